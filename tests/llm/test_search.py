import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veritab.llm import topk_join, url_filters

VECTORS = "vec_id long, embedding array<float>, label int, part long, n int, ids string"


def vectors(spark, rows):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 0, 1, 2, "z") for k, v in rows], VECTORS)


def brute(rows):
    ok = {}
    for k, v in rows:
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.setdefault(k, [math.floor(256 * float(np.float32(x))) for x in v])
    narrow = lambda s: max(1 - (1 << 63), min((1 << 63) - 1, s))
    out = []
    for q in sorted(k for k in ok if k % 50 == 0):
        scores = sorted((-narrow(sum(a * b for a, b in zip(ok[q], ok[k], strict=False))), k) for k in ok if k != q)[:5]
        out += [(q, r, k, -s) for r, (s, k) in enumerate(scores, 1)]
    return out


@pytest.mark.parametrize("block", [2048, 7])
def test_top_k_is_exact(spark, block, monkeypatch):
    monkeypatch.setattr(topk_join, "BLOCK", block)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 8))
    rows = [(k, (centres[k % 6] + 0.1 * rng.normal(size=8)).tolist()) for k in range(400)]
    rows += [(k, [0.5] * 8) for k in range(400, 520)] + [(1000, None), (1050, []), (1100, [None] * 8), (1150, [math.nan] * 8), (1200, [math.inf] * 8), (None, [1.0] * 8)]
    rows += rows[50:60] * 7 + rows[100:104]
    found = topk_join.op2_topk_search(vectors(spark, rows).repartition(5))
    assert sorted(tuple(r) for r in found.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows)


def test_vectors_of_any_length_and_size(spark):
    """Shorter vectors count as filled with zeros; large components stay exact, and scores beyond 64 bits are refused."""
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=1 + k % 5).tolist()) for k in range(200)]
    rows += [(k, (1e6 * rng.normal(size=3)).tolist()) for k in range(200, 230)] + [(k, [2.0**22, 3.0]) for k in range(250, 252)]
    found = topk_join.op2_topk_search(vectors(spark, rows))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def test_huge_and_empty_vectors_take_part(spark):
    """Scores beyond 64 bits stay at the bound; the others of the table are not touched by it."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=3).tolist()) for k in range(160)]
    rows += [(k, v) for k, v in zip(range(200, 212), ([1e30, 1.0], [1e30, 2.0], [-1e30, 1.0], [3e38, 0.0, 1.0], [-3e38], [1e17, 1e17], [], [], [0.0], [1e30, -1e30], [2.0**40, 2.0**20], [1e-30]), strict=True)] + [(250, [])]
    assert sorted(tuple(r) for r in topk_join.op2_topk_search(vectors(spark, rows)).collect()) == brute(rows)
    none = [(0, []), (50, []), (51, [])]
    assert sorted(tuple(r) for r in topk_join.op2_topk_search(vectors(spark, none)).collect()) == brute(none)
    doubles = spark.createDataFrame([(0, [1e308, 1.0]), (1, [1e308]), (2, [-1e308]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    found = [(r.vec_id, r.score) for r in topk_join.op2_topk_search(doubles).orderBy("rank").collect()]
    assert found == [(1, (1 << 63) - 1), (3, 256 * 1280), (2, 1 - (1 << 63))]


def test_few_vectors(spark):
    assert not topk_join.op2_topk_search(vectors(spark, [])).collect()
    assert not topk_join.op2_topk_search(vectors(spark, [(0, [1.0])])).collect()
    rows = [(0, [1.0, 2.0]), (50, [0.0, -1.0]), (3, [-1.0, 0.0])]
    assert sorted(tuple(r) for r in topk_join.op2_topk_search(vectors(spark, rows)).collect()) == brute(rows)


def test_groups_that_cannot_reach_are_left_out(spark):
    pivots = np.array([[100.0, 0.0], [-100.0, 0.0]])
    summaries = {0: (1, 5.0, np.zeros(6)), 1: (1, 5.0, np.zeros(6))}
    queries = spark.createDataFrame([(0, [90.0, 0.0])], "vec_id long, v array<double>")
    assert [r.part for r in topk_join._routed(queries, pivots, summaries, 5).collect()] == [0]


def test_queries_do_not_travel_once_for_each_group_and_block(spark, monkeypatch):
    """Many small blocks of many groups: a query goes to a place once, and no task sends the driver a list of pivots of its own."""
    monkeypatch.setattr(topk_join, "EACH", 8)
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist()) for k in range(3000)]
    met, many = [], topk_join._solved
    monkeypatch.setattr(topk_join, "_solved", lambda pairs, *rest: met.append(pairs.count()) or many(pairs, *rest))
    data = vectors(spark, rows).repartition(20)
    assert sorted(tuple(r) for r in topk_join.op2_topk_search(data).collect()) == brute(rows)
    assert met[0] <= 100  # blocks of queries times blocks of data: thousands, where each group has its own
    shares = topk_join._pivots(topk_join.quantised(data), 3000, 4)
    assert 250 < len(shares) < 500


@pytest.mark.parametrize("places", [1, 5])
def test_groups_lie_in_one_or_several_places(places, monkeypatch):
    monkeypatch.setattr(topk_join, "BLOCK", 10)
    found = topk_join._places({0: (3, 1.0, None), 2: (100, 1.0, None), 7: (4, 1.0, None)}, places)
    assert [x for p in found.values() for x in p] and max(x for p in found.values() for x in p) < places and all(len(p) for p in found.values())
    assert len(found[2]) == places


URLS = [
    (None, "", "", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("http://", "", "", None, "allow"),
    ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://example.org", "example.org", "", None, "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    ("http://x.com/DE/1", "x.com", "/DE/1", None, "allow"),
    ("http://www.free-bets.com/fr/1", "www.free-bets.com", "/fr/1", "com/fr/", "allow"),
    ("http://www.free-bets.net/fr/1", "www.free-bets.net", "/fr/1", None, "block"),
    ("http://casino-win.spam-farm.net/", "casino-win.spam-farm.net", "/", None, "block"),
    ("http://carefree-bets.net/", "carefree-bets.net", "/", None, "allow"),
    ("http://h?a://b/c", "h", "", None, "allow"),
    ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
]


def test_urls(spark, monkeypatch):
    pages = spark.createDataFrame([(k, u, "<p>", "x", 1) for k, (u, *_) in enumerate(URLS)], "page_id long, url string, html string, host string, tokens int")
    found = {r.page_id: r for r in url_filters.op5_url_filters(pages.union(pages)).collect()}
    for k, (url, *want) in enumerate(URLS):
        assert [found[k].host, found[k].path, found[k].rule, found[k].verdict] == want, url
    assert next(r.pattern for r in found.values() if r.host == "casino-win.spam-farm.net") == url_filters.PATTERN_RULES[-1]
    monkeypatch.setattr(url_filters, "INLINE_RULES", 3)
    joined = url_filters.op5_url_filters(pages.union(pages))
    assert sorted(map(str, joined.collect())) == sorted(map(str, url_filters.op5_url_filters(pages.union(pages)).collect()))
    assert {str(r) for r in joined.collect()} == {str(r) for r in found.values()}
    assert not url_filters.op5_url_filters(pages.limit(0)).collect()
    assert "Python" not in url_filters.op5_url_filters(pages)._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")


def test_rules_are_filed_under_rare_tokens(spark):
    pages = url_filters.parts(spark.createDataFrame([("http://a.b.com/x",)] * 3 + [("http://a.org/",)], "url string"))
    assert url_filters.rarest(pages, [["com", "a"], ["org", "a"], ["zz", "org"]]) == ["com", "org", "zz"]
    assert url_filters.literal_tokens(r"(^|[.-])free-bets\.") == ["free", "bets"]
    with pytest.raises(ValueError):
        url_filters.verdicts(pages.withColumn("page_id", F.lit(1)), [], [".*"])
