"""Operators 11 to 13 against plain Python and against SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest_llm import SCHEMA, frame
from pyspark.sql import functions as F

from veritab.llm import lexical, mixing, queries, vector_codes

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label string, v int, wide int, code string, error long, cell int"


@pytest.mark.parametrize("name", ["op11_source_mix", "op12_lexical_search", "op13_vector_codes"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.ORACLE_SQL[name]).fetchall()
    order = [c[0] for c in con.description]
    assert sorted(map(repr, map(tuple, got.select(order).collect()))) == sorted(map(repr, want))


# -- mixing


def sources(spark, rows):
    return spark.createDataFrame([(k, t, None, s, 0, 1, "a", "k", 2) for k, t, s in rows], SCHEMA)


def filled(sizes, weights, most):
    """Targets by rounds of whole fractions."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        open_ = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        over = {s for s in open_ if rest * w[s] > most * sizes[s] * sum(w[x] for x in open_)}
        if not over:
            return {s: float(most * sizes[s]) if s in full else rest * w[s] / sum(w[x] for x in open_) for s in names}
        full |= over


def test_targets_and_words_taken(spark):
    rng = random.Random(5)
    rows = []
    for source, n, words in (("a", 300, 20), ("b", 40, 900), ("c", 500, 15), ("é", 5, 3), ("", 60, 40), (None, 80, 50), ("silent", 30, 0)):
        rows += [(len(rows) + k, " ".join(["w"] * rng.randint(0, 2 * words)), source) for k in range(n)]
    rows += [(None, "x y z", "a"), (None, None, "a"), (3, "again", "c"), (3, "again", "c")]
    found = mixing.op11_source_mix(sources(spark, rows)).collect()
    sizes = Counter({s: 0 for _, _, s in rows})
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = filled(sizes, (5, 2, 1), 3)
    assert len(found) == len(rows) and len({(r.source_size, r.target) for r in found}) >= 6
    by_source = {(sizes[s], t): s for s, t in want.items()}
    taken = Counter()
    for r in found:
        taken[by_source[r.source_size, r.target]] += r.taken
        assert r.taken <= 3 * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 60), s
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.op11_source_mix(sources(spark, rows[::-1]).repartition(7)).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, found))


def test_mix_emits_whole_rows(spark, monkeypatch):
    rows = [(k, f"w{k} x", "s%d" % (k % 3)) for k in range(90)] + [(90, None, "s0"), (None, "", None)]
    docs = sources(spark, rows)
    plain = Counter(tuple(r) for r in mixing.mix(docs).collect())
    assert mixing.mix(docs).columns == docs.columns
    copies = {r.doc_id: r.copies for r in mixing.op11_source_mix(docs).collect()}
    assert Counter(k[0] for k in plain.elements()) == Counter({k: n for k, n in copies.items() if n})
    monkeypatch.setattr("veritab.llm.shared.COPIED", (0, 0))  # a list of sources too large to copy
    assert Counter(tuple(r) for r in mixing.mix(docs).collect()) == plain


def test_mix_of_nothing(spark, empty):
    assert not mixing.op11_source_mix(empty).collect() and not mixing.mix(empty).collect()
    one = mixing.op11_source_mix(sources(spark, [(1, None, None)])).collect()
    assert [tuple(r)[:5] for r in one] == [(1, 0, 0, 0.0, 0)]


# -- lexical search


def plain_search(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    texts = [(d, split(t)) for d, t in docs]
    n, total = sum(1 for _, t in texts if t), sum(len(t) for _, t in texts)
    df = Counter(x for _, t in texts for x in set(t))
    chosen = {}
    for i, t in items:
        if t is not None:
            chosen[i] = min(chosen.get(i, t), t)
    out = []
    for i, text in chosen.items():
        scored = []
        for d, t in texts:
            tf, s = Counter(t), 0
            for x in split(text):
                if x in tf:
                    m = 75 + 25 * len(t) * n // total
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m))
            if s:
                scored.append((-s, d is None, d, s))
        out += [(i, rank, d, s) for rank, (_, _, d, s) in enumerate(sorted(scored, key=lambda r: (r[0], r[1], r[2] or 0))[:k], 1)]
    return sorted(map(repr, out))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(1, 3)))
    docs = [(k, " ".join(word() for _ in range(rng.choice((0, 3, 30, 300))))) for k in range(700)]
    docs += [(k, "Same-same copy_of Ünï çödé 漢字") for k in range(2000, 2090)]  # more ties than are asked for
    docs += [(k, None) for k in range(3000, 3010)] + [(None, "copy of abc"), (None, "copy of abc"), (5, "aab"), (5, "aab"), (9000, "long " + "ab " * 200_000)]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(25)]
    items += [(100, "same COPY, copy; çödé"), (101, None), (102, ""), (103, "... ---"), (104, "nowhere"), (None, "abc"), (105, "b b b"), (105, "a")]
    return docs, items


def run_search(spark, corpus, parts=3):
    docs, items = corpus
    rows = sources(spark, [(d, t, "s") for d, t in docs]).repartition(parts)
    return sorted(repr(tuple(r)) for r in lexical.op12_lexical_search(rows, spark.createDataFrame([(*i, 1, 1) for i in items], "item_id long, text string, rank int, score int")).collect())


def test_search_is_exact(spark, corpus):
    assert run_search(spark, corpus) == plain_search(*corpus, 20)


def test_search_with_small_ranges_and_blocks(spark, corpus, monkeypatch):
    """Many ranges, few first ones, and queries in several blocks give the same."""
    for name, value in (("RANGE", 40), ("POSTINGS", 900), ("FIRST", 1), ("TERMS", 200), ("ITEMS", 10)):
        monkeypatch.setattr(lexical, name, value)
    assert run_search(spark, corpus) == plain_search(*corpus, 20)


def test_branches_are_left_out(spark):
    """The tree opens few nodes for a rare term, and all nodes of equal bound for ties."""
    block = lexical.Block([0], [b"rare common"])
    docs = [b"common " * (1 + k % 7) + (b"rare" if k in (700, 701, 3000) else b"") for k in range(4096)]
    frame_ = spark.createDataFrame([(k, t.decode()) for k, t in enumerate(docs)], "doc_id long, text string").coalesce(1)
    postings = lexical._postings(frame_, block.vocabulary)
    n, total = postings.agg(F.sum("docs"), F.sum("terms")).first()
    block.weigh(n, lexical._holding(postings, len(block.vocabulary)))
    row = lexical._index(postings, n, total).first()
    tree = lexical._Tree([bytes(x) for x in row[2:]])
    weights = np.append(block.weight, 0)[np.argsort(block.term)] if list(block.term) != [0, 1] else block.weight
    bound = int(block.bounds(*tree.root)[0])
    found, _, opened = tree.search(weights, bound, 1, 3)
    assert set(found) >= {700, 701, 3000} and opened < 20


def test_search_of_nothing(spark, empty):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert not lexical.op12_lexical_search(empty, items).collect()
    assert not lexical.op12_lexical_search(frame(spark, ["a b"]), items.where("false")).collect()
    assert lexical.op12_lexical_search(empty, items).columns == ["item_id", "rank", "doc_id", "score"]


# -- vector codes


def plain_codes(rows):
    kept = [(i, [math.floor(4096 * c) if abs(c) < 1e300 else 4096 * int(c) for c in v], label) for i, v, label in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    if not kept:
        return []
    w = -(-max(len(v) for _, v, _ in kept) // 8)
    cut = lambda v: [(v + [0] * (8 * w))[p * w : (p + 1) * w] for p in range(8)]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], r[1])):
        first.setdefault(i, v)
    books = [[cut(v)[p] for v in list(first.values())[:16]] for p in range(8)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))  # noqa: E731, B905
    for _ in range(6):
        for p in range(8):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k], strict=True)] if k in groups else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    done = [(i, label, [near(x, b) for x, b in zip(cut(v), books, strict=True)]) for i, v, label in kept]
    total = Counter()
    for _, label, ds in done:
        total[label] += min(sum(d for d, _ in ds), (1 << 63) - 1)
    return sorted(repr((i, bytes(k for _, k in ds).hex(), min(sum(d for d, _ in ds), (1 << 63) - 1), min(total[label], (1 << 63) - 1), sha)) for i, label, ds in done)


def codes(spark, rows, parts=4):
    table = spark.createDataFrame([(i, v, label, 1, 2, "x", 3, 4) for i, v, label in rows], VECTORS).repartition(parts)
    return sorted(repr(tuple(r)) for r in vector_codes.op13_vector_codes(table).collect())


def vectors(seed, n, width=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, width))
    return [(int(k), (centres[k % 9] + 0.2 * rng.normal(size=width)).tolist(), "l%d" % (k % 3)) for k in rng.permutation(n) * 3]


def test_codes(spark):
    rows = vectors(1, 300)
    rows += [(7, None, "a"), (8, [None] * 16, "a"), (10, [math.nan] * 16, "a"), (11, [math.inf] + [0.0] * 15, "a"), (None, [0.5] * 16, None), (None, [0.1] * 16, None)]
    rows += rows[:20] + [(0, [0.25] * 16, "l1"), (5, [-1e-9] * 16, None)]
    assert codes(spark, rows) == plain_codes(rows)
    assert codes(spark, rows, 1) == plain_codes(rows)


def test_codes_of_few_short_and_huge_vectors(spark):
    assert codes(spark, []) == []
    few = [(1, [1.0] * 8, "a"), (2, [2.0] * 8, "a"), (2, [2.0] * 8, "b")]
    assert codes(spark, few) == plain_codes(few)
    odd = [(k, v[: 1 + k % 19], x) for k, v, x in vectors(2, 60, 19)] + [(1000, [], "e")]
    assert codes(spark, odd) == plain_codes(odd)
    huge = vectors(3, 40, 8) + [(1, [1e308] * 8, "h"), (2, [-1e308] * 8, "h"), (5000, [1e5] * 8, "h"), (5001, [1e30, *[0.0] * 6, 1.0], "h")]
    assert codes(spark, huge) == plain_codes(huge)
    nobody = spark.createDataFrame([(None, [1.0] * 8, "a", 1, 2, "x", 3, 4)], VECTORS)
    assert [tuple(r)[:4] for r in vector_codes.op13_vector_codes(nobody).collect()] == [(None, None, None, None)]


def test_annulus_evaluates_few_entries():
    rng = np.random.default_rng(4)
    entries = [[int(1000 * k * math.cos(k)), int(1000 * k * math.sin(k))] for k in range(16)]
    near = vector_codes.Annulus(entries)
    x = np.array(entries)[rng.integers(0, 16, 5000)] + rng.integers(-300, 300, (5000, 2))
    entry, d = near.nearest(x)
    every = ((x[:, None, :] - np.array(entries)[None]) ** 2).sum(axis=2)
    assert (entry == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert near.evaluated < 3 * len(x)  # of 16
