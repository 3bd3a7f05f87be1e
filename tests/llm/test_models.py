import os
import random
import sys
from collections import Counter

import brute
import numpy as np
import pytest
from conftest_llm import SCHEMA, frame
from pyspark.sql import functions as F

from veritab.llm import language_id, quality_classifier, quality_rules, queries

SF = "/root/testdata/sf0.01"


def test_counts(docs, texts):
    found = {r.doc_id: r for r in quality_rules.op3_quality_rules(docs).collect()}
    assert [[found[k][c] for c in quality_rules.COUNTS] for k in range(len(texts))] == [brute.counts(t) for t in texts]
    for r in found.values():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_rules_on_odd_tables(spark, docs, empty):
    assert not quality_rules.op3_quality_rules(empty).collect()
    nulls = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "doc_id": F.lit(None).cast("long")})
    assert quality_rules.op3_quality_rules(nulls).count() == docs.count()
    one = frame(spark, [" ".join(f"w{k}" for k in range(60))] * 2)
    assert [r.kept for r in quality_rules.op3_quality_rules(one).collect()] == [True, True]


def plain_distances(rows):
    """Squared distances to a plain minimum-covariance-determinant estimate of one group: rows of counts that passed, as float vectors in steps of 1/1024."""
    w, c = np.maximum(rows[:, 0], 1), np.maximum(rows[:, 1], 1)
    x = np.round(np.stack([np.log1p(rows[:, 0]), np.log(c / w), np.sqrt(rows[:, 2] / c), np.sqrt(rows[:, 3] / w), rows[:, 4] / w], axis=1) * 1024) / 1024
    quarter = lambda q: np.sort(np.floor(x * 128), axis=0)[int(np.ceil(q * len(x))) - 1] / 128
    mean, cov, was = quarter(0.5), np.diag(((quarter(0.75) - quarter(0.25)) / 1.349) ** 2), np.inf
    floors = np.diag(np.square(quality_rules.FLOORS))
    for _ in range(quality_rules.STEPS + 1):
        away = x - mean
        distance = np.einsum("ni,ij,nj->n", away, np.linalg.inv(cov + floors), away)
        now = np.linalg.slogdet(cov + floors)[1]
        if was - now <= quality_rules.SHRINKS:
            return distance
        was = now
        bins = np.floor(16 * np.log2(distance + 1e-3))
        order = np.sort(bins)
        near = x[bins <= order[int(np.ceil(quality_rules.SHARE * len(x))) - 1]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * quality_rules.CONSISTENCY
    return distance


def test_verdicts_are_those_of_a_plain_estimate(spark):
    """A group's own convergence ends its steps, whatever the order of rows and the other groups."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    rows = sorted(quality_rules.judge(docs).collect(), key=lambda r: r.doc_id)
    passed = [r for r in rows if not r.base_failed]
    distance = plain_distances(np.array([[r[c] for c in quality_rules.COUNTS] for r in passed], float))
    assert np.allclose([r.distance for r in passed], distance, rtol=1e-6, atol=1e-9)
    assert [r.kept for r in passed] == (distance <= quality_rules.CUTOFF).tolist()
    other = docs.withColumns({"source": F.lit("z"), "doc_id": F.col("doc_id") + 10**9}).where("n_chars > 800")
    again = sorted((r for r in quality_rules.judge(docs.union(other).repartition(7)).collect() if r.doc_id < 10**9), key=lambda r: r.doc_id)
    assert [tuple(r) for r in again] == [tuple(r) for r in rows]


def test_rules_leave_good_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = queries.QUERIES["op3_quality_rules"](spark, SF).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(found)
    assert share[1] > 0.99 and share[0] < 0.4


def test_expectation_maximisation_finds_the_weak_labeller():
    patterns = {sum(v * 3**k for k, v in enumerate(votes)): n for votes, n in (((1, 1, 1, 1, 1, 1, 2), 900), ((0, 0, 1, 1, 1, 1, 2), 60), ((1, 1, 1, 1, 1, 1, 0), 40))}
    good, bad, abusive = quality_classifier.expectation_maximisation(patterns).values()
    assert good > 0.9 and bad < 0.1 and abusive < 0.1
    assert quality_classifier.expectation_maximisation({}) == {}


def test_classifier(spark, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    share = {(r.quality, r.toxic): r.k for r in queries.QUERIES["op6_quality_classifier"](spark, SF).join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1, 0] > 0.97 and share[1, 1] < 0.2
    rows = {r.doc_id: r for r in quality_classifier.op6_quality_classifier(docs).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(rows[r.doc_id].score == 0 for r in docs.where("text is null or text = ''").collect())
    assert not quality_classifier.op6_quality_classifier(empty).collect()
    assert quality_classifier.keep_good(docs).columns == docs.columns


def test_toxic_documents_of_every_language_go(spark):
    """Stems learned from one half of the labels, judged on the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)) == 0
    found = quality_classifier.op6_quality_classifier(docs, labels.where(half)).select("doc_id", "kept").join(labels.where(~half), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    share = {(r.lang, r.toxic): r.k for r in found.where("quality = 1").groupBy("lang", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert len(share) == 8
    for lang in ("de", "en", "es", "fr"):
        assert share[lang, 1] <= 0.15 and share[lang, 0] >= 0.97, share


def test_language(spark, docs, empty):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = queries.QUERIES["op7_language_id"](spark, SF).join(truth, "doc_id")
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert found.where("score < 0 or score > 1").count() == 0
    rows = {r.doc_id: r for r in language_id.op7_language_id(docs).collect()}
    for r in docs.collect():
        letters = any(c.isalpha() for c in r.text or "")
        assert rows[r.doc_id].lang_pred == ("en" if letters else "und")
    assert not language_id.op7_language_id(empty).collect()
    unknown = language_id.op7_language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}


def test_every_language_is_learned(spark):
    """Many languages with one document each; none is too rare."""
    rng = random.Random(41)
    words = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(30)] for _ in range(505)]
    rows = [(k, " ".join(w), f"l{k:03}") for k, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert model.languages == [lang for _, _, lang in rows]
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert sum(found[k] == lang for k, _, lang in rows[-5:]) >= 4


def test_copies_of_a_document_take_no_language_away(spark, monkeypatch):
    """Rows of one doc_id and text are chosen all or none."""
    monkeypatch.setattr(language_id, "DOCUMENTS_PER_LANGUAGE", 5)
    for first in range(3):
        rows = [(first, "ein Satz", "de")] * 60 + [(100 + k, f"one sentence {k}", "en") for k in range(12)]
        chosen = Counter(r["lang"] for r in language_id.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string")))
        assert chosen["de"] == 10 and 1 <= chosen["en"] <= 10


def test_predictions_do_not_use_lang_source_or_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.col("doc_id") + 1})
    a, b = (sorted((r.lang_pred, r.score) for r in language_id.predict(d, model).collect()) for d in (docs, other))
    assert a == b


@pytest.mark.skipif(not os.path.exists(os.path.join(os.path.dirname(queries.__file__), "..", "..", "corpus_pipeline.py")), reason="no pipeline here")
def test_pipeline(spark, docs, empty):
    sys.path.insert(0, os.path.join(os.path.dirname(queries.__file__), "..", ".."))
    import corpus_pipeline

    for table in (docs, empty):
        now = table.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() >= 0
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1 and toxic = 0")
    whole = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, corpus_pipeline.quality(spark, whole, SF), SF)
    assert kept.join(labels, "doc_id").count() > 0.98 * labels.count() and SCHEMA
