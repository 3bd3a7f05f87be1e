import hashlib
import random

import brute
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import frame, prose

import corpus_pipeline
from veritab.llm import minhash, paragraph_dedup, suffix_dedup, textbytes
from veritab.llm.components import components


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (101, 100), (5, 5), (None, 3), (200, 100)]
    found = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 200: 100}
    assert not components(spark.createDataFrame([], "a long, b long")).collect()


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, texts, size):
    found = {r.id: r for r in minhash.near_duplicates(docs.selectExpr("doc_id AS id", "text"), size).collect()}
    sets = [brute.shingles(t, size) for t in texts]
    assert [found[k].n_shingles for k in range(len(texts))] == list(map(len, sets))
    assert [found[k].component for k in range(len(texts))] == brute.components(sets)


def test_digest_of_repeated_rows_and_null_ids(spark, docs, empty):
    null = docs.where("doc_id in (4, 5)").selectExpr("CAST(NULL AS BIGINT) AS doc_id", *docs.columns[1:])
    found = minhash.op1_minhash_dedup(docs.union(docs.limit(3)).union(null))
    rows = found.collect()
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"] and len(rows) == docs.count() + 5
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)
    alone = [r for r in rows if r.doc_id is None]
    assert len(alone) == 2 and all(r.kept and r.component_id is None and r.n_shingles > 0 for r in alone)
    assert not minhash.op1_minhash_dedup(empty).collect()


@pytest.mark.parametrize("rows", [1, 2, 3, 1000])
def test_buckets_stream_over_batches(spark, rows):
    """Members, their smallest ids and predecessors, whatever the size of Arrow batches."""
    rng = random.Random(rows)
    pairs = [(rng.randrange(12), rng.randrange(40)) for _ in range(150)] + [(99, 7), (99, 7), (98, 5)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        found = sorted(tuple(r) for r in minhash._members(spark.createDataFrame(pairs, "bucket long, id long")).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for bucket in {b for b, _ in pairs}:
        ids = sorted({i for b, i in pairs if b == bucket})
        want += [(bucket, i, ids[0], ids[max(0, k - 1)]) for k, i in enumerate(ids) if len(ids) > 1]
    assert found == sorted(want)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_chain_across_components(spark, monkeypatch, block):
    """Links that only the comparison across components finds, in buckets that are banded again and in blocks of few members."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(4)
    text, chain = prose(rng, 120, 10_000).split(), []
    for k in range(30):
        chain.append(" ".join(text))
        for p in rng.sample(range(120), 4):
            text[p] = f"new{k}x{p}"
    rng.shuffle(chain)
    found = {r.id: r.component for r in minhash.near_duplicates(frame(spark, chain).selectExpr("doc_id AS id", "text"), 2).collect()}
    assert [found[k] for k in range(30)] == brute.components([brute.shingles(t, 2) for t in chain])


def crowd(rng, families=40, share=0.03):
    """Pairs of near copies that share half of their words with all others, in any order."""
    common, out = prose(rng, 60, 10**6).split(), []
    for k in range(families):
        own = [f"own{k}x{j}" for j in range(60)]
        for side in "ab":
            out.append(" ".join(common + [w if rng.random() > share else f"{side}{k}x{j}" for j, w in enumerate(own)]))
    rng.shuffle(out)
    return out


def linked_within_bands(texts, bands, rows, words=2):
    """Components by the links of pairs that share any band, by plain comparison of all pairs."""
    scale = minhash._multipliers(bands * rows)
    grids = [minhash.registers(x, scale).reshape(bands, rows) for x in minhash.shingle_sets(*textbytes.buffers(pa.array(texts)), words)]
    sets, low = [brute.shingles(t, words) for t in texts], list(range(len(texts)))
    meets = lambda i, j: (grids[i] == grids[j]).all(axis=1).any() and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    links = [(i, j) for i in range(len(texts)) for j in range(i) if meets(i, j)]
    for _ in texts:
        for i, j in links:
            low[i] = low[j] = min(low[i], low[j])
    return low


@pytest.mark.parametrize("bands, rows", [(1, 1), (2, 2), (3, 1)])
@pytest.mark.parametrize("block", [1, 4])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, block, bands, rows):
    """Near copies that share one band only, in buckets with many members that are alike by half."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = crowd(random.Random(21))
    found = {r.id: r.component for r in minhash.near_duplicates(frame(spark, texts).selectExpr("doc_id AS id", "text"), 2, 80, bands, rows).collect()}
    want = linked_within_bands(texts, bands, rows)
    assert len(set(want)) < len(texts)
    assert [found[k] for k in range(len(texts))] == want


def test_crowded_paragraphs_lose_no_link(spark, monkeypatch):
    """The same among lines, of which the later one of each group goes."""
    for module, name, value in ((minhash, "BLOCK", 1), (paragraph_dedup, "BANDS", 2), (paragraph_dedup, "ROWS", 2)):
        monkeypatch.setattr(module, name, value)
    texts = crowd(random.Random(22), share=0.015)
    found = {r.doc_id: r.removed for r in paragraph_dedup.repeated_paragraphs(frame(spark, texts)).collect()}
    want = linked_within_bands(texts, 2, 2, 5)
    assert len(set(want)) < len(texts)
    assert found == {k: [0] for k, low in enumerate(want) if k != low}


def test_crowded_documents_in_the_pipeline_lose_no_link(spark, monkeypatch):
    """The stage keeps one document of each group."""
    whole = minhash.near_duplicates
    monkeypatch.setattr(minhash, "BLOCK", 1)
    monkeypatch.setattr(minhash, "near_duplicates", lambda docs, words, percent: whole(docs, words, percent, 1, 1))
    texts = crowd(random.Random(31), share=0.015)
    kept = dict(corpus_pipeline.STAGES)["MinHash near-dedup"](spark, frame(spark, texts), "")
    want = linked_within_bands(texts, 1, 1, 5)
    assert len(set(want)) < len(texts)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_likelihood_keeps_pairs_above_the_threshold():
    rng = np.random.default_rng(2)
    scale = minhash._multipliers(160)
    for share, kept in ((0.85, True), (0.2, False)):
        common = rng.integers(0, 1 << 63, int(1000 * share), dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 1000 - len(common), dtype=np.uint64)]) for _ in "ab")
        if kept:
            b = np.concatenate([common, b[len(common) :][:50]])
        x, y = minhash.registers(a, scale), minhash.registers(b, scale)
        assert minhash.likely(np.array([len(a)]), np.array([len(b)]), (x > y).sum(keepdims=True), (x < y).sum(keepdims=True), 160, 0.8)[0] == kept


def test_sketches_merge_by_maximum():
    rng, scale = np.random.default_rng(3), minhash._multipliers(32)
    a, b = (rng.integers(0, 1 << 63, 500, dtype=np.uint64) for _ in "ab")
    assert (minhash.registers(np.union1d(a, b), scale) == np.maximum(minhash.registers(a, scale), minhash.registers(b, scale))).all()


def test_keep_one(docs, texts):
    kept = minhash.keep_one(docs)
    assert kept.columns == docs.columns
    groups = brute.components([brute.shingles(t, 5) for t in texts])
    assert sorted(r.doc_id for r in kept.collect()) == [k for k, g in enumerate(groups) if k == g]


@pytest.mark.parametrize("hot, tracked", [(2_000, 1 << 20), (1, 1 << 20), (1, 5)])
def test_suffix_dedup(docs, texts, hot, tracked, monkeypatch):
    """Without, with all, and with few of the trigger strings split."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "TRACKED", tracked)
    found = {r.doc_id: r for r in suffix_dedup.op4_suffix_dedup(docs).collect()}
    for k, flags in enumerate(brute.removed(texts)):
        raw = (texts[k] or "").encode()
        left = bytes(c for c, gone in zip(raw, flags, strict=True) if not gone)
        want = (len(raw), sum(flags), len(bytes(flags).replace(b"\0", b" ").split()), hashlib.sha256(left).hexdigest())
        assert tuple(found[k])[1:] == want, k


def test_suffix_dedup_edges(docs, empty, texts):
    assert not suffix_dedup.op4_suffix_dedup(empty).collect()
    twice = suffix_dedup.op4_suffix_dedup(docs.where("doc_id = 6").union(docs.where("doc_id = 6"))).collect()
    assert len(twice) == 2 and twice[0].n_removed == twice[1].n_removed == 0
    cut = suffix_dedup.without_repeats(docs)
    assert cut.columns == docs.columns and all(r.n_chars == len(r.text) for r in cut.collect())


def with_null_ids(frame_):
    return frame_.selectExpr("CAST(NULL AS BIGINT) AS doc_id", *frame_.columns[1:])


def test_null_ids_lose_nothing(docs, texts):
    many = with_null_ids(docs)
    for operator in (suffix_dedup.op4_suffix_dedup, paragraph_dedup.op10_paragraph_dedup):
        rows = operator(docs.unionByName(many)).where("doc_id is null").collect()
        assert len(rows) == len(texts) and not any(r.n_removed for r in rows)
    for stage in (minhash.keep_one, suffix_dedup.without_repeats, paragraph_dedup.without_repeats):
        kept = stage(docs.unionByName(many)).where("doc_id is null").collect()
        assert sorted(r.text or "" for r in kept) == sorted(t or "" for t in texts), stage


def test_frequent_strings_are_counted_over_all_batches(spark, docs, monkeypatch):
    """One phrase a batch of a trigger string still adds up."""
    monkeypatch.setattr(suffix_dedup, "HOT", 20)
    rng = random.Random(3)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(90))
    texts = ["".join(rng.choice("xyzuvw ") for _ in range(150)) + shared + "".join(rng.choice("xyzuvw ") for _ in range(150)) for _ in range(60)]
    one = frame(spark, texts).coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1)
    try:
        assert len(suffix_dedup._frequent(one.select("doc_id", "text"), 100)) >= 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_paragraphs(docs, empty, texts):
    found = {r.doc_id: r.removed for r in paragraph_dedup.repeated_paragraphs(docs).collect()}
    units = [(k, n, line) for k, t in enumerate(texts) for n, line in enumerate(x for x in (t or "").split("\n") if len(brute.words(x)) >= paragraph_dedup.WORDS)]
    groups = brute.components([brute.shingles(line, 5) for _, _, line in units])
    hits = {}
    for u, g in enumerate(groups):
        if u != g:
            hits.setdefault(units[u][0], []).append(units[u][1])
    assert found == hits and not paragraph_dedup.op10_paragraph_dedup(empty).collect()
    spans = {r.doc_id: r for r in paragraph_dedup.op10_paragraph_dedup(docs).collect()}
    cut = {r.doc_id: r for r in paragraph_dedup.without_repeats(docs).collect()}
    for k, t in enumerate(texts):
        assert spans[k].n_bytes == len((t or "").encode()) and spans[k].kept_sha256 == hashlib.sha256(cut[k].text.encode()).hexdigest()
        assert spans[k].n_removed == spans[k].n_bytes - len(cut[k].text.encode()) and cut[k].n_chars == len(cut[k].text)
        assert (spans[k].n_removed > 0) >= (k in hits)


@pytest.mark.parametrize("step", [-1, 1 << 58])
def test_paragraphs_of_any_doc_id(spark, docs, texts, step):
    """Negative ids and ids too far apart to be numbered by their difference."""
    moved = docs.withColumn("doc_id", docs["doc_id"] * step - 5) if step < 0 else docs.withColumn("doc_id", (docs["doc_id"] - 15) * step)
    few = moved.where("key = 'y' and text is not null")
    found = paragraph_dedup.op10_paragraph_dedup(few).collect()
    assert len(found) == few.count() and any(r.n_removed for r in found)


def test_passages_in_long_lines_and_wrapped_text(spark):
    """A passage of 60 words alone, inside a longer line, wrapped under 20 words a line, across lines, and with one edit."""
    rng = random.Random(8)
    passage, fill = prose(rng, 60, 10**6).split(), lambda n: prose(rng, n, 10**6).split()
    edited = [*passage[:30], "edit", *passage[31:]]
    wrapped = "\n".join(" ".join(passage[k : k + 12]) for k in range(0, 60, 12))
    around = [fill(150) for _ in range(8)]
    forms = [" ".join(passage), " ".join(around[0] + passage + around[1]), " ".join(around[2]) + "\n" + wrapped, " ".join(around[3] + passage[:30]) + "\n" + " ".join(passage[30:] + around[4]), " ".join(around[5] + edited + around[6]), " ".join(around[7])]
    both = frame(spark, forms).unionByName(frame(spark, forms).where("doc_id = 5"))
    found = {r.doc_id: r for r in paragraph_dedup.op10_paragraph_dedup(both).collect()}
    assert [found[k].n_spans for k in range(6)] == [0, 1, 1, 1, 2, 0]  # the edit stays
    passages = {r.doc_id: r for r in paragraph_dedup.repeated_passages(both).collect()}
    for k in range(1, 5):
        cut = [w for x, y in zip(passages[k].first, passages[k].last, strict=True) for w in forms[k].encode()[x:y].decode().split()]
        assert cut == (passage if k < 4 else [*passage[:30], *passage[31:]])


@pytest.mark.parametrize("least, edits, want", [(51, 0, 0.99), (25, 0, 0.9), (51, 1, 0.9)])
def test_recall_of_passages(spark, least, edits, want):
    """Passages inside lines of two documents each, exact or with words edited: almost all bytes go, no other word does, other documents stay whole."""
    rng = random.Random(12)
    texts, due = [], {}
    for n in range(60):
        passage = prose(rng, rng.randrange(least, least + 25), 10**5).split()
        for second in (False, True):
            copy = passage[:]
            if second:
                for p in rng.sample(range(5, len(copy) - 5), edits):
                    copy[p] = f"new{n}"
                due[len(texts)] = [w for w in copy if not w.startswith("new")]
            around = [" ".join(f"{side}{len(texts)}x{k}" for k in range(rng.randrange(20, 90))) for side in "ab"]
            texts.append(f"{around[0]} {' '.join(copy)} {around[1]}")
            texts.append(prose(rng, 120, 10**5))
    found = {r.doc_id: r for r in paragraph_dedup.repeated_passages(frame(spark, texts)).collect()}
    cut = {k: [w for x, y in zip(r.first, r.last, strict=True) for w in texts[k].encode()[x:y].decode().split()] for k, r in found.items()}
    assert set(cut) <= set(due) and len(cut) >= 0.95 * len(due)
    assert all(not set(cut[k]) - set(due[k]) for k in cut)
    assert sum(map(len, cut.values())) >= want * sum(map(len, due.values()))


def test_words_between_two_passages_stay(spark):
    """Two repeated passages with words of a document's own between them, and units that stream in batches of any size."""
    rng = random.Random(14)
    one, two, own = (prose(rng, n, 10**6).split() for n in (40, 50, 15))
    texts = [" ".join(one), " ".join(two), " ".join([*one, *own, *two]), " ".join([*one, *own[:3], *two])]
    for rows in (1, 3, 1000):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            found = {r.doc_id: r for r in paragraph_dedup.repeated_passages(frame(spark, texts)).collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert set(found) == {2, 3}
        cut = {k: " ".join(texts[k].encode()[x:y].decode() for x, y in zip(r.first, r.last, strict=True)) for k, r in found.items()}
        assert cut[2].split() == [*one, *two]
        assert cut[3].split() in ([*one, *two], [*one, *own[:3], *two])  # the three words stand earlier as well


def test_very_long_texts(spark):
    """Texts of some MB, which share a passage."""
    rng = random.Random(13)
    passage = prose(rng, 400, 10**5)
    long_ = [prose(rng, 300_000, 10**6) + "\n" + passage + "\n" + prose(rng, 300_000, 10**6) for _ in range(2)]
    found = {r.doc_id: r for r in paragraph_dedup.op10_paragraph_dedup(frame(spark, long_)).collect()}
    assert found[0].n_removed == 0 and found[1].n_removed >= len(passage)
    exact = {r.doc_id: r for r in suffix_dedup.op4_suffix_dedup(frame(spark, long_)).collect()}
    assert exact[0].n_removed == 0 and len(passage) <= exact[1].n_removed < 2 * len(passage)
    assert [r.kept for r in minhash.op1_minhash_dedup(frame(spark, long_ + long_[:1])).orderBy("doc_id").collect()] == [True, True, False]


def test_repeated_rows_do_not_multiply(spark):
    """Three rows of one doc_id: near-dedup keeps one of each text, the cutting stages give back as many rows as they got."""
    text = prose(random.Random(9), 60, 10**6)
    three = frame(spark, [text]).unionByName(frame(spark, [text])).unionByName(frame(spark, [text]))
    cut = suffix_dedup.without_repeats(three)
    assert cut.columns == three.columns and [(r.text, r.n_chars, r.lang, r.key) for r in cut.collect()] == [(text, len(text), "en", "y")] * 3
    assert [(r.doc_id, r.text) for r in minhash.keep_one(three).collect()] == [(0, text)]
    other = frame(spark, [prose(random.Random(10), 60, 10**6)])
    assert minhash.keep_one(three.unionByName(other)).count() == 2
    assert [r.text for r in paragraph_dedup.without_repeats(three).collect()] == [text] * 3
