"""Quality classifier trained without labels of quality.

Overlapping heuristic labellers vote good, bad or nothing on every document.  Votes
form few patterns, so the whole corpus reduces to counts of patterns; on these,
expectation-maximisation estimates each labeller's confusion table and the posterior of
every pattern.  Labellers that look at something no other does (the abuse list) would
be taken for noise; their tables are anchored by hand.  Posteriors label a bounded
sample, on which a linear model over hashed words and votes is trained; it scores all.

Abuse is known in English as a list.  For every other language the beginnings of words
that toxic documents use far more often are learned from a bounded sample of the labels
table (toxic 0 or 1; its quality is not read).  Without labels only the list counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .minhash import shingle_sets
from .quality_rules import count_batch
from .shared import clashing, materialize

#: Documents on which the linear model is trained, about.
TRAINING_DOCUMENTS = 8_000
#: Labelled documents of each class, toxic and clean, from which toxic stems are learned, about.  Bounds that are not over all data: these two.
LABELLED_DOCUMENTS = 6_000
#: Labelled texts that share one of so many minima of hashed shingles count as one.
MINIMA = 4
#: Lengths in bytes of the beginnings of words; whole words count as well.
STEM_BYTES = range(4, 9)
#: A stem stands in so many toxic documents at least, in so many times the share of the clean ones, with such a likelihood ratio statistic.
STEM_DOCUMENTS, STEM_RATIO, STEM_EVIDENCE = 3, 6.0, 20.0
#: A document with so many stems, and one in so many words, is abusive.
STEMS, STEM_WORDS = 2, 100
#: Hash buckets for words.
WIDTH = 1 << 16
#: Documents with a lower score are rejected.
THRESHOLD = 0.5

#: Words of abuse that a clean text does not use.
ABUSE = ["clown", "disgusting", "idiot", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless"]

BAD, GOOD, NOTHING = 0, 1, 2
LABELLERS = ["symbols", "capitals", "exclamations", "repeated words", "repeated lines", "length of words", "abuse"]
#: P(vote bad, good, nothing | class bad) and (... | class good) that are not learned.
ANCHORED = {"abuse": ((0.3, 0.0, 0.7), (1e-6, 0.0, 1 - 1e-6))}

#: How a labeller is believed to vote (bad, good, nothing) on bad and on good documents, and the weight of that belief.
PRIOR = ((0.2, 0.7, 0.1), (0.002, 0.898, 0.1))
PRIOR_WEIGHT = 0.2

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True


def _per_document(mark: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(mark))
    return total[offsets[1:]] - total[offsets[:-1]]


def _stripped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word bounds without ASCII punctuation at either side."""
    plain = _LETTER[data] | (data >= 0x80) | ((data >= 48) & (data <= 57))
    left = np.append(np.flatnonzero(plain), len(data))
    a = np.minimum(left[np.searchsorted(left, start)], end)
    right = np.append(-1, np.flatnonzero(plain))
    b = np.maximum(right[np.searchsorted(right, end) - 1] + 1, a)
    return a, b


def _stems(prefix: np.ndarray, a: np.ndarray, b: np.ndarray):
    """(words, hashes) for each length of stem: the words that are long enough; at last all as wholes."""
    for n in STEM_BYTES:
        long_ = np.flatnonzero(b - a >= n)
        yield long_, tb.slice_hashes(prefix, a[long_], a[long_] + n)
    some = np.flatnonzero(b > a)
    yield some, tb.mix(tb.slice_hashes(prefix, a[some], b[some]) + np.uint64(1))


def look(data: np.ndarray, offsets: np.ndarray, stems: np.ndarray):
    """(votes, document of each word, hash of each word) of the texts of one chunk; stems: sorted hashes from toxic_stems."""
    low = tb.LOWER[data]
    counts = count_batch(data, offsets)
    start, end, doc = tb.words(data, offsets)
    a, b = _stripped(low, start, end)
    prefix = tb.prefix_hashes(tb.byte_values(low))
    words = tb.slice_hashes(prefix, a, b)
    abuse = np.array([_hash_of(w) for w in ABUSE], np.uint64)
    n, chars = counts["n_words"], np.maximum(counts["word_chars"], 1)
    abusive = np.bincount(doc[np.isin(words, abuse)], minlength=len(n)) > 0
    if len(stems):
        stem = np.zeros(len(words), bool)
        for k, found in _stems(prefix, a, b):
            stem[k] |= stems[np.minimum(np.searchsorted(stems, found), len(stems) - 1)] == found
        hits = np.bincount(doc[stem], minlength=len(n))
        abusive |= (hits >= STEMS) & (STEM_WORDS * hits >= n)
    upper, letters = _per_document(_UPPER[data], offsets), np.maximum(_per_document(_LETTER[data], offsets), 1)
    shouts = _per_document(data == 0x21, offsets) / np.maximum(n, 1)
    symbols, repeated = counts["n_symbols"] / chars, counts["n_repeat_words"] / np.maximum(n, 1)
    lines, mean = counts["n_dup_lines"] / np.maximum(counts["n_lines"], 1), chars / np.maximum(n, 1)

    def vote(bad, good):
        return np.where(n == 0, NOTHING, np.where(bad, BAD, np.where(good, GOOD, NOTHING)))

    votes = np.stack([
        vote(symbols > 0.05, symbols < 0.02),
        vote(upper / letters > 0.4, upper / letters < 0.2),
        vote(shouts > 0.2, shouts < 0.05),
        vote((repeated > 0.5) & (n >= 50), (repeated < 0.3) & (n >= 20)),
        vote((lines > 0.4) & (counts["n_dup_lines"] >= 3), lines < 0.2),
        vote(((mean > 12) | (mean < 2.5)) & (n >= 20), (mean > 3.5) & (mean < 9)),
        vote(abusive, np.zeros(len(n), bool)),
    ])
    return votes, doc, words


def _hash_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(tb.slice_hashes(tb.prefix_hashes(tb.byte_values(raw)), np.array([0]), np.array([len(raw)]))[0])


def _codes(votes: np.ndarray) -> np.ndarray:
    return (votes * 3 ** np.arange(len(votes))[:, None]).sum(axis=0)


def _apart(texts: DataFrame) -> DataFrame:
    """texts (text, toxic) with one text of those of a class that share a minimum of their hashed shingles of five words.

    Near copies share each of the MINIMA with a probability of their similarity."""
    names = [f"k{k}" for k in range(MINIMA)]

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(*tb.buffers(batch.column(0)), 5))
            with np.errstate(over="ignore"):
                lows = [[int(tb.mix(s + np.uint64(k + 1)).min().view(np.int64)) if len(s) else 0 for s in sets] for k in range(MINIMA)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in lows)], ["text", "toxic", *names])

    rows = texts.select("text", F.col("toxic").cast("int")).mapInArrow(run, "text string, toxic int, " + ", ".join(f"{k} long" for k in names))
    for k in names:
        rows = rows.groupBy("toxic", k).agg(F.min(F.struct("text", *(c for c in names if c != k))).alias("x")).select("toxic", k, "x.*")
    return rows.select("text", "toxic")


def toxic_stems(docs: DataFrame, labels: DataFrame | None) -> np.ndarray:
    """Sorted hashes of the beginnings of words that mark toxic documents; labels: doc_id, toxic.

    Counted are documents with one, two and three words of a stem, since a clean
    document may name in passing what a toxic one repeats.  Copies of a text count once."""
    none = np.zeros(0, np.uint64)
    if labels is None:
        return none
    labels = labels.select("doc_id", "toxic").where("doc_id is not null and toxic in (0, 1)")
    size = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return none
    limit = F.when(F.col("toxic") == 1, _limit(size[1], LABELLED_DOCUMENTS)).otherwise(_limit(size[0], LABELLED_DOCUMENTS))
    sample = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < limit).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    texts = materialize(_apart(texts.where("text is not null")), "labelled")
    size = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return none

    def run(batches):
        for batch in batches:
            data, offsets = tb.buffers(batch.column(0))
            toxic = batch.column(1).to_numpy() == 1
            for f, to in tb.chunks(offsets):
                low, at = tb.LOWER[data[offsets[f] : offsets[to]]], offsets[f : to + 1] - offsets[f]
                start, end, doc = tb.words(low, at)
                a, b = _stripped(low, start, end)
                parts = [(doc[k], found) for k, found in _stems(tb.prefix_hashes(tb.byte_values(low)), a, b)]
                owner, found = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((owner, found))
                owner, found = owner[order], found[order]
                new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (found[1:] != found[:-1]))[: len(owner)])
                often, owner, found = np.diff(np.append(new, len(owner))), owner[new], found[new]
                stem, which = np.unique(found, return_inverse=True)
                counts = [np.bincount(which, weights=(often >= m) & (toxic[f:to][owner] == t), minlength=len(stem)).astype(np.int64) for t in (True, False) for m in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (stem.view(np.int64), *counts)], ["stem", *names])

    names = [f"{c}{m}" for c in ("toxic", "clean") for m in (1, 2, 3)]
    rows = texts.select("text", F.col("toxic").cast("int")).mapInArrow(run, "stem long, " + ", ".join(f"{c} long" for c in names))
    rows = rows.groupBy("stem").agg(*(F.sum(c).alias(c) for c in names))
    often = [f"(toxic{m} >= {STEM_DOCUMENTS} and toxic{m} * {size[0]} >= {STEM_RATIO} * clean{m} * {size[1]})" for m in (1, 2, 3)]
    rows = rows.where(" or ".join(often)).toPandas()
    keep = np.zeros(len(rows), bool)
    for m in (1, 2, 3):
        k1, k0 = rows[f"toxic{m}"].to_numpy(float), rows[f"clean{m}"].to_numpy(float)
        enough = (k1 >= STEM_DOCUMENTS) & (k1 * size[0] >= STEM_RATIO * k0 * size[1])
        keep |= enough & (_evidence(k1, size[1], k0, size[0]) > STEM_EVIDENCE)
    return np.sort(rows["stem"].to_numpy(np.int64)[keep].view(np.uint64))


def _evidence(k1: np.ndarray, n1: int, k0: np.ndarray, n0: int) -> np.ndarray:
    """Likelihood ratio statistic of two shares k1 / n1 and k0 / n0 against one common share."""

    def logs(k, n, p):
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log(1 - p)

    both = (k1 + k0) / (n1 + n0)
    return 2 * (logs(k1, n1, k1 / n1) + logs(k0, n0, k0 / n0) - logs(k1, n1, both) - logs(k0, n0, both))


def _limit(n: int, wanted: int) -> int:
    """The bound on hashes below 2**20 that lets about wanted of n pass."""
    return int((1 << 20) / max(1.0, n / wanted))


def _chunks(batch: pa.RecordBatch, text: int, stems: np.ndarray):
    everything, all_offsets = tb.buffers(batch.column(text))
    for f, to in tb.chunks(all_offsets):
        yield f, to, *look(everything[all_offsets[f] : all_offsets[to]], all_offsets[f : to + 1] - all_offsets[f], stems)


def vote_patterns(docs: DataFrame, stems: np.ndarray) -> dict[int, int]:
    """Documents of each vote pattern, over all of docs; at most 3 ** labellers entries."""

    def run(batches):
        for batch in batches:
            codes = [_codes(votes) for _, _, votes, _, _ in _chunks(batch, 0, stems)]
            if codes:
                code, n = np.unique(np.concatenate(codes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], ["code", "n"])

    rows = docs.select("text").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect()
    return {r["code"]: r["n"] for r in sorted(rows)}


def expectation_maximisation(patterns: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """Posterior of class good for each pattern.

    Labellers look at different faults, so most bad documents have one bad vote among
    good ones.  Two beliefs make that count: the start takes any bad vote as likely
    bad, and PRIOR says how a labeller votes on either class, weighing as much as
    PRIOR_WEIGHT of the corpus.  The data move the tables from there."""
    if not patterns:
        return {}
    codes, weight = np.array(list(patterns)), np.array(list(patterns.values()), float)
    votes = np.stack([codes // 3**k % 3 for k in range(len(LABELLERS))])
    good, bad = (votes == GOOD).sum(axis=0), (votes == BAD).sum(axis=0)
    posterior = np.where(bad > 0, 0.2, np.where(good > 0, 0.95, 0.5))
    anchored = {LABELLERS.index(k): np.array(v) for k, v in ANCHORED.items()}
    for _ in range(rounds):
        share = (posterior @ weight + 9) / (weight.sum() + 10)
        logs = np.stack([np.full(len(codes), np.log(1 - share)), np.full(len(codes), np.log(share))])
        for k in range(len(LABELLERS)):
            table = np.ones((2, 3))
            for v in range(3):
                hit = weight * (votes[k] == v)
                table[:, v] += hit @ (1 - posterior), hit @ posterior
            table += np.array(PRIOR) * PRIOR_WEIGHT * weight.sum()
            table /= table.sum(axis=1, keepdims=True)
            logs += np.log(np.maximum(anchored.get(k, table), 1e-12))[:, votes[k]]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - posterior).max() < 1e-9:
            break
        posterior = new
    return dict(zip(codes.tolist(), posterior.tolist(), strict=True))


def _features(votes: np.ndarray, doc: np.ndarray, words: np.ndarray, n: int):
    """(document, feature, value): hashed words with unit norm, then one feature for each vote."""
    bucket = (words & np.uint64(WIDTH - 1)).astype(np.int64)
    key, count = np.unique(doc * WIDTH + bucket, return_counts=True)
    d, value = key // WIDTH, 1 + np.log(count)
    norm = np.sqrt(np.bincount(d, weights=value**2, minlength=n))
    d = np.concatenate([d, *[np.arange(n)] * len(votes)])
    value = np.concatenate([value / np.maximum(norm[key // WIDTH], 1e-9), np.ones(n * len(votes))])
    return d, np.concatenate([key % WIDTH, *(WIDTH + 3 * k + v for k, v in enumerate(votes))]), value


def train(docs: DataFrame, posteriors: dict[int, float], total: int, stems: np.ndarray) -> np.ndarray:
    """Weights of the linear model, the last one the constant; deterministic.

    Rows are chosen by a hash of id and text.  Copies hash alike, so where they are many the sample is cut at twice its size."""

    def run(batches):
        for batch in batches:
            for f, to, votes, doc, words in _chunks(batch, 1, stems):
                n = to - f
                d, feature, value = _features(votes, doc, words, n)
                order = np.argsort(d, kind="stable")
                edges = np.searchsorted(d[order], np.arange(n + 1))
                feature, value = feature[order].astype(np.uint32), value[order].astype(np.float32)
                pieces = [[c[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for c in (feature, value)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(f, n), pa.array(_codes(votes)), *(pa.array(p, pa.binary()) for p in pieces)], ["doc_id", "code", "feature", "value"])

    chosen = docs.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < _limit(total, TRAINING_DOCUMENTS))
    found = chosen.mapInArrow(run, "doc_id long, code long, feature binary, value binary").orderBy("doc_id", "code", "feature").limit(2 * TRAINING_DOCUMENTS)
    rows = sorted(found.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["code"], r["feature"]))
    weights, squares = np.zeros(WIDTH + 3 * len(LABELLERS) + 1), np.full(WIDTH + 3 * len(LABELLERS) + 1, 1e-2)
    order, rng = np.arange(len(rows)), np.random.default_rng(5)
    for _ in range(4):
        rng.shuffle(order)
        for at in range(0, len(order), 32):
            part = [rows[i] for i in order[at : at + 32]]
            feature = np.concatenate([np.append(np.frombuffer(r["feature"], np.uint32), len(weights) - 1) for r in part]).astype(np.int64)
            value = np.concatenate([np.append(np.frombuffer(r["value"], np.float32), 1.0) for r in part])
            owner = np.repeat(np.arange(len(part)), [len(r["feature"]) // 4 + 1 for r in part])
            score = np.bincount(owner, weights=weights[feature] * value, minlength=len(part))
            error = 1 / (1 + np.exp(-np.clip(score, -50, 50))) - np.array([posteriors.get(r["code"], 0.5) for r in part])
            used, where = np.unique(feature, return_inverse=True)
            gradient = np.bincount(where, weights=error[owner] * value) + 1e-5 * weights[used]
            squares[used] += gradient**2
            weights[used] -= 0.3 * gradient / np.sqrt(squares[used])
    return weights


def _fitted(docs: DataFrame, labels: DataFrame | None):
    """(broadcast weights of fixed size, posteriors of the vote patterns, toxic stems), from all rows."""
    stems = toxic_stems(docs, labels)
    patterns = vote_patterns(docs, stems)
    posteriors = expectation_maximisation(patterns)
    return docs.sparkSession.sparkContext.broadcast(train(docs, posteriors, sum(patterns.values()), stems)), posteriors, stems


def _scores(batch: pa.RecordBatch, column: int, weights: np.ndarray, stems: np.ndarray):
    """(first row, rows, votes, scores) of each chunk of a batch."""
    for f, to, votes, doc, words in _chunks(batch, column, stems):
        n = to - f
        d, feature, value = _features(votes, doc, words, n)
        score = 1 / (1 + np.exp(-np.clip(np.bincount(d, weights=weights[feature] * value, minlength=n) + weights[-1], -50, 50)))
        yield f, n, votes, np.where(np.bincount(doc, minlength=n) > 0, score, 0.0)


def classify(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, weak_posterior, kept) of every row of docs (doc_id long, text string).

    score: probability of good quality by the linear model; kept: at least THRESHOLD.
    Null, empty and wordless texts have score 0 and are rejected.  Every row counts,
    rows with a null doc_id and repeated ones too.  Empty tables give no rows."""
    docs = docs.select("doc_id", "text")
    weights, posteriors, stems = _fitted(docs, labels)

    def run(batches):
        for batch in batches:
            for f, n, votes, score in _scores(batch, 1, weights.value, stems):
                weak = np.array([posteriors.get(c, 0.5) for c in _codes(votes).tolist()])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(f, n), pa.array(score), pa.array(weak), pa.array(score >= THRESHOLD)], ["doc_id", "score", "weak_posterior", "kept"])

    return docs.mapInArrow(run, "doc_id long, score double, weak_posterior double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of docs that are not rejected; columns unchanged, nothing shuffled."""
    weights, _, stems = _fitted(docs.select("doc_id", "text"), labels)
    text = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for f, n, _, score in _scores(batch, text, weights.value, stems):
                yield batch.slice(f, n).filter(pa.array(score >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(doc_id, score, weak_posterior, kept), one row per row of documents, null doc_id and repeated rows included.

    Null, empty and wordless texts have score 0 and are rejected; extra columns, whatever their names, are ignored; an empty table gives no rows."""
    return classify(clashing(docs, ["doc_id", "text"]), labels)
