"""Language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3) with TF-IDF weights; document
frequencies cover every document that may be learned from.  The model is trained with
follow-the-regularised-leader and an elastic-net penalty on a bounded sample for each
language, then one temperature is fitted on a part of the sample that training left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textbytes as tb
from .pretokens import LETTER, _classes
from .shared import attach, clashing, materialize

#: Documents of a language that are trained on, about; the only bound that is not over all data.  Every language is learned.
DOCUMENTS_PER_LANGUAGE = 800
WIDTH = 1 << 14
#: Follow-the-regularised-leader: step sizes, penalties and rounds.
ALPHA, BETA, L1, L2, ROUNDS = 0.5, 1.0, 0.02, 0.001, 3


def _letters(data: np.ndarray, offsets: np.ndarray):
    """(characters, text number of each): letters in lower case (A-Z), anything else as a blank; runs of blanks are one."""
    points = np.frombuffer(tb.LOWER[data].tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.searchsorted(offsets, at, side="right") - 1
    letter = _classes()[points] == LETTER
    keep = letter.copy()
    keep[:1] = True
    keep[1:] |= letter[:-1] | (doc[1:] != doc[:-1])
    return np.where(letter, points, 0x20)[keep].astype(np.uint64), doc[keep], np.bincount(doc[letter], minlength=len(offsets) - 1)


def _ngrams(data: np.ndarray, offsets: np.ndarray):
    """For each text: (counts of its hashed n-grams, number of letters)."""
    points, doc, letters = _letters(data, offsets) if len(data) else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64))
    with np.errstate(over="ignore"):
        one = (points + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        two = one[:-1] * np.uint64(31) + one[1:] if len(one) > 1 else one[:0]
        three = two[:-1] * np.uint64(31) + one[2:] if len(one) > 2 else one[:0]
    slots = [((tb.mix(x + np.uint64(k)) >> np.uint64(32)) % np.uint64(WIDTH)).astype(np.int64) for k, x in enumerate((one, two, three))]
    edges = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b, n in zip(edges[:-1].tolist(), edges[1:].tolist(), letters.tolist(), strict=True):
        yield np.bincount(np.concatenate([slots[k][a : max(a, b - k)] for k in range(3)]), minlength=WIDTH), n


def _texts(batch: pa.RecordBatch, column: int):
    data, offsets = tb.buffers(batch.column(column))
    for f, to in tb.chunks(offsets, 1 << 19):
        yield from _ngrams(data[offsets[f] : offsets[to]], offsets[f : to + 1] - offsets[f])


def _weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / max(1e-9, float(np.sqrt(x @ x)))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each slot occurs, and how many texts there are; at most WIDTH + 1 rows reach the driver."""

    def run(batches):
        for batch in batches:
            total, n = np.zeros(WIDTH, np.int64), 0
            for counts, _ in _texts(batch, 0):
                total += counts > 0
                n += 1
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(total[used], n))], ["slot", "n"])

    out, n = np.zeros(WIDTH, np.int64), 0
    for slot, count in docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        if slot < 0:
            n = count
        else:
            out[slot] = count
    return out, n


def sample(docs: DataFrame) -> list:
    """About DOCUMENTS_PER_LANGUAGE rows (lang, slots, counts) of each language, chosen by a hash of doc_id and text.

    Copies of a row hash alike: the row of a language's least hash is chosen at any rate, and where copies
    are many each language is cut at twice its size, so none takes the place of another."""
    docs = docs.select("doc_id", "text", "lang")
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit(3)), F.lit(1 << 20))
    share = F.floor((1 << 20) * F.least(F.lit(1.0), DOCUMENTS_PER_LANGUAGE / F.count("*")))
    bounds = materialize(docs.groupBy("lang").agg(F.greatest(share, F.min(chance) + 1).alias("bound")), "languages")

    def run(batches):
        for batch in batches:
            slots, counts = [], []
            for c, _ in _texts(batch, 2):
                used = np.flatnonzero(c)
                slots.append(used.astype(np.uint16).tobytes())
                counts.append(np.minimum(c[used], 65535).astype(np.uint16).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(slots, pa.binary()), pa.array(counts, pa.binary())], ["doc_id", "lang", "slots", "counts"])

    chosen = attach(docs, bounds, "lang").where(chance < F.col("bound"))
    found = chosen.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, slots binary, counts binary")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id", "slots", "counts"))
    rows = found.withColumn("nth", nth).where(F.col("nth") <= 2 * DOCUMENTS_PER_LANGUAGE).drop("nth").collect()
    return sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["lang"], r["slots"]))


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Model:
    """languages, idf, weights (WIDTH + 1 rows, the last the constant) and temperature."""

    def __init__(self, rows: list, idf: np.ndarray):
        self.languages = sorted({r["lang"] for r in rows})
        self.idf = idf
        number = {lang: k for k, lang in enumerate(self.languages)}
        examples = []
        for r in rows:
            used = np.frombuffer(r["slots"], np.uint16).astype(np.int64)
            x = np.log1p(np.frombuffer(r["counts"], np.uint16).astype(float)) * idf[used]
            examples.append((np.append(used, WIDTH), np.append(x / max(1e-9, float(np.sqrt(x @ x))), 1.0), number[r["lang"]]))
        z = np.zeros((WIDTH + 1, len(self.languages)))
        squares = np.zeros_like(z)

        def weights(at):
            shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0)
            return -shrunk / ((BETA + np.sqrt(squares[at])) / ALPHA + L2)

        rng, training = np.random.default_rng(9), [e for k, e in enumerate(examples) if k % 5 or len(examples) < 20]
        for _ in range(ROUNDS):
            for k in rng.permutation(len(training)).tolist():
                at, x, y = training[k]
                w = weights(at)
                error = _softmax(x @ w)
                error[y] -= 1
                g = x[:, None] * error[None, :]
                more = squares[at] + g * g
                z[at] += g - (np.sqrt(more) - np.sqrt(squares[at])) / ALPHA * w
                squares[at] = more
        self.weights = weights(np.arange(WIDTH + 1)).astype(np.float32)
        self.temperature = 1.0
        if len(examples) >= 20:
            held = [(x @ self.weights[at], y) for k, (at, x, y) in enumerate(examples) if k % 5 == 0]
            logits, truth = np.stack([h[0] for h in held]), np.array([h[1] for h in held])
            tried = np.geomspace(0.05, 10, 60)
            loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in tried]
            self.temperature = float(tried[int(np.argmin(loss))])

    def predict(self, counts: np.ndarray) -> tuple[str, float]:
        p = _softmax((_weighted(counts, self.idf) @ self.weights[:WIDTH] + self.weights[WIDTH]) / self.temperature)
        return self.languages[int(p.argmax())], float(p.max())


def fit(docs: DataFrame) -> Model:
    """A model from every row of docs (doc_id, text, lang) with text and lang."""
    docs = docs.where("text is not null and lang is not null")
    seen, n = document_frequencies(docs)
    return Model(sample(docs), np.log((1 + n) / (1 + seen)) + 1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(row columns of docs but text, lang_pred, score); docs has doc_id and text."""
    shared_model = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH rows, whatever the input

    def run(batches):
        m = shared_model.value
        for batch in batches:
            found = [m.predict(counts) if letters and m.languages else ("und", 0.0) for counts, letters in _texts(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows never learned from; a null doc_id is held out as well."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def op7_language_id(docs: DataFrame) -> DataFrame:
    """The digest: doc_id, held_out, lang_pred, score, one row for each row of documents.

    Null texts and texts without a letter are und with score 0, and so is everything
    where there is nothing to learn from."""
    docs = clashing(docs, ["doc_id", "text", "lang"])
    return predict(docs, fit(docs.where(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of docs whose language is told with a score of at least least; columns unchanged, nothing shuffled."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.select("doc_id", "text", "lang").where(~held_out())))
    text = docs.columns.index("text")

    def run(batches):
        m = model.value
        for batch in batches:
            kept = [bool(letters and m.languages) and m.predict(counts)[1] >= least for counts, letters in _texts(batch, text)]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
