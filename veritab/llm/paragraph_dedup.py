"""Removal of paragraphs that repeat, exactly or nearly, anywhere in the corpus.

Paragraphs are lines with at least WORDS words.  Their sets of five-word shingles are
sketched where the document is read; bands of three registers, twelve of them, are
tuned for recall: a pair at a similarity of 0.8 escapes with probability 2e-4.
Colliding paragraphs are verified by exact Jaccard similarity, and of every connected
component only the earliest paragraph (smallest doc_id, then first in it) stays.

Passages inside long lines, in lines under WORDS words and across line breaks are paragraphs
of another kind, whose bounds the content sets: all words of a text, line breaks or not, are cut
where a hash of two words is the least among its neighbours, so equal passages are cut
alike whatever surrounds them.  These segments are short, so their sets are equal or far
apart, and one hash of a segment (lower case, single spaces) stands for its sketch.  From segments that stand
elsewhere too, equality is followed word by word, to the ends of a passage and to an edit in it from both
sides.  A passage repeats with WORDS words or more that stand earlier too; only those are cut, never words between them.

Segments and the steps from them are told by 64 bits: among 10**13 different ones, as in 100 TB, some millions share a
hash with another one, but a passage needs several in a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import textbytes as tb
from .minhash import near_duplicates
from .shared import clashing, materialize, parallelism
from .spans import cut_texts, merged

#: Words that a paragraph needs to be judged; shorter repeats (titles, greetings) stay.
WORDS = 20
BANDS, ROWS, SHINGLE, PERCENT = 12, 3, 5, 80
#: A cut is least among so many word pairs to either side; stretches without a cut of over MOST words are cut every HALF.
REACH, MOST, HALF = 4, 48, 24
#: Repeated runs of words belong to one passage with so many words between them that do not repeat, at most as many as those that do.
GAP = 8


def _lines(data: np.ndarray, offsets: np.ndarray):
    """(document, number in it, start, end) of the lines with at least WORDS words."""
    start, _, _ = tb.words(data, offsets)
    breaks = np.flatnonzero(data == 0x0A)
    a = np.union1d(offsets[:-1], breaks + 1)
    a = a[a < len(data)]
    doc = np.searchsorted(offsets, a, side="right") - 1
    b = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, a)], offsets[doc + 1])
    long_ = np.searchsorted(start, b) - np.searchsorted(start, a) >= WORDS
    a, b, doc = a[long_], b[long_], doc[long_]
    lead = np.searchsorted(doc, doc)
    return doc, np.arange(len(doc)) - lead, a, b


class Segments(NamedTuple):
    """Segments of a chunk, and its words; at and to are words, counted over the chunk."""

    doc: np.ndarray
    at: np.ndarray
    to: np.ndarray
    key: np.ndarray
    word: np.ndarray
    word_doc: np.ndarray
    start: np.ndarray
    end: np.ndarray


def _segments(data: np.ndarray, offsets: np.ndarray) -> Segments:
    low = tb.LOWER[data]
    start, end, doc = tb.words(low, offsets)
    n = len(start)
    if not n:
        none = np.zeros(0, np.int64)
        return Segments(none, none, none, none.view(np.uint64), none.view(np.uint64), none, none, none)
    word = tb.slice_hashes(tb.prefix_hashes(tb.byte_values(low)), start, end)
    lead = np.append(True, doc[1:] != doc[:-1])
    with np.errstate(over="ignore"):
        pair = tb.mix(word + np.where(lead, np.uint64(0), np.append(np.uint64(0), word[:-1])) * np.uint64(0xD6E8FEB86659FD93))
    most = ~np.uint64(0)
    around = np.full(n, most)
    for k in range(1, REACH + 1):  # a document's segments depend on nothing beside it: they are numbered again later
        same = doc[k:] == doc[:-k]
        around[k:] = np.minimum(around[k:], np.where(same, pair[:-k], most))
        around[:-k] = np.minimum(around[:-k], np.where(same, pair[k:], most))
    cut = lead | (pair < around)
    at = np.flatnonzero(cut)
    long_ = np.diff(np.append(at, n))
    extra = np.where(long_ > MOST, (long_ - 1) // HALF, 0)
    step = np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1
    at = np.sort(np.append(at, np.repeat(at, extra) + HALF * step))
    to = np.append(at[1:], n)
    return Segments(doc[at], at, to, tb.slice_hashes(tb.prefix_hashes(word), at, to), word, doc, start, end)


_UNIT = "kind int, key long, doc_id long, place long"
#: Kinds of rows of a unit: met once in its batch, met more often there and the first of these, known to repeat.
ONCE, FIRST, AGAIN = 0, 1, 2


def _unit_rows(doc, place, key) -> Iterator[pa.RecordBatch]:
    """Each different unit of a batch once, at its earliest place, and the places of its repeats.

    These need no comparison any more and are dealt evenly, not to the task of their key."""
    order = np.lexsort((place, doc, key))
    key, doc, place = key[order], doc[order], place[order]
    new = np.append(True, key[1:] != key[:-1])[: len(key)]
    run = np.cumsum(new) - 1
    lead = np.flatnonzero(new)
    again = (doc != doc[lead][run]) | (place != place[lead][run])
    several = np.bincount(run, again, len(lead)) > 0
    spread = tb.mix(tb.mix(doc[again].view(np.uint64)) + place[again].view(np.uint64))
    for kind, k, d, p in ((np.where(several, FIRST, ONCE), key[new], doc[new], place[new]), (np.full(len(spread), AGAIN), spread, doc[again], place[again])):
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), *map(pa.array, (k.view(np.int64), d, p))], ["kind", "key", "doc_id", "place"])


def _settled(rows: DataFrame) -> DataFrame:
    """(doc_id, place, again) of the units that stand at several places; again: not at the earliest.

    One shuffle; a key's rows stream by in order, so only its first is kept in mind.  A repeated row of a document is the same place."""

    def settle(batches):
        held = None  # key, doc, place of the run's first, and whether it has been told
        for batch in batches:
            kind, key, doc, place = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(key):
                continue
            goes_on = held is not None and key[0] == held[0]
            new = np.append(not goes_on, key[1:] != key[:-1])
            run, lead = np.cumsum(new) - (not goes_on), np.flatnonzero(new)
            if goes_on:  # run 0 began in an earlier batch
                first_doc, first_place = np.append(held[1], doc[lead]), np.append(held[2], place[lead])
            else:
                first_doc, first_place = doc[lead], place[lead]
            again = (kind == AGAIN) | (doc != first_doc[run]) | (place != first_place[run])
            several = np.bincount(run, again | (kind == FIRST), len(first_doc)) > 0
            lone = np.bincount(run, kind != AGAIN, len(first_doc)) == 0  # known repeats begin no unit
            tell = several & ~lone
            if goes_on:
                tell[0] = several[0] and not held[3]
            told = bool(tell[-1]) or (goes_on and len(first_doc) == 1 and held[3])
            held = key[-1], first_doc[-1], first_place[-1], told
            columns = np.append(first_doc[tell], doc[again]), np.append(first_place[tell], place[again]), np.append(np.zeros(tell.sum(), bool), np.ones(again.sum(), bool))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "place", "again"])

    met = rows.repartition(parallelism(rows.sparkSession), "key").sortWithinPartitions("key", "doc_id", "place")
    return met.mapInArrow(settle, "doc_id long, place long, again boolean")


def _parts(batch: pa.RecordBatch):
    """(first row, row after the last, bytes, offsets) of chunks of whole texts in a batch of (doc_id, text, ...)."""
    data, offsets = tb.buffers(batch.column(1))
    for f, to in tb.chunks(offsets):
        yield f, to, data[offsets[f] : offsets[to]], offsets[f : to + 1] - offsets[f]


def _shared_segments(docs: DataFrame) -> DataFrame:
    """(doc_id, marks): the segments that stand elsewhere too, 2 * number in the document + 1 if elsewhere is earlier."""

    def cut(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for f, to, data, offsets in _parts(batch):
                s = _segments(data, offsets)
                parts.append([ids[f:to][s.doc], np.arange(len(s.doc)) - np.searchsorted(s.doc, s.doc), s.key])
            if parts:
                yield from _unit_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    found = _settled(docs.select("doc_id", "text").mapInArrow(cut, _UNIT))
    return found.groupBy("doc_id").agg(F.collect_list(F.col("place") * 2 + F.col("again").cast("long")).alias("marks"))


def _marked(column: pa.ListArray, f: int, to: int, lead: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, last bit) of the numbers that the lists of rows f to to hold; a document's positions begin at lead and end before limit.

    A repeated row of a doc_id may hold another, shorter text."""
    part = column.slice(f, to - f)
    at = part.offsets.to_numpy()
    value = part.flatten().to_numpy()
    row = np.repeat(np.arange(to - f), np.diff(at))
    where = lead[row] + (value >> 1)
    fits = where < limit[row]
    return where[fits], (value & 1)[fits]


def _with_marks(batch: pa.RecordBatch, column: int):
    """(first row, row after the last, bytes, segments, shared, repeated): flags by segment."""
    for f, to, data, offsets in _parts(batch):
        s = _segments(data, offsets)
        bounds = np.searchsorted(s.doc, np.arange(to - f + 1))
        where, again = _marked(batch.column(column), f, to, bounds[:-1], bounds[1:])
        shared, repeated = np.zeros(len(s.doc), bool), np.zeros(len(s.doc), bool)
        shared[where] = True
        repeated[where[again == 1]] = True
        yield f, to, offsets, s, shared, repeated


def _ends(marked: DataFrame) -> DataFrame:
    """(doc_id, ends): words beside shared segments up to which an earlier text reads the same; 2 * number of the word.

    Where a shared segment stands beside one that repeats no earlier one, and beside any where it is the first of its kind, the text from it to each word of the
    other, and a little further, is a unit of its own; so passages reach to their first and last word, and to an edit from both sides."""

    def cut(batches):
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for f, to, _, s, shared, repeated in _with_marks(batch, 2):
                n = len(s.doc)
                if not n:
                    continue
                first, last = shared & ~repeated, n - 1
                base = np.searchsorted(s.word_doc, s.doc)  # number of the document's first word in the chunk
                hashes = tb.prefix_hashes(s.word)
                for step in (1, -1):
                    k = np.flatnonzero(shared)
                    beside, far = np.clip(k + step, 0, last), np.clip(k + 2 * step, 0, last)
                    near, more = ((x != k) & (s.doc[x] == s.doc[k]) & (first[k] | ~repeated[x]) for x in (beside, far))
                    more &= far != beside
                    width = s.to - s.at
                    size = np.where(near, width[beside] + np.where(more, np.minimum(REACH, width[far]), 0), 0)
                    k = np.repeat(k, size)
                    length = np.arange(len(k)) - np.repeat(np.cumsum(size) - size, size) + 1
                    if step > 0:
                        word = s.to[k] + length - 1
                        key = tb.slice_hashes(hashes, s.at[k], word + 1)
                    else:
                        word = s.at[k] - length
                        key = ~tb.slice_hashes(hashes, word, s.to[k])
                    parts.append([ids[f:to][s.doc[k]], (word - base[k]) * 2 + (step < 0), tb.mix(key)])
            if parts:
                yield from _unit_rows(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    found = _settled(marked.select("doc_id", "text", "marks").mapInArrow(cut, _UNIT)).where("again")
    return found.groupBy("doc_id").agg(F.collect_list(F.shiftleft(F.shiftright("place", 1), 1)).alias("ends"))


def _passages(batch: pa.RecordBatch) -> tuple[list[list[int]], list[list[int]]]:
    """For each document of (doc_id, text, marks, ends): first and last bytes of what its passages repeat.

    Repeated runs of words with at most GAP others between them, and no more than they have themselves, make a passage; one
    of WORDS repeated words or more counts.  Words between runs stay."""
    firsts, lasts = [], []
    for f, to, offsets, s, _, repeated in _with_marks(batch, 2):
        n = len(s.word)
        cover = np.zeros(n + 1, np.int64)
        np.add.at(cover, s.at[repeated], 1)
        np.add.at(cover, s.to[repeated], -1)
        again = np.cumsum(cover)[:n] > 0
        bounds = np.searchsorted(s.word_doc, np.arange(to - f + 1))
        again[_marked(batch.column(3), f, to, bounds[:-1], bounds[1:])[0]] = True
        goes_on = again[1:] & again[:-1] & (s.word_doc[1:] == s.word_doc[:-1])
        a = np.flatnonzero(again & ~np.append(False, goes_on)[:n])
        b = np.flatnonzero(again & ~np.append(goes_on, False)[:n]) + 1
        found = [([], []) for _ in range(to - f)]
        k = 0
        while k < len(a):
            start, held, doc = k, b[k] - a[k], s.word_doc[a[k]]
            k += 1
            while k < len(a) and s.word_doc[a[k]] == doc and a[k] - b[k - 1] <= min(GAP, held):
                held += b[k] - a[k]
                k += 1
            if held >= WORDS:
                found[doc][0].extend((s.start[a[start:k]] - offsets[doc]).tolist())
                found[doc][1].extend((s.end[b[start:k] - 1] - offsets[doc]).tolist())
        firsts += [x for x, _ in found]
        lasts += [x for _, x in found]
    return firsts, lasts


def _marks_and_ends(docs: DataFrame) -> DataFrame:
    """(doc_id, marks, ends) of the documents with shared segments.

    Texts meet the marks by doc_id, in the same shuffle as in repeated_spans, which Spark makes once."""
    marks = materialize(_shared_segments(docs), "marks")
    return marks.join(_ends(docs.join(marks, "doc_id")), "doc_id", "left")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, first, last) of the documents that hold any: lists of the bytes from first to last of the text that repeat."""
    spans = _cut_spans(docs.select("doc_id", "text").where("doc_id is not null"), _marks_and_ends, ["doc_id", "text"])
    return spans.where("size(first) > 0").select("doc_id", "first", "last")


def _numbered(docs: DataFrame) -> tuple[DataFrame, int]:
    """(docs with a column number, bits): number << bits leaves room for the numbers of a document's paragraphs, and grows with doc_id.

    number is doc_id less the smallest one.  Where ids are spread too widely for that, it is
    the rank of doc_id, which costs a join."""
    low, high, longest = docs.agg(F.min("doc_id"), F.max("doc_id"), F.max(F.octet_length("text"))).first()
    bits = ((longest or 0) // (2 * WORDS)).bit_length() + 1
    low, high = low or 0, high or 0
    if (high - low) >> (63 - bits) == 0:
        return docs.withColumn("number", F.col("doc_id") - F.lit(low)), bits

    def count(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(batch), part)), pa.array(np.arange(n, n + len(batch)))], ["doc_id", "part", "within"])
            n += len(batch)

    spark = docs.sparkSession
    ids = docs.select("doc_id").distinct().repartitionByRange(parallelism(spark), "doc_id").sortWithinPartitions("doc_id")
    ids = materialize(ids.mapInArrow(count, "doc_id long, part long, within long"), "ranks")
    before, begin = 0, []
    for part, n in sorted(ids.groupBy("part").count().collect()):  # one row for each partition
        begin += [F.lit(part), F.lit(before).cast("long")]
        before += n
    ranks = ids.select("doc_id", (F.create_map(*begin)[F.col("part")] + F.col("within")).alias("number"))
    return docs.join(ranks, "doc_id"), bits


def paragraphs(docs: DataFrame, bits: int) -> DataFrame:
    """(id, text) of every paragraph that is judged; id is docs' number << bits | the paragraph's number in its document."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            data, offsets = tb.buffers(batch.column(1))
            for f, to in tb.chunks(offsets):
                part = data[offsets[f] : offsets[to]]
                doc, number, a, b = _lines(part, offsets[f : to + 1] - offsets[f])
                raw = part.tobytes()
                texts = [raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array((ids[f:to][doc] << bits) | number), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "text"])

    return docs.select("number", "text").mapInArrow(run, "id long, text string")


def repeated_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, removed): the sorted numbers of the paragraphs (judged ones, from 0) that repeat an earlier one, of the documents that hold any."""
    docs, bits = _numbered(docs.select("doc_id", "text").where("doc_id is not null"))
    found = near_duplicates(paragraphs(docs, bits), SHINGLE, PERCENT, BANDS, ROWS).where("id <> component").select("id").distinct()
    rows = found.groupBy(F.shiftright("id", bits).alias("number")).agg(F.sort_array(F.collect_list(F.col("id").bitwiseAND((1 << bits) - 1))).alias("removed"))
    return rows.join(docs.select("doc_id", "number").distinct(), "number").select("doc_id", "removed")


def _cut_spans(rows: DataFrame, cuts_of: Callable[[DataFrame], DataFrame], names: list[str]) -> DataFrame:
    """names, first, last of rows (doc_id, text, ...): the bytes to cut by the numbers in cuts_of(rows): removed lines, marks and ends, each where it is known."""

    def run(batches):
        for batch in batches:
            firsts, lasts = _passages(batch)
            data, offsets = tb.buffers(batch.column(1))
            for k, removed in enumerate(batch.column(4).to_pylist()):
                if removed:
                    own = data[offsets[k] : offsets[k + 1]]
                    _, _, a, b = _lines(own, np.array([0, len(own)]))
                    # a repeated row of the same doc_id may hold another text with fewer paragraphs
                    at = [n for n in removed if n < len(a)]
                    firsts[k] += a[at].tolist()
                    lasts[k] += np.minimum(b[at] + 1, len(own)).tolist()
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, kind), pa.array(lasts, kind), *batch.columns[5:]], out)

    cuts, known = cuts_of(rows.where("doc_id is not null").select("doc_id", "text")), ["marks", "ends", "removed"]
    others = names[2:]
    out = [*names[:2], "first", "last", *others]
    none = F.lit(None).cast("array<long>")
    cuts = cuts.select("doc_id", *(c if c in cuts.columns else none.alias(c) for c in known))
    with_id = rows.where("doc_id is not null").join(cuts.hint("shuffle_hash"), "doc_id", "left").select(*names[:2], *known, *others)
    without = rows.where("doc_id is null").select(*names[:2], *(none.alias(c) for c in known), *others)
    both = with_id.unionByName(without)
    field = lambda name: StructField(name, ArrayType(LongType()))
    return both.mapInArrow(run, StructType([both.schema[names[0]], both.schema[names[1]], field("first"), field("last"), *(both.schema[c] for c in others)]))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Every row of docs as (doc_id, text, first, last, others): lists of the bytes that repeated paragraphs and passages take, unmerged.

    A removed line takes the line break after it; of a passage only words that an earlier text repeats go, those of an edit stay.
    Null, empty and short texts have none.  Rows with a null
    doc_id have none either; repeated rows of one doc_id count as one document, whose
    paragraphs repeat nothing of their own."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else []))
    return _cut_spans(rows, lambda plain: _marks_and_ends(plain).join(repeated_paragraphs(plain), "doc_id", "full"), rows.columns)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated paragraphs and passages cut out of text and n_chars counted anew; rows and other columns as they were."""
    return cut_texts(docs, repeated_spans(docs))


def op10_paragraph_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_removed, n_bytes, n_spans, kept_sha256), one row per row of documents: bytes removed, bytes of the text,
    removed runs, and the hash of what is left.

    Null, empty and wordless texts lose nothing; rows with a null doc_id neither.  Repeated rows of one doc_id count as
    one document.  Extra columns, whatever their names, are ignored; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            n, removed, count, digest = [], [], [], []
            for own, spans, left in merged(batch):
                n.append(len(own))
                removed.append(len(own) - len(left))
                count.append(len(spans))
                digest.append(hashlib.sha256(left).hexdigest())
            arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (removed, n, count)), pa.array(digest)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_removed", "n_bytes", "n_spans", "kept_sha256"])

    return repeated_spans(clashing(docs, ["doc_id", "text"])).mapInArrow(run, "doc_id long, n_removed long, n_bytes long, n_spans long, kept_sha256 string")
