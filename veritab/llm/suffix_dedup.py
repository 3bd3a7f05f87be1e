"""Removal of repeated byte strings by prefix-free parsing.

Triggers: position t is a trigger if the rolling hash of its K bytes is the leftmost
minimum of all K-byte strings of some window of LENGTH bytes.  So every window has
exactly one trigger, at an offset that its own bytes decide, and equal windows meet at
equal triggers.  The triggers cut the texts into phrases; a phrase here carries the
bytes of all windows of its trigger (at most 2 * LENGTH - K), so it is an entry of the
dictionary, and the order of phrases in a document is the parse.

Dictionary: equal phrases meet in one shuffle (combined before it, batch by batch).
All but the earliest occurrence of a phrase are repeats as a whole.  A phrase whose
trigger string begins no other phrase is settled: nothing of it repeats.

Corpus order: phrases that share a trigger string but differ are ordered twice, by the
text from the trigger on (the suffixes of the parse, cut at LENGTH) and by the reversed
text before it (the suffixes of the dictionary's phrases).  With the two arrays of
longest common prefixes, the windows that reach o bytes to the left of the trigger
are equal where both orders agree on o and LENGTH - o bytes; the earliest stays.

Frequent trigger strings would gather in one task.  A first pass finds them by a mergeable
summary of counts (Misra and Gries), whatever batches they stand in; their phrases are
split into single windows, whose keys are as many as there are different windows and
of which a batch sends each once.

What differs from the method as published: phrases overlap, so that windows never span several;
the order of the whole corpus isn't written down, since its dictionary's suffixes would be
a hundred times the input; orders are kept within a trigger string, which is where equal windows meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import clashing, materialize, parallelism
from .spans import cut_texts, merged, union

K = 32
#: A trigger string with so many different phrases, counted batch by batch, is split into windows.
HOT = 2_000
#: Trigger strings that a summary tracks, and that are split at most: 8 MB.  One that escapes the summary or the
#: list has at most a share of 1 / TRACKED of all phrases, beside one for each task.
TRACKED = 1 << 20

_MAPPED = "kind int, key long, phrase long, doc_id long, first long, last long, at long"


def _phrases(data: np.ndarray, offsets: np.ndarray, length: int):
    """(document, first window, last window, trigger, trigger hash, phrase hash) of each phrase of a chunk, offsets within documents."""
    n, span = len(data), length - K + 1
    if n < length:
        return None
    prefix = tb.prefix_hashes(tb.byte_values(data))
    at = np.arange(n - K + 1)
    grams = tb.slice_hashes(prefix, at, at + K)
    low = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    width = 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    trigger = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, np.arange(len(trigger)), side="right") - 1
    inside = np.arange(len(trigger)) + length <= offsets[doc + 1]
    j = np.flatnonzero(inside)
    if not len(j):
        return None
    t, d = trigger[j], doc[j]
    new = np.ones(len(j), bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(j)) - 1
    a, b, t, d = j[first], j[last], t[first], d[first]
    with np.errstate(over="ignore"):
        phrase = tb.mix(tb.slice_hashes(prefix, a, b + length) + (t - a).astype(np.uint64))
    base = offsets[d]
    return d, a - base, b - base, t - base, grams[t], phrase, prefix, base


def _same_as_before(*columns: np.ndarray) -> np.ndarray:
    same = np.ones(len(columns[0]), bool)
    same[:1] = False
    for c in columns:
        same[1:] &= c[1:] == c[:-1]
    return same


def _batch(kind, key, phrase, doc, first, last, at) -> pa.RecordBatch:
    n = len(doc)
    columns = [np.full(n, kind, np.int32), key.view(np.int64), phrase.view(np.int64), doc, first, last, at]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "key", "phrase", "doc_id", "first", "last", "at"])


def _parsed(batch: pa.RecordBatch, length: int):
    """The phrases of one batch of (doc_id, text) as columns doc_id, first, last, trigger, key, phrase, and the chunk-wise window hasher."""
    ids = batch.column(0).to_numpy()
    data, offsets = tb.buffers(batch.column(1))
    for f, to in tb.chunks(offsets, 1 << 18):
        found = _phrases(data[offsets[f] : offsets[to]], offsets[f : to + 1] - offsets[f], length)
        if found:
            d, a, b, t, key, phrase, prefix, base = found
            part = data[offsets[f] : offsets[to]]
            yield ids[f:to][d], a, b, t, key, phrase, prefix, base, lambda part=part: tb.prefix_hashes(tb.byte_values(part) >> np.uint64(7), 1)


def _fewer(keys: np.ndarray, n: np.ndarray, less: int) -> tuple[np.ndarray, np.ndarray]:
    keep = n > less
    return keys[keep], n[keep] - less


def _frequent(docs: DataFrame, length: int) -> np.ndarray:
    """The sorted hashes of the trigger strings that are to be split."""

    def run(batches):
        keys, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            parts = [(p[4], p[5]) for p in _parsed(batch, length)]
            if parts:
                key, phrase = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((phrase, key))
                key, phrase = key[order], phrase[order]
                key = key[~_same_as_before(key, phrase)]
                keys, which = np.unique(np.concatenate([keys, key]), return_inverse=True)
                n = np.bincount(which, weights=np.concatenate([n, np.ones(len(key))]), minlength=len(keys)).astype(np.int64)
                if len(keys) > TRACKED:
                    keys, n = _fewer(keys, n, int(-np.partition(-n, TRACKED)[TRACKED]))
        keys, n = _fewer(keys, n, 1)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    rows = docs.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    return np.sort(rows.orderBy(F.desc("n"), "key").limit(TRACKED).toPandas()["key"].to_numpy(np.int64).view(np.uint64))


def _dictionary(docs: DataFrame, split_at: np.ndarray, length: int) -> DataFrame:
    """Kind 0: one row for each different phrase of a batch.  Kind 1: spans known to repeat within the batch."""

    def run(batches):
        for batch in batches:
            parts = []
            for doc, a, b, t, key, phrase, prefix, base, second in _parsed(batch, length):
                if len(split_at):
                    split = split_at[np.minimum(np.searchsorted(split_at, key), len(split_at) - 1)] == key
                    n = (b - a + 1)[split]
                    ofs = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    j = np.repeat(a[split], n) + ofs
                    begin = j + np.repeat(base[split], n)
                    whole, check = tb.slice_hashes(prefix, begin, begin + length), tb.slice_hashes(second(), begin, begin + length, 1)
                    parts.append([np.repeat(doc[split], n), j, j, j, tb.mix(whole + np.uint64(5)), check])
                    doc, a, b, t, key, phrase = (x[~split] for x in (doc, a, b, t, key, phrase))
                parts.append([doc, a, b, t, key, phrase])
            if not parts:
                continue
            doc, a, b, t, key, phrase = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((a, doc)) if (np.diff(doc) < 0).any() or len(split_at) else np.arange(len(doc))
            order = order[np.argsort(tb.mix(key ^ (phrase << np.uint64(1)))[order], kind="stable")]
            doc, a, b, t, key, phrase = (x[order] for x in (doc, a, b, t, key, phrase))
            again = _same_as_before(key, phrase)
            again &= ~_same_as_before(key, phrase, doc, a)
            again_at = np.flatnonzero(again)
            yield _batch(0, *(x[~again] for x in (key, phrase, doc, a, b, t)))
            d, s, e = union(doc[again_at], a[again_at], b[again_at] + length)
            yield _batch(1, tb.mix(d.view(np.uint64) + np.uint64(3)), np.zeros(len(d), np.uint64), d, s, e, s)

    return docs.mapInArrow(run, _MAPPED)


def _settle(rows: DataFrame, length: int) -> DataFrame:
    """Kind 1: spans that repeat.  Kind 0: one of each different phrase that shares its trigger string with others."""

    def run(batches):
        for part in tb.whole_keys(batches, 1):
            kind, key, phrase, doc, first, last, at = (c.to_numpy() for c in part.columns)
            spans = kind == 1
            yield _batch(1, *(x[spans] for x in (key, phrase, doc, first, last, at)))
            kind, key, phrase, doc, first, last, at = (x[~spans] for x in (kind, key, phrase, doc, first, last, at))
            order = np.lexsort((first, doc, phrase, key))
            key, phrase, doc, first, last, at = (x[order] for x in (key, phrase, doc, first, last, at))
            lead = ~_same_as_before(key, phrase)
            own = np.maximum.accumulate(np.where(lead, np.arange(len(key)), 0))
            again = (doc != doc[own]) | (first != first[own])
            d, s, e = union(doc[again], first[again], last[again] + length)
            yield _batch(1, d, d, d, s, e, s)
            key, phrase, doc, first, last, at = (x[lead] for x in (key, phrase, doc, first, last, at))
            _, group, n = np.unique(key, return_inverse=True, return_counts=True)
            many = n[group] > 1
            yield _batch(0, *(x[many] for x in (key, phrase, doc, first, last, at)))

    return rows.repartition(parallelism(rows.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, _MAPPED)


def _phrase_texts(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the phrases that are still open: (key, doc_id, first, last, at, left reversed, right)."""
    wanted = asked.groupBy("doc_id").agg(F.collect_list("key").alias("key"), F.collect_list("first").alias("first"), F.collect_list("last").alias("last"), F.collect_list("at").alias("at"))

    def run(batches):
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            raw = data.tobytes()
            lists = [batch.column(k) for k in (2, 3, 4, 5)]
            n = np.diff(lists[0].offsets.to_numpy())
            key, first, last, at = (x.flatten().to_numpy() for x in lists)
            base = np.repeat(offsets[:-1], n)
            left = [raw[s:t][::-1] for s, t in zip((base + first).tolist(), (base + at).tolist(), strict=True)]
            right = [raw[t:e] for t, e in zip((base + at).tolist(), (base + last + length).tolist(), strict=True)]
            doc = np.repeat(batch.column(0).to_numpy(), n)
            arrays = [pa.array(key), pa.array(doc), pa.array(first), pa.array(last), pa.array(at), pa.array(left, pa.binary()), pa.array(right, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "doc_id", "first", "last", "at", "before", "after"])

    return docs.join(wanted, "doc_id").select("doc_id", "text", "key", "first", "last", "at").mapInArrow(run, "key long, doc_id long, first long, last long, at long, before binary, after binary")


def _common(order: np.ndarray, texts: list[bytes], key: np.ndarray, width: int) -> np.ndarray:
    """Longest common prefixes of neighbours in an order; -1 where the key changes."""
    grid = np.frombuffer(b"".join(texts[i][:width].ljust(width, b"\0") for i in order), np.uint8).reshape(len(order), width)
    equal = grid[1:] == grid[:-1]
    lcp = np.where(equal.all(axis=1), width, equal.argmin(axis=1)) if len(order) > 1 else np.zeros(0, np.int64)
    return np.append(-1, np.where(key[order][1:] == key[order][:-1], lcp, -1))


def _repeated_windows(key, doc, first, last, at, before, after, length: int) -> np.ndarray:
    """repeated[i, o]: whether the window of phrase i that starts o bytes before its trigger also stands earlier.  Rows come in order of (doc, at)."""
    n = len(key)
    parse = np.array(sorted(range(n), key=lambda i: (key[i], after[i])), np.int64)
    dictionary = np.array(sorted(range(n), key=lambda i: (key[i], before[i])), np.int64)
    right, left = _common(parse, after, key, length), _common(dictionary, before, key, length - K)
    place = np.cumsum(~_same_as_before(doc, at))
    repeated = np.zeros((n, length - K + 1), bool)
    groups_r, groups_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(length - K + 1):
        active = np.flatnonzero((at - first >= o) & (at - last <= o))
        if len(active) < 2:
            continue
        groups_r[parse] = np.cumsum(right < length - o)
        groups_l[dictionary] = np.cumsum(left < o)
        both = groups_r[active] * (n + 1) + groups_l[active]
        _, lead, group = np.unique(both, return_index=True, return_inverse=True)
        repeated[active, o] = place[active] > place[active][lead][group]
    return repeated


def _ordered(phrases: DataFrame, length: int) -> DataFrame:
    """Spans of the windows of open phrases that stand earlier in another one."""

    def run(batches):
        for part in tb.whole_keys(batches, 0):
            key, doc, first, last, at = (part.column(k).to_numpy() for k in range(5))
            order = np.lexsort((at, doc))
            key, doc, first, last, at = (x[order] for x in (key, doc, first, last, at))
            before, after = part.column(5).take(pa.array(order)).to_pylist(), part.column(6).take(pa.array(order)).to_pylist()
            row, o = np.nonzero(_repeated_windows(key, doc, first, last, at, before, after, length))
            start = at[row] - o
            d, s, e = union(doc[row], start, start + length)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(s), pa.array(e)], ["doc_id", "first", "last"])

    return phrases.repartition(parallelism(phrases.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "doc_id long, first long, last long")


def repeated_spans(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, text, first, last, other columns): every row with the lists of its document's repeated spans, unmerged.

    docs: doc_id long and text string.  A byte is in a span if a string of length bytes
    that covers it also starts earlier, in a document of smaller doc_id or earlier in
    its own.  Null texts are empty; rows with a null doc_id have no place in that order, so
    nothing repeats them and they repeat nothing; identical
    repeated rows of one doc_id stand at one place and do not repeat each other."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    carried = docs.select("doc_id", "text", *([F.struct(*others).alias("others")] if others else []))
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    settled = materialize(_settle(_dictionary(docs, _frequent(docs, length), length), length), "phrases")
    open_ = settled.where("kind = 0").select("key", "doc_id", "first", "last", "at")
    spans = settled.where("kind = 1").select("doc_id", "first", "last").union(_ordered(_phrase_texts(docs, open_, length), length))
    spans = spans.groupBy("doc_id").agg(F.collect_list("first").alias("first"), F.collect_list("last").alias("last"))
    kept, none = [c for c in carried.columns if c == "others"], F.lit(None).cast("array<long>")
    found = carried.where("doc_id is not null").join(spans, "doc_id", "left").select("doc_id", "text", "first", "last", *kept)
    return found.unionByName(carried.where("doc_id is null").select("doc_id", "text", none.alias("first"), none.alias("last"), *kept))


def op4_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The digest: strings of 100 bytes; one row per row of documents.

    Null texts are empty; rows with a null doc_id lose nothing; repeated rows of one doc_id do not repeat each other.
    Extra columns, whatever their names, are ignored; an empty table gives no rows."""

    def run(batches):
        for batch in batches:
            n, removed, count, digest = [], [], [], []
            for own, spans, left in merged(batch):
                n.append(len(own))
                removed.append(len(own) - len(left))
                count.append(len(spans))
                digest.append(hashlib.sha256(left).hexdigest())
            arrays = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return repeated_spans(clashing(docs, ["doc_id", "text"])).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs with the repeated spans cut out of text and n_chars counted anew; bytes of characters cut in two go as well."""
    return cut_texts(docs, repeated_spans(docs, length))


ORACLE = """
WITH raw AS MATERIALIZED (
  SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, h, octet_length(b) AS n, unnest(range(0, octet_length(b) - 99, 500)) AS s FROM raw WHERE octet_length(b) >= 100
), blocks AS MATERIALIZED (
  SELECT doc_id, s, least(500, n - 99 - s) AS k, substr(h, 2 * s + 1, 1198) AS h FROM starts
), windows AS (
  SELECT doc_id, s, h, unnest(range(0, k)) AS p FROM blocks
), hashed AS MATERIALIZED (
  SELECT doc_id, s + p AS p, md5_number(substr(h, 2 * p + 1, 200)) AS w FROM windows
), again AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS nth FROM hashed) WHERE nth > 1
), runs AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM again
), spans AS MATERIALIZED (
  SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM runs) GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, e AS s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS e FROM spans
  UNION ALL SELECT doc_id, 0, min(s) FROM spans GROUP BY 1
), kept AS (
  SELECT r.doc_id, string_agg(substr(r.h, 2 * g.s + 1, 2 * (coalesce(g.e, octet_length(r.b)) - g.s)), '' ORDER BY g.s) AS h FROM raw r JOIN gaps g ON g.doc_id = r.doc_id GROUP BY 1
), cut AS (
  SELECT doc_id, sum(e - s) AS n, count(*) AS k FROM spans GROUP BY 1
)
SELECT r.doc_id, CAST(octet_length(r.b) AS BIGINT) AS n_bytes, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c.k, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN c.k IS NULL THEN r.b ELSE unhex(kept.h) END) AS kept_sha256
FROM raw r LEFT JOIN cut c ON c.doc_id = r.doc_id LEFT JOIN kept ON kept.doc_id = r.doc_id
"""
