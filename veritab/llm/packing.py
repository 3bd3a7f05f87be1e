"""Packing into sequences along a space-filling curve.

Every document's hashed words are projected to three dimensions, which give a Hilbert
key; equal keys are spread by a hash of doc_id.  The light table of keys and lengths is
range-sorted, running sums give each document its place in one long stream, and the
stream is cut every 1024 tokens: only the last sequence is not full.  The token ids
themselves are written once, and meet their places in one join.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from . import textbytes as tb
from .shared import clashing, materialize, parallelism

DIMS, BITS = 3, 10
SPECIAL = "<|endoftext|>"
#: Bytes of text in hand at a time, and words whose ids a worker remembers.
CHUNK, KNOWN = 2 << 20, 200_000


def hilbert(points: np.ndarray) -> np.ndarray:
    """Hilbert index of rows of DIMS unsigned integers of BITS bits (Skilling's transform)."""
    x = [points[:, k].astype(np.int64) for k in range(DIMS)]
    q = 1 << (BITS - 1)
    while q > 1:
        for i in range(DIMS):
            high = (x[i] & q) != 0
            t = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            x[i] = x[i] if i == 0 else x[i] ^ t
        q >>= 1
    for i in range(1, DIMS):
        x[i] ^= x[i - 1]
    t = np.zeros(len(points), np.int64)
    q = 1 << (BITS - 1)
    while q > 1:
        t = np.where(x[-1] & q, t ^ (q - 1), t)
        q >>= 1
    out = np.zeros(len(points), np.int64)
    for bit in range(BITS - 1, -1, -1):
        for i in range(DIMS):
            out = (out << 1) | (((x[i] ^ t) >> bit) & 1)
    return out


def _vectors(hashes: np.ndarray, which: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Mean over a document's words of DIMS pseudo-random numbers in [-1, 1)."""
    count = np.maximum(np.bincount(doc, minlength=n), 1)
    out = np.empty((n, DIMS))
    for k in range(DIMS):
        value = tb.mix(hashes + np.uint64(k + 1)).view(np.int64) / 2.0**63
        out[:, k] = np.bincount(doc, weights=value[which], minlength=n) / count
    return out


@lru_cache(1)
def _special(json_path: str) -> tuple[bytes, int]:
    from tokenizers import Tokenizer

    return SPECIAL.encode(), Tokenizer.from_file(json_path).token_to_id(SPECIAL)


def tokenized(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """(key, doc_id, n, ids): Hilbert key, number of ids with the closing 0, ids as integers of pretokens.id_type."""

    def run(batches):
        word_ids, kind = pretokens.encoder(ranks_path, pattern), pretokens.id_type(ranks_path)
        closing, width = bytes(np.dtype(kind).itemsize), np.dtype(kind).itemsize
        special, special_id = _special(json_path)
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for f, to, data, start, end, hashes, counts, which in pretokens.distinct(batch.column(1), CHUNK, special):
                raw = data.tobytes()
                if len(known) > KNOWN:
                    known.clear()
                lists = []
                for a, b in zip(start.tolist(), end.tolist(), strict=True):
                    word = raw[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = [special_id] if word == special else word_ids(word.decode())
                    lists.append(ids)
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                flat = np.fromiter((x for ids in lists for x in ids), kind, int(size.sum()))
                ids, ends = pretokens.spread(flat, np.cumsum(size) - size, size, which)
                n = to - f
                token_end = np.append(0, ends)[np.cumsum(counts)]
                token_start = np.append(0, token_end[:-1])
                raw_ids = ids.tobytes()
                closed = [raw_ids[width * a : width * b] + closing for a, b in zip(token_start.tolist(), token_end.tolist(), strict=True)]
                place = np.clip((np.tanh(4 * _vectors(hashes, which, np.repeat(np.arange(n, dtype=np.int32), counts), n)) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)
                doc_id = batch.column(0).slice(f, n)
                fine = (tb.mix(doc_id.fill_null(-1).to_numpy().view(np.uint64)) >> np.uint64(33)).astype(np.int64)
                key = (hilbert(place.astype(np.int64)) << 31) | fine
                yield pa.RecordBatch.from_arrays([pa.array(key), doc_id, pa.array(token_end - token_start + 1), pa.array(closed, pa.binary())], ["key", "doc_id", "n", "ids"])

    return docs.mapInArrow(run, "key long, doc_id long, n long, ids binary")


def _placed(tokens: DataFrame) -> DataFrame:
    """(row, start) with the place of each row's first token in the whole stream."""

    def run(batches):
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = total + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n), pa.array(np.full(len(n), part)), batch.column(1)], ["row", "within", "part", "n"])
            total = int(ends[-1]) if len(ends) else total

    light = tokens.select("key", "doc_id", "n", "row")
    light = light.repartitionByRange(parallelism(tokens.sparkSession), "key", "doc_id").sortWithinPartitions("key", "doc_id", "n", "row")
    light = materialize(light.select("row", "n").mapInArrow(run, "row long, within long, part long, n long"), "places")
    before, begin = 0, {}
    for part, n in sorted(light.groupBy("part").agg(F.sum("n")).collect()):  # one row for each partition
        begin[part] = before
        before += n
    if not begin:
        return light.select("row", F.col("within").alias("start"))
    offset = F.create_map(*[F.lit(x) for pair in begin.items() for x in pair])
    return light.select("row", (F.col("within") + offset[F.col("part")]).alias("start"))


def pack(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, length: int = 1024) -> DataFrame:
    """One row for each piece of each document.

    docs: doc_id long, text string.  Null texts are empty and still have their closing
    id; rows with a null doc_id and repeated rows each get a place of their own.  Tokens and
    places meet in a shuffled join at every size, since both grow with the input."""
    tokens = tokenized(docs.select("doc_id", "text"), json_path, ranks_path, pattern)
    tokens = materialize(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")

    def run(batches):
        kind = pretokens.id_type(ranks_path)
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            ids = data.view(kind).astype("<u4")
            offsets = offsets // np.dtype(kind).itemsize
            n, begin = np.diff(offsets), batch.column(2).to_numpy()
            first, last = begin // length, (begin + n - 1) // length
            count = last - first + 1
            row = np.repeat(np.arange(len(n)), count)
            sequence = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            a = np.maximum(sequence * length, begin[row])
            b = np.minimum((sequence + 1) * length, (begin + n)[row])
            raw = ids.tobytes()
            at = (offsets[:-1] - begin)[row]
            crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip((a + at).tolist(), (b + at).tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(a - begin[row]), pa.array(b - a), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(sequence), pa.array(a - sequence * length)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    both = tokens.select("doc_id", "ids", "row").join(_placed(tokens).hint("merge"), "row").select("doc_id", "ids", "start")
    return both.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op9_packing(docs: DataFrame) -> DataFrame:
    """The digest: sequences of 1024 ids of byte_bpe_50k, one row per piece.

    Null texts are empty documents, rows with a null doc_id and repeated rows are packed
    like any other, extra columns are ignored, an empty table gives no rows."""
    import public_tokenizers as public

    return pack(clashing(docs, ["doc_id", "text"]), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
