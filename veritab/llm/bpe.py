"""Byte-level BPE by a global shuffle of distinct words.

Texts are split into pre-tokens.  A batch of documents keeps the order of its
pre-tokens as numbers and sends each different word once, to the bucket that the word's
hash names; all batches send a word to the same bucket, where it is encoded once.
The bucket returns ids to each batch that asked, in the order of the words sent, so
neither words nor positions travel back.  Batch and ids meet in one join, and the
pre-tokens' numbers bring the ids into the order of the text.  Blocks instead of single
rows keep what is shuffled below the size of the input.

Decoding joins the ids to the table of token bytes, which has one entry per id.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pretokens
from . import textbytes as tb
from .shared import clashing, parallelism

#: Buckets of words for each shuffle partition.
BUCKETS = 4
#: Pre-tokens whose ids are brought into order at a time.
TOKENS = 1 << 18


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(x) for x in raw], np.int64).tobytes() + zlib.compress(b"".join(raw), 1)


def _unpack(block: bytes, *types) -> list[np.ndarray]:
    sizes = np.frombuffer(block, np.int64, len(types))
    raw, at, out = zlib.decompress(block[8 * len(types) :]), 0, []
    for size, kind in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _planes(numbers: np.ndarray) -> list[np.ndarray]:
    """Four bytes of each number, plane by plane, which compress better."""
    return list(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T)


def _chunks(batches):
    """(batch number, documents, the distinct() of the chunk) of every chunk of a partition.

    The number holds the partition, the chunk and a hash of the chunk's words, so
    two readings of the input agree on it exactly if they saw the same chunk."""
    from pyspark import TaskContext

    k = 0
    for batch in batches:
        for f, to, *found in pretokens.distinct(batch.column(1)):
            with np.errstate(over="ignore"):
                content = found[3].sum(dtype=np.uint64) + np.uint64(TaskContext.get().partitionId() << 20) + np.uint64(k)
            yield int(tb.mix(np.array([content])).view(np.int64)[0]), batch.column(0).slice(f, to - f), found
            k += 1


def _words(docs: DataFrame, buckets: int) -> DataFrame:
    """(batch, bucket, block): the words a batch sends to each bucket."""

    def run(batches):
        for number, _, (data, start, end, hashes, _, _) in _chunks(batches):
            raw = data.tobytes()
            lengths = (end - start).astype(np.uint32)
            found = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            edges = np.searchsorted(bucket, np.arange(buckets + 1)).tolist()
            rows = [(b, _pack(lengths[x:y], np.frombuffer(b"".join(found[x:y]), np.uint8))) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["batch", "bucket", "block"])

    return docs.mapInArrow(run, "batch long, bucket long, block binary")


def _order(docs: DataFrame) -> DataFrame:
    """(batch, block): the documents of a batch as numbers of its words."""

    def run(batches):
        for number, ids, (_, _, _, hashes, counts, which) in _chunks(batches):
            by_count = np.argsort(-np.bincount(which, minlength=len(hashes)), kind="stable")
            rank = np.empty(len(hashes), np.uint32)
            rank[by_count] = np.arange(len(hashes), dtype=np.uint32)
            null = np.array(ids.is_null(), bool)
            block = _pack(ids.fill_null(0).to_numpy(), null.astype(np.uint8), counts, by_count.astype(np.uint32), *_planes(rank[which]))
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([block], pa.binary())], ["batch", "block"])

    return docs.mapInArrow(run, "batch long, block binary")


def _encoded(words: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(batch, bucket, ids): for each block of words the block of their ids.  Each word of a bucket is encoded once."""

    def run(batches):
        encode, kind = pretokens.encoder(ranks_path, pattern), pretokens.id_type(ranks_path)
        size = np.dtype(kind).itemsize
        known, current = {}, None
        for batch in batches:
            out = []
            for bucket, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != current:
                    known, current = {}, bucket
                lengths, raw = _unpack(block.as_py(), np.uint32, np.uint8)
                raw, lists = raw.tobytes(), []
                ends = np.cumsum(lengths)
                for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True):
                    word = raw[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word.decode()), kind).tobytes()
                    lists.append(ids)
                out.append(_pack(np.array([len(x) // size for x in lists], np.uint32), np.frombuffer(b"".join(lists), kind)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["batch", "bucket", "ids"])

    return words.repartition(parallelism(words.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(run, "batch long, bucket long, ids binary")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids of every text, as little-endian unsigned integers of pretokens.id_type.

    docs: doc_id long, text string.  Null and empty texts have no ids; rows come back
    as often as they came, those with a null doc_id as well.  docs is read twice, which
    costs less than keeping the split texts on disk; an input that comes in another order
    the second time (a shuffle's output) is noticed and refused: write it as a table first."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    ids = _encoded(_words(docs, BUCKETS * parallelism(spark)), ranks_path, pattern)
    ids = ids.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("bucket", "ids"))).alias("answers"))
    both = _order(docs).join(ids.select("batch", F.col("answers.ids").alias("ids")).hint("merge"), "batch", "left")

    def run(batches):
        kind = pretokens.id_type(ranks_path)
        for batch in batches:
            for block, answers in zip(batch.column(0), batch.column(1), strict=True):
                doc, null, words, by_count, *planes = _unpack(block.as_py(), np.int64, np.uint8, np.int64, np.uint32, *[np.uint8] * 4)
                which = by_count[np.ascontiguousarray(np.stack(planes, axis=1)).view("<u4").ravel()]
                answers = answers.as_py()
                if len(by_count) and not answers:
                    raise RuntimeError("the input was not read in the same order twice; write it as a table first")
                parts = [_unpack(x, np.uint32, kind) for x in answers or []]
                size = np.concatenate([p[0] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
                flat = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, kind)
                at, to = np.cumsum(size) - size, np.append(0, np.cumsum(words))
                for f, last in tb.chunks(to, TOKENS):  # documents of so many pre-tokens at a time
                    ordered, ends = pretokens.spread(flat, at, size, which[to[f] : to[last]])
                    cut = np.append(0, ends)[to[f : last + 1] - to[f]]
                    texts = [ordered[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[f:last], mask=null[f:last] > 0), pa.array(texts, pa.binary())], ["doc_id", "ids"])

    return both.select("block", "ids").mapInArrow(run, "doc_id long, ids binary")


class TokenBytes:
    """The table of token bytes, ready to be joined to whole arrays of ids."""

    def __init__(self, ranks_path: str):
        ranks = pretokens.read_ranks(ranks_path)
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece
        self.size = np.array([len(p) for p in pieces])
        self.at = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return pretokens.spread(self.flat, self.at, self.size, ids.astype(np.int64))[0].tobytes()


def op8_bpe(docs: DataFrame) -> DataFrame:
    """The digest: encodes with byte_bpe_50k, decodes the ids again; one row per row of documents.

    Null texts are empty, rows with a null doc_id and repeated rows count like any other,
    extra columns are ignored, an empty table gives no rows."""
    import public_tokenizers as public

    path = public.path("byte_bpe_50k.tiktoken")

    def run(batches):
        table, kind = TokenBytes(path), pretokens.id_type(path)
        for batch in batches:
            n, ids_hash, text_hash = [], [], []
            data, offsets = tb.buffers(batch.column(1))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = data[a:b].view(kind)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(table.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encode(clashing(docs, ["doc_id", "text"]), path, public.PATTERN).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
