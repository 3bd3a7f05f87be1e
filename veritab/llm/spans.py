"""Byte spans of documents, and cutting them out of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textbytes as tb


def union(doc: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping or touching spans of a document joined."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    far = np.maximum.accumulate(end + (np.cumsum(np.append(True, doc[1:] != doc[:-1])) << 42)) & ((1 << 42) - 1)
    new = np.append(True, (doc[1:] != doc[:-1]) | (start[1:] > far[:-1]))
    return doc[new], start[new], np.maximum.reduceat(far, np.flatnonzero(new))


def merged(batch: pa.RecordBatch):
    """For each document of (doc_id, text, first, last, ...): its bytes, the merged spans, and what is left."""
    data, offsets = tb.buffers(batch.column(1))
    raw = data.tobytes()
    firsts, lasts = batch.column(2), batch.column(3)
    for k in range(len(batch)):
        own = raw[offsets[k] : offsets[k + 1]]
        s, e = (np.array(x[k].as_py() or [], np.int64) for x in (firsts, lasts))
        if not len(s):
            yield own, [], own
            continue
        _, s, e = union(np.zeros(len(s), np.int64), s, e)
        keep = [own[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(own)], strict=True)]
        yield own, list(zip(s.tolist(), e.tolist(), strict=True)), b"".join(keep)


def cut_texts(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The rows of spans (doc_id, text, first, last and docs' other columns as others) with the spans cut out of text and
    n_chars counted anew, in the columns of docs; bytes of characters cut in two go as well."""

    def run(batches):
        for batch in batches:
            texts = [left.decode(errors="ignore") for _, _, left in merged(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[4:]], names)

    names = ["doc_id", "text", *spans.columns[4:]]
    cut = spans.mapInArrow(run, StructType([spans.schema[c] for c in names]))
    new = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return cut.select(*(new[c] if c in new else F.col("others")[c].alias(c) for c in docs.columns))
