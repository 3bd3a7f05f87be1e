"""CSV records whose quoted fields hold line breaks, from files that many tasks read.

Whether a line's end ends a record depends on every quote before it.  A first pass takes each split of a file from both states, at
the start of a record and within quotes, and keeps where either leads; applied in order, these say how every split really
begins.  The second pass puts lines together: records within a split at once, the pieces of a record that crosses splits by
one small aggregation.  A quote opens a field only at its start, and is doubled to stand for itself.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINES = ["path", "start", "value"]


def ends_in_quotes(line: str, quoted: bool, sep: str) -> bool:
    """Whether the end of a line that begins within quotes, or at the start of a record, lies within quotes."""
    at, n = 0, len(line)
    while at <= n:
        if not quoted:
            if line.startswith('"', at):
                quoted, at = True, at + 1
                continue
        else:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('"', at + 1):
                at += 2
                continue
            quoted, at = False, at + 1
        at = line.find(sep, at)  # what follows a closing quote, or stands without one, reaches to the separator
        if at < 0:
            return False
        at += len(sep)
    return quoted


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value")


def _splits(batches):
    """((path, start), the lines) of each run of lines of one split."""
    for batch in batches:
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if len(batch) else []
        first = 0
        for k in range(1, len(keys) + 1):
            if k == len(keys) or keys[k] != keys[first]:
                yield keys[first], batch.column(2).slice(first, k - first)
                first = k


def _maps(lines: DataFrame, sep: str) -> DataFrame:
    """For each split and either state at its start: the state at its end, and whether the record that is open there began in the split."""

    def run(batches):
        ends: dict[tuple, list] = {}
        for key, values in _splits(batches):
            found = ends.setdefault(key, [(False, False), (True, False)])
            for line in values.filter(pc.match_substring(values, '"')).to_pylist():
                for k, (quoted, own) in enumerate(found):
                    after = ends_in_quotes(line, quoted, sep)
                    found[k] = after, own if quoted == after else after
        rows = [(*key, *plain, *inside) for key, (plain, inside) in ends.items()]
        kinds = (pa.string(), pa.int64(), *[pa.bool_()] * 4)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["path", "start", "end0", "own0", "end1", "own1"])

    return lines.mapInArrow(run, "path string, start long, end0 boolean, own0 boolean, end1 boolean, own1 boolean")


def _begins(maps: DataFrame) -> dict[tuple[str, int], int | None]:
    """For each split the start of the split whose record is open where it begins, None at the start of a record.

    One entry for each split, like the list of splits that Spark's driver holds itself."""
    out, open_, last = {}, None, None
    for r in sorted(maps.collect()):
        if r.path != last:
            open_, last = None, r.path
        out[r.path, r.start] = open_
        quoted, own = (r.end0, r.own0) if open_ is None else (r.end1, r.own1)
        open_ = None if not quoted else r.start if own or open_ is None else open_
    return out


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(value): each record of CSV files as one text, without blank ones and without the first of each file."""
    lines = _lines(spark, path)
    begins = _begins(_maps(lines, sep))

    def run(batches):
        key, state = None, None
        rows: list[tuple] = []

        def finished():  # a record that its split leaves open
            if key is not None and state["held"]:
                rows.append((key[0], key[1] if state["owner"] is None else state["owner"], key[1], "\n".join(state["held"])))

        def batch_of():
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["path", "record", "place", "value"])
            rows.clear()
            return out

        for here, values in _splits(batches):
            if here != key:
                finished()
                if here not in begins:
                    raise RuntimeError(f"the splits of {here[0]} have changed")
                key, state = here, {"owner": begins[here], "quoted": begins[here] is not None, "held": [], "heading": here[1] == 0}
            quotes = pc.match_substring(values, '"').to_pylist()
            for line, some in zip(values.to_pylist(), quotes, strict=True):
                quoted = ends_in_quotes(line, state["quoted"], sep) if some else state["quoted"]
                state["quoted"] = quoted
                if not quoted and not state["held"] and state["owner"] is None:
                    if state["heading"]:
                        state["heading"] = not line.strip()
                    elif line.strip():
                        rows.append((None, None, None, line.removesuffix("\r")))
                    continue
                state["held"].append(line)
                if quoted:
                    continue
                text, state["held"], owner, state["owner"] = "\n".join(state["held"]).removesuffix("\r"), [], state["owner"], None
                if owner is not None:
                    rows.append((key[0], owner, key[1], text))
                elif state["heading"]:
                    state["heading"] = False
                else:
                    rows.append((None, None, None, text))
            if len(rows) > 1000:
                yield batch_of()
        finished()
        yield batch_of()

    pieces = lines.mapInArrow(run, "path string, record long, place long, value string")
    whole = pieces.where("path is null").select("value")
    parted = pieces.where("path is not null").groupBy("path", "record").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("parts"))  # the pieces of one record
    return whole.unionAll(parted.select(F.array_join(F.transform("parts", lambda x: x["value"]), "\n").alias("value")))


def read_table(spark: SparkSession, path: str, schema: str, sep: str) -> DataFrame:
    """The records parsed into the columns of a schema."""
    options = {"sep": sep, "quote": '"', "escape": '"'}
    return read_records(spark, path, sep).select(F.from_csv("value", schema, options).alias("row")).select("row.*")
