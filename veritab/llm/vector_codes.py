"""Vector code compression: product quantisation with annular norm pruning.

A codebook's entries are sorted by norm.  By the triangle inequality an entry can be nearer to x than the best so far
only if its norm differs from that of x by at most that distance; so the search starts at the entry whose norm is nearest,
goes outward on both sides, and evaluates, in whole numbers, just the entries of the annulus that the best distance still
allows, its rim included.  Entries of equal distance go to the lower index.

Vectors are stored once as whole numbers.  A training round is one pass: tasks add up the parts of each entry, the sums meet in
one aggregation whose result has the codebooks' size, and only that reaches the driver.  Sums travel in limbs of 32 bits, so they
are exact whatever the number of rows and the size of components.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import attach, clashing, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this stay in 64-bit arithmetic; vectors with larger ones are compared in Python's unbounded integers.
NARROW = 1 << 26
LONGEST = (1 << 63) - 1
_LIMB = 32


@dataclass(frozen=True)
class Codebooks:
    """entries[part][entry]: whole components, all of one width."""

    entries: list[list[list[int]]]
    width: int

    def sha256(self) -> str:
        """Of all components by part, entry and position, as decimal numbers between commas."""
        return hashlib.sha256(",".join(str(x) for part in self.entries for e in part for x in e).encode()).hexdigest()


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v, wide): v = floor(scale * x) of each component, or, if one is NARROW or larger, null and the vector in wide.

    Vectors that are null or hold null, NaN or infinity are dropped; empty ones stay."""
    x = F.col("embedding").cast("array<double>")
    rows = clashing(vectors, ["vec_id", "embedding", "label"]).where(F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    small = F.forall(x, lambda c: F.abs(c) < NARROW / scale)
    return rows.select("vec_id", "label", F.when(small, F.transform(x, lambda c: F.floor(c * scale).cast("int"))).alias("v"), F.when(~small, x).alias("wide"))


def _whole(x: float, scale: int) -> int:
    """floor(scale * x), exact for every finite x."""
    top, bottom = float(x).as_integer_ratio()
    return scale * top // bottom


def _parts(batch: pa.RecordBatch, width: int, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray, list[list[list[int]]]]:
    """(rows of narrow vectors, their matrix [row, part, position], parts of the other rows as Python integers).  Shorter vectors end in zeros."""
    v, wide = batch.column(batch.schema.get_field_index("v")), batch.column(batch.schema.get_field_index("wide"))
    at = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
    kept = v.drop_null()
    size, out = np.diff(kept.offsets.to_numpy()), np.zeros((len(kept), parts * width), np.int64)
    out[np.arange(parts * width)[None, :] < size[:, None]] = kept.flatten().to_numpy()
    others = []
    for x in wide.drop_null().to_pylist():
        whole = [_whole(c, scale) for c in x] + [0] * (parts * width - len(x))
        others.append([whole[p * width : (p + 1) * width] for p in range(parts)])
    return at, out.reshape(-1, parts, width), others


def _exact(x: list[int], entries: list[list[int]]) -> tuple[int, int]:
    return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(entries))


class Annulus:
    """One part's codebook, sorted by norm."""

    def __init__(self, entries: list[list[int]]) -> None:
        self.all = entries
        small = [k for k, e in enumerate(entries) if all(abs(c) < NARROW for c in e)]
        rows = np.array([entries[k] for k in small], np.int64).reshape(len(small), len(entries[0]) if entries else 0)
        norms = np.sqrt((rows * rows).sum(axis=1).astype(np.float64))
        order = np.argsort(norms, kind="stable")
        self.rows, self.norms, self.index = rows[order], norms[order], np.array(small, np.int64)[order]
        self.evaluated = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) for each row of x, all of whose components are narrow."""
        n, m = len(x), len(self.index)
        if m < len(self.all) and n:  # an entry with a huge component: rare, and compared without pruning
            found = [_exact(row, self.all) for row in x.tolist()]
            return np.array([k for _, k in found], np.int64), np.array([min(d, LONGEST) for d, _ in found], np.int64)
        norm = np.sqrt((x * x).sum(axis=1).astype(np.float64))
        slack = 1e-6 + 1e-12 * norm
        right = np.clip(np.searchsorted(self.norms, norm), 1, m - 1) if m > 1 else np.zeros(n, np.int64)
        start = np.where((right > 0) & (norm - self.norms[right - 1] < self.norms[right] - norm), right - 1, right)
        best, entry = ((x - self.rows[start]) ** 2).sum(axis=1), self.index[start]
        self.evaluated += n
        for step in (1, -1):
            live, at = np.arange(n), start + step
            while len(live):
                inside = (at >= 0) & (at < m)
                live, at = live[inside], at[inside]
                inside = np.abs(self.norms[at] - norm[live]) <= np.sqrt(best[live].astype(np.float64)) * (1 + 1e-12) + slack[live]
                live, at = live[inside], at[inside]  # entries further out are further away in norm as well
                self.evaluated += len(live)
                d, k = ((x[live] - self.rows[at]) ** 2).sum(axis=1), self.index[at]
                better = (d < best[live]) | ((d == best[live]) & (k < entry[live]))
                best[live[better]], entry[live[better]] = d[better], k[better]
                at = at + step
        return entry, best


def _first(data: DataFrame, n: int, parts: int, scale: int) -> Codebooks:
    """The parts of the n smallest vec_ids; of several vectors with one id the smallest."""
    width = -(-(data.agg(F.max(F.greatest(F.size(F.coalesce("v", F.array())), F.size(F.coalesce("wide", F.array()))))).first()[0] or 0) // parts)
    chosen: dict[int, list[int]] = {}
    rest = data.where("vec_id is not null")
    while len(chosen) < n:  # at most n rounds, each a top-k
        rows = rest.orderBy("vec_id", "wide", "v").limit(4 * n).collect()
        for r in rows:
            whole = r["v"] if r["wide"] is None else [_whole(c, scale) for c in r["wide"]]
            if r["vec_id"] not in chosen and len(chosen) < n:
                chosen[r["vec_id"]] = whole + [0] * (parts * width - len(whole))
        if len(rows) < 4 * n:
            break
        rest = data.where(F.col("vec_id") > rows[-1]["vec_id"])
    return Codebooks([[x[p * width : (p + 1) * width] for x in chosen.values()] for p in range(parts)], width)


def _moved(data: DataFrame, books: Codebooks, scale: int) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor of its parts' mean; unused entries stay."""
    parts, n, width = len(books.entries), len(books.entries[0]), books.width

    def run(batches):
        sums, counts = np.zeros((parts, n, width), object), np.zeros((parts, n), np.int64)
        near = [Annulus(e) for e in books.entries]
        for batch in batches:
            at, narrow, others = _parts(batch, width, parts, scale)
            for p in range(parts):
                if len(at):
                    entry, _ = near[p].nearest(narrow[:, p])
                    counts[p] += np.bincount(entry, minlength=n)
                    for k in np.unique(entry).tolist():
                        sums[p, k] += narrow[entry == k, p].sum(axis=0).astype(object)
                for x in others:
                    _, k = _exact(x[p], books.entries[p])
                    counts[p, k] += 1
                    sums[p, k] += np.array(x[p], object)
        cells = [(c, 0, int(x)) for c, x in enumerate(counts.ravel().tolist()) if x]
        for c, x in enumerate(sums.ravel().tolist(), counts.size):
            limb, x = 0, int(x)
            while x:
                low = x & ((1 << _LIMB) - 1) if abs(x) >> _LIMB else x
                cells.append((c, limb, low))
                limb, x = limb + 1, (x - low) >> _LIMB
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in cells], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64()))], ["cell", "limb", "x"])

    found: dict[int, int] = defaultdict(int)
    for cell, limb, x in data.select("v", "wide").mapInArrow(run, "cell int, limb int, x long").groupBy("cell", "limb").agg(F.sum("x")).collect():  # of the codebooks' size
        found[cell] += x << (_LIMB * limb)
    entries = [[list(e) for e in part] for part in books.entries]
    for p in range(parts):
        for k in range(n):
            if count := found.get(p * n + k):
                first = parts * n + (p * n + k) * width
                entries[p][k] = [found.get(first + j, 0) // count for j in range(width)]
    return Codebooks(entries, width)


def trained(data: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """Codebooks of a table of quantised vectors; with fewer different ids than entries they have as many entries as ids."""
    books = _first(data, entries, parts, scale)
    for _ in range(rounds if books.entries[0] else 0):
        books = _moved(data, books, scale)
    return books


def encoded(data: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """data (see quantised) with code, two hexadecimal digits a part, and error, the squared distances summed over the parts; without v and wide.

    An error beyond 64 bits stays at their largest value.  Without entries (no vector has an id) both are null."""
    parts = len(books.entries)
    rest = [f for f in data.schema.fields if f.name not in ("v", "wide")]

    def run(batches):
        near = [Annulus(e) for e in books.entries]
        for batch in batches:
            at, narrow, others = _parts(batch, books.width, parts, scale)
            code, error = np.zeros((len(batch), parts), np.uint8), np.zeros(len(batch), object)
            if books.entries[0]:
                for p in range(parts):
                    entry, d = near[p].nearest(narrow[:, p])
                    code[at, p] = entry
                    error[at] += d.astype(object)
                for row, x in zip(np.setdiff1d(np.arange(len(batch)), at).tolist(), others, strict=True):
                    found = [_exact(x[p], books.entries[p]) for p in range(parts)]
                    code[row], error[row] = [k for _, k in found], sum(d for d, _ in found)
                codes = pa.array([bytes(c).hex() for c in code], pa.string())
                errors = pa.array([min(int(e), LONGEST) for e in error], pa.int64())
            else:
                codes, errors = pa.nulls(len(batch), pa.string()), pa.nulls(len(batch), pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(rest))), codes, errors], [*(f.name for f in rest), "code", "error"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), "code string", "error long"])
    return data.select(*[f.name for f in rest], "v", "wide").mapInArrow(run, schema)


def op13_vector_codes(vectors: DataFrame) -> DataFrame:
    """The digest: (vec_id, code, error, label_error, codebooks_sha256) of every vector that is kept.

    Null ids are encoded but start no codebook; rows of one id are encoded one by one, and the smallest of its vectors starts
    an entry; vectors shorter than the longest count as filled with zeros, and a length that 8 does not divide
    is filled to one that it does; null is a label like others; sums beyond 64 bits stay at their largest value; an empty table gives no rows."""
    data = materialize(quantised(vectors), "vectors")
    books = trained(data)
    rows = materialize(encoded(data, books), "codes")
    total = F.when(F.count("error") > 0, F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long"))
    labels = materialize(rows.groupBy("label").agg(total.alias("label_error")), "labels")
    return attach(rows, labels, "label").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _oracle() -> str:
    distance = "CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS BIGINT)"
    sql = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pieces AS MATERIALIZED (
  SELECT id, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) t(p)
), first AS (
  SELECT vec_id, min(v) AS v FROM kept WHERE vec_id IS NOT NULL GROUP BY 1 ORDER BY 1 LIMIT {ENTRIES}
), c0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS c FROM first, range({PARTS}) t(p)
)"""
    for r in range(ROUNDS + 1):
        sql += f""", a{r} AS MATERIALIZED (
  SELECT id, p, any_value(x) AS x, min({distance} * {ENTRIES} + e) AS best FROM pieces JOIN c{r} USING (p) GROUP BY id, p
)"""
        if r < ROUNDS:
            sql += f""", c{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT p, best % {ENTRIES} AS e, i, sum(x[i + 1])::BIGINT AS s, count(*) AS n FROM a{r}, range(len(x)) t(i) GROUP BY ALL) GROUP BY ALL) m USING (p, e)
)"""
    return sql + f""", coded AS (
  SELECT id, string_agg(printf('%02x', best % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(best // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY id
), hash AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN kept USING (id), hash
"""


ORACLE = _oracle()
