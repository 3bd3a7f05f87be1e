"""Exact top-k inner products by a Voronoi partition.

Pivots are data vectors, more of them in larger tables; every vector belongs to its nearest pivot.  A group's summary is its size,
radius and the distances of its k + 1 members nearest to the pivot c.  For a query
q and a group, <q, x> <= <q, c> + |q| radius, and the i-th nearest member has at least
<q, c> - |q| d_i.  The k-th best of all those lower bounds is a score that the answer
certainly reaches, so q is compared only with groups whose upper bound reaches it.  Groups
are dealt to a bounded number of places, small ones together, a large one to several, in
packed blocks of bounded size; a query travels to a place once, not once for each group.
Blocks and queries meet in one join and are multiplied as matrices; what a query has found
raises its bound for the blocks that follow, and its k best in a place leave.
Vectors travel as the narrowest integers that hold them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import clashing, materialize, parallelism
from .textbytes import mix

#: Vectors for each pivot, and the bounds on the number of pivots; their vectors and summaries are what reaches the driver.
EACH, PIVOTS = 512, (16, 4096)
#: Rows of a block of data, of queries that are multiplied at once, and of a block of queries.
BLOCK, QUERIES, ASKED = 4096, 256, 2048
#: Places that groups are dealt to, and a query at most, where one vector in so many or more is a query.
PLACES = 64
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
#: The bound of scores, of either sign.
MOST = (1 << 63) - 1
LARGEST = float(np.finfo(np.float64).max)


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v) with v = floor(scale * x) per component as doubles; without vectors that are null or hold null, NaN or infinity.

    What exceeds the largest double stays at it; an empty vector has the score 0 with every other."""
    x = F.col("embedding").cast("array<double>")
    fit = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fit)
    whole = F.transform(x, lambda c: F.greatest(F.least(c * scale, F.lit(LARGEST)), F.lit(-LARGEST)))
    # a double of 2**52 or more is whole, and may be too large for the long that floor gives
    return rows.select("vec_id", F.transform(whole, lambda c: F.when(F.abs(c) < float(1 << 52), F.floor(c).cast("double")).otherwise(c)).alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of the given width; shorter ones are filled with zeros, which add nothing to a product."""
    size, flat = np.diff(column.offsets.to_numpy()), column.flatten().to_numpy()
    if (size == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width)[None, :] < size[:, None]] = flat
    return out


_KINDS = [np.dtype(np.int16), np.dtype(np.int32), np.dtype(np.float64)]


def _packed(rows: np.ndarray) -> bytes:
    most = np.abs(rows).max() if rows.size else 0
    code = 0 if most < 1 << 15 else 1 if most < 1 << 31 else 2
    return bytes([code]) + rows.astype(_KINDS[code]).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw[1:], _KINDS[raw[0]]).astype(np.float64).reshape(n, -1)


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """All inner products as exact integers; one beyond 64 bits stays at the bound of its sign."""
    most = v.shape[1] * np.abs(v).max(initial=0.0) * np.abs(q).max(initial=0.0)
    if most < EXACT:
        return (q @ v.T).astype(np.int64)
    if most < float(1 << 62):
        return q.astype(np.int64) @ v.T.astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m] for m in (q, v))
    return np.array([[max(-MOST, min(MOST, sum(a * b for a, b in zip(x, y, strict=True)))) for y in right] for x in left], np.int64).reshape(len(q), len(v))


def _pivots(vectors: DataFrame, n: int, width: int) -> np.ndarray:
    """About one of EACH of the n vectors, within PIVOTS, chosen by a hash; they alone reach the driver, whatever the number of tasks.

    A sorted limit would send it so many rows from every task.  Any pivots are right; where the hash meets none of a few rows repeated often, one does."""
    if not width:
        return np.zeros((1, 0))
    wanted = min(PIVOTS[1], max(PIVOTS[0], n // EACH))
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)) < wanted).select("v").distinct().collect() or vectors.select("v").limit(1).collect()
    return np.unique(np.array([r["v"] + [0.0] * (width - len(r["v"])) for r in rows]), axis=0)


def _blocks(data: DataFrame, pivots: np.ndarray, size: int) -> DataFrame:
    """(part, n, distances, ids, v): rows of one group, packed; distances to the pivot ascend."""

    def packed(part, distance, ids, rows):
        order = np.lexsort((ids, distance))
        for k in range(0, len(order), size):
            at = order[k : k + size]
            yield part, len(at), distance[at].tobytes(), ids[at].tobytes(), _packed(rows[at])

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1), pivots.shape[1])
            if not len(ids):
                continue
            near = (pivots**2).sum(axis=1)[None, :] - 2 * rows @ pivots.T
            part = near.argmin(axis=1)
            distance = np.sqrt(((rows - pivots[part]) ** 2).sum(axis=1))
            out = [r for p in np.unique(part).tolist() for r in packed(p, *(x[part == p] for x in (distance, ids, rows)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "n", "distances", "ids", "v"])

    return data.select("vec_id", "v").mapInArrow(run, "part long, n long, distances binary, ids binary, v binary")


def _summaries(blocks: DataFrame, k: int) -> dict[int, tuple[int, float, np.ndarray]]:
    """For each group: number of rows, radius, and the k + 1 smallest distances."""

    def run(batches):
        for batch in batches:
            least, most = [], []
            for raw, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                d, ids = np.frombuffer(raw, np.float64), np.frombuffer(ids, np.int64)
                _, first = np.unique(ids, return_index=True)  # a repeated vec_id bounds one score, not several
                near = np.sort(first)[: k + 1]
                least.append([{"d": float(d[i]), "id": int(ids[i])} for i in near.tolist()])
                most.append(float(d[-1]))
            kind = pa.list_(pa.struct([("d", pa.float64()), ("id", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(most), pa.array(least, kind)], ["part", "n", "radius", "least"])

    each = blocks.select("part", "distances", "ids", "n").mapInArrow(run, "part long, n long, radius double, least array<struct<d:double,id:bigint>>")
    heads = each.select("part", F.inline("least")).groupBy("part", "id").agg(F.min("d").alias("d"))
    heads = heads.withColumn("r", F.row_number().over(Window.partitionBy("part").orderBy("d", "id"))).where(F.col("r") <= k + 1)
    heads = heads.groupBy("part").agg(F.sort_array(F.collect_list("d")).alias("least"))
    rows = each.groupBy("part").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).join(heads, "part").collect()  # one row for each pivot
    return {r["part"]: (r["n"], r["radius"], np.array(r["least"])) for r in rows}


def _routed(queries: DataFrame, pivots: np.ndarray, summaries: dict, k: int, places: dict[int, range] | None = None) -> DataFrame:
    """(part, q_ids, q, floor): blocks of queries for every place of a group that they need, with the score each is sure to reach.

    places: where the blocks of each group lie (see _places); its own number, if not given.  A query goes to a place once, whatever it needs there."""
    parts = np.array(sorted(summaries), np.int64)
    radius = np.array([summaries[p][1] for p in parts.tolist()])
    nearest = [summaries[p][2] for p in parts.tolist()]
    owner = np.repeat(np.arange(len(parts)), [len(x) for x in nearest])
    nearest = np.concatenate(nearest)
    at_place: dict[int, list[int]] = {}
    for j, p in enumerate(parts.tolist()):
        for x in places[p] if places else [p]:
            at_place.setdefault(x, []).append(j)

    def judged(q):
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        middle = q @ pivots[parts].T
        slack = 1e-9 * (1 + np.abs(middle) + length * radius[None, :])
        low = middle[:, owner] - length * nearest[None, :] - slack[:, owner]
        # the query itself may be among the k + 1 best, so the (k + 1)-th counts
        floor = -np.partition(-low, k, axis=1)[:, k] if low.shape[1] > k else np.full(len(q), -np.inf)
        floor = np.minimum(np.where(np.isfinite(floor), floor, -np.inf), float(MOST))
        return floor, ~(middle + length * radius[None, :] + slack < floor[:, None])  # what overflows is needed

    def run(batches):
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), _matrix(batch.column(1), pivots.shape[1])
            out = []
            for f in range(0, len(ids), ASKED):
                q, own = rows[f : f + ASKED], ids[f : f + ASKED]
                floor, need = (np.concatenate(x) for x in zip(*[judged(q[g : g + QUERIES]) for g in range(0, len(q), QUERIES)], strict=True))
                for x, members in at_place.items():
                    at = np.flatnonzero(need[:, members].any(axis=1))
                    if len(at):
                        out.append((x, own[at].tobytes(), _packed(q[at]), floor[at].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["part", "q_ids", "q", "floor"])

    return queries.select("vec_id", "v").mapInArrow(run, "part long, q_ids binary, q binary, floor binary")


def _places(summaries: dict, most: int) -> dict[int, range]:
    """For each group the places, of at most most, that its rows are dealt to: groups follow each other, about equally many rows in a place."""
    total, before, out = sum(n for n, _, _ in summaries.values()), 0, {}
    size = max(BLOCK, -(-total // most))
    for part, (n, _, _) in sorted(summaries.items()):
        out[part] = range(before // size, (before + n - 1) // size + 1)
        before += n
    return out


def _gathered(blocks: DataFrame, places: dict[int, range]) -> DataFrame:
    """(part, groups, sizes, ids, v): the rows of a place in few blocks of about BLOCK rows, which hold several groups or some of a large one."""

    def deal(batches):
        for batch in batches:
            at = []
            for group, ids in zip(batch.column(0).to_pylist(), batch.column(3), strict=True):
                first = np.frombuffer(ids.as_buffer(), np.int64, 1).view(np.uint64)
                at.append(places[group][int(mix(first)[0]) % len(places[group])])
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(batch.column(k) for k in (0, 3, 4))], ["part", "group", "ids", "v"])

    def joined(part, rows):
        ids = [np.frombuffer(r[1], np.int64) for r in rows]
        v = np.concatenate([_unpacked(r[2], len(i)) for r, i in zip(rows, ids, strict=True)])
        groups, sizes = np.array([r[0] for r in rows]), np.array([len(i) for i in ids])
        new = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        return part, groups[new].tobytes(), np.add.reduceat(sizes, new).tobytes(), np.concatenate(ids).tobytes(), _packed(v)

    def gather(batches):
        place, held, n = None, [], 0
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        write = lambda r: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(r, kinds, strict=True)], ["part", "groups", "sizes", "ids", "v"])
        for batch in batches:
            for part, group, ids, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (part != place or n + len(ids) // 8 > BLOCK):
                    yield write(joined(place, held))
                    held, n = [], 0
                place, n = part, n + len(ids) // 8
                held.append((group, ids, v))
        if held:
            yield write(joined(place, held))

    dealt = blocks.select("part", "n", "distances", "ids", "v").mapInArrow(deal, "part long, group long, ids binary, v binary")
    dealt = dealt.repartition(parallelism(blocks.sparkSession), "part").sortWithinPartitions("part", "group")
    return dealt.mapInArrow(gather, "part long, groups binary, sizes binary, ids binary, v binary")


def _best(columns: list[np.ndarray], k: int) -> list[np.ndarray]:
    """(query, id, score) reduced to the k best of each query; an id counts once, with its best score."""
    order = np.lexsort((-columns[2], columns[1], columns[0]))
    q, ids, score = (c[order] for c in columns)
    once = np.append(True, (q[1:] != q[:-1]) | (ids[1:] != ids[:-1]))
    q, ids, score = q[once], ids[once], score[once]
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    new = np.append(True, q[1:] != q[:-1])
    near = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) < k
    return [q[near], ids[near], score[near]]


def _reached(best: list[np.ndarray], q_ids: np.ndarray, k: int, reach: np.ndarray) -> np.ndarray:
    """reach, raised to the score of the k-th best of each query that has so many."""
    ids, count = np.unique(best[0], return_counts=True)  # best is sorted by query, then by falling score
    full = count >= k
    if not full.any():
        return reach
    last = best[2][np.cumsum(count)[full] - 1].astype(float)
    # beyond 2**53 doubles are rounded, and what lies below the bound of 64 bits stays at it
    last = np.where(last <= -float(1 << 62), -np.inf, last - np.abs(last) * 2.0**-51)
    ids = ids[full]
    at = np.minimum(np.searchsorted(ids, q_ids), len(ids) - 1)
    return np.where(ids[at] == q_ids, np.maximum(reach, last[at]), reach)


def _solved(pairs: DataFrame, pivots: np.ndarray, summaries: dict, k: int) -> DataFrame:
    """The k best of each query of those that reach its floor, within each place: blocks of data that follow each other for one block of queries raise what counts."""
    radius = {p: r for p, (_, r, _) in summaries.items()}

    def better(q, q_ids, reach, groups, sizes, ids, v):
        around = np.array([radius[g] for g in groups.tolist()])[None, :]
        length = np.sqrt((q * q).sum(axis=1))[:, None]
        middle = q @ pivots[groups].T
        need = ~(middle + length * around + 1e-9 * (1 + np.abs(middle) + length * around) < reach[:, None])
        edge = np.append(0, np.cumsum(sizes)).tolist()
        for g, (x, y) in enumerate(zip(edge[:-1], edge[1:], strict=True)):
            rows = np.flatnonzero(need[:, g])
            if not len(rows):
                continue
            score = _scores(q[rows], v[x:y])
            usable = (score >= reach[rows][:, None]) & (ids[None, x:y] != q_ids[rows][:, None])
            if y - x > 4 * k and np.count_nonzero(usable) > 4 * k * len(rows) and len(np.unique(ids[x:y])) == y - x:  # only what may be among the k best
                usable &= score >= -np.partition(-np.where(usable, score, np.iinfo(np.int64).min + 1), k - 1, axis=1)[:, k - 1 : k]
            i, j = np.nonzero(usable)
            yield q_ids[rows[i]], ids[x + j], score[i, j]

    def run(batches):
        def out():
            return pa.RecordBatch.from_arrays([pa.array(c) for c in best], ["query_id", "vec_id", "score"])

        key, best = None, [np.zeros(0, np.int64)] * 3
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                groups, sizes, ids, asked, floor = (np.frombuffer(row[c].as_buffer(), t) for c, t in ((0, np.int64), (1, np.int64), (2, np.int64), (4, np.int64), (6, np.float64)))
                v = _unpacked(row[3].as_py(), len(ids))
                if key is None or key.tobytes() != asked.tobytes():
                    if len(best[0]):
                        yield out()
                    key, best, q, reach = asked.copy(), [np.zeros(0, np.int64)] * 3, _unpacked(row[5].as_py(), len(asked)), floor.copy()
                with np.errstate(over="ignore", invalid="ignore"):
                    found = [x for f in range(0, len(key), QUERIES) for x in better(*(y[f : f + QUERIES] for y in (q, key, reach)), groups, sizes, ids, v)]
                if any(len(x[0]) for x in found):
                    best = _best([np.concatenate(x) for x in zip(best, *found, strict=True)], k)
                    reach = _reached(best, key, k, reach)
        if len(best[0]):
            yield out()

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k largest inner products, ties to the smaller vec_id.

    vectors and queries: vec_id long, v array<double> of whole numbers (see quantised).
    A row is no candidate for a query of its own vec_id; repeated rows are candidates
    once.  Vectors may differ in length: what a shorter one lacks counts as zero.  Empty tables give no rows.
    A score beyond 64 bits stays at the bound of its sign."""
    spark = vectors.sparkSession
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = _pivots(vectors, n, width)
    blocks = materialize(_blocks(vectors, pivots, BLOCK), "blocks")
    summaries = _summaries(blocks, k)
    asked = materialize(queries.select("vec_id", "v").distinct(), "queries")
    many = asked.count()
    # each query may travel to every place: with so many places they weigh no more than the vectors, or 64 times their own
    places = _places(summaries, max(PLACES, n // max(1, many)))
    routed = _routed(asked.repartition(max(1, -(-many // ASKED))), pivots, summaries, k, places)
    pairs = routed.join(_gathered(blocks, places).hint("merge"), "part").select("groups", "sizes", "ids", "v", "q_ids", "q", "floor")
    found = _solved(pairs, pivots, summaries, k)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_topk_search(vectors: DataFrame) -> DataFrame:
    """The digest: queries are the rows whose vec_id is divisible by 50.

    Null ids and vectors that are null or not finite take no part, empty and huge ones do; a score beyond 64 bits stays at the bound of its sign; repeated rows count once; an empty table gives no rows."""
    data = quantised(clashing(vectors, ["vec_id", "embedding"]))
    return top_k(data, data.where("vec_id % 50 = 0"), 5)


ORACLE = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
