"""Near-duplicate groups by SetSketch registers.

A document's set of word shingles is hashed to 64 bits.  Register i of its sketch is
K_i = clamp(floor(1 - log_b min_x e_i(x)), 0, q + 1) with e_i exponential hashes: the
truncated minimum on an exponentially spaced scale.  Two sketches merge by max, and
registers agree with a probability close to the Jaccard similarity.

Steps: (1) sketch every text, collapse equal sets; (2) hash bands of registers and bring
equal ones together in one sorted shuffle, through which buckets of any size stream; (3) the
full sets of all members of shared buckets are written once; (4) each member is paired with
a centre and two predecessors of its buckets; the joint likelihood of (K_u > K_v, K_u < K_v, K_u = K_v) with
known set sizes drops pairs for which the threshold is out of reach, the full sets decide
on the rest; (5) connected components; (6) where a bucket still holds several components, its
members are compared among themselves.  Those of large ones meet under the rarest items of
their sets first: similar members share one of them, members that only met by chance do not.  Full sets
meet block by block, and a spanning forest of the links between components leaves the
block.  The plan is the same at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .shared import clashing, materialize, parallelism

#: Sketch scale: b close to 1 makes agreement track similarity; rate a and q cover sets of 1 to 1e18 items.
BASE = 1.001
RATE = 20.0
LIMIT = 65534
#: Log-likelihood by which the best similarity may beat the threshold before a pair is dropped unseen.
MARGIN = 9.0
#: Members of a bucket that are compared in one place; members of a larger bucket meet under their rarest items, and what then is larger becomes pairs of such blocks.
BLOCK = 1024


def _multipliers(m: int) -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _chunk_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, n): the sorted distinct hashes of each document of a chunk, one document after the other, and how many each has."""
    docs = len(offsets) - 1
    low = tb.LOWER[data]
    start, end, doc = tb.words(low, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    word = tb.slice_hashes(tb.prefix_hashes(tb.byte_values(low)), start, end)
    n = np.bincount(doc, minlength=docs)
    to = np.cumsum(n)
    rolled = np.zeros(len(word), np.uint64)
    with np.errstate(over="ignore"):
        for j, c in enumerate(tb.powers(0xD6E8FEB86659FD93, size)):
            rolled[: len(word) - j] += word[j:] * c if j else word
        whole = np.arange(len(word)) + size <= to[doc]
        items, owner = tb.mix(rolled[whole]), doc[whole]
        few = np.flatnonzero((n > 0) & (n < size))
        if len(few):
            at = (n < size)[doc]
            place = np.arange(len(word))[at] - (to - n)[doc[at]]
            sums = np.add.reduceat(word[at] * tb.powers(0xA24BAED4963EE407, size + 1)[place + 1], np.flatnonzero(place == 0))
            items, owner = np.append(items, tb.mix(sums)), np.append(owner, few)
    order = np.argsort(items)
    by = owner[order].astype(np.uint16) if docs < 1 << 16 else owner[order]  # a stable sort of short numbers takes one pass
    order = order[np.argsort(by, kind="stable")]
    items, owner = items[order], owner[order]
    once = np.append(True, (items[1:] != items[:-1]) | (owner[1:] != owner[:-1]))
    return items[once], np.bincount(owner[once], minlength=docs)


def chunk_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """For each chunk of documents of a batch: the sorted distinct 64-bit hashes of their word shingles, and the size of each set.

    Words are lower-cased (A-Z).  A text with fewer words than size counts as one
    shingle, its whole word sequence; one without words has none."""
    for first, last in tb.chunks(offsets):
        base = offsets[first]
        yield _chunk_sets(data[base : offsets[last]], offsets[first : last + 1] - base, size)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int):
    """The set of each document of a batch, as chunk_sets gives them."""
    for items, n in chunk_sets(data, offsets, size):
        to = np.cumsum(n)
        yield from (items[x:y] for x, y in zip((to - n).tolist(), to.tolist(), strict=True))


def minima(items: np.ndarray, multipliers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The least of the items under each of the hash functions, of every run of items that begins at one of starts: a row for each."""
    least = np.empty((len(starts), len(multipliers)), np.uint64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(multipliers.tolist()):
            least[:, k] = np.minimum.reduceat(items * np.uint64(c), starts)
    return least


def scaled(least: np.ndarray) -> np.ndarray:
    """Truncated minima on the exponential scale, as uint16 registers."""
    exponential = -np.log1p(-np.minimum(least.astype(np.float64) / 2.0**64, 1 - 2.0**-53)) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / math.log(BASE)) + LIMIT // 4, 0, LIMIT + 1).astype(np.uint16)


def registers(items: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """The sketch of one set of 64-bit hashes, as uint16 registers."""
    return scaled(minima(items, multipliers, np.zeros(1, np.int64))[0])


def sketch(docs: DataFrame, words: int, m: int) -> DataFrame:
    """(id, n, f1, f2, sketch) of a table with columns id and text; f1 and f2 identify the set."""

    def run(batches):
        scale = _multipliers(m)
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            sizes, f1, f2, found = [], [], [], []
            for items, n in chunk_sets(data, offsets, words):
                some = n > 0
                starts = (np.cumsum(n) - n)[some]
                one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                if len(starts):
                    with np.errstate(over="ignore"):
                        one[some] = np.add.reduceat(items, starts)
                        two[some] = np.bitwise_xor.reduceat(tb.mix(items + np.uint64(99)), starts)
                    found.append(scaled(minima(items, scale, starts)).tobytes())
                sizes.append(n)
                f1.append(one)
                f2.append(two)
            n, f1, f2 = (np.concatenate([np.zeros(0, t), *x]) for x, t in ((sizes, np.int64), (f1, np.uint64), (f2, np.uint64)))
            at = np.append(0, np.cumsum(2 * m * (n > 0))).astype(np.int32)
            out = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(b"".join(found))])
            f1, f2 = f1.view(np.int64), f2.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(f1), pa.array(f2), out], ["id", "n", "f1", "f2", "sketch"])

    return docs.select("id", "text").mapInArrow(run, "id long, n long, f1 long, f2 long, sketch binary")


def _bands(reps: DataFrame, bands: int, rows: int) -> DataFrame:
    """(bucket, id): one row for each band of each sketch."""

    def run(batches):
        scale = tb.powers(0xD6E8FEB86659FD93, rows)
        for batch in batches:
            data, _ = tb.buffers(batch.column(1))
            grid = data.view(np.uint16).reshape(-1, bands, rows).astype(np.uint64)
            with np.errstate(over="ignore"):
                keys = tb.mix(((grid + np.uint64(1)) * scale).sum(axis=2, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407) + np.arange(bands, dtype=np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands))], ["bucket", "id"])

    return reps.select("id", "sketch").mapInArrow(run, "bucket long, id long")


def _members(rows: DataFrame) -> DataFrame:
    """(bucket, id, low, before) of the buckets with two members or more: the smallest id of the bucket and the one before this.

    Buckets stream through their task in the order of ids, so their size does not matter.  The smallest is its own predecessor."""

    def run(batches):
        last = before0 = None
        low0 = seen = 0
        for batch in batches:
            bucket, ids = (batch.column(k).to_numpy() for k in range(2))
            if not len(ids):
                continue
            same = np.append(bucket[0] == last, bucket[1:] == bucket[:-1])
            once = ~(same & np.append(ids[0] == before0, ids[1:] == ids[:-1]))
            bucket, ids, same = bucket[once], ids[once], same[once]
            if not len(ids):
                continue
            group = np.cumsum(~same)  # 0: goes on from the batch before
            first = np.append(0, np.flatnonzero(~same))[group]
            place = np.arange(len(ids)) - first + np.where(group == 0, seen, 0)
            low = np.where(group == 0, low0, ids[first])
            before = np.append(before0 if seen else 0, ids[:-1])
            last, before0, low0, seen = bucket[-1], ids[-1], low[-1], place[-1] + 1
            rest, begin = place > 0, place == 1
            columns = [np.concatenate(x) for x in ((bucket[rest], bucket[begin]), (ids[rest], low[begin]), (low[rest], low[begin]), (before[rest], low[begin]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "id", "low", "before"])

    dealt = rows.repartition(parallelism(rows.sparkSession), "bucket").sortWithinPartitions("bucket", "id")
    return dealt.mapInArrow(run, "bucket long, id long, low long, before long")


def likely(na: np.ndarray, nb: np.ndarray, more: np.ndarray, less: np.ndarray, m: int, threshold: float) -> np.ndarray:
    """Whether a similarity of at least threshold is within MARGIN of the likeliest one."""
    most = np.minimum(na, nb) / np.maximum(na, nb)
    u = (na / (na + nb))[:, None]
    grid = np.linspace(0, 1, 101)[None, :] * most[:, None]
    grid = np.concatenate([grid, np.minimum(threshold, most)[:, None]], axis=1)

    def p(x):
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE), 1e-9, 1)

    up, down = p(u - (1 - u) * grid), p((1 - u) - u * grid)
    same = np.clip(1 - up - down, 1e-9, 1)
    logs = more[:, None] * np.log(up) + less[:, None] * np.log(down) + (m - more - less)[:, None] * np.log(same)
    reach = np.where(grid >= np.minimum(threshold, most)[:, None] - 1e-12, logs, -np.inf).max(axis=1)
    return (most >= threshold - 1e-12) & (reach >= logs.max(axis=1) - MARGIN)


def _estimated(pairs: DataFrame, reps: DataFrame, m: int, threshold: float) -> DataFrame:
    """The pairs (a, b) that the sketches do not rule out."""

    def run(batches):
        for batch in batches:
            a, b = (tb.buffers(batch.column(k))[0].view(np.uint16).reshape(-1, m) for k in (4, 5))
            keep = likely(batch.column(2).to_numpy().astype(float), batch.column(3).to_numpy().astype(float), (a > b).sum(axis=1), (a < b).sum(axis=1), m, threshold) if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    def side(k):
        return reps.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("sketch").alias(f"sketch_{k}"))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sketch_a", "sketch_b")
    return both.mapInArrow(run, "a long, b long")


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of a block of sets: frequent items as one matrix product, rare ones pair by pair."""
    g = len(sets)
    owner = np.repeat(np.arange(g), [len(x) for x in sets])
    items, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros((g, g), np.float32)
    frequent = np.flatnonzero(count > 32)
    place = np.full(len(items), -1)
    for k in range(0, len(frequent), 512):
        columns = frequent[k : k + 512]
        place[columns] = np.arange(len(columns))
        hit = place[number] >= 0
        grid = np.zeros((g, len(columns)), np.float32)
        grid[owner[hit], place[number[hit]]] = 1
        out += grid @ grid.T
        place[columns] = -1
    rare = (count[number] > 1) & (count[number] <= 32)
    order = np.argsort(number[rare], kind="stable")
    own, item = owner[rare][order], number[rare][order]
    for step in range(1, 32):
        together = item[step:] == item[:-step] if len(item) > step else np.zeros(0, bool)
        if not together.any():
            break
        flat = np.bincount(own[:-step][together] * g + own[step:][together], minlength=g * g).reshape(g, g)
        out += flat + flat.T
    return out


def _tree(linked: np.ndarray, c: np.ndarray) -> list[tuple[int, int]]:
    """Row pairs that join components: a spanning forest over the components of the linked rows."""
    _, group = np.unique(c, return_inverse=True)
    k = int(group.max()) + 1
    i, j = np.nonzero(linked & (group[:, None] != group[None, :]))
    example = np.full((k, k), -1, np.int64)
    example[group[i], group[j]] = i * len(c) + j
    seen, out = np.zeros(k, bool), []
    for root in range(k):
        stack = [] if seen[root] else [root]
        seen[root] = True
        while stack:
            x = stack.pop()
            new = np.flatnonzero((example[x] >= 0) & ~seen)
            seen[new] = True
            stack += new.tolist()
            out += [divmod(int(e), len(c)) for e in example[x][new]]
    return out


def _across(placed: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of one bucket in different components, enough of them to connect what any link connects.

    placed: key (a bucket, or a pair of blocks of a large one), id, c; full: id, items."""

    def run(batches):
        for rows in tb.whole_keys(batches, 0):
            rows = rows.combine_chunks()
            key, ids, c = (rows.column(k).to_numpy() for k in range(3))
            data, offsets = tb.buffers(rows.column(3))
            data, offsets = data.view(np.uint64), offsets // 8
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])).tolist() + [len(key)]
            found = set()
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if (c[x:y] == c[x]).all():
                    continue
                common = _common([data[offsets[k] : offsets[k + 1]] for k in range(x, y)])
                n = (offsets[x + 1 : y + 1] - offsets[x:y]).astype(np.float64)
                linked = (common > 0) & (100.0 * common >= percent * (n[:, None] + n[None, :] - common))
                found.update((min(int(ids[x + i]), int(ids[x + j])), max(int(ids[x + i]), int(ids[x + j]))) for i, j in _tree(linked, c[x:y]))
            found = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    rows = placed.join(full, "id").select("key", "id", "c", "items")
    rows = rows.repartition(parallelism(placed.sparkSession), "key").sortWithinPartitions("key")
    return rows.mapInArrow(run, "a long, b long").distinct()


def _binary(items: np.ndarray, n: np.ndarray) -> pa.Array:
    """The sets of a chunk as one binary value each."""
    at = np.append(0, 8 * np.cumsum(n)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(items.tobytes())])


def _sets(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, items): the full sets of the texts with these ids, written once.

    Texts are shuffled to the ids at every size: the ids grow with the input, so they are not broadcast."""

    def run(batches):
        for batch in batches:
            data, offsets = tb.buffers(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.chunked_array([_binary(*x) for x in chunk_sets(data, offsets, words)], pa.binary()).combine_chunks()], ["id", "items"])

    return materialize(docs.select("id", "text").join(ids.hint("shuffle_hash"), "id", "left_semi").mapInArrow(run, "id long, items binary"), "sets")


def _verified(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets (id, items) have 100 * intersection >= percent * union."""

    def judge(batches):
        for batch in batches:
            (da, oa), (db, ob) = tb.buffers(batch.column(2)), tb.buffers(batch.column(3))
            da, db, oa, ob = da.view(np.uint64), db.view(np.uint64), oa // 8, ob // 8
            keep = np.zeros(len(oa) - 1, bool)
            for k in range(len(keep)):
                x, y = da[oa[k] : oa[k + 1]], db[ob[k] : ob[k + 1]]
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), max(0, len(y) - 1))
                common = int((y[at] == x).sum()) if len(y) else 0
                keep[k] = common and 100 * common >= percent * (len(x) + len(y) - common)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    side = lambda k: full.select(F.col("id").alias(k), F.col("items").alias(f"items_{k}"))
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "items_a", "items_b").mapInArrow(judge, "a long, b long").distinct()


def _open(placed: DataFrame) -> DataFrame:
    """placed (bucket, id, c) of the buckets that hold several components, with the bucket's largest component, main, its size, most, and the number of all members, n."""
    sizes = placed.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    several = sizes.groupBy("bucket").agg(F.count("*").alias("components"), F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("c", F.struct("k", "c")).alias("main")).where("components > 1")
    return placed.join(several.drop("components"), "bucket")


def _prefixes(crowd: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(bucket, id, c): the members of crowd (id, c) under the rarest items of their sets, so many that no link is lost.

    Of two sets of n and k items that are linked, percent / 100 * max(n, k) items are common, so in one order of all items
    the first n - ceil(percent / 100 * n) + 1 of the one and the like of the other share an item.  Rare ones first, few others share it."""

    def run(batches):
        for batch in batches:
            data, offsets = tb.buffers(batch.column(3))
            size = np.diff(offsets) // 8
            number = pa.array(np.repeat(np.arange(len(size)), size))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(number) for k in range(3)), pa.array(np.repeat(size, size)), pa.array(data.view(np.int64))], ["id", "c", "set", "n", "bucket"])

    # repeated rows of one id may have different sets
    held = crowd.join(full, "id").select("id", "c", F.xxhash64("items").alias("set"), "items").mapInArrow(run, "id long, c long, set long, n long, bucket long")
    held = materialize(held, "items")
    held = held.join(held.groupBy("bucket").agg(F.count("*").alias("k")).hint("merge"), "bucket")
    first = held.groupBy("id", "c", "set", "n").agg(F.sort_array(F.collect_set(F.struct("k", "bucket"))).alias("x"))
    wanted = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    return first.select(F.explode(F.slice("x", F.lit(1), wanted.cast("int"))).alias("x"), "id", "c").select("x.bucket", "id", "c").distinct()


def _blocks(placed: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """(key, id, c): what is to be compared in one place, of the members of open buckets as _open gives them.

    Where all but the largest component fit in one block, they go to each block of that component,
    whose members go to one place each.  Members of buckets with more of the others meet under the rarest items of their sets
    instead, which loses no link; where very many share one of those as well, every block of them meets every other."""
    others = F.col("n") - F.col("most")
    crowded = (F.col("n") > BLOCK) & (others > BLOCK)
    if not placed.where(crowded).isEmpty():
        again = _prefixes(placed.where(crowded).select("id", "c").distinct(), full, percent)
        placed = materialize(placed.where(~crowded).unionByName(_open(materialize(again, "prefixes"))), "open")
    upto = lambda count: F.sequence(F.lit(0).cast("long"), count - 1)
    all_blocks, main_blocks = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("most") / BLOCK)
    mine = F.pmod(F.xxhash64("id"), all_blocks)
    keys = (
        F.when(F.col("n") <= BLOCK, F.array(F.xxhash64("bucket")))
        .when(crowded, F.transform(upto(all_blocks), lambda x: F.xxhash64("bucket", F.least(x, mine), F.greatest(x, mine))))
        .when(F.col("c") == F.col("main"), F.array(F.xxhash64("bucket", F.pmod(F.xxhash64("id"), main_blocks))))
        .otherwise(F.transform(upto(main_blocks), lambda x: F.xxhash64("bucket", x)))
    )
    return placed.select(F.explode(keys).alias("key"), "id", "c")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 32, rows: int = 5) -> DataFrame:
    """(id, n_shingles, component) for every row of docs (columns id long, text string).

    component: the smallest id reachable over links, its own included.  Links join
    texts whose sets of word shingles have a Jaccard similarity of percent / 100 or
    more.  Null, empty and wordless texts have no shingles and no links.  Rows with a
    null id have no links and a null component; repeated rows of one id come back as often as they came.
    Sets hold 64-bit hashes of shingles; equal sets are told by size and 128 bits.
    A pair at 0.8 escapes all bands with probability (1 - 0.8**rows)**bands, 3e-6 here."""
    m, threshold = bands * rows, percent / 100
    all_sketches = materialize(sketch(docs, words, m), "sketch")
    reps = all_sketches.where("n > 0 and id is not null").groupBy("f1", "f2", "n").agg(F.min(F.struct("id", "sketch")).alias("x")).select("f1", "f2", "n", "x.id", "x.sketch")
    reps = materialize(reps, "sets-once")
    members = materialize(_members(_bands(reps, bands, rows)), "buckets")
    full = _sets(members.select("id").distinct(), docs, words)

    # one centre, and predecessors, which differ from bucket to bucket: an odd centre leaves no group unlinked
    chosen = F.array_distinct(F.array(F.min("low"), F.min("before"), F.max("before")))
    first = members.where("id <> low").groupBy("id").agg(chosen.alias("a")).select(F.explode("a").alias("a"), F.col("id").alias("b"))
    edges = materialize(_verified(_estimated(first, reps, m, threshold), full, percent), "links")
    groups = materialize(components(edges), "groups")

    placed = members.join(groups.withColumnRenamed("node", "id"), "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("c"))
    placed = materialize(_open(placed), "open")
    if not placed.isEmpty():
        more = materialize(_across(_blocks(placed, full, percent), full, percent), "links")
        if not more.isEmpty():
            stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
            groups = materialize(components(stars.union(more)), "groups")

    named = reps.join(groups.withColumnRenamed("node", "id"), "id", "left").select("f1", "f2", F.col("n").alias("n_"), F.coalesce("component", "id").alias("component"))
    out = all_sketches.select("id", "n", "f1", "f2").join(named.withColumnRenamed("n_", "n"), ["f1", "f2", "n"], "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its group, each text of it once; columns unchanged.

    Rows with a null doc_id are linked with nothing and stay."""
    groups = near_duplicates(clashing(docs, ["doc_id", "text"]).withColumnRenamed("doc_id", "id"), words, percent)
    kept = docs.join(groups.where("id = component").select(F.col("id").alias("doc_id")).distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    return kept.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def op1_minhash_dedup(docs: DataFrame) -> DataFrame:
    """The digest: two-word shingles, similarity 0.8; one row per row of documents.

    Rows with a null doc_id have a null component_id and are kept.  Extra columns, whatever
    their names, are ignored; an empty table gives no rows."""
    groups = near_duplicates(clashing(docs, ["doc_id", "text"]).withColumnRenamed("doc_id", "id"), words=2, percent=80)
    return groups.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


ORACLE = """
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), items AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS item FROM words
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM items GROUP BY 1
), numbered AS MATERIALIZED (
  SELECT doc_id, n, dense_rank() OVER (ORDER BY item) AS item FROM items JOIN sizes USING (doc_id)
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM numbered a JOIN numbered b ON a.item = b.item AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, low) AS (
  SELECT a, a FROM edges UNION SELECT e.b, r.low FROM reach r JOIN edges e ON e.a = r.node WHERE r.low < e.b
), lowest AS (
  SELECT node, min(low) AS low FROM reach GROUP BY 1
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(low, d.doc_id) AS component_id, coalesce(low, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest ON node = d.doc_id
"""
