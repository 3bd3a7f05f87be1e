"""Ranked lexical search over a hierarchical max tree.

Documents are indexed in ranges of up to RANGE that follow each other in the table; a range is the root of a tree
whose nodes cover 1/16 of their parent's documents, down to leaves of 16.  For every node and term the index
keeps the largest saturation that one of the node's documents gives the term, so the sum of weight times maximum
over a query's terms bounds every score below the node.  A query opens nodes best bound first, evaluates
documents only in leaves, and stops at the first bound under its k-th score; a node whose bound equals it is opened, for ties.

Two passes over the index: in the first each query is solved in the few ranges of highest bound, which gives it a score
that its answer surely reaches; in the second it enters only the ranges whose bound reaches that.  Ranges are
independent rows of a written table, so the work spreads over as many tasks as there is data.  Queries are taken in blocks of
bounded size, each a pass over the documents: what a block sends to the tasks, its terms and weights, has that bound.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import clashing, materialize
from .textbytes import LOWER, buffers

K = 20
#: Documents and postings of a range, and children of a node.
RANGE, POSTINGS, FAN = 4096, 1 << 20, 16
#: Terms (with repeats) and items of a block of queries; an item with more terms is a block of its own.
TERMS, ITEMS = 1 << 20, 4096
#: Ranges in which a query is solved first.
FIRST = 4
#: Above this, doubles no longer count exactly.
EXACT = float(1 << 53)
#: The pattern of terms, [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+, as a table over bytes: ASCII letters and digits, and all that is not ASCII.
IS_TERM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(terms in order, with A-Z lower-cased, and the text of each)."""
    if not len(data):
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    inside = IS_TERM[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    start = np.flatnonzero(inside & (cut[:-1] | ~np.append(False, inside[:-1])))
    text = LOWER[data[inside]]
    at = np.append(np.cumsum(inside)[start] - 1, len(text)).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(text)])
    return found, np.searchsorted(offsets, start, side="right") - 1


# -- queries --------------------------------------------------------------------------


class Block:
    """Queries as sparse rows: terms[at[q]:at[q+1]] of query q, how often each stands in it, and the weights once they are known."""

    def __init__(self, ids: list, texts: list[bytes]) -> None:
        self.ids = ids
        column = pa.array(texts, pa.large_binary())
        found, owner = terms(*buffers(column))
        self.vocabulary = pc.unique(found)
        place = pc.index_in(found, value_set=self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) if len(found) else np.zeros(0, np.int64)
        key, self.count = np.unique(owner * max(1, len(self.vocabulary)) + place, return_counts=True)
        self.term = key % max(1, len(self.vocabulary))
        self.at = np.searchsorted(key // max(1, len(self.vocabulary)), np.arange(len(ids) + 1))
        self.weight = np.zeros(len(self.term), np.int64)

    def weigh(self, n: int, holding: np.ndarray) -> None:
        one = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
        self.weight = one[self.term] * self.count

    def bounds(self, term: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The bound of each query at a root with these maxima of terms."""
        dense = np.zeros(len(self.vocabulary) + 1, np.int64)
        dense[term] = most
        product = np.append(self.weight * dense[self.term], 0)
        return np.where(self.at[1:] > self.at[:-1], np.add.reduceat(product, np.minimum(self.at[:-1], len(product) - 1)), 0)


def _blocks(items: DataFrame) -> list[Block]:
    """The items in blocks; an id counts once, with its smallest text."""
    once = clashing(items, ["item_id", "text"]).groupBy("item_id").agg(F.min("text").alias("text")).where("text is not null")
    long = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    sized = once.withColumn("n", long).where("n > 0")
    n, total = sized.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    count = max(-(-n * 2 // ITEMS), -(-total * 2 // TERMS)) if n > ITEMS or total > TERMS else 1
    if count > 1:
        sized = materialize(sized, "items")
    out = []
    for k in range(count if n else 0):
        rows = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(count)) == k).select("item_id", F.col("text").cast("binary").alias("text")).collect()
        if rows:
            out.append(Block([r["item_id"] for r in rows], [bytes(r["text"]) for r in rows]))
    return out


# -- index ----------------------------------------------------------------------------

_POSTINGS = "range long, docs long, terms long, ids array<long>, n binary, doc binary, term binary, tf binary"
_INDEX = "range long, ids array<long>, term0 binary, most0 binary, node1 binary, term1 binary, most1 binary, node2 binary, term2 binary, most2 binary, doc binary, term binary, score binary"


def _postings(docs: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """Ranges of documents: their ids and numbers of terms, and (document, term, occurrences) of the vocabulary, by document."""

    def run(batches):
        held, size, made = [], [0, 0], 0

        def range_of():
            nonlocal made
            ids = pa.concat_arrays([h[0] for h in held])
            n, doc, term, tf = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3, 4))
            doc = doc + np.repeat(np.cumsum([0] + [len(h[0]) for h in held])[:-1], [len(h[2]) for h in held])
            row = [TaskContext.get().partitionId() << 32 | made, int((n > 0).sum()), int(n.sum()), None, n.astype(np.int64).tobytes(), *(x.astype(np.int32).tobytes() for x in (doc, term, tf))]
            made += 1
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays([listed if x is None else pa.array([x]) for x in row], [c.split()[0] for c in _POSTINGS.split(", ")])

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, RANGE - size[0])
                at += len(part)
                found, owner = terms(*buffers(part.column(1)))
                n = np.bincount(owner, minlength=len(part))
                place = pc.index_in(found, value_set=vocabulary)
                hit = place.is_valid().to_numpy(zero_copy_only=False)
                key, tf = np.unique(owner[hit] * len(vocabulary) + place.drop_null().to_numpy().astype(np.int64), return_counts=True)
                held.append((part.column(0), n, key // len(vocabulary), key % len(vocabulary), tf))
                size = [size[0] + len(part), size[1] + len(key)]
                if size[0] >= RANGE or size[1] >= POSTINGS:
                    yield range_of()
                    held, size = [], [0, 0]
        if held:
            yield range_of()

    return clashing(docs, ["doc_id", "text"]).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _POSTINGS)


def _holding(postings: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def run(batches):
        count = np.zeros(size, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                count += np.bincount(np.frombuffer(raw, np.int32), minlength=size)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["term", "df"])

    out = np.zeros(size, np.int64)
    for term, df in postings.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect():  # at most the vocabulary
        out[term] = df
    return out


def _largest(node: np.ndarray, term: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    """(node, term, largest value), by node and term."""
    order = np.lexsort((term, node))
    node, term, value = node[order], term[order], value[order]
    if not len(node):
        return [node, term, value]
    first = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (term[1:] != term[:-1])))
    return [node[first], term[first], np.maximum.reduceat(value, first)]


def _index(postings: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The max tree of each range, level by level, and the documents' saturations."""

    def run(batches):
        for batch in batches:
            rows = []
            for k in range(len(batch)):
                n, doc, term, tf = (np.frombuffer(batch.column(c)[k].as_py(), t).astype(np.int64) for c, t in ((2, np.int64), (3, np.int32), (4, np.int32), (5, np.int32)))
                m = 75 + np.array([25 * x * n_docs // n_terms for x in n.tolist()], np.int64)[doc]
                score = (1_000_000_000 * tf) // (1000 * tf + 12 * m)
                leaf = _largest(doc // FAN, term, score)
                middle = _largest(leaf[0] // FAN, *leaf[1:])
                root = _largest(middle[0] * 0, *middle[1:])[1:]
                rows.append([x.astype(np.int32).tobytes() for x in (*root, *middle, *leaf, doc, term, score)])
            columns = [pa.array([r[k] for r in rows], pa.binary()) for k in range(11)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [c.split()[0] for c in _INDEX.split(", ")])

    return postings.select("range", "ids", "n", "doc", "term", "tf").mapInArrow(run, _INDEX)


class _Tree:
    """One range.  A node of level 1 or 2 owns a slice of the next level's entries."""

    def __init__(self, raw: list[bytes]) -> None:
        term0, most0, node1, term1, most1, node2, term2, most2, doc, term, score = (np.frombuffer(x, np.int32).astype(np.int64) for x in raw)
        self.root = term0, most0
        self.levels = [(node1, term1, most1), (node2, term2, most2), (doc, term, score)]
        self.slices = [np.array([0, len(node1)]), np.searchsorted(node2, np.arange(FAN + 1) * FAN), np.searchsorted(doc, np.arange(FAN * FAN + 1) * FAN)]

    def _sums(self, level: int, node: int, weights: np.ndarray, safe: bool) -> np.ndarray:
        """For each child of a node the sum of weight times value over its terms."""
        a, b = self.slices[level][node : node + 2]
        child, term, value = (x[a:b] for x in self.levels[level])
        product = weights[term] * value
        if safe:
            return np.bincount(child - node * FAN, product, FAN).astype(np.int64)
        out = np.zeros(FAN, np.int64)
        np.add.at(out, child - node * FAN, product)
        return out

    def search(self, weights: np.ndarray, bound: int, least: int, k: int) -> tuple[list[int], list[int], int]:
        """(documents, scores, nodes opened) of all that may be among the k best and score least or more; weights: by term."""
        safe, open_nodes, best, docs, scores, opened = bound < EXACT, [(-bound, 0, 0)], [], [], [], 0
        while open_nodes and -open_nodes[0][0] >= least:
            _, level, node = heapq.heappop(open_nodes)
            opened += 1
            sums = self._sums(level, node, weights, safe)
            for j in np.flatnonzero(sums >= least).tolist():
                s, child = int(sums[j]), node * FAN + j
                if level < 2:
                    heapq.heappush(open_nodes, (-s, level + 1, child))
                else:
                    docs.append(child)
                    scores.append(s)
                    heapq.heappush(best, s)
                    if len(best) > k:
                        heapq.heappop(best)
            if len(best) == k:
                least = max(least, best[0])
        return docs, scores, opened


def _promising(index: DataFrame, block: Block) -> DataFrame:
    """(query, range): for each query the FIRST ranges of highest bound."""

    def run(batches):
        held: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for batch in batches:
            for key, term, most in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bound = block.bounds(*(np.frombuffer(x, np.int32) for x in (term, most)))
                q = np.flatnonzero(bound)
                held.append((q, np.full(len(q), key), bound[q]))
            q, key, bound = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((key, -bound, q))
            q, key, bound = q[order], key[order], bound[order]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
            near = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < FIRST
            held = [(q[near], key[near], bound[near])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], ["query", "range", "bound"])

    found = index.select("range", "term0", "most0").mapInArrow(run, "query long, range long, bound long")
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "range")
    return found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST).select("query", "range")


def _solved(index: DataFrame, block: Block, least: np.ndarray, k: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """(query, doc_id, score): of each range, what may be among the k best of a query and scores its least or more.

    only: the queries of each range; all of them otherwise."""
    names = [c.split()[0] for c in _INDEX.split(", ")][2:]

    def run(batches):
        weights = np.zeros(len(block.vocabulary) + 1, np.int64)
        for batch in batches:
            out = [pa.array([], pa.int64())], [pa.array([], pa.int64())], [pa.array([], pa.int64())]
            for row in range(len(batch)):
                raw = [batch.column(2 + c)[row].as_py() for c in range(len(names))]
                tree, ids = _Tree(raw), batch.column(1)[row].values
                bound = block.bounds(*tree.root)
                wanted = np.flatnonzero((bound >= least) & (bound > 0))
                if only is not None:
                    wanted = np.intersect1d(wanted, only[batch.column(0)[row].as_py()])
                for q in wanted.tolist():
                    span = slice(block.at[q], block.at[q + 1])
                    weights[block.term[span]] = block.weight[span]
                    docs, scores, _ = tree.search(weights, int(bound[q]), int(least[q]), k)
                    weights[block.term[span]] = 0
                    if not docs:
                        continue
                    found, scores = ids.take(pa.array(docs)), np.array(scores)
                    key = found.fill_null((1 << 63) - 1).to_numpy(zero_copy_only=False)
                    near = np.lexsort((~found.is_valid().to_numpy(zero_copy_only=False), key, -scores))[:k]
                    for column, x in zip(out, (pa.array(np.full(len(near), q)), found.take(pa.array(near)), pa.array(scores[near])), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in out], ["query", "doc_id", "score"])

    return index.select("range", "ids", *names).mapInArrow(run, "query long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item (item_id, text) the k documents (doc_id, text) of highest score above 0, ties to the smaller doc_id."""
    spark, out = docs.sparkSession, []
    for block in _blocks(items):
        postings = materialize(_postings(docs, block.vocabulary), "postings")
        n, total = postings.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        if not n:
            continue
        block.weigh(n, _holding(postings, len(block.vocabulary)))
        index = materialize(_index(postings, n, total), "index")
        only: dict[int, list[int]] = {}
        for q, key in _promising(index, block).collect():  # FIRST for each query of the block
            only.setdefault(key, []).append(q)
        least = np.ones(len(block.ids), np.int64)
        if only:
            first = _ranked(_solved(index.where(F.col("range").isin(list(only))), block, least, k, only), k)
            for q, score in first.where(F.col("rank") == k).select("query", "score").collect():
                least[q] = score
        best = _ranked(_solved(index, block, least, k), k)
        names = spark.createDataFrame(list(enumerate(block.ids)), f"query long, item_id {items.schema['item_id'].dataType.simpleString()}")
        out.append(best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score"))
    if not out:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, out)


def op12_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The digest: the 20 best documents of each item.

    Null texts and texts without terms are no documents and no items; rows of one doc_id are documents of their own; an item_id counts once, with
    its smallest text, null as well; among equal scores a null doc_id comes last; other columns are not read; empty tables give no rows."""
    return search(docs, items, K)


ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), totals AS (
  SELECT count(*) AS n, sum(len(terms)) AS l FROM d WHERE len(terms) > 0
), q AS MATERIALIZED (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(min(text), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark GROUP BY item_id) GROUP BY ALL
), tf AS MATERIALIZED (
  SELECT id, doc_id, size, term, count(*) AS tf FROM (SELECT id, doc_id, len(terms) AS size, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, n
), s AS MATERIALIZED (
  SELECT id, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // CAST(l AS BIGINT)))) AS s FROM tf JOIN w USING (term), totals
), scored AS (
  SELECT item_id, id, doc_id, CAST(sum(times * s) AS BIGINT) AS score FROM q JOIN s USING (term) GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) <= 20
"""
