"""Mixing sources to target weights.

One pass counts the words of each document, one aggregation those of each source.  Sources are
numbered by code point in range-sorted parts, so that no task sees them all, and take their weights in
turn.  Targets fill up like water: a source that its weight would carry over its ceiling stops there and the
others share what it leaves; each round is one small aggregation whose sums alone reach the driver.

A source's rate is target / size.  Each document is emitted floor(rate) times, and once more if a number
in [0, 1) drawn by a hash of its id and a seed falls below the rate's fraction.  Several seeds are tried in the
same aggregation and each source takes the one that comes nearest its target; every seed's draws are independent
of each other, so a long document weighs less on the result than with a single draw.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import attach, clashing, materialize, parallelism

WEIGHTS = (5, 2, 1)
#: No source is repeated more often than this.
MOST = 3
#: Seeds tried for each source; four draws come from one hash.
SEEDS = 32
_HASHES = SEEDS // 4
WORD = r"[^\x20\x09-\x0D]+"


def _key(docs: DataFrame) -> DataFrame:
    """docs with the text that its draws are hashed from: its id, or without one its text's hash."""
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "mix_key"], F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))).alias("mix_key"))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, mix_key): the words of each document; null text has none."""
    rows = _key(clashing(docs, ["doc_id", "source", "text"]))
    return rows.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), "mix_key")


def _draw(seed: int) -> Column:
    """A whole number below 2**32 for a row with mix_key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed // 4}:"), "mix_key").cast("binary")), 1 + 8 * (seed % 4), 8), 16, 10).cast("long")


def _numbered(sizes: DataFrame) -> DataFrame:
    """sizes with number, the place of each source by code point, null last."""
    order = [F.col("source").isNull(), F.col("source")]
    parts = materialize(sizes.repartitionByRange(parallelism(sizes.sparkSession), *order).withColumn("part", F.spark_partition_id()), "sources")
    before, first = 0, {}
    for part, n in sorted(tuple(r) for r in parts.groupBy("part").count().collect()):  # one row for each part
        first[part], before = before, before + n
    if not first:
        return parts.withColumn("number", F.lit(0).cast("long"))
    at = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    return parts.withColumn("number", at[F.col("part")] + F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) of a table (source, source_size): all sizes shared by weight, none above most times its own."""
    turn = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    rows = materialize(_numbered(sizes).select("source", "source_size", turn.alias("weight"), (F.col("source_size") * most).alias("ceiling")), "weights")
    total, weight = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    left, open_weight, stopped = total, weight, 0
    while True:
        full = F.lit(left).cast("decimal(20,0)") * F.col("weight").cast("decimal(4,0)") > F.col("ceiling").cast("decimal(20,0)") * F.lit(open_weight).cast("decimal(18,0)")
        n, filled, gone = rows.where(full).agg(F.count("*"), F.coalesce(F.sum("ceiling"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == stopped:
            break
        left, open_weight, stopped = total - filled, weight - gone, n
    share = (F.lit(left).cast("long") * F.col("weight")).cast("double") / F.lit(float(open_weight or 1))
    return rows.select("source", "source_size", F.when(full, F.col("ceiling").cast("double")).otherwise(share).alias("target"))


def rates(measures: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, whole, fraction, seed): how often each source's documents are emitted, and its seed.

    measures: see measured.  A source without words has rate 0."""
    sizes = measures.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    found = targets(sizes, weights, most).withColumn("rate", rate)
    found = found.select("source", "source_size", "target", F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("fraction"))
    found = materialize(found, "rates")
    hashes = [F.md5(F.concat(F.lit(f"{k}:"), "mix_key").cast("binary")).alias(f"h{k}") for k in range(_HASHES)]
    rows = attach(measures, found, "source").select("source", "size", "fraction", *hashes)
    draw = lambda s: F.conv(F.substring(f"h{s // 4}", 1 + 8 * (s % 4), 8), 16, 10).cast("long")
    extra = [F.sum(F.when(draw(s) < F.col("fraction") * float(1 << 32), F.col("size")).otherwise(0)).alias(f"t{s}") for s in range(SEEDS)]
    taken = rows.groupBy("source").agg(*extra)
    gap = lambda s: F.abs((F.col("whole") * F.col("source_size") + F.col(f"t{s}")).cast("double") - F.col("target"))
    nearest = F.array_min(F.array(*[F.struct(gap(s).alias("gap"), F.lit(s).alias("seed")) for s in range(SEEDS)]))["seed"]
    best = taken.withColumnRenamed("source", "source_").join(found, F.col("source_").eqNullSafe(F.col("source")))
    return materialize(best.select("source", "source_size", "target", "whole", "fraction", nearest.alias("seed")), "seeds")


def copies(rows: DataFrame, found: DataFrame) -> DataFrame:
    """rows (with source and mix_key) with the columns of rates and copies, how often the mix holds each."""
    rows = attach(rows, found, "source")
    drawn = reduce(lambda rest, s: F.when(F.col("seed") == s, _draw(s)).otherwise(rest), range(SEEDS), F.lit(None).cast("long"))
    return rows.withColumn("copies", F.col("whole") + F.when(drawn < F.col("fraction") * float(1 << 32), 1).otherwise(0))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix: the rows of docs (doc_id, text, source and any others), each as often as the mix takes it.

    Repeated rows of one id share their draw; reruns give the same rows.  An empty table gives an empty mix."""
    found = rates(materialize(measured(docs), "sizes"), weights, most)
    rows = copies(_key(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", "mix_key"), found.select("source", "whole", "fraction", "seed"))
    return rows.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op11_source_mix(docs: DataFrame) -> DataFrame:
    """The digest: one row for each row of docs with its size, its source's size and target, and the words that the mix takes of it.

    Null texts and texts without words have size 0 and are in the mix as often as their source's rate says; null is a source of its own, the last
    one; a source without words has target 0; null ids draw by their text; repeated rows are documents of their own with one
    draw; other columns are not read; an empty table gives no rows."""
    rows = materialize(measured(docs), "sizes")
    return copies(rows, rates(rows)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _oracle() -> str:
    draw = lambda s: f"CAST('0x' || substr(md5('{s // 4}:' || mix_key), {1 + 8 * (s % 4)}, 8) AS BIGINT)"
    draws = "[" + ", ".join(draw(s) for s in range(SEEDS)) + "]"
    return f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size, coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS mix_key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS ceiling, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS i FROM s
), p AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(ceiling) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, sum(w) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM r
), level AS (
  SELECT i, rest, weights FROM p WHERE w * rest <= ceiling * weights ORDER BY i LIMIT 1
), t AS (
  SELECT source, source_size, CASE WHEN r.i < level.i THEN CAST(ceiling AS DOUBLE) ELSE CAST(CAST(rest * w AS BIGINT) AS DOUBLE) / CAST(weights AS DOUBLE) END AS target FROM r, level
), q AS (
  SELECT *, floor(rate) AS whole, rate - floor(rate) AS fraction FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
), drawn AS MATERIALIZED (
  SELECT d.doc_id, d.source, d.size, {draws} AS u FROM d
), tried AS (
  SELECT source, k, CAST(sum(CASE WHEN u[k + 1] < fraction * 4294967296.0 THEN size ELSE 0 END) AS BIGINT) AS extra FROM drawn JOIN q USING (source), range({SEEDS}) g(k) GROUP BY ALL
  UNION ALL SELECT drawn.source, k, CAST(sum(CASE WHEN u[k + 1] < fraction * 4294967296.0 THEN size ELSE 0 END) AS BIGINT) FROM drawn, q, range({SEEDS}) g(k) WHERE drawn.source IS NULL AND q.source IS NULL GROUP BY ALL
), best AS (
  SELECT q.source, q.source_size, q.target, q.whole, q.fraction, k FROM tried JOIN q ON tried.source IS NOT DISTINCT FROM q.source
  QUALIFY row_number() OVER (PARTITION BY q.source ORDER BY abs(CAST(CAST(whole AS BIGINT) * source_size + extra AS DOUBLE) - target), k) = 1
), n AS (
  SELECT doc_id, size, source_size, target, CAST(whole AS BIGINT) + CASE WHEN u[k + 1] < fraction * 4294967296.0 THEN 1 ELSE 0 END AS copies FROM drawn JOIN best ON drawn.source IS NOT DISTINCT FROM best.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * copies AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies FROM n
"""


ORACLE = _oracle()
