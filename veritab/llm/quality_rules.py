"""Robust outliers: text statistics against minimum-covariance-determinant estimates per language and source.

Statistics are whole-text counts.  Transformed, they are vectors of five numbers.  For
each group of language and source the estimate starts from medians and quartiles and is
improved by concentration steps: the 75 % of the group nearest in Mahalanobis distance
give the next mean and covariance, until the group's determinant shrinks no more; groups that are done take no part in later steps.  Statistics are
rounded to 1/1024 and summed as whole numbers, so that estimates do not depend on the order of rows.  A step is one aggregation by (group, distance
bin) with sums of first and second powers, so no group is ever gathered in one task;
what is left for each group is a few hundred bins.  The statistics table is small, is
written once and serves all steps.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbytes as tb
from .shared import clashing, materialize

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

P = 5
#: Standard deviations are not taken as less than these, in the order of _vector().
FLOORS = [0.5, 0.15, 0.04, 0.05, 0.1]
SHARE = 0.75
#: Makes the covariance of the nearest 75 % consistent for normal data: SHARE / F_chi2(P + 2)(quantile_chi2(P)(SHARE)).
CONSISTENCY = 1.41
#: Squared distances above this are outliers: the chi-squared quantile for P = 5 at 1 - 2e-8.
CUTOFF = 45.0
#: Concentration steps at most, and the decrease of a logarithm of the determinant that asks for another.
STEPS, SHRINKS = 12, 0.01
UNIT = 1024


def count_batch(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts and n_lines of every text of a batch."""
    out: dict[str, list] = {c: [] for c in [*COUNTS, "n_lines"]}
    for first, last in tb.chunks(offsets):
        base = offsets[first]
        part, at = data[base : offsets[last]], offsets[first : last + 1] - base
        n = last - first
        start, end, doc = tb.words(part, at)
        points = np.append(0, np.cumsum((part & 0xC0) != 0x80))
        symbols = np.append(0, np.cumsum(SYMBOLS[part]))
        prefix = tb.prefix_hashes(tb.byte_values(part))
        salt = tb.mix(np.arange(n, dtype=np.uint64) + np.uint64(17))

        breaks = np.flatnonzero(part == 0x0A)
        line_start = np.union1d(at[:-1], breaks + 1)
        line_start = line_start[line_start < len(part)]
        line_doc = np.searchsorted(at, line_start, side="right") - 1
        line_end = np.minimum(np.append(breaks, len(part))[np.searchsorted(breaks, line_start)], at[line_doc + 1])
        worded = np.searchsorted(start, line_end) > np.searchsorted(start, line_start)
        line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
        lines = np.bincount(line_doc, minlength=n)
        with np.errstate(over="ignore"):
            key = tb.slice_hashes(prefix, line_start, line_end) + salt[line_doc]
        _, one = np.unique(key, return_index=True)

        word = tb.slice_hashes(prefix, start, end)
        inside = np.flatnonzero(doc[:-2] == doc[2:]) if len(doc) > 2 else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            three = tb.mix(word[inside] + word[inside + 1] * np.uint64(0xD6E8FEB86659FD93) + word[inside + 2] * np.uint64(0xA24BAED4963EE407)) + salt[doc[inside]]
        order = np.argsort(three)
        ranked = three[order]
        twice = np.zeros(len(three), bool)
        same = ranked[1:] == ranked[:-1]
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        covered = np.zeros(len(word), bool)
        for k in range(3):
            covered[inside[twice] + k] = True

        out["n_words"].append(np.bincount(doc, minlength=n))
        out["word_chars"].append(np.bincount(doc, weights=points[end] - points[start], minlength=n).astype(np.int64))
        out["n_symbols"].append(symbols[at[1:]] - symbols[at[:-1]])
        out["n_dup_lines"].append(lines - np.bincount(line_doc[one], minlength=n))
        out["n_repeat_words"].append(np.bincount(doc[covered], minlength=n))
        out["n_lines"].append(lines)
    return {c: np.concatenate(x) if x else np.zeros(0, np.int64) for c, x in out.items()}


def text_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts) of every row; null texts count as empty."""

    def run(batches):
        for batch in batches:
            counts = count_batch(*tb.buffers(batch.column(3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(counts[c]) for c in COUNTS)], ["doc_id", "lang", "source", *COUNTS])

    return docs.select("doc_id", "lang", "source", "text").mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _vector() -> list:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    every = [F.log1p("n_words"), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / words), F.col("n_repeat_words") / words]
    return [F.round(x * UNIT).cast("long") for x in every]


X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SUMS = ["n", *X, *(f"s{i}{j}" for i, j in PAIRS)]
_ESTIMATE = "g1 string, g2 string, determinant double, shrunk double, " + ", ".join(f"m{i} double" for i in range(P)) + ", " + ", ".join(f"w{i}{j} double" for i, j in PAIRS)


def _row(group: tuple, mean: np.ndarray, cov: np.ndarray, was: float = np.inf) -> pd.DataFrame:
    """An estimate; determinant is its logarithm, shrunk how much less that is than was."""
    cov = cov + np.diag(np.square(FLOORS))
    inverse = np.linalg.inv(cov)
    now = np.linalg.slogdet(cov)[1]
    row = [*group, now, was - now, *mean, *(inverse[i, j] * (1 if i == j else 2) for i, j in PAIRS)]
    return pd.DataFrame([row], columns=["g1", "g2", "determinant", "shrunk", *(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in PAIRS)])


def _start(bins: DataFrame) -> DataFrame:
    """Medians and quartiles from counts of (group, dimension, bin), bins 1/128 wide."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        mean, spread = np.zeros(P), np.zeros(P)
        for d, part in rows.groupby("dim"):
            part = part.sort_values("bin")
            to = part["n"].cumsum().to_numpy()
            low, mid, high = (part["bin"].to_numpy()[np.searchsorted(to, q * to[-1])] / 128 for q in (0.25, 0.5, 0.75))
            mean[d], spread[d] = mid, (high - low) / 1.349
        return _row(group, mean, np.diag(spread**2))

    return bins.groupBy("g1", "g2").applyInPandas(run, _ESTIMATE)


def _step(sums: DataFrame) -> DataFrame:
    """The next estimate from sums over distance bins: the nearest bins that hold SHARE of the group."""

    def run(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        part = rows[SUMS].to_numpy()[np.argsort(rows["bin"].to_numpy())]
        to = np.cumsum(part[:, 0])
        total = part[: int(np.searchsorted(to, SHARE * to[-1])) + 1].sum(axis=0)
        mean, power = total[1 : P + 1] / total[0] / UNIT, total[P + 1 :] / total[0] / UNIT**2
        cov = np.zeros((P, P))
        for (i, j), x in zip(PAIRS, power, strict=True):
            cov[i, j] = cov[j, i] = x - mean[i] * mean[j]
        return _row(group, mean, cov * CONSISTENCY, rows["determinant"].iloc[0])

    return sums.groupBy("g1", "g2").applyInPandas(run, _ESTIMATE)


def _distance():
    away = [F.col(f"x{i}") / UNIT - F.col(f"m{i}") for i in range(P)]
    return sum((away[i] * away[j] * F.col(f"w{i}{j}") for i, j in PAIRS), F.lit(0.0))


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, five counts, base_failed, distance, kept) of every row of docs.

    docs: doc_id, text, lang, source; null lang or source is the group of the empty
    name.  base_failed: under 50 words, or more than half of the words in repeated
    windows of three.  The estimates come from rows that pass; kept rows pass and have a
    squared distance of at most CUTOFF.  A group of which no row passes keeps none."""
    stats = text_counts(docs).withColumns({"g1": F.coalesce("lang", F.lit("")), "g2": F.coalesce("source", F.lit(""))})
    stats = stats.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    stats = materialize(stats.select("doc_id", "g1", "g2", *COUNTS, "base_failed"), "counts")
    vectors = stats.withColumns(dict(zip(X, _vector(), strict=True)))
    good = vectors.where("not base_failed").select("g1", "g2", *X)

    cells = good.select("g1", "g2", F.posexplode(F.array(*[F.floor(F.col(x) / (UNIT // 128)) for x in X])).alias("dim", "bin"))
    estimate = materialize(_start(cells.groupBy("g1", "g2", "dim", "bin").agg(F.count("*").alias("n"))), "estimate")
    done: list[DataFrame] = []
    for _ in range(STEPS):
        near = good.join(estimate, ["g1", "g2"]).withColumn("bin", F.floor(16 * F.log2(_distance() + 1e-3)))
        sums = near.groupBy("g1", "g2", "determinant", "bin").agg(F.count("*").alias("n"), *(F.sum(x).alias(x) for x in X), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i, j in PAIRS))
        step = materialize(_step(sums), "estimate")
        done.append(step.where(F.col("shrunk") <= SHRINKS))
        estimate = step.where(F.col("shrunk") > SHRINKS)
        if estimate.isEmpty():
            break
    estimate = reduce(DataFrame.unionByName, [*done, estimate])
    out = vectors.join(estimate, ["g1", "g2"], "left").withColumn("distance", _distance())
    return out.select("doc_id", *COUNTS, "base_failed", "distance", (~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(False))).alias("kept"))


def op3_quality_rules(docs: DataFrame) -> DataFrame:
    """The digest: counts and verdict, one row per row of documents, null doc_id and repeated rows included.

    Null texts count as empty and fail; null lang or source is the group of the empty name; extra columns,
    whatever their names, are ignored; an empty table gives no rows."""
    return judge(clashing(docs, ["doc_id", "text", "lang", "source"]))
