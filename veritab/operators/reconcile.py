"""Reconciliation of two tables as one lazy plan.

Both sides are normalised, given their record key and united; one aggregation by key
counts each side and keeps its values.  That is the only shuffle of the data: presence
and duplicates are counts, matched records are the groups with one row on each side,
and the rules run on them as expressions, all in one pass.  A key with very many
rows collapses before the shuffle.

    key_frame: record_key, n_s, n_d, s, d
      -> field_results: one row for each matched key and rule
      -> record_rollup: one category for each key
      -> run_summary: counts of the categories
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions import transforms
from veritab.functions.dialect import Value, exact_decimals, qcol, safe_name
from veritab.plans.config import RunConfig

from . import rules

FIELD_RESULTS = ["record_key", *rules.RESULT_FIELDS]
#: Summary counter -> category.
CATEGORIES = {
    "match_count": "MATCH",
    "mismatch_count": "MISMATCH",
    "missing_src": "MISSING_IN_SOURCE",
    "missing_dst": "MISSING_IN_DEST",
    "duplicate_count": "DUPLICATE",
    "exception_count": "EXCEPTION",
}
SUMMARY = ["total_records", *CATEGORIES]
#: Buckets of saved sides.
BUCKETS = 256
_CACHED = ("judged", "key_counts", "field_results", "record_rollup", "run_summary")
PAIRED = "n_s = 1 and n_d = 1"


def _fields(frame: DataFrame) -> Column:
    """The columns of a canonical side but its key, as one."""
    return F.struct(*[c for c in frame.columns if c != "record_key"]) if len(frame.columns) > 1 else F.struct(F.lit(1).alias("f_"))


def canonical(df: DataFrame, config: RunConfig, side: str) -> tuple[DataFrame, dict[str, str]]:
    """(record_key and f_<field> columns of one side, kind of each field).

    The key joins the transformed key columns with |; null parts vanish, so it is never null.
    Only mapped columns are read."""
    given = lambda b: transforms.apply(Value(qcol(b.column(side)).cast("string")), b.transform(side))
    values = {key: given(b) for key, b in config.fields(side).items()}
    key = F.concat_ws("|", *(given(b).text() for b in config.key_pairs))
    frame = df.select(key.alias("record_key"), *(v.col.alias(f"f_{safe_name(k)}") for k, v in values.items()))
    return frame, {k: v.kind for k, v in values.items()}


@dataclass
class Reconciliation:
    """A planned run; every table is lazy and nothing is collected unless asked for."""

    config: RunConfig
    source: DataFrame
    dest: DataFrame

    def __post_init__(self) -> None:
        if not (self.config.rules or self.config.cross_rules):
            raise ValueError("no rules to evaluate")
        with exact_decimals(self.source.sparkSession):
            self.source_keyed, self._source_kinds = canonical(self.source, self.config, "src")
            self.dest_keyed, self._dest_kinds = canonical(self.dest, self.config, "dst")
            self.key_frame = self._key_frame()

    def between(self, source_keyed: DataFrame, dest_keyed: DataFrame) -> Reconciliation:
        """The same run over some of the canonical rows of each side."""
        run = copy(self)
        run.source_keyed, run.dest_keyed = source_keyed, dest_keyed
        for name in _CACHED:
            run.__dict__.pop(name, None)
        run.key_frame = run._key_frame()
        return run

    def save_sides(self, prefix: str, folder: str, buckets: int = BUCKETS) -> None:
        """Keeps both sides as tables prefix_source and prefix_dest under a folder, one row for each key, bucketed by it.

        Rows of one key are collapsed before they are dealt out, so a key with very many rows makes no large bucket."""
        for name, frame in (("source", self.source_keyed), ("dest", self.dest_keyed)):
            once = frame.groupBy("record_key").agg(F.count("*").alias("n"), F.any_value(_fields(frame)).alias("v"))
            once.repartition(buckets, "record_key").write.mode("overwrite").option("path", f"{folder}/{name}").bucketBy(buckets, "record_key").sortBy("record_key").format("parquet").saveAsTable(f"{prefix}_{name}")

    def from_sides(self, prefix: str) -> Reconciliation:
        """The same run over saved sides: a full outer join of buckets where they lie, without a shuffle."""
        tables = (self.source.sparkSession.table(f"{prefix}_{name}") for name in ("source", "dest"))
        s, d = (t.select("record_key", F.col("n").alias(f"n_{x}"), F.col("v").alias(x)) for x, t in zip("sd", tables, strict=True))
        run = copy(self)
        for name in _CACHED:
            run.__dict__.pop(name, None)
        run.key_frame = s.join(d, "record_key", "full_outer").select("record_key", *(F.coalesce(f"n_{x}", F.lit(0)).alias(f"n_{x}") for x in "sd"), "s", "d")
        return run

    @cached_property
    def judged(self) -> DataFrame:
        """record_key, n_s, n_d, results (null unless matched) and category."""
        with exact_decimals(self.source.sparkSession):
            return self._judged()

    def _key_frame(self) -> DataFrame:
        def side(frame: DataFrame, mine: str, other: str) -> DataFrame:
            return frame.select("record_key", F.lit(1).alias(f"is_{mine}"), _fields(frame).alias(mine), F.lit(0).alias(f"is_{other}"))

        both = side(self.source_keyed, "s", "d").unionByName(side(self.dest_keyed, "d", "s"), allowMissingColumns=True)
        return both.groupBy("record_key").agg(F.sum("is_s").alias("n_s"), F.sum("is_d").alias("n_d"), F.any_value("s", True).alias("s"), F.any_value("d", True).alias("d"))

    def _values(self, side: str) -> dict[str, Value]:
        kinds = self._source_kinds if side == "s" else self._dest_kinds
        return {k: Value(F.col(f"{side}.f_{safe_name(k)}"), kind) for k, kind in kinds.items()}

    def _bound(self) -> tuple[DataFrame, list[tuple[Column, Column]]]:
        """key_frame with the values that rules need bound to columns, and each rule's (result, category)."""
        source, dest, frame, joined = self._values("s"), self._values("d"), self.key_frame, {}
        for k, rule in enumerate(rules.joined_lists(self.config)):
            codes = frame.sparkSession.createDataFrame([(c,) for c in self.config.active_codes(rule.params["code_list"])], f"code_{k} string")
            frame = frame.join(codes, dest[rule.target_field_keys[0]].text() == F.col(f"code_{k}"), "left")
            joined[rule.rule_id] = F.col(f"code_{k}").isNotNull()
        dest_by_name = {safe_name(k): v for k, v in dest.items()} | dest
        bind = rules.Binder()
        every = [rules.judge(r, self.config, source, dest, joined, bind) for r in self.config.rules]
        every += [rules.judge(r, self.config, source, dest_by_name, joined, bind) for r in self.config.cross_rules]
        for level in bind.levels:
            frame = frame.select("*", *(c.alias(name) for name, c in level.items()))
        return frame, every

    def _judged(self) -> DataFrame:
        """key_frame with results (null unless matched) and category."""
        frame, every = self._bound()
        results, categories = zip(*every, strict=True)
        severe = [c for r, c in zip([*self.config.rules, *self.config.cross_rules], categories, strict=True) if r.severity == "ERROR"]
        return frame.select("record_key", "n_s", "n_d", F.when(F.expr(PAIRED), F.array(*results)).alias("results"), self._category(categories, severe).alias("category"))

    @staticmethod
    def _category(categories: Sequence[Column], severe: Sequence[Column]) -> Column:
        """Missing before duplicate before exception before mismatch (of severity ERROR) before match."""
        some = lambda among, what: reduce(or_, (c == what for c in among), F.lit(False))
        return (
            F.when(F.col("n_d") == 0, "MISSING_IN_DEST")
            .when(F.col("n_s") == 0, "MISSING_IN_SOURCE")
            .when((F.col("n_s") > 1) | (F.col("n_d") > 1), "DUPLICATE")
            .when(some(categories, "EXCEPTION"), "EXCEPTION")
            .when(some(severe, "MISMATCH"), "MISMATCH")
            .otherwise("MATCH")
        )

    def persist(self) -> Reconciliation:
        """Keeps the judged records, from which the three results are cheap."""
        self.judged = self.judged.persist()
        for name in ("field_results", "record_rollup", "run_summary"):
            self.__dict__.pop(name, None)
        return self

    def unpersist(self) -> None:
        self.judged.unpersist()

    # -- steps, each a table of its own ------------------------------------------------

    def issues(self, by: str = "field_key") -> DataFrame:
        """(by, issues) for by field_key or severity: report.by_field or by_severity of field_results.

        Rules are counted as they are judged, one counter each, so that no result row is made; a rule without a severity has none."""
        with exact_decimals(self.source.sparkSession):
            frame, every = self._bound()
            counts = [F.count_if(F.expr(PAIRED) & c.isin("MISMATCH", "EXCEPTION")).alias(f"n{k}") for k, (_, c) in enumerate(every)]
            named = [rules.field_of(r) if by == "field_key" else r.severity for r in (*self.config.rules, *self.config.cross_rules)]
            pairs = F.array(*[F.struct(F.lit(name).alias(by), F.col(f"n{k}").alias("n")) for k, name in enumerate(named) if name] or [F.struct(F.lit("").alias(by), F.lit(0).alias("n"))])
            return frame.agg(*counts).select(F.inline(pairs)).where("n > 0").groupBy(by).agg(F.sum("n").alias("issues"))

    @cached_property
    def key_counts(self) -> DataFrame:
        """record_key with the row counts of both sides."""
        return self.key_frame.select("record_key", "n_s", "n_d")

    def duplicate_keys(self) -> DataFrame:
        """(record_key, side, cnt) of keys with several rows on a side."""
        sides = F.array(F.struct(F.lit("SOURCE").alias("side"), F.col("n_s").alias("cnt")), F.struct(F.lit("DEST").alias("side"), F.col("n_d").alias("cnt")))
        return self.key_counts.select("record_key", F.inline(sides)).where("cnt > 1")

    def unique_side(self, side: str) -> DataFrame:
        """The canonical rows of a side (s or d) whose key is not repeated there."""
        return self.key_frame.where(F.col(f"n_{side}") == 1).select("record_key", f"{side}.*")

    def matched(self) -> DataFrame:
        """record_key with s_<field> and d_<field> of the keys that stand once on each side."""
        both = self.key_frame.where(PAIRED)
        named = [F.col(f"{x}.f_{safe_name(k)}").alias(f"{x}_{safe_name(k)}") for x, kinds in (("s", self._source_kinds), ("d", self._dest_kinds)) for k in kinds]
        return both.select("record_key", *named)

    def matched_wide(self) -> DataFrame:
        """record_key with the destination's values as f_<field>, which cross-field rules see."""
        return self.key_frame.where(PAIRED).select("record_key", "d.*")

    def missing(self) -> DataFrame:
        """(record_key, category) of keys that one side lacks altogether."""
        side = F.when(F.col("n_d") == 0, "MISSING_IN_DEST").otherwise("MISSING_IN_SOURCE").alias("category")
        return self.key_counts.where("n_d = 0 or n_s = 0").select("record_key", side)

    # -- results ------------------------------------------------------------------------

    @cached_property
    def field_results(self) -> DataFrame:
        return self.judged.where(PAIRED).select("record_key", F.inline("results"))

    @cached_property
    def record_rollup(self) -> DataFrame:
        return self.judged.select("record_key", "category")

    @cached_property
    def run_summary(self) -> DataFrame:
        return summarise(self.record_rollup)

    def write(self, path: str) -> None:
        """field_results and record_rollup as Parquet folders under path."""
        for name in ("field_results", "record_rollup"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}.parquet")

    def collect(self) -> dict:
        """Everything as Python values in a fixed order; for small runs."""
        order = ["record_key", "field_key", "rule_id"]
        return {
            "rule_engine_version": self.config.engine_version,
            "as_of_date": self.config.as_of_date,
            "summary": self.run_summary.first().asDict(),
            "record_rollup": [tuple(r) for r in self.record_rollup.orderBy("record_key").collect()],
            "field_results": [r.asDict() for r in self.field_results.orderBy(*order).collect()],
        }


def summarise(rollup: DataFrame) -> DataFrame:
    """One row of counters over (record_key, category)."""
    return rollup.agg(F.count("*").alias("total_records"), *(F.count_if(F.col("category") == c).alias(n) for n, c in CATEGORIES.items()))


def reconcile(config: RunConfig, source: DataFrame, dest: DataFrame) -> Reconciliation:
    return Reconciliation(config, source, dest)
