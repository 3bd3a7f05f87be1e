"""Registered queries of the reconciliation engine, and the SQL that says the same.

Both sides of the reconciliation come from orders: the destination lacks some keys, has others
twice, and holds wrong amounts, codes and dates, all by rules on the key.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.functions import dialect as d
from veritab.functions import transforms
from veritab.functions.dialect import Value
from veritab.operators import profile, report
from veritab.operators.incremental import Incremental
from veritab.operators.reconcile import Reconciliation, reconcile
from veritab.plans.config import resolve
from veritab.sources import store, tables, tagged
from veritab.streaming.arrivals import judge_arrivals, settled

AS_OF = "2026-06-04"
TRIM = {"op": "trim"}
CODES = {"ORDER_STATUS": [{"item_code": "F"}, {"item_code": "O", "active": True}, {"item_code": "P", "active": False}]}
TEMPLATE = {
    "template_id": "orders",
    "version": "1.0.0",
    "fields": [{"field_key": k, "datatype": t, "is_key": k == "order_no"} for k, t in (("order_no", "STRING"), ("customer", "STRING"), ("status", "ENUM"), ("price", "DECIMAL"), ("twice", "DECIMAL"), ("day", "DATE"), ("priority", "STRING"))],
    "rules": [
        {"rule_id": "r_cust_eq", "type": "EQUALITY", "severity": "ERROR", "target_field_keys": ["customer"]},
        {"rule_id": "r_day_ok", "type": "DATE_VALID", "severity": "ERROR", "target_field_keys": ["day"], "params": {"format": "%Y-%m-%d", "not_future": True}},
        {"rule_id": "r_price_rng", "type": "RANGE", "severity": "WARNING", "target_field_keys": ["price"], "params": {"min": 1000, "max": 400000}},
        {"rule_id": "r_price_tol", "type": "TOLERANCE", "severity": "ERROR", "target_field_keys": ["price"], "params": {"tolerance": 0.01, "scale": 4}},
        {"rule_id": "r_prio_re", "type": "REGEX", "severity": "WARNING", "target_field_keys": ["priority"], "params": {"pattern": "[1-5]-[A-Z ]+"}},
        {"rule_id": "r_stat_lk", "type": "LOOKUP", "severity": "WARNING", "target_field_keys": ["status"], "params": {"code_list": "ORDER_STATUS"}},
        {"rule_id": "r_stat_nn", "type": "NOT_NULL", "severity": "ERROR", "target_field_keys": ["status"]},
        {"rule_id": "r_twice_cf", "rule_key": "twice", "type": "CROSS_FIELD", "severity": "WARNING", "params": {"lhs": "f_price * 2", "rhs": "f_twice", "tolerance": 1}},
    ],
}
MAPPING = {
    "key_pairs": [{"field_key": "order_no", "src_col": "okey", "dst_col": "OKEY", "src_transform": TRIM, "dst_transform": TRIM}],
    "field_bindings": [{"field_key": k, "src_col": k, "dst_col": k.upper(), "dst_transform": TRIM if k in ("customer", "day", "status") else None} for k in ("customer", "status", "price", "twice", "day", "priority")],
}


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.col("o_totalprice").cast("decimal(18,2)")
    return o.select(
        F.col("o_orderkey").alias("k"), F.col("o_orderkey").cast("string").alias("okey"), F.col("o_custkey").cast("string").alias("customer"), F.col("o_orderstatus").alias("status"),
        price.alias("amount"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.col("o_orderpriority").alias("priority"),
    )


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("okey", "customer", "status", F.col("amount").cast("string").alias("price"), (F.col("amount") * 2).cast("string").alias("twice"), "day", "priority")


def dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = _orders(spark, sf_dir), F.col("k")
    cents = F.when(k % 53 == 0, F.lit(5).cast("decimal(18,2)")).when(k % 7 == 0, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.lit(0).cast("decimal(18,2)"))
    copies = F.when(k % 89 == 0, F.array(F.lit(0), F.lit(1))).when(k % 101 == 0, F.array(F.lit(0), F.lit(10_000_000))).otherwise(F.array(F.lit(0)))
    rows = o.where(k % 97 != 0).withColumn("shift", F.explode(copies))
    number = F.when(F.col("shift") > 1, k + F.col("shift")).otherwise(k).cast("string")
    return rows.select(
        F.when(k % 11 == 0, F.concat(F.lit("  "), number, F.lit(" "))).otherwise(number).alias("OKEY"),
        F.when(k % 37 == 0, F.concat("customer", F.lit("0"))).otherwise(F.col("customer")).alias("CUSTOMER"),
        F.when(k % 43 == 0, "X").when(k % 67 == 0, "  ").when(k % 131 == 0, F.lit(None)).otherwise(F.col("status")).alias("STATUS"),
        F.when(k % 61 == 0, "ABC").otherwise((F.col("amount") + cents).cast("string")).alias("PRICE"),
        F.when(k % 41 == 0, F.lit("7")).otherwise((F.col("amount") * 2).cast("string")).alias("TWICE"),
        F.when(k % 59 == 0, "2021-13-40").when(k % 71 == 0, "2099-01-01").when(k % 17 == 0, F.concat(F.lit(" "), F.col("day"))).otherwise(F.col("day")).alias("DAY"),
        F.when(k % 47 == 0, F.lower("priority")).otherwise(F.col("priority")).alias("PRIORITY"),
    )


def run(spark: SparkSession, sf_dir: str) -> Reconciliation:
    return reconcile(resolve(TEMPLATE, MAPPING, CODES, AS_OF), source(spark, sf_dir), dest(spark, sf_dir))


_BASE = """
WITH o AS MATERIALIZED (
  SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS okey, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status,
         CAST(o_totalprice AS DECIMAL(18,2)) AS amount, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS priority
  FROM orders
), source AS (
  SELECT okey, customer, status, CAST(amount AS VARCHAR) AS price, CAST(amount * 2 AS VARCHAR) AS twice, day, priority FROM o
), copied AS (
  SELECT *, 0 AS shift FROM o WHERE k % 97 <> 0
  UNION ALL SELECT *, 1 FROM o WHERE k % 97 <> 0 AND k % 89 = 0
  UNION ALL SELECT *, 10000000 FROM o WHERE k % 97 <> 0 AND k % 89 <> 0 AND k % 101 = 0
), numbered AS (
  SELECT *, CAST(CASE WHEN shift > 1 THEN k + shift ELSE k END AS VARCHAR) AS number FROM copied
), dest AS (
  SELECT CASE WHEN k % 11 = 0 THEN '  ' || number || ' ' ELSE number END AS "OKEY",
    CASE WHEN k % 37 = 0 THEN customer || '0' ELSE customer END AS "CUSTOMER",
    CASE WHEN k % 43 = 0 THEN 'X' WHEN k % 67 = 0 THEN '  ' WHEN k % 131 = 0 THEN NULL ELSE status END AS "STATUS",
    CASE WHEN k % 61 = 0 THEN 'ABC' ELSE CAST(CAST(amount + CASE WHEN k % 53 = 0 THEN 5.00 WHEN k % 7 = 0 THEN 0.01 ELSE 0.00 END AS DECIMAL(18,2)) AS VARCHAR) END AS "PRICE",
    CASE WHEN k % 41 = 0 THEN '7' ELSE CAST(amount * 2 AS VARCHAR) END AS "TWICE",
    CASE WHEN k % 59 = 0 THEN '2021-13-40' WHEN k % 71 = 0 THEN '2099-01-01' WHEN k % 17 = 0 THEN ' ' || day ELSE day END AS "DAY",
    CASE WHEN k % 47 = 0 THEN lower(priority) ELSE priority END AS "PRIORITY"
  FROM numbered
), sk AS MATERIALIZED (
  SELECT concat_ws('|', trim(okey)) AS record_key, trim(okey) AS f_order_no, customer AS f_customer, status AS f_status, price AS f_price, twice AS f_twice, day AS f_day, priority AS f_priority FROM source
), dk AS MATERIALIZED (
  SELECT concat_ws('|', trim("OKEY")) AS record_key, trim("OKEY") AS f_order_no, trim("CUSTOMER") AS f_customer, trim("STATUS") AS f_status, "PRICE" AS f_price, "TWICE" AS f_twice, trim("DAY") AS f_day, "PRIORITY" AS f_priority FROM dest
), counts AS MATERIALIZED (
  SELECT coalesce(s.record_key, t.record_key) AS record_key, coalesce(n_s, 0) AS n_s, coalesce(n_d, 0) AS n_d
  FROM (SELECT record_key, count(*) AS n_s FROM sk GROUP BY 1) s FULL JOIN (SELECT record_key, count(*) AS n_d FROM dk GROUP BY 1) t ON s.record_key = t.record_key
), pairs AS (
  SELECT c.record_key, s.f_order_no AS s_order_no, s.f_customer AS s_customer, s.f_status AS s_status, s.f_price AS s_price, s.f_twice AS s_twice, s.f_day AS s_day, s.f_priority AS s_priority,
         t.f_order_no AS d_order_no, t.f_customer AS d_customer, t.f_status AS d_status, t.f_price AS d_price, t.f_twice AS d_twice, t.f_day AS d_day, t.f_priority AS d_priority
  FROM counts c JOIN sk s ON s.record_key = c.record_key JOIN dk t ON t.record_key = c.record_key WHERE n_s = 1 AND n_d = 1
), num AS MATERIALIZED (
  SELECT *, TRY_CAST(s_price AS DECIMAL(38,4)) AS a, TRY_CAST(d_price AS DECIMAL(38,4)) AS b, TRY_CAST(d_price AS DOUBLE) AS x, try_strptime(d_day, '%Y-%m-%d') AS ts,
         TRY_CAST(d_price AS DECIMAL(18,4)) * 2 AS l, TRY_CAST(d_twice AS DECIMAL(18,4)) AS r
  FROM pairs
), fr AS (
  SELECT record_key, 'customer' AS field_key, 'r_cust_eq' AS rule_id, 'ERROR' AS severity, s_customer AS expected, d_customer AS actual,
    CASE WHEN s_customer IS NOT DISTINCT FROM d_customer THEN 'MATCH' ELSE 'MISMATCH' END AS category, CASE WHEN s_customer IS NOT DISTINCT FROM d_customer THEN 'equal' ELSE 'not_equal' END AS verdict FROM num
  UNION ALL SELECT record_key, 'day', 'r_day_ok', 'ERROR', 'valid_date(%Y-%m-%d)', d_day,
    CASE WHEN ts IS NULL OR CAST(ts AS DATE) > DATE '2026-06-04' THEN 'MISMATCH' ELSE 'MATCH' END, CASE WHEN ts IS NULL THEN 'unparseable' WHEN CAST(ts AS DATE) > DATE '2026-06-04' THEN 'future_date' ELSE 'valid' END FROM num
  UNION ALL SELECT record_key, 'price', 'r_price_rng', 'WARNING', '[1000,400000]', d_price,
    CASE WHEN x IS NULL THEN 'EXCEPTION' WHEN x BETWEEN 1000 AND 400000 THEN 'MATCH' ELSE 'MISMATCH' END, CASE WHEN x IS NULL THEN 'uncastable' WHEN x BETWEEN 1000 AND 400000 THEN 'in_range' ELSE 'out_of_range' END FROM num
  UNION ALL SELECT record_key, 'price', 'r_price_tol', 'ERROR', s_price, d_price,
    CASE WHEN a IS NULL OR b IS NULL THEN 'EXCEPTION' WHEN abs(a - b) <= 0.01 THEN 'MATCH' ELSE 'MISMATCH' END, CASE WHEN a IS NULL OR b IS NULL THEN 'uncastable' ELSE 'diff=' || CAST(abs(a - b) AS VARCHAR) END FROM num
  UNION ALL SELECT record_key, 'priority', 'r_prio_re', 'WARNING', '[1-5]-[A-Z ]+', d_priority,
    CASE WHEN d_priority IS NOT NULL AND regexp_full_match(d_priority, '[1-5]-[A-Z ]+') THEN 'MATCH' ELSE 'MISMATCH' END, CASE WHEN d_priority IS NULL THEN 'empty' WHEN regexp_full_match(d_priority, '[1-5]-[A-Z ]+') THEN 'format_ok' ELSE 'format_bad' END FROM num
  UNION ALL SELECT record_key, 'status', 'r_stat_lk', 'WARNING', 'in:ORDER_STATUS', d_status,
    CASE WHEN d_status IN ('F', 'O') THEN 'MATCH' ELSE 'MISMATCH' END, CASE WHEN d_status IS NULL THEN 'empty' WHEN d_status IN ('F', 'O') THEN 'found' ELSE 'not_in_list' END FROM num
  UNION ALL SELECT record_key, 'status', 'r_stat_nn', 'ERROR', 'NOT_NULL', d_status,
    CASE WHEN d_status IS NULL OR trim(d_status) = '' THEN 'MISMATCH' ELSE 'MATCH' END, CASE WHEN d_status IS NULL OR trim(d_status) = '' THEN 'missing' ELSE 'present' END FROM num
  UNION ALL SELECT record_key, 'cross:twice', 'r_twice_cf', 'WARNING', CAST(r AS VARCHAR), CAST(l AS VARCHAR),
    CASE WHEN l IS NULL OR r IS NULL THEN 'EXCEPTION' WHEN abs(l - r) <= 1 THEN 'MATCH' ELSE 'MISMATCH' END, CASE WHEN l IS NULL OR r IS NULL THEN 'uncastable' ELSE 'diff=' || CAST(abs(l - r) AS VARCHAR) END FROM num
), rollup_ AS (
  SELECT counts.record_key, CASE WHEN n_d = 0 THEN 'MISSING_IN_DEST' WHEN n_s = 0 THEN 'MISSING_IN_SOURCE' WHEN n_s > 1 OR n_d > 1 THEN 'DUPLICATE'
    WHEN x IS NULL OR a IS NULL OR b IS NULL OR l IS NULL OR r IS NULL THEN 'EXCEPTION'
    WHEN s_customer IS DISTINCT FROM d_customer OR ts IS NULL OR CAST(ts AS DATE) > DATE '2026-06-04' OR abs(a - b) > 0.01 OR d_status IS NULL OR trim(d_status) = '' THEN 'MISMATCH' ELSE 'MATCH' END AS category
  FROM counts LEFT JOIN num ON num.record_key = counts.record_key
)
"""
_SUMMARY_SQL = "SELECT count(*) AS total_records, " + ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS {n}" for n, c in (("match_count", "MATCH"), ("mismatch_count", "MISMATCH"), ("missing_src", "MISSING_IN_SOURCE"), ("missing_dst", "MISSING_IN_DEST"), ("duplicate_count", "DUPLICATE"), ("exception_count", "EXCEPTION"))) + " FROM rollup_"
_ISSUES = "category IN ('MISMATCH', 'EXCEPTION')"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _base(sql: str) -> str:
    """The common tables that sql reads, directly or through others, before it."""
    parts = re.split(r"(?m)^(?:WITH |\), )(\w+) AS ", _BASE.strip().removesuffix(")"))[1:]
    tables, wanted = dict(zip(parts[::2], parts[1::2], strict=True)), sql
    for name in reversed(list(tables)):
        if re.search(rf"\b{name}\b", wanted):
            wanted += tables[name]
        else:
            del tables[name]
    return "WITH " + ", ".join(f"{name} AS {body.rstrip()}\n)" for name, body in tables.items()) + "\n" + sql


def _of_run(name: str, pick: Callable[[Reconciliation], DataFrame], sql: str) -> None:
    _add(name, lambda spark, sf_dir: pick(run(spark, sf_dir)), _base(sql))


# -- stages and results of a run
_add("stage_source", source, _base("SELECT * FROM source"))
_add("stage_dest", dest, _base("SELECT * FROM dest"))
_of_run("canonical_source", lambda r: r.source_keyed, "SELECT * FROM sk")
_of_run("canonical_dest", lambda r: r.dest_keyed, "SELECT * FROM dk")
_of_run("key_universe", lambda r: r.key_counts, "SELECT * FROM counts")
_of_run("dup_keys", lambda r: r.duplicate_keys(), "SELECT record_key, 'SOURCE' AS side, n_s AS cnt FROM counts WHERE n_s > 1 UNION ALL SELECT record_key, 'DEST', n_d FROM counts WHERE n_d > 1")
_of_run("unique_source", lambda r: r.unique_side("s"), "SELECT sk.* FROM sk JOIN counts USING (record_key) WHERE n_s = 1")
_of_run("unique_dest", lambda r: r.unique_side("d"), "SELECT dk.* FROM dk JOIN counts USING (record_key) WHERE n_d = 1")
_of_run("matched", lambda r: r.matched(), "SELECT * FROM pairs")
_of_run("matched_wide", lambda r: r.matched_wide(), "SELECT dk.* FROM dk JOIN pairs USING (record_key)")
_of_run("missing_records", lambda r: r.missing(), "SELECT record_key, CASE WHEN n_d = 0 THEN 'MISSING_IN_DEST' ELSE 'MISSING_IN_SOURCE' END AS category FROM counts WHERE n_d = 0 OR n_s = 0")
_of_run("field_results", lambda r: r.field_results, "SELECT * FROM fr")
for _rule in TEMPLATE["rules"]:
    _of_run(f"rule_{_rule['type'].lower()}", lambda r, i=_rule["rule_id"]: r.field_results.where(F.col("rule_id") == i), f"SELECT * FROM fr WHERE rule_id = '{_rule['rule_id']}'")
_of_run("record_rollup", lambda r: r.record_rollup, "SELECT * FROM rollup_")
_of_run("run_summary", lambda r: r.run_summary, _SUMMARY_SQL)
_of_run("by_field", lambda r: r.issues(), f"SELECT field_key, count(*) AS issues FROM fr WHERE {_ISSUES} GROUP BY 1")
_of_run("by_severity", lambda r: r.issues("severity"), f"SELECT severity, count(*) AS issues FROM fr WHERE {_ISSUES} AND severity <> '' GROUP BY 1")
_of_run("report_by_field", lambda r: report.by_field_sheet(r.field_results), f"SELECT field_key, count(*) FILTER (WHERE category = 'MISMATCH') AS mismatch, count(*) FILTER (WHERE category = 'EXCEPTION') AS exception, count(*) AS total FROM fr WHERE {_ISSUES} GROUP BY 1 ORDER BY total DESC, field_key")
_of_run("report_drilldown", lambda r: report.drilldown_sheet(r.field_results), 'SELECT record_key AS "Record Key", field_key AS "Field", category AS "Category", severity AS "Severity", rule_id AS "Rule", expected AS "Expected", actual AS "Actual", verdict AS "Verdict", \'—\' AS "PDF Ref" FROM fr')
_of_run("drilldown_filtered", lambda r: report.drilldown(r.field_results, "MISMATCH", "price"), "SELECT * FROM fr WHERE category = 'MISMATCH' AND field_key = 'price'")
_of_run("drilldown_page", lambda r: report.page(r.field_results, 3, 50, category="MISMATCH"), "SELECT * FROM fr WHERE category = 'MISMATCH' ORDER BY record_key, field_key, rule_id OFFSET 100 LIMIT 50")
_of_run("drilldown_total", lambda r: report.drilldown(r.field_results, "EXCEPTION").agg(F.count("*").alias("total")), "SELECT count(*) AS total FROM fr WHERE category = 'EXCEPTION'")
_of_run("nonmatch_results", lambda r: report.non_matches(r.field_results), "SELECT * FROM fr WHERE category <> 'MATCH'")
_of_run("severity_demotion", lambda r: r.judged.where("category = 'MATCH'").select("record_key", F.size(F.filter("results", lambda x: x["category"] == "MISMATCH")).cast("long").alias("warnings")).where("warnings > 0"), "SELECT record_key, count(*) AS warnings FROM fr JOIN rollup_ USING (record_key) WHERE rollup_.category = 'MATCH' AND fr.category = 'MISMATCH' GROUP BY 1")


# -- transforms
def _transform(name: str, column: str, sql_column: str, transform, sql: str) -> None:
    """name: a transform of a text column of orders; column and sql_column are that text in Spark and SQL."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.expr(column).alias("x"))
        return o.select("o_orderkey", transforms.apply(Value(F.col("x")), transform).text().alias("y"))

    _add(name, query, f"SELECT o_orderkey, CAST({sql} AS VARCHAR) AS y FROM (SELECT o_orderkey, {sql_column} AS x FROM orders)")


_MONEY = "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING)", "CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)"
_DAY = "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"
_KEY = "CAST(o_orderkey AS STRING)", "CAST(o_orderkey AS VARCHAR)"
_PRIORITY = "o_orderpriority", "o_orderpriority"
_transform("tf_trim", "concat('\t  ', o_orderpriority, '  ')", "'\t  ' || o_orderpriority || '  '", TRIM, "trim(x)")
_transform("tf_upper", "lower(o_orderpriority)", "lower(o_orderpriority)", {"op": "upper"}, "upper(x)")
_transform("tf_lower", *_PRIORITY, {"op": "lower"}, "lower(x)")
_transform("tf_round", *_MONEY, {"op": "round", "args": [1]}, "round(TRY_CAST(x AS DOUBLE), 1)")
_transform("tf_round_tens", *_MONEY, {"op": "round", "args": [-2]}, "round(TRY_CAST(x AS DOUBLE), -2)")
_transform("tf_scale", *_MONEY, {"op": "scale", "args": [100]}, "TRY_CAST(x AS DOUBLE) / 100")
_transform("tf_scale_zero", *_MONEY, {"op": "scale", "args": [0]}, "TRY_CAST(x AS DOUBLE) / 0")
_transform("tf_substr", *_PRIORITY, {"op": "substr", "args": [3, 4]}, "substr(x, 3, 4)")
_transform("tf_substr_zero", *_PRIORITY, {"op": "substr", "args": [0, 3]}, "substr(x, 0, 3)")
_transform("tf_substr_back", *_PRIORITY, {"op": "substr", "args": [-3, 2]}, "substr(x, -3, 2)")
_transform("tf_pad_left", *_KEY, {"op": "pad_left", "args": [4, "0"]}, "lpad(x, 4, '0')")
_transform("tf_replace", *_PRIORITY, {"op": "replace", "from": "I", "to": "1."}, "replace(x, 'I', '1.')")
_transform("tf_null_if", *_PRIORITY, {"op": "null_if", "args": ["1-URGENT"]}, "nullif(x, '1-URGENT')")
_transform("tf_date_format", *_DAY, {"op": "date_format", "from": "%Y-%m-%d", "to": "%d/%m/%y %b %j"}, "strftime(try_strptime(x, '%Y-%m-%d'), '%d/%m/%y %b %j')")
_transform("tf_chain", *_PRIORITY, [{"op": "lower"}, {"op": "replace", "from": "-", "to": ""}, {"op": "pad_left", "args": [12, "*"]}], "lpad(replace(lower(x), '-', ''), 12, '*')")
_add(
    "record_key",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.concat_ws("|", F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")), "o_orderpriority").alias("record_key")),
    "SELECT o_orderkey, concat_ws('|', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END, o_orderpriority) AS record_key FROM orders",
)


# -- predicates on one table
def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, money = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    text = F.when(k % 5 == 0, F.concat(F.lit(" "), money)).when(k % 7 == 0, F.concat(money, F.lit("d"))).when(k % 11 == 0, "1_000.5").when(k % 13 == 0, "").when(k % 17 == 0, "-.5e3").when(k % 19 == 0, "NaN").otherwise(money)
    return o.select("o_orderkey", d.double_text(d.to_double(text)).alias("as_double"), d.to_decimal(Value(text), 18, 1).cast("string").alias("as_decimal"))


_add(
    "safe_casts",
    _numbers,
    """SELECT o_orderkey, CAST(TRY_CAST(x AS DOUBLE) AS VARCHAR) AS as_double, CAST(TRY_CAST(x AS DECIMAL(18,1)) AS VARCHAR) AS as_decimal FROM (
  SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN ' ' || m WHEN o_orderkey % 7 = 0 THEN m || 'd' WHEN o_orderkey % 11 = 0 THEN '1_000.5' WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderkey % 17 = 0 THEN '-.5e3' WHEN o_orderkey % 19 = 0 THEN 'NaN' ELSE m END AS x
  FROM (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS m FROM orders))""",
)
_add(
    "dup_keys_lineitem",
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("cnt")).where("cnt > 1"),
    "SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
_add(
    "profile_columns",
    lambda spark, sf_dir: profile.statistics(dest(spark, sf_dir)).select("column_name", F.col("ordinal").cast("long").alias("ordinal"), "null_count", "distinct_count", F.col("min_length").cast("long").alias("min_length"), F.col("max_length").cast("long").alias("max_length")),
    _base(" UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({k} AS BIGINT) AS ordinal, count(*) - count(\"{c}\") AS null_count, count(DISTINCT \"{c}\") AS distinct_count, CAST(min(length(\"{c}\")) AS BIGINT) AS min_length, CAST(max(length(\"{c}\")) AS BIGINT) AS max_length FROM dest" for k, c in enumerate(("OKEY", "CUSTOMER", "STATUS", "PRICE", "TWICE", "DAY", "PRIORITY")))),
)
_KINDS = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, CAST({k} AS BIGINT) AS ordinal, count(t) AS filled,
  CASE WHEN count(t) = 0 THEN 'EMPTY' WHEN bool_and(coalesce(regexp_full_match(t, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') AND try_strptime(t, '%Y-%m-%d') IS NOT NULL, false)) FILTER (WHERE t IS NOT NULL) THEN 'DATE'
    WHEN bool_and(regexp_full_match(t, '[+-]?\\d+')) THEN 'INTEGER' WHEN bool_and(regexp_full_match(t, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?')) THEN 'DECIMAL' ELSE 'STRING' END AS kind FROM (SELECT nullif(trim("{c}"), '') AS t FROM both_)"""
    for k, c in enumerate(("OKEY", "CUSTOMER", "STATUS", "PRICE", "TWICE", "DAY", "PRIORITY"))
)


def column_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The kinds of the destination's columns after the source's rows, as further files of one dataset, were merged into them."""
    names = ("OKEY", "CUSTOMER", "STATUS", "PRICE", "TWICE", "DAY", "PRIORITY")
    parts = [profile.kinds(dest(spark, sf_dir)), profile.kinds(source(spark, sf_dir).toDF(*names))]
    return profile.inferred(profile.merge_kinds(*parts)).select("column_name", "ordinal", "filled", "kind")


_add("column_kinds", column_kinds, _base("SELECT * FROM dest, source WHERE false").removesuffix("SELECT * FROM dest, source WHERE false").rstrip() + ", both_ AS (SELECT * FROM dest UNION ALL SELECT * FROM source)\n" + _KINDS)
_add(
    "code_list_table",
    lambda spark, sf_dir: tables.code_table(source(spark, sf_dir), "status", inactive=("P",)),
    _base("SELECT DISTINCT status AS item_code, status <> 'P' AS active FROM source WHERE status IS NOT NULL"),
)

# -- tag-length records of customers
LAYOUT = {
    "header": {"fmt": "fixed", "total": 8, "fields": [{"field_key": "header.kind", "position": 1, "length": 4, "char": "A"}, {"field_key": "header.revision", "position": 5, "length": 4, "char": "N"}]},
    "nm": {"fmt": "tagged", "fields": [{"field_key": "nm.opening", "tag": "NM", "length": 3, "lentype": "F", "char": "A/N"}, {"field_key": "nm.name", "tag": "01", "length": 50, "lentype": "V", "char": "A"}]},
    "ac": {"fmt": "tagged", "fields": [{"field_key": "ac.opening", "tag": "AC", "length": 4, "lentype": "F", "char": "A/N"}, {"field_key": "ac.number", "tag": "01", "length": 10, "lentype": "F", "char": "N"}, {"field_key": "ac.market", "tag": "02", "length": 6, "lentype": "F", "char": "A"}]},
}


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.select("c_custkey", F.lit("N01").alias("nm.opening"), F.col("c_name").alias("nm.name"), F.lit("C001").alias("ac.opening"), F.col("c_custkey").cast("string").alias("ac.number"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("ac.market"), F.col("c_mktsegment").alias("market"))


def tagged_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged.encode_subjects(_customers(spark, sf_dir), LAYOUT).select("c_custkey", "encoded")


def tagged_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer as a file of its own, decoded again."""
    head = " " * 8
    files = tagged_encode(spark, sf_dir).select(F.col("c_custkey").cast("string").alias("path"), F.concat(F.lit(head), "encoded", F.lit(tagged.END_OF_FILE)).alias("value"))
    return tagged.decode_texts(files, LAYOUT).select(F.col("path").cast("long").alias("c_custkey"), *(d.qcol(k).alias(k.replace(".", "_")) for k in tagged.field_keys(LAYOUT)))


_add("tagged_encode", tagged_encode, """SELECT c_custkey, 'NM03N01' || '01' || lpad(CAST(length(c_name) AS VARCHAR), 2, '0') || c_name || 'AC04C001' || '0110' || lpad(CAST(c_custkey AS VARCHAR), 10, '0') || CASE WHEN c_custkey % 4 <> 0 THEN '0206' || rpad(c_mktsegment, 6, ' ') ELSE '' END || 'ES00' AS encoded FROM customer""")
_add("tagged_round_trip", tagged_round_trip, """SELECT c_custkey, 'N01' AS nm_opening, c_name AS nm_name, 'C001' AS ac_opening, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS ac_number, CASE WHEN c_custkey % 4 <> 0 THEN trim(substr(c_mktsegment, 1, 6)) END AS ac_market FROM customer""")
_add(
    "fixed_decode",
    lambda spark, sf_dir: tagged.decode_fixed(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.concat(F.lit("HEAD"), F.lpad(F.col("c_custkey").cast("string"), 4, " ")).alias("v")), F.col("v"), LAYOUT["header"]).select("c_custkey", d.qcol("header.kind").alias("tag"), d.qcol("header.revision").alias("version")),
    "SELECT c_custkey, 'HEAD' AS tag, trim(lpad(CAST(c_custkey AS VARCHAR), 4, ' ')) AS version FROM customer",
)


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k: Column = F.col("o_orderkey")
    detail = F.when(k % 3 == 0, F.lit("{}")).when(k % 3 == 1, F.concat(F.lit('{"citation": {"page": '), k.cast("string"), F.lit(', "source_text": "a line"}}'))).otherwise(F.lit('{"citation": {"source_text": "a line"}}'))
    return o.select("o_orderkey", report.citation(detail).alias("ref"))


_add("citation_text", _citations, "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '—' WHEN 1 THEN CASE WHEN o_orderkey = 0 THEN 'a line' ELSE 'p.' || o_orderkey || ': a line' END ELSE 'a line' END AS ref FROM orders")


# -- files and stores: written to the session's shared folder and read again
def _folder(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; on a single machine, where that is unset, a temporary one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{where or tempfile.mkdtemp(prefix='veritab-')}/veritab-{uuid.uuid4().hex}"


def csv_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconciliation of both sides from CSV files, whose summary says the same as that of the tables."""
    sides, folder = {"source": source, "dest": dest}, _folder(spark)
    for name, side in sides.items():
        tables.write_csv(side(spark, sf_dir), f"{folder}/{name}")
    return reconcile(resolve(TEMPLATE, MAPPING, CODES, AS_OF), *(tables.read_csv(spark, f"{folder}/{name}") for name in sides)).run_summary


def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with separators, quotes and line breaks, through a CSV file."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    odd = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit('a "b", '), "o_orderpriority", F.lit("\nc"))).otherwise(F.col("o_orderpriority"))
    path = _folder(spark)
    o.select(F.col("o_orderkey").cast("string").alias("key"), odd.alias("odd, text")).write.option("header", True).option("escape", '"').csv(path)
    return tables.read_csv(spark, path).select(F.col("key").cast("long").alias("key"), d.qcol("odd, text").alias("text"))


def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup as the Parquet sink leaves it."""
    folder = _folder(spark)
    run(spark, sf_dir).write(folder)
    return spark.read.parquet(f"{folder}/record_rollup.parquet")


def _saved(spark: SparkSession, sf_dir: str, into: store.Store, of: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> str:
    """The run of the tables, its field rows or what is wanted of them, saved in a store; returns its id."""
    done, record = run(spark, sf_dir).persist(), store.Run("t", "m", "s", "d", "1", AS_OF)
    into.create_run(record)
    into.save_results(record.run_id, of(done.field_results), done.record_rollup)
    into.mark_completed(record.run_id)
    done.unpersist()
    return record.run_id


def stored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one category from a run that was saved in a store and read from it again."""
    folder = _folder(spark)
    saved = _saved(spark, sf_dir, store.ParquetStore(spark, folder))
    return store.ParquetStore(spark, folder).rows(saved).where("category = 'EXCEPTION' and field_key is not null").select("record_key", "field_key", "rule_id", "verdict")


def stored_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a saved run, found from the index of its files."""
    kept = store.ParquetStore(spark, _folder(spark))
    return kept.page(_saved(spark, sf_dir, kept), category="MISMATCH", page=3, size=50)[1].drop("detail")


def stored_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues by field of a run whose issues were saved in a database, twice.

    spark.veritab.jdbc.url names the database; on a single machine an embedded one serves."""
    folder = _folder(spark)
    url, options = spark.conf.get("spark.veritab.jdbc.url", None), {}
    if not url:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.veritab.jdbc.url must name a database that all executors reach")
        url, options = f"jdbc:derby:{re.sub('^file:/*', '/', folder)}.db;create=true", {"properties": {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}, "sent": "CLOB"}
    kept = store.JdbcStore(spark, url, folder, **options)
    saved = _saved(spark, sf_dir, kept, report.issues)
    rows = kept.rows(saved)
    kept.save_results(saved, rows.where("field_key is not null"), rows.where("field_key is null"))
    return report.by_field(kept.rows(saved).where("field_key is not null"))


def bucketed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup over sides that were saved in buckets, which are joined where they lie."""
    planned, prefix = run(spark, sf_dir), f"sides_{uuid.uuid4().hex}"
    planned.save_sides(prefix, _folder(spark), 16)
    return planned.from_sides(prefix).record_rollup


def incremental_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of a run that took over what an earlier one, before some prices changed, had judged."""
    kept, config = Incremental(spark, _folder(spark), 64), resolve(TEMPLATE, MAPPING, CODES, AS_OF)
    now = dest(spark, sf_dir)
    before = now.withColumn("PRICE", F.when(F.trim("OKEY").isin("1", "2", "3", "7", "32"), "0").otherwise(F.col("PRICE")))
    kept.run(config, source(spark, sf_dir), before)
    return kept.run(config, source(spark, sf_dir), now).record_rollup


def arrivals_settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup of destination rows that arrived in several batches of a stream, some keys in more than one."""
    folder, config = _folder(spark), resolve(TEMPLATE, MAPPING, CODES, AS_OF)
    rows, left = dest(spark, sf_dir), source(spark, sf_dir)
    rows.repartition(4).write.parquet(f"{folder}/arrived")  # round robin: copies of a key part
    arrivals = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/arrived")
    judge_arrivals(config, left, arrivals, f"{folder}/judged", f"{folder}/stream", once=True).awaitTermination()
    return settled(spark, config, left, f"{folder}/judged").record_rollup


def tagged_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of one file that many tasks have written and many read by byte ranges."""
    path, head = f"{_folder(spark)}.tag", spark.createDataFrame([("CUST", "7")], "`header.kind` string, `header.revision` string")
    size = tagged.write_file(head, _customers(spark, sf_dir), LAYOUT, path, "c_custkey")
    found = tagged.read_subjects(spark, path, LAYOUT, min(tagged.RANGE, max(4096, size // 32)))  # several ranges even of a small file
    return found.select("subject", *(d.qcol(k).alias(k.replace(".", "_")) for k in tagged.field_keys(LAYOUT)))


def tagged_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against their tag-length records, of which some lack a market."""
    decoded = tagged_file(spark, sf_dir)
    left = _customers(spark, sf_dir).select(F.lpad(d.qcol("ac.number"), 10, "0").alias("number"), F.substring(F.trim(F.substring("market", 1, 6)), 1, 6).alias("market"))
    fields = [{"field_key": n, "src_col": n, "dst_col": f"ac_{n}"} for n in ("number", "market")]
    template = {"rules": [{"rule_id": "same", "type": "EQUALITY", "severity": "ERROR", "target_field_keys": ["market"]}]}
    return reconcile(resolve(template, {"key_pairs": fields[:1], "field_bindings": fields}), left, decoded).run_summary


_add("tagged_file", tagged_file, """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS subject, 'N01' AS nm_opening, c_name AS nm_name, 'C001' AS ac_opening, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS ac_number, CASE WHEN c_custkey % 4 <> 0 THEN trim(substr(c_mktsegment, 1, 6)) END AS ac_market FROM customer""")
_add("csv_run", csv_run, _base(_SUMMARY_SQL))
_add("csv_scan", csv_scan, "SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 = 0 THEN 'a \"b\", ' || o_orderpriority || chr(10) || 'c' ELSE o_orderpriority END AS text FROM orders")
_add("parquet_sink", parquet_sink, _base("SELECT * FROM rollup_"))
_add("bucketed_run", bucketed_run, _base("SELECT * FROM rollup_"))
_add("incremental_run", incremental_run, _base("SELECT * FROM rollup_"))
_add("arrivals_settled", arrivals_settled, _base("SELECT * FROM rollup_"))
_add("stored_page", stored_page, _base("SELECT * FROM fr WHERE category = 'MISMATCH' ORDER BY record_key, field_key, rule_id OFFSET 100 LIMIT 50"))
_add("stored_summary", stored_summary, _base(f"SELECT field_key, count(*) AS issues FROM fr WHERE {_ISSUES} GROUP BY 1"))
_add("stored_run", stored_run, _base("SELECT record_key, field_key, rule_id, verdict FROM fr WHERE category = 'EXCEPTION'"))
_add(
    "tagged_reconcile",
    tagged_reconcile,
    "SELECT count(*) AS total_records, count(*) FILTER (WHERE c_custkey % 4 <> 0) AS match_count, count(*) FILTER (WHERE c_custkey % 4 = 0) AS mismatch_count, 0::BIGINT AS missing_src, 0::BIGINT AS missing_dst, 0::BIGINT AS duplicate_count, 0::BIGINT AS exception_count FROM customer",
)
