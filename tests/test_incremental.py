import golden
import pytest
from pyspark.sql import functions as F

from veritab.operators.incremental import Incremental
from veritab.operators.reconcile import reconcile
from veritab.plans.config import resolve


@pytest.fixture
def sides(spark):
    def table(rows):
        return spark.createDataFrame([tuple(r[c] for c in golden.COLUMNS) for r in rows], ", ".join(f"{c} string" for c in golden.COLUMNS))

    return table(golden.SOURCE), table(golden.DEST)


def config(**change):
    return resolve(golden.TEMPLATE | change, golden.MAPPING, golden.CODES, golden.AS_OF)


def same(outcome, config_, source, dest):
    whole = reconcile(config_, source, dest)
    assert sorted(map(repr, map(tuple, outcome.field_results.collect()))) == sorted(map(repr, map(tuple, whole.field_results.collect())))
    assert sorted(map(tuple, outcome.record_rollup.collect())) == sorted(map(tuple, whole.record_rollup.collect()))


def test_only_changed_buckets_are_judged(spark, tmp_path, sides):
    source, dest = sides
    kept = Incremental(spark, str(tmp_path / "kept"), 8)
    first = kept.run(config(), source, dest)
    assert len(first.judged) > 5
    same(first, config(), source, dest)
    again = kept.run(config(), source.repartition(5), dest.orderBy("LOAD"))
    assert again.judged == []
    same(again, config(), source, dest)
    moved = dest.withColumn("LOAD", F.when(F.col("TICKET") == "T04", "99").otherwise(F.col("LOAD")))
    third = Incremental(spark, str(tmp_path / "kept"), 8).run(config(), source, moved)
    assert len(third.judged) == 1
    same(third, config(), source, moved)
    same(first, config(), source, dest)  # what was opened before stays
    kept.vacuum()
    same(kept.results(), config(), source, moved)


def test_repeated_lost_and_new_rows(spark, tmp_path, sides):
    """A row more or less, a null that moves to another column, values that change places: all are changes."""
    source, dest = sides
    kept = Incremental(spark, str(tmp_path / "kept"), 64)
    kept.run(config(), source, dest)
    one = dest.where("TICKET = 'T04'")
    swapped = one.withColumns({"SEATS": F.col("FARE"), "FARE": F.col("SEATS")})
    rest = dest.where("TICKET <> 'T04'")
    nulls = [rest.unionAll(one.withColumn(c, F.lit(None).cast("string"))) for c in ("SEATS", "FARE")]
    for table in (dest.unionAll(one), rest, rest.unionAll(swapped), *nulls, dest):
        found = kept.run(config(), source, table)
        assert len(found.judged) == 1
        same(found, config(), source, table)
    found = kept.run(config(), source.where("false"), dest.where("false"))
    assert found.judged == [] and found.rows.count() == 0


def test_another_configuration_judges_everything(spark, tmp_path, sides):
    kept = Incremental(spark, str(tmp_path / "kept"), 8)
    kept.run(config(), *sides)
    changed = config(rules=golden.TEMPLATE["rules"][:3])
    found = kept.run(changed, *sides)
    assert len(found.judged) > 5
    same(found, changed, *sides)


def test_a_failed_run_leaves_the_last(spark, tmp_path, sides):
    kept = Incremental(spark, str(tmp_path / "kept"), 8)
    kept.run(config(), *sides)
    broken = sides[1].withColumn("LOAD", F.when(F.col("TICKET") == "T04", F.raise_error(F.lit("boom"))).otherwise(F.col("LOAD")))
    with pytest.raises(Exception, match="boom"):
        kept.run(config(), sides[0], broken)
    same(kept.results(), config(), *sides)
