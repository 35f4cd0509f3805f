"""Large tables joined to small ones by keys with few values: work stays spread over tasks."""

import math

import pytest
from pyspark.sql import functions as F

from driftloom.operators import dynamics as dyn
from driftloom.operators import joins as jn
from driftloom.operators import resampling as rs
from driftloom.operators.grid import Axis


@pytest.fixture
def no_guesses(spark):
    """Without broadcasts by guessed sizes, as adaptive execution takes them back where most partitions are empty."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_rows_of_a_data_set_keep_their_tasks_when_points_are_joined(spark, no_guesses):
    rows = spark.range(0, 8000, 1, 8).select(F.when(F.col("id") < 7000, "a").otherwise("b").alias("k"), (F.col("id") % 10).cast("double").alias("x"))
    points = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 4.0), ("b", 0.0), ("c", 0.0)], "k string, point double").distinct()
    out = jn.distances_to_points(rows, points, ["k"], [("x", "point")])
    assert out.count() == 15_000
    assert out.agg(F.sum("distance")).first()[0] == 700 * (37 + 25) + 100 * 45
    assert most_in_a_task(out) == 2_000


def test_tables_that_are_not_few_are_joined_as_others(spark, no_guesses):
    rows = spark.range(1000).withColumn("k", F.col("id") % 50)
    few = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a, b = jn.with_few(rows, few, ["k"]), jn.with_few(rows, few, ["k"], most=10)
    assert a.exceptAll(b).isEmpty() and a.count() == b.count() == 1000
    assert "BroadcastHashJoin" in a._jdf.queryExecution().toString() and "BroadcastHashJoin" not in b._jdf.queryExecution().toString()


def test_draws_of_one_data_set_are_made_in_many_tasks(spark, no_guesses, monkeypatch):
    largest, settled = [], rs.settled

    def seen(df):
        out = settled(df)
        if "__base" in out.columns:
            largest.append(most_in_a_task(out))
        return out

    monkeypatch.setattr(rs, "settled", seen)
    df = spark.range(400).select(F.when(F.col("id") < 399, "a").otherwise("b").alias("k"), F.col("id").alias("crop"))
    assert rs.multiplicity_arrays(df, ["k"], "crop", 8).count() == 400
    assert len(largest) == 1 and largest[0] < 200


def test_sums_are_those_of_unfolded_replicates(spark, monkeypatch):
    """Nulls, numbers that are not finite, whole numbers and groups that no replicate draws; with sums handed on at every batch."""
    monkeypatch.setattr(rs, "HELD", 1)
    nan, inf = math.nan, math.inf
    per = [("a", 1, 0, 1.5, 2), ("a", 2, 0, nan, 3), ("a", 3, 0, None, 4), ("a", 1, 1, None, None), ("a", 3, 2, inf, 9), ("b", 1, 0, -1.0, 5), ("b", 2, 3, 2.0, 6)]
    per = spark.createDataFrame(per, "k string, crop long, i int, x double, n int")
    drawn = spark.createDataFrame([("a", 1, [2, 0, 1]), ("a", 2, [0, 1, 0]), ("a", 3, [1, 2, 0]), ("b", 1, [3, 0, 1]), ("b", 2, [0, 0, 0])], "k string, crop long, times array<int>")
    out = rs.resampled_sums(per, drawn, ["k"], "crop", ["i"], ["x", "n"])
    unfolded = per.join(drawn, ["k", "crop"]).select("k", "i", "x", "n", F.posexplode("times").alias("replicate", "t")).where("t > 0")
    want = unfolded.groupBy("k", "replicate", "i").agg(F.sum(F.col("x") * F.col("t")).alias("x"), F.sum(F.col("n") * F.col("t")).alias("n"))
    assert dict(out.dtypes) == dict(want.dtypes)
    assert out.exceptAll(want).isEmpty() and want.exceptAll(out).isEmpty() and want.count() == 9


def test_replicates_are_unfolded_once_for_field_and_totals(spark):
    rows = spark.range(600).selectExpr("'a' as dataset", "0 as position", "id div 20 as crop_index", "cast(id % 20 as int) as frame_number", "(id * 7 % 11) / 11.0D as x")
    out = dyn.bootstrap_field(rows, [Axis("x", 0.0, 0.25, 4)], [("gaussian", 0.3)], 1.0, ["dataset"], "crop_index", 8)
    assert "posexplode" not in out._jdf.queryExecution().toString()
    assert out.count() == 32
