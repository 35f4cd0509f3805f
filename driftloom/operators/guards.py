"""Checks of tables: of schemas at plan time, of rows as report tables or as errors raised by the job itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table, or ValueError for columns that it lacks."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def column_report(df: DataFrame, expected: list[str], may_miss: list[str] = ()) -> dict[str, list[str]]:
    """Columns beyond those expected, and expected ones that are missing and may not be."""
    return {"extra": sorted(set(df.columns) - set(expected)), "missing": sorted(set(expected) - set(df.columns) - set(may_miss))}


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """``(n_values, value)``: number of distinct values and the smallest; one value is what single-valued tables have."""
    low, high = F.min(column), F.max(column)
    n = F.when(low.isNull(), 0).when(low == high, 1).otherwise(F.approx_count_distinct(column))
    return df.agg(F.greatest(n, F.when(low < high, 2).otherwise(0)).alias("n_values"), low.alias("value"))


def only_value(df: DataFrame, column: str):
    """The one value of a column; ValueError for none or several."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    if low is None or low != high:
        raise ValueError(f"{column} does not hold exactly one value")
    return low


def with_known(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key is unknown to ``known``."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, and how many."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table; the job fails where two rows share the keys. Reuses the exchange that a following join on the keys needs."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(*keys))
    ok = F.assert_true(n == 1, F.lit(f"rows share {', '.join(keys)}"))
    return df.withColumn("__unique", ok).where("__unique is null").drop("__unique")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that stand in the way of a one-to-one join, by side."""
    a = duplicate_keys(left, keys).withColumn("side", F.lit("left"))
    return a.unionByName(duplicate_keys(right, keys).withColumn("side", F.lit("right")))


def set_differences(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys on one side only: ``extra`` in found, ``missing`` from it."""
    found, expected = found.select(*keys).distinct(), expected.select(*keys).distinct()
    extra = found.join(expected, keys, "left_anti").withColumn("kind", F.lit("extra"))
    return extra.unionByName(expected.join(found, keys, "left_anti").withColumn("kind", F.lit("missing")))


def row_counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_in, n_out, same): rows by key in two tables, 0 where a key is in one only. Null keys are a key."""
    both = before.select(*keys, F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(after.select(*keys, F.lit(0).alias("a"), F.lit(1).alias("b")))
    out = both.groupBy(*keys).agg(F.sum("a").alias("n_in"), F.sum("b").alias("n_out"))
    return out.withColumn("same", F.col("n_in") == F.col("n_out"))


def allclose(a: Column, b: Column, relative: float = 1e-5, absolute: float = 1e-8) -> Column:
    """Whether two arrays have the same size and nearly the same numbers."""
    near = F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda ok: ok)
    return (F.size(a) == F.size(b)) & near
