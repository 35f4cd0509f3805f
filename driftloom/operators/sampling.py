"""Samples of keys that do not depend on how rows are laid out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.windows import with_dense_index


def every_nth_key(df: DataFrame, keys: list[str], n: int, least: int = 10) -> DataFrame:
    """Rows of every nth of the sorted distinct keys, if that leaves more than ``least`` keys; else all rows."""
    distinct = with_dense_index(df.select(*keys).distinct(), keys, "__i")
    whole = distinct.agg((F.count("*") > n * least).alias("__many"))  # one row
    kept = distinct.crossJoin(F.broadcast(whole)).where(~F.col("__many") | (F.col("__i") % n == 0))
    return df.join(kept.select(*keys), keys, "left_semi")


def split_rows(df: DataFrame, keys: list[str], percent: int = 20, seed: int = 42) -> DataFrame:
    """A column ``split``: 'validation' for about ``percent`` of the keys by a hash, else 'train'. Stable across partitions and reruns."""
    text = F.concat_ws(":", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    at = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % 100
    return df.withColumn("split", F.when(at < percent, "validation").otherwise("train"))
