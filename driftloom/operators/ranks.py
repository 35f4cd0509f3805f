"""Exact percentiles of groups that grow with the table. No task holds a group: values are ranked over range partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.sources.scratch import settled


def _same(a: str, b: str, keys: list[str]) -> Column:
    """Rows of the same keys, null keys included, for two aliased tables."""
    return reduce(lambda x, k: x & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")), keys, F.lit(True))


def ranked(df: DataFrame, keys: list[str], x: Column) -> tuple[DataFrame, DataFrame]:
    """Distinct values with their places, and the range partitions they lie in.

    The first has (keys, __p, v, __n, __cum): how often a value occurs, and how many values of the key within the partition
    are at most it. The second has (keys, __p, __n, __low, __before, __all): a row for each key in a partition, with the
    number of values in partitions before and in all. It holds at most one row more for each partition than there are keys.
    Null values are left out.
    """
    counts = df.select(*keys, x.cast("double").alias("v")).where("v is not null").groupBy(*keys, "v").agg(F.count("*").alias("__n"))
    parts = counts.repartitionByRange(*keys, "v").withColumn("__p", F.spark_partition_id())
    inner = Window.partitionBy("__p", *keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # Settled, so that all uses see the same ranges, whatever is computed again.
    rows = settled(parts.withColumn("__cum", F.sum("__n").over(inner)))
    sizes = rows.groupBy(*keys, "__p").agg(F.sum("__n").alias("__n"), F.min("v").alias("__low"))
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    return rows, sizes.withColumns({"__before": F.coalesce(before, F.lit(0)), "__all": F.sum("__n").over(key)})


def _at_ranks(rows: DataFrame, sizes: DataFrame, keys: list[str], wanted: Column, carried: list[str]) -> DataFrame:
    """(keys, __values, carried): the value at each rank (from 0) of the array ``wanted``, a column of the sizes."""
    places = sizes.withColumn("__w", wanted).where(F.exists("__w", lambda k: (k >= F.col("__before")) & (k < F.col("__before") + F.col("__n"))))
    places = places.select(*keys, "__p", "__before", "__w", *carried)
    both = rows.alias("r").join(places.alias("s"), (F.col("r.__p") == F.col("s.__p")) & _same("r", "s", keys))
    start = F.col("__before") + F.col("__cum") - F.col("__n")
    hit = both.select(*(F.col(f"r.{k}").alias(k) for k in keys), "v", *carried, F.posexplode("__w").alias("__i", "__k"), start.alias("__start"), (start + F.col("__n")).alias("__stop"))
    hit = hit.where("__k >= __start and __k < __stop")
    found = F.array_sort(F.collect_list(F.struct("__i", "v")))  # one value a wanted rank
    return hit.groupBy(*keys).agg(F.transform(found, lambda s: s["v"]).alias("__values"), *(F.first(c).alias(c) for c in carried)).where(F.size("__values") > 0)


def _position(percent: float) -> Column:
    return F.lit(percent / 100) * (F.col("__all") - 1)


def _between(values: Column, percents: list[float]) -> Column:
    """Linear percentiles from the values below and above each position, which stand in turn."""
    out = []
    for i, p in enumerate(percents):
        low, high, h = values[2 * i], values[2 * i + 1], _position(p)
        out.append(low + (h - F.floor(h)) * (high - low))
    return F.array(*out)


def percentiles(df: DataFrame, keys: list[str], x: str | Column, percents: list[float], name: str = "p") -> DataFrame:
    """``keys`` and an array of exact percentiles (linear between neighbours), also of groups that hold a large part of the table.

    Equal values are counted before anything is shuffled, values are ordered by range partitions, and counts of partitions
    give ranks. Keys without a value have no row; null keys are a key. Without keys there is one row, or none.
    """
    rows, sizes = ranked(df, keys, F.col(x) if isinstance(x, str) else x)
    wanted = F.array(*(f(_position(p)) for p in percents for f in (F.floor, F.ceil)))
    out = _at_ranks(rows, sizes, keys, wanted, ["__all"])
    return out.select(*keys, _between(F.col("__values"), percents).alias(name))


def circular_percentile(df: DataFrame, keys: list[str], x: str, percents: list[float], period: float) -> DataFrame:
    """``keys`` and an array of percentiles of a periodic value, cut open at its largest gap.

    The circle is cut in the middle of nowhere: behind the largest gap between neighbouring values (the first of equal ones).
    Values are counted from there, percentiles are linear, and the cut is added again. Null values are left out. The order
    from the cut is the sorted order, begun elsewhere, so values are sorted once, over range partitions.
    """
    rows, sizes = ranked(df, keys, F.pmod(F.col(x), F.lit(period)))
    key = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    # The value after a partition's last is the next partition's least; after the key's last comes its least, one turn on.
    seam = F.coalesce(F.lead("__low").over(key.orderBy("__p")), F.min("__low").over(key) + F.lit(period))
    places = sizes.withColumn("__seam", seam)
    both = rows.alias("r").join(places.alias("s"), (F.col("r.__p") == F.col("s.__p")) & _same("r", "s", keys))
    named = both.select(*(F.col(f"r.{k}").alias(k) for k in keys), F.col("r.__p").alias("__p"), "v", "__cum", "__before", "__all", "__seam")
    follow = F.coalesce(F.lead("v").over(Window.partitionBy("__p", *keys).orderBy("v")), F.col("__seam"))
    gaps = named.withColumns({"__gap": follow - F.col("v"), "__next": F.pmod(follow, F.lit(period)), "__from": F.pmod(F.col("__before") + F.col("__cum"), F.col("__all"))})
    cuts = gaps.groupBy(*keys).agg(F.max_by(F.struct("__next", "__from"), F.struct("__gap", -F.col("v"))).alias("__cut"))
    joined = sizes.alias("a").join(cuts.alias("b"), _same("a", "b", keys)).select("a.*", F.col("__cut.__next").alias("__next"), F.col("__cut.__from").alias("__from"))
    wanted = F.array(*(F.pmod(f(_position(p)) + F.col("__from"), F.col("__all")) for p in percents for f in (F.floor, F.ceil)))
    out = _at_ranks(rows, joined, keys, wanted, ["__all", "__next"])
    opened = F.transform("__values", lambda v: F.pmod(v - F.col("__next"), F.lit(period)))
    found = _between(opened, percents)
    return out.select(*keys, F.transform(found, lambda v: F.pmod(v + F.col("__next"), F.lit(period))).alias("percentiles"))
