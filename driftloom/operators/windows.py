"""Ordered analytics within a trajectory. All operators of a key share one window, so one sort serves many columns."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.angles import unwrapped_step, wrapped_difference
from driftloom.operators.blocks import BLOCK, over_blocks
from driftloom.sources.scratch import settled

TRACK = ["dataset", "position", "crop_index"]
TIME = "frame_number"


def ordered(keys: list[str] = TRACK):
    return Window.partitionBy(*keys).orderBy(TIME)


def whole(keys: list[str] = TRACK):
    return Window.partitionBy(*keys)


def with_track_duration(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """Last frame minus first frame."""
    return df.withColumn("track_duration", F.max(TIME).over(whole(keys)) - F.min(TIME).over(whole(keys)))


def difference(x: str | Column, keys: list[str] = TRACK) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return x - F.lag(x).over(ordered(keys))


def rate(x: str | Column, keys: list[str] = TRACK) -> Column:
    """Change since the row before over the frames since then."""
    return difference(x, keys) / difference(TIME, keys)


def forward_differences(df: DataFrame, columns: list[str], lag: int = 1, periods: dict[str, float] | None = None, keys: list[str] = TRACK) -> DataFrame:
    """Rows that have a partner ``lag`` rows on and exactly ``lag`` frames later, with d_<column>; periodic columns take the short way."""
    w, periods = ordered(keys), periods or {}
    rows = df.withColumn("__gap", F.lead(TIME, lag).over(w) - F.col(TIME))
    for c in columns:
        d = F.lead(c, lag).over(w) - F.col(c)
        if c in periods:
            step = unwrapped_step(F.lead(c, 1).over(w) - F.col(c), periods[c])
            if lag == 1:
                d = step
            else:
                rows = rows.withColumn("__s_" + c, step)
                d = F.sum("__s_" + c).over(w.rowsBetween(0, lag - 1))
        rows = rows.withColumn("d_" + c, d)
    return rows.where(F.col("__gap") == lag).drop("__gap", *("__s_" + c for c in periods))


def unwrapped(x: str, period: float, keys: list[str] = TRACK) -> Column:
    """A periodic column without jumps: the first value plus all short steps since. Needs the row-to-row step as a column."""
    w = ordered(keys)
    return F.first(x).over(w) + F.coalesce(F.sum("__step").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))


def with_unwrapped(df: DataFrame, x: str, period: float, name: str, keys: list[str] = TRACK) -> DataFrame:
    step = F.coalesce(unwrapped_step(difference(x, keys), period), F.lit(0.0))
    return df.withColumn("__step", step).withColumn(name, unwrapped(x, period, keys)).drop("__step")


def unwrapped_to(x: Column, reference: Column, period: float) -> Column:
    """The copy of a value within half a period of a reference."""
    return reference + wrapped_difference(x - reference, period)


def _decayed(y: Column, v: Column, nulls: Column, alpha: float) -> Column:
    """The average after a value that follows ``nulls`` rows without one."""
    w = F.pow(F.lit(1 - alpha), nulls + 1)
    return (w * y + alpha * v) / (w + alpha)


def ema(df: DataFrame, x: str, alpha: float, keys: list[str], order: list[str], name: str = "ema") -> DataFrame:
    """Exponential moving average without adjustment. A null keeps the last value, and the gap lets its weight decay.

    Keys of any length: rows lie in range partitions by key and order, each of which is averaged in one pass from nothing.
    A key that goes on in the next partition hands on its average and the nulls since its last value. What is handed on is
    linear in a segment's first average, so a prefix over partitions settles it, and each row is moved by it. Rows that tie
    in key and order go by value, nulls first. NaN is a value.
    """
    rows = df.select(*keys, *order, F.col(x).cast("double").alias("__x"))
    parts = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order, "__x")
    # One string tells keys apart, nulls included.
    parts = parts.withColumns({"__p": F.spark_partition_id(), "__key": F.to_json(F.struct(*keys))})
    shape = T.StructType([*parts.drop("__key").schema, *(T.StructField(n, T.DoubleType()) for n in ("__y", "__slope", "__first")), *(T.StructField(n, T.LongType()) for n in ("__lead", "__nulls"))])

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """y from nothing, its slope in the segment's first average, the first value, nulls before it, and nulls since the last."""
        key = y = slope = first = None
        lead = nulls = 0
        for batch in batches:
            out = []
            for k, v in zip(batch.column("__key").to_pylist(), batch.column("__x").to_pylist(), strict=True):
                if k != key:
                    key, y, slope, first, lead, nulls = k, None, None, None, 0, 0
                if v is None:
                    nulls += 1
                    lead += first is None
                elif first is None:
                    y, slope, first, nulls = v, 1.0, v, 0
                else:
                    w = (1 - alpha) ** (nulls + 1)
                    y, slope, nulls = (w * y + alpha * v) / (w + alpha), slope * w / (w + alpha), 0
                out.append((y, slope, first, lead, nulls))
            added = list(zip(*out, strict=True)) or [()] * 5
            kept = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "__key"]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(added, [pa.float64()] * 3 + [pa.int64()] * 2, strict=True))], shape.names)

    # Settled, so that both uses below see the same partitions.
    local = settled(parts.mapInArrow(averaged, shape).withColumn("__i", F.monotonically_increasing_id()))
    ends = local.groupBy(*keys, "__p").agg(F.max_by(F.struct("__y", "__slope", "__first", "__lead", "__nulls"), "__i").alias("e"))
    # A key in several partitions has one segment in each; only partitions' first keys can go on, so this is no longer than their number.
    chains = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__p", "e"))).alias("s")).where(F.size("s") > 1)
    zero = F.struct(F.lit(None).cast("double").alias("y"), F.lit(0).cast("long").alias("nulls"), F.array().cast("array<struct<y:double,nulls:bigint>>").alias("out"))

    def handed(acc: Column, seg: Column) -> Column:
        e = seg["e"]
        moved = e["__y"] + e["__slope"] * (_decayed(acc["y"], e["__first"], acc["nulls"] + e["__lead"], alpha) - e["__first"])
        y = F.when(e["__first"].isNull(), acc["y"]).when(acc["y"].isNull(), e["__y"]).otherwise(moved)
        nulls = F.when(e["__first"].isNull(), acc["nulls"] + e["__nulls"]).otherwise(e["__nulls"])
        return F.struct(y.alias("y"), nulls.alias("nulls"), F.concat(acc["out"], F.array(F.struct(acc["y"].alias("y"), acc["nulls"].alias("nulls")))).alias("out"))

    before = F.aggregate("s", zero, handed, lambda acc: acc["out"])
    carried = chains.select(*keys, F.explode(F.arrays_zip(F.col("s"), before.alias("b"))).alias("c")).select(*(F.col(k).alias("__k_" + k) for k in keys), F.col("c.s.__p").alias("__q"), F.col("c.b.y").alias("__in"), F.col("c.b.nulls").alias("__gap"))
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col("__k_" + k)), keys, F.col("__p") == F.col("__q"))
    both = local.join(carried.where("__in is not null"), same, "left")
    moved = F.col("__y") + F.col("__slope") * (_decayed(F.col("__in"), F.col("__first"), F.col("__gap") + F.col("__lead"), alpha) - F.col("__first"))
    y = F.when(F.col("__in").isNull(), F.col("__y")).when(F.col("__y").isNull(), F.col("__in")).otherwise(moved)
    return both.select(*keys, *order, y.alias(name))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(raw) for x in raw]


def gaussian_smoothed(df: DataFrame, x: str, sigma: float, keys: list[str], order: list[str], name: str = "smoothed", block: int = BLOCK) -> DataFrame:
    """Gaussian smoothing with mirrored edges (the edge value repeats), over rows in order; null where a value in reach is null.

    Keys may have any length; they are worked on in blocks.
    """
    weights = np.array(gaussian_weights(sigma))
    radius = len(weights) // 2

    def smooth(values: np.ndarray, start: int, n: int) -> np.ndarray:
        at = (start + np.arange(len(values)))[:, None] + np.arange(-radius, radius + 1)
        at %= 2 * n
        at = np.minimum(at, 2 * n - 1 - at) - start
        # Rows of the halo lack neighbours; they are no results.
        return values[np.clip(at, 0, len(values) - 1)] @ weights

    return over_blocks(df, x, keys, order, radius, smooth, name, block=max(block, radius))


def rolling_median(df: DataFrame, x: str, size: int, keys: list[str], order: list[str], name: str = "rolling_median", place: str | None = None, block: int = BLOCK) -> DataFrame:
    """Median over [-size/2, size/2 - 1] rows; rows without a whole window take the nearest whole window's median.

    Shorter keys than the window have one median for all rows. Nulls are left out. Keys may have any length: they are worked on in
    blocks, and inside a block the window moves over an ordered structure. ``place`` names a column for a row's place in its key.
    """
    half = size // 2
    width = 2 * half

    def median(values: np.ndarray, start: int, n: int) -> np.ndarray:
        if n < size:
            return np.full(len(values), pd.Series(values).median())
        ending = pd.Series(values).rolling(width, min_periods=1).median().to_numpy()
        middle = np.clip(start + np.arange(len(values)), half, n - half)
        # The window of a row ends half - 1 rows behind it.
        return ending[np.clip(middle + half - 1 - start, 0, len(values) - 1)]

    return over_blocks(df, x, keys, order, size, median, name, place, max(block, size))


def local_extrema(df: DataFrame, x: str, keys: list[str], order: list[str], name: str = "extremum") -> DataFrame:
    """'max' or 'min' at strict local extrema, else null. A plateau counts at its middle row; ends do not count."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__new", F.coalesce((F.col(x) != F.lag(x).over(w)).cast("int"), F.lit(1)))
    rows = rows.withColumns({"__run": F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)), "__rn": F.row_number().over(w)})
    runs = rows.groupBy(*keys, "__run").agg(F.first(x).alias("__v"), F.min("__rn").alias("__a"), F.max("__rn").alias("__b"))
    by_run = Window.partitionBy(*keys).orderBy("__run")
    before, after = F.lag("__v").over(by_run), F.lead("__v").over(by_run)
    kind = F.when((F.col("__v") > before) & (F.col("__v") > after), "max").when((F.col("__v") < before) & (F.col("__v") < after), "min")
    marks = runs.select(*keys, F.floor((F.col("__a") + F.col("__b")) / 2).cast("int").alias("__rn"), kind.alias(name)).where(F.col(name).isNotNull())
    return rows.drop("__new", "__run").join(marks, [*keys, "__rn"], "left").drop("__rn")


def first_passage(df: DataFrame, distance: str, threshold: float, keys: list[str] = TRACK) -> DataFrame:
    """first_passage: the first frame within the threshold (null if never), and time_to_passage: frames until then."""
    first = F.min(F.when(F.col(distance) <= threshold, F.col(TIME))).over(whole(keys))
    return df.withColumn("first_passage", first).withColumn("time_to_passage", F.col("first_passage") - F.col(TIME))


def passages(df: DataFrame, distance: str, thresholds: list[float], keys: list[str] = TRACK) -> DataFrame:
    """A row for each row and threshold (j) that its key ever reaches, with first_passage and time_to_passage, as in ``first_passage``."""
    firsts = F.array(*(F.min(F.when(F.col(distance) <= t, F.col(TIME))).over(whole(keys)) for t in thresholds))
    rows = df.withColumn("__f", firsts).select("*", F.posexplode("__f").alias("j", "first_passage")).drop("__f")
    return rows.where("first_passage is not null").withColumn("time_to_passage", F.col("first_passage") - F.col(TIME))


def normalized_time(keys: list[str] = TRACK) -> Column:
    low, high = F.min(TIME).over(whole(keys)), F.max(TIME).over(whole(keys))
    return F.when(high == low, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(TIME) - low) / (high - low))))


def with_dense_index(df: DataFrame, keys: list[str], name: str = "crop_index") -> DataFrame:
    """Index from 0 of the distinct keys in sorted order.

    Distinct keys are sorted by range partitions; a partition's rows are numbered within it and moved by the sum of the counts before.
    """
    distinct = df.select(*keys).distinct()
    parts = distinct.repartitionByRange(*keys).withColumn("__p", F.spark_partition_id())
    # Settled, so that both uses below see the same ranges, whatever is computed again.
    inner = settled(parts.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*keys))))
    sizes = inner.groupBy("__p").agg(F.max("__i").alias("__n"), F.min(F.struct(*keys)).alias("__first"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    index = inner.join(before.select("__p", "__before"), "__p").select(*keys, (F.col("__before") + F.col("__i") - 1).cast("long").alias(name))
    return df.join(index, keys)


def arc_length(columns: list[str], keys: list[str], order: list[str]) -> Column:
    """Length of the step from the row before; its running sum is the arc length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return F.coalesce(F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in columns), F.lit(0.0))), F.lit(0.0))


def resampled(df: DataFrame, columns: list[str], n: int, keys: list[str], order: list[str]) -> DataFrame:
    """n points at equal arc lengths along each path, by linear interpolation."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("__d", arc_length(columns, keys, order)).withColumn("s", F.sum("__d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumns({"__to": F.lead("s").over(w), "__all": F.max("s").over(Window.partitionBy(*keys)), **{"__n_" + c: F.lead(c).over(w) for c in columns}})
    step = F.col("__all") / (n - 1)
    # The points of a segment are computed from its ends, so no join is needed; the path's last point belongs to its last segment.
    low = F.ceil(F.col("s") / step - 1e-9)
    high = F.when(F.col("__to") >= F.col("__all"), F.lit(n - 1)).otherwise(F.ceil(F.col("__to") / step - 1e-9) - 1)
    inside = rows.where("__to > s").withColumn("i", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))))
    part = (F.col("i") * step - F.col("s")) / (F.col("__to") - F.col("s"))
    return inside.select(*keys, "i", *((F.col(c) + part * (F.col("__n_" + c) - F.col(c))).alias(c) for c in columns))


def fill_frames(df: DataFrame, keys: list[str] = TRACK) -> DataFrame:
    """All frames between the table's first and last for every key; rows that were not there hold null."""
    bounds = df.agg(F.min(TIME).alias("__a"), F.max(TIME).alias("__b"))
    every = df.select(*keys).distinct().crossJoin(F.broadcast(bounds)).select(*keys, F.explode(F.sequence("__a", "__b")).alias(TIME))
    return every.join(df, [*keys, TIME], "left")
