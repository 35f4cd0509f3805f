"""Aggregates over groups. Each is a column for ``groupBy().agg()`` or a table of grouped rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.angles import PI
from driftloom.operators.ranks import percentiles


def r_squared(y: Column, fit: Column) -> Column:
    """1 - SSE / SST; null where y is constant."""
    sse = F.sum((y - fit) * (y - fit))
    sst = F.var_pop(y) * F.count(y)
    return 1 - sse / F.nullif(sst, F.lit(0.0))


def describe(x: Column, prefix: str = "") -> list[Column]:
    """count, mean, std (sample), min, quartiles (linear), max, for groups of bounded size; ``described`` serves all others."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    std = F.when(F.count(x) > 1, F.stddev_samp(x))
    parts = {"count": F.count(x), "mean": F.avg(x), "std": std, "min": F.min(x), "q25": q[0], "q50": q[1], "q75": q[2], "max": F.max(x)}
    return [c.alias(prefix + n) for n, c in parts.items()]


def described(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """``describe`` for groups of any size: the quartiles come from ranks over range partitions. Null keys are a key."""
    std = F.when(F.count(x) > 1, F.stddev_samp(x))
    rest = df.groupBy(*keys).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), std.alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    q = percentiles(df, keys, x, [25, 50, 75], "__q").select(F.struct(*keys).alias("__key"), "__q")
    both = rest.join(q, F.struct(*keys).eqNullSafe(F.col("__key")), "left")
    return both.select(*keys, "count", "mean", "std", "min", *(F.col("__q")[i].alias(n) for i, n in enumerate(("q25", "q50", "q75"))), "max")


def sem(x: Column) -> Column:
    return F.when(F.count(x) > 1, F.stddev_samp(x) / F.sqrt(F.count(x)))


def circular_mean(x: Column, low: float, high: float) -> Column:
    """Mean of a periodic value over [low, high)."""
    angle = (x - F.lit(low)) * F.lit(2 * PI / (high - low))
    mean = F.pmod(F.atan2(F.avg(F.sin(angle)), F.avg(F.cos(angle))), F.lit(2 * PI))
    return mean * F.lit((high - low) / (2 * PI)) + F.lit(low)


def resultant(x: Column, low: float, high: float) -> Column:
    angle = (x - F.lit(low)) * F.lit(2 * PI / (high - low))
    return F.hypot(F.avg(F.cos(angle)), F.avg(F.sin(angle)))


def circular_variance(x: Column, low: float, high: float) -> Column:
    return 1 - resultant(x, low, high)


def correlations(columns: list[str]) -> list[Column]:
    """Pearson correlation of each pair of columns, over rows in which both are known."""
    return [F.corr(a, b).alias(f"{a}__{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]


def flow_statistics(u: Column, v: Column, digits: int = 12) -> dict[str, Column]:
    """Statistics of flow vectors: speeds, components, angles, and the length of the mean unit vector over moving ones."""
    speed, angle = F.hypot(u, v), F.atan2(v, u)
    s, c = F.avg(F.sin(angle)), F.avg(F.cos(angle))
    ux, vy = (F.avg(F.when(speed > 0, x / speed)) for x in (u, v))
    found = {
        "mean_speed": F.avg(speed), "std_speed": F.stddev_pop(speed), "mean_u": F.avg(u), "mean_v": F.avg(v), "std_u": F.stddev_pop(u), "std_v": F.stddev_pop(v),
        "mean_angle": F.atan2(s, c), "std_angle": F.sqrt(-2 * F.log(F.hypot(s, c))), "unit_length": F.hypot(ux, vy),
    }
    return {n: F.round(x, digits) for n, x in found.items()}
