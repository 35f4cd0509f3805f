"""Bins, weighted histograms and smoothing over state space. Grids are long tables: one row a cell that holds something."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.hooks import KERNELS
from driftloom.operators import ranks


@dataclass(frozen=True)
class Axis:
    """An axis of equal bins: column, lower limit, bin width, number of bins, and a period if it is an angle."""

    column: str
    low: float
    width: float
    n: int
    period: float | None = None

    @property
    def high(self) -> float:
        return self.low + self.n * self.width

    def center(self, i: Column) -> Column:
        return F.lit(self.low) + (i + 0.5) * self.width

    def index(self) -> Column:
        """Bin of a value; the last edge belongs to the last bin, values outside have none."""
        x = F.col(self.column)
        i = F.floor((x - F.lit(self.low)) / self.width).cast("int")
        return F.when((x >= self.low) & (x <= self.high), F.least(F.lit(self.n - 1), i))

    def clamped(self) -> Column:
        i = F.floor((F.col(self.column) - F.lit(self.low)) / self.width).cast("int")
        return F.greatest(F.lit(0), F.least(F.lit(self.n - 1), i))


def snapped_limits(low: Column, high: Column, size: float) -> tuple[Column, Column]:
    """Limits moved outwards to whole bins."""
    return F.floor(low / size) * size, F.ceil(high / size) * size


def make_axis(df: DataFrame, column: str, width: float, limits: tuple[float, float] | None = None, pad: float = 0.0, percentiles: tuple[float, float] | None = None, period: float | None = None) -> Axis:
    """An axis with ceil((high - low) / width) bins between given limits, percentiles (percent) or padded extremes of the data."""
    if width <= 0:
        raise ValueError("the bin width must be above 0")
    if limits is None:
        if percentiles is None:
            low, high = df.agg(F.min(column) - pad, F.max(column) + pad).first()
        else:
            found = ranks.percentiles(df, [], column, list(percentiles)).first()
            low, high = found["p"] if found else (None, None)
    else:
        low, high = limits
    if low is None or not low < high:
        raise ValueError(f"{column} has no range to bin")
    n = ceil((high - low) / width - 1e-12)
    return Axis(column, float(low), (high - low) / n, n, period)


def axis_table(spark, axis: Axis) -> DataFrame:
    i = F.col("id").cast("int")
    return spark.range(axis.n).select(i.alias("i"), (F.lit(axis.low) + F.col("id") * axis.width).alias("low"), axis.center(F.col("id")).alias("center"))


def histogram(df: DataFrame, axes: list[Axis], weights: dict[str, Column], keys: list[str] = ()) -> DataFrame:
    """(keys, i0, i1, ..., weights) summed by cell; rows outside the axes are dropped."""
    rows = df.withColumns({f"i{k}": a.index() for k, a in enumerate(axes)} | {"__w_" + n: w for n, w in weights.items()})
    rows = rows.na.drop(subset=[f"i{k}" for k in range(len(axes))])
    return rows.groupBy(*keys, *(f"i{k}" for k in range(len(axes)))).agg(*(F.sum("__w_" + n).alias(n) for n in weights))


def density_histogram(df: DataFrame, keys: list[str], x: str, low: float, width: float, n: int) -> DataFrame:
    """(keys, b, density): counts over (rows of the key inside the range) * width."""
    from pyspark.sql import Window

    axis = Axis(x, low, width, n)
    counts = histogram(df, [axis], {"n": F.lit(1)}, keys)
    total = F.sum("n").over(Window.partitionBy(*keys))
    return counts.select(*keys, F.col("i0").alias("b"), (F.col("n") / (total * F.lit(width))).alias("density"))


def smoothed(hist: DataFrame, axes: list[Axis], kernels: list[tuple[str, float]], values: list[str], keys: list[str] = (), cutoff: float = 0.0) -> DataFrame:
    """out(i) = sum over j of hist(j) times the product of the axes' kernels at their distance in cells, on the whole grid.

    The product is taken axis by axis: each pass spreads every cell along one axis by the kernel's weights, which are computed in
    the row, and sums what lands on a cell. Weights of at most ``cutoff`` are left out. Cells that nothing reaches have no row.
    """
    out = hist
    for k, (axis, (name, bandwidth)) in enumerate(zip(axes, kernels, strict=True)):
        to = F.explode(F.sequence(F.lit(0), F.lit(axis.n - 1)))
        spread = out.withColumn("__to", to)
        weight = KERNELS[name]((F.col("__to") - F.col(f"i{k}")) * F.lit(axis.width), bandwidth, axis.period)
        spread = spread.withColumn("__k", weight).where(F.col("__k") > cutoff).drop(f"i{k}").withColumnRenamed("__to", f"i{k}")
        out = spread.groupBy(*keys, *(f"i{j}" for j in range(len(axes)))).agg(*(F.sum(F.col(v) * F.col("__k")).alias(v) for v in values))
    return out


def _offset(axis: Axis, k: int, steps: int) -> Column:
    """Offsets of an axis in cells; on a circle each other cell is met once, the short way."""
    low, high = (-steps, steps) if axis.period is None or 2 * steps + 1 <= axis.n else (-((axis.n - 1) // 2), axis.n // 2)
    return F.explode(F.sequence(F.lit(low), F.lit(high))).alias(f"__o{k}")


def stencil(hist: DataFrame, axes: list[Axis], kernel: Callable[..., Column], reach: list[int], values: list[str], keys: list[str] = ()) -> DataFrame:
    """out(i) = sum over j of hist(j) times a kernel of the distances i - j, for kernels that are no product of the axes.

    ``kernel`` takes a column with the distance along each axis, in the axis's unit, and is 0 beyond ``reach`` cells. Each cell
    is spread to its neighbours, and partial sums follow at once. Beyond the ends of an axis nothing lands; a periodic axis closes on
    itself. Cells that nothing reaches have no row.
    """
    out = hist
    for k, (axis, steps) in enumerate(zip(axes, reach, strict=True)):
        to = F.col(f"i{k}") + F.col(f"__o{k}")
        out = out.select("*", _offset(axis, k, steps))
        out = out.withColumn(f"__t{k}", F.pmod(to, F.lit(axis.n))) if axis.period else out.withColumn(f"__t{k}", to).where(F.col(f"__t{k}").between(0, axis.n - 1))
    weight = kernel(*(F.col(f"__o{k}") * F.lit(a.width) for k, a in enumerate(axes)))
    out = out.withColumn("__k", weight).where("__k != 0")
    return out.groupBy(*keys, *(F.col(f"__t{k}").cast("int").alias(f"i{k}") for k in range(len(axes)))).agg(*(F.sum(F.col(v) * F.col("__k")).alias(v) for v in values))


def stencil_at(hist: DataFrame, axes: list[Axis], kernel: Callable[..., Column], cell: list[int], values: list[str], keys: list[str] = ()) -> DataFrame:
    """The same for one cell, by key: every cell of the histogram gives its share, and nothing is spread."""
    away = []
    for k, (axis, i) in enumerate(zip(axes, cell, strict=True)):
        d = F.lit(i) - F.col(f"i{k}")
        away.append((F.pmod(d + (axis.n - 1) // 2, F.lit(axis.n)) - (axis.n - 1) // 2 if axis.period else d) * F.lit(axis.width))
    out = hist.withColumn("__k", kernel(*away)).where("__k != 0")
    return out.groupBy(*keys).agg(*(F.sum(F.col(v) * F.col("__k")).alias(v) for v in values))


def end_weight(axis: Axis, i: Column) -> Column:
    """Weight of a cell in the trapezoid rule."""
    return F.when((i == 0) | (i == axis.n - 1), F.lit(axis.width / 2)).otherwise(F.lit(axis.width))


def integral(p: Column, axes: list[Axis]) -> Column:
    """Trapezoid integral of a gridded density, as an aggregate."""
    out = F.coalesce(p, F.lit(0.0))
    for k, a in enumerate(axes):
        out = out * end_weight(a, F.col(f"i{k}"))
    return F.sum(out)


def marginal(df: DataFrame, axes: list[Axis], over: int, p: str, keys: list[str] = ()) -> DataFrame:
    """A density integrated over one axis."""
    rest = [f"i{k}" for k in range(len(axes)) if k != over]
    return df.groupBy(*keys, *rest).agg(F.sum(F.coalesce(F.col(p), F.lit(0.0)) * end_weight(axes[over], F.col(f"i{over}"))).alias(p))


def cells(spark, axes: list[Axis]) -> DataFrame:
    """Every cell of a grid, with the center of each axis."""
    out = None
    for k, a in enumerate(axes):
        one = spark.range(a.n).select(F.col("id").cast("int").alias(f"i{k}"), a.center(F.col("id")).alias(f"x{k}"))
        out = one if out is None else out.crossJoin(one)
    return out
