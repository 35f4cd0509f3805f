"""Statistics of small grouped tables and of trajectories."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators.ranks import percentiles
from driftloom.sources.scratch import settled


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def pearson_p(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation of n pairs; null below three pairs."""
    if n is None or n < 3 or r is None or math.isnan(r):
        return None
    return incomplete_beta(n / 2 - 1, n / 2 - 1, (1 - min(1.0, abs(r))) / 2) * 2


def with_pearson_p(df: DataFrame, r: str, n: str, name: str = "p") -> DataFrame:
    """Grouped rows with the p-value of their correlation; one short Python step over rows that are few."""

    @F.pandas_udf("double")
    def p(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rs, ns in batches:
            yield pd.Series([pearson_p(a, b) for a, b in zip(rs, ns, strict=True)], dtype=float)

    return df.withColumn(name, F.when(F.col(n) >= 3, p(F.col(r), F.col(n))))


def _correlated(first: int, frames: int, most: int):
    """Lagged products of whole trajectories at once, by the convolution theorem; padding keeps the ends apart."""
    size = 1 << (2 * frames - 1).bit_length()

    def centred(row: np.ndarray, at: np.ndarray, values: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of n trajectories by frame, less their means, and the sample deviations."""
        known = values.is_valid().to_numpy(zero_copy_only=False)
        row, at, v = row[known], at[known], values.to_numpy(zero_copy_only=False)[known]
        many = np.bincount(row, minlength=n)
        v = v - (np.bincount(row, v, n) / np.maximum(many, 1))[row]
        low, high, out = np.full(n, np.inf), np.full(n, -np.inf), np.zeros((n, frames))
        np.minimum.at(low, row, v)
        np.maximum.at(high, row, v)
        out[row, at] = v
        return out, np.where(low < high, np.sqrt(np.bincount(row, v * v, n) / np.maximum(many - 1, 1)), np.nan)

    def correlated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Some trajectories at a time, out of flat arrays, so that neither the input's rows nor the lags of a batch are held as objects."""
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                rows = part.column("__rows")
                row = np.repeat(np.arange(len(part)), rows.value_lengths().to_numpy())
                frame, *values = rows.flatten().flatten()
                (x, sx), (y, sy) = (centred(row, frame.to_numpy() - first, v, len(part)) for v in values)
                products = np.fft.irfft(np.fft.rfft(x, size).conj() * np.fft.rfft(y, size), size)
                scaled = np.concatenate((products[:, size - most :], products[:, : most + 1]), axis=1) / (frames * sx * sy)[:, None]
                places = pa.array(np.arange(len(part) + 1) * (2 * most + 1), pa.int32())
                lags = pa.ListArray.from_arrays(places, pa.array(scaled.ravel()), mask=pa.array(np.isnan(sx * sy)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names if c != "__rows"), lags], [*(c for c in part.schema.names if c != "__rows"), "ccf"])

    return correlated


def cross_correlation(df: DataFrame, x: str, y: str, keys: list[str], lags: int | None = None) -> DataFrame:
    """(keys, lag, ccf) of each trajectory for lags from minus to plus a third of the frames (or ``lags``): x against y ``lag`` frames later.

    Values are centred by the mean of the frames present, missing frames and nulls count 0, and the sum of lagged products is
    divided by the table's number of frames and both sample deviations; trajectories with a constant or single value give null.
    A trajectory is one row of arrays, so rows are shuffled once, whatever the number of lags.
    """
    low, high = df.agg(F.min("frame_number"), F.max("frame_number")).first()
    frames = 1 if low is None else high - low + 1
    most = min(frames - 1, lags) if lags is not None else max(1, frames // 3)
    rows = df.groupBy(*keys).agg(F.collect_list(F.struct("frame_number", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))).alias("__rows"))
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("ccf", T.ArrayType(T.DoubleType()))])
    found = rows.mapInArrow(_correlated(low or 0, frames, most), schema)
    return found.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).select(*keys, "lag", F.col("ccf")[F.col("lag") + most].alias("ccf"))


def autocorrelation(df: DataFrame, x: str, keys: list[str], lags: int | None = None) -> DataFrame:
    """(keys, lag, acf) of each trajectory for positive lags: its cross-correlation with itself."""
    return cross_correlation(df, x, x, keys, lags).where("lag > 0").withColumnRenamed("ccf", "acf")


def lag_summary(acf: DataFrame, keys: list[str], value: str = "acf") -> DataFrame:
    """Mean and 5th and 95th percentile of a correlation over trajectories."""
    acf = settled(acf)
    out = acf.groupBy(*keys, "lag").agg(F.avg(value).alias("mean")).join(percentiles(acf, [*keys, "lag"], value, [5, 95]), [*keys, "lag"], "left")
    return out.select(*keys, "lag", "mean", F.col("p")[0].alias("lower"), F.col("p")[1].alias("upper"))


def fit_decay(df: DataFrame, keys: list[str], x: str, y: str, low: float, high: float, steps: int = 40, rounds: int = 3) -> DataFrame:
    """Least squares fit of a * exp(-b * x) + c for each key: (keys, a, b, c, sse).

    For a fixed b the rest is a line fit, so b runs over a grid, which is refined around the best value in each round. b stays
    at ``low`` or above; values far below 1 over the range of x give a line, whose a and c only cancel each other.
    """
    grid = df.select(*keys).distinct().withColumns({"__lo": F.lit(low), "__hi": F.lit(high)})
    best = None
    for _ in range(rounds):
        b = F.col("__lo") + F.col("__i") * (F.col("__hi") - F.col("__lo")) / steps
        tried = grid.withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("b", b)
        e = F.exp(-F.col("b") * F.col(x))
        fit = df.join(tried, keys).withColumn("__e", e).groupBy(*keys, "b", "__lo", "__hi").agg(
            F.regr_slope(y, "__e").alias("a"), F.regr_intercept(y, "__e").alias("c"), (F.regr_syy(y, "__e") - F.regr_slope(y, "__e") * F.regr_sxy(y, "__e")).alias("sse")
        )
        best = fit.where("a is not null").groupBy(*keys).agg(F.min_by(F.struct("a", "b", "c", "sse", "__lo", "__hi"), F.struct("sse", "b")).alias("f"))
        width = (F.col("f.__hi") - F.col("f.__lo")) / steps
        grid = best.select(*keys, F.greatest(F.lit(max(low, 1e-9)), F.col("f.b") - width).alias("__lo"), (F.col("f.b") + width).alias("__hi"))
    return best.select(*keys, "f.a", "f.b", "f.c", "f.sse")


def york_fit(x, y, sx, sy, rounds: int = 50) -> tuple[float, float, float, float, float]:
    """Slope, intercept, their standard errors and reduced chi square of a line with errors in both axes (York's iteration)."""
    wx, wy = 1 / sx**2, 1 / sy**2
    slope = np.polyfit(x, y, 1)[0]
    for _ in range(rounds):
        w = wx * wy / (wx + slope**2 * wy)
        mx, my = (w * x).sum() / w.sum(), (w * y).sum() / w.sum()
        u, v = x - mx, y - my
        b = w * (u / wy + slope * v / wx)
        new = (w * b * v).sum() / (w * b * u).sum()
        if abs(new - slope) <= 1e-14 * abs(new):
            break
        slope = new
    intercept = my - slope * mx
    xa = mx + b
    mid = (w * xa).sum() / w.sum()
    error = 1 / np.sqrt((w * (xa - mid) ** 2).sum())
    chi2 = (w * (y - slope * x - intercept) ** 2).sum() / (len(x) - 2)
    return slope, intercept, error, np.sqrt(1 / w.sum() + mid**2 * error**2), chi2


def line_fit_both_errors(df: DataFrame, keys: list[str], x: str, y: str, sx: str, sy: str) -> DataFrame:
    """Line y = slope * x + intercept for each key, with standard errors in both axes.

    Points weigh by the inverse squares of their errors; points with a null or an error of 0 are left out; fewer than three
    points give null. A key's rows are the bins of a statistics table, so their number is that of the bins.
    """
    points = df.where(" and ".join(f"{c} is not null" for c in (x, y, sx, sy)) + f" and {sx} > 0 and {sy} > 0").select(*keys, x, y, sx, sy)
    found = ["slope", "intercept", "slope_error", "intercept_error", "chi2"]
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(f, T.DoubleType()) for f in found), T.StructField("n", T.LongType())])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        values = york_fit(*(pdf[c].to_numpy(dtype=float) for c in (x, y, sx, sy))) if len(pdf) > 2 else [None] * 5
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), *values, len(pdf)]], columns=schema.names)

    return points.groupBy(*keys).applyInPandas(fit, schema)


def signed_distance_to_line(x: Column, y: Column, slope: Column, intercept: Column) -> Column:
    return (y - slope * x - intercept) / F.sqrt(1 + slope * slope)
