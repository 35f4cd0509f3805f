"""Outliers against a rolling median."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.windows import local_extrema, rolling_median


def outlier_classes(
    df: DataFrame, x: str, size: int, keys: list[str], order: list[str],
    dark: float = 0.01, partial: float = 0.004, bright: float = 0.01, slices: int = 1, peaks_only: bool = True,
) -> DataFrame:
    """Rows far from the rolling median: dark, partial_dark (not dark) or bright, with the frame of the row and its annotation.

    A frame has ``slices`` rows. Unless ``peaks_only`` is off, dark rows are local minima and bright ones local maxima.
    Partly dark rows are errors of the scope, the others temporary artifacts. Bounds are reckoned in decimals: 1 - 0.8 is 0.2, which doubles miss.
    """
    low, middle, high = (float(1 + sign * Decimal(str(x))) for sign, x in ((-1, dark), (-1, partial), (1, bright)))
    rows = rolling_median(df, x, size, keys, order, place="__row")
    m, v = F.col("rolling_median"), F.col(x)
    kind = F.when(v <= m * low, "dark").when(v <= m * middle, "partial_dark").when(v >= m * high, "bright")
    if peaks_only:
        rows = local_extrema(rows, x, keys, order)
        kind = F.when(F.col("extremum") == F.when(kind == "bright", "max").otherwise("min"), kind)
    rows = rows.withColumns({"kind": kind, "frame_number": F.floor(F.col("__row") / slices).cast("int")}).drop("__row").where("kind is not null")
    return rows.withColumn("annotation", F.when(F.col("kind") == "partial_dark", "scope_error").otherwise("temporary_artifact"))


def threshold_outliers(df: DataFrame, x: str, size: int, keys: list[str], order: list[str], low: float, high: float) -> DataFrame:
    """Rows below ``low`` times or above ``high`` times the rolling median."""
    rows = rolling_median(df, x, size, keys, order)
    return rows.where((F.col(x) < F.col("rolling_median") * low) | (F.col(x) > F.col("rolling_median") * high))
