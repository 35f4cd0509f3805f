"""Places where users put functions of their own: kernels, stop conditions, metrics and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.angles import kernel

Kernel = Callable[..., Column]
KERNELS: dict[str, Kernel] = {name: partial(kernel, name) for name in ("gaussian", "epanechnikov", "periodic")}


def add_kernel(name: str, made: Kernel) -> None:
    """Register a kernel: a function of (distance, bandwidth, period) that gives a column."""
    if name in KERNELS:
        raise ValueError(f"a kernel is already called {name}")
    KERNELS[name] = made


def first_condition(conditions: list[tuple[str, Column]]) -> Column:
    """Name of the first condition that holds, in the order given; null if none does. Unknown counts as not holding."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(conditions):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def stops(df: DataFrame, keys: list[str], order: str, conditions: list[tuple[str, Column]]) -> DataFrame:
    """(keys, stop, order): the first row of each key on which a condition holds, and its name."""
    rows = df.withColumn("stop", first_condition(conditions)).where("stop is not null")
    return rows.groupBy(*keys).agg(F.min_by("stop", order).alias("stop"), F.min(order).alias(order))


def aggregate(function: Callable[[pd.Series], float]) -> Callable[[Column], Column]:
    """A user's aggregate of a series as a grouped aggregate; groups of bounded size only, as a group goes to one task."""

    @F.pandas_udf("double")
    def run(x: pd.Series) -> float:
        return float(function(x))

    return run
