"""Correlations of many columns at once, from blocks of sums over pairs of columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of a block, and how many partial results of a block are added together at first.
BLOCK, SALTS = 64, 16
SUMS = ("n", "x", "y", "xx", "yy", "xy")
SCHEMA = "rows int, cols int, salt int, sums array<double>"


def _partial(size: int, shift: list[float]):
    """Sums of pairs over a partition: with values 0 where missing and masks, each is a product of two matrices."""
    centre = np.array(shift)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, any_rows = np.zeros((4, size, size)), False
        for pdf in batches:
            for part in range(0, len(pdf), 4096):
                x = np.array([[np.nan if v is None else v for v in row] for row in pdf["v"].iloc[part : part + 4096]], dtype=float) - centre
                mask = np.isfinite(x).astype(float)
                x = np.where(mask > 0, x, 0.0)
                for k, (a, b) in enumerate(((mask, mask), (x, mask), (x * x, mask), (x, x))):
                    total[k] += a.T @ b
                any_rows = True
        if any_rows:
            starts = range(0, size, BLOCK)
            n, one, two, both = total
            out = []
            for i in starts:
                for j in (s for s in starts if s >= i):
                    rows, cols = slice(i, i + BLOCK), slice(j, j + BLOCK)
                    blocks = (n[rows, cols], one[rows, cols], one[cols, rows].T, two[rows, cols], two[cols, rows].T, both[rows, cols])
                    out.append((i, j, TaskContext.get().partitionId() % SALTS, np.concatenate([b.ravel() for b in blocks])))
            yield pd.DataFrame(out, columns=["rows", "cols", "salt", "sums"])

    return summed


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.iloc[:1].assign(sums=[np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)])


def _coefficients(size: int):
    def unfolded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, j, sums in zip(pdf["rows"], pdf["cols"], pdf["sums"], strict=True):
                h, w = min(BLOCK, size - i), min(BLOCK, size - j)
                n, x, y, xx, yy, xy = np.asarray(sums).reshape(len(SUMS), h, w)
                with np.errstate(all="ignore"):
                    vx, vy = n * xx - x * x, n * yy - y * y
                    r = (n * xy - x * y) / np.sqrt(vx * vy)
                # What rounding leaves of a constant column is no spread.
                r = np.where((n > 1) & (vx > 1e-12 * n * xx) & (vy > 1e-12 * n * yy), np.clip(r, -1.0, 1.0), np.nan)
                a, b = np.nonzero(np.arange(i, i + h)[:, None] < np.arange(j, j + w))
                out = pd.DataFrame({"a": a + i, "b": b + j, "n": n[a, b].astype(np.int64), "r": r[a, b]})
                yield out.astype({"r": object}).where(out.notna(), None)

    return unfolded


def correlation_matrix(df: DataFrame, vector: str, size: int) -> DataFrame:
    """(a, b, n, r): Pearson correlation of each pair of components a < b of an array, over rows in which both are known.

    Null arrays and null or non-finite components are missing; r is null for fewer than two rows or a constant component. Values are
    taken from near their mean, so that sums do not cancel. A partition gives one block of sums for each 64 x 64 components; blocks are
    added in two steps, and no row of the table is repeated for its pairs. Arrays of another length than ``size`` are an error.
    """
    rows = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    each = [F.get("v", F.lit(i)) for i in range(size)]
    known = [F.avg(F.when(F.abs(x) < float("inf"), x)) for x in each]
    found = rows.agg(F.array(*known).alias("mean"), F.bool_and(F.size("v") == size).alias("alike")).first()
    if found["alike"] is False:
        raise ValueError(f"arrays of {size} components are needed")
    shift = [0.0 if m is None else m for m in found["mean"]]
    blocks = rows.mapInPandas(_partial(size, shift), SCHEMA)
    for keys in (["rows", "cols", "salt"], ["rows", "cols"]):
        blocks = blocks.groupBy(*keys).applyInPandas(_added, SCHEMA)
    return blocks.mapInPandas(_coefficients(size), "a int, b int, n long, r double")
