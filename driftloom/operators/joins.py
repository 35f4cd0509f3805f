"""Joins of feature tables: equal keys, boxes, nearest points and links between frames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.functions.angles import wrapped_difference
from driftloom.sources.scratch import settled


#: Rows up to which a table that was counted goes to every task.
FEW = 100_000


def with_few(df: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", most: int = FEW) -> DataFrame:
    """``df`` joined to a table with few rows, such as one a data set, which goes to every task if a count finds it to be few.

    Exchanged by such keys, all rows of a data set would go to one task. Adaptive execution keeps that exchange where most of
    its partitions are empty, and so leaves a few tasks with everything, however large the cluster.
    """
    few = settled(few)
    return df.join(F.broadcast(few) if few.count() <= most else few, keys, how)


def inner_without_clashes(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join; columns of the right table that the left has too are dropped first."""
    return left.join(right.drop(*(set(left.columns) & set(right.columns) - set(keys))), keys)


def left_with_suffixes(left: DataFrame, right: DataFrame, keys: list[str], suffixes: tuple[str, str] = ("_x", "_y")) -> DataFrame:
    """Left join; columns that both have get a suffix on either side."""
    both = set(left.columns) & set(right.columns) - set(keys)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in both})
    return left.join(right.withColumnsRenamed({c: c + suffixes[1] for c in both}), keys, "left")


def first_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row a key: the first in a stated order."""
    rows = df.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.where("__rn = 1").drop("__rn")


#: Distinct points, and boxes, that a task counts at once.
PART = 1 << 17

#: An axis of boxes: point column with the columns of both bounds, or with the column of the centre and half the side.
BoxAxis = tuple[str, str, str | float]


def _first(values: np.ndarray, at: np.ndarray, holds: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first place in ascending values from which on a condition holds, for each entry of ``at``."""
    low, high = np.zeros(len(at), dtype=np.int64), np.full(len(at), len(values))
    while (still := low < high).any():
        middle = (low + high) // 2
        found = holds(values[np.minimum(middle, len(values) - 1)], at)
        low, high = np.where(still & ~found, middle + 1, low), np.where(still & found, middle, high)
    return low


def _reached(values: np.ndarray, boxes: pa.Table, axis: BoxAxis) -> tuple[np.ndarray, np.ndarray]:
    """The places in ascending values where those inside each box begin and end. NaN is above all numbers, and in no box around a centre."""
    _, a, b = axis
    if isinstance(b, str):
        return np.searchsorted(values, boxes.column(a).to_numpy(), "left"), np.searchsorted(values, boxes.column(b).to_numpy(), "right")
    begin, end = (_first(values, boxes.column(a).to_numpy(), holds) for holds in (lambda p, c: ~(p - c < -b), lambda p, c: ~(p - c <= b)))
    return begin, np.maximum(begin, end)


def _weights_inside(weights: np.ndarray, ranks: np.ndarray, across: tuple[np.ndarray, np.ndarray], along: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sums of weights over places in [begin, end) whose rank is in [begin, end), for many ranges, without listing pairs.

    Bit by bit of the ranks, points are dealt to two sides in stable order, so that a range stays a range; what is on the side below a
    bound is added. The work is that of points and ranges, times the bits.
    """
    total = np.zeros(len(along[0]), dtype=np.int64)
    asked = [(across[0], across[1], along[1], 1), (across[0], across[1], along[0], -1)]
    for bit in reversed(range(len(ranks).bit_length())):
        one = (ranks >> bit & 1).astype(bool)
        below, sums = (np.concatenate(([0], np.cumsum(v))) for v in (~one, np.where(one, 0, weights)))
        for k, (begin, end, bound, sign) in enumerate(asked):
            up, b, e = (bound >> bit & 1).astype(bool), below[begin], below[end]
            total += sign * np.where(up, sums[end] - sums[begin], 0)
            asked[k] = np.where(up, below[-1] + begin - b, b), np.where(up, below[-1] + end - e, e), bound, sign
        ranks, weights = (np.concatenate((v[~one], v[one])) for v in (ranks, weights))
    return total


def count_in_boxes(boxes: DataFrame, points: DataFrame, keys: list[str], axes: list[BoxAxis], tile: float, box_id: list[str], name: str = "n_points", part: int = PART) -> DataFrame:
    """Boxes with the number of points inside, bounds included; 0 where there is none.

    ``axes`` holds one or two of (point column, low column, high column) or (point column, centre column, half side); the latter compares
    the distance from the centre. The first axis is cut into tiles: a point lies in one, a box is repeated for those that it covers. In a
    tile of a key, up to ``part`` distinct points meet up to ``part`` boxes, whatever the crowd, and are counted by sorted order, not in pairs.
    """
    if len(axes) not in (1, 2):
        raise ValueError("boxes have one or two axes")
    p, a, b = axes[0]
    low, high = (F.col(a), F.col(b)) if isinstance(b, str) else (F.col(a) - b, F.col(a) + b)
    # A distance is rounded: a point on the bound may lie in the next tile.
    slack = 0.0 if isinstance(b, str) else 1e-6
    columns, bounds, cell = [c for c, _, _ in axes], list(dict.fromkeys(c for axis in axes for c in axis[1:] if isinstance(c, str))), [*keys, "__tile"]
    covered = F.sequence(F.floor(low / tile - slack), F.floor(high / tile + slack))
    spread = boxes.dropna(subset=[*keys, *bounds]).select(*keys, *box_id, *bounds, F.explode(covered).alias("__tile"))
    placed = points.dropna(subset=[*keys, *columns]).groupBy(*keys, *columns).agg(F.count("*").alias("__w")).withColumn("__tile", F.floor(F.col(p) / tile))
    parts = lambda rows, c: rows.groupBy(*cell).agg(F.ceil(F.count("*") / part).alias(c))
    sizes = parts(placed, "__ps").join(parts(spread, "__bs"), cell)
    each = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    placed = placed.join(sizes, cell).withColumns({"__i": F.pmod(F.xxhash64(*columns), "__ps"), "__j": each("__bs")}).drop("__ps", "__bs")
    spread = spread.join(sizes, cell).withColumns({"__j": F.pmod(F.xxhash64(*box_id), "__bs"), "__i": each("__ps")}).drop("__ps", "__bs")
    schema = T.StructType([*(spread.schema[c] for c in [*keys, *box_id]), T.StructField("__n", T.LongType())])

    def counted(some: pa.Table, around: pa.Table) -> pa.Table:
        at = [some.column(c).to_numpy() for c in columns]
        order, weights = np.argsort(at[0], kind="stable"), some.column("__w").to_numpy()
        across = _reached(at[0][order], around, axes[0])
        if len(axes) == 1:
            sums = np.concatenate(([0], np.cumsum(weights[order])))
            n = np.maximum(sums[across[1]] - sums[across[0]], 0)
        else:
            up = np.argsort(at[1], kind="stable")
            ranks = np.empty(len(up), dtype=np.int64)
            ranks[up] = np.arange(len(up))
            along = _reached(at[1][up], around, axes[1])
            # A box whose bounds are the wrong way round holds nothing.
            n = _weights_inside(weights[order], ranks[order], (across[0], np.maximum(*across)), (along[0], np.maximum(*along)))
        return around.select(schema.names[:-1]).append_column("__n", pa.array(n, pa.int64()))

    group = [*cell, "__i", "__j"]
    # Named anew, as boxes and points may be of one table.
    spread = spread.select(*(F.col(c).alias(c) for c in spread.columns))
    counts = placed.groupBy(*group).cogroup(spread.groupBy(*group)).applyInArrow(counted, schema).groupBy(*keys, *box_id).agg(F.sum("__n").alias(name))
    return boxes.join(counts, [*keys, *box_id], "left").fillna(0, [name])


def rows_in_boxes(points: DataFrame, centers: DataFrame, keys: list[str], center_id: list[str], axes: list[tuple[str, str]], sides: list[float]) -> DataFrame:
    """Rows of ``points`` inside the half-open box around each center, with the center's id and place; a row may lie in several boxes.

    ``axes`` holds (column of points, column of centers), ``sides`` the box's width on each. The first axis is cut into tiles.
    """
    inside = reduce(lambda x, y: x & y, ((F.col(p) >= F.col(c) - side / 2) & (F.col(p) < F.col(c) + side / 2) for (p, c), side in zip(axes, sides, strict=True)))
    cells = centers.select(*keys, *center_id, *(c for _, c in axes))
    (p, c), side = axes[0], sides[0]
    covered = F.sequence(F.floor((F.col(c) - side / 2) / side), F.floor((F.col(c) + side / 2) / side))
    return cells.withColumn("__tile", F.explode(covered)).join(points.withColumn("__tile", F.floor(F.col(p) / side)), [*keys, "__tile"]).where(inside).drop("__tile")


def means_in_boxes(points: DataFrame, values: list[str], centers: DataFrame, keys: list[str], center_id: list[str], axes: list[tuple[str, str]], side: float) -> DataFrame:
    """Means of values over the half-open cube of a side around each center; null where no row is inside.

    ``axes`` holds (column of points, column of centers).
    """
    found = rows_in_boxes(points, centers, keys, center_id, axes, [side] * len(axes))
    means = found.groupBy(*keys, *center_id).agg(*(F.avg(v).alias("mean_" + v) for v in values))
    return centers.join(means, [*keys, *center_id], "left")


def distances_to_points(df: DataFrame, points: DataFrame, keys: list[str], axes: list[tuple[str, str]], periods: dict[str, float] | None = None) -> DataFrame:
    """Rows with every fixed point of their keys: signed differences d_<axis> (periodic ones the short way) and the distance."""
    periods = periods or {}
    rows = with_few(df, points, keys)
    diffs = {}
    for x, c in axes:
        d = F.col(x) - F.col(c)
        diffs["d_" + x] = wrapped_difference(d, periods[x]) if x in periods else d
    rows = rows.withColumns(diffs)
    return rows.withColumn("distance", F.sqrt(sum((F.col(d) * F.col(d) for d in diffs), F.lit(0.0))))


def nearest_on_grid(df: DataFrame, axes: dict[str, tuple[float, float, int]], name: str = "cell") -> DataFrame:
    """Index of the nearest point of a regular grid on each axis; ``axes`` holds (low, step, number of points). Ties go down."""
    out = {}
    for x, (low, step, n) in axes.items():
        i = F.ceil((F.col(x) - F.lit(low)) / step - 0.5)
        out[f"{name}_{x}"] = F.greatest(F.lit(0), F.least(F.lit(n - 1), i)).cast("int")
    return df.withColumns(out)


def greedy_matches(baseline: DataFrame, found: DataFrame, keys: list[str], axes: list[str], radius: float, ranks: int, periods: dict[str, float] | None = None) -> DataFrame:
    """Matches of baseline points (``point_id``, ``rank``) to found ones (``replicate``, ``found_id``) within a radius.

    Within a replicate each found point is used once; baseline points choose in the order of their rank, the nearest first.
    ``ranks`` is the number of rounds; a baseline point whose rank is not below it is an error.
    """
    if not baseline.where(F.col("rank").isNull() | (F.col("rank") < 0) | (F.col("rank") >= ranks)).isEmpty():
        raise ValueError(f"ranks of baseline points must be from 0 to {ranks - 1}")
    periods = periods or {}
    b = baseline.select(*keys, "point_id", "rank", *(F.col(a).alias("__b_" + a) for a in axes))
    near = found.join(b, keys)
    d = [wrapped_difference(F.col(a) - F.col("__b_" + a), periods[a]) if a in periods else F.col(a) - F.col("__b_" + a) for a in axes]
    near = near.withColumn("distance", F.sqrt(sum((x * x for x in d), F.lit(0.0)))).where(F.col("distance") <= radius)
    used = [*keys, "replicate", "found_id"]
    left, taken = settled(near), None
    for r in range(ranks):
        pick = settled(first_by(left.where(F.col("rank") == r), [*keys, "replicate", "point_id"], ["distance", "found_id"]))
        taken = pick if taken is None else taken.unionByName(pick)
        left = settled(left.where(F.col("rank") > r).join(pick.select(*used), used, "left_anti")) if r + 1 < ranks else left
    return taken.select(*keys, "replicate", "point_id", "found_id", *axes, "distance")


#: How labels of a frame and of another are matched: the best of each label here, of each label there, or only where both agree. In time,
#: forward looks from the earlier frame to the later one and reverse the other way.
MODES = ("forward", "reverse", "to_reference", "from_reference", "reciprocal")


def best_pairs(pairs: DataFrame, a: list[str], b: list[str], score: Column, order: str = "desc", mode: str = "reciprocal", step: int = 1) -> DataFrame:
    """Pairs that are best for ``a`` (from), for ``b`` (to) or for both; ties go to the smaller partner."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    sides = {"forward": "b" if step < 0 else "a", "reverse": "a" if step < 0 else "b", "to_reference": "b", "from_reference": "a", "reciprocal": "ab"}[mode]
    sort = score.desc() if order == "desc" else score.asc()
    ranks = {"a": Window.partitionBy(*a).orderBy(sort, *b), "b": Window.partitionBy(*b).orderBy(sort, *a)}
    rows = pairs.withColumns({f"__r{s}": F.row_number().over(ranks[s]) for s in sides})
    return rows.where(reduce(lambda x, y: x & y, (F.col(f"__r{s}") == 1 for s in sides))).drop("__ra", "__rb")


LINK = ["position", "frame_number"]


def overlap_links(pixels: DataFrame, step: int = 1, mode: str = "reciprocal", least: int = 1) -> DataFrame:
    """Labels of frames ``step`` apart that overlap most: (position, frame_number, label, next_label, overlap)."""
    after = pixels.select("position", (F.col("frame_number") - step).alias("frame_number"), "y", "x", F.col("label").alias("next_label"))
    both = pixels.join(after, [*LINK, "y", "x"]).groupBy(*LINK, "label", "next_label").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= least)
    return best_pairs(both, [*LINK, "label"], [*LINK, "next_label"], F.col("overlap"), "desc", mode, step)


def metric_links(regions: DataFrame, metrics: dict[str, tuple[list[str], float]], step: int = 1, mode: str = "reciprocal", every: bool = False) -> DataFrame:
    """Labels of frames ``step`` apart with the smallest mean metric distance: (position, frame_number, label, next_label, distance).

    ``metrics`` holds columns and the largest distance of each metric; of several columns the distance is Euclidean, and infinity
    sets no limit. Distances beyond their limit, and null ones, are left out of the mean; a pair needs one metric within its
    limit, or all where ``every``. Pairs are found tile by tile in the columns of a metric; only where a metric without a limit may
    decide alone do all labels of both frames meet.
    """
    columns = list(dict.fromkeys(c for names, _ in metrics.values() for c in names))
    after = regions.select("position", (F.col("frame_number") - step).alias("frame_number"), F.col("label").alias("next_label"), *(F.col(c).alias("__n_" + c) for c in columns))
    before = regions.select(*LINK, "label", *columns)
    limited = {m: v for m, v in metrics.items() if v[1] != float("inf")}
    if every:
        found = [_tiled(before, after, *next(iter(limited.values())))] if limited else [before.join(after, LINK)]
    elif len(limited) < len(metrics):
        found = [before.join(after, LINK)]
    else:
        found = [_tiled(before, after, *v) for v in limited.values()]
    both = reduce(DataFrame.unionByName, found)
    if len(found) > 1:
        both = both.dropDuplicates([*LINK, "label", "next_label"])
    near = []
    for names, most in metrics.values():
        d = F.sqrt(sum(((F.col(c) - F.col("__n_" + c)) ** 2 for c in names), F.lit(0.0)))
        near.append(F.when(d <= most, d))
    present = sum((d.isNotNull().cast("int") for d in near), F.lit(0))
    total = sum((F.coalesce(d, F.lit(0.0)) for d in near), F.lit(0.0))
    both = both.where(present >= (len(near) if every else 1)).select(*LINK, "label", "next_label", (total / present).alias("distance"))
    return best_pairs(both, [*LINK, "label"], [*LINK, "next_label"], F.col("distance"), "asc", mode, step)


def _tiled(before: DataFrame, after: DataFrame, names: list[str], most: float) -> DataFrame:
    """Pairs of the same frame whose tiles of side ``most`` touch in every column."""
    tiles = [f"__t{k}" for k in range(len(names))]
    side = most if most > 0 else 1.0
    for t, c in zip(tiles, names, strict=True):
        at = F.floor(F.col(c) / side)
        before = before.where(F.col(c).isNotNull()).withColumn(t, F.explode(F.sequence(at - 1, at + 1)))
        after = after.withColumn(t, F.floor(F.col("__n_" + c) / side))
    return before.join(after, [*LINK, *tiles]).drop(*tiles)


def lagged_pairs(df: DataFrame, x: str, keys: list[str], lags: int) -> DataFrame:
    """Pairs of values ``lag`` frames apart, for lags 1 to ``lags``."""
    later = df.select(*keys, F.col("frame_number").alias("__t"), F.col(x).alias("later"))
    early = df.select(*keys, "frame_number", F.col(x).alias("early"), F.explode(F.sequence(F.lit(1), F.lit(lags))).alias("lag"))
    return early.withColumn("__t", F.col("frame_number") + F.col("lag")).join(later, [*keys, "__t"]).drop("__t")
