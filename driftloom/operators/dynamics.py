"""Drift fields from trajectories, their fixed points, and bootstrap intervals.

Everything is a long table keyed by the groups one likes (data set, condition, patch type, replicate), so that many fields come
from one job.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators.aggregates import circular_mean, resultant
from driftloom.operators.grid import Axis, histogram, integral, smoothed
from driftloom.operators.joins import rows_in_boxes
from driftloom.operators.ranks import circular_percentile, percentiles
from driftloom.operators.resampling import multiplicity_arrays, resampled_sums
from driftloom.operators.windows import TRACK, forward_differences
from driftloom.sources.scratch import settled

LEAST_DENSITY = 1e-10


def moments(df: DataFrame, axes: list[Axis], keys: list[str], lag: int = 1, track: list[str] = TRACK) -> DataFrame:
    """Kramers-Moyal moments of displacements, binned where they start: m0 (count), m1_k and m2_k (sums of d and d squared)."""
    periods = {a.column: a.period for a in axes if a.period}
    steps = forward_differences(df, [a.column for a in axes], lag, periods, track)
    weights: dict[str, Column] = {"m0": F.lit(1.0)}
    for k, a in enumerate(axes):
        d = F.col("d_" + a.column)
        weights |= {f"m1_{k}": d, f"m2_{k}": d * d}
    return histogram(steps, axes, weights, keys)


def normalized_density(smooth: DataFrame, axes: list[Axis], keys: list[str], weight: str = "m0") -> DataFrame:
    """``density``: the smoothed weight over its trapezoid integral, by key."""
    total = smooth.groupBy(*keys).agg(integral(F.col(weight), axes).alias("__all")) if keys else smooth.agg(integral(F.col(weight), axes).alias("__all"))
    rows = smooth.join(total, keys) if keys else smooth.crossJoin(F.broadcast(total))
    return rows.withColumn("density", F.col(weight) / F.nullif(F.col("__all"), F.lit(0.0))).drop("__all")


def field_of(hist: DataFrame, axes: list[Axis], kernels: list[tuple[str, float]], dt: float, keys: list[str]) -> DataFrame:
    """(keys, cell, density, drift_k, diffusion_k) from moments; drift is null where the density is next to nothing."""
    values = ["m0", *(f"m{p}_{k}" for k in range(len(axes)) for p in (1, 2))]
    rows = normalized_density(smoothed(hist, axes, kernels, values, keys), axes, keys)
    dense = F.col("density") >= LEAST_DENSITY
    out = {}
    for k in range(len(axes)):
        out[f"x{k}"] = axes[k].center(F.col(f"i{k}"))
        out[f"drift_{k}"] = F.when(dense, F.col(f"m1_{k}") / (F.col("m0") * dt))
        out[f"diffusion_{k}"] = F.when(dense, F.col(f"m2_{k}") / (2 * F.col("m0") * dt))
    return rows.withColumns(out).drop(*values)


def drift_field(df: DataFrame, axes: list[Axis], kernels: list[tuple[str, float]], dt: float, keys: list[str], lag: int = 1, track: list[str] = TRACK) -> DataFrame:
    return field_of(moments(df, axes, keys, lag, track), axes, kernels, dt, keys)


def density_of(df: DataFrame, axes: list[Axis], kernels: list[tuple[str, float]], keys: list[str]) -> DataFrame:
    """Kernel density estimate of rows on a grid."""
    hist = histogram(df, axes, {"m0": F.lit(1.0)}, keys)
    return normalized_density(smoothed(hist, axes, kernels, ["m0"], keys), axes, keys).drop("m0")


def masked_by_density(field: DataFrame, density: DataFrame, cells: list[str], drifts: list[str], least: float) -> DataFrame:
    """The field with null drift where the density is below a limit or unknown."""
    rows = field.join(density.select(*cells, F.col("density").alias("__p")), cells, "left")
    return rows.withColumns({d: F.when(F.col("__p") >= least, F.col(d)) for d in drifts}).drop("__p")


def filled(field: DataFrame, drifts: list[str]) -> DataFrame:
    return field.fillna(0.0, drifts)


def fixed_points_1d(field: DataFrame, axis: Axis, keys: list[str], x: str = "x0", drift: str = "drift_0", i: str = "i0") -> DataFrame:
    """Roots of a field that is linear between neighbouring cells, with their stability.

    A root is a sign change between neighbours, or the middle of a run of cells of zero drift between cells of opposite drift.
    Falling drift is stable, rising unstable. Cells without a drift part their neighbours. A periodic axis closes on itself, and
    a run may go over its seam.
    """
    w = Window.partitionBy(*keys).orderBy(i)
    known = field.where(F.col(drift).isNotNull())
    known = known.withColumns({"__rn": F.row_number().over(w), "__all": F.count("*").over(Window.partitionBy(*keys))})
    rows = known.where(F.col(drift) != 0)
    after = {"__ni": i, "__nx": x, "__nv": drift, "__nrn": "__rn"}
    following = {name: F.lead(c).over(w) for name, c in after.items()}
    if axis.period:
        ends = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        turn = {"__ni": F.lit(axis.n), "__nx": F.lit(axis.n * axis.width), "__nv": F.lit(0.0), "__nrn": F.col("__all")}
        following = {name: F.coalesce(following[name], F.first(c).over(ends) + turn[name]) for name, c in after.items()}
    rows = rows.withColumns(following)
    here, there, apart = F.col(drift), F.col("__nv"), F.col("__ni") - F.col(i)
    rows = rows.where((apart == F.col("__nrn") - F.col("__rn")) & (here * there < 0))
    share = F.when(apart == 1, -here / (there - here)).otherwise(0.5)
    root = F.col(x) + share * (F.col("__nx") - F.col(x))
    if axis.period:
        root = F.pmod(root - F.lit(axis.low), F.lit(axis.period)) + F.lit(axis.low)
    return rows.select(*keys, F.round(root, 4).alias(axis.column), F.when(there < here, "stable").otherwise("unstable").alias("stability"))


def stability_of(jacobian: np.ndarray) -> str:
    """Stability from the real parts of a Jacobian's eigenvalues."""
    real = np.linalg.eigvals(jacobian).real
    if np.allclose(real, 0):
        return "indeterminate"
    if real.min() < 0 < real.max():
        return "saddle"
    return "stable" if real.max() < 0 else "unstable"


#: Halvings of a cell, and boxes that are looked at together; beyond either, boxes that touch count as one root.
HALVINGS, BOXES = 24, 4096
EDGE = 1e-9


def _values(corners: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A multilinear field and its Jacobian at the points u (m, d) of the unit cell; corners have shape (2,) * d + (d,)."""
    d = corners.ndim - 1

    def parts(skip=None):
        value = np.broadcast_to(corners, (len(u), *corners.shape))
        for k in range(d):
            t = u[:, k].reshape(-1, *[1] * (value.ndim - 2))
            value = value[:, 1] - value[:, 0] if k == skip else value[:, 0] * (1 - t) + value[:, 1] * t
        return value

    return parts(), np.stack([parts(k) for k in range(d)], axis=2)


def _polished(corners: np.ndarray, u: np.ndarray, steps: int = 40) -> np.ndarray | None:
    """Newton's method from u; None where it does not settle."""
    scale = max(np.abs(corners).max(), np.finfo(float).tiny)
    for _ in range(steps):
        f, j = (x[0] for x in _values(corners, u[None]))
        if np.abs(f).max() <= 1e-13 * scale:
            return u
        try:
            u = u - np.linalg.solve(j, f)
        except np.linalg.LinAlgError:
            return None
        if not np.isfinite(u).all() or np.abs(u).max() > 1e3:
            return None
    return u if np.abs(_values(corners, u[None])[0]).max() <= 1e-9 * scale else None


def _one_to_one(values: np.ndarray, d: int) -> bool:
    """Whether a multilinear field is surely one to one in a box, from its values at the box's corners.

    Its derivatives along an axis lie between those of the box's edges. Divided by the middle Jacobian they must dominate on the diagonal.
    """
    cube = values.reshape((2,) * d + (d,))
    slopes = [np.diff(cube, axis=k).reshape(-1, d) for k in range(d)]
    middle = np.stack([s.mean(axis=0) for s in slopes], axis=1)
    if not np.isfinite(middle).all() or np.linalg.cond(middle) > 1e12:
        return False
    turned = [np.linalg.solve(middle, s.T) for s in slopes]
    return all(turned[i][i].min() > sum(np.abs(turned[k][i]).max() for k in range(d) if k != i) for i in range(d))


def cell_roots(corners: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """All roots of a multilinear field in the unit cell with their Jacobians, by subdivision.

    A box where some component keeps its sign at all corners holds no root. One in which the field is one to one holds at most
    one, which Newton's method finds. Others are halved along every axis. Boxes that are left when ``HALVINGS`` or ``BOXES`` is reached
    hold a double root or lie along a curve of zeros: those that touch become one root in their middle.
    """
    d = corners.ndim - 1
    unit = np.array(list(product((0, 1), repeat=d)), dtype=float)
    low, size, found, left = np.zeros((1, d)), 1.0, [], np.empty((0, d))
    for depth in range(HALVINGS + 1):
        values = _values(corners, (low[:, None, :] + unit * size).reshape(-1, d))[0].reshape(len(low), -1, d)
        change = ((values.min(axis=1) <= 0) & (values.max(axis=1) >= 0)).all(axis=1)
        low, values, left = low[change], values[change], []
        for at, v in zip(low, values, strict=True):
            root = _polished(corners, at + size / 2) if _one_to_one(v, d) else None
            if root is None:
                left.append(at)
            elif (root >= at - EDGE).all() and (root <= at + size + EDGE).all():
                found.append(root)
        left = np.array(left).reshape(-1, d)
        if not len(left) or depth == HALVINGS or len(left) * 2**d > BOXES:
            break
        size /= 2
        low = (left[:, None, :] + unit * size).reshape(-1, d)
    found += [group.mean(axis=0) + size / 2 for group in _touching(left, size)]
    distinct: list[np.ndarray] = []
    for u in (np.where(np.abs(u - np.round(u)) < 1e-7, np.round(u), u) for u in found):
        if not any(np.abs(u - v).max() < 1e-6 for v in distinct):
            distinct.append(u)
    return [(u, _values(corners, u[None])[1][0]) for u in distinct]


def _touching(low: np.ndarray, size: float) -> list[np.ndarray]:
    """Groups of boxes that touch."""
    place = {tuple(p): k for k, p in enumerate(np.round(low / size).astype(int).tolist())}
    groups = []
    while place:
        todo, group = [next(iter(place))], []
        group.append(place.pop(todo[0]))
        while todo:
            here = todo.pop()
            for step in product((-1, 0, 1), repeat=len(here)):
                other = tuple(a + b for a, b in zip(here, step, strict=True))
                if other in place:
                    group.append(place.pop(other))
                    todo.append(other)
        groups.append(low[group])
    return groups


def fixed_points_nd(field: DataFrame, axes: list[Axis], keys: list[str]) -> DataFrame:
    """Roots of a field that is linear along each axis inside the cells between grid points, with their stability.

    Only cells on whose corners every component changes sign or touches zero go to Python; ``cell_roots`` finds all roots of each.
    A root on a face of several cells counts once. Where the field vanishes along a curve, each cell has one root of it.
    """
    d = len(axes)
    index = [f"i{k}" for k in range(d)]
    rows = field.where(reduce(lambda a, b: a & b, (F.col(f"drift_{k}").isNotNull() for k in range(d))))
    offsets = F.explode(F.array(*(F.struct(*(F.lit(o).alias(f"o{k}") for k, o in enumerate(p))) for p in product((0, 1), repeat=d))))
    rows = rows.withColumn("o", offsets)
    base = [F.col(f"i{k}") - F.col(f"o.o{k}") for k in range(d)]
    base = [F.pmod(b, F.lit(a.n)) if a.period else b for b, a in zip(base, axes, strict=True)]
    rows = rows.select(*keys, *(b.alias(n) for b, n in zip(base, index, strict=True)), F.struct("o", F.array(*(f"drift_{k}" for k in range(d))).alias("v")).alias("c"))
    corners = rows.groupBy(*keys, *index).agg(F.array_sort(F.collect_list("c")).alias("c"), *(F.min(F.col("c.v")[k]).alias(f"lo{k}") for k in range(d)), *(F.max(F.col("c.v")[k]).alias(f"hi{k}") for k in range(d)))
    change = reduce(lambda a, b: a & b, ((F.col(f"lo{k}") <= 0) & (F.col(f"hi{k}") >= 0) for k in range(d)))
    candidates = corners.where((F.size("c") == 2**d) & change).select(*keys, *index, F.transform("c", lambda x: x["v"]).alias("v"))
    names = [a.column for a in axes]
    schema = T.StructType([*(candidates.schema[k] for k in keys), *(T.StructField(n, T.DoubleType()) for n in names), T.StructField("stability", T.StringType())])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                for u, j in cell_roots(np.array([list(v) for v in row["v"]], dtype=float).reshape((2,) * d + (d,))):
                    # Whole turns are taken off in cells, so that both sides of a face or seam give the same number.
                    cells = [row[i] + 0.5 + t for i, t in zip(index, u, strict=True)]
                    x = [a.low + (c % a.n if a.period else c) * a.width for a, c in zip(axes, cells, strict=True)]
                    # Slopes by cell become slopes by unit; a cell's width is positive, so signs stay.
                    out.append([*(row[k] for k in keys), *np.round(x, 4), stability_of(j / np.array([a.width for a in axes])[None, :])])
            yield pd.DataFrame(out, columns=schema.names)

    return candidates.mapInPandas(solve, schema).dropDuplicates([*keys, *names])


def percentile_bounds(df: DataFrame, axes: list[Axis], keys: list[str], low: float = 5, high: float = 95) -> DataFrame:
    """``keys`` with lo_<column> and hi_<column> of each axis; those of periodic axes run along the circle, so the low one may be above.

    Keys without a value on some axis have no row.
    """
    out = None
    for a in axes:
        if a.period:
            # Counted from the axis's start, as percentiles of a circle lie in [0, period).
            found = circular_percentile(df.withColumn("__v", F.col(a.column) - F.lit(a.low)), keys, "__v", [low, high], a.period)
            p = [F.col("percentiles")[i] + F.lit(a.low) for i in range(2)]
        else:
            found = percentiles(df, keys, a.column, [low, high], "percentiles")
            p = [F.col("percentiles")[i] for i in range(2)]
        found = found.select(*keys, p[0].alias("lo_" + a.column), p[1].alias("hi_" + a.column))
        out = found if out is None else out.join(found, keys)
    return out


def within_bounds(points: DataFrame, bounds: DataFrame, keys: list[str], axes: list[Axis]) -> DataFrame:
    """Points inside the box of percentiles: ``bounds`` has lo_<column> and hi_<column>; a periodic box may wrap."""
    from driftloom.operators.filters import inside_box

    rows = points.join(bounds, keys)
    return rows.where(reduce(lambda a, b: a & b, (inside_box(F.col(x.column), F.col("lo_" + x.column), F.col("hi_" + x.column)) for x in axes))).select(*points.columns)


def bootstrap_density(df: DataFrame, axis: Axis, kernel: tuple[str, float], keys: list[str], track: str, replicates: int, draws: DataFrame | None = None) -> DataFrame:
    """(keys, i0, mean, low, high) of the kernel density over replicates of drawn trajectories, with the 5 to 95 % band."""
    per_track = histogram(df, [axis], {"m0": F.lit(1.0)}, [*keys, track])
    # Settled, as the smoothed sums are met with their own totals.
    rows = settled(resampled_sums(per_track, multiplicity_arrays(df, keys, track, replicates, draws=draws), keys, track, ["i0"], ["m0"]))
    one = [*keys, "replicate"]
    density = normalized_density(smoothed(rows, [axis], [kernel], ["m0"], one), [axis], one)
    # A group holds a value a replicate, so it is bounded.
    p = F.percentile("density", F.array(F.lit(0.05), F.lit(0.95)))
    return density.groupBy(*keys, "i0").agg(F.avg("density").alias("mean"), p[0].alias("low"), p[1].alias("high"))


def bootstrap_field(df: DataFrame, axes: list[Axis], kernels: list[tuple[str, float]], dt: float, keys: list[str], track: str, replicates: int) -> DataFrame:
    """The drift field of every replicate. Histograms by trajectory are computed once; a replicate sums them by multiplicity."""
    per_track = moments(df, axes, [*keys, track])
    values = ["m0", *(f"m{p}_{k}" for k in range(len(axes)) for p in (1, 2))]
    cells = [f"i{k}" for k in range(len(axes))]
    # Settled, as the smoothed sums are met with their own totals.
    rows = settled(resampled_sums(per_track, multiplicity_arrays(df, keys, track, replicates), keys, track, cells, values))
    return field_of(rows, axes, kernels, dt, [*keys, "replicate"])


def match_summary(baseline: DataFrame, matched: DataFrame, keys: list[str], axes: list[Axis], replicates: int) -> DataFrame:
    """Per baseline point: cluster mean, 5 to 95 % interval for two or more hits, and detection rate.

    On periodic axes the mean is that of angles and the interval runs along the circle from its low end to its high end, so that the low end
    may be the larger number; a mean of hits that balance out is null.
    """
    point = [*keys, "point_id"]
    aggs = [F.count("*").alias("hits")]
    for a in axes:
        x = F.col(a.column)
        if a.period:
            aggs.append(F.when(resultant(x, a.low, a.low + a.period) > 1e-9, circular_mean(x, a.low, a.low + a.period)).alias(a.column + "_mean"))
        else:
            # A group holds a hit a replicate at most, so it is bounded.
            p = F.percentile(x, F.array(F.lit(0.05), F.lit(0.95)))
            aggs += [F.avg(x).alias(a.column + "_mean"), p[0].alias(a.column + "_low"), p[1].alias(a.column + "_high")]
    out = baseline.select(*point).join(matched.groupBy(*point).agg(*aggs), point, "left")
    for a in axes:
        if a.period:
            ends = percentile_bounds(matched, [a], point).withColumnsRenamed({"lo_" + a.column: a.column + "_low", "hi_" + a.column: a.column + "_high"})
            out = out.join(ends, point, "left")
    bounds = {f"{a.column}_{e}": F.when(F.col("hits") >= 2, F.col(f"{a.column}_{e}")) for a in axes for e in ("low", "high")}
    return out.withColumns(bounds).withColumn("detection_rate", F.coalesce("hits", F.lit(0)) / replicates)


def box_means(df: DataFrame, value: str, row: str, points: DataFrame, keys: list[str], point: str, axes: list[tuple[str, str]], sides: list[float], replicates: int) -> DataFrame:
    """Points with n, the number of rows in the box around each, the mean of their values, and the 5 to 95 % interval of means of as many
    rows drawn from them.

    ``row`` tells rows apart and ``point`` tells points apart, over all keys. Boxes are half-open and rows without a value do not count. A box without
    rows has no mean, one with a single row no interval.
    """
    inside = settled(rows_in_boxes(df.where(F.col(value).isNotNull()), points, keys, [point], axes, sides).select(point, row, F.col(value).cast("double").alias("s"), F.lit(1).alias("n")))
    sums = resampled_sums(inside, multiplicity_arrays(inside, [point], row, replicates), [point], row, [], ["s", "n"])
    # A group holds a mean a replicate, so it is bounded.
    p = F.percentile(F.col("s") / F.col("n"), F.array(F.lit(0.05), F.lit(0.95)))
    ends = sums.groupBy(point).agg(p[0].alias("low"), p[1].alias("high"))
    rows = points.join(inside.groupBy(point).agg(F.count("*").alias("n"), F.avg("s").alias("mean")), point, "left").join(ends, point, "left")
    return rows.withColumns({"n": F.coalesce("n", F.lit(0)), **{e: F.when(F.col("n") >= 2, F.col(e)) for e in ("low", "high")}})


def angle_between(a: DataFrame, b: DataFrame, cells: list[str], parts: list[str]) -> DataFrame:
    """Angle and dot product of two fields, cell by cell."""
    from driftloom.functions.angles import vector_angle

    both = a.select(*cells, *parts).join(b.select(*cells, *(F.col(p).alias("__" + p) for p in parts)), cells)
    x, y = [F.col(p) for p in parts], [F.col("__" + p) for p in parts]
    dot = sum((s * t for s, t in zip(x, y, strict=True)), F.lit(0.0))
    return both.select(*cells, vector_angle(x, y).alias("angle"), dot.alias("dot"))
