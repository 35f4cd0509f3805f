"""Fixed points: runs of zeros, seams, cells with several roots and curves of zeros."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import dynamics as dyn
from driftloom.operators.grid import Axis


def roots_1d(spark, drifts, axis):
    rows = [("d", i, axis.low + (i + 0.5) * axis.width, v) for i, v in enumerate(drifts)]
    field = spark.createDataFrame(rows, "key string, i0 int, x0 double, drift_0 double")
    return sorted((r[axis.column], r.stability) for r in dyn.fixed_points_1d(field, axis, ["key"]).collect())


@pytest.mark.parametrize(
    ("drifts", "want"),
    [
        ([1.0, -1.0, -1.0, 3.0], [(1.0, "stable"), (2.75, "unstable")]),
        ([2.0, 0.0, -2.0, -1.0], [(1.5, "stable")]),
        ([2.0, 0.0, 0.0, -2.0, -1.0], [(2.0, "stable")]),
        ([-1.0, 0.0, 0.0, 0.0, 4.0], [(2.5, "unstable")]),
        ([1.0, 0.0, 0.0, 1.0], []),
        ([0.0, 0.0, 1.0, 0.0], []),
        ([1.0, None, -1.0], []),
        ([1.0, 0.0, None, 0.0, -1.0], []),
        ([0.0, 0.0], []),
    ],
)
def test_roots_on_a_line(spark, drifts, want):
    assert roots_1d(spark, drifts, Axis("x", 0.0, 1.0, len(drifts))) == want


@pytest.mark.parametrize(
    ("drifts", "want"),
    [
        ([1.0, -1.0, -1.0, 1.0], [(1.0, "stable"), (3.0, "unstable")]),
        ([0.0, -1.0, -1.0, 1.0], [(0.5, "stable"), (3.0, "unstable")]),
        ([0.0, -2.0, -1.0, 2.0, 0.0], [(0.0, "stable"), (2.8333, "unstable")]),
        ([0.0, 0.0, -2.0, -1.0, 2.0, 0.0, 0.0], [(0.0, "stable"), (3.8333, "unstable")]),
        ([3.0, 1.0, 1.0, -1.0], [(3.0, "stable"), (3.75, "unstable")]),
        ([1.0, 2.0, 3.0, None], []),
        ([None, -1.0, 1.0, None], [(2.0, "unstable")]),
        ([1.0], []),
    ],
)
def test_roots_on_a_circle(spark, drifts, want):
    n = len(drifts)
    assert roots_1d(spark, drifts, Axis("x", 0.0, 1.0, n, float(n))) == want


def corners(*functions):
    d = len(functions)
    grid = np.stack(np.meshgrid(*[[0.0, 1.0]] * d, indexing="ij"), axis=-1)
    return np.stack([f(*np.moveaxis(grid, -1, 0)) for f in functions], axis=-1)


@pytest.mark.parametrize(
    ("functions", "want"),
    [
        # Two roots, with a singular Jacobian in the middle of the cell, and without.
        ((lambda u, v: u * v - 0.12, lambda u, v: u + v - 0.7), [(0.3, 0.4), (0.4, 0.3)]),
        ((lambda u, v: u * v - 0.12, lambda u, v: u + 1.3 * v - 0.79), [(0.4, 0.3), (0.39, 0.12 / 0.39)]),
        ((lambda u, v: u - 0.25, lambda u, v: v - 0.75), [(0.25, 0.75)]),
        ((lambda u, v: u - v, lambda u, v: u + v), [(0.0, 0.0)]),
        ((lambda u, v: u * v - 0.12, lambda u, v: u + v - 0.6), []),
        # A double root.
        ((lambda u, v: u * v - 0.09, lambda u, v: u + v - 0.6), [(0.3, 0.3)]),
        ((lambda u, v, w: u * v - 0.12, lambda u, v, w: u + v - 0.7, lambda u, v, w: w - 0.5), [(0.3, 0.4, 0.5), (0.4, 0.3, 0.5)]),
        ((lambda u, v, w: u - 0.1, lambda u, v, w: v * w - 0.06, lambda u, v, w: u + v + w - 0.6), [(0.1, 0.2, 0.3), (0.1, 0.3, 0.2)]),
    ],
)
def test_all_roots_of_a_cell(functions, want):
    found = sorted(tuple(u) for u, _ in dyn.cell_roots(corners(*functions)))
    assert len(found) == len(want)
    assert np.allclose(np.array(found).reshape(-1, len(functions)), np.array(sorted(want)).reshape(-1, len(functions)), atol=2e-4)


def test_curves_of_zeros_are_one_root_a_cell():
    for second in (lambda u, v: u - v, lambda u, v: 2 * u - 2 * v, lambda u, v: 0 * u):
        (found,) = dyn.cell_roots(corners(lambda u, v: u - v, second))
        assert np.allclose(found[0], 0.5, atol=0.01)


def test_random_cells_equal_the_closed_form():
    rng = np.random.default_rng(4)
    several = 0
    for _ in range(300):
        c = rng.normal(size=(2, 2, 2))
        (a1, a2), (b1, b2), (c1, c2) = c[0, 0], c[1, 0] - c[0, 0], c[0, 1] - c[0, 0]
        e1, e2 = c[1, 1] - c[1, 0] - c[0, 1] + c[0, 0]
        want = []
        for v in np.roots([c1 * e2 - c2 * e1, a1 * e2 + c1 * b2 - a2 * e1 - c2 * b1, a1 * b2 - a2 * b1]):
            u = -(a1 + c1 * v) / (b1 + e1 * v)
            if abs(v.imag) < 1e-12 and 0 <= v.real <= 1 and 0 <= u.real <= 1:
                want.append((u.real, v.real))
        found = sorted(tuple(u) for u, _ in dyn.cell_roots(c))
        assert len(found) == len(want) and np.allclose(np.array(found).reshape(-1, 2), np.array(sorted(want)).reshape(-1, 2), atol=1e-5)
        several += len(want) == 2
    assert several > 3


def test_roots_on_faces_and_seams_count_once(spark):
    axes = [Axis("a", 0.0, 1.0, 4, 4.0), Axis("b", 0.0, 1.0, 3)]
    first = [0.0, -1.0, 0.0, 1.0]  # zero on the grid lines a = 0.5 (stable) and a = 2.5 (unstable)
    rows = [("d", i, j, first[i], 1.0 - j) for i in range(4) for j in range(3)]  # zero at b = 1.5
    field = spark.createDataFrame(rows, "key string, i0 int, i1 int, drift_0 double, drift_1 double")
    found = sorted((r.a, r.b, r.stability) for r in dyn.fixed_points_nd(field, axes, ["key"]).collect())
    assert found == [(0.5, 1.5, "stable"), (2.5, 1.5, "saddle")]


def test_bounds_and_summaries_on_a_circle(spark):
    """Values on both sides of the seam at 0 = 10: the interval runs over it, and means do not fall to the other side."""
    axis, line = Axis("a", 0.0, 1.0, 10, 10.0), Axis("x", 0.0, 1.0, 10)
    rows = [("g", 1, b, (9.5 + b / 100) % 10, float(b)) for b in range(101)] + [("g", 2, 0, 3.0, 1.0), ("g", 3, 0, 2.0, 1.0), ("g", 3, 1, 7.0, 3.0)]
    hits = spark.createDataFrame(rows, "g string, point_id int, replicate int, a double, x double")
    base = hits.select("g", "point_id").distinct().unionByName(spark.createDataFrame([("g", 4)], "g string, point_id int"))
    out = {r.point_id: r for r in dyn.match_summary(base, hits, ["g"], [axis, line], 101).collect()}
    assert (out[1].a_low, out[1].a_high, out[1].x_low, out[1].x_high) == pytest.approx((9.55, 0.45, 5.0, 95.0))
    assert min(out[1].a_mean, 10 - out[1].a_mean) == pytest.approx(0, abs=1e-9) and out[1].detection_rate == 1
    # One hit gives no interval, opposite hits no mean angle, and none at all nothing.
    assert (out[2].hits, out[2].a_low, out[2].x_high, out[2].a_mean) == (1, None, None, pytest.approx(3.0))
    assert out[3].a_mean is None and out[3].x_mean == 2.0
    assert (out[4].hits, out[4].a_mean, out[4].a_low, out[4].detection_rate) == (None, None, None, 0.0)
    bounds = dyn.percentile_bounds(hits.where("point_id = 1"), [axis, line], ["g"])
    points = spark.createDataFrame([("g", 9.9, 50.0), ("g", 0.2, 50.0), ("g", 5.0, 50.0), ("g", 0.2, 99.0)], "g string, a double, x double")
    assert sorted(r.a for r in dyn.within_bounds(points, bounds, ["g"], [axis, line]).collect()) == [0.2, 9.9]
    # An axis that begins elsewhere: the same circle from -5 to 5.
    moved = dyn.percentile_bounds(hits.where("point_id = 1").withColumn("a", F.when(F.col("a") >= 5, F.col("a") - 10).otherwise(F.col("a"))), [Axis("a", -5.0, 1.0, 10, 10.0)], ["g"]).first()
    assert (moved.lo_a, moved.hi_a) == pytest.approx((-0.45, 0.45))


def test_box_means(spark):
    df = spark.createDataFrame([("g", i, i / 100, float(i % 7) if i != 30 else None) for i in range(100)], "g string, id int, x double, v double")
    points = spark.createDataFrame([("g", "p", 0.3), ("g", "q", 0.0), ("g", "far", 9.0)], "g string, pt string, c double")
    out = {r.pt: r for r in dyn.box_means(df, "v", "id", points, ["g"], "pt", [("x", "c")], [0.2], 500).collect()}
    want = [i % 7 for i in range(100) if 0.2 <= i / 100 < 0.4 and i != 30]
    p = out["p"]
    assert p.n == len(want) and p.mean == pytest.approx(sum(want) / len(want))
    # Means of n draws have the values' spread over the root of n; the interval is 2 * 1.645 of that.
    spread = np.std(want) / np.sqrt(len(want))
    assert p.high - p.low == pytest.approx(2 * 1.645 * spread, rel=0.15) and p.low < p.mean < p.high
    assert (out["far"].n, out["far"].mean, out["far"].low) == (0, None, None) and out["q"].n == 10
    alone = dyn.box_means(df.where("id = 0"), "v", "id", points, ["g"], "pt", [("x", "c")], [0.2], 50).where("pt = 'q'").first()
    assert (alone.n, alone.mean, alone.low, alone.high) == (1, 0.0, None, None)
