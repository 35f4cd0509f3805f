"""Cross- and autocorrelation against sums of lagged products."""

import math

import numpy as np
import pytest

from driftloom.operators import statistics as st

ROWS = "k string, frame_number int, x double, y double"


def plain(series, frames, first, lags):
    x, y = (np.full(frames, np.nan) for _ in range(2))
    for t, a, b in series:
        x[t - first], y[t - first] = (np.nan if v is None else v for v in (a, b))
    sx, sy = (np.nanstd(v, ddof=1) if np.isfinite(v).sum() > 1 else 0 for v in (x, y))
    cx, cy = (np.nan_to_num(v - np.nanmean(v)) for v in (x, y))
    out = {}
    for lag in lags:
        total = sum(cx[t] * cy[t + lag] for t in range(frames) if 0 <= t + lag < frames)
        out[lag] = None if not sx * sy > 0 else total / (frames * sx * sy)
    return out


def test_cross_correlation_equals_lagged_products(spark):
    rng = np.random.default_rng(5)
    tracks = {}
    for k in range(5):
        frames = sorted(rng.choice(np.arange(3, 34), size=rng.integers(2, 31), replace=False).tolist())
        tracks[f"t{k}"] = [(t, float(rng.normal()), None if rng.random() < 0.1 else float(rng.normal())) for t in frames]
    tracks["flat"] = [(t, 2.0, float(t)) for t in range(3, 20)]
    tracks["one"] = [(3, 1.0, 1.0)]
    tracks["ends"] = [(3, 1.0, -1.0), (33, 4.0, 2.0)]
    df = spark.createDataFrame([(k, *r) for k, rows in tracks.items() for r in rows], ROWS)
    found = {(r.k, r.lag): r.ccf for r in st.cross_correlation(df, "x", "y", ["k"]).collect()}
    lags = range(-10, 11)
    assert set(found) == {(k, lag) for k in tracks for lag in lags}
    for k, rows in tracks.items():
        for lag, want in plain(rows, 31, 3, lags).items():
            assert found[k, lag] == (None if want is None else pytest.approx(want, abs=1e-12)), (k, lag)
    mirrored = {(r.k, -r.lag): r.ccf for r in st.cross_correlation(df, "y", "x", ["k"]).collect()}
    assert all(found[key] == (None if v is None else pytest.approx(v, abs=1e-12)) for key, v in mirrored.items())


def test_autocorrelation_is_the_positive_half(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([("a", t, float(v), 0.0) for t, v in enumerate(rng.normal(size=12))], ROWS)
    auto = {r.lag: r.acf for r in st.autocorrelation(df, "x", ["k"]).collect()}
    both = {r.lag: r.ccf for r in st.cross_correlation(df, "x", "x", ["k"]).collect()}
    assert set(auto) == {1, 2, 3, 4} and all(auto[k] == pytest.approx(both[k]) == pytest.approx(both[-k]) for k in auto)
    assert both[0] == pytest.approx(11 / 12)


def test_empty_tables_and_plans(spark):
    empty = spark.createDataFrame([], ROWS)
    assert st.cross_correlation(empty, "x", "y", ["k"]).count() == 0
    df = spark.createDataFrame([("a", t, float(t), 1.0) for t in range(9)], ROWS)
    plan = st.cross_correlation(df, "x", "y", ["k"])._jdf.queryExecution().toString()
    assert plan.count("hashpartitioning") == 1 and "Join" not in plan


def test_trajectories_are_taken_a_few_at_a_time():
    """The lags of a batch are never held at once; nulls are missing, constants and NaN have no correlation."""
    import pyarrow as pa

    from driftloom.operators.statistics import _correlated

    rows = [[(0, 1.0, 2.0), (1, 2.0, None), (3, 4.0, 1.0)], [(0, 5.0, 1.0), (1, 5.0, 2.0)], [(0, math.nan, 1.0), (1, 2.0, 2.0)], [(2, 1.0, 1.0)]] * 250
    struct = pa.struct([("frame_number", pa.int32()), ("x", pa.float64()), ("y", pa.float64())])
    made = pa.array([[dict(zip(("frame_number", "x", "y"), r, strict=True)) for r in row] for row in rows], pa.list_(struct))
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), made], ["id", "__rows"])
    out = list(_correlated(0, 4, 1)(iter([batch])))
    assert max(map(len, out)) <= 256 and pa.Table.from_batches(out).column("id").to_pylist() == list(range(1000))
    found = pa.Table.from_batches(out).column("ccf").to_pylist()
    x, y = np.array([-4, -1, 0, 5]) / 3, np.array([0.5, 0, 0, -0.5])
    want = np.array([x[1:] @ y[:-1], x @ y, x[:-1] @ y[1:]]) / (4 * np.std([1, 2, 4], ddof=1) * np.std([2, 1], ddof=1))
    assert np.allclose(found[0], want) and np.allclose(found[996], want) and found[1] is found[2] is found[3] is found[999] is None
