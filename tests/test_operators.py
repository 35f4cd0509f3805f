"""Literal cases of operators, planted dynamics and errors."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.functions import angles as A
from driftloom.functions import arrays as R
from driftloom.functions import text as S
from driftloom.operators import aggregates as agg
from driftloom.operators import annotations as ann
from driftloom.operators import catalog as cat
from driftloom.operators import dynamics as dyn
from driftloom.operators import features as feat
from driftloom.operators import filters as flt
from driftloom.operators import grid, guards, ranks
from driftloom.operators import joins as jn
from driftloom.operators import regions as reg
from driftloom.operators import statistics as st
from driftloom.operators import windows as win
from driftloom.operators.planes import plane_basis
from driftloom.operators.sampling import split_rows
from driftloom.sources import files


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns, by=None):
    return [tuple(r) if len(columns) > 1 else r[0] for r in df.orderBy(*(by or columns)).select(*columns).collect()]


@pytest.fixture
def settings(spark):
    rows = frame(spark, [("d", p, f) for p in (1, 3, 5) for f in range(4)], "dataset string, position int, frame_number int")
    datasets = frame(spark, [("d", 4)], "dataset string, duration int")
    dust = frame(spark, [("d", 1, "dust")], "dataset string, position int, annotation string")
    marks = [("d", 1, "not_steady_state", 0, 1), ("d", 3, "not_steady_state", 0, 1), ("d", 5, "not_steady_state", 0, 0), ("d", 3, "cell_piling", 2, 3), ("d", 5, "cell_piling", 3, 3), ("d", 1, "scope_error", 1, 1)]
    return rows, datasets, dust, frame(spark, marks, "dataset string, position int, annotation string, start_frame int, stop_frame int")


@pytest.mark.parametrize(
    ("positions", "frames", "want"),
    [
        (["dust"], ["not_steady_state"], [(3, 2), (3, 3), (5, 1), (5, 2), (5, 3)]),
        ([], None, [(1, 2), (1, 3), (5, 1), (5, 2)]),
        (None, None, [(5, 1), (5, 2)]),
        ([], [], [(p, f) for p in (1, 3, 5) for f in range(4)]),
    ],
)
def test_annotation_filter(settings, positions, frames, want):
    rows, datasets, dust, marks = settings
    assert values(flt.by_annotations(rows, datasets, rows, dust, marks, positions, frames), "position", "frame_number") == want


def test_annotation_helpers(settings):
    rows, datasets, dust, marks = settings
    assert values(ann.annotated_positions(dust), "position") == [1]
    assert values(ann.unannotated_positions(rows, dust), "position") == [3, 5]
    assert values(ann.steady_start(rows, datasets, marks), "position", "start") == [(1, 2), (3, 2), (5, 1)]
    assert ann.except_kinds(marks, ["cell_piling"]).count() == 4


def test_conditions(spark):
    flow = frame(spark, [("d", 0, 0, 1, 1.0), ("d", 1, 2, 3, 2.0)], "dataset string, ordinal int, start_frame int, stop_frame int, shear_stress double")
    rows = frame(spark, [("d", f) for f in range(5)], "dataset string, frame_number int")
    assert values(flt.with_condition(rows, flow), "frame_number", "shear_stress") == [(0, 1.0), (1, 1.0), (2, 2.0), (3, 2.0), (4, 2.0)]
    assert values(ann.flow_at(rows, flow), "frame_number", "shear_stress")[-1] == (4, None)
    assert tuple(ann.flow_change(flow).first()) == ("d", 1, 2)


def test_track_length(spark):
    df = frame(spark, [(i,) for i in range(1, 6)], "track_duration int")
    assert values(flt.by_track_length(df, 3), "track_duration") == [3, 4, 5]
    with pytest.raises(ValueError):
        flt.by_track_length(df, 9, strict=True)


@pytest.mark.parametrize(("x", "want"), [(0.2, "ab"), (0.5, "c"), (0.7, "de"), (1.0, "de")])
def test_same_bin(spark, x, want):
    df = frame(spark, list(zip("abcde", (0.1, 0.3, 0.6, 0.8, 0.9), strict=True)), "name string, feat double")
    edges = {"feat": [0, 1 / 3, 2 / 3, 1.0]}
    assert "".join(values(flt.in_same_bin(df, {"feat": x}, edges), "name")) == want
    with pytest.raises(ValueError):
        flt.in_same_bin(df, {"feat": 1.5}, edges)


@pytest.mark.parametrize(
    ("t", "x", "lag", "want"),
    [((0, 1, 2, 3), (1, 2, 4, 7), 1, [(1, 1), (2, 2), (4, 3)]), ((0, 2, 3), (1, 2, 3), 1, [(2, 1)]), ((0, 1, 2, 3), (1, 2, 4, 7), 2, [(1, 3), (2, 5)]), ((0, 1, 3), (1, 2, 4), 2, []), ((0,), (1,), 1, [])],
)
def test_forward_difference(spark, t, x, lag, want):
    df = frame(spark, [("c", a, float(b)) for a, b in zip(t, x, strict=True)], "crop string, frame_number int, x double")
    assert values(win.forward_differences(df, ["x"], lag, keys=["crop"]), "x", "d_x") == want


def test_periodic_step_takes_the_short_way(spark):
    e = 0.05
    df = frame(spark, [("c", 0, math.pi / 2 - e), ("c", 1, -(math.pi / 2 - e)), ("c", 2, 0.0)], "crop string, frame_number int, x double")
    out = values(win.forward_differences(df, ["x"], 1, {"x": math.pi}, ["crop"]), "frame_number", "d_x")
    assert out[0][1] == pytest.approx(2 * e)
    two = win.forward_differences(df, ["x"], 2, {"x": math.pi}, ["crop"]).first()
    assert two.d_x == pytest.approx(sum(d for _, d in out))


def test_unwrap_equals_numpy(spark):
    x = np.random.default_rng(0).uniform(0, math.pi, 50)
    df = frame(spark, [("c", i, float(v)) for i, v in enumerate(x)], "crop string, frame_number int, x double")
    got = values(win.with_unwrapped(df, "x", math.pi, "u", ["crop"]), "u", by=["frame_number"])
    assert np.allclose(got, np.unwrap(x, period=math.pi))


def test_angles(spark):
    one = spark.range(1)
    c = {
        "a": A.rewrap(F.lit(-0.5), 0.0, math.pi), "b": A.smallest_difference(F.lit(350.0), F.lit(10.0)), "c": A.smallest_difference(F.lit(180.0), F.lit(0.0)), "d": A.shear_bin(F.lit(4.5)), "e": A.shear_bin(F.lit(7.5)),
        "f": A.unwrapped_step(F.lit(math.pi / 2), math.pi), "g": A.wrapped_difference(F.lit(math.pi / 2), math.pi),
    }
    r = one.select(*(v.alias(k) for k, v in c.items())).first()
    assert r.a == pytest.approx(math.pi - 0.5) and r.b == -20 and r.c == -180 and (r.d, r.e) == (6, 6)
    assert r.f == math.pi / 2 and r.g == -math.pi / 2
    for bad in (("gaussian", 0.0, None), ("periodic", 1.0, None), ("gaussian", 1.0, 2.0), ("box", 1.0, None)):
        with pytest.raises(ValueError):
            A.kernel(bad[0], F.lit(1.0), bad[1], bad[2])


def test_a_difference_just_below_the_seam_stays_at_the_upper_end(spark):
    below = -180 - 2.0**-45
    row = spark.range(1).select(A.smallest_difference(F.lit(below), F.lit(0.0)).alias("a"), A.rewrap(F.lit(-(2.0**-60)), 0.0, 360.0).alias("b"), A.rewrap(F.lit(1e30), 0.0, 360.0).alias("c")).first()
    assert row.a == pytest.approx(180) and row.b == pytest.approx(360) and 0 <= row.c < 360


def test_counts_in_crowded_boxes(spark):
    rng = np.random.default_rng(3)
    points = [("a", float(x), int(y)) for x, y in zip(rng.integers(0, 60, 400) / 4, rng.integers(0, 12, 400), strict=True)] + [("a", 1.0, 2)] * 50 + [("b", math.nan, 1), ("b", None, 1), (None, 1.0, 1)]
    boxes = [("a", i, float(x), float(x) + 5, int(y), int(y) + 3) for i, (x, y) in enumerate(rng.integers(-3, 15, (90, 2)))] + [("b", 90, 0.0, 9.0, 0, 9), ("c", 91, 0.0, 9.0, 0, 9), (None, 92, 0.0, 9.0, 0, 9), ("a", 93, None, 9.0, 0, 9), ("a", 94, 9.0, 0.0, 0, 9)]
    p, b = frame(spark, points, "k string, x double, y int"), frame(spark, boxes, "k string, id int, x0 double, x1 double, y0 int, y1 int")
    axes = [("x", "x0", "x1"), ("y", "y0", "y1")]
    for n in (1, 2):
        want = [(i, sum(q[0] == k and k is not None and None not in (q[1], x0) and x0 <= q[1] <= x1 and (n == 1 or y0 <= q[2] <= y1) for q in points)) for k, i, x0, x1, y0, y1 in boxes]
        assert values(jn.count_in_boxes(b, p, ["k"], axes[:n], 4.0, ["id"]), "id", "n_points") == want
        # A crowded tile is cut into parts, and pairs of parts add up.
        assert values(jn.count_in_boxes(b, p, ["k"], axes[:n], 4.0, ["id"], part=16), "id", "n_points") == want
    with pytest.raises(ValueError):
        jn.count_in_boxes(b, p, ["k"], [], 4.0, ["id"])


def test_a_point_at_half_the_side_is_in_the_box(spark):
    # The bound of the box is a little above the point, but their rounded distance is half the side.
    assert 200.3 - 200 > 0.3 and 0.3 - 200.3 == -200
    p, b = frame(spark, [("a", 0.3)], "k string, x double"), frame(spark, [("a", 1, 200.3)], "k string, id int, c double")
    assert values(jn.count_in_boxes(b, p, ["k"], [("x", "c", 200.0)], 400.0, ["id"]), "id", "n_points") == [(1, 1)]


def test_circular_percentiles(spark):
    df = frame(spark, [("a", v) for v in (3.0, 3.1, 0.05, 0.1)] + [("b", v) for v in (1.0, 1.1, 1.2, 1.3)], "k string, x double")
    out = {r.k: r.percentiles for r in ranks.circular_percentile(df, ["k"], "x", [0, 50, 100], math.pi).collect()}
    assert out["b"] == pytest.approx([1.0, 1.15, 1.3])
    assert out["a"][0] == pytest.approx(3.0) and out["a"][2] == pytest.approx(0.1)


def test_ranked_percentiles(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.normal(size=4000)] + [("ties", float(v)) for v in rng.integers(0, 3, 500)] + [(None, 1.0), (None, 2.0), ("one", 7.0), ("none", None)]
    df = frame(spark, rows, "k string, x double").repartition(7)
    percents = [0, 5, 33.3, 50, 95, 100]
    found = {r.k: r.p for r in ranks.percentiles(df, ["k"], "x", percents).collect()}
    assert set(found) == {"hot", "ties", None, "one"}
    for k in found:
        assert found[k] == pytest.approx(np.percentile([v for g, v in rows if g == k], percents))
    # More partitions than distinct values, and no keys.
    assert ranks.percentiles(df.where("k = 'ties'"), [], "x", [50]).first()["p"] == [float(np.median([v for g, v in rows if g == "ties"]))]
    assert ranks.percentiles(df.limit(0), ["k"], "x", [50]).count() == 0 and ranks.percentiles(df.limit(0), [], "x", [50]).count() == 0
    told = {r.k: r for r in agg.described(df, ["k"], "x").collect()}
    assert told[None].q50 == 1.5 and told["none"]["count"] == 0 and told["none"].q50 is None and told["one"].std is None
    assert told["hot"]["count"] == 4000 and told["hot"].q75 == pytest.approx(np.percentile([v for g, v in rows if g == "hot"], 75))


def test_circular_percentiles_over_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(k, float(v)) for k, c in (("a", 0.0), ("b", 40.0), ("c", 99.0)) for v in np.round(rng.normal(c, 8.0, 700)) % 100] + [("d", None)]
    found = {r.k: r.percentiles for r in ranks.circular_percentile(frame(spark, rows, "k string, x double").repartition(5), ["k"], "x", [5, 50, 95], 100.0).collect()}
    assert set(found) == {"a", "b", "c"}
    for k, got in found.items():
        v = sorted(x for g, x in rows if g == k)
        gaps = [(v[(i + 1) % len(v)] - v[i] + (100.0 if i + 1 == len(v) else 0.0), -v[i], v[(i + 1) % len(v)]) for i in range(len(v))]
        cut = max(gaps)[2]
        want = (np.percentile([(x - cut) % 100.0 for x in v], [5, 50, 95]) + cut) % 100.0
        assert got == pytest.approx(list(want))


def test_ema_of_keys_over_many_partitions(spark):
    import pandas as pd

    rng = np.random.default_rng(7)
    x = np.where(rng.random(6000) < 0.3, np.nan, rng.normal(size=6000))
    x[:40], x[2000:3500] = np.nan, np.nan  # no value at first, and partitions without any
    rows = [("hot", i, None if np.isnan(v) else float(v)) for i, v in enumerate(x)] + [(None, i, float(i)) for i in range(5)] + [("none", 0, None)]
    df = frame(spark, rows, "k string, i int, x double").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.k, r.i): r.e for r in win.ema(df, "x", 0.3, ["k"], ["i"], "e").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows) and got["none", 0] is None
    want = pd.Series(x).ewm(alpha=0.3, adjust=False).mean()
    assert all((got["hot", i] is None) if np.isnan(w) else got["hot", i] == pytest.approx(w, abs=1e-12) for i, w in enumerate(want))
    assert [got[None, i] for i in range(5)] == pytest.approx(list(pd.Series(range(5)).ewm(alpha=0.3, adjust=False).mean()))
    assert win.ema(df.limit(0), "x", 0.3, ["k"], ["i"], "e").count() == 0


def test_bins(spark):
    df = frame(spark, [(0.0,), (10.0,)], "x double")
    a = grid.make_axis(df, "x", 3.0)
    assert a.n == 4 and a.width == 2.5
    assert grid.make_axis(df, "x", 3.0, (0.0, 6.0)).n == 2
    with pytest.raises(ValueError):
        grid.make_axis(df, "x", 0.0)
    with pytest.raises(ValueError):
        grid.make_axis(df.limit(0), "x", 1.0)
    rows = frame(spark, [(0.0,), (2.5,), (10.0,), (10.1,), (None,)], "x double")
    assert values(grid.histogram(rows, [a], {"n": F.lit(1)}), "i0", "n") == [(0, 1), (1, 1), (3, 1)]


def test_percentile_box(spark):
    df = frame(spark, [(0.1, 0.0, 1.0), (2.0, 0.0, 1.0), (3.0, 2.5, 0.5), (1.0, 2.5, 0.5), (None, 0.0, 1.0)], "x double, lo double, hi double")
    assert [r[0] for r in df.select(flt.inside_box(F.col("x"), F.col("lo"), F.col("hi"))).collect()] == [True, False, True, False, False]


@pytest.mark.parametrize(("j", "want"), [([[-1, 0], [0, -2]], "stable"), ([[1, 0], [0, 2]], "unstable"), ([[1, 0], [0, -2]], "saddle"), ([[0, 1], [-1, 0]], "indeterminate")])
def test_stability(j, want):
    assert dyn.stability_of(np.array(j, dtype=float)) == want


def test_planted_fixed_point_1d(spark):
    axis = grid.Axis("x", -1.0, 0.1, 20)
    field = spark.range(20).select(F.lit("d").alias("k"), F.col("id").cast("int").alias("i0"), axis.center(F.col("id")).alias("x0")).withColumn("drift_0", -(F.col("x0") - 0.32))
    assert [tuple(r) for r in dyn.fixed_points_1d(field, axis, ["k"]).collect()] == [("d", 0.32, "stable")]
    well = field.withColumn("drift_0", F.col("x0") - F.col("x0") ** 3 * 4)
    found = [(round(r.x, 1), r.stability) for r in dyn.fixed_points_1d(well, axis, ["k"]).orderBy("x").collect()]
    assert found == [(-0.5, "stable"), (0.0, "unstable"), (0.5, "stable")]


def test_planted_fixed_point_2d(spark):
    axes = [grid.Axis("x", -1.0, 0.2, 10), grid.Axis("y", -1.0, 0.2, 10)]
    cells = grid.cells(spark, axes).withColumn("k", F.lit("d"))
    saddle = cells.withColumns({"drift_0": F.col("x0") - 0.13, "drift_1": -(F.col("x1") + 0.27)})
    assert [tuple(r) for r in dyn.fixed_points_nd(saddle, axes, ["k"]).collect()] == [("d", 0.13, -0.27, "saddle")]


def test_drift_of_relaxing_tracks(spark):
    rng, rows = np.random.default_rng(1), []
    for c in range(150):
        x = rng.uniform(-1, 1)
        for t in range(30):
            rows.append(("d", 0, c, t, float(x)))
            x += -0.3 * (x - 0.2) + 0.05 * rng.normal()
    df = frame(spark, rows, "dataset string, position int, crop_index long, frame_number int, x double")
    axis = grid.Axis("x", -1.2, 0.1, 24)
    field = dyn.drift_field(df, [axis], [("gaussian", 0.1)], 1.0, ["dataset"])
    (point,) = dyn.fixed_points_1d(field, axis, ["dataset"]).collect()
    assert point.stability == "stable" and point.x == pytest.approx(0.2, abs=0.03)
    total = field.groupBy("dataset").agg(grid.integral(F.col("density"), [axis]).alias("p")).first().p
    assert total == pytest.approx(1.0)


def test_bootstrap_summary_rests_on_500_replicates(spark):
    from driftloom import registry

    rows = registry.queries()["stat20_bootstrap_summary"](spark, "/root/testdata/sf0.001").where("hits > 0").collect()
    assert rows and all(r.detection_rate == pytest.approx(r.hits / 500, abs=1e-6) for r in rows)


def test_greedy_matches_use_points_once(spark):
    base = frame(spark, [("d", 1, 0, 0.0), ("d", 2, 1, 0.1)], "k string, point_id int, rank int, x double")
    found = frame(spark, [("d", 0, 7, 0.06), ("d", 0, 8, 0.3), ("d", 1, 9, 0.9)], "k string, replicate int, found_id int, x double")
    out = jn.greedy_matches(base, found, ["k"], ["x"], 0.3, 2).orderBy("point_id").collect()
    assert [(r.point_id, r.found_id) for r in out] == [(1, 7), (2, 8)]


def test_greedy_matches_refuse_ranks_beyond_the_rounds(spark):
    base = frame(spark, [("d", 1, 0, 0.0), ("d", 2, 2, 0.1)], "k string, point_id int, rank int, x double")
    found = frame(spark, [("d", 0, 7, 0.06)], "k string, replicate int, found_id int, x double")
    with pytest.raises(ValueError):
        jn.greedy_matches(base, found, ["k"], ["x"], 0.3, 2)


def test_summary_matches_all_of_five_roots(spark):
    from driftloom.plans.dynamics import summary

    points = [(x, "unstable" if k == 2 else "stable") for k, x in enumerate((-0.8, 0.0, 0.8, 1.6, 2.4))]
    points += [(3.2, "stable")]
    base = frame(spark, [("d", x, s, k + 1) for k, (x, s) in enumerate(points)], "dataset string, rho double, stability string, point_id int")
    found = frame(spark, [("d", b, x + 0.1 * b, s) for b in range(2) for x, s in points], "dataset string, replicate int, rho double, stability string")
    out = values(summary(base, found, 2), "point_id", "hits", "detection_rate")
    assert out == [(k + 1, 2, 1.0) for k in range(6)]


def test_statistics(spark):
    assert st.pearson_p(0.5, 20) == pytest.approx(0.0247, abs=1e-4)
    assert st.pearson_p(1.0, 5) == 0 and st.pearson_p(0.1, 2) is None and st.pearson_p(0.0, 10) == pytest.approx(1.0)
    x = np.linspace(0, 10, 40)
    y = 2 * x + 1 + np.random.default_rng(0).normal(size=40) * 0.1
    slope, intercept, *_ = st.york_fit(x, y, np.full(40, 0.1), np.full(40, 0.1))
    # With equal errors the fit is that of Deming.
    sxx, syy, sxy = x.var(), y.var(), np.cov(x, y, bias=True)[0, 1]
    assert slope == pytest.approx((syy - sxx + math.sqrt((syy - sxx) ** 2 + 4 * sxy**2)) / (2 * sxy), rel=1e-9)
    assert intercept == pytest.approx(y.mean() - slope * x.mean(), rel=1e-9)


def test_decay_fit(spark):
    df = spark.range(60).select(F.lit("d").alias("k"), F.col("id").cast("double").alias("x"), (3 * F.exp(-0.15 * F.col("id")) + 0.5).alias("y"))
    r = st.fit_decay(df, ["k"], "x", "y", 0.0, 1.0).first()
    assert (r.a, r.b, r.c) == (pytest.approx(3, abs=0.01), pytest.approx(0.15, abs=1e-3), pytest.approx(0.5, abs=0.01))


def test_components_are_centred_and_orthogonal(spark):
    x = np.random.default_rng(3).normal(size=(200, 5)) * [5, 3, 1, 1, 1] + 7
    df = frame(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    mean, loadings, explained, _ = feat.fit_pca(df, "v", 3)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(np.array(loadings) @ np.array(loadings).T, np.eye(3))
    pcs = np.array([r.pc for r in feat.project(df, "v", mean, loadings).orderBy("id").collect()])
    assert np.allclose(pcs.mean(axis=0), 0, atol=1e-9) and explained == sorted(explained, reverse=True)
    assert np.allclose(pcs, (x - x.mean(axis=0)) @ np.array(loadings).T)
    with pytest.raises(ValueError):
        feat.project(df, "v", mean, loadings[:1])


def test_tracks_follow_links(spark):
    nodes = frame(spark, [(0, f, 1) for f in range(20)] + [(0, 5, 2)], "position int, frame_number int, label int")
    links = frame(spark, [(0, f, 1, f + 1, 1) for f in range(19) if f != 9], "position int, frame_number int, label int, next_frame int, next_label int")
    out = {(r.frame_number, r.label): r.track_id for r in reg.tracks(links, nodes).collect()}
    assert len({out[f, 1] for f in range(10)}) == 1 and len({out[f, 1] for f in range(10, 20)}) == 1
    assert sorted(set(out.values())) == [0, 1, 2]


def test_guards(spark):
    df = frame(spark, [("a", 1), ("a", 2), ("b", 2)], "k string, v int")
    with pytest.raises(ValueError):
        guards.require_columns(df, ["k", "x"])
    with pytest.raises(ValueError):
        guards.only_value(df, "k")
    assert guards.only_value(df.where("k = 'b'"), "k") == "b"
    assert guards.require_unique(df, ["k", "v"]).count() == 3
    with pytest.raises(Exception, match="rows share"):
        guards.require_unique(df, ["k"]).count()


def test_names(spark):
    r = spark.range(1).select(S.slugify(F.lit(" A b-C! ")).alias("a"), S.position_of(F.lit("/x/20240101_P12.zarr")).alias("b"), S.frame_in_name(F.lit("T1_T22.tif")).alias("c"), S.frame_in_name(F.lit("none"), 7).alias("d")).first()
    assert tuple(r) == ("a_b_c", 12, 22, 7)
    with pytest.raises(Exception, match="no position"):
        spark.range(1).select(S.position_of(F.lit("/x/none"), strict=True)).collect()


def test_catalog(spark):
    rows = [("m1", "w", {"a": "1"}, "d1", None, "p1", None), ("m2", "w", {"a": "1", "b": "2"}, "d1", None, None, None)]
    m = frame(spark, rows, "name string, workflow string, parameters map<string,string>, key string, id string, path string, uri string")
    assert cat.one_manifest(m, "w", {"b": "2"}) == "m2" and cat.location_of(m, "m1", "d1") == "p1"
    for bad in ({"a": "1"}, {"a": "3"}):
        with pytest.raises(ValueError):
            cat.one_manifest(m, "w", bad)
    with pytest.raises(KeyError):
        cat.location_of(m, "m2", "d1")


def test_files(spark, tmp_path):
    df = frame(spark, [("a", 1), ("b", 2)], "k string, v int")
    for suffix in ("parquet", "csv", "tsv"):
        path = f"{tmp_path}/t.{suffix}"
        files.write_table(df, path, parameters={"p": "1"})
        files.check_written(spark, path, df)
        assert values(files.read_first(spark, [None, f"{tmp_path}/none.parquet", path]), "k", "v") == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError):
        files.read_first(spark, [None])


def test_small_things(spark):
    r = spark.range(1).select(R.array_std(F.array(F.lit(1.0), F.lit(3.0))).alias("s"), F.size(R.sanitized(F.array(F.lit(0.0), F.lit(float("nan")), F.lit(2.0)))).alias("n"), R.array_mean(F.array().cast("array<double>")).alias("m")).first()
    assert tuple(r) == (1.0, 1, None)
    with pytest.raises(ValueError):
        plane_basis((0, 0, 0), (1, 1, 1), (2, 2, 2))
    a = split_rows(spark.range(1000), ["id"]).where("split = 'validation'")
    assert 120 < a.count() < 280
    assert a.count() == split_rows(spark.range(1000).repartition(7), ["id"]).where("split = 'validation'").count()


def test_first_passages_do_not_depend_on_order_or_batches(spark, tmp_path):
    from driftloom.streaming import streams

    # Falling time over more rows than an Arrow batch, then an earlier event in a later file.
    day = "timestamp'2024-01-01' + make_dt_interval(0, 0, 0, {n})"
    rows = spark.range(25_000).selectExpr("1L as user_id", "id as event_id", f"{day.format(n='30000 - id')} as ts", "300.0 as value")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.range(1).selectExpr("1L as user_id", "99999L as event_id", f"{day.format(n='1')} as ts", "300.0 as value").write.parquet(f"{tmp_path}/in/b")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = streams.first_passages(source, 200.0).writeStream.format("memory").queryName("passages").outputMode("complete")
    query.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("passages").collect()] == [(1, 99999)]


def test_broken_files_lead_to_the_next_place(spark, tmp_path):
    from driftloom.sources import files

    (tmp_path / "broken.parquet").write_text("no parquet")
    spark.range(3).write.parquet(f"{tmp_path}/whole.parquet")
    found = files.read_first(spark, [None, f"{tmp_path}/none.csv", f"{tmp_path}/broken.parquet", f"{tmp_path}/whole.parquet"], schema="id long")
    assert found.count() == 3


def test_written_tables_are_checked(spark, tmp_path):
    from driftloom.sources import files

    df = spark.range(3)
    df.write.parquet(f"{tmp_path}/t.parquet")
    files.check_written(spark, f"{tmp_path}/t.parquet", df)
    for other in (spark.range(4), df.withColumnRenamed("id", "other")):
        with pytest.raises(ValueError):
            files.check_written(spark, f"{tmp_path}/t.parquet", other)
