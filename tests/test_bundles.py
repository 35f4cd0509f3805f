"""Feature bundles and pipelines on small planted cells."""

import math
import time

import pytest
from pyspark.sql import functions as F

from driftloom.operators import bundles as bun
from driftloom.sources.files import read_table
from driftloom.sources.scratch import settled

IMAGE = (100.0, 100.0)


@pytest.fixture(scope="module")
def made(spark):
    """Two tracks of a data set with settings, one of a data set without; the second misses frame 1."""
    rows = []
    for dataset, track, frames in (("a", 1, (0, 1, 2, 3)), ("a", 2, (0, 2, 3)), ("b", 1, (0, 1))):
        for t in frames:
            rows.append((dataset, 0, t, track * 10, track, 100.0 + track, 40.0, 0.25 * math.pi * track, 0.6, 50.0 + 3 * t, 50.0 + 4 * t * (track == 1), 2.0 + t * t, [1.0, 3.0, None], [] if t == 0 else [5.0], [7, 8], track == 2 and t == 3))
    schema = "dataset string, position int, frame_number int, label int, crop_index int, area_px double, perimeter_px double, orientation double, eccentricity double, centroid_x double, centroid_y double, cell_fluor_mean double, edge_fluor array<double>, node_fluor array<double>, neighbor_labels array<int>, is_edge boolean"
    cells = spark.createDataFrame(rows, schema)
    nuclei = cells.select(*bun.FRAME, F.col("label").alias("cell_label"), (F.col("centroid_x") - 3).alias("nuclei_x"), (F.col("centroid_y") - 4).alias("nuclei_y"), F.array(F.lit(1), F.lit(2)).alias("nuclei_labels"))
    settings = spark.createDataFrame([("a", 30.0, 0.5)], "dataset string, time_interval_in_minutes double, pixel_size_xy_in_um double")
    flow = spark.createDataFrame([("a", 1, 2, 20.0), ("a", 0, 1, 6.0)], "dataset string, ordinal int, start_frame int, shear_stress double")
    return cells.drop("crop_index"), cells.select(*bun.CELL, "crop_index"), nuclei, settings, flow


def bundle(made, crop=20.0):
    cells = bun.merged_cells(*made[:3])
    return bun.frame_bundle(cells, made[3], made[4], made[2], crop, IMAGE)


def by_place(df):
    return {(r.dataset, r.crop_index, r.frame_number): r for r in df.collect()}


def test_frame_bundle(made):
    rows = by_place(bundle(made))
    assert len(rows) == 9
    one = rows["a", 1, 2]
    assert (one.shear_stress_regime, one.shear_stresses, one.time_min, one.time_h, one.time_since_flow_h) == ("6_to_21", [6.0, 20.0], 60.0, 1.0, 0.5)
    assert (one.edge_fluor_mean, one.edge_fluor_std, one.node_fluor_mean, one.node_fluor_std, one.edge_and_node_fluor_mean) == (2.0, 1.0, 5.0, 0.0, 3.0)
    assert one.edge_and_node_fluor_std == pytest.approx(math.sqrt(8 / 3))
    assert (one.nuclei_dx, one.nuclei_dy, one.nuclei_distance, one.n_neighbors, one.n_nuclei, one.n_rows) == (3.0, 4.0, 5.0, 2, 2, 1)
    assert one.alignment_deg == pytest.approx(45) and one.aspect_ratio == pytest.approx(1.25) and one.area_um2 == pytest.approx(25.25)
    assert one.area_normalized == pytest.approx(1) and one.area_normalized_change == pytest.approx(0)
    assert one.is_valid_crop and one.n_tracks == 2 and one.track_duration == 3
    # In frame 0 both cells lie at one place; in frame 2 the other's nuclei are twelve pixels off, beyond the crop of 20.
    assert [rows["a", 1, t].n_nuclei_in_crop for t in range(4)] == [2, 1, 1, 1]
    first = rows["a", 1, 0]
    assert (first.node_fluor_mean, first.node_fluor_std, first.edge_and_node_fluor_mean, first.area_normalized_change) == (None, None, 2.0, None)
    unknown = rows["b", 1, 1]
    assert (unknown.time_min, unknown.area_um2, unknown.shear_stress_regime, unknown.nuclei_distance) == (None, None, None, 5.0)


def test_track_bundle_uses_time_between_rows(made):
    rows = by_place(bun.track_bundle(bundle(made)))
    one, gap, first = rows["a", 1, 1], rows["a", 2, 2], rows["a", 2, 0]
    assert (one.vx, one.vy, one.speed) == pytest.approx((0.05, 4 * 0.5 / 30, math.hypot(0.05, 4 * 0.5 / 30)))
    # Six pixels in two frames.
    assert gap.vx == pytest.approx(0.05) and gap.cell_fluor_per_min == pytest.approx(4 / 60) and gap.heading_deg == pytest.approx(0)
    assert one.nuclei_to_heading_deg == pytest.approx(0, abs=1e-9) and one.nuclei_dot_velocity == pytest.approx(0.05 * 1.5 + 2 / 30 * 2)
    assert (first.vx, first.speed, first.heading, first.normalized_time) == (None, None, None, 0.0)
    assert [rows["a", 1, t].n_tracks_at_frame for t in range(4)] == [2, 1, 2, 2] and gap.normalized_time == pytest.approx(2 / 3)
    # Without an interval there are no rates.
    assert rows["b", 1, 1].vx is None


def test_pipelines_write_once_and_give_both_tables(spark, made, tmp_path):
    marks = spark.createDataFrame([("a", 0, "piling", 2, 9)], "dataset string, position int, annotation string, start_frame int, stop_frame int")
    limits = {"least_duration": 2, "most_change": 0.1, "least_valid": 1}
    merged, catalog = bun.merge_pipeline(*made, marks, ["piling"], str(tmp_path / "merged.parquet"), 20.0, IMAGE, **limits)
    rows = by_place(merged)
    assert {k for k, r in rows.items() if r.is_included} == {("a", 1, 1), ("a", 1, 2), ("a", 1, 3)}
    # Track 2 has one valid row only: its first has no change, its last touches the edge.
    assert (rows["a", 2, 2].n_valid, rows["a", 2, 2].n_tracks_after, rows["a", 1, 2].n_tracks_after, rows["a", 1, 2].n_tracks) == (1, None, 1, 2)
    assert [rows["a", 1, t].piling for t in range(4)] == [0, 0, 1, 1]
    assert catalog.first().parameters["least_valid"] == "1" and read_table(spark, str(tmp_path / "merged.parquet")).count() == 9

    latent = spark.createDataFrame([("a", 0, 1, 1, 5, 0.1, "m"), ("a", 0, 3, 1, 5, 0.3, None), ("a", 0, 0, 2, 5, 0.4, "m")], "dataset string, position int, frame_number int, crop_index int, label int, latent double, model string")
    both, filtered, _ = bun.combine_pipeline(merged, latent, str(tmp_path / "combined.parquet"), unwanted=("time_h",))
    assert both.count() == 9 and {"label_x", "label_y"} <= set(both.columns)
    left = by_place(filtered)
    assert set(left) == {("a", 1, 1)} and left["a", 1, 1].label_y == 5 and "time_h" not in filtered.columns
    # Features along tracks are made of included rows, so the row before in the whole table does not count.
    assert left["a", 1, 1].vx is None and left["a", 1, 1].n_tracks_at_frame == 1
    with pytest.raises(ValueError, match="several latent rows"):
        bun.combine_pipeline(merged, latent.unionByName(latent), str(tmp_path / "again.parquet"))


def test_features_are_made_behind_the_exchanges(spark, made):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = bundle(made)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    # Neither windows nor kept tables hold them; joins behind them are of few rows.
    assert not [line for line in plan.splitlines() if "edge_fluor_std" in line and ("Window" in line or "RDD" in line or "MapInArrow" in line)]
    assert "Window" in plan[plan.index("edge_fluor_std") :]


def test_written_tables_are_computed_once(spark, tmp_path):
    runs = spark.sparkContext.accumulator(0)

    def kept(i):
        runs.add(1)
        return i % 2 == 0

    df = spark.range(100).where(F.udf(kept, "boolean")("id"))
    again, _ = bun.written(df, str(tmp_path / "once.parquet"), [], {})
    assert again.count() == 50 and runs.value == 100
    again, _ = bun.written(df.limit(0), str(tmp_path / "none.parquet"), [], {})
    assert again.count() == 0


def test_kept_tables_leave_no_shuffle_files(spark, tmp_path):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")
    before = files()
    df = spark.range(1000).repartition(5, "id")
    kept = settled(df)
    again, _ = bun.written(df.groupBy((F.col("id") % 7).alias("k")).count(), str(tmp_path / "kept.parquet"), [], {})
    # They are removed in the background.
    end = time.time() + 20
    while files() > before and time.time() < end:
        time.sleep(0.2)
    assert files() <= before
    # The tables themselves can be used on and on.
    assert kept.count() == kept.distinct().count() == df.count() == df.distinct().count() == 1000 and again.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"


def test_cells_without_a_track_stay(spark, made):
    segments, tracking, nuclei, settings, flow = made
    tracking = tracking.withColumn("crop_index", F.when(F.col("crop_index") != 2, F.col("crop_index")))
    rows = bundle((segments, tracking, nuclei, settings, flow)).collect()
    assert len(rows) == 9 and sorted(r.n_nuclei_in_crop for r in rows if r.crop_index is None) == [2, 2, 2]


def test_empty_tables(spark, made, tmp_path):
    none = tuple(t.limit(0) for t in made[:3])
    assert bun.track_bundle(bundle((*none, *made[3:]))).count() == 0
