"""Feature bundles of cells, in a frame and along a track, and the pipelines that merge and combine feature tables.

A cell is a row with ``dataset``, ``position``, ``frame_number``, ``label`` and ``crop_index`` (its track), area_px, perimeter_px, orientation,
eccentricity, centroid_x and centroid_y, nuclei_x and nuclei_y, cell_fluor_mean, is_edge, and the arrays edge_fluor, node_fluor,
neighbor_labels and nuclei_labels. A label occurs once in a frame. Further columns go through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from driftloom.functions import angles as A
from driftloom.operators import filters as flt
from driftloom.operators import joins as jn
from driftloom.operators import windows as win
from driftloom.sources.files import check_written, read_table, write_table
from driftloom.sources.scratch import settled, shuffles_dropped

FRAME = ["dataset", "position", "frame_number"]
CELL = [*FRAME, "label"]


def merged_cells(segments: DataFrame, tracking: DataFrame, nuclei: DataFrame) -> DataFrame:
    """Cells that were measured, tracked and given nuclei; a nuclei row names its cell by ``cell_label``."""
    both = jn.inner_without_clashes(tracking, segments, CELL)
    return jn.inner_without_clashes(both, nuclei.withColumnRenamed("cell_label", "label"), CELL)


def _spread(values: Column) -> tuple[Column, Column]:
    """Mean and population standard deviation of an array; null entries are left out, and an array without others gives null."""
    present = F.filter(values, lambda x: x.isNotNull())
    n = F.nullif(F.size(present), F.lit(0))
    mean = F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / n
    squares = F.aggregate(F.transform(present, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda s, x: s + x)
    return mean, F.sqrt(squares / n)


def distinct_tracks(rows: DataFrame, name: str) -> DataFrame:
    """``FRAME`` and the number of tracks in each."""
    return rows.groupBy(*FRAME).agg(F.count_distinct("crop_index").alias(name))


def frame_bundle(cells: DataFrame, settings: DataFrame, flow: DataFrame, points: DataFrame, crop: float, image: tuple[float, float], sigma: float = 2.0) -> DataFrame:
    """Cells with all features that need no clean tracks.

    ``settings`` has time_interval_in_minutes and pixel_size_xy_in_um a data set, ``flow`` its conditions; features of a data set
    without them are null. ``points`` holds the nuclei (FRAME, nuclei_x, nuclei_y) that are counted in the crop of a side around each cell.
    ``image`` is the width and height. Added are:

    - shear_stress_regime, shear_stresses; time_min, time_h, time_since_flow_h
    - alignment, alignment_deg, orientation_deg, nematic_order, aspect_ratio; area_um2, perimeter_um
    - mean and standard deviation of edge, node and both intensities; n_neighbors, n_nuclei
    - nuclei_dx, nuclei_dy (cell less nuclei), nuclei_distance, nuclei_angle, nuclei_angle_deg
    - the crop's bounds, is_valid_crop (inside the image), n_nuclei_in_crop
    - n_tracks (tracks of the frame), n_rows (of the track in the frame; 1 in a sound table), track_duration
    - area_normalized (area over its smoothed course along the track) and its change
    """
    # Settled, as cells go into counts of boxes, into tracks of the frame and into the rows themselves, and are numbered.
    cells = settled(cells.withColumn("__row", F.monotonically_increasing_id()))
    # Counts and smoothing take many exchanges, so they get these columns only and meet the others once.
    axes = [("nuclei_x", "centroid_x", crop / 2), ("nuclei_y", "centroid_y", crop / 2)]
    measured = cells.select("__row", *win.TRACK, win.TIME, "label", "area_px", "centroid_x", "centroid_y")
    measured = jn.count_in_boxes(measured, points, FRAME, axes, crop, ["__row"], "n_nuclei_in_crop").drop("centroid_x", "centroid_y")
    measured = settled(win.gaussian_smoothed(measured, "area_px", sigma, win.TRACK, [win.TIME, "label"], "__smooth").select("__row", "n_nuclei_in_crop", "__smooth"))
    rows = cells.join(measured, "__row").drop("__row")
    # Windows before the other features, so that those are in no exchange.
    rows = rows.withColumn("area_normalized", F.col("area_px") / F.nullif(F.col("__smooth"), F.lit(0.0))).drop("__smooth")
    rows = win.with_track_duration(rows).withColumns({
        "area_normalized_change": win.difference("area_normalized"),
        "n_rows": F.count("*").over(win.whole([*win.TRACK, win.TIME])),
    })
    rows = jn.with_few(rows, distinct_tracks(cells, "n_tracks"), FRAME)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "start_frame", "shear_stress")))
    flows = flow.groupBy("dataset").agg(ordered.alias("c")).select(
        "dataset",
        F.concat_ws("_to_", F.transform("c", lambda c: A.shear_bin(c["shear_stress"]).cast("string"))).alias("shear_stress_regime"),
        F.transform("c", lambda c: c["shear_stress"]).alias("shear_stresses"),
        F.col("c")[0]["start_frame"].alias("__start"),
    )
    rows = rows.join(settings.select("dataset", "time_interval_in_minutes", "pixel_size_xy_in_um"), "dataset", "left").join(flows, "dataset", "left")
    minutes, pixel, half = F.col("time_interval_in_minutes"), F.col("pixel_size_xy_in_um"), F.lit(crop / 2)
    alignment, dx, dy = A.axis_alignment(F.col("orientation")), F.col("centroid_x") - F.col("nuclei_x"), F.col("centroid_y") - F.col("nuclei_y")
    made = {
        "time_min": F.col("frame_number") * minutes,
        "time_h": F.col("frame_number") * minutes / 60,
        "time_since_flow_h": (F.col("frame_number") - F.col("__start")) * minutes / 60,
        "alignment": alignment,
        "alignment_deg": F.degrees(alignment),
        "orientation_deg": F.degrees("orientation"),
        "nematic_order": A.nematic_order(F.col("orientation")),
        "aspect_ratio": A.aspect_ratio(F.col("eccentricity")),
        "area_um2": F.col("area_px") * pixel * pixel,
        "perimeter_um": F.col("perimeter_px") * pixel,
        "n_neighbors": F.size("neighbor_labels"),
        "n_nuclei": F.size("nuclei_labels"),
        "nuclei_dx": dx,
        "nuclei_dy": dy,
        "nuclei_distance": F.hypot(dx, dy),
        "nuclei_angle": F.atan2(dy, dx),
        "nuclei_angle_deg": F.degrees(F.atan2(dy, dx)),
        "start_x": F.col("centroid_x") - half,
        "end_x": F.col("centroid_x") + half,
        "start_y": F.col("centroid_y") - half,
        "end_y": F.col("centroid_y") + half,
    }
    for name, values in (("edge", F.col("edge_fluor")), ("node", F.col("node_fluor")), ("edge_and_node", F.concat("edge_fluor", "node_fluor"))):
        made[f"{name}_fluor_mean"], made[f"{name}_fluor_std"] = _spread(values)
    rows = rows.withColumns(made).drop("__start")
    valid = (F.col("start_x") >= 0) & (F.col("start_y") >= 0) & (F.col("end_x") <= image[0]) & (F.col("end_y") <= image[1])
    return rows.withColumn("is_valid_crop", F.coalesce(valid, F.lit(False)))


def track_bundle(rows: DataFrame, keys: list[str] = win.TRACK) -> DataFrame:
    """Rows of ``frame_bundle`` with the features that follow a track; all share one window, hence one sort.

    Rates are changes since the track's row before over the minutes since then, null in its first row and where no time passed.
    They depend on which rows a track has, so wrong rows are to be filtered first. Added are:

    - x_um, y_um, their rates vx and vy, speed, heading, heading_deg
    - alignment_deg_per_min; cell, edge and node intensities and the nuclei in the crop per minute
    - nuclei_dx_um, nuclei_dy_um, nuclei_to_heading_deg (in [-180, 180)), nuclei_dot_velocity
    - normalized_time: 0 to 1 along the track
    - n_tracks_at_frame: tracks of the frame among these rows
    """
    pixel = F.col("pixel_size_xy_in_um")
    rows = jn.with_few(rows, distinct_tracks(rows, "n_tracks_at_frame"), FRAME)
    rows = rows.withColumns({name: F.col(c) * pixel for name, c in {"x_um": "centroid_x", "y_um": "centroid_y", "nuclei_dx_um": "nuclei_dx", "nuclei_dy_um": "nuclei_dy"}.items()})
    passed = F.nullif(win.difference("time_min", keys), F.lit(0.0))
    rates = {
        "vx": "x_um",
        "vy": "y_um",
        "alignment_deg_per_min": "alignment_deg",
        "cell_fluor_per_min": "cell_fluor_mean",
        "edge_fluor_per_min": "edge_fluor_mean",
        "node_fluor_per_min": "node_fluor_mean",
        "nuclei_in_crop_per_min": "n_nuclei_in_crop",
    }
    rows = rows.withColumns({name: win.difference(c, keys) / passed for name, c in rates.items()} | {"normalized_time": win.normalized_time(keys)})
    heading = F.atan2("vy", "vx")
    return rows.withColumns({
        "speed": F.hypot("vx", "vy"),
        "heading": heading,
        "heading_deg": F.degrees(heading),
        "nuclei_to_heading_deg": A.smallest_difference(F.col("nuclei_angle_deg"), F.degrees(heading)),
        "nuclei_dot_velocity": F.col("vx") * F.col("nuclei_dx_um") + F.col("vy") * F.col("nuclei_dy_um"),
    })


def flagged(rows: DataFrame, annotations: DataFrame, kinds: list[str], least_duration: int = 24, most_change: float = 0.1, least_valid: int = 20) -> DataFrame:
    """Rows of ``frame_bundle`` with quality flags, ``is_included``, a 0/1 column a kind of annotation, and ``n_tracks_after``.

    The latter counts the included tracks of the frame and is null on rows that are not included. The rows are read twice, first for
    these counts, which need few columns.
    """
    rows = flt.quality_flags(rows, "area_normalized", F.col("is_edge"), least_duration, most_change, least_valid)
    rows = jn.with_few(rows, distinct_tracks(rows.where("is_included"), "__after"), FRAME, "left").withColumn("n_tracks_after", F.when(F.col("is_included"), F.col("__after"))).drop("__after")
    return flt.flag_columns(rows, annotations, kinds)


def written(df: DataFrame, path: str, by: list[str], parameters: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """The table written, counted against what was to be written, and read again; and its catalog row."""
    # Counted while it is written, as another run of the plan would exchange its rows once more.
    seen = Observation()
    with shuffles_dropped(df.sparkSession):
        catalog = write_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, by, parameters)
        check_written(df.sparkSession, path, df, seen.get["rows"])
    return read_table(df.sparkSession, path), catalog


def merge_pipeline(segments: DataFrame, tracking: DataFrame, nuclei: DataFrame, settings: DataFrame, flow: DataFrame, annotations: DataFrame, kinds: list[str], path: str, crop: float, image: tuple[float, float], **limits: float) -> tuple[DataFrame, DataFrame]:
    """The merged table of all data sets, split by data set, and its catalog row: joins, frame features, quality flags, annotations.

    A data set that one of the tables lacks has no row. ``limits`` are those of ``flagged``.
    """
    cells = merged_cells(segments, tracking, nuclei)
    rows = frame_bundle(cells, settings, flow, nuclei, crop, image)
    return written(flagged(rows, annotations, kinds, **limits), path, ["dataset"], {"crop": str(crop)} | {k: str(v) for k, v in limits.items()})


def combine_pipeline(merged: DataFrame, latent: DataFrame, path: str, model: str = "model", unwanted: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The unfiltered and the filtered table of measured and latent features, from one join that is written once, and its catalog row.

    Latent rows are met by frame and track; columns of both sides get suffixes. The filtered table keeps included rows, adds the features along
    tracks, then drops rows that no model saw and the ``unwanted`` columns. A second latent row of a track in a frame is an error.
    """
    keys = [*FRAME, "crop_index"]
    with shuffles_dropped(latent.sparkSession):
        several = not latent.groupBy(*keys).count().where("count > 1").isEmpty()
    if several:
        raise ValueError("a track has several latent rows in a frame")
    both, catalog = written(jn.left_with_suffixes(merged, latent, keys), path, ["dataset"], {"model": model})
    filtered = track_bundle(both.where("is_included")).where(F.col(model).isNotNull()).drop(*unwanted)
    return both, filtered, catalog
