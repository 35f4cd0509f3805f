"""Queries of the feature bundles and of the merge and combine pipelines (STAT-35 to STAT-38)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftloom.functions.angles import PI
from driftloom.operators import bundles as bun
from driftloom.operators.windows import gaussian_weights
from driftloom.registry import query
from driftloom.sources.scratch import settled, shared_folder
from driftloom.sources.tables import ANNOTATIONS, DATASETS, FLOW, T_SQL, U_SQL, setting, trajectories

KEY = ["dataset", "position", "crop_index", "frame_number"]
CROP, IMAGE = 400.0, (2600.0, 1000.0)
KINDS = ["not_steady_state", "cell_piling"]
#: Differences of whole numbers over minutes end within ten digits, so that fewer digits would meet ties.
FINE, RATE = 9, 11
LIMITS = {"least_duration": 24, "most_change": 0.1, "least_valid": 8}
TRACK = "PARTITION BY dataset, position, crop_index"
OVER = f"OVER ({TRACK} ORDER BY frame_number)"

#: Columns that are compared as they are, and those that are rounded.
FRAME_PLAIN = ["shear_stress_regime", "n_neighbors", "n_nuclei", "is_valid_crop", "n_nuclei_in_crop", "n_tracks", "n_rows", "track_duration"]
FRAME_REAL = """time_min time_h time_since_flow_h alignment alignment_deg orientation_deg nematic_order aspect_ratio area_um2 perimeter_um edge_fluor_mean edge_fluor_std
  node_fluor_mean node_fluor_std edge_and_node_fluor_mean edge_and_node_fluor_std nuclei_dx nuclei_dy nuclei_distance nuclei_angle nuclei_angle_deg start_x end_x start_y end_y
  area_normalized area_normalized_change""".split()
FLAGS = ["long_enough", "small_change", "inside", "n_valid", "is_included", "n_tracks_after", *KINDS]
TRACK_REAL = """x_um y_um vx vy speed heading heading_deg alignment_deg_per_min cell_fluor_per_min edge_fluor_per_min node_fluor_per_min nuclei_in_crop_per_min nuclei_dx_um nuclei_dy_um
  nuclei_to_heading_deg nuclei_dot_velocity normalized_time""".split()


def digits_of(c, digits):
    return RATE if c in ("vx", "vy") or c.endswith("_per_min") else digits


def shown(df, plain, real, digits=5):
    # Adding zero leaves no negative zeros. The scaled double is rounded, as in SQL, not its decimal digits: ties of the two differ.
    scaled = lambda c, n: F.round(F.col(c) * F.lit(10.0**n)) / F.lit(10.0**n)
    return df.select(*KEY, *plain, *((scaled(c, digits_of(c, digits)) + 0.0).alias(c) for c in real))


def shown_sql(plain, real, source, digits=5):
    return f"SELECT {', '.join([*KEY, *plain, *(f'round({c}, {digits_of(c, digits)}) + 0.0 AS {c}' for c in real)])} FROM {source}"


def segments(spark, sf):
    """Cells from the first events of frames: their place, shape and intensities follow the event's value and k."""
    t = trajectories(spark, sf)
    return t.select(
        *bun.FRAME,
        (F.col("crop_index") + 1).alias("label"),
        (F.lit(400) + F.col("value")).alias("area_px"),
        (4 * F.sqrt(F.lit(400) + F.col("value"))).alias("perimeter_px"),
        (F.col("polar_theta") - F.lit(PI / 2)).alias("orientation"),
        (F.col("k") % 90 / F.lit(100.0)).alias("eccentricity"),
        (F.col("value") * 10).alias("centroid_x"),
        (F.col("k") * F.lit(10.0)).alias("centroid_y"),
        F.col("polar_r").alias("cell_fluor_mean"),
        F.array("value", F.col("k").cast("double"), "rho").alias("edge_fluor"),
        F.when(F.col("k") % 5 == 0, F.array().cast("array<double>")).otherwise(F.array("polar_r", "rho")).alias("node_fluor"),
        F.slice(F.sequence(F.lit(1), F.lit(7)), F.lit(1), F.col("k") % 7).alias("neighbor_labels"),
        (F.col("k") >= 95).alias("is_edge"),
    )


def tracking(spark, sf):
    return trajectories(spark, sf).select(*bun.FRAME, (F.col("crop_index") + 1).alias("label"), "crop_index")


def nuclei(spark, sf):
    u = trajectories(spark, sf, last=True).where("k % 10 <> 9")
    labels = F.slice(F.array(F.lit(1), F.lit(2)), F.lit(1), 1 + F.col("k") % 2)
    return u.select(*bun.FRAME, (F.col("crop_index") + 1).alias("cell_label"), (F.col("value") * 10).alias("nuclei_x"), (F.col("k") * F.lit(10.0)).alias("nuclei_y"), labels.alias("nuclei_labels"))


def framed(spark, sf):
    found = nuclei(spark, sf)
    cells = bun.merged_cells(segments(spark, sf), tracking(spark, sf), found)
    return bun.frame_bundle(cells, setting(spark, DATASETS), setting(spark, FLOW), found, CROP, IMAGE)


_WEIGHTS = ", ".join(f"({k - 8}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(gaussian_weights(2.0)))

#: The bundle as ``f``: reflected weights by a join of places, crops by a join of all nuclei of the frame, intensities by list functions.
_FRAME = f"""WITH {T_SQL}, {U_SQL}, a AS ({ANNOTATIONS}), ds AS ({DATASETS}), flow AS ({FLOW}), w(s, w) AS (VALUES {_WEIGHTS}),
  fl AS (SELECT dataset, string_agg(CAST(CAST(3 * round_even(shear_stress / 3, 0) AS INTEGER) AS VARCHAR), '_to_' ORDER BY ordinal) AS shear_stress_regime, arg_min(start_frame, ordinal) AS onset FROM flow GROUP BY 1),
  n AS (SELECT *, value * 10 AS nx, k * 10.0::DOUBLE AS ny FROM u WHERE k % 10 <> 9),
  c AS (SELECT t.*, n.nx, n.ny, n.k AS nk, 400 + t.value AS area, t.value * 10 AS cx, t.k * 10.0::DOUBLE AS cy, t.polar_theta - {PI!r} / 2 AS o, (t.k % 90) / 100.0::DOUBLE AS ecc,
    [t.value, CAST(t.k AS DOUBLE), t.rho] AS edge, CASE WHEN t.k % 5 = 0 THEN CAST([] AS DOUBLE[]) ELSE [t.polar_r, t.rho] END AS node,
    row_number() OVER (PARTITION BY t.dataset, t.position, t.crop_index ORDER BY t.frame_number) - 1 AS i, count(*) OVER (PARTITION BY t.dataset, t.position, t.crop_index) AS m
    FROM t JOIN n USING (dataset, position, crop_index, frame_number)),
  sm AS (SELECT q.crop_index, q.frame_number, sum(q.w * z.area) AS smooth FROM (SELECT c.crop_index, c.frame_number, w.w, c.m, (i + s) - 2 * m * floor((i + s) / (2.0 * m)) AS p FROM c, w) q JOIN (SELECT crop_index, i, area FROM c) z ON z.crop_index = q.crop_index AND z.i = least(p, 2 * q.m - 1 - p) GROUP BY ALL),
  nc AS (SELECT c.crop_index, c.frame_number, count(n.k) AS n_nuclei_in_crop FROM c LEFT JOIN n ON n.dataset = c.dataset AND n.position = c.position AND n.frame_number = c.frame_number AND abs(n.nx - c.cx) <= 200 AND abs(n.ny - c.cy) <= 200 GROUP BY ALL),
  nt AS (SELECT dataset, position, frame_number, count(DISTINCT crop_index) AS n_tracks FROM c GROUP BY ALL),
  f0 AS (SELECT c.*, pixel_size_xy_in_um AS px, shear_stress_regime, n_tracks, n_nuclei_in_crop, area / smooth AS area_normalized, frame_number * time_interval_in_minutes AS time_min, frame_number * time_interval_in_minutes / 60 AS time_h,
    (frame_number - onset) * time_interval_in_minutes / 60 AS time_since_flow_h, acos(least(1.0, abs(cos(o)))) AS alignment, degrees(acos(least(1.0, abs(cos(o))))) AS alignment_deg, degrees(o) AS orientation_deg, 2 * cos(o) ** 2 - 1 AS nematic_order,
    1 / sqrt(1 - ecc * ecc) AS aspect_ratio, area * pixel_size_xy_in_um ** 2 AS area_um2, 4 * sqrt(area) * pixel_size_xy_in_um AS perimeter_um, k % 7 AS n_neighbors, 1 + nk % 2 AS n_nuclei,
    list_avg(edge) AS edge_fluor_mean, list_stddev_pop(edge) AS edge_fluor_std, list_avg(node) AS node_fluor_mean, list_stddev_pop(node) AS node_fluor_std, list_avg(edge || node) AS edge_and_node_fluor_mean, list_stddev_pop(edge || node) AS edge_and_node_fluor_std,
    cx - nx AS nuclei_dx, cy - ny AS nuclei_dy, sqrt((cx - nx) ** 2 + (cy - ny) ** 2) AS nuclei_distance, atan2(cy - ny, cx - nx) AS nuclei_angle, degrees(atan2(cy - ny, cx - nx)) AS nuclei_angle_deg,
    cx - 200 AS start_x, cx + 200 AS end_x, cy - 200 AS start_y, cy + 200 AS end_y, cx BETWEEN 200 AND 2400 AND cy BETWEEN 200 AND 800 AS is_valid_crop
    FROM c JOIN ds USING (dataset) JOIN fl USING (dataset) JOIN sm USING (crop_index, frame_number) JOIN nc USING (crop_index, frame_number) JOIN nt USING (dataset, position, frame_number)),
  f AS (SELECT *, area_normalized - lag(area_normalized) {OVER} AS area_normalized_change, 1 AS n_rows, max(frame_number) OVER ({TRACK}) - min(frame_number) OVER ({TRACK}) AS track_duration FROM f0)"""


@query("stat35_frame_features", f"{_FRAME} {shown_sql(FRAME_PLAIN, FRAME_REAL, 'f')}")
def stat35(spark, sf):
    return shown(framed(spark, sf), FRAME_PLAIN, FRAME_REAL)


def _track_sql(source: str, name: str) -> str:
    """The bundle along tracks of a table, as a table of a name."""
    per = lambda c: f"({c} - lag({c}) {OVER}) / (time_min - lag(time_min) {OVER})"
    return f"""{name}1 AS (SELECT *, cx * px AS x_um, cy * px AS y_um, nuclei_dx * px AS nuclei_dx_um, nuclei_dy * px AS nuclei_dy_um FROM {source}),
  {name}2 AS (SELECT *, {per('x_um')} AS vx, {per('y_um')} AS vy, {per('alignment_deg')} AS alignment_deg_per_min, {per('polar_r')} AS cell_fluor_per_min, {per('edge_fluor_mean')} AS edge_fluor_per_min, {per('node_fluor_mean')} AS node_fluor_per_min,
    {per('n_nuclei_in_crop')} AS nuclei_in_crop_per_min, coalesce((frame_number - min(frame_number) OVER ({TRACK})) / nullif(max(frame_number) OVER ({TRACK}) - min(frame_number) OVER ({TRACK}), 0)::DOUBLE, 0) AS normalized_time FROM {name}1),
  {name}3 AS (SELECT *, sqrt(vx ** 2 + vy ** 2) AS speed, atan2(vy, vx) AS heading, degrees(atan2(vy, vx)) AS heading_deg, vx * nuclei_dx_um + vy * nuclei_dy_um AS nuclei_dot_velocity, nuclei_angle_deg - degrees(atan2(vy, vx)) + 180 AS turn FROM {name}2),
  {name}4 AS (SELECT dataset, position, frame_number, count(DISTINCT crop_index) AS n_tracks_at_frame FROM {source} GROUP BY ALL),
  {name} AS (SELECT *, turn - 360 * floor(turn / 360) - 180 AS nuclei_to_heading_deg FROM {name}3 JOIN {name}4 USING (dataset, position, frame_number))"""


@query("stat36_track_features", f"{_FRAME}, {_track_sql('f', 'tr')} {shown_sql(['n_tracks_at_frame'], TRACK_REAL, 'tr', FINE)}")
def stat36(spark, sf):
    # Settled, as rows and their counts by frame both begin here.
    return shown(bun.track_bundle(settled(framed(spark, sf))), ["n_tracks_at_frame"], TRACK_REAL, FINE)


def place(spark, name):
    """A folder of its own for a run's table."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}.parquet"


def merged(spark, sf):
    tables = segments(spark, sf), tracking(spark, sf), nuclei(spark, sf), setting(spark, DATASETS), setting(spark, FLOW), setting(spark, ANNOTATIONS)
    return bun.merge_pipeline(*tables, KINDS, place(spark, "merged"), CROP, IMAGE, **LIMITS)


def _mark(kind: str) -> str:
    return f"CAST(EXISTS (SELECT 1 FROM a WHERE a.dataset = v.dataset AND a.position = v.position AND annotation = '{kind}' AND frame_number BETWEEN start_frame AND stop_frame) AS INTEGER) AS {kind}"


_MERGED = f"""{_FRAME}, g0 AS (SELECT *, track_duration > 24 AS long_enough, coalesce(abs(area_normalized_change) < 0.1, false) AS small_change, k < 95 AS inside FROM f),
  g1 AS (SELECT *, CAST(sum((long_enough AND small_change AND inside)::INT) OVER ({TRACK}) AS BIGINT) AS n_valid FROM g0),
  g2 AS (SELECT *, long_enough AND small_change AND inside AND n_valid > 8 AS is_included FROM g1),
  g AS (SELECT *, CASE WHEN is_included THEN (SELECT count(DISTINCT crop_index) FROM g2 b WHERE b.is_included AND b.dataset = v.dataset AND b.position = v.position AND b.frame_number = v.frame_number) END AS n_tracks_after, {', '.join(map(_mark, KINDS))} FROM g2 v)"""
MERGED_REAL = ["area_um2", "alignment_deg", "edge_and_node_fluor_mean", "nuclei_distance", "area_normalized", "time_since_flow_h"]


@query("stat37_merge_pipeline", f"{_MERGED} {shown_sql([*FLAGS, 'n_nuclei_in_crop', 'track_duration'], MERGED_REAL, 'g')}")
def stat37(spark, sf):
    return shown(merged(spark, sf)[0], [*FLAGS, "n_nuclei_in_crop", "track_duration"], MERGED_REAL)


def latent(spark, sf):
    """Latent features of crops around cells; rows that no model saw have no model."""
    u = trajectories(spark, sf, last=True).where("k > 20")
    model = F.when(F.col("k") % 10 != 8, F.concat(F.lit("m"), F.col("k") % 2))
    return u.select(*bun.FRAME, "crop_index", (F.col("crop_index") + 1).alias("label"), F.col("rho").alias("latent"), model.alias("model"))


def combined(spark, sf):
    return bun.combine_pipeline(merged(spark, sf)[0], latent(spark, sf), place(spark, "combined"), unwanted=("n_rows", "time_h"))


_COMBINED = f"""{_MERGED}, l AS (SELECT dataset, position, crop_index, frame_number, crop_index + 1 AS label_y, rho AS latent, CASE WHEN k % 10 <> 8 THEN 'm' || k % 2 END AS model FROM u WHERE k > 20),
  j AS (SELECT g.*, crop_index + 1 AS label_x, label_y, latent, model FROM g LEFT JOIN l USING (dataset, position, crop_index, frame_number))"""


@query("stat38_combine_pipeline", f"{_COMBINED}, jf AS (SELECT * FROM j WHERE is_included), {_track_sql('jf', 'tr')} {shown_sql(['model', 'n_tracks_at_frame', 'label_x', 'label_y'], ['latent', *TRACK_REAL], 'tr WHERE model IS NOT NULL', FINE)}")
def stat38(spark, sf):
    return shown(combined(spark, sf)[1], ["model", "n_tracks_at_frame", "label_x", "label_y"], ["latent", *TRACK_REAL], FINE)


@query("stat38b_combined_unfiltered", f"{_COMBINED} {shown_sql(['model', 'is_included', 'label_x', 'label_y'], ['latent', 'area_um2'], 'j')}")
def stat38b(spark, sf):
    return shown(combined(spark, sf)[0], ["model", "is_included", "label_x", "label_y"], ["latent", "area_um2"])
