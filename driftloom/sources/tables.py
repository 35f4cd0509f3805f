"""Adapters that give the driver's tables the shapes of trajectories, cells, pixels and their settings, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of a frame and start of frame 0, in seconds.
FRAME_SECONDS, FIRST_SECOND = 43_200, 1_704_067_200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frame_of(ts: Column) -> Column:
    """Whole frames since the first, by wall clock: the session's time zone plays no part."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return F.floor(F.timestamp_diff("SECOND", start, ts.cast("timestamp_ntz")) / FRAME_SECONDS).cast("int")


def trajectories(spark: SparkSession, sf_dir: str, last: bool = False) -> DataFrame:
    """One row per user and frame from the first (or last) event in it; frames without events are gaps."""
    events = table(spark, sf_dir, "events").withColumn("frame_number", frame_of(F.col("ts")))
    pick = F.max if last else F.min
    rows = events.groupBy("user_id", "frame_number").agg(pick(F.struct("ts", "event_id", "value", "props")).alias("e"))
    k = F.get_json_object("e.props", "$.k").cast("int")
    return rows.select(
        F.concat(F.lit("ds"), F.col("user_id") % 4).alias("dataset"),
        (F.col("user_id") % 6).cast("int").alias("position"),
        F.col("user_id").alias("crop_index"),
        "frame_number",
        k.alias("k"),
        F.col("e.value").alias("value"),
        F.log1p("e.value").alias("polar_r"),
        (k * F.lit(3.141592653589793) / 100).alias("polar_theta"),
        (F.col("e.value") / 50 - 1).alias("rho"),
    )


def _trajectory_sql(name: str, order: str) -> str:
    return f"""{name} AS (
  SELECT 'ds' || (user_id % 4) AS dataset, CAST(user_id % 6 AS INTEGER) AS position, user_id AS crop_index, frame_number, k, value,
         ln(1 + value) AS polar_r, k * 3.141592653589793 / 100 AS polar_theta, value / 50 - 1 AS rho
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
               row_number() OVER (PARTITION BY user_id, frame_number ORDER BY ts {order}, event_id {order}) AS rn
        FROM (SELECT *, CAST(floor((epoch(date_trunc('second', ts)) - {FIRST_SECOND}) / {FRAME_SECONDS}) AS INTEGER) AS frame_number FROM events))
  WHERE rn = 1)"""


T_SQL = _trajectory_sql("t", "ASC")
U_SQL = _trajectory_sql("u", "DESC")

#: Fixed settings of the four data sets; the same text serves Spark and the check.
FLOW = """SELECT dataset, ordinal, start_frame, stop_frame, CAST(shear AS DOUBLE) AS shear_stress FROM (VALUES
  ('ds0', 0, 0, 59, 6), ('ds1', 0, 0, 29, 6), ('ds1', 1, 30, 59, 20), ('ds2', 0, 0, 59, 12), ('ds3', 0, 0, 19, 9), ('ds3', 1, 20, 59, 24))
  AS v(dataset, ordinal, start_frame, stop_frame, shear)"""
ANNOTATIONS = """SELECT dataset, position, annotation, start_frame, stop_frame FROM (VALUES
  ('ds2', 0, 'not_steady_state', 0, 9), ('ds2', 2, 'not_steady_state', 0, 9), ('ds2', 4, 'not_steady_state', 0, 9),
  ('ds3', 1, 'not_steady_state', 0, 9), ('ds3', 3, 'not_steady_state', 0, 9), ('ds3', 5, 'not_steady_state', 5, 12),
  ('ds0', 0, 'cell_piling', 50, 59), ('ds2', 0, 'cell_piling', 50, 59), ('ds3', 3, 'cell_piling', 50, 59),
  ('ds0', 2, 'scope_error', 17, 17), ('ds1', 1, 'scope_error', 3, 3), ('ds1', 3, 'not_steady_state', 0, 9), ('ds1', 3, 'not_steady_state', 40, 44),
  ('ds2', 4, 'scope_error', 5, 14)) AS v(dataset, position, annotation, start_frame, stop_frame)"""
DUST = """SELECT dataset, position, annotation FROM (VALUES ('ds0', 4, 'dust'), ('ds1', 5, 'dust'), ('ds3', 1, 'edge'))
  AS v(dataset, position, annotation)"""
DATASETS = """SELECT dataset, duration, CAST(minutes AS DOUBLE) AS time_interval_in_minutes, CAST(pixel AS DOUBLE) / 1000 AS pixel_size_xy_in_um,
  replicate_number, stability_category, date FROM (VALUES
  ('ds0', 60, 720, 383, 1, 'stable', '20240101'), ('ds1', 60, 720, 383, 2, 'bistable', '20240102'),
  ('ds2', 58, 720, 271, 1, 'stable', '20240103'), ('ds3', 60, 720, 271, 2, 'unstable', '20240104'))
  AS v(dataset, duration, minutes, pixel, replicate_number, stability_category, date)"""


def setting(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


#: Cells on frames: lineitem rows are cells (label = line number), orders are tracking rows, customers are nuclei counts.
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("label"), F.col("l_quantity").alias("area"), F.col("l_extendedprice").alias("intensity"), F.col("l_discount").alias("eccentricity")
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight by eight pixels a vector: (position, frame_number, y, x, intensity, label)."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("position"), F.col("vec_id").alias("frame_number"), F.posexplode("embedding").alias("at", "v"))
    v = F.col("v").cast("double")
    label = F.when(v < -0.1, 1).when(v < 0, 2).when(v < 0.1, 3).otherwise(4)
    return rows.select("position", "frame_number", F.floor(F.col("at") / 8).cast("int").alias("y"), (F.col("at") % 8).alias("x"), v.alias("intensity"), label.alias("label"))


PX_SQL = """px AS (
  SELECT label AS position, vec_id AS frame_number, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS intensity,
         CASE WHEN CAST(embedding[i] AS DOUBLE) < -0.1 THEN 1 WHEN CAST(embedding[i] AS DOUBLE) < 0 THEN 2 WHEN CAST(embedding[i] AS DOUBLE) < 0.1 THEN 3 ELSE 4 END AS label
  FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM embeddings))"""
