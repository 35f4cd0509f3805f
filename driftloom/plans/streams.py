"""Queries that run as streams over the events table until all of it is read (STM)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftloom.registry import query
from driftloom.sources.scratch import shared_folder
from driftloom.sources.tables import table
from driftloom.streaming import streams


def _run(spark, sf, make, mode, closed=False):
    """Stream the events file once through ``make`` and return what it wrote."""
    folder = f"{shared_folder(spark)}/driftloom-{uuid.uuid4().hex}"
    schema = table(spark, sf, "events").schema
    # The glob lets the stream read the table whether it is a file or a folder of files.
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events.parqu*")
    source = source.withColumn("ts", F.col("ts").cast("timestamp"))
    if closed:
        # What waits for the watermark comes out when time goes on: a row of no user, long after the last event, ends the stream.
        last = table(spark, sf, "events").agg(F.max(F.col("ts").cast("timestamp")).alias("ts"))
        last.select(*(F.lit(-1 if c.name == "user_id" else None).cast(c.dataType).alias(c.name) if c.name != "ts" else (F.col("ts") + F.expr("interval 365 days")).alias("ts") for c in source.schema)).write.parquet(f"{folder}/end")
        source = source.unionByName(spark.readStream.schema(source.schema).parquet(f"{folder}/end"))
    out = make(source)
    if mode == "append":
        writer = out.writeStream.format("parquet").option("path", f"{folder}/out").outputMode("append")
    else:
        writer = out.writeStream.foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{folder}/out")).outputMode(mode)
    writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query(
    "stm01_differences",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER w AS n, value - lag(value) OVER w AS difference FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s(user_id, event_id, n, y, difference) AS (SELECT user_id, event_id, n, value, difference FROM e WHERE n = 1
      UNION ALL SELECT e.user_id, e.event_id, e.n, 0.7 * s.y + 0.3 * e.value, e.difference FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, event_id, round(difference, 6) AS difference, round(y, 6) AS ema FROM s""",
)
def stm01(spark, sf):
    out = _run(spark, sf, streams.with_differences, "append", closed=True).where("user_id >= 0")
    return out.select("user_id", "event_id", F.round("difference", 6).alias("difference"), F.round("ema", 6).alias("ema"))


@query("stm02_first_passages", "SELECT user_id, arg_min(event_id, row(ts, event_id)) AS event_id FROM events WHERE value >= 200 GROUP BY 1")
def stm02(spark, sf):
    return _run(spark, sf, lambda df: streams.first_passages(df, 200.0), "complete")


@query(
    "stm02b_passage_alarms",
    "SELECT user_id, event_id FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quiet FROM events WHERE value >= 100) WHERE quiet IS NULL OR quiet > INTERVAL 5 DAY",
)
def stm02b(spark, sf):
    out = _run(spark, sf, lambda df: streams.passage_alarms(df, 100.0, quiet="5 days"), "append", closed=True)
    return out.where("user_id >= 0").select("user_id", "event_id")


@query("stm03_outlier_counts", "SELECT date_trunc('day', ts) AS day, event_type, CAST(sum((value < 5 OR value > 150)::INT) AS BIGINT) AS n_outliers, count(*) AS n FROM events GROUP BY ALL")
def stm03(spark, sf):
    return _run(spark, sf, lambda df: streams.outlier_counts(df, 5.0, 150.0), "complete")
