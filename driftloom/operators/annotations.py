"""Frame intervals with a kind, and positions with a kind. Intervals are inclusive at both ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["dataset", "position"]


def of_kinds(table: DataFrame, kinds: list[str] | None) -> DataFrame:
    """All rows for None, else those of the kinds; none for an empty list."""
    return table if kinds is None else table.where(F.col("annotation").isin(kinds) if kinds else F.lit(False))


def except_kinds(table: DataFrame, ignored: list[str]) -> DataFrame:
    return table.where(~F.col("annotation").isin(ignored)) if ignored else table


def annotated_positions(annotations: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return of_kinds(annotations, kinds).select(*KEYS).distinct()


def unannotated_positions(positions: DataFrame, annotations: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    return positions.select(*KEYS).distinct().join(of_kinds(annotations, kinds), KEYS, "left_anti")


def annotated_frames(annotations: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Distinct (dataset, position, frame_number) of the intervals."""
    frames = F.explode(F.sequence("start_frame", "stop_frame")).alias("frame_number")
    return of_kinds(annotations, kinds).select(*KEYS, frames).distinct()


def unannotated_frames(positions: DataFrame, datasets: DataFrame, annotations: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Frames 0 to duration - 1 of each position that no interval holds."""
    frames = F.explode(F.sequence(F.lit(0), F.col("duration") - 1)).alias("frame_number")
    every = positions.select(*KEYS).distinct().join(datasets.select("dataset", "duration"), "dataset").select(*KEYS, frames)
    return every.join(annotated_frames(annotations, kinds), [*KEYS, "frame_number"], "left_anti")


def steady_start(positions: DataFrame, datasets: DataFrame, annotations: DataFrame) -> DataFrame:
    """First frame after the last that is not steady; null without such frames or past the end."""
    last = of_kinds(annotations, ["not_steady_state"]).groupBy(*KEYS).agg((F.max("stop_frame") + 1).alias("next"))
    rows = positions.select(*KEYS).distinct().join(datasets.select("dataset", "duration"), "dataset").join(last, KEYS, "left")
    return rows.select(*KEYS, F.when(F.col("next") < F.col("duration"), F.col("next")).alias("start"))


def flow_change(flow: DataFrame) -> DataFrame:
    """Frames before and after the change of flow, for data sets with exactly two conditions; else null."""
    two = F.count("*") == 2
    rows = flow.groupBy("dataset").agg(two.alias("two"), F.min_by("stop_frame", "ordinal").alias("before"), F.max_by("start_frame", "ordinal").alias("after"))
    return rows.select("dataset", F.when(F.col("two"), F.col("before")).alias("before"), F.when(F.col("two"), F.col("after")).alias("after"))


def flow_at(df: DataFrame, flow: DataFrame) -> DataFrame:
    """Rows with the first condition whose closed interval holds the frame; null columns where there is none.

    The few conditions of a data set become one array, so each row meets its own only.
    """
    first = F.array_sort(F.collect_list(F.struct("ordinal", "start_frame", "stop_frame", "shear_stress")))
    conditions = flow.groupBy("dataset").agg(first.alias("conditions"))
    held = F.filter("conditions", lambda c: (c["start_frame"] <= F.col("frame_number")) & (F.col("frame_number") <= c["stop_frame"]))
    found = F.try_element_at(held, F.lit(1))
    rows = df.join(conditions, "dataset", "left").withColumn("__c", found)
    return rows.withColumns({"ordinal": F.col("__c.ordinal"), "shear_stress": F.col("__c.shear_stress")}).drop("conditions", "__c")


def duration_at(flow: DataFrame) -> DataFrame:
    """Sum of stop - start over the intervals of each shear stress."""
    return flow.groupBy("dataset", "shear_stress").agg(F.sum(F.col("stop_frame") - F.col("start_frame")).alias("duration"))
