"""Row filters. A comparison with null keeps no row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.arrays import clamped_bin
from driftloom.operators import annotations as ann

TRACK = ["dataset", "position", "crop_index"]


def non_empty(df: DataFrame, what: str) -> DataFrame:
    """The table, or ValueError if it has no row. This runs a job."""
    if df.isEmpty():
        raise ValueError(f"no rows are left after {what}")
    return df


def by_track_length(df: DataFrame, least: int, strict: bool = False) -> DataFrame:
    kept = df.where(F.col("track_duration") >= least)
    return non_empty(kept, "the filter by track length") if strict else kept


def by_annotations(
    df: DataFrame, datasets: DataFrame, positions: DataFrame, position_annotations: DataFrame, frame_annotations: DataFrame,
    position_kinds: list[str] | None = None, frame_kinds: list[str] | None = None,
) -> DataFrame:
    """Rows at positions without the annotations and at frames without them. None means all kinds, an empty list none.

    Positions that ``positions`` lacks are dropped, and so are frames outside the data set's duration. The interval tables
    are settings; each side of a join that grows is the filtered table alone.
    """
    allowed = ann.unannotated_positions(positions, position_annotations, position_kinds)
    kept = df.join(allowed, ann.KEYS, "left_semi").join(datasets.select("dataset", "duration"), "dataset")
    kept = kept.where((F.col("frame_number") >= 0) & (F.col("frame_number") < F.col("duration"))).drop("duration")
    return kept.join(ann.annotated_frames(frame_annotations, frame_kinds), [*ann.KEYS, "frame_number"], "left_anti")


def steady_state(df: DataFrame, datasets: DataFrame, positions: DataFrame, position_annotations: DataFrame, frame_annotations: DataFrame) -> DataFrame:
    return by_annotations(df, datasets, positions, position_annotations, frame_annotations, [], ["not_steady_state"])


def with_condition(df: DataFrame, flow: DataFrame) -> DataFrame:
    """Rows with the ordinal and shear stress of their condition: all frames for one condition, split at the second's start for two."""
    settings = flow.groupBy("dataset").agg(
        F.count("*").alias("n"), F.max_by("start_frame", "ordinal").alias("change"), F.min_by("shear_stress", "ordinal").alias("s0"), F.max_by("shear_stress", "ordinal").alias("s1")
    )
    second = (F.col("n") > 1) & (F.col("frame_number") >= F.col("change"))
    rows = df.join(settings, "dataset").withColumns({"ordinal": second.cast("int"), "shear_stress": F.when(second, F.col("s1")).otherwise(F.col("s0"))})
    return rows.drop("n", "change", "s0", "s1")


def in_same_bin(df: DataFrame, point: dict[str, float], edges: dict[str, list[float]]) -> DataFrame:
    """Rows in the bin of a point on every axis. Rows beyond the edges count to the end bins; a point beyond them is an error."""
    kept = F.lit(True)
    for name, value in point.items():
        e = edges[name]
        if not e[0] <= value <= e[-1]:
            raise ValueError(f"{name} = {value} lies outside its edges")
        k = min(len(e) - 2, sum(x <= value for x in e) - 1)
        kept = kept & (clamped_bin(F.col(name), F.array(*map(F.lit, e))) == k)
    return df.where(F.coalesce(kept, F.lit(False)))


def quality_flags(df: DataFrame, area: str, at_edge: Column, least_duration: int = 24, most_change: float = 0.1, least_valid: int = 20) -> DataFrame:
    """Boolean flags of a row and ``is_included``: all of them, on tracks with enough rows that have all."""
    w = Window.partitionBy(*TRACK).orderBy("frame_number")
    whole = Window.partitionBy(*TRACK)
    change = F.col(area) - F.lag(area).over(w)
    rows = df.withColumns({"__change": change, "track_duration": F.max("frame_number").over(whole) - F.min("frame_number").over(whole)})
    flags = {
        "long_enough": F.col("track_duration") > least_duration,
        "small_change": F.coalesce(F.abs("__change") < most_change, F.lit(False)),
        "inside": F.coalesce(~at_edge, F.lit(False)),
    }
    rows = rows.withColumns(flags).withColumn("valid", F.col("long_enough") & F.col("small_change") & F.col("inside"))
    rows = rows.withColumn("n_valid", F.sum(F.col("valid").cast("int")).over(whole))
    return rows.withColumn("is_included", F.col("valid") & (F.col("n_valid") > least_valid)).drop("__change")


def reaching(df: DataFrame, distance: str, radius: float) -> DataFrame:
    """Trajectories that ever come within the radius."""
    near = df.where(F.col(distance) <= radius).select(*TRACK).distinct()
    return df.join(near, TRACK, "left_semi")


def inside_box(x: Column, low: Column, high: Column) -> Column:
    """Between two percentiles; a periodic box may wrap, so that low is above high."""
    return F.coalesce(F.when(low <= high, (x >= low) & (x <= high)).otherwise((x >= low) | (x <= high)), F.lit(False))


def flag_columns(df: DataFrame, annotations: DataFrame, kinds: list[str]) -> DataFrame:
    """A 0/1 column for each kind: whether an interval of it holds the row's frame."""
    marks = ann.of_kinds(annotations, kinds).select(*ann.KEYS, "annotation", F.explode(F.sequence("start_frame", "stop_frame")).alias("frame_number"))
    marks = marks.groupBy(*ann.KEYS, "frame_number").pivot("annotation", kinds).agg(F.lit(1))
    return df.join(marks, [*ann.KEYS, "frame_number"], "left").fillna(0, kinds)


def nearest_slice(df: DataFrame, axis: str, value: float) -> DataFrame:
    """Rows at the axis value(s) nearest to a value; ties stay."""
    nearest = df.agg(F.min(F.abs(F.col(axis) - F.lit(value))).alias("__d"))
    return df.join(F.broadcast(nearest), F.abs(F.col(axis) - F.lit(value)) == F.col("__d")).drop("__d")


def from_entry(df: DataFrame, in_bin: Column) -> DataFrame:
    """Rows of a trajectory from the first frame at which it is in the bin."""
    entry = df.where(in_bin).groupBy(*TRACK).agg(F.min("frame_number").alias("__entry"))
    return df.join(entry, TRACK).where(F.col("frame_number") >= F.col("__entry")).drop("__entry")
