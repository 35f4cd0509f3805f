"""Measurements of labelled regions from long pixel tables: (position, frame_number, y, x, label, intensity)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftloom.functions.angles import PI
from driftloom.sources.scratch import settled

FRAME = ["position", "frame_number"]


def region_table(px: DataFrame, height: int, width: int) -> DataFrame:
    """One row a region: area, centroid, box, intensities, second moments with axes, eccentricity and orientation, border contact."""
    x, y, v = F.col("x"), F.col("y"), F.col("intensity")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    edge = (y == 0) | (x == 0) | (y == height - 1) | (x == width - 1)
    g = px.groupBy(*FRAME, "label").agg(
        F.count("*").alias("area"), F.avg(y).alias("cy"), F.avg(x).alias("cx"), F.min(y).alias("y0"), F.min(x).alias("x0"), (F.max(y) + 1).alias("y1"), (F.max(x) + 1).alias("x1"),
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), q.alias("__q"),
        F.var_pop(y).alias("__yy"), F.var_pop(x).alias("__xx"), F.covar_pop(y, x).alias("__xy"), F.bool_or(edge).alias("touches_border"),
    )
    # A pixel is a square, so each adds a twelfth to its own second moment.
    a, b, c = F.col("__yy") + 1 / 12, F.col("__xx") + 1 / 12, F.col("__xy")
    root = F.sqrt(((a - b) / 2) ** 2 + c * c)
    l1, l2 = (a + b) / 2 + root, (a + b) / 2 - root
    shape = {
        "q25": F.col("__q")[0], "median": F.col("__q")[1], "q75": F.col("__q")[2], "major_axis": 4 * F.sqrt(l1), "minor_axis": 4 * F.sqrt(F.greatest(l2, F.lit(0.0))),
        "eccentricity": F.sqrt(F.greatest(F.lit(0.0), 1 - l2 / l1)), "orientation": F.when((a == b) & (c == 0), PI / 4).otherwise(F.atan2(-2 * c, b - a) / 2),
    }
    return g.withColumns(shape).drop("__q", "__yy", "__xx", "__xy")


def best_overlaps(cells: DataFrame, nuclei: DataFrame) -> DataFrame:
    """(frame, cell, nucleus, fraction): for each cell the nuclei with the largest share of their pixels in it; ties stay."""
    n = nuclei.select(*FRAME, "y", "x", F.col("label").alias("nucleus"))
    sizes = n.groupBy(*FRAME, "nucleus").agg(F.count("*").alias("__size"))
    both = cells.join(n, [*FRAME, "y", "x"]).groupBy(*FRAME, "label", "nucleus").agg(F.count("*").alias("__n"))
    rows = both.join(sizes, [*FRAME, "nucleus"]).withColumn("fraction", F.col("__n") / F.col("__size"))
    rank = F.dense_rank().over(Window.partitionBy(*FRAME, "label").orderBy(F.desc("fraction")))
    return rows.withColumn("__r", rank).where("__r = 1").select(*FRAME, "label", "nucleus", "fraction")


def neighbours(px: DataFrame, background: int = 0) -> DataFrame:
    """(frame, label, neighbours): sorted labels in contact over edges or corners, without the background."""
    around = F.explode(F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx)))
    moved = px.select(*FRAME, "y", "x", F.col("label").alias("__a"), around.alias("o")).select(*FRAME, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "__a")
    pairs = moved.join(px, [*FRAME, "y", "x"]).where((F.col("__a") != F.col("label")) & (F.col("__a") != background) & (F.col("label") != background))
    return pairs.groupBy(*FRAME, F.col("__a").alias("label")).agg(F.array_sort(F.collect_set(F.col("label"))).alias("neighbours"))


def focus_planes(px: DataFrame, plane: str) -> DataFrame:
    """(frame, plane) with the smallest spread of intensity; ties go to the lower plane."""
    spread = px.groupBy(*FRAME, plane).agg(F.stddev_pop("intensity").alias("s"))
    return spread.groupBy(*FRAME).agg(F.min_by(plane, F.struct("s", plane)).alias(plane))


def intensity_threshold(px: DataFrame, percent: float, width: int, keys: list[str] = FRAME) -> DataFrame:
    """Percentile of every tenth pixel; no threshold (minus infinity) for percentages of 0 and less."""
    if percent <= 0:
        return px.select(*keys).distinct().withColumn("threshold", F.lit(float("-inf")))
    tenth = px.where((F.col("y") * width + F.col("x")) % 10 == 0)
    return tenth.groupBy(*keys).agg(F.percentile("intensity", percent / 100).alias("threshold"))


def relabelled(px: DataFrame, mapping: DataFrame) -> DataFrame:
    """Labels replaced by (label, new_label); labels without one become 0."""
    return px.join(mapping, "label", "left").withColumn("label", F.coalesce("new_label", F.lit(0))).drop("new_label")


def nearest_links(by_gap: list[DataFrame]) -> DataFrame:
    """Links over skipped frames from one-to-one links of frames 1, 2, 3 … apart: (position, frame_number, label, next_frame, next_label).

    A label goes on in the nearest frame that it links to, and a label continues the newest record that links to it: shorter
    gaps come first on both sides. There are as many rounds as gaps.
    """
    accepted = None
    for gap, links in enumerate(by_gap, 1):
        links = links.select(*FRAME, "label", (F.col("frame_number") + gap).alias("next_frame"), "next_label")
        if accepted is not None:
            links = links.join(accepted, [*FRAME, "label"], "left_anti").join(accepted, ["position", "next_frame", "next_label"], "left_anti").select(*accepted.columns)
        links = settled(links)
        accepted = links if accepted is None else accepted.unionByName(links)
    return accepted


def unmatched_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Labels that continue no track; they begin new ones."""
    taken = links.select("position", F.col("next_frame").alias("frame_number"), F.col("next_label").alias("label"))
    return nodes.select(*FRAME, "label").distinct().join(taken, [*FRAME, "label"], "left_anti")


def tracks(links: DataFrame, nodes: DataFrame, rounds: int = 32) -> DataFrame:
    """(position, frame_number, label, track_id) from links (position, frame_number, label, next_frame, next_label) between frames.

    A node's root is the first of its chain of links. Pointers double in length every round, so the rounds grow with the logarithm
    of the number of frames. Ids are the roots' indices in sorted order.
    """
    from driftloom.operators.windows import with_dense_index

    node = lambda f, l: F.struct(F.col("position").alias("p"), F.col(f).alias("f"), F.col(l).alias("l"))
    at = links.select(node("next_frame", "next_label").alias("n"), node("frame_number", "label").alias("to"))
    at = settled(nodes.select(node("frame_number", "label").alias("n")).join(at, "n", "left").withColumn("to", F.coalesce("to", "n")))
    for _ in range(rounds):
        ahead = at.toDF("to", "further")
        new = settled(at.join(ahead, "to").select("n", F.col("further").alias("to"), (F.col("further") != F.col("to")).alias("moved")))
        at, moving = new.drop("moved"), not new.where("moved").isEmpty()
        if not moving:
            break
    else:
        raise ValueError(f"links still lead on after {rounds} rounds: they run in a circle")
    indexed = with_dense_index(at, ["to"], "track_id")
    return indexed.select(F.col("n.p").alias("position"), F.col("n.f").alias("frame_number"), F.col("n.l").alias("label"), "track_id")
