"""Queries over pixel tables: regions, contacts, focus and tracks (AGG-29 to AGG-34, STAT-39, STAT-40)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import joins as jn
from driftloom.operators import regions as reg
from driftloom.registry import query
from driftloom.sources.tables import PX_SQL, pixels, table

W = f"WITH {PX_SQL}"


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


@query(
    "agg29_regions",
    f"""{W}, g AS (SELECT position, frame_number, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, avg(intensity) AS mean, stddev_pop(intensity) AS std, quantile_cont(intensity, 0.5) AS median,
      var_pop(y) + 1 / 12.0 AS a, var_pop(x) + 1 / 12.0 AS b, covar_pop(y, x) AS c, bool_or(y IN (0, 7) OR x IN (0, 7)) AS touches_border FROM px GROUP BY ALL),
    l AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c * c) AS l1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c * c) AS l2 FROM g)
    SELECT position, frame_number, label, area, round(cy, 6) AS cy, round(cx, 6) AS cx, y0, x0, y1, x1, round(mean, 6) AS mean, round(std, 6) AS std, round(median, 6) AS median, round(4 * sqrt(l1), 5) AS major_axis, round(4 * sqrt(greatest(l2, 0)), 5) AS minor_axis, touches_border FROM l""",
)
def agg29(spark, sf):
    out = reg.region_table(pixels(spark, sf), 8, 8)
    return out.select("position", "frame_number", "label", "area", r("cy", "cy"), r("cx", "cx"), "y0", "x0", "y1", "x1", r("mean", "mean"), r("std", "std"), r("median", "median"), r("major_axis", "major_axis", 5), r("minor_axis", "minor_axis", 5), "touches_border")


_NUC = "nuc AS (SELECT position, frame_number, y, x, CASE WHEN (y + x) % 3 = 0 THEN 1 WHEN x < 4 THEN 2 ELSE 3 END AS nucleus FROM px)"


@query(
    "agg30_nuclei_of_cells",
    f"""{W}, {_NUC}, s AS (SELECT position, frame_number, nucleus, count(*) AS size FROM nuc GROUP BY ALL), b AS (SELECT px.position, px.frame_number, label, nucleus, count(*) AS n FROM px JOIN nuc USING (position, frame_number, y, x) GROUP BY ALL),
    f AS (SELECT position, frame_number, label, nucleus, n / size::DOUBLE AS fraction FROM b JOIN s USING (position, frame_number, nucleus)), k AS (SELECT *, dense_rank() OVER (PARTITION BY position, frame_number, label ORDER BY fraction DESC) AS rk FROM f)
    SELECT position, frame_number, label, nucleus, round(fraction, 6) AS fraction FROM k WHERE rk = 1""",
)
def agg30(spark, sf):
    px = pixels(spark, sf)
    kind = F.when((F.col("y") + F.col("x")) % 3 == 0, 1).when(F.col("x") < 4, 2).otherwise(3)
    return reg.best_overlaps(px.drop("intensity"), px.withColumn("label", kind)).withColumn("fraction", F.round("fraction", 6))


@query(
    "agg31_neighbours",
    f"{W} SELECT a.position, a.frame_number, a.label, list_sort(list(DISTINCT b.label)) AS neighbours FROM px a JOIN px b ON a.position = b.position AND a.frame_number = b.frame_number AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.label <> b.label AND a.label <> 1 AND b.label <> 1 GROUP BY ALL",
)
def agg31(spark, sf):
    return reg.neighbours(pixels(spark, sf), background=1)


@query("agg32_focus_plane", f"{W}, s AS (SELECT position, frame_number, y, stddev_pop(intensity) AS s FROM px GROUP BY ALL), m AS (SELECT position, frame_number, arg_min(y, s) AS y FROM s GROUP BY ALL) SELECT position, CAST(round_even(avg(y), 0) AS INTEGER) AS center, round(stddev_pop(y), 6) AS std FROM m GROUP BY 1")
def agg32(spark, sf):
    planes = reg.focus_planes(pixels(spark, sf), "y")
    return planes.groupBy("position").agg(F.bround(F.avg("y"), 0).cast("int").alias("center"), r(F.stddev_pop("y"), "std"))


@query("agg33_threshold", f"{W} SELECT position, frame_number, round(quantile_cont(intensity, 0.7), 6) AS threshold FROM px WHERE (y * 8 + x) % 10 = 0 GROUP BY ALL")
def agg33(spark, sf):
    return reg.intensity_threshold(pixels(spark, sf), 70, 8).withColumn("threshold", F.round("threshold", 6))


@query("agg34_image_correlation", f"{W} SELECT a.frame_number, round(corr(a.intensity, b.intensity), 6) AS r FROM px a JOIN px b ON b.frame_number = a.frame_number + 1 AND a.y = b.y AND a.x = b.x GROUP BY 1")
def agg34(spark, sf):
    px = pixels(spark, sf)
    after = px.select((F.col("frame_number") - 1).alias("frame_number"), "y", "x", F.col("intensity").alias("other"))
    return px.join(after, ["frame_number", "y", "x"]).groupBy("frame_number").agg(r(F.corr("intensity", "other"), "r"))


def film(spark, sf):
    """Ten vectors make a film of ten frames."""
    n = F.col("frame_number")
    return pixels(spark, sf).select(F.floor(n / 10).alias("position"), (n % 10).alias("frame_number"), "y", "x", "label")


_FILM = f"""p AS (SELECT frame_number // 10 AS position, frame_number % 10 AS frame_number, y, x, label FROM px),
b AS (SELECT a.position, a.frame_number, a.label, n.label AS next_label, count(*) AS overlap FROM p a JOIN p n ON a.position = n.position AND n.frame_number = a.frame_number + 1 AND a.y = n.y AND a.x = n.x GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY position, frame_number, label ORDER BY overlap DESC, next_label) AS ra, row_number() OVER (PARTITION BY position, frame_number, next_label ORDER BY overlap DESC, label) AS rb FROM b),
k AS (SELECT position, frame_number, label, next_label FROM m WHERE ra = 1 AND rb = 1), nd AS (SELECT DISTINCT position, frame_number, label FROM p),
c AS (SELECT position, frame_number AS rf, label AS rl, frame_number, label FROM nd WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.position = nd.position AND k.frame_number = nd.frame_number - 1 AND k.next_label = nd.label)
  UNION ALL SELECT c.position, rf, rl, c.frame_number + 1, k.next_label FROM c JOIN k ON k.position = c.position AND k.frame_number = c.frame_number AND k.label = c.label)"""


@query("stat39_tracks", f"WITH RECURSIVE {PX_SQL}, {_FILM} SELECT position, frame_number, label, dense_rank() OVER (ORDER BY position, rf, rl) - 1 AS track_id FROM c")
def stat39(spark, sf):
    px = film(spark, sf)
    links = jn.overlap_links(px).withColumn("next_frame", F.col("frame_number") + 1)
    return reg.tracks(links, px.select("position", "frame_number", "label").distinct())


#: Labels that vanish now and then, and tracks that go on over up to two frames without them.
TOLERANCE = 2
_VANISHED = "(frame_number * 3 + label * 5 + position) % 7 < 2"


def _gap_sql() -> str:
    parts = [f"p AS (SELECT * FROM (SELECT frame_number // 10 AS position, frame_number % 10 AS frame_number, y, x, label FROM px) WHERE NOT {_VANISHED})"]
    for k in range(1, TOLERANCE + 2):
        parts.append(f"""b{k} AS (SELECT a.position, a.frame_number, a.label, n.frame_number AS next_frame, n.label AS next_label, count(*) AS overlap
          FROM p a JOIN p n ON a.position = n.position AND n.frame_number = a.frame_number + {k} AND a.y = n.y AND a.x = n.x GROUP BY ALL)""")
        parts.append(f"m{k} AS (SELECT *, row_number() OVER (PARTITION BY position, frame_number, label ORDER BY overlap DESC, next_label) AS ra, row_number() OVER (PARTITION BY position, frame_number, next_label ORDER BY overlap DESC, label) AS rb FROM b{k})")
        earlier = " AND ".join(
            f"NOT EXISTS (SELECT 1 FROM k{j} o WHERE o.position = m{k}.position AND (o.frame_number = m{k}.frame_number AND o.label = m{k}.label OR o.next_frame = m{k}.next_frame AND o.next_label = m{k}.next_label))" for j in range(1, k)
        )
        parts.append(f"k{k} AS (SELECT position, frame_number, label, next_frame, next_label FROM m{k} WHERE ra = 1 AND rb = 1{' AND ' + earlier if earlier else ''})")
    parts.append("k AS (" + " UNION ALL ".join(f"SELECT * FROM k{k}" for k in range(1, TOLERANCE + 2)) + ")")
    parts.append("nd AS (SELECT DISTINCT position, frame_number, label FROM p)")
    parts.append("fresh AS (SELECT * FROM nd WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.position = nd.position AND k.next_frame = nd.frame_number AND k.next_label = nd.label))")
    parts.append("""c AS (SELECT position, frame_number AS rf, label AS rl, frame_number, label FROM fresh
      UNION ALL SELECT c.position, rf, rl, k.next_frame, k.next_label FROM c JOIN k ON k.position = c.position AND k.frame_number = c.frame_number AND k.label = c.label)""")
    return f"WITH RECURSIVE {PX_SQL}, " + ", ".join(parts)


def _gaps(spark, sf):
    px = film(spark, sf).where(f"NOT {_VANISHED}")
    links = reg.nearest_links([jn.overlap_links(px, k) for k in range(1, TOLERANCE + 2)])
    return px.select("position", "frame_number", "label").distinct(), links


@query("stat39b_tracks_over_gaps", f"{_gap_sql()} SELECT position, frame_number, label, dense_rank() OVER (ORDER BY position, rf, rl) - 1 AS track_id FROM c")
def stat39b(spark, sf):
    nodes, links = _gaps(spark, sf)
    return reg.tracks(links, nodes)


@query("jn23b_new_labels", f"{_gap_sql()} SELECT * FROM fresh")
def jn23b(spark, sf):
    return reg.unmatched_labels(*_gaps(spark, sf))


@query("stat40_relabelled", f"{W} SELECT frame_number, y, x, CASE label WHEN 2 THEN 20 WHEN 4 THEN 40 ELSE 0 END AS label FROM px")
def stat40(spark, sf):
    mapping = spark.sql("SELECT * FROM (VALUES (2, 20), (4, 40)) AS v(label, new_label)")
    return reg.relabelled(pixels(spark, sf), mapping).select("frame_number", "y", "x", "label")


@query("jn06b_vectors_per_label", "SELECT label AS position, count(*) AS n FROM embeddings GROUP BY 1")
def jn06b(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("position")).agg(F.count("*").alias("n"))
