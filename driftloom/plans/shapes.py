"""Queries of sorts (SRT), sets (SET) and reshaping (RSH)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.operators.grid import Axis, cells, histogram
from driftloom.registry import query
from driftloom.sources.tables import DATASETS, T_SQL, U_SQL, setting, table, trajectories

W = f"WITH {T_SQL}, {U_SQL}, ds AS ({DATASETS})"
KEY = ["crop_index", "frame_number"]
COLS = "crop_index, frame_number"


def r(c, name, digits=9):
    return F.round(c, digits).alias(name)


@query("srt01_sorted", f"{W} SELECT {COLS}, k FROM t ORDER BY crop_index, frame_number")
def srt01(spark, sf):
    return trajectories(spark, sf).orderBy(*KEY).select(*KEY, "k")


@query(
    "srt02_category_order",
    f"{W} SELECT dataset, stability_category, n, row_number() OVER (ORDER BY CASE stability_category WHEN 'unstable' THEN 0 WHEN 'stable' THEN 1 ELSE 2 END, n DESC, replicate_number) AS place FROM (SELECT dataset, count(*) AS n FROM t GROUP BY 1) JOIN ds USING (dataset)",
)
def srt02(spark, sf):
    counts = trajectories(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")).join(setting(spark, DATASETS), "dataset")
    order = F.when(F.col("stability_category") == "unstable", 0).when(F.col("stability_category") == "stable", 1).otherwise(2)
    place = F.row_number().over(Window.orderBy(order, F.desc("n"), "replicate_number"))  # one row a data set
    return counts.select("dataset", "stability_category", "n", place.alias("place"))


@query(
    "srt03_summary_order",
    "SELECT p_type, n, row_number() OVER (ORDER BY p_type = 'ECONOMY', CAST(split_part(size_text, ' ', 1) AS INTEGER), p_type) AS place FROM (SELECT p_type, max(p_size) || ' units' AS size_text, count(*) AS n FROM part GROUP BY 1)",
)
def srt03(spark, sf):
    g = table(spark, sf, "part").groupBy("p_type").agg(F.concat(F.max("p_size").cast("string"), F.lit(" units")).alias("size_text"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("p_type") == "ECONOMY", F.split("size_text", " ")[0].cast("int"), "p_type")  # one row a type
    return g.select("p_type", "n", F.row_number().over(order).alias("place"))


@query("srt04_top_k", f"{W} SELECT crop_index, count(DISTINCT frame_number) AS n FROM t GROUP BY 1 ORDER BY n DESC, crop_index LIMIT 10")
def srt04(spark, sf):
    return trajectories(spark, sf).groupBy("crop_index").agg(F.count_distinct("frame_number").alias("n")).orderBy(F.desc("n"), "crop_index").limit(10)


@query("srt05_first_keys", f"{W} SELECT {COLS} FROM t WHERE crop_index IN (SELECT DISTINCT crop_index FROM t ORDER BY 1 LIMIT 5)")
def srt05(spark, sf):
    t = trajectories(spark, sf)
    return t.join(t.select("crop_index").distinct().orderBy("crop_index").limit(5), "crop_index", "left_semi").select(*KEY)


@query("srt06_argmin", f"{W} SELECT dataset, frame_number, arg_min(crop_index, value) AS low, arg_max(crop_index, value) AS high FROM t GROUP BY ALL")
def srt06(spark, sf):
    # Of equal values the smallest index, so that reruns agree. Rows without a value take no part, as in SQL: in a struct, null would be least.
    low, high = (F.when(F.col("value").isNotNull(), F.struct("value", index)) for index in (F.col("crop_index"), -F.col("crop_index")))
    return trajectories(spark, sf).groupBy("dataset", "frame_number").agg(F.min_by("crop_index", low).alias("low"), F.max_by("crop_index", high).alias("high"))


@query("srt07_angle_order", f"{W}, m AS (SELECT dataset, position, avg(k) AS a FROM t GROUP BY ALL) SELECT dataset, position, row_number() OVER (PARTITION BY dataset ORDER BY (a + 50) - 100 * floor((a + 50) / 100), position) AS place FROM m")
def srt07(spark, sf):
    from driftloom.functions.angles import rewrap

    m = trajectories(spark, sf).groupBy("dataset", "position").agg(F.avg("k").alias("a"))
    return m.select("dataset", "position", F.row_number().over(Window.partitionBy("dataset").orderBy(rewrap(F.col("a"), -50.0, 100.0), "position")).alias("place"))


@query("srt08_every_tenth", f"{W}, i AS (SELECT crop_index, row_number() OVER (ORDER BY crop_index) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT crop_index FROM t)) SELECT {COLS} FROM t WHERE crop_index IN (SELECT crop_index FROM i WHERE n <= 100 OR (rn - 1) % 10 = 0)")
def srt08(spark, sf):
    from driftloom.operators.sampling import every_nth_key

    return every_nth_key(trajectories(spark, sf), ["crop_index"], 10).select(*KEY)


@query("set01_union", f"{W} SELECT {COLS}, k FROM t UNION ALL SELECT {COLS}, k FROM u")
def set01(spark, sf):
    return trajectories(spark, sf).select(*KEY, "k").unionByName(trajectories(spark, sf, last=True).select("k", *KEY))


@query("set02_ragged_union", f"{W} SELECT {COLS}, k, NULL::DOUBLE AS rho FROM t UNION ALL SELECT {COLS}, NULL, round(rho, 9) FROM u")
def set02(spark, sf):
    return trajectories(spark, sf).select(*KEY, "k").unionByName(trajectories(spark, sf, last=True).select(*KEY, r("rho", "rho")), allowMissingColumns=True)


@query("set03_pooled", f"{W} SELECT patch_type, count(*) AS n, count(DISTINCT crop_index) AS tracks FROM (SELECT 'grid_based' AS patch_type, crop_index FROM t UNION ALL SELECT 'cell_centered', crop_index FROM u) GROUP BY 1")
def set03(spark, sf):
    a = trajectories(spark, sf).select(F.lit("grid_based").alias("patch_type"), "crop_index")
    both = a.union(trajectories(spark, sf, last=True).select(F.lit("cell_centered"), "crop_index"))
    return both.groupBy("patch_type").agg(F.count("*").alias("n"), F.count_distinct("crop_index").alias("tracks"))


@query("set04_difference", f"{W} SELECT dataset, position, k FROM t EXCEPT SELECT dataset, position, k FROM u")
def set04(spark, sf):
    c = ["dataset", "position", "k"]
    return trajectories(spark, sf).select(*c).subtract(trajectories(spark, sf, last=True).select(*c))


@query("set05_distinct_first", f"{W} SELECT dataset, k, arg_min(crop_index, (frame_number, crop_index)) AS crop_index, min(frame_number) AS frame_number FROM t GROUP BY ALL")
def set05(spark, sf):
    first = F.min(F.struct("frame_number", "crop_index")).alias("s")
    return trajectories(spark, sf).groupBy("dataset", "k").agg(first).select("dataset", "k", "s.crop_index", "s.frame_number")


@query("set06_known_columns", "SELECT user_id, value FROM events")
def set06(spark, sf):
    rows = table(spark, sf, "events")
    return rows.select(*(c for c in ("user_id", "value", "no_such_column") if c in rows.columns))


@query("rsh01_pivot", f"{W} SELECT crop_index, " + ", ".join(f"arg_min(k, frame_number) FILTER (frame_number % 3 = {j}) AS dt_{j}" for j in range(3)) + " FROM t GROUP BY 1")
def rsh01(spark, sf):
    rows = trajectories(spark, sf).withColumn("dt", F.col("frame_number") % 3)
    wide = rows.groupBy("crop_index").pivot("dt", [0, 1, 2]).agg(F.min_by("k", "frame_number"))
    return wide.withColumnsRenamed({str(j): f"dt_{j}" for j in range(3)})


@query("rsh02_absent_columns", f"{W} SELECT {COLS}, k, NULL::DOUBLE AS mean_speed, NULL::DOUBLE AS mean_angle FROM t")
def rsh02(spark, sf):
    rows = trajectories(spark, sf).select(*KEY, "k")
    return rows.withColumns({c: F.lit(None).cast("double") for c in ("mean_speed", "mean_angle") if c not in rows.columns})


@query("rsh03_melt", f"{W} SELECT {COLS}, feature, round(v, 9) AS v FROM (SELECT {COLS}, unnest(['polar_r', 'rho']) AS feature, unnest([polar_r, rho]) AS v FROM t)")
def rsh03(spark, sf):
    return trajectories(spark, sf).unpivot(KEY, ["polar_r", "rho"], "feature", "v").withColumn("v", F.round("v", 9))


@query("rsh04_grid_axes", f"{W}, g AS (SELECT k // 10 AS i, CAST(floor(value / 50) AS INTEGER) AS j, count(*) AS n FROM t GROUP BY ALL) SELECT i, list(j ORDER BY j) AS js, list(n ORDER BY j) AS ns FROM g GROUP BY i")
def rsh04(spark, sf):
    g = trajectories(spark, sf).groupBy(F.floor(F.col("k") / 10).cast("int").alias("i"), F.floor(F.col("value") / 50).cast("int").alias("j")).agg(F.count("*").alias("n"))
    s = g.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "n"))).alias("s"))
    return s.select("i", F.transform("s", lambda x: x["j"]).alias("js"), F.transform("s", lambda x: x["n"]).alias("ns"))


@query("rsh05_split_array", "SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS y, round(CAST(embedding[2] AS DOUBLE), 6) AS x FROM embeddings")
def rsh05(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r(F.col("embedding")[0].cast("double"), "y", 6), r(F.col("embedding")[1].cast("double"), "x", 6))


@query("rsh06_cartesian", f"{W}, h AS (SELECT k // 10 AS i0, least(5, CAST(floor(value / 100) AS INTEGER)) AS i1, count(*) AS n FROM t GROUP BY ALL) SELECT CAST(a AS INTEGER) AS i0, CAST(b AS INTEGER) AS i1, coalesce(n, 0) AS n FROM (SELECT unnest(generate_series(0, 9)) AS a), (SELECT unnest(generate_series(0, 4)) AS b) LEFT JOIN h ON i0 = a AND i1 = b")
def rsh06(spark, sf):
    axes = [Axis("k", 0.0, 10.0, 10), Axis("value", 0.0, 100.0, 5)]
    h = histogram(trajectories(spark, sf), axes, {"n": F.lit(1)})
    return cells(spark, axes).select("i0", "i1").join(h, ["i0", "i1"], "left").fillna(0, ["n"])


@query("rsh07_renamed", f"{W} SELECT crop_index, frame_number, k AS k_grid, round(rho, 9) AS rho_grid FROM t")
def rsh07(spark, sf):
    return trajectories(spark, sf).select(*KEY, "k", r("rho", "rho")).withColumnsRenamed({c: c + "_grid" for c in ("k", "rho")})


@query("udf01_kernel_by_name", f"{W} SELECT {COLS}, round(exp(-((rho / 0.4) ** 2) / 2) / sqrt(2 * 3.141592653589793) / 0.4, 6) AS w FROM t")
def udf01(spark, sf):
    from driftloom.functions.hooks import KERNELS

    return trajectories(spark, sf).select(*KEY, r(KERNELS["gaussian"](F.col("rho"), 0.4), "w", 6))


@query(
    "udf02_own_metric",
    f"{W}, p AS (SELECT t.dataset, t.frame_number, t.crop_index AS a, u.crop_index AS b, abs(t.k - u.k) AS d FROM t JOIN u ON t.dataset = u.dataset AND t.frame_number = u.frame_number WHERE t.position = 0 AND u.position <> 0), m AS (SELECT *, row_number() OVER (PARTITION BY dataset, frame_number, a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY dataset, frame_number, b ORDER BY d, a) AS rb FROM p) SELECT dataset, frame_number, a, b FROM m WHERE ra = 1 AND rb = 1",
)
def udf02(spark, sf):
    from driftloom.operators.joins import best_pairs

    frame = ["dataset", "frame_number"]
    a, b = trajectories(spark, sf).where("position = 0"), trajectories(spark, sf, last=True).where("position <> 0")
    # Equal values are equally far from all others and ties go to the smaller partner, so only the smallest of equals can be best of both.
    a = a.groupBy(*frame, F.col("k").alias("ka")).agg(F.min("crop_index").alias("a"))
    b = b.groupBy(*frame, F.col("k").alias("kb")).agg(F.min("crop_index").alias("b"))
    return best_pairs(a.join(b, frame), [*frame, "a"], [*frame, "b"], F.abs(F.col("ka") - F.col("kb")), "asc").select(*frame, "a", "b")


@query("udf03_grouped_map", f"{W} SELECT crop_index, frame_number, round(value - min(value) OVER (PARTITION BY crop_index), 6) AS value FROM t")
def udf03(spark, sf):
    def above_least(pdf):
        return pdf.assign(value=pdf["value"] - pdf["value"].min())

    rows = trajectories(spark, sf).select(*KEY, "value")
    return rows.groupBy("crop_index").applyInPandas(above_least, rows.schema).select(*KEY, r("value", "value", 6))


@query("udf04_stop_conditions", f"{W}, s AS (SELECT crop_index, frame_number, CASE WHEN rho > 3 THEN 'escaped' WHEN abs(rho) <= 0.05 THEN 'arrived' END AS stop FROM t) SELECT crop_index, arg_min(stop, frame_number) AS stop, min(frame_number) AS frame_number FROM s WHERE stop IS NOT NULL GROUP BY 1")
def udf04(spark, sf):
    from driftloom.functions.hooks import stops

    return stops(trajectories(spark, sf), ["crop_index"], "frame_number", [("escaped", F.col("rho") > 3), ("arrived", F.abs("rho") <= 0.05)])


@query("udf05_own_aggregate", f"{W} SELECT crop_index, round(max(value) - min(value), 6) AS spread FROM t GROUP BY 1")
def udf05(spark, sf):
    from driftloom.functions.hooks import aggregate

    spread = aggregate(lambda x: x.max() - x.min())
    return trajectories(spark, sf).groupBy("crop_index").agg(spread("value").alias("s")).select("crop_index", r("s", "spread", 6))
