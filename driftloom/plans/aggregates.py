"""Queries of aggregations (AGG)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.functions import arrays as arr
from driftloom.operators import aggregates as agg
from driftloom.operators import annotations as ann
from driftloom.operators.ranks import circular_percentile, percentiles
from driftloom.operators.windows import with_track_duration
from driftloom.registry import query
from driftloom.sources.tables import ANNOTATIONS, DATASETS, T_SQL, U_SQL, setting, table, trajectories

W = f"WITH {T_SQL}, {U_SQL}, a AS ({ANNOTATIONS}), ds AS ({DATASETS})"
PI = "3.141592653589793"
DIGITS = 7


def r(c, name, digits=DIGITS):
    return F.round(c, digits).alias(name)


def rounded(columns, names):
    return [r(c, n) if n not in ("count", "n") else c.alias(n) for c, n in zip(columns, names, strict=True)]


_DESCRIBE = ", ".join(
    ["count({x}) AS count"]
    + [f"round({e}, {DIGITS}) AS {n}" for n, e in (("mean", "avg({x})"), ("std", "stddev_samp({x})"), ("min", "min({x})"), ("q25", "quantile_cont({x}, 0.25)"), ("q50", "quantile_cont({x}, 0.5)"), ("q75", "quantile_cont({x}, 0.75)"), ("max", "max({x})"))]
)
NAMES = ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]


@query("agg01_describe", f"SELECT l_returnflag, l_linestatus, {_DESCRIBE.format(x='l_extendedprice')} FROM lineitem GROUP BY ALL")
def agg01(spark, sf):
    out = agg.described(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice")
    return out.select("l_returnflag", "l_linestatus", *rounded([F.col(n) for n in NAMES], NAMES))


@query("agg02_sem", "SELECT l_returnflag, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 7) AS sem FROM lineitem GROUP BY ALL")
def agg02(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r(agg.sem(F.col("l_quantity")), "sem"))


@query(
    "agg03_all_bins",
    f"{W}, b AS (SELECT unnest(generate_series(0, 29)) AS i), x AS (SELECT *, CAST(floor(value / 20) AS BIGINT) AS i FROM t) SELECT CAST(b.i AS INTEGER) AS i, b.i * 20.0 + 10.0 AS center, count(value) AS n, round(avg(value), {DIGITS}) AS mean FROM b LEFT JOIN x ON b.i = x.i GROUP BY b.i",
)
def agg03(spark, sf):
    stats = trajectories(spark, sf).groupBy(F.floor(F.col("value") / 20).cast("int").alias("i")).agg(F.count("value").alias("n"), r(F.avg("value"), "mean"))
    bins = spark.range(30).select(F.col("id").cast("int").alias("i"))
    return bins.join(stats, "i", "left").fillna(0, ["n"]).withColumn("center", F.col("i") * F.lit(20.0) + 10.0)


@query(
    "agg04_sweep",
    f"{W}, h AS (SELECT unnest(generate_series(0, 40)) AS j), p AS (SELECT j, crop_index, min(CASE WHEN abs(rho) <= j / 40.0 THEN frame_number END) AS fpt FROM t, h GROUP BY ALL) SELECT CAST(j AS INTEGER) AS j, count(fpt) AS count, round(avg(fpt), {DIGITS}) AS mean, round(stddev_samp(fpt), {DIGITS}) AS std, round(100.0 * count(fpt) / count(*), {DIGITS}) AS percent FROM p GROUP BY j",
)
def agg04(spark, sf):
    # One pass: each trajectory gives one row a threshold, before anything is grouped by thresholds.
    first = [F.min(F.when(F.abs("rho") <= j / 40.0, F.col("frame_number"))) for j in range(41)]
    per = trajectories(spark, sf).groupBy("crop_index").agg(F.array(*first).alias("f")).select("crop_index", F.posexplode("f").alias("j", "fpt"))
    x = F.col("fpt")
    return per.groupBy("j").agg(F.count(x).alias("count"), r(F.avg(x), "mean"), r(F.stddev_samp(x), "std"), r(100 * F.count(x) / F.count("*"), "percent"))


@query("agg05_distinct_tracks", f"{W} SELECT dataset, sum(n)::BIGINT AS n FROM (SELECT dataset, position, count(DISTINCT crop_index) AS n FROM t GROUP BY ALL) GROUP BY 1")
def agg05(spark, sf):
    per = trajectories(spark, sf).groupBy("dataset", "position").agg(F.count_distinct("crop_index").alias("n"))
    return per.groupBy("dataset").agg(F.sum("n").alias("n"))


@query("agg06_tracks_per_frame", f"{W}, n AS (SELECT frame_number, count(DISTINCT crop_index) AS n_all, count(DISTINCT CASE WHEN k < 50 THEN crop_index END) AS n_kept FROM t GROUP BY 1) SELECT crop_index, frame_number, n_all, CASE WHEN k < 50 THEN n_kept END AS n_kept FROM t JOIN n USING (frame_number)")
def agg06(spark, sf):
    t = trajectories(spark, sf)
    per = t.groupBy("frame_number").agg(F.count_distinct("crop_index").alias("n_all"), F.count_distinct(F.when(F.col("k") < 50, F.col("crop_index"))).alias("n_kept"))
    return t.join(per, "frame_number").select("crop_index", "frame_number", "n_all", F.when(F.col("k") < 50, F.col("n_kept")).alias("n_kept"))


@query("agg07_medians", f"{W} SELECT frame_number, round(median(value), {DIGITS}) AS value, round(median(rho), {DIGITS}) AS rho FROM t GROUP BY 1")
def agg07(spark, sf):
    # One ranking of both features: the feature is one more key.
    rows = trajectories(spark, sf).selectExpr("frame_number", "stack(2, 'value', value, 'rho', rho) as (feature, v)")
    per = percentiles(rows, ["frame_number", "feature"], "v", [50])
    value = lambda n: F.max(F.when(F.col("feature") == n, F.col("p")[0]))
    return per.groupBy("frame_number").agg(r(value("value"), "value"), r(value("rho"), "rho"))


@query(
    "agg08_pooled_percentiles",
    """WITH l AS (SELECT l_returnflag AS dataset, unnest(['quantity', 'price']) AS feature, unnest([l_quantity, l_extendedprice]) AS v FROM lineitem)
    SELECT coalesce(dataset, 'ALL_POOLED') AS dataset, feature, round(quantile_cont(v, 0.05), 1) AS p5, round(quantile_cont(v, 0.95), 1) AS p95, count(v) AS n FROM l GROUP BY GROUPING SETS ((dataset, feature), (feature))""",
)
def agg08(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr("l_returnflag as dataset", "stack(2, 'quantity', l_quantity, 'price', l_extendedprice) as (feature, v)")
    rows = rows.withColumn("dataset", F.explode(F.array("dataset", F.lit("ALL_POOLED"))))
    n = rows.groupBy("dataset", "feature").agg(F.count("v").alias("n"))
    out = percentiles(rows, ["dataset", "feature"], "v", [5, 95]).join(n, ["dataset", "feature"])
    return out.select("dataset", "feature", r(F.col("p")[0], "p5", 1), r(F.col("p")[1], "p95", 1), "n")


@query(
    "agg09_two_levels",
    f"{W}, g AS (SELECT dataset, avg(value) AS m, stddev_samp(value) AS s, median(value) AS d, avg(value * pixel_size_xy_in_um) AS um FROM t JOIN ds USING (dataset) GROUP BY 1) SELECT round(avg(m), 6) AS mean, round(avg(s), 6) AS std, round(avg(d), 6) AS median, round(avg(um), 6) AS mean_um, count(*) AS n FROM g",
)
def agg09(spark, sf):
    rows = trajectories(spark, sf).join(setting(spark, DATASETS), "dataset")
    per = rows.groupBy("dataset").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"), F.avg(F.col("value") * F.col("pixel_size_xy_in_um")).alias("um"))
    per = per.join(percentiles(rows, ["dataset"], "value", [50]).select("dataset", F.col("p")[0].alias("d")), "dataset")
    return per.agg(r(F.avg("m"), "mean", 6), r(F.avg("s"), "std", 6), r(F.avg("d"), "median", 6), r(F.avg("um"), "mean_um", 6), F.count("*").alias("n"))


@query("agg10_model_metrics", "SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 7) AS mean, round(stddev_samp(c_acctbal), 7) AS std, count(c_acctbal) AS n FROM customer GROUP BY ALL")
def agg10(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(r(F.avg(x), "mean"), r(F.stddev_samp(x), "std"), F.count(x).alias("n"))


@query("agg11_lists_per_frame", f"{W} SELECT dataset, position, frame_number, list(crop_index ORDER BY crop_index) AS tracks, list(k ORDER BY crop_index) AS xs FROM t GROUP BY ALL")
def agg11(spark, sf):
    g = trajectories(spark, sf).groupBy("dataset", "position", "frame_number").agg(F.array_sort(F.collect_list(F.struct("crop_index", "k"))).alias("s"))
    return g.select("dataset", "position", "frame_number", F.transform("s", lambda x: x["crop_index"]).alias("tracks"), F.transform("s", lambda x: x["k"]).alias("xs"))


@query("agg12_first_then_sum", f"{W}, p AS (SELECT dataset, frame_number, position, arg_min(k, crop_index) AS k, arg_min(CASE WHEN k < 50 THEN k END, CASE WHEN k < 50 THEN crop_index END) AS kept FROM t GROUP BY ALL) SELECT dataset, CAST(sum(k) AS BIGINT) AS before, CAST(sum(kept) AS BIGINT) AS after FROM p GROUP BY 1")
def agg12(spark, sf):
    kept = F.col("k") < 50
    per = trajectories(spark, sf).groupBy("dataset", "frame_number", "position").agg(
        F.min_by("k", "crop_index").alias("k"), F.min_by("k", F.when(kept, F.col("crop_index"))).alias("kept")
    )
    return per.groupBy("dataset").agg(F.sum("k").alias("before"), F.sum("kept").alias("after"))


@query(
    "agg13_annotation_counts",
    f"""{W}, o AS (SELECT *, row_number() OVER (PARTITION BY dataset, position, annotation ORDER BY start_frame) AS n FROM a),
    g AS (SELECT dataset, position, CASE WHEN annotation <> 'not_steady_state' THEN annotation WHEN n = 1 THEN 'adaptation' ELSE 'delamination' END AS grp, start_frame, stop_frame FROM o)
    SELECT t.dataset, grp, count(*) AS n_rows, count(DISTINCT (t.position, t.frame_number)) AS n_frames FROM t JOIN g ON t.dataset = g.dataset AND t.position = g.position AND frame_number BETWEEN start_frame AND stop_frame GROUP BY ALL""",
)
def agg13(spark, sf):
    order = F.row_number().over(Window.partitionBy("dataset", "position", "annotation").orderBy("start_frame"))
    kind = F.when(F.col("annotation") != "not_steady_state", F.col("annotation")).when(F.col("n") == 1, "adaptation").otherwise("delamination")
    marks = setting(spark, ANNOTATIONS).withColumn("n", order).withColumn("grp", kind)
    marks = marks.select("dataset", "position", "grp", F.explode(F.sequence("start_frame", "stop_frame")).alias("frame_number"))
    rows = trajectories(spark, sf).join(marks, ["dataset", "position", "frame_number"])
    return rows.groupBy("dataset", "grp").agg(F.count("*").alias("n_rows"), F.count_distinct("position", "frame_number").alias("n_frames"))


@query(
    "agg14_annotation_quality",
    f"{W}, m AS (SELECT DISTINCT dataset, position, frame_number FROM t WHERE k < 10), x AS (SELECT DISTINCT dataset, position, frame_number FROM u WHERE k < 10) SELECT dataset, count(*) AS n_manual, count(*) FILTER (NOT hit) AS n_missed, round(100.0 * count(*) FILTER (NOT hit) / count(*), 6) AS percent_missed FROM (SELECT m.*, x.dataset IS NOT NULL AS hit FROM m LEFT JOIN x USING (dataset, position, frame_number)) GROUP BY dataset",
)
def agg14(spark, sf):
    key = ["dataset", "position", "frame_number"]
    manual = trajectories(spark, sf).where("k < 10").select(*key).distinct()
    auto = trajectories(spark, sf, last=True).where("k < 10").select(*key).distinct()
    rows = manual.join(auto.withColumn("hit", F.lit(True)), key, "left").withColumn("miss", F.col("hit").isNull().cast("long"))
    return rows.groupBy("dataset").agg(F.count("*").alias("n_manual"), F.sum("miss").alias("n_missed"), r(100 * F.sum("miss") / F.count("*"), "percent_missed", 6))


@query(
    "agg15_circular_moments",
    f"""{W}, s AS (SELECT crop_index, avg(sin(2 * polar_theta)) AS s, avg(cos(2 * polar_theta)) AS c, var_pop(value) AS v FROM t GROUP BY 1)
    SELECT crop_index, round((atan2(s, c) - 2 * {PI} * floor(atan2(s, c) / (2 * {PI}))) / 2, 6) AS mean, round(1 - sqrt(s * s + c * c), 6) AS variance, round(v, 6) AS plain_variance FROM s""",
)
def agg15(spark, sf):
    x = F.col("polar_theta")
    g = trajectories(spark, sf).groupBy("crop_index")
    return g.agg(r(agg.circular_mean(x, 0.0, 3.141592653589793), "mean", 6), r(agg.circular_variance(x, 0.0, 3.141592653589793), "variance", 6), r(F.var_pop("value"), "plain_variance", 6))


@query("agg16_vector_mean", f"{W} SELECT dataset, frame_number, CASE WHEN count(*) >= 2 THEN round(atan2(avg(sin(polar_theta)), avg(cos(polar_theta))), 6) END AS angle, CASE WHEN count(*) >= 2 THEN round(sqrt(avg(sin(polar_theta)) ** 2 + avg(cos(polar_theta)) ** 2), 6) END AS mag FROM t GROUP BY ALL")
def agg16(spark, sf):
    g = trajectories(spark, sf).groupBy("dataset", "frame_number").agg(F.avg(F.sin("polar_theta")).alias("s"), F.avg(F.cos("polar_theta")).alias("c"), F.count("*").alias("n"))
    enough = lambda c, name: F.when(F.col("n") >= 2, F.round(c, 6)).alias(name)
    return g.select("dataset", "frame_number", enough(F.atan2("s", "c"), "angle"), enough(F.hypot("s", "c"), "mag"))


_FLOW = "f AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS u, CAST(embedding[i + 1] AS DOUBLE) AS v, i % 3 = 0 AS fg FROM (SELECT *, unnest(generate_series(1, 63)) AS i FROM embeddings))"


@query(
    "agg17_flow_statistics",
    f"""WITH {_FLOW}, s AS (SELECT *, sqrt(u * u + v * v) AS sp FROM f WHERE fg)
    SELECT vec_id, round(avg(sp), 6) AS mean_speed, round(stddev_pop(sp), 6) AS std_speed, round(avg(u), 6) AS mean_u, round(avg(v), 6) AS mean_v, round(stddev_pop(u), 6) AS std_u, round(stddev_pop(v), 6) AS std_v,
      round(atan2(avg(sin(atan2(v, u))), avg(cos(atan2(v, u)))), 6) AS mean_angle, round(sqrt(-2 * ln(sqrt(avg(sin(atan2(v, u))) ** 2 + avg(cos(atan2(v, u))) ** 2))), 6) AS std_angle,
      round(sqrt(avg(u / sp) ** 2 + avg(v / sp) ** 2), 6) AS unit_length FROM s GROUP BY 1""",
)
def agg17(spark, sf):
    pairs = F.arrays_zip(F.slice("embedding", 1, 63).alias("u"), F.slice("embedding", 2, 63).alias("v"))
    f = table(spark, sf, "embeddings").select("vec_id", F.posexplode(pairs).alias("i", "p")).where((F.col("i") + 1) % 3 == 0)
    f = f.select("vec_id", F.col("p.u").cast("double").alias("u"), F.col("p.v").cast("double").alias("v"))
    return f.groupBy("vec_id").agg(*(c.alias(n) for n, c in agg.flow_statistics(F.col("u"), F.col("v"), 6).items()))


#: Gaps between whole numbers are exact, so equal gaps are told apart alike.
@query(
    "agg18_circular_percentile",
    f"""{W}, v AS (SELECT crop_index, CAST(k AS DOUBLE) AS v FROM t), g AS (SELECT *, coalesce(lead(v) OVER w, min(v) OVER (PARTITION BY crop_index) + 100) AS f FROM v WINDOW w AS (PARTITION BY crop_index ORDER BY v)),
    c AS (SELECT *, first_value(f - 100 * floor(f / 100)) OVER (PARTITION BY crop_index ORDER BY f - v DESC, v) AS cut FROM g), o AS (SELECT crop_index, cut, (v - cut) - 100 * floor((v - cut) / 100) AS x FROM c),
    p AS (SELECT crop_index, any_value(cut) AS cut, quantile_cont(x, 0.05) AS a, quantile_cont(x, 0.95) AS b FROM o GROUP BY 1)
    SELECT crop_index, round(a + cut - 100 * floor((a + cut) / 100), 6) AS p5, round(b + cut - 100 * floor((b + cut) / 100), 6) AS p95 FROM p""",
)
def agg18(spark, sf):
    rows = trajectories(spark, sf).withColumn("x", F.col("k").cast("double"))
    out = circular_percentile(rows, ["crop_index"], "x", [5, 95], 100.0)
    return out.select("crop_index", r(F.col("percentiles")[0], "p5", 6), r(F.col("percentiles")[1], "p95", 6))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("agg19_correlation_matrix", "SELECT " + ", ".join(f"round(corr({a}, {b}), 6) AS {a}__{b}" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]) + " FROM lineitem")
def agg19(spark, sf):
    out = table(spark, sf, "lineitem").agg(*agg.correlations(_COLS))
    return out.select(*(r(c, c, 6) for c in out.columns))


@query(
    "agg19b_correlation_of_components",
    """WITH e AS (SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM (SELECT *, CAST(unnest(generate_series(0, 63)) AS INTEGER) AS i FROM embeddings) WHERE (vec_id * 7 + i * 13) % 11 != 0)
    SELECT p.i AS a, q.i AS b, count(*) AS n, round(corr(p.x, q.x), 6) AS r FROM e p JOIN e q ON p.vec_id = q.vec_id AND p.i < q.i GROUP BY ALL""",
)
def agg19b(spark, sf):
    """All pairs of 64 components, of which one in eleven values is taken out."""
    from driftloom.operators.matrices import correlation_matrix

    holes = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") * 7 + i * 13) % 11 != 0, x))
    return correlation_matrix(table(spark, sf, "embeddings").select(holes.alias("v")), "v", 64).withColumn("r", F.round("r", 6))


@query("agg20_pearson", f"{W} SELECT dataset, position, round(corr(value, k), 6) AS r, count(*) AS n FROM t GROUP BY ALL")
def agg20(spark, sf):
    from driftloom.operators.statistics import with_pearson_p

    g = trajectories(spark, sf).groupBy("dataset", "position").agg(F.corr("value", "k").alias("r"), F.count("*").alias("n"))
    return with_pearson_p(g, "r", "n").select("dataset", "position", r("r", "r", 6), "n")


@query("agg20b_pearson_p")
def agg20b(spark, sf):
    from driftloom.operators.statistics import with_pearson_p

    g = trajectories(spark, sf).groupBy("dataset", "position").agg(F.corr("value", "k").alias("r"), F.count("*").alias("n"))
    return with_pearson_p(g, "r", "n")


@query(
    "agg21_binned_means",
    f"{W}, m AS (SELECT min(value) AS a, max(value) AS z FROM t) SELECT k // 10 AS kb, CAST(floor((value - a) / 40) AS INTEGER) AS vb, round(CAST(sum(CAST(round(value * 10000) AS BIGINT)) AS DOUBLE) / (count(*) * 500000.0) - 1, 9) AS mean, count(*) AS n FROM t, m GROUP BY ALL",
)
def agg21(spark, sf):
    t = trajectories(spark, sf)
    low = F.broadcast(t.agg(F.min("value").alias("a")))  # one row
    bins = [F.floor(F.col("k") / 10).cast("int").alias("kb"), F.floor((F.col("value") - F.col("a")) / 40).cast("int").alias("vb")]
    # The mean of rho = value / 50 - 1 from whole numbers, so that no order of addition shows.
    whole = F.sum(F.round(F.col("value") * 10000).cast("long")).cast("double")
    return t.crossJoin(low).groupBy(*bins).agg(r(whole / (F.count("*") * F.lit(500000.0)) - 1, "mean", 9), F.count("*").alias("n"))


@query(
    "agg22_heat_map",
    f"{W} SELECT CAST(greatest(0, least(3, floor(rho / 0.5))) AS INTEGER) AS i, CAST(greatest(0, least(2, floor(polar_theta))) AS INTEGER) AS j, round(sum(value), 6) AS total, count(*) AS n FROM t GROUP BY ALL",
)
def agg22(spark, sf):
    i = arr.clamped_bin(F.col("rho"), F.array(*map(F.lit, (0.0, 0.5, 1.0, 1.5, 2.0))))
    j = arr.clamped_bin(F.col("polar_theta"), F.array(*map(F.lit, (0.0, 1.0, 2.0, 3.0))))
    return trajectories(spark, sf).groupBy(i.alias("i"), j.alias("j")).agg(r(F.sum("value"), "total", 6), F.count("*").alias("n"))


@query(
    "agg23_histograms",
    f"""{W}, l AS (SELECT frame_number, unnest(['polar_theta', 'rho']) AS feature, unnest([polar_theta, rho]) AS v FROM t), b AS (SELECT *, CASE WHEN v = 3 THEN 7 ELSE CAST(floor((v + 1) / 0.5) AS INTEGER) END AS b, count(*) OVER (PARTITION BY frame_number, feature) AS n FROM l WHERE v BETWEEN -1 AND 3)
    SELECT frame_number, feature, b, round(count(*) / (any_value(n) * 0.5), 6) AS density FROM b GROUP BY ALL""",
)
def agg23(spark, sf):
    from driftloom.operators.grid import density_histogram

    rows = trajectories(spark, sf).selectExpr("frame_number", "stack(2, 'polar_theta', polar_theta, 'rho', rho) as (feature, v)")
    return density_histogram(rows, ["frame_number", "feature"], "v", -1.0, 0.5, 8).withColumn("density", F.round("density", 6))


@query(
    "agg24_mean_angle",
    f"{W}, f AS (SELECT *, first_value(k) OVER (PARTITION BY dataset, position ORDER BY frame_number, crop_index) AS f FROM t), d AS (SELECT *, f + (k - f + 50) - 100 * floor((k - f + 50) / 100.0) - 50 AS w FROM f), m AS (SELECT dataset, position, frame_number, avg(w) AS m FROM d GROUP BY ALL) SELECT dataset, position, frame_number, round(m - 100 * floor(m / 100), 6) AS mean FROM m",
)
def agg24(spark, sf):
    from driftloom.functions.angles import rewrap
    from driftloom.operators.windows import unwrapped_to

    t = trajectories(spark, sf)
    # One row a group, from partial sums, instead of a window that sorts it.
    first = t.groupBy("dataset", "position").agg(F.min_by(F.col("k").cast("double"), F.struct("frame_number", "crop_index")).alias("f"))
    rows = t.join(first, ["dataset", "position"]).withColumn("w", unwrapped_to(F.col("k").cast("double"), F.col("f"), 100.0))
    return rows.groupBy("dataset", "position", "frame_number").agg(r(rewrap(F.avg("w"), 0.0, 100.0), "mean", 6))


@query("agg25_variation", f"{W} SELECT dataset, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(stddev_samp(value) / avg(value), 6) AS cv FROM t GROUP BY 1")
def agg25(spark, sf):
    x = F.col("value")
    return trajectories(spark, sf).groupBy("dataset").agg(r(F.avg(x), "mean", 6), r(F.stddev_samp(x), "std", 6), r(F.stddev_samp(x) / F.avg(x), "cv", 6))


@query("agg26_mean_by_frame", f"{W} SELECT frame_number, round(avg(k), 6) AS k, round(avg(value), 6) AS value, round(avg(rho), 6) AS rho FROM t GROUP BY 1")
def agg26(spark, sf):
    return trajectories(spark, sf).groupBy("frame_number").agg(*(r(F.avg(c), c, 6) for c in ("k", "value", "rho")))


@query("agg27_counts", f"{W} SELECT dataset, count(*) AS n_rows, count(DISTINCT k) AS n_bins FROM t GROUP BY 1")
def agg27(spark, sf):
    return trajectories(spark, sf).groupBy("dataset").agg(F.count("*").alias("n_rows"), F.count_distinct("k").alias("n_bins"))


@query("agg28_global_limits", f"{W}, b AS (SELECT * FROM t UNION ALL SELECT * FROM u) SELECT round(min(value), 6) AS low, round(max(value), 6) AS high, min(k) AS k_low, max(k) AS k_high FROM b")
def agg28(spark, sf):
    both = trajectories(spark, sf).unionByName(trajectories(spark, sf, last=True))
    return both.agg(r(F.min("value"), "low", 6), r(F.max("value"), "high", 6), F.min("k").alias("k_low"), F.max("k").alias("k_high"))


@query("agg35_nested_maps", "SELECT n_regionkey, list(n_name ORDER BY n_nationkey) AS names, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def agg35(spark, sf):
    g = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("m"))
    return g.select("n_regionkey", F.map_values("m").alias("names"), F.map_keys("m").alias("keys"))
