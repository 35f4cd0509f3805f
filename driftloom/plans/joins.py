"""Queries of joins (JN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import joins as jn
from driftloom.registry import query
from driftloom.sources.tables import DATASETS, FLOW, PX_SQL, T_SQL, U_SQL, pixels, setting, table, trajectories

KEY = ["dataset", "position", "crop_index", "frame_number"]
COLS = "dataset, position, crop_index, frame_number"
W = f"WITH {T_SQL}, {U_SQL}, ds AS ({DATASETS}), flow AS ({FLOW})"


def r(name, digits=6):
    return F.round(name, digits).alias(name)


@query("jn01_tracking_cells", "SELECT o_orderkey AS k, l_linenumber, o_orderstatus, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def jn01(spark, sf):
    tracking = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", F.lit(0).alias("l_quantity").cast("double")).drop("l_quantity")
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_quantity")
    return jn.inner_without_clashes(tracking, cells, ["k"])


@query("jn02_with_nuclei", "SELECT o_orderkey AS k, l_linenumber, c_mktsegment FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey")
def jn02(spark, sf):
    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    nuclei = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return rows.join(nuclei, "o_custkey").select(F.col("o_orderkey").alias("k"), "l_linenumber", "c_mktsegment")


@query("jn03_measured_latent", f"{W} SELECT t.dataset, t.position, t.crop_index, t.frame_number, round(t.value, 6) AS value_x, round(u.value, 6) AS value_y FROM t LEFT JOIN u ON t.crop_index = u.crop_index AND t.frame_number = u.frame_number AND u.k > 50")
def jn03(spark, sf):
    left = trajectories(spark, sf).select(*KEY, r("value"))
    right = trajectories(spark, sf, last=True).where("k > 50").select(*KEY, r("value"))
    return jn.left_with_suffixes(left, right, KEY)


@query("jn04_filter_flags", f"{W} SELECT t.dataset, t.position, t.crop_index, t.frame_number FROM t LEFT JOIN u USING ({COLS}) WHERE coalesce(u.k > 50, false)")
def jn04(spark, sf):
    flags = trajectories(spark, sf, last=True).select(*KEY, (F.col("k") > 50).alias("is_included"))
    return trajectories(spark, sf).join(flags, KEY, "left").where(F.coalesce("is_included", F.lit(False))).select(*KEY)


_BOX = "p AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value FROM events)"


@query(
    "jn05_count_in_boxes",
    f"WITH {_BOX} SELECT b.event_id, count(p.event_id) AS n_points FROM p b LEFT JOIN p ON b.event_type = p.event_type AND b.day = p.day AND p.k BETWEEN b.k - 10 AND b.k + 10 AND p.value BETWEEN b.value - 15 AND b.value + 15 GROUP BY b.event_id",
)
def jn05(spark, sf):
    p = table(spark, sf, "events").select("event_id", "event_type", F.to_date("ts").alias("day"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
    boxes = p.select("event_id", "event_type", "day", (F.col("k") - 10).alias("k0"), (F.col("k") + 10).alias("k1"), (F.col("value") - 15).alias("v0"), (F.col("value") + 15).alias("v1"))
    return jn.count_in_boxes(boxes, p, ["event_type", "day"], [("k", "k0", "k1"), ("value", "v0", "v1")], 25, ["event_id"]).select("event_id", "n_points")


@query(
    "jn06_labels_in_window",
    f"WITH {PX_SQL} SELECT position, frame_number, w.y0, list_sort(list_distinct(list(label))) AS labels FROM px JOIN (SELECT unnest([0, 4]) AS y0) w ON y >= y0 AND y < y0 + 4 AND x >= 2 AND x < 6 GROUP BY ALL",
)
def jn06(spark, sf):
    px = pixels(spark, sf).where("x >= 2 and x < 6").withColumn("y0", (F.floor(F.col("y") / 4) * 4).cast("int"))
    return px.groupBy("position", "frame_number", "y0").agg(F.array_sort(F.collect_set("label")).alias("labels"))


@query(
    "jn07_value_of_labels",
    "SELECT o_orderkey, list(c_acctbal ORDER BY l_linenumber, l_suppkey) AS balances FROM orders JOIN lineitem ON o_orderkey = l_orderkey LEFT JOIN (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN round(c_acctbal, 2) END AS c_acctbal FROM customer) ON l_suppkey = c_custkey GROUP BY 1",
)
def jn07(spark, sf):
    labels = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_suppkey").alias("c_custkey"))
    values = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.round("c_acctbal", 2)).alias("b"))
    rows = labels.join(values, "c_custkey", "left").join(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", "c_custkey", "b")))
    return rows.groupBy("o_orderkey").agg(F.transform(ordered, lambda x: x["b"]).alias("balances"))


@query(
    "jn08_first_flow_features",
    f"{W}, f AS (SELECT *, row_number() OVER (PARTITION BY dataset, frame_number ORDER BY value, crop_index) AS rn FROM u) SELECT t.crop_index, t.frame_number, round(f.value, 6) AS flow FROM t LEFT JOIN f ON t.dataset = f.dataset AND t.frame_number = f.frame_number AND rn = 1",
)
def jn08(spark, sf):
    once = jn.first_by(trajectories(spark, sf, last=True), ["dataset", "frame_number"], ["value", "crop_index"])
    return trajectories(spark, sf).join(once.select("dataset", "frame_number", F.round("value", 6).alias("flow")), ["dataset", "frame_number"], "left").select("crop_index", "frame_number", "flow")


@query(
    "jn09_pivoted_lags",
    f"{W} SELECT t.crop_index, t.frame_number, round(a.value, 6) AS lag_1, round(b.value, 6) AS lag_2 FROM t LEFT JOIN t a ON a.crop_index = t.crop_index AND a.frame_number = t.frame_number + 1 LEFT JOIN t b ON b.crop_index = t.crop_index AND b.frame_number = t.frame_number + 2",
)
def jn09(spark, sf):
    t = trajectories(spark, sf)
    records = jn.lagged_pairs(t, "value", ["crop_index"], 2)
    wide = records.groupBy("crop_index", "frame_number").pivot("lag", [1, 2]).agg(F.first(F.round("later", 6)))
    return t.select("crop_index", "frame_number").join(wide.withColumnsRenamed({"1": "lag_1", "2": "lag_2"}), ["crop_index", "frame_number"], "left")


@query("jn10_grid_and_tracked", f"{W}, a AS (SELECT k, count(*) AS n, round(avg(value), 9) AS mean FROM t GROUP BY 1), b AS (SELECT k, count(*) AS n, round(avg(value), 9) AS mean FROM u GROUP BY 1) SELECT k, a.n AS n_grid_based, a.mean AS mean_grid_based, b.n AS n_cell_centered, b.mean AS mean_cell_centered FROM a JOIN b USING (k)")
def jn10(spark, sf):
    stats = lambda df, s: df.groupBy("k").agg(F.count("*").alias("n" + s), F.round(F.avg("value"), 9).alias("mean" + s))
    return stats(trajectories(spark, sf), "_grid_based").join(stats(trajectories(spark, sf, last=True), "_cell_centered"), "k")


@query("jn11_full_outer", f"{W}, a AS (SELECT k, count(*) AS na FROM t WHERE rho < -0.9 GROUP BY 1), b AS (SELECT k, count(*) AS nb FROM u WHERE rho > 2 GROUP BY 1) SELECT k, na, nb FROM a FULL JOIN b USING (k)")
def jn11(spark, sf):
    a = trajectories(spark, sf).where("rho < -0.9").groupBy("k").agg(F.count("*").alias("na"))
    b = trajectories(spark, sf, last=True).where("rho > 2").groupBy("k").agg(F.count("*").alias("nb"))
    return a.join(b, "k", "full")


@query("jn12_fit_and_correlation", f"{W} SELECT dataset, position, round(regr_slope(value, k), 6) AS slope, round(regr_intercept(value, k), 6) AS intercept, round(corr(value, k), 6) AS r FROM t GROUP BY ALL")
def jn12(spark, sf):
    g = trajectories(spark, sf).groupBy("dataset", "position")
    return g.agg(F.round(F.regr_slope("value", "k"), 6).alias("slope"), F.round(F.regr_intercept("value", "k"), 6).alias("intercept"), F.round(F.corr("value", "k"), 6).alias("r"))


@query(
    "jn13_largest_deviation",
    f"""{W}, a AS (SELECT dataset, position, avg(polar_theta) AS th, avg(rho) AS rho FROM t GROUP BY ALL), b AS (SELECT dataset, position, avg(polar_theta) AS th, avg(rho) AS rho FROM u GROUP BY ALL),
    d AS (SELECT dataset, a.th - b.th + 3.141592653589793 / 2 AS x, abs(a.rho - b.rho) AS y FROM a JOIN b USING (dataset, position))
    SELECT dataset, round(max(abs(x - 3.141592653589793 * floor(x / 3.141592653589793) - 3.141592653589793 / 2)), 6) AS theta, round(max(y), 6) AS rho FROM d GROUP BY 1""",
)
def jn13(spark, sf):
    from driftloom.functions.angles import PI, wrapped_difference

    mean = lambda df, s: df.groupBy("dataset", "position").agg(F.avg("polar_theta").alias("th" + s), F.avg("rho").alias("rho" + s))
    both = mean(trajectories(spark, sf), "_a").join(mean(trajectories(spark, sf, last=True), "_b"), ["dataset", "position"])
    theta = F.abs(wrapped_difference(F.col("th_a") - F.col("th_b"), PI))
    return both.groupBy("dataset").agg(F.round(F.max(theta), 6).alias("theta"), F.round(F.max(F.abs(F.col("rho_a") - F.col("rho_b"))), 6).alias("rho"))


@query("jn14_means_and_counts", "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, count(l_quantity) AS n FROM lineitem GROUP BY ALL")
def jn14(spark, sf):
    x = F.col("l_quantity")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.count(x).alias("n"))


_CENTERS = "c AS (SELECT dataset, position, avg(polar_theta) AS ct, avg(polar_r) AS cr FROM u GROUP BY ALL)"


def centers(spark, sf):
    return trajectories(spark, sf, last=True).groupBy("dataset", "position").agg(F.avg("polar_theta").alias("ct"), F.avg("polar_r").alias("cr"))


@query(
    "jn15_means_in_boxes",
    f"{W}, {_CENTERS} SELECT c.dataset, c.position, round(avg(t.value), 5) AS mean_value FROM c LEFT JOIN t ON c.dataset = t.dataset AND polar_theta >= ct - 0.5 AND polar_theta < ct + 0.5 AND polar_r >= cr - 0.5 AND polar_r < cr + 0.5 GROUP BY ALL",
)
def jn15(spark, sf):
    t = trajectories(spark, sf).select("dataset", "polar_theta", "polar_r", "value")
    out = jn.means_in_boxes(t, ["value"], centers(spark, sf), ["dataset"], ["position"], [("polar_theta", "ct"), ("polar_r", "cr")], 1.0)
    return out.select("dataset", "position", F.round("mean_value", 5).alias("mean_value"))


@query(
    "jn16_distances",
    f"""{W}, {_CENTERS}, d AS (SELECT t.crop_index, t.frame_number, c.position AS point, polar_theta - ct + 3.141592653589793 / 2 AS x, polar_r - cr AS dr FROM t JOIN c USING (dataset)),
    e AS (SELECT *, x - 3.141592653589793 * floor(x / 3.141592653589793) - 3.141592653589793 / 2 AS dt FROM d)
    SELECT crop_index, frame_number, point, round(dt, 5) AS d_polar_theta, round(dr, 5) AS d_polar_r, round(sqrt(dt * dt + dr * dr), 5) AS distance FROM e""",
)
def jn16(spark, sf):
    from driftloom.functions.angles import PI

    points = centers(spark, sf).withColumnRenamed("position", "point")
    t = trajectories(spark, sf).select("dataset", "crop_index", "frame_number", "polar_theta", "polar_r")
    out = jn.distances_to_points(t, points, ["dataset"], [("polar_theta", "ct"), ("polar_r", "cr")], {"polar_theta": PI})
    return out.select("crop_index", "frame_number", "point", r("d_polar_theta", 5), r("d_polar_r", 5), r("distance", 5))


@query(
    "jn17_nearest_grid_point",
    f"{W}, g AS (SELECT i, i * 0.25 AS pt FROM (SELECT unnest(generate_series(0, 12)) AS i)), n AS (SELECT crop_index, frame_number, value, CAST(arg_min(i, row(abs(polar_theta - pt), i)) AS INTEGER) AS cell FROM t, g GROUP BY ALL), v AS (SELECT cell, avg(value) AS mean FROM n GROUP BY 1) SELECT crop_index, frame_number, cell, round(mean, 9) AS mean FROM n JOIN v USING (cell)",
)
def jn17(spark, sf):
    rows = jn.nearest_on_grid(trajectories(spark, sf), {"polar_theta": (0.0, 0.25, 13)}).withColumnRenamed("cell_polar_theta", "cell")
    vectors = rows.groupBy("cell").agg(F.round(F.avg("value"), 9).alias("mean"))
    return rows.select("crop_index", "frame_number", "cell").join(vectors, "cell")


def greedy_sql(keys: str, rounds: int) -> str:
    """Greedy matches of ``near`` (keys, replicate, point_id, rank, found_id, distance), unrolled by rank, as ``taken``."""
    out, left = [], "near"
    for k in range(rounds):
        out.append(f"pick{k} AS MATERIALIZED (SELECT * FROM {left} WHERE rank = {k} QUALIFY row_number() OVER (PARTITION BY {keys}, replicate, point_id ORDER BY distance, found_id) = 1)")
        out.append(f"left{k} AS MATERIALIZED (SELECT * FROM {left} WHERE rank > {k} AND ({keys}, replicate, found_id) NOT IN (SELECT ({keys}, replicate, found_id) FROM pick{k}))")
        left = f"left{k}"
    return ", ".join([*out, "taken AS (" + " UNION ALL ".join(f"SELECT * FROM pick{k}" for k in range(rounds)) + ")"])


@query(
    "jn18_greedy_matches",
    f"""{W}, {_CENTERS}, m AS (SELECT dataset, frame_number AS replicate, position AS found_id, avg(polar_theta) AS polar_theta, avg(polar_r) AS polar_r FROM t GROUP BY ALL),
    d AS (SELECT m.*, c.position AS point_id, c.position // 2 AS rank, polar_theta - ct + 3.141592653589793 / 2 AS x, polar_r - cr AS dr FROM m JOIN c USING (dataset)),
    near AS (SELECT * FROM (SELECT *, sqrt((x - 3.141592653589793 * floor(x / 3.141592653589793) - 3.141592653589793 / 2) ** 2 + dr * dr) AS distance FROM d) WHERE distance <= 0.3), {greedy_sql("dataset", 3)}
    SELECT dataset, replicate, point_id, found_id, round(polar_theta, 6) AS polar_theta, round(polar_r, 6) AS polar_r, round(distance, 6) AS distance FROM taken""",
)
def jn18(spark, sf):
    base = centers(spark, sf).select("dataset", F.col("position").alias("point_id"), F.floor(F.col("position") / 2).cast("int").alias("rank"), F.col("ct").alias("polar_theta"), F.col("cr").alias("polar_r"))
    found = trajectories(spark, sf).groupBy("dataset", F.col("frame_number").alias("replicate"), F.col("position").alias("found_id")).agg(F.avg("polar_theta").alias("polar_theta"), F.avg("polar_r").alias("polar_r"))
    out = jn.greedy_matches(base, found, ["dataset"], ["polar_theta", "polar_r"], 0.3, 3, {"polar_theta": 3.141592653589793})
    return out.select("dataset", "replicate", "point_id", "found_id", *(r(c, 6) for c in ("polar_theta", "polar_r", "distance")))


@query(
    "jn19_overlap_links",
    f"""WITH {PX_SQL}, p AS (SELECT frame_number // 10 AS position, frame_number % 10 AS frame_number, y, x, label FROM px),
    b AS (SELECT a.position, a.frame_number, a.label, n.label AS next_label, count(*) AS overlap FROM p a JOIN p n ON a.position = n.position AND n.frame_number = a.frame_number + 1 AND a.y = n.y AND a.x = n.x GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY position, frame_number, label ORDER BY overlap DESC, next_label) AS ra, row_number() OVER (PARTITION BY position, frame_number, next_label ORDER BY overlap DESC, label) AS rb FROM b)
    SELECT position, frame_number, label, next_label, overlap FROM m WHERE ra = 1 AND rb = 1""",
)
def jn19(spark, sf):
    n = F.col("frame_number")
    p = pixels(spark, sf).select(F.floor(n / 10).alias("position"), (n % 10).alias("frame_number"), "y", "x", "label")
    return jn.overlap_links(p)


_REG = f"""{PX_SQL}, g AS (SELECT frame_number // 10 AS position, frame_number % 10 AS frame_number, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM px GROUP BY ALL)"""


@query(
    "jn20_metric_links",
    f"""WITH {_REG}, b AS (SELECT a.position, a.frame_number, a.label, n.label AS next_label, (abs(a.cy - n.cy) + abs(a.cx - n.cx)) / 2 AS d FROM g a JOIN g n ON a.position = n.position AND n.frame_number = a.frame_number + 1 AND abs(a.cy - n.cy) <= 1 AND abs(a.cx - n.cx) <= 1),
    m AS (SELECT *, row_number() OVER (PARTITION BY position, frame_number, label ORDER BY d, next_label) AS ra, row_number() OVER (PARTITION BY position, frame_number, next_label ORDER BY d, label) AS rb FROM b)
    SELECT position, frame_number, label, next_label, round(d, 6) AS distance FROM m WHERE ra = 1 AND rb = 1""",
)
def jn20(spark, sf):
    n = F.col("frame_number")
    g = pixels(spark, sf).groupBy(F.floor(n / 10).alias("position"), (n % 10).alias("frame_number"), "label").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    return jn.metric_links(g, {"cy": (["cy"], 1.0), "cx": (["cx"], 1.0)}, every=True).withColumn("distance", F.round("distance", 6))


_FILM_REGIONS = f"{PX_SQL}, g AS (SELECT frame_number // 10 AS position, frame_number % 10 AS frame_number, label, avg(y) AS cy, avg(x) AS cx, count(*) AS area, avg(intensity) AS mean FROM px GROUP BY ALL)"
#: The centroid within 1.5 pixels, the area within 6; the mean intensity is compared without a limit where the query has three metrics.
_METRICS = {"centroid": (["cy", "cx"], 1.5), "area": (["area"], 6.0)}


def _mode_sql(step: int, side: str, third: bool = False) -> str:
    """All pairs of labels of both frames, ranked on one side."""
    d = "CASE WHEN d1 <= 1.5 THEN d1 END, CASE WHEN d2 <= 6 THEN d2 END" + (", d3" if third else "")
    rank = "label ORDER BY d, next_label" if side == "from" else "next_label ORDER BY d, label"
    return f"""WITH {_FILM_REGIONS}, b AS (SELECT a.position, a.frame_number, a.label, n.label AS next_label, sqrt((a.cy - n.cy) ** 2 + (a.cx - n.cx) ** 2) AS d1, abs(a.area - n.area) AS d2, abs(a.mean - n.mean) AS d3
      FROM g a JOIN g n ON a.position = n.position AND n.frame_number = a.frame_number + {step}),
    m AS (SELECT *, list_avg(list_filter([{d}], lambda x: x IS NOT NULL)) AS d FROM b),
    k AS (SELECT *, row_number() OVER (PARTITION BY position, frame_number, {rank}) AS r FROM m WHERE d IS NOT NULL)
    SELECT position, frame_number, label, next_label, round(d, 6) AS distance FROM k WHERE r = 1"""


def _film_links(spark, sf, step, mode, metrics=None):
    n = F.col("frame_number")
    g = pixels(spark, sf).groupBy(F.floor(n / 10).alias("position"), (n % 10).alias("frame_number"), "label")
    g = g.agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.count("*").alias("area"), F.avg("intensity").alias("mean"))
    return jn.metric_links(g, metrics or _METRICS, step, mode).withColumn("distance", F.round("distance", 6))


@query("jn20b_links_forward", _mode_sql(1, "from"))
def jn20b(spark, sf):
    return _film_links(spark, sf, 1, "forward")


@query("jn20c_links_reverse", _mode_sql(1, "to"))
def jn20c(spark, sf):
    return _film_links(spark, sf, 1, "reverse")


@query("jn20d_links_to_reference", _mode_sql(-1, "to"))
def jn20d(spark, sf):
    return _film_links(spark, sf, -1, "to_reference")


@query("jn20e_links_from_reference", _mode_sql(-2, "from", third=True))
def jn20e(spark, sf):
    return _film_links(spark, sf, -2, "from_reference", _METRICS | {"mean": (["mean"], float("inf"))})


@query("jn21_lagged_products", f"{W} SELECT a.crop_index, CAST(b.frame_number - a.frame_number AS INTEGER) AS lag, round(sum(a.rho * b.rho), 9) AS product, count(*) AS n FROM t a JOIN t b ON a.crop_index = b.crop_index AND b.frame_number - a.frame_number BETWEEN 1 AND 5 GROUP BY ALL")
def jn21(spark, sf):
    rows = jn.lagged_pairs(trajectories(spark, sf), "rho", ["crop_index"], 5)
    return rows.groupBy("crop_index", "lag").agg(F.round(F.sum(F.col("early") * F.col("later")), 9).alias("product"), F.count("*").alias("n"))


@query("jn22_patch_coordinates", "SELECT n_name, r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def jn22(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("n_name", "r_name").agg(F.count("*").alias("n"))


@query("jn23_unmatched_labels", f"{W} SELECT crop_index, frame_number FROM t WHERE NOT EXISTS (SELECT 1 FROM t p WHERE p.crop_index = t.crop_index AND p.frame_number = t.frame_number - 1)")
def jn23(spark, sf):
    t = trajectories(spark, sf).select("crop_index", "frame_number")
    return t.join(t.select("crop_index", (F.col("frame_number") + 1).alias("frame_number")), ["crop_index", "frame_number"], "left_anti")


@query("jn24_path_lookup", f"{W} SELECT crop_index, frame_number, '/store/' || dataset || '/' || date || '_P' || position || '.zarr' AS path FROM t JOIN ds USING (dataset)")
def jn24(spark, sf):
    paths = setting(spark, DATASETS).select("dataset", "date")
    parts = [F.lit("/store/"), F.col("dataset"), F.lit("/"), F.col("date"), F.lit("_P"), F.col("position"), F.lit(".zarr")]
    return trajectories(spark, sf).join(paths, "dataset").select("crop_index", "frame_number", F.concat(*(p.cast("string") for p in parts)).alias("path"))


@query("jn25_condition_of_row", f"{W} SELECT crop_index, frame_number, ordinal, shear_stress FROM t JOIN flow ON t.dataset = flow.dataset AND frame_number BETWEEN start_frame AND stop_frame")
def jn25(spark, sf):
    from driftloom.operators.annotations import flow_at

    return flow_at(trajectories(spark, sf), setting(spark, FLOW)).select("crop_index", "frame_number", "ordinal", "shear_stress")
