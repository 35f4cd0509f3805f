"""Queries of scalar functions: angles and units (MTH), strings (STR), arrays (ARR) and dates (DAT)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.functions import angles as A
from driftloom.functions import arrays as R
from driftloom.functions import text as S
from driftloom.registry import query
from driftloom.sources.tables import T_SQL, U_SQL, table, trajectories

KEY = ["crop_index", "frame_number"]
PI = "3.141592653589793"


def r(col, name, digits=6):
    return F.round(col, digits).alias(name)


def traj(spark, sf):
    return trajectories(spark, sf)


@query("mth01_polar_radius", f"WITH {T_SQL} SELECT crop_index, frame_number, round(sqrt(rho * rho + polar_r * polar_r), 6) AS r FROM t")
def mth01(spark, sf):
    return traj(spark, sf).select(*KEY, r(A.polar_radius(F.col("rho"), F.col("polar_r")), "r"))


@query("mth02_polar_angle", f"WITH {T_SQL} SELECT crop_index, frame_number, round((atan2(polar_r, rho) + {PI}) / 2, 6) AS theta FROM t")
def mth02(spark, sf):
    return traj(spark, sf).select(*KEY, r(A.polar_angle(F.col("rho"), F.col("polar_r")), "theta"))


@query(
    "mth03_inverse_polar",
    f"WITH {T_SQL} SELECT crop_index, frame_number, round(polar_r * cos(2 * polar_theta - {PI}), 6) AS x, round(polar_r * sin(2 * polar_theta - {PI}), 6) AS y FROM t",
)
def mth03(spark, sf):
    x, y = A.from_polar(F.col("polar_r"), F.col("polar_theta"))
    return traj(spark, sf).select(*KEY, r(x, "x"), r(y, "y"))


@query(
    "mth04_rewrap",
    f"WITH {T_SQL}, s AS (SELECT *, value - 100 AS v FROM t) SELECT crop_index, frame_number, round(v + 90 - 180 * floor((v + 90) / 180) - 90, 6) AS wrapped FROM s",
)
def mth04(spark, sf):
    return traj(spark, sf).select(*KEY, r(A.rewrap(F.col("value") - 100, -90.0, 180.0), "wrapped"))


@query(
    "mth05_smallest_difference",
    f"WITH {T_SQL}, s AS (SELECT *, value - k * 3.6 + 180 AS d FROM t) SELECT crop_index, frame_number, round(d - 360 * floor(d / 360) - 180, 5) AS diff FROM s",
)
def mth05(spark, sf):
    # A quotient of whole numbers is the double nearest to the decimal, as in SQL; a product with 3.6 may be next to it, on the seam's other side.
    return traj(spark, sf).select(*KEY, r(A.smallest_difference(F.col("value"), F.col("k") * 36 / 10), "diff", 5))


@query("mth06_nematic_order", f"WITH {T_SQL} SELECT crop_index, frame_number, round(cos(2 * polar_theta), 6) AS s FROM t")
def mth06(spark, sf):
    return traj(spark, sf).select(*KEY, r(A.nematic_order(F.col("polar_theta")), "s"))


@query("mth07_aspect_ratio", "SELECT l_orderkey, l_linenumber, round(sqrt(1 / (1 - l_discount * l_discount)), 6) AS aspect FROM lineitem")
def mth07(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(A.aspect_ratio(F.col("l_discount")), "aspect"))


@query("mth08_axis_alignment", f"WITH {T_SQL} SELECT crop_index, frame_number, round(atan2(abs(sin(polar_theta)), abs(cos(polar_theta))), 6) AS a FROM t")
def mth08(spark, sf):
    return traj(spark, sf).select(*KEY, r(A.axis_alignment(F.col("polar_theta")), "a"))


_PAIR = f"WITH {T_SQL}, {U_SQL} SELECT t.crop_index, t.frame_number, "
_ON = " FROM t JOIN u ON t.crop_index = u.crop_index AND t.frame_number = u.frame_number"


def pairs(spark, sf):
    return traj(spark, sf).alias("t").join(trajectories(spark, sf, last=True).alias("u"), KEY)


@query(
    "mth09_offset",
    _PAIR + "round(u.value - t.value, 6) AS dx, CAST(u.k - t.k AS INTEGER) AS dy, round(sqrt((u.value - t.value) ** 2 + (u.k - t.k) ** 2), 6) AS dist, round(atan2(u.k - t.k, u.value - t.value), 6) AS angle" + _ON,
)
def mth09(spark, sf):
    dx, dy = F.col("u.value") - F.col("t.value"), F.col("u.k") - F.col("t.k")
    return pairs(spark, sf).select(*KEY, r(dx, "dx"), dy.alias("dy"), r(F.hypot(dx, dy), "dist"), r(F.atan2(dy, dx), "angle"))


@query("mth10_dot_product", _PAIR + "round(t.value * u.value + t.k * u.k, 5) AS dot" + _ON)
def mth10(spark, sf):
    return pairs(spark, sf).select(*KEY, r(F.col("t.value") * F.col("u.value") + F.col("t.k") * F.col("u.k"), "dot", 5))


@query(
    "mth11_units",
    f"WITH {T_SQL} SELECT crop_index, frame_number, round(value * 0.383, 6) AS um, round(value * 0.383 * 0.383, 6) AS um2, CAST(frame_number * 720 AS INTEGER) AS minutes, round((frame_number - 30) * 720 / 60.0, 6) AS hours_since_flow FROM t",
)
def mth11(spark, sf):
    t = F.col("frame_number")
    return traj(spark, sf).select(*KEY, r(F.col("value") * 0.383, "um"), r(F.col("value") * 0.383 * 0.383, "um2"), (t * 720).alias("minutes"), r((t - 30) * 720 / F.lit(60.0), "hours_since_flow"))


@query("mth12_degrees", f"WITH {T_SQL} SELECT crop_index, frame_number, round(degrees(polar_theta), 6) AS deg, round(radians(value), 6) AS rad FROM t")
def mth12(spark, sf):
    return traj(spark, sf).select(*KEY, r(F.degrees("polar_theta"), "deg"), r(F.radians("value"), "rad"))


@query(
    "mth13_crop_box",
    f"""WITH {T_SQL}, b AS (SELECT crop_index, frame_number, CAST(trunc(value - 32) AS INTEGER) AS x0, CAST(trunc(value + 32) AS INTEGER) AS x1,
      CAST(trunc(k * 4 - 32.0) AS INTEGER) AS y0, CAST(trunc(k * 4 + 32.0) AS INTEGER) AS y1 FROM t)
    SELECT *, CAST(floor(x0 / 4.0) AS INTEGER) AS level_x0, x0 >= 0 AND y0 >= 0 AND x1 <= 480 AND y1 <= 400 AS in_bounds FROM b""",
)
def mth13(spark, sf):
    x, y = F.col("value"), F.col("k") * F.lit(4.0)
    box = traj(spark, sf).select(*KEY, (x - 32).cast("int").alias("x0"), (x + 32).cast("int").alias("x1"), (y - 32).cast("int").alias("y0"), (y + 32).cast("int").alias("y1"))
    inside = (F.greatest("x0", F.lit(0)) == F.col("x0")) & (F.col("y0") >= 0) & (F.least("x1", F.lit(480)) == F.col("x1")) & (F.col("y1") <= 400)
    return box.withColumns({"level_x0": F.floor(F.col("x0") / 4).cast("int"), "in_bounds": inside})


@query(
    "mth14_vector_angle",
    _PAIR
    + "round(acos(least(1.0, greatest(-1.0, (t.rho * u.rho + t.polar_r * u.polar_r) / nullif(sqrt(t.rho ** 2 + t.polar_r ** 2) * sqrt(u.rho ** 2 + u.polar_r ** 2), 0)))), 4) AS angle"
    + _ON,
)
def mth14(spark, sf):
    a = [F.col("t.rho"), F.col("t.polar_r")]
    b = [F.col("u.rho"), F.col("u.polar_r")]
    return pairs(spark, sf).select(*KEY, r(A.vector_angle(a, b), "angle", 4))


@query(
    "mth15_nematic_bound",
    f"""WITH {T_SQL}, s AS (SELECT *, rho - polar_theta + {PI} / 2 AS d FROM t)
    SELECT crop_index, frame_number, round(least(1.0, greatest(-1.0, cos(2 * polar_theta) + abs(-2 * sin(2 * polar_theta)) * (d - {PI} * floor(d / {PI}) - {PI} / 2))), 5) AS bound FROM s""",
)
def mth15(spark, sf):
    return traj(spark, sf).select(*KEY, r(A.nematic_bound(F.col("polar_theta"), F.col("rho")), "bound", 5))


@query("mth16_shown_angle", f"WITH {T_SQL} SELECT crop_index, frame_number, round(CASE WHEN polar_theta > 5 * {PI} / 6 THEN polar_theta - {PI} ELSE polar_theta END, 6) AS shown FROM t")
def mth16(spark, sf):
    return traj(spark, sf).select(*KEY, r(A.shown_angle(F.col("polar_theta")), "shown"))


#: The plane through (1,0,0), (0,1,0), (0,0,1): first axis along the first two points, second by Gram-Schmidt.
@query(
    "mth17_plane_projection",
    f"""WITH {T_SQL}, p AS (SELECT *, ((polar_r - 1) * -1 + polar_theta) / sqrt(2) AS a, ((polar_r - 1) * -1 - polar_theta + 2 * rho) / sqrt(6) AS b FROM t)
    SELECT crop_index, frame_number, round(a, 6) AS a, round(b, 6) AS b, round(1 - a / sqrt(2) - b / sqrt(6), 6) AS back_x, round(a / sqrt(2) - b / sqrt(6), 6) AS back_y, round(2 * b / sqrt(6), 6) AS back_z FROM p""",
)
def mth17(spark, sf):
    from driftloom.operators.planes import plane_basis, on_plane, off_plane

    basis = plane_basis((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))
    a, b = on_plane([F.col("polar_r"), F.col("polar_theta"), F.col("rho")], basis)
    rows = traj(spark, sf).select(*KEY, a.alias("a"), b.alias("b"))
    x, y, z = off_plane(F.col("a"), F.col("b"), basis)
    return rows.select(*KEY, r(F.col("a"), "a"), r(F.col("b"), "b"), r(x, "back_x"), r(y, "back_y"), r(z, "back_z"))


@query("mth18_shear_bin", f"WITH {T_SQL} SELECT crop_index, frame_number, CAST(3 * round_even(value / 3, 0) AS INTEGER) AS shear_bin FROM t")
def mth18(spark, sf):
    return traj(spark, sf).select(*KEY, A.shear_bin(F.col("value")).alias("shear_bin"))


@query(
    "mth19_r_squared",
    f"""WITH {T_SQL}, m AS (SELECT *, avg(value) OVER (PARTITION BY dataset) AS mean FROM t)
    SELECT dataset, round(1 - sum((value - k * 0.5) ** 2) / nullif(sum((value - mean) ** 2), 0), 6) AS r2 FROM m GROUP BY dataset""",
)
def mth19(spark, sf):
    from driftloom.operators.aggregates import r_squared

    return traj(spark, sf).groupBy("dataset").agg(r(r_squared(F.col("value"), F.col("k") * 0.5), "r2"))


@query("mth20_exponential_decay", f"WITH {T_SQL} SELECT crop_index, frame_number, round(2.5 * exp(-0.1 * frame_number) + 0.25, 6) AS y FROM t")
def mth20(spark, sf):
    return traj(spark, sf).select(*KEY, r(2.5 * F.exp(-0.1 * F.col("frame_number")) + 0.25, "y"))


@query(
    "mth21_kernels",
    f"""WITH {T_SQL} SELECT crop_index, frame_number, round(exp(-((rho / 0.5) ** 2) / 2) / sqrt(2 * {PI}) / 0.5, 6) AS gaussian,
      round(CASE WHEN abs(rho / 0.5) <= 1 THEN 0.75 * (1 - (rho / 0.5) ** 2) ELSE 0 END / 0.5, 6) AS epanechnikov,
      round(exp(-2 * (sin(polar_theta) ** 2 / 0.5) ** 2) / 0.5, 6) AS periodic FROM t""",
)
def mth21(spark, sf):
    rho, theta = F.col("rho"), F.col("polar_theta")
    return traj(spark, sf).select(*KEY, r(A.kernel("gaussian", rho, 0.5), "gaussian"), r(A.kernel("epanechnikov", rho, 0.5), "epanechnikov"), r(A.kernel("periodic", theta, 0.5, A.PI), "periodic"))


@query("str01_slugify", r"""SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9_\s-]', '', 'g'), '[\s-]+', '_', 'g') AS slug FROM pages""")
def str01(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.slugify(F.col("url")).alias("slug"))


@query("str02_joined_sorted", "SELECT r_regionkey, string_agg(n_name, '_' ORDER BY n_name) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def str02(spark, sf):
    rows = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_regionkey").agg(S.joined_sorted(F.collect_list("n_name")).alias("names"))


_PATHS = "SELECT p_partkey, '/data/' || p_brand || '/20240' || (100 + p_size) || '_P' || p_size || '_T' || p_partkey || '_T' || (p_size + 1) || '.zarr' AS path FROM part"


def paths(spark, sf):
    parts = [F.lit("/data/"), F.col("p_brand"), F.lit("/20240"), (100 + F.col("p_size")), F.lit("_P"), F.col("p_size"), F.lit("_T"), F.col("p_partkey"), F.lit("_T"), F.col("p_size") + 1, F.lit(".zarr")]
    return table(spark, sf, "part").select("p_partkey", F.concat(*(p.cast("string") for p in parts)).alias("path"))


@query("str03_position_in_path", f"SELECT p_partkey, CAST(regexp_extract(path, '.*/[^/]*P([0-9]+)[^/]*$', 1) AS INTEGER) AS position FROM ({_PATHS})")
def str03(spark, sf):
    return paths(spark, sf).select("p_partkey", S.position_of(F.col("path"), strict=True).alias("position"))


@query("str04_frame_in_name", f"SELECT p_partkey, CAST(regexp_extract_all(path, 'T([0-9]+)', 1)[-1] AS INTEGER) AS last, CAST(regexp_extract(path, 'T([0-9]+)', 1) AS INTEGER) AS first FROM ({_PATHS})")
def str04(spark, sf):
    return paths(spark, sf).select("p_partkey", S.frame_in_name(F.col("path")).alias("last"), S.frame_in_name(F.col("path"), last=False).alias("first"))


@query(
    "str05_labels",
    f"SELECT p_partkey, d AS date, d || ' (' || p_size || '-' || (p_size + 3) || ' dyn/cm2)' AS label FROM (SELECT p_partkey, p_size, split_part(regexp_extract(path, '[^/]+$'), '_', 1) AS d FROM ({_PATHS}) JOIN part USING (p_partkey))",
)
def str05(spark, sf):
    rows = paths(spark, sf).join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    date = S.date_part(F.element_at(F.split("path", "/"), -1))
    return rows.select("p_partkey", date.alias("date"), S.label_of(date, F.array(F.col("p_size"), F.col("p_size") + 3)).alias("label"))


@query("str06_regimes", "SELECT o_custkey, string_agg(o_orderpriority, '_to_' ORDER BY o_orderdate, o_orderkey) AS regimes FROM orders GROUP BY o_custkey")
def str06(spark, sf):
    ordered = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(ordered, lambda x: x["o_orderpriority"]), "_to_").alias("regimes"))


@query("str07_dataset_key", f"SELECT p_partkey FROM ({_PATHS}) WHERE regexp_matches(path, '20[0-9]{{6}}_')")
def str07(spark, sf):
    return paths(spark, sf).where(S.is_dataset_key(F.col("path"))).select("p_partkey")


@query(
    "str08_uri_parts",
    r"SELECT page_id, regexp_extract(url, '^[a-z0-9]+://([^/]+)', 1) AS bucket, regexp_extract(url, '^[a-z0-9]+://[^/]+/(.*)$', 1) AS key, regexp_extract(url, '(\.[A-Za-z0-9]+)$', 1) AS suffix FROM pages",
)
def str08(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.uri_parts(F.col("url")).alias("u")).select("page_id", "u.*")


_VEC = "SELECT vec_id, embedding[i] AS x FROM (SELECT *, unnest(generate_series(1, 64)) AS i FROM embeddings)"


@query("arr01_size", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n FROM embeddings")
def arr01(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.size("embedding").alias("n"))


@query("arr02_mean_std", f"SELECT vec_id, round(avg(CAST(x AS DOUBLE)), 6) AS mean, round(stddev_pop(CAST(x AS DOUBLE)), 6) AS std FROM ({_VEC}) GROUP BY vec_id")
def arr02(spark, sf):
    both = F.concat(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))
    return table(spark, sf, "embeddings").select("vec_id", r(R.array_mean(both), "mean"), r(R.array_std(both), "std"))


@query("arr03_sanitized", f"SELECT vec_id, CAST(count(*) FILTER (round(x, 1) <> 0) AS INTEGER) AS n FROM ({_VEC}) GROUP BY vec_id")
def arr03(spark, sf):
    rounded = F.transform("embedding", lambda x: F.when(F.abs(x) < 0.3, F.round(x, 1)).otherwise(x))
    return table(spark, sf, "embeddings").select("vec_id", F.size(R.sanitized(rounded)).alias("n"))


@query("arr04_element", "SELECT vec_id, round(CAST(embedding[label + 1] AS DOUBLE), 6) AS x FROM embeddings")
def arr04(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", r(F.try_element_at("embedding", F.col("label") + 1).cast("double"), "x"))


@query(
    "arr05_linspace",
    f"""WITH {T_SQL}, g AS (SELECT dataset, min(value) AS lo, max(value) AS hi FROM t GROUP BY dataset), e AS (SELECT dataset, lo, hi, unnest(generate_series(0, 7)) AS i FROM g)
    SELECT dataset, CAST(i AS INTEGER) AS i, round(lo + (i + 0.5) * (hi - lo) / 8, 6) AS mid FROM e""",
)
def arr05(spark, sf):
    g = traj(spark, sf).groupBy("dataset").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    edges = R.linspace(F.col("lo"), F.col("hi"), F.lit(8))
    return g.select("dataset", F.posexplode(R.midpoints(edges)).alias("i", "mid")).select("dataset", "i", r(F.col("mid"), "mid"))


@query("arr06_map_lookup", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS code FROM customer")
def arr06(spark, sf):
    codes = F.create_map(F.lit("BUILDING"), F.lit(1), F.lit("MACHINERY"), F.lit(2))
    return table(spark, sf, "customer").select("c_custkey", F.try_element_at(codes, F.col("c_mktsegment")).alias("code"))


@query("dat01_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS stamp, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS DATE) AS day FROM orders")
def dat01(spark, sf):
    stamp = F.date_format("o_orderdate", "yyyyMMdd")
    return table(spark, sf, "orders").select("o_orderkey", stamp.alias("stamp"), F.to_date(stamp, "yyyyMMdd").alias("day"))
