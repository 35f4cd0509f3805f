"""Queries of window functions (WIN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driftloom.functions.angles import PI
from driftloom.operators import windows as win
from driftloom.registry import query
from driftloom.sources.tables import T_SQL, table, trajectories

COLS = "crop_index, frame_number"
KEY = ["crop_index", "frame_number"]
W = f"WITH {T_SQL}"
OVER = "OVER (PARTITION BY crop_index ORDER BY frame_number)"
ALL = "OVER (PARTITION BY crop_index)"


def r(c, name, digits=6):
    return F.round(c, digits).alias(name)


@query("win01_duration", f"{W} SELECT {COLS}, max(frame_number) {ALL} - min(frame_number) {ALL} AS track_duration FROM t")
def win01(spark, sf):
    return win.with_track_duration(trajectories(spark, sf)).select(*KEY, "track_duration")


@query("win02_rows_of_key", f"{W} SELECT {COLS}, count(*) OVER (PARTITION BY dataset, position, frame_number) AS n FROM t")
def win02(spark, sf):
    return trajectories(spark, sf).select(*KEY, F.count("*").over(Window.partitionBy("dataset", "position", "frame_number")).alias("n"))


@query("win03_difference", f"{W} SELECT {COLS}, round(value - lag(value) {OVER}, 6) AS d FROM t")
def win03(spark, sf):
    return trajectories(spark, sf).select(*KEY, r(win.difference("value"), "d"))


@query("win04_rate", f"{W} SELECT {COLS}, round((value - lag(value) {OVER}) / (frame_number - lag(frame_number) {OVER}), 6) AS rate FROM t")
def win04(spark, sf):
    return trajectories(spark, sf).select(*KEY, r(win.rate("value"), "rate"))


@query(
    "win05_velocity",
    f"{W}, v AS (SELECT {COLS}, (value - lag(value) {OVER}) / (frame_number - lag(frame_number) {OVER}) AS vx, (k - lag(k) {OVER}) / (frame_number - lag(frame_number) {OVER})::DOUBLE AS vy FROM t) SELECT {COLS}, round(vx, 6) AS vx, round(vy, 6) AS vy, round(sqrt(vx * vx + vy * vy), 6) AS speed, round(degrees(atan2(vy, vx)), 5) AS angle FROM v",
)
def win05(spark, sf):
    rows = trajectories(spark, sf).withColumns({"vx": win.rate("value"), "vy": win.rate("k")})
    return rows.select(*KEY, r("vx", "vx"), r("vy", "vy"), r(F.hypot("vx", "vy"), "speed"), r(F.degrees(F.atan2("vy", "vx")), "angle", 5))


@query("win06_forward_difference", f"{W}, d AS (SELECT *, lead(value, 2) {OVER} - value AS dv, lead(frame_number, 2) {OVER} - frame_number AS gap FROM t) SELECT {COLS}, round(dv, 6) AS d_value FROM d WHERE gap = 2")
def win06(spark, sf):
    return win.forward_differences(trajectories(spark, sf), ["value"], 2).select(*KEY, r("d_value", "d_value"))


#: Whole numbers with a period of 100, so that half periods are exact.
_STEP = f"{W}, a AS (SELECT *, k - lag(k) {OVER} AS d FROM t), b AS (SELECT *, d + 50 - 100 * floor((d + 50) / 100.0) - 50 AS w FROM a), s AS (SELECT *, CASE WHEN w = -50 AND d > 0 THEN 50 ELSE coalesce(w, 0) END AS step FROM b)"


@query("win07_unwrap", f"{_STEP} SELECT {COLS}, CAST(first_value(k) {OVER} + sum(step) {OVER} AS DOUBLE) AS turned FROM s")
def win07(spark, sf):
    rows = trajectories(spark, sf).withColumn("k", F.col("k").cast("double"))
    return win.with_unwrapped(rows, "k", 100.0, "turned").select(*KEY, "turned")


@query("win08_unwrap_to_first", f"{W}, a AS (SELECT *, first_value(polar_theta) {OVER} AS f FROM t), b AS (SELECT *, polar_theta - f + {PI} / 2 AS d FROM a) SELECT {COLS}, round(f + d - {PI} * floor(d / {PI}) - {PI} / 2, 5) AS theta FROM b WHERE abs(d / {PI} - round(d / {PI})) > 0.000001")
def win08(spark, sf):
    first = F.first("polar_theta").over(win.ordered())
    rows = trajectories(spark, sf).withColumn("f", first).withColumn("d", F.col("polar_theta") - F.col("f") + F.lit(PI / 2))
    rows = rows.where(F.abs(F.col("d") / PI - F.round(F.col("d") / PI)) > 0.000001)
    return rows.select(*KEY, r(win.unwrapped_to(F.col("polar_theta"), F.col("f"), PI), "theta", 5))


_EV = "e AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)"


@query(
    "win09_ema",
    f"""WITH RECURSIVE {_EV}, s(user_id, event_id, n, y, w) AS (
      SELECT user_id, event_id, n, x, CAST(1 AS DOUBLE) FROM e WHERE n = 1
      UNION ALL
      SELECT e.user_id, e.event_id, e.n, CASE WHEN e.x IS NULL THEN s.y WHEN s.y IS NULL THEN e.x ELSE (s.w * 0.7 * s.y + 0.3 * e.x) / (s.w * 0.7 + 0.3) END,
             CASE WHEN e.x IS NOT NULL OR s.y IS NULL THEN 1 ELSE s.w * 0.7 END FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1)
    SELECT user_id, event_id, round(y, 6) AS ema FROM s""",
)
def win09(spark, sf):
    rows = table(spark, sf, "events").withColumn("x", F.when(F.col("event_type") != "error", F.col("value")))
    return win.ema(rows, "x", 0.3, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", r("ema", "ema"))


_WEIGHTS = ", ".join(f"({k - 8}, CAST({w!r} AS DOUBLE))" for k, w in enumerate(win.gaussian_weights(2.0)))


@query(
    "win10_gaussian",
    f"""WITH w(k, w) AS (VALUES {_WEIGHTS}), e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events),
    m AS (SELECT user_id, event_id, value, w, (i + k) - 2 * n * floor((i + k) / (2.0 * n)) AS p, n FROM e, w)
    SELECT m.user_id, m.event_id, round(sum(w * f.value), 5) AS smoothed FROM m JOIN e f ON f.user_id = m.user_id AND f.i = least(p, 2 * m.n - 1 - p) GROUP BY ALL""",
)
def win10(spark, sf):
    return win.gaussian_smoothed(table(spark, sf, "events"), "value", 2.0, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", r("smoothed", "smoothed", 5))


_ROLL = """e AS (SELECT user_id, event_id, ts, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM events),
m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING) AS m, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS s FROM e),
f AS (SELECT *, max(CASE WHEN rn = 7 THEN m END) OVER (PARTITION BY user_id) AS a, max(CASE WHEN rn = n - 5 THEN m END) OVER (PARTITION BY user_id) AS z FROM m),
rm AS (SELECT *, CASE WHEN n < 12 THEN s WHEN rn <= 6 THEN a WHEN rn > n - 5 THEN z ELSE m END AS rolling_median FROM f)"""


@query("win11_rolling_median", f"WITH {_ROLL} SELECT user_id, event_id, round(rolling_median, 6) AS rolling_median FROM rm")
def win11(spark, sf):
    return win.rolling_median(table(spark, sf, "events"), "value", 12, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", r("rolling_median", "rolling_median"))


_EXT = """q AS (SELECT user_id, event_id, ts, floor(value / 20) AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
g AS (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY user_id ORDER BY rn) THEN 0 ELSE 1 END AS new FROM q),
h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY rn) AS run FROM g),
u AS (SELECT user_id, run, any_value(v) AS v, min(rn) AS a, max(rn) AS b FROM h GROUP BY ALL),
x AS (SELECT *, lag(v) OVER (PARTITION BY user_id ORDER BY run) AS p, lead(v) OVER (PARTITION BY user_id ORDER BY run) AS n FROM u)"""


@query("win12_extrema", f"WITH {_EXT} SELECT q.user_id, q.event_id, CASE WHEN v2 > p AND v2 > n THEN 'max' ELSE 'min' END AS extremum FROM (SELECT user_id, (a + b) // 2 AS rn, v AS v2, p, n FROM x WHERE (v > p AND v > n) OR (v < p AND v < n)) y JOIN q ON q.user_id = y.user_id AND q.rn = y.rn")
def win12(spark, sf):
    rows = table(spark, sf, "events").withColumn("v", F.floor(F.col("value") / 20))
    return win.local_extrema(rows, "v", ["user_id"], ["ts", "event_id"]).where("extremum is not null").select("user_id", "event_id", "extremum")


@query(
    "win13_outlier_classes",
    f"""WITH {_ROLL}, o AS (SELECT *, CASE WHEN value <= rolling_median * 0.2 THEN 'dark' WHEN value <= rolling_median * 0.6 THEN 'partial_dark' WHEN value >= rolling_median * 1.8 THEN 'bright' END AS kind FROM rm)
    SELECT user_id, event_id, CAST((rn - 1) // 4 AS INTEGER) AS frame_number, CASE kind WHEN 'partial_dark' THEN 'scope_error' ELSE 'temporary_artifact' END AS annotation, kind FROM o WHERE kind IS NOT NULL""",
)
def win13(spark, sf):
    from driftloom.operators.outliers import outlier_classes

    out = outlier_classes(table(spark, sf, "events"), "value", 12, ["user_id"], ["ts", "event_id"], dark=0.8, partial=0.4, bright=0.8, slices=4, peaks_only=False)
    return out.select("user_id", "event_id", "frame_number", "annotation", "kind")


@query("win14_threshold_outliers", f"WITH {_ROLL} SELECT user_id, event_id, round(value - rolling_median, 6) AS excess FROM rm WHERE value < rolling_median * 0.5 OR value > rolling_median * 1.5")
def win14(spark, sf):
    from driftloom.operators.outliers import threshold_outliers

    out = threshold_outliers(table(spark, sf, "events"), "value", 12, ["user_id"], ["ts", "event_id"], 0.5, 1.5)
    return out.select("user_id", "event_id", r(F.col("value") - F.col("rolling_median"), "excess"))


@query("win15_normalized_time", f"{W} SELECT {COLS}, round(CASE WHEN max(frame_number) {ALL} = min(frame_number) {ALL} THEN 0 ELSE (frame_number - min(frame_number) {ALL}) / (max(frame_number) {ALL} - min(frame_number) {ALL})::DOUBLE END, 6) AS s FROM t")
def win15(spark, sf):
    return trajectories(spark, sf).select(*KEY, r(win.normalized_time(), "s"))


@query("win16_valid_points", f"{W} SELECT {COLS}, CAST(sum((k < 50)::INT) {ALL} AS BIGINT) AS n_valid FROM t")
def win16(spark, sf):
    return trajectories(spark, sf).select(*KEY, F.sum((F.col("k") < 50).cast("int")).over(win.whole()).alias("n_valid"))


@query("win17_dense_index", "SELECT event_id, dense_rank() OVER (ORDER BY event_type, user_id) - 1 AS idx FROM events")
def win17(spark, sf):
    return win.with_dense_index(table(spark, sf, "events"), ["event_type", "user_id"], "idx").select("event_id", "idx")


@query("win18_first_passage", f"{W}, p AS (SELECT *, min(CASE WHEN abs(rho) <= 0.1 THEN frame_number END) {ALL} AS first_passage FROM t) SELECT {COLS}, first_passage, first_passage - frame_number AS time_to_passage FROM p")
def win18(spark, sf):
    rows = trajectories(spark, sf).withColumn("distance", F.abs("rho"))
    return win.first_passage(rows, "distance", 0.1).select(*KEY, "first_passage", "time_to_passage")


@query("win19_reached", f"{W} SELECT {COLS}, max((abs(rho) <= 0.01)::INT) {ALL} = 1 AS reached FROM t")
def win19(spark, sf):
    return trajectories(spark, sf).select(*KEY, (F.max((F.abs("rho") <= 0.01).cast("int")).over(win.whole()) == 1).alias("reached"))


@query("win20_latest_record", f"{W} SELECT crop_index, max(frame_number) AS frame_number, round(arg_max(value, frame_number), 6) AS value FROM t GROUP BY 1")
def win20(spark, sf):
    latest = F.rank().over(Window.partitionBy("crop_index").orderBy(F.desc("frame_number")))
    return trajectories(spark, sf).withColumn("rk", latest).where("rk = 1").select(*KEY, r("value", "value"))


@query(
    "win21_resampled_path",
    f"""{W}, a AS (SELECT crop_index, frame_number, value AS x, CAST(k AS DOUBLE) AS y, coalesce(sqrt((value - lag(value) {OVER}) ** 2 + (k - lag(k) {OVER}) ** 2), 0) AS d FROM t),
    s AS (SELECT *, sum(d) {OVER} AS s FROM a), b AS (SELECT *, lead(s) {OVER} AS e, lead(x) {OVER} AS nx, lead(y) {OVER} AS ny, max(s) {ALL} AS total FROM s),
    p AS (SELECT b.*, i, total / 9 * i AS pt FROM b, (SELECT unnest(generate_series(0, 9)) AS i))
    SELECT crop_index, i, round(x + (pt - s) / (e - s) * (nx - x), 4) AS x, round(y + (pt - s) / (e - s) * (ny - y), 4) AS y FROM p
    WHERE e > s AND ((i < 9 AND pt >= s - 1e-9 * total / 9 AND pt < e - 1e-9 * total / 9) OR (i = 9 AND e >= total))""",
)
def win21(spark, sf):
    rows = trajectories(spark, sf).select("crop_index", "frame_number", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))
    return win.resampled(rows, ["x", "y"], 10, ["crop_index"], ["frame_number"]).select("crop_index", "i", r("x", "x", 4), r("y", "y", 4))


@query("win22_filled_frames", f"{W}, b AS (SELECT min(frame_number) AS a, max(frame_number) AS z FROM t), e AS (SELECT crop_index, CAST(unnest(generate_series(a, z)) AS INTEGER) AS frame_number FROM (SELECT DISTINCT crop_index FROM t), b) SELECT e.crop_index, e.frame_number, k FROM e LEFT JOIN t USING (crop_index, frame_number)")
def win22(spark, sf):
    return win.fill_frames(trajectories(spark, sf)).select(*KEY, "k")


@query("win23_angle_gaps", f"{W}, a AS (SELECT DISTINCT dataset, k FROM t) SELECT dataset, k, CAST(coalesce(lead(k) OVER w, min(k) OVER (PARTITION BY dataset) + 100) - k AS INTEGER) AS gap FROM a WINDOW w AS (PARTITION BY dataset ORDER BY k)")
def win23(spark, sf):
    rows = trajectories(spark, sf).select("dataset", "k").distinct()
    w = Window.partitionBy("dataset").orderBy("k")
    return rows.withColumn("gap", F.coalesce(F.lead("k").over(w), F.first("k").over(w) + 100) - F.col("k"))
