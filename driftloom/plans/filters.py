"""Queries of guards (VAL), filters (FLT) and annotations (ANN)."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.operators import annotations as ann
from driftloom.operators import filters as flt
from driftloom.operators import guards
from driftloom.operators.ranks import percentiles
from driftloom.operators.windows import with_track_duration
from driftloom.registry import query
from driftloom.sources.tables import ANNOTATIONS, DATASETS, DUST, FLOW, T_SQL, U_SQL, setting, table, trajectories

KEY = ["dataset", "position", "crop_index", "frame_number"]
COLS = "dataset, position, crop_index, frame_number"
_SETTINGS = f"a AS ({ANNOTATIONS}), dust AS ({DUST}), ds AS ({DATASETS}), flow AS ({FLOW}), pos AS (SELECT DISTINCT dataset, position FROM t WHERE crop_index % 5 <> 0)"
W = f"WITH {T_SQL}, {_SETTINGS}"
_FRAMES = "(SELECT DISTINCT dataset, position, unnest(generate_series(start_frame, stop_frame)) AS f FROM a{where})"


class S:
    """Settings and trajectories of a query."""

    def __init__(self, spark, sf):
        self.t = trajectories(spark, sf)
        self.a, self.dust, self.ds, self.flow = (setting(spark, x) for x in (ANNOTATIONS, DUST, DATASETS, FLOW))
        self.pos = self.t.where("crop_index % 5 <> 0").select("dataset", "position").distinct()


def _removed(frame_kinds: str, position_kinds: str) -> str:
    return f"""{W} SELECT {COLS}, round(value, 6) AS value FROM t JOIN ds USING (dataset) WHERE frame_number BETWEEN 0 AND duration - 1
      AND EXISTS (SELECT 1 FROM pos p WHERE p.dataset = t.dataset AND p.position = t.position)
      AND NOT EXISTS (SELECT 1 FROM dust p WHERE p.dataset = t.dataset AND p.position = t.position AND {position_kinds})
      AND NOT EXISTS (SELECT 1 FROM a WHERE a.dataset = t.dataset AND a.position = t.position AND frame_number BETWEEN start_frame AND stop_frame AND {frame_kinds})"""


@query("val01_required_columns", "SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def val01(spark, sf):
    return guards.require_columns(table(spark, sf, "events"), ["user_id", "value"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("val02_single_value", "SELECT CAST(CASE WHEN count(DISTINCT event_type) > 1 THEN 2 ELSE count(DISTINCT event_type) END AS BIGINT) AS several, min(event_type) AS value FROM events")
def val02(spark, sf):
    found = guards.distinct_values(table(spark, sf, "events"), "event_type")
    return found.select(F.least("n_values", F.lit(2)).cast("long").alias("several"), "value")


@query("val03_unknown_dataset", f"{W} SELECT dataset, count(*) AS n FROM t WHERE dataset NOT IN (SELECT dataset FROM ds WHERE duration = 60) GROUP BY dataset")
def val03(spark, sf):
    s = S(spark, sf)
    return guards.with_known(s.t, s.ds.where("duration = 60"), "dataset").groupBy("dataset").agg(F.count("*").alias("n"))


@query("val04_only_value", "SELECT o_custkey, max(o_orderstatus) AS status FROM orders GROUP BY o_custkey HAVING min(o_orderstatus) = max(o_orderstatus)")
def val04(spark, sf):
    g = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderstatus").alias("low"), F.max("o_orderstatus").alias("status"))
    return g.where("low = status").drop("low")


@query("val05_duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def val05(spark, sf):
    return guards.duplicate_keys(table(spark, sf, "events"), ["user_id", "event_type"])


@query(
    "val06_one_to_one",
    "SELECT 'left' AS side, o_custkey AS k, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1 UNION ALL SELECT 'right', c_custkey, count(*) FROM customer GROUP BY ALL HAVING count(*) > 1",
)
def val06(spark, sf):
    left = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    return guards.one_to_one(left, table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])


@query(
    "val07_position_sets",
    f"""{W}, e AS (SELECT dataset, CAST(p AS INTEGER) AS position FROM ds, (SELECT unnest(generate_series(0, 4)) AS p)), f AS (SELECT DISTINCT dataset, position FROM t)
    SELECT dataset, position, 'extra' AS kind FROM (SELECT * FROM f EXCEPT SELECT * FROM e) UNION ALL SELECT dataset, position, 'missing' FROM (SELECT * FROM e EXCEPT SELECT * FROM f)""",
)
def val07(spark, sf):
    s = S(spark, sf)
    expected = s.ds.select("dataset", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("position"))
    return guards.set_differences(s.t, expected, ["dataset", "position"])


@query(
    "val08_frame_sets",
    f"""{W}, e AS (SELECT dataset, position, CAST(unnest(generate_series(0, duration - 1)) AS INTEGER) AS frame_number FROM pos JOIN ds USING (dataset)), f AS (SELECT DISTINCT dataset, position, frame_number FROM t)
    SELECT *, 'extra' AS kind FROM (SELECT * FROM f EXCEPT SELECT * FROM e) UNION ALL SELECT *, 'missing' FROM (SELECT * FROM e EXCEPT SELECT * FROM f)""",
)
def val08(spark, sf):
    s = S(spark, sf)
    frames = F.explode(F.sequence(F.lit(0), F.col("duration") - 1)).alias("frame_number")
    expected = s.pos.join(s.ds, "dataset").select("dataset", "position", frames)
    return guards.set_differences(s.t, expected, ["dataset", "position", "frame_number"])


@query(
    "val09_column_report",
    """WITH d AS (SELECT column_name AS c FROM (DESCRIBE SELECT * FROM events)), e AS (SELECT unnest(['event_id', 'ts', 'user_id', 'label', 'mask']) AS c)
    SELECT (SELECT count(*) FROM events) AS n_rows, (SELECT list(c ORDER BY c) FROM d WHERE c NOT IN (SELECT c FROM e)) AS extra, (SELECT list(c ORDER BY c) FROM e WHERE c NOT IN (SELECT c FROM d) AND c <> 'mask') AS missing""",
)
def val09(spark, sf):
    found = guards.column_report(table(spark, sf, "events"), ["event_id", "ts", "user_id", "label", "mask"], ["mask"])
    counted = table(spark, sf, "events").agg(F.count("*").alias("n_rows"))
    return counted.select("n_rows", F.array(*map(F.lit, found["extra"])).alias("extra"), F.array(*map(F.lit, found["missing"])).alias("missing"))


@query(
    "val10_config_rules",
    f"{W} SELECT dataset, count(*) AS n, CAST(bool_or(frame_number >= duration) AS BOOLEAN) AS too_long, bool_and(time_interval_in_minutes IS NOT NULL = (duration > 1)) AS interval_ok FROM t JOIN ds USING (dataset) GROUP BY dataset",
)
def val10(spark, sf):
    s = S(spark, sf)
    ok = F.col("time_interval_in_minutes").isNotNull() == (F.col("duration") > 1)
    return s.t.join(s.ds, "dataset").groupBy("dataset").agg(F.count("*").alias("n"), F.bool_or(F.col("frame_number") >= F.col("duration")).alias("too_long"), F.bool_and(ok).alias("interval_ok"))


REGIMES = "SELECT regime, low, high FROM (VALUES ('none', 0, 20), ('low', 21, 120), ('mid', 121, 300), ('high', 301, 500)) AS v(regime, low, high)"


@query("val11_regime", f"{W}, g AS ({REGIMES}) SELECT {COLS}, regime FROM t JOIN g ON floor(value) BETWEEN low AND high")
def val11(spark, sf):
    found = F.broadcast(setting(spark, REGIMES))  # four fixed rows
    return trajectories(spark, sf).join(found, F.floor("value").between(F.col("low"), F.col("high"))).select(*KEY, "regime")


@query(
    "val12_row_count",
    """WITH c AS (SELECT event_type, count(*) AS n_in, count(*) FILTER (value < 50) AS low, count(*) FILTER (NOT value < 50 OR value IS NULL) AS rest, count(*) FILTER (value > 50) AS above FROM events GROUP BY 1)
    SELECT event_type, n_in, low + rest AS n_out, n_in = low + rest AS same, low + above AS n_gap, n_in = low + above AS same_gap FROM c""",
)
def val12(spark, sf):
    """Rows by type before a split and after the union of its parts, for a split that keeps all and one that leaves a gap at 50 and nulls."""
    rows = table(spark, sf, "events")
    low = rows.where("value < 50")
    whole, gap = low.unionByName(rows.where("not value < 50 or value is null")), low.unionByName(rows.where("value > 50"))
    kept = guards.row_counts(rows, whole, ["event_type"])
    lost = guards.row_counts(rows, gap, ["event_type"]).withColumnsRenamed({"n_out": "n_gap", "same": "same_gap"})
    return kept.join(lost.drop("n_in"), "event_type")


@query("val13_allclose", "SELECT a.vec_id, list_sort([round(x, 6) FOR x IN a.embedding]) = list_sort([round(x, 6) FOR x IN a.embedding]) AS same FROM embeddings a")
def val13(spark, sf):
    near = F.transform("embedding", lambda x: x.cast("double") * (1 + 1e-7))
    return table(spark, sf, "embeddings").select("vec_id", guards.allclose(near, F.transform("embedding", lambda x: x.cast("double"))).alias("same"))


@query("val14_unknown_members", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def val14(spark, sf):
    known = table(spark, sf, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return guards.with_known(table(spark, sf, "orders").select("o_custkey"), known, "o_custkey").distinct()


_DUR = f"{W}, d AS (SELECT *, max(frame_number) OVER (PARTITION BY dataset, position, crop_index) - min(frame_number) OVER (PARTITION BY dataset, position, crop_index) AS track_duration FROM t)"


@query("flt01_track_length", f"{_DUR} SELECT {COLS}, track_duration FROM d WHERE track_duration >= 55")
def flt01(spark, sf):
    return flt.by_track_length(with_track_duration(trajectories(spark, sf)), 55).select(*KEY, "track_duration")


@query("flt02_annotations", _removed("true", "true"))
def flt02(spark, sf):
    s = S(spark, sf)
    return flt.by_annotations(s.t, s.ds, s.pos, s.dust, s.a).select(*KEY, F.round("value", 6).alias("value"))


@query("flt03_steady_state", _removed("annotation = 'not_steady_state'", "false"))
def flt03(spark, sf):
    s = S(spark, sf)
    return flt.steady_state(s.t, s.ds, s.pos, s.dust, s.a).select(*KEY, F.round("value", 6).alias("value"))


_COND = f"""{W}, c AS (SELECT dataset, count(*) AS n, arg_max(start_frame, ordinal) AS change, arg_min(shear_stress, ordinal) AS s0, arg_max(shear_stress, ordinal) AS s1 FROM flow GROUP BY dataset),
  w AS (SELECT t.*, CASE WHEN n > 1 AND frame_number >= change THEN 1 ELSE 0 END AS ordinal, CASE WHEN n > 1 AND frame_number >= change THEN s1 ELSE s0 END AS shear_stress FROM t JOIN c USING (dataset))"""


@query("flt04_flow_condition", f"{_COND} SELECT {COLS}, shear_stress FROM w WHERE ordinal = 1")
def flt04(spark, sf):
    s = S(spark, sf)
    return flt.with_condition(s.t, s.flow).where("ordinal = 1").select(*KEY, "shear_stress")


@query("flt05_shear_stress", f"{_COND} SELECT {COLS} FROM w WHERE shear_stress = 6")
def flt05(spark, sf):
    s = S(spark, sf)
    return flt.with_condition(s.t, s.flow).where("shear_stress = 6").select(*KEY)


@query("flt06_same_bin", f"{W} SELECT {COLS} FROM t WHERE polar_theta >= 1 AND polar_theta < 2 AND rho >= 0.5")
def flt06(spark, sf):
    edges = {"polar_theta": [0.0, 1.0, 2.0, 3.0], "rho": [-0.5, 0.0, 0.5, 1.0]}
    return flt.in_same_bin(trajectories(spark, sf), {"polar_theta": 1.5, "rho": 1.0}, edges).select(*KEY)


@query("flt07_stability", f"{W} SELECT {COLS} FROM t JOIN ds USING (dataset) WHERE stability_category = 'stable'")
def flt07(spark, sf):
    s = S(spark, sf)
    return s.t.join(s.ds, "dataset").where("stability_category = 'stable'").select(*KEY)


@query(
    "flt08_quality_flags",
    f"""{_DUR}, f AS (SELECT *, track_duration > 24 AS long_enough, coalesce(abs(rho - lag(rho) OVER (PARTITION BY dataset, position, crop_index ORDER BY frame_number)) < 0.5, false) AS small_change, k < 95 AS inside FROM d),
    v AS (SELECT *, long_enough AND small_change AND inside AS valid FROM f), n AS (SELECT *, sum(valid::INT) OVER (PARTITION BY dataset, position, crop_index) AS n_valid FROM v)
    SELECT {COLS}, track_duration, long_enough, small_change, inside, valid, CAST(n_valid AS BIGINT) AS n_valid, valid AND n_valid > 10 AS is_included FROM n""",
)
def flt08(spark, sf):
    out = flt.quality_flags(trajectories(spark, sf), "rho", F.col("k") >= 95, most_change=0.5, least_valid=10)
    return out.select(*KEY, "track_duration", "long_enough", "small_change", "inside", "valid", "n_valid", "is_included")


@query("flt09_included", f"{_DUR} SELECT {COLS} FROM d WHERE track_duration > 24 AND k < 95")
def flt09(spark, sf):
    flagged = with_track_duration(trajectories(spark, sf)).withColumn("is_included", (F.col("track_duration") > 24) & (F.col("k") < 95))
    return flagged.where("is_included").select(*KEY)


@query("flt10_in_bounds", f"{W} SELECT {COLS} FROM t WHERE value - 32 >= 0 AND k * 4 - 32 >= 0 AND value + 32 <= 480 AND k * 4 + 32 <= 400")
def flt10(spark, sf):
    x, y = F.col("value"), F.col("k") * 4
    return trajectories(spark, sf).where((x - 32 >= 0) & (y - 32 >= 0) & (x + 32 <= 480) & (y + 32 <= 400)).select(*KEY)


@query("flt11_detected_points", f"{W} SELECT crop_index, dataset, round(avg((rho < 0)::INT), 6) AS detection_rate FROM t JOIN ds USING (dataset) WHERE stability_category = 'stable' GROUP BY ALL HAVING avg((rho < 0)::INT) >= 0.4")
def flt11(spark, sf):
    s = S(spark, sf)
    rate = s.t.join(s.ds, "dataset").groupBy("crop_index", "dataset", "stability_category").agg(F.avg((F.col("rho") < 0).cast("int")).alias("detection_rate"))
    return rate.where("detection_rate >= 0.4 and stability_category = 'stable'").select("crop_index", "dataset", F.round("detection_rate", 6).alias("detection_rate"))


@query(
    "flt12_enough_rows",
    f"""WITH {T_SQL}, {U_SQL}, a AS (SELECT k // 10 AS b, count(*) AS na, avg(value) AS va FROM t GROUP BY 1), c AS (SELECT k // 10 AS b, count(*) AS nc, avg(value) AS vc FROM u GROUP BY 1)
    SELECT CAST(b AS INTEGER) AS b, na, nc, round(va, 6) AS va, round(vc, 6) AS vc FROM a JOIN c USING (b) WHERE na >= 10 AND nc >= 10 AND va IS NOT NULL AND vc IS NOT NULL""",
)
def flt12(spark, sf):
    b = F.floor(F.col("k") / 10).cast("int").alias("b")
    a = trajectories(spark, sf).groupBy(b).agg(F.count("*").alias("na"), F.avg("value").alias("va"))
    c = trajectories(spark, sf, last=True).groupBy(b).agg(F.count("*").alias("nc"), F.avg("value").alias("vc"))
    out = a.join(c, "b").where("na >= 10 and nc >= 10 and va is not null and vc is not null")
    return out.withColumns({"va": F.round("va", 6), "vc": F.round("vc", 6)})


@query("flt13_reaching", f"{W} SELECT {COLS} FROM t WHERE crop_index IN (SELECT crop_index FROM t WHERE abs(rho) <= 0.02)")
def flt13(spark, sf):
    rows = trajectories(spark, sf).withColumn("distance", F.abs("rho"))
    return flt.reaching(rows, "distance", 0.02).select(*KEY)


@query("flt14_before_passage", f"{W}, p AS (SELECT crop_index, min(frame_number) AS fpt FROM t WHERE abs(rho) <= 0.1 GROUP BY 1) SELECT {COLS} FROM t JOIN p USING (crop_index) WHERE frame_number < fpt")
def flt14(spark, sf):
    from driftloom.operators.windows import first_passage

    rows = first_passage(trajectories(spark, sf).withColumn("distance", F.abs("rho")), "distance", 0.1)
    return rows.where(F.col("frame_number") < F.col("first_passage")).select(*KEY)


@query(
    "flt15_percentile_box",
    f"""{W}, b AS (SELECT dataset, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM t GROUP BY 1)
    SELECT {COLS} FROM t JOIN b USING (dataset) WHERE value BETWEEN lo AND hi AND (polar_theta >= 2.5 OR polar_theta <= 0.5)""",
)
def flt15(spark, sf):
    t = trajectories(spark, sf)
    bounds = percentiles(t, ["dataset"], "value", [5, 95]).select("dataset", F.col("p")[0].alias("lo"), F.col("p")[1].alias("hi"))
    inside = flt.inside_box(F.col("value"), F.col("lo"), F.col("hi")) & flt.inside_box(F.col("polar_theta"), F.lit(2.5), F.lit(0.5))
    return t.join(bounds, "dataset").where(inside).select(*KEY)


@query("flt17_is_in", f"{W} SELECT {COLS} FROM t WHERE position IN (0, 2) AND frame_number IN (1, 5, 9)")
def flt17(spark, sf):
    return trajectories(spark, sf).where(F.col("position").isin(0, 2) & F.col("frame_number").isin(1, 5, 9)).select(*KEY)


@query("flt18_demo_subset", f"{W} SELECT {COLS} FROM t WHERE frame_number < 30 ORDER BY dataset, position, crop_index, frame_number LIMIT 100")
def flt18(spark, sf):
    return trajectories(spark, sf).where("frame_number < 30").orderBy(*KEY).limit(100).select(*KEY)


@query("flt19_drop_null", "SELECT event_id FROM events WHERE try_cast(json_extract_string(props, '$.k') AS INTEGER) IS NOT NULL AND nullif(event_type, 'error') IS NOT NULL")
def flt19(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.nullif("event_type", F.lit("error")).alias("kind"))
    return rows.na.drop(subset=["k", "kind"]).select("event_id")


@query(
    "flt20_split_and_union",
    f"{_DUR} SELECT {COLS}, CASE WHEN track_duration > 24 THEN round(frame_number - avg(frame_number) OVER (PARTITION BY crop_index, track_duration > 24), 6) END AS centred FROM d",
)
def flt20(spark, sf):
    from pyspark.sql import Window

    rows = with_track_duration(trajectories(spark, sf))
    centred = F.round(F.col("frame_number") - F.avg("frame_number").over(Window.partitionBy("crop_index")), 6)
    out = rows.where("track_duration > 24").withColumn("centred", centred).unionByName(rows.where("not track_duration > 24"), allowMissingColumns=True)
    return out.select(*KEY, "centred")


@query(
    "flt21_annotation_columns",
    f"""{W} SELECT {COLS}, {', '.join(f"CAST(EXISTS (SELECT 1 FROM a WHERE a.dataset = t.dataset AND a.position = t.position AND annotation = '{k}' AND frame_number BETWEEN start_frame AND stop_frame) AS INTEGER) AS {k}" for k in ('not_steady_state', 'cell_piling'))} FROM t""",
)
def flt21(spark, sf):
    s = S(spark, sf)
    return flt.flag_columns(s.t, s.a, ["not_steady_state", "cell_piling"]).select(*KEY, "not_steady_state", "cell_piling")


@query("flt22_wrapped_limits", f"WITH {T_SQL}, s AS (SELECT *, CASE WHEN polar_theta < 1 THEN polar_theta + 3.141592653589793 ELSE polar_theta END AS w FROM t) SELECT {COLS}, round(w, 6) AS theta FROM s WHERE w BETWEEN 1 AND 3.5")
def flt22(spark, sf):
    from driftloom.functions.angles import PI

    x = F.col("polar_theta")
    moved = F.when(x < 1, x + F.lit(PI)).when(x > 1 + PI, x - F.lit(PI)).otherwise(x)
    return trajectories(spark, sf).withColumn("theta", moved).where(F.col("theta").between(1, 3.5)).select(*KEY, F.round("theta", 6).alias("theta"))


@query("flt23_from_entry", f"{W}, e AS (SELECT crop_index, min(frame_number) AS entry FROM t WHERE k BETWEEN 40 AND 44 GROUP BY 1) SELECT {COLS} FROM t JOIN e USING (crop_index) WHERE frame_number >= entry")
def flt23(spark, sf):
    return flt.from_entry(trajectories(spark, sf), F.col("k").between(40, 44)).select(*KEY)


@query("flt24_drop_columns", f"{W} SELECT {COLS}, k FROM t")
def flt24(spark, sf):
    return trajectories(spark, sf).drop("value", "polar_r", "polar_theta", "rho")


@query("flt25_nearest_slice", f"{W} SELECT {COLS} FROM t WHERE abs(k - 40.5) = (SELECT min(abs(k - 40.5)) FROM t)")
def flt25(spark, sf):
    return flt.nearest_slice(trajectories(spark, sf), "k", 40.5).select(*KEY)


@query("ann01_positions", f"{W} SELECT DISTINCT dataset, position FROM t WHERE NOT EXISTS (SELECT 1 FROM dust d WHERE d.dataset = t.dataset AND d.position = t.position)")
def ann01(spark, sf):
    s = S(spark, sf)
    return ann.unannotated_positions(s.t, s.dust)


@query("ann02_annotated_rows", f"{W} SELECT DISTINCT dataset, position, frame_number FROM t JOIN a USING (dataset, position) WHERE frame_number BETWEEN start_frame AND stop_frame")
def ann02(spark, sf):
    s = S(spark, sf)
    return s.t.select("dataset", "position", "frame_number").distinct().join(ann.annotated_frames(s.a), ["dataset", "position", "frame_number"], "left_semi")


@query(
    "ann03_unannotated_frames",
    f"""{W}, e AS (SELECT dataset, position, CAST(unnest(generate_series(0, duration - 1)) AS INTEGER) AS frame_number FROM pos JOIN ds USING (dataset))
    SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.dataset = e.dataset AND a.position = e.position AND e.frame_number BETWEEN start_frame AND stop_frame)""",
)
def ann03(spark, sf):
    s = S(spark, sf)
    return ann.unannotated_frames(s.pos, s.ds, s.a)


@query(
    "ann04_steady_start",
    f"{W}, m AS (SELECT dataset, position, max(stop_frame) + 1 AS n FROM a WHERE annotation = 'not_steady_state' GROUP BY ALL) SELECT pos.dataset, pos.position, CASE WHEN n < duration THEN n END AS start FROM pos JOIN ds USING (dataset) LEFT JOIN m USING (dataset, position)",
)
def ann04(spark, sf):
    s = S(spark, sf)
    return ann.steady_start(s.pos, s.ds, s.a)


@query(
    "ann05_flow_change",
    f"{W}, c AS (SELECT dataset, count(*) AS n, arg_min(stop_frame, ordinal) AS b, arg_max(start_frame, ordinal) AS f FROM flow GROUP BY 1) SELECT DISTINCT t.dataset, CASE WHEN n = 2 THEN b END AS before, CASE WHEN n = 2 THEN f END AS after FROM t JOIN c USING (dataset)",
)
def ann05(spark, sf):
    s = S(spark, sf)
    return ann.flow_change(s.flow).join(s.t.select("dataset").distinct(), "dataset")


@query("ann06_flow_at_frame", f"{W} SELECT {COLS}, shear_stress, CAST(3 * round_even(shear_stress / 3, 0) AS INTEGER) AS shear_bin FROM t LEFT JOIN flow USING (dataset) WHERE frame_number BETWEEN start_frame AND stop_frame")
def ann06(spark, sf):
    from driftloom.functions.angles import shear_bin

    s = S(spark, sf)
    return ann.flow_at(s.t, s.flow).select(*KEY, "shear_stress", shear_bin(F.col("shear_stress")).alias("shear_bin"))


@query("ann06b_duration_at_flow", f"{W}, n AS (SELECT dataset, count(*) AS n FROM t GROUP BY 1) SELECT dataset, shear_stress, CAST(sum(stop_frame - start_frame) AS BIGINT) AS duration, n FROM flow JOIN n USING (dataset) GROUP BY ALL")
def ann06b(spark, sf):
    s = S(spark, sf)
    return ann.duration_at(s.flow).join(s.t.groupBy("dataset").agg(F.count("*").alias("n")), "dataset")


@query("ann07_other_kinds", f"{W} SELECT annotation, count(*) AS n FROM t JOIN a USING (dataset, position) WHERE frame_number BETWEEN start_frame AND stop_frame AND annotation <> 'cell_piling' GROUP BY 1")
def ann07(spark, sf):
    s = S(spark, sf)
    marks = ann.except_kinds(s.a, ["cell_piling"]).select("dataset", "position", "annotation", F.explode(F.sequence("start_frame", "stop_frame")).alias("frame_number"))
    return s.t.join(marks, ["dataset", "position", "frame_number"]).groupBy("annotation").agg(F.count("*").alias("n"))
