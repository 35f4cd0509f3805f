"""Queries of sources, sinks and catalogs (SRC)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from driftloom.operators import catalog as cat
from driftloom.operators.sampling import split_rows
from driftloom.registry import query
from driftloom.sources import files
from driftloom.sources.scratch import shared_folder
from driftloom.sources.tables import ANNOTATIONS, DATASETS, DUST, FLOW, T_SQL, setting, table, trajectories

W = f"WITH {T_SQL}, a AS ({ANNOTATIONS}), ds AS ({DATASETS}), flow AS ({FLOW}), dust AS ({DUST})"


def _scratch(spark, name):
    return f"{shared_folder(spark)}/driftloom-{uuid.uuid4().hex}/{name}"


def nations(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


@query("src01_parquet", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src01(spark, sf):
    return files.read_table(spark, f"{sf}/nation.parquet")


def _round_trip(spark, sf, suffix):
    path = _scratch(spark, "supplier" + suffix)
    rows = table(spark, sf, "supplier")
    files.write_table(rows, path)
    return files.read_table(spark, path, rows.schema)


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@query("src02_csv", _SUPPLIER)
def src02(spark, sf):
    return _round_trip(spark, sf, ".csv")


@query("src03_tsv", _SUPPLIER)
def src03(spark, sf):
    return _round_trip(spark, sf, ".tsv")


@query("src05_fallback", "SELECT r_regionkey, r_name FROM region")
def src05(spark, sf):
    return files.read_first(spark, [None, f"{sf}/no_such_table.parquet", f"{sf}/region.parquet"])


@query("src06_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def src06(spark, sf):
    return files.read_table(spark, f"{sf}/lineitem.parquet", columns=["l_orderkey", "l_quantity"]).where("l_quantity > 45")


def manifests(spark, sf):
    """One manifest a part type: parameters from brand and size, places from the name."""
    p = table(spark, sf, "part")
    params = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"))
    path = F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("/data/"), F.col("p_partkey").cast("string"), F.lit(".parquet")))
    return p.select(F.col("p_name").alias("name"), F.col("p_type").alias("workflow"), params.alias("parameters"), F.col("p_partkey").cast("string").alias("key"), F.lit(None).cast("string").alias("id"), path.alias("path"), F.lit(None).cast("string").alias("uri"))


@query("src07_manifest_list", "SELECT p_name AS name, p_type AS workflow, count(*) AS n FROM part GROUP BY ALL")
def src07(spark, sf):
    return manifests(spark, sf).groupBy("name", "workflow").agg(F.count("*").alias("n"))


@query("src08_by_parameters", "SELECT CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#2' AND p_size = 11")
def src08(spark, sf):
    return cat.with_parameters(manifests(spark, sf), "ECONOMY", {"brand": "Brand#2", "size": "11"}).select("key")


@query("src09_location", "SELECT p_name AS name, CAST(p_partkey AS VARCHAR) AS key, '/data/' || p_partkey || '.parquet' AS path FROM part WHERE p_partkey % 3 <> 0")
def src09(spark, sf):
    return cat.locations(manifests(spark, sf)).select("name", "key", F.col("place").alias("path"))


@query("src10_located_keys", "SELECT DISTINCT p_name AS name, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE p_partkey % 3 <> 0")
def src10(spark, sf):
    return cat.located_keys(manifests(spark, sf))


@query("src11_templates", f"{W} SELECT DISTINCT dataset, position, '/z/' || dataset || '/P' || position || '/T' || frame_number || '.zarr' AS path FROM t")
def src11(spark, sf):
    t = trajectories(spark, sf)
    template = F.concat(F.lit("/z/"), F.col("dataset"), F.lit("/P{{position}}/T{{timepoint}}.zarr"))
    return t.select("dataset", "position", cat.expand_template(template, {"position": F.col("position"), "timepoint": F.col("frame_number")}).alias("path")).distinct()


@query("src12_collections", "SELECT n_name AS dataset, row_number() OVER (ORDER BY r_name = 'ASIA' DESC, n_name) AS place FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def src12(spark, sf):
    collections = nations(spark, sf).groupBy(F.col("r_name").alias("name")).agg(F.array_sort(F.collect_list("n_name")).alias("members"))
    return cat.members_of(collections, ["ASIA", "EUROPE"])


@query("src13_config_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_type FROM events")
def src13(spark, sf):
    parsed = F.from_json("props", "k int")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), "event_type")


@query("src14_gathered", f"{W} SELECT crop_index, k, frame_number FROM t")
def src14(spark, sf):
    folder = _scratch(spark, "frames")
    # One job: each frame's rows meet in one task, which writes one file into the frame's folder.
    rows = trajectories(spark, sf).select("crop_index", "k", F.col("frame_number").alias("T"))
    rows.repartition("T").write.partitionBy("T").parquet(folder)
    return files.gather(spark, folder, "*.parquet")


@query("src16_partitioned_write", f"{W} SELECT dataset, count(*) AS n, CAST(sum(k) AS BIGINT) AS k FROM t GROUP BY 1")
def src16(spark, sf):
    path = _scratch(spark, "t.parquet")
    rows = trajectories(spark, sf)
    files.write_table(rows, path, ["dataset"], {"workflow": "trajectories"}, {"k": "state index"})
    files.check_written(spark, path, rows)
    return spark.read.parquet(path).groupBy("dataset").agg(F.count("*").alias("n"), F.sum("k").alias("k"))


@query("src17_csv_summary", f"{W} SELECT dataset, count(*) AS n FROM t GROUP BY 1")
def src17(spark, sf):
    path = _scratch(spark, "summary.tsv")
    files.write_table(trajectories(spark, sf).groupBy("dataset").agg(F.count("*").alias("n")), path)
    return files.read_table(spark, path, "dataset string, n bigint")


@query("src18_output_names", "SELECT p_partkey, 'summary_' || regexp_replace(lower(p_name), '[\\s-]+', '_', 'g') || CASE WHEN n > 0 THEN '_' || n ELSE '' END AS name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part)")
def src18(spark, sf):
    from pyspark.sql import Window

    from driftloom.functions.text import slugify

    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
    name = F.concat(F.lit("summary_"), slugify(F.col("p_name")), F.when(F.col("n") > 0, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(F.lit("")))
    return table(spark, sf, "part").withColumn("n", n).select("p_partkey", name.alias("name"))


@query("src19_parameters", "SELECT CAST(p_partkey AS VARCHAR) AS key, p_brand || ';' || p_size AS parameters FROM part")
def src19(spark, sf):
    return manifests(spark, sf).select("key", F.array_join(F.map_values("parameters"), ";").alias("parameters"))


@query("src20_comments", "SELECT n_nationkey, n_name, n_regionkey, 'name of the nation' AS n_name_comment FROM nation")
def src20(spark, sf):
    path = _scratch(spark, "nation.parquet")
    files.write_table(files.with_comments(table(spark, sf, "nation"), {"n_name": "name of the nation"}), path)
    # Read back, so that the row shows what the written table says of its columns.
    again = spark.read.parquet(path)
    return again.withColumn("n_name_comment", F.lit(again.schema["n_name"].metadata.get("comment")))


@query("src15_written", "SELECT count(*) FILTER (o_totalprice < 1000) - count(*) AS more_rows, ['o_custkey'] AS other_columns, 0 AS more_rows_whole FROM orders")
def src15(spark, sf):
    """What the check of a written table says of a table that lost rows and a column, and of a whole one."""
    part, whole, rows = _scratch(spark, "part.parquet"), _scratch(spark, "orders.parquet"), table(spark, sf, "orders")
    files.write_table(rows.where("o_totalprice < 1000").drop("o_custkey"), part)
    files.write_table(rows, whole)
    files.check_written(spark, whole, rows)
    n, columns = files.written_differences(spark, part, rows)
    return spark.createDataFrame([(n, sorted(columns), files.written_differences(spark, whole, rows)[0])], "more_rows long, other_columns array<string>, more_rows_whole int")


@query("src21_staging", "SELECT DISTINCT '/data/' || p_brand AS source, '/stage/' || lower(p_brand) AS target FROM part")
def src21(spark, sf):
    b = F.col("p_brand")
    return table(spark, sf, "part").select(F.concat(F.lit("/data/"), b).alias("source"), F.concat(F.lit("/stage/"), F.lower(b)).alias("target")).dropDuplicates()


@query(
    "src22_release_rows",
    f"{W}, n AS (SELECT dataset, count(*) AS n FROM t GROUP BY 1) SELECT dataset, date, n, max(CASE WHEN ordinal = 0 THEN shear_stress END) AS condition_0, max(CASE WHEN ordinal = 1 THEN shear_stress END) AS condition_1 FROM n JOIN ds USING (dataset) JOIN flow USING (dataset) GROUP BY ALL",
)
def src22(spark, sf):
    wide = setting(spark, FLOW).groupBy("dataset").pivot("ordinal", [0, 1]).agg(F.max("shear_stress")).withColumnsRenamed({"0": "condition_0", "1": "condition_1"})
    n = trajectories(spark, sf).groupBy("dataset").agg(F.count("*").alias("n"))
    return n.join(setting(spark, DATASETS), "dataset").join(wide, "dataset").select("dataset", "date", "n", "condition_0", "condition_1")


@query("src23_listing", f"{W} SELECT dataset, position, CAST(greatest(0, position * 5 - 3) AS INTEGER) AS z_low, CAST(least(24, position * 5 + 4) AS INTEGER) AS z_high, list(DISTINCT frame_number ORDER BY frame_number) AS frames FROM t GROUP BY ALL")
def src23(spark, sf):
    low, high = cat.plane_bounds(F.col("position") * 5, 3, 4)
    return trajectories(spark, sf).groupBy("dataset", "position").agg(F.array_sort(F.collect_set("frame_number")).alias("frames")).withColumns({"z_low": low, "z_high": high})


@query("src24_per_frame", f"{W}, l AS (SELECT dataset, position, min(frame_number) AS a, max(frame_number) AS z FROM t GROUP BY ALL) SELECT dataset, position, CAST(unnest(CASE WHEN position = 0 THEN [1, 3, 5] ELSE generate_series(a, z, 7) END) AS INTEGER) AS frame_number FROM l")
def src24(spark, sf):
    l = trajectories(spark, sf).groupBy("dataset", "position").agg(F.min("frame_number").alias("a"), F.max("frame_number").alias("z"))
    chosen = F.when(F.col("position") == 0, F.array(F.lit(1), F.lit(3), F.lit(5)))
    return cat.per_frame(l, chosen, F.col("a"), F.col("z"), F.lit(7)).select("dataset", "position", "frame_number")


@query("src25_plane_bounds", "SELECT p_partkey, CAST(greatest(0, p_size - 10) AS INTEGER) AS z_low, CAST(least(24, p_size + 5) AS INTEGER) AS z_high FROM part")
def src25(spark, sf):
    low, high = cat.plane_bounds(F.col("p_size"), 10, 5)
    return table(spark, sf, "part").select("p_partkey", low.alias("z_low"), high.alias("z_high"))


@query("src26_train_split", "SELECT event_id, CASE WHEN CAST('0x' || substr(md5(event_id || ':42'), 1, 15) AS BIGINT) % 100 < 20 THEN 'validation' ELSE 'train' END AS split FROM events")
def src26(spark, sf):
    return split_rows(table(spark, sf, "events"), ["event_id"]).select("event_id", "split")


@query("src27_training_dates", f"{W} SELECT DISTINCT date FROM (SELECT dataset FROM t WHERE k < 5 UNION SELECT dataset FROM t WHERE k > 95) JOIN ds USING (dataset)")
def src27(spark, sf):
    t = trajectories(spark, sf)
    used = t.where("k < 5").select("dataset").union(t.where("k > 95").select("dataset")).distinct()
    return setting(spark, DATASETS).join(used, "dataset", "left_semi").select("date").distinct()


@query("src28_work_list", f"{W}, p AS (SELECT DISTINCT dataset, position FROM t) SELECT dataset, position, CAST(f AS INTEGER) AS frame_number, (f // 4) % 5 = 0 AS is_validation FROM (SELECT *, unnest(generate_series(0, duration - 1, 4)) AS f FROM p JOIN ds USING (dataset))")
def src28(spark, sf):
    p = trajectories(spark, sf).select("dataset", "position").distinct().join(setting(spark, DATASETS), "dataset")
    return cat.work_list(p, F.col("duration"), 4, 5).select("dataset", "position", "frame_number", "is_validation")


@query("src29_prediction_rows", f"{W} SELECT crop_index, frame_number, k * 4 AS start_x, k * 4 + 64 AS end_x, CAST(regexp_extract('/z/' || dataset || '_P' || position || '.zarr', 'P([0-9]+)', 1) AS INTEGER) AS position FROM t")
def src29(spark, sf):
    from driftloom.functions.text import position_of

    path = F.concat(F.lit("/z/"), F.col("dataset"), F.lit("_P"), F.col("position").cast("string"), F.lit(".zarr"))
    start = F.col("k") * 4
    return trajectories(spark, sf).select("crop_index", "frame_number", start.alias("start_x"), (start + 64).alias("end_x"), position_of(path).alias("position"))


@query(
    "src30_explorer_rows",
    f"{W} SELECT crop_index + 1 AS label, frame_number, k * 4 + 32.0 AS centroid_x, CAST(EXISTS (SELECT 1 FROM a WHERE a.dataset = t.dataset AND a.position = t.position AND annotation = 'cell_piling' AND frame_number BETWEEN start_frame AND stop_frame) AS INTEGER) AS cell_piling FROM t",
)
def src30(spark, sf):
    from driftloom.operators.filters import flag_columns

    rows = flag_columns(trajectories(spark, sf), setting(spark, ANNOTATIONS), ["cell_piling"])
    start = F.col("k") * 4
    return rows.select((F.col("crop_index") + 1).alias("label"), "frame_number", ((start + start + 64) / F.lit(2.0)).alias("centroid_x"), "cell_piling")
