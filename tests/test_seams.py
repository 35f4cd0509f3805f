"""Queries against their SQL over events that lie on the seams, ties and bounds which larger tables hold."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from driftloom import registry

SF = "/root/testdata/sf0.001"
FIRST = 1_704_067_200_000_000


def tables(folder, events):
    """The smallest tables with events of (user, frame, value, k)."""
    for t in os.listdir(SF):
        if t != "events.parquet":
            os.symlink(f"{SF}/{t}", folder / t)
    user, frame, value, k = zip(*events, strict=True)
    n = len(events)
    made = {
        "event_id": pa.array(range(n), pa.int64()), "ts": pa.array([FIRST + f * 43_200_000_000 + i for i, f in enumerate(frame)], pa.timestamp("us")), "user_id": pa.array(user, pa.int64()),
        "event_type": pa.array(["view"] * n), "value": pa.array(value, pa.float64()), "props": pa.array([f'{{"k": {x}}}' for x in k]),
    }
    pq.write_table(pa.table(made), folder / "events.parquet")
    return str(folder)


def plain(rows):
    return sorted((tuple(float(f"{v:.9g}") + 0.0 if isinstance(v, float) else v for v in r) for r in rows), key=str)


def compare(spark, sf, name):
    duck = duckdb.connect()
    for t in os.listdir(sf):
        duck.sql(f"create view {t.removesuffix('.parquet')} as select * from '{sf}/{t}'")
    want = duck.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf).select(*want.columns)
    assert plain(got.collect()) == plain(want.fetchall())


#: Values a half turn from k * 3.6 degrees.
SEAM = [(187.2, 2), (0.0, 50), (3.6, 51), (7.2, 52), (10.8, 53), (14.4, 54), (43.2, 62), (97.2, 77), (104.4, 79), (111.6, 81), (122.4, 84), (147.6, 91), (154.8, 93), (169.2, 97), (176.4, 99)]


def test_differences_on_the_seam(spark, tmp_path):
    compare(spark, tables(tmp_path, [(i, 0, v, k) for i, (v, k) in enumerate(SEAM)]), "mth05_smallest_difference")


def test_best_pairs_among_many_equals(spark, tmp_path):
    sf = tables(tmp_path, [(12 * i + 2 * (i % 3), i % 2, 1.0, i * i % 7) for i in range(300)])
    compare(spark, sf, "udf02_own_metric")
    plan = registry.queries()["udf02_own_metric"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    # Pairs are made of the smallest of equals: both sides of their join are aggregated by value first.
    assert "min(crop_index" in plan.split("Join Inner", 1)[1]


def test_outliers_on_a_decimal_bound(spark, tmp_path):
    values = [5.0, 5.0, 1.0, 5.0, 3.0, 5.0, 9.0, 5.0]
    compare(spark, tables(tmp_path, [(7, i, v, 1) for i, v in enumerate(values)]), "win13_outlier_classes")


def test_ties_of_the_extremes_go_to_the_smallest_index(spark, tmp_path):
    sf = tables(tmp_path, [(u, 0, v, 1) for u, v in ((8, 1.0), (4, 1.0), (12, 1.0), (20, 6.0), (16, 6.0), (24, 6.0))])
    (row,) = registry.queries()["srt06_argmin"](spark, sf).collect()
    assert (row.low, row.high) == (4, 16)


def test_extremes_leave_out_rows_without_a_value(spark, tmp_path):
    # Frame 1 has no value in any row.
    compare(spark, tables(tmp_path, [(4, 0, None, 1), (8, 0, 2.0, 1), (12, 0, 5.0, 1), (16, 0, float("nan"), 1), (20, 1, None, 1), (5, 0, None, 1), (9, 0, 1.0, 1)]), "srt06_argmin")


def crowd(tmp_path):
    """Cells whose nuclei lie half a crop apart, in two frames."""
    return tables(tmp_path, [(12 * i, f, round(0.03 + 0.37 * (i // 3) + 20 * ((i + f) % 3), 2), 2 * (i % 4) + 1) for f in range(2) for i in range(90)])


@pytest.mark.parametrize("name", ["stat35_frame_features", "stat37_merge_pipeline"])
def test_nuclei_on_the_bounds_of_crops(spark, tmp_path, name):
    compare(spark, crowd(tmp_path), name)


def test_track_features_of_nuclei_on_bounds(spark, tmp_path):
    compare(spark, crowd(tmp_path), "stat36_track_features")


def test_ties_of_decimals_round_as_scaled_doubles(spark):
    from driftloom.plans.bundles import shown

    row = spark.sql("select 'a' dataset, 0 position, 0 crop_index, 0 frame_number, 2.00000025D x")
    assert shown(row, [], ["x"], 7).first().x == duckdb.sql("select round(2.00000025::DOUBLE, 7)").fetchall()[0][0] == 2.0000002
