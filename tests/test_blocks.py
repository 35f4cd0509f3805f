"""Windows over blocks against plain Python, with keys that go over many blocks and partitions."""

import random
import statistics

import pytest

from driftloom.operators import windows as win
from driftloom.operators.blocks import placed
from driftloom.operators.outliers import outlier_classes


def table(spark, lengths, nulls=0.0, seed=1):
    rng = random.Random(seed)
    rows = [(k, i, None if rng.random() < nulls else rng.gauss(0, 1), f"other {i}") for k, n in lengths.items() for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, i int, x double, other string").repartition(6), rows


def by_key(rows):
    out = {}
    for k, i, x, *_ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(k, []).append(x)
    return out


LENGTHS = {"long": 700, "a": 1, "b": 11, "c": 12, "d": 13, "e": 48, "f": 49, None: 30}


def median(values, i, size):
    half, n = size // 2, len(values)
    i = i if n < size else min(max(i, half), n - half)
    window = [v for v in (values if n < size else values[i - half : i + half]) if v is not None]
    return statistics.median(window) if window else None


@pytest.mark.parametrize(("size", "block", "nulls"), [(12, 4096, 0.0), (12, 16, 0.2), (100, 100, 0.0)])
def test_rolling_medians(spark, size, block, nulls):
    df, rows = table(spark, LENGTHS, nulls)
    found = win.rolling_median(df, "x", size, ["k"], ["i"], block=block, place="at").collect()
    values = by_key(rows)
    assert sorted((str(r.k), r.i, r.other) for r in found) == sorted((str(k), i, o) for k, i, _, o in rows)
    for r in found:
        assert r.at == r.i and r.rolling_median == (None if (m := median(values[r.k], r.i, size)) is None else pytest.approx(m)), r


@pytest.mark.parametrize("block", [4096, 9, 50])
def test_gaussian_smoothing(spark, block):
    df, rows = table(spark, LENGTHS)
    weights, values = win.gaussian_weights(2.0), by_key(rows)
    for r in win.gaussian_smoothed(df, "x", 2.0, ["k"], ["i"], block=block).collect():
        v = values[r.k]
        n, total = len(v), 0.0
        for k, w in enumerate(weights):
            at = (r.i + k - 8) % (2 * n)
            total += w * v[min(at, 2 * n - 1 - at)]
        assert r.smoothed == pytest.approx(total), r


def test_one_key_lies_in_many_partitions(spark):
    df, _ = table(spark, {"only": 3000})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = win.rolling_median(df, "x", 12, ["k"], ["i"], block=200)
        from pyspark.sql import functions as F

        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3000 and len(sizes) > 2 and max(sizes) < 2400
        assert sorted(r[0] for r in placed(df, ["k"], ["i"]).select("__place").collect()) == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_tables_and_outlier_places(spark):
    empty, _ = table(spark, {})
    assert win.rolling_median(empty, "x", 12, ["k"], ["i"]).count() == 0 and win.gaussian_smoothed(empty, "x", 2.0, ["k"], ["i"]).count() == 0
    df = spark.createDataFrame([("a", i, 100.0 if i != 9 else 50.0, "") for i in range(30)], "k string, i int, x double, other string")
    (row,) = outlier_classes(df, "x", 12, ["k"], ["i"], slices=4).collect()
    assert (row.i, row.frame_number, row.kind, row.annotation) == (9, 2, "dark", "temporary_artifact")
