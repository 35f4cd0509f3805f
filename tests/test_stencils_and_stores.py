"""Kernels that are no product, and tables in a store behind the s3a scheme."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from driftloom.functions.hooks import KERNELS
from driftloom.operators.grid import Axis, smoothed, stencil, stencil_at
from driftloom.sources import files

AXES = [Axis("a", 0.0, 0.5, 7, 3.5), Axis("b", 0.0, 1.0, 6)]


def table(spark):
    rng = random.Random(2)
    rows = [(k, i, j, rng.uniform(-1, 1)) for k in "xy" for i, j in itertools.product(range(7), range(6)) if rng.random() < 0.4]
    return spark.createDataFrame(rows, "k string, i0 int, i1 int, v double"), rows


def cone(a, b):
    return F.greatest(F.lit(0.0), 1 - F.sqrt(a * a + b * b) / 1.7)


def test_a_radial_kernel_equals_all_pairs(spark):
    df, rows = table(spark)
    want = {}
    for k, i, j, v in rows:
        for p, q in itertools.product(range(7), range(6)):
            away = min(abs(p - i), 7 - abs(p - i)) * 0.5
            w = max(0.0, 1 - math.hypot(away, q - j) / 1.7)
            if w:
                want[k, p, q] = want.get((k, p, q), 0.0) + v * w
    found = {(r.k, r.i0, r.i1): r.v for r in stencil(df, AXES, cone, [3, 1], ["v"], ["k"]).collect()}
    assert set(found) == set(want) and all(found[c] == pytest.approx(want[c]) for c in want)
    # More reach than a circle has cells changes nothing.
    wide = {(r.k, r.i0, r.i1): r.v for r in stencil(df, AXES, cone, [9, 5], ["v"], ["k"]).collect()}
    assert set(wide) == set(want) and all(wide[c] == pytest.approx(want[c]) for c in want)
    for cell in ([0, 0], [6, 5], [3, 2]):
        one = {r.k: r.v for r in stencil_at(df, AXES, cone, cell, ["v"], ["k"]).collect()}
        assert one == {k: pytest.approx(v) for (k, *c), v in want.items() if c == cell}


def test_a_product_kernel_equals_the_axis_wise_form(spark):
    df, _ = table(spark)
    gaussian = KERNELS["gaussian"]
    axes = [Axis("a", 0.0, 0.5, 7), Axis("b", 0.0, 1.0, 6)]
    both = stencil(df, axes, lambda a, b: gaussian(a, 0.6, None) * gaussian(b, 0.9, None), [6, 5], ["v"], ["k"])
    found = {(r.k, r.i0, r.i1): r.v for r in both.collect()}
    want = {(r.k, r.i0, r.i1): r.v for r in smoothed(df, axes, [("gaussian", 0.6), ("gaussian", 0.9)], ["v"], ["k"]).collect()}
    assert set(found) == set(want) and all(found[c] == pytest.approx(want[c], abs=1e-12) for c in want)


@pytest.mark.parametrize("suffix", [".parquet", ".csv", ".tsv"])
def test_tables_behind_the_s3a_scheme(spark, tmp_path, suffix):
    """The scheme is bound to a local folder by a mount table, so that the reader's own path and options are used."""
    bucket = f"public{suffix[1:]}"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    files.write_table(rows, f"{tmp_path}/t{suffix}")
    settings = {"fs.s3a.impl": "org.apache.hadoop.fs.viewfs.ViewFileSystemOverloadScheme", f"fs.viewfs.mounttable.{bucket}.link./data": f"file://{tmp_path}"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        path = f"s3a://{bucket}/data/t{suffix}"
        found = files.read_table(spark, path, rows.schema)
        assert sorted(map(tuple, found.collect())) == [(1, "a"), (2, "b")]
        assert sorted(map(tuple, files.read_table(spark, path, rows.schema, columns=["name"]).collect())) == [("a",), ("b",)]
        assert files.read_first(spark, [f"s3a://{bucket}/data/none{suffix}", path], schema=rows.schema).count() == 2
    finally:
        for key in settings:
            spark.conf.unset(key)
    key = f"fs.s3a.bucket.{bucket}.aws.credentials.provider"
    assert files.anonymous(path) == {key: "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"} and files.anonymous("/tmp/t.csv") == {}
    assert spark.conf.get(key, None) is None
