"""Bootstrap draws: the properties of draws with replacement."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import resampling as rs


def drawn(spark, tracks, replicates, draws=None):
    df = spark.createDataFrame([(k, i) for k, n in tracks.items() for i in range(n)], "k string, crop long")
    m = None if draws is None else spark.createDataFrame(list(draws.items()), "k string, __draws long")
    rows = rs.multiplicity_arrays(df, ["k"], "crop", replicates, draws=m).orderBy("k", "crop").collect()
    return {k: np.array([r.times for r in rows if r.k == k]) for k in tracks}


def test_each_replicate_draws_as_often_as_asked(spark):
    found = drawn(spark, {"a": 1, "b": 7, "c": 130}, 40)
    assert all((t.sum(axis=0) == len(t)).all() for t in found.values())
    found = drawn(spark, {"a": 1, "b": 7, "c": 130}, 40, {"a": 9, "b": 0, "c": 2000})
    assert {k: set(t.sum(axis=0)) for k, t in found.items()} == {"a": {9}, "b": {0}, "c": {2000}}


def test_replicates_with_too_many_counts_are_drawn_anew(spark, monkeypatch):
    monkeypatch.setattr(rs, "SPREAD", 0)  # half of all totals are too large then
    (times,) = drawn(spark, {"a": 60}, 200).values()
    assert (times.sum(axis=0) == 60).all()
    assert times.mean(axis=0).std() == 0 and times.var() == pytest.approx(1 - 1 / 60, rel=0.05)


@pytest.mark.parametrize(("n", "replicates"), [(38, 500), (94, 500), (375, 500), (100_000, 300), (2_000_000, 20)])
def test_spread_of_bootstrap_means(spark, n, replicates):
    """The standard deviation of means over replicates is that of the values over sqrt(n)."""
    # A few values stand for all trajectories: the mean over replicates depends on sums by value only.
    df = spark.range(n).select(F.lit("d").alias("k"), F.col("id").alias("crop"))
    per = df.withColumn("x", (F.pmod(F.xxhash64("crop"), F.lit(1000)) / 1000.0)).withColumn("one", F.lit(1.0))
    sums = rs.resampled_sums(per, rs.multiplicity_arrays(df, ["k"], "crop", replicates), ["k"], "crop", [], ["x", "one"])
    rows = sums.collect()
    assert {r.one for r in rows} == {float(n)} and len(rows) == replicates
    means = np.array([r.x / r.one for r in rows])
    x = per.agg(F.avg("x"), F.stddev_pop("x")).first()
    tolerance = 0.1 if replicates >= 300 else 3 / np.sqrt(2 * replicates)
    assert means.std(ddof=1) == pytest.approx(x[1] / np.sqrt(n), rel=tolerance)
    assert abs(means.mean() - x[0]) < 4 * x[1] / np.sqrt(n * replicates)


def test_counts_are_multinomial_and_replicates_independent(spark):
    (times,) = drawn(spark, {"a": 400}, 500).values()
    # Chances of 0, 1, 2, 3 draws under Binomial(400, 1/400), over 200,000 counts.
    share = np.bincount(times.ravel(), minlength=5)[:4] / times.size
    want = [(399 / 400) ** 400, 400 * (1 / 400) * (399 / 400) ** 399, 0.18417, 0.06132]
    assert np.allclose(share, want, atol=0.004)
    within = np.corrcoef(times.T)[np.triu_indices(500, 1)]
    assert abs(within.mean()) < 0.001 and within.std() == pytest.approx(1 / np.sqrt(400), rel=0.05)
    tracks = np.corrcoef(times)[np.triu_indices(400, 1)]
    assert tracks.mean() == pytest.approx(-1 / 399, abs=0.0005) and np.abs(within).max() < 0.3


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).select(F.lit("d").alias("k"), F.col("id").alias("crop"))
    one = rs.multiplicities(df.coalesce(1), ["k"], "crop", 8)
    many = rs.multiplicities(df.repartition(7), ["k"], "crop", 8)
    assert one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()
