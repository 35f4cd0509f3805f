"""Centroid clustering against plain integer arithmetic."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import types as T

from driftloom.llm.centroids import Rotation, cluster_embeddings, nearest

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("cluster", T.StringType())])


def plain(rows, dim=64, clusters=8, rounds=10):
    kept = [(i, [int(np.floor(1024 * v)) for v in x]) for i, x, *_ in rows if x is not None and len(x) == dim and all(v is not None and np.isfinite(v) for v in x)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [x for _, x in sorted(kept, key=key)[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids)) for _, x in kept]

    for _ in range(rounds):
        near = assign()
        for k in range(len(centroids)):
            mine = [x for (_, x), (_, j) in zip(kept, near, strict=True) if j == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    near = assign()
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    whole = sum(d for d, _ in near)
    return sorted(((i, k, d, sum(e for e, j in near if j == k), whole, digest[k]) for (i, _), (d, k) in zip(kept, near, strict=True)), key=str)


def got(spark, rows, **more):
    return sorted(map(tuple, cluster_embeddings(spark.createDataFrame(rows, VECTORS), **more).collect()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(6, 64)) * 0.2
    out = [(k, (middles[k % 6] + rng.normal(size=64) * rng.choice([0.01, 0.3])).tolist(), "clash") for k in range(150)]
    bad = out[0][1]
    out += [(400, None, ""), (401, [], ""), (402, bad[:63], ""), (403, [None, *bad[1:]], ""), (404, [float("nan"), *bad[1:]], ""), (405, [float("-inf"), *bad[1:]], "")]
    out += [(None, bad, ""), (7, bad, ""), (7, bad, ""), (500, [60000.0] * 64, ""), (501, [-0.0] * 64, ""), *[(600 + k, bad, "") for k in range(90)]]
    return out


def test_clusters_equal_plain_integers(spark, rows):
    assert got(spark, rows) == plain(rows)


def test_ties_few_vectors_and_empty_tables(spark):
    ones = [(k, [1.0] * 64, "") for k in range(3)]
    found = got(spark, ones)
    assert found == plain(ones) and {r[1] for r in found} == {0}
    lattice = [(k, [float(k % 3), float(k % 2), 0.0], "") for k in range(40)]
    assert got(spark, lattice, dim=3, rounds=4) == plain(lattice, dim=3, rounds=4)
    assert got(spark, []) == [] and got(spark, [(1, None, "")]) == []


def test_huge_components_are_held(spark):
    found = got(spark, [(1, [1e300] * 64, ""), (2, [-1e300] * 64, ""), (3, [0.0] * 64, "")])
    assert {r[2] for r in found} == {0} and len(found) == 3


def test_filter_skips_and_stays_exact():
    rng = np.random.default_rng(0)
    spread = np.geomspace(300, 1, 64)
    x = (rng.normal(size=(4000, 64)) * spread).astype(np.int64)
    centroids = x[:8].copy()
    rotation = Rotation(x, 16)
    label, best, verified = nearest(x, *rotation.parts(x), centroids, *rotation.parts(centroids))
    exact = ((x[:, None, :] - centroids) ** 2).sum(axis=2)
    assert (label == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()
    assert verified < 2 * len(x)
