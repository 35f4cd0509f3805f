"""Centroid clustering of integer vectors with a PCA-rotated filter.

Vectors are turned into integers and indexed once: the leading coordinates after a rotation to principal axes, and the norm
of what is left. The squared distance of the leading coordinates plus the squared difference of the two residual norms is
never above the true squared distance, so a centroid whose bound exceeds the best exact distance so far is skipped; the
others are verified in integers. Each round reads the index, and tasks hand on sums and counts of clusters only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.shared import stored

#: Coordinates that the filter keeps after the rotation.
LEAD = 16
#: The rotation, which changes the work but never the result, is fitted on the vectors with so many smallest hashes.
FIT_ROWS = 4096
#: Integer components end here, so that a squared distance fits a long.
LIMIT = 1 << 26
#: Relative allowance for rounding in the bounds; exact distances decide.
SLACK = 1e-9


def integer_vector(vec: Column, dim: int, scale: int) -> Column:
    """floor(scale * x) of each component as long, held within ``LIMIT``; null where a vector is not usable."""
    usable = (F.size(vec) == dim) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(vec, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))))
    return F.when(usable, held)


class Rotation:
    """Principal axes of a sample and the parts of a vector that the filter keeps."""

    def __init__(self, sample: np.ndarray, lead: int):
        x = sample.astype(np.float64)
        self.mean = x.mean(axis=0)
        _, axes = np.linalg.eigh((x - self.mean).T @ (x - self.mean))
        self.axes = axes[:, ::-1][:, :lead]

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leading coordinates and the residual norm of each row."""
        y = x.astype(np.float64) - self.mean
        lead = y @ self.axes
        return lead, np.linalg.norm(y - lead @ self.axes.T, axis=1)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray, c_lead: np.ndarray, c_rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: smaller number), its exact squared distance, and how many distances were verified."""
    bound = ((lead[:, None, :] - c_lead) ** 2).sum(axis=2) + (rest[:, None] - c_rest) ** 2
    size = 1.0 + (lead**2).sum(axis=1) + rest**2 + ((c_lead**2).sum(axis=1) + c_rest**2).max()
    label = bound.argmin(axis=1)
    best, verified = ((x - centroids[label]) ** 2).sum(axis=1), len(x)
    guess = label.copy()
    for k in range(len(centroids)):
        at = np.flatnonzero((guess != k) & (bound[:, k] - SLACK * size <= best))
        exact = ((x[at] - centroids[k]) ** 2).sum(axis=1)
        better = (exact < best[at]) | ((exact == best[at]) & (k < label[at]))
        label[at[better]], best[at[better]] = k, exact[better]
        verified += len(at)
    return label, best, verified


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.stack(pdf["x"].to_numpy()), np.stack(pdf["lead"].to_numpy()), pdf["rest"].to_numpy()


def _sums(index: DataFrame, centroids: np.ndarray, rotation: Rotation) -> dict[int, tuple[int, dict[int, int]]]:
    """Count and exact component sums of each cluster that has vectors: at most one row a centroid and component."""
    parts = rotation.parts(centroids)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
        for pdf in batches:
            if len(pdf):
                x, lead, rest = _arrays(pdf)
                label = nearest(x, lead, rest, centroids, *parts)[0]
                np.add.at(total, label, x)
                count += np.bincount(label, minlength=len(centroids))
        use = np.flatnonzero(count)
        if len(use):
            yield pd.DataFrame({"cluster": use, "n": count[use], "total": list(total[use])})

    rows = index.mapInPandas(partial, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("at", "part"))
    rows = rows.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    out: dict[int, tuple[int, dict[int, int]]] = {}
    for r in rows.collect():
        out.setdefault(r["cluster"], (r["n"], {}))[1][r["at"]] = int(r["total"])
    return out


def cluster_embeddings(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", dim: int = 64, clusters: int = 8, rounds: int = 10, scale: int = 1024, seed: int = 3, lead: int = LEAD
) -> DataFrame:
    """One row per usable vector: id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Usable vectors have exactly ``dim`` components, none null or non-finite; the others get no row. Components become
    floor(scale * x), held within +-2^26 so that distances fit a long. The first centroids are the vectors with the smallest
    sha256 of ``seed:id``; a null id comes after all others and ties (repeated ids) go by the integer vector, then one is as
    good as the other. With fewer vectors than ``clusters`` each vector is a centroid. Every row counts, repeated or not, and
    ties go to the smaller centroid, also between equal centroids. A centroid without vectors stays. Inertia that a long
    can't hold is null. An empty table gives no rows; columns beside id and vector are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), integer_vector(F.col(vec_col), dim, scale).alias("x")).where(F.col("x").isNotNull())
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")).cast("binary"), 256)
    start = rows.select(order.alias("order"), "x").orderBy(F.col("order").asc_nulls_last(), "x").limit(clusters).collect()
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("cluster", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("distance", "cluster_inertia", "inertia")]
        + [T.StructField("centroid_sha256", T.StringType())]
    )
    spark = df.sparkSession
    if not start:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["x"] for r in start], dtype=np.int64)
    sample = rows.select("x").orderBy(F.xxhash64("x"), "x").limit(FIT_ROWS).collect()
    rotation = Rotation(np.array([r["x"] for r in sample], dtype=np.int64), min(lead, dim))

    def indexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                leading, rest = rotation.parts(np.stack(pdf["x"].to_numpy()))
                yield pdf.assign(lead=list(leading), rest=rest)

    fields = [*rows.schema.fields, T.StructField("lead", T.ArrayType(T.DoubleType())), T.StructField("rest", T.DoubleType())]
    index = stored(rows.mapInPandas(indexed, T.StructType(fields)), "rotated")
    for _ in range(rounds):
        for k, (n, total) in _sums(index, centroids, rotation).items():
            centroids[k] = [total[i] // n for i in range(dim)]
    parts = rotation.parts(centroids)

    def assigned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                label, best, _ = nearest(*_arrays(pdf), centroids, *parts)
                yield pd.DataFrame({id_col: pdf["id"], "cluster": label, "distance": best})

    found = stored(index.mapInPandas(assigned, T.StructType(schema.fields[:3])), "assigned")
    # At most one row for each centroid.
    inertia = {r["cluster"]: int(r["inertia"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    held = {k: v if v < 1 << 63 else None for k, v in [*inertia.items(), (None, sum(inertia.values()))]}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = spark.createDataFrame([(k, held[k], held[None], digests[k]) for k in inertia], T.StructType([schema["cluster"], *schema.fields[3:]]))
    return found.join(F.broadcast(names), "cluster").select(*schema.names)


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _rounds(n: int) -> str:
    """SQL of n rounds, each from centroids c<i> to c<i+1>."""
    one = """,
near{i} as materialized (
  select n, arg_min(k, (list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), k)) as k from vectors, c{i} group by n),
mean{i} as materialized (
  select k, list(floor(s / m) order by pos) as c from (
    select k, pos, sum(x[pos]) as s, count(*)::double as m from near{i} join vectors using (n), range(1, 65) r(pos) group by k, pos) group by k),
c{j} as materialized (select c{i}.k, coalesce(mean{i}.c, c{i}.c) as c from c{i} left join mean{i} using (k))"""
    return "".join(one.format(i=i, j=i + 1) for i in range(n))


OP11_SQL = f"""
with vectors as materialized (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
  select row_number() over (order by h, x) - 1 as k, x as c from (select sha256('3:' || vec_id) as h, x from vectors order by h, x limit 8)){_rounds(10)},
final as materialized (
  select n, min(struct_pack(d := list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), k := k)) as best
  from vectors, c10 group by n)
select vec_id, best.k::integer as cluster, best.d::bigint as distance, sum(best.d::bigint) over (partition by best.k)::bigint as cluster_inertia,
  sum(best.d::bigint) over ()::bigint as inertia,
  (select sha256(array_to_string(list_transform(c10.c, lambda v: v::bigint), ',')) from c10 where c10.k = best.k) as centroid_sha256
from vectors join final using (n)
"""
