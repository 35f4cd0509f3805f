"""Near duplicates among embeddings by cross-polytope hashing.

Each table rotates the unit vectors by fast Hadamard transforms with random signs and hashes a vector to the
axis (with sign) nearest to it, twice, so that a table has (2d)^2 buckets. A vector enters its own bucket and the next
nearest ones (multiprobe). Pairs that share a bucket are verified by their cosine; each bucket reports only per-vector
link counts and a spanning forest of its links, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.components import components
from driftloom.llm.shared import stored

SEED = 20240101
#: Buckets of up to so many classes are compared together.
SMALL = 64


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        x = x.reshape(len(x), -1, 2, half)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def bucket_keys(unit: np.ndarray, tables: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Bucket keys of unit vectors, shape (rows, tables, probes); the first probe is a vector's own bucket."""
    rows, dim = unit.shape
    size = 1 << max(1, (dim - 1).bit_length())
    padded = np.zeros((rows, size))
    padded[:, :dim] = unit
    rng = np.random.default_rng([seed, size])
    probes = min(probes, size)
    first, second = (x.ravel() for x in np.meshgrid(np.arange(probes), np.arange(probes), indexing="ij"))
    keys = np.empty((rows, tables, probes), dtype=np.int64)
    for t in range(tables):
        axes, heights = [], []
        for _ in range(2):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice((-1.0, 1.0), size))
            # Rounding makes the choice of axis the same however rows are batched.
            height = np.round(np.abs(y), 9)
            top = np.argsort(-height, axis=1, kind="stable")[:, :probes]
            axes.append(2 * top + (np.take_along_axis(y, top, 1) > 0))
            heights.append(np.take_along_axis(height, top, 1))
        loss = (heights[0][:, :1] - heights[0][:, first]) ** 2 + (heights[1][:, :1] - heights[1][:, second]) ** 2
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        both = axes[0][:, first] * (2 * size) + axes[1][:, second]
        keys[:, t] = np.take_along_axis(both, best, 1)
    return keys


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one length as unit rows in double precision; scaling first keeps the norm finite."""
    x = np.stack(list(vectors)).astype(np.float64)
    x /= np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows, the smallest row that the links ``(i, j)`` reach."""
    label = np.arange(n)
    while True:
        low = label.copy()
        np.minimum.at(low, i, label[j])
        np.minimum.at(low, j, label[i])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify(threshold: float, probes: int):
    def first_shared(table, key, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each pair's bucket is the first that it shares, so that sums over buckets count it once."""
        first = np.ones(len(left), dtype=bool)
        for t in range(left.shape[1]):
            for p in range(probes):
                for q in range(probes):
                    earlier = (t < table) | ((t == table) & (left[:, t, p] < key))
                    first &= ~((left[:, t, p] == right[:, t, q]) & earlier)
        return first

    def few(unit, bucket, split, part, table, key, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Linked pairs of many small buckets at once, and which of them count here: rows of a bucket stand together."""
        ends = []
        for off in range(1, len(bucket)):
            at = np.flatnonzero(bucket[off:] == bucket[:-off])
            if not len(at):
                break
            at = at[np.einsum("ij,ij->i", unit[at], unit[at + off]) >= threshold]
            ends.append((at, at + off))
        i, j = (np.concatenate(x) for x in zip(*ends, strict=True)) if ends else (np.empty(0, dtype=np.int64),) * 2
        across = ~split[i] | (part[i] != part[j])
        i, j = i[across], j[across]
        return i, j, first_shared(table[i], key[i], keys[i], keys[j])

    def one(table: int, key: int, split: bool, unit, keys, part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same of one bucket block, or of two blocks of one bucket."""
        near = np.triu(unit @ unit.T >= threshold, 1)
        if split:
            near &= part[:, None] != part[None, :]
        i, j = np.nonzero(near)
        return i, j, first_shared(np.full(len(i), table), np.full(len(i), key), keys[i], keys[j])

    def many(pdf: pd.DataFrame) -> pd.DataFrame:
        """All blocks that were dealt to one group: small ones together, the others one after the other."""
        names = ["label", "dim", "table", "key", "low", "high"]
        pdf = pdf.sort_values([*names, "node"], kind="stable", ignore_index=True)
        bucket = np.cumsum((pdf[names] != pdf[names].shift()).any(axis=1).to_numpy()) - 1
        size = np.bincount(bucket)[bucket]
        node, part, copies = (pdf[c].to_numpy() for c in ("node", "part", "copies"))
        table, key, dim, split = pdf["table"].to_numpy(), pdf["key"].to_numpy(), pdf["dim"].to_numpy(), (pdf["low"] != pdf["high"]).to_numpy()
        keys = np.stack(pdf["keys"].to_numpy()).reshape(len(pdf), -1, probes)
        vectors, ends = pdf["vec"].to_numpy(), []
        for d in np.unique(dim[size <= SMALL]):
            at = np.flatnonzero((dim == d) & (size <= SMALL))
            i, j, first = few(unit_rows(vectors[at]), bucket[at], split[at], part[at], table[at], key[at], keys[at])
            ends.append((at[i], at[j], first))
        large = np.flatnonzero(size > SMALL)
        for at in np.split(large, np.flatnonzero(np.diff(bucket[large])) + 1) if len(large) else []:
            i, j, first = one(table[at[0]], key[at[0]], split[at[0]], unit_rows(vectors[at]), keys[at], part[at])
            ends.append((at[i], at[j], first))
        i, j, first = (np.concatenate(x) for x in zip(*ends, strict=True))
        links = np.bincount(i[first], weights=copies[j[first]], minlength=len(pdf)) + np.bincount(j[first], weights=copies[i[first]], minlength=len(pdf))
        root = reached(len(pdf), i, j)
        use = np.flatnonzero((links > 0) | (root != np.arange(len(pdf))))
        return pd.DataFrame({"node": node[use], "links": links[use].astype(np.int64), "root": node[root[use]]})

    return many


def near_duplicate_embeddings(
    df: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    label_col: str = "label",
    threshold: float = 0.98,
    tables: int = 5,
    probes: int = 3,
    block_rows: int = 1024,
) -> DataFrame:
    """One row per input row: id, n_links (other rows linked directly), component_id, kept.

    Rows link when labels are equal and not null and the cosine is at least ``threshold``. A pair at exactly 0.98 is
    missed with a chance of about 1e-5 (5 tables, 3 probes, 64 components). Rows with a null id, a null label or a vector
    that is null, empty, zero or has null or non-finite components link with nothing; vectors of unequal length do not link.
    A null id gets a null component and is kept. Rows that repeat an id count as rows of their own. Other columns are
    left out. Equal vectors of a label are one class with its count, so copies never meet as pairs; buckets above
    ``block_rows`` classes are split into blocks and compared block by block, each in a task of its own.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    good = F.coalesce(
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vec", lambda x: x != 0),
        F.lit(False),
    )
    classes = base.where(good).groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    classes = classes.withColumn("node", F.monotonically_increasing_id())

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys = np.empty(len(pdf), dtype=object)
            dims = pdf["vec"].map(len).to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                unit = unit_rows(pdf["vec"].to_numpy()[at])
                for k, row in zip(at, bucket_keys(unit, tables, probes).reshape(len(at), -1), strict=True):
                    keys[k] = row
            yield pdf.assign(keys=keys)

    schema = T.StructType([*classes.schema.fields, T.StructField("keys", T.ArrayType(T.LongType()))])
    # Written once: the numbers given to the classes are fixed from here on.
    index = stored(classes.mapInPandas(hashed, schema), "vectors")
    entries = index.select("node", "label", F.size("vec").alias("dim"), F.posexplode("keys").alias("at", "key"))
    entries = entries.withColumn("table", F.floor(F.col("at") / F.lit(probes)).cast("int")).drop("at")
    bucket = ["label", "dim", "table", "key"]
    sizes = entries.groupBy(*bucket).agg(F.count("*").alias("n")).where("n > 1")
    sizes = stored(sizes.withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int")), "buckets")
    placed = entries.join(sizes.drop("n"), bucket).withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    placed = placed.withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")
    members = placed.join(index.select("node", "vec", "copies", "keys"), "node")
    # Small buckets share a group; a group holds about four blocks, however many rows there are.
    total = sizes.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    dealt = F.pmod(F.xxhash64(*bucket, "low", "high"), F.lit(max(1, total // (4 * block_rows))))
    found = members.groupBy(dealt.alias("dealt")).applyInPandas(_verify(threshold, probes), "node long, links long, root long")
    found = stored(found, "found")
    joined = stored(components(found, "node", "root"), "joined")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = (
        index.select("label", "vec", "node", "rep", "copies")
        .join(links, "node", "left")
        .join(joined, "node", "left")
        .withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        .select("label", "vec", "rep", "n_links", F.coalesce("component", "node").alias("component"))
    )
    per_class = stored(per_class, "classes")
    least = per_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = stored(per_class.join(stored(least, "least"), "component").drop("component", "rep"), "named")
    linked = base.where(good).join(named, ["label", "vec"]).select("id", "n_links", "component_id")
    rest = base.where(~good).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    )


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
