"""Bootstrap draws of trajectories with replacement.

How often a trajectory is drawn in each replicate is made in its own row, as an array, from a counter-based generator, so nothing is
shuffled by draw:

- A digest of (seed, key, trajectory, counter) gives uniform 32-bit numbers, and those Poisson counts at a rate a little below
  draws / trajectories. Independent Poisson counts whose total is given are multinomial.
- The total of a replicate falls short of the wanted draws by about 5 of its standard deviations. The missing draws are single
  uniform picks, also from digests: about 5 * sqrt(draws) a replicate. In the rare replicate whose total is too large the counts are set
  aside and all draws are single picks. Either way the counts are exactly those of draws with replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.operators.joins import FEW, with_few
from driftloom.operators.windows import with_dense_index
from driftloom.sources.scratch import settled

SEED = 17
#: Counts above the 32nd term have a chance below 2^-32 at this rate.
HIGHEST_RATE, TERMS = 4.0, 32
SPREAD = 5
#: Groups whose sums a task holds before it hands them on.
HELD = 1_000


def poisson_limits(tracks: int, draws: int) -> np.ndarray:
    """Limits of the 32-bit numbers: a number gives as many draws as there are limits at or below it."""
    rate = min(HIGHEST_RATE, max(0.0, (draws - SPREAD * math.sqrt(draws)) / tracks))
    terms = np.array([rate**k / float(math.factorial(k)) for k in range(TERMS)])
    return np.minimum(2**32 - 1, np.floor(2**32 * (math.exp(-rate) * np.cumsum(terms)))).astype(np.int64)


def uniform_numbers(name: str, n: int) -> np.ndarray:
    """n 32-bit numbers of a name, four a digest."""
    digests = b"".join(md5(f"{name}:{g}".encode()).digest() for g in range(-(-n // 4)))
    return np.frombuffer(digests, dtype=">u4")[:n].astype(np.int64)


def _poisson(replicates: int):
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        limits: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            out = []
            for name, tracks, draws in zip(pdf["__name"], pdf["__n"], pdf["__draws"], strict=True):
                if (tracks, draws) not in limits:
                    limits[tracks, draws] = poisson_limits(tracks, draws)
                out.append(np.searchsorted(limits[tracks, draws], uniform_numbers(name, replicates), side="right").astype(np.int8))
            yield pdf.drop(columns="__name").assign(__base=out)

    return counted


def _partial_sums(by: list[str], values: list[str]):
    """Sums of the given values times multiplicity as arrays over replicates, by the groups of a task; rows that are not drawn count nothing."""

    def handed_on(held: dict[tuple, np.ndarray], types: list[pa.DataType]) -> pa.RecordBatch:
        names = [pa.array([name[i] for name in held], t) for i, t in enumerate(types)]
        sums = [pa.array([s[i] for s in held.values()], pa.list_(pa.float64())) for i in range(len(values))]
        return pa.RecordBatch.from_arrays(names + sums, [*by, *values])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        types: list[pa.DataType] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [batch.schema.field(c).type for c in by]
            times = batch["times"].flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            x = np.column_stack([batch[v].to_numpy() for v in values])
            groups: dict[tuple, list[int]] = {}
            for i, name in enumerate(zip(*(batch[c].to_pylist() for c in by), strict=True)):
                groups.setdefault(name, []).append(i)
            for name, at in groups.items():
                t, v = times[at], x[at]
                sums = np.where(np.isfinite(v), v, 0.0).T @ t
                for i, k in np.argwhere(~np.isfinite(v)):
                    sums[k] += np.multiply(v[i, k], t[i], out=np.zeros_like(t[i]), where=t[i] > 0)
                held[name] = held[name] + sums if name in held else sums
            if len(held) > HELD:
                yield handed_on(held, types)
                held = {}
        if held:
            yield handed_on(held, types)

    return summed


def _sums_by_replicate(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, replicate, values) from rows with ``times``: replicates are unfolded behind the sums of a task, which are few."""
    fields = [rows.schema[c] for c in by] + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in values]
    sums = rows.select(*by, *values, "times").mapInArrow(_partial_sums(by, values), T.StructType(fields))
    sums = sums.select(*by, F.posexplode(F.arrays_zip(*values)).alias("replicate", "__z"))
    return sums.groupBy(*by, "replicate").agg(*(F.sum(F.col("__z")[v]).alias(v) for v in values))


def multiplicity_arrays(df: DataFrame, keys: list[str], track: str, replicates: int, seed: int = SEED, draws: DataFrame | None = None) -> DataFrame:
    """(keys, track, times): an array with the number of draws of the trajectory in each replicate.

    A key draws as often as it has trajectories, or as often as ``draws`` (keys, __draws) says. Results depend on keys,
    trajectories, numbers of both and seed alone, not on partitions. Keys and trajectories must not be null.
    """
    tracks = settled(with_dense_index(df.select(*keys, track).distinct(), [*keys, track], "__i"))
    each = tracks.groupBy(*keys).agg(F.min("__i").alias("__least"), F.count("*").alias("__n"))
    each = each.withColumn("__draws", F.col("__n")) if draws is None else each.join(draws.select(*keys, F.col("__draws").cast("long").alias("__draws")), keys)
    named = F.concat_ws(":", F.lit(seed), *keys, track)
    tracks = with_few(tracks, each, keys).withColumn("__j", F.col("__i") - F.col("__least")).drop("__i", "__least").withColumn("__name", named)
    fields = [f for f in tracks.schema.fields if f.name != "__name"]
    # Rows are small and their draws are not, so they go to a stated number of tasks, which is not coalesced.
    parts = _parts(df)
    tracks = tracks.repartition(parts, *keys, track)
    base = settled(tracks.mapInPandas(_poisson(replicates), T.StructType([*fields, T.StructField("__base", T.ArrayType(T.ByteType()))])))

    key = [*keys, "__n", "__draws"]
    totals = _sums_by_replicate(base.select(*key, F.lit(1.0).alias("__one"), F.col("__base").alias("times")), key, ["__one"])
    totals = totals.withColumn("total", F.col("__one").cast("long"))
    fits = F.col("total") <= F.col("__draws")
    totals = settled(totals.select(*key, "replicate", fits.alias("fits"), F.when(fits, F.col("__draws") - F.col("total")).otherwise(F.col("__draws")).alias("missing")))
    picks = totals.where("missing > 0").repartition(parts, *keys, "replicate").select(*key, "replicate", F.explode(F.sequence(F.lit(0).cast("long"), F.col("missing") - 1)).alias("d"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.lit("pick"), *keys, "replicate", "d").cast("binary"))
    at = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.col("__n")
    picked = picks.groupBy(*keys, at.alias("__j"), "replicate").agg(F.count("*").cast("int").alias("v"))
    # At most an entry a replicate in each of these.
    picked = picked.groupBy(*keys, "__j").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "v"))).alias("__picked"))
    good = totals.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("replicate", "fits"))).alias("__fits"))
    rows = with_few(base, good, keys, most=FEW // replicates).join(picked, [*keys, "__j"], "left")
    drawn = F.transform("__base", lambda v, b: F.when(F.col("__fits")[b]["fits"], v.cast("int")).otherwise(0) + F.coalesce(F.col("__picked")[b], F.lit(0)))
    return rows.select(*keys, track, drawn.alias("times"))


def multiplicities(df: DataFrame, keys: list[str], track: str, replicates: int, seed: int = SEED, draws: DataFrame | None = None) -> DataFrame:
    """The same as a row for each replicate and trajectory that is drawn in it: (keys, replicate, track, times)."""
    rows = multiplicity_arrays(df, keys, track, replicates, seed, draws)
    rows = rows.select(*keys, F.posexplode("times").alias("replicate", "times"), track).where("times > 0")
    return rows.select(*keys, "replicate", track, F.col("times").cast("long").alias("times"))


def resampled_sums(per_track: DataFrame, drawn: DataFrame, keys: list[str], track: str, cells: list[str], values: list[str]) -> DataFrame:
    """(keys, replicate, cells, values): sums of per-trajectory values times multiplicity, as doubles or, of whole numbers, as longs.

    One join by trajectory; a task adds up arrays over replicates, so trajectories are never unfolded by replicate. As in SQL, null
    values count nothing, and cells of which nothing is drawn have no row.
    """
    # A stated number of partitions is not coalesced: rows are small here, and large once they have their draws.
    rows = per_track.join(drawn.repartition(_parts(drawn), *keys, track), [*keys, track])
    number = {v: F.coalesce(F.col(v).cast("double"), F.lit(0.0)) for v in values}
    known = {"__known_" + v: F.col(v).isNotNull().cast("double") for v in values}
    rows = rows.select(*keys, *cells, "times", *(c.alias(v) for v, c in (number | known).items()), F.lit(1.0).alias("__drawn"))
    sums = _sums_by_replicate(rows, [*keys, *cells], [*number, *known, "__drawn"]).where("__drawn > 0")
    whole = {v for v in values if isinstance(per_track.schema[v].dataType, T.IntegralType)}
    results = {v: F.when(F.col("__known_" + v) > 0, F.col(v)).cast("long" if v in whole else "double") for v in values}
    return sums.select(*keys, "replicate", *cells, *(c.alias(v) for v, c in results.items()))


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def draws_sql(replicates: int, key: str = "dataset", track: str = "crop_index") -> str:
    """The same in SQL from ``j`` (key, track, j: number from 0 within the key, n: trajectories, m: draws); y has a row a replicate and track."""
    factorials = ", ".join(f"({k}, {float(math.factorial(k))!r})" for k in range(TERMS))
    name = f"'{SEED}:' || {key} || ':' || {track} || ':' || (b // 4)"
    pick = f"'{SEED}:pick:' || {key} || ':' || b || ':' || d"
    return f"""fac AS (SELECT * FROM (VALUES {factorials}) AS v(k, f)),
    rt AS (SELECT DISTINCT {key}, least({HIGHEST_RATE}, greatest(0.0, (m - {SPREAD} * sqrt(m)) / n)) AS rate FROM j),
    th AS (SELECT {key}, list(lower(lpad(to_hex(CAST(least(4294967295, floor(4294967296 * c)) AS BIGINT)), 8, '0')) ORDER BY k) AS th
      FROM (SELECT {key}, k, exp(-rate) * sum(pow(rate, k) / f) OVER (PARTITION BY {key} ORDER BY k) AS c FROM rt, fac) GROUP BY {key}),
    ba AS (SELECT {key}, {track}, j, n, m, b, len(list_filter(th, lambda h: h <= substr(md5({name}), CAST(1 + 8 * (b % 4) AS BIGINT), 8))) AS v
      FROM j JOIN th USING ({key}), (SELECT unnest(generate_series(0, {replicates - 1})) AS b)),
    nd AS (SELECT {key}, n, m, b, CASE WHEN total <= m THEN m - total ELSE m END AS missing, total <= m AS fits
      FROM (SELECT {key}, n, m, b, sum(v) AS total FROM ba GROUP BY {key}, n, m, b)),
    pk AS (SELECT {key}, b, CAST('0x' || substr(md5({pick}), 1, 15) AS BIGINT) % n AS j, count(*) AS v FROM (SELECT *, unnest(range(CAST(missing AS BIGINT))) AS d FROM nd) GROUP BY ALL),
    y AS (SELECT {key}, CAST(b AS INTEGER) AS replicate, {track}, CAST(sum(v) AS BIGINT) AS times
      FROM (SELECT {key}, b, {track}, v FROM ba JOIN nd USING ({key}, b) WHERE fits UNION ALL SELECT {key}, b, {track}, v FROM pk JOIN (SELECT {key}, j, {track} FROM j) USING ({key}, j))
      GROUP BY ALL HAVING sum(v) > 0)"""
