"""Windows over keys of any length: a key's rows are cut into blocks by place, and each block also gets its neighbours' edges.

No task holds a key. Places come from range partitions and sums of counts; a block has at most ``BLOCK`` rows of its own and
``halo`` rows on either side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.sources.scratch import settled

BLOCK = 4096


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with ``__place`` (from 0, in order within the key) and ``__n`` (rows of the key). Null keys are a key."""
    parts = df.repartitionByRange(*keys, *order).withColumn("__p", F.spark_partition_id())
    inner = F.row_number().over(Window.partitionBy("__p", *keys).orderBy(*order))
    # Settled, so that both uses below see the same ranges, whatever is computed again.
    local = settled(parts.withColumn("__rn", inner))
    sizes = local.groupBy(*keys, "__p").agg(F.count("*").alias("__m"))
    key = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__m").over(key.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(F.col("__p").alias("__q"), *(F.col(k).alias("__k_" + k) for k in keys), before.alias("__before"), F.sum("__m").over(key).alias("__n"))
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col("__k_" + k)), keys, F.col("__p") == F.col("__q"))
    rows = local.join(sizes, same).withColumn("__place", F.col("__before") + F.col("__rn") - 1)
    return rows.select(*df.columns, "__place", "__n")


def over_blocks(df: DataFrame, x: str, keys: list[str], order: list[str], halo: int, function: Callable[[np.ndarray, int, int], np.ndarray], name: str, place: str | None = None, block: int = BLOCK) -> DataFrame:
    """Rows with a double ``name`` from a function of neighbouring values; ``place`` names a column for the place in the key, if wanted.

    The function gets the values of a block with its halo (NaN for null), the place of the first and the rows of the key, and gives a value
    for each of them; NaN becomes null. Other columns go through unchanged.
    """
    if block < halo:
        raise ValueError("blocks must not be shorter than the halo")
    rows = placed(df, keys, order)
    last, at = F.floor((F.col("__n") - 1) / block), F.col("__place")
    copies = F.sequence(F.greatest(F.lit(0), F.floor((at - halo) / block)), F.least(last, F.floor((at + halo) / block)))
    rows = rows.withColumn("__block", F.explode(copies)).withColumn("__group", F.to_json(F.struct(*keys, "__block")))
    rows = rows.withColumn("__x", F.col(x).cast("double"))
    rows = rows.repartition("__group").sortWithinPartitions("__group", "__place")
    kept = [*df.columns, *(["__place"] if place else [])]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(name, T.DoubleType())])

    def finished(table: pa.Table) -> Iterator[pa.RecordBatch]:
        group = table.column("__group").combine_chunks()
        edges = np.flatnonzero(pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(group) > 1 else np.empty(0, dtype=int)
        values = table.column("__x").to_numpy().astype(float)
        at, n, mine = (table.column(c).to_numpy() for c in ("__place", "__n", "__block"))
        out = np.empty(len(values))
        for a, b in zip([0, *edges], [*edges, len(values)], strict=True):
            out[a:b] = function(values[a:b], int(at[a]), int(n[a]))
        made = table.select(kept).append_column(name, pa.array(out, from_pandas=True))
        for part in made.filter(pa.array(at // block == mine)).to_batches():
            yield pa.RecordBatch.from_arrays(part.columns, schema.names)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            # The last group may go on in the next batch.
            start = pc.index(table.column("__group"), table.column("__group")[-1]).as_py()
            if start:
                yield from finished(table.slice(0, start))
            held = table.slice(start)
        if held is not None:
            yield from finished(held)

    found = rows.mapInArrow(streamed, schema)
    return found.withColumnRenamed("__place", place) if place else found
