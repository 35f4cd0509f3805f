"""Mix of sources to target weights by hash-threshold histograms.

Every document has a place in [0, 2^60) from a hash of its id and text. A source that should give q whole passes and a remainder
takes each document q times and once more where its place lies below the source's threshold. The threshold is found from
sums by source and hash bucket: the bucket in which the running sum crosses the remainder is refined alone, so that no
document is ever sorted. Rows that repeat an id and a text share a place; of those at the threshold itself as many are taken
as come nearest to the target, by their numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.shared import documents, stored, word_count

#: Bits below the two levels of buckets; a place has 60 bits, so a source has 4,096 buckets, and the one at its boundary 65,536.
COARSE, FINE = 48, 32
CAP = 3


def place(id_: Column, text: Column) -> Column:
    """The first 60 bits of the MD5 of an id and of the MD5 of a text, as a number; null counts as empty."""
    both = F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(F.md5(both), 1, 15), 16, 10).cast("long")


def ranked(sizes: DataFrame) -> DataFrame:
    """The rows with ``number``: their place from 0 in order of code points, null last. ``source`` is distinct.

    Places come from ranges of sources and a sum of counts over the ranges, so no task sees all sources.
    """
    key = F.struct(F.col("source").isNull().alias("null"), F.encode("source", "UTF-8").alias("bytes")).alias("key")
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once, so that the ranges are the same for both uses.
    rows = stored(sizes.withColumn("key", key).repartitionByRange(parts, "key").withColumn("range", F.spark_partition_id()), "ranges")
    counts = rows.groupBy("range").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("range", F.coalesce(before, F.lit(0)).alias("start"))
    inner = F.row_number().over(Window.partitionBy("range").orderBy("key"))
    return rows.withColumn("inner", inner).join(starts, "range").withColumn("number", F.col("start") + F.col("inner") - 1).drop("key", "range", "inner", "start")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)`` with one row a source; of no rows, none.

    Sources in order of code points, null last, weigh 1, 2, 3 and so on in turn and share the sum of all sizes. A source
    stops at three times its size; the excess goes to the others by weight. The level, words for each unit of weight, rises
    until no further source stops: each step is one sum over the sources.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int"))
    rows = ranked(sizes).withColumn("weight", weight.cast("long")).withColumn("cap", CAP * F.col("source_size"))
    rows = stored(rows, "weights")
    level, stopped = -1.0, -1
    while True:
        stops = F.col("cap") <= F.lit(level) * F.col("weight")
        sums = rows.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(stops, F.col("cap")).otherwise(0)).alias("spent"),
            F.sum(F.when(stops, 0).otherwise(F.col("weight"))).alias("free"),
            F.sum(stops.cast("long")).alias("n"),
        ).first()
        if not sums["free"] or sums["n"] == stopped:
            break
        level, stopped = (sums["all"] - sums["spent"]) / sums["free"], sums["n"]
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")).alias("target"))


def sized(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.col(text_col).alias("text"))
    # Written with the row's number, which therefore stays.
    return stored(rows.withColumn("place", place(F.col("id"), F.col("text"))).drop("text").withColumn("row", F.monotonically_increasing_id()), "sizes")


def thresholds(rows: DataFrame) -> DataFrame:
    """``(source, source_size, target, passes, edge, same, more)`` from ``(source, size, place)``.

    A document is taken ``passes`` times, and once more if its place is below ``edge``. Of the ``same`` rows at ``edge``, ``more``
    are taken once more.
    """
    sums = stored(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    plan = targets(sums)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", whole).withColumn("open", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = stored(plan, "targets")

    same = "rows.source <=> plan.source"
    coarse, fine = f"shiftright(place, {COARSE})", f"shiftright(place, {FINE})"
    filled = rows.where("size > 0")
    level = _crossed(filled.groupBy("source", F.expr(coarse).alias("at")).agg(F.sum("size").alias("size")), plan.select("source", "open"))
    inside = filled.alias("rows").join(level.alias("plan"), F.expr(f"{same} and {coarse} = plan.at")).select("rows.*", "plan.open")
    inside = stored(inside, "boundary")
    level = _crossed(inside.groupBy("source", F.expr(fine).alias("at")).agg(F.sum("size").alias("size")), level.select("source", "open"))
    last = inside.drop("open").alias("rows").join(level.alias("plan"), F.expr(f"{same} and {fine} = plan.at")).select("rows.*")
    last = stored(last.groupBy("source", F.col("place").alias("at")).agg(F.sum("size").alias("size"), F.count("*").alias("same")), "last")
    level = _crossed(last.drop("same"), level.select("source", "open"))
    level = level.alias("rows").join(last.alias("plan"), F.expr(f"{same} and rows.at = plan.at")).select("rows.*", "plan.same")
    # Rows at the crossing have one text and so one size; a single one is taken where that leaves the smaller difference.
    more = F.ceil(F.col("open") * F.col("same") / F.col("size") - 0.5).cast("long")
    level = level.select("source", F.col("at").alias("edge"), "same", more.alias("more"))
    plan = plan.alias("plan").join(level.alias("rows"), F.expr(same), "left")
    zeros = [F.coalesce(f"rows.{c}", F.lit(0)).alias(c) for c in ("edge", "same", "more")]
    return stored(plan.select("plan.source", "source_size", "target", "passes", *zeros), "thresholds")


def copies(at: Column) -> Column:
    """How often a document at a place is taken under the thresholds of its source, where rows at ``edge`` are treated alike."""
    return F.col("passes") + ((at < F.col("edge")) | ((at == F.col("edge")) & (F.col("more") > 0))).cast("long")


def divided(at: Column) -> Column:
    """Whether only some of the rows at a document's place are taken once more."""
    return (at == F.col("edge")) & (F.col("more") > 0) & (F.col("more") < F.col("same"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of the divided places with ``number``, from 0 within the source in order of ``row``.

    A source's rows may be a large part of the table: they are numbered within the partition that gave ``row``, and moved by the counts of
    the partitions before.
    """
    rows = rows.withColumn("part", F.shiftright("row", 33))
    inner = F.row_number().over(Window.partitionBy("source", "part").orderBy("row")) - 1
    counts = rows.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("source", "part", F.coalesce(before, F.lit(0)).alias("start"))
    both = rows.withColumn("inner", inner).alias("rows").join(starts.alias("plan"), F.expr("rows.source <=> plan.source and rows.part = plan.part"))
    return both.select("rows.*", (F.col("inner") + F.col("start")).alias("number")).drop("part", "inner")


def mixed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per input row: id, source, size (words), source_size, target (of its source), taken (words, repeats counted).

    Null and empty texts have size 0 and take 0. A null source is a source of its own. Rows that repeat an id and a text share a
    place and have numbers there, so that some of them may be taken once more than the others; a null id counts as an empty one.
    Further columns are left out. A source's taken words differ from its target by at most half the words of a row at its last place;
    reruns agree, as places depend on ids and texts alone and rows of one place are equal.
    """
    rows = sized(df, id_col, text_col, source_col)
    joined = rows.alias("rows").join(thresholds(rows).alias("plan"), F.expr("rows.source <=> plan.source"))
    joined = joined.select("rows.*", "source_size", "target", "passes", "edge", "same", "more")
    shown = lambda part, taken: part.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("size") * taken).alias("taken"))
    some = numbered(joined.where(divided(F.col("place"))))
    sure = shown(joined.where(~divided(F.col("place"))), copies(F.col("place")))
    return sure.unionByName(shown(some, F.col("passes") + (F.col("number") < F.col("more")).cast("long")))


def repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as ``mixed`` takes it; rows without words are not taken.

    Only the table of thresholds, one row a source, meets the texts. All columns stay, whatever their names. Rows that repeat an id and a
    text and differ elsewhere may change places with each other when the table is read in another order.
    """
    plan = thresholds(sized(df, id_col, text_col, source_col)).withColumnRenamed("source", "mix_source")
    whole = df.select(F.struct(*(F.col(c) for c in df.columns)).alias("row_"))
    out = whole.where(word_count(F.col(f"row_.{text_col}")) > 0).join(plan, F.col(f"row_.{source_col}").eqNullSafe(F.col("mix_source")))
    at = place(F.col(f"row_.{id_col}"), F.col(f"row_.{text_col}"))
    times = lambda part, n: part.withColumn("time", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select("row_.*")
    if plan.where("more > 0 and more < same").isEmpty():
        return times(out, copies(at))
    # Only where rows of one place are told apart are texts read a second time.
    tied = out.where(divided(at)).select("row_", "passes", "more", F.col("mix_source").alias("source"))
    some = numbered(stored(tied.withColumn("row", F.monotonically_increasing_id()), "tied"))
    return times(out.where(~divided(at)), copies(at)).unionByName(times(some, F.col("passes") + (F.col("number") < F.col("more")).cast("long")))


def _crossed(sums: DataFrame, open_sums: DataFrame) -> DataFrame:
    """For each source, the bucket in which the running sum passes what is open: ``(source, at, size, open)``, open less all before."""
    up_to = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.withColumn("up_to", F.sum("size").over(up_to)).alias("rows")
    rows = rows.join(open_sums.alias("plan"), F.expr("rows.source <=> plan.source")).where("up_to > open and up_to - size <= open and open > 0")
    return stored(rows.select("rows.source", "at", "size", (F.col("open") - (F.col("up_to") - F.col("size"))).alias("open")), "crossed")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


#: Independent form: water filling by recursion over stopped sources, and running sums over all documents in hash order.
OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / weight, source IS NULL, source) AS n, 3.0 * source_size AS cap FROM s),
fill(n, spent, gone) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)
  UNION ALL
  SELECT r.n, fill.spent + r.cap, fill.gone + r.weight FROM fill JOIN r ON r.n = fill.n + 1
  WHERE r.cap <= r.weight * ((SELECT sum(source_size) FROM s) - fill.spent) / ((SELECT sum(weight) FROM s) - fill.gone)),
stop AS (SELECT max(n) AS n, max(spent) AS spent, max(gone) AS gone FROM fill),
t AS (
  SELECT r.source, r.source_size,
         CASE WHEN r.n <= stop.n THEN r.cap
              ELSE least(r.cap, ((SELECT sum(source_size) FROM s) - stop.spent) / ((SELECT sum(weight) FROM s) - stop.gone) * r.weight) END AS target
  FROM r, stop),
p AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS passes FROM t),
q AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.passes, p.target - p.passes * p.source_size AS open,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS up_to,
         sum(d.size) OVER (PARTITION BY d.source, d.place) AS here, count(*) OVER (PARTITION BY d.source, d.place) AS same,
         row_number() OVER (PARTITION BY d.source, d.place ORDER BY d.doc_id) - 1 AS number
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (passes + CASE WHEN up_to <= open THEN 1
                                  WHEN up_to - here <= open AND number < ceil((open - (up_to - here)) * same / here - 0.5) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q
"""
