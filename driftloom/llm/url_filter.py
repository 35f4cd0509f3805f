"""URL filters: host and path rules, and exact membership in a list by a cascade of Bloom filters.

Level 0 encodes the listed keys. Keys of the corpus that are not listed but pass level 0 are encoded by level 1, listed keys
that pass level 1 by level 2, and so on until no key is left. Over the complete universe of the corpus's keys the
cascade answers without error: a key is listed if the first level that it fails is odd, or if it passes all of an odd number.
Keys are split by hash into shards so that every filter has a bounded size; each shard has a cascade of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.shared import lower_ascii, stored

#: Fixed rules of the registered query: verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
FILTER_BITS = 1 << 26
BITS_A_KEY = 10


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does. Of equally long rules the first in order wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1:]), reverse=False):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _bits_of(keys: DataFrame, size: int, level: int, hashes: int) -> DataFrame:
    """64-bit words of the filter that holds ``keys``: ``(word, bits)``."""
    at = F.explode(F.array(*(F.pmod(F.xxhash64("key", F.lit(level * 64 + k)), F.lit(size)) for k in range(hashes))))
    return keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))


def _passes(spark: SparkSession, words: DataFrame, size: int, level: int, hashes: int, key: Column) -> Column:
    """Whether a key passes a filter, whose words go to all tasks; their number is at most ``size`` / 64."""
    held = np.zeros(size // 64, dtype=np.uint64)
    for word, bits in words.toLocalIterator():
        held[word] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    shared = spark.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def test(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for columns in batches:
            ok = np.ones(len(columns[0]), dtype=bool)
            for c in columns:
                at = c.to_numpy()
                ok &= (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield pd.Series(ok)

    return test(*(F.pmod(F.xxhash64(key, F.lit(level * 64 + k)), F.lit(size)) for k in range(hashes)))


class Cascade:
    """Exact membership of the keys of a universe in a list.

    ``universe`` has a column ``key`` with all keys that will be asked for and a boolean ``listed``; null keys are ignored,
    and repeated rows count once. A filter has about ten bits for each of its keys and goes to every task that tests its
    shard. Keys go to as many shards by hash as it takes for filters of about ``max_bits`` (8 MB), twice that at most.
    """

    def __init__(self, universe: DataFrame, max_bits: int = FILTER_BITS, hashes: int = 5):
        self.spark, self.hashes = universe.sparkSession, hashes
        keys = stored(universe.select("key", "listed").where("key is not null").distinct(), "keys")
        self.shards = max(1, math.ceil(1.25 * BITS_A_KEY * keys.count() / max_bits))
        keys = self._sharded(keys, "key")
        self.levels = [self._built(keys.where(F.col("shard") == s), 2 * max_bits) for s in range(self.shards)]

    def _sharded(self, df: DataFrame, key: str) -> DataFrame:
        """The rows with their shard; several shards are stored apart, so that each is read once."""
        df = df.withColumn("shard", F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(self.shards)).cast("int"))
        return df if self.shards == 1 else stored(df, "shards", by="shard")

    def _built(self, keys: DataFrame, most: int) -> list[tuple[DataFrame, int]]:
        levels: list[tuple[DataFrame, int]] = []
        inside, outside = keys.where("listed").select("key"), keys.where("not listed").select("key")
        while (n := inside.count()) > 0:
            size = min(most, max(1 << 10, 1 << (BITS_A_KEY * n - 1).bit_length()))
            words = stored(_bits_of(inside, size, len(levels), self.hashes), "filter")
            levels.append((words, size))
            passed = outside.where(_passes(self.spark, words, size, len(levels) - 1, self.hashes, F.col("key")))
            inside, outside = stored(passed, "passed"), inside
        return levels

    def mark(self, df: DataFrame, key: str, name: str) -> DataFrame:
        """The rows with a boolean column: whether their key, one of the universe, is listed; false for null.

        Shards are tested one by one, each with its own filters only. ``df`` must have no column ``shard``."""
        rows, parts = self._sharded(df, key), []
        for s, levels in enumerate(self.levels):
            answer = F.lit(len(levels) % 2 == 1)
            for level in reversed(range(len(levels))):
                words, size = levels[level]
                answer = F.when(_passes(self.spark, words, size, level, self.hashes, F.col(key)), answer).otherwise(F.lit(level % 2 == 1))
            parts.append(rows.where(F.col("shard") == s).withColumn(name, F.coalesce(F.col(key).isNotNull() & answer, F.lit(False))).drop("shard"))
        return reduce(DataFrame.unionByName, parts)


def filtered_urls(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict.

    The longest rule that fits decides. Where none fits, the list does: it holds every host of the corpus with a page that a
    rule blocks, and such hosts are blocked, all others allowed. Null urls and urls without ``://`` have an empty host and path.
    Null ids and repeated rows are rows like any other; further columns are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumn("found", matched_rule(F.col("host"), F.col("path"), rules))
    bad = F.max(F.coalesce(F.col("found.verdict") == "block", F.lit(False)))
    cascade = Cascade(rows.groupBy(F.col("host").alias("key")).agg(bad.alias("listed")))
    rows = cascade.mark(rows, "host", "listed")
    other = F.when(F.col("listed"), "block").otherwise("allow")
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), F.coalesce("found.verdict", other).alias("verdict"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP9_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM h),
b AS (SELECT DISTINCT host FROM r WHERE rule IN ('example.com/en/', 'net/es/', 'net/fr/'))
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
