"""Removal of long repeated byte strings by prefix-free parsing.

Triggers, 8-byte windows with a certain hash, cut every text into phrases, so equal strings are cut alike from their first
trigger on. A string of 400 bytes is then a suffix of a phrase of the dictionary (what stands before its first trigger) and a
prefix of a suffix of the parse (what follows). Two places share 400 bytes exactly where they are neighbours in corpus order
with such a common prefix, so both orders are needed to depth 400 only and are kept as classes of equal prefixes, which can be
counted with partial sums, instead of ranks:

- A cell holds the starts of one phrase with the distance to its trigger in one bucket of 128. All windows of a cell contain its
  core, 400 - 128 + 1 bytes at a fixed place beside the trigger. A core that occurs once rules its cell out.
- The hull of a cell is all that its windows cover. A hull that occurs twice makes all its starts repeated.
- What is left are the ends of repeats: cells with a repeated core and a single hull. They, and one representative of each
  other hull of such a core, are cut into cells of 16 starts and judged alike; of those that are left then, windows are
  counted one by one.

Strings are compared by fingerprints modulo primes near 2^31: two for cores, and two more for the hulls or windows of a core.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftloom.llm.shared import discard, documents, stored

LENGTH = 400
#: A cell has so many starts at most, and a small cell so many.
BITS = 7
WIDTH = 1 << BITS
SMALL = 16
#: One in 2^6 words is a trigger: about 0.2 % of windows of prose see none.
TRIGGER_BITS = 6
WORD_BYTES = 8
#: Starts that are looked at together in a long text.
BLOCK = 1 << 18
POSITION_BITS = 20
#: Rows and slices that a task hands on together.
ROWS = 100_000
SLICES = 1024
# The largest primes below 2^31, and arbitrary bases and an odd factor.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1299709111, 1566083941, 1812433253)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> list[np.ndarray]:
    out = []
    for p, base in zip(PRIMES, BASES, strict=True):
        x = np.ones(n, dtype=np.uint64)
        done, step = 1, base
        while done < n:
            take = min(done, n - done)
            x[done : done + take] = x[:take] * np.uint64(step) % np.uint64(p)
            done, step = done + take, step * step % p
        out.append(x)
    return out


class Fingerprints:
    """Fingerprints of substrings of short byte arrays; equal strings agree wherever they stand."""

    def __init__(self, longest: int):
        self.longest = longest
        self.powers = _powers(longest + 1)

    def sums(self, data: np.ndarray, which: int) -> np.ndarray:
        """Prefix sums along the last axis."""
        p = np.uint64(PRIMES[which])
        terms = (data.astype(np.uint64) + np.uint64(1)) * self.powers[which][: data.shape[-1]] % p
        out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), dtype=np.uint64)
        np.cumsum(terms, axis=-1, out=out[..., 1:])
        return out

    def of(self, part: np.ndarray, start: np.ndarray, which: int) -> np.ndarray:
        """Fingerprints from differences of prefix sums of strings that begin at ``start``."""
        p = np.uint64(PRIMES[which])
        return part % p * self.powers[which][self.longest - start] % p


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << np.uint64(31) | b).astype(np.int64)


_blocks = Fingerprints(BLOCK + LENGTH + WORD_BYTES)
_slices = Fingerprints(WIDTH + LENGTH)


def pack(first: np.ndarray, ahead: np.ndarray, size: np.ndarray) -> np.ndarray:
    """First start, how far ahead of it the core begins, and number of starts of a cell in one long."""
    return first << 2 * BITS | ahead << BITS | (size - 1)


def unpack(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return packed >> 2 * BITS, packed >> BITS & (WIDTH - 1), (packed & (WIDTH - 1)) + 1


def word_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the 8 bytes at each position."""
    word = data.astype(np.uint64)
    for k in (1, 2, 4):
        word = word[:-k] | word[k:] << np.uint64(8 * k)
    return word * FACTOR


def least_words(hashes: np.ndarray, starts: np.ndarray, reach: int) -> np.ndarray:
    """Position of the first least hash among those from each start to ``reach`` farther on."""
    low = hashes >> np.uint64(POSITION_BITS) << np.uint64(POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while 2 * size <= reach + 1:
        low, size = np.minimum(low[:-size], low[size:]), 2 * size
    return (np.minimum(low[starts], low[starts + reach + 1 - size]) & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64)


def cells(data: np.ndarray, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of the starts from ``begin`` to ``end`` (exclusive): packed place, core, hull.

    In a window without a trigger the first word with the least hash serves as one.
    """
    here = data[begin : end + LENGTH - 1]
    stop, reach = end - begin, LENGTH - WORD_BYTES  # a trigger lies at most so far ahead of its windows' starts
    hashes = word_hashes(here)
    at = np.flatnonzero(hashes >> np.uint64(64 - TRIGGER_BITS) == 0)
    at = at[: np.searchsorted(at, stop - 1) + 1]
    low = np.concatenate(([0], at[:-1] + 1)) if len(at) else at
    bucket = np.arange(-(-(reach + 1) // WIDTH))
    first = np.maximum(low[:, None], at[:, None] - np.minimum((bucket + 1) * WIDTH - 1, reach))
    last = np.minimum(at[:, None] - bucket * WIDTH, stop - 1)
    trigger, which = np.nonzero(first <= last)
    first, last, trigger = first[trigger, which], last[trigger, which], at[trigger]
    alone_low = np.append(low, at[-1] + 1 if len(at) else 0)
    n = np.maximum(np.append(np.minimum(at - reach, stop), stop) - alone_low, 0)
    if n.any():
        alone = np.repeat(alone_low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        least = least_words(hashes, alone, reach)
        far = (least - alone) // WIDTH
        new = np.concatenate(([True], (np.diff(alone) > 1) | (np.diff(least) != 0) | (np.diff(far) != 0)))
        first, last = np.concatenate((first, alone[new])), np.concatenate((last, alone[np.append(new[1:], True)]))
        trigger, which = np.concatenate((trigger, least[new])), np.concatenate((which, far[new]))
    core = trigger - which * WIDTH
    core_end = core + LENGTH - WIDTH + 1
    out = []
    for k in range(2):
        s = _blocks.sums(here, k)
        out.append(_blocks.of(s[core_end] - s[core], core, k))
    for k in (2, 3):
        s = _blocks.sums(here, k)
        out.append(_blocks.of(s[last + LENGTH] - s[first], first, k))
    return pack(begin + first, core - first, last - first + 1), _pair(*out[:2]), _pair(*out[2:])


def _cells(block: int):
    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for pdf in batches:
            for k1, k2, body in zip(pdf["k1"], pdf["k2"], pdf["body"], strict=True):
                data = np.frombuffer(body, dtype=np.uint8)
                for begin in range(0, len(data) - LENGTH + 1, block):
                    at, core, hull = cells(data, begin, min(begin + block, len(data) - LENGTH + 1))
                    found.append((np.full(len(at), k1), np.full(len(at), k2), at, core, hull))
                    rows += len(at)
                    if rows >= ROWS:
                        yield _table(found)
                        found, rows = [], 0
        if found:
            yield _table(found)

    return parsed


def _table(found: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("k1", "k2", "at", "core", "hull"), map(np.concatenate, zip(*found, strict=True)), strict=True)))


def _cut_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bytes of open cells. Of equal texts that stand together one is used; copies beyond that change nothing, as ``n`` is 2 for them already."""
    seen = None
    for pdf in batches:
        found = []
        for k1, k2, body, opened in zip(pdf["k1"], pdf["k2"], pdf["body"], pdf["opened"], strict=True):
            if (k1, k2) == seen:
                continue
            seen = (k1, k2)
            for o in opened:
                first, _, size = unpack(o["at"])
                found.append((k1, k2, o["at"], o["n"], body[first : first + size + LENGTH - 1]))
            if len(found) >= ROWS:
                yield pd.DataFrame(found, columns=["k1", "k2", "whole", "n", "slice"])
                found = []
        if found:
            yield pd.DataFrame(found, columns=["k1", "k2", "whole", "n", "slice"])


def _matrix(slices: pd.Series) -> np.ndarray:
    """Slices as rows, filled up with zeros."""
    width = WIDTH + LENGTH - 1
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in slices), dtype=np.uint8).reshape(-1, width)


def _small_cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of ``SMALL`` starts, dealt by the distance to the core, with the core and hull that these have."""
    for whole in batches:
        for part in range(0, len(whole), SLICES):
            pdf = whole.iloc[part : part + SLICES]
            data, (begin, ahead, size) = _matrix(pdf["slice"]), unpack(pdf["whole"].to_numpy())
            deal = np.arange(WIDTH // SMALL) * SMALL
            far, near = np.minimum(ahead[:, None], deal + SMALL - 1), np.maximum((ahead - size + 1)[:, None], deal)
            row, which = np.nonzero(far >= near)
            first, last, core = ahead[row] - far[row, which], ahead[row] - near[row, which], ahead[row] - deal[which]
            prints = []
            for k, (start, end) in enumerate([(core, core + LENGTH - SMALL + 1)] * 2 + [(first, last + LENGTH)] * 2):
                s = _slices.sums(data, k)
                prints.append(_slices.of(s[row, end] - s[row, start], start, k))
            columns = {c: pdf[c].to_numpy()[row] for c in ("k1", "k2", "whole", "n")}
            yield pd.DataFrame(columns | {"at": pack(begin[row] + first, core - first, last - first + 1), "core": _pair(*prints[:2]), "hull": _pair(*prints[2:])})


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Windows of open small cells with their prints."""
    for whole in batches:
        for part in range(0, len(whole), SLICES):
            pdf = whole.iloc[part : part + SLICES]
            data, (begin, _, _) = _matrix(pdf["slice"]), unpack(pdf["whole"].to_numpy())
            owner = np.repeat(np.arange(len(pdf)), pdf["opened"].map(len).to_numpy())
            core, at, n = (np.array([o[c] for opened in pdf["opened"] for o in opened], dtype=np.int64) for c in ("core", "at", "n"))
            first, _, size = unpack(at)
            cell = np.repeat(np.arange(len(owner)), size)
            start = first[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(size) - size, size)
            row, offset = owner[cell], start - begin[owner[cell]]
            prints = []
            for k in (2, 3):
                s = _slices.sums(data, k)
                prints.append(_slices.of(s[row, offset + LENGTH] - s[row, offset], offset, k))
            columns = {c: pdf[c].to_numpy()[row] for c in ("k1", "k2")} | {"core": core[cell], "n": n[cell]}
            yield pd.DataFrame(columns | {"at": pack(start, 0, 1), "print": _pair(*prints)})


def spans(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that windows of these cells cover."""
    start, _, size = unpack(np.sort(packed))
    end = np.maximum.accumulate(start + size - 1 + LENGTH)
    new = np.concatenate(([True], start[1:] > end[:-1]))
    return start[new], end[np.concatenate((new[1:], [True]))]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for body, packed in zip(pdf["body"], pdf["repeated"], strict=True):
            digest, view, at, removed, runs = hashlib.sha256(), memoryview(body), 0, 0, 0
            if packed is not None:
                for a, b in zip(*(x.tolist() for x in spans(np.asarray(packed))), strict=True):
                    digest.update(view[at:a])
                    at, removed, runs = b, removed + b - a, runs + 1
            digest.update(view[at:])
            out.append((len(body), removed, runs, digest.hexdigest()))
        yield pd.DataFrame({"id": pdf["id"]} | dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), map(list, zip(*out, strict=True)), strict=True)) if out else {})


def _judged(cells: DataFrame, place: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Cells whose hull occurs again, and one cell for each hull of the cores that also have a hull that does not.

    ``n`` is how often a cell occurs; 2 stands for more.
    """
    # Written first, as adaptive execution splits hot keys only where both sides of a join come straight from an exchange.
    again = stored(cells.groupBy("core").agg(F.sum("n").alias("all")).where("all > 1").select("core"), f"{name}-again")
    live = stored(cells.join(again, "core"), f"{name}-live")
    discard(cells)
    hulls = live.groupBy("core", "hull").agg(F.sum("n").alias("n"), F.min(F.struct(*place)).alias("one"))
    hulls = stored(hulls.withColumn("n", F.least("n", F.lit(2))), f"{name}-hulls")
    mixed = hulls.groupBy("core").agg(F.min("n").alias("least"), F.count("*").alias("kinds")).where("least = 1 and kinds > 1").select("core")
    mixed = stored(mixed, f"{name}-mixed")
    opened = hulls.join(mixed, "core").select("one.*", "core", "n")
    whole = live.join(hulls.where("n > 1").select("core", "hull"), ["core", "hull"])
    return whole, opened


def repeated_starts(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(k1, k2, repeated): for each text with a repeat, packed starts of its 400-byte strings that occur elsewhere too."""
    texts = docs.where(F.length("body") >= LENGTH).select("k1", "k2", "body")
    found = stored(texts.mapInPandas(_cells(block), "k1 long, k2 long, at long, core long, hull long").withColumn("n", F.lit(1)), "cells")
    whole, opened = _judged(found, ["k1", "k2", "at"], "cells")
    opened = stored(opened.groupBy("k1", "k2").agg(F.collect_list(F.struct("at", "n")).alias("opened")), "opened")
    slices = texts.join(opened, ["k1", "k2"]).mapInPandas(_cut_slices, "k1 long, k2 long, whole long, n int, slice binary")
    slices = stored(slices, "slices")
    small = stored(slices.mapInPandas(_small_cells, "k1 long, k2 long, whole long, n int, at long, core long, hull long"), "small")
    parts, opened = _judged(small, ["k1", "k2", "whole", "at"], "small")
    opened = opened.groupBy("k1", "k2", "whole").agg(F.collect_list(F.struct("core", "at", "n")).alias("opened"))
    windows = slices.drop("n").join(opened, ["k1", "k2", "whole"]).mapInPandas(_windows, "k1 long, k2 long, core long, n int, at long, print long")
    windows = stored(windows, "windows")
    discard(slices)
    again = windows.groupBy("core", "print").agg(F.sum("n").alias("all")).where("all > 1").select("core", "print")
    again = stored(again, "windows-again")
    ends = windows.where("n = 1").join(again, ["core", "print"])
    starts = [x.select("k1", "k2", "at") for x in (whole, parts.where("n = 1"), ends)]
    starts = starts[0].unionByName(starts[1]).unionByName(starts[2])
    return stored(starts.groupBy("k1", "k2").agg(F.collect_set("at").alias("repeated")), "starts")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256.

    Each byte of the text's UTF-8 that a 400-byte string covers which also starts anywhere else is removed, in the same
    document or another, overlapping or not; matches never cross documents, and all strings are judged on the input. Null and
    empty texts have no bytes and keep the hash of an empty string; texts below 400 bytes stay whole. Rows are judged one by
    one, whether ids repeat or are null, so a repeated row of 400 bytes or more is removed whole. Long texts are parsed in
    blocks of ``block`` starts. A run of one byte costs a row a byte. Other columns are left out; an empty table gives
    no rows.
    """
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    docs = df.select(F.col(id_col).alias("id"), body.alias("body"))
    # Equal texts share a key of two hashes.
    docs = docs.withColumn("k1", F.xxhash64("body")).withColumn("k2", F.xxhash64(F.lit(1), "body"))
    rows = docs.join(repeated_starts(docs, block), ["k1", "k2"], "left").select("id", "body", "repeated")
    schema = T.StructType(
        [T.StructField("id", df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    )
    return rows.mapInPandas(_cut, schema).withColumnRenamed("id", id_col)


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))
