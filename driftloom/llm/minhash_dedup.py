"""Near duplicates among documents by an LSH forest over MinHash signatures.

A document's set of word shingles gives a signature of minimum hashes. Each tree of the forest is the list of all
signatures sorted from another starting hash. Neighbours in a tree have the longest prefixes in common; a region is a run of
documents that share a prefix. From the shallowest depth at which a match is likely, the prefix grows region by region until
few documents share it: shallow where documents are rare, deep where many share a prefix. Documents of such a leaf are
candidates, and so are neighbours. Candidates are confirmed on the full sets. What that joins need not be compared any more;
in regions that had to be split, all other pairs are compared in blocks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.components import components
from driftloom.llm.shared import documents, stored

HASHES, TREES, STEP = 64, 16, 4
CHUNK = 2048
#: Classes and shingles that one part of a long run has on average; a block compares two parts.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 19
_RNG = np.random.default_rng(20240102)
_MULTIPLY = _RNG.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)
_PLACES = [int(x) | 1 for x in _RNG.integers(0, 1 << 63, 64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; empty without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, np.uint64(size))
    for k in range(size):
        total = _mix(total + hashed[k : len(words) - size + 1 + k] * np.uint64(_PLACES[k % 64]))
    return np.unique(total)


def signature(found: np.ndarray) -> bytes:
    """Minimum hashes as 64 16-bit numbers."""
    low = np.full(HASHES, np.uint64(2**64 - 1))
    for k in range(0, len(found), CHUNK):
        np.minimum(low, (found[None, k : k + CHUNK] * _MULTIPLY + _ADD).min(axis=1), out=low)
    return (_mix(low) >> np.uint64(48)).astype(">u2").tobytes()


def _digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def _signed(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(len(x), _digest(x), signature(x) if len(x) else None) for x in (shingles(t, width) for t in pdf["text"])]
            size, digest, sign = zip(*rows, strict=True) if rows else ((), (), ())
            yield pd.DataFrame({"id": pdf["id"], "text_hash": pdf["text_hash"], "n_shingles": list(size), "digest": list(digest), "sign": list(sign)})

    return run


def _sets(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t, width) for t in pdf["text"]]
            same = [_digest(x) == d for x, d in zip(found, pdf["digest"], strict=True)]
            yield pd.DataFrame({"node": pdf["node"], "members": [x.view(np.int64) for x in found]})[same]

    return run


def common_prefixes(tree: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """How many hashes each row of sorted trees has in common, from the first on, with the row before it."""
    same = (sign[1:] == sign[:-1]) & (tree[1:] == tree[:-1])[:, None]
    return np.concatenate([[0], np.logical_and.accumulate(same, axis=1).sum(axis=1)]).astype(np.int64)


def leaves(common: np.ndarray, prefix: int, few: int) -> np.ndarray:
    """A number for each row's leaf: the shallowest region, of ``prefix`` hashes or more, with at most ``few`` rows.

    Rows whose whole signature more than ``few`` rows share are in no leaf (-1).
    """
    leaf = np.full(len(common), -1, dtype=np.int64)
    for depth in range(prefix, HASHES + 1):
        run = np.cumsum(common < depth)
        small = (leaf < 0) & (np.bincount(run)[run] <= few)
        leaf[small] = run[small] * (HASHES + 1) + depth
        if (leaf >= 0).all():
            break
    return leaf


def _pairs(pdf: pd.DataFrame, few: int, prefix: int, alike: float) -> pd.DataFrame:
    """Neighbours that share a prefix, and rows of one leaf, if their signatures look alike."""
    tree, sign, node = pdf["tree"].to_numpy(), _numbers(pdf["sign"]), pdf["node"].to_numpy()
    outs = []
    if len(node) > 1:
        common = common_prefixes(tree, sign)
        leaf = leaves(common, prefix, few)
        for off in range(1, min(few, len(node))):
            same = (leaf[off:] == leaf[:-off]) & (leaf[off:] >= 0)
            at = np.flatnonzero(same | (common[1:] >= prefix) if off == 1 else same)
            if off > 1 and not len(at):
                break
            at = at[(sign[at + off] == sign[at]).mean(axis=1) >= alike]
            x, y = node[at], node[at + off]
            outs.append(pd.DataFrame({"a": np.minimum(x, y), "b": np.maximum(x, y), "first": (off == 1) & (tree[at] < STEP)}))
    return pd.concat(outs) if outs else pd.DataFrame({"a": [], "b": [], "first": []}).astype({"a": int, "b": int, "first": bool})


def _numbers(sign: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(sign), dtype=">u2").reshape(-1, HASHES)


def _neighbours(few: int, prefix: int, alike: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Pairs of one partition of the sorted trees, and the rows of small regions that other partitions hold a part of."""
        left = None
        for pdf in batches:
            if left is not None:
                pdf = pd.concat([left, pdf], ignore_index=True)
            if not len(pdf):
                continue
            # The last region may go on: it is looked at with the next rows if it is small, and its last rows are if not.
            n, ends = int(pdf["n"].iat[-1]), _regions(pdf, prefix)
            held = min(int((ends == ends[-1]).sum()), few)
            left = pdf.tail(held)
            yield from _whole(pdf.head(len(pdf) - held) if n <= few else pdf, few, prefix, alike)
        if left is not None:
            yield from _whole(left, few, prefix, alike)

    return run


def _regions(pdf: pd.DataFrame, prefix: int) -> np.ndarray:
    return np.cumsum(common_prefixes(pdf["tree"].to_numpy(), _numbers(pdf["sign"])) < prefix)


def _whole(pdf: pd.DataFrame, few: int, prefix: int, alike: float) -> Iterator[pd.DataFrame]:
    if not len(pdf):
        return
    region, n = _regions(pdf, prefix), pdf["n"].to_numpy()
    torn = (n <= few) & (np.bincount(region)[region] < n)
    if torn.any():
        yield pdf[torn]
    yield _pairs(pdf[~torn], few, prefix, alike)


def _torn(few: int, prefix: int, alike: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pairs(pdf.sort_values(["sign", "node"], ignore_index=True), few, prefix, alike)

    return run


def near_duplicate_documents(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    prefix: int = 3,
    few: int = 16,
    alike: float = 0.55,
) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept, text_hash, stays.

    Words are runs without space, tab or line ends, A-Z in lower case; a document's set holds its distinct shingles of
    ``width`` words, or the whole sequence where it has fewer. Rows link when 100 * intersection >= percent * union; a
    component is named by its smallest id. Null and empty texts have no set and link with nothing; a null id does not
    link either, gets a null component and is kept. Rows that repeat an id are rows of their own. Other columns are
    left out. Shingles are compared by 64-bit hashes. ``stays`` tells rows apart that share an id: it holds for one text of
    each component, that of the smallest id and, among its texts, of the smallest ``text_hash`` (xxhash64 of the text).

    Equal sets are one class, so exact copies never meet. Two classes are candidates when they share ``prefix`` hashes in
    one of 16 trees and agree in ``alike`` of all 64, however many others share the prefix. Two sets at similarity 0.8
    share the prefix in no tree with a chance of 1e-5. Neighbours are confirmed first, then leaves of at most ``few`` classes,
    then all other pairs of regions with more classes than that; after the first step only candidates between different
    components are, as no other can change a component.
    """
    base = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    shape = _schema(base, "text_hash long, n_shingles long, digest binary, sign binary")
    signed = stored(base.mapInPandas(_signed(width), shape), "signatures")
    usable = "id is not null and sign is not null"
    first = F.min(F.struct("id", "text_hash")).alias("rep")
    classes = signed.where(usable).groupBy("digest").agg(first, F.first("sign").alias("sign"), F.first("n_shingles").alias("size"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """The sets of some classes, each made anew from one row's text."""
        wanted = classes.join(nodes, "node").select("node", "rep.id", "rep.text_hash", "digest")
        texts = base.join(wanted, ["id", "text_hash"]).select("node", "text", "digest")
        return stored(texts.mapInPandas(_sets(width), "node long, members array<long>").dropDuplicates(["node"]), "sets")

    pairs, runs = candidates(classes.select("node", "sign"), prefix, few, alike)
    pairs = stored(pairs, "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())

    edges = stored(_confirmed(pairs.where("first"), sets, percent), "edges")
    joined = stored(components(edges), "joined")
    of_a, of_b = joined.toDF("a", "ca"), joined.toDF("b", "cb")
    rest = pairs.where("not first").join(of_a, "a", "left").join(of_b, "b", "left").where("coalesce(ca, a) != coalesce(cb, b)")
    more = stored(_confirmed(rest, sets, percent), "edges")
    edges = edges.unionByName(more)
    joined = stored(components(edges), "joined")

    blocks = _blocks(runs, joined, classes)
    if not blocks.isEmpty():
        members = sets_of(blocks.select("node").distinct()).join(classes.select("node", "sign"), "node")
        over = blocks.join(members, "node").groupBy("tree", "head", "i", "j").applyInPandas(_linked(prefix, alike, percent), "a long, b long")
        joined = components(edges.unionByName(stored(over, "edges")))

    named = classes.join(joined, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component"))
    named = stored(named, "named")
    least = stored(named.groupBy("component").agg(F.min("rep").alias("least")), "least")
    named = stored(named.join(least, "component").select("digest", "least"), "named")
    own = F.struct("id", "text_hash")
    linked = signed.where(usable).join(named, "digest").withColumn("stays", own == F.col("least"))
    linked = linked.select("id", "n_shingles", F.col("least.id").alias("component_id"), "text_hash", "stays")
    rest = signed.where(f"not ({usable})").select("id", "n_shingles", F.col("id").alias("component_id"), "text_hash", F.lit(True).alias("stays"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return linked.unionByName(rest).select(F.col("id").alias(id_col), "n_shingles", "component_id", kept, "text_hash", "stays")


def _schema(base: DataFrame, more: str) -> str:
    return f"id {base.schema['id'].dataType.simpleString()}, {more}"


def candidates(classes: DataFrame, prefix: int, few: int, alike: float) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs ``(a, b, first)`` of neighbours and of leaves in the forest over ``(node, sign)``, and the rows
    ``(tree, head, node)`` of regions with more than ``few`` classes. An empty table gives none of either."""
    turned = "concat(substring(sign, 2 * {s} * tree + 1, 2 * {h}), substring(sign, 1, 2 * {s} * tree))".format(s=STEP, h=HASHES)
    trees = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    # Light rows first: only prefixes that two classes share go on with their signatures.
    light = classes.select("node", "sign", trees.alias("tree")).select("node", "tree", F.expr(f"substring({turned}, 1, {2 * prefix})").alias("head"))
    shared = stored(light.groupBy("tree", "head").agg(F.count("*").alias("n")).where("n > 1"), "heads")
    light = stored(light.join(shared, ["tree", "head"]).select("node", "tree", F.when(F.col("n") > few, F.col("head")).alias("head"), "n"), "branches")
    rows = light.drop("head").join(classes, "node").select("tree", F.expr(turned).alias("sign"), "node", "n")
    parts = max(1, min(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), light.count() // 512))
    rows = rows.repartitionByRange(parts, "tree", "sign", "node").sortWithinPartitions("tree", "sign", "node")
    shape = "a long, b long, first boolean, tree int, sign binary, node long, n long"
    found = stored(rows.mapInPandas(_framed(_neighbours(few, prefix, alike)), shape), "neighbours")
    # A small region that lies in two or more partitions; it has at most ``few`` rows.
    torn = found.where("node is not null").select("tree", F.expr(f"substring(sign, 1, {2 * prefix})").alias("head"), "sign", "node")
    torn = torn.groupBy("tree", "head").applyInPandas(_torn(few, prefix, alike), "a long, b long, first boolean")
    both = found.where("node is null").select("a", "b", "first").unionByName(torn)
    return both.groupBy("a", "b").agg(F.max("first").alias("first")), light.where("head is not null").select("tree", "head", "node")


def _blocks(runs: DataFrame, joined: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows ``(tree, head, i, j, part, node, component)`` of the blocks that compare different components of a run.

    The largest component of a run has parts below 0, all others have parts from 0. Blocks pair two parts of the others,
    equal ones too, or one of either; the largest component is never compared with itself.
    """
    rows = runs.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = stored(rows.join(classes.select("node", "size"), "node"), "runs")
    each = rows.groupBy("tree", "head", "component").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    each = each.groupBy("tree", "head").agg(F.max(F.struct("n", "size", "component")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    each = each.where("n > main.n")

    def parts(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_SHINGLES)).cast("int")

    most = parts(F.col("main.n"), F.col("main.size")).alias("mains"), parts(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size")).alias("others")
    rows = rows.drop("size").join(each.select("tree", "head", F.col("main.component").alias("main"), *most), ["tree", "head"])
    in_main, salt = F.col("component") == F.col("main"), F.xxhash64("node")
    part = F.when(in_main, -1 - F.pmod(salt, F.col("mains"))).otherwise(F.pmod(salt, F.col("others"))).cast("int")
    rows = rows.withColumn("part", part)
    mains, others = F.sequence(-F.col("mains"), F.lit(-1)), F.sequence(F.lit(0), F.col("others") - 1)
    meets = F.when(in_main, others).otherwise(F.concat(mains, others))
    rows = rows.withColumn("other", F.explode(meets))
    return stored(rows.select("tree", "head", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "node", "component"), "blocks")


def _linked(prefix: int, alike: float, percent: int):
    heads = (STEP * np.arange(TREES)[:, None] + np.arange(prefix)) % HASHES

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Confirmed links of a block that join its components; each pair counts in the first tree where it shares the prefix."""
        tree, across = pdf["tree"].iat[0], pdf["i"].iat[0] != pdf["j"].iat[0]
        sign, node, part = _numbers(pdf["sign"]).astype(np.uint16), pdf["node"].to_numpy(), pdf["part"].to_numpy()
        size = pdf["members"].map(len).to_numpy()
        group = np.unique(pdf["component"], return_inverse=True)[1]
        places = np.unique(np.concatenate(pdf["members"].tolist()), return_inverse=True)[1]
        own, marked = np.split(places, np.cumsum(size)[:-1]), np.zeros(places.max() + 1, dtype=np.int8)
        out = []
        for x in range(len(node) - 1):
            y = np.arange(x + 1, len(node))
            y = y[(group[y] != group[x]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))]
            if across:
                y = y[part[y] != part[x]]
            same = sign[y] == sign[x]
            near = same.mean(axis=1) >= alike
            y, same = y[near], same[near]
            y = y[same[:, heads].all(axis=2).argmax(axis=1) == tree]
            if not len(y):
                continue
            marked[own[x]] = 1
            common = np.add.reduceat(marked[np.concatenate([own[k] for k in y])], np.cumsum(size[y]) - size[y], dtype=np.int64)
            marked[own[x]] = 0
            for k in y[100 * common >= percent * (size[x] + size[y] - common)]:
                if group[k] != group[x]:
                    out.append((node[x], node[k]))
                    group[group == group[k]] = group[x]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _framed(run):
    names = ["a", "b", "first", "tree", "sign", "node", "n"]

    def framed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in run(batches):
            yield x.reindex(columns=names).astype({"a": "Int64", "b": "Int64", "first": "boolean", "tree": "Int32", "node": "Int64", "n": "Int64"})

    return framed


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    both = pairs.select("a", "b").join(x, "a").join(y, "b").withColumn("common", F.size(F.array_intersect("x", "y")))
    return both.where(F.col("common") * 100 >= percent * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_documents(documents(spark, sf_dir), width=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
