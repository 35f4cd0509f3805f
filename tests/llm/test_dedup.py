"""Near duplicates of vectors and documents against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from driftloom.llm.components import components
from driftloom.llm.embedding_dedup import hadamard, near_duplicate_embeddings
from driftloom.llm.minhash_dedup import candidates, common_prefixes, leaves, near_duplicate_documents, shingles, signature

VECTORS = T.StructType(
    [T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("n_links", T.StringType())]
)
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("kept", T.StringType())])


def groups(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    edges = [(5, 9), (9, 7), (7, 7), (1, 2), (2, 3), (3, 4), (4, 1), (20, 21), (None, 3), (5, 9)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {5: 5, 9: 5, 7: 5, 1: 1, 2: 1, 3: 1, 4: 1, 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("ordered", [True, False])
def test_long_chain_of_links(spark, ordered):
    order = list(range(10_000)) if ordered else random.Random(3).sample(range(3000), 3000)
    got = components(spark.createDataFrame(list(itertools.pairwise(order)), "a long, b long")).collect()
    assert {r.component for r in got} == {0} and len(got) == len(order)


def test_star_of_links(spark):
    edges = [(5000, k) for k in range(3000)] + [(k, 7000) for k in (3001, 3002)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(k, 0) for k in [*range(3000), 5000]} | {(k, 3001) for k in (3001, 3002, 7000)}


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)


@pytest.fixture(scope="module")
def vector_rows():
    rng = np.random.default_rng(1)
    base = rng.normal(size=(6, 24))
    rows = []
    for k in range(240):
        x = base[k % 6] * rng.uniform(0.5, 2) + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.25])
        rows.append((k, [float(v) for v in x.astype(np.float32)], int(k % 2)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [0.0] * 24, 0), (304, [float("nan")] * 24, 0), (305, [None, *rows[0][1][1:]], 0)]
    rows += [(306, rows[0][1], None), (307, [], 0), (308, rows[0][1][:10], 0), (309, [float("inf"), *rows[0][1][1:]], 0), (None, rows[0][1], 0), (0, rows[0][1], 0)]
    return [(*r, "clash") for r in rows]


@pytest.mark.parametrize("block_rows", [1024, 16])
def test_embeddings_equal_brute_force(spark, vector_rows, block_rows):
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])

    good = [r for r in vector_rows if usable(r)]
    unit = [np.array(r[1]) / np.linalg.norm(r[1]) for r in good]
    links = [(i, j) for i, j in itertools.combinations(range(len(good)), 2) if good[i][2] == good[j][2] and len(good[i][1]) == len(good[j][1]) and unit[i] @ unit[j] >= 0.98]
    root, degree = groups(len(good), links), np.bincount(np.array(links).ravel(), minlength=len(good))
    least = {k: min(good[i][0] for i in range(len(good)) if root[i] == k) for k in set(root)}
    want = [(r[0], int(degree[i]), least[root[i]], r[0] == least[root[i]]) for i, r in enumerate(good)]
    want += [(r[0], 0, r[0], True) for r in vector_rows if not usable(r)]
    got = near_duplicate_embeddings(spark.createDataFrame(vector_rows, VECTORS), block_rows=block_rows)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_vectors(spark):
    assert near_duplicate_embeddings(spark.createDataFrame([], VECTORS)).count() == 0


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()) + str(rng.randint(0, 400)) for _ in range(n)]


@pytest.fixture(scope="module")
def document_rows():
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        text = words(rng, 80)
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = "w" + str(rng.randint(0, 10**6))
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[0].replace(" ", "\t\n"), "", " \n", "one", "ONE", "one two", "two one", "ünïcode wörds hier sïnd", "x " * 5000, "x " * 5001, " ".join(words(rng, 30_000))]
    rows = list(enumerate(texts)) + [(1000, None), (1001, None), (None, texts[0]), (5, texts[5])]
    return [(*r, "clash") for r in rows]


def shingle_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width", [4, 5])
def test_documents_equal_brute_force(spark, document_rows, width):
    sets = [shingle_set(r[1], width) for r in document_rows]
    use = [i for i, r in enumerate(document_rows) if r[0] is not None and sets[i]]
    links = [(i, j) for i, j in itertools.combinations(use, 2) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = groups(len(document_rows), links)
    least = {k: min(document_rows[i][0] for i in use if root[i] == k) for k in {root[i] for i in use}}
    want = []
    for i, r in enumerate(document_rows):
        c = least[root[i]] if i in use else r[0]
        want.append((r[0], len(sets[i]), c, True if r[0] is None else r[0] == c))
    got = near_duplicate_documents(spark.createDataFrame(document_rows, DOCS), width=width).drop("text_hash").collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == sorted(want, key=str)
    assert sorted(r.doc_id for r in got if r.stays and r.doc_id is not None) == sorted({w[0] for w in want if w[3] and w[0] is not None})


def variants(text, n, changes, rng, name):
    """Texts with so many of the words at every sixth place replaced by words of their own."""
    out = []
    for k in range(n):
        copy = list(text)
        for at in rng.sample(range(3, len(text) - 3, 6), changes):
            copy[at] = f"{name}{k}x{at}"
        out.append(copy)
    return out


def test_hub_of_a_thousand_variants(spark):
    # Variants are at 0.845 to the hub and at about 0.71 to each other.
    rng = random.Random(11)
    hub = words(rng, 480)
    rows = [(k + 1, " ".join(t)) for k, t in enumerate([*variants(hub, 1000, 8, rng, "v"), hub])]
    got = near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 1001 and {r.component_id for r in got} == {1} and sum(r.kept for r in got) == 1


def test_pairs_among_many_of_a_template(spark):
    # Pairs are at 0.81; documents of different pairs at about 0.71 or below.
    rng = random.Random(12)
    template = words(rng, 480)
    rows = []
    for k, first in enumerate(variants(template, 700, 8, rng, "v")):
        second = list(first)
        for at in rng.sample([a for a in range(3, 477, 6) if first[a] == template[a]], 10):
            second[at] = f"w{k}x{at}"
        rows += [(2 * k, " ".join(first)), (2 * k + 1, " ".join(second))]
    got = near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(k, k - k % 2) for k in range(1400)}


def test_pages_of_a_template_that_differ_in_one_word(spark):
    # Most of them share one signature.
    page = words(random.Random(13), 1500)
    rows = [(k, " ".join([*page, f"date{k}"])) for k in range(150)]
    got = near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert {r.component_id for r in got} == {0} and len(got) == 150


def test_one_pair_in_each_family_of_a_template(spark):
    # Documents of a family are at about 0.78 or below to the template; one is linked to its partner alone.
    rng, rows, want = random.Random(14), [], set()
    for f in range(6):
        template = words(rng, 480)
        family = variants(template, 299, 11, rng, f"f{f}v")
        partner = list(family[7])
        for at in [a for a in range(3, 477, 6) if partner[a] == template[a]][:10]:
            partner[at] = f"p{f}x{at}"
        texts = [*family, partner]
        rows += [(1000 * f + k, " ".join(t)) for k, t in enumerate(texts)]
        want.add((1000 * f + 299, 1000 * f + 7))
    got = near_duplicate_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got if not r.kept} == want


def test_regions_torn_between_partitions(spark):
    # So few rows a partition that most regions lie in several.
    rng = random.Random(15)
    texts = [t for _ in range(40) for t in variants(words(rng, 480), 3, 3, rng, f"x{rng.random()}")]
    nodes = spark.createDataFrame([(k, signature(shingles(" ".join(t), 5))) for k, t in enumerate(texts)], "node long, sign binary")
    pairs, _ = candidates(nodes, 3, 16, 0.55)
    assert {(r.a, r.b) for r in pairs.collect()} >= {(3 * k + i, 3 * k + j) for k in range(40) for i, j in ((0, 1), (0, 2), (1, 2))}


def test_common_prefixes_and_leaves():
    sign = np.zeros((40, 64), dtype=np.uint16)
    sign[30:, 5] = 1
    tree = np.repeat([0, 1], [35, 5])
    common = common_prefixes(tree, sign)
    assert common[0] == 0 and common[1] == 64 and common[30] == 5 and common[35] == 0
    leaf = leaves(common, 3, 16)
    assert (leaf[:30] == -1).all() and len(set(leaf[30:35])) == 1 and len(set(leaf[35:])) == 1 and leaf[30] != leaf[35]


def test_recall_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, shingle_set(r.text, 4)) for r in df.collect()]
    by_shingle = {}
    for i, (_, s) in enumerate(rows):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    near = {p for at in by_shingle.values() for p in itertools.combinations(at, 2)}
    links = [(a, b) for a, b in near if 100 * len(rows[a][1] & rows[b][1]) >= 80 * len(rows[a][1] | rows[b][1])]
    root = groups(len(rows), sorted(links))
    least = {}
    for i, (k, _) in enumerate(rows):
        least[root[i]] = min(k, least.get(root[i], k))
    got = {r.doc_id: r.component_id for r in near_duplicate_documents(df, width=4).collect()}
    assert got == {k: least[root[i]] for i, (k, _) in enumerate(rows)} and len(links) > 10


def test_empty_documents(spark):
    assert near_duplicate_documents(spark.createDataFrame([], DOCS)).count() == 0
