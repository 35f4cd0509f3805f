"""Removal of repeated bytes against counting every 400-byte string."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from driftloom.llm import repeats
from driftloom.llm.repeats import cells, op12_repeated_bytes, remove_repeats, unpack

SF = "/root/testdata/sf0.001"


def plain(rows):
    """{id: (n_bytes, n_removed, n_spans, kept_sha256)} in a list, as ids may repeat."""
    bodies = [(i, (text or "").encode()) for i, text, *_ in rows]
    seen = Counter(b[k : k + 400] for _, b in bodies for k in range(len(b) - 399))
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b) + 1, dtype=int)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = 1
        runs = int((np.diff(gone, prepend=0) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, schema="doc_id long, text string, body string", **more):
    return sorted(map(tuple, remove_repeats(spark.createDataFrame(rows, schema), **more).collect()), key=str)


def texts(seed):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "dèlta", "eps", "zeta", "eta", "日本", "x"]
    fresh = lambda n: " ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(n))
    passage, exact, short = fresh(60), fresh(200), fresh(30)
    return [
        *[fresh(rng.randrange(20)) + passage + fresh(rng.randrange(40)) for _ in range(12)],
        *[exact] * 3,
        exact.replace("a", "A", 2),
        exact[:399],
        exact[:400],
        exact[100:520],
        short + fresh(30),
        short + fresh(30),
        "q" * 1500,
        "q" * 401,
        "r" * 400,
        "ab" * 300,
        "0123456789abcdefghijkl " * 40,
        passage + fresh(5) + passage,
        *[passage[:n] + fresh(3) for n in (380, 398, 399, 400, 401, 402, 420)],
        *[fresh(3) + passage[-n:] for n in (399, 400, 401, 430)],
        "",
        None,
        fresh(300),
    ]


@pytest.mark.parametrize(("seed", "block"), [(1, 1 << 18), (2, 300), (3, 97)])
def test_equals_counting(spark, seed, block):
    rows = [(k, t, "clash") for k, t in enumerate(texts(seed))]
    assert got(spark, rows, block=block) == plain(rows)


def test_ids_that_repeat_nulls_and_empty_tables(spark):
    text = texts(4)[0]
    rows = [(None, text, ""), (None, text, ""), (5, text, ""), (5, None, ""), (6, "", "")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == [] and got(spark, [(1, None, ""), (2, "short", "")]) == plain([(1, None), (2, "short")])


def test_hub_of_passages_with_own_surroundings(spark):
    """A passage in hundreds of texts: the ends of its occurrences differ everywhere."""
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = noise(700)
    rows = [(k, noise(rng.randrange(200)) + passage[rng.randrange(3) * 90 :] + noise(rng.randrange(200)), "") for k in range(250)]
    assert got(spark, rows) == plain(rows)


def test_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_repeated_bytes(spark, SF).collect()), key=str) == plain(rows)


def test_cells_hold_each_start_once():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 256, 5000, dtype=np.uint8), np.full(1000, 7, dtype=np.uint8), np.tile(np.arange(20, dtype=np.uint8), 90)):
        at, core, hull = cells(data, 0, len(data) - 399)
        start, _, n = unpack(at)
        covered = np.concatenate([np.arange(a, a + k) for a, k in zip(start, n, strict=True)])
        assert sorted(covered.tolist()) == list(range(len(data) - 399)) and len(core) == len(hull) == len(at)


def test_fingerprints_do_not_depend_on_the_place():
    data = np.frombuffer(b"some text, some text, some more text" * 3, dtype=np.uint8)
    for k in range(4):
        s = repeats._blocks.sums(data, k)
        a, b, c = repeats._blocks.of(s[[9, 20, 21]] - s[[0, 11, 12]], np.array([0, 11, 12]), k)
        assert a == b != c
