"""Mixes, nearest vectors, URL filters and the pipeline."""

import itertools

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from driftloom.llm import mixing, nearest, queries, secrets, url_filter
from test_dedup import groups, shingle_set

SF = "/root/testdata/sf0.001"


def against_sql(spark, df, table, query, sql, op):
    want = duckdb.connect()
    want.register(table, df.toPandas())
    rows = want.sql(sql)
    order = [rows.columns.index(c) for c in op.columns]
    clean = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    assert sorted((clean(r) for r in op.collect()), key=str) == sorted((clean([r[i] for i in order]) for r in rows.fetchall()), key=str), query


MIX = [(k, "w " * (k % 7), f"s{k % 3}", "clash") for k in range(60)] + [(100, "a b", None, ""), (101, None, "s0", ""), (102, "x " * 900, "big", ""), (103, " ", "empty", ""), (5, "q q", "s1", "")]


@pytest.mark.parametrize("rows", [MIX, MIX[:1], MIX[62:63] + MIX[:3]])
def test_mix_equals_sql(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    op = mixing.mixed(df).select("doc_id", "size", "source_size", "target", "taken")
    against_sql(spark, df.drop("taken"), "documents", "op6", mixing.OP6_SQL, op)


def test_mix_meets_targets_and_limits(spark):
    df = spark.createDataFrame([(k, "w " * (1 + k % 9), "abc"[k % 11 % 3]) for k in range(600)], "doc_id long, text string, source string")
    rows = mixing.mixed(df).collect()
    for s in "abc":
        mine = [r for r in rows if r.source == s]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 9
        assert all(r.taken <= 3 * r["size"] for r in mine)
    repeated = mixing.repeated(df).groupBy("doc_id").count().collect()
    times = {r.doc_id: r.taken // r["size"] for r in rows if r.taken}
    assert {r.doc_id: r["count"] for r in repeated} == times
    assert mixing.mixed(df.limit(0)).count() == 0 == mixing.repeated(df.limit(0)).count()


def test_shared_and_null_ids_meet_the_target(spark):
    rows = [(7, f"a b w{k}", "one") for k in range(200)] + [(None, f"c d e w{k}", "two") for k in range(200)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in ("one", "two"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4


def test_equal_rows_meet_the_target(spark):
    """A source of 1,000 equal rows is neither taken whole nor left: its target is met to half a row, also by the mix itself."""
    equal = [(7, "two words", "a")] * 1000
    rows = [*equal, *((k, "one", "b") for k in range(500)), *((k, "x y z", "c") for k in range(300))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mixing.mixed(df).collect()
    for source, row in (("a", 2), ("b", 1), ("c", 3)):
        mine = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= row / 2
    assert len({r.taken for r in got if r.source == "a"}) == 2
    words = sum(2 for r in mixing.repeated(df).collect() if r.source == "a")
    assert words == sum(r.taken for r in got if r.source == "a")


def test_many_sources_are_ranked_in_order(spark):
    names = [f"s{k}" for k in range(500)] + ["Z", "é", "\U0001f600", "\uffff", None]
    df = spark.createDataFrame([(n, k % 9 + 1) for k, n in enumerate(names)], "source string, source_size long")
    got = {r.number: r.source for r in mixing.ranked(df).collect()}
    assert [got[k] for k in range(len(names))] == [*sorted(n for n in names if n is not None), None]
    rows = mixing.targets(df).collect()
    assert abs(sum(r.target for r in rows) - sum(r.source_size for r in rows)) < 1e-6
    assert all(r.target <= 3 * r.source_size for r in rows)


def vectors(spark, n, rng, extra=()):
    rows = [(k, [float(v) for v in rng.normal(size=16).astype(np.float32)], "clash") for k in range(n)]
    return spark.createDataFrame(rows + list(extra), "vec_id long, embedding array<float>, score string"), rows


def exact(rows, k, every=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = (x * x[q]).sum(axis=1)
        keep = ids != ids[q]
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(ids[q])] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist(), strict=True))
    return out


def test_nearest_recall_and_scores(spark):
    bad = [(2000, None, ""), (2001, [0.0] * 16, ""), (2020, [float("nan")] * 16, ""), (None, [1.0] * 16, ""), (2003, [1.0], ""), (2004, [None] * 16, ""), (2005, [], "")]
    df, rows = vectors(spark, 1500, np.random.default_rng(4), bad)
    want, hits, total = exact(rows, 20), 0, 0
    got = {}
    for r in nearest.nearest(df, block_rows=400, query_rows=30).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want)
    for q, found in got.items():
        assert len(found) == 20 and found == sorted(found, key=lambda p: (-p[1], p[0]))
        truth = dict(want[q])
        hits, total = hits + sum(v in truth for v, _ in found), total + 20
        assert all(abs(truth[v] - s) < 1e-12 for v, s in found if v in truth)
    assert hits >= 0.9 * total


def test_nearest_recall_on_given_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = exact([(r.vec_id, r.embedding) for r in df.collect()], 20)
    got = {}
    for r in nearest.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert sum(len(got[q] & {v for v, _ in truth}) for q, truth in want.items()) >= 0.93 * 20 * len(want)


def test_windows_are_counted_as_they_widen():
    x = np.random.default_rng(8).normal(size=(3000, 16))
    block = nearest.Block(x, float(np.linalg.norm(x, axis=1).max()), 64, 10)
    places, scores = block.search(x[5], np.array([5]), nearest.threshold(64, 1.0))
    assert 10 <= len(places) < 1500 and 5 not in places and len(set(places.tolist())) == len(places)
    assert np.allclose(scores, x[places] @ x[5])


def test_ids_with_several_vectors_are_listed_once(spark):
    rows = [(0, [1.0, 0.0], ""), (1, [1.0, 0.0], ""), (1, [2.0, 0.0], ""), (2, [0.0, 1.0], "")]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2.0), (0, 2, 2, 0.0)]


def test_nearest_of_few_is_exact_with_ties(spark):
    rows = [(k, [1.0, float(k // 3)], "") for k in range(12)] + [(0, [1.0, 0.0], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = [(r.vec_id, r.score) for r in nearest.nearest(df).orderBy("rank").collect()]
    assert got == exact(rows[:12], 20)[0] and len(got) == 11
    assert nearest.nearest(df.limit(0)).count() == 0


URLS = [
    "http://" + "a" * 100_000 + ".net/fr/" + "b" * 100_000 + "?x",
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x?y", "https://www.example.com/en/", "https://sub.www.example.com/en/#a", "http://a.net/es/1", "http://net/fr/", "http://a.net/de/", "http://b.net/",
    "http://com/", "http://com", "http://telecom/", "ftp://x.COM/a://b.net/fr/", "http://exämple.com/en/", "http://a.net?es/", "http://example.com/en", "x\n://a.net/fr/q", "http://example.community/en/",
]


def test_urls_equal_sql(spark):
    rows = [(k, u, "clash") for k, u in enumerate(URLS)] + [(None, URLS[5], ""), (5, URLS[5], "")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    op = url_filter.filtered_urls(df)
    against_sql(spark, df.select("page_id", "url"), "pages", "op9", url_filter.OP9_SQL, op)
    assert url_filter.filtered_urls(df.limit(0)).count() == 0


@pytest.mark.parametrize("bits", [1 << 12, 1 << 26])
def test_cascade_is_exact(spark, bits):
    keys = spark.range(900).select(F.concat(F.lit("host"), F.col("id")).alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    cascade = url_filter.Cascade(keys, max_bits=bits, hashes=2)
    assert cascade.shards == (3 if bits < 1 << 20 else 1)
    rows = keys.unionByName(spark.createDataFrame([(None, False), ("host7", True), ("host7", True)], "key string, listed boolean"))
    marked = cascade.mark(rows, "key", "answer")
    assert marked.where("answer != listed").count() == 0 and marked.count() == 903


@pytest.mark.parametrize("listed", [True, False])
def test_cascade_of_all_or_none(spark, listed):
    keys = spark.range(20).select(F.col("id").cast("string").alias("key"), F.lit(listed).alias("listed"))
    cascade = url_filter.Cascade(keys)
    assert {r.answer for r in cascade.mark(keys, "key", "answer").collect()} == {listed}


def test_pipeline_stages(spark):
    """Each stage on the given documents and odd rows, against plain forms of what it decides."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.where("doc_id = 3").first()
    long = " ".join(f"{w}{k % 97}" for k, w in enumerate(first.text.split() * 400))
    odd = [
        (9001, None, "en", "s", 0), (9002, "12 34", "en", "s", 5), (None, first.text, "en", None, 1), (3, first.text, "en", "s", 1), (3, first.text + " more", "en", "s", 1),
        (9003, long, "en", "s", len(long)), (9004, "password = abcdefghijklmnop " + first.text[::-1], "en", "s", 1),
    ]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("text_hash", F.lit("clash")).withColumn("score", F.lit("clash"))
    kept = corpus_pipeline.identify_language(spark, docs, SF)
    ids = [r.doc_id for r in kept.collect()]
    assert 9001 not in ids and 9002 not in ids and len(ids) >= 0.97 * docs.count() - 2

    rows = kept.collect()
    once = corpus_pipeline.drop_near_duplicates(spark, kept.withColumn("kept", F.lit(1)), SF)
    sets = [shingle_set(r.text, 5) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    root = groups(len(rows), links)
    least = {}
    for i, r in enumerate(rows):
        k = 1 << 70 if r.doc_id is None else r.doc_id
        least[root[i]] = min(k, least.get(root[i], k))
    assert sorted(r.doc_id for r in once.collect()) == sorted(least.values()) and once.columns == list(corpus_pipeline.COLUMNS)

    clean = corpus_pipeline.redact_secrets(spark, once, SF)
    scanner = secrets.Scanner(secrets.RULES)
    texts = {r.doc_id: r.text for r in once.collect()}
    want = {k: secrets.masked(t, scanner.spans([t])[0]) for k, t in texts.items()}
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {k: (t, len(t)) for k, t in want.items()}
    assert any("[SECRET]" in t for t in want.values()) and not any("abcdefghijklmnop" in t for t in want.values())

    mix = corpus_pipeline.mix_sources(spark, clean, SF)
    assert mix.columns == list(corpus_pipeline.COLUMNS) == clean.columns
    taken = {r.doc_id: r.taken // r["size"] for r in mixing.mixed(clean).collect() if r.taken}
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == taken

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    counts = {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in want.items()}
    got = corpus_pipeline.encode(spark, mix, SF).collect()
    assert len(got) == mix.count() and all(r.n_tokens == counts[r.doc_id] for r in got)


def test_pipeline_stages_keep_an_empty_table_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_every_operator_is_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "secret_scan", "mix_sources", "bpe_encode_decode"]
