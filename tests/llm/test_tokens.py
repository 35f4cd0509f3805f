"""Encoding and counting against the tokenizers library."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from driftloom.llm import bpe, token_counts

TEXTS = [
    None, "", " ", "\n\n", "a", "Hello, World's  END", "ΑΣ ΣΑΣ Σ", "İstanbul", "été café", "x\x1cy \x1f z", "<|endoftext|>",
    "a<|endoftext|>b <|startoftext|> <|ENDOFTEXT|>", "12345 6²③", "日本語 テキスト　全角", "🙂🙂 👩‍👩‍👧", "don't we'll I'M", "tab\tand\xa0nbsp em",
    "a" * 300, "word " * 40 + "end", "### $$$ %%%", "  lead and trail  ", "​ zero﻿width", "mañanã",
]
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(None, "no id", None), (1, "", "again")]
    return spark.createDataFrame(rows, SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_encode_equals_library(docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        want.append((row.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = [tuple(r) for r in bpe.digests(bpe.encode_documents(docs, bpe.word_vocabulary())).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_small_caches_change_nothing():
    file = bpe.read_vocabulary(bpe.word_vocabulary())
    small, large = bpe.WordBpe(file, keep=2), bpe.WordBpe(file)
    for t in TEXTS:
        assert small.encode(t or "") == large.encode(t or "")


@pytest.mark.parametrize(("huge", "chunk", "overlap"), [(40_000, 16_384, 512), (40, 16, 4), (25, 10, 1)])
def test_counts_equal_library(docs, huge, chunk, overlap):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [(r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect()]
    got = token_counts.token_counts(docs, token_counts.byte_vocabulary(), huge=huge, chunk=chunk, overlap=overlap)
    assert sorted((tuple(r)[:3] for r in got.collect()), key=str) == sorted(want, key=str)


def test_huge_document_is_spliced(spark):
    text = "The <|endoftext|> quick\n\n  brown fox don't " * 3000 + "x" * 50_000 + " end"
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(df, token_counts.byte_vocabulary(), chunk=2000, overlap=64).collect()
    assert got == [(7, len(text), len(library.encode(text, add_special_tokens=False).ids), True)]


def test_only_failed_seams_are_encoded_again(spark):
    text = "ab " * 700 + "x" * 5000 + " cd" * 700 + "y" * 2000
    df = spark.createDataFrame([(1, text), (1, text), (2, "ef " * 3000)], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = token_counts.token_counts(df, token_counts.byte_vocabulary(), huge=2000, chunk=1000, overlap=50).collect()
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in (text, text, "ef " * 3000)]
    assert sorted(r.n_tokens for r in got) == sorted(want)
    chunks = spark.createDataFrame(
        [(7, 0, 0, False, 5, [], [], [90], [4]), (7, 1, 1, False, 5, [90], [1], [190], [4]), (7, 2, 2, False, 5, [200], [1], [], []), (7, 3, 3, True, 5, [305], [1], [], [])],
        token_counts.CHUNK_SCHEMA,
    )
    assert [tuple(r) for r in token_counts._failed(chunks).collect()] == [(7, 1, 3)]


def test_very_long_text_round_trip(spark):
    text = "The quick\n\n  brown fox don't " * 40_000 + "z" * 30_000
    df = spark.createDataFrame([(7, text)], "doc_id long, text string")
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = library.encode(text, add_special_tokens=False).ids
    got = bpe.digests(bpe.encode_documents(df, bpe.word_vocabulary())).collect()
    assert tuple(got[0])[:4] == (7, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert bpe.encode_documents(df, bpe.word_vocabulary()).count() == 0
    assert token_counts.token_counts(df, token_counts.byte_vocabulary()).count() == 0


def test_limit(spark):
    df = spark.range(1).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"))
    assert token_counts.token_counts(df, token_counts.byte_vocabulary(), limit=2).first().over_limit
