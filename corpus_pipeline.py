"""A corpus pipeline: language, near duplicates, secrets, mix of sources, tokens.

Each stage takes the documents that the one before it kept and returns documents again; the last returns one row of digests
for each row of the mix. Stages are written as Parquet and read again, so a lost executor costs a stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm import bpe, language_id, minhash_dedup, mixing, secrets
from driftloom.llm.shared import documents, stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document whose best language has a lower mean probability than this is rejected, and so is one without a letter.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: null texts, texts without a letter and unclear texts go.

    Null and repeated ids are rows like any other, very long texts are read whole, columns beside those of documents are
    left out, and an empty table stays empty. The same holds for each stage below unless it says otherwise.
    """
    found = language_id.identify(docs, language_id.fitted(docs), carry=COLUMNS[1:])
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, similarity 0.8): the one with the smallest id.

    Of rows that share an id, texts count one by one: the text with the smallest hash stands for the id. Rows that repeat an
    id and a text count once. Rows without an id take part with a number from their text that is above all others, so that
    they go where a document with an id stays. Texts without words are in no group and stay.
    """
    rows = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    beyond = F.lit(1 << 62) + F.pmod(F.xxhash64("text", F.lit("id")), F.lit(1 << 62))
    rows = rows.withColumn("number", F.coalesce(F.col("doc_id").cast("long"), beyond))
    stay = minhash_dedup.near_duplicate_documents(rows, id_col="number").where("stays").select("number", "text_hash").distinct()
    return rows.join(stay, ["number", "text_hash"], "left_semi").dropDuplicates(["number", "text_hash"]).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret masked; n_chars follows the new text and is null for a null text."""
    found = secrets.scan_secrets(docs, carry=("lang", "source"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; rows without words are not taken. A null source is one source."""
    return mixing.repeated(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row of the mix; a null text counts as empty.

    Workers hold nothing over, as other stages share their memory.
    """
    return bpe.digests(bpe.encode_documents(docs, bpe.word_vocabulary(), keep=100_000, hold=False))


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("bpe_encode_decode", encode),
]

#: SQL can't express the network, the forest and the merges; tests hold each stage against a plain form instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
