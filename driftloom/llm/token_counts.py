"""Token counts of whole texts, with overlap resynchronisation for huge documents.

Ordinary documents are counted at once, as the sum over their pieces between stable boundaries. A huge one is cut in one pass
into chunks that overlap, which different tasks encode with offsets. Two neighbours are spliced at a token boundary that both
have inside their overlap and that is proven stable: one between a character that is not white space and white space, which no
word of the pre-tokenizer spans, whatever stands before or after. Where an overlap holds no such boundary, it is widened to
all of its two chunks, which are encoded as one; all other chunks keep their counts.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftloom.llm.bpe import SPACE, read_vocabulary
from driftloom.llm.shared import documents, stored

HUGE, CHUNK, OVERLAP = 40_000, 16_384, 512
_DOUBLE = re.compile(f"[{SPACE}](?: |$)")
_PIECE = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_TURN = regex.compile(f"[^{SPACE}](?=[{SPACE}])")


@lru_cache(maxsize=1)
def _tokenizer(file: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_buffer(file)
    made.no_truncation()
    made.no_padding()
    return made


class _Pieces(dict):
    """Tokens of a piece of text with a prefix before it; a new piece is encoded when asked for, and kept if it is short."""

    def __init__(self, tokenizer, prefix: str, keep: int):
        super().__init__()
        self.encode, self.prefix, self.keep = tokenizer.encode, prefix, keep

    def __missing__(self, piece: str) -> int:
        n = len(self.encode(self.prefix + piece, add_special_tokens=False))
        if len(self) >= self.keep:
            self.clear()
        if len(piece) <= 64:
            self[piece] = n
        return n


class PieceCounter:
    """Tokens of a text as the sum over its pieces between stable boundaries, each counted by the library once.

    No token spans the place between a character that is not white space and white space, so such pieces are independent.
    """

    def __init__(self, tokenizer, keep: int = 500_000):
        self.plain, self.spaced = _Pieces(tokenizer, "", keep // 5), _Pieces(tokenizer, " ", keep)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if _DOUBLE.search(text) or text[0] in " ":
            return sum(map(self.plain.__getitem__, _PIECE.findall(text)))
        # No white space before a space: every space begins a piece.
        first, *rest = text.split(" ")
        return self.plain[first] + sum(map(self.spaced.__getitem__, rest))


@lru_cache(maxsize=1)
def _counter(file: bytes) -> PieceCounter:
    """A Python worker keeps the counter, and the pieces counted so far, from task to task."""
    return PieceCounter(_tokenizer(file))


def _counts(file):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counter(file.value)
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_tokens": [counter.count(t) for t in pdf["text"]]})

    return run


def stable_boundaries(text: str, starts: np.ndarray) -> np.ndarray:
    """Token starts at which white space follows another character."""
    cuts = {m.start() + 1 for m in _TURN.finditer(text)}
    return np.array([s for s in np.unique(starts).tolist() if s in cuts], dtype=np.int64)


PIECE_SCHEMA = "node long, chunk int, upto int, begin long, final boolean, overlap int, text string"
CHUNK_COLUMNS = ["node", "chunk", "upto", "final", "tokens", "head_at", "head_before", "tail_at", "tail_before"]
CHUNK_SCHEMA = "node long, chunk int, upto int, final boolean, tokens long, head_at array<long>, head_before array<long>, tail_at array<long>, tail_before array<long>"


def _cut(step: int, overlap: int):
    """Cut texts into chunks of ``step`` characters and the overlap after them: one by one, or from first to last as ``spans`` tell."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for node, text, wanted in zip(pdf["node"], pdf["text"], pdf["spans"], strict=True):
                n = max(1, -(-len(text) // step))
                spans = [(k, k) for k in range(n)] if wanted is None else [(int(a), int(b)) for a, b in wanted]
                # About a million characters a batch.
                for at in range(0, len(spans), 64):
                    rows = [(node, a, b, a * step, b == n - 1, overlap, text[a * step : (b + 1) * step + overlap]) for a, b in spans[at : at + 64]]
                    yield pd.DataFrame(rows, columns=["node", "chunk", "upto", "begin", "final", "overlap", "text"])

    return run


def _chunk_counts(file):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """For each chunk: its tokens, and the stable boundaries of its first and last overlap with the tokens before each."""
        made = _tokenizer(file.value)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                starts = np.array([a for a, _ in made.encode(r.text, add_special_tokens=False).offsets], dtype=np.int64)
                stable = stable_boundaries(r.text, starts)
                head = stable[stable <= r.overlap] if r.chunk else stable[:0]
                tail = stable[stable >= len(r.text) - r.overlap] if not r.final else stable[:0]
                before = lambda at: np.searchsorted(starts, at, side="left")
                rows.append((r.node, r.chunk, r.upto, bool(r.final), len(starts), (head + r.begin).tolist(), before(head).tolist(), (tail + r.begin).tolist(), before(tail).tolist()))
            yield pd.DataFrame(rows, columns=CHUNK_COLUMNS)

    return run


def _seams(chunks: DataFrame) -> DataFrame:
    """Each chunk with ``cut``, the boundary that it has in common with its predecessor, if any, and the tokens that count twice."""
    left = chunks.where("not final").select("node", (F.col("upto") + 1).alias("chunk"), "tail_at", "tail_before", F.col("tokens").alias("before"))
    both = chunks.drop("tail_at", "tail_before").join(left, ["node", "chunk"], "left").withColumn("common", F.array_intersect("tail_at", "head_at"))
    middle = F.element_at("common", F.greatest(F.lit(1), F.floor((F.size("common") + 1) / 2).cast("int")))
    both = both.withColumn("cut", F.when(F.coalesce(F.size("common"), F.lit(0)) > 0, middle))
    at = lambda where, value: F.element_at(value, F.array_position(where, F.col("cut")).cast("int"))
    # Tokens after the cut in the left chunk and before it in the right one.
    return both.withColumn("twice", F.col("before") - at("tail_at", "tail_before") + at("head_at", "head_before"))


def _failed(chunks: DataFrame) -> DataFrame:
    """``(node, first, upto)``: the longest runs of chunks with no common boundary between neighbours."""
    order = Window.partitionBy("node").orderBy("chunk")
    seams = _seams(chunks).select("node", "chunk", "upto", (F.col("chunk") > 0).alias("inner"), F.col("cut").isNull().alias("open"))
    runs = seams.withColumn("run", F.sum((~(F.col("inner") & F.col("open"))).cast("int")).over(order))
    return runs.groupBy("node", "run").agg(F.min("chunk").alias("first"), F.max("upto").alias("upto"), F.count("*").alias("n")).where("n > 1").drop("n", "run")


def _spliced(chunks: DataFrame) -> DataFrame:
    """``(node, n_tokens)``: a plain sum over chunks and seams."""
    own = F.col("tokens") - F.coalesce("twice", F.lit(0))
    return _seams(chunks).groupBy("node").agg(F.sum(own).alias("n_tokens"))


def token_counts(
    df: DataFrame,
    vocabulary: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    huge: int = HUGE,
    chunk: int = CHUNK,
    overlap: int = OVERLAP,
    limit: int = 512,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Null and empty texts count 0. Null ids and repeated rows are rows like any other; further columns are left out. Texts of
    more than ``huge`` characters are counted by chunks of ``chunk`` characters that overlap by ``overlap``; a text without a stable
    boundary for a whole overlap is encoded in larger parts there, by one task each.
    """
    if not 0 < overlap < chunk <= huge:
        raise ValueError("needs 0 < overlap < chunk <= huge")
    file = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    base = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = base.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = base.schema["id"].dataType.simpleString()
    done = base.where(F.length("text") <= huge).mapInPandas(_counts(file), f"id {kind}, n_bytes long, n_tokens long")

    large = base.where(F.length("text") > huge).withColumn("node", F.monotonically_increasing_id())
    large = stored(large, "huge")

    def counted(texts: DataFrame) -> DataFrame:
        # Chunks of one document go to different tasks.
        pieces = texts.select("node", "text", "spans").mapInPandas(_cut(chunk, overlap), PIECE_SCHEMA)
        return stored(pieces.repartition("node", "chunk").mapInPandas(_chunk_counts(file), CHUNK_SCHEMA), "chunks")

    chunks = counted(large.withColumn("spans", F.lit(None).cast("array<array<int>>")))
    failed = stored(_failed(chunks), "failed")
    wider = counted(large.join(failed.groupBy("node").agg(F.collect_list(F.array("first", "upto")).alias("spans")), "node"))
    gone = (chunks.node == failed.node) & chunks.chunk.between(failed["first"], failed["upto"])
    found = _spliced(stored(chunks.join(failed, gone, "left_anti").unionByName(wider), "chunks"))
    done = done.unionByName(large.join(found, "node").select("id", "n_bytes", "n_tokens"))
    return done.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), byte_vocabulary())
