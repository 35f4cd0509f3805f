"""Registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftloom.llm.bpe import op3_bpe_encode_decode
from driftloom.llm.centroids import OP11_SQL, op11_centroid_clusters
from driftloom.llm.conversations import OP13_SQL, op13_conversation_repair
from driftloom.llm.embedding_dedup import op1_embedding_near_dedup
from driftloom.llm.language_id import op4_language_id
from driftloom.llm.minhash_dedup import op2_minhash_near_dedup
from driftloom.llm.mixing import OP6_SQL, op6_mix_sources
from driftloom.llm.nearest import op8_nearest_vectors
from driftloom.llm.pii import op7_personal_data
from driftloom.llm.repeats import op12_repeated_bytes
from driftloom.llm.secrets import op10_secret_scan
from driftloom.llm.token_counts import op5_token_counts
from driftloom.llm.url_filter import OP9_SQL, op9_url_filter

QUERIES = [
    op1_embedding_near_dedup,
    op2_minhash_near_dedup,
    op3_bpe_encode_decode,
    op4_language_id,
    op5_token_counts,
    op6_mix_sources,
    op7_personal_data,
    op8_nearest_vectors,
    op9_url_filter,
    op10_secret_scan,
    op11_centroid_clusters,
    op12_repeated_bytes,
    op13_conversation_repair,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op6_mix_sources": OP6_SQL, "op9_url_filter": OP9_SQL, "op11_centroid_clusters": OP11_SQL, "op13_conversation_repair": OP13_SQL}
