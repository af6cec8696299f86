"""The training-data operators as queries over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rainfold.llm import audio, bpe, chat, decontaminate, host_quality, language, mixing, near_duplicates, phrases, sharding, token_counts, topk, vector_codes
from rainfold.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_telephony_audio": lambda s, d: audio.media_digest(table(s, d, "documents")),
        "op2_byte_bpe": lambda s, d: bpe.encoded_digest(table(s, d, "documents")),
        "op3_language_id": lambda s, d: language.language_report(table(s, d, "documents")),
        "op4_feistel_shards": lambda s, d: sharding.shard_report(table(s, d, "documents")),
        "op5_threshold_topk": lambda s, d: topk.search_report(table(s, d, "embeddings")),
        "op6_mix_sources": lambda s, d: mixing.mix_report(table(s, d, "documents")),
        "op7_chat_format": lambda s, d: chat.chat_report(table(s, d, "conversations")),
        "op8_token_counts": lambda s, d: token_counts.token_count_report(table(s, d, "documents")),
        "op9_host_quality": lambda s, d: host_quality.quality_report(table(s, d, "documents"), table(s, d, "labels")),
        "op10_jaccard_join": lambda s, d: near_duplicates.component_report(table(s, d, "documents")),
        "op11_vector_codes": lambda s, d: vector_codes.code_report(table(s, d, "embeddings")),
        "op12_winnowing": lambda s, d: decontaminate.contamination_report(table(s, d, "documents"), table(s, d, "benchmark")),
        "op13_collocations": lambda s, d: phrases.collocations(table(s, d, "documents")),
    }
