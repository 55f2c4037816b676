"""Named queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import chat, decontam, langid, lines, minhash, mixing, sharding, simhash, substrings, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op8_fuzzy_lines": lines.query,
    "op1_chat_snapshots": chat.query,
    "op3_toxicity": toxicity.query,
    "op4_simhash": simhash.query,
    "op9_language_bitmask": langid.query,
    "op10_spaced_seeds": decontam.query,
    "op2_source_mixing": mixing.query,
    "op5_contiguous_sharding": sharding.query,
    "op6_dart_minhash": minhash.query,
    "op7_substring_dedup": substrings.query,
}

ORACLE: dict[str, str] = {
    "op1_chat_snapshots": chat.SQL,
    "op2_source_mixing": mixing.SQL,
    "op7_substring_dedup": substrings.SQL,
}
