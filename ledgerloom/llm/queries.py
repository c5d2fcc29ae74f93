"""Registered queries of this subpackage and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import byte_bpe, conversations, debruijn, decontaminate, exact_dedup, fill_middle, language_id, secret_scan, simhash, suffix_dedup, toxicity, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op7_simhash": simhash.op7_simhash,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op1_url_filter": url_filters.op1_url_filter,
    "op4_warc": warc.op4_warc,
    "op3_language_id": language_id.op3_language_id,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op11_debruijn_dedup": debruijn.op11_debruijn_dedup,
    "op12_fill_middle": fill_middle.op12_fill_middle,
    "op13_conversation_repair": conversations.op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op6_secret_scan": secret_scan.OP6_SQL,
    "op1_url_filter": url_filters.OP1_SQL,
    "op4_warc": warc.OP4_SQL,
    "op11_debruijn_dedup": debruijn.OP11_SQL,
    "op12_fill_middle": fill_middle.OP12_SQL,
    "op13_conversation_repair": conversations.OP13_SQL,
}
