"""Light queries against their SQL; tests/check_all.py runs every query."""

import pytest
from harness import compare, duck

import __spark_entry__ as e

SF = "/root/testdata/sf0.001"
LIGHT = [
    "in1_csv_ledger", "in3_json_ledger", "in4_xml_ledger", "in5_list_columns", "in7_txid_normalised", "in8_tx_features", "in9_amount_lists", "in14_utc_times",
    "in15_epochs", "dq1_reject_reasons", "dq4_amount_alignment", "dq7_geo_enrichment", "dq9_dedupe", "dq14_top_legs", "co2_wallet_union", "co4_exact_match",
    "co5_nearest_window", "co7_tiered_match", "co10_lead_score", "fe7_counterparties", "fe11_geo_entropy", "ml7_contamination_cut", "ml13_evaluation",
    "bp2_leak_free_split", "bp6_tempo_profile", "qs6_triage_fold", "qs10_hourly_volume", "st2_stream_dedupe",
    "co11_evidence", "re7_reason_texts", "re8_plain_reasons", "bp13_supporting_evidence", "bp17_explanation", "ml9_comparison_guard",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", LIGHT)
def test_query_matches_sql(spark, con, name):
    ok, message, _ = compare(spark, con, name, e.queries()[name], e.oracle_sql()[name], SF)
    assert ok, message


def test_entry_returns_rows(spark):
    assert e.entry(spark).count() > 0
