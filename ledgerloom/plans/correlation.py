"""The correlation run over files: features, labels, edges, capture to leads and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import LeadRules, ModelRules
from ..operators.correlate import Correlated, correlate
from ..operators.outliers import heuristic_score, model_matrix, model_scores
from ..session import cut
from ..sources import correlation_files as cf
from ..sources.sinks import write_correlation

MIN_TRAINING_ROWS = 10


def add_model_scores(scored: DataFrame, cfg: ModelRules = ModelRules()) -> DataFrame:
    """Forest scores, or the heuristic when there are too few rows to train on."""
    if scored.limit(MIN_TRAINING_ROWS).count() < MIN_TRAINING_ROWS:
        return heuristic_score(scored)
    return scored.join(model_scores(cut(model_matrix(scored)), cfg), "txid", "left")


def run_correlation(
    spark: SparkSession, folder: str, out: str | None = None, rules: LeadRules = LeadRules(), max_rows: int | None = None
) -> Correlated:
    base = folder.rstrip("/")
    table = cf.read_text_table(spark, f"{base}/txs_features.csv")
    tx = cf.tx_features(table) if max_rows is None else cf.tx_features(cf.with_position(table), max_rows, "file_pos").drop("file_pos")
    result = correlate(
        tx,
        cf.read_edges(spark, f"{base}/AddrTx_edgelist.csv", f"{base}/TxAddr_edgelist.csv", tx),
        cf.read_labels(spark, f"{base}/txs_classes.csv", "tx"),
        cf.read_labels(spark, f"{base}/wallets_classes.csv", "wallet"),
        cf.read_capture(spark, f"{base}/network_data.csv"),
        rules,
        with_model=add_model_scores,
    )
    if out:
        write_correlation(result, out)
    return result
