"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TABLES = ("transactions", "legs", "observations", "rejects", "wallet_seeds", "tx_classes", "duplicates")


def write_ledger(ledger, folder: str, dataset_id: str) -> None:
    """Write the normalised tables of one data set; a rerun replaces that data set only."""
    for name in TABLES:
        df = getattr(ledger, name)
        if df is None:
            continue
        (
            df.withColumn("dataset_id", F.lit(dataset_id))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("dataset_id")
            .parquet(f"{folder.rstrip('/')}/{name}")
        )


def write_correlation(result, folder: str) -> None:
    """Records, leads in rank order and distinct edges, as CSV folders."""
    base = folder.rstrip("/")
    writer = lambda df, name: df.write.mode("overwrite").option("header", True).csv(f"{base}/{name}")
    writer(result.records, "transaction_correlations")
    writer(result.leads.orderBy(F.desc("risk_score"), "txid"), "investigation_leads")
    writer(result.edges.dropDuplicates(), "graph_edges")


def write_features(features: DataFrame, folder: str, dataset_id: str) -> None:
    """One JSON document per wallet."""
    cols = [c for c in features.columns if c != "address"]
    (
        features.select(
            F.col("address").alias("entity_id"),
            F.lit("WALLET").alias("entity_type"),
            F.lit(dataset_id).alias("dataset_id"),
            F.to_json(F.struct(*cols)).alias("features"),
        )
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dataset_id")
        .parquet(f"{folder.rstrip('/')}/entity_features")
    )
