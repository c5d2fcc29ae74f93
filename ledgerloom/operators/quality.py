"""Data-quality report, field completeness and reject reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import snap
from .ingest import Ledger

COMPLETENESS_FIELDS = [
    "txid", "timestamp", "input_addresses", "output_addresses", "input_amounts",
    "output_amounts", "fee", "src_ip", "geo_country", "asn",
]


def reject_histogram(rejects: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Rows per reason; repeated ids count under a reason that names the id."""
    dup = duplicates.select(F.concat(F.lit("Duplicate TXID: "), "txid").alias("reason"), F.col("copies").alias("n"))
    return rejects.groupBy("reason").agg(F.count("*").alias("n")).unionByName(dup)


def _presence(df: DataFrame) -> dict:
    known = lambda c: F.col(c).isNotNull() & ~F.col(c).isin("", "UNKNOWN")
    return {
        "txid": F.col("txid") != "",
        "timestamp": F.col("ts").isNotNull(),
        "input_addresses": F.size("inputs") > 0,
        "output_addresses": F.size("outputs") > 0,
        "input_amounts": F.size("inputs") > 0,
        "output_amounts": F.size("outputs") > 0,
        "fee": F.col("fee") > 0,
        "src_ip": F.col("src_ip").isNotNull() & (F.col("src_ip") != ""),
        "geo_country": known("country"),
        "asn": known("asn"),
    }


def _counts(ledger: Ledger) -> DataFrame:
    """Rejected, repeated and wallet-class rows: one row."""
    dup = ledger.duplicates.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("d")).select("d").scalar()
    kinds = ledger.class_rows.agg(
        F.struct(F.count_if(F.col("record_type") == "WALLET").alias("w"), F.count("*").alias("all"))
    ).scalar()
    return ledger.rejects.agg(F.count("*").alias("rejected_records")).select(
        "rejected_records",
        dup.cast("long").alias("duplicate_records"),
        kinds["w"].alias("wallet_rows"),
        kinds["all"].alias("class_rows"),
    )


def completeness(ledger: Ledger) -> DataFrame:
    """Percent of all records that carry each field: (field, percent)."""
    tx = ledger.normalized
    present = _presence(tx)
    hits = tx.agg(F.count("*").alias("_valid"), *[F.count_if(cond).alias(f) for f, cond in present.items()])
    one = hits.join(_counts(ledger), F.lit(True)).withColumn(
        "_all",
        F.greatest(
            F.lit(1), F.col("_valid") + F.col("rejected_records") + F.col("duplicate_records") + F.col("class_rows")
        ),
    ).withColumn("input_addresses", F.col("input_addresses") + F.col("wallet_rows"))
    pairs = F.array(
        *[
            F.struct(F.lit(f).alias("field"), snap(F.col(f) / F.col("_all") * 100.0, 1).alias("percent"))
            for f in COMPLETENESS_FIELDS
        ]
    )
    return one.select(F.inline(pairs))


def quality_report(ledger: Ledger) -> DataFrame:
    """One row: counts, distinct entities, time range, volume and mean fee."""
    tx = ledger.normalized
    known = lambda c: F.when(~F.col(c).isin("", "UNKNOWN"), F.col(c))
    base = tx.agg(
        F.count("*").alias("valid_transactions"),
        F.count("txid").alias("unique_txids"),  # one kept row for each id
        F.min("ts").alias("time_min"),
        F.max("ts").alias("time_max"),
        snap(F.coalesce(F.sum(F.greatest("input_total", "output_total")), F.lit(0.0)), 4).alias("total_btc_volume"),
        F.coalesce(F.sum("fee"), F.lit(0.0)).alias("_fees"),
    )
    distinct = tx.agg(
                F.count_distinct("src_ip").alias("unique_src_ips"),
        F.count_distinct(known("country")).alias("unique_countries"),
        F.count_distinct(known("asn")).alias("unique_asns"),
    )
    addresses = tx.select(
        F.explode(F.array_distinct(F.transform(F.concat("inputs", "outputs"), lambda p: p["address"]))).alias("address")
    )
    wallets = addresses.unionByName(ledger.wallet_seeds.select("address")).agg(
        F.count_distinct("address").alias("unique_wallets")
    )
    one = base.join(distinct, F.lit(True)).join(wallets, F.lit(True)).join(_counts(ledger), F.lit(True))
    valid = F.col("valid_transactions") + F.col("class_rows")
    return one.select(
        (valid + F.col("rejected_records") + F.col("duplicate_records")).alias("total_records"),
        valid.alias("valid_records"),
        "rejected_records",
        "duplicate_records",
        "unique_wallets",
        "unique_txids",
        "unique_src_ips",
        "unique_countries",
        "unique_asns",
        "time_min",
        "time_max",
        "total_btc_volume",
        snap(F.col("_fees") / F.greatest(F.lit(1), valid), 6).alias("avg_fee"),
    )
