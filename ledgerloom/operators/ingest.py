"""Raw records to a ledger: transactions, legs, observations, rejects and wallet seeds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .checks import class_seed, normalize, with_reject_reason


@dataclass
class Ledger:
    transactions: DataFrame
    legs: DataFrame
    observations: DataFrame
    rejects: DataFrame | None = None
    wallet_seeds: DataFrame | None = None
    normalized: DataFrame | None = None
    tx_classes: DataFrame | None = None
    duplicates: DataFrame | None = None
    class_rows: DataFrame | None = None


def first_by_txid(df: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """First row of each txid, and (txid, extra copies).

    The first position per txid is an aggregate with map-side combine; the kept rows are then
    picked by position, which is unique, so a txid repeated without end never gathers in a task.
    """
    position = F.struct(*order)
    firsts = df.groupBy("txid").agg(F.min(position).alias("_first"), F.count("*").alias("_n"))
    kept = df.join(
        firsts.select(*[F.col(f"_first.{c}").alias(c) for c in order]), order, "left_semi"
    )
    extra = firsts.filter("_n > 1").select("txid", (F.col("_n") - 1).alias("copies"))
    return kept, extra


def legs_of(tx: DataFrame) -> DataFrame:
    """One row per (transaction, direction, address, amount); both lists in one pass."""
    ins = F.transform("inputs", lambda p, i: F.struct(F.lit("IN").alias("direction"), i.cast("int").alias("leg_no"), p["address"].alias("address"), p["amount"].alias("amount")))
    outs = F.transform("outputs", lambda p, i: F.struct(F.lit("OUT").alias("direction"), i.cast("int").alias("leg_no"), p["address"].alias("address"), p["amount"].alias("amount")))
    return tx.select("txid", F.inline(F.concat(ins, outs)))


def top_legs(legs: DataFrame, keep: int = 50) -> DataFrame:
    """The `keep` largest legs per transaction and direction.

    Rank-limited window: each map task keeps at most `keep` rows per group before the shuffle.
    """
    w = Window.partitionBy("txid", "direction").orderBy(F.desc("amount"), "leg_no")
    return legs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep).drop("_r")


def top_pairs(pairs: str, keep: int = 50) -> Column:
    """The same cut on a list held in one record, by its place when amounts tie."""
    placed = F.transform(pairs, lambda p, i: F.struct((-p["amount"]).alias("o"), i.alias("i"), p["address"].alias("address"), p["amount"].alias("amount")))
    cut = F.slice(F.array_sort(placed), 1, keep)
    back = F.transform(cut, lambda p: F.struct(p["address"].alias("address"), p["amount"].alias("amount")))
    return F.when(F.size(pairs) > keep, back).otherwise(F.col(pairs))


def observations_of(tx: DataFrame) -> DataFrame:
    return tx.filter(F.col("src_ip").isNotNull() & (F.col("src_ip") != "")).select(
        "txid", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "country", "asn"
    )


def ingest(
    raw: DataFrame,
    run_time: Column | None = None,
    subnets: DataFrame | None = None,
    order: tuple[str, ...] = ("src_file", "src_pos"),
    keep_legs: int | None = None,
    seen: DataFrame | None = None,
) -> Ledger:
    """Validate, normalise, drop repeats, explode.  Class rows go to label and seed tables.

    All legs are kept unless the caller asks for the `keep_legs` largest of each side.  `seen`: (txid)
    kept by earlier runs; valid transactions with one of those ids count as repeats, and nothing else changes.
    """
    checked = cut(with_reject_reason(raw))  # the raw records are read and validated once; all tables come from here
    valid = checked.filter(F.col("reason").isNull())
    rejects = checked.filter(F.col("reason").isNotNull()).select("record_type", "txid", "reason", *order)
    tx_rows = valid.filter(F.col("record_type") == "TRANSACTION")
    kept, extra = first_by_txid(tx_rows.withColumn("txid", F.trim("txid")), list(order))
    if seen is not None:
        known = seen.select("txid").distinct()
        late = kept.select("txid").join(known, "txid", "left_semi").select("txid", F.lit(1).cast("long").alias("copies"))
        extra = extra.unionByName(late).groupBy("txid").agg(F.sum("copies").alias("copies"))
        kept = kept.join(known, "txid", "left_anti")
    tx = cut(normalize(kept, run_time, subnets))
    listed = tx if keep_legs is None else tx.withColumns({c: top_pairs(c, keep_legs) for c in ("inputs", "outputs")})
    score, anomaly = class_seed("class")
    seeds = (
        valid.filter(F.col("record_type") == "WALLET")
        .groupBy(F.trim("address").alias("address"))
        .agg(F.max_by("class", F.struct(*order)).alias("class"))
        .select("address", "class", score.alias("risk_score"), anomaly.alias("anomaly_score"))
    )
    classes = (
        valid.filter(F.col("record_type") == "TX_CLASS")
        .groupBy(F.trim("txid").alias("txid"))
        .agg(F.max_by("class", F.struct(*order)).alias("class"))
    )
    return Ledger(
        transactions=tx.select("txid", "ts", "fee", "script_type", "input_total", "output_total", "time_assumed"),
        legs=legs_of(listed),
        observations=observations_of(tx),
        rejects=rejects,
        wallet_seeds=seeds,
        normalized=tx,
        tx_classes=classes,
        duplicates=extra,
        class_rows=valid.filter(F.col("record_type") != "TRANSACTION").select("record_type"),
    )


def wallet_rollup(legs: DataFrame, tx: DataFrame) -> DataFrame:
    """Running totals per wallet; `tx_count` counts legs."""
    sent, received = F.col("direction") == "IN", F.col("direction") == "OUT"
    return (
        legs.join(tx.select("txid", "ts"), "txid")
        .groupBy("address")
        .agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            F.round(F.coalesce(F.sum(F.when(received, F.col("amount"))), F.lit(0.0)), 8).alias("total_received"),
            F.round(F.coalesce(F.sum(F.when(sent, F.col("amount"))), F.lit(0.0)), 8).alias("total_sent"),
            F.count("*").alias("tx_count"),
        )
        .withColumn("risk_score", F.lit(0))
        .withColumn("anomaly_score", F.lit(0.0))
    )


def seed_wallets(rollup: DataFrame, seeds: DataFrame, run_time: Column | None = None) -> DataFrame:
    """Add wallets known only from class rows, and their seed scores."""
    at = F.current_timestamp() if run_time is None else run_time
    delta = seeds.select(
        "address",
        at.alias("first_seen"),
        at.alias("last_seen"),
        F.lit(0.0).alias("total_received"),
        F.lit(0.0).alias("total_sent"),
        F.lit(0).cast("long").alias("tx_count"),
        "risk_score",
        "anomaly_score",
    )
    return merge_wallets(rollup, delta)


def merge_wallets(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Fold new totals into old ones; a score is replaced only by a positive score."""
    o, d = old.alias("o"), delta.alias("d")
    add = lambda c, zero: F.coalesce(F.col(f"o.{c}"), F.lit(zero)) + F.coalesce(F.col(f"d.{c}"), F.lit(zero))
    newer = lambda c: F.when(F.col(f"d.{c}") > 0, F.col(f"d.{c}")).otherwise(F.coalesce(F.col(f"o.{c}"), F.col(f"d.{c}")))
    return o.join(d, F.col("o.address") == F.col("d.address"), "full_outer").select(
        F.coalesce("o.address", "d.address").alias("address"),
        F.least("o.first_seen", "d.first_seen").alias("first_seen"),
        F.greatest("o.last_seen", "d.last_seen").alias("last_seen"),
        F.round(add("total_received", 0.0), 8).alias("total_received"),
        F.round(add("total_sent", 0.0), 8).alias("total_sent"),
        add("tx_count", 0).alias("tx_count"),
        newer("risk_score").alias("risk_score"),
        newer("anomaly_score").alias("anomaly_score"),
    )


def purge(ledger: dict[str, DataFrame], dataset_id: str) -> dict[str, DataFrame]:
    """Drop one data set from every table, then wallets no remaining leg refers to.

    The dataset filter is on the partition column, so the files of other data sets are all that is read.
    """
    left = {
        name: df.filter(~F.col("dataset_id").eqNullSafe(dataset_id))
        for name, df in ledger.items()
        if "dataset_id" in df.columns
    }
    used = left["legs"].select("address")
    left["wallets"] = ledger["wallets"].join(used, "address", "left_semi")
    return {**{n: df for n, df in ledger.items() if n not in left}, **left}


def list_datasets(datasets: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return datasets.orderBy(F.desc("created_at"), "dataset_id").offset(offset).limit(limit)


def dataset_status(datasets: DataFrame) -> DataFrame:
    return datasets.groupBy("status").agg(F.count("*").alias("datasets"))
