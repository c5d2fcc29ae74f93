"""The 21 wallet features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import WALLET_FEATURES
from ..session import cut
from .peers import facing_peers

DAY_S = 86_400.0


def leg_union(inputs: DataFrame, outputs: DataFrame, tx: DataFrame | None = None) -> DataFrame:
    """Sending and receiving legs in one table, repeats kept; kept to `tx` when given."""
    both = inputs.withColumn("direction", F.lit("IN")).unionByName(outputs.withColumn("direction", F.lit("OUT")))
    return both if tx is None else both.join(tx.select("txid"), "txid", "left_semi")


def leg_counts() -> list[Column]:
    sends, receives = F.col("direction") == "IN", F.col("direction") == "OUT"
    return [
        F.count("*").alias("tx_count_total"),
        F.count_if(receives).alias("tx_incoming_count"),
        F.count_if(sends).alias("tx_outgoing_count"),
    ]


def leg_flows() -> list[Column]:
    amount_if = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0.0))
    return [amount_if("OUT").alias("total_incoming_btc"), amount_if("IN").alias("total_outgoing_btc")]


def leg_amounts() -> list[Column]:
    return [
        F.avg("amount").alias("avg_tx_amount"),
        F.max("amount").alias("max_tx_amount"),
        F.when(F.count("*") > 1, F.stddev_pop("amount")).otherwise(F.lit(0.0)).alias("std_tx_amount"),
    ]


def leg_tempo() -> list[Column]:
    """Mean gap is the span over n - 1, so no ordering is needed."""
    n = F.count("ts")
    span_s = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6
    return [
        F.when(n > 1, F.try_divide(span_s, n - 1)).otherwise(F.lit(DAY_S)).alias("avg_time_between_txs_sec"),
        F.when(n > 1, F.count("*") / F.greatest(F.lit(1.0), span_s / 3600.0))
        .otherwise(F.count("*").cast("double"))
        .alias("tx_velocity_per_hour"),
    ]


def counterparties(legs: DataFrame) -> DataFrame:
    """Distinct opposite-side addresses per wallet, counted without pairing the legs of a transaction."""
    return facing_peers(legs, "unique_counterparties")


def wallet_transactions(legs: DataFrame) -> DataFrame:
    """Legs per (wallet, transaction), dealt by transaction: what joins on it next needs no other shuffle."""
    return legs.select("address", "txid").repartition("txid").groupBy("address", "txid").agg(F.count("*").alias("legs"))


def graph_degrees(legs: DataFrame) -> DataFrame:
    txs = wallet_transactions(legs).groupBy("address").agg(F.count("*").alias("distinct_txs"))
    return txs.join(counterparties(legs), "address", "left").select(
        "address",
        (F.coalesce("unique_counterparties", F.lit(0)) + F.col("distinct_txs")).alias("graph_degree"),
    )


def _known(c: str) -> Column:
    return F.when(~F.col(c).isin("", "UNKNOWN"), F.col(c))


def _seen(obs: DataFrame) -> DataFrame:
    return obs.groupBy("txid", "src_ip", "country", "asn").agg(F.count("*").alias("seen"))


def _kinds(txs: Column) -> Column:
    """A row's IP, known ASN and known country as (kind, v, txs); `txs` stays with the IP."""
    values = (("ip", F.col("src_ip"), txs), ("asn", _known("asn"), F.lit(0)), ("country", _known("country"), F.lit(0)))
    return F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("v"), x.alias("txs")) for k, v, x in values]))


def _network_cells(legs: DataFrame, obs: DataFrame) -> DataFrame:
    """(wallet, kind, value, n) of the IPs, known ASNs and known countries: both sides are counted before they meet."""
    met = wallet_transactions(legs).join(_seen(obs), "txid").select("address", _kinds(F.lit(0)), (F.col("legs") * F.col("seen")).alias("n"))
    return met.groupBy("address", "kind", "v").agg(F.sum("n").alias("n"))


def _transaction_cells(legs: DataFrame, obs: DataFrame) -> DataFrame:
    """The cells of all wallets, where `txs` adds up to a wallet's transactions: each counts at its first place, or at no IP if never seen."""
    each = Window.partitionBy("txid").orderBy("src_ip", "country", "asn")
    seen = _seen(obs.filter("txid IS NOT NULL")).withColumn("_first", (F.row_number().over(each) == 1).cast("int"))
    met = wallet_transactions(legs).join(seen, "txid", "left")
    rows = met.select("address", _kinds(F.coalesce("_first", F.lit(1))), (F.col("legs") * F.col("seen")).alias("n"))
    return rows.filter("kind = 'ip' OR v IS NOT NULL").groupBy("address", "kind", "v").agg(F.sum("n").alias("n"), F.sum("txs").alias("txs"))


def network_features(cells: DataFrame, *more: Column) -> DataFrame:
    """Distinct IPs, ASNs and countries of each wallet, and the Shannon entropy in bits of its country counts, from count sums alone."""
    held = lambda k: (F.col("kind") == k) & F.col("v").isNotNull()
    c = F.when(held("country"), F.col("n"))
    total = F.sum(c)
    bits = F.log2(total) - F.sum(c * F.log2(c)) / total
    return cells.groupBy("address").agg(
        F.count_if(held("ip")).alias("unique_observed_ips"),
        F.count_if(held("asn")).alias("unique_asns"),
        F.count_if(held("country")).alias("unique_countries"),
        F.when(total.isNotNull(), F.greatest(F.lit(0.0), bits)).alias("foreign_geo_entropy"),
        *more,
    )


def network_spread(cells: DataFrame) -> DataFrame:
    return network_features(cells).drop("foreign_geo_entropy")


def geo_entropy(cells: DataFrame) -> DataFrame:
    """For wallets with a known country."""
    return network_features(cells).filter("foreign_geo_entropy IS NOT NULL").select("address", "foreign_geo_entropy")


def wallet_features(tx: DataFrame, legs: DataFrame, obs: DataFrame) -> DataFrame:
    """address and the 21 features.  All parts aggregate by address and meet on it.

    Each part is written before the next begins, one row for each wallet, so that disk holds what one of them shuffles.
    """
    timed = legs.join(tx.select("txid", "ts"), "txid", "left")
    base = cut(timed.groupBy("address").agg(*leg_counts(), *leg_flows(), *leg_amounts(), *leg_tempo()))
    network = cut(network_features(_transaction_cells(legs, obs), F.sum("txs").alias("_txs")))
    joined = base.join(network, "address").join(cut(counterparties(legs)), "address", "left")
    total = F.greatest(F.lit(1), F.col("tx_count_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    cols = {c: F.col(c) for c in WALLET_FEATURES if c in joined.columns}
    cols.update(
        net_flow_btc=F.col("total_incoming_btc") - F.col("total_outgoing_btc"),
        unique_counterparties=zero("unique_counterparties"),
        fan_in_ratio=F.col("tx_incoming_count") / total,
        fan_out_ratio=F.col("tx_outgoing_count") / total,
        graph_degree=zero("unique_counterparties") + F.col("_txs"),
        graph_in_degree=F.col("tx_incoming_count"),
        graph_out_degree=F.col("tx_outgoing_count"),
        unique_observed_ips=zero("unique_observed_ips"),
        unique_asns=zero("unique_asns"),
        unique_countries=zero("unique_countries"),
        foreign_geo_entropy=F.coalesce("foreign_geo_entropy", F.lit(0.0)),
    )
    return joined.select("address", *[cols[c].cast("double").alias(c) for c in WALLET_FEATURES])
