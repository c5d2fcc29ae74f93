"""Behaviour profiles of wallets from their own past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import snap
from ..config import STORED_PROFILE, ProfileRules
from ..session import cut, kept
from .peers import distinct_peers, others_met
from .spread import SPLIT_OVER, quantiles, tempo

DAY_S = 86_400.0


def wallet_events(tx: DataFrame, legs: DataFrame) -> DataFrame:
    """One event per leg: address, txid, ts, direction, amount, leg_no and the leg counts of the transaction."""
    sizes = legs.groupBy("txid").agg(
        F.count_if(F.col("direction") == "IN").alias("fan_in"), F.count_if(F.col("direction") == "OUT").alias("fan_out")
    )
    return (
        legs.join(tx.select("txid", "ts"), "txid")
        .join(sizes, "txid")
        .select(
            "address", "txid", "ts", "direction", "leg_no", "amount",
            F.greatest(F.lit(1), F.col("fan_in")).alias("fan_in"),
            F.greatest(F.lit(1), F.col("fan_out")).alias("fan_out"),
        )
    )


def event_order() -> Column:
    return F.struct("ts", "txid", "direction", "leg_no")


def without_latest(events: DataFrame, min_history: int = 3) -> DataFrame:
    """Drop each wallet's latest event if it has more than `min_history`.

    The latest event is a max with map-side combine, not a sorted window, so a busy wallet is not
    gathered.  Transactions and leg numbers identify it, and the anti join is on those.
    """
    events = kept(events, "events")
    last = (
        events.groupBy("address")
        .agg(F.max(event_order()).alias("_last"), F.count("*").alias("_n"))
        .filter(F.col("_n") > min_history)
        .select("address", *[F.col(f"_last.{c}").alias(c) for c in ("txid", "direction", "leg_no")])
    )
    return events.join(last, ["txid", "direction", "leg_no", "address"], "left_anti")


def before(events: DataFrame, as_of: DataFrame | Column) -> DataFrame:
    """Events strictly before T; events without a time stay.  T is a column or (address, as_of) rows."""
    if isinstance(as_of, Column):
        return events.filter((F.col("ts") < as_of) | F.col("ts").isNull())
    cut = events.join(as_of.select("address", "as_of"), "address", "left")
    keep = F.col("as_of").isNull() | F.col("ts").isNull() | (F.col("ts") < F.col("as_of"))
    return cut.filter(keep).drop("as_of")


def reliability(n: Column | str, cfg: ProfileRules = STORED_PROFILE) -> Column:
    c = F.col(n) if isinstance(n, str) else n
    return (
        F.when(c < cfg.min_history, "INSUFFICIENT_HISTORY").when(c >= cfg.high_from, "HIGH").otherwise("MEDIUM")
    )


def amount_profile(events: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """Mean, median, population std and sum of sent ('input'), received ('output') and all amounts."""
    side = lambda d: F.when(F.col("direction") == d, F.col("amount"))

    def stats(d: str, name: str) -> list[Column]:
        c = side(d)
        return [
            snap(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(f"avg_{name}_amount"),
            snap(F.when(F.count(c) > 1, F.stddev_pop(c)).otherwise(F.lit(0.0)), 4).alias(f"{name}_amount_dispersion"),
            snap(F.coalesce(F.sum(c), F.lit(0.0)), 4).alias(f"total_{name}_value"),
        ]

    every = F.when(F.count("*") > 1, F.stddev_pop("amount")).otherwise(F.lit(0.0))
    base = events.groupBy("address").agg(
        *stats("IN", "input"), *stats("OUT", "output"), snap(every, 4).alias("amount_dispersion")
    )
    medians = quantiles(events, ["address", "direction"], "amount", {"m": 0.5}, split_over)
    pick = lambda d, name: F.max(F.when(F.col("direction") == d, F.col("m"))).alias(f"median_{name}_amount")
    flat = medians.groupBy("address").agg(pick("IN", "input"), pick("OUT", "output"))
    zero = lambda c: snap(F.coalesce(F.col(c), F.lit(0.0)), 4).alias(c)
    return base.join(flat, "address", "left").select(
        *base.columns, zero("median_input_amount"), zero("median_output_amount")
    )


def tempo_profile(events: DataFrame, cfg: ProfileRules = STORED_PROFILE) -> DataFrame:
    """Velocity, frequency, mean gap, and velocity range from the extreme gaps."""
    j = tempo(events.select("address", F.unix_micros("ts").alias("t")), ["address"], "t")
    span_s = (F.col("hi") - F.col("lo")) / 1e6
    many = F.col("n") > 1
    speed = lambda gap: 1.0 / F.greatest(F.lit(0.01), F.col(gap) / 3600.0)
    pick = lambda c, alone: F.when(many, c).otherwise(F.lit(alone))
    hours = F.greatest(F.lit(cfg.min_span_hours), span_s / 3600.0)
    return j.select(
        "address",
        snap(pick(F.col("n") / hours, 1.0), 2).alias("transaction_velocity"),
        snap(pick(F.col("n") / F.greatest(F.lit(1.0 / 24.0), span_s / DAY_S), 1.0), 2).alias("transaction_frequency"),
        snap(pick(F.try_divide(span_s, F.col("n") - 1), DAY_S), 1).alias("avg_inter_transaction_time"),
        snap(pick(speed("max_gap_s"), 0.5), 2).alias("min_velocity"),
        snap(pick(speed("min_gap_s"), 1.5), 2).alias("max_velocity"),
        F.timestamp_micros("lo").alias("first_seen"),
        F.timestamp_micros("hi").alias("last_seen"),
        snap(pick(hours, 1.0), 2).alias("active_duration_hours"),
    )


def flow_profile(events: DataFrame, legs: DataFrame) -> DataFrame:
    """Mean fan-in and fan-out per event and distinct opposite-side peers."""
    fans = events.groupBy("address").agg(
        snap(F.avg("fan_in"), 2).alias("typical_fan_in"), snap(F.avg("fan_out"), 2).alias("typical_fan_out")
    )
    other = F.when(F.col("direction") == "IN", "OUT").otherwise("IN")
    theirs = legs.select("txid", other.alias("direction"), F.col("address").alias("peer"))
    peers = distinct_peers(events, theirs, ["txid", "direction"], "unique_counterparty_count")
    return fans.join(peers, "address", "left").withColumn(
        "unique_counterparty_count", F.coalesce("unique_counterparty_count", F.lit(0))
    )


def _samples(cells: DataFrame, kind: str, n: int, name: str) -> DataFrame:
    w = Window.partitionBy("address").orderBy("v")
    few = cells.filter(F.col("kind") == kind).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    return few.groupBy("address").agg(F.array_sort(F.collect_list("v")).alias(name))


def network_cells(events: DataFrame, obs: DataFrame) -> DataFrame:
    """Distinct (address, kind, value) of what was observed on the wallet's transactions."""
    seen = obs.select("txid", "src_ip", F.col("src_port").cast("string").alias("src_port"), "asn", "country").distinct()
    values = (("ip", "src_ip"), ("port", "src_port"), ("asn", "asn"), ("country", "country"))
    cells = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("v")) for k, c in values]))
    # an observation meets its wallets as one row, not as one for each kind
    met = events.select("address", "txid").distinct().join(seen, "txid").select("address", cells)
    return met.filter(F.col("v").isNotNull() & ~F.col("v").isin("", "UNKNOWN", "0")).distinct()


def network_profile(events: DataFrame, obs: DataFrame) -> DataFrame:
    """Distinct IPs, ports, ASNs, countries, small samples of each, and events with any network data."""
    cells = network_cells(events, obs)
    count = lambda k, name: F.count_if(F.col("kind") == k).alias(name)
    counts = cells.groupBy("address").agg(
        count("ip", "unique_observed_ips"), count("port", "unique_ports"), count("asn", "unique_asns"), count("country", "unique_countries")
    )
    with_net = (
        events.join(obs.select("txid").distinct(), "txid", "left_semi")
        .groupBy("address")
        .agg(F.count("*").alias("network_observation_count"))
    )
    return (
        counts.join(with_net, "address", "left")
        .join(_samples(cells, "ip", 10, "observed_ips"), "address", "left")
        .join(_samples(cells, "asn", 5, "asns"), "address", "left")
        .join(_samples(cells, "country", 5, "countries"), "address", "left")
    )


def profiles(
    events: DataFrame, legs: DataFrame, obs: DataFrame, cfg: ProfileRules = STORED_PROFILE, all_wallets: DataFrame | None = None
) -> DataFrame:
    """One profile per wallet from the given (already cut) events."""
    counts = events.groupBy("address").agg(F.count("*").alias("observation_count"))
    if all_wallets is not None:
        counts = all_wallets.select("address").join(counts, "address", "left").withColumn(
            "observation_count", F.coalesce("observation_count", F.lit(0))
        )
    enough = F.col("observation_count") >= cfg.min_history
    return (
        counts.withColumn("has_sufficient_history", enough)
        .withColumn("profile_reliability", reliability("observation_count", cfg))
        .join(amount_profile(events), "address", "left")
        .join(tempo_profile(events, cfg), "address", "left")
        .join(flow_profile(events, legs), "address", "left")
        .join(network_profile(events, obs), "address", "left")
        .withColumn(
            "temporal_statistics",
            F.struct("first_seen", "last_seen", "active_duration_hours", F.col("max_velocity").alias("peak_velocity_per_hour")),
        )
    )


def stored_profiles(tx: DataFrame, legs: DataFrame, obs: DataFrame, cfg: ProfileRules = STORED_PROFILE) -> DataFrame:
    """Profiles learned without each wallet's latest event; the events feed five parts, so they are written once."""
    return profiles(kept(without_latest(wallet_events(tx, legs), cfg.min_history), "prior"), legs, obs, cfg)


def on_demand_baseline(tx: DataFrame, legs: DataFrame, min_history: int = 3, high_from: int = 6) -> DataFrame:
    """Per-wallet baseline over distinct transactions, the latest left out.

    A wallet on both sides of a transaction contributes one sent and one received amount (the last leg
    of each side), and velocities use a one-hour floor.
    """
    side = lambda d, c: F.max_by(F.when(F.col("direction") == d, F.col(c)), F.when(F.col("direction") == d, F.col("leg_no")))
    per_tx = (
        legs.join(tx.select("txid", "ts"), "txid")
        .groupBy("address", "txid", "ts")
        .agg(side("IN", "amount").alias("sent"), side("OUT", "amount").alias("received"))
    )
    last = cut(
        per_tx.groupBy("address").agg(F.max(F.struct("ts", "txid")).alias("_l"), F.count("*").alias("total_recorded_transactions"))
    )
    cutting = last.filter(F.col("total_recorded_transactions") > min_history).select("address", F.col("_l.txid").alias("txid"))
    rows = kept(per_tx.join(cutting, ["address", "txid"], "left_anti"), "past")
    both = rows.select(
        "address",
        F.inline(F.array(F.struct(F.lit("S").alias("side"), F.col("sent").alias("amount")), F.struct(F.lit("R").alias("side"), F.col("received").alias("amount")))),
    ).filter(F.col("amount").isNotNull())
    r4 = lambda c: snap(c, 4)
    amounts = cut(both.groupBy("address").agg(
        r4(F.avg("amount")).alias("avg_amount"),
        r4(F.when(F.count("*") > 1, F.stddev_pop("amount")).otherwise(F.lit(0.0))).alias("std_amount"),
        r4(F.max("amount")).alias("max_amount"),
        r4(F.min("amount")).alias("min_amount"),
        F.avg(F.when(F.col("side") == "S", F.col("amount"))).alias("_avg_out"),
        F.count_if(F.col("side") == "R").alias("_in"),
        F.count_if(F.col("side") == "S").alias("_out"),
        F.avg("amount").alias("_avg_all"),
    ))
    med_out = cut(quantiles(both.filter("side = 'S'"), ["address"], "amount", {"_mo": 0.5}))
    med_all = cut(quantiles(both, ["address"], "amount", {"_ma": 0.5}))
    pace = cut(tempo(rows.select("address", F.unix_micros("ts").alias("t")), ["address"], "t"))
    span_s, many = (F.col("hi") - F.col("lo")) / 1e6, F.col("n") > 1
    speed = lambda gap: 1.0 / F.greatest(F.lit(0.01), F.col(gap) / 3600.0)
    pick = lambda c, alone: F.when(many, c).otherwise(F.lit(alone))
    peers = cut(others_met(rows, legs, tx, cutting, "counterparties_count"))
    counts = rows.groupBy("address").agg(F.count("*").alias("_rows"))
    total = F.greatest(F.lit(1), F.col("_in") + F.col("_out"))
    j = (
        last.select("address", "total_recorded_transactions")
        .join(counts, "address", "left")
        .join(amounts, "address", "left")
        .join(med_out, "address", "left")
        .join(med_all, "address", "left")
        .join(pace, "address", "left")
        .join(peers, "address", "left")
    )
    return j.select(
        "address",
        F.coalesce("_rows", F.lit(0)).alias("observation_count"),
        "total_recorded_transactions",
        (F.col("total_recorded_transactions") >= min_history).alias("has_sufficient_history"),
        F.when(F.col("total_recorded_transactions") < min_history, "INSUFFICIENT_HISTORY")
        .when(F.col("_rows") >= high_from, "HIGH")
        .otherwise("MEDIUM")
        .alias("profile_reliability"),
        "avg_amount", "std_amount", "max_amount", "min_amount",
        r4(F.coalesce("_mo", "_ma")).alias("median_output_amount"),
        r4(F.coalesce("_avg_out", "_avg_all")).alias("avg_output_amount"),
        snap(pick(F.col("n") / F.greatest(F.lit(1.0), span_s / 3600.0), 1.0), 2).alias("avg_velocity_per_hour"),
        snap(pick(speed("max_gap_s"), 0.5), 2).alias("min_velocity_per_hour"),
        snap(pick(speed("min_gap_s"), 1.5), 2).alias("max_velocity_per_hour"),
        snap(pick(F.try_divide(span_s, F.col("n") - 1), DAY_S), 1).alias("avg_time_between_txs_sec"),
        F.coalesce("counterparties_count", F.lit(0)).alias("counterparties_count"),
        snap(F.col("_in") / total, 2).alias("fan_in_ratio"),
        snap(F.col("_out") / total, 2).alias("fan_out_ratio"),
    )


# The one baseline schema that validation reads.
BASELINE_COLUMNS = [
    "has_sufficient_history", "observation_count", "profile_reliability", "median_output_amount",
    "avg_output_amount", "std_amount", "max_amount", "avg_velocity_per_hour", "min_velocity_per_hour",
    "max_velocity_per_hour", "avg_time_between_txs_sec", "counterparties_count",
]


def baseline_of_profile(stored: DataFrame) -> DataFrame:
    """A stored profile in the baseline schema; its peak amount is 1.5 times a typical amount."""
    nz = lambda c: F.when(F.col(c) != 0, F.col(c))
    typical = F.coalesce(nz("median_output_amount"), nz("avg_output_amount"), nz("median_input_amount"), nz("avg_input_amount"))
    return stored.select(
        "address",
        "has_sufficient_history",
        "observation_count",
        "profile_reliability",
        "median_output_amount",
        "avg_output_amount",
        F.col("output_amount_dispersion").alias("std_amount"),
        F.coalesce(typical * 1.5, F.lit(1.0)).alias("max_amount"),
        F.col("transaction_velocity").alias("avg_velocity_per_hour"),
        F.col("min_velocity").alias("min_velocity_per_hour"),
        F.col("max_velocity").alias("max_velocity_per_hour"),
        F.col("avg_inter_transaction_time").alias("avg_time_between_txs_sec"),
        F.col("unique_counterparty_count").alias("counterparties_count"),
    )


def resolve_baseline(
    entities: DataFrame, override: DataFrame | None = None, stored: DataFrame | None = None, computed: DataFrame | None = None
) -> DataFrame:
    """Per entity: the override, else the stored profile, else the computed one, else no history."""
    out = entities.select("address")
    found = []
    for name, df in (("override", override), ("stored", stored), ("computed", computed)):
        if df is None:
            continue
        side = df.select("address", F.struct(F.lit(name).alias("source"), *[F.col(c) for c in BASELINE_COLUMNS]).alias(f"_{name}"))
        out = out.join(side, "address", "left")
        found.append(F.col(f"_{name}"))
    picked = F.coalesce(*found)
    defaults = {
        "has_sufficient_history": F.lit(False),
        "observation_count": F.lit(0).cast("long"),
        "profile_reliability": F.lit("INSUFFICIENT_HISTORY"),
    }
    return out.select(
        "address",
        F.coalesce(picked["source"], F.lit("none")).alias("baseline_source"),
        *[F.coalesce(picked[c], defaults.get(c, F.lit(None))).alias(c) for c in BASELINE_COLUMNS],
    )
