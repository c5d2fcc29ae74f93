"""Transactions joined to wallets, labels and network observations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import snap
from ..config import LeadRules
from ..session import cut
from .spread import around

# Notes per match kind.
NOTES = {
    "exact_txid": "network observation exactly matched by transaction identifier (TXID)",
    "timestamp_window": "network observation temporally correlated with transaction within observation window",
    "none": "no network observation correlated",
}
OBS_FIELDS = ["network_timestamp", "src_ip", "src_port", "dst_ip", "dst_port", "network_txid"]


# --- labels and wallets -------------------------------------------------------------------


def tx_class(tx: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds tx_class, 'unknown' without a label.  `classes`: (key, class), one row per key."""
    labelled = classes.select(F.col("key").alias("txid"), F.col("class").alias("_c"))
    return tx.join(labelled, "txid", "left").withColumn("tx_class", F.coalesce("_c", F.lit("unknown"))).drop("_c")


def wallet_links(tx: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (txid, side, address) from edge lists and the addresses held in the rows."""
    listed = edges.join(tx.select("txid").distinct(), "txid", "left_semi").select("txid", "side", "address")
    if "input_addresses" in tx.columns:
        side = lambda s, c: F.transform(c, lambda a: F.struct(F.lit(s).alias("side"), a.alias("address")))
        inline = tx.select(
            "txid", F.inline(F.concat(side("IN", "input_addresses"), side("OUT", "output_addresses")))
        )
        listed = listed.unionByName(inline)
    return listed.filter("address <> ''").dropDuplicates(["txid", "side", "address"])


def wallet_counts(links: DataFrame) -> DataFrame:
    """Distinct wallets per transaction over both sides."""
    return links.select("txid", "address").distinct().groupBy("txid").agg(
        F.count("*").cast("int").alias("wallet_count")
    )


def wallet_lists(links: DataFrame) -> DataFrame:
    """Sorted wallet lists per transaction, whole: the record's cell holds what one transaction names.

    `links` is the same as rows, for readers who want no long cells.
    """
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("address"))))
    lists = links.groupBy("txid").agg(side("IN").alias("input_wallets"), side("OUT").alias("output_wallets"))
    lists = lists.withColumn("related_wallets", F.array_sort(F.array_union("input_wallets", "output_wallets")))
    return lists.withColumn("wallet_count", F.size("related_wallets"))


def wallet_class_pairs(links: DataFrame, wallet_classes: DataFrame) -> DataFrame:
    """(txid, address, class) for every related wallet that has a label."""
    related = links.select("txid", "address").distinct()
    return related.join(
        wallet_classes.select(F.col("key").alias("address"), "class"), "address"
    ).select("txid", "address", "class")


def wallet_class_map(links: DataFrame, wallet_classes: DataFrame) -> DataFrame:
    """address -> class per transaction; `wallet_class_pairs` is the same as rows."""
    pairs = wallet_class_pairs(links, wallet_classes)
    entries = F.array_sort(F.collect_list(F.struct("address", "class")))
    return pairs.groupBy("txid").agg(F.map_from_entries(entries).alias("wallet_classes"))


def join_wallets(
    tx: DataFrame, edges: DataFrame, tx_classes: DataFrame, wallet_classes: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Transactions with class, wallet lists, class map and count; and the link table."""
    links = cut(wallet_links(tx, edges))
    out = (
        tx_class(tx, tx_classes)
        .join(wallet_lists(links), "txid", "left")
        .join(wallet_class_map(links, wallet_classes), "txid", "left")
        .withColumn("wallet_count", F.coalesce("wallet_count", F.lit(0)))
    )
    return out, links


# --- network ------------------------------------------------------------------------------


def decay(diff_s: Column, window_s: float) -> Column:
    return snap(F.greatest(F.lit(0.0), 1.0 - diff_s / F.lit(window_s)), 4)


def _obs_struct() -> Column:
    return F.struct("obs_us", "obs_id", *OBS_FIELDS)


def exact_match(tx: DataFrame, obs: DataFrame) -> DataFrame:
    """Equal txid; the last observation of a txid wins (partial aggregation, one row per txid)."""
    last = (
        obs.filter(F.coalesce("network_txid", F.lit("")) != "")
        .groupBy(F.col("network_txid").alias("txid"))
        .agg(F.max_by(_obs_struct(), "obs_id").alias("hit"))
    )
    gap = F.abs(F.col("ts_us") - F.col("obs_us")) / 1e6
    return (
        tx.select("txid", "ts_us")
        .join(last.select("txid", "hit.*"), "txid")
        .withColumn("time_difference_seconds", snap(F.coalesce(gap, F.lit(0.0)), 2))
        .withColumn("network_confidence", F.lit(1.0))
        .withColumn("correlation_method", F.lit("exact_txid"))
    )


def nearest_match(tx: DataFrame, obs: DataFrame, window_s: float = 120.0) -> DataFrame:
    """Closest observation within the window; ties go to the earlier one, then the earlier in file.

    The answer depends on the transaction time alone, so both sides first collapse to distinct
    times and meet on one time line, without pairing transactions with observations.
    """
    width = int(round(window_s * 1e6))
    seen = (
        obs.filter(F.col("obs_us").isNotNull())
        .groupBy(F.col("obs_us").alias("t"))
        .agg(F.min_by(_obs_struct(), "obs_id").alias("obs"))
    )
    asked = tx.filter(F.col("ts_us").isNotNull()).select(F.col("ts_us").alias("t")).distinct()
    line = (
        asked.withColumn("ask", F.lit(True))
        .join(seen, "t", "full_outer")
        .withColumn("obs", F.when(F.col("obs").isNotNull(), F.struct("t", "obs")))
    )
    near = around(line, [], "t", "obs").filter("ask")
    back, ahead = F.col("t") - F.col("mark_before.t"), F.col("mark_after.t") - F.col("t")
    far = F.lit(1 << 62)
    pick_back = F.coalesce(back, far) <= F.coalesce(ahead, far)
    chosen = near.select(
        F.col("t").alias("ts_us"),
        F.when(pick_back, F.col("mark_before")).otherwise(F.col("mark_after")).alias("_m"),
        F.when(pick_back, back).otherwise(ahead).alias("_gap"),
    ).filter(F.col("_gap") <= width)
    chosen = chosen.select("ts_us", "_m.obs.*", "_gap")
    gap_s = F.col("_gap") / 1e6
    return (
        tx.select("txid", "ts_us")
        .join(chosen, "ts_us")
        .withColumn("time_difference_seconds", snap(gap_s, 2))
        .withColumn("network_confidence", decay(gap_s, window_s))
        .withColumn("correlation_method", F.lit("timestamp_window"))
        .drop("_gap")
    )


def join_network(tx: DataFrame, obs: DataFrame, window_s: float = 120.0) -> DataFrame:
    """Exact match, else nearest in the window, else none.  Adds the match columns to `tx`."""
    exact = exact_match(tx, obs)
    rest = tx.join(exact.select("txid"), "txid", "left_anti")
    cols = ["txid", *OBS_FIELDS, "time_difference_seconds", "network_confidence", "correlation_method"]
    hits = exact.select(*cols).unionByName(nearest_match(rest, obs, window_s).select(*cols))
    method = F.coalesce("correlation_method", F.lit("none"))
    note = F.create_map(*[F.lit(x) for kv in NOTES.items() for x in kv])
    return (
        tx.join(hits, "txid", "left")
        .withColumn("correlation_method", method)
        .withColumn("network_confidence", F.coalesce("network_confidence", F.lit(0.0)))
        .withColumn("observation_note", note[F.col("correlation_method")])
        .withColumn(
            "names_other_tx",
            F.coalesce(
                (F.col("correlation_method") == "timestamp_window") & (F.col("network_txid") != F.col("txid")),
                F.lit(False),
            ),
        )
    )


# --- features, score, records ---------------------------------------------------------------


def tx_vector(df: DataFrame) -> DataFrame:
    """Adds the transaction feature columns."""
    return (
        df.withColumn("degree", F.col("fan_in") + F.col("fan_out"))
        .withColumn("fan_ratio", snap(F.col("fan_in") / F.greatest(F.lit(1), F.col("fan_out")), 4))
        .withColumn("transaction_amount", snap("total_input_amount", 6))
        .withColumn("fee_rounded", snap("fee", 8))
        .withColumn("amount_per_output_rounded", snap("amount_per_output", 6))
        .withColumn("unique_counterparties", F.col("wallet_count"))
        .withColumn("network_correlation_strength", snap("network_confidence", 4))
        .withColumn("temporal_distance", snap(F.coalesce("time_difference_seconds", F.lit(999.0)), 2))
    )


def _fixed(c: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", snap(c, digits))


def lead_terms(cfg: LeadRules) -> list[tuple[Column, int, Column]]:
    """(condition, points, evidence text) of every rule, in order; alternatives exclude each other."""
    amount, conf, fee = F.col("transaction_amount"), F.col("network_confidence"), F.col("fee_rounded")
    very, large = amount >= cfg.very_large_amount, amount >= cfg.large_amount
    strong = conf >= cfg.strong_confidence
    weak = ~strong & (F.col("correlation_method") == "timestamp_window") & (conf > 0)
    illicit = F.lower("tx_class").isin("1", "illicit")
    gap = F.coalesce(F.concat(_fixed("time_difference_seconds", 1), F.lit("s")), F.lit("exact"))
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    num = lambda c: F.col(c).cast("string")
    very_pts = cfg.pts_large + cfg.pts_very_large_extra
    # Evidence wording.
    return [
        (
            F.col("fan_in") >= cfg.fan_in,
            cfg.pts_fan_in,
            text(f"+{cfg.pts_fan_in} High fan-in: Aggregated from ", num("fan_in"), f" input sources (threshold >= {cfg.fan_in})"),
        ),
        (
            F.col("fan_out") >= cfg.fan_out,
            cfg.pts_fan_out,
            text(f"+{cfg.pts_fan_out} High fan-out: Peeling/splitting across ", num("fan_out"), f" output addresses (threshold >= {cfg.fan_out})"),
        ),
        (
            very,
            very_pts,
            text(f"+{very_pts} Very large transaction: ", _fixed(amount, 2), f" BTC moved (exceeds {cfg.very_large_amount} BTC)"),
        ),
        (
            large & ~very,
            cfg.pts_large,
            text(f"+{cfg.pts_large} Large transaction: ", _fixed(amount, 2), f" BTC moved (threshold >= {cfg.large_amount} BTC)"),
        ),
        (
            strong,
            cfg.pts_network,
            text(f"+{cfg.pts_network} Strong network correlation: Confidence ", _fixed(conf, 2), " via ", F.col("correlation_method"), " (time difference: ", gap, ")"),
        ),
        (
            weak,
            cfg.pts_network_weak,
            text(f"+{cfg.pts_network_weak} Moderate temporal network correlation: Confidence ", _fixed(conf, 2)),
        ),
        (
            F.col("wallet_count") >= cfg.many_wallets,
            cfg.pts_wallets,
            text(f"+{cfg.pts_wallets} Highly connected entity: ", num("wallet_count"), " associated counterparties"),
        ),
        (
            illicit,
            cfg.pts_illicit,
            text(f"+{cfg.pts_illicit} Known illicit category label in benchmark forensic dataset"),
        ),
        (
            ~illicit & (fee >= cfg.high_fee),
            cfg.pts_fee,
            text(f"+{cfg.pts_fee} Anomalous high transaction fee: ", _fixed(fee, 6), " BTC"),
        ),
    ]


# Fixed value: evidence when no rule fires.
DEFAULT_EVIDENCE = "Standard transaction profile within normal baseline operating bounds"


def lead_score(cfg: LeadRules = LeadRules()) -> Column:
    points = sum((F.when(cond, F.lit(pts)).otherwise(F.lit(0)) for cond, pts, _ in lead_terms(cfg)), F.lit(0))
    return F.least(F.lit(100), F.greatest(F.lit(0), points)).cast("int")


def lead_priority(score: Column | str, cfg: LeadRules = LeadRules()) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= cfg.high_from, "HIGH").when(s >= cfg.medium_from, "MEDIUM").otherwise("LOW")


def lead_evidence(cfg: LeadRules = LeadRules()) -> Column:
    fired = F.array_compact(F.array(*[F.when(cond, text) for cond, _, text in lead_terms(cfg)]))
    return F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit(DEFAULT_EVIDENCE)))


def score_leads(df: DataFrame, cfg: LeadRules = LeadRules()) -> DataFrame:
    return (
        df.withColumn("risk_score", lead_score(cfg))
        .withColumn("priority", lead_priority("risk_score", cfg))
        .withColumn("evidence", lead_evidence(cfg))
    )


RECORD_COLUMNS = [
    "txid", "timestamp", "tx_class", "fee", "script_type", "input_count", "output_count", "fan_in", "fan_out",
    "total_input_amount", "amount_per_output", "input_wallets", "output_wallets", "related_wallets",
    "wallet_classes", "network_timestamp", "time_difference_seconds", "src_ip", "src_port", "dst_ip", "dst_port",
    "network_txid", "correlation_method", "network_confidence",
]


def correlation_records(df: DataFrame) -> DataFrame:
    """The 24-column record; lists joined by ';', the class map as JSON."""
    joined = {c: F.concat_ws(";", c) for c in ("input_wallets", "output_wallets", "related_wallets")}
    joined["wallet_classes"] = F.coalesce(F.to_json("wallet_classes"), F.lit("{}"))
    return df.select(*[joined.get(c, F.col(c)).alias(c) for c in RECORD_COLUMNS])


def lead_records(scored: DataFrame) -> DataFrame:
    extra = [c for c in ("ml_anomaly_score", "ml_anomaly_label") if c in scored.columns]
    return scored.select(
        "txid",
        "timestamp",
        F.col("total_input_amount").alias("amount"),
        "fee",
        "tx_class",
        "fan_in",
        "fan_out",
        "wallet_count",
        "network_confidence",
        "risk_score",
        "priority",
        F.array_join("evidence", " | ").alias("evidence"),
        *extra,
    )


def rank_leads(leads: DataFrame) -> DataFrame:
    return leads.orderBy(F.desc("risk_score"), "txid")


def run_metrics(scored: DataFrame, links: DataFrame, obs: DataFrame) -> DataFrame:
    """One row of run totals."""
    wallets = links.agg(F.count_distinct("address")).scalar()
    seen = obs.agg(F.count("*")).scalar()
    return scored.agg(
        F.count("*").alias("transactions_processed"),
        F.count_if(F.col("correlation_method") != "none").alias("correlated_transactions"),
        F.count("*").alias("investigation_leads"),
        F.count_if(F.col("priority") == "HIGH").alias("high_priority_leads"),
    ).select(
        "transactions_processed",
        wallets.alias("wallets_connected"),
        seen.alias("network_observations"),
        "correlated_transactions",
        "investigation_leads",
        "high_priority_leads",
    )


def filter_leads(
    leads: DataFrame,
    priority: str | None = None,
    minimum_score: float | None = None,
    transaction_class: str | None = None,
    date: str | None = None,
) -> DataFrame:
    """All leads that pass the filters; `count()` of this is the total before paging."""
    out = leads
    if priority and priority.upper() != "ALL":
        out = out.filter(F.upper("priority") == priority.upper())
    if minimum_score is not None:
        out = out.filter(F.col("risk_score") >= minimum_score)
    if transaction_class:
        out = out.filter(F.lower("tx_class") == transaction_class.lower())
    if date:
        out = out.filter(F.contains(F.col("timestamp").cast("string"), F.lit(date)))
    return out


def page(ranked: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    return ranked.offset(offset).limit(limit)


def _list(c: str) -> Column:
    return F.filter(F.split(F.coalesce(F.col(c), F.lit("")), ";"), lambda w: ~w.isin("", "None", "nan"))


def lead_detail(leads: DataFrame, records: DataFrame, txid: str | None = None) -> DataFrame:
    """Leads joined to their records, with evidence and wallets as lists again."""
    left = leads if txid is None else leads.filter(F.col("txid") == txid)
    right = records.select(
        "txid", "script_type", "input_wallets", "output_wallets", "related_wallets", "wallet_classes",
        "src_ip", "src_port", "dst_ip", "dst_port", "time_difference_seconds", "correlation_method",
    )
    j = left.join(right, "txid", "left")
    return j.select(
        "txid",
        "risk_score",
        "priority",
        F.split("evidence", r" \| ").alias("evidence"),
        F.struct("timestamp", "amount", "fee", "tx_class", "fan_in", "fan_out", F.coalesce("script_type", F.lit("P2PKH")).alias("script_type")).alias("transaction_information"),
        F.struct(*[_list(c).alias(c) for c in ("input_wallets", "output_wallets", "related_wallets")], F.coalesce("wallet_classes", F.lit("{}")).alias("wallet_classes")).alias("wallet_information"),
        F.struct("src_ip", "src_port", "dst_ip", "dst_port", "time_difference_seconds", "correlation_method", "network_confidence").alias("network_correlation"),
    )


def record_breakdown(records: DataFrame, txid: str | None = None) -> DataFrame:
    """Wallet and network parts of correlation records."""
    r = records if txid is None else records.filter(F.col("txid") == txid)
    related = _list("related_wallets")
    return r.select(
        "txid",
        F.struct(*[_list(c).alias(c) for c in ("input_wallets", "output_wallets", "related_wallets")], "wallet_classes", F.size(related).alias("total_wallets")).alias("wallet_correlations"),
        F.struct("network_timestamp", "time_difference_seconds", "src_ip", "src_port", "dst_ip", "dst_port", "network_txid", "correlation_method", "network_confidence").alias("network_correlations"),
    )


def correlation_edges(links: DataFrame, matched: DataFrame) -> DataFrame:
    """Distinct wallet -> tx, tx -> wallet and ip -> tx edges."""
    into = links.filter(F.col("side") == "IN").select(
        F.col("address").alias("source"), F.col("txid").alias("target"),
        F.lit("wallet").alias("source_type"), F.lit("transaction").alias("target_type"), F.lit("input_to").alias("relationship"),
    )
    out = links.filter(F.col("side") == "OUT").select(
        F.col("txid").alias("source"), F.col("address").alias("target"),
        F.lit("transaction").alias("source_type"), F.lit("wallet").alias("target_type"), F.lit("output_to").alias("relationship"),
    )
    seen = matched.filter(F.col("src_ip").isNotNull() & ~F.col("src_ip").isin("", "None", "nan")).select(
        F.col("src_ip").alias("source"), F.col("txid").alias("target"),
        F.lit("ip").alias("source_type"), F.lit("transaction").alias("target_type"), F.lit("network_observation").alias("relationship"),
    )
    return into.unionByName(out).unionByName(seen).dropDuplicates()


@dataclass
class Correlated:
    records: DataFrame
    leads: DataFrame
    edges: DataFrame
    links: DataFrame
    scored: DataFrame
    metrics: DataFrame


def correlate(
    tx: DataFrame,
    edges: DataFrame,
    tx_classes: DataFrame,
    wallet_classes: DataFrame,
    obs: DataFrame,
    cfg: LeadRules = LeadRules(),
    with_model=None,
) -> Correlated:
    """The correlation run.  `with_model` may add model score columns to the scored rows."""
    walleted, links = join_wallets(tx, edges, tx_classes, wallet_classes)
    scored = cut(score_leads(tx_vector(join_network(cut(walleted), obs, cfg.window_s)), cfg))  # records, leads, edges, metrics and models read this
    if with_model is not None:
        scored = with_model(scored)
    return Correlated(
        records=correlation_records(scored),
        leads=lead_records(scored),
        edges=correlation_edges(links, scored),
        links=links,
        scored=scored,
        metrics=run_metrics(scored, links, obs),
    )
