"""Priority scores, population baselines, deviations and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import snap
from ..config import ModelRules
from ..functions.tables import WALLET_FEATURES
from .spread import SPLIT_OVER, quantiles


def _cap(c: Column) -> Column:
    return F.least(F.lit(100.0), c)


def subscore_columns() -> dict[str, Column]:
    return {
        "ml_score": _cap(F.greatest(F.lit(0.0), F.col("anomaly_score") * 100.0)),
        "velocity_score": _cap(F.col("tx_velocity_per_hour") / 8.0 * 100.0),
        "counterparty_score": _cap(F.col("unique_counterparties") / 20.0 * 100.0),
        "network_score": _cap(
            F.col("unique_observed_ips") * 15.0 + F.col("unique_asns") * 15.0 + F.col("unique_countries") * 10.0
        ),
        "graph_score": _cap(F.col("graph_degree") / 25.0 * 100.0),
    }


# Weights of the composite.
WEIGHTS = {
    "ml_score": 0.40,
    "velocity_score": 0.20,
    "counterparty_score": 0.15,
    "network_score": 0.15,
    "graph_score": 0.10,
}


def severity(score: Column | str) -> Column:
    s = F.col(score) if isinstance(score, str) else score
    return F.when(s >= 80, "CRITICAL").when(s >= 60, "HIGH").when(s >= 35, "MEDIUM").otherwise("LOW")


def composite() -> Column:
    parts = subscore_columns()
    weighted = None
    for name, weight in WEIGHTS.items():
        term = F.lit(weight) * parts[name]
        weighted = term if weighted is None else weighted + term
    return F.least(F.lit(100), F.greatest(F.lit(0), F.bround(weighted, 0))).cast("int")


def priority(df: DataFrame) -> DataFrame:
    """Adds priority_score, severity and the five sub-scores.  Needs anomaly_score and the features."""
    return (
        df.withColumn("priority_score", composite())
        .withColumn("severity", severity("priority_score"))
        .select("*", *[snap(c, 1).alias(n) for n, c in subscore_columns().items()])
    )


def long_features(df: DataFrame, cols=WALLET_FEATURES, keep=("address",)) -> DataFrame:
    """(keys, feature, pos, value); NaN and infinities become 0."""
    clean = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(0.0)).otherwise(F.coalesce(F.col(c).cast("double"), F.lit(0.0)))
    pairs = F.array(
        *[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), clean(c).alias("value")) for i, c in enumerate(cols)]
    )
    return df.select(*keep, F.inline(pairs))


def population_baseline(df: DataFrame, cols=WALLET_FEATURES, split_over: int = SPLIT_OVER) -> DataFrame:
    """One row per feature: mean, median, sample std (1 when not positive), p90, min, max."""
    rows = long_features(df, cols, keep=())
    plain = rows.groupBy("feature", "pos").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("_std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    ranks = quantiles(rows, ["feature"], "value", {"median": 0.5, "p90": 0.9}, split_over)
    std = F.when(F.col("_std") > 0, F.col("_std")).otherwise(F.lit(1.0))
    return plain.join(ranks, "feature").select("feature", "pos", "mean", "median", std.alias("std"), "p90", "min", "max")


def deviations(df: DataFrame, baseline: DataFrame, cols=WALLET_FEATURES) -> DataFrame:
    """z and ratio to the median per (address, feature); the baseline has one row per feature."""
    rows = long_features(df, cols)
    base = F.broadcast(baseline.drop("pos"))
    std = F.when(F.col("std") > 1e-6, F.col("std")).otherwise(F.lit(1.0))
    z = (F.col("value") - F.col("mean")) / std
    ratio = F.col("value") / F.greatest(F.lit(0.0001), F.col("median"))
    return rows.join(base, "feature").select(
        "address", "feature", "pos", "value", "mean", "median", "p90",
        z.alias("z"), ratio.alias("ratio"),
        snap(z, 2).alias("z_score"), snap(ratio, 2).alias("ratio_to_median"),
    )


def top_reasons(dev: DataFrame, n: int = 4, above: float = 1.2) -> DataFrame:
    """The n largest z above the bar per address; ties in feature order."""
    w = Window.partitionBy("address").orderBy(F.desc("z"), "pos")
    return dev.filter(F.col("z") > above).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def top_deviations(dev: DataFrame, n: int = 6) -> DataFrame:
    w = Window.partitionBy("address").orderBy(F.desc(F.abs("z_score")), "pos")
    return dev.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _num(c: Column | str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", snap(c, digits))


def reason_text() -> Column:
    """Wording by feature over value, median, z and ratio."""
    v, med, f = F.col("value"), F.col("median"), F.col("feature")
    whole = lambda c: c.cast("long").cast("string")
    t = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    # Reason wording.
    return (
        F.when(f == "tx_velocity_per_hour", t("Transaction velocity (", _num(v, 1), " tx/hr) is ", _num("ratio", 1), "x higher than population median (", _num(med, 1), " tx/hr)."))
        .when(f == "unique_counterparties", t("Connected to ", whole(v), " counterparties, significantly exceeding typical baseline (", whole(med), " peers)."))
        .when(f == "unique_observed_ips", t("Observed broadcasting across ", whole(v), " distinct IP addresses (population normal: ", whole(med), ")."))
        .when(f == "unique_asns", t("Associated with transactions routed through ", whole(v), " autonomous systems (ASNs)."))
        .when(f == "unique_countries", t("Transaction broadcast observed in ", whole(v), " geographic jurisdictions."))
        .when((f == "avg_time_between_txs_sec") & (v < med * 0.2), t("Extremely rapid inter-transaction intervals (", _num(v, 0), "s vs ", _num(med, 0), "s baseline), characteristic of automated peeling chains."))
        .when(f == "graph_degree", t("Unusually high topological graph connectivity (Degree: ", whole(v), " vs ", _num(med, 1), " average)."))
        .when(f == "foreign_geo_entropy", t("High jurisdictional entropy (", _num(v, 2), ") indicating intentional multi-country network dispersal."))
        .otherwise(t("Elevated ", F.replace(f, F.lit("_"), F.lit(" ")), ": ", _num(v, 2), " (z-score: +", _num("z", 1), ")."))
    )


def explain(df: DataFrame, baseline: DataFrame, cols=WALLET_FEATURES, n: int = 4) -> DataFrame:
    """address, reasons (at most n, strongest first).  `df` carries anomaly and priority scores."""
    dev = deviations(df, baseline, cols)
    top = top_reasons(dev, n).select("address", F.struct("rank", reason_text().alias("text")).alias("r"))
    listed = top.groupBy("address").agg(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["text"]).alias("_reasons"))
    # Fixed value: the reason without deviations.
    default = F.array(
        F.concat(
            F.lit("Multivariate Isolation Forest anomaly score: "), _num("anomaly_score", 2),
            F.lit(" (investigation priority: "), F.col("priority_score").cast("string"), F.lit("/100)."),
        )
    )
    return df.select("address", "anomaly_score", "priority_score").join(listed, "address", "left").select(
        "address", F.coalesce("_reasons", default).alias("reasons")
    )


def simple_reasons() -> Column:
    """Reasons when no population baseline exists."""
    vel, peers, ips = F.col("tx_velocity_per_hour"), F.col("unique_counterparties").cast("long"), F.col("unique_observed_ips").cast("long")
    # Texts of the simple reasons.
    fired = F.array_compact(
        F.array(
            F.when(vel > 4, F.concat(F.lit("High transaction frequency ("), _num(vel, 1), F.lit(" tx/hr)"))),
            F.when(peers > 10, F.concat(F.lit("Large counterparty network ("), peers.cast("string"), F.lit(" distinct peers)"))),
            F.when(ips > 3, F.concat(F.lit("Dispersed network relay observations ("), ips.cast("string"), F.lit(" unique IPs)"))),
        )
    )
    return F.when(F.size(fired) > 0, fired).otherwise(F.array(F.lit("Elevated multivariate statistical anomaly score.")))


def alert_candidates(scored: DataFrame, cfg: ModelRules = ModelRules()) -> DataFrame:
    return scored.filter((F.col("priority_score") >= cfg.alert_score) | (F.col("anomaly_score") > cfg.alert_anomaly))


def triage(candidates: DataFrame, top: int = 200) -> DataFrame:
    """Highest priority first; TakeOrdered keeps `top` rows per task."""
    return candidates.orderBy(F.desc("priority_score"), F.desc("anomaly_score"), "address").limit(top)


def evidence_sample(wallets: DataFrame, legs: DataFrame, obs: DataFrame, n: int = 5) -> DataFrame:
    """Up to n transactions per direction and n source IPs of those, per wallet."""
    mine = legs.join(wallets.select("address"), "address", "left_semi").select("address", "direction", "txid").distinct()
    w = Window.partitionBy("address", "direction").orderBy("txid")
    picked = mine.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).select("address", "txid").distinct()
    ips = picked.join(obs.select("txid", "src_ip").distinct(), "txid").select("address", "src_ip").distinct()
    wi = Window.partitionBy("address").orderBy("src_ip")
    few = ips.withColumn("_r", F.row_number().over(wi)).filter(F.col("_r") <= n)
    tx_lists = picked.groupBy("address").agg(F.array_sort(F.collect_set("txid")).alias("related_transactions"))
    ip_lists = few.groupBy("address").agg(F.array_sort(F.collect_set("src_ip")).alias("observed_ips"))
    empty = F.array().cast("array<string>")
    return (
        wallets.select("address")
        .join(tx_lists, "address", "left")
        .join(ip_lists, "address", "left")
        .select("address", *[F.coalesce(c, empty).alias(c) for c in ("related_transactions", "observed_ips")])
    )


def write_back(wallets: DataFrame, scored: DataFrame) -> DataFrame:
    """Next wallet snapshot with the new scores."""
    new = scored.select("address", F.col("priority_score").alias("_p"), snap("anomaly_score", 4).alias("_a"))
    return (
        wallets.join(new, "address", "left")
        .withColumn("risk_score", F.coalesce("_p", "risk_score"))
        .withColumn("anomaly_score", F.coalesce("_a", "anomaly_score"))
        .drop("_p", "_a")
    )
