"""The entity run: ledger to features, scores, clusters, profiles and ranked, explained alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import snap
from ..config import ModelRules, ValidationRules
from ..functions.tables import WALLET_FEATURES
from ..operators import clusters as cl
from ..operators import evaluate as ev
from ..operators import outliers as ol
from ..operators import prioritize as pr
from ..operators import profiles as pf
from ..operators.features import wallet_features
from ..operators.ingest import Ledger
from ..operators.validate import validate
from ..session import cut


@dataclass
class EntityRun:
    status: str
    features: DataFrame
    scored: DataFrame | None = None
    metrics: DataFrame | None = None
    labels: DataFrame | None = None
    cluster_profile: DataFrame | None = None
    profiles: DataFrame | None = None
    alerts: DataFrame | None = None


def alert_rows(
    scored: DataFrame, features: DataFrame, baseline: DataFrame, verdicts: DataFrame, evidence: DataFrame,
    dataset_id: str = "default", created_at: Column | None = None,
) -> DataFrame:
    """Alerts of the triaged entities.  Ids are hashes of natural keys, so a rerun gives the same ids."""
    at = F.current_timestamp() if created_at is None else created_at
    reasons = pr.explain(scored, baseline)
    v = verdicts.select(
        "address", "raw_anomaly_score", "validation_score", "confidence", "behavioural_deviation", "supporting_evidence",
        "counter_evidence", "validation_explanation", "has_sufficient_history", "observation_count", "profile_reliability",
    )
    return (
        scored.join(reasons, "address")
        .join(v, "address")
        .join(evidence, "address", "left")
        .select(
            F.sha2(F.concat_ws("|", F.lit(dataset_id), "address"), 256).alias("alert_id"),
            F.lit(dataset_id).alias("dataset_id"),
            F.col("address").alias("entity_id"),
            F.lit("WALLET").alias("entity_type"),
            snap("anomaly_score", 4).alias("anomaly_score"),
            "raw_anomaly_score",
            "validation_score",
            "priority_score",
            "severity",
            "confidence",
            F.lit("NEW").alias("status"),
            "reasons",
            "behavioural_deviation",
            "supporting_evidence",
            "counter_evidence",
            "validation_explanation",
            "has_sufficient_history",
            "observation_count",
            "profile_reliability",
            "related_transactions",
            "observed_ips",
            at.alias("created_at"),
        )
    )


def run_entity_analysis(
    ledger: Ledger, dataset_id: str = "default", labels: DataFrame | None = None,
    cfg: ModelRules = ModelRules(), rules: ValidationRules = ValidationRules(),
) -> EntityRun:
    """Everything after ingest.  Features and scores feed many steps and are checkpointed once each."""
    tx, legs, obs = ledger.transactions, ledger.legs, ledger.observations
    features = cut(wallet_features(tx, legs, obs))
    if features.limit(cfg.min_entities).count() < cfg.min_entities:
        return EntityRun("SKIPPED", features)
    cols = WALLET_FEATURES
    detected = ol.detect(features, cols, "address", cfg)
    scored = cut(pr.priority(features.join(detected, "address")))
    other = ol.lof_baseline(features, cols, "address", cfg)
    metrics = ev.compare_baseline(scored, other, labels)
    cluster_labels = cut(cl.cluster_entities(features, cols, "address", cfg))
    stored = cut(pf.stored_profiles(tx, legs, obs))
    chosen = pr.triage(pr.alert_candidates(scored, cfg), cfg.triage_top)
    base = pf.resolve_baseline(chosen, stored=pf.baseline_of_profile(stored))
    verdicts = validate(chosen, base, rules)
    evidence = pr.evidence_sample(chosen, legs, obs)
    alerts = alert_rows(chosen, features, pr.population_baseline(features), verdicts, evidence, dataset_id)
    return EntityRun(
        "COMPLETED", features, scored, metrics, cluster_labels, cl.cluster_profile(features, cluster_labels), stored, alerts
    )
