"""Thresholds and weights, one frozen record per concern."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LeadRules:
    window_s: float = 120.0
    fan_in: int = 4
    fan_out: int = 4
    large_amount: float = 10.0
    very_large_amount: float = 50.0
    high_fee: float = 0.01
    many_wallets: int = 5
    strong_confidence: float = 0.5
    pts_fan_in: int = 15
    pts_fan_out: int = 15
    pts_large: int = 15
    pts_very_large_extra: int = 5
    pts_network: int = 25
    pts_network_weak: int = 10
    pts_wallets: int = 10
    pts_illicit: int = 20
    pts_fee: int = 10
    high_from: int = 70
    medium_from: int = 40


@dataclass(frozen=True)
class ValidationRules:
    min_history: int = 3
    velocity_times: float = 2.0
    amount_times: float = 2.0
    peers_times: float = 2.0
    interval_share: float = 0.25
    tolerance: float = 0.25
    w_raw: float = 0.35
    w_history: float = 0.45
    w_network: float = 0.20
    attenuation: float = 0.60
    conf_no_history: float = 0.35
    conf_base: float = 0.65
    conf_per_signal: float = 0.08
    conf_conflict: float = 0.15
    conf_consistent: float = 0.38


@dataclass(frozen=True)
class ProfileRules:
    """Constants of one behaviour-profile variant (velocities are per hour)."""

    min_history: int = 3
    high_from: int = 5
    min_span_hours: float = 0.5


STORED_PROFILE = ProfileRules()
ON_DEMAND_PROFILE = ProfileRules(high_from=6, min_span_hours=1.0)


@dataclass(frozen=True)
class ModelRules:
    model: str = "forest"
    contamination: float = 0.05
    trees: int = 100
    rows_per_tree: int = 256
    seed: int = 42
    lof_neighbours: int = 20
    dbscan_eps: float = 0.7
    dbscan_min_samples: int = 3
    min_entities: int = 3
    alert_score: int = 35
    alert_anomaly: float = 0.65
    triage_top: int = 200
