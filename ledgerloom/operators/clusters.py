"""Density clusters of entities and their profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import snap
from ..config import ModelRules
from ..functions.tables import WALLET_FEATURES
from ..session import cut
from .metric_cells import density_clusters, folded, nearest_of
from .outliers import clean_matrix, seeded_sample, standard_scale

NOISE = -1


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, by alternating star contraction.

    `edges`: (src, dst).  Every round moves each vertex's larger neighbours to its smallest one, so
    chains halve instead of shrinking by one; the edge table never grows beyond its first size.
    Rounds are checkpointed, so a lost executor costs a reread and not the whole history.
    """
    current = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    seen = None
    for _ in range(max_rounds):
        both = current.select("src", "dst").unionByName(current.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        # large star: larger neighbours point to the smallest of the neighbourhood
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        big = both.filter("dst > src").join(low, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        big = big.filter("src <> dst").distinct()
        # small star: smaller neighbours and the vertex itself point to the smallest
        m = big.groupBy("src").agg(F.min("dst").alias("m"))
        small = big.join(m, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst")
        step = cut(small.unionByName(m.select("src", F.col("m").alias("dst"))).distinct())
        mark = step.agg(F.count("*"), F.bit_xor(F.xxhash64("src", "dst"))).first()
        current = step
        if mark == seen:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("dst").alias("id"), F.col("dst").alias("component")).distinct()
    return current.select(F.col("src").alias("id"), F.col("dst").alias("component")).unionByName(roots)


def dbscan(df: DataFrame, cols: list[str], key: str, eps: float, min_samples: int = 3) -> DataFrame:
    """(key, cluster_label) on already scaled rows, exact at every size; -1 is noise."""
    points = cut(folded(df, list(cols), key))
    if points.isEmpty():
        return df.select(key, F.lit(NOISE).alias("cluster_label"))
    found = density_clusters(points, eps, min_samples, connected_components)
    x = F.array(*[F.col(c).cast("double") for c in cols])
    named = points.join(found, "pid").select("x", "cluster_label")
    return df.select(key, x.alias("x")).join(named, "x").select(key, "cluster_label")


def assign_nearest(df: DataFrame, labelled: DataFrame, cols: list[str], key: str, reach: float) -> DataFrame:
    """Rows to the nearest cluster centre within `reach`, else noise; ties go to the smaller label. Exact, through pivot cells."""
    cols = list(cols)
    centres = labelled.filter(F.col("cluster_label") != NOISE).groupBy("cluster_label").agg(*[F.avg(c).alias(c) for c in cols])
    centres = cut(centres.select(F.col("cluster_label").cast("long").alias("pid"), F.array(*cols).alias("x"), F.lit(1).cast("long").alias("w")))
    if centres.isEmpty():
        return df.select(key, F.lit(NOISE).alias("cluster_label"))
    near = nearest_of(df.select(F.col(key).alias("pid"), F.array(*[F.col(c).cast("double") for c in cols]).alias("x")), centres, reach)
    return df.select(F.col(key).alias("pid")).join(near, "pid", "left").select(F.col("pid").alias(key), F.coalesce(F.col("other").cast("int"), F.lit(NOISE)).alias("cluster_label"))


def cluster_entities(df: DataFrame, cols: list[str], key: str = "address", cfg: ModelRules = ModelRules()) -> DataFrame:
    """(key, cluster_label) of all rows by DBSCAN on standardised features."""
    scaled = cut(standard_scale(clean_matrix(df.select(key, *cols), list(cols)), list(cols)))
    return dbscan(scaled, cols, key, cfg.dbscan_eps, cfg.dbscan_min_samples)


def sample_then_assign(df: DataFrame, cols: list[str], rows: int, key: str = "address", cfg: ModelRules = ModelRules()) -> DataFrame:
    """The sampling variant, only on request: DBSCAN on `rows` sampled rows, the rest to the nearest centre."""
    scaled = cut(standard_scale(clean_matrix(df.select(key, *cols), list(cols)), list(cols)))
    sample = cut(seeded_sample(scaled, key, rows, cfg.seed))
    labels = cut(dbscan(sample, cols, key, cfg.dbscan_eps, cfg.dbscan_min_samples))
    rest = scaled.join(sample.select(key), key, "left_anti")
    return labels.unionByName(assign_nearest(rest, sample.join(labels, key), list(cols), key, 3 * cfg.dbscan_eps))


def cluster_profile(df: DataFrame, labels: DataFrame, cols=WALLET_FEATURES, key: str = "address") -> DataFrame:
    """Size, feature means and a name per cluster.  Members stay rows of `labels`."""
    j = df.join(labels, key)
    means = j.groupBy("cluster_label").agg(
        F.count("*").alias("member_count"), *[F.avg(c).alias(f"m_{c}") for c in cols]
    )
    raw = lambda c: F.col(f"m_{c}") if c in cols else F.lit(0.0)
    vel, peers, ips = raw("tx_velocity_per_hour"), raw("unique_counterparties"), raw("unique_observed_ips")
    head = F.concat(F.lit("Cluster "), F.col("cluster_label").cast("string"), F.lit(": "))
    # Cluster names.
    name = (
        F.when(F.col("cluster_label") == NOISE, F.lit("Noise / Outlier Group"))
        .when((vel > 5.0) & (peers > 10), F.concat(head, F.lit("High-Velocity Fan-Out Entities")))
        .when(ips > 3, F.concat(head, F.lit("Multi-IP Network Dispersal Cohort")))
        .when(peers < 2, F.concat(head, F.lit("Isolated Peer Transfer Chain")))
        .otherwise(F.concat(head, F.lit("Behaviorally Correlated Group")))
    )
    return means.select(
        "cluster_label", name.alias("cluster_name"), "member_count", *[snap(f"m_{c}", 4).alias(c) for c in cols]
    )


def list_clusters(profile: DataFrame) -> DataFrame:
    """Clusters by label with the overall noise and cluster counts on each row."""
    totals = profile.agg(
        F.struct(
            F.coalesce(F.sum(F.when(F.col("cluster_label") == NOISE, F.col("member_count"))), F.lit(0)).alias("noise"),
            F.count_if(F.col("cluster_label") != NOISE).alias("n"),
        )
    ).scalar()
    held = profile.withColumn("_t", totals)
    return held.select(
        "cluster_label", "cluster_name", "member_count", F.col("_t.n").alias("total_clusters"), F.col("_t.noise").alias("noise_count")
    ).orderBy("cluster_label")
