"""Scaling, isolation forest, local outlier factor and score handling."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import snap
from ..config import ModelRules
from ..functions.tables import MODEL_FEATURES
from ..session import cut
from .metric_cells import density_factor, folded
from .spread import SPLIT_OVER, quantiles

FOREST = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


# --- matrices ---------------------------------------------------------------------------


def clean_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """NaN, infinities and nulls to 0 in the given columns."""
    fix = lambda c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")) | F.col(c).isNull(), F.lit(0.0)).otherwise(F.col(c).cast("double")).alias(c)
    return df.select(*[fix(c) if c in cols else F.col(c) for c in df.columns])


def _stack(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in cols])))


def _apply(df: DataFrame, cols: list[str], params: DataFrame) -> DataFrame:
    """(x - centre) / scale.  The parameters are one row per column, so they become literals."""
    by = {r.feature: (r.centre, r.scale) for r in params.collect()}
    return df.select(
        *[((F.col(c) - F.lit(by[c][0])) / F.lit(by[c][1])).alias(c) if c in by else F.col(c) for c in df.columns]
    )


def robust_parameters(df: DataFrame, cols: list[str], split_over: int = SPLIT_OVER) -> DataFrame:
    """feature, centre (median), scale (interquartile range, 0 becomes 1); one row per feature."""
    q = quantiles(_stack(df, cols), ["feature"], "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, split_over)
    iqr = F.col("q3") - F.col("q1")
    return q.select("feature", F.col("q2").alias("centre"), F.when(iqr == 0, F.lit(1.0)).otherwise(iqr).alias("scale"))


def standard_parameters(df: DataFrame, cols: list[str]) -> DataFrame:
    s = _stack(df, cols).groupBy("feature").agg(F.avg("value").alias("centre"), F.stddev_pop("value").alias("_s"))
    return s.select("feature", "centre", F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s")).alias("scale"))


def robust_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return _apply(df, cols, robust_parameters(df, cols))


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    return _apply(df, cols, standard_parameters(df, cols))


def model_matrix(df: DataFrame) -> DataFrame:
    """The nine model features of transactions; no time difference becomes 999, other nulls 0."""
    values = {
        "fan_in": F.coalesce("fan_in", F.lit(1)),
        "fan_out": F.coalesce("fan_out", F.lit(1)),
        "time_difference_seconds": F.coalesce("time_difference_seconds", F.lit(999.0)),
    }
    return df.select(
        "txid", *[F.coalesce(values.get(c, F.col(c)).cast("double"), F.lit(0.0)).alias(c) for c in MODEL_FEATURES]
    )


def heuristic_score(df: DataFrame) -> DataFrame:
    """Score and label when no model exists."""
    h = F.least(
        F.lit(1.0),
        F.col("fan_in") * 0.05 + F.col("fan_out") * 0.05 + F.col("transaction_amount") * 0.01 + F.col("network_confidence") * 0.4,
    )
    return df.withColumn("ml_anomaly_score", snap(h, 4)).withColumn(
        "ml_anomaly_label", F.when(h > 0.6, F.lit(-1)).otherwise(F.lit(1))
    )


# --- sampling -----------------------------------------------------------------------------


def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows in seeded hash order: the same rows however the data is partitioned.

    Rows whose hash lies above a bound that leaves n with room to spare don't leave the scan, so the
    final sort sees about n rows and not n of every partition.
    """
    drawn = df.withColumn("_h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))))
    total = df.count()
    room = n + 8 * math.sqrt(n) + 64
    if room < total:
        low = drawn.filter(F.col("_h") <= f"{int(room / total * 16**8):08x}")
        drawn = low if low.count() >= n else drawn
    return drawn.orderBy("_h", key).limit(n).drop("_h")


def tree_samples(df: DataFrame, key: str, total: int, trees: int, psi: int, seed: int) -> DataFrame:
    """Exactly min(psi, total) distinct rows for every tree.

    Each row draws one hash per tree; only hashes low enough to matter leave the scan, about
    4 * psi rows per tree whatever the table size, and the psi lowest of those are kept.
    """
    share = min(1.0, 4.0 * psi / max(1, total))
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("tree"), F.xxhash64(F.col(key).cast("string"), t, F.lit(seed)).alias("h")),
    )
    bound = int(-(2**63) + share * (2**64 - 1)) if share < 1.0 else 2**63 - 1
    low = df.withColumn("_d", F.explode(F.filter(draws, lambda d: d["h"] <= F.lit(bound))))
    drawn = low.select("*", "_d.tree", "_d.h").drop("_d")
    w = Window.partitionBy("tree").orderBy("h", key)
    return drawn.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= psi).drop("_r", "h")


# --- isolation forest -----------------------------------------------------------------------


def _grow(points: np.ndarray, tree: int, seed: int) -> list[tuple]:
    """Random splits until a node holds one point, equal points, or sits at the depth limit."""
    rng = np.random.default_rng([seed, tree])
    limit = max(1, math.ceil(math.log2(max(2, len(points)))))
    nodes: list[tuple | None] = [None]
    todo = [(0, points, 0)]
    while todo:
        at, rows, depth = todo.pop()
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes[at] = (tree, at, -1, 0.0, -1, -1, len(rows), depth)
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(lo[f], hi[f]))
        below = rows[:, f] <= cut
        if below.all() or not below.any():
            cut = float(lo[f])
            below = rows[:, f] <= cut
        left, right = len(nodes), len(nodes) + 1
        nodes += [None, None]
        nodes[at] = (tree, at, f, cut, left, right, len(rows), depth)
        todo += [(left, rows[below], depth + 1), (right, rows[~below], depth + 1)]
    return nodes


def fit_forest(
    df: DataFrame, cols: list[str], key: str, trees: int = 100, psi: int = 256, seed: int = 42, total: int | None = None
) -> DataFrame:
    """A forest as rows: one per node.  Each tree is built in its own task from psi rows."""
    cols = list(cols)
    n = df.count() if total is None else total
    picked = tree_samples(df.select(key, *cols), key, n, trees, psi, seed)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(key)
        grown = _grow(ordered[cols].to_numpy(float), int(pdf["tree"].iloc[0]), seed)
        names = [f.split()[0] for f in FOREST.split(", ")]
        return pd.DataFrame(grown, columns=names)

    return picked.groupBy("tree").applyInPandas(build, FOREST)


def _average_path(n):
    """Mean path length of an unsuccessful search in a tree of n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2.0)
    grown = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, grown))


def score_forest(df: DataFrame, forest: DataFrame, cols: list[str], out: str = "raw_score") -> DataFrame:
    """Adds 2^(-mean path / c(psi)).  The forest has at most trees * (2 * psi - 1) rows, so it is
    small enough to send to every task whatever the size of `df`."""
    cols = list(cols)
    nodes = forest.toPandas().sort_values(["tree", "node"])
    if nodes.empty:
        raise ValueError("the forest is empty")
    trees = [
        (
            g["feature"].to_numpy(),
            g["threshold"].to_numpy(),
            g["left"].to_numpy(),
            g["right"].to_numpy(),
            g["depth"].to_numpy() + _average_path(g["size"].to_numpy()),
        )
        for _, g in nodes.groupby("tree")
    ]
    psi = int(nodes.loc[nodes["node"] == 0, "size"].max())
    norm = float(_average_path(psi)) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def score(batches):
        for pdf in batches:
            x = pdf[cols].to_numpy(float)
            rows = np.arange(len(x))
            depth = np.zeros(len(x))
            for feature, cut, left, right, path in shared.value:
                at = np.zeros(len(x), dtype=int)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    go = x[rows, np.maximum(f, 0)] <= cut[at]
                    at = np.where(inner, np.where(go, left[at], right[at]), at)
                depth += path[at]
            pdf[out] = np.exp2(-(depth / len(shared.value)) / norm)
            yield pdf

    schema = T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType())])
    return df.mapInPandas(score, schema)


def min_max(df: DataFrame, score: str = "raw_score", out: str = "anomaly_score") -> DataFrame:
    """Scale to [0, 1]; a constant score becomes 0.  The bounds are a scalar subquery."""
    b = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi"))).scalar()
    held = df.withColumn("_b", b)
    span = F.col("_b.hi") - F.col("_b.lo")
    return held.withColumn(
        out, F.coalesce(F.try_divide(F.col(score) - F.col("_b.lo"), span), F.lit(0.0))
    ).drop("_b")


def contamination_cut(
    df: DataFrame, contamination: float = 0.05, score: str = "raw_score", out: str = "prediction", split_over: int = SPLIT_OVER
) -> DataFrame:
    """1 for rows whose outlier score lies above the (1 - contamination) quantile."""
    bar = quantiles(df, [], score, {"cut": 1.0 - contamination}, split_over).select("cut").scalar()
    return df.withColumn(out, F.when(F.col(score) > bar, F.lit(1)).otherwise(F.lit(0)))


def detect(df: DataFrame, cols: list[str], key: str, cfg: ModelRules = ModelRules()) -> DataFrame:
    """raw_score, anomaly_score in [0, 1] and prediction on scaled features, from an isolation forest or, on request, the outlier factor."""
    if cfg.model == "lof":
        return lof_baseline(df, cols, key, cfg)
    scaled = cut(robust_scale(clean_matrix(df.select(key, *cols), list(cols)), list(cols)))
    forest = fit_forest(scaled, cols, key, cfg.trees, cfg.rows_per_tree, cfg.seed)
    scored = cut(score_forest(scaled, forest, cols).select(key, "raw_score"))
    return contamination_cut(min_max(scored), cfg.contamination)


def model_scores(matrix: DataFrame, cfg: ModelRules = ModelRules()) -> DataFrame:
    """Transaction model: scales and draws the samples of its trees from all rows; label -1 for outliers.

    Score is 1 - minmax(decision), which is the min-max of the outlier score itself.
    """
    cols = MODEL_FEATURES
    scaled = cut(_apply(matrix, cols, cut(robust_parameters(matrix, cols))))
    forest = fit_forest(scaled, cols, "txid", cfg.trees, cfg.rows_per_tree, cfg.seed)
    scored = cut(score_forest(scaled, forest, cols).select("txid", "raw_score"))
    bar = quantiles(scored, [], "raw_score", {"cut": 1.0 - cfg.contamination}).select("cut").scalar()
    b = scored.agg(F.struct(F.min("raw_score").alias("lo"), F.max("raw_score").alias("hi"))).scalar()
    span = F.col("_b.hi") - F.col("_b.lo")
    return scored.withColumn("_b", b).select(
        "txid",
        snap((F.col("raw_score") - F.col("_b.lo")) / F.when(span > 1e-6, span).otherwise(F.lit(1.0)), 4).alias("ml_anomaly_score"),
        F.when(F.col("raw_score") > bar, F.lit(-1)).otherwise(F.lit(1)).alias("ml_anomaly_label"),
    )


# --- local outlier factor ---------------------------------------------------------------------


def lof(df: DataFrame, cols: list[str], key: str, k: int = 20) -> DataFrame:
    """Local outlier factor per row, exact at every size: mean neighbour density over own density."""
    points = cut(folded(df, list(cols), key))
    n = points.agg(F.sum("w")).first()[0] or 0
    if n < 2:
        return df.select(key, F.lit(1.0).alias("raw_score"))
    scores = density_factor(points, min(k, n - 1))
    x = F.array(*[F.col(c).cast("double") for c in cols])
    named = points.join(scores, "pid").select("x", "raw_score")
    return df.select(key, x.alias("x")).join(named, "x").select(key, "raw_score")


def lof_baseline(df: DataFrame, cols: list[str], key: str, cfg: ModelRules = ModelRules()) -> DataFrame:
    """Comparison scores."""
    scaled = cut(robust_scale(clean_matrix(df.select(key, *cols), list(cols)), list(cols)))
    return contamination_cut(min_max(cut(lof(scaled, cols, key, cfg.lof_neighbours))), cfg.contamination)


def enough_entities(df: DataFrame, cfg: ModelRules = ModelRules()) -> Column:
    """True subquery when the population is large enough to model."""
    return df.agg((F.count("*") >= cfg.min_entities)).scalar()
