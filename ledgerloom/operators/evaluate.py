"""Detector quality against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import snap
from .spread import running_before


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"),
        F.count_if((y == 0) & (p == 1)).alias("fp"),
        F.count_if((y == 1) & (p == 0)).alias("fn"),
        F.count_if((y == 0) & (p == 0)).alias("tn"),
    )


def ranking_metrics(df: DataFrame, label: str = "label", score: str = "anomaly_score") -> DataFrame:
    """roc_auc and pr_auc, one row.

    Rows collapse to one per distinct score; cumulative counts over scores come from sliced running
    sums, so the global order is never sorted in one task.
    """
    per = df.groupBy(F.col(score).alias("s")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    run = running_before(per, [], "s", ["pos", "neg"])
    totals = per.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    r = run.withColumn("_t", totals)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    below = F.col("before_neg") + neg / 2.0
    at_or_above_pos = F.col("_t.p") - F.col("before_pos")
    at_or_above_all = at_or_above_pos + F.col("_t.n") - F.col("before_neg")
    return r.agg(
        F.sum(pos * below).alias("_wins"),
        F.sum(F.coalesce(F.try_divide(pos * at_or_above_pos, at_or_above_all), F.lit(0.0))).alias("_prec"),
        F.max("_t.p").alias("_p"),
        F.max("_t.n").alias("_n"),
    ).select(
        F.coalesce(F.try_divide(F.col("_wins"), F.col("_p").cast("double") * F.col("_n")), F.lit(0.5)).alias("roc_auc"),
        F.coalesce(F.try_divide("_prec", "_p"), F.lit(0.0)).alias("pr_auc"),
    )


def evaluate(df: DataFrame, label: str = "label", pred: str = "prediction", score: str = "anomaly_score") -> DataFrame:
    """Precision, recall, F1, false-positive rate, AUCs: one row; zeros for no rows."""
    c = confusion(df, label, pred)
    r = ranking_metrics(df, label, score)
    one = c.join(r, F.lit(True))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    out = {
        "precision": div(tp, tp + fp),
        "recall": div(tp, tp + fn),
        "f1_score": div(2.0 * tp, 2.0 * tp + fp + fn),
        "roc_auc": F.when(n > 0, F.col("roc_auc")).otherwise(F.lit(0.0)),
        "pr_auc": F.when(n > 0, F.col("pr_auc")).otherwise(F.lit(0.0)),
        "false_positive_rate": fp / F.greatest(F.lit(1.0), fp + tn),
        "detection_rate": div(tp, tp + fn),
    }
    return one.select(*[snap(v, 4).alias(k) for k, v in out.items()], n.cast("long").alias("sample_count"))


def with_labels(scored: DataFrame, labels: DataFrame | None, key: str = "address") -> DataFrame:
    """Truth from labels (0 when absent); without any, the predictions themselves, and marked so."""
    if labels is None:
        return scored.withColumn("label", F.col("prediction")).withColumn("self_evaluated", F.lit(True))
    return (
        scored.join(labels.select(key, F.col("label").alias("_y")), key, "left")
        .withColumn("label", F.coalesce("_y", F.lit(0)))
        .drop("_y")
        .withColumn("self_evaluated", F.lit(False))
    )


def compare_baseline(primary: DataFrame, baseline: DataFrame | None, labels: DataFrame | None, key: str = "address") -> DataFrame:
    """Metrics of the detector and, where there is one, of the comparison model."""
    truth = with_labels(primary, labels, key)
    rows = evaluate(truth).withColumn("model", F.lit("ISOLATION_FOREST"))
    if baseline is None:
        return rows
    y = truth.select(key, "label")
    other = evaluate(baseline.join(y, key)).withColumn("model", F.lit("LOCAL_OUTLIER_FACTOR"))
    return rows.unionByName(other)


def run_record(metrics: DataFrame, model: str, params: dict, started=None) -> DataFrame:
    """One appendable row per run."""
    return metrics.select(
        F.lit(model).alias("model_type"),
        F.lit("1.0.0").alias("version"),
        F.to_json(F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv])).alias("hyperparameters"),
        F.to_json(F.struct(*metrics.columns)).alias("evaluation_metrics"),
        F.col("sample_count").alias("dataset_records_count"),
        (F.current_timestamp() if started is None else started).alias("trained_at"),
    )


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return runs.orderBy(F.desc("trained_at"), "model_type").limit(limit)
