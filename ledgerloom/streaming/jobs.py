"""Streaming forms of ingest, wallet totals, time correlation and hourly volume.

Each reuses the batch operator, so batch and stream agree.  Sinks are idempotent: a replayed
micro-batch overwrites what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import LeadRules
from ..operators.correlate import join_network
from ..operators.ingest import Ledger, ingest, merge_wallets, wallet_rollup
from ..sources.sinks import TABLES


#: Slice of rows without a readable time.
NO_TIME = -(1 << 40)


def dedupe_stream(tx: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """First copy of a txid; repeats within the lateness bound are dropped."""
    return tx.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["txid"])


def observed(df: DataFrame, name: str = "ingest") -> DataFrame:
    """Counters readable from query progress."""
    return df.observe(
        name,
        F.count("*").alias("records"),
        F.count_if(F.col("reason").isNull()).alias("valid"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
    )


def write_batch(ledger: Ledger, folder: str, batch_id: int) -> None:
    """One folder per micro-batch and table; a replay overwrites it."""
    for name in TABLES:
        df = getattr(ledger, name)
        if df is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch_id={batch_id}")


def start_ingest_stream(raw: DataFrame, folder: str, checkpoint: str, order=("src_file", "src_pos")) -> StreamingQuery:
    """Raw record stream to ledger tables, one ingest per micro-batch.

    Every record is validated first.  A valid transaction whose id an earlier micro-batch has written
    counts as a repeat; rejects, class rows and repeat counts stay whole, so all batches together equal
    one batch ingest.  State is the written ids themselves and survives restarts.
    """
    spark = raw.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            earlier = written_before(spark, f"{folder}/transactions", batch_id)
            write_batch(ingest(batch, order=order, seen=earlier), folder, batch_id)
        finally:
            batch.unpersist()

    return (
        raw.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _drop(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written_before(spark: SparkSession, folder: str, batch_id: int) -> DataFrame | None:
    if not _exists(spark, folder):
        return None
    rows = spark.read.option("basePath", folder).parquet(folder)
    return rows.filter(F.col("batch_id") < batch_id)


def running_wallets(legs: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Streaming wallet totals (update mode); `legs` carries ts."""
    side = lambda d: F.coalesce(F.sum(F.when(F.col("direction") == d, F.col("amount"))), F.lit(0.0))
    return (
        legs.withWatermark("ts", lateness)
        .groupBy("address")
        .agg(
            F.min("ts").alias("first_seen"),
            F.max("ts").alias("last_seen"),
            side("OUT").alias("total_received"),
            side("IN").alias("total_sent"),
            F.count("*").alias("tx_count"),
        )
    )


def start_wallet_merge(legs: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch into a versioned wallet table: version b = version b-1 merged with batch b.

    A missing version is an error: going on would lose all earlier totals.  The last two versions stay,
    one for readers and one for a replay.
    """
    spark = legs.sparkSession

    def handle(batch: DataFrame, batch_id: int) -> None:
        delta = wallet_rollup(batch.drop("ts"), batch.select("txid", "ts").distinct())
        before = f"{folder}/version={batch_id - 1}"
        if batch_id and not _exists(spark, before):
            raise RuntimeError(f"{before} is missing: earlier totals would be lost")
        merged = merge_wallets(spark.read.parquet(before), delta) if batch_id else delta
        merged.write.mode("overwrite").parquet(f"{folder}/version={batch_id}")
        _drop(spark, f"{folder}/version={batch_id - 2}")

    return (
        legs.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_version(spark: SparkSession, folder: str) -> DataFrame:
    """The newest version, found by folder names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = [s.getPath().getName() for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    newest = max(int(n.removeprefix("version=")) for n in names if n.startswith("version="))
    return spark.read.parquet(f"{folder}/version={newest}")


def start_correlation_stream(
    tx: DataFrame, obs: DataFrame, folder: str, checkpoint: str, rules: LeadRules = LeadRules(), slice_s: int = 86_400
) -> tuple[StreamingQuery, StreamingQuery]:
    """Land both feeds in tables partitioned by time slice; correlate closed slices with `close_slices`.

    Pairing two streams inside Spark's join state would hold every pair of a busy window.  Landing the
    feeds keeps state in files, and a closed slice is correlated by the batch operator.
    """

    def land(df: DataFrame, time: str, name: str) -> StreamingQuery:
        sliced = df.withColumn("time_slice", F.coalesce(F.floor(F.col(time) / (slice_s * 1_000_000)), F.lit(NO_TIME)))

        def handle(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic"
            ).partitionBy("time_slice", "batch_id").parquet(f"{folder}/{name}")

        return (
            sliced.writeStream.foreachBatch(handle)
            .option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True)
            .start()
        )

    return land(tx, "ts_us", "tx"), land(obs, "obs_us", "obs")


def close_slices(
    spark: SparkSession, folder: str, up_to_us: int, rules: LeadRules = LeadRules(), slice_s: int = 86_400
) -> DataFrame:
    """Correlate every landed slice that ends a window before `up_to_us`, as far as it isn't written yet.

    What is closed is a slice of one landed batch: rows that arrive for a slice after it was closed come
    in a later batch and are correlated by the next call.  Rows without a time have a slice of their own
    that is always due; they can still match by id.
    """
    width = slice_s * 1_000_000
    last = (up_to_us - int(rules.window_s * 1e6)) // width  # slices below this are complete
    tx = spark.read.parquet(f"{folder}/tx").filter(F.col("time_slice") < last)
    obs = spark.read.parquet(f"{folder}/obs")
    out = f"{folder}/matched"
    if _exists(spark, out):
        tx = tx.join(spark.read.parquet(out).select("time_slice", "batch_id").distinct(), ["time_slice", "batch_id"], "left_anti")
    matched = join_network(tx, obs.drop("batch_id", "time_slice"), rules.window_s)
    (
        matched.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("time_slice", "batch_id")
        .parquet(out)
    )
    return spark.read.parquet(out)


def hourly_stream(tx: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Tumbling one-hour counts and volume, append mode behind a watermark."""
    return (
        tx.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "1 hour"))
        .agg(F.count("*").alias("tx_count"), F.sum(F.col("input_total") + F.col("output_total")).alias("volume"))
        .select(F.col("window.start").alias("hour_start"), "tx_count", "volume")
    )
