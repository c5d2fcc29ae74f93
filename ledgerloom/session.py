"""Session defaults and the checkpoint folder."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark removes the shuffle files of an action when it ends, not when the driver next collects garbage.
FREEING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app: str = "ledgerloom", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder the cluster names; make a local one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="ledgerloom-ckpt-")
    sc.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def freeing(spark: SparkSession):
    """Actions of tables that are made in here leave no shuffle files."""
    before = spark.conf.get(FREEING, None)
    spark.conf.set(FREEING, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREEING) if before is None else spark.conf.set(FREEING, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later rounds of an iteration read files, not a growing plan. What was shuffled for it is removed."""
    ensure_checkpoint_dir(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> DataFrame:
    """Like `cut` for tables with a row for each leg: compressed columns take a fraction of a checkpoint's rows.

    Times are kept as microseconds, so that no calendar of the file format touches them.
    """
    spark, times = df.sparkSession, {c for c, t in df.dtypes if t == "timestamp"}
    folder = scratch(spark, name)
    with freeing(spark):
        df.select(*[F.unix_micros(c).alias(c) if c in times else F.col(c) for c in df.columns]).write.parquet(folder, compression="zstd")
    back = spark.read.parquet(folder)
    return back.select(*[F.timestamp_micros(c).alias(c) if c in times else F.col(c) for c in df.columns])


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `cut` returned and nothing reads any more."""
    sc = df.sparkSession.sparkContext
    named = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if named.isDefined():
        path = sc._jvm.org.apache.hadoop.fs.Path(named.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
