"""Exact deduplication as a stateful stream.

A streaming aggregation keyed by the digest of the normalised text keeps, in RocksDB on disk and without expiry, for
every digest seen: the smallest identifier, the content locator of that row (file and row in it) and a count. The state
is read back as a table after each drain, so further files only cost their own rows. A digest hit alone drops nothing:
the full normalised bytes of every hit are compared with those of the row that the locator names, and rows whose bytes
differ form groups of their own.

Defined results: null text counts as empty; a null id is larger than any other; of rows with equal id and text the one
first in (file, row) order stays; an empty table gives an empty result; other columns are carried inside one struct, so
their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import BLANK, read, shared_if_small
from ledgerloom.session import scratch

ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else every state partition reserves megabytes of disk
}
#: Copies of one text that are compared with one copy of the row that stays, in one task.
COPIES_PER_TASK = 2000


def folded(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(df: DataFrame, doc_id: str, text: str, digest: Callable[[Column], Column]) -> DataFrame:
    """(digest, place): place orders rows by id, then by where they are stored."""
    at = df.metadataColumn("_metadata")
    # streams and batches write the same path with one or three slashes
    file = F.regexp_replace(at["file_path"], "^([A-Za-z0-9]+):/+", "$1:/")
    place = F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("id"), file.alias("file"), at["row_index"].alias("row"))
    return df.select(*df.columns, place.alias("__place"), digest(folded(F.col(text))).alias("__digest"))


def drain(spark: SparkSession, folder: str, doc_id: str, text: str, state: str, digest=sha256, files_per_batch: int | None = None) -> None:
    """Run every file of `folder` that `state` has not seen through the keyed state."""
    glob = f"{folder.rstrip('/')[:-1]}[{folder.rstrip('/')[-1]}]"  # a stream takes a single file only as a pattern
    files = files_per_batch or 2 * spark.sparkContext.defaultParallelism
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", files).parquet(glob)
        seen = _located(stream, doc_id, text, digest).groupBy("__digest").agg(F.min("__place").alias("keep"), F.count(F.lit(1)).alias("n"))
        job = seen.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        job.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_table(spark: SparkSession, state: str) -> DataFrame:
    """(__digest, __keep, __n) for every digest seen so far, read from the state store."""
    rows = spark.read.format("statestore").load(state)
    return rows.select(F.col("key.__digest"), F.col("value.min").alias("__keep"), F.col("value.count").alias("__n"))


def _unequal(rows: DataFrame, groups: DataFrame, text: str) -> DataFrame:
    """Rows of `rows` (joined with their group) whose normalised bytes aren't those of the row that stays."""
    salts = F.ceil(F.col("__n") / COPIES_PER_TASK).cast("int")
    hits = rows.select("__digest", "__place", "__keep", "__n", folded(F.col(text)).alias("__text"))
    own = F.col("__place") == F.col("__keep")
    firsts = hits.filter(own).select("__digest", F.explode(F.sequence(F.lit(0), salts - 1)).alias("__salt"), F.col("__text").alias("__first"))
    copies = hits.filter(~own).withColumn("__salt", F.pmod(F.xxhash64("__place"), salts).cast("int"))
    return copies.join(firsts, ["__digest", "__salt"]).filter(F.col("__text").cast("binary") != F.col("__first").cast("binary"))


def decide(spark: SparkSession, folder: str, doc_id: str = "doc_id", text: str = "text", state: str | None = None, digest=sha256, files_per_batch: int | None = None) -> DataFrame:
    """Every row of the Parquet table `folder` with __digest, __place, __keep (place of the row that stays) and __n (rows of its text).

    `state` is the folder of the keyed state; given again with more files, only the new ones run through the stream.
    """
    if state is None:
        state = scratch(spark, "dedup-state")
    rows = _located(spark.read.parquet(folder), doc_id, text, digest)
    if rows.isEmpty():
        place = rows.schema["__place"].dataType
        return rows.withColumn("__keep", F.lit(None).cast(place)).withColumn("__n", F.lit(None).cast("long"))
    drain(spark, folder, doc_id, text, state, digest, files_per_batch)
    groups = state_table(spark, state).filter("__n > 1")
    groups = shared_if_small(groups, groups.count(), 250)
    joined = rows.join(groups, "__digest", "left")
    unequal = _unequal(rows.join(groups, "__digest"), groups, text)
    keep, n = F.coalesce("__keep", "__place"), F.coalesce("__n", F.lit(1).cast("long"))
    if unequal.isEmpty():
        return joined.withColumn("__keep", keep).withColumn("__n", n)
    # digests that hit with other bytes: the rows left over are grouped by the bytes themselves
    again = unequal.groupBy("__digest", "__text").agg(F.min("__place").alias("__keep2"), F.count(F.lit(1)).alias("__n2"))
    fixed = unequal.select("__digest", "__text", "__place").join(again, ["__digest", "__text"]).select("__place", "__keep2", "__n2")
    lost = unequal.groupBy("__digest").agg(F.count(F.lit(1)).alias("__lost"))
    joined = joined.join(fixed, "__place", "left").join(lost, "__digest", "left")
    return (
        joined.withColumn("__keep", F.coalesce("__keep2", keep)).withColumn("__n", F.coalesce("__n2", n - F.coalesce("__lost", F.lit(0)))).drop("__keep2", "__n2", "__lost")
    )


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of any frame that stay, columns unchanged."""
    spark = docs.sparkSession
    folder = scratch(spark, "dedup-rows")
    docs.select(F.struct("*").alias("doc")).write.parquet(folder, compression="zstd")
    rows = decide(spark, folder, f"doc.`{doc_id}`", f"doc.`{text}`")
    return rows.filter(F.col("__keep").isNull() | (F.col("__keep") == F.col("__place"))).select("doc.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decide(spark, f"{sf_dir}/documents.parquet")
    return rows.select(
        "doc_id", F.col("__keep.id").alias("keep_id"), F.col("__n").alias("group_size"), (F.col("__keep") == F.col("__place")).alias("kept"), F.col("__digest").alias("text_sha256"),
    )


OP2_SQL = """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM t WINDOW w AS (PARTITION BY body)
"""

__all__ = ["decide", "drain", "drop_copies", "folded", "op2_exact_dedup", "read", "state_table"]
