"""What several operators share: scratch tables and a checked broadcast."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import scratch

#: A side of a join goes to every task only below this many bytes; beyond it Spark shuffles both sides.
BROADCAST_BYTES = 32 << 20

#: The blanks of the contracts, as a Java and Python character class.
BLANK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Arrow batches of whole texts: a thousand rows or eight megabytes instead of ten thousand and 64, so that buffers stay small on both sides."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now > most or now <= 0:
            spark.conf.set(key, str(most))


def release() -> None:
    """At the end of a partition: a Python worker that waits for its next task gives back what it no longer uses."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        pass


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared scratch folder and go on from the files: later readers don't repeat the work, and lost executors lose nothing."""
    spark = df.sparkSession
    folder = scratch(spark, name)
    df.write.parquet(folder, compression="zstd")
    return spark.read.schema(df.schema).parquet(folder)


def shared_if_small(df: DataFrame, rows: int, bytes_per_row: int) -> DataFrame:
    """df for a broadcast join if its counted rows fit the bound, else unchanged for a shuffled join."""
    return F.broadcast(df) if rows * bytes_per_row <= BROADCAST_BYTES else df


def held_out(doc_id: str, of: int, remainder: int):
    """Whether crc32 of the id as text leaves this remainder; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % of == remainder, F.lit(False))


#: A key with more than this share of the rows (one of so many parts) is dealt to several tasks.
HOT_PARTS, LEAST_PART = 10_000, 1000


def join_dealt(rows: DataFrame, stats: DataFrame, keys: list[str], salt: list[str], n: str = "n") -> DataFrame:
    """Inner join of rows with stats (one row for each value of keys, n its number of rows), nulls equal nulls.

    Keys with more than 1/HOT_PARTS of all rows are dealt to pieces by a hash of the salt columns; they are fewer than
    HOT_PARTS, so their list goes to every task, and their rows of stats repeat once for each piece.
    stats should be stored: it is read several times.
    """
    total = stats.agg(F.sum(n)).first()[0] or 0
    part = max(LEAST_PART, total // HOT_PARTS)
    pieces = F.ceil(F.col(n) / F.lit(part)).cast("int")
    hot = stats.filter(F.col(n) > part).select(*[F.col(k).alias(f"__hot_{k}") for k in keys], pieces.alias("__pieces"))
    same = lambda a, b: [F.col(x).eqNullSafe(F.col(y)) for x, y in zip(a, b)]
    dealt = rows.join(F.broadcast(hot), same(keys, [f"__hot_{k}" for k in keys]), "left")
    dealt = dealt.withColumn("__piece", F.coalesce(F.pmod(F.xxhash64(*salt), F.col("__pieces")).cast("int"), F.lit(0)))
    other = stats.withColumn("__own", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), pieces) - 1)))
    other = other.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    joined = dealt.join(other, same([*keys, "__piece"], [*[f"__key_{k}" for k in keys], "__own"]))
    return joined.drop(*[f"__hot_{k}" for k in keys], *[f"__key_{k}" for k in keys], "__pieces", "__piece", "__own")
