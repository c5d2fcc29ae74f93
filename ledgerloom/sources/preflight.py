"""Checks before a correlation run, and batch ingest in which each file stands alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import EXPECTED_FILES
from ..functions.text import blank_to_null
from .correlation_files import detect_schema, read_text_table
from .ledger_files import read_ledger

REPORT = (
    "file string, present boolean, size_bytes long, columns string, rows_checked long, "
    "missing_txid long, time_errors long, status string"
)


def _file_size(spark: SparkSession, path: str) -> int | None:
    jvm = spark._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.getFileStatus(hadoop_path).getLen() if fs.exists(hadoop_path) else None


def table_profile(df: DataFrame, sample_rows: int = 5000, time_rows: int = 100) -> DataFrame:
    """Null ids in the first rows and unreadable times in the first filled ones: one row."""
    found = detect_schema(df.columns, "transaction")
    txid, time = found["txid"], found["timestamp"]
    head = df.select(
        (F.col(f"`{txid}`") if txid else F.lit(None)).cast("string").alias("txid"),
        (F.col(f"`{time}`") if time else F.lit(None)).cast("string").alias("ts"),
    ).limit(sample_rows)
    counts = head.agg(
        F.count("*").alias("rows_checked"),
        F.count_if(blank_to_null("txid").isNull()).alias("missing_txid"),
    )
    times = head.filter(blank_to_null("ts").isNotNull()).limit(time_rows)
    readable = F.col("ts").try_cast("double").isNotNull() | F.col("ts").try_cast("timestamp").isNotNull()
    errors = times.agg(F.count_if(~readable).alias("time_errors"))
    return counts.withColumn("time_errors", errors.scalar())


def preflight(spark: SparkSession, folder: str, sample_rows: int = 5000) -> DataFrame:
    """One report row per expected file; the run is valid only if the feature file is there."""
    rows = []
    for i, name in enumerate(EXPECTED_FILES):
        path = f"{folder.rstrip('/')}/{name}"
        size = _file_size(spark, path)
        if size is None:
            status = "CRITICAL_MISSING_FILES" if i == 0 else "MISSING"
            rows.append((name, False, None, None, None, None, None, status))
            continue
        try:
            table = read_text_table(spark, path)
            cols, checked, no_id, bad_time, status = ",".join(table.columns), None, None, None, "OK"
            if i == 0:
                p = table_profile(table, sample_rows).first()
                checked, no_id, bad_time = p.rows_checked, p.missing_txid, p.time_errors
                if detect_schema(table.columns)["txid"] is None:
                    status = "WARNING_MISSING_TXID_COLUMN"
            rows.append((name, True, size, cols, checked, no_id, bad_time, status))
        except Exception as error:  # a broken file is a finding, not a failure of the check
            rows.append((name, True, size, None, None, None, None, f"ERROR: {error}"))
    return spark.createDataFrame(rows, REPORT)


def ingest_many(spark: SparkSession, paths: list[str], ingest_one) -> tuple[list, DataFrame]:
    """Run `ingest_one(raw records, path)` per file; a bad file ends as a FAILED status row.

    Returns the results of the files that worked and a status table over all of them.
    """
    done, status = [], []
    for path in paths:
        try:
            raw = read_ledger(spark, path)
            if raw.isEmpty():
                raise ValueError("file holds no records")
            done.append(ingest_one(raw, path))
            status.append((path, "COMPLETED", None))
        except Exception as error:
            status.append((path, "FAILED", str(error)))
    return done, spark.createDataFrame(status, "path string, status string, error string")
