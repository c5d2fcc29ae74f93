"""Streams over several micro-batches against the batch operators, in full rows."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.correlate import join_network
from ledgerloom.operators.ingest import ingest
from ledgerloom.plans import catalog
from ledgerloom.sources import star
from ledgerloom.streaming import jobs

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_ingest_stream_equals_batch(spark, tmp_path):
    raw = star.raw_records(spark, SF)
    stream = catalog._landed_in_parts(raw, "t", catalog._thirds(raw, "src_pos"))
    out = str(tmp_path / "out")
    jobs.start_ingest_stream(stream, out, str(tmp_path / "state")).awaitTermination()
    want = ingest(raw)
    for name in ("transactions", "legs", "observations", "rejects", "tx_classes"):
        got = spark.read.option("basePath", f"{out}/{name}").parquet(f"{out}/{name}")
        assert got.isEmpty() or got.select("batch_id").distinct().count() == 3
        cols = [c for c in got.columns if c not in ("batch_id", "time_assumed", "ts")]
        assert rows(got.select(*cols)) == rows(getattr(want, name).select(*cols)), name
    copies = spark.read.option("basePath", f"{out}/duplicates").parquet(f"{out}/duplicates").groupBy("txid").agg(F.sum("copies").alias("copies"))
    assert rows(copies) == rows(want.duplicates) and copies.count() > 0


def test_wallet_merge_fails_without_its_earlier_version(spark, tmp_path):
    legs = star.legs(spark, SF).join(star.tx_times(spark, SF), "txid").select("txid", "direction", "address", "amount", "leg_no", "ts").limit(200)
    stream = catalog._landed_in_parts(legs, "t", F.pmod(F.xxhash64("txid"), F.lit(3)))
    out = str(tmp_path / "out")
    jobs.start_wallet_merge(stream, out, str(tmp_path / "state")).awaitTermination()
    total = jobs.latest_version(spark, out).agg(F.sum("tx_count")).first()[0]
    assert total == legs.count() and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["version=1", "version=2"]
    folder = str(tmp_path / "legs")
    legs.coalesce(1).write.parquet(folder)
    feed = lambda: spark.readStream.schema(legs.schema).parquet(folder)
    bare = str(tmp_path / "bare")
    jobs.start_wallet_merge(feed(), bare, str(tmp_path / "state2")).awaitTermination()
    jobs._drop(spark, f"{bare}/version=0")
    legs.coalesce(1).write.mode("append").parquet(folder)
    with pytest.raises(Exception, match="is missing"):
        jobs.start_wallet_merge(feed(), bare, str(tmp_path / "state2")).awaitTermination()


def test_late_and_timeless_rows_are_correlated(spark, tmp_path):
    day = 86_400 * 1_000_000
    tx = spark.createDataFrame([("a", day), ("b", None), ("c", 2 * day), ("d", day + 5), ("e", 40 * day)], "txid string, ts_us long")
    obs = spark.createDataFrame([(0, day + 1_000_000, "b", "1.1.1.1"), (1, 2 * day, None, "2.2.2.2")], "obs_id long, obs_us long, network_txid string, src_ip string")
    obs = obs.select("*", F.lit(1).alias("src_port"), F.lit("9").alias("dst_ip"), F.lit(1).alias("dst_port"), F.lit("t").alias("network_timestamp"))
    late = F.when(F.col("txid").isin("d"), 1).otherwise(0)
    out, state, folder = str(tmp_path / "out"), str(tmp_path / "state"), str(tmp_path / "tx")
    parts = tx.withColumn("p", late)
    parts.filter("p = 0").drop("p").coalesce(1).write.parquet(folder)
    feed = lambda: spark.readStream.schema(tx.schema).parquet(folder)
    for q in jobs.start_correlation_stream(feed(), catalog._landed(obs, "obs"), out, state):
        q.awaitTermination()
    assert {r.txid for r in jobs.close_slices(spark, out, 10 * day).collect()} == {"a", "b", "c"}
    parts.filter("p = 1").drop("p").coalesce(1).write.mode("append").parquet(folder)
    for q in jobs.start_correlation_stream(feed(), catalog._landed(obs, "obs"), out, state)[:1]:
        q.awaitTermination()
    got = jobs.close_slices(spark, out, 100 * day)
    cols = ["txid", "correlation_method", "network_confidence", "src_ip"]
    assert rows(got.select(*cols)) == rows(join_network(tx, obs).select(*cols))


@pytest.mark.parametrize("name", ["st2_stream_dedupe", "st6_hourly_stream"])
def test_bounded_state_streams_lose_nothing(spark, name):
    from harness import compare, duck

    import __spark_entry__ as e

    ok, message, _ = compare(spark, duck(SF), name, e.queries()[name], e.oracle_sql()[name], SF)
    assert ok, message
