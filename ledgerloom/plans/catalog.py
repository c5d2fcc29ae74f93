"""Registered queries: one per operator, each over whole tables.

`tests` and the entry module run them next to the SQL in catalog_sql.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import snap
from ..config import ModelRules
from ..functions import address as ad
from ..functions import clock, text
from ..functions.tables import WALLET_FEATURES
from ..operators import checks, clusters, correlate, evaluate, features, geo, graph, ingest, investigate, outliers
from ..operators import prioritize, profiles, quality, validate
from ..session import cut, kept, scratch
from ..sources import correlation_files as cfiles
from ..sources import ledger_files, preflight, sinks, star
from ..streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RUN_TIME = "2024-02-01 00:00:00"
DAY0 = "1998-01-01 00:00:00"


def query(fn: Query) -> Query:
    @functools.wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


def r(c, digits: int = 6) -> Column:
    return snap(F.col(c) if isinstance(c, str) else c, digits)


def us(c: str) -> Column:
    return F.unix_micros(c)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded, so sums in any order compare equal."""
    return df.select(
        *[snap(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )


def run_time() -> Column:
    return F.lit(RUN_TIME).cast("timestamp")


def raw_ledger(spark, sf) -> ingest.Ledger:
    return ingest.ingest(star.raw_records(spark, sf), run_time())


def star_ledger(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    return star.transactions(spark, sf), star.legs(spark, sf), star.observations(spark, sf)


def star_features(spark, sf) -> DataFrame:
    """Written once: most users read the features several times."""
    return cut(features.wallet_features(star.tx_times(spark, sf), star.legs(spark, sf), star.observations(spark, sf)))


def planted_score(df: DataFrame) -> DataFrame:
    """A fixed outlier score for checks that should not depend on a fitted model."""
    return df.withColumn("anomaly_score", snap(F.least(F.lit(1.0), F.col("max_tx_amount") / 50.0), 4))


def scored_wallets(spark, sf, f: DataFrame | None = None) -> DataFrame:
    """`f`: the features, where a query has them already."""
    return prioritize.priority(planted_score(star_features(spark, sf) if f is None else f))


def event_matched(spark, sf) -> DataFrame:
    tx = correlate.tx_class(star.event_transactions(spark, sf), event_labels(spark, sf))
    counts = correlate.wallet_counts(correlate.wallet_links(star.event_transactions(spark, sf), star.event_edges(spark, sf)))
    tx = tx.join(counts, "txid", "left").withColumn("wallet_count", F.coalesce("wallet_count", F.lit(0)))
    return correlate.join_network(tx, star.event_capture(spark, sf))


def event_labels(spark, sf) -> DataFrame:
    return cfiles.labels(star.event_tx_labels(spark, sf), "key", "code", "pos")


def event_scored(spark, sf) -> DataFrame:
    return correlate.score_leads(correlate.tx_vector(event_matched(spark, sf)))


def event_run(spark, sf) -> correlate.Correlated:
    return correlate.correlate(
        star.event_transactions(spark, sf),
        star.event_edges(spark, sf),
        event_labels(spark, sf),
        cfiles.labels(star.wallet_labels(spark, sf), "key", "code", "pos"),
        star.event_capture(spark, sf),
    )


# --- sources and sinks ------------------------------------------------------------------------


def _flat_raw(spark, sf) -> DataFrame:
    """Raw records as file rows: the columns of a ledger file."""
    return star.raw_records(spark, sf).select(
        "txid", "timestamp", "fee", "script_type", "input_addresses", "output_addresses", "input_amounts",
        "output_amounts", "src_ip", "dst_ip", "src_port", "geo_country", "asn",
    )


def _file_view(raw: DataFrame) -> DataFrame:
    return raw.select(
        "record_type",
        F.coalesce("txid", F.lit("")).alias("txid"),
        "timestamp",
        "fee",
        "script_type",
        F.array_join("input_addresses", "~").alias("ins"),
        F.array_join("output_addresses", "~").alias("outs"),
        F.array_join("input_amounts", "~").alias("in_amts"),
        F.array_join("output_amounts", "~").alias("out_amts"),
        "src_ip",
        "src_port",
        "geo_country",
        "asn",
    )


@query
def in1_csv_ledger(spark, sf):
    folder = scratch(spark, "csv")
    joined = {c: F.concat_ws(";", c).alias(c) for c in ledger_files.LIST_FIELDS}
    # some cells hold a line break
    note = F.when(F.col("txid").endswith("7"), F.concat("script_type", F.lit("\nsecond line"))).otherwise(F.col("script_type"))
    flat = _flat_raw(spark, sf).withColumn("script_type", note)
    flat.select(*[joined.get(c, F.col(c)) for c in flat.columns]).withColumnRenamed("txid", "Tx-Hash").withColumnRenamed(
        "geo_country", "Country"
    ).write.option("header", True).csv(folder)
    return _file_view(ledger_files.read_ledger_csv(spark, folder))


@query
def in2_record_kinds(spark, sf):
    parts = {
        "tx": _flat_raw(spark, sf).select("txid", "fee", F.concat_ws(";", "input_addresses").alias("inputs")),
        "wallet": star.table(spark, sf, "labels").select(F.concat(F.lit("U"), "doc_id").alias("address"), F.col("toxic").alias("class")),
        "class": star.table(spark, sf, "labels").select(F.concat(F.lit("TX"), "doc_id").alias("txid"), F.col("quality").alias("class")),
    }
    out = None
    for name, df in parts.items():
        folder = scratch(spark, f"kind-{name}")
        df.write.option("header", True).csv(folder)
        got = ledger_files.read_ledger_csv(spark, folder)
        out = got if out is None else out.unionByName(got)
    return out.groupBy("record_type").agg(F.count("*").alias("n"), F.count_distinct("class").alias("classes"))


@query
def in3_json_ledger(spark, sf):
    folder = scratch(spark, "json")
    _flat_raw(spark, sf).withColumnRenamed("txid", "tx_hash").withColumnRenamed("output_amounts", "amounts").write.json(folder)
    return _file_view(ledger_files.read_ledger_json(spark, folder))


@query
def in4_xml_ledger(spark, sf):
    folder = scratch(spark, "xml")
    flat = _flat_raw(spark, sf)
    nested = {c: F.struct(F.col(c).alias("item")).alias(c) for c in ledger_files.LIST_FIELDS}
    shown = flat.select(*[nested.get(c, F.col(c)) for c in flat.columns])
    other = F.coalesce(F.col("txid").endswith("3"), F.lit(False))
    # two record tags in one set of files
    for tag, rows in (("transaction", shown.filter(~other)), ("tx", shown.filter(other))):
        rows.write.format("xml").option("rowTag", tag).option("rootTag", "transactions").mode("append").save(folder)
    return _file_view(ledger_files.read_ledger_xml(spark, folder))


@query
def in5_list_columns(spark, sf):
    rec = star.raw_records(spark, sf).filter("copy = 0").select("order_key", "output_addresses")
    a, k = F.col("output_addresses"), F.col("order_key") % 6
    shown = (
        F.when(k == 0, F.array_join(a, ";"))
        .when(k == 1, F.array_join(a, " | "))
        .when(k == 2, F.array_join(a, ", "))
        .when(k == 3, F.to_json(a))
        .when((k == 4) & (F.size(a) == 0), F.lit("[]"))
        .when(k == 4, F.concat(F.lit("['"), F.array_join(a, "', '"), F.lit("']")))
        .otherwise(F.concat(F.lit("("), F.array_join(a, ";"), F.lit(")")))
    )
    parsed = text.split_list(shown)
    return rec.select("order_key", F.array_join(parsed, "~").alias("items"), F.size(parsed).alias("n"))


@query
def in6_schema_detection(spark, sf):
    e = star.table(spark, sf, "events").select(
        F.col("event_id").alias("Tx_ID"), F.col("ts").cast("string").alias("my_block_time_utc"), F.col("value").alias("Fees"), F.col("user_id").alias("sender_input_addresses_x")
    )
    got = cfiles.resolve_columns(e, "transaction")
    return got.agg(
        F.count("txid").alias("txid"), F.count("timestamp").alias("timestamp"), F.count("fee").alias("fee"),
        F.count("script_type").alias("script_type"), F.count("input_addresses").alias("input_addresses"),
        F.count("output_addresses").alias("output_addresses"), r(F.sum(F.col("fee").cast("decimal(18,2)")).cast("double"), 2).alias("fee_sum"),
    )


@query
def in7_txid_normalised(spark, sf):
    k = F.col("o_orderkey")
    shown = F.when(k % 4 == 0, F.concat(k, F.lit(".0"))).when(k % 4 == 1, F.concat(F.lit("  "), k, F.lit(" "))).when(k % 4 == 2, F.concat(F.lit("T"), k))
    return star.table(spark, sf, "orders").select("o_orderkey", text.norm_txid(shown).alias("txid"))


@query
def in8_tx_features(spark, sf):
    o = star.table(spark, sf, "orders")
    k, hit = F.col("o_orderkey"), lambda n: F.col("o_orderkey") % n == 0
    wide = o.select(
        F.when(hit(31), F.lit(None)).otherwise(F.concat(k.cast("string"), F.lit(".0"))).alias("txId"),
        F.when(hit(7), F.lit(None)).otherwise((k % 49 + 1).cast("string")).alias("Time step"),
        F.when(hit(5), F.lit("n/a")).otherwise((k % 9 * 0.001).cast("decimal(9,3)").cast("string")).alias("fees"),
        F.when(hit(3), F.lit(None)).otherwise((k % 11 + 1).cast("string")).alias("num_input_addresses"),
        F.when(hit(2), F.concat(F.lit("CW"), "o_custkey", F.lit(",CW0"))).alias("input_addresses"),
        (k % 13 + 1).cast("string").alias("in_txs_degree"),
        F.when(hit(6), F.lit(None)).otherwise((k % 17 + 1).cast("string")).alias("out_txs_degree"),
        F.when(hit(4), F.concat(F.lit("["), (k % 100).cast("string"), F.lit(", bad, 2.5]"))).alias("input_amounts"),
        F.when(hit(8), F.lit(None)).otherwise((k % 1000).cast("string")).alias("total_BTC"),
        k.alias("pos"),
    )
    got = cfiles.tx_features(wide, order_by="pos")
    return got.select(
        "txid", "timestamp", "ts_us", r("fee").alias("fee"), "script_type", "input_count", "output_count", "fan_in", "fan_out",
        r("total_input_amount").alias("total_input_amount"), r("amount_per_output").alias("amount_per_output"),
    )


@query
def in9_amount_lists(spark, sf):
    o = star.table(spark, sf, "orders")
    k = F.col("o_orderkey")
    shown = (
        F.when(k % 4 == 0, F.concat(F.lit("["), k % 50, F.lit(".5, 20.0, x]")))
        .when(k % 4 == 1, F.concat(k % 50, F.lit(";7.25;;bad")))
        .when(k % 4 == 2, F.concat(k % 50, F.lit(" 3.5 'n'")))
    )
    got = text.split_amounts(shown)
    return o.select("o_orderkey", F.size(got).alias("n"), F.aggregate(got, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query
def in10_capture(spark, sf):
    u = F.col("user_id")
    frame = star.table(spark, sf, "events").select(
        F.col("event_id").alias("obs_id"),
        F.when(u % 11 == 0, F.lit("not a time")).otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")).alias("capture_time"),
        F.when(u % 5 == 0, F.lit("")).otherwise(star.relay_ip("user_id")).alias("source_ip"),
        F.when(u % 3 == 0, F.lit("http")).otherwise((u % 1000).cast("string")).alias("sport"),
        F.when(u % 2 == 0, F.concat(F.col("event_id"), F.lit(".0"))).alias("tx_id"),
    )
    return cfiles.capture(frame).drop("network_timestamp")


@query
def in11_labels(spark, sf):
    return event_labels(spark, sf)


@query
def in12_edge_sets(spark, sf):
    return cfiles.edge_sets(star.event_edges(spark, sf))


@query
def in13_edge_filter(spark, sf):
    targets = star.event_transactions(spark, sf).filter("k % 3 = 0").select("txid")
    return cfiles.keep_edges(star.event_edges(spark, sf), targets).groupBy("side").agg(
        F.count("*").alias("edges"), F.count_distinct("address").alias("addresses")
    )


@query
def in14_utc_times(spark, sf):
    e = star.table(spark, sf, "events").withColumn("t", F.date_trunc("second", F.col("ts").cast("timestamp")))
    k, sec = F.col("event_id") % 5, F.unix_seconds("t")
    shown = (
        F.when(k == 0, F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, sec.cast("string"))
        .when(k == 2, (sec * 1000).cast("string"))
        .when(k == 3, F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.lit("no time"))
    )
    return e.select("event_id", us(clock.to_utc(shown, run_time())).alias("ts_us"))


@query
def in15_epochs(spark, sf):
    e = star.table(spark, sf, "events").withColumn("t", F.date_trunc("second", F.col("ts").cast("timestamp")))
    k, sec = F.col("event_id") % 4, F.unix_seconds("t")
    shown = (
        F.when(k == 0, F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
        .when(k == 1, sec.cast("string"))
        .when(k == 2, (F.col("event_id") % 49 + 1).cast("string"))
        .otherwise(F.lit("no time"))
    )
    return e.select("event_id", clock.to_epoch(shown).alias("epoch"))


@query
def in16_preflight(spark, sf):
    folder = scratch(spark, "preflight")
    tx = star.event_transactions(spark, sf)
    tx.select("txid", "timestamp", "fee").write.option("header", True).csv(f"{folder}/txs_features.csv")
    event_labels(spark, sf).select(F.col("key").alias("txId"), "class").write.option("header", True).csv(f"{folder}/txs_classes.csv")
    return preflight.preflight(spark, folder).select("file", "present", "missing_txid", "time_errors", "status")


@query
def in17_many_files(spark, sf):
    folder = scratch(spark, "many")
    flat = _flat_raw(spark, sf)
    flat.write.json(f"{folder}/a.json")
    star.table(spark, sf, "labels").select(F.concat(F.lit("U"), "doc_id").alias("address"), F.col("toxic").alias("class")).write.option("header", True).csv(f"{folder}/b.csv")
    star.table(spark, sf, "nation").select("n_name").write.text(f"{folder}/c.xml")
    paths = [f"{folder}/{n}" for n in ("a.json", "b.csv", "c.xml", "missing.csv")]
    done, status = preflight.ingest_many(spark, paths, lambda raw, path: raw.withColumn("path", F.lit(path)))
    rows = done[0].select("path")
    for d in done[1:]:
        rows = rows.unionByName(d.select("path"))
    counts = rows.groupBy("path").agg(F.count("*").alias("records"))
    return status.join(counts, "path", "left").select(
        F.element_at(F.split("path", "/"), -1).alias("file"), "status", F.coalesce("records", F.lit(0)).alias("records")
    )


@query
def in18_row_cap(spark, sf):
    tx = star.event_transactions(spark, sf)
    return cfiles.head_rows(tx.withColumn("pos", F.col("txid").cast("long")), 150, "pos").select("txid", "timestamp")


@query
def in19_correlation_sink(spark, sf):
    folder = scratch(spark, "corr")
    sinks.write_correlation(event_run(spark, sf), folder)
    read = lambda n: spark.read.option("header", True).csv(f"{folder}/{n}")
    out = None
    for n in ("transaction_correlations", "investigation_leads", "graph_edges"):
        part = read(n).agg(F.lit(n).alias("output"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def in20_ledger_sink(spark, sf):
    folder = scratch(spark, "ledger")
    sinks.write_ledger(raw_ledger(spark, sf), folder, "d1")
    out = None
    for n in ("transactions", "legs", "observations", "rejects"):
        part = spark.read.parquet(f"{folder}/{n}").groupBy("dataset_id").agg(F.count("*").alias("n")).withColumn("output", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


# --- validation, normalisation, quality -----------------------------------------------------------


@query
def dq1_reject_reasons(spark, sf):
    checked = checks.with_reject_reason(star.raw_records(spark, sf))
    return checked.select("src_pos", F.coalesce("reason", F.lit("")).alias("reason"))


@query
def dq2_patterns(spark, sf):
    raw = star.raw_records(spark, sf)
    return raw.select(
        "src_pos",
        ad.valid_txid("txid").alias("txid_ok"),
        F.forall("input_addresses", ad.valid_address).alias("inputs_ok"),
        F.forall("output_addresses", ad.valid_address).alias("outputs_ok"),
    )


@query
def dq3_ip_validity(spark, sf):
    o = star.raw_observations(spark, sf)
    return o.groupBy("src_ip").agg(F.count("*").alias("n")).select("src_ip", "n", ad.valid_ip("src_ip").alias("ok"))


@query
def dq4_amount_alignment(spark, sf):
    raw = star.raw_records(spark, sf)
    pairs = raw.withColumn("p", checks.align_amounts("output_addresses", "output_amounts"))
    return pairs.select("src_pos", F.size("p").alias("n"), r(checks.total("p")).alias("total"))


@query
def dq5_canonical_fields(spark, sf):
    return star.raw_records(spark, sf).select(
        "src_pos", checks.clean_fee("fee").alias("fee"), checks.clean_script("script_type").alias("script_type"), checks.clean_port("src_port").alias("src_port")
    )


@query
def dq6_class_seeds(spark, sf):
    score, anomaly = checks.class_seed("code")
    return star.wallet_labels(spark, sf).select("key", score.alias("risk_score"), anomaly.alias("anomaly_score"))


@query
def dq7_geo_enrichment(spark, sf):
    raw = star.raw_records(spark, sf).withColumnRenamed("geo_country", "country")
    return geo.fill_geo(raw).select("src_pos", "country", "asn")


@query
def dq8_geo_fallback(spark, sf):
    o = star.raw_observations(spark, sf).groupBy("src_ip").agg(F.count("*").alias("n"))
    return o.withColumn("g", geo.fallback_geo("src_ip")).select("src_ip", "n", "g.country", "g.asn", "g.org")


@query
def dq9_dedupe(spark, sf):
    raw = star.raw_records(spark, sf).filter("txid <> ''")
    kept, extra = ingest.first_by_txid(raw, ["src_file", "src_pos"])
    return kept.join(extra, "txid", "left").select("txid", "src_pos", F.coalesce("copies", F.lit(0)).alias("copies"))


@query
def dq10_quality_report(spark, sf):
    rep = quality.quality_report(raw_ledger(spark, sf))
    return rep.withColumn("time_min", us("time_min")).withColumn("time_max", us("time_max"))


@query
def dq11_completeness(spark, sf):
    return quality.completeness(raw_ledger(spark, sf))


@query
def dq12_reject_histogram(spark, sf):
    led = raw_ledger(spark, sf)
    return quality.reject_histogram(led.rejects, led.duplicates)


@query
def dq13_leg_explode(spark, sf):
    return ingest.legs_of(raw_ledger(spark, sf).normalized).select("txid", "direction", "leg_no", "address", r("amount").alias("amount"))


@query
def dq14_top_legs(spark, sf):
    top = ingest.top_legs(star.legs(spark, sf), 3)
    return top.select("txid", "direction", "address", r("amount").alias("amount"), "leg_no")


@query
def dq15_observations(spark, sf):
    return raw_ledger(spark, sf).observations.select("txid", us("ts").alias("ts_us"), "src_ip", "src_port", "country", "asn")


def _rollup_view(w: DataFrame) -> DataFrame:
    return w.select(
        "address", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), r("total_received").alias("total_received"),
        r("total_sent").alias("total_sent"), "tx_count", "risk_score", r("anomaly_score", 4).alias("anomaly_score"),
    )


def _wallets(spark, sf) -> DataFrame:
    return ingest.wallet_rollup(star.legs(spark, sf), star.tx_times(spark, sf))


@query
def dq16_wallet_merge(spark, sf):
    tx, legs = star.tx_times(spark, sf), star.legs(spark, sf)
    old = F.col("ts") < F.lit(DAY0).cast("timestamp")
    first = ingest.wallet_rollup(legs, tx.filter(old)).withColumn("risk_score", F.lit(40)).withColumn("anomaly_score", F.lit(0.35))
    later = ingest.wallet_rollup(legs, tx.filter(~old))
    scored = later.withColumn("risk_score", F.when(F.col("tx_count") > 15, F.lit(90)).otherwise(F.lit(0)))
    return _rollup_view(ingest.merge_wallets(first, scored))


@query
def dq17_purge(spark, sf):
    sets = F.when(F.col("txid").substr(2, 20).cast("long") % 3 == 0, "d0").otherwise("d1")
    ledger = {
        "transactions": star.tx_times(spark, sf).withColumn("dataset_id", sets),
        "legs": star.legs(spark, sf).withColumn("dataset_id", sets),
        "observations": star.raw_observations(spark, sf).withColumn("dataset_id", sets),
        "wallets": _wallets(spark, sf),
    }
    left = ingest.purge(ledger, "d1")
    out = None
    for n in sorted(left):
        part = left[n].agg(F.count("*").alias("n")).withColumn("name", F.lit(n))
        out = part if out is None else out.unionByName(part)
    return out


def _datasets(spark, sf) -> DataFrame:
    return (
        star.table(spark, sf, "orders")
        .groupBy(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("created_at"))
        .agg(F.count("*").alias("records"), F.count_if(F.col("o_orderstatus") == "P").alias("p"))
        .withColumn("dataset_id", F.date_format("created_at", "yyyy-MM"))
        .withColumn("status", F.when(F.col("p") % 3 == 0, "FAILED").otherwise("COMPLETED"))
    )


@query
def dq18_dataset_list(spark, sf):
    page = ingest.list_datasets(_datasets(spark, sf), 20, 5)
    return page.join(ingest.dataset_status(_datasets(spark, sf)), "status").select("dataset_id", "records", "status", "datasets")


# --- correlation --------------------------------------------------------------------------------


@query
def co1_tx_class(spark, sf):
    return correlate.tx_class(star.event_transactions(spark, sf), event_labels(spark, sf)).select("txid", "tx_class")


@query
def co2_wallet_union(spark, sf):
    links = correlate.wallet_links(star.event_transactions(spark, sf), star.event_edges(spark, sf))
    return correlate.wallet_lists(links).select(
        "txid", "wallet_count", F.array_join("input_wallets", ";").alias("ins"), F.array_join("output_wallets", ";").alias("outs"), F.array_join("related_wallets", ";").alias("related")
    )


@query
def co3_wallet_classes(spark, sf):
    links = correlate.wallet_links(star.event_transactions(spark, sf), star.event_edges(spark, sf))
    classes = cfiles.labels(star.wallet_labels(spark, sf), "key", "code", "pos")
    m = correlate.wallet_class_map(links, classes)
    return m.select("txid", F.explode("wallet_classes").alias("address", "class"))


@query
def co4_exact_match(spark, sf):
    hit = correlate.exact_match(star.event_transactions(spark, sf), star.event_capture(spark, sf))
    return hit.select("txid", "obs_id", "src_ip", "time_difference_seconds", "network_confidence")


@query
def co5_nearest_window(spark, sf):
    hit = correlate.nearest_match(star.event_transactions(spark, sf), star.event_capture(spark, sf))
    return hit.select("txid", "obs_id", "src_ip", "time_difference_seconds")


@query
def co6_confidence_decay(spark, sf):
    hit = correlate.nearest_match(star.event_transactions(spark, sf), star.event_capture(spark, sf), 300.0)
    return hit.select("txid", "network_confidence")


@query
def co7_tiered_match(spark, sf):
    return event_matched(spark, sf).select(
        "txid", "correlation_method", "network_confidence", "time_difference_seconds", "src_ip", "network_txid", "names_other_tx", "observation_note"
    )


@query
def co8_correlation_records(spark, sf):
    rec = event_run(spark, sf).records
    return rec.withColumn("wallet_classes", F.length("wallet_classes") > 2).withColumn("amount_per_output", r("amount_per_output"))


@query
def co9_feature_vector(spark, sf):
    v = correlate.tx_vector(event_matched(spark, sf))
    return v.select(
        "txid", "degree", "fan_ratio", "transaction_amount", "fee_rounded", "amount_per_output_rounded", "wallet_count", "network_correlation_strength", "temporal_distance"
    )


@query
def co10_lead_score(spark, sf):
    return event_scored(spark, sf).select("txid", "risk_score")


@query
def co11_evidence(spark, sf):
    e = event_scored(spark, sf)
    return e.select("txid", F.array_join("evidence", " | ").alias("evidence"), F.size("evidence").alias("n"))


@query
def co12_priority(spark, sf):
    return event_scored(spark, sf).groupBy("priority").agg(F.count("*").alias("n"), F.sum("risk_score").alias("points"))


@query
def co13_ranked_leads(spark, sf):
    return correlate.rank_leads(correlate.lead_records(event_scored(spark, sf))).select(
        "txid", "timestamp", "amount", "fee", "tx_class", "fan_in", "fan_out", "wallet_count", "network_confidence", "risk_score", "priority"
    )


@query
def co14_run_metrics(spark, sf):
    return event_run(spark, sf).metrics


@query
def co15_lead_page(spark, sf):
    leads = correlate.lead_records(event_scored(spark, sf))
    kept = correlate.filter_leads(leads, priority="medium", minimum_score=45, transaction_class="Licit", date="2024-01")
    total = kept.agg(F.count("*")).scalar()
    return correlate.page(correlate.rank_leads(kept), 40, 10).withColumn("total", total).select("txid", "risk_score", "total")


@query
def co16_lead_detail(spark, sf):
    run = event_run(spark, sf)
    d = correlate.lead_detail(run.leads, run.records)
    return d.select(
        "txid", "risk_score", "priority", F.size("evidence").alias("evidence_n"), "transaction_information.script_type",
        F.size("wallet_information.related_wallets").alias("related_n"), "network_correlation.correlation_method", "network_correlation.src_ip",
    )


@query
def co17_record_breakdown(spark, sf):
    b = correlate.record_breakdown(event_run(spark, sf).records)
    return b.select(
        "txid", "wallet_correlations.total_wallets", F.size("wallet_correlations.input_wallets").alias("ins"), F.size("wallet_correlations.output_wallets").alias("outs"),
        "network_correlations.correlation_method", "network_correlations.dst_port",
    )


# --- features -------------------------------------------------------------------------------------


@query
def fe1_leg_union(spark, sf):
    legs = star.legs(spark, sf)
    side = lambda d: legs.filter(F.col("direction") == d).drop("direction")
    recent = star.tx_times(spark, sf).filter(F.col("ts") >= F.lit(DAY0).cast("timestamp"))
    return features.leg_union(side("IN"), side("OUT"), recent).groupBy("direction").agg(F.count("*").alias("legs"), F.count_distinct("address").alias("wallets"))


def _by_wallet(spark, sf, aggs) -> DataFrame:
    timed = star.legs(spark, sf).join(star.tx_times(spark, sf), "txid", "left")
    return rounded(timed.groupBy("address").agg(*aggs), 5)


@query
def fe2_leg_counts(spark, sf):
    return rounded(star.legs(spark, sf).groupBy("address").agg(*features.leg_counts()))


@query
def fe3_flows(spark, sf):
    out = star.legs(spark, sf).groupBy("address").agg(*features.leg_flows())
    return rounded(out.withColumn("net_flow_btc", F.col("total_incoming_btc") - F.col("total_outgoing_btc")), 5)


@query
def fe4_amounts(spark, sf):
    return rounded(star.legs(spark, sf).groupBy("address").agg(*features.leg_amounts()), 5)


@query
def fe5_mean_gap(spark, sf):
    return _by_wallet(spark, sf, features.leg_tempo()[:1])


@query
def fe6_velocity(spark, sf):
    return _by_wallet(spark, sf, features.leg_tempo()[1:])


@query
def fe7_counterparties(spark, sf):
    return features.counterparties(star.legs(spark, sf))


@query
def fe8_fan_ratios(spark, sf):
    c = star.legs(spark, sf).groupBy("address").agg(*features.leg_counts())
    total = F.greatest(F.lit(1), F.col("tx_count_total"))
    return c.select("address", r(F.col("tx_incoming_count") / total).alias("fan_in_ratio"), r(F.col("tx_outgoing_count") / total).alias("fan_out_ratio"))


@query
def fe9_graph_degree(spark, sf):
    return features.graph_degrees(star.legs(spark, sf))


@query
def fe10_network_spread(spark, sf):
    return features.network_spread(features._network_cells(star.legs(spark, sf), star.observations(spark, sf)))


@query
def fe11_geo_entropy(spark, sf):
    return rounded(features.geo_entropy(features._network_cells(star.legs(spark, sf), star.observations(spark, sf))))


@query
def fe12_feature_documents(spark, sf):
    folder = scratch(spark, "features")
    sinks.write_features(star_features(spark, sf), folder, "d1")
    docs = spark.read.parquet(f"{folder}/entity_features")
    return docs.select("entity_id", F.get_json_object("features", "$.tx_count_total").cast("double").alias("legs"), F.size(F.from_json("features", "map<string,double>")).alias("fields"))


@query
def fe_all_wallet_features(spark, sf):
    return rounded(star_features(spark, sf), 4)


# --- models ----------------------------------------------------------------------------------------


@query
def ml1_clean_matrix(spark, sf):
    e = star.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 7 == 1, F.lit(float("-inf"))).when(F.col("event_id") % 7 == 2, F.lit(None)).otherwise(F.col("value")).alias("x")
    )
    return outliers.clean_matrix(e, ["x"])


SCALED = ["avg_tx_amount", "max_tx_amount", "unique_counterparties", "unique_countries"]


@query
def ml2_robust_scaling(spark, sf):
    return rounded(outliers.robust_scale(star_features(spark, sf), WALLET_FEATURES), 4)


@query
def ml3_standard_scaling(spark, sf):
    return rounded(outliers.standard_scale(star_features(spark, sf), WALLET_FEATURES), 4)


def _matrix(spark, sf) -> DataFrame:
    return cut(outliers.robust_scale(star_features(spark, sf), WALLET_FEATURES))


@query
def ml4_forest_fit(spark, sf):
    return outliers.fit_forest(_matrix(spark, sf), WALLET_FEATURES, "address")


@query
def ml5_forest_scores(spark, sf):
    m = _matrix(spark, sf)
    return outliers.score_forest(m, outliers.fit_forest(m, WALLET_FEATURES, "address"), WALLET_FEATURES).select("address", "raw_score")


@query
def ml6_score_range(spark, sf):
    f = star_features(spark, sf).select("address", F.col("max_tx_amount").alias("raw_score"))
    return outliers.min_max(f).select("address", r("anomaly_score").alias("anomaly_score"))


@query
def ml7_contamination_cut(spark, sf):
    f = star.table(spark, sf, "events").select("event_id", F.col("value").alias("raw_score"))
    return outliers.contamination_cut(f).select("event_id", "prediction")


@query
def ml8_local_outlier_factor(spark, sf):
    """Comparison model over all rows and features."""
    m = cut(outliers.standard_scale(star_features(spark, sf), WALLET_FEATURES))
    return outliers.lof(m, WALLET_FEATURES, "address").select("address", r("raw_score", 4).alias("raw_score"))


@query
def ml9_comparison_guard(spark, sf):
    """Comparison scores of every entity, whatever their number."""
    out = outliers.lof_baseline(star_features(spark, sf), WALLET_FEATURES, "address")
    return out.select("address", r("raw_score", 4).alias("raw_score"), r("anomaly_score", 4).alias("anomaly_score"), "prediction")


@query
def ml10_dbscan(spark, sf):
    return clusters.cluster_entities(star_features(spark, sf), WALLET_FEATURES)


@query
def ml11_sample_then_assign(spark, sf):
    return clusters.sample_then_assign(star_features(spark, sf), WALLET_FEATURES, 200)


def _rule_labels(f: DataFrame) -> DataFrame:
    return f.select("address", (F.floor(F.col("unique_counterparties") / 40) - 1).cast("int").alias("cluster_label"))


@query
def ml12_cluster_profile(spark, sf):
    f = star_features(spark, sf)
    return rounded(clusters.cluster_profile(f, _rule_labels(f), SCALED + ["tx_velocity_per_hour", "unique_observed_ips"]), 3)


def _event_truth(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return star.table(spark, sf, "events").select(
        "event_id", F.floor("value").cast("double").alias("anomaly_score"), F.when(k % 10 == 0, 1).otherwise(0).alias("label"), F.when(F.col("value") > 60, 1).otherwise(0).alias("prediction")
    )


@query
def ml13_evaluation(spark, sf):
    return evaluate.evaluate(_event_truth(spark, sf))


@query
def ml14_model_comparison(spark, sf):
    t = _event_truth(spark, sf)
    other = t.select("event_id", F.col("label").alias("prediction"), (F.col("anomaly_score") * 0.5 + F.col("label")).alias("anomaly_score"))
    return evaluate.compare_baseline(t.drop("label"), other, t.select("event_id", "label"), "event_id")


@query
def ml15_self_evaluation(spark, sf):
    t = evaluate.with_labels(_event_truth(spark, sf).drop("label"), None, "event_id")
    return evaluate.evaluate(t).withColumn("self_evaluated", F.lit(True))


@query
def ml16_model_matrix(spark, sf):
    return rounded(outliers.model_matrix(correlate.tx_vector(event_matched(spark, sf))))


@query
def ml17_training_sample(spark, sf):
    t = star.event_transactions(spark, sf).select("txid", "fan_in", "fan_out")
    return outliers.seeded_sample(t, "txid", 500)


@query
def ml18_model_scores(spark, sf):
    m = cut(outliers.model_matrix(correlate.tx_vector(event_matched(spark, sf))))
    return outliers.model_scores(m)


@query
def ml19_heuristic_score(spark, sf):
    return outliers.heuristic_score(correlate.tx_vector(event_matched(spark, sf))).select("txid", "ml_anomaly_score", "ml_anomaly_label")


@query
def ml20_minimum_population(spark, sf):
    f = star.legs(spark, sf).select("address").distinct()
    return f.agg(F.count("*").alias("entities")).withColumn("enough", outliers.enough_entities(f))


@query
def ml21_run_records(spark, sf):
    m = evaluate.evaluate(_event_truth(spark, sf))
    params = {"contamination": 0.05, "n_estimators": 100, "random_state": 42}
    runs = evaluate.run_record(m, "ISOLATION_FOREST", params, run_time()).unionByName(evaluate.run_record(m, "LOCAL_OUTLIER_FACTOR", params, run_time()))
    return evaluate.list_runs(runs).select("model_type", "version", "dataset_records_count", us("trained_at").alias("trained_us"))


# --- priority and reasons --------------------------------------------------------------------------


@query
def re1_subscores(spark, sf):
    return scored_wallets(spark, sf).select("address", "ml_score", "velocity_score", "counterparty_score", "network_score", "graph_score")


@query
def re2_composite(spark, sf):
    return scored_wallets(spark, sf).select("address", "priority_score")


@query
def re3_severity(spark, sf):
    return scored_wallets(spark, sf).select("address", "severity")


@query
def re4_population_baseline(spark, sf):
    return rounded(prioritize.population_baseline(star_features(spark, sf)).drop("pos"), 4)


def _deviations(spark, sf, f: DataFrame | None = None) -> DataFrame:
    f = star_features(spark, sf) if f is None else f
    return prioritize.deviations(f, prioritize.population_baseline(f))


@query
def re5_deviations(spark, sf):
    return _deviations(spark, sf).select("address", "feature", r("value", 4).alias("value"), "z_score", "ratio_to_median")


@query
def re6_top_reasons(spark, sf):
    return prioritize.top_reasons(_deviations(spark, sf)).select("address", "rank", "feature", "z_score")


@query
def re7_reason_texts(spark, sf):
    s = scored_wallets(spark, sf)
    e = prioritize.explain(s, prioritize.population_baseline(s))
    return e.select("address", F.size("reasons").alias("n"), F.array_join("reasons", " | ").alias("reasons"))


@query
def re8_plain_reasons(spark, sf):
    f = star_features(spark, sf).withColumn("tx_velocity_per_hour", F.col("tx_count_total") / 10.0)
    got = prioritize.simple_reasons()
    return f.select("address", F.array_join(got, "|").alias("reasons"))


@query
def re9_alert_candidates(spark, sf):
    return prioritize.alert_candidates(scored_wallets(spark, sf)).select("address", "priority_score", "anomaly_score")


@query
def re10_triage(spark, sf):
    return prioritize.triage(prioritize.alert_candidates(scored_wallets(spark, sf))).select("address", "priority_score", "anomaly_score")


@query
def re11_evidence_sample(spark, sf):
    w = star.legs(spark, sf).select("address").distinct()
    e = prioritize.evidence_sample(w, star.legs(spark, sf), star.observations(spark, sf))
    return e.select("address", F.array_join("related_transactions", ",").alias("txs"), F.array_join("observed_ips", ",").alias("ips"))


@query
def re12_score_write_back(spark, sf):
    return _rollup_view(prioritize.write_back(_wallets(spark, sf), scored_wallets(spark, sf)))


# --- profiles and validation -----------------------------------------------------------------------


def _events(spark, sf) -> DataFrame:
    return profiles.wallet_events(star.tx_times(spark, sf), star.legs(spark, sf))


def _prior(spark, sf) -> DataFrame:
    return profiles.without_latest(_events(spark, sf))


@query
def bp1_wallet_events(spark, sf):
    return _events(spark, sf).select("address", "txid", us("ts").alias("ts_us"), "direction", "leg_no", r("amount", 4).alias("amount"), "fan_in", "fan_out")


@query
def bp2_leak_free_split(spark, sf):
    return _prior(spark, sf).groupBy("address").agg(F.count("*").alias("n"), us(F.max("ts")).alias("last_us"), F.max(F.struct("ts", "txid"))["txid"].alias("last_txid"))


@query
def bp3_point_in_time(spark, sf):
    cutoffs = star.table(spark, sf, "orders").groupBy(F.concat(F.lit("CW"), "o_custkey").alias("address")).agg(F.max(F.col("o_orderdate").cast("timestamp")).alias("as_of"))
    return profiles.before(_events(spark, sf), cutoffs).groupBy("address").agg(F.count("*").alias("n"), us(F.max("ts")).alias("last_us"))


@query
def bp4_history_tiers(spark, sf):
    c = _prior(spark, sf).groupBy("address").agg(F.count("*").alias("n"))
    return c.select("address", "n", profiles.reliability("n").alias("reliability"))


@query
def bp5_amount_profile(spark, sf):
    return profiles.amount_profile(_prior(spark, sf))


@query
def bp6_tempo_profile(spark, sf):
    t = profiles.tempo_profile(_prior(spark, sf))
    return t.drop("first_seen", "last_seen", "active_duration_hours")


@query
def bp7_flow_profile(spark, sf):
    return profiles.flow_profile(_prior(spark, sf), star.legs(spark, sf))


@query
def bp8_network_profile(spark, sf):
    n = profiles.network_profile(_prior(spark, sf), star.observations(spark, sf))
    joined = {c: F.array_join(c, ",").alias(c) for c in ("observed_ips", "asns", "countries")}
    return n.select(*[joined.get(c, F.col(c)) for c in n.columns])


@query
def bp9_temporal_stats(spark, sf):
    t = profiles.tempo_profile(_prior(spark, sf))
    return t.select("address", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "active_duration_hours", F.col("max_velocity").alias("peak_velocity"))


@query
def bp10_on_demand_baseline(spark, sf):
    return profiles.on_demand_baseline(star.tx_times(spark, sf), star.legs(spark, sf))


def _overrides(spark, sf) -> DataFrame:
    """Given baselines for the first customers, from customer balances."""
    c = star.table(spark, sf, "customer")
    amount = F.abs("c_acctbal") / 1000.0
    return c.filter("c_custkey % 10 = 0").select(
        F.concat(F.lit("CW"), "c_custkey").alias("address"),
        F.lit(True).alias("has_sufficient_history"),
        F.lit(12).cast("long").alias("observation_count"),
        F.lit("HIGH").alias("profile_reliability"),
        amount.alias("median_output_amount"), amount.alias("avg_output_amount"), (amount / 4).alias("std_amount"), (amount * 1.3).alias("max_amount"),
        F.lit(0.5).alias("avg_velocity_per_hour"), F.lit(0.25).alias("min_velocity_per_hour"), F.lit(0.75).alias("max_velocity_per_hour"),
        F.lit(9e6).alias("avg_time_between_txs_sec"), F.lit(8).cast("long").alias("counterparties_count"),
    )


def _stored(spark, sf) -> DataFrame:
    return profiles.stored_profiles(star.tx_times(spark, sf), star.legs(spark, sf), star.observations(spark, sf))


def _resolved(spark, sf) -> DataFrame:
    stored = profiles.baseline_of_profile(_stored(spark, sf)).filter("address not like 'SW%'")
    stored = cut(stored)
    computed = cut(profiles.on_demand_baseline(star.tx_times(spark, sf), star.legs(spark, sf)))
    wallets = star.legs(spark, sf).select("address").distinct()
    return profiles.resolve_baseline(wallets, _overrides(spark, sf), stored, computed)


@query
def bp11_resolved_baseline(spark, sf):
    return rounded(_resolved(spark, sf), 4)


def _verdicts(spark, sf, f: DataFrame | None = None) -> DataFrame:
    f = star_features(spark, sf) if f is None else f
    return validate.validate(planted_score(f), _resolved(spark, sf))


@query
def bp12_deviations(spark, sf):
    d = _verdicts(spark, sf)
    keep = ["has_deviation", "status", "amount_significant", "velocity_significant", "peers_significant", "interval_significant"]
    return d.select("address", *[F.col(f"behavioural_deviation.{c}").alias(c) for c in keep])


@query
def bp13_supporting_evidence(spark, sf):
    return _verdicts(spark, sf).select("address", F.array_join(F.transform("supporting_evidence", lambda e: F.concat_ws(": ", e["kind"], e["reason"])), " | ").alias("evidence"))


@query
def bp14_counter_evidence(spark, sf):
    return _verdicts(spark, sf).select("address", F.array_join(F.transform("counter_evidence", lambda e: F.concat_ws(": ", e["kind"], e["reason"])), " | ").alias("evidence"))


@query
def bp15_validation_score(spark, sf):
    return _verdicts(spark, sf).select("address", "validation_score")


@query
def bp16_confidence(spark, sf):
    return _verdicts(spark, sf).select("address", "confidence")


@query
def bp17_explanation(spark, sf):
    return _verdicts(spark, sf).select("address", "validation_explanation")


@query
def bp18_verdicts(spark, sf):
    v = _verdicts(spark, sf)
    return v.select(
        "address", "baseline_source", r("raw_anomaly_score", 4).alias("raw_anomaly_score"), "validation_score", "confidence",
        F.col("behavioural_deviation.has_deviation").alias("has_deviation"), F.size("supporting_evidence").alias("supporting"), F.size("counter_evidence").alias("counter"),
    )


# --- graph -----------------------------------------------------------------------------------------


def _graph(spark, sf, scores: DataFrame | None = None, recent: int | None = None, walked: bool = False) -> graph.Graph:
    g = graph.build_graph(star.tx_times(spark, sf), star.legs(spark, sf), star.observations(spark, sf), scores, recent)
    return graph.Graph(g.vertices, kept(g.edges, "edges")) if walked else g


def _center(spark, sf, g: graph.Graph) -> str:
    """The best connected wallet."""
    wallets = g.vertices.filter("type = 'WALLET'").join(graph.degree(g.edges), "id")
    return wallets.orderBy(F.desc("degree"), "id").select("id").first().id


@query
def gr1_vertices(spark, sf):
    return _graph(spark, sf).vertices.select("id", "type", "label")


@query
def gr2_edges(spark, sf):
    return _graph(spark, sf).edges.select("src", "dst", "type", r("amount", 4).alias("amount"), "port")


@query
def gr3_recency_cap(spark, sf):
    g = _graph(spark, sf, recent=1500)
    return g.edges.groupBy("type").agg(F.count("*").alias("n"))


@query
def gr4_score_enrichment(spark, sf):
    s = scored_wallets(spark, sf).select("address", F.col("priority_score").alias("risk_score"), "anomaly_score")
    return _graph(spark, sf, s).vertices.select("id", "type", "risk_score", r("anomaly_score", 4).alias("anomaly_score"))


@query
def gr5_correlation_edges(spark, sf):
    return event_run(spark, sf).edges


@query
def gr6_degree(spark, sf):
    return graph.degree(_graph(spark, sf).edges)


@query
def gr7_ego_network(spark, sf):
    g = _graph(spark, sf, walked=True)
    e = graph.ego(g, _center(spark, sf, g), 2, 150)
    return e.vertices.select("id", "type", "distance", "is_focal")


@query
def gr8_shortest_path(spark, sf):
    g = _graph(spark, sf, walked=True)
    ends = g.vertices.filter("type = 'WALLET'").select("id")
    a = ends.filter("id like 'CW%'").agg(F.min("id")).first()[0]
    b = ends.filter("id like 'SW%'").agg(F.max("id")).first()[0]
    return graph.shortest_path(g, a, b).vertices.select("id", "type", "path_pos")


@query
def gr9_overview(spark, sf):
    s = scored_wallets(spark, sf).select("address", F.col("priority_score").alias("risk_score"), "anomaly_score")
    return graph.overview(_graph(spark, sf, s, walked=True), 100).vertices.select("id", "type")


@query
def gr10_density(spark, sf):
    return graph.density(_graph(spark, sf))


@query
def gr11_correlation_ego(spark, sf):
    edges = cut(event_run(spark, sf).edges)
    center = edges.groupBy("target").count().orderBy(F.desc("count"), "target").first().target
    return graph.correlation_ego(edges, center, 2).vertices.select("id", "type", "distance", "is_center")


@query
def gr12_fund_flows(spark, sf):
    g = _graph(spark, sf, walked=True)
    seeds = prioritize.triage(prioritize.alert_candidates(scored_wallets(spark, sf))).select(F.col("address").alias("seed"))
    nodes = graph.ego_nodes(g.edges, seeds, 2, 150)
    return graph.fund_flows(g.edges, nodes).select("seed", "pos", "src", "dst", "type", r("amount", 4).alias("amount"))


# --- investigation ---------------------------------------------------------------------------------


@query
def qs1_search(spark, sf):
    w = prioritize.write_back(_wallets(spark, sf), scored_wallets(spark, sf))
    return investigate.search(w, star.tx_times(spark, sf), star.raw_observations(spark, sf), " w99 ").select("entity_id", "entity_type", "label", "risk_score").unionByName(
        investigate.search(w, star.tx_times(spark, sf), star.raw_observations(spark, sf), "t12").select("entity_id", "entity_type", "label", "risk_score")
    ).unionByName(investigate.search(w, star.tx_times(spark, sf), star.raw_observations(spark, sf), "203.0").select("entity_id", "entity_type", "label", "risk_score"))


def _alerts(spark, sf, f: DataFrame | None = None) -> DataFrame:
    s = prioritize.alert_candidates(scored_wallets(spark, sf, f))
    return s.select(
        F.sha2("address", 256).alias("alert_id"), F.lit("d1").alias("dataset_id"), F.col("address").alias("entity_id"), "priority_score", "anomaly_score", "severity",
        F.when(F.col("priority_score") % 4 == 0, "CLOSED").otherwise("NEW").alias("status"), F.array(F.lit("planted")).alias("reasons"), F.lit(0.5).alias("confidence"),
    )


def _dossiers(spark, sf, f: DataFrame | None = None) -> investigate.Dossiers:
    tx, legs, obs = star_ledger(spark, sf)
    f = star_features(spark, sf) if f is None else f
    s = scored_wallets(spark, sf, f)
    wallets = prioritize.write_back(ingest.wallet_rollup(legs, star.tx_times(spark, sf)), s)
    return investigate.wallet_dossiers(wallets, tx, legs, obs, s, _alerts(spark, sf, f), _rule_labels(s))


@query
def qs2_wallet_dossiers(spark, sf):
    h = _dossiers(spark, sf).header
    return h.select(
        "entity_id", "risk_score", "severity", us("first_seen").alias("first_us"), r("total_volume_btc", 4).alias("total_volume_btc"), "transaction_count", "distinct_transactions",
        "unique_counterparties", "observed_ip_count", "observed_country_count", "observed_asn_count", "cluster_label", F.col("alert_id").isNotNull().alias("has_alert"),
    )


@query
def qs2_dossier_transactions(spark, sf):
    d = _dossiers(spark, sf).transactions
    return d.select("entity_id", "txid", us("ts").alias("ts_us"), r("input_total", 4).alias("input_total"), r("output_total", 4).alias("output_total"))


@query
def qs3_tx_dossiers(spark, sf):
    d = investigate.tx_dossiers(*star_ledger(spark, sf))
    return d.select("entity_id", us("first_seen").alias("first_us"), r("total_volume_btc", 4).alias("total_volume_btc"), "input_count", "output_count", "unique_counterparties", "observation_count", "country_count", "asn_count")


@query
def qs4_ip_dossiers(spark, sf):
    d = investigate.ip_dossiers(star.observations(spark, sf))
    return d.select("entity_id", us("first_seen").alias("first_us"), us("last_seen").alias("last_us"), "relayed_tx_count", "country", "asn")


@query
def qs5_alert_list(spark, sf):
    a = investigate.list_alerts(_alerts(spark, sf), 40, 10, severity="medium", status="new", min_score=36)
    return a.select("entity_id", "priority_score", "total", "critical_count", "high_count", "medium_count", "low_count")


def _triage_events(spark, sf) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return star.table(spark, sf, "events").select(
        F.concat(F.lit("A"), F.col("user_id")).alias("alert_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.when(k % 3 == 0, "triaged").when(k % 3 == 1, "escalated").otherwise("closed").alias("status"),
        F.when(k % 2 == 0, F.lit("seen")).alias("note"),
        F.when(k % 5 == 0, F.concat(F.lit("analyst"), k % 4)).alias("assigned_to"),
    )


@query
def qs6_triage_fold(spark, sf):
    return investigate.fold_triage(_triage_events(spark, sf)).withColumn("updated_at", us("updated_at"))


@query
def qs6_triage_history(spark, sf):
    return investigate.triage_history(_triage_events(spark, sf)).select("alert_id", "event_id", "status_change")


@query
def qs7_replay(spark, sf):
    f = star_features(spark, sf)
    v = _verdicts(spark, sf, f).select(
        F.col("address").alias("entity_id"), "raw_anomaly_score", "validation_score", "supporting_evidence", "counter_evidence", "has_sufficient_history", "observation_count", F.col("confidence").alias("conf")
    )
    a = prioritize.triage(prioritize.alert_candidates(scored_wallets(spark, sf, f))).select(F.col("address").alias("entity_id"), F.sha2("address", 256).alias("alert_id"), "anomaly_score", "priority_score", "severity")
    alerts = cut(a.join(v, "entity_id").withColumnRenamed("conf", "confidence"))
    g = _graph(spark, sf, walked=True)
    rows = investigate.replay(alerts, investigate.replay_graph(alerts, g.edges))
    fig = lambda k: F.col("figures")[k]
    return rows.select("entity_id", "stage_order", "stage_id", fig("score_adjustment").alias("score_adjustment"), fig("nodes").alias("nodes"), fig("edges").alias("edges"), fig("fund_flow_edges").alias("flows"))


@query
def qs8_top_alert(spark, sf):
    a = _alerts(spark, sf)
    both = a.unionByName(a.withColumn("priority_score", F.col("priority_score") - 3).withColumn("alert_id", F.concat("alert_id", F.lit("b"))))
    return investigate.top_alert(both).select("entity_id", "priority_score", "status")


@query
def qs9_briefs(spark, sf):
    f = star_features(spark, sf)
    return investigate.briefs(_dossiers(spark, sf, f), _deviations(spark, sf, f)).groupBy("section").agg(F.count("*").alias("lines"), F.count_distinct("entity_id").alias("entities"))


@query
def qs10_hourly_volume(spark, sf):
    tx = star.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("input_total"), (F.col("value") * 2).alias("output_total"))
    alerts = star.table(spark, sf, "events").filter("event_type = 'error'").select(F.col("ts").cast("timestamp").alias("created_at"))
    return investigate.hourly_volume(tx, alerts)


@query
def qs11_cluster_list(spark, sf):
    f = star_features(spark, sf)
    return clusters.list_clusters(clusters.cluster_profile(f, _rule_labels(f)))


@query
def qs12_severity_counts(spark, sf):
    return investigate.severity_counts(_alerts(spark, sf))


@query
def qs13_top_deviations(spark, sf):
    return prioritize.top_deviations(_deviations(spark, sf)).select("address", "rank", "feature", "z_score")


# --- streaming ---------------------------------------------------------------------------------------


def _landed(df: DataFrame, name: str) -> DataFrame:
    """Write a derived table to files and open it as a stream."""
    spark = df.sparkSession
    folder = scratch(spark, f"land-{name}")
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).parquet(folder)


#: Files of each landed part, and so of each micro-batch.
PART_FILES = 4


def _landed_in_parts(df: DataFrame, name: str, part, parts: int = 3, closing: DataFrame | None = None) -> DataFrame:
    """Land a table in `parts` turns one after the other, by the column `part` (0 to parts - 1), PART_FILES files each, and stream one turn for each micro-batch."""
    spark = df.sparkSession
    folder = scratch(spark, f"land-{name}")
    rows = cut(df.withColumn("_part", part))
    for p in range(parts):
        rows.filter(F.col("_part") == p).drop("_part").repartition(PART_FILES).write.mode("append").parquet(folder)
    if closing is not None:
        closing.select(*df.columns).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", PART_FILES).parquet(folder)


def _thirds(df: DataFrame, c: str):
    """0, 1 or 2 by the thirds of an ordered column."""
    a, b = df.select(F.col(c).cast("double").alias("v")).approxQuantile("v", [1 / 3, 2 / 3], 0.01)
    v = F.col(c).cast("double")
    return F.when(v <= a, 0).when(v <= b, 1).otherwise(2)


def _by_time(timed: DataFrame):
    """Thirds of column ts; `timed` also has it as microseconds s."""
    a, b = timed.approxQuantile("s", [1 / 3, 2 / 3], 0.01)
    s = F.unix_micros("ts")
    return F.when(s <= a, 0).when(s <= b, 1).otherwise(2)


def _drain(df: DataFrame, name: str, mode: str) -> DataFrame:
    """Run a streaming result to the end of its input and read what it wrote."""
    spark = df.sparkSession
    out = scratch(spark, f"out-{name}")
    writer = df.writeStream.option("checkpointLocation", scratch(spark, f"state-{name}")).trigger(availableNow=True)
    if mode == "append":
        writer.outputMode("append").format("parquet").option("path", out).start().awaitTermination()
    else:
        def save(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

        writer.outputMode(mode).foreachBatch(save).start().awaitTermination()
    return spark.read.option("basePath", out).parquet(out)


@query
def st1_ingest_stream(spark, sf):
    raw = star.raw_records(spark, sf)
    stream = _landed_in_parts(raw, "raw", _thirds(raw, "src_pos"))
    out = scratch(spark, "st1")
    jobs.start_ingest_stream(stream, out, scratch(spark, "st1-state")).awaitTermination()
    parts = None
    for n in ("transactions", "legs", "observations", "rejects"):
        p = spark.read.parquet(f"{out}/{n}").agg(F.count("*").alias("n")).withColumn("output", F.lit(n))
        parts = p if parts is None else parts.unionByName(p)
    return parts


@query
def st2_stream_dedupe(spark, sf):
    raw = star.raw_records(spark, sf).filter("txid <> ''").select("txid", F.to_timestamp("timestamp").alias("ts"))
    by_time = _by_time(raw.withColumn("s", F.unix_micros("ts")))
    return _drain(jobs.dedupe_stream(_landed_in_parts(raw, "dd", by_time), "1 day"), "dd", "append").select("txid")


@query
def st3_wallet_merge_stream(spark, sf):
    legs = star.legs(spark, sf).join(star.tx_times(spark, sf), "txid").select("txid", "direction", "address", "amount", "leg_no", "ts")
    out = scratch(spark, "st3")
    parts = F.pmod(F.xxhash64("txid", "leg_no"), F.lit(3))
    jobs.start_wallet_merge(_landed_in_parts(legs, "legs", parts), out, scratch(spark, "st3-state")).awaitTermination()
    return _rollup_view(jobs.latest_version(spark, out))


@query
def st4_correlation_stream(spark, sf):
    tx = star.event_transactions(spark, sf).select("txid", "ts_us")
    out, state = scratch(spark, "st4"), scratch(spark, "st4-state")
    parts = F.pmod(F.xxhash64("txid"), F.lit(3))
    for q in jobs.start_correlation_stream(_landed_in_parts(tx, "tx", parts), _landed(star.event_capture(spark, sf), "obs"), out, state):
        q.awaitTermination()
    low, high = tx.agg(F.min("ts_us"), F.max("ts_us")).first()
    jobs.close_slices(spark, out, (low + high) // 2)
    got = jobs.close_slices(spark, out, high + 2 * 86_400 * 1_000_000)
    return got.select("txid", "correlation_method", "network_confidence", "time_difference_seconds", "src_ip")


@query
def st5_live_counters(spark, sf):
    stream = jobs.observed(checks.with_reject_reason(_landed(star.raw_records(spark, sf), "obs5")))
    out = scratch(spark, "st5")
    q = stream.select("src_pos", "reason").writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch(spark, "st5-state")).trigger(availableNow=True).start()
    q.awaitTermination()
    seen = [p["observedMetrics"].get("ingest") for p in q.recentProgress]
    seen = [m for m in seen if m]
    counted = spark.createDataFrame([(sum(m["records"] for m in seen), sum(m["valid"] for m in seen), sum(m["rejected"] for m in seen))], "records long, valid long, rejected long")
    return counted


@query
def st6_hourly_stream(spark, sf):
    tx = star.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("decimal(18,2)").alias("input_total"), F.lit(0).cast("decimal(18,2)").alias("output_total"))
    # a last row two hours later moves the watermark past every window of the table; its own window stays open
    last = tx.agg((F.max("ts") + F.expr("INTERVAL 2 HOURS")).alias("ts"), F.lit(0).cast("decimal(18,2)").alias("input_total"), F.lit(0).cast("decimal(18,2)").alias("output_total"))
    got = _drain(jobs.hourly_stream(_landed_in_parts(tx, "hr", _by_time(tx.withColumn("s", F.unix_micros("ts"))), closing=last)), "hr", "append")
    return got.select(us("hour_start").alias("hour_us"), "tx_count", r(F.col("volume").cast("double"), 2).alias("volume"))
