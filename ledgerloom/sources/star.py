"""The star-schema and event tables read as ledgers.

Orders become transactions: the customer sends the order total, each line item pays a supplier.
Events become network observations, or, in the event ledger, both transactions and a capture.
Money is divided by 10,000; sums run over exact cents so they do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.clock import epoch_us
from ..operators.geo import lookup

# Leading octets of synthetic relay addresses, one per built-in subnet.
RELAY_PREFIXES = [
    "1.1.1", "8.8.8", "45.33.7", "104.17.9", "185.220.101", "185.195.3", "194.26.29", "103.21.245",
    "116.202.8", "198.51.100", "203.0.113", "192.0.2", "172.67.5", "149.154.161", "91.108.5",
]
MONEY = 10_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def cents(c: Column | str) -> Column:
    return F.col(c).cast("decimal(18,2)") if isinstance(c, str) else c.cast("decimal(18,2)")


def transactions(spark: SparkSession, folder: str) -> DataFrame:
    """txid, ts, ts_us, fee, script_type, input_total, output_total."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    paid = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            (F.sum(cents("l_extendedprice")).cast("double") / MONEY).alias("output_total"),
            (F.sum((F.col("l_extendedprice") * F.col("l_tax")).cast("decimal(18,4)")).cast("double") / 1e6).alias("fee"),
        )
    )
    return orders.join(paid, "o_orderkey", "left").select(
        F.concat(F.lit("T"), "o_orderkey").alias("txid"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        epoch_us("o_orderdate").alias("ts_us"),
        F.coalesce("fee", F.lit(0.0)).alias("fee"),
        F.lit("P2PKH").alias("script_type"),
        (F.col("o_totalprice") / MONEY).alias("input_total"),
        F.coalesce("output_total", F.lit(0.0)).alias("output_total"),
    )


def tx_times(spark: SparkSession, folder: str) -> DataFrame:
    """Only the ids and times of the orders, for jobs that need no totals."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("T"), "o_orderkey").alias("txid"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        epoch_us("o_orderdate").alias("ts_us"),
    )


def legs(spark: SparkSession, folder: str) -> DataFrame:
    """txid, direction, address, amount, leg_no."""
    sent = table(spark, folder, "orders").select(
        F.concat(F.lit("T"), "o_orderkey").alias("txid"),
        F.lit("IN").alias("direction"),
        F.concat(F.lit("CW"), "o_custkey").alias("address"),
        (F.col("o_totalprice") / MONEY).alias("amount"),
        F.lit(0).alias("leg_no"),
    )
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_extendedprice")
    received = table(spark, folder, "lineitem").select(
        F.concat(F.lit("T"), "l_orderkey").alias("txid"),
        F.lit("OUT").alias("direction"),
        F.concat(F.lit("SW"), "l_suppkey").alias("address"),
        (F.col("l_extendedprice") / MONEY).alias("amount"),
        F.row_number().over(w).alias("leg_no"),
    )
    return sent.unionByName(received)


def relay_ip(user: Column | str) -> Column:
    u = F.col(user) if isinstance(user, str) else user
    kind, host = u % 20, (u % 250 + 1).cast("string")
    prefix = F.get(F.array(*[F.lit(p) for p in RELAY_PREFIXES]), kind.cast("int"))
    return (
        F.when(kind < len(RELAY_PREFIXES), F.concat_ws(".", prefix, host))
        .when(kind == 15, F.lit("127.0.0.1"))
        .when(kind == 16, F.concat(F.lit("2001:db8::"), host))
        .when(kind == 17, F.concat(F.lit("host-"), host))
        .otherwise(F.concat_ws(".", (F.lit(10) + u % 80).cast("string"), (u * 7 % 256).cast("string"), F.lit("0"), host))
    )


def raw_observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations before enrichment."""
    u = F.col("user_id")
    return table(spark, folder, "events").select(
        F.concat(F.lit("T"), "event_id").alias("txid"),
        F.col("ts").cast("timestamp").alias("ts"),
        epoch_us("ts").alias("ts_us"),
        relay_ip("user_id").alias("src_ip"),
        F.lit("10.0.0.1").alias("dst_ip"),
        (F.lit(8333) + u % 3).cast("int").alias("src_port"),
        F.lit(8333).alias("dst_port"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Observations with country and ASN."""
    geo = raw_observations(spark, folder).withColumn("_geo", lookup("src_ip"))
    return geo.select(
        "txid", "ts", "ts_us", "src_ip", "dst_ip", "src_port", "dst_port",
        F.col("_geo.country").alias("country"), F.col("_geo.asn").alias("asn"),
    )


def raw_records(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as raw ledger records, with planted faults and repeats.

    One record per order as a ledger file would hold it; every 41st order appears twice.
    """
    k = F.col("o_orderkey")
    hit = lambda n: k % n == 0
    amount = lambda c: (F.col(c) / MONEY).cast("decimal(18,6)").cast("string")
    supplier = F.when(
        (F.col("l_orderkey") % 67 == 0) & (F.col("l_linenumber") == 2), F.lit("S?")
    ).otherwise(F.concat(F.lit("SW"), "l_suppkey"))
    item = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"),
        F.struct("l_linenumber", "l_suppkey", "l_extendedprice", supplier.alias("address"), amount("l_extendedprice").alias("amount")).alias("item"),
    )
    lists = item.groupBy("o_orderkey").agg(F.array_sort(F.collect_list("item")).alias("items"))
    net = table(spark, folder, "events").select(
        F.col("event_id").alias("o_orderkey"), relay_ip("user_id").alias("src_ip"), (F.lit(8333) + F.col("user_id") % 3).cast("string").alias("src_port")
    )
    base = table(spark, folder, "orders").join(lists, "o_orderkey", "left").join(net, "o_orderkey", "left")
    outs = F.coalesce(F.transform("items", lambda x: x["amount"]), F.array().cast("array<string>"))
    text = lambda c: c.cast("string")
    out = base.select(
        F.lit("TRANSACTION").alias("record_type"),
        F.when(hit(97), F.concat(F.lit("T!"), k)).when(hit(89), F.lit("")).otherwise(F.concat(F.lit("T"), k)).alias("txid"),
        F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(hit(53), F.lit("-0.5")).when(hit(47), F.lit("free")).otherwise(text((k % 7 * 0.001).cast("decimal(9,3)"))).alias("fee"),
        F.when(hit(3), F.lit("taproot")).when(hit(5), F.lit("weird")).otherwise(F.lit("P2WPKH")).alias("script_type"),
        F.array(F.when(hit(71), F.concat(F.lit("C#"), "o_custkey")).otherwise(F.concat(F.lit("CW"), "o_custkey"))).alias("input_addresses"),
        F.coalesce(F.transform("items", lambda x: x["address"]), F.array().cast("array<string>")).alias("output_addresses"),
        F.array(F.when(hit(61), F.lit("-1.5")).otherwise(amount("o_totalprice"))).alias("input_amounts"),
        F.when(hit(59) & (F.size(outs) > 0), F.concat(F.array(F.lit("n/a")), F.slice(outs, F.lit(2), F.greatest(F.lit(0), F.size(outs) - 1)))).otherwise(outs).alias("output_amounts"),
        "src_ip",
        F.when(F.col("src_ip").isNotNull(), F.lit("10.0.0.1")).alias("dst_ip"),
        F.when(hit(13) & F.col("src_ip").isNotNull(), F.lit("http")).otherwise(F.col("src_port")).alias("src_port"),
        F.lit(None).cast("string").alias("dst_port"),
        F.when(hit(11), F.lit("FR")).when(hit(2), F.lit("UNKNOWN")).alias("geo_country"),
        F.when(hit(11), F.lit("AS3215")).alias("asn"),
        F.lit(None).cast("string").alias("address"),
        F.lit(None).cast("string").alias("class"),
        k.alias("order_key"),
        F.explode(F.when(hit(41), F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return out.select("*", F.lit("orders").alias("src_file"), (F.col("order_key") * 10 + F.col("copy")).alias("src_pos"))


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Purchases as correlation-run transactions."""
    k = F.col("k")
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type") == "purchase")
        .withColumn("k", _k())
        .select(
            F.col("event_id").cast("string").alias("txid"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
            epoch_us("ts").alias("ts_us"),
            F.when(k % 4 == 0, F.lit(0.02)).otherwise(F.lit(0.001)).alias("fee"),
            F.lit("P2PKH").alias("script_type"),
            (1 + k % 6).alias("input_count"),
            (1 + k % 8).alias("output_count"),
            (1 + k % 6).alias("fan_in"),
            (1 + k % 8).alias("fan_out"),
            F.col("value").alias("total_input_amount"),
            (F.col("value") / (1 + k % 8)).alias("amount_per_output"),
            F.array(F.concat(F.lit("U"), "user_id")).alias("input_addresses"),
            F.array(F.concat(F.lit("M"), k)).alias("output_addresses"),
            k,
            "user_id",
        )
    )


def event_capture(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks, views and signups as a network capture; signups name a transaction."""
    named = F.when(F.col("event_type") == "signup", _k().cast("string"))
    return (
        table(spark, folder, "events")
        .filter(F.col("event_type").isin("click", "view", "signup"))
        .select(
            F.col("event_id").alias("obs_id"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("network_timestamp"),
            epoch_us("ts").alias("obs_us"),
            relay_ip("user_id").alias("src_ip"),
            (F.lit(8333) + F.col("user_id") % 3).cast("int").alias("src_port"),
            F.lit("10.0.0.1").alias("dst_ip"),
            F.lit(8333).alias("dst_port"),
            named.alias("network_txid"),
        )
    )


def event_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edge lists of the event ledger: extra senders and receivers per purchase, with repeats."""
    base = event_transactions(spark, folder)
    ins = base.select(
        "txid",
        F.lit("IN").alias("side"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("k") % 5), lambda i: F.concat(F.lit("U"), (F.col("user_id") + i * 2) % 150))).alias("address"),
    )
    outs = base.select(
        "txid",
        F.lit("OUT").alias("side"),
        F.explode(F.transform(F.sequence(F.lit(0), F.col("k") % 3), lambda i: F.concat(F.lit("M"), F.col("k") + i))).alias("address"),
    )
    return ins.unionByName(outs)


def event_tx_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(key, code, pos): a class code for two in three purchases, later rows overriding."""
    base = event_transactions(spark, folder)
    first = base.filter("k % 3 <> 1").select(F.col("txid").alias("key"), F.when(F.col("k") % 10 == 0, "1").otherwise("2").alias("code"), F.lit(0).alias("pos"))
    later = base.filter("k % 9 = 0").select(F.col("txid").alias("key"), F.lit("Mixer").alias("code"), F.lit(1).alias("pos"))
    return first.unionByName(later)


def wallet_labels(spark: SparkSession, folder: str) -> DataFrame:
    """(key, code, pos) for event-ledger senders, from the labels table."""
    return table(spark, folder, "labels").select(
        F.concat(F.lit("U"), "doc_id").alias("key"),
        F.when(F.col("toxic") == 1, "1").when(F.col("quality") == 1, "2").otherwise("3").alias("code"),
        F.lit(0).alias("pos"),
    )
