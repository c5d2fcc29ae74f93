"""Correlation inputs: transaction features, captures, labels and edge lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import to_epoch_us
from ..functions.tables import CLASS_NAMES, CORRELATION_ALIASES, CORRELATION_TABLES
from ..functions.text import blank_to_null, norm_txid, split_amounts, split_names, to_double


def detect_column(columns: list[str], field: str) -> str | None:
    """Exact alias first (any case), then the first alias contained in a column name."""
    clean = {c.strip().lower(): c for c in columns}
    aliases = CORRELATION_ALIASES.get(field, [field])
    exact = next((clean[a] for a in aliases if a in clean), None)
    if exact is not None:
        return exact
    return next((orig for a in aliases for low, orig in clean.items() if a in low), None)


def detect_schema(columns: list[str], table: str = "transaction") -> dict[str, str | None]:
    return {f: detect_column(columns, f) for f in CORRELATION_TABLES.get(table, ["txid"])}


def resolve_columns(df: DataFrame, table: str) -> DataFrame:
    """Rename to the standard names; a field without a column becomes null text."""
    found = detect_schema(df.columns, table)
    return df.select(
        *[
            (F.col(f"`{src}`").cast("string") if src else F.lit(None).cast("string")).alias(field)
            for field, src in found.items()
        ]
    )


def read_text_table(spark: SparkSession, path) -> DataFrame:
    return spark.read.option("header", True).option("escape", '"').csv(path)


def with_position(table: DataFrame, name: str = "file_pos") -> DataFrame:
    """Adds the place of a row of a text table: file, block in it, row in the block."""
    at = table.metadataColumn("_metadata")
    return table.withColumn(name, F.struct(at["file_path"].alias("file"), at["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")))


def _positive_count(df: DataFrame, name: str) -> Column | None:
    return to_double(F.col(f"`{name}`").cast("string")).cast("int") if name in df.columns else None


def tx_features(df: DataFrame, max_rows: int | None = None, order_by: str | None = None) -> DataFrame:
    """Transaction features with the fallbacks of a sparse file.

    `max_rows` keeps the head of the file, in the order of `order_by` (the id when not given).
    """
    found = detect_schema(df.columns, "transaction")
    none = F.lit(None).cast("string")

    def text(field: str) -> Column:
        src = found.get(field)
        return blank_to_null(F.col(f"`{src}`").cast("string")) if src else none

    txid_src = found["txid"] or df.columns[0]
    ins, outs, amounts = split_names(text("input_addresses")), split_names(text("output_addresses")), split_amounts(text("input_amounts"))

    def counted(named: str, names: Column, degree: str) -> Column:
        sized = F.when(F.size(names) > 0, F.size(names))
        options = [_positive_count(df, named), sized, _positive_count(df, degree), F.lit(1)]
        return F.coalesce(*[o for o in options if o is not None]).cast("int")

    fee = text("fee") if found["fee"] or "fees" not in df.columns else F.col("fees").cast("string")
    listed = F.when(F.size(amounts) > 0, F.aggregate(amounts, F.lit(0.0), lambda a, x: a + x))
    total_btc = to_double(F.col("total_BTC").cast("string")) if "total_BTC" in df.columns else None
    totals = [listed, total_btc, to_double(text("input_amounts")), F.lit(0.0)]
    extra = [order_by] if order_by and order_by not in ("txid",) else []
    base = df.select(
        blank_to_null(norm_txid(F.col(f"`{txid_src}`"))).alias("txid"),
        F.trim(F.coalesce(text("timestamp"), F.lit("1970-01-01T00:00:00Z"))).alias("timestamp"),
        F.coalesce(to_double(fee), F.lit(0.0)).alias("fee"),
        F.trim(F.coalesce(text("script_type"), F.lit("P2PKH"))).alias("script_type"),
        counted("num_input_addresses", ins, "in_txs_degree").alias("input_count"),
        counted("num_output_addresses", outs, "out_txs_degree").alias("output_count"),
        F.coalesce(*[t for t in totals if t is not None]).alias("total_input_amount"),
        ins.alias("input_addresses"),
        outs.alias("output_addresses"),
        *extra,
    ).filter(F.col("txid").isNotNull())
    out = (
        base.withColumn("fan_in", F.col("input_count"))
        .withColumn("fan_out", F.col("output_count"))
        .withColumn("amount_per_output", F.col("total_input_amount") / F.greatest(F.lit(1), F.col("output_count")))
        .withColumn("ts_us", to_epoch_us("timestamp"))
    )
    if max_rows:
        out = head_rows(out, max_rows, order_by or "txid")
    return out


def head_rows(df: DataFrame, n: int, order_by: str) -> DataFrame:
    """First n rows in a fixed order."""
    return df.orderBy(order_by).limit(n)


def capture(df: DataFrame, steps: bool = True) -> DataFrame:
    """Network capture rows with defaults; `obs_id` fixes the file order."""
    r = resolve_columns(df.drop("obs_id"), "network") if "obs_id" not in df.columns else None
    if r is None:
        found = detect_schema([c for c in df.columns if c != "obs_id"], "network")
        r = df.select(
            "obs_id",
            *[
                (F.col(f"`{s}`").cast("string") if s else F.lit(None).cast("string")).alias(f)
                for f, s in found.items()
            ],
        )
    else:
        r = r.withColumn("obs_id", F.monotonically_increasing_id())
    port = lambda c: F.coalesce(to_double(blank_to_null(c)).cast("int"), F.lit(8333))
    host = lambda c: F.coalesce(F.trim(blank_to_null(c)), F.lit("127.0.0.1"))
    return r.select(
        "obs_id",
        F.col("timestamp").alias("network_timestamp"),
        to_epoch_us("timestamp", steps).alias("obs_us"),
        host("src_ip").alias("src_ip"),
        port("src_port").alias("src_port"),
        host("dst_ip").alias("dst_ip"),
        port("dst_port").alias("dst_port"),
        blank_to_null(norm_txid("txid")).alias("network_txid"),
    )


def read_capture(spark: SparkSession, path, steps: bool = True) -> DataFrame:
    return capture(read_text_table(spark, path), steps)


def class_name(c: Column | str) -> Column:
    text = norm_txid(c)
    out = F.lower(text)
    for code, name in CLASS_NAMES.items():
        out = F.when(text == code, F.lit(name)).otherwise(out)
    return out


def labels(df: DataFrame, key: str, class_col: str, pos: str) -> DataFrame:
    """Key to class, the later row of a key wins; partial aggregation per key."""
    return (
        df.select(norm_txid(key).alias("key"), class_name(class_col).alias("class"), F.col(pos).alias("_pos"))
        .groupBy("key")
        .agg(F.max_by("class", "_pos").alias("class"))
    )


def read_labels(spark: SparkSession, path, key: str) -> DataFrame:
    """`key` is 'tx' or 'wallet'."""
    table, fields = ("tx_class", ("txid", "tx_class")) if key == "tx" else ("wallet", ("wallet_address", "wallet_class"))
    raw = read_text_table(spark, path)
    found = detect_schema(raw.columns, table)
    key_col, cls_col = found[fields[0]] or raw.columns[0], found[fields[1]] or raw.columns[1]
    return labels(raw.withColumn("_pos", F.monotonically_increasing_id()), f"`{key_col}`", f"`{cls_col}`", "_pos")


def edges(inputs: DataFrame, outputs: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Distinct (txid, side, address) rows of the two edge lists, kept to `targets` when given.

    First column of `inputs` is the address and the second the txid; `outputs` the other way round.
    """
    ia, it = inputs.columns[:2]
    ot, oa = outputs.columns[:2]
    both = inputs.select(
        norm_txid(f"`{it}`").alias("txid"), F.lit("IN").alias("side"), norm_txid(f"`{ia}`").alias("address")
    ).unionByName(
        outputs.select(
            norm_txid(f"`{ot}`").alias("txid"), F.lit("OUT").alias("side"), norm_txid(f"`{oa}`").alias("address")
        )
    )
    if targets is not None:
        both = keep_edges(both, targets)
    return both.dropDuplicates()


def keep_edges(edge_df: DataFrame, targets: DataFrame) -> DataFrame:
    return edge_df.join(targets.select("txid").distinct(), "txid", "left_semi")


def read_edges(spark: SparkSession, in_path, out_path, targets: DataFrame | None = None) -> DataFrame:
    return edges(read_text_table(spark, in_path), read_text_table(spark, out_path), targets)


def edge_sets(edge_df: DataFrame) -> DataFrame:
    """Number of distinct addresses per transaction and side."""
    return edge_df.dropDuplicates(["txid", "side", "address"]).groupBy("txid", "side").agg(
        F.count("*").alias("addresses")
    )
