"""Row validity with the first failing reason, and normalisation of valid rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import valid_address, valid_ip, valid_txid
from ..functions.clock import to_utc
from ..functions.tables import CLASS_SEED_OTHER, CLASS_SEEDS, SCRIPT_TYPES
from ..functions.text import blank_to_null, to_double
from .geo import fill_geo


def _first_bad_address(addresses: str, text: str) -> Column:
    bad = F.filter(addresses, lambda a: ~valid_address(a))
    return F.when(F.size(bad) > 0, F.concat(F.lit(text), F.get(bad, F.lit(0))))


def _first_bad_amount(amounts: str, side: str) -> Column:
    bad = F.filter(amounts, lambda a: to_double(a).isNull() | (to_double(a) < 0))
    worst = F.get(bad, F.lit(0))
    number = to_double(worst)
    return F.when(
        F.size(bad) > 0,
        F.when(number.isNull(), F.concat(F.lit(f"Non-numeric {side} amount: "), F.coalesce(worst, F.lit("None"))))
        .otherwise(F.concat(F.lit(f"Negative {side} amount: "), number.cast("string"))),
    )


def reject_reason(strict_ips: bool = False) -> Column:
    """Null for a valid row, else the reason of the first rule that fails, in a fixed order."""
    shown = lambda c: F.coalesce(F.col(c), F.lit("None"))
    fee = to_double("fee")
    # Texts of the reasons.
    transaction = [
        F.when(~valid_txid("txid"), F.concat(F.lit("Missing or invalid TXID format: "), shown("txid"))),
        F.when(F.coalesce(F.size("input_addresses"), F.lit(0)) < 1, "At least one input address is required"),
        _first_bad_address("input_addresses", "Malformed input wallet address: "),
        F.when(F.coalesce(F.size("output_addresses"), F.lit(0)) < 1, "At least one output address is required"),
        _first_bad_address("output_addresses", "Malformed output wallet address: "),
        _first_bad_amount("input_amounts", "input"),
        _first_bad_amount("output_amounts", "output"),
        F.when(F.col("fee").isNotNull() & fee.isNull(), F.concat(F.lit("Non-numeric fee: "), F.col("fee"))),
        F.when(fee < 0, F.concat(F.lit("Negative fee: "), F.col("fee"))),
    ]
    if strict_ips:
        transaction.append(
            F.when(F.col("src_ip").isNotNull() & ~valid_ip("src_ip"), F.concat(F.lit("Invalid source IP: "), F.col("src_ip")))
        )
    wallet = F.when(~valid_address("address"), F.concat(F.lit("Missing or invalid wallet address: "), shown("address")))
    tx_class = F.when(~valid_txid("txid"), F.concat(F.lit("Missing or invalid TXID: "), shown("txid")))
    kind = F.col("record_type")
    return (
        F.when(kind == "WALLET", wallet).when(kind == "TX_CLASS", tx_class).otherwise(F.coalesce(*transaction))
    )


def with_reject_reason(raw: DataFrame, strict_ips: bool = False) -> DataFrame:
    return raw.withColumn("reason", reject_reason(strict_ips))


def align_amounts(addresses: str, amounts: str) -> Column:
    """i-th address with i-th amount; missing, bad or negative amounts become 0."""
    kept = F.filter(F.transform(addresses, lambda a: F.trim(a)), lambda a: a != "")
    amount = lambda i: F.greatest(F.lit(0.0), F.coalesce(to_double(F.get(F.col(amounts), i)), F.lit(0.0)))
    return F.transform(kept, lambda a, i: F.struct(a.alias("address"), amount(i).alias("amount")))


def total(pairs: str) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["amount"])


def clean_port(c: str) -> Column:
    return F.when(F.col(c).isNotNull(), F.coalesce(F.col(c).try_cast("int"), F.lit(8333)))


def clean_script(c: str) -> Column:
    upper = F.upper(F.trim(c))
    return F.when(upper.isin(*SCRIPT_TYPES), upper).otherwise(F.lit(SCRIPT_TYPES[0]))


def clean_fee(c: str) -> Column:
    return F.greatest(F.lit(0.0), F.coalesce(to_double(c), F.lit(0.0)))


def class_seed(c: Column | str) -> tuple[Column, Column]:
    """Seed score and anomaly for a wallet class code."""
    code = F.trim(F.col(c) if isinstance(c, str) else c)
    score, anomaly = F.lit(CLASS_SEED_OTHER[0]), F.lit(CLASS_SEED_OTHER[1])
    for key, (s, a) in CLASS_SEEDS.items():
        score = F.when(code == key, F.lit(s)).otherwise(score)
        anomaly = F.when(code == key, F.lit(a)).otherwise(anomaly)
    return score.cast("int"), anomaly


def normalize(valid: DataFrame, run_time: Column | None = None, subnets: DataFrame | None = None) -> DataFrame:
    """Valid transaction records to typed rows; `time_assumed` marks rows stamped with the run time."""
    run_time = F.current_timestamp() if run_time is None else run_time
    parsed = to_utc("timestamp")
    typed = valid.select(
        F.trim("txid").alias("txid"),
        F.coalesce(parsed, run_time).alias("ts"),
        parsed.isNull().alias("time_assumed"),
        clean_fee("fee").alias("fee"),
        clean_script("script_type").alias("script_type"),
        align_amounts("input_addresses", "input_amounts").alias("inputs"),
        align_amounts("output_addresses", "output_amounts").alias("outputs"),
        F.trim(blank_to_null("src_ip")).alias("src_ip"),
        F.trim(blank_to_null("dst_ip")).alias("dst_ip"),
        clean_port("src_port").alias("src_port"),
        clean_port("dst_port").alias("dst_port"),
        F.col("geo_country").alias("country"),
        "asn",
        *[c for c in ("src_file", "src_pos") if c in valid.columns],
    )
    located = fill_geo(typed, subnets)
    return located.withColumn("input_total", total("inputs")).withColumn("output_total", total("outputs"))
