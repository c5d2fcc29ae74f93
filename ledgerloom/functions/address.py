"""Address, id and IP rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

# Id and address patterns.
TXID_PATTERN = r"^([a-fA-F0-9]{64}|[a-zA-Z0-9_\-]{3,64})$"
ADDRESS_PATTERN = (
    r"^(1[a-km-zA-HJ-NP-Z1-9]{25,34}|3[a-km-zA-HJ-NP-Z1-9]{25,34}"
    r"|bc1[a-zA-Z0-9_]{6,74}|tb1[a-zA-Z0-9_]{6,74}|[a-zA-Z0-9_\-]{3,90})$"
)
IPV4_PATTERN = r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"
IPV6_PATTERN = (
    r"^(([0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}"
    r"|(?=.*::)(?!.*::.*::)(([0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?::(([0-9a-fA-F]{1,4}:){0,6}[0-9a-fA-F]{1,4})?)$"
)


def valid_txid(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)).rlike(TXID_PATTERN), F.lit(False))


def valid_address(c: Column | str) -> Column:
    text = F.trim(col(c))
    return F.coalesce(F.length(text).between(3, 90) & text.rlike(ADDRESS_PATTERN), F.lit(False))


def is_ipv4(c: Column | str) -> Column:
    return F.coalesce(F.trim(col(c)).rlike(IPV4_PATTERN), F.lit(False))


def valid_ip(c: Column | str) -> Column:
    return is_ipv4(c) | F.coalesce(F.trim(col(c)).rlike(IPV6_PATTERN), F.lit(False))


def ipv4_number(c: Column | str) -> Column:
    """IPv4 text as a 32-bit number held in a long; null when it is not IPv4."""
    octets = F.split(F.trim(col(c)), r"\.")
    number = sum(F.get(octets, F.lit(i)).try_cast("long") * (256 ** (3 - i)) for i in range(4))
    return F.when(is_ipv4(c), number)
