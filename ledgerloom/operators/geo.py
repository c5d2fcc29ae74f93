"""Country and ASN of an IP from a subnet table, with a fixed fallback."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import ipv4_number, is_ipv4
from ..functions.tables import FALLBACK_GEO, LOOPBACK, LOOPBACK_GEO, SUBNETS, UNKNOWN_GEO


def _geo(values: tuple[str, str, str]) -> Column:
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(("country", "asn", "org"), values)])


def _subnet_chain(number: Column, subnets=SUBNETS) -> Column:
    """A short fixed list compiles to one expression: no join, no shuffle, first listed wins."""

    def first_hit(n: Column) -> Column:
        hits = []
        for cidr, *meta in subnets:
            net = ipaddress.ip_network(cidr, strict=False)
            inside = n.between(int(net.network_address), int(net.broadcast_address))
            hits.append(F.when(inside, _geo(tuple(meta))))
        return F.coalesce(*hits)

    return F.get(F.transform(F.array(number), first_hit), F.lit(0))  # the number is worked out once


def fallback_geo(ip: Column | str) -> Column:
    """Outside every subnet: loopback, then a bucket of the first two octets, else unknown."""
    c = F.col(ip) if isinstance(ip, str) else ip
    octets = F.split(c, r"\.")
    bucket = (F.get(octets, F.lit(0)).try_cast("int") * 31 + F.get(octets, F.lit(1)).try_cast("int")) % 10
    table = F.array(*[_geo(v) for v in FALLBACK_GEO])
    return (
        F.when(c.isNull() | (c == "") | c.isin(*LOOPBACK), _geo(LOOPBACK_GEO))
        .when(is_ipv4(c), F.get(table, bucket))
        .otherwise(_geo(UNKNOWN_GEO))
    )


def lookup(ip: Column | str) -> Column:
    """struct(country, asn, org) for an IP text, from the built-in subnets."""
    c = F.col(ip) if isinstance(ip, str) else ip
    loopback = c.isNull() | (c == "") | c.isin(*LOOPBACK)
    return F.when(loopback, _geo(LOOPBACK_GEO)).otherwise(
        F.coalesce(_subnet_chain(ipv4_number(c)), fallback_geo(c))
    )


def lookup_table(ips: DataFrame, subnets: DataFrame, ip: str = "ip") -> DataFrame:
    """The same lookup against a subnet table of any size.

    `subnets`: (pos, lo, hi, country, asn, org).  Each range is cut into /16 blocks, so the join is
    an equality on the block; it runs once per distinct IP.
    """
    one = ips.select(ip).distinct().withColumn("_n", ipv4_number(ip)).withColumn("_block", F.shiftright("_n", 16))
    blocks = subnets.withColumn("_block", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))))
    hits = (
        one.join(blocks, "_block")
        .filter(F.col("_n").between(F.col("lo"), F.col("hi")))
        .groupBy(ip)
        .agg(F.min_by(F.struct("country", "asn", "org"), "pos").alias("_hit"))
    )
    c = F.col(ip)
    loopback = c.isNull() | (c == "") | c.isin(*LOOPBACK)
    found = F.when(loopback, _geo(LOOPBACK_GEO)).otherwise(F.coalesce("_hit", fallback_geo(ip)))
    return one.select(ip).join(hits, ip, "left").select(ip, found.alias("geo"))


def fill_geo(df: DataFrame, subnets: DataFrame | None = None, ip: str = "src_ip") -> DataFrame:
    """Fill country and asn where blank or UNKNOWN and an IP is known."""
    missing = lambda c: F.col(c).isNull() | F.col(c).isin("", "UNKNOWN")
    if subnets is None:
        with_geo = df.withColumn("_geo", lookup(ip))
    else:
        geo = lookup_table(df.filter(F.col(ip).isNotNull()), subnets, ip).withColumnRenamed("geo", "_geo")
        with_geo = df.join(geo, ip, "left")
    known = F.col(ip).isNotNull() & (F.col(ip) != "")

    def filled(c: str) -> Column:
        return F.when(missing(c), F.when(known, F.col(f"_geo.{c}")).otherwise(F.lit("UNKNOWN"))).otherwise(F.col(c))

    return with_geo.withColumn("country", filled("country")).withColumn("asn", filled("asn")).drop("_geo")
