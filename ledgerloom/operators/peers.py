"""Distinct peers of wallets without a row for every pair of a large set.

A wallet's peers are the members of the sets it faces (the other side of its transactions, or all of them). Sets of at
most SMALL rows give their pairs as they are: at most SMALL for each row of a wallet. Larger ones never do: equal sets
are one set, named by a digest of its members; wallets that face the same large sets are one family. Families unfold, once
each, and what meets is dealt on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .spread import has_large

#: Rows of a set up to which its pairs are written out.
SMALL = 64
#: Rows of one side that meet in one group of the unfolding.
PART = 2048


def _digest(*cols: str) -> Column:
    """Names a set of distinct values: their number and two sums of hashes, whatever their order."""
    return F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*cols)).alias("a"), F.bit_xor(F.xxhash64(*cols, F.lit(1))).alias("b"))


def _sets(mine: DataFrame, sets: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """((address, set) of every wallet, (keys, set) of every set)."""
    named = cut(sets.groupBy(*keys).agg(_digest("peer").alias("set")))
    faced = cut(mine.join(named, keys).select("address", "set").distinct())
    return faced, named


def families(faced: DataFrame) -> DataFrame:
    """(address, family, sets): the family of each wallet and its number of sets."""
    return faced.groupBy("address").agg(_digest("set").alias("family"), F.count("*").alias("sets"))


def unfolded(family: DataFrame, faced: DataFrame, named: DataFrame, sets: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """(family, peer) of the families with `least` sets or more: one wallet stands for its family, one transaction for its set."""
    one = family.filter(F.col("sets") >= least).groupBy("family").agg(F.min("address").alias("address"))
    wanted = faced.join(one, "address").select("family", "set")
    stands = named.join(wanted.select("set").distinct(), "set", "left_semi").groupBy("set").agg(F.min(F.struct(*keys)).alias("k")).select("set", "k.*")
    members = sets.join(stands, keys).select("set", "peer")
    parts = wanted.groupBy("set").agg(F.ceil(F.count("*") / PART).cast("int").alias("_f"))
    parts = parts.withColumn("_p", F.ceil(F.col("set.n") / PART).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = wanted.join(parts, "set").withColumn("_own", F.pmod(F.xxhash64("family"), F.col("_f"))).withColumn("_other", every("_p"))
    right = members.join(parts, "set").withColumn("_other", F.pmod(F.xxhash64("peer"), F.col("_p"))).withColumn("_own", every("_f"))
    same = [left["set"] == right["set"], left["_own"] == right["_own"], left["_other"] == right["_other"]]
    return left.join(right, same).select("family", "peer").distinct()


def _small_pairs(mine: DataFrame, sets: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct (address, peer) of sets that are small enough to write out, without the wallet itself."""
    return mine.join(sets, keys).select("address", "peer").filter(~F.col("peer").eqNullSafe(F.col("address"))).distinct()


def _large(mine: DataFrame, sets: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(address, name) over large sets; (address, family) and (family, peer) behind it."""
    mine, sets = cut(mine.distinct()), cut(sets.distinct())
    faced, named = _sets(mine, sets, keys)
    family = cut(families(faced))
    held = cut(unfolded(family, faced, named, sets, keys, 1))
    sizes = held.groupBy("family").agg(F.count("*").alias("union"))
    itself = mine.join(sets.withColumnRenamed("peer", "address"), [*keys, "address"], "left_semi").select("address").distinct().withColumn("_self", F.lit(1))
    many = F.col("union") - F.coalesce("_self", F.lit(0))
    return family.join(sizes, "family").join(itself, "address", "left").select("address", many.alias(name)), family, held


def facing_peers(legs: DataFrame, name: str) -> DataFrame:
    """(address, name): distinct members other than itself of the opposite sides of a wallet's transactions.

    Both sides of a transaction face each other, so a pair of wallets is one row, whichever of them sent; it counts for both.
    legs: (txid, direction, address). Transactions with a side of more than SMALL rows send all to `distinct_peers`.
    """
    if has_large(legs.filter("txid IS NOT NULL"), ["txid", "direction"], SMALL):
        other = F.when(F.col("direction") == "IN", "OUT").otherwise("IN")
        sets = legs.select("txid", other.alias("direction"), F.col("address").alias("peer"))
        return distinct_peers(legs, sets, ["txid", "direction"], name)
    members = lambda d, c: legs.filter((F.col("direction") == d) & F.col("txid").isNotNull()).select("txid", F.col("address").alias(c))
    met = members("IN", "_a").join(members("OUT", "_b"), "txid").filter(~F.col("_a").eqNullSafe(F.col("_b")))
    return _counted_pairs(met.select(*_pair("_a", "_b")).distinct().select(F.explode(F.array("_lo", "_hi")).alias("address")), name)


def others_met(rows: DataFrame, legs: DataFrame, tx: DataFrame, left_out: DataFrame, name: str) -> DataFrame:
    """(address, name): distinct others in the transactions of `rows`, for wallets that have any.

    legs: (txid, address), all members of a transaction; rows: (address, txid), the members of the transactions `tx` without those
    in `left_out`. Two members of a transaction are one row that tells for which of them it counts.
    Transactions of more than SMALL legs send all to `distinct_peers`.
    """
    legs = legs.select("txid", "address").filter("txid IS NOT NULL")
    if has_large(legs, ["txid"], SMALL):
        return distinct_peers(rows, legs.withColumnRenamed("address", "peer"), ["txid"], name)
    # dealt by transaction once; those left out meet it as one short list for each transaction
    members = legs.repartition("txid").distinct()
    gone = left_out.groupBy("txid").agg(F.collect_set("address").alias("_gone"))
    held = members.join(tx.select("txid"), "txid", "left_semi").join(gone, "txid", "left")
    held = held.withColumn("_own", ~F.coalesce(F.array_contains("_gone", F.col("address")), F.lit(False)))
    a = held.select("txid", F.col("address").alias("_a"), F.col("_own").alias("_x"))
    b = held.select("txid", F.col("address").alias("_b"), F.col("_own").alias("_y"))
    met = a.join(b, "txid").filter((F.col("_a") < F.col("_b")) | (F.col("_a").isNotNull() & F.col("_b").isNull())).filter("_x OR _y")
    pairs = met.groupBy("_a", "_b").agg(F.max("_x").alias("_x"), F.max("_y").alias("_y"))
    end = lambda c, own: F.struct(F.col(c).alias("address"), F.col(own).alias("_own"))
    return _counted_pairs(pairs.select(F.inline(F.array(end("_a", "_x"), end("_b", "_y")))).filter("_own"), name)


def _pair(a: str, b: str) -> list[Column]:
    """A pair as (_lo, _hi), whichever way round; a missing address is the second."""
    swap = F.col(a).isNull() | (F.col(b) < F.col(a))
    return [F.when(swap, F.col(b)).otherwise(F.col(a)).alias("_lo"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias("_hi")]


def _counted_pairs(ends: DataFrame, name: str) -> DataFrame:
    return ends.filter("address IS NOT NULL").groupBy("address").agg(F.count("*").alias(name))


def distinct_peers(mine: DataFrame, sets: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(address, name): members other than itself of the sets that each wallet faces, for wallets that have any.

    mine: (address, keys), the sets a wallet faces; sets: (keys, peer). Repeated rows don't count twice.
    """
    mine, sets = mine.select("address", *keys).filter("address IS NOT NULL"), sets.select(*keys, "peer")
    large = cut(sets.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > SMALL).select(*keys))
    if large.isEmpty():
        return _small_pairs(mine, sets, keys).groupBy("address").agg(F.count("*").alias(name))
    side = lambda df, how: df.join(large, keys, how)
    counts, family, held = _large(side(mine, "left_semi"), side(sets, "left_semi"), keys, name)
    # a peer of a small set counts only if no large set of the wallet holds it
    pairs = _small_pairs(side(mine, "left_anti"), side(sets, "left_anti"), keys).join(family.select("address", "family"), "address", "left")
    again = (F.col("family") == F.col("_family")) & F.col("peer").eqNullSafe(F.col("_peer"))
    rest = pairs.join(held.select(F.col("family").alias("_family"), F.col("peer").alias("_peer")), again, "left_anti").groupBy("address").agg(F.count("*").alias(name))
    found = counts.unionByName(rest).groupBy("address").agg(F.sum(name).alias(name))
    return found.filter(F.col(name) > 0)
