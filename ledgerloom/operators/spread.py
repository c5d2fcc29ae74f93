"""Exact ordered operations that never hold a hot group in one task.

A window over a whole group puts the group in one task.  The helpers here first
collapse equal values, then work in bounded slices: value slices cut by a sketch,
or time slices whose size is bounded by the clock (microseconds in a second,
seconds in a day, days in a calendar).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, freeing, kept

SLICES = 256
SPLIT_OVER = 500_000

SECOND_US = 1_000_000
DAY_US = 86_400 * SECOND_US


def scalar(df: DataFrame, *aggs: Column) -> Column:
    """One-row aggregate of `df` as a scalar subquery (a struct if several)."""
    if len(aggs) == 1:
        return df.agg(aggs[0]).scalar()
    return df.agg(F.struct(*aggs)).scalar()


def running_before(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], slices: int = SLICES
) -> DataFrame:
    """Add `before_<sum>`: the sum over rows of the group with a smaller `value`.

    `df` holds one row per (keys, value).  Slices come from a per-group sketch, so each
    window sorts about 1/slices of a group; slice totals are at most `slices` rows per group.
    """
    keys = list(keys)
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(value, [i / slices for i in range(1, slices)], 10 * slices).alias("_cuts")
    )
    if keys:
        cut_df = df.join(cuts, keys)
    else:
        cut_df = df.withColumn("_cuts", cuts.select("_cuts").scalar())
    sliced = cut_df.withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    totals = sliced.groupBy(*keys, "_slice").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    within = (
        Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    )
    joined = sliced.join(offsets, [*keys, "_slice"])
    for s in sums:
        inside = F.coalesce(F.sum(s).over(within), F.lit(0))
        joined = joined.withColumn(f"before_{s}", inside + F.col(f"_o_{s}"))
    return joined.drop("_slice", *[f"_o_{s}" for s in sums])


def has_large(df: DataFrame, keys: Sequence[str], split_over: int = SPLIT_OVER) -> bool:
    """Whether a group has more than `split_over` rows: one count for each group, combined before the shuffle.

    Groups are counted by a short hash of their keys first, as it moves and compares faster: that can put groups together but not
    split one, so only if it finds a large one are the keys themselves counted.
    """
    found = lambda by: not df.groupBy(*by).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > split_over).isEmpty()
    with freeing(df.sparkSession):
        return found([F.hash(*keys).alias("_hash")]) and found(keys)


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    split_over: int = SPLIT_OVER,
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles per group.

    Groups up to `split_over` distinct values use the built-in `percentile`; larger ones are
    ranked in slices.  Either way the answer is exact.  Where no group has more rows than that,
    the values are not counted first.
    """
    keys = list(keys)
    data = df.filter(F.col(value).isNotNull())
    if not keys:
        data, keys_in = data.withColumn("_all", F.lit(0)), ["_all"]
    else:
        keys_in = keys
    if not has_large(data, keys_in, split_over):
        share = [F.col(weight).cast("long")] if weight else []
        out = data.groupBy(*keys_in).agg(*[F.percentile(value, F.lit(p), *share).alias(name) for name, p in wanted.items()])
        return out if keys else out.drop("_all")
    n = F.sum(weight) if weight else F.count("*")
    # counted once: both ways below read this small table, and without large groups there is only one way
    counted = kept(data.groupBy(*keys_in, F.col(value).alias("_v")).agg(n.cast("long").alias("_n")), "values")
    large = cut(
        counted.groupBy(*keys_in).agg(F.count("*").alias("_d")).filter(F.col("_d") > split_over).select(*keys_in)
    )
    all_small = large.isEmpty()
    small_rows = counted if all_small else counted.join(large, keys_in, "left_anti")
    small = small_rows.groupBy(*keys_in).agg(
        *[F.percentile("_v", F.lit(p), F.col("_n")).alias(name) for name, p in wanted.items()]
    )
    if all_small:
        return small if keys else small.drop("_all")
    ranked = running_before(counted.join(large, keys_in, "left_semi"), keys_in, "_v", ["_n"])
    totals = counted.join(large, keys_in, "left_semi").groupBy(*keys_in).agg(F.sum("_n").alias("_total"))
    placed = ranked.join(totals, keys_in)
    first, last = F.col("before__n"), F.col("before__n") + F.col("_n") - 1
    picks = []
    for name, p in wanted.items():
        at = (F.col("_total") - 1) * F.lit(p)
        lo, hi = F.floor(at), F.ceil(at)
        picks += [
            F.max(F.when((first <= lo) & (lo <= last), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when((first <= hi) & (hi <= last), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(at - lo).alias(f"_f_{name}"),
        ]
    big = placed.groupBy(*keys_in).agg(*picks).select(
        *keys_in,
        *[
            (F.col(f"_lo_{n_}") + (F.col(f"_hi_{n_}") - F.col(f"_lo_{n_}")) * F.col(f"_f_{n_}")).alias(n_)
            for n_ in wanted
        ],
    )
    out = small.unionByName(big)
    return out if keys else out.drop("_all")


def _last(c: Column, w) -> Column:
    return F.last(c, ignorenulls=True).over(w)


def around(moments: DataFrame, keys: Sequence[str], t: str, mark: str) -> DataFrame:
    """For each moment, the nearest marked moment at or before it, and at or after it.

    `moments` holds one row per (keys, t); `mark` is a struct whose first field is t, null where
    the moment carries no mark.  Adds `mark_before` and `mark_after`.  The way ahead is a running
    window over the reverse order: a frame that ends with the group is run through again for each row.
    """
    keys = list(keys)
    m = moments.withColumn("_sec", F.floor(F.col(t) / SECOND_US)).withColumn(
        "_day", F.floor(F.col(t) / DAY_US)
    )
    all_sec = m.groupBy(*keys, "_day", "_sec").agg(F.min(mark).alias("_lo"), F.max(mark).alias("_hi"))
    all_day = all_sec.groupBy(*keys, "_day").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

    earlier = (Window.unboundedPreceding, -1)
    ways = lambda part, at: (Window.partitionBy(*part).orderBy(at), Window.partitionBy(*part).orderBy(F.desc(at)))
    up, down = ways(keys, "_day")
    days = all_day.select(
        *keys,
        "_day",
        _last(F.col("_hi"), up.rowsBetween(*earlier)).alias("_day_before"),
        _last(F.col("_lo"), down.rowsBetween(*earlier)).alias("_day_after"),
    )
    up, down = ways([*keys, "_day"], "_sec")
    secs = (
        all_sec.select(
            *keys,
            "_day",
            "_sec",
            _last(F.col("_hi"), up.rowsBetween(*earlier)).alias("_sec_before"),
            _last(F.col("_lo"), down.rowsBetween(*earlier)).alias("_sec_after"),
        )
        .join(days, [*keys, "_day"])
        .select(
            *keys,
            "_sec",
            F.coalesce("_sec_before", "_day_before").alias("_prev"),
            F.coalesce("_sec_after", "_day_after").alias("_next"),
        )
    )
    up, down = ways([*keys, "_sec"], t)
    upto = (Window.unboundedPreceding, Window.currentRow)
    return (
        m.join(secs, [*keys, "_sec"])
        .withColumn("mark_before", F.coalesce(_last(F.col(mark), up.rowsBetween(*upto)), F.col("_prev")))
        .withColumn("mark_after", F.coalesce(_last(F.col(mark), down.rowsBetween(*upto)), F.col("_next")))
        .drop("_sec", "_day", "_prev", "_next")
    )


def tempo(df: DataFrame, keys: Sequence[str], t: str, split_over: int = SPLIT_OVER) -> DataFrame:
    """Per key that is not null: rows (n), first and last time (lo, hi), smallest and largest gap (seconds) between neighbours in time.

    Groups of up to `split_over` rows are put in order once; where one is larger, all go by days, seconds and microseconds.
    """
    keys = list(keys)
    known = df.select(*keys, t).dropna()
    if has_large(known, keys, split_over):
        moments = known.groupBy(*keys, t).agg(F.count("*").alias("n"))
        spans = moments.groupBy(*keys).agg(F.sum("n").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"))
        return spans.join(gap_range(moments, keys, t, "n"), keys)
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    found = known.withColumn("_gap", gap).groupBy(*keys)
    return found.agg(
        F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi"),
        (F.min("_gap") / 1e6).alias("min_gap_s"), (F.max("_gap") / 1e6).alias("max_gap_s"),
    )


def gap_range(moments: DataFrame, keys: Sequence[str], t: str, n: str) -> DataFrame:
    """Per key: smallest and largest gap (seconds) between consecutive moments, weights in `n`.

    One row per (keys, t) in; a weight over 1 means equal times, hence a gap of 0.
    """
    keys = list(keys)
    tc = F.col(t)
    m = moments.withColumn("_sec", F.floor(tc / SECOND_US)).withColumn("_day", F.floor(tc / DAY_US))

    def fold(df: DataFrame, part: list[str], order: str, lo: str, hi: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(order)
        step = df.withColumn("_gap", F.col(lo) - F.lag(hi).over(w))
        return step.groupBy(*part).agg(
            F.min(lo).alias("_lo"),
            F.max(hi).alias("_hi"),
            F.least(F.min("_gap"), F.min("_gmin")).alias("_gmin"),
            F.greatest(F.max("_gap"), F.max("_gmax")).alias("_gmax"),
        )

    repeat = F.when(F.col(n) > 1, F.lit(0).cast("long"))
    base = m.select(*keys, "_day", "_sec", tc.alias("_lo"), tc.alias("_hi"), repeat.alias("_gmin"), repeat.alias("_gmax"))
    secs = fold(base, [*keys, "_day", "_sec"], "_lo", "_lo", "_hi")
    days = fold(secs, [*keys, "_day"], "_sec", "_lo", "_hi")
    full = fold(days, keys, "_day", "_lo", "_hi")
    return full.select(
        *keys,
        (F.col("_gmin") / 1e6).alias("min_gap_s"),
        (F.col("_gmax") / 1e6).alias("max_gap_s"),
    )
