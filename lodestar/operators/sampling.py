"""Deterministic sampling and the preparation of training sets: ranks come from arithmetic on ids, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one window numbers, about.
ROWS_A_BUCKET = 100_000
#: Bounds of ranges that are brought to the driver, at most.
BOUNDS = 1023


def shuffled(key: str, seed: int = 42, prime: int = 2_147_483_647) -> Column:
    """A rank key that scatters ids: a multiplicative hash modulo a prime (ids are reduced first, so that no id overflows); ties, if any,
    to the id."""
    return F.pmod(F.pmod(F.col(key).cast("long"), F.lit(prime)) * 48271 + seed * 16807, F.lit(prime))


def quota_sample(df: DataFrame, by: list[str], key: str, quota: int, seed: int = 42) -> DataFrame:
    """At most ``quota`` rows a group, in shuffled order; the rank is kept."""
    w = Window.partitionBy(*by).orderBy(shuffled(key, seed), key)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= quota)


def uniform_sample(df: DataFrame, key: str, n: int, seed: int = 42, place: str = "place") -> DataFrame:
    """``n`` rows, all as likely, without replacement, numbered in shuffled order. Tasks keep ``n`` rows each before they meet."""
    first = df.orderBy(shuffled(key, seed), key).limit(n)
    return first.withColumn(place, F.row_number().over(Window.orderBy(shuffled(key, seed), key)))  # n rows


def buckets(rows: int, least: int = 1) -> int:
    """How many buckets so many rows are numbered in: ``least``, or more where one would hold over ``ROWS_A_BUCKET``."""
    return max(least, -(-rows // ROWS_A_BUCKET))


def in_ranges(df: DataFrame, key: str, n: int) -> Column:
    """The range (from 0) of each key in its order, of about ``n`` ranges with as many distinct keys each, however keys cluster; -1 for
    null. The bounds are the keys of smallest hash, ``BOUNDS`` at most, which come to the driver; a row finds its range by binary search."""
    n = min(n - 1, BOUNDS)
    found = df.select(key).filter(F.col(key).isNotNull()).distinct().orderBy(F.xxhash64(key), key).limit(n).collect() if n > 0 else []
    bounds = sorted(r[0] for r in found)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(key) < F.lit(bounds[mid]), search(low, mid)).otherwise(search(mid + 1, high))

    return F.when(F.col(key).isNull(), -1).otherwise(search(0, len(bounds)))


def placed(rows: DataFrame, by: list[str], bucket: str, order: list[str], place: str, size: str) -> DataFrame:
    """Each row's place (from 1) in its group by bucket and ``order``, and the group's size. A task numbers one bucket of a group; only a row a
    bucket meets in a group's window."""
    counts = rows.groupBy(*by, bucket).agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    groups = [F.col(c).alias(f"__g{i}") for i, c in enumerate(by)]
    starts = counts.select(*groups, F.col(bucket).alias("__gb"), F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__start"), F.sum("__c").over(Window.partitionBy(*by)).alias(size))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*by, bucket).orderBy(*order)))
    same = F.col(bucket) == F.col("__gb")
    for i, c in enumerate(by):
        same &= ranked[c].eqNullSafe(F.col(f"__g{i}"))
    joined = ranked.join(starts, same).withColumn(place, F.col("__start") + F.col("__r"))
    return joined.drop(bucket, "__gb", "__start", "__r", *(f"__g{i}" for i in range(len(by))))


def numbered(df: DataFrame, by: str, key: str, seed: int = 42, place: str = "place", size: str = "size") -> DataFrame:
    """Each row's place (from 1, in shuffled order) in its group and the group's size. Places are counted within buckets of the
    rank key first, as many as the table's rows ask for, so that a large group is spread over many tasks."""
    width = -(-2_147_483_647 // buckets(df.count(), 64))
    rows = df.withColumns({"__h": shuffled(key, seed), "__b": F.floor(shuffled(key, seed) / width).cast("int")})
    return placed(rows, [by], "__b", ["__h", key], place, size).drop("__h")


def stratified_split(df: DataFrame, by: str, key: str, train: float = 0.85, seed: int = 42) -> DataFrame:
    """``split``: train for the first floor(train * n) rows of each group in shuffled order, else val."""
    ranked = numbered(df, by, key, seed, "__place", "__n")
    return ranked.withColumn("split", F.when(F.col("__place") <= F.floor(F.col("__n") * train), "train").otherwise("val")).drop("__place", "__n")


def draws(anchors: DataFrame, pool: DataFrame, by: str, key: str, anchor: str, out: str, least: int = 1, seed: int = 7) -> DataFrame:
    """For each anchor one row of ``pool``: a group first, all groups of ``least`` rows or more being as likely, then a row of
    it, all as likely; so large groups weigh no more than small ones. If anchors have the column ``by``, the group is
    another than their own. Both choices are arithmetic on the anchor's id, and equi-joins fetch the rows; no anchor meets
    more than one row. Anchors without any other group get null."""
    groups = dictionary(pool, by, least).select(F.col(by).alias("__name"), F.col("label").alias("__label"), F.col("n").alias("__size"))
    total = groups.agg(F.count(F.lit(1)).alias("__groups"))  # one row, so a broadcast of it is safe
    own = anchors.join(groups.select("__name", F.col("__label").alias("__own")), anchors[by] == F.col("__name"), "left").drop("__name") if by in anchors.columns else anchors.withColumn("__own", F.lit(None).cast("int"))
    asked = own.join(F.broadcast(total))
    others = F.col("__groups") - F.when(F.col("__own").isNull(), 0).otherwise(1)
    step = F.when(others > 0, F.pmod(shuffled(anchor, seed), F.nullif(others, F.lit(0))))
    chosen = asked.withColumn("__label", F.when(F.col("__own").isNull(), step).otherwise(F.pmod(F.col("__own") + 1 + step, F.col("__groups"))).cast("int"))
    placed = chosen.join(groups.drop("__name"), "__label", "left").withColumn("__place", F.pmod(shuffled(anchor, seed + 1), F.col("__size")) + 1)
    rows = numbered(pool.select(by, key), by, key, place="__at", size="__all").join(groups, F.col(by) == F.col("__name")).select(F.col("__label").alias("__l"), "__at", F.col(key).alias(out))
    found = placed.join(rows, (F.col("__label") == F.col("__l")) & (F.col("__place") == F.col("__at")), "left")
    return found.drop("__own", "__groups", "__label", "__size", "__place", "__l", "__at")


def mixture(key: str, shares: list[tuple[str, int]], seed: int = 42) -> Column:
    """A class for each row by its shuffled id: ``shares`` are names and per cent, 100 in all."""
    u, bound, rule = F.pmod(shuffled(key, seed), F.lit(100)), 0, None
    for name, share in shares:
        bound += share
        rule = (F if rule is None else rule).when(u < bound, name)
    return rule.otherwise(shares[-1][0])


def dictionary(df: DataFrame, column: str, least: int = 1) -> DataFrame:
    """Values with ``least`` rows or more, sorted, with dense labels from 0 and inverse-frequency weights. Many values are
    numbered in ranges, so no task sees all of them."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    ranged = counts.withColumn("__b", in_ranges(counts, column, buckets(counts.count())))
    found = placed(ranged, [], "__b", [column], "__place", "__size")
    return found.select(column, "n", (F.col("__place") - 1).cast("int").alias("label"), F.round(1.0 / F.greatest("n", F.lit(1)), 8).alias("weight"))


def replicate(df: DataFrame, times: Column, out: str = "copy") -> DataFrame:
    """Each row so many times, numbered from 1."""
    return df.withColumn(out, F.explode(F.sequence(F.lit(1), times)))


def next_of_group(df: DataFrame, by: str, key: str, out: str, least: int = 64) -> DataFrame:
    """Each row's successor within its group in the order of keys (the last one's is the first): another row of the group, or
    itself if it is alone. A group is cut into ranges with as many keys each, ``least`` or as many as the table's rows ask for, so that a large one
    is spread over many tasks even where keys cluster; the last row of a range is followed by the first of the next."""
    rows = df.withColumn("__b", in_ranges(df, key, buckets(df.count(), least)))
    firsts = rows.groupBy(by, "__b").agg(F.min(key).alias("__m"))  # a row a group and range
    in_order = Window.partitionBy(by).orderBy("__b")
    after = F.coalesce(F.lead("__m").over(in_order), F.first("__m").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    firsts = firsts.select(F.col(by).alias("__g"), F.col("__b").alias("__gb"), after.alias("__after"))
    led = rows.withColumn("__next", F.lead(key).over(Window.partitionBy(by, "__b").orderBy(key)))
    joined = led.join(firsts, led[by].eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__gb")))
    return joined.withColumn(out, F.coalesce("__next", "__after")).drop("__b", "__next", "__g", "__gb", "__after")
