"""Joins and frames by time without a window over a whole key: as-of by buckets with carries, sliding frames by buckets with a halo,
overlapping intervals by cells of several widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: str, time: str, key: str, take: list[str], seconds: int = 86_400) -> DataFrame:
    """Each row of ``left`` with the columns ``take`` of the latest row of ``right`` with the same ``by`` and an earlier ``time`` (of equal times the
    one of the largest ``key``); nulls where there is none. Both sides are united and cut into buckets of so many seconds; inside one,
    the last row before is looked up, and what a bucket ends with is carried into those after it. A key with any number of
    rows is as many tasks as it has buckets; only a row a bucket meets in one window. Rows with a null time find nothing; a null ``by``
    is a key of its own."""
    value = F.struct(time, key, *take)
    rows = left.withColumns({"__v": F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType), "__left": F.lit(True)})
    known = right.filter(F.col(time).isNotNull()).select(by, time, value.alias("__v")).withColumn("__left", F.lit(False))
    both = rows.unionByName(known, allowMissingColumns=True).withColumn("__b", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds))
    # of equal times rows of the left come first, so that they see earlier rows only
    before = Window.partitionBy(by, "__b").orderBy(F.col(time), F.desc("__left"), F.col(f"__v.{key}")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.last("__v", ignorenulls=True).over(before)).filter("__left")
    ends = known.withColumn("__b", F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds)).groupBy(by, "__b").agg(F.max("__v").alias("__end"))
    buckets = seen.select(by, "__b").distinct().join(ends.withColumnRenamed(by, "__by").withColumnRenamed("__b", "__eb"), F.col(by).eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__eb")), "full_outer")
    buckets = buckets.select(F.when(F.col("__eb").isNull(), F.col(by)).otherwise(F.col("__by")).alias("__by"), F.coalesce("__b", "__eb").alias("__eb"), "__end")
    carry = F.last("__end", ignorenulls=True).over(Window.partitionBy("__by").orderBy("__eb").rowsBetween(Window.unboundedPreceding, -1))
    carried = buckets.select("__by", "__eb", carry.alias("__carry"))
    found = seen.join(carried, seen[by].eqNullSafe(F.col("__by")) & (F.col("__b") == F.col("__eb")), "left")
    best = F.when(F.col(time).isNotNull(), F.coalesce("__seen", "__carry"))
    return found.select(*left.columns, *(best[c].alias(f"as_of_{c}") for c in dict.fromkeys([key, time, *take])))


def sliding(df: DataFrame, by: str, time: str, seconds: int, bucket: int = 86_400, **aggregates: Column) -> DataFrame:
    """Each row with ``aggregates`` of its key's rows of the last so many seconds, rows of its own time included. Time is cut into buckets
    of ``bucket`` seconds (of a frame's length at least); a row also goes, as part of a halo, to the next bucket if frames there reach back to it. So a
    row is copied once at most, and a key that holds most rows is as many tasks as it has buckets. Rows without a time see one
    another; a null key is a key of its own."""
    wide, back = max(bucket, seconds) * 1_000_000, seconds * 1_000_000
    at = df.withColumn("__t", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("__own", F.floor(F.col("__t") / wide))
    reached = F.col("__t") + back >= (F.col("__own") + 1) * wide
    halo = at.withColumn("__b", F.explode(F.when(reached, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))))
    frame = Window.partitionBy(by, "__b").orderBy("__t").rangeBetween(-back, Window.currentRow)
    seen = halo.withColumns({name: x.over(frame) for name, x in aggregates.items()})
    return seen.filter(F.col("__b").eqNullSafe(F.col("__own"))).drop("__t", "__own", "__b")


def _cells(df: DataFrame, start: Column, end: Column, levels: list[int], tag: str) -> DataFrame:
    """A row for each cell that an interval touches: on the level of its own length (two cells at most) and on all wider ones."""
    own = F.length(F.bin(end - start))
    levelled = df.withColumns({f"__s{tag}": start, f"__e{tag}": end, f"__own{tag}": own}).filter(F.col(f"__s{tag}") <= F.col(f"__e{tag}"))
    wider = levelled.withColumn("__level", F.explode(F.filter(F.array(*map(F.lit, levels)), lambda x: x >= F.col(f"__own{tag}"))))
    place = lambda x: F.call_function("shiftright", F.col(x), F.col("__level"))
    return wider.withColumn("__cell", F.explode(F.sequence(place(f"__s{tag}"), place(f"__e{tag}"))))


def overlapping(a: DataFrame, b: DataFrame, by: str, start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> DataFrame:
    """All pairs of a row of ``a`` and one of ``b`` with the same ``by`` whose closed intervals of whole numbers overlap; other columns have different
    names. Intervals lie in cells as wide as the next power of 2 above their length, and in all wider ones that intervals have. A
    pair meets on the level of the longer one, in the first cell that both touch, so it is reported once, and a key that holds a third of
    all rows is as many keys as it has cells. Intervals that lack an end or end before they start overlap nothing."""
    length = lambda df, s, e: df.select(F.length(F.bin(e - s)).alias("l"), (s <= e).alias("ok")).filter("ok").select("l")
    levels = sorted(r[0] for r in length(a, start_a, end_a).union(length(b, start_b, end_b)).distinct().collect())  # 64 at most
    if not levels:
        return a.join(b, by).limit(0)
    left, right = _cells(a, start_a, end_a, levels, "a"), _cells(b, start_b, end_b, levels, "b")
    met = left.join(right, [by, "__level", "__cell"])
    first = F.call_function("shiftright", F.greatest("__sa", "__sb"), F.col("__level"))
    met = met.filter((F.col("__level") == F.greatest("__owna", "__ownb")) & (F.col("__cell") == first) & (F.col("__sa") <= F.col("__eb")) & (F.col("__sb") <= F.col("__ea")))
    return met.select(by, *(c for c in a.columns if c != by), *(c for c in b.columns if c != by))
