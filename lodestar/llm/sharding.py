"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

A row descends the tree by one weighted hash draw a level: each child c of weight w draws -ln(u) / w, where u in (0, 1)
comes from the hash of (key, child's name), and the smallest draw wins. A child's chance is its share of its siblings'
weight. If the weight of one child grows, only that child's draws shrink: rows move into its subtree alone and no row
moves between the others; below a node whose children's weights are as before, no row moves.

Shards fill the tree in order: ``SHARDS_A_RACK`` shards a rack, ``RACKS_A_REGION`` racks a region. A shard that opens a
region (as the 17th of the default tree does) is a new top-level subtree, so growing by it takes rows only into itself.
A shard added to a region that is there already also draws rows to that region's other shards, but moves none between
the subtrees whose weights stay.

Everything is built-in column functions: draws are codegen'd expressions over narrow rows; no text is shuffled.

Edge cases: a null key draws as the text "null"; equal keys share a shard; a null text has size 1 and checksum 0; an
empty table gives no rows; input columns beyond the key and the text aren't read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS_A_RACK, RACKS_A_REGION = 4, 2
#: Rows that one window of ``slots`` numbers, about.
ROWS_A_BUCKET = 100_000


def draw(key: Column, name: str, weight: float) -> Column:
    """An exponential draw of rate ``weight`` from the first 52 bits of md5(key, name)."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("/" + name))), 1, 13), 16, 10).cast("long")
    return -F.log((bits + 1).cast("double") / F.lit(float(1 << 52) + 1)) / F.lit(float(weight))


def tree(n: int, weights: dict[int, float] | None = None) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight for shards 0 to n - 1; weights default to 1."""
    out: dict[int, dict[int, dict[int, float]]] = {}
    for s in range(n):
        rack = s // SHARDS_A_RACK
        out.setdefault(rack // RACKS_A_REGION, {}).setdefault(rack, {})[s] = (weights or {}).get(s, 1.0)
    return out


def _pick(key: Column, level: str, weights: dict[int, float]) -> Column:
    """The child with the smallest draw; equal draws (never seen) go to the smaller number."""
    if len(weights) == 1:
        return F.lit(next(iter(weights)))
    return F.least(*(F.struct(draw(key, f"{level}{c}", w).alias("d"), F.lit(c).alias("c")) for c, w in weights.items()))["c"]


def _switch(value: Column, cases: dict[int, Column]) -> Column:
    first, *rest = cases.items()
    out = F.when(value == first[0], first[1])
    for k, v in rest:
        out = out.when(value == k, v)
    return out


def assign(df: DataFrame, key: str, n: int, out: str, weights: dict[int, float] | None = None) -> DataFrame:
    """Add ``out``, the shard (0 to n - 1) of each row by its key column, a level at a time."""
    k = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    regions = tree(n, weights)
    racks = {rack: shards for x in regions.values() for rack, shards in x.items()}
    rack_weights = {r: {rack: sum(shards.values()) for rack, shards in x.items()} for r, x in regions.items()}
    df = df.withColumn("__region", _pick(k, "region", {r: sum(w.values()) for r, w in rack_weights.items()}))
    df = df.withColumn("__rack", _switch(F.col("__region"), {r: _pick(k, "rack", w) for r, w in rack_weights.items()}))
    df = df.withColumn(out, _switch(F.col("__rack"), {r: _pick(k, "shard", w) for r, w in racks.items()}).cast("int"))
    return df.drop("__region", "__rack")


def slots(df: DataFrame, shard_col: str, order: list[str], out: str = "slot") -> DataFrame:
    """Number the rows of each shard without gaps from 0. No task sees a whole shard: rows are numbered within
    (shard, bucket), and each bucket starts where the counts of those before it end."""
    spark = df.sparkSession
    total = df.count()
    buckets = max(8, -(-total // ROWS_A_BUCKET))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = df.repartition(parts, shard_col, "__bucket")
    counts = df.groupBy(shard_col, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(shard_col).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard_col).alias("__s"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(shard_col, "__bucket").orderBy(*order)
    numbered = dealt.withColumn("__r", F.row_number().over(inside))
    joined = numbered.join(starts, (F.col(shard_col) == F.col("__s")) & (F.col("__bucket") == F.col("__b")), "left")
    return joined.withColumn(out, (F.col("__start") + F.col("__r") - 1).cast("long")).drop("__s", "__b", "__start", "__r", "__bucket")


def shard_documents(documents: DataFrame, n: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, size (UTF-8 bytes of the text, plus 1), text_crc32, law ``key``, shard, slot, grown_shard (with one
    more shard)."""
    df = documents.select(
        F.col(key),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    df = assign(assign(df, key, n, "shard"), key, n + 1, "grown_shard")
    return slots(df, "shard", [key, "size", "text_crc32"]).select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
