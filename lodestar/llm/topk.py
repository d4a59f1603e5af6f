"""Exact top-k search by inner product, by MaxScore over shards.

The components of a vector are its terms. Rows stay where they are: a shard is what one task reads of their written table.
Queries come in blocks of ``QUERY_BYTES`` at most, which are broadcast; a block is one pass over the rows, without a shuffle
of vectors. In a shard each term has a score bound for a query: the largest product that the values of the term allow.
Terms are split by these bounds: the non-essential ones together can't lift a row over the query's threshold (its k-th
best score so far). The essential terms' values are traversed for all rows, the others probed only for rows that still can
compete, a few terms at a time. A first pass over one row in ``WARM_PART`` gives each query a threshold, which all other
shards start from; shards report at most k rows a query, and a window merges them.

Scores are exact integers; ties go to the smaller id.

Edge cases: vectors that are null or hold null or non-finite components take no part, nor do rows without an id; vectors of
another length than the query's are no candidates; repeated ids are separate rows, each a candidate for the other; fewer
than k candidates are all returned; an empty table gives no rows; columns other than id and vector aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import shared_dir, written

#: Bytes of query vectors (8 a component) that pass through the driver at a time.
QUERY_BYTES = 1 << 25
#: One row in so many is scored first, for thresholds.
WARM_PART = 32
#: Rows scored in full where there is no threshold yet; terms probed at a time.
WARM, PROBE = 64, 8
NONE = np.iinfo(np.int64).min

FOUND = {"query_row": pa.int64(), "query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "row": pa.int64()}


def scored_shard(q: np.ndarray, q_row: np.ndarray, least: np.ndarray, rows: np.ndarray, row_id: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(query's position, rows' positions, scores) of the k best rows of a shard for each query, but for those under ``least``, the
    queries' thresholds so far (NONE without one)."""
    if len(rows) and float(np.abs(q).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1] < 2**53:
        q, rows = q.astype(float), rows.astype(float)  # products and sums stay exact, and numpy is faster
    bounds = np.maximum(q * rows.max(axis=0), q * rows.min(axis=0))
    out = []
    for i in range(len(q)):
        own = row_id != q_row[i]
        threshold = None if least[i] == NONE else least[i]
        if threshold is None:
            warm = np.flatnonzero(own)[:WARM]
            scores = rows[warm] @ q[i]
            threshold = np.partition(scores, len(scores) - k)[-k] if len(scores) >= k else None
        order = np.argsort(-bounds[i], kind="stable")
        rest = bounds[i][order][::-1].cumsum()[::-1]  # the most that the terms from here on add
        if threshold is not None and rest[0] < threshold:
            continue
        # without a threshold all are essential; else those before the last terms that together stay under it
        essential = len(order) if threshold is None else max(1, int(np.searchsorted(-rest, -threshold, side="right")))
        partial = rows[:, order[:essential]] @ q[i][order[:essential]]
        alive, done = np.flatnonzero(own), essential
        while done < len(order) and len(alive):
            alive = alive[partial[alive] + rest[done] >= threshold]
            terms = order[done : done + PROBE]
            partial[alive] += rows[np.ix_(alive, terms)] @ q[i][terms]
            done += PROBE
        if threshold is not None:
            alive = alive[partial[alive] >= threshold]
        best = alive[np.lexsort((ids[alive], -partial[alive]))[:k]]
        if len(best):
            out.append((i, best, partial[best].astype(np.int64)))
    return out


def _matrices(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """ids, rows and vectors of a batch, by the vectors' length."""
    table = pa.Table.from_batches([batch]) if isinstance(batch, pa.RecordBatch) else batch
    dims = table.column("dims").to_numpy()
    for d in np.unique(dims):
        part = table.filter(pa.array(dims == d)) if len(table) and (dims != d).any() else table
        if d:
            v = part.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            yield part.column("id").to_numpy(), part.column("row").to_numpy(), v


def best_of(rows: DataFrame, queries: list, k: int) -> DataFrame:
    """The k best rows of each shard for each query of a block: (ids, rows, vectors, thresholds) by length. The block is broadcast."""
    held = rows.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = [(q_id, q_row, q, least.copy()) for q_id, q_row, q, least in held.value]
        best: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
        for batch in batches:
            for ids, row, v in _matrices(batch):
                for b, (_, q_row, q, least) in enumerate(block):
                    if q.shape[1] != v.shape[1]:
                        continue
                    for i, at, scores in scored_shard(q, q_row, least, v, row, ids, k):
                        new = scores, ids[at], row[at]
                        if (b, i) in best:
                            new = tuple(np.concatenate(x) for x in zip(best[b, i], new, strict=True))
                            first = np.lexsort((new[2], new[1], -new[0]))[:k]
                            new = tuple(x[first] for x in new)
                        best[b, i] = new
                        if len(new[0]) == k:
                            least[i] = max(least[i], new[0].min())
        if best:
            n = [len(x[0]) for x in best.values()]
            q_rows, q_ids = (np.repeat([block[b][c][i] for b, i in best], n) for c in (1, 0))
            scores, ids, row = (np.concatenate([x[c] for x in best.values()]) for c in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q_rows, q_ids, ids, scores, row)], names=[*FOUND])

    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in FOUND))


def search(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds, the k rows of the highest scores."""
    spark = df.sparkSession
    fine = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    floors = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    base = df.filter(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), floors.alias("v"), F.size(vector).alias("dims"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row"))
    base = written(base, "topk")
    size = base.filter("q").agg(F.sum(8 * F.col("dims") + 16)).first()[0] or 0
    blocks = max(1, -(-2 * size // QUERY_BYTES))  # half full on average, so that none is over
    vectors, place = ("id", "row", "dims", "v"), F.pmod(F.xxhash64("row"), F.lit(blocks))
    is_warm = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(WARM_PART)) == 0
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    path = f"{shared_dir(spark)}/topk-found-{uuid.uuid4().hex}"
    for b in range(blocks):
        asked = [*_matrices(base.filter(F.col("q") & (place == b)).select(*vectors).toArrow())]
        queries = [(ids, row, v, np.full(len(ids), NONE)) for ids, row, v in asked]
        warm = written(best_of(base.filter(is_warm).select(*vectors), queries, k), "topk-warm")
        kth = warm.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("query_row", "score").toArrow()
        least = dict(zip(kth.column("query_row").to_pylist(), kth.column("score").to_pylist(), strict=True))
        queries = [(ids, row, v, np.array([least.get(r, NONE) for r in row.tolist()], np.int64)) for ids, row, v in asked]
        warm.unionByName(best_of(base.filter(~is_warm).select(*vectors), queries, k)).write.mode("append").parquet(path)
    found = spark.read.schema(", ".join(f"{c} long" for c in FOUND)).parquet(path)
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
