"""Lookups: Hamming top-k, re-ranking by cosine, fast path, margins, boosts, rotations.

Every search meets a stated set of queries with all rows. Distances are worked out for a block of queries and a batch of rows
at a time, and only k rows a query leave it, so no pair is ever a row of a table. The rows stay where they are; queries are broadcast, in
blocks of ``QUERIES`` and ``QUERY_BYTES`` at most, one after the other. Long lists by hash take two passes: the first counts distances,
so that the second reports rows of the lists and no others but ties of their last distance.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import rotate

#: Queries of a broadcast block, and the bytes of their hashes and vectors, at most.
QUERIES = 10_000
QUERY_BYTES = 32 << 20
#: Queries that are compared with a batch of rows at a time.
STRIP = 64
#: Lists of more rows than this take two passes. Rows that are compared with a strip at a time, and pairs whose vectors are held, there.
SHORT = 32
CHUNK = 2_048
PAIRS = 8_192


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of each group; Spark limits groups before and after its shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(flat), -1)


def _units(column: pa.ChunkedArray) -> np.ndarray:
    v = _matrix(column, np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-8)


def _cosines(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of units at 6 places, of rows i of x and j of y; only ``PAIRS`` pairs of vectors are held at a time."""
    out = np.empty(len(i))
    for start in range(0, len(i), PAIRS):
        at = slice(start, start + PAIRS)
        out[at] = np.round(np.clip((x[i[at]] * y[j[at]]).sum(axis=1), -1, 1), 6)
    return out


def _hash_matrix(column: pa.ChunkedArray) -> np.ndarray:
    return _matrix(column, np.int64).view(np.uint64)


def _within(q: pa.Table, r: pa.Table, limit: np.ndarray, differ: list[tuple[str, str]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """A strip's start, its end, positions of queries and rows, and distances (bits that differ, over all hashes): the pairs of a strip of
    queries and a chunk of rows that are not farther apart than the query's limit. ``limit`` may be lowered between two steps."""
    a, b = _hash_matrix(q.column("query_hash")), np.ascontiguousarray(_hash_matrix(r.column("hash")).T)
    pairs = [(q.column(x).to_numpy(), r.column(y).to_numpy()) for x, y in differ]
    kind = np.uint8 if 64 * len(b) < 256 else np.uint16
    most = np.minimum(limit, np.iinfo(kind).max).astype(kind)
    # memory that all steps share: apart, bits of a hash, distances, near ones
    held = [np.empty(STRIP * CHUNK, t) for t in (np.uint64, np.uint8, kind, bool)]
    for first in range(0, b.shape[1], CHUNK):
        for start in range(0, len(a), STRIP):
            x, y = a[start : start + STRIP], b[:, first : first + CHUNK]
            apart, bits, dist, near = (m[: len(x) * y.shape[1]].reshape(len(x), -1) for m in held)
            for h in range(len(y)):
                np.bitwise_xor(x[:, h, None], y[h], out=apart)
                np.bitwise_count(apart, out=bits if h else dist)
                if h:
                    np.add(dist, bits, out=dist)
            most[start : start + len(x)] = np.minimum(limit[start : start + len(x)], np.iinfo(kind).max)
            np.less_equal(dist, most[start : start + len(x), None], out=near)
            at = np.flatnonzero(near)
            i, j = np.divmod(at, y.shape[1])
            i, j, d = i + start, j + first, dist.ravel()[at]
            for mine, theirs in pairs:
                fine = mine[i] != theirs[j]
                i, j, d = i[fine], j[fine], d[fine]
            yield start, start + len(x), i, j, d


def counted(q: pa.Table, k: int, differ: list[tuple[str, str]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many rows are at each distance of each query: ``at`` (the query's position), ``dist``, ``n``, as far as k rows of ``batches`` go."""
    width = 64 * _hash_matrix(q.column("query_hash")).shape[1] + 1 if len(q) else 1
    n, limit = np.zeros((len(q), width), np.int64), np.full(len(q), width - 1)
    for batch in batches:
        if len(q) and len(batch):
            for start, end, i, _, dist in _within(q, pa.Table.from_batches([batch]), limit, differ):
                n[start:end] += np.bincount((i - start) * width + dist, minlength=(end - start) * width).reshape(-1, width)
                limit[start:end] = np.minimum((np.cumsum(n[start:end], axis=1) < k).sum(axis=1), width - 1)
    i, dist = np.nonzero(n * (np.arange(width) <= limit[:, None]))
    for start in range(0, len(i), 1 << 16):
        at = slice(start, start + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(i[at], pa.int32()), pa.array(dist[at], pa.int32()), pa.array(n[i[at], dist[at]])], names=["at", "dist", "n"])


def listed(q: pa.Table, limit: np.ndarray, ties: np.ndarray, row: str, differ: list[tuple[str, str]], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, positions of queries and rows, and distances: all rows nearer than the query's limit, and of those at the limit at least
    the ``ties`` smallest by id that ``batches`` hold."""
    had, most, last = np.zeros(len(q), np.int64), np.full(len(q), np.iinfo(np.int64).min), np.full(len(q), np.iinfo(np.int64).max)
    for batch in batches:
        if not len(q) or not len(batch):
            continue
        r = pa.Table.from_batches([batch])
        ids, held, size = r.column(row).to_numpy(), [], 0
        for *_, i, j, dist in _within(q, r, limit, differ):
            tied = dist == limit[i]
            t = np.flatnonzero(tied & (ids[j] <= last[i]))
            t = t[np.lexsort((ids[j[t]], i[t]))]
            t = t[np.arange(len(t)) - np.searchsorted(i[t], i[t]) < ties[i[t]]]
            np.add.at(had, i[t], 1)
            np.maximum.at(most, i[t], ids[j[t]])
            full = i[t][had[i[t]] >= ties[i[t]]]
            last[full] = np.minimum(last[full], most[full])  # so many have come that none with a larger id is needed
            kept = np.concatenate([np.flatnonzero(~tied), t])
            held.append((i[kept], j[kept], dist[kept]))
            size += len(kept)
            if size >= 1 << 16:
                yield r, *map(np.concatenate, zip(*held, strict=True))
                held, size = [], 0
        if size:
            yield r, *map(np.concatenate, zip(*held, strict=True))


def nearest_of(q: pa.Table, r: pa.Table, k: int, by: str, query: str, row: str, differ: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries and rows, and the distance, of each query's k nearest rows; ties to the smaller row id."""
    ids = r.column(row).to_numpy()
    if by == "hash":
        a, b = (_hash_matrix(t.column(c)) for t, c in ((q, "query_hash"), (r, "hash")))
    else:
        a, b = _units(q.column("query_embedding")), _units(r.column("embedding")).T
    pairs = [(q.column(x).to_numpy(), r.column(y).to_numpy()) for x, y in differ]
    found = []
    for start in range(0, len(a), STRIP):
        part = a[start : start + STRIP]
        if by == "hash":
            dist = sum(np.bitwise_count(part[:, None, h] ^ b[None, :, h]).astype(np.int32) for h in range(part.shape[1]))
        else:
            dist = -np.round(np.clip(part @ b, -1, 1), 6)
        out = np.zeros(dist.shape, bool)
        for x, y in pairs:
            out |= x[start : start + STRIP, None] == y[None, :]
        for i in range(len(part)):
            at = np.flatnonzero(~out[i])
            d = dist[i, at]
            if len(at) > k:
                near = d <= np.partition(d, k - 1)[k - 1]
                at, d = at[near], d[near]
            first = np.lexsort((ids[at], d))[:k]
            found.append((np.full(len(first), start + i), at[first], d[first]))
    if not found:
        return np.empty(0, int), np.empty(0, int), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def limits(rows: DataFrame, held: Broadcast, k: int, differ: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """For each of the queries ``held``, the distance of its k-th nearest row, and how many rows of that distance belong to the k."""
    columns = rows.select(*dict.fromkeys([*(y for _, y in differ), "hash"]))
    counts = columns.mapInArrow(lambda batches: counted(held.value, k, differ, batches), "at int, dist int, n long")
    upto = F.sum("n").over(Window.partitionBy("at").orderBy("dist"))
    cells = counts.groupBy("at", "dist").agg(F.sum("n").alias("n")).withColumn("upto", upto)
    ends = cells.groupBy("at").agg(F.min(F.when(F.col("upto") >= k, F.col("dist"))).alias("limit"), F.max(F.when(F.col("upto") < k, F.col("upto"))).alias("below"))
    got = ends.filter("limit is not null").select("at", "limit", F.coalesce("below", F.lit(0)).alias("below")).toArrow()
    limit, ties = np.full(len(held.value), np.iinfo(np.int32).max), np.full(len(held.value), k)  # where there are fewer than k rows, all belong
    at = got.column("at").to_numpy()
    limit[at], ties[at] = got.column("limit").to_numpy(), k - got.column("below").to_numpy()
    return limit, ties


def knn(queries: DataFrame, rows: DataFrame, k: int, by: str = "hash", query: str = "query_id", row: str = "vec_id", differ: tuple[tuple[str, str], ...] = (("query_id", "vec_id"),), keep: tuple[str, ...] = (), sims: bool = False, then: Callable[[DataFrame], DataFrame] = lambda found: found) -> DataFrame:
    """The k nearest rows for each query, ties to the smaller row id, ranked from 1: query, row, ``dist``, ``keep`` (columns of
    either side), ``sim`` if asked for, ``rank``.

    ``by`` hash: bits that differ in all hashes of the arrays ``query_hash`` and ``hash`` together. ``by`` cosine: ``dist`` is less
    the cosine of ``query_embedding`` and ``embedding`` at 6 places. ``differ``: columns in which a pair must not agree
    nor be null.
    ``sims``: the cosine too, of the rows that are found. Rows and queries without a hash or vector, or with a null in it, take no part.
    ``then``: what becomes of the rows found, query by query; each block of queries goes through it before the next one comes."""
    vectors = {"hash"} if by == "hash" else set()
    vectors |= {"embedding"} if by == "cosine" or sims else set()
    mine, theirs = [x for x, _ in differ], [y for _, y in differ]
    q = queries.select(*dict.fromkeys([query, *mine, *(c for c in keep if c in queries.columns), *(f"query_{c}" for c in sorted(vectors))]))
    r = rows.select(*dict.fromkeys([row, *theirs, *(c for c in keep if c in rows.columns), *sorted(vectors)]))
    spark, long = queries.sparkSession, by == "hash" and k > SHORT
    checkpoints = bool(spark.sparkContext.getCheckpointDir())
    if long and checkpoints:
        r = r.checkpoint()  # each block of queries reads the rows twice; filters come later, for they would work hashes out once more
    whole = lambda c: F.col(c).isNotNull() & ~F.exists(c, lambda x: x.isNull())
    for c in sorted(vectors):
        q, r = q.filter(whole(f"query_{c}")), r.filter(whole(c))
    for x, y in differ:
        q, r = q.filter(F.col(x).isNotNull()), r.filter(F.col(y).isNotNull())
    sources = {query: q, row: r} | {c: q if c in q.columns else r for c in keep}
    kinds = {c: next(t for n, t in df.dtypes if n == c) for c, df in sources.items()} | {"dist": "int" if by == "hash" else "double"} | ({"sim": "double"} if sims else {})
    names = [*sources]

    def pairs(a: pa.Table, b: pa.Table, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> pa.Table:
        out = {c: (a.column(c).take(pa.array(i)) if c in a.column_names else b.column(c).take(pa.array(j))) for c in names}
        out["dist"] = pa.array(dist, pa.int32() if by == "hash" else pa.float64())
        if sims:
            out["sim"] = pa.array(_cosines(_units(a.column("query_embedding")), _units(b.column("embedding")), i, j))
        return pa.table(out)

    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items())
    width = sum((F.size(f"query_{c}") * 8 for c in sorted(vectors)), F.lit(64))
    n, size = q.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    # half full on average, so that none is over
    blocks = 1 if n <= QUERIES and size <= QUERY_BYTES else max(-(-2 * n // QUERIES), -(-2 * size // QUERY_BYTES))


    def block(b: int) -> DataFrame:
        asked = q if blocks == 1 else q.filter(F.pmod(F.xxhash64(query), F.lit(blocks)) == b)
        held = spark.sparkContext.broadcast(asked.toArrow())
        bounds = spark.sparkContext.broadcast(limits(r, held, k, list(differ)) if long else None)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if long:
                for found in listed(held.value, *bounds.value, row, list(differ), batches):
                    yield from pairs(held.value, *found).combine_chunks().to_batches()
                return
            for batch in batches:
                if len(held.value) and len(batch):
                    part = pa.Table.from_batches([batch])
                    yield from pairs(held.value, part, *nearest_of(held.value, part, k, by, query, row, list(differ))).combine_chunks().to_batches()

        best = then(top_k(r.mapInArrow(run, schema), [query], [F.col("dist"), F.col(row)], k))
        if blocks > 1 and checkpoints:
            best = best.checkpoint()  # so that a block leaves memory before the next comes
            held.destroy()
            bounds.destroy()
        return best

    found = block(0)
    for b in range(1, blocks):
        found = found.unionAll(block(b))
    return found


def rotations(queries: DataFrame, block: str, query: str = "query_id") -> DataFrame:
    """A row for each quarter turn of each query's block, from the unturned one."""
    turned = F.array(*(F.struct(F.lit(q).alias("turn"), rotate(F.col(block), q).alias("block")) for q in range(4)))
    return queries.select(query, F.explode(turned).alias("t")).select(query, "t.turn", "t.block")


def margins(ranked: DataFrame, value: str, query: str, rank: str, out: str, default: float, descending: bool = True) -> DataFrame:
    """Per query: the difference between ranks 1 and 2, or ``default`` for a single row."""
    first, second = (F.max(F.when(F.col(rank) == r, F.col(value))) for r in (1, 2))
    gap = (first - second) if descending else (second - first)
    return ranked.groupBy(query).agg(F.coalesce(gap, F.lit(default)).alias(out))


def rerank(candidates: DataFrame, boosts: list[Column], k: int, margin: float = 0.05, add: float = 0.10, query: str = "query_id", row: str = "vec_id") -> DataFrame:
    """Candidates (with ``sim`` and ``dist``) by similarity, in as many rounds as ``boosts``: where ranks 1 and 2 are closer than
    ``margin``, rows for which the round's boost holds gain ``add``; the next round looks at the order that results."""
    scored = candidates.withColumn("score", F.round("sim", 6))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "dist", row)
    whole = Window.partitionBy(query)
    for boost in boosts:
        ranked = scored.withColumn("r", F.row_number().over(order))
        first, second = (F.max(F.when(F.col("r") == n, F.col("score"))).over(whole) for n in (1, 2))
        tight = F.round(F.coalesce(first - second, F.lit(1.0)), 6) < margin
        scored = ranked.withColumn("score", F.round(F.col("score") + F.when(tight & F.coalesce(boost, F.lit(False)), add).otherwise(0.0), 6)).drop("r")
    return top_k(scored, [query], [F.desc("score"), F.col("dist"), F.col(row)], k)


def dual_route(modern: DataFrame, whole: DataFrame, confidence: float = 0.70, query: str = "query_id") -> DataFrame:
    """One row a query: the path taken and its distances. Both sides are ranked lists (``dist``, ``rank``) with the predicted
    ``frame`` and its ``conf``. A query of low confidence tries both and keeps the closer one (ties: modern); any other takes
    only its own path, so the losing distance is null. ``+fast_hash`` where the winner is decisive."""
    sides = [side.groupBy(query, "frame", "conf").agg(F.min("dist").alias(name), F.max(F.when(F.col("rank") == 2, F.col("dist"))).alias(f"{name}2")) for side, name in ((modern, "modern"), (whole, "whole"))]
    both = sides[0].join(sides[1], [query, "frame", "conf"])
    unsure = F.col("conf") < confidence
    takes_modern = F.when(unsure, F.col("modern") <= F.col("whole")).otherwise(F.col("frame") == "modern")
    pick = lambda a, b: F.when(takes_modern, F.col(a)).otherwise(F.col(b))
    best, gap = pick("modern", "whole"), F.coalesce(pick("modern2", "whole2") - pick("modern", "whole"), F.lit(0))
    route = F.when(~unsure, "single").when(takes_modern, "parallel_modern").otherwise("parallel_whole")
    return both.select(query, F.concat(route, F.when((best <= 4) & (gap >= 8), "+fast_hash").otherwise("")).alias("route"), F.when(unsure, F.when(takes_modern, "modern").otherwise("fullart")).otherwise(F.col("frame")).alias("effective_frame"), best.alias("winning_dist"), F.when(unsure, pick("whole", "modern")).alias("losing_dist"))


def displayed(ranked: DataFrame, catalog: DataFrame, row: str, fields: list[str], upper: list[str] = ()) -> DataFrame:
    """Ranked rows with the catalog's fields for display: ``?`` where one is absent, those of ``upper`` in capitals."""
    joined = ranked.join(catalog.select(row, *fields), row, "left")
    shown = {f: F.coalesce(F.col(f), F.lit("?")) for f in fields}
    return joined.withColumns({f: F.upper(c) if f in upper else c for f, c in shown.items()})
