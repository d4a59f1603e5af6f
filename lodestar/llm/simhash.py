"""SimHash near-duplicates: fingerprints, tiled exact comparison, connected components.

Fingerprint: texts have A-Z lower-cased and are split at ASCII white space; each shingle of ``width`` words (repeats count
each time; a shorter text is one shingle; a text without words has fingerprint 0) is hashed by XXH64, and a bit of the
fingerprint is set if it is set in over half the hashes.

Comparison: equal fingerprints collapse first. The distinct ones are cut into tiles by the population counts of their
``q`` equal parts. Two fingerprints within ``radius`` bits have population counts whose differences sum to no more than
``radius``, so a tile meets only the tiles that near: all others are skipped unread. Tile pairs are keyed rows, so Spark
deals them out; each is compared exactly by numpy exclusive-or and bit counts, and reports a spanning forest of its
links instead of all pairs. ``q`` is 2, 4 or 8 by the number of distinct fingerprints, which changes the cost alone.

Components: alternating large-star and small-star steps on the links, each step a pair of grouped minimums and joins,
cut off by a written table.

Edge cases: null and empty texts have fingerprint 0 and link to each other like any others; null keys never name a
component unless no other key is in it; repeated rows all appear in the result; an empty table gives no rows; columns
other than key and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, map_texts, written

#: Fingerprints of a tile, about.
TILE = 8192
#: Rows of a tile that are compared with the other tile at a time.
STRIP = 64
#: Hashes whose bits are counted at a time.
HASHES = 1 << 15
#: Near copies of the pipeline: this part of the distinct shingles of so many words in common. Pairs within so many bits are compared
#: first, which changes the cost alone.
COPY_LEAST = (4, 5)
COPY_WIDTH = 5
COPY_RADIUS = 12
#: A text's prefix holds one in so many of its shingles beyond those that a copy may lack.
COPY_SPARE = 10
#: Bytes of a tile, about, and the width of a band of shingle counts in logarithms: a little over ln(5 / 4).
COPY_TILE = 1 << 20
BAND = 0.2235


def shingles(text: str | None, width: int) -> list[bytes]:
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint(text: str | None, width: int, seed: int) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    from xxhash import xxh64_intdigest

    found = shingles(text, width)
    if not found:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(found), HASHES):
        part = found[i : i + HASHES]
        hashes = np.array([xxh64_intdigest(s, seed) for s in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * counts > len(found)).tolist())


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, ``keep`` and ``fp`` (the fingerprint's bits as a long) of each row."""

    def start() -> Callable[[list], dict[str, list]]:
        return lambda texts: {"fp": np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64)}

    return map_texts(df, [key, *keep], text, start, {"fp": "long"})


def spanning_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Positions (i, j) of a spanning forest of the links between two tiles (or inside one): |a| + |b| links at most."""
    component = np.arange(len(b))
    out = []
    for start in range(0, len(a), STRIP):
        near = np.bitwise_count(a[start : start + STRIP, None] ^ b[None, :]) <= radius
        for r in np.flatnonzero(near.any(axis=1)).tolist():
            i = start + r
            js = np.flatnonzero(near[r])
            if same:
                if len(js) < 2:
                    continue
                js = np.concatenate([[i], js[js != i]])
            labels, first = np.unique(component[js], return_index=True)
            if same:
                out += [(i, j) for j in js[first].tolist() if component[j] != component[i]]
            else:
                out += [(i, j) for j in js[first].tolist()]
            if len(labels) > 1:
                component[np.isin(component, labels)] = labels[0]
    return out


def _dealt(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def _steps(q: int, radius: int) -> list[tuple[int, ...]]:
    """All vectors of ``q`` integers whose absolute values sum to ``radius`` at most."""
    if not q:
        return [()]
    return [(x, *rest) for x in range(-radius, radius + 1) for rest in _steps(q - 1, radius - abs(x))]


def links(fps: DataFrame, radius: int = 3, q: int = 0) -> DataFrame:
    """Links ``u``, ``v`` that connect all distinct fingerprints ``fp`` within ``radius`` bits, directly or by way of others."""
    n = fps.count()
    q = q or (2 if n < 1_000_000 else 4 if n < 100_000_000 else 8)
    bits = 64 // q
    counts = [F.bit_count(F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit((1 << bits) - 1))).cast("long") for i in range(q)]
    place = sum((c * (128**i) for i, c in enumerate(counts)), F.lit(0).cast("long"))
    placed = fps.select("fp", place.alias("place"))
    sizes = written(placed.groupBy("place").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("subs")), "simhash-places")
    subbed = placed.join(sizes, "place").select("fp", "place", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int").alias("sub"))
    # dealt by both, as a place may hold any number of tiles
    tiles = written(_dealt(subbed, "place", "sub").groupBy("place", "sub").agg(F.collect_list("fp").alias("fps")), "simhash-tiles")
    steps = _steps(q, radius)
    shifts = sorted({s for d in steps if (s := sum(x * 128**i for i, x in enumerate(d))) >= 0})
    left = tiles.select(F.col("place").alias("p"), F.col("sub").alias("s"), F.col("fps").alias("a"), F.explode(F.array(*map(F.lit, shifts))).alias("shift"))
    left = left.withColumn("place", F.col("p") + F.col("shift")).join(sizes, "place")
    left = left.withColumn("sub", F.explode(F.sequence(F.when(F.col("shift") == 0, F.col("s")).otherwise(F.lit(0)), F.col("subs") - 1)))
    pairs = left.join(tiles, ["place", "sub"]).select("a", F.col("fps").alias("b"), ((F.col("shift") == 0) & (F.col("s") == F.col("sub"))).alias("same"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b, same in zip(pdf["a"], pdf["b"], pdf["same"], strict=True):
                x, y = np.asarray(a, np.int64), np.asarray(b, np.int64)
                if found := spanning_links(x.view(np.uint64), y.view(np.uint64), radius, bool(same)):
                    i, j = np.array(found).T
                    yield pd.DataFrame({"u": x[i], "v": y[j]})

    return pairs.mapInPandas(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` for each node of the links ``u``, ``v`` but the roots: root is its component's smallest node."""
    e = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now[0] == 0 or (now[0], now[1]) == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (now[0], now[1])
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(small.distinct(), "links")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, seed: int = 42, radius: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's ``key``, ``keep``, ``fp``, ``root`` (a fingerprint that stands for its component) and ``component_id``: the
    smallest key reachable over links of ``radius`` bits at most."""
    marked = written(fingerprints(df, key, text, width, seed, keep), "simhash")
    distinct = written(marked.groupBy("fp").agg(F.min(key).alias("first")), "simhash-distinct")
    roots = components(links(distinct.select("fp"), radius))
    grouped = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    named = grouped.join(smallest, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select(key, *keep, "fp", "root", "component_id")


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingles of ``COPY_WIDTH`` words of a text as sorted 64-bit hashes."""
    from xxhash import xxh64_intdigest

    return np.unique(np.array([xxh64_intdigest(x, 1) for x in shingles(text, COPY_WIDTH)], "<u8"))


def alike(n_both: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Whether sets of so many members, so many of them common, have a Jaccard similarity of ``COPY_LEAST``."""
    return COPY_LEAST[1] * n_both >= COPY_LEAST[0] * (n_a + n_b - n_both)


def tile_pairs(nodes: DataFrame, place: str, fields: tuple[str, ...], bytes_: Column, name: str) -> DataFrame:
    """Pairs of tiles of ``nodes`` of the same ``place``: ``fields`` of either side as lists (those of the left one end in ``_a``), and
    ``same`` for a tile with itself. Pairs are made of numbers alone; each then fetches its two tiles."""
    placed = nodes.select(F.col(place).alias("place"), *fields)
    sizes = written(placed.groupBy("place").agg(F.ceil(F.sum(bytes_) / COPY_TILE).cast("int").alias("subs")), f"{name}-places")
    subbed = placed.join(sizes, "place").select("place", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int").alias("sub"), *fields)
    tiles = _dealt(subbed, "place", "sub").groupBy("place", "sub").agg(F.collect_list(F.struct(*fields)).alias("__t"))
    tiles = written(tiles.select("place", "sub", *(F.col(f"__t.{c}").alias(c) for c in fields)), f"{name}-tiles")
    numbers = tiles.select("place", "sub").join(sizes, "place").select("place", F.col("sub").alias("__s"), F.explode(F.sequence("sub", F.col("subs") - 1)).alias("sub"))
    left = tiles.select("place", F.col("sub").alias("__s"), *(F.col(c).alias(f"{c}_a") for c in fields))
    return numbers.join(left, ["place", "__s"]).join(tiles, ["place", "sub"]).select(*(f"{c}_a" for c in fields), *fields, (F.col("__s") == F.col("sub")).alias("same"))


class _Forest:
    """Which nodes of two tiles are joined already: the nodes of the right one come after those of the left one, unless it's the same."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _pairs(a: list[np.ndarray], b: list[np.ndarray], same: bool, forest: _Forest, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs of two tiles (fp, n) whose numbers of shingles allow for copies and that aren't joined yet: those
    within ``COPY_RADIUS`` bits first, which join most copies, then all others."""
    (x, n_a), (y, n_b) = a, b
    for near in (True, False):
        for start in range(0, len(x), STRIP):
            roots = np.array([forest.root(k) for k in range(shift + len(y))])
            apart = roots[start : min(start + STRIP, len(x)), None] != roots[None, shift:]
            i, j = np.nonzero(((np.bitwise_count(x[start : start + STRIP, None] ^ y[None, :]) <= COPY_RADIUS) == near) & apart)
            i += start
            ok = alike(np.minimum(n_a[i], n_b[j]), n_a[i], n_b[j])
            if same:
                ok &= i < j
            if ok.any():
                yield i[ok], j[ok]


def _column(batch: pa.RecordBatch, name: str, row: int) -> pa.Array:
    return batch.column(name)[row].values


def _numbers(batch: pa.RecordBatch, row: int, side: str) -> list[np.ndarray]:
    fp, n = (_column(batch, f"{c}{side}", row).to_numpy() for c in ("fp", "n"))
    return [fp.view(np.uint64), n]


def _links(batch: pa.RecordBatch, row: int, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    x, y = np.array(pairs).T
    return pa.RecordBatch.from_arrays([pa.array(_column(batch, c, row).to_numpy()[k]) for c, k in (("node_a", x), ("node", y))], names=["u", "v"])


def prefix(s: np.ndarray) -> np.ndarray:
    """The first members of a set of shingles: as many as a copy may lack, and one in ``COPY_SPARE`` of all."""
    n = len(s)
    return s[: n - -(-n * COPY_LEAST[0] // COPY_LEAST[1]) + -(-n // COPY_SPARE)]


def candidates(nodes: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect all nodes (node, n, first) that can be copies, directly or by way of others, by two prefix filters.

    ``first`` is the ``prefix`` of a node's n shingles in the order of their hashes. Of two copies, neither has more than n - ceil(0.8 n)
    shingles that the other lacks, so the first ceil(n / 10) common ones (n of the smaller one) are in both prefixes. A copy
    has 0.8 n at least, so a node shares ceil(0.08 n) of its prefix with each copy. Nodes with fewer shingles that stand in any
    other prefix are out. The rest orders its prefix by how many nodes have a shingle: without its last ceil(0.08 n) - 1 members,
    two copies still share one. Equal members are met by an equi-join on shingle and band of n (copies are in the same band or in
    neighbouring ones), each node with the smallest one only. Counts and joins keep one row a node and shingle, and tables are
    written between, so AQE splits the rows of a frequent shingle."""
    members = nodes.select("node", "n", F.explode("first").alias("s"))
    often = written(members.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "copies-often")
    least = F.expr(f"({COPY_LEAST[0]} * n + {COPY_LEAST[1] * COPY_SPARE - 1}) div {COPY_LEAST[1] * COPY_SPARE}")
    node = Window.partitionBy("node")  # the shingles of one text
    shared = members.join(often, "s").withColumn("__m", F.count(F.lit(1)).over(node)).filter(F.col("__m") >= least)
    rare = shared.withColumn("__r", F.row_number().over(node.orderBy("df", "s"))).filter(F.col("__r") <= F.col("__m") - least + 1)
    band = F.floor(F.log("n") / F.lit(BAND)).cast("int")
    met = written(rare.select("node", "s", F.explode(F.array(band, band + 1)).alias("band")), "copies-met")
    one = written(met.groupBy("s", "band").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("df")).filter("df > 1").drop("df"), "copies-one")
    return met.join(one, ["s", "band"]).filter("node <> v").select(F.col("node").alias("u"), "v")


def _bitmaps(sets: pa.Array, bits: int) -> np.ndarray:
    """For each set of shingles, the bits at its members modulo ``bits``, as rows of 64-bit words."""
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        at = np.frombuffer(s.as_buffer(), "<u8") & np.uint64(bits - 1)
        np.bitwise_or.at(out[i], (at >> np.uint64(3)).astype(np.int64), np.left_shift(1, at & np.uint64(7)).astype(np.uint8))
    return out.view(np.uint64)


def copies(sets: DataFrame) -> DataFrame:
    """Links ``u``, ``v`` that connect all nodes (node, group, fp, n, s: the shingles' hashes) whose sets are alike by exact counts,
    directly or by way of others: a spanning forest of each pair of tiles, so no more links than nodes, however large a group
    of near copies is. Only nodes of a group meet. A pair that is joined already isn't compared. Of the rest, most that
    aren't copies are told by bitmaps: the bits of one set that the other one hasn't are members that it lacks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a, b, same = _numbers(batch, r, "_a"), _numbers(batch, r, ""), batch.column("same")[r].as_py()
                s_a, s_b = _column(batch, "s_a", r), _column(batch, "s", r)
                if same and len(s_a) < 2:
                    continue
                bits = 64 << int(max(a[1].max(), b[1].max()) // 8).bit_length()
                map_a = _bitmaps(s_a, bits)
                map_b = map_a if same else _bitmaps(s_b, bits)
                shift = 0 if same else len(s_a)
                forest, found = _Forest(shift + len(s_b)), []
                for i, j in _pairs(a, b, same, forest, shift):
                    for at in range(0, len(i), 4096):
                        p, q = i[at : at + 4096], j[at : at + 4096]
                        lacks = np.bitwise_count(map_a[p] & ~map_b[q]).sum(axis=1, dtype=np.int64)
                        ok = alike(np.minimum(a[1][p] - lacks, b[1][q]), a[1][p], b[1][q])
                        for x, y in zip(p[ok].tolist(), q[ok].tolist(), strict=True):
                            if forest.root(x) == forest.root(y + shift):
                                continue
                            one, other = (np.frombuffer(s.as_buffer(), "<u8") for s in (s_a[x], s_b[y]))
                            if alike(len(np.intersect1d(one, other, assume_unique=True)), len(one), len(other)):
                                forest.join(x, y + shift)
                                found.append((x, y))
                if found:
                    yield _links(batch, r, found)

    return tile_pairs(sets, "group", ("node", "fp", "n", "s"), 8 * F.col("n") + 24, "copies-sets").mapInArrow(run, "u long, v long")


def copy_roots(df: DataFrame, key: str, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Each row's ``key``, ``keep`` and ``root``: a number that stands for all rows that links between texts, of at least
    ``COPY_LEAST`` in common, join to it. No link is lost. Texts with the same words are one node. Prefix filters find groups of
    nodes that can be copies; only their sets of shingles go into tiles, group by group, where pairs are checked, by fingerprints
    first."""

    def start() -> Callable[[list], dict[str, list]]:
        from xxhash import xxh3_128_intdigest

        def make(texts: list) -> dict[str, list]:
            whole = [xxh3_128_intdigest(b" ".join((t or "").encode().lower().split())) for t in texts]
            halves = [np.array([h >> s & 0xFFFFFFFFFFFFFFFF for h in whole], np.uint64).view(np.int64) for s in (0, 64)]
            fps = np.array([fingerprint(t, 3, 42) for t in texts], np.uint64).view(np.int64)
            sets = [shingle_set(t) for t in texts]
            return {"h1": halves[0], "h2": halves[1], "fp": fps, "n": [len(s) for s in sets], "first": [prefix(s).view(np.int64) for s in sets]}

        return make

    columns = {"h1": "long", "h2": "long", "fp": "long", "n": "long", "first": "array<bigint>"}
    rows = written(map_texts(df, [key, *keep], text, start, columns, arrow={"first": pa.list_(pa.int64())}), "copies")
    of = F.min(F.struct(*keep)).alias("__of")
    nodes = rows.groupBy("h1", "h2").agg(F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("first").alias("first"), of)
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "copies-nodes")
    # most groups are small: only inside them do sets of shingles meet
    reach = written(components(candidates(nodes)), "copies-reach")
    group = reach.select("node", F.col("root").alias("group")).union(reach.select("root", "root").distinct())
    wanted = nodes.join(group, "node").select("node", "group", "fp", "n", *(F.col(f"__of.{c}").alias(f"__{i}") for i, c in enumerate(keep)))
    texts = df.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), F.col(f"`{text}`").alias("__text"))
    texts = texts.join(wanted, [f"__{i}" for i in range(len(keep))]).dropDuplicates(["node"])
    sets = lambda: (lambda ts: {"s": [shingle_set(t).tobytes() for t in ts]})
    sets = written(map_texts(texts, ["node", "group", "fp", "n"], "__text", sets, {"s": "binary"}), "copies-sets")
    roots = components(copies(sets))
    named = nodes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("root"))
    return rows.select(key, *keep, "h1", "h2").join(named, ["h1", "h2"]).select(key, *keep, "root")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` with one row of each group of near copies (``copy_roots``): the one of the smallest key (then of the
    smallest hash). Columns keep their names and values whatever they are called."""
    k1, k2 = fresh(df, "__k1", "__k2")
    marked = df.withColumns({k1: F.xxhash64(key, text), k2: F.xxhash64(F.lit(7), text, key)})
    found = copy_roots(marked, key, text, (k1, k2))
    first = found.groupBy("root").agg(F.min(F.struct(F.col(key).isNull(), key, k1, k2)).alias("x")).select(f"x.{k1}", f"x.{k2}")
    return marked.join(first, [k1, k2], "left_semi").dropDuplicates([k1, k2]).select(*(F.col(f"`{c}`") for c in df.columns))
