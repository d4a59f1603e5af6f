"""Suffix-array dedup: every byte covered by a 400-byte string that also starts elsewhere, found exactly.

The suffix arrays are built by linear grouping (``group_suffixes``): suffixes are put into groups by their Lyndon prefixes,
working from the largest group down; each suffix of a group points to the previous smaller one, and those pointed to
are regrouped right behind their old group, by how often they were hit. A second pass then emits every group's order
from the order of the suffixes that end its Lyndon prefixes. Nothing is renamed or solved recursively.

A corpus has no single suffix array here; strings that can share ``length`` bytes are brought together first:

1. Each window of ``length`` bytes picks an anchor, its leftmost gram of smallest hash. Equal windows pick equal anchors at
   equal offsets, so only anchors whose gram stands in two places go on (``candidates``).
2. The windows of an anchor lie in one stretch of text; equal stretches collapse to one with a count (``contexts``). What stands
   twice repeats as a whole.
3. Where a gram also has stretches that stand once, all its stretches are compared: a stretch is cut into ranges of ``RANGE`` windows. All windows of a range share a core; ranges of equal cores form a
   group, and a member is what stands left and right of the core (``ranges``). Cores become one symbol each, so a member
   is a short string, and a window repeats if its suffix shares ``RANGE`` symbols with a neighbour in the suffix array, or
   if its member stands for several stretches (``judge``).
4. A core that over ``HOT`` rows share is split into finer ranges, whose cores are longer, down to single windows; these go
   the same way (``judged``), so no task holds a large group.
5. Verdicts go back to the texts, whose windows' union is removed (``marked``, ``removals``).

Stretches, cores and texts are told apart by 128-bit digests: exact but for their collisions. Equal texts are worked on once,
with their number.

Edge cases: null texts are empty; texts under ``length`` bytes lose nothing; overlapping copies count (a run of one letter is
all repeats but for its own single window); rows alike in text lose the same; an empty table gives no rows; columns other
than key and text aren't read by ``repeats``; ``deduped`` keeps all columns, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import common
from lodestar.llm.common import fresh, text_key

LENGTH = 400
#: Bytes that 50 words take at least, about: what the pipeline cuts out, and what ``n_passages`` counts.
PASSAGE = 200
GRAM = 64
RANGE = 64
#: Bytes of texts that are looked at together.
SEGMENT = 1 << 19
#: Rows of a core that are judged as they are; more are cut into ranges of an eighth.
HOT = 1000
FINER = 8
#: Symbols of a suffix array, about.
SYMBOLS = 100_000
#: Bytes of an Arrow batch, about. A batch is held several times over by an executor (vectors, the stream to Python) and its Python workers, beside the heap.
BATCH = 4_000_000


def written(df: DataFrame, name: str) -> DataFrame:
    """``common.written``, with batches of whole texts that go to Python bounded by bytes; the session's setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    before = conf.get(key)
    conf.set(key, f"{BATCH}b")
    try:
        return common.written(df, name)
    finally:
        conf.set(key, before)


# ---- suffix arrays ----


def group_suffixes(s: np.ndarray) -> list[int]:
    """The suffix array of non-negative integers whose last, 0, is smaller than all others."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    ranked = s[order]
    heads = np.flatnonzero(np.r_[True, ranked[1:] != ranked[:-1]])
    sizes = np.diff(np.r_[heads, n])
    sa = order.tolist()
    starts = np.empty(n, np.int64)
    starts[order] = np.repeat(heads, sizes)
    group = starts.tolist()  # the first place of a suffix's group; groups compare by it
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    size = [0] * n
    for h, k in zip(heads.tolist(), sizes.tolist(), strict=True):
        size[h] = k
    smaller = [-2] * n  # the previous suffix of a smaller group, -1: none, -2: not known yet
    end = n
    while end > 0:
        head = group[sa[end - 1]]
        hits: dict[int, int] = {}
        for i in sa[head:end]:
            if smaller[i] != -2:
                continue
            chain, p = [i], i - 1  # suffixes of this group in a row have the same pointer
            while p >= 0 and group[p] >= head:
                if smaller[p] == -2:
                    chain.append(p)
                    p -= 1
                else:
                    p = smaller[p]
            for x in chain:
                smaller[x] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + len(chain)
        by_hits: list[list[int]] = [[] for _ in range(max(hits.values(), default=0) + 1)]
        for p, k in hits.items():
            by_hits[k].append(p)
        for k in range(len(by_hits) - 1, 0, -1):
            moved: dict[int, int] = {}
            for p in by_hits[k]:
                g = group[p]
                m = moved[g] = moved.get(g, 0) + 1
                to, at = g + size[g] - m, place[p]
                other = sa[to]
                sa[to], sa[at] = p, other
                place[p], place[other] = to, at
            for g, m in moved.items():
                if m == size[g]:
                    continue
                new = g + size[g] - m
                size[g] -= m
                size[new] = m
                for p in sa[new : new + m]:
                    group[p] = new
        end = head
    # the order within groups: from each suffix, those whose Lyndon prefixes end there
    out, done, free = [0] * n, [False] * n, list(range(n))
    out[0] = n - 1
    done[n - 1] = True
    for x in range(n):
        j = out[x] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = smaller[j]
    return out


# ---- anchors ----

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BITS = np.uint64((1 << 24) - 1)


def grams(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each GRAM bytes."""
    h = np.lib.stride_tricks.as_strided(b[:8].view("<u8"), shape=(len(b) - 7,), strides=(1,)) * _MUL
    k = 8
    while k < GRAM:
        h ^= h >> np.uint64(29)
        h = h[:-k] * _MUL + h[k:]
        k *= 2
    h ^= h >> np.uint64(32)
    h *= _MUL
    return h ^ (h >> np.uint64(32))


def anchors_of(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts ``b[starts[i]:ends[i]]``: gram hashes, places of anchors, and the first and last windows that picked them."""
    w = length - GRAM + 1
    if len(b) < length:
        none = np.empty(0, np.int64)
        return none, none, none, none
    h = grams(b)
    x = (h & ~_BITS) | np.arange(len(h), dtype=np.uint64)
    full = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max)
    full[: len(x)] = x
    full = full.reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(back[: len(x) - w + 1], ahead[w - 1 : len(x)]) & _BITS).astype(np.int64)
    # windows that lie inside a text; those of different texts have different anchors
    edge = np.zeros(len(at) + 1, np.int32)
    long = ends - starts >= length
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - length + 1, -1)
    window = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    at = at[window]
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else window
    return h[at[new]].view(np.int64), at[new], window[new], window[np.r_[new[1:], len(at)] - 1] if len(at) else window


def _pieces(column: pa.Array, segment: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The texts of a column in buffers of about ``segment`` bytes: bytes, rows, starts and ends. A longer text is cut into
    stretches that overlap, so that each of its windows lies in one."""
    binary = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    offsets = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(binary) + 1].astype(np.int64)
    data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)
    rows, start = len(binary), 0
    while start < rows:
        end = max(int(np.searchsorted(offsets, offsets[start] + segment, "right")) - 1, start + 1)
        yield data[offsets[start] : offsets[end]], np.arange(start, end), offsets[start:end] - offsets[start], offsets[start + 1 : end + 1] - offsets[start]
        start = end


def anchors_in(column: pa.Array, length: int, segment: int) -> Iterator[tuple[np.ndarray, ...]]:
    """row, gram, at, first, last of a column's texts, a buffer at a time."""
    for b, rows, starts, ends in _pieces(column, segment):
        if len(rows) > 1 or len(b) <= 2 * segment:
            gram, at, first, last = anchors_of(b, starts, ends, length)
            row = np.searchsorted(starts, first, "right") - 1
            base = starts[row]
            yield rows[row], gram, at - base, first - base, last - base
            continue
        found = []
        for s in range(0, len(b) - length + 1, segment):
            part = b[s : s + segment + length - 1]
            found.append([x if i == 0 else x + s for i, x in enumerate(anchors_of(part, np.array([0]), np.array([len(part)]), length))])
        gram, at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
        # an anchor at a border was found from both sides
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        yield np.full(len(new), rows[0]), gram[new], at[new], first[new], last[np.r_[new[1:], len(at)] - 1]


def _lists(row: np.ndarray, n: int, values: np.ndarray) -> pa.Array:
    """A list for each of ``n`` rows, of the values whose ``row`` (sorted) it is."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int64()))


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each value of a list column, and the values."""
    n = pc.list_value_length(column).fill_null(0).to_numpy()
    return np.repeat(np.arange(len(column)), n), column.flatten()


def _map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: (out for batch in batches for out in fn(batch)), schema)


_I64, _BIN = pa.int64(), pa.binary()


def candidates(texts: DataFrame, length: int) -> DataFrame:
    """rid, t1, t2, n, text, grams: the different texts (columns t1, t2, text) with an anchor's gram that stands twice, their
    number, and those grams."""
    segment = SEGMENT

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column = batch.column("text")
        found = [*anchors_in(column, length, segment)]
        row, gram = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), _lists(row, len(column), gram)], names=["t1", "t2", "grams"])

    long = texts.filter(F.octet_length("text") >= length)
    found = written(_map(long, fn, "t1 long, t2 long, grams array<long>"), "suffix-grams")
    every = found.select("t1", "t2", F.explode("grams").alias("gram"))
    # a table of its own, so that the join below has a plain shuffle on either side, and a gram of very many places can be split
    twice = written(every.groupBy("gram").count().filter("count > 1").select("gram"), "suffix-twice")
    shared = every.join(twice, "gram", "left_semi").groupBy("t1", "t2").agg(F.collect_set("gram").alias("grams"))
    each = long.join(shared, ["t1", "t2"]).groupBy("t1", "t2").agg(F.first("text").alias("text"), F.first("grams").alias("grams"), F.count(F.lit(1)).alias("n"))
    return written(each.withColumn("rid", F.monotonically_increasing_id()), "suffix-texts")


# ---- stretches around anchors ----


def _halves(digests: list[bytes]) -> list[np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return [both[:, 0], both[:, 1]]


def contexts(texts: DataFrame, length: int) -> DataFrame:
    """x1, x2 (128 bits of a stretch), gram, rid, n (copies of the text), the anchor's place ``at``, and ``low`` and ``high``, how far
    before the anchor the last and the first window start that picked it."""
    segment = SEGMENT

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        column = batch.column("text")
        wanted = np.unique(batch.column("grams").flatten().to_numpy())
        rid, n = (batch.column(c).to_numpy() for c in ("rid", "n"))
        last, b = -1, b""
        for row, gram, at, first, end in anchors_in(column, length, segment):
            keep = np.isin(gram, wanted)
            row, gram, at, first, end = row[keep], gram[keep], at[keep], first[keep], end[keep]
            out = []
            for r, a, s, e in zip(row.tolist(), at.tolist(), first.tolist(), (end + length).tolist(), strict=True):
                if r != last:
                    last, b = r, memoryview(column[r].as_buffer())
                out.append(xxh3_128_digest(b[s:e], a - s))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (*_halves(out), gram, rid[row], n[row], at, (at - end).astype(np.int32), (at - first).astype(np.int32))], names=["x1", "x2", "gram", "rid", "n", "at", "low", "high"])

    return _map(texts.select("text", "grams", "rid", "n"), fn, "x1 long, x2 long, gram long, rid long, n long, at long, low int, high int")


def ranges(texts: DataFrame, length: int) -> DataFrame:
    """c1, c2 (128 bits of a core), side, n, x1, x2, high: the ranges of the stretches in ``wanted`` (at, low, high, x1, x2, n).
    ``high``: how far before the anchor a range's first window starts."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        column = batch.column("text")
        row, stretches = _flat(batch.column("wanted"))
        at, low, high, x1, x2, n = (stretches.field(c).to_numpy() for c in ("at", "low", "high", "x1", "x2", "n"))
        for start in range(0, len(row), 20_000):
            cores, sides, which, highs = [], [], [], []
            last, b = -1, b""
            for i in range(start, min(start + 20_000, len(row))):
                if row[i] != last:
                    last = row[i]
                    b = column[int(last)].as_buffer().to_pybytes()
                p, lo, hi = int(at[i]), int(low[i]), int(high[i])
                for k in range(lo // RANGE, hi // RANGE + 1):
                    a = p - k * RANGE  # the core's start
                    z = a - RANGE + 1 + length
                    first, final = min(hi, k * RANGE + RANGE - 1), max(lo, k * RANGE)
                    cores.append(xxh3_128_digest(b[a:z], k))  # with its place, lest a text meet itself by two anchors
                    sides.append(bytes((first - k * RANGE,)) + b[p - first : a] + b[z : p - final + length])
                    which.append(i)
                    highs.append(first)
            if cores:
                yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in _halves(cores)), pa.array(sides, _BIN), *(pa.array(v[which]) for v in (n, x1, x2)), pa.array(highs, pa.int32())], names=["c1", "c2", "side", "n", "x1", "x2", "high"])

    return _map(texts.select("text", "wanted"), fn, "c1 long, c2 long, side binary, n long, x1 long, x2 long, high int")


# ---- verdicts ----


def repeated_windows(groups: list[list[tuple[bytes, int]]], width: int) -> list[list[int]]:
    """For each member (side, number) of each group, the bits of its windows (of ``width`` symbols) that repeat, by one suffix
    array. A member that stands for several stretches repeats with itself."""
    symbols, where = [], []
    for g, members in enumerate(groups):
        for m, (side, _) in enumerate(members):
            k = side[0]
            where.append((len(symbols), g, m, len(side) - width + 1))
            symbols += [c + 2 for c in side[1 : k + 1]]
            symbols.append(258 + g)
            symbols += [c + 2 for c in side[k + 1 :]]
            symbols.append(1)
    s = np.array([*symbols, 0], np.int64)
    starts = np.full(len(s), -1, np.int64)
    for w, (at, _, _, windows) in enumerate(where):
        starts[at : at + windows] = w
    sa = np.array(group_suffixes(s), np.int64)
    sa = sa[starts[sa] >= 0]
    out = [[0] * len(members) for members in groups]
    if len(sa):
        rows = s[sa[:, None] + np.arange(width)]
        twin = (rows[1:] == rows[:-1]).all(axis=1)
        again = np.r_[False, twin] | np.r_[twin, False]
        for i in sa[again].tolist():
            at, g, m, _ = where[starts[i]]
            out[g][m] |= 1 << (i - at)
    for _, g, m, windows in where:
        if groups[g][m][1] > 1:
            out[g][m] = (1 << windows) - 1
    return out


def judge(members: DataFrame, keep: list[str], width: int) -> DataFrame:
    """``keep`` and ``bits`` of the rows of ``members`` (c1, c2, side, n) with a window that repeats: one shuffle by core, then
    suffix arrays of about SYMBOLS symbols over the groups as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[list[list]] = []  # of each core, its different sides: side, number
        kept: list[pa.RecordBatch] = []
        places: list[tuple[int, int]] = []  # of each row
        size, last = 0, None

        def out() -> pa.RecordBatch:
            # the windows of a core's only member repeat if it stands for several stretches
            busy = {g: i for i, g in enumerate(i for i, g in enumerate(groups) if len(g) > 1)}
            found = repeated_windows([groups[g] for g in busy], width) if busy else []
            bits = np.array([found[busy[g]][m] if g in busy else (1 << len(groups[g][0][0]) - width + 1) - 1 if groups[g][0][1] > 1 else 0 for g, m in places], np.uint64).view(np.int64)
            some = np.flatnonzero(bits)
            rows = pa.Table.from_batches(kept).take(pa.array(some)).combine_chunks()
            return pa.RecordBatch.from_arrays([*(rows.column(c).combine_chunks() for c in keep), pa.array(bits[some])], names=[*keep, "bits"])

        for batch in batches:
            begun = 0
            for i, (c1, c2, side, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("c1", "c2", "side", "n")), strict=True)):
                if (c1, c2) != last:
                    last = c1, c2
                    if size >= SYMBOLS:
                        kept.append(batch.slice(begun, i - begun).select(keep))
                        yield out()
                        groups, kept, places, size, begun = [], [], [], 0, i
                    groups.append([])
                group = groups[-1]
                if group and group[-1][0] == side:
                    group[-1][1] += n
                else:
                    group.append([side, n])
                    size += len(side) + 1
                places.append((len(groups) - 1, len(group) - 1))
            kept.append(batch.slice(begun).select(keep))
        if places:
            yield out()

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(members.dtypes)
    names = dict.fromkeys(["c1", "c2", "side", "n", *keep])
    sorted_ = members.select(*names).repartition(parts, "c1", "c2").sortWithinPartitions("c1", "c2", "side")
    return sorted_.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "bits long"]))


def finer(members: DataFrame, width: int) -> DataFrame:
    """The members (c1, c2, side, n) cut into ranges of an eighth of the width: u1, u2 (the finer range's core), ``inner`` (its
    side), ``first`` (the bit of its first window), and the members' columns. What all windows of a finer range share of
    the sides goes into the core."""
    step = width // FINER
    left = F.conv(F.hex(F.substring("side", 1, 1)), 16, 10).cast("int")
    m = members.withColumn("__left", left).withColumn("__right", F.octet_length("side") - 1 - F.col("__left"))
    # windows by how many symbols of the left part they take: from ``low`` to ``__left``
    m = m.withColumn("__low", F.lit(width - 1) - F.col("__right"))
    m = m.withColumn("__j", F.explode(F.sequence(F.floor(F.col("__low") / step).cast("int"), F.floor(F.col("__left") / step).cast("int"))))
    first = F.least(F.col("__left"), F.col("__j") * step + step - 1)  # the most symbols that a window here takes
    final = F.greatest(F.col("__low"), F.col("__j") * step)
    shared_left, shared_right = F.col("__j") * step, F.lit(width - step) - F.col("__j") * step
    cut = lambda start, n: F.substring(F.col("side"), start, n)
    core = [F.col("__j"), cut(F.col("__left") - shared_left + 2, shared_left), cut(F.col("__left") + 2, shared_right)]
    outer_left = cut(F.col("__left") - first + 2, first - shared_left)
    outer_right = cut(F.col("__left") + 2 + shared_right, F.lit(width - 1) - final - shared_right)
    inner = F.concat(F.unhex(F.lpad(F.hex(first - shared_left), 2, "0")), outer_left, outer_right)
    u1, u2 = F.xxhash64("c1", "c2", *core), F.xxhash64(F.lit(7), "c1", "c2", *core)
    return m.select(*members.columns, u1.alias("u1"), u2.alias("u2"), inner.alias("inner"), (F.col("__left") - first).alias("first"))


def judged(members: DataFrame, keep: list[str], width: int = 0) -> DataFrame:
    """``keep`` and ``bits`` of the rows of ``members`` (a written table) with a window that repeats. A core that over ``HOT`` rows
    share is split: its members are cut into finer ranges, whose cores say more, and these are judged likewise; at a width
    of one window a core is the whole window, and equal rows are one."""
    width = width or RANGE
    hot = written(members.groupBy("c1", "c2").count().filter(F.col("count") > HOT).select("c1", "c2"), "suffix-hot") if width > 1 else None
    if hot is None or hot.isEmpty():
        return judge(members, keep, width)
    some = judge(members.join(hot, ["c1", "c2"], "left_anti"), keep, width)
    rows = members.join(hot, ["c1", "c2"], "left_semi")
    each = written(rows.groupBy("c1", "c2", "side").agg(F.sum("n").alias("n")), "suffix-members")
    fine = finer(each, width)
    inner = fine.groupBy("u1", "u2", "inner").agg(F.sum("n").alias("n")).select(F.col("u1").alias("c1"), F.col("u2").alias("c2"), F.col("inner").alias("side"), "n")
    inner = judged(written(inner, "suffix-finer"), ["c1", "c2", "side"], width // FINER)
    inner = inner.select(F.col("c1").alias("u1"), F.col("c2").alias("u2"), F.col("side").alias("inner"), F.col("bits").alias("__b"))
    bits = fine.join(inner, ["u1", "u2", "inner"]).groupBy("c1", "c2", "side").agg(F.bit_or(F.call_function("shiftleft", F.col("__b"), F.col("first"))).alias("bits"))
    bits = written(bits, "suffix-bits")  # a side may be that of very many rows: a plain join can be split
    return some.unionByName(rows.join(bits, ["c1", "c2", "side"]).select(*keep, "bits"))


def marked(texts: DataFrame, length: int) -> DataFrame:
    """The texts (rid, t1, t2, n, text, grams) with a window that repeats, and ``marks``: start of a range of windows, bits of
    those that repeat."""
    found = written(contexts(texts, length), "suffix-contexts")
    each = found.groupBy("x1", "x2", "gram", "low", "high").agg(F.sum("n").alias("n"), F.min(F.struct("rid", "at")).alias("p"))
    each = written(each.select("x1", "x2", "gram", "low", "high", "n", "p.*"), "suffix-stretches")
    # a stretch that stands twice repeats as a whole; one that stands once is compared with all others of its gram
    single = each.groupBy("gram").agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") == 1).alias("single")).filter("all > 1 and single > 0")
    single = written(single.select("gram"), "suffix-single")  # a table of its own, for the join's sake as above
    wanted = each.join(single, "gram", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("at", "low", "high", "x1", "x2", "n")).alias("wanted"))
    members = written(ranges(texts.join(wanted, "rid"), length), "suffix-ranges")
    bits = judged(members, ["x1", "x2", "high", "n"]).filter("n = 1").select("x1", "x2", "high", "bits")
    windows = F.expr("transform(sequence(0, (high - low) div 64), i -> struct(high - 64 * i as high, shiftrightunsigned(-1L, greatest(0, 63 - high + 64 * i + low)) as bits))")
    whole = each.filter("n > 1").select("x1", "x2", windows.alias("v"))
    verdicts = written(bits.groupBy("x1", "x2").agg(F.collect_list(F.struct("high", "bits")).alias("v")).unionByName(whole), "suffix-verdicts")
    marks = found.select("x1", "x2", "rid", "at").join(verdicts, ["x1", "x2"])
    marks = marks.select("rid", F.transform("v", lambda v: F.struct((F.col("at") - v["high"]).alias("start"), v["bits"].alias("bits"))).alias("m"))
    marks = marks.groupBy("rid").agg(F.flatten(F.collect_list("m")).alias("marks"))
    return texts.select("rid", "t1", "t2", "text").join(marks, "rid")


def removals(texts: DataFrame, length: int, decoded: bool = False) -> DataFrame:
    """t1, t2, n_removed, n_spans, spans and kept of marked texts. ``decoded``: kept is a string, and a character cut in two goes
    as a whole."""

    def fn(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        column, marks = batch.column("text"), batch.column("marks")
        for i in range(len(column)):
            b = np.frombuffer(column[i].as_buffer(), np.uint8)
            mark = marks[i].values
            bits = np.unpackbits(mark.field("bits").to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, off = np.nonzero(bits)
            edges = np.zeros(len(b) + 1, np.int32)
            at = np.unique(mark.field("start").to_numpy()[which] + off)
            edges[at] += 1
            edges[at + length] -= 1  # both without doubles
            gone = np.cumsum(edges[:-1]) > 0
            turns = np.flatnonzero(np.diff(np.r_[False, gone, False])).reshape(-1, 2)
            spans = [{"start": s, "end": e} for s, e in turns.tolist()]
            kept = b[~gone].tobytes()
            values = ([batch.column("t1")[i].as_py()], [batch.column("t2")[i].as_py()], [int(gone.sum())], [len(spans)], [spans], [kept.decode("utf-8", "ignore") if decoded else kept])
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, types.values(), strict=True)], names=[*types])

    types = {"t1": _I64, "t2": _I64, "n_removed": _I64, "n_spans": _I64, "spans": pa.list_(pa.struct([("start", _I64), ("end", _I64)])), "kept": pa.string() if decoded else _BIN}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for made in fn(batch):
                held.append(made)
                size += made.nbytes
                if size > 4_000_000:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return texts.select("text", "marks", "t1", "t2").mapInArrow(run, f"t1 long, t2 long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept {'string' if decoded else 'binary'}")


# ---- the operator ----


def _texts(df: DataFrame, text: str) -> DataFrame:
    return df.select(*text_key(F.coalesce(F.col(text), F.lit(""))), F.col(text).alias("text"))


def repeats(df: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """Per different text (t1, t2) with something to remove: n_removed, n_spans, spans (start and end of each run, in bytes)
    and kept (the remaining bytes)."""
    return removals(marked(candidates(_texts(df, text), length), length), length)


def dedup(df: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """Per row: key, n_bytes, n_removed, n_spans, kept_sha256 by strings of ``length`` bytes; n_passages: n_spans, or where that is 0
    the runs of strings of ``passage`` bytes that also start elsewhere; has_repeat: n_passages > 0."""
    texts = candidates(_texts(df, text), min(length, passage))
    found = written(removals(marked(texts, length), length).select("t1", "t2", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), "suffix-removed")
    # texts that lost nothing, and all that share a gram with them: the anchors of longer strings are among those of shorter ones
    clean = texts.join(found, ["t1", "t2"], "left_anti").select(F.explode("grams").alias("gram")).distinct()
    open_ = texts.select("rid", F.explode("grams").alias("gram")).join(clean, "gram").groupBy("rid").agg(F.collect_list("gram").alias("grams"))
    texts = written(texts.drop("grams").join(open_, "rid"), "suffix-open")
    short = removals(marked(texts, passage), passage).select("t1", "t2", F.col("n_spans").alias("n_passages"))
    raw = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key), F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw.cast("binary"), 256).alias("__whole"), *text_key(raw))
    joined = rows.join(found.join(short, ["t1", "t2"], "full_outer"), ["t1", "t2"], "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    joined = joined.select(key, "n_bytes", n("n_removed").alias("n_removed"), n("n_spans").alias("n_spans"), F.coalesce("kept_sha256", "__whole").alias("kept_sha256"), F.when(n("n_spans") > 0, n("n_spans")).otherwise(n("n_passages")).alias("n_passages"))
    return joined.withColumn("has_repeat", F.col("n_passages") > 0)


def deduped(df: DataFrame, text: str = "text", length: int = PASSAGE) -> DataFrame:
    """The rows of ``df`` with what repeats cut out of their texts; a character cut in two goes as a whole."""
    found = removals(marked(candidates(_texts(df, text), length), length), length, decoded=True)
    # a table of its own: no Python worker stands beside the join of whole texts
    found = written(found.select("t1", "t2", "kept"), "suffix-kept").toDF(*(names := fresh(df, "t1", "t2", "kept")))
    t1, t2, kept = names
    k1, k2 = text_key(F.coalesce(F.col(text), F.lit("")))
    joined = df.join(found, (k1 == F.col(t1)) & (k2 == F.col(t2)), "left")
    return joined.select(*(F.coalesce(F.col(kept), F.col(c)).alias(c) if c == text else F.col(f"`{c}`") for c in df.columns))
