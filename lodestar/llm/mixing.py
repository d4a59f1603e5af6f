"""Mixing sources to target weights by the cube method.

Targets: sources by code point, null last, weigh 1, 2, 3, repeating, and share the words of all documents. A target stops at
``CAP`` times its source's words; the excess is reshared by weight until no target is above. In closed form the target
is least(cap, L * weight) for one level L, found by a running sum over the sources in the order of cap by weight.

Copies: a source whose target is r times its words takes each document floor(r) times, and once more with inclusion
probability p = r - floor(r). The cube method decides who: the flight moves the probabilities of a few documents at a
time along the null space of the constraints (number of documents, number of words) until one of them is 0 or 1, so both
totals stay as they are; when no such move is left, a block has two undecided documents at most. Blocks of about
``BLOCK`` documents fly alone, whatever the size of a source; what they leave undecided meets in new blocks, a level at a
time, until a source is one block. There ``HELD`` documents stay out of the flight, and the landing rounds them and the last
undecided ones together, by trying all ways, to the one that comes nearest to both totals. Random
choices come from hashes of the documents, so reruns agree.

Edge cases: a null text has size 0; documents of size 0 are taken like others and add no words; a source without words
has target 0 and takes nothing; rows that are alike in key and size are separate units; an empty table gives no rows;
columns other than key, text and source aren't read.
"""

from __future__ import annotations

import random
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import fresh, n_words, written

CAP = 3
BLOCK = 4096
#: Documents that are left for the landing of a source: 2 ** (HELD + 2) ways are tried.
HELD = 10
EPS = 1e-9


def targets(units: DataFrame, cap: float = CAP, share: float = 1.0) -> DataFrame:
    """Per source: source, source_size, n, target. The windows run over one row a source."""
    by_code = Window.orderBy(F.col("source").isNull(), "source")
    s = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    s = s.withColumn("weight", (F.row_number().over(by_code) - 1) % 3 + 1)
    s = s.withColumn("cap", F.col("source_size").cast("double") * cap)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before, everything = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    left = F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / rest)
    # the level rises while sources stop at their caps and falls after that
    s = s.withColumn("target", F.least("cap", F.max("level").over(everything) * F.col("weight")))
    return s.select("source", "source_size", "n", "target")


def flight(p: list[float], size: list[int], rng: random.Random, landing: bool) -> list[float]:
    """Move the probabilities, keeping their sum and the sum of p * size, until two at most are undecided; with
    ``landing``, those two and ``HELD`` others that didn't fly are rounded together."""
    waiting = [i for i in range(len(p) - 1, -1, -1) if EPS < p[i] < 1 - EPS]
    held = [waiting.pop() for _ in range(min(HELD, len(waiting)))] if landing else []
    active: list[int] = []

    def move(idx: list[int], u: list[float]) -> None:
        up = min((1 - p[i]) / d if d > 0 else p[i] / -d for i, d in zip(idx, u, strict=True) if d)
        down = min(p[i] / d if d > 0 else (1 - p[i]) / -d for i, d in zip(idx, u, strict=True) if d)
        step = up if rng.random() * (up + down) < down else -down
        for i, d in zip(idx, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * d))

    while True:
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) == 3:
            i, j, k = active
            a, b, c = size[j] - size[k], size[k] - size[i], size[i] - size[j]
            move(active, [a, b, c] if a or b or c else [1, -1, 0])
        elif len(active) == 2 and size[active[0]] == size[active[1]]:
            move(active, [1, -1])
        else:
            break
        active = [i for i in active if EPS < p[i] < 1 - EPS]
    if landing and (rest := active + held):
        at, sizes = np.array([p[i] for i in rest]), np.array([size[i] for i in rest], float)
        choices = (np.arange(1 << len(rest))[:, None] >> np.arange(len(rest))) & 1
        off = np.abs((choices - at) @ sizes) + 0.1 * sizes.mean() * np.abs((choices - at).sum(axis=1))
        for i, x in zip(rest, choices[int(off.argmin())].tolist(), strict=True):
            p[i] = float(x)
    return p


def _fly(block: int):
    def run(group: pa.Table) -> pa.Table:
        p, size, tie = (group.column(c).to_pylist() for c in ("__p", "size", "__tie"))
        landing = group.column("n")[0].as_py() <= block  # the source has no other block
        order = sorted(range(len(p)), key=lambda i: (tie[i], size[i]))
        seed = tie[order[0]] ^ len(order)
        moved = flight([p[i] for i in order], [size[i] for i in order], random.Random(seed), landing)
        out = [0.0] * len(p)
        for i, v in zip(order, moved, strict=True):
            out[i] = 0.0 if v <= EPS else 1.0 if v >= 1 - EPS else v
        at = group.schema.get_field_index("__p")
        return group.set_column(at, group.schema.field(at), pa.array(out, pa.float64()))

    return run


def mix(units: DataFrame, key: list[str], cap: float = CAP, share: float = 1.0) -> DataFrame:
    """Rows of units (columns ``key``, source, size) with source_size, target and ``copies``, the times each is taken."""
    base = written(units.select(*key, "source", "size", F.xxhash64(*key, F.lit("cube")).alias("__tie")), "mix-units")
    per = written(targets(base, cap, share), "mix-targets")
    largest = per.agg(F.max("n")).first()[0] or 0
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    named = per.select(F.col("source").alias("__s"), "source_size", "n", "target", ratio.alias("__r"))
    rows = base.join(named, base["source"].eqNullSafe(F.col("__s"))).drop("__s")
    rows = rows.withColumn("__whole", F.floor(F.col("__r") + EPS)).withColumn("__p", F.greatest(F.col("__r") - F.col("__whole"), F.lit(0.0)))
    done = None
    while True:
        # two of each block go on at most; a source of one block lands
        blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.lit(1)).cast("long")
        last = largest <= BLOCK
        block = F.pmod(F.xxhash64("__tie", F.lit(largest)), blocks).alias("__block")
        flown = rows.select("*", block).groupBy("source", "__block").applyInArrow(_fly(BLOCK), rows.select("*", block).schema)
        flown = written(flown.drop("__block"), "mix-flown")
        decided = flown.filter("__p = 0 or __p = 1")
        done = decided if done is None else done.unionByName(decided)
        if last:
            break
        rows = flown.filter("__p > 0 and __p < 1").withColumn("n", 2 * F.ceil(F.col("n") / BLOCK))
        largest = 2 * ceil(largest / BLOCK)
    return done.select(*key, "source", "size", "source_size", "target", (F.col("__whole") + F.col("__p")).cast("long").alias("copies"))


def mix_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: float = CAP) -> DataFrame:
    """Per document: key, size, source_size, target, copies and taken, the words that the mix takes of it."""
    units = documents.select(F.col(key), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    mixed = mix(units, [key], cap)
    return mixed.select(key, "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def mixed_rows(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cap: float = CAP) -> DataFrame:
    """The documents themselves, each as often as the mix takes it. Rows alike in key, text and source are one unit here,
    which is taken or left as a whole."""
    k1, k2, n = fresh(documents, "__k1", "__k2", "copies")
    marked = documents.withColumns({k1: F.xxhash64(key, text, source), k2: F.xxhash64(F.lit(7), text, key, source)})
    rows = marked.select(F.col(k1).alias("__k1"), F.col(k2).alias("__k2"), F.col(source).alias("source"), n_words(F.col(text)).alias("__size"))
    units = rows.groupBy("__k1", "__k2", "source").agg(F.sum("__size").alias("size"))
    copies = mix(units, ["__k1", "__k2"], cap).filter("copies > 0").select("__k1", "__k2", "copies").toDF(k1, k2, n)
    each = marked.join(copies, [k1, k2])
    every = each.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))))
    return every.select(*(F.col(f"`{c}`") for c in documents.columns))
