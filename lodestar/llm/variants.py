"""Spelling variants by pivotal grams: words within one edit, and the frequent word that each rare one stands for.

A word's bigrams are ordered by how often they stand in the vocabulary, the rarest first (then by place); the first three are
its prefix. Of these, dynamic programming picks the two that don't overlap and are rarest together: the word's pivots. One
edit spoils one pivot at most, so of two words within one edit, the one whose prefix ends earlier in that order
has a pivot that stands in the other's prefix. Its place is limited too: an edit behind the first pivot leaves all
letters up to and with it as they are, an edit before that leaves all letters from the second pivot on. So a word asks for two
keys (its head up to the first pivot, its tail from the second one), for each length within one of its own, and is found under
a head and a tail for each gram of its prefix. Asking and being found is an equi-join on hashes of these; pairs that meet are
compared by bits that tell which letters stand in either an odd number of times, then verified by edit distance.

Bigrams count by one of 2 ** 16 numbers, so their frequencies are a table of bounded size in any alphabet; bigrams that
share a number count as equal, which costs a comparison and no result.

Words are counted in each task before they are shuffled, so a word that makes up a third of all text is a row a task. Chains of
forms are followed by doubling: a chain is no longer than the logarithm of the largest count, as counts grow along it.

Edge cases: null and empty texts have no words; a null key reads as the empty string where places are drawn by key; an empty
table gives no rows; repeated rows count each time; other columns aren't read, whatever their names. Words may be
of any length: one that is longer than ``LONG`` is compared in one walk.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import slices, written

#: Code points of the shortest words and how often they stand at least.
LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form stands so many times as often as its variant at least.
TIMES = 10
#: Numbers of bigrams.
GRAMS = 1 << 16
#: What part of the words that agree in a stretch of letters also agree in one more, about: weighs pivots.
LETTER = 0.3
#: Letters of the longest words whose edit distance is a built-in function, which takes time by the square of them.
LONG = 200
#: Distinct words that a task counts before it hands them on.
COUNTED = 300_000


def typed(word: str, prefix_crc: int, every: int) -> str:
    """``word`` without one of its letters, for one word of ``every``, by the crc of a prefix and the word."""
    h = zlib.crc32(word.encode(), prefix_crc)
    if h % every:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1 :]


def word_counts(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LETTERS, every: int | None = None) -> DataFrame:
    """``word``, ``n``: how often each maximal run of Latin letters (A-Z lower-cased) of ``least`` code points or more stands in all
    texts, for words that stand ``LEAST_COUNT`` times. ``every``: one in so many distinct words of a document is mistyped, by
    its crc."""
    runs = re.compile(f"[a-zÀ-ÿ]{{{least},}}")

    def told(counts: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for start, end in slices(batch.column(1), 1_000_000):
                for k, t in zip(keys[start:end], batch.column(1).slice(start, end - start).to_pylist(), strict=True):
                    found = Counter(runs.findall((t or "").encode().lower().decode()))
                    if not every:
                        counts.update(found)
                        continue
                    crc = zlib.crc32(f"{k or ''}:".encode())
                    for w, n in found.items():
                        if len(w := typed(w, crc, every)) >= least:
                            counts[w] += n
                if len(counts) > COUNTED:
                    yield told(counts)
                    counts.clear()
        yield told(counts)

    rows = df.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def gram_numbers(words: list[str]) -> list[np.ndarray]:
    """The numbers of each word's bigrams, in order."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    numbers = ((points[:-1] * np.uint64(0x9E3779B1) ^ points[1:] * np.uint64(0x85EBCA6B)) >> np.uint64(7)).astype(np.int64) % GRAMS
    ends = np.cumsum([len(w) for w in words])
    return [numbers[b - len(w) : b - 1] for w, b in zip(words, ends.tolist(), strict=True)]


def gram_counts(words: DataFrame) -> np.ndarray:
    """How often each number stands in the vocabulary: one row a number comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(GRAMS, np.int64)
        for batch in batches:
            for found in gram_numbers(batch.column(0).to_pylist()):
                np.add.at(counts, found, 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])

    out = np.zeros(GRAMS, np.int64)
    for gram, n in words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect():
        out[gram] = n
    return out


def prefix(ranks: list[int]) -> tuple[list[int], tuple[int, int]]:
    """The places of the three rarest grams of a word and the (rank, place) of the last of them. The gram at the next place
    joins them if it is the same one, as an edit may move the last one there."""
    first = nsmallest(3, zip(ranks, range(len(ranks)), strict=True))
    rank, place = first[-1]
    places = sorted(i for _, i in first)
    if place + 1 < len(ranks) and ranks[place + 1] == rank and place + 1 not in places:
        places = sorted([*places, place + 1])
    return places, (rank, place)


def pivots(places: list[int], costs: list[int], length: int) -> tuple[int, int]:
    """The two of ``places`` (in order, three at least) that don't overlap and cost least together: a gram costs as many words as hold it,
    less for each letter that its key holds besides. ``one`` is the cheapest single gram that ends before the place at hand,
    ``two`` the cheapest pair so far."""
    one: tuple[float, int] | None = None
    two: tuple[float, int, int] | None = None
    waiting: list[tuple[float, int]] = []
    for i in places:
        while waiting and waiting[0][1] + 2 <= i:
            one = min(filter(None, (one, waiting.pop(0))))
        if one:
            pair = (one[0] + costs[i] * LETTER ** min(length - 2 - i, 50), one[1], i)
            two = min(two, pair) if two else pair
        waiting.append((costs[i] * LETTER ** min(i, 50), i))
    return two[1], two[2]


def letters(words: list[str]) -> np.ndarray:
    """64 bits a word: which of its letters, by 64 numbers, stand in it an odd number of times. An edit changes two at most."""
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    bits = np.uint64(1) << (points * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
    ends = np.cumsum([len(w) for w in words])
    return np.bitwise_xor.reduceat(bits, np.concatenate([[0], ends[:-1]])).view(np.int64) if words else np.zeros(0, np.int64)


def keys(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """``key``, ``word``, ``letters``, ``last`` (where the prefix ends, as one number) and ``asks``: the keys that words are found under
    and those that they ask for. Keys are hashes of a head or a tail and of the length of the word that is found there."""
    # ranks are dense and don't depend on ties in the counts
    order = np.argsort(counts, kind="stable")
    rank = np.empty(GRAMS, np.int64)
    rank[order] = np.arange(GRAMS)
    sent = words.sparkSession.sparkContext.broadcast((rank, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        ranks, costs = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                part = batch.column(0).slice(start, 4096).to_pylist()
                found, asked, lasts = [], [], []
                many = []  # keys that each word is found under
                for w, numbers in zip(part, gram_numbers(part), strict=True):
                    places, (r, p) = prefix(ranks[numbers].tolist())
                    one, two = pivots(places, costs[numbers].tolist(), len(w))
                    for n in (len(w) - 1, len(w), len(w) + 1):
                        asked += (xxh64_intdigest(w[: one + 2], 2 * n), xxh64_intdigest(w[two:], 2 * n + 1))
                    for i in places:
                        found += (xxh64_intdigest(w[: i + 2], 2 * len(w)), xxh64_intdigest(w[i:], 2 * len(w) + 1))
                    many.append(2 * len(places))
                    lasts.append(r << 32 | p)
                at = np.repeat(np.arange(len(part)), 6), np.repeat(np.arange(len(part)), many)
                for asks, key, i in ((True, asked, at[0]), (False, found, at[1])):
                    columns = [pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(part, pa.string()).take(pa.array(i)), pa.array(letters(part)[i]), pa.array(np.array(lasts, np.int64)[i]), pa.repeat(asks, len(i))]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "letters", "last", "asks"])

    return words.select("word").mapInArrow(run, "key long, word string, letters long, last long, asks boolean")


def _one_edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of words that one edit parts: what follows the first difference is equal but for it."""

    def parted(a: str, b: str) -> bool:
        x, y = (np.frombuffer(w.encode("utf-32-le", "surrogatepass"), "<u4") for w in (a, b))
        n = min(len(x), len(y))
        other = np.flatnonzero(x[:n] != y[:n])
        i = int(other[0]) if len(other) else n
        return a != b and np.array_equal(x[i + (len(x) >= len(y)) :], y[i + (len(y) >= len(x)) :])

    for batch in batches:
        yield batch.filter(pa.array([parted(a, b) for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True)], pa.bool_()))


def near_pairs(words: DataFrame) -> DataFrame:
    """``u`` < ``v``: all pairs of distinct ``word``s (of four letters or more) that differ by one inserted, deleted or replaced code
    point, once each."""
    found = written(keys(words, gram_counts(words)), "variants-keys")
    ask, have = (found.filter(F.col("asks") == x).select("key", *(F.col(c).alias(f"{c}_{t}") for c in ("word", "letters", "last"))) for x, t in ((True, "a"), (False, "b")))
    near = (F.bit_count(F.col("letters_a").bitwiseXOR(F.col("letters_b"))) <= 2) & (F.col("last_a") <= F.col("last_b"))
    short = ask.filter(F.length("word_a") <= LONG).join(have, "key").filter(near).select("word_a", "word_b").filter(F.levenshtein("word_a", "word_b", 1) == 1)
    long = ask.filter(F.length("word_a") > LONG).join(have.filter(F.length("word_b") >= LONG), "key").filter(near).select("word_a", "word_b")
    met = short.union(long.mapInArrow(_one_edit, "word_a string, word_b string"))
    return met.select(F.least("word_a", "word_b").alias("u"), F.greatest("word_a", "word_b").alias("v")).distinct()


def variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """For each of ``words`` (word, n): ``form``, its near word of the largest n (ties to the smallest) if that is ``times`` its own n
    or more, ``root``, where forms of forms end, ``n_near`` and ``form_n``."""
    words = written(words.select("word", "n"), "variants-words")
    pairs = written(near_pairs(words), "variants-pairs")
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("other")).union(pairs.select("v", "u"))
    other = words.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    best = both.join(other, "other").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    form = F.when(-F.col("best.less") >= times * F.col("n"), F.col("best.other"))
    rows = words.join(best, "word", "left").select("word", "n", form.alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(form.isNotNull(), -F.col("best.less")).alias("form_n"))
    rows = written(rows, "variants-forms")
    ends = written(rows.filter("form is not null").select("word", F.col("form").alias("root")), "variants-roots")
    while True:  # each step doubles how far a root is from its word
        after = ends.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(ends.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "variants-roots")
        if step.filter("moved").isEmpty():
            break
        ends = step.select("word", "root")
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
