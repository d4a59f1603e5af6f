"""Benchmark decontamination by winnowing.

Texts have A-Z lower-cased and are cut into words of digits, letters and whatever lies beyond ASCII. Of each window of ``SPAN``
words the smallest of its hashes of ``K`` consecutive words is the window's fingerprint. Equal
windows have equal fingerprints, so no shared span of ``SPAN`` words or more is missed. An item of fewer words is one window,
whose only fingerprint is the hash of all its words; texts are searched for each length that such items have.

A bitmap of ``BITS`` bits, whatever the benchmark's size, holds the fingerprints of all items. A text's fingerprints are looked up
in it where the text is read, and only what is found goes on: a hit is extended to the windows it is the fingerprint of,
each told by a 128-bit digest of its words, and fingerprint and digest together meet the distinct windows of the items in
an equi-join. A window of the benchmark is one row there however many items hold it, so a common phrase multiplies nothing;
items are looked up once for each distinct set of windows, not once a document. Texts and words are never shuffled.

Edge cases: null and empty texts have no words; items without words and items with a null id or text: the former occur
nowhere, the latter's windows count as hits but name no item; items of equal id count once; repeated documents each
have their row; an empty benchmark hits nothing; an empty table gives no rows; other columns aren't read, whatever
their names. A text of any length is searched whole, in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import map_texts, written

#: Words of a window, and of a hash. A window has SPAN - K + 1 hashes.
SPAN = 10
K = 5
#: The logarithm of the bitmap's bits: 8 MB.
BITS = 26
#: Bytes of text that are searched at a time.
BATCH_BYTES = 500_000

_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_POWERS = np.cumprod(np.full(1024, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
_LISTS = {"at": "array<int>", "n": "array<int>", "fp": "array<long>", "w1": "array<long>", "w2": "array<long>"}
_ARROW = {c: pa.list_(pa.int32() if t == "array<int>" else pa.int64()) for c, t in _LISTS.items()}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts side by side: ``text`` is the text of each word, ``hashes`` a hash of it, ``counts`` the words
    of each text."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode().lower() for t in texts]
        flat = np.frombuffer(b" ".join([*raw, b""]), np.uint8)  # ends in a space
        word = _WORD[flat]
        edges = np.flatnonzero(np.diff(word, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        self.lengths = ends - starts
        first = np.cumsum([0, *(len(r) + 1 for r in raw)])
        self.text = np.searchsorted(first, starts, "right") - 1
        self.counts = np.bincount(self.text, minlength=len(texts))
        before = np.cumsum(self.lengths) - self.lengths
        place = np.arange(int(self.lengths.sum())) - np.repeat(before, self.lengths)
        values = (flat[word].astype(np.uint64) + np.uint64(1)) * _POWERS[place & 1023]
        self.hashes = _mixed(np.add.reduceat(values, before)) if len(before) else np.zeros(0, np.uint64)
        # the words with one space after each, so that a window is a slice
        word[ends] = True
        joined = flat[word]
        self.starts = before + np.arange(len(before))
        joined[self.starts + self.lengths] = 0x20
        self.joined = joined.tobytes()

    def grams(self, k: int) -> np.ndarray:
        """A hash of the ``k`` words from each word on; the last ones run over the end of a text."""
        n = max(0, len(self.hashes) - k + 1)
        out = np.full(n, k, np.uint64)
        for i in range(k):
            out = out * np.uint64(0x9FB21C651E98DF25) + self.hashes[i : i + n]
        return _mixed(out)

    def inside(self, k: int) -> np.ndarray:
        """The places from which ``k`` words belong to one text."""
        n = max(0, len(self.text) - k + 1)
        return np.flatnonzero(self.text[:n] == self.text[k - 1 : k - 1 + n])

    def winnowed(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of all windows of ``SPAN`` words and their fingerprints, the least hash of each."""
        at, grams = self.inside(SPAN), self.grams(K)
        least = grams[at]
        for i in range(1, SPAN - K + 1):
            least = np.minimum(least, grams[at + i])
        return at, least

    def digests(self, at: np.ndarray, n: int) -> list[np.ndarray]:
        from xxhash import xxh3_128_intdigest

        last = at + n - 1
        cut = zip(self.starts[at].tolist(), (self.starts[last] + self.lengths[last]).tolist(), strict=True)
        found = [xxh3_128_intdigest(self.joined[a:b]) for a, b in cut]
        return [np.array([x >> s & 0xFFFFFFFFFFFFFFFF for x in found], np.uint64).view(np.int64) for s in (0, 64)]


def _known(fps: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    low = fps & np.uint64((1 << BITS) - 1)
    return (bitmap[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _found(words: Words, runs: list[tuple[int, np.ndarray, np.ndarray]]) -> dict[str, list]:
    """Lists for each text of its windows: place in the text, number of words, fingerprint and digest."""
    at = np.concatenate([x for _, x, _ in runs])
    n = np.concatenate([np.full(len(x), k, np.int32) for k, x, _ in runs])
    fp = np.concatenate([x for _, _, x in runs]).view(np.int64)
    w1, w2 = (np.concatenate(x) for x in zip(*(words.digests(x, k) for k, x, _ in runs), strict=True))
    text = words.text[at]
    first = np.cumsum(words.counts) - words.counts
    columns = {"at": (at - first[text]).astype(np.int32), "n": n, "fp": fp, "w1": w1, "w2": w2}
    order = np.argsort(text, kind="stable")
    cuts = np.cumsum(np.bincount(text, minlength=len(words.counts)))[:-1]
    return {"n_words": words.counts, **{c: np.split(x[order], cuts) for c, x in columns.items()}}


def item_windows(texts: list[str | None]) -> dict[str, list]:
    """All windows of items: those of ``SPAN`` words, or the whole item."""
    words = Words(texts)
    runs = [(SPAN, *words.winnowed())]
    for k in range(1, SPAN):
        at = words.inside(k)
        at = at[words.counts[words.text[at]] == k]
        runs.append((k, at, words.grams(k)[at]))
    return _found(words, runs)


def text_windows(texts: list[str | None], bitmap: np.ndarray, short: list[int]) -> dict[str, list]:
    """The windows of texts whose fingerprints the bitmap knows: those of ``SPAN`` words and of each length in ``short``."""
    words = Words(texts)
    runs = []
    for k, at, fp in [(SPAN, *words.winnowed()), *((k, x := words.inside(k), words.grams(k)[x]) for k in short)]:
        known = _known(fp, bitmap)
        runs.append((k, at[known], fp[known]))
    return _found(words, runs)


def _mapped(df: DataFrame, keep: list[str], text: str, fn: Callable[[], Callable[[list], dict[str, list]]]) -> DataFrame:
    return map_texts(df, keep, text, fn, {"n_words": "long", **_LISTS}, BATCH_BYTES, _ARROW)


def fingerprint_bitmap(windows: DataFrame) -> np.ndarray:
    """The bitmap of the fingerprints ``fp``: 2 ** (BITS - 15) rows of 4 KB at most come to the driver."""
    low = F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    parts = windows.groupBy(F.call_function("bitmap_bucket_number", low).alias("b")).agg(F.call_function("bitmap_construct_agg", F.call_function("bitmap_bit_position", low)).alias("bits"))
    out = np.zeros((1 << (BITS - 15), 4096), np.uint8)
    for b, bits in parts.collect():
        out[b - 1] = np.frombuffer(bits, np.uint8)
    return out.ravel()


def contaminated(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key``, n_words, n_hit (words inside an occurrence of a window of an item), n_items and
    items_sha256 (of the items' ids, sorted as strings and joined by commas), contaminated, and ``spans``: first words and ends of
    the stretches that are hit, in order."""
    spark = docs.sparkSession
    known = items.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{item_text}`").alias("text"))
    lists = F.explode(F.arrays_zip(*_LISTS)).alias("x")
    found = _mapped(known, ["item"], "text", lambda: item_windows).select("item", lists).select("item", "x.n", "x.fp", "x.w1", "x.w2")
    by_item = written(found.distinct(), "leak-items")
    windows = by_item.groupBy("fp", "w1", "w2", "n").agg(F.count(F.lit(1)).alias("__n"))
    windows = written(windows.select("fp", "w1", "w2", "n", F.monotonically_increasing_id().alias("window")), "leak-windows")
    bitmap = spark.sparkContext.broadcast(fingerprint_bitmap(windows))
    short = sorted(r[0] for r in windows.filter(F.col("n") < SPAN).select("n").distinct().collect())  # nine at most

    def start() -> Callable[[list], dict[str, list]]:
        return lambda texts: text_windows(texts, bitmap.value, short)

    rows = _mapped(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), ["key"], "text", start)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "leak-texts")
    hits = rows.select("row", lists).select("row", "x.at", "x.n", "x.fp", "x.w1", "x.w2")
    hits = hits.join(windows, ["fp", "w1", "w2", "n"]).select("row", F.struct("at", (F.col("at") + F.col("n")).alias("end")).alias("span"), "window")
    # windows of a row are put in order; a stretch begins where no window before reaches. A row holds no more windows than words
    in_order = Window.partitionBy("row").orderBy("span")
    upto = F.max("span.end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("begins", F.coalesce(F.col("span.at") > upto, F.lit(True)).cast("int"))
    hits = hits.withColumn("stretch", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    stretches = hits.groupBy("row", "stretch").agg(F.struct(F.min("span.at").alias("at"), F.max("span.end").alias("end")).alias("span"), F.collect_set("window").alias("w"))
    per_row = stretches.groupBy("row").agg(F.sort_array(F.collect_list("span")).alias("spans"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("w")))).alias("w"))
    per_row = written(per_row.withColumn("set", F.sha2(F.array_join(F.col("w").cast("array<string>"), ","), 256)), "leak-rows")
    names = by_item.join(windows, ["fp", "w1", "w2", "n"]).filter("item is not null").select("window", "item")
    sets = per_row.select("set", "w").dropDuplicates(["set"]).select("set", F.explode("w").alias("window"))
    sets = sets.join(names, "window").groupBy("set").agg(F.sort_array(F.collect_set("item")).alias("items"))
    told = per_row.join(sets, "set", "left").select("row", "spans", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("digest"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["at"])
    all_rows = rows.select("row", "key", "n_words").join(told, "row", "left")
    return all_rows.select(
        F.col("key").alias(key),
        "n_words",
        F.coalesce(n_hit, F.lit(0)).alias("n_hit"),
        F.greatest(F.coalesce("n_items", F.lit(0)), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("digest", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
        F.coalesce("spans", F.array().cast("array<struct<at:int,end:int>>")).alias("spans"),
    )

