"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

A text is taken as a space and itself, in UTF-8; each tokenizer's tokens are stretches of these bytes. Pandas' merge_asof,
keyed by stretch of text, looks up for each token start the token of the other side that covers it. Two tokens overlap just
if one of them covers the other's start, so both directions together are all overlaps. Bytes where tokens of both sides end cut the
text into groups.

Counts over the corpus: a text's links are kept as its distinct pairs of ids with how often each stands there, which are
summed by pair (in each task before the shuffle). A text needs the counts of its own pairs back. The ``BROADCAST`` most frequent
pairs, a fixed number however many there are, are broadcast, so no pair that stands everywhere is a hot key; rarer pairs are
joined. The highest count of an id is a table as long as the vocabulary.

Texts are aligned by chunks: neither tokenizer has a token that holds a space after another character, so a text may be
cut before each single space between two characters that aren't white space. Tokens of both sides end there, so links and groups lie
inside chunks, and a text's are those of its chunks, one after the other. Each Python worker aligns a new chunk once and keeps about
``CACHED`` of them, those met most. New chunks are encoded in runs, joined by spaces. Texts with characters beyond U+017F, where the tokenizers
may normalise across a cut, are taken whole, as is any text if a vocabulary has such a token.

Edge cases: null and empty texts, and texts whose tokens don't give back the space and the text (as when a tokenizer replaces
characters), have no tokens: counts of 0 and an empty hash. Strings of special tokens are plain text. Repeated rows each
count; an empty table gives no rows; other columns aren't read, whatever their names. A very long text is one row's work,
held in arrays of some 100 bytes a token.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.bpe import byte_symbols
from lodestar.llm.common import map_texts, written

#: Aligned chunks that a Python worker keeps, about; longer ones than so many characters aren't kept.
CACHED = 300_000
KEPT_LENGTH = 100
#: Chunks that are encoded at a time, joined by spaces.
RUN = 64
#: Bytes of text that are aligned at a time.
BATCH_BYTES = 500_000
#: Pairs of ids that are broadcast with their counts (32 bytes each): the most frequent ones.
BROADCAST = 500_000
#: A single space between characters that no version of Unicode takes for white space.
CUT = re.compile("(?<=[^\\s\u180e\u200b\ufeff]) (?=[^\\s\u180e\u200b\ufeff])")
BEYOND = re.compile("[^\u0001-\u017f]")
#: Chunks that may stand between single spaces: a text of them would be cut there.
SOLID = re.compile("[!-~\u00a1-\u017f](?:[\u0001-\u017f]*[!-~\u00a1-\u017f])?")


class Tokenizer:
    """Ids of chunks by a library, and the bytes of each id. A chunk stands for a space and itself."""

    def __init__(self, tokens: list[bytes], encode: Callable[[list[str]], list[list[int]]]):
        self.tokens, self.encode = tokens, encode
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.cuts = not any(re.search(r"\S ", t.decode(errors="replace")) for t in tokens)

    def whole(self, text: str, ids: Iterable[int]) -> bool:
        """Whether the tokens give back a space and the text."""
        return b"".join(map(self.tokens.__getitem__, ids)) == f" {text}".encode()

    def cut(self, chunks: list[str], ids: np.ndarray) -> np.ndarray | None:
        """How many of the ids each chunk has, if they give back the chunks and a token ends with each."""
        if not self.whole(" ".join(chunks), ids.tolist()):
            return None
        ends = np.cumsum(self.sizes[ids])
        wanted = np.cumsum([1 + (len(c) if c.isascii() else len(c.encode())) for c in chunks])
        at = np.searchsorted(ends, wanted)
        return np.diff(at, prepend=-1) if np.array_equal(ends[at], wanted) else None

    def ids(self, runs: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all chunks of runs, how many each chunk has, and whether they give it back. A run is encoded at once and its ids are
        cut where its chunks end; where that fails, its chunks are encoded alone."""
        chunks = [*chain.from_iterable(runs)]
        told = self.encode([" ".join(r) for r in runs])
        flat = np.fromiter(chain.from_iterable(told), np.int64)
        if (n := self.cut(chunks, flat)) is not None:
            return flat, n, np.ones(len(chunks), bool)
        parts = []
        for run, x in zip(runs, told, strict=True):
            ids = np.array(x, np.int64)
            if (n := self.cut(run, ids)) is not None:
                parts.append((ids, n, np.ones(len(run), bool)))
            else:
                parts.append(self.ids([[c] for c in run]) if len(run) > 1 else (ids, np.array([len(ids)]), np.zeros(1, bool)))
        return tuple(map(np.concatenate, zip(*parts, strict=True)))


def byte_level(path: str) -> Tokenizer:
    """A byte-level file of the tokenizers library."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer as Library

    lib = Library.from_file(path)
    lib.encode_special_tokens = True
    vocab = lib.get_vocab(with_added_tokens=True)
    to_byte = {s: b for b, s in enumerate(byte_symbols())}
    tokens = [b""] * (1 + max(vocab.values()))
    for s, i in vocab.items():
        tokens[i] = bytes(map(to_byte.__getitem__, s)) if all(c in to_byte for c in s) else s.encode()
    return Tokenizer(tokens, lambda chunks: [e.ids for e in lib.encode_batch_fast([f" {c}" for c in chunks], add_special_tokens=False)])


def pieces(path: str) -> Tokenizer:
    """A sentencepiece model, which puts the space before a text itself."""
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    byte = re.compile("<0x([0-9A-F]{2})>")
    names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
    tokens = [bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in names]
    return Tokenizer(tokens, lambda chunks: lib.encode(chunks, num_threads=1))


def _split(text: str | None, cuts: bool) -> list[str]:
    if not text:
        return []
    return [text] if not cuts or BEYOND.search(text) else CUT.split(text)


def _runs(chunks: list[str]) -> list[list[str]]:
    solid = [c for c in chunks if len(c) <= KEPT_LENGTH and SOLID.fullmatch(c)]
    return [*(solid[i : i + RUN] for i in range(0, len(solid), RUN)), *([c] for c in set(chunks).difference(solid))]


def tokens_of(texts: list[str | None], a: Tokenizer, b: Tokenizer) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids of both sides; none where either doesn't give back the text."""
    chunks = [_split(t, a.cuts and b.cuts) for t in texts]
    runs = _runs([*dict.fromkeys(chain.from_iterable(chunks))])
    names = [*chain.from_iterable(runs)]
    sides = []
    for side in (a, b):
        ids, n, good = side.ids(runs) if runs else (np.zeros(0, np.int64),) * 3
        sides.append((dict(zip(names, np.split(ids, np.cumsum(n)[:-1]), strict=False)), {c for c, ok in zip(names, good, strict=True) if not ok}))
    out: tuple[list, list] = [], []
    for text, cs in zip(texts, chunks, strict=True):
        both = [np.concatenate([np.zeros(0, np.int64), *map(ids.__getitem__, cs)]) for ids, _ in sides]
        fine = all(odd.isdisjoint(cs) or side.whole(text, x.tolist()) for side, (_, odd), x in zip((a, b), sides, both, strict=True))
        for to, x in zip(out, both, strict=True):
            to.append(x if fine else x[:0])
    return out


def _side(flat: np.ndarray, n: np.ndarray, sizes: np.ndarray, name: str) -> pd.DataFrame:
    """A row a token of texts of ``n`` tokens: its text's number, its id, its start among the bytes of all texts, its end, its place."""
    end = np.cumsum(sizes[flat])
    return pd.DataFrame({"doc": np.repeat(np.arange(len(n)), n), "at": end - sizes[flat], f"end_{name}": end, name: flat, f"i_{name}": np.arange(len(flat))})


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The places of all overlapping tokens, pair by pair: each token start finds the token of the other side that covers it; starts that
    both sides share are found from either side and counted once."""
    left = pd.merge_asof(a[["doc", "at", "i_a"]], b[["doc", "at", "i_b"]], on="at", by="doc")
    right = pd.merge_asof(b[["doc", "at", "i_b"]], a[["doc", "at", "i_a"]].rename(columns={"at": "at_a"}).assign(at=a["at"]), on="at", by="doc")
    right = right[right["at_a"] < right["at"]]
    return np.concatenate([left["i_a"], right["i_a"]]).astype(np.int64), np.concatenate([left["i_b"], right["i_b"]]).astype(np.int64)


@functools.cache
def _told(n: int) -> list[bytes]:
    """How each of ``n`` ids reads before a comma, a bar, a semicolon and at the end."""
    return [b"%d%s" % (i, mark) for i in range(n) for mark in (b",", b"|", b";", b"")]


def groups_of(a: pd.DataFrame, b: pd.DataFrame, n: int) -> tuple[np.ndarray, list[bytes]]:
    """For each of ``n`` texts, the number of its groups and their text ``a1,a2|b1;...``."""
    shared = np.intersect1d(a["end_a"], b["end_b"], assume_unique=True)
    side = np.repeat([0, 1], [len(a), len(b)])
    group = np.concatenate([np.searchsorted(shared, a["end_a"]), np.searchsorted(shared, b["end_b"])])
    doc = np.concatenate([a["doc"], b["doc"]])
    ids = np.concatenate([a["a"], b["b"]])
    order = np.lexsort((side, group))  # stable: tokens of a side stay in order
    side, group, doc, ids = side[order], group[order], doc[order], ids[order]
    after = np.full(len(ids), 3)  # what follows a token: a comma, a bar, a semicolon, nothing
    same = group[1:] == group[:-1]
    after[:-1] = np.where(same, side[1:] != side[:-1], np.where(doc[1:] == doc[:-1], 2, 3))
    text = list(map(_told(1 << int(ids.max()).bit_length()).__getitem__, (4 * ids + after).tolist())) if len(ids) else []
    cuts = np.cumsum(np.bincount(doc, minlength=n)).tolist()
    last = np.flatnonzero(np.diff(group, append=-1))
    return np.bincount(doc[last], minlength=n), [b"".join(text[x:y]) for x, y in zip([0, *cuts], cuts, strict=False)]


class Aligned:
    """Chunks that are aligned already. Under a chunk's number stand its numbers of tokens, groups and links, its groups' text, its links'
    pairs (id of a * size of b's vocabulary + id of b), whether its tokens don't give it back, and how often it was met."""

    def __init__(self, a: Tokenizer, b: Tokenizer):
        self.a, self.b = a, b
        self.known: dict[str, int] = {}
        self.told: list[bytes] = []
        self.counts = np.zeros((0, 4), np.int64)
        self.at = np.zeros(1, np.int64)  # where pairs of a chunk start
        self.pairs = np.zeros(0, np.int64)
        self.odd = np.zeros(0, bool)
        self.met = np.zeros(0, np.int64)

    def add(self, ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, odd: np.ndarray) -> None:
        """Align chunks of ``n_a`` and ``n_b`` tokens, under the next numbers."""
        n = len(odd)
        one, other = _side(ids_a, n_a, self.a.sizes, "a"), _side(ids_b, n_b, self.b.sizes, "b")
        i, j = overlaps(one, other)
        n_groups, told = groups_of(one, other, n)
        text = one["doc"].to_numpy()[i]
        pair = one["a"].to_numpy()[i] * len(self.b.tokens) + other["b"].to_numpy()[j]
        n_links = np.bincount(text, minlength=n)
        counts = [n_a, n_b, n_groups, n_links]
        self.told += told
        self.counts = np.concatenate([self.counts, np.stack(counts, axis=1)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(n_links)])
        self.pairs = np.concatenate([self.pairs, pair[np.argsort(text, kind="stable")]])
        self.odd = np.concatenate([self.odd, odd])
        self.met = np.concatenate([self.met, np.zeros(n, np.int64)])

    def learn(self, chunks: list[str]) -> None:
        if not chunks:
            return
        runs = _runs(chunks)
        (ids_a, n_a, good_a), (ids_b, n_b, good_b) = self.a.ids(runs), self.b.ids(runs)
        good = good_a & good_b
        self.known.update(zip(chain.from_iterable(runs), range(len(self.told), len(self.told) + len(chunks)), strict=True))
        self.add(ids_a[np.repeat(good, n_a)], n_a * good, ids_b[np.repeat(good, n_b)], n_b * good, ~good)

    def places(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of all pairs of chunks, one chunk after the other, and how many each has."""
        n = self.counts[numbers, 3]
        return np.repeat(self.at[numbers] - np.cumsum(n) + n, n) + np.arange(n.sum()), n

    def keep(self, numbers: np.ndarray, names: list[str]) -> None:
        """Forget all chunks but those."""
        where, n = self.places(numbers)
        self.known = dict(zip(names, range(len(names)), strict=True))
        self.told = [self.told[k] for k in numbers.tolist()]
        self.pairs, self.at = self.pairs[where], np.concatenate([[0], np.cumsum(n)])
        self.counts, self.odd, self.met = self.counts[numbers], self.odd[numbers], self.met[numbers]

    def tidy(self) -> None:
        """The half met most stays if there are too many."""
        if len(self.known) > CACHED:
            numbers = np.sort(np.argsort(-self.met, kind="stable")[: CACHED // 2])
            names = list(self.known)
            self.keep(numbers, [names[k] for k in numbers.tolist()])
            self.met //= 2

    def __call__(self, texts: list[str | None]) -> dict[str, list]:
        """Per text: numbers of tokens, groups and links, the groups' hash, and its distinct pairs with how often they stand in it."""
        self.tidy()
        chunks = [_split(t, self.a.cuts and self.b.cuts) for t in texts]
        new = set(chain.from_iterable(chunks)).difference(self.known)
        long = [c for c in new if len(c) > KEPT_LENGTH]
        self.learn([*new.difference(long)])
        kept = len(self.told)
        self.learn(long)
        numbers = [[*map(self.known.__getitem__, cs)] for cs in chunks]
        size = np.array([*map(len, numbers)], np.int64)
        if self.odd.any():  # whether a text with such a chunk is given back is told by the whole of it
            some = [k for k, x in enumerate(numbers) if len(x) > 1 and self.odd[x].any()]
            again = len(self.told)
            if some:
                sides = tokens_of([texts[k] for k in some], self.a, self.b)
                self.add(*(f(ids) for ids in sides for f in (np.concatenate, lambda ids: np.array([*map(len, ids)]))), np.zeros(len(some), bool))
            for k, number in zip(some, range(again, again + len(some)), strict=True):
                numbers[k], size[k] = [number], 1
        flat = np.fromiter(chain.from_iterable(numbers), np.int64)
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.counts[flat], axis=0)])
        totals = np.diff(totals[np.concatenate([[0], np.cumsum(size)])], axis=0)
        span = len(self.a.tokens) * len(self.b.tokens)
        where, _ = self.places(flat)
        key = np.sort(np.repeat(np.arange(len(texts)), totals[:, 3]) * span + self.pairs[where])
        first = np.flatnonzero(np.diff(key, prepend=-1))
        doc, pair = np.divmod(key[first], span)
        cuts = np.cumsum(np.bincount(doc, minlength=len(texts)))[:-1]
        told = [b";".join(map(self.told.__getitem__, x)) for x in numbers]
        self.met += np.bincount(flat, minlength=len(self.told))
        if len(self.told) > kept:  # whole texts aren't kept
            self.keep(np.arange(kept), [*self.known][:kept])
        return {
            "n_a": totals[:, 0],
            "n_b": totals[:, 1],
            "n_groups": totals[:, 2],
            "n_links": totals[:, 3],
            "groups_sha256": [hashlib.sha256(g).hexdigest() if g else "" for g in told],
            "pair": np.split(pair, cuts),
            "times": np.split(np.diff(first, append=len(key)), cuts),
        }


_loaded: dict[tuple, Aligned] = {}


def _aligned(a_path: str, b_path: str) -> Aligned:
    """Both tokenizers and the chunks met so far, one in each Python worker."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligned(byte_level(a_path), pieces(b_path))
    return _loaded[a_path, b_path]


def links(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``key`` and what ``Aligned`` tells. A map over rows."""
    out = {"n_a": "long", "n_b": "long", "n_groups": "long", "n_links": "long", "groups_sha256": "string", "pair": "array<long>", "times": "array<long>"}
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    arrow = {"pair": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}
    return map_texts(rows, ["key"], "text", lambda: _aligned(a_path, b_path), out, BATCH_BYTES, arrow)


def align(df: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text", broadcast: int = BROADCAST) -> DataFrame:
    """Per row: ``key``, n_a, n_b, n_groups, n_links, n_best (links whose pair's count over all rows is the highest that its
    b id has), count_sum (the sum of its links' counts), groups_sha256."""
    size_b = len(pieces(b_path).tokens)
    rows = written(links(df, a_path, b_path, key, text).withColumn("row", F.monotonically_increasing_id()), "align-rows")
    pairs = rows.select("row", F.explode(F.arrays_zip("pair", "times")).alias("x")).select("row", "x.pair", "x.times")
    counts = written(pairs.groupBy("pair").agg(F.sum("times").alias("count")), "align-counts")
    highest = counts.groupBy((F.col("pair") % size_b).alias("b")).agg(F.max("count").alias("most"))  # a row an id of b
    counts = counts.withColumn("b", F.col("pair") % size_b).join(F.broadcast(highest), "b")
    counts = written(counts.select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "align-counts")
    hot = counts.orderBy(F.desc("count"), "pair").limit(broadcast)
    known = pairs.join(F.broadcast(hot), "pair", "left")
    value = [F.sum(F.col("times") * F.col("count")).alias("s"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n")]
    frequent = known.filter("count is not null").groupBy("row").agg(*value)
    rare = known.filter("count is null").select("row", "pair", "times").join(counts, "pair").groupBy("row").agg(*value)
    sums = frequent.unionByName(rare).groupBy("row").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    found = rows.join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return found.select(F.col("key").alias(key), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n", zero).alias("n_best"), F.coalesce("s", zero).alias("count_sum"), "groups_sha256")
