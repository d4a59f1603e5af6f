"""Byte-pair encoding and decoding with a segment tree over the ranks of adjacent pairs.

The tree's leaf i holds ``rank << 32 | i`` for the pair that starts at symbol i, its inner nodes the smaller of their
children. So the root is the leftmost pair of lowest rank; a merge changes three leaves, each in logarithmic time, and
encoding ends when the root holds no pair. A word of n symbols costs O(n log n), also a word of a megabyte.

Words repeat, so each Python worker keeps the encodings of about ``CACHED_WORDS`` strings between spaces, and the new words of a batch
are merged together: one tree a word, the trees of words of like length side by side in numpy arrays (``merge_many``);
words of over 256 bytes take the tree alone (``merge_all``). Normalisation and word
splitting follow the tokenizer file; text beyond U+017F is left to the tokenizers library's own normaliser and
splitter, for their Unicode tables to agree with it.

Edge cases: a null or empty text has no tokens and decodes to the empty text. Special tokens that stand in a text are
found first and become their ids. Extra columns pass through unless their names clash with the outputs, which win.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame

from lodestar.llm.common import map_texts

NONE = 1 << 62
#: Strings between white space whose encodings a Python worker keeps at a time, before a batch.
CACHED_WORDS = 250_000
#: Bytes of text for which one output batch is built.
BATCH_BYTES = 1_000_000
#: Beyond this, Unicode tables of different versions could differ; str.split() also splits at U+001C to U+001F.
BEYOND = re.compile("[^\u0000-\u001b\u0020-\u017f]")
#: U+0000 to U+017F by class, as the tokenizer's pattern sees them.
_LETTERS = "".join(c for c in map(chr, range(0x180)) if c.isalpha())
_NUMBERS = "".join(c for c in map(chr, range(0x180)) if c.isnumeric())
_SPACES = "\t\n\x0b\x0c\r \x85\xa0"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def merge_all(symbols: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Merge adjacent symbols, always the leftmost pair of lowest rank, until no pair of ``pairs`` is left."""
    n = len(symbols)
    if n < 2:
        return symbols
    width = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [NONE] * (2 * width)
    for i in range(n - 1):
        if found := pairs.get((symbols[i], symbols[i + 1])):
            tree[width + i] = found[0] << 32 | i
    for i in range(width - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += width
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            best = value if value < other else other
            i >>= 1
            if tree[i] == best:
                return
            tree[i] = value = best

    while (root := tree[1]) != NONE:
        i = root & 0xFFFFFFFF
        j = after[i]
        symbols[i] = pairs[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < width:
            put(j, NONE)
        if k < n:
            before[k] = i
            found = pairs.get((symbols[i], symbols[k]))
            put(i, found[0] << 32 | i if found else NONE)
        else:
            put(i, NONE)
        if (h := before[i]) >= 0:
            found = pairs.get((symbols[h], symbols[i]))
            put(h, found[0] << 32 | h if found else NONE)
    return [s for s in symbols if s >= 0]


def merge_many(symbols: np.ndarray, ranks: Callable, width: int) -> np.ndarray:
    """``merge_all`` for many words at a time. ``symbols``: a row a word, padded with -1 to ``width`` (a power of two, 256
    at most) and one more. ``ranks(a, b)`` has the ranks and the merged symbols of pairs, -1 where a pair has none.
    Changes ``symbols``: what is merged away is -1."""
    none, m = np.int32(0x7FFFFFFF), len(symbols)
    tree = np.full((m, 2 * width), none, np.int32)

    def leaf(i: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank, _ = ranks(left, right)
        return np.where(rank < 0, none, (rank << 8 | i).astype(np.int32))

    at = np.broadcast_to(np.arange(width), (m, width))
    tree[:, width:] = leaf(at.ravel(), symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(m, width)
    level = width
    while level > 1:
        np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
        level //= 2
    after = np.tile(np.arange(1, width + 2, dtype=np.int32), (m, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int32), (m, 1))
    rows = np.flatnonzero(tree[:, 1] != none)
    while len(rows):
        i = tree[rows, 1] & 255
        j = after[rows, i]
        k = np.minimum(after[rows, j], width)
        symbols[rows, i] = merged = ranks(symbols[rows, i], symbols[rows, j])[1]
        symbols[rows, j] = -1
        after[rows, i] = k
        before[rows, k] = i
        tree[rows, np.minimum(width + j, 2 * width - 1)] = none
        tree[rows, width + i] = leaf(i, merged, symbols[rows, k])
        h = before[rows, i]
        has = np.flatnonzero(h >= 0)
        tree[rows[has], width + h[has]] = leaf(h[has], symbols[rows[has], h[has]], merged[has])
        row = np.concatenate([rows, rows, rows[has]])
        node = np.concatenate([i, np.minimum(j, width - 1), h[has]]) + width
        for _ in range(width.bit_length() - 1):
            node >>= 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        rows = rows[tree[rows, 1] != none]
    return symbols


class Codec:
    """A tokenizer file of the tokenizers library: BPE over words with an end-of-word suffix."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, self.suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = s
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(merges)])}
        found = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.pairs.items())
        self.pair_keys, self.pair_ranks, self.pair_new = (np.array(x, np.int64) for x in zip(*found, strict=True))
        self.bytes = np.array([vocab.get(s, -1) for s in byte_symbols()], np.int64)
        self.last = np.array([vocab.get(s + self.suffix, -1) for s in byte_symbols()], np.int64)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        letters, numbers, spaces = (re.escape(x) for x in (_LETTERS, _NUMBERS, _SPACES))
        self.words = re.compile(f"[{letters}]+|'(?:s|t|re|ve|m|ll|d)|[{numbers}]|[^{spaces}{letters}{numbers}]+").findall
        self.to_bytes = {s: b for b, s in enumerate(byte_symbols())}
        self.ids: dict[str, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        known = (self.pair_keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.pair_ranks[at], -1), np.where(known, self.pair_new[at], -1)

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, by the library."""
        parts = self.lib.pre_tokenizer.pre_tokenize_str(self.lib.normalizer.normalize_str(text))
        return [bytes(self.to_bytes[c] for c in s).decode() for s, _ in parts]

    def merged(self, words: Iterable[str]) -> None:
        """Put the ids of distinct words in ``ids``."""
        out = self.ids
        by_width: dict[int, list[tuple[str, bytes]]] = {}
        for w in words:
            raw = w.encode()
            by_width.setdefault(8 if len(raw) <= 8 else 1 << (len(raw) - 1).bit_length(), []).append((w, raw))
        for width, group in by_width.items():
            if width > 256:
                for w, raw in group:
                    symbols = self.bytes[np.frombuffer(raw, np.uint8)]
                    symbols[-1] = self.last[raw[-1]]
                    out[w] = np.array(merge_all([s for s in symbols.tolist() if s >= 0], self.pairs), "<u4").tobytes()
                continue
            lengths = np.array([len(raw) for _, raw in group])
            symbols = np.full((len(group), width + 1), -1, np.int64)
            inside = np.arange(width + 1) < lengths[:, None]
            symbols[inside] = self.bytes[np.frombuffer(b"".join(raw for _, raw in group), np.uint8)]
            symbols[np.arange(len(group)), lengths - 1] = self.last[[raw[-1] for _, raw in group]]
            merge_many(symbols, self.ranks, width)
            kept = symbols >= 0
            flat, ends = symbols[kept].astype("<u4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
            out.update(zip([w for w, _ in group], [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))


    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers. What stands between white space is looked up as a
        whole in ``ids``; only what isn't there yet is split into words."""
        special = {s: struct.pack("<I", i) for s, i in self.special.items()}
        parts: list[list[bytes | list[str]]] = []
        odd: list[tuple[list, int, list[str]]] = []
        if len(self.ids) > CACHED_WORDS:
            self.ids.clear()
        for text in texts:
            got: list = []
            parts.append(got)
            for p in self.split_special.split(text) if text and "<|" in text else (text or "",):
                if p in special:
                    got.append(special[p])
                elif BEYOND.search(p):
                    odd.append((got, len(got), self.split(p)))
                    got.append(b"")
                else:
                    got.append(p.lower().split())
        new = {c for got in parts for p in got if isinstance(p, list) for c in p}.difference(self.ids)
        words = {c: self.words(c) for c in new if not c.isalpha()}
        new.difference_update(words)
        for ws in words.values():
            new.update(ws)
        for _, _, ws in odd:
            new.update(ws)
        self.merged(new.difference(self.ids))
        known = self.ids.__getitem__
        self.ids.update((c, b"".join(map(known, ws))) for c, ws in words.items())
        for got, i, ws in odd:
            got[i] = b"".join(map(known, ws))
        return [b"".join(p if isinstance(p, bytes) else b"".join(map(known, p)) for p in got) for got in parts]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, joined as the tokenizer file's (absent) decoder says: by spaces."""
        at = np.frombuffer(ids, "<u4")
        if len(at) and at.max() >= len(self.tokens):
            at = at[at < len(self.tokens)]
        return " ".join(map(self.tokens.__getitem__, at.tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of a file, made once in each Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode(df: DataFrame, path: str, text: str = "text", decoded: str | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit) and, if asked for, ``decoded``: a column for what the
    ids decode to; ``drop``: columns that the result needn't have. A map over rows: no shuffle, and a lost task is redone
    alone."""
    out = {"n_tokens": "long", "ids": "binary"} | ({decoded: "string"} if decoded else {})

    def start() -> Callable[[list], dict[str, list]]:
        c = codec(path)

        def run(texts: list) -> dict[str, list]:
            ids = c.encode(texts)
            return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids} | ({decoded: [c.decode(x) for x in ids]} if decoded else {})

        return run

    return map_texts(df, [c for c in df.columns if c not in (*out, *drop)], text, start, out, BATCH_BYTES)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text that ``ids`` (as ``encode`` writes them) decode to; null ids: the empty text. Unknown ids are left out,
    as the library does."""

    def start() -> Callable[[list], dict[str, list]]:
        c = codec(path)
        return lambda values: {out: [c.decode(x or b"") for x in values]}

    return map_texts(df, [c for c in df.columns if c != out], ids, start, {out: "string"}, BATCH_BYTES)
