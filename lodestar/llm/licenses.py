"""License scans: exact phrases, and short notices found in spite of edits.

Texts have A-Z lower-cased and are cut into words (digits, letters and everything beyond ASCII). A phrase stands where its
words stand consecutively. A notice with up to ``errors`` edits stands near an exact seed: cut the notice into
``errors + 1`` pieces, and by the pigeonhole principle at least one piece is free of edits. So seeds are found by plain
substring search, and only the text around a seed goes to the regex library, whose bounded-error matching (inserted,
deleted and replaced characters) verifies it and reports the span. A span must begin and end at word borders.

Edge cases: null and empty texts have no words and no labels, null places and score 0. Overlapping places all count; places of
a notice with edits don't overlap each other. Rows alike get the same answer, null keys stay null, an empty table gives no
rows. Columns other than the key and the text aren't read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestar.llm.common import map_texts

# fixed values: the phrases and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices to be found with edits: text -> (label, most edits in bytes).
NOTICES = {
    "under the mit license": ("mit", 2),
    "apache license version 2": ("apache-2", 2),
    "licensed under cc by nc": ("cc-by-nc", 2),
    "creative commons attribution noncommercial": ("cc-by-nc", 4),
    "gnu general public license": ("gpl", 3),
    "mozilla public license": ("mpl", 2),
    "redistribution and use in source and binary forms": ("bsd", 4),
    "permission is hereby granted free of charge": ("mit", 4),
}
#: Bytes -> the same bytes in lower case, with a space for what belongs to no word.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def folded(text: str | None) -> tuple[bytes, int]:
    """The words of a text with a space before, between and after; their number."""
    words = (text or "").encode().translate(_FOLD).split()
    return b" " + b" ".join(words) + b" ", len(words)


def pieces(notice: bytes, errors: int) -> list[tuple[int, bytes]]:
    """``errors + 1`` pieces of a notice, each with its offset."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """The seeds and verifiers of all notices, made once in a worker."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, int]]):
        import ahocorasick
        import regex

        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices = []
        seeds: dict[str, list[tuple[int, int]]] = {}
        for k, (notice, (label, errors)) in enumerate(notices.items()):
            raw = notice.encode()
            # word borders are part of the match, so a seed at an edge can't grow into other words
            self.notices.append((raw, label, errors, regex.compile(rb"(?b)(?<= )(?:" + regex.escape(raw) + rb"){e<=" + str(errors).encode() + rb"}(?= )")))
            for at, piece in pieces(raw, errors):
                seeds.setdefault(piece.decode("latin-1"), []).append((k, at))
        self.seeds = ahocorasick.Automaton()
        for piece, where in seeds.items():
            self.seeds.add_word(piece, (len(piece), where))
        self.seeds.make_automaton()

    def exact(self, line: bytes) -> list[tuple[int, int, str]]:
        """Byte spans and labels of the phrases; those that overlap too."""
        out = []
        for phrase, label in self.phrases:
            at = line.find(phrase)
            while at >= 0:
                out.append((at + 1, at + len(phrase) - 1, label))
                at = line.find(phrase, at + 1)
        return out

    def windows(self, line: bytes) -> dict[int, list[tuple[int, int]]]:
        """For each notice, the merged stretches of the text in which a seed lets it stand."""
        found: dict[int, list[tuple[int, int]]] = {}
        for end, (size, where) in self.seeds.iter(line.decode("latin-1")):
            for k, at in where:
                raw, _, errors, _ = self.notices[k]
                a = end - size + 1 - at - errors - 1
                found.setdefault(k, []).append((a, a + len(raw) + 2 * errors + 2))
        out: dict[int, list[tuple[int, int]]] = {}
        for k, stretches in found.items():
            merged = out[k] = []
            for a, b in sorted(stretches):  # a seed that ends later may begin its stretch earlier
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
        return out

    def fuzzy(self, line: bytes) -> list[tuple[int, int, str, float]]:
        """Byte spans, labels and similarities (1 less edits by length) of the notices with edits."""
        out = []
        for k, stretches in self.windows(line).items():
            raw, label, errors, pattern = self.notices[k]
            for a, b in stretches:
                for m in pattern.finditer(line, max(0, a), min(len(line), b)):
                    out.append((m.start(), m.end(), label, 1 - sum(m.fuzzy_counts) / len(raw)))
        return out


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Per row: key, n_words, n_base, first_word, last_word (of the phrases, in words from 0), base_labels, labels, score (of
    the best match, 0 without one) and spans: start and end in words (end excluded), label, similarity, exact."""
    phrases, notices = PHRASES if phrases is None else phrases, NOTICES if notices is None else notices

    def one(scanner: Scanner, value: str | None) -> tuple:
        line, n = folded(value)
        base = scanner.exact(line)
        near = scanner.fuzzy(line)
        if not base and not near:
            return n, 0, None, None, "", "", 0.0, []
        borders = [i for i, c in enumerate(line) if c == 32]
        word = lambda at: bisect_right(borders, at) - 1
        spans = [(word(a), word(b - 1) + 1, label, 1.0, True) for a, b, label in base]
        starts = [s[0] for s in spans]
        exact = {s[:3] for s in spans}
        spans += [x for a, b, label, like in near if (x := (word(a), word(b - 1) + 1, label, like, False))[:3] not in exact]
        named = sorted({label for _, _, label in base}), sorted({s[2] for s in spans})
        return n, len(base), min(starts, default=None), max(starts, default=None), ",".join(named[0]), ",".join(named[1]), max(s[3] for s in spans), sorted(spans)

    span = {"start": pa.int64(), "end": pa.int64(), "label": pa.string(), "similarity": pa.float64(), "exact": pa.bool_()}
    out = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "spans": "array<struct<start:long,end:long,label:string,similarity:double,exact:boolean>>"}

    def start() -> Callable[[list], dict[str, list]]:
        scanner = Scanner(phrases, notices)

        def run(texts: list) -> dict[str, list]:
            columns = [list(x) for x in zip(*(one(scanner, t) for t in texts), strict=True)]
            columns[-1] = [[dict(zip(span, s, strict=True)) for s in spans] for spans in columns[-1]]
            return dict(zip(out, columns, strict=True))

        return run

    return map_texts(df, [key], text, start, out, arrow={"spans": pa.list_(pa.struct(list(span.items())))})
