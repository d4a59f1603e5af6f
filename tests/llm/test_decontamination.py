"""Benchmark decontamination against a plain search."""

import hashlib
import re

import pytest

from lodestar.llm import contamination

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ITEMS = [
    (1, "One two three four five six seven eight nine ten eleven twelve."),
    (2, "alpha beta gamma"),
    (3, "three FOUR five six seven eight nine ten eleven twelve thirteen"),
    (4, "été"),
    (5, "x x x x x x x x x x x x"),
    (5, "alpha beta gamma"),
    (6, None),
    (7, "..."),
    (None, "no name here"),
    (10, "one, two; three four five six seven eight nine ten!"),
]
DOCS = [
    (0, "zero one two three four five six seven eight nine ten eleven twelve thirteen end"),
    (1, "one-two-three-four-five-six-seven-eight-nine"),
    (2, "Alpha beta, gamma; alpha BETA gamma delta. Été été"),
    (3, "x " * 40),
    (4, None),
    (5, ""),
    (6, "no name here, but others"),
    (7, "a b c d e f g"),
    (7, "a b c d e f g"),
    (None, "two three four five six seven eight nine ten eleven"),
    (8, "filler " * 30_000 + "one two three four five six seven eight nine ten " + "filler " * 30_000),
    (9, "alpha beta gamma" + "z" * 1_000_000),
]


def words(text):
    return WORDS.findall((text or "").encode().lower().decode())


def plain(docs, items):
    known = {}
    for item, text in items:
        ws = words(text)
        n = min(len(ws), contamination.SPAN)
        for i in range(len(ws) - n + 1) if n else ():
            known.setdefault(tuple(ws[i : i + n]), set()).add(item)
    out = []
    for key, text in docs:
        ws, hit, found = words(text), set(), set()
        for n in {len(k) for k in known}:
            for i in range(len(ws) - n + 1):
                if (w := tuple(ws[i : i + n])) in known:
                    hit.update(range(i, i + n))
                    found |= known[w]
        ids = sorted({str(x) for x in found if x is not None})
        edges = [x for x in sorted(hit) if x - 1 not in hit], [x + 1 for x in sorted(hit) if x + 1 not in hit]
        out.append((key, len(ws), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit), list(zip(*edges, strict=True))))
    return out


def joined(spans):
    """Stretches without the borders between those that touch."""
    out = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def ordered(rows):
    return sorted(rows, key=repr)


def found(spark, docs, items, extra=False):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    if extra:
        d = d.selectExpr("*", "1 as key", "2 as row", "3 as window", "4 as at", "'x' as item")
    rows = contamination.contaminated(d, spark.createDataFrame(items, "item_id long, text string"))
    return [(*r[:-1], joined([tuple(x) for x in r[-1]])) for r in map(tuple, rows.collect())]


@pytest.mark.parametrize("extra", [False, True])
def test_equals_plain_search(spark, extra):
    assert ordered(found(spark, DOCS, ITEMS, extra)) == ordered(plain(DOCS, ITEMS))


def test_every_shared_span_is_found(spark):
    """Spans of ten words or more at any place of either side, with others around them; nine aren't enough."""
    item = [f"w{i}" for i in range(60)]
    docs = []
    for n in (9, 10, 11, 17, 60):
        for at in range(0, 61 - n, 3):
            docs.append((len(docs), " ".join(["before"] * (at % 7) + item[at : at + n] + ["after"] * (at % 5))))
    got = found(spark, docs, [(1, " ".join(item))])
    assert ordered(got) == ordered(plain(docs, [(1, " ".join(item))]))
    assert {r[2] for r in got} == {0, 10, 11, 17, 60}


def test_empty_tables(spark):
    assert found(spark, [], ITEMS) == []
    assert {(r[2], r[3], r[5]) for r in found(spark, DOCS, [])} == {(0, 0, False)}


def test_a_common_window_is_one_row(spark):
    """A phrase that all items hold and all documents repeat: items are named once for each set of windows."""
    phrase = "which of these ten words is the one asked for"
    items = [(i, f"{phrase} number {i}") for i in range(300)]
    docs = [(i, f"{i} {phrase} {i}") for i in range(200)]
    assert ordered(found(spark, docs, items)) == ordered(plain(docs, items))
