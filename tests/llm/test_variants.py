"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestar.llm import variants


def edits(a, b):
    """Whether one inserted, deleted or replaced code point leads from a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    near = {w: [v for v in counts if edits(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 10 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out)


def told(spark, counts):
    return sorted(tuple(r) for r in variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect())


def test_all_pairs(spark):
    """Few letters, so that grams repeat, shift and overlap, and every word has many neighbours."""
    rng = random.Random(5)
    counts = {}
    for _ in range(150):
        w = "".join(rng.choices("abé", k=rng.randint(7, 11)))
        counts[w] = 10 ** rng.randint(0, 4)
        for _ in range(3):
            i, c = rng.randrange(len(w)), rng.choice("abé")
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            if len(v) >= 7:
                counts.setdefault(v, 10 ** rng.randint(0, 3))
    counts |= {"a" * n: n for n in range(7, 30)} | {"ab" * n: n for n in range(4, 9)} | {"b" + "a" * n: 100 for n in range(6, 12)}
    assert told(spark, counts) == plain(counts)


def test_chains_ties_and_long_words(spark):
    counts = {"abcdefgh": 10**6, "abcdefgx": 10**5, "abcdefyx": 10**4, "abcdzzyx": 1, "abcdzfyx": 1000, "lonelyword": 5, "tietietie": 1, "tietietia": 10, "tietietib": 10}
    counts |= {"q" * 600: 50, "q" * 599: 5, "q" * 300 + "r" + "q" * 300: 3, "p" * 200: 7, "p" * 201: 70, "p" * 202: 700, "p" * 100 + "r" + "p" * 100: 1}
    assert told(spark, counts) == plain(counts)
    assert dict((r[0], r[2]) for r in told(spark, counts))["abcdzzyx"] == "abcdefgh"


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(1)
    for _ in range(300):
        places = sorted(rng.sample(range(9), rng.choice([3, 4])))
        costs = [rng.randrange(5) for _ in range(9)]
        cost = lambda i, j: costs[i] * variants.LETTER**i + costs[j] * variants.LETTER ** (8 - j)  # noqa: E731, B023
        i, j = variants.pivots(places, costs, 10)
        assert j - i >= 2 and cost(i, j) == pytest.approx(min(cost(i, j) for i in places for j in places if j - i >= 2))


def test_counts(spark):
    docs = [(1, "Example example EXAMPLE short exämple, exämple"), (2, None), (3, ""), (None, "mistyped mistyped Mistyped ÉCLAIRS éclairs"), (1, "x" * 1_000_000 + " " + "x" * 1_000_000), (4, "seven77 example_s ×÷×÷×÷× ×÷×÷×÷×")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("word", "n", "key")})
    want: Counter = Counter()
    mistyped: Counter = Counter()
    for k, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.encode().lower().decode()
            want[w] += 1
            h = zlib.crc32(f"{'' if k is None else k}:{w}".encode())
            mistyped[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 3 == 0 else w] += 1
    kept = lambda c: {w: n for w, n in c.items() if len(w) >= 7 and n >= 2}
    assert dict(map(tuple, variants.word_counts(df).collect())) == kept(want)
    assert dict(map(tuple, variants.word_counts(df, every=3).collect())) == kept(mistyped)
    assert variants.word_counts(df.limit(0), every=3).collect() == []


def test_very_long_words(spark):
    n = 300_000
    assert [r[3:5] for r in told(spark, {"q" * n: 50, "q" * (n - 1): 5, "q" * 1000 + "r" + "q" * (n - 1001): 3, "r" * n: 1})] == [(5, 2), (50, 2), (3, 2), (1, 0)]


def test_empty_vocabulary(spark):
    assert told(spark, {"oneword": 3}) == [("oneword", None, "oneword", 3, 0, None)]
    assert variants.variants(spark.createDataFrame([], "word string, n long")).collect() == []
