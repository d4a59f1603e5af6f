"""Quality rules with adaptive thresholds, in built-in functions only.

Per document: words, their characters, symbols, repeated lines and repeated 3-word windows. Fixed rules (``base_failed``) go
first: under 50 words, or over half the words in repeated windows. The rest is judged against its own kind: for each
language and source, mergeable quantile sketches of three rates (symbols a word, repeated lines a line, words in
repeated windows a word) and of the mean word length are built with partial aggregation. A document is rejected if a value
lies beyond a Tukey fence of its group, more than ``SPREADS`` interquartile ranges outside the quartiles. Rates are mostly
0, so quartiles are those of the values above 0. Where quartiles tell no scale (they coincide, or less than ``LEAST_SHARE``
of the rows are above 0), the fence is the group's quantile ``TOP`` of all rows, zeros counted (for the word length also
the one at the other end). All quantiles are shrunk to the language's, and these to the corpus's, worth ``PRIOR`` rows each, so no
fence is a constant: scaling a measure scales its fence. One symbol, one repeated line or one window that stands twice
rejects no document (``ONCE``).

A sketch is a histogram on a logarithmic scale: counts of the values between powers of ``GAMMA``, so a quantile is exact
in rank and within (GAMMA - 1) / (GAMMA + 1) of its value. Sketches of a language are the sums of its sources', those of the
corpus of its languages'. Counts
merge in any order to the same numbers, so reruns, other partitions and lost executors change no verdict. A sketch has some
thousand bins a decade at most and holds any number of rows, and counts are summed before the shuffle, so a source with a
third of all rows costs no task more than its share. The thresholds are one row a group and meet the documents in a join.

Edge cases: null texts have no words and fail; null languages and sources are groups of their own; repeated rows are
judged alike; an empty table gives no rows; columns other than key, text, lang and source aren't read. ``judge`` writes the
measures before anything filters on them: a filter pushed into ``features`` would compute the windows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import SPACE, fresh, written

MIN_WORDS = 50
SPREADS = 3.0
#: Bins of the sketches grow by this factor: quantiles are within 0.05 % of their value.
GAMMA = 1.001
#: Rows that the quantiles of the language count in a group's, and those of the corpus in a language's.
PRIOR = 100
#: Where fewer rows than this share have a measure at all, quartiles of the others tell no scale.
LEAST_SHARE = 0.1
#: Rows out of a hundred inside the fence of such a measure; one row may always be outside.
TOP = 99
#: measure -> whether there is a fence below too
MEASURES = {"symbol_rate": False, "dup_line_rate": False, "repeat_rate": False, "word_length": True}
#: What a rate counts, and how much of it comes of a single occurrence.
ONCE = {"symbol_rate": ("n_symbols", 1), "dup_line_rate": ("n_dup_lines", 1), "repeat_rate": ("n_repeat_words", 6)}


def features(df: DataFrame, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ("lang", "source"), n: int = 3) -> DataFrame:
    """key, ``keep`` and the measures of each row's text. Words in repeated n-word windows are counted in one sort: a window is
    a long, the high bits of its hash before its place, so equal windows stand side by side. Places take the fewest bits
    that hold them; the hash keeps 54 of its 64 bits in a text of 1,000 words. Words are compared too, so the count is exact."""
    df = df.select(F.col(key), *keep, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    df = df.withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    df = df.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))))
    df = df.select(
        key,
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        "__w",
        F.length(F.bin(F.size("__w").cast("long"))).alias("__bits"),
    )
    place = lambda i: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.xxhash64(*(F.get("__w", i + k) for k in range(n))), F.col("__bits")), F.col("__bits")).bitwiseOR(i.cast("long"))
    last = F.size("__w") - n
    df = df.withColumn("__o", F.when(last > 0, F.sort_array(F.transform(F.sequence(F.lit(0), last), place))).otherwise(F.array().cast("array<long>")))
    twin = lambda a, b: F.call_function("shiftrightunsigned", a.bitwiseXOR(b), F.col("__bits")) == 0
    df = df.withColumn("__twins", F.filter("__o", lambda x, i: ((i > 0) & twin(x, F.get("__o", F.greatest(i - 1, F.lit(0))))) | twin(x, F.get("__o", i + 1))))
    spot = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__bits")) - 1).cast("int")
    # neighbours of equal bits and other words, as very long texts may have: then the windows themselves are compared
    words = lambda x: F.array(*(F.get("__w", spot(x) + k) for k in range(n)))
    false = F.filter("__twins", lambda x, i: (i > 0) & twin(x, F.get("__twins", F.greatest(i - 1, F.lit(0)))) & (words(x) != words(F.get("__twins", F.greatest(i - 1, F.lit(0))))))
    window = lambda x: F.struct(words(x).alias("w"), spot(x).alias("i"))
    same = lambda x, y: F.coalesce(x["w"] == y["w"], F.lit(False))
    slow = F.array_sort(F.transform("__twins", window))
    true = F.flatten(F.transform(F.array(slow), lambda s: F.transform(F.filter(s, lambda x, i: ((i > 0) & same(x, F.get(s, F.greatest(i - 1, F.lit(0))))) | same(x, F.get(s, i + 1))), lambda x: x["i"])))
    at = F.when(F.size(false) > 0, true).otherwise(F.transform("__twins", spot))
    covered = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(*(i + k for k in range(n))))))
    return df.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("__w", "__o", "__bits", "__twins")


def _measures() -> dict[str, Column]:
    def rate(a: str, b: str) -> Column:
        return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))

    return {"symbol_rate": rate("n_symbols", "n_words"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"), "word_length": rate("word_chars", "n_words")}


def sketches(rows: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Per group and measure ``__m``: how many rows ``__n`` have a value in each bin ``__b`` (null: 0)."""
    place = lambda m: F.when(F.col(m) > 0, F.ceil(F.ln(m) / F.lit(math.log(GAMMA))).cast("int"))
    values = F.array(*(F.struct(F.lit(m).alias("__m"), place(m).alias("__b")) for m in MEASURES))
    return rows.select(*by, F.inline(values)).groupBy(*by, "__m", "__b").agg(F.count(F.lit(1)).alias("__n"))


def _quartiles(bins: DataFrame, by: tuple[str, ...], tag: str) -> DataFrame:
    """Per group: its size and, for each measure, how many values above 0 it has, their quartiles (1, 3), and the low and high
    quantiles of all values (0, 4), as the outer edge of their bin."""
    above = F.when(F.col("__b").isNotNull(), F.col("__n"))
    group = Window.partitionBy(*by, "__m")  # the bins of one sketch
    upto = lambda n: F.sum(n).over(group.orderBy("__b"))
    bins = bins.withColumns({"__above": above, "__upto": upto(above), "__all": F.sum(above).over(group), "__rank": upto(F.col("__n")), "__rows": F.sum("__n").over(group)})
    of = lambda m, x: F.when(F.col("__m") == m, x)
    # null bins come first and have reached no count
    middle = lambda b: F.pow(F.lit(GAMMA), b) * (2 / (1 + GAMMA))
    quartile = lambda m, i: middle(F.min(of(m, F.when(4 * F.col("__upto") >= i * F.col("__all"), F.col("__b")))))
    reached = {0: 100 * F.col("__rank") > (100 - TOP) * F.col("__rows") + 100, 4: 100 * F.col("__rank") > TOP * F.col("__rows") - 100}
    end = lambda m, i: F.min(of(m, F.when(reached[i], F.coalesce(F.pow(F.lit(GAMMA), F.col("__b") - int(i == 0)), F.lit(0.0)))))
    found = {f"{tag}_n_{m}": F.coalesce(F.sum(of(m, F.col("__above"))), F.lit(0)) for m in MEASURES}
    found |= {f"{tag}_{m}_{i}": quartile(m, i) for m in MEASURES for i in (1, 3)}
    found |= {f"{tag}_{m}_{i}": end(m, i) for m in MEASURES for i in (0, 4)}
    return bins.groupBy(*by).agg(F.coalesce(F.sum(of("word_length", F.col("__n"))), F.lit(0)).alias(f"{tag}_n"), *(x.alias(c) for c, x in found.items()))


def _shrunk(m: str, i: int, *tags: str) -> Column:
    """A quantile of the first of ``tags`` (from the smallest group to the corpus), shrunk to that of the next, and so on."""
    own = F.col(f"{tags[0]}_{m}_{i}")
    if len(tags) == 1:
        return own
    n, wider = F.col(f"{tags[0]}_n_{m}" if i in (1, 3) else f"{tags[0]}_n"), _shrunk(m, i, *tags[1:])
    return F.coalesce((n * own + PRIOR * wider) / (n + PRIOR), wider)


def thresholds(rows: DataFrame, by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """Per group: the fences of each measure, from merged quantile sketches of the rows that the fixed rules let pass, and
    whether they are told by quartiles (else by the quantiles of all rows)."""
    bins = written(sketches(rows, by), "quality-sketches")
    add = lambda d, *c: d.groupBy(*c, "__m", "__b").agg(F.sum("__n").alias("__n"))
    wide = add(bins, by[0])
    groups, langs, corpus = _quartiles(bins, by, "g"), _quartiles(wide, by[:1], "l").withColumnRenamed(by[0], "__wide"), _quartiles(add(wide), (), "c")
    both = groups.join(langs, groups[by[0]].eqNullSafe(F.col("__wide"))).crossJoin(F.broadcast(corpus))  # the corpus is one row
    fences = []
    for m in MEASURES:
        low, q1, q3, high = (_shrunk(m, i, "g", "l", "c") for i in (0, 1, 3, 4))
        share = (F.col(f"g_n_{m}") + PRIOR * F.col(f"l_n_{m}") / F.col("l_n")) / (F.col("g_n") + PRIOR)
        scaled = F.coalesce((q3 > q1) & (share >= LEAST_SHARE), F.lit(False))
        fences += [F.when(scaled, q1 - SPREADS * (q3 - q1)).otherwise(low).alias(f"{m}_low"), F.when(scaled, q3 + SPREADS * (q3 - q1)).otherwise(high).alias(f"{m}_high"), scaled.alias(f"{m}_scaled")]
    return both.select(*by, *fences)


def judge(df: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source"), extra: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, the measures, base_failed, and kept: not base_failed and inside all fences of its group."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = features(df, key, text, (*by, *extra)).withColumn("base_failed", failed)
    rows = written(rows.withColumns(_measures()), "quality")
    fences = thresholds(rows.filter(~F.col("base_failed")), by)
    fences = fences.select(*(F.col(c).alias(f"__{c}") for c in by), *(c for c in fences.columns if c not in by))
    same = [rows[c].eqNullSafe(F.col(f"__{c}")) for c in by]
    inside = F.lit(True)
    for m, below in MEASURES.items():
        good = F.coalesce(F.col(m) <= F.col(f"{m}_high"), F.lit(True))
        if m in ONCE:
            good = good | (F.col(ONCE[m][0]) <= ONCE[m][1])
        if below:
            good = good & F.coalesce(F.col(m) >= F.col(f"{m}_low"), F.lit(True))
        inside = inside & good
    kept = ~F.col("base_failed") & inside
    return rows.join(fences, same, "left").select(key, *extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


def passing(df: DataFrame, key: str = "doc_id", text: str = "text", by: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns, whatever their names."""
    k1, k2 = fresh(df, "__k1", "__k2")
    marked = df.withColumns({k1: F.xxhash64(key, text, *by), k2: F.xxhash64(F.lit(7), text, key, *by)})
    good = judge(marked, key, text, by, (k1, k2)).filter("kept").select(k1, k2).distinct()
    return marked.join(good, [k1, k2], "left_semi").select(*(F.col(f"`{c}`") for c in df.columns))
