"""Language identification of web pages by Bayesian evidence fusion.

Evidence of a page: its text (letter 3-grams, a multinomial model with add-one smoothing, tempered to ``EFFECTIVE`` grams,
as neighbouring grams aren't independent), the language that its markup declares, the suffix of its address and its
host. How much a declared language tells is counted from all pages: the share of each declaration among the pages whose
text says each language. Host priors are smoothed hierarchically: all pages, then the suffix's, then the host's, each
level worth ``STRENGTH`` pages of the one above it; all are grouped aggregations over narrow rows, so a host with a third
of all pages is pre-aggregated. The posterior is the normalised product.

The text model is fitted on at most ``FIT_ROWS`` different labelled texts a language (the ones with the smallest hashes);
all pages are scored and counted.

Edge cases: null or empty pages and addresses have no evidence of that kind and get the prior's language; a page without
letters has no text_lang (null) and counts for no language in priors and shares; declarations of
unknown languages are one kind of their own; repeated rows get the same answer; without pages or without labelled
documents there are no rows; columns other than those named aren't read.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import map_texts, written

FIT_ROWS = 2000
#: Languages that the model tells apart at most, the most frequent ones: a label column may hold anything.
LANGUAGES = 500
BUCKETS = 1 << 14
EFFECTIVE = 40.0
STRENGTH = 20.0

_HIDING = re.compile(r"<(?:(script|style|nav|head)\b|!--)", re.I)
_ENDS = {x: re.compile(rf"</{x}\s*>", re.I).search for x in ("script", "style", "nav", "head")}
_TAG = re.compile(r"<[^<>]*>")
_LETTERS = re.compile(r"[^\W\d_]+")


def visible(page: str | None) -> str:
    """The text of a page without markup, scripts, styles, head, navigation and comments. One scan forward: an element that isn't
    closed hides nothing, and isn't looked for again."""
    page = page or ""
    out, at, open_ = [], 0, set()
    for m in iter(lambda: _HIDING.search(page, at), None):
        kind = (m[1] or "").lower()
        end = None
        if kind not in open_:
            if kind:
                end = found.end() if (found := _ENDS[kind](page, m.end())) else None
            elif (found := page.find("-->", m.end())) >= 0:
                end = found + 3
            if end is None:
                open_.add(kind)
        out.append(page[at : m.start() if end else m.end()])
        at = end or m.end()
    out.append(page[at:])
    return markup.unescape(_TAG.sub(" ", " ".join(out)))


def gram_counts(text: str) -> np.ndarray:
    """Counts of the letter 3-grams of a text, by bucket."""
    words = " ".join(_LETTERS.findall(text.lower()))
    if not words:
        return np.zeros(BUCKETS)
    c = np.frombuffer(f" {words} ".encode("utf-32-le"), "<u4").astype(np.uint64)
    h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x27D4EB2F165667C5)
    return np.bincount((h >> np.uint64(50)).astype(np.int64), minlength=BUCKETS).astype(float)


def fit(documents: DataFrame, lang: str = "lang", text: str = "text", rows: int = FIT_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages and log-likelihoods (language, bucket): BUCKETS numbers a language come to the driver. The LANGUAGES languages with the
    most different texts are told apart; rarer ones aren't learnt."""
    known = documents.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    keys = written(known.select("lang", "h").distinct(), "langid-texts")
    sizes = keys.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    # only hashes low enough to be among the first reach the window, about 2 * rows a language whatever its size
    low = keys.join(F.broadcast(sizes), "lang").filter((F.col("h") / F.lit(2.0**64) + 0.5) * F.col("n") <= 2 * rows)
    picked = low.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("r") <= rows).select("lang", "h")
    sample = known.join(F.broadcast(picked), ["lang", "h"]).dropDuplicates(["lang", "h"])  # rows * languages keys at most

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                total[name] = total.get(name, 0) + gram_counts(t)
        for name, c in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * BUCKETS), pa.array(range(BUCKETS), pa.int64()), pa.array(c)], names=["lang", "bucket", "n"])

    found = sample.mapInArrow(count, "lang string, bucket long, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(found["lang"].unique())
    table = np.ones((len(names), BUCKETS))
    for i, name in enumerate(names):
        part = found[found["lang"] == name]
        table[i, part["bucket"].to_numpy()] += part["n"].to_numpy()
    return names, np.log(table / table.sum(axis=1, keepdims=True))


def text_scores(df: DataFrame, keep: list[str], text: str, names: list[str], table: np.ndarray, is_page: bool = True) -> DataFrame:
    """``keep`` and ``ll``: tempered log-likelihoods of the text, one a language."""

    held = df.sparkSession.sparkContext.broadcast(table)

    def start() -> Callable[[list], dict[str, list]]:
        def one(t: str | None) -> list[float]:
            c = gram_counts(visible(t) if is_page else t or "")
            return (held.value @ c * (min(1.0, EFFECTIVE / n) if (n := c.sum()) else 0.0)).tolist()

        return lambda texts: {"ll": [one(t) for t in texts]}

    return map_texts(df, keep, text, start, {"ll": "array<double>"}, arrow={"ll": pa.list_(pa.float64())})


def _argmax(values: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), F.array_position(values, F.array_max(values)).cast("int"))


def identify(pages: DataFrame, names: list[str], table: np.ndarray, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: key, lang, probability, text_lang, declared, suffix. Without languages there are no rows."""
    if not names:
        nothing = {"lang": "string", "probability": "double", "text_lang": "string", "declared": "string", "suffix": "string"}
        return pages.filter(F.lit(False)).select(key, *(F.lit(None).cast(t).alias(c) for c, t in nothing.items()))
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    declared = F.lower(F.regexp_extract(F.coalesce(F.col(html), F.lit("")), r"(?i)<html\b[^<>]*\blang\s*=\s*[\"']?([a-zA-Z]{2,3})", 1))
    rows = pages.select(F.col(key), F.col(html).alias("__html"), host.alias("host"), declared.alias("declared"))
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))
    rows = rows.withColumn("declared", F.when(F.col("declared") == "", "").when(F.col("declared").isin(names), F.col("declared")).otherwise("other"))
    rows = written(text_scores(rows, [key, "host", "suffix", "declared"], "__html", names, table).withColumn("text_lang", F.when(F.array_min("ll") < 0, _argmax(F.col("ll"), names))), "langid")
    tally = [F.count_if(F.col("text_lang") == x).cast("double").alias(f"n{i}") for i, x in enumerate(names)]
    ns = F.array(*(f"n{i}" for i in range(len(names))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    smooth = lambda up, c: F.zip_with(c, up, lambda n, p: (n + STRENGTH * p) / (total(c) + STRENGTH))
    per_host = written(rows.groupBy("host", "suffix").agg(*tally).select("host", "suffix", ns.alias("c")), "langid-hosts")
    add = [F.sum(F.element_at("c", i + 1)).alias(f"n{i}") for i in range(len(names))]
    everywhere = per_host.agg(*add).select(F.coalesce(ns, F.array(*(F.lit(0.0) for _ in names))).alias("all"))
    level = everywhere.first()["all"]
    flat = F.array(*(F.lit((x or 0.0) / max(sum(y or 0.0 for y in level), 1.0) * 0.99 + 0.01 / len(names)) for x in level))
    by_suffix = per_host.groupBy("suffix").agg(*add).select("suffix", smooth(flat, ns).alias("up"))
    priors = per_host.join(by_suffix, "suffix").select("host", smooth(F.col("up"), F.col("c")).alias("prior"))
    # for each declaration, its share among the pages of each language
    said = rows.filter("declared <> ''").groupBy("declared").agg(*tally).select("declared", ns.alias("d"))
    of_lang = rows.filter("declared <> ''").agg(*tally).select(ns.alias("of")).first()["of"]
    shares = said.select("declared", F.zip_with("d", F.array(*(F.lit(float(x)) for x in of_lang)), lambda d, n: (d + 1.0) / (n + 2.0 + len(names))).alias("share"))
    joined = rows.join(priors, "host").join(shares, "declared", "left")
    none = F.array(*(F.lit(1.0) for _ in names))
    score = F.zip_with(F.col("ll"), F.zip_with("prior", F.coalesce("share", none), lambda p, s: F.ln(p) + F.ln(s)), lambda a, b: a + b)
    out = joined.withColumn("score", score).withColumn("lang", _argmax(F.col("score"), names))
    weight = F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("score")))
    return out.select(key, "lang", F.round(1 / weight, 6).alias("probability"), "text_lang", "declared", "suffix")
