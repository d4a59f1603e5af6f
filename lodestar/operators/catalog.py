"""Catalog work: frame rules, alternative art, profiles, cache upkeep, lookups, fuzzy titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: layouts that the first rule calls special
SPECIAL_LAYOUTS = ["split", "flip", "saga", "class", "planar", "scheme", "leveler", "meld", "adventure", "mutate", "prototype", "case", "battle", "transform", "modal_dfc", "reversible_card", "double_faced_token", "art_series", "host", "augment"]
# fixed values: plain layouts, and the effects that mean a full or an alternative art
PLAIN_LAYOUTS = ["normal", "token", "emblem"]
FULL_EFFECTS = ["showcase", "extendedart"]
ALT_EFFECTS = ["extendedart", "showcase", "inverted", "etched", "fullart", "colorshifted"]


def has_any(values: Column, names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(values, F.array(*map(F.lit, names))), F.lit(False))


def frame_class(from_image: Column | None = None) -> Column:
    """special, fullart or modern: the first rule that fits; ``from_image`` decides what metadata leave open."""
    full = F.col("full_art").eqNullSafe(True) | F.col("border_color").eqNullSafe("borderless") | has_any(F.col("frame_effects"), FULL_EFFECTS)
    rule = F.when(F.col("layout").isin(SPECIAL_LAYOUTS), "special").when(full, "fullart").when(F.col("layout").isin(PLAIN_LAYOUTS), "modern")
    return rule.otherwise(F.coalesce(from_image if from_image is not None else F.lit(None), F.lit("modern")))


def is_alt_art() -> Column:
    return F.col("border_color").eqNullSafe("borderless") | F.col("full_art").eqNullSafe(True) | has_any(F.col("frame_effects"), ALT_EFFECTS)


def distribution(df: DataFrame, column: str, classes: list[str]) -> DataFrame:
    """Count and share of each class of a fixed list, zero where absent."""
    dimension = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{column} string, place int")
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(F.lit(1)).alias("total"))
    filled = dimension.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"), F.lit(1).alias("one"))
    return filled.join(total.withColumn("one", F.lit(1)), "one").select(column, "n", F.coalesce(F.round(100.0 * F.col("n") / F.nullif("total", F.lit(0)), 4), F.lit(0.0)).alias("pct"))


def refresh(cache: DataFrame, available: DataFrame, key: str, compute: Column, value: str) -> DataFrame:
    """The cache for what is available: kept where known, computed where not."""
    kept = cache.join(available, key, "left_semi").select(key, value, F.lit("kept").alias("origin"))
    new = available.join(cache, key, "left_anti").select(key, compute.alias(value), F.lit("computed").alias("origin"))
    return kept.unionByName(new)


def fuzzy_titles(titles: DataFrame, catalog: DataFrame, query: str, name: str, most: int = 2, cap: int = 20, key: str = "id") -> DataFrame:
    """For each title, the catalog rows of the closest names within ``most`` edits (up to ``cap`` by key). Names are blocked by
    pieces: a name with so few edits keeps one of ``most + 1`` equal pieces of the title, so an equi-join on pieces finds
    all candidates (an empty piece, of a title shorter than that, stands everywhere)."""
    names = catalog.select(F.lower(name).alias("__n")).distinct()
    pieces = most + 1
    t = titles.select(query, F.lower(query).alias("__t")).distinct()
    lengths = F.sequence(F.greatest(F.length("__t") - most, F.lit(0)), F.length("__t") + most)
    sized = t.select(query, "__t", F.explode(lengths).alias("__len"))
    seeds = sized.withColumn("__i", F.explode(F.array(*map(F.lit, range(pieces)))))
    piece = F.expr("case __i " + " ".join(f"when {i} then substring(__t, cast(floor(length(__t) * {i} / {pieces}) as int) + 1, cast(floor(length(__t) * {i + 1} / {pieces}) - floor(length(__t) * {i} / {pieces}) as int))" for i in range(pieces)) + " end")
    seeds = seeds.select(query, "__t", "__len", piece.alias("__piece"), F.length(piece).alias("__k"), F.expr("case __i " + " ".join(f"when {i} then cast(floor(length(__t) * {i} / {pieces}) as int)" for i in range(pieces)) + " end").alias("__at"))
    seeds = seeds.withColumn("__at", F.explode(F.sequence(F.greatest(F.col("__at") - most, F.lit(0)), F.col("__at") + most)))
    sizes = seeds.select("__k").distinct()
    sized_names = names.withColumn("__k", F.explode(F.sequence(F.lit(0), F.length("__n"))))
    grams = sized_names.join(sizes, "__k").withColumn("__at", F.explode(F.sequence(F.lit(0), F.length("__n") - F.col("__k")))).select("__n", F.length("__n").alias("__len"), "__k", "__at", F.expr("substring(__n, __at + 1, __k)").alias("__piece"))
    met = seeds.join(grams, ["__len", "__k", "__at", "__piece"]).select(query, "__t", "__n").distinct()
    near = met.withColumn("edits", F.levenshtein("__t", "__n", most)).filter("edits >= 0")
    best = near.groupBy(query).agg(F.min("edits").alias("edits"))
    closest = near.join(best, [query, "edits"])
    rows = catalog.select(F.col(key), F.lower(name).alias("__n"))
    found = closest.join(rows, "__n").withColumn("__r", F.row_number().over(Window.partitionBy(query).orderBy(key)))
    return found.filter(F.col("__r") <= cap).select(query, F.col("__n").alias("matched"), "edits", key)


def overwritten(value: Column, fields: Column, name: str) -> Column:
    """The field of a map where the map has it, even if null there; else ``value``."""
    return F.when(F.coalesce(F.map_contains_key(fields, name), F.lit(False)), F.element_at(fields, F.lit(name))).otherwise(value)


def top_values(df: DataFrame, fields: str, name: str, k: int) -> DataFrame:
    """The k most frequent values of a field of a map, ties by value (null last). ``<missing>`` where the map hasn't the field; a field that is there
    and null is a value of its own."""
    value = F.when(F.coalesce(F.map_contains_key(fields, name), F.lit(False)), F.element_at(fields, F.lit(name))).otherwise("<missing>")
    return df.groupBy(value.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def encoded(df: DataFrame, dictionary: DataFrame, column: str, label: str = "label") -> DataFrame:
    """Each row with its value's label from a dictionary; null where the dictionary hasn't the value."""
    return df.join(dictionary.select(column, label), column, "left")


def labelled(df: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Each row with its label's columns and ``warning``, which tells rows without a label."""
    joined = df.join(labels.withColumn("__has", F.lit(True)), key, "left")
    return joined.withColumn("warning", F.when(F.col("__has").isNull(), "label missing")).drop("__has")
