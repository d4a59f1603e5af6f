"""Evaluation reports: cubes, histograms, accuracies, running best, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def report(df: DataFrame, by: list[str], hits: dict[str, Column], value: str) -> DataFrame:
    """Count, per cent of rows for which each of ``hits`` holds and the mean of ``value``, for each cell, each row and column, and
    overall; empty cells have no row."""
    shares = [F.round(100.0 * F.count_if(hit) / F.count(F.lit(1)), 4).cast("double").alias(name) for name, hit in hits.items()]
    return df.cube(*by).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), *shares, F.round(F.coalesce(F.avg(value), F.lit(0.0)), 4).alias("mean_value"))


def lists(df: DataFrame, by: list[str], value: str, out: str, most: int = 1_000_000) -> DataFrame:
    """The sorted values of each group as an array, for groups of ``most`` values at most: a first pass counts them, and a larger group is
    an error (``sampling.numbered`` has no such limit)."""
    largest = df.groupBy(*by).agg(F.count(value).alias("n")).agg(F.max("n")).first()[0]
    if (largest or 0) > most:
        raise ValueError(f"a group has {largest} values, more than {most}")
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(value)).alias(out))


def total(timings: Column) -> Column:
    """The sum of a map's values; null ones count 0."""
    return F.aggregate(F.map_values(timings), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def status(pct: Column) -> Column:
    return F.when(pct > 80, "OK").when(pct > 0, "PARTIAL").otherwise("MISSING")


def histogram(df: DataFrame, by: list[str], column: str) -> DataFrame:
    return df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))


def first_samples(df: DataFrame, by: list[str], order: str, n: int = 2) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(order))).filter(F.col("place") <= n)


def running_best(df: DataFrame, order: str, value: str) -> DataFrame:
    """``improved``: the value beats all before it. ``df`` has a row a step (it is an aggregate already)."""
    before = F.max(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("best_before", before).withColumn("improved", before.isNull() | (F.col(value) > before))


def verdict(ours: Column, theirs: Column, points: float = 1.0) -> Column:
    return F.when(ours - theirs > points, "ahead").when(theirs - ours > points, "behind").otherwise("level")


def confusion(df: DataFrame, truth: str, guess: str) -> DataFrame:
    """Rows of each pair of true and guessed class, with the pair's share of its true class; on the diagonal, the class's
    accuracy."""
    pairs = df.groupBy(truth, guess).agg(F.count(F.lit(1)).alias("n"))
    return pairs.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(truth)), 6))


def histogram_map(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """A JSON object a group, ``{"value": count}`` in the order of values; the column has few distinct values."""
    counts = histogram(df, by, column)
    entries = F.array_sort(F.collect_list(F.struct(F.col(column).cast("string").alias("k"), F.col("n"))))
    return counts.groupBy(*by).agg(F.to_json(F.map_from_entries(entries)).alias("counts"))
