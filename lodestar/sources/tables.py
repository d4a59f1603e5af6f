"""Sources and sinks: tables with required columns, catalogs, images, labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, required: Iterable[str] = ()) -> DataFrame:
    """A Parquet table; raises if a required column is missing."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    if missing := set(required) - set(df.columns):
        raise ValueError(f"{name} lacks {sorted(missing)}")
    return df


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of records, with its places as ``card_idx`` and each record's fields as a map, so that a missing field
    and a null one differ."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("card_idx", "record")).select("card_idx", F.from_json("record", "map<string,string>").alias("fields"))


def images(spark: SparkSession, path: str, extensions: Iterable[str] = ("jpg", "jpeg", "png", "webp", "bmp")) -> DataFrame:
    """Files of the given kinds: path, id (the name without extension), content."""
    ending = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    found = spark.read.format("binaryFile").load(path).filter(ending.isin([*extensions]))
    return found.select("path", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("id"), "content")


def images_of(found: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """``wanted`` with the path and the content of each row's image, null where there is none."""
    return wanted.join(found.select(F.col("id").alias(key), "path", "content"), key, "left")


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object file -> {corners_normalized: points} as rows of file and corners; a file without that field has null corners."""
    whole = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<corners_normalized:array<array<double>>>>")
    return whole.select(F.explode(entries).alias("file", "label")).select("file", F.col("label.corners_normalized").alias("corners"))


def cached(spark: SparkSession, path: str, column: str, values: Iterable[str]) -> DataFrame:
    """The rows of a Parquet table whose column is one of ``values``; the filter reaches the scan."""
    return spark.read.parquet(path).filter(F.col(column).isin([*values]))


def corner_labels(df: DataFrame, corners: str = "corners") -> DataFrame:
    """Oriented-box label lines, ``0 x1 y1 ... x4 y4`` with six places, from an array of 4 points."""
    points = F.array_join(F.transform(F.flatten(corners), lambda x: F.format_string("%.6f", x.cast("double"))), " ")
    return df.withColumn("value", F.concat(F.lit("0 "), points))


def read_corner_labels(spark: SparkSession, path: str) -> DataFrame:
    numbers = F.transform(F.slice(F.split("value", " "), 2, 8), lambda x: x.cast("double"))
    return spark.read.text(path).select(numbers.alias("corners"))
