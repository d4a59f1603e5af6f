"""Sinks: hash index, embeddings, caches that are replaced as a whole, dictionaries, reports, run metrics."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions.vectors import unit


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def require(spark: SparkSession, paths: Iterable[str]) -> None:
    """Raises FileNotFoundError that names all paths that aren't there; any file system that Spark reads."""
    missing = [x for x in paths if not (lambda p, fs: fs.exists(p))(*_file_system(spark, x))]
    if missing:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")


def write_hash_index(df: DataFrame, path: str) -> None:
    """card_idx, side, phash, dhash, frame_class as Parquet, a folder a side."""
    columns = {"card_idx": "long", "phash": "long", "dhash": "long", "frame_class": "tinyint"}
    df.select("side", *(F.col(c).cast(t).alias(c) for c, t in columns.items())).write.partitionBy("side").parquet(path)


def read_hash_index(spark: SparkSession, path: str, side: str) -> DataFrame:
    """The rows of a side; ``frame_class`` is null where an index was written without it."""
    df = spark.read.parquet(path).filter(F.col("side") == side)
    if missing := {"card_idx", "phash", "dhash"} - set(df.columns):
        raise ValueError(f"the index lacks {sorted(missing)}")
    return df if "frame_class" in df.columns else df.withColumn("frame_class", F.lit(None).cast("tinyint"))


def write_embeddings(df: DataFrame, path: str, vector: str = "embedding") -> None:
    """Vectors of length 1 in single precision."""
    df.withColumn(vector, unit(F.col(vector)).cast("array<float>")).write.parquet(path)


def replace(df: DataFrame, path: str) -> None:
    """Write ``df`` as the table at ``path`` in place of what is there, which ``df`` may read: to a new folder first, then the old one is put aside,
    the new one renamed and the old one deleted. If writing or renaming fails, the old table stays; if the driver is lost in between, it
    stands beside the path."""
    spark, new = df.sparkSession, f"{path}-{uuid.uuid4().hex}"
    df.write.parquet(new)
    (old, fs), (made, _), (aside, _) = (_file_system(spark, x) for x in (path, new, f"{new}-old"))
    had = fs.exists(old)
    if had and not fs.rename(old, aside):
        raise OSError(f"{path} couldn't be put aside")
    if not fs.rename(made, old):
        if had:
            fs.rename(aside, old)
        raise OSError(f"{new} couldn't be renamed to {path}")
    if had:
        fs.delete(aside, True)


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; null fields are kept, so that they differ from absent ones."""
    df.write.option("ignoreNullFields", "false").json(path)


def nested(cells: DataFrame, samples: DataFrame, by: list[str], n: int = 20) -> DataFrame:
    """A row for each cell of a report: ``by``, ``result`` (its other columns) and ``samples``, its first ``n`` sample rows by their columns' order."""
    rest = [c for c in samples.columns if c not in by]
    first = samples.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(F.struct(*rest)))).filter(F.col("__r") <= n)
    few = first.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("samples"))
    result = F.struct(*(c for c in cells.columns if c not in by)).alias("result")
    none = F.array().cast(few.schema["samples"].dataType)
    return cells.select(*by, result).join(few, by, "left").select(*by, "result", F.coalesce("samples", none).alias("samples"))


def summary(detections: DataFrame, weights: str, threshold: float) -> DataFrame:
    """One row for a table of file, detected, best_conf: weights, total, detected, detection_rate, conf_threshold; zeros where it is
    empty."""
    found, total = F.count_if("detected"), F.count(F.lit(1))
    rate = F.coalesce(found / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("detection_rate")
    return detections.agg(total.alias("total"), found.alias("detected"), rate).select(F.lit(weights).alias("weights"), "total", "detected", "detection_rate", F.lit(threshold).alias("conf_threshold"))


def log_metrics(df: DataFrame, path: str, run_id: str, step: Column, metrics: list[str]) -> None:
    """Append run_id, step, metric, value for each row and each of ``metrics``; values that are null aren't logged."""
    rows = df.select(F.lit(run_id).alias("run_id"), step.cast("long").alias("step"), F.explode(F.create_map(*(x for m in metrics for x in (F.lit(m), F.col(m).cast("double"))))).alias("metric", "value"))
    rows.filter("value is not null").write.mode("append").parquet(path)
