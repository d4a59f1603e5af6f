"""An extra beyond batch work: the same lookups over files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def each_batch(spark: SparkSession, folder: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to the Parquet files of a folder that are new since the last run; results are appended to ``out``."""
    source = spark.readStream.schema(schema).parquet(folder)
    return source.writeStream.foreachBatch(lambda df, _: work(df).write.mode("append").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
