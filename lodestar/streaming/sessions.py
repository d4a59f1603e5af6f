"""Sessions by event time: the same declaration over a table and over a stream with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def sessions(events: DataFrame, by: str, time: str, value: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Per session of a key (rows no more than ``gap`` apart): its first and last instant, rows and sum of values. ``late``: how long after the
    newest row a stream waits for older ones; its state is the open sessions only. Rows without a time are in none."""
    kind = dict(events.dtypes)[time]
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if late else rows
    found = rows.filter(F.col(time).isNotNull()).groupBy(F.session_window(time, gap).alias("w"), by)
    ended = F.col("w.end") - F.expr(f"interval {gap}")
    return found.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(by, F.col("w.start").cast(kind).alias("first"), ended.cast(kind).alias("last"), "n", "total")


def stream_sessions(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, by: str, time: str, value: str, gap: str = "30 minutes", late: str = "1 day", files: int = 1) -> tuple[StreamingQuery, int]:
    """Append to ``out`` the sessions that end in the files of a folder that are new since the last run, and tell how many rows came too
    late for theirs. What is open stays in the checkpoint."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
    query = sessions(source, by, time, value, gap, late).writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query, sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
