"""Streams: extensions beyond the batch operators, from growing folders of Parquet files.

Batch admission treats every micro-batch of files as one load: rules and identities are evaluated by the batch operators
inside ``foreachBatch``, with output folders named by the batch id, so a replayed batch overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from granaria.operators.rules import codes, manifest_rules


def event_stream(spark: SparkSession, folder: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, end, event_type, n, total) over tumbling or sliding windows of ``ts``; later rows than ``late`` are dropped.

    Works on streams and on tables.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    marked = e.withWatermark("ts", late) if e.isStreaming else e
    return marked.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "w.end", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): runs of a user's events with no pause longer than ``gap``."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    marked = e.withWatermark("ts", late) if e.isStreaming else e
    return marked.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", "w.start", "w.end", "n")


def admit_stream(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes valid rows to ``out/rows`` and broken rules to ``out/problems``, one folder for each batch. A row is judged by
    itself: another row with its path, or a null path, changes nothing."""

    def admit(batch: DataFrame, number: int) -> None:
        flagged = batch.withColumn("_codes", codes(manifest_rules(allow_unsplit=True))).persist()
        flagged.select("path", F.explode("_codes").alias("code")).write.mode("overwrite").parquet(f"{out}/problems/batch={number}")
        flagged.where(F.size("_codes") == 0).drop("_codes").write.mode("overwrite").parquet(f"{out}/rows/batch={number}")
        flagged.unpersist()

    return rows.writeStream.foreachBatch(admit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
