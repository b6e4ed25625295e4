"""Streaming ingest of spooled envelopes, and event-time aggregates over change feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest
from ..schema import ENVELOPE


def spool_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """New envelope files of a folder."""
    return spark.readStream.schema(ENVELOPE).option("maxFilesPerTrigger", files_per_batch).option("multiLine", True).json(path)


def ingest_stream(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to <out>/bodies, responses and fetches, and what was refused to <out>/rejected with the reason; stops when the spool is read.

    Each micro-batch is anti-joined with what is stored, so a replayed spool or batch adds nothing.
    """

    def known(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
        try:
            return spark.read.schema(like.schema).parquet(path)
        except Exception as e:  # the first batch finds no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return like.limit(0)

    def step(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        good, bad = ingest.envelopes(batch)
        good = good.persist()
        for name, rows, keys in (
            ("bodies", ingest.bodies(good), ["sha256"]),
            ("responses", ingest.responses(good).drop("fetches"), ingest.RESPONSE_KEY),
            ("fetches", good.select("event_id", "fetched_at", *ingest.RESPONSE_KEY), ["event_id"]),
            ("rejected", bad, ["event_id", "reason"]),
        ):
            path = f"{out}/{name}"
            ingest.new_only(rows, known(spark, path, rows), keys).write.mode("append").parquet(path)
        good.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts in tumbling windows; works on streams (late rows dropped after ``late``) and on tables."""
    w = events.withWatermark(time, late) if events.isStreaming else events
    return w.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Session windows that close after a gap."""
    w = events.withWatermark(time, late) if events.isStreaming else events
    return w.groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")
