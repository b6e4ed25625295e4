"""Receipts of jobs as a stream with state: in whatever order and however often they arrive, only the newest one counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ingest


def acknowledged(receipts: DataFrame, keys: list[str]) -> DataFrame:
    """Job states (keys, state, last_response_id, attempts) of distinct receipts; works on streams (in update mode: the states that change) and on tables.

    Two kinds of state: the ids that were counted, dealt by id, so a job with most of the receipts is no hot key in it; and one row
    for each job, the newest receipt by (fetched_at, event_id) and the count. A delayed receipt raises the count and never undoes a newer one, so
    every order and every cut into batches ends in what the batch plan gives. No id expires, as a receipt may come again at any time;
    receipts without a time or id are left out.
    """
    said = receipts.where("fetched_at is not null and event_id is not null").select(*keys, "fetched_at", "event_id", "outcome", "response_id")
    return ingest.acknowledged_state(said.dropDuplicates(["event_id"]), keys)


def acknowledge_stream(receipts: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Writes the changed job states of each micro-batch to ``out`` under its number, so a batch that is run again overwrites itself; see ``job_states``."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return acknowledged(receipts, keys).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_states(written: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each job out of what ``acknowledge_stream`` has written; attempts rise with every change."""
    return written.groupBy(*keys).agg(F.max_by(F.struct("state", "last_response_id", "attempts"), "attempts").alias("_s")).select(*keys, "_s.*")
