"""Streams with state against the batch plans, in any order, split and restarted."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ingest
from ledgerloom.streaming import receipts

SCHEMA = "account string, operation string, fetched_at string, event_id string, outcome string, response_id string"


@pytest.mark.parametrize("seed", [0])
def test_receipts_in_any_order(spark, tmp_path, seed):
    draw = random.Random(seed)
    rows = [(draw.choice("ab"), draw.choice(["x", "y"]), f"2026-01-0{draw.randint(1, 9)}", f"e{i}", draw.choice(["done", "retry", "unavailable"]), f"r{i}") for i in range(60)]
    rows += [("a", "x", None, "n", "done", "r"), ("b", "x", "2026-01-01", None, "done", "r")]
    sent = rows + draw.sample(rows, 25)  # some come twice
    draw.shuffle(sent)
    where, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(2):  # a stop and a start from the checkpoint
        half = sent[k::2]
        for i in range(0, len(half), 20):
            spark.createDataFrame(half[i : i + 20], SCHEMA).coalesce(1).write.mode("append").json(where)
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(where)
        q = receipts.acknowledge_stream(stream, ["account", "operation"], out, str(tmp_path / "checkpoint"))
        assert q.awaitTermination(240) and q.exception() is None
    got = receipts.job_states(spark.read.parquet(out), ["account", "operation"])
    want = ingest.acknowledged_state(spark.createDataFrame(rows, SCHEMA).where("fetched_at is not null and event_id is not null"), ["account", "operation"])
    assert {tuple(r) for r in got.select("account", "operation", "state", "last_response_id", "attempts").collect()} == {tuple(r) for r in want.select("account", "operation", "state", "last_response_id", "attempts").collect()}
    assert spark.read.parquet(out).agg(F.countDistinct("batch")).first()[0] > 2
