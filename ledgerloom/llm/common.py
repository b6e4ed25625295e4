"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import shipping

#: Fixed character classes of the operators' contracts (as regular expressions).
WORD_WS = r"[^\x20\x09-\x0D]+"
WORD_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z to a-z, nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Lower-cases A-Z and blanks out every other ASCII byte that is no letter or digit: then bytes.split() gives the matches of WORD_ALNUM.
PLAIN_BYTES = bytes(b if 48 <= b <= 57 or b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of an Arrow batch on its way to Python.
BATCH_BYTES = "8m"


def ship(spark: SparkSession) -> None:
    """Make the package importable on the executors; where the session does not bound Arrow batches by bytes itself, bound them.

    The bound is one and the same for all operators and changes no result, so frames may run in any order.
    """
    shipping.ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def pieces(batches: Iterable[pa.RecordBatch], most: int = 1 << 20, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches with at most ``most`` bytes of text and ``rows`` rows (a longer text is alone).

    Spark bounds the batches themselves (see ``ship``); what Python builds from a batch is many times
    larger, so tasks work on slices.
    """
    for b in batches:
        size = np.zeros(len(b), np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
            elif pa.types.is_nested(c.type):
                size += c.nbytes // max(1, len(b))
        upto, at = np.cumsum(size), 0
        while at < len(b):
            end = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right"))
            end = min(max(end, at + 1), at + rows, len(b))
            yield b.slice(at, end - at)
            at = end


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only a local session may do without the setting."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    made = sc._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_staged: dict[str, tuple] = {}


def _delete(path: str) -> None:
    jvm, conf = _staged.pop(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _delete_all() -> None:
    """Tables behind results that were handed out may be read until the driver ends."""
    for path in list(_staged):
        try:
            _delete(path)
        except Exception:  # the JVM has gone
            return


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage and survives lost executors.

    What ``unstage`` has not deleted before is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    _staged[path] = sc._jvm, sc._jsc.hadoopConfiguration()
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._ledgerloom_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete what ``stage`` wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_ledgerloom_path", None)
        if path in _staged:
            _delete(path)


def broadcast_if(df: DataFrame, rows: int, most: int = 100_000) -> DataFrame:
    """A broadcast hint where the known row count is within ``most``; else Spark's own choice of join."""
    return F.broadcast(df) if rows <= most else df


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of an undirected graph, as (node, root), root the smallest node.

    ``edges`` has columns a and b of one orderable type. Alternates the large-star
    and small-star steps until the edge set no longer changes; every step is a
    grouped minimum and one join, so no component is ever gathered in one place.
    Self loops are ignored, nodes without an edge are absent, no edges give no rows.
    """
    e = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    mark = lambda d: tuple(d.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    seen = mark(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = stage(small.distinct(), name)
        now = mark(new)
        unstage(e)
        e = new
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
