"""Size-bounded parts with a manifest, and versions of a table that readers can pin."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lossless, packing
from ..operators.cdc import cell_key
from .commits import CommitLog, Conflict


def write_parts(rows: DataFrame, order: str, size: Column, path: str, most: int = lossless.PART_BYTES) -> None:
    """Parts as full as ``most`` bytes allow below path/rows, ordered inside (a longer row is alone); the manifest of their ranges is written last.

    Small parts that follow one another share a file of about ``lossless.PART_BYTES``, so files grow with the bytes and not with the parts.
    """
    bundle = F.floor(F.col("part") / _bundled(most)).cast("long")
    binned = packing.pack(rows, order, size, most, external=most).drop("external").withColumn("bundle", bundle)
    binned.repartition("bundle").sortWithinPartitions("bundle", "part", order).write.mode("overwrite").partitionBy("bundle").parquet(f"{path}/rows")
    there = rows.sparkSession.read.schema(binned.schema).parquet(f"{path}/rows")
    lossless.part_ranges(there, order, size).withColumn("bundle", bundle).write.mode("overwrite").parquet(f"{path}/manifest")


def _bundled(most: int) -> int:
    """Parts of a file."""
    return max(1, lossless.PART_BYTES // max(most, 1))


def read_range(spark: SparkSession, path: str, order: str, low: object, high: object) -> DataFrame:
    """The rows with low <= order <= high; only files that hold a part whose range meets it are read."""
    manifest = spark.read.parquet(f"{path}/manifest").where((F.col("first") <= F.lit(high)) & (F.col("last") >= F.lit(low)))
    rows = spark.read.parquet(f"{path}/rows").where(F.col(order).between(F.lit(low), F.lit(high)))
    return rows.join(F.broadcast(manifest.select("bundle").distinct()), "bundle", "left_semi").drop("part", "bundle")  # a row for each file of about 20 MB; prunes partitions


def fingerprint(rows: DataFrame) -> DataFrame:
    """(rows, digest): the same for the same rows in any order; a sum of row hashes, so nothing is sorted or gathered."""
    h = F.xxhash64(cell_key(rows, rows.columns)).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def publish(rows: DataFrame, path: str, version: int, baseline: str | None = None) -> dict:
    """Writes a version, reads it back, and only then names it in the log, bound to the version before and to a baseline.

    Versions go up from 1 by 1. Of two writers of one version one wins, the other raises ``Conflict``, and what it wrote is never read.
    """
    spark, log = rows.sparkSession, CommitLog(rows.sparkSession, path)
    base = log.read()
    if version != base["version"] + 2:
        raise Conflict(f"the next version is {base['version'] + 2}")
    data = f"versions/v{version}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{data}")
    there = fingerprint(spark.read.parquet(f"{path}/{data}")).first()
    return log.commit(base, {"data": data, "baseline": baseline, "rows": there["rows"], "fingerprint": there["digest"]})


def published(spark: SparkSession, path: str, version: int | None = None, baseline: str | None = None) -> dict:
    """What the log says of a version, the latest without a number. The chain of digests up to it is checked, and the baseline if one is asked for."""
    log = CommitLog(spark, path)
    top = len(log.versions()) if version is None else version
    if not 1 <= top <= len(log.versions()):
        raise LookupError("no such version")
    if broken := [p for p in log.problems() if p[0] < top]:
        raise ValueError(f"the log was changed: {broken}")
    found = log.read(top - 1)
    if baseline is not None and found["baseline"] != baseline:
        raise LookupError("another baseline")
    return found


def open_version(spark: SparkSession, path: str, version: int | None = None, baseline: str | None = None) -> DataFrame:
    """A published version, the latest without a number; later publications do not change what it reads."""
    return spark.read.parquet(f"{path}/{published(spark, path, version, baseline)['data']}")


def backup(spark: SparkSession, path: str, target: str, version: int | None = None) -> None:
    """Copies a version to a new place and holds the copy against the original; refuses a place that is taken."""
    source = open_version(spark, path, version)
    source.write.mode("error").parquet(target)
    if fingerprint(source).first() != fingerprint(spark.read.parquet(target)).first():
        raise ValueError("the copy differs")
