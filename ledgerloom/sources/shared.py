"""The folder that driver and executors share, and tables written there to cut a plan."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a local session may do without the setting."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = sc._jsc.sc().getCheckpointDir()
    if not made.isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerloom-"))
        made = sc._jsc.sc().getCheckpointDir()
    return made.get().rstrip("/")


def file_system(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


_scratch: dict[str, SparkSession] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted when the driver ends or by ``discard``."""
    path = f"{shared_dir(spark)}/ledgerloom-{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def discard(*paths: str) -> None:
    for path in paths:
        spark = _scratch.pop(path, None)
        if spark is not None:
            fs, p = file_system(spark, path)
            fs.delete(p, True)


@atexit.register
def _discard_all() -> None:
    for path in list(_scratch):
        try:
            discard(path)
        except Exception:  # the JVM has gone
            return


def nothing(spark: SparkSession, schema: str) -> DataFrame:
    """A frame without rows that the optimizer knows to have none, so joins with it are left out."""
    return spark.range(1).where(F.lit(False)).select(F.from_json(F.lit(None).cast("string"), schema).alias("_r")).select("_r.*")


def written(df: DataFrame, path: str) -> DataFrame:
    """``df``, written once and read back: cuts its plan, and survives lost executors."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
