"""File sets as a tree of hashes: only files that changed are read again, and any subset has a token without reading one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lossless
from . import shared

CHUNK = 4 << 20
#: Files that one read names.
_AT_ONCE = 10_000
LEAF = "path string, length bigint, modified timestamp, chunk int, sha256 string"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, modified) of all files below ``path`` but empty ones, which Spark's file sources leave out; no file is opened."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def leaves(spark: SparkSession, paths: list[str], size: int = CHUNK) -> DataFrame:
    """(path, length, modified, chunk, sha256) of every chunk of some files (a file of up to 2 GB is one row on its way)."""
    f = spark.read.format("binaryFile").load(paths)
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / size)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sha2(F.substring(F.col("content"), i * size + 1, F.lit(size)), 256))
    return f.select("path", "length", F.col("modificationTime").alias("modified"), F.posexplode(hashes).alias("chunk", "sha256"))


def refreshed(spark: SparkSession, path: str, known: DataFrame | None, size: int = CHUNK) -> tuple[DataFrame, int]:
    """The leaves of all files below ``path``, and how many files were read: those whose length or time is not as in ``known`` (leaves of an earlier run)."""
    now = listing(spark, path)
    known = spark.createDataFrame([], LEAF) if known is None else known
    same = known.join(now, ["path", "length", "modified"], "left_semi")
    new = [r["path"] for r in now.join(known.select("path", "length", "modified").distinct(), ["path", "length", "modified"], "left_anti").select("path").toLocalIterator()]
    for k in range(0, len(new), _AT_ONCE):
        same = same.unionByName(leaves(spark, new[k : k + _AT_ONCE], size))
    return shared.written(same, shared.scratch(spark, "leaves")), len(new)


def files(leaves_: DataFrame) -> DataFrame:
    """(path, length, sha256): a file's hash over those of its chunks, in order."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "sha256"))), lambda x: x["sha256"]), "\n")
    return leaves_.groupBy("path", "length").agg(F.sha2(lines, 256).alias("sha256"))


def token(files_: DataFrame) -> str:
    """One hash of a set of files (path, length, sha256), the same in whatever order they come; a subset's follows from its rows alone."""
    rows = files_.select("path", F.sha2(F.concat_ws("\n", "path", F.col("length").cast("string"), "sha256"), 256).alias("digest"))
    return lossless.stream_digest(lossless.numbered(rows, "path", "at"), "at").first()["digest"]


def file_problems(want: DataFrame, got: DataFrame) -> DataFrame:
    """(path, chunk, problem) of two sets of leaves: missing and unknown files (chunk null), and the chunks that differ."""
    a = want.select("path", "chunk", F.col("sha256").alias("_a"))
    b = got.select("path", "chunk", F.col("sha256").alias("_b"))
    chunks = a.join(b, ["path", "chunk"], "full_outer").where("not (_a <=> _b)")
    only = lambda x, y, problem: x.select("path").distinct().join(y.select("path").distinct(), "path", "left_anti").select("path", F.lit(None).cast("int").alias("chunk"), F.lit(problem).alias("problem"))
    both = a.select("path").intersect(b.select("path"))
    changed = chunks.join(both, "path", "left_semi").select("path", "chunk", F.lit("content").alias("problem"))
    return only(a, b, "missing").unionByName(only(b, a, "unknown")).unionByName(changed)
