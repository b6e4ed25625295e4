"""Whole tables as typed cells in sheets of bounded length, and their check cell by cell against the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, lossless, packing

#: Fixed: rows of a sheet.
SHEET_ROWS = 200_000
_CELL = ["row_key", "column_index", "column_name", "type", "encoding"]


def export_sheets(rows: DataFrame, key: str, path: str, most: int = SHEET_ROWS, chars: int = lossless.SHEET_CHARS) -> None:
    """Every cell of ``rows`` (unique in ``key``) as one or more pieces of at most ``chars`` characters below path/sheets, in sheets of at most ``most`` pieces.

    A row's pieces stay together, rows come in order of the key, and sheets are as full as that allows. path/columns has the schema,
    and path/manifest, which is written last, what each sheet holds.
    """
    pieces = lossless.chunks(lossless.cells(rows, key), chars)
    sizes = pieces.groupBy("row_key").agg(F.count("*").alias("n"))
    sheets = packing.pack(sizes, "row_key", F.col("n"), most, external=1 << 62).select("row_key", F.col("part").alias("sheet"))
    out = pieces.join(sheets, "row_key").repartition("sheet").sortWithinPartitions("sheet", "row_key", "column_index", "chunk")
    out.write.partitionBy("sheet").parquet(f"{path}/sheets")
    constraints.schema_rows(rows.sparkSession, {"rows": rows}).coalesce(1).write.parquet(f"{path}/columns")
    manifest(rows.sparkSession.read.schema(out.schema).parquet(f"{path}/sheets")).write.parquet(f"{path}/manifest")


def manifest(sheets: DataFrame) -> DataFrame:
    """(sheet, pieces, first, last, digest) of each sheet; the digest is a sum of hashes, so it needs no order."""
    h = F.xxhash64(*[c for c in sheets.columns if c != "sheet"]).cast("decimal(38,0)")
    return sheets.groupBy("sheet").agg(F.count("*").alias("pieces"), F.min("row_key").alias("first"), F.max("row_key").alias("last"), F.sum(h).cast("string").alias("digest"))


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/sheets")


def sheet_problems(spark: SparkSession, path: str) -> DataFrame:
    """(sheet, problem): sheets that are not as the manifest has them, or whose keys run into those of another."""
    now = manifest(read_sheets(spark, path)).withColumnsRenamed({"pieces": "_pieces", "digest": "_digest", "first": "_first", "last": "_last"})
    want = spark.read.parquet(f"{path}/manifest")
    problem = F.when(F.col("_pieces").isNull(), "missing").when(F.col("pieces").isNull(), "unknown").when(~(F.col("pieces") == F.col("_pieces")) | ~F.col("digest").eqNullSafe(F.col("_digest")), "content")
    return want.join(now, "sheet", "full_outer").withColumn("problem", problem).where("problem is not null").select("sheet", "problem")


def cell_problems(pieces: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(row_key, column_name, problem): cells that lack pieces (incomplete), are gone (missing), were never there (unknown), or differ in type or value.

    ``pieces`` are read back; the cells are put together again and held against those of ``rows``, one by one, so nothing that the export has
    computed is trusted.
    """
    # a null cell's piece is null, so completeness and values come apart
    found = lossless.unchunked(pieces.select(*_CELL, "chunk_total", "chunk", "value"), _CELL).withColumnsRenamed({"type": "_type", "encoding": "_encoding", "value": "_value", "column_name": "_name"})
    want = lossless.cells(rows, key)
    both = want.join(found, ["row_key", "column_index"], "full_outer")
    problem = (
        F.when(F.col("_type").isNull(), "missing").when(F.col("type").isNull(), "unknown").when(~F.col("complete"), "incomplete")
        .when((F.col("type") != F.col("_type")) | (F.col("encoding") != F.col("_encoding")) | (F.col("column_name") != F.col("_name")), "type").when(~F.col("value").eqNullSafe(F.col("_value")), "value")
    )
    return both.withColumn("problem", problem).where("problem is not null").select("row_key", F.coalesce("column_name", "_name").alias("column_name"), "problem")
