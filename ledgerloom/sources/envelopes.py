"""Fetch envelopes from JSON files, and exports back to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ENVELOPE


def read_envelopes(spark: SparkSession, path: str) -> DataFrame:
    """One envelope a file, in order of file names; objects among the fields stay JSON text."""
    return spark.read.schema(ENVELOPE).json(path, multiLine=True).withColumn("file", F.input_file_name())


def read_wrapped(spark: SparkSession, path: str, account: str) -> tuple[DataFrame, DataFrame]:
    """Files that hold a bare result object with an id become envelopes; the rest are listed with a reason."""
    t = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    v = F.try_parse_json("value")
    t = t.withColumn("id", F.try_variant_get(v, "$.result.id", "string")).withColumn("fetched_at", F.coalesce(F.try_variant_get(v, "$.result.playedTime", "string"), F.lit("1970-01-01T00:00:00Z")))
    t = t.withColumn("reason", F.when(v.isNull(), "not JSON").when(F.col("id").isNull(), "no result.id"))
    good = t.where("reason is null").select(F.sha2("value", 256).alias("event_id"), F.lit(account).alias("account"), "fetched_at", F.lit("Import").alias("operation"), F.to_json(F.struct("id")).alias("variables"), F.lit(None).cast("string").alias("query_id"), F.lit(None).cast("string").alias("app_version"), F.lit(200).alias("status"), F.lit("{}").alias("headers"), F.base64(F.encode("value", "UTF-8")).alias("body_base64"))
    return good, t.where("reason is not null").select("file", "reason")


def export_raw(bodies: DataFrame, manifest: DataFrame, fetches: DataFrame, path: str) -> None:
    """Bodies as Parquet by hash prefix (rows stay bytes), manifests as ordered JSON lines; the pointer file comes last."""
    bodies.withColumn("prefix", F.substring("sha256", 1, 2)).write.mode("overwrite").partitionBy("prefix").parquet(f"{path}/bodies")
    manifest.orderBy("id").write.mode("overwrite").json(f"{path}/manifest")
    fetches.orderBy("event_id").write.mode("overwrite").json(f"{path}/fetches")
    bodies.sparkSession.range(1).selectExpr("'complete' as state").coalesce(1).write.mode("overwrite").json(f"{path}/_CURRENT")


def export_assets(assets: DataFrame, path: str) -> None:
    """The assets of a raw export as ordered JSON lines: url, state, content type and the hash of the body that holds each."""
    assets.select("url", "state", "content_type", "body_sha256").orderBy("url").write.mode("overwrite").json(f"{path}/assets")


def lines_header(rows: DataFrame) -> dict:
    """What a reader of typed lines must know first: the columns and their types, in order."""
    return {"columns": [{"name": f.name, "type": f.dataType.simpleString()} for f in rows.schema]}


def typed_lines(rows: DataFrame, limit: int) -> tuple[DataFrame, dict]:
    """Rows as JSON lines, and the footer that says whether more would follow; ``lines_header`` goes before them."""
    n = rows.limit(limit + 1).count()
    return rows.limit(limit).select(F.to_json(F.struct(*rows.columns)).alias("line")), {"rows": min(n, limit), "truncated": n > limit}


def query(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """Read-only SQL over named tables."""
    head = sql.lstrip().split(None, 1)[0].lower() if sql.strip() else ""
    if head not in ("select", "with", "values", "from", "explain", "describe", "show"):
        raise ValueError("only reading statements")
    for name, d in tables.items():
        d.createOrReplaceTempView(name)
    return spark.sql(sql)


def file_chunks(spark: SparkSession, path: str, size: int) -> DataFrame:
    """Files in numbered pieces of bytes, each with its SHA-256, and the whole file's."""
    f = spark.read.format("binaryFile").load(path)
    n = F.greatest(F.lit(1), F.ceil(F.length("content") / size)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("content"), i * size + 1, F.lit(size)))
    return f.select("path", F.sha2("content", 256).alias("whole"), n.alias("total"), F.posexplode(pieces).alias("chunk", "data")).withColumn("sha256", F.sha2("data", 256))


def joined_chunks(chunks: DataFrame) -> DataFrame:
    """(path, content, verified)."""
    g = chunks.groupBy("path", "whole", "total").agg(F.array_sort(F.collect_list(F.struct("chunk", "data"))).alias("p"))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["data"]))
    return g.select("path", whole.alias("content"), ((F.size("p") == F.col("total")) & (F.sha2(whole, 256) == F.col("whole"))).alias("verified"))
