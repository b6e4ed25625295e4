"""Lossless typed export: cells, chunks, size-bounded parts, digests, selectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources import shared

#: Fixed sizes: bytes of a part, of an external chunk and from which a cell is external, characters of a sheet chunk.
PART_BYTES, CHUNK_BYTES, EXTERNAL_BYTES, SHEET_CHARS = 20 << 20, 64 << 10, 256 << 10, 16_000
_KINDS = {"bigint": "integer", "int": "integer", "smallint": "integer", "tinyint": "integer", "boolean": "integer", "double": "real", "float": "real", "string": "text", "binary": "blob"}


def _base64(c: Column) -> Column:
    return F.regexp_replace(F.base64(c), r"\s", "")


def cells(rows: DataFrame, key: str) -> DataFrame:
    """Long format: (key, column_index, column_name, type, encoding, value) for every cell, nulls too.

    Reals travel as their shortest exact text, blobs as base64, text that a sheet cannot hold as base64 of UTF-8.
    """
    parts = []
    for i, f in enumerate(rows.schema):
        c, kind = F.col(f.name), _KINDS.get(f.dataType.simpleString(), "text")
        unsafe = c.cast("string").rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]")
        if kind == "blob":
            enc, val = F.lit("base64"), _base64(c)
        elif kind == "text":
            enc, val = F.when(unsafe, "base64").otherwise("plain"), F.when(unsafe, _base64(F.encode(c.cast("string"), "UTF-8"))).otherwise(c.cast("string"))
        else:
            enc, val = F.lit("plain"), (c.cast("int") if f.dataType.simpleString() == "boolean" else c).cast("string")
        parts.append(F.struct(F.lit(i).alias("column_index"), F.lit(f.name).alias("column_name"), F.when(c.isNull(), "null").otherwise(kind).alias("type"), F.when(c.isNull(), "plain").otherwise(enc).alias("encoding"), val.alias("value")))
    return rows.select(F.col(key).alias("row_key"), F.inline(F.array(*parts)))


def chunks(cells_: DataFrame, size: int = SHEET_CHARS, value: str = "value") -> DataFrame:
    """Values in pieces of at most ``size`` characters, numbered from 0, with the number of pieces; null and empty values have one."""
    n = F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(value, F.lit(""))) / size)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(F.col(value).isNotNull(), F.substring(F.col(value), i * size + 1, F.lit(size))))
    return cells_.select(*[c for c in cells_.columns if c != value], n.alias("chunk_total"), F.posexplode(pieces).alias("chunk", value))


def unchunked(pieces: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The values again, and complete: whether each piece is there exactly once."""
    g = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("chunk", F.col(value).alias("v")))).alias("p"), F.max("chunk_total").alias("t"), F.count_if(F.col(value).isNull()).alias("nulls"))
    whole = F.array_join(F.transform("p", lambda x: x["v"]), "")
    return g.select(*keys, F.when(F.col("nulls") == 0, whole).alias(value), ((F.size("p") == F.col("t")) & (F.size(F.array_distinct(F.transform("p", lambda x: x["chunk"]))) == F.col("t"))).alias("complete"))


def restored(values: DataFrame, row_key: str, schema: list[tuple[str, str]]) -> DataFrame:
    """Rows out of cells (row_key, column_name, type, encoding, value)."""
    one = []
    for name, kind in schema:
        v = F.col("value")
        x = F.when(F.col("encoding") == "base64", F.unbase64(v)).otherwise(F.encode(v, "UTF-8")) if kind == "binary" else F.when(F.col("encoding") == "base64", F.decode(F.unbase64(v), "UTF-8")).otherwise(v)
        one.append(F.max(F.when((F.col("column_name") == name) & (F.col("type") != "null"), x if kind == "binary" else x.cast(kind))).alias(name))
    return values.groupBy(row_key).agg(*one)


def external_cells(cells_: DataFrame, most: int = EXTERNAL_BYTES, size: int = CHUNK_BYTES) -> DataFrame:
    """Chunks of the cells that are too long to stay in their row."""
    return chunks(cells_.where(F.octet_length("value") > most), size)


def _boundaries(rows: DataFrame, order: str, ranges: int) -> list:
    """Values of ``order`` that cut ``rows`` into about ``ranges`` ranges of like size, from a sample of at most 64 a range."""
    some = rows.select(order).where(F.col(order).isNotNull()).orderBy(F.rand(7)).limit(64 * ranges)
    n = F.ntile(ranges).over(W.orderBy(order))  # the bounded sample
    return [r[0] for r in some.withColumn("_n", n).groupBy("_n").agg(F.min(order).alias("low")).select("low").distinct().orderBy("low").collect()][1:]


def _range_of(order: str, cuts: list) -> Column:
    """How many of the cuts are not above the value: looked up among every k-th cut first, then among the k after it."""
    if not cuts:
        return F.lit(0)
    k = max(1, int(len(cuts) ** 0.5))
    upto = lambda a: F.size(F.filter(a, lambda c: c <= F.col(order)))
    groups = [cuts[i : i + k] for i in range(0, len(cuts), k)]
    at = upto(F.array(*[F.lit(g[0]) for g in groups]))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, g)) for g in groups]), F.greatest(at, F.lit(1)))
    return F.when(at == 0, 0).otherwise((at - 1) * k + upto(inner)).cast("int")


def numbered(rows: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """``rows`` with their place (from 0, no gaps) in ascending order, nulls first.

    Rows are counted within ranges and the counts summed over the ranges, so no task sees all rows. Rows of
    one value are in one range; ``order`` should be unique if reruns must agree.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = rows.withColumn("_range", _range_of(order, _boundaries(rows, order, parts)))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    before = r.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(order)) - 1
    return r.join(F.broadcast(before), "_range").withColumn(name, place).drop("_range", "_before")  # as many rows as shuffle partitions


def part_ranges(binned: DataFrame, order: str, size: Column) -> DataFrame:
    """(part, first, last, rows, bytes): what a reader needs to know which parts of ``size_bins`` a range of keys is in."""
    return binned.groupBy("part").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("rows"), F.sum(size).cast("long").alias("bytes"))


def size_bins(rows: DataFrame, order: str, size: Column, most: int = PART_BYTES) -> DataFrame:
    """``rows`` with part: contiguous ranges in order (nulls first), each within ``most`` bytes (a longer row is alone in its part).

    Sums of row sizes are taken within ranges of rows and then over the ranges, so no task sees all rows.
    The ranges have boundaries that are taken once, so that sums and rows agree on them. Rows that
    begin in the same half of a budget are one part, unless a row of over half a budget, which has a part of
    its own, is between them. Part numbers rise with the order, with gaps. ``order`` should be unique.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0))).withColumn("_range", _range_of(order, _boundaries(rows, order, parts)))
    half = max(1, most // 2)
    r = r.withColumn("_big", (F.col("_size") > half).cast("long"))
    sums = r.groupBy("_range").agg(F.sum("_size").alias("_sum"), F.sum("_big").alias("_bigs"))
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    before = sums.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"), F.coalesce(F.sum("_bigs").over(earlier), F.lit(0)).alias("_big_before"))
    r = r.join(F.broadcast(before), "_range")  # as many rows as shuffle partitions
    upto = W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    start = F.col("_before") + F.sum("_size").over(upto) - F.col("_size")
    bigs = F.col("_big_before") + F.sum("_big").over(upto)
    part = F.floor(start / half).cast("long") + 2 * bigs - F.col("_big")
    return r.withColumn("part", part).drop("_size", "_big", "_range", "_before", "_big_before")


def stream_digest(digests: DataFrame, order: str, run: int = 4096) -> DataFrame:
    """One digest of an ordered stream of row digests: of each run of ordinals, then of runs of these, until one is left.

    No task holds more than ``run`` digests. An empty stream has the digest of no text.
    """
    level = digests.select(F.col(order).cast("long").alias("at"), "digest", F.lit(1).cast("long").alias("n"))
    most = level.agg(F.max(F.abs("at"))).first()[0] or 0
    while True:
        lines = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["digest"]))
        if most < run:
            return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.sha2(F.array_join(lines, "|"), 256).alias("digest"))
        level = level.groupBy(F.floor(F.col("at") / run).alias("_at")).agg(F.sha2(F.array_join(lines, "|"), 256).alias("digest"), F.sum("n").alias("n")).withColumnRenamed("_at", "at")
        most = most // run + 1


def outsized(cells_: DataFrame, most: int = PART_BYTES) -> DataFrame:
    """(row_key, column_name): of rows whose cells are over ``most`` bytes together, the largest cells, as many as bring the rest within it."""
    sized = cells_.select("row_key", "column_name", "column_index", F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("_b"))
    least_first = W.partitionBy("row_key").orderBy("_b", F.col("column_index").desc())  # one row's cells
    return sized.withColumn("_upto", F.sum("_b").over(least_first.rowsBetween(W.unboundedPreceding, 0))).where((F.col("_upto") > most) & (F.col("_b") > 0)).select("row_key", "column_name")


def compared(a: DataFrame, b: DataFrame, ordinal: str) -> DataFrame:
    """(ordinal, problem): rows of two ordered streams that differ or that one side lacks."""
    x, y = a.select(ordinal, F.col("digest").alias("_a")), b.select(ordinal, F.col("digest").alias("_b"))
    return x.join(y, ordinal, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(ordinal, F.when(F.col("_a").isNull(), "only right").when(F.col("_b").isNull(), "only left").otherwise("differs").alias("problem"))


def selectors(classification: DataFrame, keys: list[str], set_column: str = "analysis_set", rule: str = "rule_raw") -> DataFrame:
    """(set, rule, matches): every pair of an observed population and an observed rule with its matches, also none.

    The two name lists are small (one row for each distinct name), their product is the result's own size.
    """
    spark = classification.sparkSession
    n = shared.written(classification.groupBy(set_column, rule).agg(F.count("*").alias("matches")), shared.scratch(spark, "selectors"))  # one pass over the classes
    sets = n.select(set_column).where(F.col(set_column).isNotNull()).distinct()
    rules = n.select(rule).where(F.col(rule).isNotNull()).distinct()
    return sets.join(F.broadcast(rules)).join(n, [set_column, rule], "left").withColumn("matches", F.coalesce("matches", F.lit(0)))


def escaped(c: Column) -> Column:
    """Spreadsheet text: control characters, and what looks like an escape already, as _xHHHH_."""
    safe = F.regexp_replace(c, "_(x[0-9A-Fa-f]{4}_)", "_x005F_$1")
    controls = [*range(0, 9), 11, 12, *range(14, 32)]
    return reduce(lambda s, i: F.replace(s, F.lit(chr(i)), F.lit(f"_x{i:04X}_")), controls, safe)


def unescaped(c: Column) -> Column:
    """The inverse of ``escaped``, one level."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)(_x[0-9A-Fa-f]{4}_|.)"), 1)
    one = lambda p: F.when(p.rlike("^_x[0-9A-Fa-f]{4}_$"), F.decode(F.unhex(F.substring(p, 3, 4)), "UTF-16BE")).otherwise(p)
    return F.array_join(F.transform(parts, one), "")
