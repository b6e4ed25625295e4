"""Finding single rows of a large table by columns that it is not ordered by, with generations of changes on top.

Parts are written with a manifest of zone maps (least and greatest value, nulls) and Bloom filters. A search first picks the
parts that may hold a match from the manifest alone, probes only the columns asked for in these and in the operations, decides which
of the rows found are still current, and only then fetches whole rows, of at most two keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lossless, packing

#: Bits of a Bloom filter for each row of a part, and bits that a value sets.
BITS_A_ROW, HASHES = 10, 4
_EXACT = {"bigint": int, "int": int, "double": float, "string": str, "binary": bytes, "boolean": bool}
#: With more parts than this left, they are joined in instead of being listed in a filter.
MOST_LISTED = 2000


def _place(c: Column, i: int, bits: Column) -> Column:
    """The bit that a value's i-th hash sets; values of one type only are compared, so the type needs no part in it."""
    return F.pmod(F.xxhash64(c, F.lit(i)), bits)


def write_indexed(rows: DataFrame, path: str, order: str, size: Column, columns: list[str], most: int = lossless.PART_BYTES) -> None:
    """Parts of at most ``most`` bytes in ``order`` below path/rows, and for each part a row of path/manifest with its range and, for ``columns``, zone maps and Bloom filters."""
    packed = packing.pack(rows, order, size, most, external=most).drop("external")
    packed.repartition("part").sortWithinPartitions("part", order).write.partitionBy("part").parquet(f"{path}/rows")
    there = rows.sparkSession.read.schema(packed.schema).parquet(f"{path}/rows")
    # a -0.0 is equal to 0.0, and NaN to none
    zone = [F.struct(F.min(c).alias("low"), F.max(c).alias("high"), F.count_if(F.col(c).isNull()).alias("nulls")).alias(f"zone_{c}") for c in columns]
    zones = there.groupBy("part").agg(F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"), *zone).withColumn("bits", (F.ceil(F.col("rows") * BITS_A_ROW / 64) * 64).cast("long"))
    sized = there.select("part", *columns).join(zones.select("part", "bits"), "part")
    set_bits = F.array(*[F.struct(F.lit(c).alias("column"), _place(F.col(c), i, F.col("bits")).alias("bit")) for c in columns for i in range(HASHES)])
    words = sized.select("part", F.inline(set_bits)).groupBy("part", "column", F.floor(F.col("bit") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word_bits"))
    pick = lambda c: F.map_from_entries(F.collect_list(F.when(F.col("column") == c, F.struct("word", "word_bits")))).alias(f"bloom_{c}")
    blooms = words.groupBy("part").agg(*[pick(c) for c in columns])  # a filter's words: bounded by the rows of a part
    zones.join(blooms, "part").write.parquet(f"{path}/manifest")


def exact(schema, criteria: dict[str, object]) -> bool:
    """Whether every value has its column's own type: another one is never equal."""
    return all(v is None or type(v) is _EXACT.get(schema[c].dataType.simpleString()) for c, v in criteria.items())


def _same(c: str, v: object) -> Column:
    return F.col(c).isNull() if v is None else F.col(c) == F.lit(v)


def matching(criteria: dict[str, object]) -> Column:
    found = F.lit(True)
    for c, v in criteria.items():
        found = found & _same(c, v)
    return found


def candidate_parts(spark: SparkSession, path: str, criteria: dict[str, object]) -> DataFrame:
    """(part): the parts whose zone maps and Bloom filters do not rule a match out; columns that are not in the manifest rule nothing out."""
    manifest = spark.read.parquet(f"{path}/manifest")
    may = F.lit(True)
    for c, v in criteria.items():
        if f"zone_{c}" not in manifest.columns:
            continue
        if v is None:
            may = may & (F.col(f"zone_{c}.nulls") > 0)
            continue
        value = F.lit(v).cast(manifest.schema[f"zone_{c}"].dataType["low"].dataType)
        may = may & F.coalesce((F.col(f"zone_{c}.low") <= value) & (F.col(f"zone_{c}.high") >= value), F.lit(False))
        for i in range(HASHES):
            bit = _place(value, i, F.col("bits"))
            word = F.try_element_at(F.col(f"bloom_{c}"), F.floor(bit / 64).cast("int"))
            may = may & (F.coalesce(word, F.lit(0)).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))) != 0)
    return manifest.where(may).select("part")


def _in_parts(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """The rows of some parts; the others' files are not opened."""
    some = [r[0] for r in parts.limit(MOST_LISTED + 1).collect()]
    return rows.where(F.col("part").isin(some)) if len(some) <= MOST_LISTED else rows.join(parts, "part", "left_semi")


def candidates(spark: SparkSession, path: str, key: str, schema, criteria: dict[str, object], rows: DataFrame | None = None) -> DataFrame:
    """(key, part) of the baseline rows that match: reads the key and the criteria's columns of candidate parts."""
    rows = rows if rows is not None else spark.read.schema(f"{schema}, part bigint" if isinstance(schema, str) else schema).parquet(f"{path}/rows")
    return _in_parts(rows, candidate_parts(spark, path, criteria)).where(matching(criteria)).select(key, "part")


def find(spark: SparkSession, path: str, operations: DataFrame, key: str, criteria: dict[str, object], baseline: DataFrame | None = None) -> DataFrame:
    """At most two current rows that match all criteria with exact types: none, the one, or proof that it is not unique.

    ``operations`` (generation, ordinal, op, key, columns) lie over the baseline below ``path``. Keys come from the narrow probe of
    both; the last operation on each of them, and the last clear, say which are still so. The overlay is never made.
    Many searches list the files once if they share ``baseline`` (path/rows, opened); that is a file for each part.
    """
    baseline = baseline if baseline is not None else spark.read.parquet(f"{path}/rows")
    columns = [c for c in baseline.columns if c != "part"]
    if not exact(baseline.schema, criteria):
        return baseline.select(*columns).limit(0)
    wanted = list(dict.fromkeys([key, *criteria]))
    at = F.struct("generation", "ordinal")
    base = candidates(spark, path, key, baseline.schema, criteria, baseline)
    changed = operations.where("op = 'upsert'").where(matching(criteria)).select(key)
    keys = base.select(key).unionByName(changed).distinct()
    clear = operations.where("op = 'clear_table'").agg(F.max(at).alias("cleared"))  # one row
    ops = operations.where("op <> 'clear_table'").select("generation", "ordinal", "op", *wanted).join(keys, key, "left_semi")
    last = ops.groupBy(key).agg(F.max_by(F.struct("op", *[F.col(c).alias(f"c_{c}") for c in criteria]), at).alias("_w"), F.max(at).alias("_at"))
    known = keys.join(last, key, "left").join(base, key, "left").join(F.broadcast(clear))
    fits = F.lit(True)
    for c, v in criteria.items():
        fits = fits & (F.col(f"_w.c_{c}").isNull() if v is None else F.coalesce(F.col(f"_w.c_{c}") == F.lit(v), F.lit(False)))
    by_operation = F.col("_at").isNotNull() & (F.col("cleared").isNull() | (F.col("_at") > F.col("cleared"))) & (F.col("_w.op") == "upsert") & fits
    by_baseline = F.col("_at").isNull() & F.col("cleared").isNull() & F.col("part").isNotNull()
    two = known.where(by_operation | by_baseline).select(key, "part", "_at", by_operation.alias("_op")).limit(2).collect()
    found = baseline.select(*columns).limit(0)
    if parts := {r["part"] for r in two if not r["_op"]}:
        found = baseline.where(F.col("part").isin(sorted(parts)) & F.col(key).isin([r[key] for r in two if not r["_op"]])).select(*columns)
    for r in two:
        if r["_op"]:
            one = operations.where((F.col(key) == r[key]) & (F.col("generation") == r["_at"]["generation"]) & (F.col("ordinal") == r["_at"]["ordinal"]))
            found = found.unionByName(one.select(*columns))
    return found


def find_one(spark: SparkSession, path: str, operations: DataFrame, key: str, criteria: dict[str, object]):
    """The row, or None; LookupError if there are more."""
    rows = find(spark, path, operations, key, criteria).collect()
    if len(rows) > 1:
        raise LookupError("more than one row")
    return rows[0] if rows else None
