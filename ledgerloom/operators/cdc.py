"""Change feeds: windows, net changes, reconciliation of snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lossless import numbered
from .overlay import current_rows


def cell_key(df: DataFrame, columns: list[str]) -> Column:
    """One string of typed, length-prefixed cells, equal exactly for rows with the same types and values; -0.0 is not 0.0 in it."""
    parts = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        v = F.base64(F.col(c)) if kind == "binary" else F.to_json(F.struct(F.col(c))) if kind.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        parts.append(F.coalesce(F.concat(F.lit(f"{kind}:"), F.length(v).cast("string"), F.lit(":"), v), F.lit("null:")))
    return F.concat_ws("|", *parts)


def window(feed: DataFrame, after: int, through: int) -> DataFrame:
    """The events of a pinned window; later ones wait for the next."""
    return feed.where((F.col("event_id") > after) & (F.col("event_id") <= through))


def net_changes(feed: DataFrame, current: DataFrame, key: str = "row_id") -> DataFrame:
    """One operation for each identity that the feed names, old or new: upsert with the current row, or delete."""
    ids = feed.select(F.col("old_id").alias(key)).unionByName(feed.select(F.col("new_id").alias(key))).where(F.col(key).isNotNull()).distinct()
    rows = current.withColumn("_there", F.lit(True))
    return ids.join(rows, key, "left").withColumn("op", F.when(F.col("_there"), "upsert").otherwise("delete")).drop("_there")


def feed_of(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(row_id, op) from two snapshots: insert, update or delete, null and bit-exact."""
    cols = [c for c in after.columns if c != key]
    b = before.select(F.col(key), F.sha2(cell_key(before, cols), 256).alias("_b"))
    a = after.select(F.col(key), F.sha2(cell_key(after, cols), 256).alias("_a"))
    op = F.when(F.col("_b").isNull(), "insert").when(F.col("_a").isNull(), "delete").when(F.col("_a") != F.col("_b"), "update")
    return b.join(a, key, "full_outer").withColumn("op", op).where("op is not null").select(key, "op")


def reconcile(before: DataFrame, after: DataFrame, key: str | None) -> DataFrame:
    """The operations that turn ``before`` into ``after``: (ordinal_class, key, op, and the row for upserts).

    Without a key, or with other columns or types, the table is cleared and loaded anew.
    """
    same = key is not None and [(f.name, f.dataType) for f in before.schema] == [(f.name, f.dataType) for f in after.schema]
    if not same:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in after.schema]
        clear = after.sparkSession.range(1).select(F.lit(0).alias("ordinal_class"), F.lit("clear_table").alias("op"), *empty)
        return clear.unionByName(after.select(F.lit(1).alias("ordinal_class"), F.lit("upsert").alias("op"), "*"))
    ops = feed_of(before, after, key)
    named = ops.select(F.lit(1).alias("ordinal_class"), key, F.when(F.col("op") == "delete", "delete").otherwise("upsert").alias("op"))
    rest = [c for c in after.columns if c != key]
    return named.join(after.select(key, *rest), key, "left").select("ordinal_class", "op", key, *rest)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one side only, with side."""
    return a.subtract(b).withColumn("side", F.lit("a")).unionByName(b.subtract(a).withColumn("side", F.lit("b")))


def operation_log(changes: DataFrame) -> DataFrame:
    """``changes`` (table_name, op, identity, values ...) of all tables with ordinal: one gapless sequence, a table's operations together.

    A table's clear comes first, then its operations by identity; rows without an identity (of a cleared table) by their
    content. Equal rows may change places, which changes nothing.
    """
    rest = F.sha2(F.to_json(F.struct(*[c for c in changes.columns if c not in ("table_name", "op", "identity")])), 256)
    place = F.concat_ws("\x01", "table_name", F.when(F.col("op") == "clear_table", "0").otherwise("1"), F.coalesce("identity", F.lit("")), F.coalesce(rest, F.lit("")))
    return numbered(changes.withColumn("_place", place), "_place").drop("_place")


def replay_problems(before: DataFrame, log: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, op): what is still to be done after one table's log was applied to ``before``; no rows if the log is right."""
    got = current_rows(before, log.withColumn("generation", F.lit(0)), key)
    return feed_of(got.select(*after.columns), after, key)


def identity_problems(log: DataFrame) -> DataFrame:
    """(table_name, identity, problem): identities that a log names twice, and operations that lack one although nothing was cleared."""
    cleared = log.where("op = 'clear_table'").select("table_name").distinct().withColumn("_cleared", F.lit(True))
    ops = log.where("op <> 'clear_table'")
    twice = ops.where("identity is not null").groupBy("table_name", "identity").agg(F.count("*").alias("n")).where("n > 1").select("table_name", "identity", F.lit("repeated").alias("problem"))
    lost = ops.where("identity is null").select("table_name", "op").distinct().join(F.broadcast(cleared), "table_name", "left").where("_cleared is null or op = 'delete'")  # names of tables
    return twice.unionByName(lost.select("table_name", F.lit(None).cast(log.schema["identity"].dataType).alias("identity"), F.lit("missing").alias("problem")).distinct())


def transport_problems(operations: DataFrame) -> DataFrame:
    """(table_name, problem): operation logs whose ordinals are not contiguous, that clear twice, or clear after an upsert."""
    per = operations.groupBy("table_name").agg(F.count_if(F.col("op") == "clear_table").alias("clears"), F.min(F.when(F.col("op") != "clear_table", F.col("ordinal"))).alias("first"), F.max(F.when(F.col("op") == "clear_table", F.col("ordinal"))).alias("cleared"), F.count("*").alias("n"), F.countDistinct("ordinal").alias("d"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"))
    checks = F.array(F.when(F.col("clears") > 1, "cleared twice"), F.when(F.col("cleared") > F.col("first"), "cleared late"), F.when((F.col("d") != F.col("n")) | (F.col("hi") - F.col("lo") + 1 != F.col("n")), "ordinals"))
    return per.select("table_name", F.explode(F.array_compact(checks)).alias("problem"))


def needs_reset(previous_through: int | None, high_water: int, reconcile_asked: bool, schema_before: str | None, schema_now: str) -> bool:
    """Whether a delta must start from a full reconciliation."""
    return previous_through is None or previous_through > high_water or reconcile_asked or schema_before != schema_now


def is_idle(guards_verified: bool, through: int, high_water: int, schema_before: str, schema_now: str) -> bool:
    return guards_verified and through == high_water and schema_before == schema_now
