"""Baseline and delta generations read as one current table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def current_rows(baseline: DataFrame, operations: DataFrame, key: str) -> DataFrame:
    """The rows after all generations. ``operations`` has generation, ordinal, op (upsert, delete, clear_table), key and the columns.

    The last operation on each key wins, if it is newer than the last clear; the winner is found by a
    partial maximum, so a key with many operations is never gathered.
    """
    cols = [c for c in baseline.columns if c != key]
    base = baseline.select(F.lit(-1).cast("long").alias("generation"), F.lit(0).cast("long").alias("ordinal"), F.lit("upsert").alias("op"), key, *cols)
    every = base.unionByName(operations.select(F.col("generation").cast("long").alias("generation"), F.col("ordinal").cast("long").alias("ordinal"), "op", key, *cols))
    at = F.struct("generation", "ordinal")
    clear = every.where("op = 'clear_table'").agg(F.max(at).alias("cleared"))  # one row
    best = every.where("op <> 'clear_table'").groupBy(key).agg(F.max_by(F.struct(at.alias("at"), "op", *cols), at).alias("w"))
    live = best.join(F.broadcast(clear)).where((F.col("cleared").isNull() | (F.col("w.at") > F.col("cleared"))) & (F.col("w.op") == "upsert"))
    return live.select(key, *[F.col(f"w.{c}").alias(c) for c in cols])


def generation_counts(baseline: DataFrame, operations: DataFrame, key: str) -> DataFrame:
    """(generation, rows): the rows that there are after each generation (-1: the baseline), to hold against what its metadata says.

    A key exists from a generation that ends with its upsert up to the next generation in which it has an operation, or a
    clear follows: +1 and -1 over generations, summed up to each. Operations are first reduced to the last one of a
    key in a generation, so a key's window has one row a generation; that reduction is read twice, the sources once.
    Clears are at most one row a generation, held in one array.
    """
    base = baseline.select(F.lit(-1).cast("long").alias("generation"), F.lit(0).cast("long").alias("ordinal"), F.lit("upsert").alias("op"), F.col(key).alias("_key"))
    named = F.when(F.col("op") != "clear_table", F.col(key))
    every = base.unionByName(operations.select(F.col("generation").cast("long").alias("generation"), F.col("ordinal").cast("long").alias("ordinal"), "op", named.alias("_key")))
    last = every.groupBy("_key", "generation").agg(F.max(F.struct("ordinal", "op")).alias("_last"))
    clears = last.where("_last.op = 'clear_table'").agg(F.array_sort(F.collect_list(F.struct("generation", F.col("_last.ordinal").alias("ordinal")))).alias("_clears"))  # one row
    ops = last.where("_last.op <> 'clear_table'").join(F.broadcast(clears))
    at = F.struct("generation", F.col("_last.ordinal").alias("ordinal"))
    cleared = F.get(F.filter("_clears", lambda c: c > at), F.lit(0))["generation"]
    following = F.lead("generation").over(W.partitionBy("_key").orderBy("generation"))
    there = (F.col("_last.op") == "upsert") & (cleared.isNull() | (cleared > F.col("generation")))
    span = ops.select("generation", there.alias("_there"), F.least(following, cleared).alias("_end"))  # least skips nulls
    step = lambda g, n: F.struct(g.alias("generation"), F.lit(n).alias("n"))
    each = F.array(step(F.col("generation"), 0), F.when(F.col("_there"), step(F.col("generation"), 1)), F.when(F.col("_there") & F.col("_end").isNotNull(), step(F.col("_end"), -1)))
    steps = span.select(F.inline(F.array_compact(each)))
    there = clears.select(F.inline(F.transform("_clears", lambda c: step(c["generation"], 0)))).unionByName(baseline.sparkSession.range(1).select(F.lit(-1).cast("long").alias("generation"), F.lit(0).alias("n")))
    per = steps.unionByName(there).groupBy("generation").agg(F.sum("n").alias("n"))
    return per.select("generation", F.sum("n").over(W.orderBy("generation")).alias("rows"))  # a row for each generation


def lookup(rows: DataFrame, criteria: dict[str, object]) -> DataFrame:
    """At most two rows that match all criteria exactly: none, the one, or proof that it is not unique."""
    kinds = {"bigint": int, "int": int, "double": float, "string": str, "binary": bytes, "boolean": bool}
    out = rows
    for c, v in criteria.items():
        kind = kinds.get(rows.schema[c].dataType.simpleString())
        if v is not None and (kind is None or type(v) is not kind):
            return rows.limit(0)  # another type is never equal
        out = out.where(F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
    return out.limit(2)


def unique(rows: DataFrame, criteria: dict[str, object]):
    found = lookup(rows, criteria).collect()
    if len(found) > 1:
        raise LookupError("more than one row")
    return found[0] if found else None


def chain_problems(generations: DataFrame) -> DataFrame:
    """(id, problem) of a chain (ordinal, id, parent, after, through, schema_hash, baseline, reset): each must follow from the one before."""
    w = W.orderBy("ordinal")  # one row for each generation
    g = generations.withColumns({"_id": F.lag("id").over(w), "_through": F.lag("through").over(w), "_schema": F.lag("schema_hash").over(w), "_base": F.first("baseline").over(w)})
    first = F.col("_id").isNull()
    checks = F.array(
        F.when(first & ~F.col("reset"), "starts without a reset"),
        F.when(~first & ~F.col("parent").eqNullSafe(F.col("_id")), "parent"),
        F.when(~first & ~F.col("reset") & (F.col("after") != F.col("_through")), "gap"),
        F.when(~first & ~F.col("reset") & (F.col("schema_hash") != F.col("_schema")), "schema"),
        F.when(F.col("baseline") != F.col("_base"), "baseline"),
        F.when(F.col("through") < F.col("after"), "backwards"),
    )
    return g.select("id", F.explode(F.array_compact(checks)).alias("problem"))


def from_last_reset(generations: DataFrame) -> DataFrame:
    """The generations that count: from the last reset on."""
    last = generations.where("reset").agg(F.max("ordinal").alias("_last"))
    return generations.join(F.broadcast(last)).where(F.col("_last").isNull() | (F.col("ordinal") >= F.col("_last"))).drop("_last")


def selected(current: DataFrame, classification: DataFrame, analysis_set: str | None, rule_raw: str | None = None) -> DataFrame:
    """Current matches of one population (and rule), or with None those that have no classification."""
    key = ["account", "kind", "match_key"]
    if analysis_set is None:
        return current.join(classification, key, "left_anti")
    c = classification.where(F.col("analysis_set") == analysis_set)
    return current.join(c.where(F.col("rule_raw") == rule_raw) if rule_raw else c, key, "left_semi")
