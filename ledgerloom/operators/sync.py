"""Three-way plans for keeping two file trees equal, publication checks, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_BYTES = 1 << 30


def plan_sync(local: DataFrame, remote: DataFrame, baseline: DataFrame, mode: str = "both", retired: tuple[str, ...] = ()) -> DataFrame:
    """(path, action, reason, conflict) from file lists (path, sha256, size, mtime) and the last common hashes (path, sha256).

    New files go to the other side as the mode allows; equal ones are left out; of different ones the
    side that still has the common hash takes the other's, else the newer wins (ties: remote) as a conflict.
    Files over 1 GiB on either side are skipped.
    """
    side = lambda d, p: d.select("path", *[F.col(c).alias(f"{p}_{c}") for c in ("sha256", "size", "mtime")])
    j = side(local, "l").join(side(remote, "r"), "path", "full_outer").join(baseline.select("path", F.col("sha256").alias("common")), "path", "left")
    j = j.where(F.coalesce(F.greatest("l_size", "r_size"), F.lit(0)) <= MOST_BYTES).where(~F.col("path").isin(*retired) if retired else F.lit(True))
    push_safe, pull_safe = F.coalesce(F.col("r_sha256") == F.col("common"), F.lit(False)), F.coalesce(F.col("l_sha256") == F.col("common"), F.lit(False))
    row = lambda a, r, c: F.struct(F.lit(a).alias("action"), F.lit(r).alias("reason"), (F.lit(c) if isinstance(c, bool) else c).alias("conflict"))
    gone_r, gone_l = F.col("r_sha256").isNull(), F.col("l_sha256").isNull()
    differ = {"push": row("push", "update", ~push_safe), "pull": row("pull", "update", ~pull_safe)}.get(mode)
    if differ is None:
        differ = F.when(push_safe, row("push", "local changed", False)).when(pull_safe, row("pull", "remote changed", False)).when(F.col("l_mtime") > F.col("r_mtime"), row("push", "local newer", True)).when(F.col("l_mtime") < F.col("r_mtime"), row("pull", "remote newer", True)).otherwise(row("pull", "same time", True))
    step = F.when(gone_r, row("push", "new", False) if mode != "pull" else F.lit(None)).when(gone_l, row("pull", "new", False) if mode != "push" else F.lit(None)).when(F.col("l_sha256") != F.col("r_sha256"), differ)
    return j.withColumn("s", step).where("s is not null").select("path", "s.action", "s.reason", "s.conflict")


def merged_baseline(baseline: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """The last common hashes after a run: new where both sides agree, kept where a file still exists, gone otherwise."""
    l, r = local.select("path", F.col("sha256").alias("l")), remote.select("path", F.col("sha256").alias("r"))
    j = l.join(r, "path", "full_outer").join(baseline.select("path", F.col("sha256").alias("b")), "path", "left")
    return j.withColumn("sha256", F.when(F.col("l") == F.col("r"), F.col("l")).otherwise(F.col("b"))).where("sha256 is not null").select("path", "sha256")


def manifest_problems(declared: DataFrame, found: DataFrame, required: tuple[str, ...] = ()) -> DataFrame:
    """(path, problem) between a manifest and the files that are there (path, size, sha256)."""
    d, f = declared.select("path", F.col("size").alias("ds"), F.col("sha256").alias("dh")), found.select("path", F.col("size").alias("fs"), F.col("sha256").alias("fh"))
    twice = declared.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path", F.lit("declared twice").alias("problem"))
    problem = F.when(F.col("fh").isNull(), "missing").when(F.col("dh").isNull(), "not declared").when(F.col("ds") != F.col("fs"), "size").when(F.col("dh") != F.col("fh"), "hash")
    out = d.join(f, "path", "full_outer").select("path", problem.alias("problem")).where("problem is not null").unionByName(twice)
    if required:
        need = declared.sparkSession.createDataFrame([(p,) for p in required], "path string")
        out = out.unionByName(need.join(declared, "path", "left_anti").select("path", F.lit("required").alias("problem")))
    return out


def range_problems(shards: DataFrame) -> DataFrame:
    """(table_name, first_row, problem): shards (table_name, first_row, last_row, columns_hash) with gaps, overlaps or other columns."""
    from pyspark.sql import Window as W

    w = W.partitionBy("table_name").orderBy("first_row")
    s = shards.withColumns({"_last": F.lag("last_row").over(w), "_hash": F.lag("columns_hash").over(w)})
    p = F.array(F.when(F.col("_last").isNull() & (F.col("first_row") != 1), "start"), F.when(F.col("_last") + 1 != F.col("first_row"), "range"), F.when(F.col("_hash") != F.col("columns_hash"), "columns"))
    return s.select("table_name", "first_row", F.explode(F.array_compact(p)).alias("problem"))


def lag_seconds(now: Column, published_at: Column, captured_at: Column) -> Column:
    """struct(published_age, capture_gap) in seconds, never negative."""
    gap = lambda a, b: F.greatest(F.lit(0), F.unix_seconds(a) - F.unix_seconds(b))
    return F.struct(gap(now, published_at).alias("published_age"), gap(published_at, captured_at).alias("capture_gap"))


def due_day(now: Column, hour: int, zone: str) -> Column:
    """The latest day whose hour has come in the zone."""
    local = F.from_utc_timestamp(now, zone)
    return F.when(F.hour(local) >= hour, F.to_date(local)).otherwise(F.date_sub(F.to_date(local), 1))


def due_step(now: Column, due: Column, last_success: Column, last_failure: Column, retry_seconds: int) -> Column:
    """run, wait or done."""
    fresh = F.coalesce(last_success >= due, F.lit(False))
    waiting = F.coalesce(F.unix_seconds(now) - F.unix_seconds(last_failure) < retry_seconds, F.lit(False))
    return F.when(fresh, "done").when(waiting, "wait").otherwise("run")


AXES = ("unified", "mode", "rule")


def dataset_problems(items: DataFrame) -> DataFrame:
    """(token, problem) of a list of data sets (token, axis): unknown axes, repeated tokens, tokens that are not of their axis.

    A token is ``unified``, ``mode:<name>`` or ``rule:<name>``.
    """
    of = F.when(F.col("token") == "unified", "unified").when(F.col("token").startswith("mode:"), "mode").when(F.col("token").startswith("rule:"), "rule")
    checks = F.array(F.when(~F.coalesce(F.col("axis").isin(*AXES), F.lit(False)), "axis"), F.when(~of.eqNullSafe(F.col("axis")), "token"))
    each = items.select("token", F.explode(F.array_compact(checks)).alias("problem"))
    return each.unionByName(items.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token", F.lit("repeated").alias("problem")))


def count_problems(counts: DataFrame) -> DataFrame:
    """(problem) of one row (mode_files, rule_files, modes, rules): a rule file for each mode and rule, a file for each mode at least."""
    checks = F.array(
        F.when(F.least("mode_files", "rule_files", "modes", "rules") < 0, "negative"), F.when(F.col("rule_files") != F.col("modes") * F.col("rules"), "rule files"), F.when(F.col("mode_files") < F.col("modes"), "mode files")
    )
    return counts.select(F.explode(F.array_compact(checks)).alias("problem"))
