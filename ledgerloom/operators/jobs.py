"""Job queue: priorities, delays, scope of jobs, planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority(operation: Column, histories: list[str], details: list[str], ranking: list[str], kind: Column) -> Column:
    """0 histories, 1 details, 5 rankings, 3 other jobs of a match, 2 the rest."""
    return F.when(operation.isin(*histories), 0).when(operation.isin(*details), 1).when(operation.isin(*ranking), 5).when(kind.isNotNull(), 3).otherwise(2)


def eligible(jobs: DataFrame, now: Column, routes: list[str] | None = None, low_disk: bool = False) -> DataFrame:
    """Jobs that may run now, best first; with little disk only histories and details. ``jobs`` has a priority."""
    out = jobs.where(F.col("state").isin("pending", "retry") & (F.col("next_attempt") <= now))
    out = out.where(F.col("operation").isin(*routes)) if routes is not None else out
    out = out.where("priority <= 1") if low_disk else out
    return out.orderBy("priority", "attempts", "operation", "variables_json")


def network_delay(attempts: Column) -> Column:
    """Seconds until the next attempt after a network failure."""
    return F.least(F.lit(3600.0), 30 * F.pow(F.lit(2.0), F.least(attempts, F.lit(7))))


def empty_delay(empty_retries: Column) -> Column:
    """Seconds until an empty related detail is asked for again."""
    return F.least(F.lit(86400.0), 300 * F.pow(F.lit(2.0), F.least(empty_retries - 1, F.lit(9))))


def outcome_delay(outcome: Column) -> Column:
    return F.when(outcome.isin("done", "unavailable"), 86400.0).otherwise(300.0)


def retry_after(header: Column, now: Column) -> Column:
    """Seconds that a Retry-After header asks for, 60 at least; null if it cannot be read."""
    seconds = F.when(header.rlike(r"^\d+$"), header.cast("double"))
    date = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(header, r"^\w+, | GMT$", ""), F.lit("dd MMM yyyy HH:mm:ss"))) - F.unix_seconds(now)
    wait = F.coalesce(seconds, date.cast("double"))
    return F.when(wait.isNotNull(), F.greatest(F.lit(60.0), wait))


def _number(df: DataFrame, c: str) -> Column:
    """A time or number as a number, only to find its bin."""
    kind = df.schema[c].dataType.simpleString()
    if kind.startswith(("timestamp", "date", "string")):
        return F.unix_micros(F.try_to_timestamp(F.col(c)) if kind == "string" else F.col(c).cast("timestamp")).cast("double")
    return F.col(c).cast("double")


def participation(played: DataFrame, periods: DataFrame, keys: list[str], at: str = "played_at") -> DataFrame:
    """``periods`` with participated: whether a row with the same keys lies in [start, end).

    Time is cut into bins of the periods' mean length, so periods lie in about three bins each, however long some are.
    Keys and bin carry a semi-join: a hot key's rows are dealt over bins, and no pair of row and period is ever made.
    """
    p = periods.select(*keys, "start", "end").where(F.col("start") < F.col("end")).distinct()
    low, high = _number(periods, "start"), _number(periods, "end")
    width = p.agg(F.avg(high - low).alias("_width"))  # one row
    bin_ = lambda c: F.floor(c / F.greatest("_width", F.lit(1e-9))).cast("long")
    dealt = p.join(F.broadcast(width)).withColumn("_bin", F.explode(F.sequence(bin_(low), bin_(high))))
    rows = played.select(*keys, F.col(at).alias("_at"), _number(played, at).alias("_n")).join(F.broadcast(width)).select(*keys, "_at", bin_(F.col("_n")).alias("_bin"))
    rows = rows.where("_bin is not null")
    same = [dealt[c] == rows[c] for c in (*keys, "_bin")]
    hit = dealt.join(rows, [*same, rows["_at"] >= dealt["start"], rows["_at"] < dealt["end"]], "left_semi").select(*keys, "start", "end").distinct().withColumn("_hit", F.lit(True))
    return periods.join(hit, [*keys, "start", "end"], "left").withColumn("participated", F.col("_hit").isNotNull()).drop("_hit")


def scope(jobs: DataFrame, now: Column) -> DataFrame:
    """``jobs`` (scope_kind, start, end, participated, superseded_by) with scope_state and scope_reason.

    Season rankings wait for the season's end, event rankings need a match in the event's period; jobs of
    other kinds are eligible. Periods that are not known yet are awaited.
    """
    k = F.col("scope_kind")
    state = (
        F.when(F.col("superseded_by").isNotNull(), F.struct(F.lit("superseded").alias("s"), F.lit("REPLACED").alias("r")))
        .when(~k.isin("season", "event"), F.struct(F.lit("eligible").alias("s"), F.lit("NOT_RANKING").alias("r")))
        .when(F.col("end").isNull(), F.struct(F.lit("awaiting_scope").alias("s"), F.lit("PERIOD_UNKNOWN").alias("r")))
        .when((k == "season") & (now < F.col("end")), F.struct(F.lit("awaiting_scope").alias("s"), F.lit("SEASON_OPEN").alias("r")))
        .when((k == "event") & ~F.col("participated"), F.when(now < F.col("end"), F.struct(F.lit("awaiting_scope").alias("s"), F.lit("NOT_PLAYED_YET").alias("r"))).otherwise(F.struct(F.lit("out_of_scope").alias("s"), F.lit("NOT_PLAYED").alias("r"))))
        .otherwise(F.struct(F.lit("eligible").alias("s"), F.lit("IN_SCOPE").alias("r")))
    )
    return jobs.withColumn("_s", state).withColumn("scope_state", F.col("_s.s")).withColumn("scope_reason", F.col("_s.r")).drop("_s")


def final_states(jobs: DataFrame, fetches: DataFrame) -> DataFrame:
    """done becomes done_final once an acknowledged fetch of the job came at or after its final_after."""
    last = fetches.where("acknowledged = 1").groupBy("account", "operation", "variables_json").agg(F.max("fetched_at").alias("_last"))
    done = (F.col("state") == "done") & (F.col("_last") >= F.col("final_after"))
    return jobs.join(last, ["account", "operation", "variables_json"], "left").withColumn("state", F.when(done, "done_final").otherwise(F.col("state"))).drop("_last")


def backfill(jobs: DataFrame, histories: list[str], matches: DataFrame) -> DataFrame:
    """Re-arms history jobs, and detail jobs of matches that have no detail."""
    open_ = matches.where("detail_response_id is null").select("account", "match_key").distinct().withColumn("_open", F.lit(True))
    again = F.col("operation").isin(*histories) | F.col("_open")
    j = jobs.join(open_, ["account", "match_key"], "left")
    return j.withColumn("state", F.when(again, "pending").otherwise(F.col("state"))).withColumn("next_attempt", F.when(again, 0.0).otherwise(F.col("next_attempt"))).drop("_open")


def catalog_binding(definitions: DataFrame, responses: DataFrame, current: str) -> DataFrame:
    """``responses`` with binding: which schema version explains them.

    ``definitions`` (catalog, operation, query_id, app_version, definition and, if stored, sha256); a response without
    an app_version is explained by any version of its query. It is known_current or known_saved if all catalogs that name
    its query agree on one definition, ambiguous if they do not, catalog_corrupt if one of them differs from its stored
    hash, catalog_invalid if one has no definition, legacy_unchecked without a query id, else unresolved.
    """
    hashed = F.sha2("definition", 256)
    wrong = F.coalesce(hashed != F.col("sha256"), F.lit(False)) if "sha256" in definitions.columns else F.lit(False)
    d = definitions.where("operation is not null and query_id <> ''").select("operation", "query_id", "app_version", hashed.alias("_d"), wrong.alias("_wrong"), (F.col("catalog") == current).alias("_cur"))
    d = d.where("app_version is not null").unionByName(d.withColumn("app_version", F.lit(None).cast("string")))
    d = d.groupBy("operation", "query_id", "app_version").agg(F.countDistinct("_d").alias("_n"), F.bool_or("_cur").alias("_now"), F.bool_or("_wrong").alias("_corrupt"), F.bool_or(F.col("_d").isNull()).alias("_invalid"))
    keys = ["operation", "query_id", "app_version"]
    d = d.select(*[F.col(c).alias(f"_{c}") for c in keys], "_n", "_now", "_corrupt", "_invalid")
    on = (F.col("operation") == F.col("_operation")) & (F.col("query_id") == F.col("_query_id")) & F.col("app_version").eqNullSafe(F.col("_app_version"))
    states = {"_corrupt": "catalog_corrupt", "_invalid": "catalog_invalid"}
    b = F.when(F.col("query_id").isNull(), "legacy_unchecked")
    for flag, name in states.items():
        b = b.when(F.col(flag), name)
    b = b.when(F.col("_n") > 1, "ambiguous").when(F.col("_now"), "known_current").when(F.col("_n") == 1, "known_saved").otherwise("unresolved")
    return responses.join(d, on, "left").select(*responses.columns, b.alias("binding"))


def assets_due(assets: DataFrame, now: Column, most: int) -> DataFrame:
    """The assets to fetch next, those with the fewest attempts first."""
    return assets.where(F.col("state").isin("pending", "retry") & (F.col("next_attempt") <= now)).orderBy("attempts", "url").limit(most)


def with_periods(jobs: DataFrame, groups: DataFrame, periods: DataFrame) -> DataFrame:
    """``jobs`` (account, period_id ...) with start, end, event_id and what is missing, as ``reason``.

    A period is described by the group that lists it (``groups``: account, json_text with timePeriods and
    leagueMatchSetting); if that lacks its times, by its own entity (``periods``: account, entity_id,
    json_text, possibly below data). The event comes from the description, else from any group that lists
    the period. Successive left joins and a coalesce; each side has one row for a period.
    """
    v = F.try_parse_json("json_text")
    body = lambda x: F.coalesce(F.when(F.try_variant_get(x, "$.data", "map<string,variant>").isNotNull(), F.try_variant_get(x, "$.data", "variant")), x)
    text = lambda c, path: F.try_variant_get(c, path, "string")
    event = "$.leagueMatchSetting.leagueMatchEvent.id"
    g = groups.select("account", body(v).alias("g"))
    g = g.select("account", text(F.col("g"), event).alias("e"), F.explode(F.try_variant_get("g", "$.timePeriods", "array<variant>")).alias("p"))
    g = g.select("account", text(F.col("p"), "$.id").alias("period_id"), text(F.col("p"), "$.startTime").alias("s"), text(F.col("p"), "$.endTime").alias("t"), "e").where("period_id is not null")
    listed = g.groupBy("account", "period_id").agg(F.max(F.when(F.col("s").isNotNull() & F.col("t").isNotNull(), F.struct("s", "t", "e"))).alias("a"), F.min("e").alias("any_event"))
    own = periods.select("account", F.col("entity_id").alias("period_id"), body(v).alias("p"), F.lit(True).alias("there"))
    own = own.groupBy("account", "period_id").agg(F.max(F.struct(text(F.col("p"), "$.startTime").alias("s"), text(F.col("p"), "$.endTime").alias("t"), text(F.col("p"), event).alias("e"), (F.try_variant_get("p", "$", "map<string,variant>").isNotNull()).alias("fine"))).alias("b"))
    j = jobs.join(listed, ["account", "period_id"], "left").join(own, ["account", "period_id"], "left")
    start, end = (F.coalesce(F.col(f"a.{x}"), F.when(F.col("a").isNull(), F.col(f"b.{x}"))) for x in "st")
    at = lambda c: F.try_to_timestamp(c)
    found = F.coalesce("a.e", F.when(F.col("a").isNull(), F.col("b.e")), "any_event")
    reason = (
        F.when(F.col("period_id").isNull(), "missing_period_id")
        .when(F.col("a").isNull() & F.col("b").isNull(), "period_entity_not_found")
        .when(F.col("a").isNull() & ~F.col("b.fine"), "invalid_period_json")
        .when(start.isNull() | end.isNull(), "missing_period_time_range")
        .when(at(start).isNull() | at(end).isNull(), "invalid_period_time_format")
        .when(at(start) >= at(end), "invalid_period_time_range")
        .when(found.isNull(), "event_id_unconfirmed")
    )
    keep = [c for c in jobs.columns if c not in ("start", "end", "event_id", "reason")]
    return j.select(*keep, at(start).alias("start"), at(end).alias("end"), found.alias("event_id"), reason.alias("reason"))
