"""Audit counts: events, assets, URL addresses, status of the archive, integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx


def event_evidence(responses: DataFrame) -> DataFrame:
    """One row of counts from usable event responses; festivals count once per account and id, big runs per account, period and stage."""
    v = F.col("v")
    r = responses.where("http_status = 200 and projected = 1 and json_text is not null").withColumn("v", F.try_variant_get(jsonx.parsed("json_text"), "$.data", "variant"))
    fest, data = F.col("operation").startswith("DetailFest"), jsonx.is_object(v)
    fest_id = jsonx.text(v, "$.fest.id")
    fest_ok = fest & data & (F.coalesce(fest_id, F.lit("")) != "")
    coop_ok = ~fest & data & jsonx.is_object(v, "$.coopRecord")
    big = jsonx.is_object(v, "$.coopRecord.bigRunRecord")
    edges = jsonx.elements(v, "$.coopRecord.bigRunRecord.records.edges")
    attend = jsonx.integer(v, "$.coopRecord.teamContestRecord.attend")
    marked = r.select("account", v, fest_ok.alias("fest_ok"), fest_id.alias("fest_id"), jsonx.is_object(v, "$.fest.playerResult").alias("played"), F.when(coop_ok & (attend >= 0), attend).alias("attend"),
        F.when(coop_ok & big, edges).alias("edges"), ((fest & ~fest_ok) | (~fest & ~coop_ok) | (coop_ok & big & edges.isNull())).alias("bad"))
    fests = marked.where("fest_ok").groupBy("account", "fest_id").agg(F.bool_or("played").alias("played")).agg(F.count("*").alias("fest_event_details"), F.count_if("played").alias("fest_events_with_player_result"))
    e = marked.where("edges is not null").select("account", F.explode("edges").alias("e"))
    at = lambda p: F.nullif(jsonx.text(F.col("e"), f"$.node.{p}"), F.lit(""))
    e = e.select("account", at("startTime").alias("start"), at("endTime").alias("end"), at("coopStage.id").alias("stage"), F.coalesce(jsonx.integer(F.col("e"), "$.node.highestJobScore") > 0, F.lit(False)).alias("positive"))
    whole = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("stage").isNotNull()
    runs = e.where(whole).groupBy("account", "start", "end", "stage").agg(F.bool_or("positive").alias("positive")).agg(F.count("*").alias("big_run_event_records"), F.count_if("positive").alias("big_run_events_with_positive_highest_job_score"))
    rest = marked.agg(F.max("attend").alias("team_contest_max_observed_attend"), F.count_if("bad").alias("bad"))
    torn = e.agg(F.count_if(~whole).alias("torn"))
    one = F.lit(1).alias("k")
    out = fests.select("*", one).join(runs.select("*", one), "k").join(rest.select("*", one), "k").join(torn.select("*", one), "k")  # one row each
    return out.withColumn("unusable_event_responses_or_rows", F.col("bad") + F.col("torn")).drop("k", "bad", "torn")


def url_address(url: Column) -> Column:
    """struct(scheme, host, port, path) of an http(s) address; null with control characters, user names or backslashes."""
    fine = url.rlike(r"(?i)^https?://[^/?#@\\\x00-\x20\x7f]+([/?#][^\\\x00-\x20\x7f]*)?$")
    scheme = F.lower(F.regexp_extract(url, r"^([^:]+):", 1))
    authority = F.regexp_extract(url, r"^[^:]+://([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    effective = F.when(port != "", port.cast("int")).when(scheme == "https", 443).otherwise(80)
    path = F.regexp_extract(url, r"^[^:]+://[^/?#]*([^?#]*)", 1)
    return F.when(fine, F.struct(scheme.alias("scheme"), F.lower(F.regexp_replace(authority, r":\d*$", "")).alias("host"), effective.alias("port"), path.alias("path")))


def signed_url_expired(url: Column, now: Column) -> Column:
    """Whether a signed URL's time (Expires, or X-Goog-Date and X-Goog-Expires) has come; null for unsigned ones."""
    ask = lambda k: F.try_parse_url(url, F.lit("QUERY"), F.lit(k))
    seconds = F.coalesce(F.try_to_number(ask("Expires"), F.lit("9999999999999")).cast("long"), F.unix_seconds(F.try_to_timestamp(ask("X-Goog-Date"), F.lit("yyyyMMdd'T'HHmmssX"))) + F.try_to_number(ask("X-Goog-Expires"), F.lit("9999999999999")).cast("long"))
    return seconds <= F.unix_seconds(now)


def host_allowed(url: Column, suffixes: tuple[str, ...], buckets: dict[str, str] | None = None) -> Column:
    """https on port 443 without user names, on one of the hosts or below it, or in the one allowed bucket (first path segment) of a store's host."""
    a = url_address(url)
    host = a["host"]
    near = F.lit(False)
    for s in suffixes:
        near = near | (host == s) | host.endswith("." + s)
    first = F.get(F.filter(F.split(a["path"], "/"), lambda s: s != ""), F.lit(0))
    for store, bucket in (buckets or {}).items():
        near = near | ((host == store) & F.coalesce(first == bucket, F.lit(False)))
    return F.coalesce((a["scheme"] == "https") & (a["port"] == 443) & near, F.lit(False))


STATES = ("done", "pending", "retry", "expired")


def asset_evidence(assets: DataFrame, bodies: DataFrame) -> DataFrame:
    """Counts of assets by state and stored body, and of expired addresses that are (not) stored under another signature."""
    a = assets.join(bodies.select(F.col("sha256").alias("body_sha256"), F.lit(True).alias("stored")), "body_sha256", "left")
    state = F.when(F.col("state").isin(*STATES), F.col("state")).otherwise("other")
    a = a.select(state.alias("state"), F.coalesce("stored", F.lit(False)).alias("stored"), url_address(F.col("url")).alias("address"))
    counts = a.agg(*[F.count_if(F.col("state") == s).alias(f"{s}_assets") for s in (*STATES, "other")], F.count_if((F.col("state") == "done") & F.col("stored")).alias("done_with_body"), F.count_if(F.col("address").isNull()).alias("without_address"))
    gone = a.where("state = 'expired' and address is not null").select("address").distinct()
    kept = a.where("state = 'done' and stored and address is not null").select("address").distinct().withColumn("kept", F.lit(True))
    both = gone.join(kept, "address", "left").agg(F.count("*").alias("expired_addresses"), F.count_if(F.col("kept").isNotNull()).alias("expired_but_stored"))
    return counts.join(both)  # one row each


def status(tables: dict[str, DataFrame]) -> DataFrame:
    """(section, name, n): rows of each table, jobs and assets by state, matches without a detail, matches by population, and tags."""
    line = lambda section, name, n: F.struct(F.lit(section).alias("section"), name.alias("name"), n.alias("n"))
    rows = lambda t, n: line("rows", F.lit(t), n)

    def by_code(t: str, section: str, name: Column) -> DataFrame:
        """A table's rows by one of its fixed codes and as a whole, from one pass: there are as many rows as codes."""
        n = tables[t].groupBy(name.alias("name")).agg(F.count("*").alias("n"))
        one = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.collect_list(F.struct("name", "n")).alias("each"))
        return one.select(F.inline(F.concat(F.array(rows(t, F.col("all"))), F.transform("each", lambda x: line(section, x["name"], x["n"])))))

    coded = {t: by_code(t, t, F.col("state")) for t in ("jobs", "assets") if t in tables}
    if "match_classification" in tables:
        coded["match_classification"] = by_code("match_classification", "analysis", F.concat_ws("/", "kind", "genre", "roster_class", "analysis_set"))
    if "matches" in tables:
        one = tables["matches"].agg(F.count("*").alias("all"), F.count_if(F.col("detail_response_id").isNull()).alias("none"))
        coded["matches"] = one.select(F.inline(F.array(rows("matches", F.col("all")), line("matches", F.lit("without detail"), F.col("none")))))
    parts = [coded[t] if t in coded else d.agg(F.count("*").alias("n")).select(F.lit("rows").alias("section"), F.lit(t).alias("name"), "n") for t, d in sorted(tables.items())]
    if "match_tags" in tables:
        parts.append(tables["match_tags"].groupBy(F.col("tag").alias("name")).agg(F.count("*").alias("n")).select(F.lit("tags").alias("section"), "name", "n"))
    return reduce(DataFrame.unionByName, parts)


def verify(bodies: DataFrame, responses: DataFrame) -> DataFrame:
    """(problem, id): bodies whose hash or length is wrong, responses without their body."""
    bad = bodies.where((F.sha2("body", 256) != F.col("sha256")) | (F.length("body") != F.col("byte_length"))).select(F.lit("body").alias("problem"), F.col("sha256").alias("id"))
    lost = responses.join(bodies.select(F.col("sha256").alias("body_sha256")), "body_sha256", "left_anti").select(F.lit("missing body").alias("problem"), F.col("id").cast("string").alias("id"))
    return bad.unionByName(lost)


def duplicate_responses(details: DataFrame, keys: list[str], order: list[str], complete: Column) -> DataFrame:
    """``details`` with keep: of a key's rows the first complete one, or the first if none is."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys)
    first = F.row_number().over(w.orderBy((~complete).cast("int"), *order))
    return details.withColumn("copies", F.count("*").over(w)).withColumn("keep", first == 1)
