"""Queries of single records, catalogs, status, scopes, labels, schedules and homes over the benchmark tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import evidence, ingest, jobs, layout, overlay, rates, records, sync, views
from . import fixtures as fx
from .archive_queries import _classes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, base: bool = False):
    """Registers a query by its name, and its SQL; with ``base`` the fixture tables stand before it."""

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {fx.SQL} {sql}" if base else sql
        return f

    return put


def _iso(c: str = "ts") -> Column:
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


_Z = "strftime(ts, '%Y-%m-%dT%H:%M:%SZ')"

# -- records and catalogs -----------------------------------------------------------------------------------------


@query("SELECT o.account, o.match_key, cs.analysis_set, cs.judgement, CASE WHEN o.has_detail THEN 'available' WHEN o.k % 4 IN (0, 2) THEN 'pending' WHEN o.k % 4 = 1 THEN 'unavailable' ELSE 'unresolved' END AS detail_state FROM o LEFT JOIN cs USING (k) WHERE o.match_key = 'm7'", True)
def record_get(s, d):
    frame = views.detail_states(records.records(fx.matches(s, d), fx.documents(s, d), _classes(s, d)), fx.jobs(s, d))
    account = fx.orders(s, d).where("match_key = 'm7'").select("account")  # the one key that is asked for
    return records.get(frame, account.first()[0], "vs", "m7").select("account", "match_key", "analysis_set", "judgement", "detail_state")


@query("SELECT (SELECT least(count(DISTINCT account), 2) FROM o) AS accounts, NULL::VARCHAR AS account UNION ALL SELECT 1, (SELECT min(account) FROM o)", True)
def single_account(s, d):
    m = fx.matches(s, d)
    first = m.agg(F.min("account")).first()[0]
    return records.only_account(m).unionByName(records.only_account(m.where(F.col("account") == first)))


@query("SELECT cs.account, cs.match_key, coalesce((SELECT string_agg(tag, ', ' ORDER BY tag) FROM tg WHERE tg.account = cs.account AND tg.match_key = cs.match_key), '') AS tags FROM cs", True)
def tag_lists(s, d):
    return records.tag_lists(_classes(s, d), fx.tags(s, d)).drop("kind")


def _responses(s: SparkSession, d: str) -> DataFrame:
    return fx.read(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("account"), F.col("event_type").alias("operation"), F.when(F.col("event_id") % 4 == 0, 500).otherwise(200).alias("http_status"), _iso().alias("fetched_at"))


@query(f"SELECT event_id AS id, event_type AS operation, CASE WHEN event_id % 4 = 0 THEN 500 ELSE 200 END AS http_status, CASE WHEN event_id % 5 > 0 THEN 'p' || event_id % 9 END AS part, CASE event_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS fetches, CASE WHEN event_id % 3 < 2 THEN {_Z} END AS first_fetched_at, CASE WHEN event_id % 3 < 2 THEN {_Z} END AS last_fetched_at FROM events")
def response_index(s, d):
    r = _responses(s, d)
    once = r.where("id % 3 < 2").select(F.col("id").alias("response_id"), "fetched_at")
    homes = r.where("id % 5 > 0").select("id", F.concat(F.lit("p"), (F.col("id") % 9).cast("string")).alias("part"))
    return layout.response_index(r, homes, once.unionByName(once.where("response_id % 3 = 0"))).drop("account")


@query("SELECT url, CASE WHEN page_id % 3 = 0 THEN 'done' ELSE 'pending' END AS state, CASE WHEN page_id % 3 = 0 THEN strlen(html) END AS byte_length, CASE WHEN page_id % 3 = 0 THEN 'images/' || substr(sha256(html), 1, 2) || '.parquet' ELSE 'images/no-body.parquet' END AS part FROM pages")
def asset_index(s, d):
    p = fx.read(s, d, "pages").withColumn("sha256", F.sha2("html", 256))
    done = F.col("page_id") % 3 == 0
    assets = p.select("url", F.when(done, "done").otherwise("pending").alias("state"), F.lit(None).cast("string").alias("content_type"), F.when(done, F.col("sha256")).alias("body_sha256"))
    bodies = p.groupBy("sha256").agg(F.max(F.octet_length("html")).cast("long").alias("byte_length"))
    return layout.asset_index(assets, bodies).drop("content_type")


@query("SELECT o_orderpriority AS table_name, count(DISTINCT o_orderkey % 50) AS parts, count(*) AS rows FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1")
def table_homes(s, d):
    k = F.col("o_orderkey")
    return layout.table_homes(fx.read(s, d, "orders").select((k % 50).cast("string").alias("part"), F.col("o_orderpriority").alias("table_name"), F.when(k % 3 > 0, "home").otherwise("copy").alias("role")))


@query("SELECT 1 AS step, 'send' AS action, o_orderkey::VARCHAR AS part FROM orders WHERE o_orderkey % 5 = 0 AND o_orderkey % 7 > 0 UNION ALL SELECT 2, 'catalog', NULL UNION ALL SELECT 3, 'delete', o_orderkey::VARCHAR FROM orders WHERE o_orderkey % 7 = 0")
def publication(s, d):
    k = F.col("o_orderkey")
    o = fx.read(s, d, "orders").select(k, k.cast("string").alias("part"))
    return layout.publication(o.select("part", F.lit("x").alias("sha256")), o.where(k % 7 > 0).select("part", F.when(k % 5 == 0, "y").otherwise("x").alias("sha256")))


@query("SELECT o_orderpriority || (o_orderkey % 50) AS part FROM orders GROUP BY 1 HAVING count_if(o_orderkey % 4 > 0) = 0")
def emptied_parts(s, d):
    o = fx.read(s, d, "orders").select("o_orderkey", F.concat("o_orderpriority", (F.col("o_orderkey") % 50).cast("string")).alias("part"))
    return layout.emptied_parts(o, o.where("o_orderkey % 4 > 0"))


@query(f"SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'fetches/' || strftime(ts + INTERVAL 9 HOUR, '%Y-%m/%Y-%m-%d') || '.parquet' WHEN event_id % 3 = 1 THEN 'matches/' || event_type || '.parquet' ELSE 'unplaced/rate_points.parquet' END AS part FROM events")
def rate_point_homes(s, d):
    e = fx.read(s, d, "events").select("event_id", "event_type", _iso().alias("fetched_at"), F.concat(F.lit("u"), "user_id").alias("account"))
    key = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("fetch:"), "event_id")).otherwise(F.concat(F.lit("m"), "event_id"))
    homes = {"any_match": e.where("event_id % 3 = 1").select("account", key.alias("match_key"), F.concat(F.lit("matches/"), "event_type", F.lit(".parquet")).alias("part")), "fetches": e.select(F.col("event_id").cast("string").alias("event_id"), "fetched_at")}
    return layout.home_of("rate_points", e.select("event_id", "account", key.alias("match_key")), homes).select("event_id", "part")


# -- ingest -------------------------------------------------------------------------------------------------------


def _with_ids(s: SparkSession, d: str) -> DataFrame:
    """Each order as a response with its id at two places, one of them no match's, and an image."""
    k = F.col("o_orderkey").cast("string")
    node = F.struct(F.concat(F.lit("VsHistoryDetail-u"), F.col("o_custkey"), F.lit(":RECENT:d"), k).alias("id"), F.struct(F.concat(F.lit("https://h/"), k, F.lit(".png")).alias("url")).alias("image"))
    return fx.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.struct(F.array(node).alias("nodes"), F.struct(k.alias("id"), F.lit("http://no/x").alias("url")).alias("page")).alias("data"))).alias("json_text"))


@query("SELECT o_orderkey AS id, '$.data.nodes[0]' AS path, 'vs' AS kind, 'u' || o_custkey || ':d' || o_orderkey AS match_key FROM orders")
def sightings_found(s, d):
    return ingest.sightings(_with_ids(s, d))


@query("SELECT o_orderkey AS id, '$.data.nodes[0].image.url' AS path, 'https://h/' || o_orderkey || '.png' AS url FROM orders")
def asset_refs_found(s, d):
    return ingest.asset_refs(_with_ids(s, d))


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_id < 5) GROUP BY ALL")
def insert_or_ignore(s, d):
    e = fx.read(s, d, "events").select("user_id", "event_type", "event_id")
    first = e.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    known = e.where("event_id < 5").select("user_id").distinct().join(e.select("user_id", "event_type").distinct(), "user_id")
    return ingest.new_only(first, known, ["user_id", "event_type"])


@query("""WITH e AS (SELECT user_id::VARCHAR AS account, event_type AS tag, arg_max(event_id, (ts, event_id)) AS last, max(ts) AS ts FROM events WHERE event_id % 3 > 0 GROUP BY ALL), t AS (SELECT DISTINCT user_id::VARCHAR AS account, event_type AS tag FROM events WHERE event_id % 3 = 0)
SELECT account, tag, 'old' AS note FROM t WHERE (account, tag) NOT IN (SELECT account, tag FROM e) UNION ALL SELECT account, tag, 'n' || last FROM e WHERE last % 2 = 0""")
def tags_after_edits(s, d):
    e = fx.read(s, d, "events").select(F.col("user_id").cast("string").alias("account"), F.lit("k").alias("match_key"), F.col("event_type").alias("tag"), "event_id", "ts")
    old = e.where("event_id % 3 = 0").select("account", "match_key", "tag").distinct().select("*", F.lit("old").alias("note"), F.lit("t").alias("updated_at"))
    at = F.concat(F.col("ts").cast("string"), F.format_string(" %012d", F.col("event_id")))
    edits = e.where("event_id % 3 > 0").select("account", "match_key", "tag", F.concat(F.lit("n"), "event_id").alias("note"), at.alias("at"), F.when(F.col("event_id") % 2 == 0, "add").otherwise("remove").alias("op"))
    return ingest.tags_after(old, edits).select("account", "tag", "note")


@query("""WITH f AS (SELECT event_type, ts FROM events WHERE event_id % 4 > 0 AND event_id % 6 <> 1 AND event_type <> 'error') SELECT t.event_type AS operation, strftime(max(f.ts), '%Y-%m-%dT%H:%M:%SZ') AS last_success_at,
(epoch(n) - epoch(date_trunc('second', max(f.ts))))::BIGINT AS age_seconds, coalesce((epoch(n) - epoch(date_trunc('second', max(f.ts)))) > 1500, TRUE) AS stale FROM (SELECT DISTINCT event_type FROM events) t LEFT JOIN f USING (event_type), (SELECT date_trunc('second', max(ts)) + INTERVAL 5 MINUTE AS n FROM events) GROUP BY 1, n""")
def last_success(s, d):
    r = _responses(s, d).withColumn("projected", F.lit(1))
    now = fx.read(s, d, "events").agg(F.date_trunc("second", F.max(F.col("ts").cast("timestamp"))) + F.expr("interval 5 minutes")).first()[0]
    issues = r.where("id % 6 = 1 or operation = 'error'").select(F.col("id").alias("response_id"), F.when(F.col("operation") == "error", "SELECTED_FIELD_MISSING").otherwise("INCOMPLETE_RESPONSE").alias("code"))
    harmless = r.where("id % 6 = 2").select(F.col("id").alias("response_id"), F.lit("NOTE").alias("code"))
    out = ingest.last_success(r.where("fetched_at is not null").withColumn("fetched_at", F.to_timestamp("fetched_at")), r.select(F.col("id").alias("response_id"), F.to_timestamp("fetched_at").alias("fetched_at")), issues.unionByName(harmless), F.lit(now), 1500)
    return out.withColumn("last_success_at", _iso("last_success_at"))


# -- jobs and schedules -------------------------------------------------------------------------------------------


@query("SELECT url, page_id % 6 AS attempts FROM pages WHERE page_id % 4 IN (1, 2) AND page_id % 100 <= 60 ORDER BY attempts, url LIMIT 30")
def assets_due(s, d):
    k = F.col("page_id")
    a = fx.read(s, d, "pages").select("url", F.when(k % 4 == 1, "pending").when(k % 4 == 2, "retry").otherwise("done").alias("state"), (k % 6).alias("attempts"), (k % 100).cast("double").alias("next_attempt"))
    return jobs.assets_due(a, F.lit(60.0), 30).select("url", "attempts")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (0, 4, 7) THEN '2026-01-01' WHEN o_orderkey % 8 = 1 THEN '2026-02-01' WHEN o_orderkey % 8 = 5 THEN '2026-03-01' END AS day, CASE WHEN o_orderkey % 8 IN (0, 7) THEN 'e' WHEN o_orderkey % 8 = 1 THEN 'own' END AS event_id,
CASE o_orderkey % 8 WHEN 2 THEN 'period_entity_not_found' WHEN 3 THEN 'invalid_period_json' WHEN 4 THEN 'missing_period_time_range' WHEN 5 THEN 'invalid_period_time_range' WHEN 6 THEN 'missing_period_id' END AS reason FROM orders""")
def period_scopes(s, d):
    """By the order's number: a period that a group describes, one of its own, an unknown, a broken, a timeless, an ended one, none."""
    k = F.col("o_orderkey") % 8
    j = fx.read(s, d, "orders").select("o_orderkey", F.lit("a").alias("account"), F.when(k == 7, "p0").when(k != 6, F.concat(F.lit("p"), k.cast("string"))).alias("period_id"))
    groups = s.createDataFrame([("a", '{"leagueMatchSetting":{"leagueMatchEvent":{"id":"e"}},"timePeriods":[{"id":"p0","startTime":"2026-01-01T00:00:00Z","endTime":"2026-01-02T00:00:00Z"},{"x":1}]}'), ("a", "[broken"), ("b", '{"timePeriods":[{"id":"p2","startTime":"2026-01-01T00:00:00Z","endTime":"2026-01-02T00:00:00Z"}]}')], "account string, json_text string")
    own = s.createDataFrame([
        ("a", "p1", '{"data":{"startTime":"2026-02-01T00:00:00Z","endTime":"2026-02-02T00:00:00Z","leagueMatchSetting":{"leagueMatchEvent":{"id":"own"}}}}'),
        ("a", "p3", "{"), ("a", "p4", '{"startTime":"2026-01-01T00:00:00Z"}'), ("a", "p5", '{"startTime":"2026-03-01T00:00:00Z","endTime":"2026-02-01T00:00:00Z"}'),
    ], "account string, entity_id string, json_text string")
    return jobs.with_periods(j, groups, own).select("o_orderkey", F.date_format("start", "yyyy-MM-dd").alias("day"), "event_id", "reason")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'done' WHEN event_id % 4 = 1 THEN 'wait' ELSE 'run' END AS step, ((event_id % 3) * 45 + 15)::BIGINT AS published_age, (event_id % 4) * 10 AS capture_gap FROM events")
def due_steps(s, d):
    k, day = F.col("event_id") % 4, F.date_trunc("day", "ts")
    now = day + F.expr("interval 5 hours")
    step = sync.due_step(now, day, F.when(k == 0, now).when(k == 3, day - F.expr("interval 1 day")), F.when(k == 1, now - F.expr("interval 30 seconds")).when(k == 2, day), 60)
    published = now - F.make_dt_interval(secs=(F.col("event_id") % 3) * 45 + 15)
    lag = sync.lag_seconds(now, published, published - F.make_dt_interval(secs=k * 10))
    return fx.read(s, d, "events").select("event_id", step.alias("step"), lag["published_age"].cast("long").alias("published_age"), lag["capture_gap"].cast("long").alias("capture_gap"))


@query("SELECT event_id FROM events WHERE event_id >= (SELECT max(event_id) FROM events WHERE event_id % 97 = 0)")
def from_last_reset(s, d):
    e = fx.read(s, d, "events").select("event_id", F.col("event_id").alias("ordinal"), (F.col("event_id") % 97 == 0).alias("reset"))
    return overlay.from_last_reset(e).select("event_id")


@query("SELECT user_id AS account, max(event_id) AS id, arg_max(event_type, (ts, event_id)) AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id")
def latest_runs(s, d):
    runs = fx.read(s, d, "events").select(F.col("user_id").alias("account"), "ts", F.col("event_id").alias("id"), F.col("event_type").alias("status"))
    return ingest.latest(runs, ["account"], "ts", "id").select("account", "id", "status")


# -- labels and series --------------------------------------------------------------------------------------------


def _short(v: str) -> str:
    return f"CASE WHEN abs({v} - round({v})) < 1e-9 THEN round({v})::BIGINT::VARCHAR ELSE regexp_replace(CASE WHEN abs({v}) >= 1 THEN printf('%.2f', {v}) ELSE printf('%.4f', {v}) END, '\\.?0+$', '') END"


@query(f"SELECT l_orderkey, l_linenumber, {_short('v')} AS short, CASE WHEN v > 0 THEN '+' WHEN v = 0 THEN '±' ELSE '' END || {_short('v')} AS signed FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN l_extendedprice - 30000 ELSE l_discount - 0.05 END AS v FROM lineitem)")
def number_texts(s, d):
    n = F.col("l_linenumber") % 3
    v = F.when(n == 0, F.col("l_quantity")).when(n == 1, F.col("l_extendedprice") - 30000).otherwise(F.col("l_discount") - 0.05)
    rows = fx.read(s, d, "lineitem").select("l_orderkey", "l_linenumber", v.alias("v"))
    return rows.select("l_orderkey", "l_linenumber", labels.short_number(F.col("v")).alias("short"), labels.signed_number(F.col("v")).alias("signed"))


@query("SELECT o_orderkey, ['dangerRate', 'earnedUdemaePoint', 'jobRate', 'power'][o_orderkey % 4 + 1] AS metric, o_orderkey % 4 = 0 OR o_orderkey % 7 = 0 AS ratio, o_orderkey % 4 = 1 OR o_orderkey % 5 = 0 AS hidden FROM orders")
def series_flags(s, d):
    k = F.col("o_orderkey")
    series = F.concat(F.lit("g|R|"), F.when(k % 5 == 0, "derived_judgement.").otherwise("a.b."), F.element_at(F.array(*map(F.lit, ("dangerRate", "earnedUdemaePoint", "jobRate", "power"))), (k % 4 + 1).cast("int")))
    label = F.when(k % 7 == 0, "キケン度x").when(k % 3 == 0, "L")
    return fx.read(s, d, "orders").select("o_orderkey", labels.metric_key(series).alias("metric"), labels.is_ratio(series, label).alias("ratio"), labels.is_hidden(series, label).alias("hidden"))


@query(f"""WITH p AS (SELECT 'u' || user_id AS account, event_type, ts, event_id, (event_id % 41)::DOUBLE / CASE WHEN event_type = 'view' THEN 100 ELSE 1 END AS value FROM events WHERE event_type <> 'error'),
r AS (SELECT *, row_number() OVER (PARTITION BY account, event_type ORDER BY ts DESC, event_id DESC) AS n FROM p),
g AS (SELECT account, event_type, count(*) AS n, max(CASE WHEN n = 1 THEN value END) AS a, max(CASE WHEN n = 1 THEN value END) - max(CASE WHEN n = 2 THEN value END) AS d, min(value) AS lo, max(value) AS hi FROM r GROUP BY ALL),
h AS (SELECT account, event_type, n, CASE WHEN event_type = 'view' THEN '%' ELSE '' END AS u, CASE WHEN event_type = 'view' THEN 100 ELSE 1 END AS f, a, d, lo, hi FROM g)
SELECT account, event_type AS rule_raw, n AS count, {_short('a * f')} || u AS latest, coalesce(CASE WHEN d * f > 0 THEN '+' WHEN d = 0 THEN '±' ELSE '' END || {_short('d * f')} || u, '—') AS change, {_short('lo * f')} || u AS least, {_short('hi * f')} || u AS most FROM h""")
def display_stats(s, d):
    t = F.col("event_type")
    metric = F.when(t == "view", "dangerRate").when(t == "error", "earnedUdemaePoint").otherwise("jobScore")
    value = (F.col("event_id") % 41).cast("double") / F.when(t == "view", 100).otherwise(1)
    p = fx.read(s, d, "events").select(F.concat(F.lit("u"), "user_id").alias("account"), F.concat(F.lit("g|"), t, F.lit("|"), metric).alias("series_id"), metric.alias("label"), F.lit("g").alias("genre"), t.alias("rule_raw"), F.lit("api").alias("source"), F.lit("primary").alias("priority"), F.col("ts").cast("string").alias("played_time"), F.col("event_id").alias("match_key"), value.alias("value"))
    return rates.display_stats(p).select("account", "rule_raw", "count", "latest", "change", "least", "most")


@query("""SELECT 'u' || user_id AS account, 'w' || user_id AS weapon_id, unnest(CASE WHEN event_id % 2 = 0 THEN ['vibes', 'weaponPower'] ELSE ['vibes'] END) AS metric, unnest(CASE WHEN event_id % 2 = 0 THEN [event_id::DOUBLE, event_id + 0.5] ELSE [event_id::DOUBLE] END) AS value, 'f' || event_id AS event_id FROM events WHERE event_type <> 'error'""")
def weapon_snapshots(s, d):
    k = F.col("event_id")
    stats = F.struct(k.alias("vibes"), (k % 3 == 0).alias("maxWeaponPower"), F.struct(F.when(k % 2 == 0, k + 0.5).alias("weaponPower")).alias("currentWeaponPowerOrder"))
    node = F.struct(F.concat(F.lit("w"), "user_id").alias("id"), stats.alias("stats"))
    text = F.to_json(F.struct(F.struct(F.struct(F.array(node).alias("nodes")).alias("weaponRecords")).alias("data")))
    e = fx.read(s, d, "events")
    r = e.select(k.alias("id"), F.concat(F.lit("u"), "user_id").alias("account"), F.when(F.col("event_type") == "error", "{").otherwise(text).alias("json_text"))
    return rates.weapon_snapshots(r, e.select(k.alias("response_id"), F.concat(F.lit("f"), k).alias("event_id"), "ts").withColumnRenamed("ts", "fetched_at")).select("account", "weapon_id", "metric", "value", "event_id")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS expired, page_id % 5 IN (0, 1) AS allowed FROM pages")
def signed_urls(s, d):
    k = F.col("page_id")
    host = F.element_at(F.array(*map(F.lit, ("https://good.example", "https://a.good.example:443", "http://good.example", "https://good.example:8443", "https://notgood.example"))), (k % 5 + 1).cast("int"))
    ask = F.element_at(F.array(*map(F.lit, ("?Expires=1000", "?Expires=9999999999", "?X-Goog-Date=20200101T000000Z&X-Goog-Expires=60", "?x=1"))), (k % 4 + 1).cast("int"))
    url = F.concat(host, F.lit("/i"), k.cast("string"), ask)
    return fx.read(s, d, "pages").select("page_id", evidence.signed_url_expired(url, F.lit("2026-01-01 00:00:00").cast("timestamp")).alias("expired"), evidence.host_allowed(url, ("good.example",)).alias("allowed"))
