"""Queries of the match archive over the benchmark tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, labels
from ..operators import classify, details, evidence, rates, records, views
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query by its name, and its SQL (the fixture tables are common table expressions)."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {fx.SQL} {sql}"
        return f

    return put


def _details(s: SparkSession, d: str) -> DataFrame:
    return details.match_details(fx.matches(s, d), fx.documents(s, d))


def _classes(s: SparkSession, d: str) -> DataFrame:
    return details.classified(fx.matches(s, d), fx.documents(s, d))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return details.classified(fx.matches(s, d), fx.documents(s, d), classify.SHOWN)


@query("SELECT account, rule_raw, 'n_' || rule_raw AS rule_name, count(*) AS matches, count(CASE WHEN judgement = 'WIN' THEN 1 END) AS wins, count(CASE WHEN judgement = 'LOSE' THEN 1 END) AS losses, count(CASE WHEN judgement = 'DRAW' THEN 1 END) AS draws, count(CASE WHEN judgement IS NULL THEN 1 END) AS other FROM cs WHERE analysis_set = 'bankara_open' GROUP BY ALL")
def by_rule(s, d):
    return views.by_rule(views.population_of(_classified(s, d), "bankara_open"))


@query("SELECT account, analysis_set, rule_raw, 'n_' || rule_raw AS rule_name, count(*) AS matches, count(CASE WHEN judgement = 'WIN' THEN 1 END) AS wins, count(CASE WHEN judgement = 'LOSE' THEN 1 END) AS losses, count(CASE WHEN judgement = 'DRAW' THEN 1 END) AS draws, count(CASE WHEN judgement IS NULL THEN 1 END) AS other FROM cs WHERE analysis_set <> 'hold' GROUP BY ALL")
def rule_results(s, d):
    p = views.population_of(_classified(s, d), *classify.PUBLIC_SETS, *classify.PRIVATE_SETS)
    return p.groupBy("account", "analysis_set", "rule_raw", "rule_name").agg(F.count("*").alias("matches"), *[F.count_if(F.col("judgement") == j).alias(n) for j, n in (("WIN", "wins"), ("LOSE", "losses"), ("DRAW", "draws"))], F.count_if(F.col("judgement").isNull()).alias("other"))


@query("SELECT account, match_key, analysis_set, rule_raw, played AS played_time, judgement FROM cs WHERE analysis_set = 'xmatch'")
def population_view(s, d):
    return views.population(_details(s, d), _classes(s, d), "xmatch").select("account", "match_key", "analysis_set", "rule_raw", "played_time", "judgement")


@query("SELECT cs.account, cs.match_key, tag, note FROM cs LEFT JOIN tg USING (account, match_key) WHERE analysis_set = 'private_other'")
def population_tagged(s, d):
    return views.tagged(views.population_of(_classified(s, d), "private_other"), fx.tags(s, d)).select("account", "match_key", "tag", "note")


@query("SELECT account, match_key, mode AS mode_raw, bankara AS bankara_mode, rule_raw, 'n_' || rule_raw AS rule_name, genre, roster_class, analysis_set, 2::BIGINT AS team_count, mine::BIGINT AS my_player_count, others::BIGINT AS opponents FROM cs")
def classify_matches(s, d):
    return _classes(s, d).select("account", "match_key", "mode_raw", "bankara_mode", "rule_raw", "rule_name", "genre", "roster_class", "analysis_set", F.col("team_count").cast("long").alias("team_count"), F.col("my_player_count").cast("long").alias("my_player_count"), F.col("opponent_counts")[0].cast("long").alias("opponents"))


@query("SELECT rule AS rule_raw, CASE rule WHEN 'REGULAR' THEN 'salmon_regular' ELSE lower(rule) END AS analysis_set, 'not_applicable' AS roster_class, count(*) AS n FROM co GROUP BY ALL")
def classify_coop(s, d):
    return classify.classify(fx.coop_details(s, d)).groupBy("rule_raw", "analysis_set", "roster_class").agg(F.count("*").alias("n"))


@query("SELECT account, 'vs' AS kind, match_key, first_seen, last_seen, k AS detail_response_id FROM o WHERE has_detail")
def details_join(s, d):
    return _details(s, d).drop("json_text")


@query("SELECT account, match_key, k AS detail_response_id, played AS played_time, mode, 'n_' || rule_raw AS rule, 'stage' || (k % 6) AS stage, judgement, k % 300 AS duration, NULL::VARCHAR AS knockout, genre, roster_class, analysis_set FROM cs")
def battles(s, d):
    return details.battles(_details(s, d)).drop("json_text")


@query("SELECT account, match_key, t AS team_index, 1 - t AS is_my_team, CASE t WHEN 0 THEN mine ELSE others END AS players FROM cs, (SELECT unnest([0, 1]) AS t)")
def battle_teams(s, d):
    t = details.battle_teams(_details(s, d))
    return t.select("account", "match_key", "team_index", "is_my_team", F.size(jsonx.elements(jsonx.parsed("json_text"), "$.players")).cast("long").alias("players"))


@query("SELECT account, match_key, team_index, player_index, 'p' || l_partkey AS player_id, 's' || l_suppkey AS name, (l_linenumber = 1)::BIGINT AS is_myself, 'w' || (l_suppkey % 10) AS weapon, l_quantity::BIGINT AS paint, l_partkey % 9 AS kills, l_linenumber::BIGINT AS assists FROM pl")
def battle_players(s, d):
    return details.players_of(_details(s, d), texts=False).select("account", "match_key", "team_index", "player_index", "player_id", "name", "is_myself", "weapon", "paint", "kills", "assists")


@query("""SELECT account, match_key, team_index, player_index, slot, '{"name":"' || l_returnflag || '"}' AS json_text FROM pl, (SELECT unnest(['headGear', 'clothingGear', 'shoesGear']) AS slot)
WHERE (slot = 'headGear' AND l_returnflag = 'R') OR (slot = 'clothingGear' AND l_returnflag = 'A') OR (slot = 'shoesGear' AND l_linenumber > 3)""")
def battle_gear(s, d):
    return details.battle_gear(details.players_of(_details(s, d)))


@query("""SELECT account, match_key, player_index AS award_index, '{"name":"s' || l_suppkey || '"}' AS json_text FROM pl WHERE team_index = 0""")
def battle_awards(s, d):
    return details.battle_awards(_details(s, d))


@query("SELECT account, match_key, event_id AS detail_response_id, played_time, 'stage' || (n % 3) AS stage, rule, value AS danger_rate, (n % 4)::BIGINT AS result_wave FROM co")
def salmon_runs(s, d):
    return details.salmon_runs(fx.coop_details(s, d)).drop("json_text")


@query("""SELECT account, match_key, i AS player_index, (i = 0)::INTEGER AS is_myself, '{"goldenDeliverCount":' || (n + i) || '}' AS json_text FROM co, (SELECT unnest([0, 1, 2]) AS i)""")
def salmon_players(s, d):
    return details.salmon_players(fx.coop_details(s, d))


@query("""SELECT account, match_key, i AS wave_index, '{"teamDeliverCount":' || (n + i) || '}' AS json_text FROM co, (SELECT unnest([0, 1]) AS i)""")
def salmon_waves(s, d):
    return details.salmon_waves(fx.coop_details(s, d))


@query("""SELECT account, match_key, i AS boss_index, '{"n":' || (i + 1) || '}' AS json_text FROM co, (SELECT unnest([0, 1, 2]) AS i) WHERE i <= n % 3""")
def salmon_bosses(s, d):
    return details.salmon_bosses(fx.coop_details(s, d))


@query("""SELECT account, match_key, g || '|' || rule || '|' || m AS series_id, CASE m WHEN 'dangerRate' THEN 'キケン度' ELSE '集めた金イクラ' END AS label, v::DOUBLE AS value, 'primary' AS priority FROM
(SELECT account, match_key, rule, CASE rule WHEN 'REGULAR' THEN 'salmon_regular' ELSE lower(rule) END AS g, unnest(['dangerRate', 'myResult.goldenDeliverCount', 'waveResults.teamDeliverCountSum']) AS m, unnest([value, n::DOUBLE, (2 * n + 1)::DOUBLE]) AS v FROM co)""")
def rate_observations(s, d):
    x = classify.classify(fx.coop_details(s, d), keep=("json_text",), also={"played_time": classify.SHOWN["played_time"]})
    return rates.observations(x).select("account", "match_key", "series_id", "label", "value", "priority")


_SERIES = """x AS (SELECT user_id, event_type, ts, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events WHERE value IS NOT NULL)
SELECT user_id, event_type, count(*) AS count, max(CASE WHEN r = 1 THEN value END) AS latest, max(CASE WHEN r = 2 THEN value END) AS previous,
max(CASE WHEN r = 1 THEN value END) - max(CASE WHEN r = 2 THEN value END) AS delta, min(value) AS min, max(value) AS max FROM x GROUP BY user_id, event_type"""


@query("")
def series_summary(s, d):
    return rates.series_summary(fx.read(s, d, "events"), ["user_id", "event_type"], "ts", "event_id")


SQL["series_summary"] = f"WITH {_SERIES}"


@query()
def streaks(s, d):
    return rates.streaks(fx.read(s, d, "events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type", ["purchase", "signup"], ["error"]).select("event_id", "user_id", "streak")


SQL["streaks"] = """WITH a AS (SELECT event_id, user_id, ts, CASE WHEN event_type IN ('purchase', 'signup') THEN 1 WHEN event_type = 'error' THEN -1 ELSE 0 END AS s FROM events),
b AS (SELECT *, CASE WHEN s IS DISTINCT FROM lag(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 1 ELSE 0 END AS n FROM a),
c AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM b)
SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) * s)::BIGINT AS streak FROM c"""


@query()
def history_gap(s, d):
    days = fx.read(s, d, "events").select("event_type", F.to_date("ts").alias("day"), "user_id")
    return rates.history_gaps_of_rows(days, ["event_type"], "day", "user_id").select("event_type", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("members").alias("users"), "possible_gap")


SQL["history_gap"] = """WITH a AS (SELECT event_type, ts::DATE AS day, list(DISTINCT user_id) AS u FROM events GROUP BY ALL),
b AS (SELECT *, lag(u) OVER (PARTITION BY event_type ORDER BY day) AS p FROM a)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, len(u)::BIGINT AS users, coalesce(NOT list_has_any(p, u), FALSE) AS possible_gap FROM b"""


@query("SELECT 'u' || user_id AS account, event_type AS match_key, min(ts)::VARCHAR AS first_observed_at, max(ts + CASE WHEN event_id % 3 = 0 THEN INTERVAL 5 DAY ELSE INTERVAL 0 DAY END)::VARCHAR AS last_observed_at, count(DISTINCT event_id) AS observing_responses FROM events GROUP BY user_id, event_type")
def observations(s, d):
    e = fx.read(s, d, "events")
    text = lambda c: c.cast("string")
    sightings = e.select(F.col("event_id").alias("response_id"), F.concat(F.lit("u"), "user_id").alias("account"), F.lit("vs").alias("kind"), F.col("event_type").alias("match_key"))
    fetches = e.where("event_id % 3 = 0").select(F.col("event_id").alias("response_id"), text(F.col("ts") + F.expr("interval 5 day")).alias("fetched_at"))
    return views.match_observations(sightings, e.select(F.col("event_id").alias("id"), text(F.col("ts")).alias("fetched_at")), fetches).drop("kind")


@query("SELECT account, match_key, CASE WHEN has_detail THEN 'available' WHEN k % 4 IN (0, 2) THEN 'pending' WHEN k % 4 = 1 THEN 'unavailable' ELSE 'unresolved' END AS detail_state FROM o")
def detail_state(s, d):
    return views.detail_states(fx.matches(s, d), fx.jobs(s, d)).select("account", "match_key", "detail_state")


@query("SELECT account, match_key FROM o WHERE NOT has_detail AND k % 4 IN (0, 2)")
def pending_details(s, d):
    return views.pending_details(fx.matches(s, d), fx.jobs(s, d)).select("account", "match_key")


@query("SELECT account, match_key FROM o WHERE NOT has_detail AND k % 4 = 1")
def unavailable_details(s, d):
    return views.unavailable_details(fx.matches(s, d), fx.jobs(s, d)).select("account", "match_key")


def _search(s: SparkSession, d: str, **ask):
    want = records.Search(account="BUILDING", **ask)
    return records.search(records.indexed(fx.matches(s, d), fx.documents(s, d)), want, None, fx.tags(s, d)), want


_W = "wp AS (SELECT DISTINCT k, 'w' || (l_suppkey % 10) AS weapon FROM pl WHERE l_linenumber = 1)"


@query(f", {_W} SELECT match_key, analysis_set, rule_raw, played AS played_time FROM cs WHERE account = 'BUILDING' AND rule_raw = 'LOFT' AND played >= '1996' AND played <= '1999' AND k IN (SELECT k FROM wp WHERE weapon = 'w3')")
def search_filtered(s, d):
    return _search(s, d, rule_raw="LOFT", played_from="1996", played_to="1999", weapon="w3")[0].select("match_key", "analysis_set", "rule_raw", "played_time")


@query(f", {_W} SELECT o.match_key FROM o LEFT JOIN cs USING (k) WHERE o.account = 'BUILDING' AND (contains(o.match_key, '77') OR contains(coalesce('stage' || (cs.k % 6), ''), '77') OR o.match_key IN (SELECT match_key FROM tg WHERE contains(tag, '77')) OR o.k IN (SELECT k FROM wp WHERE contains(weapon, '77')))")
def search_text(s, d):
    return _search(s, d, query="77")[0].select("match_key")


@query("SELECT match_key FROM o WHERE account = 'BUILDING' AND match_key IN (SELECT match_key FROM tg WHERE tag = 'x')")
def search_tagged(s, d):
    return _search(s, d, tag="x")[0].select("match_key")


@query("SELECT match_key FROM o WHERE account = 'BUILDING' AND NOT has_detail")
def search_unclassified(s, d):
    return _search(s, d, analysis_set="unclassified")[0].select("match_key")


@query("SELECT match_key FROM cs WHERE account = 'BUILDING' AND analysis_set = 'xmatch' ORDER BY match_key LIMIT 20 OFFSET 40")
def search_page(s, d):
    return records.page(*_search(s, d, analysis_set="xmatch", limit=20, offset=40)).select("match_key")


@query("SELECT count(*) AS total FROM cs WHERE account = 'BUILDING' AND analysis_set = 'xmatch'")
def search_total(s, d):
    return records.total(_search(s, d, analysis_set="xmatch")[0])


@query(f", {_W}, f AS (SELECT DISTINCT 'analysis_set' AS facet, analysis_set AS value FROM cs WHERE account = 'BUILDING' UNION SELECT 'rule_raw', rule_raw FROM cs WHERE account = 'BUILDING' UNION SELECT 'weapon', weapon FROM wp JOIN o USING (k) WHERE account = 'BUILDING' UNION SELECT 'tag', tag FROM tg WHERE account = 'BUILDING') SELECT facet, value FROM f")
def facets(s, d):
    own = details.players_of(_details(s, d), texts=False).where("is_myself = 1").select("account", "match_key", "weapon")
    return records.facets(_classes(s, d), own, fx.tags(s, d), "BUILDING").select("facet", "value")


@query("""SELECT s.v AS analysis_set, count(cs.k) AS total, count(CASE WHEN cs.k IS NOT NULL AND t.match_key IS NULL THEN 1 END) AS untagged, coalesce((SELECT string_agg(tag || '=' || n, ',' ORDER BY tag) FROM (SELECT tag, count(*) AS n FROM cs c2 JOIN tg ON tg.match_key = c2.match_key AND tg.account = c2.account WHERE c2.analysis_set = s.v GROUP BY tag)), '') AS tags
FROM (SELECT unnest(['nawabari', 'xmatch', 'private_other', 'fest']) AS v) s LEFT JOIN cs ON cs.analysis_set = s.v LEFT JOIN (SELECT DISTINCT account, match_key FROM tg) t ON t.account = cs.account AND t.match_key = cs.match_key GROUP BY s.v""")
def tag_summary(s, d):
    sets = s.createDataFrame([(x,) for x in ("nawabari", "xmatch", "private_other", "fest")], "analysis_set string")
    return records.tag_summary(sets, _classes(s, d), fx.tags(s, d)).withColumn("tags", F.array_join(F.transform("tags", lambda t: F.concat(t["tag"], F.lit("="), t["n"].cast("string"))), ","))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, (json_type(props) = 'OBJECT') AS object FROM events")
def json_fields(s, d):
    v = jsonx.parsed("props")
    return fx.read(s, d, "events").select("event_id", jsonx.integer(v, "$.k").alias("k"), jsonx.is_object(v).alias("object"))


@query("SELECT event_id, unnest([0, 1])::BIGINT AS ordinal, unnest(['$', '$.k']) AS path, unnest(['object', 'integer']) AS type, unnest([NULL, json_extract_string(props, '$.k')]) AS atom FROM events")
def json_walk(s, d):
    return jsonx.all_fields(fx.read(s, d, "events"), "event_id", "props")


@query("SELECT genre, count(*) AS n, CASE genre WHEN 'bankara_open' THEN 3 WHEN 'bankara_challenge' THEN 2 WHEN 'xmatch' THEN 4 WHEN 'nawabari' THEN 1 WHEN 'private' THEN 6 ELSE 17 END::DOUBLE AS place, CASE genre WHEN 'bankara_open' THEN 'バンカラマッチ（オープン）' WHEN 'bankara_challenge' THEN 'バンカラマッチ（チャレンジ）' WHEN 'xmatch' THEN 'Xマッチ' WHEN 'nawabari' THEN 'レギュラーマッチ' WHEN 'private' THEN 'プライベートマッチ' ELSE '未対応のジャンル（' || genre || '）' END AS label FROM cs GROUP BY genre")
def display_labels(s, d):
    g = F.col("genre")
    return _classes(s, d).groupBy(g).agg(F.count("*").alias("n")).select(g, "n", labels.genre_order(g).alias("place"), labels.genre_label(g).alias("label"))


@query()
def url_address(s, d):
    a = evidence.url_address(F.col("url"))
    return fx.read(s, d, "pages").select("page_id", a["scheme"].alias("scheme"), a["host"].alias("host"), a["port"].alias("port"), a["path"].alias("path"))


SQL["url_address"] = r"SELECT page_id, regexp_extract(url, '^(\w+):', 1) AS scheme, regexp_extract(url, '://([^/?#]+)', 1) AS host, CASE WHEN url LIKE 'https%' THEN 443 ELSE 80 END AS port, regexp_extract(url, '://[^/?#]+([^?#]*)', 1) AS path FROM pages"


def _assets(s: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    state = F.when(k % 5 == 0, "done").when(k % 5 == 1, "expired").when(k % 5 == 2, "pending").when(k % 5 == 3, "retry").otherwise("strange")
    return fx.read(s, d, "pages").select(F.regexp_replace("url", r"/\d+", "/9").alias("url"), state.alias("state"), F.when(k % 10 == 0, k.cast("string")).alias("body_sha256"))


@query()
def asset_evidence(s, d):
    bodies = fx.read(s, d, "pages").select(F.col("page_id").cast("string").alias("sha256"))
    return evidence.asset_evidence(_assets(s, d), bodies)


SQL["asset_evidence"] = r"""WITH a AS (SELECT page_id, page_id % 5 AS r, page_id % 10 = 0 AS stored, regexp_replace(regexp_replace(url, '/\d+', '/9'), '[?#].*', '') AS u FROM pages),
g AS (SELECT DISTINCT u FROM a WHERE r = 1), k AS (SELECT DISTINCT u FROM a WHERE r = 0 AND stored)
SELECT count_if(r = 0)::BIGINT AS done_assets, count_if(r = 2)::BIGINT AS pending_assets, count_if(r = 3)::BIGINT AS retry_assets, count_if(r = 1)::BIGINT AS expired_assets, count_if(r = 4)::BIGINT AS other_assets,
count_if(r = 0 AND stored)::BIGINT AS done_with_body, 0::BIGINT AS without_address, (SELECT count(*) FROM g) AS expired_addresses, (SELECT count(*) FROM g WHERE u IN (SELECT u FROM k)) AS expired_but_stored FROM a"""


def _event_responses(s: SparkSession, d: str) -> DataFrame:
    """Events as responses: signups are festivals, purchases big runs, errors contests, clicks broken, views not usable."""
    e = fx.read(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    t, k = F.col("event_type"), F.col("k")
    fest = F.to_json(F.struct(F.struct(F.struct(F.concat(F.lit("f"), k % 20).alias("id"), F.when(k % 3 == 0, F.struct(k.alias("n"))).alias("playerResult")).alias("fest")).alias("data")))
    edge = F.struct(F.struct(F.struct(F.when(k % 10 != 0, F.concat(F.lit("s"), k % 4)).alias("id")).alias("coopStage"), F.lit("a").alias("startTime"), F.lit("b").alias("endTime"), (k % 7).alias("highestJobScore")).alias("node"))
    big = F.to_json(F.struct(F.struct(F.struct(F.struct(F.struct(F.array(edge).alias("edges")).alias("records")).alias("bigRunRecord")).alias("coopRecord")).alias("data")))
    team = F.to_json(F.struct(F.struct(F.struct(F.struct(k.alias("attend")).alias("teamContestRecord")).alias("coopRecord")).alias("data")))
    text = F.when(t == "signup", fest).when(t == "purchase", big).when(t == "error", team).when(t == "click", F.lit("{")).otherwise(F.lit('{"data":null}'))
    return e.select(F.concat(F.lit("u"), F.col("user_id") % 5).alias("account"), F.when(t == "signup", "DetailFestQuery").otherwise("CoopRecordQuery").alias("operation"), F.when(F.col("event_id") % 4 == 0, 500).otherwise(200).alias("http_status"), F.lit(1).alias("projected"), text.alias("json_text"))


@query()
def event_evidence(s, d):
    return evidence.event_evidence(_event_responses(s, d))


SQL["event_evidence"] = """WITH e AS (SELECT user_id % 5 AS a, event_type AS t, json_extract_string(props, '$.k')::INTEGER AS k FROM events WHERE event_id % 4 <> 0),
f AS (SELECT a, k % 20 AS i, bool_or(k % 3 = 0) AS p FROM e WHERE t = 'signup' GROUP BY ALL), b AS (SELECT a, k % 4 AS s, bool_or(k % 7 > 0) AS p FROM e WHERE t = 'purchase' AND k % 10 <> 0 GROUP BY ALL)
SELECT (SELECT count(*) FROM f) AS fest_event_details, (SELECT count_if(p) FROM f)::BIGINT AS fest_events_with_player_result, (SELECT count(*) FROM b) AS big_run_event_records, (SELECT count_if(p) FROM b)::BIGINT AS big_run_events_with_positive_highest_job_score,
(SELECT max(k) FROM e WHERE t = 'error')::BIGINT AS team_contest_max_observed_attend, (SELECT count(*) FROM e WHERE t IN ('click', 'view') OR (t = 'purchase' AND k % 10 = 0)) AS unusable_event_responses_or_rows"""


@query()
def dedupe_detail(s, d):
    c = fx.read(s, d, "conversations").select("conv_id", "turn", "role")
    return evidence.duplicate_responses(c, ["conv_id", "role"], ["turn"], F.col("turn") > 0).select("conv_id", "turn", "role", "copies", "keep")


SQL["dedupe_detail"] = "SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id, role) AS copies, row_number() OVER (PARTITION BY conv_id, role ORDER BY (NOT turn > 0)::INT, turn) = 1 AS keep FROM conversations"
