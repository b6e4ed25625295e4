"""Archive-shaped tables made from the benchmark tables, so that every operator can run on them.

An order is a match of its customer's segment (the account), its lines the players; an
event is a cooperative run of its user; documents are bodies, pages are assets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = ("AREA", "LOFT", "GOAL", "CLAM")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _iso(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """k, account, match_key, mode, bankara, rule_raw, judgement, played, has_detail."""
    o = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("account")), "o_custkey")
    k, p = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    mode = F.when(p.isin("1", "2"), "BANKARA").when(p == "3", "PRIVATE").when(p == "4", "X_MATCH").when(k % 3 == 0, "BANKARA").otherwise("REGULAR")
    played = F.when(k % 11 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(_iso(F.col("o_orderdate")))
    return o.select(
        k.alias("k"), "account", F.concat(F.lit("m"), k.cast("string")).alias("match_key"), mode.alias("mode"), F.when(p == "1", "OPEN").when(p == "2", "CHALLENGE").alias("bankara"),
        F.element_at(F.array(*map(F.lit, RULES)), (k % 4 + 1).cast("int")).alias("rule_raw"),
        F.when(F.col("o_orderstatus") == "F", "WIN").when(F.col("o_orderstatus") == "O", "LOSE").when(k % 2 == 0, "DRAW").alias("judgement"),
        played.alias("played"), (k % 5 != 0).alias("has_detail"), "o_orderdate",
    )


def matches(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("account", F.lit("vs").alias("kind"), "match_key", _iso(F.col("o_orderdate")).alias("first_seen"), _iso(F.col("o_orderdate") + F.expr("interval 1 day")).alias("last_seen"), F.when(F.col("has_detail"), F.col("k")).alias("detail_response_id"))


def documents(spark: SparkSession, d: str) -> DataFrame:
    """Detail documents as JSON text: odd lines are the own team, even ones the other."""
    n = F.col("l_linenumber")
    gear = F.struct(F.col("l_returnflag").alias("name"))
    player = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
        F.struct(
            F.concat(F.lit("p"), F.col("l_partkey")).alias("id"), F.concat(F.lit("s"), F.col("l_suppkey")).alias("name"), (n == 1).alias("isMyself"),
            F.struct(F.concat(F.lit("w"), F.col("l_suppkey") % 10).alias("name")).alias("weapon"), F.col("l_quantity").cast("int").alias("paint"),
            F.struct((F.col("l_partkey") % 9).alias("kill"), n.alias("assist")).alias("result"),
            F.when(F.col("l_returnflag") == "R", gear).alias("headGear"), F.when(F.col("l_returnflag") == "A", gear).alias("clothingGear"), F.when(n > 3, gear).alias("shoesGear"),
        ).alias("p"),
    )
    lines = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(player)).alias("lines"))
    side = lambda odd: F.transform(F.filter(F.coalesce("lines", F.array().cast(lines.schema["lines"].dataType)), lambda x: x["l_linenumber"] % 2 == odd), lambda x: x["p"])
    o = orders(spark, d).where("has_detail").join(lines, "k", "left")
    doc = F.struct(
        F.struct(F.col("mode").alias("mode")).alias("vsMode"), F.when(F.col("bankara").isNotNull(), F.struct(F.col("bankara").alias("mode"))).alias("bankaraMatch"),
        F.struct(F.col("rule_raw").alias("rule"), F.concat(F.lit("n_"), "rule_raw").alias("name")).alias("vsRule"), F.struct(F.concat(F.lit("stage"), F.col("k") % 6).alias("name")).alias("vsStage"),
        "judgement", F.col("played").alias("playedTime"), (F.col("k") % 300).alias("duration"),
        F.struct(side(1).alias("players")).alias("myTeam"), F.array(F.struct(side(0).alias("players"))).alias("otherTeams"),
        F.transform(side(1), lambda p: F.struct(p["name"].alias("name"))).alias("awards"),
    )
    return o.select(F.col("k").alias("response_id"), "account", F.lit("vs").alias("kind"), "match_key", F.to_json(doc).alias("json_text"))


def coop_details(spark: SparkSession, d: str) -> DataFrame:
    """An event as a cooperative run; k comes from its JSON properties."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", "ts", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    rule = F.when(F.col("event_type") == "purchase", "BIG_RUN").when(F.col("event_type") == "error", "TEAM_CONTEST").otherwise("REGULAR")
    gold = lambda c: F.struct(c.alias("goldenDeliverCount"))
    doc = F.struct(
        rule.alias("rule"), _iso(F.col("ts")).alias("playedTime"), F.col("value").alias("dangerRate"), (F.col("k") % 4).alias("resultWave"), F.struct(F.concat(F.lit("stage"), F.col("k") % 3).alias("name")).alias("coopStage"),
        gold(F.col("k")).alias("myResult"), F.array(gold(F.col("k") + 1), gold(F.col("k") + 2)).alias("memberResults"),
        F.transform(F.array("k", F.col("k") + 1), lambda x: F.struct(x.alias("teamDeliverCount"))).alias("waveResults"), F.transform(F.sequence(F.lit(1), F.col("k") % 3 + 1), lambda i: F.struct(i.alias("n"))).alias("enemyResults"),
    )
    return e.select(F.concat(F.lit("u"), "user_id").alias("account"), F.lit("coop").alias("kind"), F.concat(F.lit("e"), "event_id").alias("match_key"), F.col("event_id").alias("detail_response_id"), F.to_json(doc).alias("json_text"))


def tags(spark: SparkSession, d: str) -> DataFrame:
    o = orders(spark, d).where("k % 7 = 0")
    names = F.when(F.col("k") % 14 == 0, F.array(F.concat(F.lit("t"), F.col("k") % 3), F.lit("x"))).otherwise(F.array(F.concat(F.lit("t"), F.col("k") % 3)))
    return o.select("account", "match_key", F.explode(names).alias("tag"), F.concat(F.lit("n"), F.col("k") % 2).alias("note"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs of the matches without a detail: pending, unavailable, both or none, by the order's number."""
    o = orders(spark, d).where("not has_detail")
    states = F.when(F.col("k") % 4 == 0, F.array(F.lit("pending"))).when(F.col("k") % 4 == 1, F.array(F.lit("unavailable"))).when(F.col("k") % 4 == 2, F.array(F.lit("unavailable"), F.lit("retry"))).otherwise(F.array().cast("array<string>"))
    return o.select("account", "match_key", "k", F.posexplode(states).alias("i", "state"))


#: SQL of the same tables.
SQL = """
o AS (SELECT o_orderkey AS k, c_mktsegment AS account, 'm' || o_orderkey AS match_key,
      CASE WHEN o_orderpriority[1] IN ('1','2') THEN 'BANKARA' WHEN o_orderpriority[1] = '3' THEN 'PRIVATE' WHEN o_orderpriority[1] = '4' THEN 'X_MATCH' WHEN o_orderkey % 3 = 0 THEN 'BANKARA' ELSE 'REGULAR' END AS mode,
      CASE o_orderpriority[1] WHEN '1' THEN 'OPEN' WHEN '2' THEN 'CHALLENGE' END AS bankara, ['AREA','LOFT','GOAL','CLAM'][o_orderkey % 4 + 1] AS rule_raw,
      CASE WHEN o_orderstatus = 'F' THEN 'WIN' WHEN o_orderstatus = 'O' THEN 'LOSE' WHEN o_orderkey % 2 = 0 THEN 'DRAW' END AS judgement,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'Z' END AS played, o_orderkey % 5 <> 0 AS has_detail, o_orderdate,
      strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%dT%H:%M:%SZ') AS last_seen
      FROM orders JOIN customer ON c_custkey = o_custkey),
pl AS (SELECT l_orderkey AS k, account, match_key, 1 - l_linenumber % 2 AS team_index, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS player_index,
       l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM lineitem JOIN o ON o.k = l_orderkey WHERE has_detail),
sz AS (SELECT o.k, count(CASE WHEN team_index = 0 THEN 1 END) AS mine, count(CASE WHEN team_index = 1 THEN 1 END) AS others FROM o LEFT JOIN pl ON pl.k = o.k WHERE has_detail GROUP BY o.k),
cl AS (SELECT o.*, mine, others, CASE WHEN mode = 'BANKARA' THEN CASE bankara WHEN 'OPEN' THEN 'bankara_open' WHEN 'CHALLENGE' THEN 'bankara_challenge' ELSE 'bankara_unspecified' END
               WHEN mode = 'PRIVATE' THEN 'private' WHEN mode = 'X_MATCH' THEN 'xmatch' ELSE 'nawabari' END AS genre,
       CASE WHEN mine = others AND mine BETWEEN 1 AND 4 THEN ['one_vs_one','two_vs_two','three_vs_three','four_vs_four'][mine] ELSE 'other' END AS roster_class FROM o JOIN sz ON sz.k = o.k),
cs AS (SELECT *, CASE WHEN genre = 'private' THEN 'private_' || roster_class WHEN genre = 'bankara_unspecified' THEN 'hold' ELSE genre END AS analysis_set FROM cl),
tg AS (SELECT account, match_key, unnest(CASE WHEN k % 14 = 0 THEN ['t' || (k % 3), 'x'] ELSE ['t' || (k % 3)] END) AS tag, 'n' || (k % 2) AS note FROM o WHERE k % 7 = 0),
jb AS (SELECT account, match_key, k, unnest(CASE k % 4 WHEN 0 THEN ['pending'] WHEN 1 THEN ['unavailable'] WHEN 2 THEN ['unavailable', 'retry'] ELSE [] END) AS state FROM o WHERE NOT has_detail),
co AS (SELECT 'u' || user_id AS account, 'e' || event_id AS match_key, event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS played_time, value,
       CASE event_type WHEN 'purchase' THEN 'BIG_RUN' WHEN 'error' THEN 'TEAM_CONTEST' ELSE 'REGULAR' END AS rule, json_extract_string(props, '$.k')::INTEGER AS n FROM events)
"""
