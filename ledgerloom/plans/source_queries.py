"""Queries of sources, exports and ready answers over the benchmark tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsonx, paths
from ..operators import layout, lossless
from ..sources import envelopes, parts, shared, sheets
from . import fixtures as fx
from . import recipes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str, base: bool = False):
    """Registers a query by its name, and its SQL; with ``base`` the fixture tables stand before it."""

    def put(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"WITH {fx.SQL} {sql}" if base else sql
        return f

    return put


@query("""SELECT event_id, CASE WHEN event_id % 50 = 7 THEN NULL ELSE '{"B":"' || event_type || '","a":[1,2.5,null,true],"u":{"x":"é","z":' || user_id || '}}' END AS canonical FROM events""")
def canonical_texts(s, d):
    messy = F.concat(F.lit('{ "u" : {"z":'), F.col("user_id"), F.lit(',\n "x": "\\u00e9"}, "a":[1, 2.50,null ,true], "B": "'), F.col("event_type"), F.when(F.col("event_id") % 50 == 7, F.lit('"')).otherwise(F.lit('" }')))
    return fx.read(s, d, "events").select("event_id", jsonx.canonical_json(messy).alias("canonical"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 'rule_unknown' WHEN regexp_full_match(o_orderpriority, '[A-Za-z0-9_-]{1,64}') THEN o_orderpriority ELSE 'rule_' || substr(sha256(o_orderpriority), 1, 48) END AS token FROM orders")
def rule_tokens(s, d):
    raw = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderpriority"))
    return fx.read(s, d, "orders").select("o_orderkey", paths.rule_token(raw).alias("token"))


@query("SELECT o_orderkey, o_totalprice AS price, 'first' AS opened FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 1, 'latest' FROM orders WHERE o_orderkey % 3 = 0")
def opened_versions(s, d):
    o, root = fx.read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), shared.scratch(s, "versions")
    parts.publish(o.where("o_orderkey % 2 = 0"), root, 1)
    first = parts.open_version(s, root)  # what it reads does not change with the next publication
    parts.publish(o.where("o_orderkey % 3 = 0").withColumn("price", F.col("price") + 1), root, 2)
    return first.withColumn("opened", F.lit("first")).unionByName(parts.open_version(s, root).withColumn("opened", F.lit("latest")))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey BETWEEN (SELECT quantile_disc(o_orderkey, 0.25) FROM orders) AND (SELECT quantile_disc(o_orderkey, 0.5) FROM orders)")
def range_of_parts(s, d):
    o, path = fx.read(s, d, "orders").select("o_orderkey", "o_custkey"), shared.scratch(s, "parts")
    parts.write_parts(o, "o_orderkey", F.lit(16), path, 8_000)
    low, high = o.agg(F.expr("percentile_disc(0.25) within group (order by o_orderkey)"), F.expr("percentile_disc(0.5) within group (order by o_orderkey)")).first()
    return parts.read_range(s, path, "o_orderkey", low, high)


@query("SELECT sha256(text) AS sha256, any_value(strlen(text)) AS byte_length, substr(sha256(text), 1, 2) AS prefix, count(*) AS fetches FROM documents GROUP BY text")
def raw_export(s, d):
    docs, path = fx.read(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("body")).withColumn("sha256", F.sha2("body", 256)), shared.scratch(s, "export")
    bodies = docs.groupBy("sha256").agg(F.first("body").alias("body"))
    envelopes.export_raw(bodies, docs.select(F.col("doc_id").alias("id"), "sha256"), docs.select(F.col("doc_id").alias("event_id"), "sha256"), path)
    there = s.read.schema("sha256 string, body binary, prefix string").parquet(f"{path}/bodies").where(F.sha2("body", 256) == F.col("sha256"))  # bytes came back as they were
    fetched = s.read.schema("event_id long, sha256 string").json(f"{path}/fetches").groupBy("sha256").agg(F.count("*").alias("fetches"))
    return there.select("sha256", F.length("body").cast("long").alias("byte_length"), "prefix").join(fetched, "sha256")


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS line FROM nation""")
def typed_lines(s, d):
    return envelopes.typed_lines(fx.read(s, d, "nation"), 1000)[0]


@query("SELECT o_orderpriority, count(*) AS orders, max(c_acctbal) AS most FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def read_only_sql(s, d):
    tables = {t: fx.read(s, d, t) for t in ("orders", "customer")}
    return envelopes.query(s, "SELECT o_orderpriority, count(*) AS orders, max(c_acctbal) AS most FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1", tables)


_CELLS = "sha256('int:' || length(n_nationkey::VARCHAR) || ':' || n_nationkey || '|string:' || length(n_name) || ':' || n_name || '|int:' || length(n_regionkey::VARCHAR) || ':' || n_regionkey)"


@query(f"""WITH r AS (SELECT n_nationkey AS place, {_CELLS} AS h FROM nation), a AS (SELECT place // 4 AS p, sha256(string_agg(place || ':' || h, '|' ORDER BY place)) AS h FROM r GROUP BY 1),
b AS (SELECT p // 4 AS p, sha256(string_agg(p || ':' || h, '|' ORDER BY p)) AS h FROM a GROUP BY 1) SELECT (SELECT count(*) FROM nation) AS rows, sha256(string_agg(p || ':' || h, '|' ORDER BY p)) AS digest FROM b""")
def stream_digest_value(s, d):
    n = fx.read(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return lossless.stream_digest(layout.row_digests(n, "n_nationkey").repartition(5), "n_nationkey", run=4)


# -- ready answers ------------------------------------------------------------------------------------------------


def _tables(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"matches": fx.matches(s, d), "documents": fx.documents(s, d)}


@query("SELECT analysis_set, rule_raw, count(*) FILTER (WHERE judgement = 'WIN') AS wins, count(*) FILTER (WHERE judgement = 'LOSE') AS losses, count(*) FILTER (WHERE judgement = 'WIN')::DOUBLE / nullif(count(*) FILTER (WHERE judgement IN ('WIN', 'LOSE')), 0) AS win_rate FROM cs WHERE analysis_set <> 'hold' GROUP BY ALL", True)
def recipe_win_rates(s, d):
    return recipes.win_rates(_tables(s, d))


@query("SELECT account, 'w' || (l_suppkey % 10) AS weapon, count(*) AS matches, avg(l_partkey % 9) AS kills, avg(floor(l_quantity)) AS paint FROM pl WHERE l_linenumber = 1 GROUP BY ALL", True)
def recipe_weapon_results(s, d):
    return recipes.weapon_results(_tables(s, d))


@query("SELECT account, match_key, 2::BIGINT AS waves, n + n + 1 AS delivered, n + 1 AS best_wave FROM co", True)
def recipe_wave_totals(s, d):
    return recipes.wave_totals({"coop_details": fx.coop_details(s, d)})


@query("SELECT o_orderpriority AS operation, CASE WHEN o_orderstatus = 'F' THEN 'pending' ELSE 'retry' END AS state, count(*) AS jobs, max(o_orderkey % 5) AS attempts FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL")
def recipe_open_work(s, d):
    state = F.when(F.col("o_orderstatus") == "F", "pending").when(F.col("o_orderstatus") == "O", "retry").otherwise("done")
    return recipes.open_work({"jobs": fx.read(s, d, "orders").select(F.col("o_orderpriority").alias("operation"), state.alias("state"), (F.col("o_orderkey") % 5).alias("attempts"))})


# -- sheets -------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, lang, source, text, length(text) > 777 AS long FROM documents)
SELECT doc_id AS row_key, unnest(['doc_id', 'lang', 'source', 'text']) AS column_name, 'missing' AS problem FROM d WHERE doc_id % 13 = 6
UNION ALL SELECT doc_id, 'text', 'incomplete' FROM d WHERE doc_id % 10 = 3 AND long AND doc_id % 13 <> 6 UNION ALL SELECT doc_id, 'lang', 'value' FROM d WHERE doc_id % 11 = 5 AND doc_id % 13 <> 6
UNION ALL SELECT doc_id, 'source', 'type' FROM d WHERE doc_id % 17 = 1 AND doc_id % 13 <> 6 UNION ALL SELECT doc_id + 1000000000, 'lang', 'unknown' FROM d WHERE doc_id % 50 = 2""")
def sheet_cells(s, d):
    docs, path, k = fx.read(s, d, "documents").select("doc_id", "lang", "source", "text"), shared.scratch(s, "sheets"), F.col("row_key")
    sheets.export_sheets(docs, "doc_id", path, 2_000, 777)
    there, at = sheets.read_sheets(s, path).drop("sheet"), F.col("column_name")
    lost = (k % 13 == 6) | ((k % 10 == 3) & (at == "text") & (F.col("chunk") == 1))
    other = there.where((k % 50 == 2) & (at == "lang")).withColumn("row_key", k + 1_000_000_000)
    broken = there.where(~lost).withColumns({"value": F.when((k % 11 == 5) & (at == "lang"), "xx").otherwise(F.col("value")), "type": F.when((k % 17 == 1) & (at == "source"), "blob").otherwise(F.col("type"))})
    whole = sheets.cell_problems(there, docs, "doc_id")  # gives no rows
    return sheets.cell_problems(broken.unionByName(other), docs, "doc_id").unionByName(whole)
