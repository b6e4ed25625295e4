"""Queries of what is kept and advanced step by step: the incremental layout and generations, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import constraints, increment, ingest, overlay, packing, projection
from ..sources import lookup, shared
from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query by its name, and its SQL."""

    def put(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return put


# -- incremental layout -------------------------------------------------------------------------------------------


def _archive(s: SparkSession, d: str, later: bool) -> DataFrame:
    """Links of an archive whose matches are the orders, before or after its feed: some matches are classified, some change their rule, some lose their detail or tag."""
    k = F.col("k")
    o = fx.read(s, d, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate", F.concat(F.lit("s"), F.substring("o_orderpriority", 1, 1)).alias("analysis_set"))
    o = o.withColumns({"account": F.lit("a"), "kind": F.lit("vs"), "match_key": F.concat(F.lit("m"), k), "id": k.cast("string"), "response_id": k, "played": fx._iso(F.col("o_orderdate"))})
    rule = F.when((k % 11 == 0) & F.lit(later), "CLAM").otherwise(F.element_at(F.array(*map(F.lit, fx.RULES)), (k % 3 + 1).cast("int")))
    even = o.where(k % 2 == 0)
    tables = {
        "matches": o.withColumn("detail_response_id", F.when(k % 2 == 0, k)),
        "match_classification": o.withColumn("rule_raw", rule).where(F.lit(later) | (k % 10 != 3)),
        "documents": even.where(~F.lit(later) | (k % 13 != 0)),
        "match_tags": o.where((k % 7 == 0) & (~F.lit(later) | (k % 21 != 0))),
        "responses": o.select("id", "response_id", F.lit("VsHistoryDetailQuery").alias("operation"), F.col("played").alias("fetched_at"), F.lit(None).cast("string").alias("body_sha256")),
        "sightings": fx.read(s, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("response_id")),
    }
    out = None
    for t, rows in tables.items():
        one = increment.links(t, rows)
        out = one if out is None else out.unionByName(one)
    return out


_LOCAL = "o_orderdate + INTERVAL 9 HOUR"


def _rows_sql(name: str, later: bool) -> str:
    """(tbl, id, part) of all rows, from whole tables."""
    rule = "['AREA','LOFT','GOAL'][k % 3 + 1]"
    rule, known = (f"CASE WHEN k % 11 = 0 THEN 'CLAM' ELSE {rule} END", "TRUE") if later else (rule, "k % 10 <> 3")
    doc = "k % 26 NOT IN (0) AND k % 2 = 0" if later else "k % 2 = 0"
    tag = "k % 7 = 0 AND k % 21 <> 0" if later else "k % 7 = 0"
    return f"""{name}h AS (SELECT k, {known} AS known, {doc} AS doc, {tag} AS tag, 'matches/' || CASE WHEN {known} THEN 's' || o_orderpriority[1] || '/' || {rule} ELSE 'unclassified/no-rule' END || '/'
 || CASE WHEN {doc} THEN strftime({_LOCAL}, '%Y-%m/%Y-%m-%d') ELSE 'unknown-date' END || '/m' || k || '.parquet' AS part,
 'responses/VsHistoryDetailQuery/' || strftime({_LOCAL}, '%Y-%m/%Y-%m-%d/%H') || '.parquet' AS own FROM (SELECT o_orderkey AS k, * FROM orders)),
{name} AS (SELECT 'matches' AS tbl, k, part FROM {name}h UNION ALL SELECT 'match_classification', k, part FROM {name}h WHERE known UNION ALL SELECT 'documents', k, part FROM {name}h WHERE doc
 UNION ALL SELECT 'match_tags', k, part FROM {name}h WHERE tag UNION ALL SELECT 'responses', k, CASE WHEN doc THEN part ELSE own END FROM {name}h
 UNION ALL SELECT 'sightings', event_id, CASE WHEN k IS NULL THEN 'unplaced/sightings.parquet' WHEN doc THEN part ELSE own END FROM events LEFT JOIN {name}h ON k = event_id)"""


@query(f"""WITH {_rows_sql('b', False)}, {_rows_sql('n', True)},
feed AS (SELECT 'match_classification' AS tbl, k FROM bh WHERE k % 10 = 3 OR k % 11 = 0 UNION ALL SELECT 'documents', k FROM bh WHERE k % 26 = 0 UNION ALL SELECT 'match_tags', k FROM bh WHERE k % 21 = 0),
dirty AS (SELECT part FROM (SELECT * FROM b EXCEPT SELECT * FROM n) UNION SELECT part FROM (SELECT * FROM n EXCEPT SELECT * FROM b) UNION SELECT part FROM (SELECT * FROM b UNION ALL SELECT * FROM n) JOIN feed USING (tbl, k))
SELECT part, part NOT IN (SELECT part FROM n) AS emptied FROM dirty""")
def layout_delta(s, d):
    state = increment.IncrementalLayout(s, shared.scratch(s, "layout"), buckets=16)
    before, after = _archive(s, d, False), _archive(s, d, True)
    state.advance(before.withColumn("op", F.lit("upsert")))
    step = state.advance(increment.net(before, after))
    gone = step.emptied.withColumn("_gone", F.lit(True))
    return step.dirty.join(gone, "part", "left").select("part", F.coalesce("_gone", F.lit(False)).alias("emptied"))


# -- generations and parts ----------------------------------------------------------------------------------------

#: Seven generations over the orders: upserts of some keys, deletes of others, a clear in the fifth after some of its upserts.
_OPS = """ops AS (SELECT o_orderkey AS id, g::BIGINT AS generation, CASE WHEN (o_orderkey + g) % 3 = 0 THEN 'delete' ELSE 'upsert' END AS op, (o_orderkey * 7 % 1000) * 2 AS ordinal FROM orders, range(7) AS t(g) WHERE (o_orderkey + g * 13) % 5 = 0
 UNION ALL SELECT o_orderkey, g, CASE WHEN (o_orderkey + g) % 4 = 0 THEN 'upsert' ELSE 'delete' END, 5000 + o_orderkey % 10 FROM orders, range(7) AS t(g) WHERE (o_orderkey + g * 13) % 35 = 0 UNION ALL SELECT NULL, 4, 'clear_table', 777),
base AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 1), gens AS (SELECT unnest(range(-1, 7)) AS generation)"""


def _operations(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    k, g = F.col("id"), F.col("generation")
    o = fx.read(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    some = o.withColumn("generation", F.explode(F.sequence(F.lit(0), F.lit(6)))).withColumn("generation", g.cast("long")).where((k + g * 13) % 5 == 0)
    first = some.withColumns({"op": F.when((k + g) % 3 == 0, "delete").otherwise("upsert"), "ordinal": (k * 7 % 1000) * 2})
    again = some.where((k + g * 13) % 35 == 0).withColumns({"op": F.when((k + g) % 4 == 0, "upsert").otherwise("delete"), "ordinal": 5000 + k % 10})
    clear = s.range(1).select(F.lit(None).cast("long").alias("id"), F.lit(4).cast("long").alias("generation"), F.lit("clear_table").alias("op"), F.lit(777).cast("long").alias("ordinal"))
    return o.where(k % 4 != 1), first.unionByName(again).unionByName(clear)


@query(f"""WITH {_OPS}, e AS (SELECT id, -1 AS generation, 0 AS ordinal, 'upsert' AS op FROM base UNION ALL SELECT id, generation, ordinal, op FROM ops),
last AS (SELECT g.generation, id, arg_max(op, e.generation * 100000 + ordinal) AS op, max(e.generation * 100000 + ordinal) AS place FROM gens g JOIN e ON e.generation <= g.generation WHERE op <> 'clear_table' GROUP BY ALL)
SELECT generation::BIGINT AS generation, count(*) FILTER (WHERE op = 'upsert' AND NOT (generation >= 4 AND place < 400777)) AS rows FROM last GROUP BY generation""")
def generation_rows(s, d):
    return overlay.generation_counts(*_operations(s, d), "id")


#: The sequential definition: a part begins with the first row that does not fit into the one before.
@query("""WITH RECURSIVE r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn, b > 4000 AS external, CASE WHEN b > 4000 THEN 128 ELSE b END AS b FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 7 THEN 90000 ELSE 60 + o_custkey * 31 % 997 END AS b FROM orders)),
c AS (SELECT *, sum(b) OVER (ORDER BY rn) AS upto FROM r),
p(part, first, before) AS (SELECT 0::BIGINT, 1::BIGINT, 0::HUGEINT UNION ALL SELECT part + 1, n.rn, n.upto - n.b FROM p JOIN c n ON n.upto > p.before + 20000 AND n.upto - n.b <= p.before + 20000)
SELECT o_orderkey, part, external FROM c JOIN p ON c.rn >= p.first AND c.upto <= p.before + 20000""")
def packed_parts(s, d):
    k = F.col("o_orderkey")
    o = fx.read(s, d, "orders").select(k, F.when(k % 50 == 7, 90_000).otherwise(60 + F.col("o_custkey") * 31 % 997).alias("b"))
    return packing.pack(o, "o_orderkey", F.col("b"), 20_000, 4_000, run=1000, fan=4).select("o_orderkey", "part", "external")


#: Price of the first generation up by 1, of the second by 2 for other keys, some keys deleted; as the overlay queries have it.
_NOW = "now AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 2 WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS price, o_orderpriority AS priority, o_custkey AS customer FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 <> 0)"


@query(f"""WITH {_NOW}, low AS (SELECT min(o_orderkey) AS k FROM orders), o AS (SELECT o_totalprice AS price, o_custkey AS customer FROM orders, low WHERE o_orderkey = k),
c AS (SELECT 'now' AS asked, now.id FROM now, o WHERE now.price = o.price UNION ALL SELECT 'customer', now.id FROM now, o WHERE now.customer = o.customer UNION ALL SELECT 'both', now.id FROM now, o WHERE now.customer = o.customer AND now.price = o.price + 2
 UNION ALL SELECT 'many', id FROM now WHERE priority = '1-URGENT')
SELECT asked, least(count(id), 2)::BIGINT AS found, CASE WHEN count(id) = 1 THEN min(id) END AS id FROM (SELECT unnest(['now', 'customer', 'both', 'many', 'none', 'type']) AS asked) LEFT JOIN c USING (asked) GROUP BY asked""")
def indexed_lookup(s, d):
    k = F.col("id")
    o = fx.read(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    path = shared.scratch(s, "indexed")
    lookup.write_indexed(o, path, "id", F.lit(40), ["price", "customer"], 8_000)
    one = lambda g, rows, op, more: rows.select(F.lit(g).cast("long").alias("generation"), k.alias("ordinal"), F.lit(op).alias("op"), "id", (F.col("price") + more).alias("price"), "priority", "customer")
    ops = one(1, o.where(k % 3 == 0), "upsert", 1).unionByName(one(2, o.where((k % 5 == 0) & (k % 7 != 0)), "delete", 0)).unionByName(one(3, o.where(k % 7 == 0), "upsert", 2))
    first = o.agg(F.min_by(F.struct("price", "customer"), "id")).first()[0]
    asked = {
        "now": {"price": first["price"]}, "customer": {"customer": first["customer"]}, "both": {"customer": first["customer"], "price": first["price"] + 2},
        "many": {"priority": "1-URGENT"}, "none": {"price": -1.0}, "type": {"customer": float(first["customer"])},
    }
    found, there = None, s.read.schema("id long, price double, priority string, customer long, part long").parquet(f"{path}/rows")
    for name, criteria in asked.items():
        n = lookup.find(s, path, ops, "id", criteria, there).agg(F.count("*").alias("found"), F.when(F.count("*") == 1, F.min("id")).alias("id")).select(F.lit(name).alias("asked"), "found", "id")
        found = n if found is None else found.unionByName(n)
    return found


# -- constraints --------------------------------------------------------------------------------------------------

_KEYS = [
    constraints.ForeignKey("nation_region", "nation", ("n_regionkey",), "region", ("r_regionkey",)),
    constraints.ForeignKey("customer_nation", "customer", ("c_nationkey",), "nation", ("n_nationkey",)),
    constraints.ForeignKey("order_customer", "orders", ("o_custkey",), "customer", ("c_custkey",)),
    constraints.ForeignKey("order_earlier", "orders", ("earlier",), "orders", ("o_orderkey",)),
    constraints.ForeignKey("line_order", "lineitem", ("l_orderkey", "l_linenumber"), "slots", ("o_orderkey", "slot")),
]


@query("""WITH n AS (SELECT * FROM nation WHERE n_nationkey % 6 <> 1 UNION ALL SELECT * FROM nation WHERE n_nationkey = 3),
o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS c, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey - 1 + (o_orderkey % 100 = 0)::INT * 1000000000 END AS earlier FROM orders),
s AS (SELECT o_orderkey, unnest([1, 2, 3]) AS slot FROM orders),
v AS (SELECT 'nation_region' AS "constraint", n_regionkey::VARCHAR AS key, 'missing' AS problem FROM n WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey <> 2)
 UNION ALL SELECT 'customer_nation', c_nationkey::VARCHAR, 'missing' FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM n)
 UNION ALL SELECT 'customer_nation', n_nationkey::VARCHAR, 'repeated' FROM n WHERE n_nationkey = 3
 UNION ALL SELECT 'order_customer', c::VARCHAR, 'missing' FROM o WHERE c IS NOT NULL AND c NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 4)
 UNION ALL SELECT 'order_earlier', earlier::VARCHAR, 'missing' FROM o WHERE earlier IS NOT NULL AND earlier NOT IN (SELECT o_orderkey FROM o)
 UNION ALL SELECT 'line_order', l_orderkey || ',' || l_linenumber, 'missing' FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = l_orderkey AND s.slot = l_linenumber))
SELECT "constraint", key, problem, count(*) AS rows FROM v GROUP BY ALL""")
def key_violations(s, d):
    k = F.col("o_orderkey")
    nation, orders = fx.read(s, d, "nation"), fx.read(s, d, "orders")
    tables = {
        "region": fx.read(s, d, "region").where("r_regionkey <> 2"), "nation": nation.where("n_nationkey % 6 <> 1").unionByName(nation.where("n_nationkey = 3")),
        "customer": fx.read(s, d, "customer").withColumn("c_custkey", F.when(F.col("c_custkey") % 10 != 4, F.col("c_custkey"))),
        "orders": orders.select(k, F.when(k % 9 > 0, F.col("o_custkey")).alias("o_custkey"), F.when(k % 2 == 0, k - 1 + F.when(k % 100 == 0, 1_000_000_000).otherwise(0)).alias("earlier")),
        "lineitem": fx.read(s, d, "lineitem"), "slots": orders.select(k, F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("slot")),
    }
    return constraints.violations(tables, _KEYS)


# -- projection with validation -----------------------------------------------------------------------------------

_FIELD = lambda name, **more: {"kind": "ScalarField", "name": name} | more
_CATALOG = {"Order": {"operation": {"selections": [
    {"kind": "LinkedField", "name": "order", "concreteType": "Order", "plural": False, "args": None, "selections": [
        _FIELD("id"), _FIELD("sum", alias="total"), {"kind": "Condition", "condition": "full", "passingValue": True, "selections": [_FIELD("never")]},
        {"kind": "InlineFragment", "type": "Order", "selections": [{"kind": "LinkedField", "name": "lines", "plural": True, "concreteType": "Line", "args": None, "selections": [_FIELD("n")]}]},
        {"kind": "InlineFragment", "type": "Other", "selections": [_FIELD("only_other")]}]},
    {"kind": "LinkedField", "name": "page", "concreteType": "Page", "plural": False, "args": [{"kind": "Variable", "name": "after", "variableName": "cursor"}], "selections": [_FIELD("n")]}]}}}


def _order_fetches(s: SparkSession, d: str) -> DataFrame:
    """A response for each order: some without a selected field, with a wrong shape, with a next page, null, refused, or of an unknown operation."""
    k = F.col("o_orderkey")
    line = F.when(k % 5 == 0, F.lit('{"n":1}')).when(k % 3 == 0, F.lit("[null]")).otherwise(F.lit('[{"n":1},{"n":2}]'))
    total = F.when(k % 4 == 0, F.lit("")).otherwise(F.lit(',"total":7'))
    order = F.when(k % 11 == 0, F.lit("null")).otherwise(F.concat(F.lit('{"id":"Order-'), k % 500, F.lit('"'), total, F.lit(',"lines":'), line, F.lit("}")))
    page = F.when(k % 13 == 0, F.concat(F.lit('{"n":1,"pageInfo":{"hasNextPage":true,"endCursor":"c'), k % 50, F.lit('"}}'))).otherwise(F.lit("null"))
    text = F.concat(F.lit('{"data":{"order":'), order, F.lit(',"page":'), page, F.lit("}}"))
    raw = fx.read(s, d, "orders").select(
        F.format_string("f%012d", k).alias("event_id"), F.lit("a").alias("account"), fx._iso(F.col("o_orderdate")).alias("fetched_at"), F.when(k % 10 == 9, "Strange").otherwise("Order").alias("operation"),
        F.concat(F.lit('{"k":'), k, F.lit("}")).alias("variables"), F.lit(None).cast("string").alias("query_id"), F.lit(None).cast("string").alias("app_version"), F.when(k % 7 == 0, 500).otherwise(200).alias("status"), F.lit("{}").alias("headers"), F.base64(F.encode(text, "UTF-8")).alias("body_base64"),
    )
    return ingest.envelopes(raw.withColumn("body_base64", F.regexp_replace("body_base64", r"\s", "")))[0]


_PROJECTED = """x AS (SELECT o_orderkey AS k, printf('f%012d', o_orderkey) AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS seen, o_orderkey % 10 <> 9 AS known, o_orderkey % 11 = 0 AS gone, o_orderkey % 7 = 0 AS refused, o_orderkey % 13 = 0 AS paged FROM orders),
y AS (SELECT *, known AND NOT gone AND k % 4 = 0 AS lacks FROM x), z AS (SELECT *, CASE WHEN refused OR lacks THEN 'retry' WHEN known AND gone THEN 'unavailable' WHEN gone AND NOT paged THEN 'retry' ELSE 'done' END AS outcome FROM y)"""


def _projected(s: SparkSession, d: str) -> dict[str, DataFrame]:
    return projection.project(_order_fetches(s, d), _CATALOG, {"Order": "order"}, routes={"Detail": ("id", ["Order"])})


@query(f"""WITH {_PROJECTED} SELECT id AS response_id, 'SELECTED_FIELD_MISSING' AS code, '$.order.total' AS path FROM z WHERE lacks UNION ALL SELECT id, 'SELECTED_FIELD_SHAPE_INVALID', '$.order.lines' FROM z WHERE known AND NOT gone AND k % 5 = 0
UNION ALL SELECT id, 'UNKNOWN_OPERATION', NULL FROM z WHERE NOT known UNION ALL SELECT id, 'INCOMPLETE_RESPONSE', NULL FROM z WHERE outcome = 'retry' UNION ALL SELECT id, 'DETAIL_UNAVAILABLE', NULL FROM z WHERE outcome = 'unavailable'""")
def projected_issues(s, d):
    return _projected(s, d)["issues"]


@query(f"""WITH {_PROJECTED}, e AS (SELECT k % 500 AS e, seen, id, CASE WHEN k % 4 = 0 THEN '' ELSE 't' END || CASE WHEN k % 5 = 0 THEN 'o' WHEN k % 3 = 0 THEN 'n' ELSE 'l' END AS body FROM z WHERE known AND NOT gone),
l AS (SELECT e, arg_max(body, seen || id) AS body FROM e GROUP BY e), o AS (SELECT e.e, max(seen || id) AS upto FROM e JOIN l ON l.e = e.e AND l.body <> e.body GROUP BY e.e)
SELECT 'Order-' || e.e AS entity_id, min_by(id, seen || id) AS response_id FROM e JOIN l ON l.e = e.e AND l.body = e.body LEFT JOIN o ON o.e = e.e WHERE upto IS NULL OR seen || id > upto GROUP BY e.e""")
def projected_entities(s, d):
    return _projected(s, d)["entities"].select("entity_id", "response_id")


@query(f"""WITH {_PROJECTED} SELECT DISTINCT 'Order' AS operation, '{{"cursor":"c' || (k % 50) || '","k":' || k || '}}' AS variables_json, 'next' AS reason FROM z WHERE known AND paged
UNION ALL SELECT DISTINCT 'Detail', '{{"id":"Order-' || (k % 500) || '"}}', 'related' FROM z WHERE known AND NOT gone""")
def projected_jobs(s, d):
    return _projected(s, d)["next_jobs"].drop("account")


@query(f"""WITH {_PROJECTED} SELECT id, outcome FROM z WHERE outcome <> CASE WHEN refused THEN 'retry' WHEN known AND gone THEN 'unavailable' WHEN gone AND NOT paged THEN 'retry' ELSE 'done' END""")
def outcome_repairs(s, d):
    """Outcomes that were stored before responses were held against the catalog, and what they must become."""
    stored = ingest.project(_order_fetches(s, d), {"Order": "order"})["responses"].select("id", "outcome")
    return ingest.changed_only(stored, _projected(s, d)["responses"].select("id", "outcome"), ["id"], "outcome")
