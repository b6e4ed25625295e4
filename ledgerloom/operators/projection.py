"""Everything that follows from a log of fetches once responses are held against the catalog of queries: validated tables, issues, and what to ask next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import shared
from . import ingest, rates, schema_walk

KEY = ["account", "typename", "entity_id"]


def entities(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(account, typename, entity_id, response_id, json_text): each entity as last fetched, and the response that brought it to that state.

    A later response with the same content does not move it: it is the first one after the last with another content.
    """
    e = found.where("finding = 'entity'").select("id", F.from_json("detail", "array<string>").alias("_k"), "body").select("id", F.col("_k")[0].alias("typename"), F.col("_k")[1].alias("entity_id"), "body")
    e = e.join(stored.select("id", "account", "fetched_at"), "id").withColumns({"_at": F.struct("fetched_at", "id"), "_h": F.sha2("body", 256)})
    last = e.groupBy(*KEY).agg(F.max_by("_h", "_at").alias("_now"))
    marked = e.select(*KEY, "_at", "_h").join(last, KEY)
    other = marked.where("_h <> _now").groupBy(*KEY).agg(F.max("_at").alias("_other"))
    first = marked.where("_h = _now").join(other, KEY, "left").where("_other is null or _at > _other").groupBy(*KEY, "_now").agg(F.min("_at").alias("_at"))
    bodies = e.select(*KEY, "_at", "body").dropDuplicates([*KEY, "_at"])  # a response may show one entity at many paths
    return first.join(bodies, [*KEY, "_at"]).select(*KEY, F.col("_at.id").alias("response_id"), F.col("body").alias("json_text"))


def gaps(stored: DataFrame, sightings: DataFrame, histories: list[str]) -> DataFrame:
    """(response_id): successful responses of the history queries that share no match with the one before, though both name some."""
    place = F.concat_ws("\x1f", "fetched_at", "id").alias("place")
    rows = stored.where(F.col("operation").isin(histories) & (F.col("outcome") == "done")).select("id", "account", "operation", place)
    seen = sightings.select(F.col("response_id").alias("id"), F.concat_ws("\x1f", "kind", "match_key").alias("match")).distinct()
    flagged = rates.history_gaps_of_rows(rows.join(seen, "id", "left"), ["account", "operation"], "place", "match").where("possible_gap")
    return flagged.select(F.substring_index("place", "\x1f", -1).alias("response_id"))


def next_jobs(found: DataFrame, stored: DataFrame, objects: DataFrame, matches: DataFrame, routes: dict[str, tuple[str, list[str]]], details: dict[str, tuple[str, str]]) -> DataFrame:
    """(account, operation, variables_json, reason), each once: further pages, related objects, and details of matches that have none.

    ``routes``: variable and types of the objects that an operation asks by id; ``details``: operation and variable by kind of match.
    """
    owner = stored.select("id", "account", "operation")
    pages = found.where("finding in ('next', 'page')").join(owner, "id").select("account", "operation", F.col("detail").alias("variables_json"), F.col("finding").alias("reason"))
    spark = found.sparkSession
    asked = [(t, op, var) for op, (var, types) in sorted(routes.items()) for t in types]
    table = spark.createDataFrame(asked, "typename string, operation string, variable string")
    ask = lambda variable, value: F.to_json(F.create_map(variable, value))
    related = objects.join(F.broadcast(table), "typename").select("account", "operation", ask(F.col("variable"), F.col("entity_id")).alias("variables_json"), F.lit("related").alias("reason"))  # the table is part of the code
    pick = lambda i: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[i])) for k, v in sorted(details.items())], F.lit(None).cast("string"))
    open_ = matches.where("detail_response_id is null").withColumns({"operation": pick(0), "_var": pick(1)}).where("operation is not null")
    detail = open_.select("account", "operation", ask(F.col("_var"), F.col("match_key")).alias("variables_json"), F.lit("detail").alias("reason"))
    return pages.unionByName(related).unionByName(detail).distinct()


def project(
    fetches: DataFrame, catalog: dict[str, dict], detail_roots: dict[str, str], null_roots: dict[str, str] | None = None, histories: list[str] | None = None,
    routes: dict[str, tuple[str, list[str]]] | None = None, details: dict[str, tuple[str, str]] | None = None,
) -> dict[str, DataFrame]:
    """The tables of ``ingest.project``, where a response with missing fields moves no head and no match, with issues of all kinds, entities and next_jobs.

    Responses are made once and walked once, in Arrow batches; they, what is found and their outcomes are written once, and everything else is a plan over these. Running it again
    over more fetches, in any order, gives what one run over all of them gives.
    """
    spark = fetches.sparkSession
    keep = lambda df, name: shared.written(df, shared.scratch(spark, name))
    raw = keep(ingest.responses(fetches).withColumn("id", F.col("event_id")), "responses")
    found = keep(schema_walk.findings(raw.select("id", "operation", "variables_json", "json_text"), catalog, bodies=True), "findings")
    out = ingest.project(fetches, detail_roots, found.where("finding = 'missing'").select("id"), null_roots, raw, lambda df: keep(df, "outcomes"))
    stored = out["responses"]
    issue = lambda rows, code, path: rows.select(F.col("id").alias("response_id"), F.lit(code).alias("code"), path.alias("path"))
    of = lambda kind: found.where(F.col("finding") == kind)
    nowhere: Column = F.lit(None).cast("string")
    out["issues"] = (
        issue(stored.where("parse_error is not null"), "INVALID_JSON", nowhere)
        .unionByName(issue(of("missing"), "SELECTED_FIELD_MISSING", F.col("path")))
        .unionByName(issue(of("shape"), "SELECTED_FIELD_SHAPE_INVALID", F.col("path")))
        .unionByName(issue(of("unknown_operation"), "UNKNOWN_OPERATION", nowhere))
        .unionByName(issue(of("stalled"), "PAGINATION_STALLED", F.col("path")))
        .unionByName(issue(stored.where("outcome = 'retry'"), "INCOMPLETE_RESPONSE", nowhere))
        .unionByName(issue(stored.where("outcome = 'unavailable'"), "DETAIL_UNAVAILABLE", nowhere))
        .unionByName(issue(gaps(stored, out["sightings"], histories or []).withColumnRenamed("response_id", "id"), "POSSIBLE_HISTORY_GAP", nowhere))
    )
    out["entities"] = entities(found, stored)
    out["next_jobs"] = next_jobs(found, stored, out["entities"], out["matches"], routes or {}, details or {})
    return out
