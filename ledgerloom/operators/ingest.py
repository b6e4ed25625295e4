"""Idempotent ingest: stored bodies, responses, fetch receipts, and everything that is derived from them by recomputing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsonx
from ..functions.shipping import ship
from .cdc import cell_key
from .identity import identity

#: What makes two fetches one response; compared null-safely.
RESPONSE_KEY = ["account", "operation", "variables_json", "body_sha256", "http_status", "query_id", "app_version"]
#: With a length of whole quartets, this is strict base64; no group repeats, so long bodies are safe.
_STRICT = r"^[A-Za-z0-9+/]*={0,2}$"


def envelopes(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fetches with their decoded bodies, and the rejected ones with a reason."""
    ship(raw.sparkSession)
    body = F.when(F.col("body_base64").rlike(_STRICT) & (F.length("body_base64") % 4 == 0), F.unbase64("body_base64"))
    d = raw.withColumn("body", body)
    reason = F.when(F.col("fetched_at").isNull() | F.col("event_id").isNull() | F.col("account").isNull() | F.col("operation").isNull(), "missing field").when(F.col("body").isNull(), "body is not base64")
    d = d.withColumn("reason", reason)
    # Of fetches that share an event_id, always the same one; the others are left out before they are shuffled.
    order = [F.asc("fetched_at"), F.asc("body_sha256"), F.asc("account"), F.asc("operation"), F.asc("variables")]
    first = F.row_number().over(W.partitionBy("event_id").orderBy(*order))
    one = d.where("reason is null").withColumn("body_sha256", F.sha2("body", 256)).withColumn("_n", first).where("_n = 1")
    good = one.select(
        "event_id", "account", "fetched_at", "operation", jsonx.canonical_json(F.coalesce("variables", F.lit("{}"))).alias("variables_json"), "query_id", "app_version",
        F.col("status").alias("http_status"), "headers", "body", "body_sha256",
    )
    return good, d.where("reason is not null").select("event_id", "reason")


def bodies(fetches: DataFrame) -> DataFrame:
    """Each distinct body once."""
    return fetches.groupBy(F.col("body_sha256").alias("sha256")).agg(F.first("body").alias("body")).withColumn("byte_length", F.length("body").cast("long"))


def responses(fetches: DataFrame) -> DataFrame:
    """Each distinct response with its first fetch, its JSON text and whether that parses."""
    first = fetches.groupBy(*RESPONSE_KEY).agg(F.min_by(F.struct("event_id", "fetched_at", "body"), F.struct("fetched_at", "event_id")).alias("f"), F.count("*").alias("fetches"))
    text = F.decode("f.body", "UTF-8")
    fine = jsonx.is_json(text)
    return first.select(*RESPONSE_KEY, "f.event_id", "f.fetched_at", "fetches", F.when(fine, text).alias("json_text"), F.when(~fine, "INVALID_JSON").alias("parse_error"))


def receipts(fetches: DataFrame, stored: DataFrame) -> DataFrame:
    """(event_id, response_event_id, fetched_at): every fetch and the response it repeats."""
    r = stored.select(*RESPONSE_KEY, F.col("event_id").alias("response_event_id"))
    same = [fetches[k].eqNullSafe(r[k]) for k in RESPONSE_KEY]
    return fetches.join(r, same).select(fetches["event_id"], "response_event_id", fetches["fetched_at"])


def new_only(incoming: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-ignore: the rows whose key is not known yet, nulls equal; of incoming ties one."""
    k = known.select(*[F.col(c).alias(f"_{c}") for c in keys]).distinct()
    return incoming.dropDuplicates(keys).join(k, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys], "left_anti")


def outcome(http_status: Column, v: Column, detail_root: Column, null_root: Column, missing: Column) -> Column:
    """retry, unavailable or done for a response: ``v`` its JSON, roots the names that must (or may) be null, missing whether fields lack."""
    data = F.try_variant_get(v, "$.data", "map<string,variant>")
    errors = F.try_variant_get(v, "$.errors", "variant")
    has_errors = errors.isNotNull() & (F.coalesce(F.to_json(errors), F.lit("null")).isin("null", "[]", "false", "0", '""', "{}") == F.lit(False))
    filled = lambda x: x.isNotNull() & ~F.is_variant_null(x)
    retry = (http_status != 200) | data.isNull() | has_errors | missing
    gone = detail_root.isNotNull() & ~F.coalesce(filled(F.try_element_at(data, detail_root)), F.lit(False))
    fine = null_root.isNotNull() & F.map_contains_key(data, F.coalesce(null_root, F.lit(""))) & ~F.coalesce(filled(F.try_element_at(data, null_root)), F.lit(False))
    any_value = F.exists(F.map_values(data), lambda x: F.coalesce(filled(x), F.lit(False)))
    return F.when(F.coalesce(retry, F.lit(True)), "retry").when(gone, "unavailable").when(fine, "done").when(~F.coalesce(any_value, F.lit(False)), "retry").otherwise("done")


def latest(rows: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The row of each key with the greatest time, then tie; a partial maximum, so large groups do not gather."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(time).isNotNull(), F.col(time), F.col(tie)))
    return rows.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def endpoint_heads(receipts_: DataFrame) -> DataFrame:
    """The response that each account and operation fetched last: A, B, A again makes A current."""
    return latest(receipts_.select("account", "operation", "response_id", "fetched_at", "event_id"), ["account", "operation"], "fetched_at", "event_id").select("account", "operation", "response_id")


def seen(sightings: DataFrame, keys: list[str], time: str) -> DataFrame:
    """first_seen and last_seen of each key over distinct contents."""
    return sightings.groupBy(*keys).agg(F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def canonical_details(details: DataFrame) -> DataFrame:
    """For each match the newest full detail: partial ones (path longer than one step) never replace it."""
    full = details.where(F.size(F.split("path", r"\.")) == 1)
    return latest(full, ["account", "kind", "match_key"], "fetched_at", "response_id")


def changed_only(current: DataFrame, incoming: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Latest-wins upsert without no-op writes: incoming rows that are new, or differ null-safely."""
    old = current.select(*keys, F.col(value).alias("_old"), F.lit(True).alias("_known"))
    return incoming.join(old, keys, "left").where(F.col("_known").isNull() | ~F.col(value).eqNullSafe(F.col("_old"))).drop("_old", "_known")


def replaced(current: DataFrame, incoming: DataFrame, owner: list[str], keys: list[str]) -> DataFrame:
    """(keys, op): what brings the rows of the owners that ``incoming`` names in line with it; rows that it no longer has are deleted.

    Other owners' rows are left alone. Rows are compared as typed cells; equal rows give no operation.
    """
    theirs = current.join(incoming.select(*owner).distinct(), owner, "left_semi")
    cols = [c for c in incoming.columns if c not in keys]
    old, new = theirs.select(*keys, F.sha2(cell_key(theirs, cols), 256).alias("_b")), incoming.select(*keys, F.sha2(cell_key(incoming, cols), 256).alias("_a"))
    op = F.when(F.col("_a").isNull(), "delete").when(~F.col("_a").eqNullSafe(F.col("_b")), "upsert")
    return old.join(new, keys, "full_outer").withColumn("op", op).where("op is not null").select(*keys, "op")


def acknowledged_state(receipts_: DataFrame, keys: list[str]) -> DataFrame:
    """Job state after replaying receipts in any order: only the newest by time counts, a delayed one never undoes it; attempts count all."""
    order = F.struct("fetched_at", "event_id")
    return receipts_.groupBy(*keys).agg(F.max_by("outcome", order).alias("state"), F.max_by("response_id", order).alias("last_response_id"), F.count("*").alias("attempts"))


def sightings(responses_: DataFrame, key: str = "id") -> DataFrame:
    """(key, path, kind, match_key) for every text anywhere in a response that is a match's id."""
    walked = jsonx.all_fields(responses_, key).where((F.col("type") == "text") & F.col("path").endswith(".id"))
    i = identity(F.col("atom"))
    return walked.withColumn("_i", i).where("_i is not null").select(key, F.regexp_replace("path", r"\.id$", "").alias("path"), "_i.kind", "_i.match_key")


def asset_refs(responses_: DataFrame, key: str = "id") -> DataFrame:
    """(key, path, url): https texts under url-like names on a path that tells of an image."""
    walked = jsonx.all_fields(responses_, key).where((F.col("type") == "text") & F.col("atom").startswith("https://"))
    return walked.where(F.col("path").rlike(r"\.(url|originalUrl|imageUrl|src)$") & F.lower("path").rlike("image|icon|thumbnail|photo|url")).select(key, "path", F.col("atom").alias("url"))


def tags_after(tags: DataFrame, edits: DataFrame) -> DataFrame:
    """The tag table after edits (account, match_key, tag, note, at, op add/remove): the latest edit of each tag wins."""
    last = latest(edits, ["account", "match_key", "tag"], "at", "op")
    key = ["account", "match_key", "tag"]
    old = tags.join(last.select(*key), key, "left_anti").select(*key, "note", "updated_at")
    return old.unionByName(last.where("op = 'add'").select(*key, "note", F.col("at").alias("updated_at")))


def superseded(jobs: DataFrame) -> DataFrame:
    """Jobs with state superseded where another job for the same match and operation is done.

    The matches that are done are counted once each and joined in; jobs without a match meet none and are not gathered.
    """
    key = ["account", "operation", "kind", "match_key"]
    done = jobs.where("state = 'done' and match_key is not null").groupBy(*key).agg(F.lit(True).alias("_done"))
    waits = jobs.where(_WAITS)
    late = waits.join(done, [waits[c].eqNullSafe(done[c]) for c in key], "left").select(*[waits[c] for c in jobs.columns if c != "state"], F.when(F.col("_done"), "superseded").otherwise(waits["state"]).alias("state"))
    return jobs.where(f"not coalesce({_WAITS}, false)").unionByName(late.select(*jobs.columns))


#: Jobs that another one can supersede.
_WAITS = "match_key is not null and state in ('pending', 'retry')"


#: Fixed codes of issues after which a response does not count as a success.
BLOCKING = ("INCOMPLETE_RESPONSE", "SELECTED_FIELD_MISSING", "SELECTED_FIELD_SHAPE_INVALID", "RESPONSE_CATALOG_MISMATCH", "RESPONSE_CATALOG_UNRESOLVED")


def project(fetches: DataFrame, detail_roots: dict[str, str], missing: DataFrame | None = None, null_roots: dict[str, str] | None = None, stored: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> dict[str, DataFrame]:
    """All that is derived from the fetches, by name: responses (with outcome), receipts, issues, endpoint_heads, sightings, matches, documents, asset_refs, jobs.

    Nothing is mutated: every table is a plan over the raw log, so running it again after more fetches,
    in any order, gives what one run over all of them gives. ``detail_roots`` names, by operation, the
    field below data that a match's detail is in; a sighting there is its document. ``null_roots`` names fields that may be null.
    ``missing`` (id): responses that lack fields their query asks for, see ``projection``; they wait for another try.
    ``stored``: the responses with their id, if they are there already. ``keep`` may write the responses with their outcome, which all else reads.
    """
    if stored is None:
        stored = responses(fetches).withColumn("id", F.col("event_id"))  # a response is known by its first fetch
    v = F.col("_v")
    named_root = lambda roots: F.coalesce(*[F.when(F.col("operation") == op, F.lit(name)) for op, name in roots.items()], F.lit(None).cast("string"))
    root, incomplete = named_root(detail_roots), F.col("parse_error").isNotNull()
    if missing is not None:
        stored = stored.join(missing.select("id").distinct().withColumn("_missing", F.lit(True)), "id", "left")
        incomplete = incomplete | F.col("_missing").isNotNull()
    stored = stored.withColumn("_v", jsonx.parsed("json_text")).withColumn("outcome", outcome(F.col("http_status"), v, root, named_root(null_roots or {}), incomplete)).drop("_v", "_missing")
    stored = keep(stored)
    got = receipts(fetches, stored)
    named = got.join(stored.select(F.col("id").alias("response_event_id"), "account", "operation", "outcome"), "response_event_id")
    issue = F.when(F.col("parse_error").isNotNull(), F.col("parse_error")).when(F.col("outcome") == "retry", "INCOMPLETE_RESPONSE")
    fine = stored.where("outcome = 'done'")
    seen_at = sightings(fine.select("id", "json_text"))
    found = seen_at.join(stored.select("id", "account", "operation", "fetched_at"), "id")
    on_root = root.isNotNull() & (F.col("path") == F.concat(F.lit("$.data."), root))
    details = found.where(on_root).select("account", "kind", "match_key", "fetched_at", F.col("id").alias("response_id"), F.lit("detail").alias("path"))
    chosen = canonical_details(details)
    matches = seen(found, ["account", "kind", "match_key"], "fetched_at").join(chosen.select("account", "kind", "match_key", F.col("response_id").alias("detail_response_id")), ["account", "kind", "match_key"], "left")
    text = stored.select(F.col("id").alias("response_id"), F.to_json(F.try_variant_get(F.try_element_at(F.try_variant_get(jsonx.parsed("json_text"), "$.data", "map<string,variant>"), root), "$", "variant")).alias("json_text"))
    return {
        "responses": stored, "receipts": got, "issues": stored.select(F.col("id").alias("response_id"), issue.alias("code")).where("code is not null"),
        "endpoint_heads": endpoint_heads(named.where("outcome = 'done'").select("account", "operation", F.col("response_event_id").alias("response_id"), "fetched_at", "event_id")),
        "sightings": found.select(F.col("id").alias("response_id"), "account", "path", "kind", "match_key"), "matches": matches,
        "documents": chosen.select("response_id", "account", "kind", "match_key").join(text, "response_id"), "asset_refs": asset_refs(fine.select("id", "json_text")),
        "jobs": acknowledged_state(named.select("account", "operation", "fetched_at", "event_id", "outcome", F.col("response_event_id").alias("response_id")), ["account", "operation"]),
    }


def last_success(stored: DataFrame, fetched: DataFrame, issues: DataFrame, now: Column, stale_after: int = 600) -> DataFrame:
    """(operation, last_success_at, age_seconds, stale) of ``stored`` (id, operation, http_status, projected), ``fetched`` (response_id, fetched_at), ``issues`` (response_id, code).

    Of the fetches of projected responses with status 200 and without a blocking issue the latest
    counts; an operation without any is stale. Every operation in ``stored`` has a row.
    """
    fine = stored.where("http_status = 200 and projected = 1").join(issues.where(F.col("code").isin(*BLOCKING)).select(F.col("response_id").alias("id")), "id", "left_anti")
    last = fetched.join(fine.select(F.col("id").alias("response_id"), "operation"), "response_id").groupBy("operation").agg(F.max("fetched_at").alias("last_success_at"))
    age = F.when(F.col("last_success_at").isNotNull(), F.greatest(F.lit(0), F.unix_seconds(now) - F.unix_seconds("last_success_at")))
    return stored.select("operation").distinct().join(last, "operation", "left").select("operation", "last_success_at", age.alias("age_seconds"), F.coalesce(age > stale_after, F.lit(True)).alias("stale"))
