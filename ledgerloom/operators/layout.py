"""The partitioned layout: where each row lives, incremental rebuilding, catalog and audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import jsonx, paths
from .cdc import cell_key
from .views import KEY

SUFFIX = ".parquet"
SYSTEM_TABLES = ("runs", "control", "manifests", "endpoint_heads", "page_fingerprints", "schema_version", "analysis_genre")


def _path(*parts: Column | str) -> Column:
    return F.concat(F.concat_ws("/", *[F.lit(p) if isinstance(p, str) else p for p in parts]), F.lit(SUFFIX))


def _segment(c: Column, other: str) -> Column:
    return F.coalesce(paths.encode_segment(c), F.lit(other))


def match_home(matches: DataFrame, classification: DataFrame, documents: DataFrame) -> DataFrame:
    """(account, kind, match_key, part): matches/<population>/<rule>/<month>/<day>/<key>, days nine hours ahead of UTC."""
    d = jsonx.with_parsed(documents, "_v").select(F.col("response_id").alias("detail_response_id"), *KEY, jsonx.text(F.col("_v"), "$.playedTime").alias("played"))
    m = matches.select(*KEY, "detail_response_id").join(classification.select(*KEY, "analysis_set", "rule_raw"), KEY, "left").join(d, ["detail_response_id", *KEY], "left")
    return m.select(*KEY, match_part(F.col("analysis_set"), F.col("rule_raw"), F.col("played"), F.col("match_key")).alias("part"))


def home_part() -> Column:
    """``match_part`` of a row of ``details.classified`` with played_time: a match's home without a join with its classes and its document."""
    return match_part(F.col("analysis_set"), F.col("rule_raw"), F.col("played_time"), F.col("match_key"))


def match_part(analysis_set: Column, rule_raw: Column, played: Column, match_key: Column) -> Column:
    return _path("matches", _segment(analysis_set, "unclassified"), _segment(rule_raw, "no-rule"), paths.local_day_path(played), _segment(match_key, "no-match-key"))


def prefer_vs(homes: DataFrame) -> DataFrame:
    """One home for each (account, match_key): that of the vs match if there is one, else of the first kind."""
    w = W.partitionBy("account", "match_key").orderBy((F.col("kind") != "vs").cast("int"), "kind")
    return homes.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "kind")


def response_home(responses: DataFrame, documents: DataFrame, homes: DataFrame | None = None) -> DataFrame:
    """(id, part): the home of the first match whose detail it is, else a part of its operation and hour; ranking responses have their own.

    Without ``homes`` the documents have their match's home already, as part.
    """
    placed = documents if homes is None else documents.join(homes, KEY)
    first = placed.groupBy(F.col("response_id").alias("id")).agg(F.min_by("part", F.struct(*KEY)).alias("_match"))
    r = responses.select("id", "operation", "fetched_at").join(first, "id", "left")
    return r.select("id", F.coalesce("_match", own_response_part(F.col("operation"), F.col("fetched_at"), F.col("id"))).alias("part"))


def own_response_part(operation: Column, fetched_at: Column, response_id: Column) -> Column:
    """Where a response lives that is no match's detail."""
    op, period = _segment(operation, "no-operation"), paths.response_period(operation, fetched_at)
    return F.when(operation.isin(*paths.RANKING_OPERATIONS), _path("responses", op, period, response_id.cast("string"))).otherwise(_path("responses", op, period))


def fetch_home(fetched_at: Column) -> Column:
    return _path("fetches", paths.local_day_path(fetched_at))


def feed_home(changed_at: Column) -> Column:
    hour = F.date_format(F.from_utc_timestamp(paths.instant(changed_at), paths.LOCAL_ZONE), "yyyy-MM-dd/HH")
    return _path("system/archive_change_feed", F.coalesce(hour, F.lit("unknown-date/unknown-hour")))


def image_home(body_sha256: Column) -> Column:
    return F.when(F.coalesce(body_sha256, F.lit("")) == "", _path("images", "no-body")).otherwise(_path("images", paths.encode_segment(F.substring(body_sha256, 1, 2))))


def home_of(table: str, rows: DataFrame, homes: dict[str, DataFrame]) -> DataFrame:
    """``rows`` with part, by the rules of the table; rows whose parent is missing go to unplaced, never away.

    ``homes``: match (account, kind, match_key, part), any_match (account, match_key, part), response (id, part), fetches (event_id, fetched_at).
    """
    lost, system = F.lit(f"unplaced/{table}{SUFFIX}"), F.lit(f"system/{table}{SUFFIX}")
    if table in ("matches", "match_classification", "match_refs", "documents"):
        return rows.join(homes["match"], KEY, "left").withColumn("part", F.coalesce("part", lost))
    if table == "match_tags":
        return rows.join(homes["any_match"], ["account", "match_key"], "left").withColumn("part", F.coalesce("part", lost))
    if table == "rate_points":
        at = homes["fetches"].select(F.concat(F.lit("fetch:"), "event_id").alias("match_key"), fetch_home(F.col("fetched_at")).alias("_fetch"))
        r = rows.join(homes["any_match"], ["account", "match_key"], "left").join(at, "match_key", "left")
        return r.withColumn("part", F.coalesce(F.when(F.col("match_key").startswith("fetch:"), F.col("_fetch")).otherwise(F.col("part")), lost)).drop("_fetch")
    if table == "jobs":
        return rows.join(homes["match"], KEY, "left").withColumn("part", F.coalesce("part", system))
    if table == "responses":
        return rows.join(homes["response"], "id", "left").withColumn("part", F.coalesce("part", lost))
    if table in ("sightings", "asset_refs", "entities", "issues"):
        r = rows.join(homes["response"].withColumnRenamed("id", "response_id"), "response_id", "left")
        return r.withColumn("part", F.when(F.col("response_id").isNull() & F.lit(table == "issues"), system).otherwise(F.coalesce("part", lost)))
    if table == "response_fetches":
        return rows.withColumn("part", fetch_home(F.col("fetched_at")))
    if table == "assets":
        return rows.withColumn("part", image_home(F.col("body_sha256")))
    if table == "archive_change_feed":
        return rows.withColumn("part", feed_home(F.col("changed_at")))
    return rows.withColumn("part", system if table in SYSTEM_TABLES else lost)


def body_homes(bodies: DataFrame, responses: DataFrame, response_homes: DataFrame, assets: DataFrame) -> DataFrame:
    """(sha256, part, role): one home for each body and a copy in every other part that refers to it."""
    images = assets.where("coalesce(body_sha256, '') <> ''").select(F.col("body_sha256").alias("sha256")).distinct().withColumn("_image", F.lit(True))
    refs = responses.select("id", F.col("body_sha256").alias("sha256")).join(response_homes, "id").groupBy("sha256", "part").agg(F.min("id").alias("first"))
    refs = refs.join(refs.groupBy("sha256").agg(F.min("first").alias("least")), "sha256").join(images, "sha256", "left")
    placed = refs.select("sha256", "part", F.when((F.col("first") == F.col("least")) & F.col("_image").isNull(), "home").otherwise("copy").alias("role"))
    own = images.select("sha256", image_home(F.col("sha256")).alias("part"), F.lit("home").alias("role"))
    lost = bodies.select("sha256").join(images, "sha256", "left_anti").join(refs, "sha256", "left_anti").select("sha256", F.lit(f"unplaced/bodies{SUFFIX}").alias("part"), F.lit("home").alias("role"))
    return own.unionByName(placed).unionByName(lost)


def rebuild_mode(has_feed: bool, first_run: bool, rules_before: int, rules_now: int, schema_before: str, schema_now: str, high_before: int, high_now: int, unknown_rows: int) -> str:
    """full or delta."""
    full = not has_feed or first_run or rules_before != rules_now or schema_before != schema_now or high_now < high_before or unknown_rows > 0
    return "full" if full else "delta"


def dirty_parts(before: DataFrame, now: DataFrame, touched: DataFrame, key: list[str]) -> DataFrame:
    """Parts to rebuild: both sides of every moved, new or lost row, and the parts of touched rows. Inputs have key and part; touched the key."""
    moved = before.select(*key, "part").subtract(now.select(*key, "part")).unionByName(now.select(*key, "part").subtract(before.select(*key, "part"))).select("part")
    return moved.unionByName(now.join(touched.select(*key).distinct(), key, "left_semi").select("part")).distinct()


def emptied_parts(before: DataFrame, now: DataFrame) -> DataFrame:
    """Parts that no row lives in any more."""
    return before.select("part").distinct().join(now.select("part").distinct(), "part", "left_anti")


def match_index(matches: DataFrame, classification: DataFrame, homes: DataFrame, tags: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each match: identity, population and rule (or that there is none), time, stage, result, own weapon, tags in order, whether it has a detail, part."""
    c = classification.select(*KEY, F.nullif("analysis_set", F.lit("")).alias("analysis_set"), F.nullif("rule_raw", F.lit("")).alias("rule_raw"), "rule_name")
    d = jsonx.with_parsed(documents, "_v").select(F.col("response_id").alias("detail_response_id"), *KEY, *[x(F.col("_v")).alias(n) for n, x in INDEXED.items()], F.lit(1).alias("_there"))
    m = matches.select(*KEY, "detail_response_id").join(d, ["detail_response_id", *KEY], "left").join(c, KEY, "left").join(homes, KEY, "left")
    return _indexed(m, tags)


def _if_vs(path: str, other: str | None = None) -> Callable[[Column], Column]:
    return lambda v: F.when(F.col("kind") == "vs", jsonx.text(v, path)).otherwise(jsonx.text(v, other) if other else F.lit(None))


#: What the index shows of a match's detail.
INDEXED = {"played_time": lambda v: jsonx.text(v, "$.playedTime"), "stage": _if_vs("$.vsStage.name", "$.coopStage.name"), "judgement": _if_vs("$.judgement"), "my_weapon": _if_vs("$.player.weapon.name")}


def classified_index(classified: DataFrame, tags: DataFrame) -> DataFrame:
    """``match_index`` with the homes, from every match with its classes and ``INDEXED`` texts (``details.classified`` with ``how="left"``): one pass over the documents."""
    named = {c: F.nullif(c, F.lit("")).alias(c) for c in ("analysis_set", "rule_raw")}
    return _indexed(classified.select(*KEY, *named.values(), "rule_name", *INDEXED, F.when(F.col("genre").isNotNull(), 1).alias("_there"), home_part().alias("part")), tags)


def _indexed(m: DataFrame, tags: DataFrame) -> DataFrame:
    t = tags.groupBy("account", "match_key").agg(F.array_join(F.array_sort(F.collect_set("tag")), "、").alias("tags"))
    return m.join(t, ["account", "match_key"], "left").select(
        *KEY, F.coalesce("analysis_set", F.lit("unclassified")).alias("analysis_set"), F.coalesce("rule_raw", F.lit("no-rule")).alias("rule_raw"), "rule_name",
        *INDEXED, "tags", F.coalesce("_there", F.lit(0)).alias("detail_available"), "part",
    )


def response_index(responses: DataFrame, homes: DataFrame, fetches: DataFrame) -> DataFrame:
    """One row for each response: operation, status, part, how often it was fetched, first and last."""
    n = fetches.groupBy("response_id").agg(F.count("*").alias("fetches"), F.min("fetched_at").alias("first_fetched_at"), F.max("fetched_at").alias("last_fetched_at"))
    r = responses.select("id", "account", "operation", "http_status").join(homes, "id", "left")
    return r.join(n.withColumnRenamed("response_id", "id"), "id", "left").withColumn("fetches", F.coalesce("fetches", F.lit(0)))


def asset_index(assets: DataFrame, bodies: DataFrame) -> DataFrame:
    """One row for each asset: state, content type, length of the stored body and the part that holds it."""
    b = bodies.select(F.col("sha256").alias("body_sha256"), "byte_length")
    return assets.select("url", "state", "content_type", "body_sha256").join(b, "body_sha256", "left").select("url", "state", "content_type", "byte_length", image_home(F.col("body_sha256")).alias("part"))


def table_homes(placed: DataFrame) -> DataFrame:
    """(table_name, parts, rows): in how many parts a table lives, from rows (part, table_name, role) of homes and copies."""
    return placed.where("role = 'home'").groupBy("table_name").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("rows"))


def publication(published: DataFrame, verified: DataFrame) -> DataFrame:
    """(step, action, part) in order: new or changed parts (by sha256) are sent first, the catalog then, and only after it lost ones are deleted."""
    new = verified.join(published, ["part", "sha256"], "left_anti").select(F.lit(1).alias("step"), F.lit("send").alias("action"), "part")
    gone = published.join(verified.select("part"), "part", "left_anti").select(F.lit(3).alias("step"), F.lit("delete").alias("action"), "part")
    change = new.unionByName(gone)
    return change.unionByName(change.groupBy().agg(F.count("*").alias("n")).where("n > 0").select(F.lit(2).alias("step"), F.lit("catalog").alias("action"), F.lit(None).cast("string").alias("part"))).orderBy("step", "part")


def refreshed_index(previous: DataFrame, recomputed: DataFrame) -> DataFrame:
    """The index after an incremental run: recomputed rows replace theirs, all others stay."""
    return previous.join(recomputed.select(*KEY), KEY, "left_anti").unionByName(recomputed)


def part_counts(placed: DataFrame) -> DataFrame:
    """(part, counts as JSON) from rows (part, table_name, role)."""
    n = placed.groupBy("part", "table_name", "role").agg(F.count("*").alias("n"))
    return n.groupBy("part").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat_ws(":", "table_name", "role"), "n"))))).alias("counts"))


def parsed_path(part: Column) -> Column:
    """What a part's path tells: domain, population, rule, month, day, operation, hour, name."""
    p, stem = F.split(F.regexp_replace(part, r"\.[a-z0-9]+$", ""), "/"), F.size(F.split(part, "/"))
    at = lambda i: F.try_element_at(p, F.lit(i))
    match, resp = at(1) == "matches", at(1) == "responses"
    dated = at(4).rlike(r"^\d{4}-\d{2}$")
    return F.struct(
        at(1).alias("domain"), F.when(match, at(2)).alias("analysis_set"), F.when(match, at(3)).alias("rule_raw"),
        F.when(match & dated, at(4)).when(resp & at(3).rlike(r"^\d{4}-\d{2}$"), at(3)).alias("month"), F.when(match & dated, at(5)).when(resp & at(4).rlike(r"^\d{4}-\d{2}-\d{2}$"), at(4)).alias("day"),
        F.when(resp, paths.decode_segment(at(2))).alias("operation"), F.when(resp & (stem == 5) & at(5).rlike(r"^\d{2}$"), at(5)).alias("hour"), paths.decode_segment(F.element_at(p, -1)).alias("name"),
    )


def row_digests(rows: DataFrame, key: str) -> DataFrame:
    """(key, digest): SHA-256 of a row's typed cells."""
    return rows.select(key, F.sha2(cell_key(rows, rows.columns), 256).alias("digest"))


def audit(source: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """(key, problem): rows without exactly one home, with another content in a part, or that the source lacks. ``parts`` adds role."""
    s = row_digests(source, key).withColumnRenamed("digest", "want")
    p = parts.select(key, "role", F.sha2(cell_key(parts, source.columns), 256).alias("digest")).groupBy(key).agg(F.count_if(F.col("role") == "home").alias("homes"), F.min("digest").alias("lo"), F.max("digest").alias("hi"))
    problem = F.when(F.col("want").isNull(), "not in source").when(F.coalesce("homes", F.lit(0)) != 1, "homes").when((F.col("lo") != F.col("want")) | (F.col("hi") != F.col("want")), "content")
    return s.join(p, key, "full_outer").withColumn("problem", problem).where("problem is not null").select(key, "problem")


def write(placed: DataFrame, path: str) -> None:
    """Rows by population, rule and day as Parquet partitions; only partitions that occur are overwritten."""
    at = parsed_path(F.col("part"))
    out = placed.withColumns({"p_set": F.coalesce(at["analysis_set"], at["domain"]), "p_rule": F.coalesce(at["rule_raw"], F.lit("none")), "p_day": F.coalesce(at["day"], F.lit(paths.UNKNOWN_DATE))})
    out.repartition("p_set", "p_rule", "p_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("p_set", "p_rule", "p_day").parquet(path)
