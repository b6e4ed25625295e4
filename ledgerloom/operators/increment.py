"""Incremental layout: from a feed of changed rows to the parts that must be rebuilt, by closing over what depends on them.

A row's part is the home of the entity that it belongs to (a match, a response, a body ...), and an entity's home follows
from the rows that tell of it and from the homes of other entities. What is kept is narrow: each row's links to
entities, with the values that homes need, and each entity's homes. A run reads the feed and the buckets of the entities that the feed names, works out
their homes anew, goes on with the entities that depend on those whose home has changed, and ends where nothing changes
any more. It never compares whole tables, and never reads the source tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..sources import shared
from ..sources.commits import BucketTable, CommitLog, commit_tables
from . import layout

SEP = "\x1f"
#: A link: the row tells of an entity (value: what it tells), and lives where the entity lives if it is a member.
LINK = "struct<entity: string, key: string, value: map<string, string>, member: boolean>"
CHANGE = f"table_name string, id string, op string, links array<{LINK}>"


def key_of(*columns: Column | str) -> Column:
    return F.concat_ws(SEP, *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns])


def part_of(key: Column, i: int) -> Column:
    return F.split(key, SEP)[i]


def _family(key: str = "key") -> Column:
    """What a bucket follows from: the first two parts of a key, so a match and its (account, match_key) share one."""
    return F.substring_index(F.col(key), SEP, 2)


@dataclass
class Entity:
    """``home(links, homes)`` gives (key, part, role) from the links of some keys; ``homes(name, keys)`` looks up homes of other entities.

    ``after`` names those entities, each with what gives this one's keys from the links of theirs (key, table_name, value).
    """

    name: str
    home: Callable[[DataFrame, Callable[[str, DataFrame], DataFrame]], DataFrame]
    after: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)


@dataclass
class Step:
    """What a run found: parts to rebuild, rows that moved (table_name, id, part, role, side), parts left without rows, and the commit."""

    dirty: DataFrame
    moved: DataFrame
    emptied: DataFrame
    commit: dict


def links(table: str, rows: DataFrame) -> DataFrame:
    """(table_name, id, links) of rows of an archive table; ``id`` is the row's identity as text."""
    link = lambda entity, key, member=True, **value: F.struct(
        F.lit(entity).alias("entity"), key.alias("key"), F.map_from_arrays(F.array(*[F.lit(n) for n in value]), F.array(*[v.cast("string") for v in value.values()])).cast("map<string,string>").alias("value") if value else F.create_map().cast("map<string,string>").alias("value"), F.lit(member).alias("member"),
    )
    match, any_match = key_of("account", "match_key", "kind") if "kind" in rows.columns else None, key_of("account", "match_key") if "match_key" in rows.columns else None
    if table == "matches":
        found = [link("match", match, detail=F.col("detail_response_id"))]
    elif table == "match_classification":
        found = [link("match", match, analysis_set=F.col("analysis_set"), rule_raw=F.col("rule_raw"))]
    elif table == "documents":
        response = key_of("response_id")
        found = [link("match", match, response=F.col("response_id"), played=F.col("played")), link("response", response, False, match=match)]
    elif table in ("match_refs", "jobs"):
        found = [link("match", match)]
    elif table == "match_tags":
        found = [link("any_match", any_match)]
    elif table == "rate_points":
        fetch = F.col("match_key").startswith("fetch:")
        found = [F.when(fetch, link("fetch", F.substring("match_key", 7, 1 << 30))).otherwise(link("any_match", any_match))]
    elif table == "responses":
        own = layout.own_response_part(F.col("operation"), F.col("fetched_at"), F.col("id"))
        found = [link("response", key_of("response_id"), own=own, body=F.col("body_sha256"))]
        found.append(F.when(F.col("body_sha256").isNotNull(), link("body", F.col("body_sha256"), False, response=F.col("response_id"))))
    elif table in ("sightings", "asset_refs", "entities", "issues"):
        found = [link("response", key_of("response_id"))]
    elif table == "response_fetches":
        found = [link("fetch", F.col("event_id"), own=layout.fetch_home(F.col("fetched_at")))]
    elif table == "assets":
        found = [link("own", key_of(F.lit(table), "id"), own=layout.image_home(F.col("body_sha256")))]
        found.append(F.when(F.coalesce(F.col("body_sha256"), F.lit("")) != "", link("body", F.col("body_sha256"), False, image=F.lit("1"))))
    elif table == "bodies":
        found = [link("body", F.col("sha256"))]
    elif table == "archive_change_feed":
        found = [link("own", key_of(F.lit(table), "id"), own=layout.feed_home(F.col("changed_at")))]
    else:
        found = [link("own", key_of(F.lit(table), "id"), own=F.lit(f"{'system' if table in layout.SYSTEM_TABLES else 'unplaced'}/{table}{layout.SUFFIX}"))]
    return rows.select(F.lit(table).alias("table_name"), F.col("id").cast("string").alias("id"), F.array_compact(F.array(*found)).cast(f"array<{LINK}>").alias("links"))


def _own(links_: DataFrame, _) -> DataFrame:
    return links_.where(F.col("value")["own"].isNotNull()).groupBy("key").agg(F.max(F.col("value")["own"]).alias("part")).withColumn("role", F.lit("home"))


def _match(links_: DataFrame, _) -> DataFrame:
    of = lambda table, *names: links_.where(F.col("table_name") == table).select("key", *[F.col("value")[n].alias(n) for n in names])
    m = of("matches", "detail").join(of("match_classification", "analysis_set", "rule_raw"), "key", "left").join(of("documents", "response", "played").withColumnRenamed("response", "detail"), ["key", "detail"], "left")
    return m.select("key", layout.match_part(F.col("analysis_set"), F.col("rule_raw"), F.col("played"), part_of(F.col("key"), 1)).alias("part"), F.lit("home").alias("role"))


def _any_match(links_: DataFrame, homes) -> DataFrame:
    """A vs match's home before that of other kinds."""
    keys = links_.select("key").distinct()
    kind = part_of(F.col("key"), 2)
    found = homes("match", keys, family=True).withColumn("_any", _family())
    return found.groupBy(F.col("_any").alias("key")).agg(F.min_by("part", F.struct(kind != "vs", kind)).alias("part")).withColumn("role", F.lit("home"))


def _response(links_: DataFrame, homes) -> DataFrame:
    """The home of the first match whose detail the response is, else the response's own."""
    details = links_.where("table_name = 'documents'").select("key", F.col("value")["match"].alias("match"))
    at = homes("match", details.select(F.col("match").alias("key")).distinct()).select(F.col("key").alias("match"), F.col("part").alias("_part"))
    order = F.struct(part_of(F.col("match"), 0), part_of(F.col("match"), 2), part_of(F.col("match"), 1))
    first = details.join(at, "match").groupBy("key").agg(F.min_by("_part", order).alias("_part"))
    own = links_.where("table_name = 'responses'").groupBy("key").agg(F.max(F.col("value")["own"]).alias("own"))
    return own.join(first, "key", "left").select("key", F.coalesce("_part", "own").alias("part"), F.lit("home").alias("role"))


def _body(links_: DataFrame, homes) -> DataFrame:
    """An image's body lives with the images; others with the first response that has them. Every other part that refers to a body has a copy."""
    there = links_.where("table_name = 'bodies'").select("key").distinct()
    images = links_.where("table_name = 'assets'").select("key").distinct()
    by = links_.where("table_name = 'responses'").select("key", F.col("value")["response"].alias("response"))
    at = homes("response", by.select(F.col("response").alias("key")).distinct()).select(F.col("key").alias("response"), "part")
    refs = by.join(at, "response").groupBy("key", "part").agg(F.min(F.lpad("response", 20, "0")).alias("first"))
    least = refs.groupBy("key").agg(F.min("first").alias("least"))
    refs = refs.join(least, "key").join(images.withColumn("_image", F.lit(True)), "key", "left")
    placed = refs.select("key", "part", F.when((F.col("first") == F.col("least")) & F.col("_image").isNull(), "home").otherwise("copy").alias("role"))
    own = images.select("key", layout.image_home(F.col("key")).alias("part"), F.lit("home").alias("role"))
    return own.unionByName(placed).join(there, "key", "left_semi")


#: The archive's entities, each after those that its home follows from.
ENTITIES = [
    Entity("own", _own),
    Entity("fetch", _own),
    Entity("match", _match),
    Entity("any_match", _any_match, {"match": lambda found: found.select(_family().alias("key"))}),
    Entity("response", _response, {"match": lambda found: found.where("table_name = 'documents'").select(F.col("value")["response"].alias("key"))}),
    Entity("body", _body, {"response": lambda found: found.where("table_name = 'responses' and value['body'] is not null").select(F.col("value")["body"].alias("key"))}),
]


def fallback(table: Column) -> Column:
    """Where a row lives whose entity has no home."""
    return F.when(table.isin("jobs", "issues"), F.concat(F.lit("system/"), table, F.lit(layout.SUFFIX))).otherwise(F.concat(F.lit("unplaced/"), table, F.lit(layout.SUFFIX)))


class IncrementalLayout:
    """The kept state below ``root``: links by entity, homes by entity, links by row, row counts by part; all in ``buckets`` buckets under one commit log."""

    def __init__(self, spark: SparkSession, root: str, entities: list[Entity] | None = None, buckets: int = 64):
        self.spark, self.log, self.entities = spark, CommitLog(spark, root), entities or ENTITIES
        table = lambda name, schema, key, bucket: BucketTable(self.log, name, schema, key, bucket, buckets)
        self.links = table("links", "entity string, key string, table_name string, id string, value map<string,string>, member boolean", ["entity", "key", "table_name", "id"], _family())
        self.homes = table("homes", "entity string, key string, places array<struct<part: string, role: string>>", ["entity", "key"], _family())
        self.rows = table("rows", f"table_name string, id string, links array<{LINK}>", ["table_name", "id"], F.concat_ws(SEP, "table_name", "id"))
        self.counts = table("counts", "part string, n bigint", ["part"], F.col("part"))

    def placed(self, commit: dict | None = None) -> DataFrame:
        """(table_name, id, part, role) of every row of a version."""
        commit = commit or self.log.read()
        members = self.links.read(commit).where("member")
        return self._placed(members, self.homes.read(commit))

    @staticmethod
    def _placed(members: DataFrame, homes: DataFrame) -> DataFrame:
        lost = F.array(F.struct(fallback(F.col("table_name")).alias("part"), F.lit("home").alias("role")))
        places = F.when(F.size("places") > 0, F.col("places")).otherwise(lost)
        return members.join(homes.select("entity", "key", "places"), ["entity", "key"], "left").select("table_name", "id", F.inline(places))

    def advance(self, changes: DataFrame) -> Step:
        """Takes in the net changes (table_name, id, op upsert/delete, links) and publishes the next version of the state.

        One change for each row. Raises ``Conflict`` if another writer was there first with the same buckets; a repeated feed changes nothing.
        """
        spark, base, made, read = self.spark, self.log.read(), [], {}

        def keep(df: DataFrame, name: str) -> DataFrame:
            made.append(shared.scratch(spark, name))
            return shared.written(df, made[-1])

        def at(table: BucketTable, keys: DataFrame, on: list[str], buckets: list[int] | None = None) -> DataFrame:
            buckets = table.touched(keys) if buckets is None else buckets
            read[table.name] = sorted({*read.get(table.name, []), *buckets})
            return table.lookup(base, keys, on, buckets)

        changes = keep(changes.select("table_name", "id", "op", F.col("links").cast(f"array<{LINK}>").alias("links")), "changes")
        before = at(self.rows, changes, ["table_name", "id"]).withColumnRenamed("links", "_old")
        both = changes.join(before, ["table_name", "id"], "left")
        now = F.when(F.col("op") == "upsert", F.col("links"))
        side = lambda links_, sign: both.select("table_name", "id", F.inline(links_), F.lit(sign).alias("sign"))
        delta = keep(side(F.col("_old"), -1).unionByName(side(now, 1)), "delta")

        new_homes: dict[str, DataFrame] = {}  # of the keys that were looked at: entity, key, was, places
        seen: dict[str, DataFrame] = {}  # their links, before (sign -1) and after (sign 1)

        def homes_of(name: str, keys: DataFrame, family: bool = False) -> DataFrame:
            on = [_family()] if family else ["key"]
            state = at(self.homes, keys.withColumn("entity", F.lit(name)), ["entity", "key"]).where(F.col("entity") == name) if not family else self._family_homes(base, name, keys, read)
            if name in new_homes:
                fresh = new_homes[name].select("entity", "key", "places")
                wanted = keys.select(F.col("key").alias("_k")).distinct()
                fresh = fresh.join(wanted, on[0] == F.col("_k") if family else fresh["key"] == F.col("_k"), "left_semi")
                state = state.join(new_homes[name].select("entity", "key"), ["entity", "key"], "left_anti").unionByName(fresh)
            return state.select("key", F.inline("places")).where("role = 'home'")

        for e in self.entities:
            keys = delta.where(F.col("entity") == e.name).select("key")
            for name, follow in e.after.items():
                if name not in new_homes:
                    continue
                moved = new_homes[name].where("not (was <=> places)").select("key")
                keys = keys.unionByName(follow(seen[name].join(moved, "key", "left_semi")).where("key is not null"))
            keys = keep(keys.distinct().withColumn("entity", F.lit(e.name)), f"keys-{e.name}")
            if not (buckets := self.links.touched(keys)):
                continue  # nothing of the kind is touched
            mine = delta.where(F.col("entity") == e.name)
            old = at(self.links, keys, ["entity", "key"], buckets).where(F.col("entity") == e.name)  # known to the scan, so other entities' links stay out of the join
            kept = old.join(mine.where("sign = -1").select("entity", "key", "table_name", "id"), ["entity", "key", "table_name", "id"], "left_anti")
            cols = ["entity", "key", "table_name", "id", "value", "member"]
            after = kept.select(*cols).unionByName(mine.where("sign = 1").select(*cols))
            seen[e.name] = keep(old.select(*cols).withColumn("sign", F.lit(-1)).unionByName(after.withColumn("sign", F.lit(1))), f"links-{e.name}")
            homes = e.home(seen[e.name].where("sign = 1").select(*cols), homes_of)
            places = homes.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("part", "role"))).alias("places"))  # a body's: one a part that refers to it
            was = at(self.homes, keys, ["entity", "key"], buckets).where(F.col("entity") == e.name).select("key", F.col("places").alias("was"))
            new_homes[e.name] = keep(keys.join(places, "key", "left").join(was, "key", "left").select("entity", "key", "was", "places"), f"homes-{e.name}")

        if not seen:
            none = spark.createDataFrame([], "part string")
            return Step(none, spark.createDataFrame([], "table_name string, id string, part string, role string, side bigint"), none, base)
        every = lambda frames: self._union(list(frames.values()))
        members = every(seen).where("member")
        looked = every(new_homes)
        side_of = lambda sign, places: self._placed(members.where(F.col("sign") == sign), looked.select("entity", "key", F.col(places).alias("places")))
        placed = keep(side_of(-1, "was").withColumn("sign", F.lit(-1)).unionByName(side_of(1, "places").withColumn("sign", F.lit(1))), "placed")
        moved = placed.groupBy("table_name", "id", "part", "role").agg(F.sum("sign").alias("side")).where("side <> 0")
        touched = placed.join(changes.select("table_name", "id"), ["table_name", "id"], "left_semi").select("part")
        dirty = keep(moved.select("part").unionByName(touched).distinct(), "dirty")
        step = placed.groupBy("part").agg(F.sum("sign").alias("step")).where("step <> 0")
        counted = at(self.counts, dirty, ["part"])
        counts = keep(step.join(counted, "part", "left").select("part", (F.col("step") + F.coalesce("n", F.lit(0))).alias("n")), "counts")

        gone = F.lit(True)
        new_links = delta.groupBy("entity", "key", "table_name", "id").agg(F.max_by(F.struct("value", "member"), "sign").alias("_v"), F.max("sign").alias("_s"))
        moved_homes = looked.where("not (was <=> places)")
        written = {
            "rows": self.rows.write(base, changes.select("table_name", "id", F.when(F.col("op") == "upsert", F.col("links")).alias("links"), (F.col("op") != "upsert").alias("_gone"))),
            "links": self.links.write(base, new_links.select("entity", "key", "table_name", "id", "_v.value", "_v.member", (F.col("_s") < 0).alias("_gone"))),
            "homes": self.homes.write(base, moved_homes.select("entity", "key", "places", F.col("places").isNull().alias("_gone"))),
            "counts": self.counts.write(base, counts.select("part", "n", F.when(F.col("n") == 0, gone).otherwise(~gone).alias("_gone"))),
        }
        commit = commit_tables(self.log, base, written, read)
        moved = shared.written(moved, shared.scratch(spark, "moved"))
        shared.discard(*[p for p in made if "-dirty-" not in p and "-counts-" not in p])
        return Step(dirty, moved, counts.where("n = 0").select("part"), commit)

    def _family_homes(self, base: dict, name: str, keys: DataFrame, read: dict) -> DataFrame:
        read["homes"] = sorted({*read.get("homes", []), *self.homes.touched(keys)})
        rows = self.homes.read(base, self.homes.touched(keys)).where(F.col("entity") == name)
        return rows.join(keys.select(F.col("key").alias("_k")).distinct(), _family() == F.col("_k"), "left_semi")

    @staticmethod
    def _union(frames: list[DataFrame]) -> DataFrame:
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f)
        return out


def net(before: DataFrame, after: DataFrame) -> DataFrame:
    """The changes (table_name, id, op, links) between two whole tables of links, for tests and first runs; links are compared by their digests."""
    digest = F.unhex(F.sha2(F.to_json("links"), 256))
    old, new = before.select("table_name", "id", digest.alias("_o")), after.select("table_name", "id", "links", digest.alias("_n"))
    return old.join(new, ["table_name", "id"], "full_outer").where("not (_o <=> _n)").select("table_name", "id", F.when(F.col("_n").isNull(), "delete").otherwise("upsert").alias("op"), "links")
