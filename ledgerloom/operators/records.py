"""Record search: filters, pages, totals, facets and summaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from . import classify, details, views

_TOKEN = re.compile(r"[A-Za-z0-9_-]{1,64}")
_CONTROL = re.compile(r"[\x00-\x1f\x7f]")


@dataclass(frozen=True)
class Search:
    """What a caller may ask for; every filter but the account may be left out, and all are and-ed."""

    account: str
    kind: str | None = None
    analysis_set: str | None = None
    rule_raw: str | None = None
    played_from: str | None = None
    played_to: str | None = None
    weapon: str | None = None
    tag: str | None = None
    query: str | None = None
    limit: int = 50
    offset: int = 0

    def __post_init__(self) -> None:
        if not self.account:
            raise ValueError("an account is needed")
        if isinstance(self.limit, bool) or not 1 <= self.limit <= 200 or isinstance(self.offset, bool) or self.offset < 0:
            raise ValueError("limit is 1 to 200, offset 0 or more")
        if self.kind not in (None, "vs", "coop"):
            raise ValueError("kind is vs or coop")
        for name in ("analysis_set", "rule_raw"):
            if (x := getattr(self, name)) is not None and not _TOKEN.fullmatch(x):
                raise ValueError(f"{name} is no token")
        for name in ("weapon", "tag", "query"):
            if (x := getattr(self, name)) is not None and (not 1 <= len(x) <= 80 or _CONTROL.search(x)):
                raise ValueError(f"{name} has 1 to 80 characters, none of them control characters")
        if self.played_from and self.played_to and self.played_from > self.played_to:
            raise ValueError("played_from is after played_to")


def records(matches: DataFrame, documents: DataFrame, classification: DataFrame) -> DataFrame:
    """Matches with what lists show; bodies and whole documents are not read beyond the parsed scalars."""
    d = documents.withColumnRenamed("response_id", "detail_response_id")
    v = F.col("_v")
    d = jsonx.with_parsed(d, "_v").select("detail_response_id", *views.KEY, jsonx.text(v, "$.playedTime").alias("played_time"), jsonx.text(v, "$.judgement").alias("judgement"), F.coalesce(jsonx.text(v, "$.vsStage.name"), jsonx.text(v, "$.coopStage.name")).alias("stage"))
    return matches.join(d, ["detail_response_id", *views.KEY], "left").join(classification.drop("detail_response_id"), views.KEY, "left")


def own_weapons(v: Column) -> Column:
    """The names of the weapons that the player had in a match, each once."""
    none = F.array().cast("array<variant>")
    teams = F.concat(F.array(F.try_variant_get(v, "$.myTeam", "variant")), F.coalesce(jsonx.elements(v, "$.otherTeams"), none))
    players = F.flatten(F.transform(teams, lambda t: F.coalesce(F.try_variant_get(t, "$.players", "array<variant>"), none)))
    mine = F.filter(players, lambda p: F.coalesce(jsonx.integer(p, "$.isMyself") == 1, F.lit(False)))
    return F.array_distinct(F.array_compact(F.transform(mine, lambda p: jsonx.text(p, "$.weapon.name"))))


def indexed(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """``records`` with classes and the player's own weapons (an array), all taken out of each detail in one pass and joined once."""
    v = lambda path: (lambda x: jsonx.text(x, path))
    stage = lambda x: F.coalesce(jsonx.text(x, "$.vsStage.name"), jsonx.text(x, "$.coopStage.name"))
    shown = {"played_time": v("$.playedTime"), "judgement": v("$.judgement"), "stage": stage, "weapons": own_weapons}
    known = classify.classify(details.match_details(matches, documents), also=shown).drop("detail_response_id")
    return matches.join(known, views.KEY, "left")


SEARCHED = ("match_key", "rule_raw", "rule_name", "stage", "judgement", "analysis_set", "genre", "mode_raw")


def search(frame: DataFrame, s: Search, weapons: DataFrame | None, tags: DataFrame) -> DataFrame:
    """All rows of ``records`` that fit. ``weapons`` (account, match_key, weapon) are the player's own, ``tags`` those of matches.

    A frame of ``indexed`` has its weapons in a column and needs none beside it. Text is compared byte for byte. Weapon and tag tests are semi-joins; a free text query may
    also hit either, so there the keys that hit are joined on and or-ed with the columns.
    """
    key = ["account", "match_key"]
    out = frame.where(F.col("account") == s.account)
    if s.kind:
        out = out.where(F.col("kind") == s.kind)
    if s.analysis_set == "unclassified":
        out = out.where("analysis_set is null")
    elif s.analysis_set:
        out = out.where(F.col("analysis_set") == s.analysis_set)
    if s.rule_raw:
        out = out.where(F.col("rule_raw") == s.rule_raw)
    if s.played_from:
        out = out.where(F.col("played_time") >= s.played_from)
    if s.played_to:
        out = out.where(F.col("played_time") <= s.played_to)
    if s.weapon and weapons is None:
        out = out.where(F.array_contains("weapons", s.weapon))
    elif s.weapon:
        out = out.join(weapons.where(F.col("weapon") == s.weapon), key, "left_semi")
    if s.tag:
        out = out.join(tags.where(F.col("tag") == s.tag), key, "left_semi")
    if s.query:
        named = tags.where(F.col("tag").contains(s.query)).select(*key)
        here: Column = F.lit(False)
        if weapons is None:
            here = F.coalesce(F.exists("weapons", lambda w: w.contains(s.query)), F.lit(False))
        else:
            named = named.unionByName(weapons.where(F.col("weapon").contains(s.query)).select(*key))
        named = named.distinct().withColumn("_named", F.lit(True))
        for c in (c for c in SEARCHED if c in frame.columns):
            here = here | F.coalesce(F.col(c).contains(s.query), F.lit(False))
        out = out.join(named, key, "left").where(here | F.col("_named").isNotNull()).drop("_named")
    return out


def get(frame: DataFrame, account: str, kind: str, match_key: str) -> DataFrame:
    """The one record of a match with its detail_state's columns, no row if there is none; the key reaches the scans as a filter."""
    return frame.where((F.col("account") == account) & (F.col("kind") == kind) & (F.col("match_key") == match_key)).limit(1)


def only_account(matches: DataFrame) -> DataFrame:
    """(accounts, account): how many accounts there are, and the one if it is only one. Two distinct names are enough to know."""
    few = matches.select("account").where("account is not null").distinct().limit(2)
    return few.agg(F.count("*").alias("accounts"), F.when(F.count("*") == 1, F.max("account")).alias("account"))


def tag_lists(classification: DataFrame, tags: DataFrame) -> DataFrame:
    """(account, kind, match_key, tags) for a sheet: each match's tags in order, comma-joined; empty without any."""
    t = tags.groupBy("account", "match_key").agg(F.array_join(F.array_sort(F.collect_set("tag")), ", ").alias("tags"))
    return classification.select(*views.KEY).join(t, ["account", "match_key"], "left").select(*views.KEY, F.coalesce("tags", F.lit("")).alias("tags"))


def page(found: DataFrame, s: Search) -> DataFrame:
    """One page in order of kind and key."""
    return found.orderBy("kind", "match_key").offset(s.offset).limit(s.limit)


def total(found: DataFrame) -> DataFrame:
    return found.groupBy().agg(F.count("*").alias("total"))


def truncated(found: DataFrame, limit: int) -> tuple[DataFrame, bool]:
    """The first rows and whether more follow, by asking for one row more."""
    return found.limit(limit), found.limit(limit + 1).count() > limit


def facets(frame: DataFrame, weapons: DataFrame, tags: DataFrame, account: str) -> DataFrame:
    """(facet, value, place): distinct non-empty values; known populations first, then other observed ones in order."""
    mine = lambda d: d.where(F.col("account") == account)
    one = lambda d, c, name: mine(d).where(F.coalesce(F.col(c), F.lit("")) != "").select(F.lit(name).alias("facet"), F.col(c).alias("value"))
    every = one(frame, "analysis_set", "analysis_set").unionByName(one(frame, "rule_raw", "rule_raw")).unionByName(one(weapons, "weapon", "weapon")).unionByName(one(tags, "tag", "tag")).distinct()
    known = {x: i for i, x in enumerate(classify.ANALYSIS_SETS)}
    first = F.coalesce(*[F.when(F.col("value") == k, i) for k, i in known.items()], F.lit(len(known)))
    return every.withColumn("place", F.when(F.col("facet") == "analysis_set", first).otherwise(0)).orderBy("facet", "place", "value")


def tag_summary(sets: DataFrame, classification: DataFrame, tags: DataFrame, set_column: str = "analysis_set") -> DataFrame:
    """For each population in ``sets``, also empty ones: matches, untagged ones, and tag counts as a sorted array."""
    key = ["account", "match_key"]
    has = tags.select(*key).distinct().withColumn("_tagged", F.lit(True))
    counts = classification.select(*key, set_column).join(has, key, "left").groupBy(set_column).agg(F.count("*").alias("total"), F.count_if(F.col("_tagged").isNull()).alias("untagged"))
    per = classification.select(*key, set_column).join(tags.select(*key, "tag"), key).groupBy(set_column, "tag").agg(F.count("*").alias("n"))
    lists = per.groupBy(set_column).agg(F.array_sort(F.collect_list(F.struct("tag", "n"))).alias("tags"))
    none = F.array().cast("array<struct<tag: string, n: bigint>>")
    out = sets.join(counts, set_column, "left").join(lists, set_column, "left")
    return out.select(set_column, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("untagged", F.lit(0)).alias("untagged"), F.coalesce("tags", none).alias("tags"))


def rule_results(details: DataFrame, classification: DataFrame) -> DataFrame:
    """``views.by_rule`` of every population but the cooperative ones, told apart by analysis_set."""
    parts = [views.by_rule(views.population(details, classification, s)).withColumn("analysis_set", F.lit(s)) for s in (*classify.PUBLIC_SETS, *classify.PRIVATE_SETS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
