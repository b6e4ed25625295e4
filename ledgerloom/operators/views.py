"""Relational views: populations, results by rule, tags, observations, open details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from .classify import SHOWN

KEY = ["account", "kind", "match_key"]


def population(details: DataFrame, classification: DataFrame, analysis_set: str) -> DataFrame:
    """The matches of one population, with what is asked of their details; one builder for all populations."""
    c = classification.where(F.col("analysis_set") == analysis_set)
    d = jsonx.with_parsed(details, "_v").select(*details.columns, *[jsonx.text(F.col("_v"), path).alias(name) for name, path in SHOWN.items()])
    return d.join(c.drop("detail_response_id"), KEY).select(*details.columns, *[x for x in c.columns if x not in details.columns], *SHOWN)


def population_of(classified: DataFrame, *analysis_sets: str) -> DataFrame:
    """``population`` of details that were classified with ``also=SHOWN``: no join, one parse."""
    return classified.where(F.col("analysis_set").isin(*analysis_sets))


def by_rule(population: DataFrame) -> DataFrame:
    """Matches, wins, losses, draws and other results for each account and rule; exempted and deemed losses are other."""
    j = F.col("judgement")
    known = j.isin("WIN", "LOSE", "DRAW")
    return population.groupBy("account", "rule_raw", "rule_name").agg(
        F.count("*").alias("matches"),
        F.count_if(j == "WIN").alias("wins"),
        F.count_if(j == "LOSE").alias("losses"),
        F.count_if(j == "DRAW").alias("draws"),
        F.count_if(j.isNull() | ~known).alias("other"),
    )


def tagged(population: DataFrame, tags: DataFrame) -> DataFrame:
    """A row for each tag of a match, or one without a tag."""
    return population.join(tags.select("account", "match_key", "tag", "note"), ["account", "match_key"], "left")


def match_observations(sightings: DataFrame, responses: DataFrame, fetches: DataFrame) -> DataFrame:
    """When each match was first and last seen, re-fetches included, and in how many responses."""
    last = fetches.groupBy(F.col("response_id").alias("id")).agg(F.max("fetched_at").alias("latest"))
    r = responses.select("id", "fetched_at").join(last, "id", "left").withColumnRenamed("id", "response_id")
    return sightings.join(r, "response_id").groupBy(*KEY).agg(F.min("fetched_at").alias("first_observed_at"), F.max(F.coalesce("latest", "fetched_at")).alias("last_observed_at"), F.countDistinct("response_id").alias("observing_responses"))


def detail_states(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    """``matches`` with detail_state: available, pending, unavailable or unresolved."""
    flags = jobs.where("match_key is not null").groupBy("account", "match_key").agg(F.max(F.col("state").isin("pending", "retry")).alias("_open"), F.max(F.col("state") == "unavailable").alias("_gone"))
    state = F.when(F.col("detail_response_id").isNotNull(), "available").when(F.col("_open"), "pending").when(F.col("_gone"), "unavailable").otherwise("unresolved")
    return matches.join(flags, ["account", "match_key"], "left").withColumn("detail_state", state).drop("_open", "_gone")


def pending_details(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    open_ = jobs.where(F.col("state").isin("pending", "retry"))
    return matches.where("detail_response_id is null").join(open_, ["account", "match_key"], "left_semi")


def unavailable_details(matches: DataFrame, jobs: DataFrame) -> DataFrame:
    open_, gone = jobs.where(F.col("state").isin("pending", "retry")), jobs.where("state = 'unavailable'")
    return matches.where("detail_response_id is null").join(gone, ["account", "match_key"], "left_semi").join(open_, ["account", "match_key"], "left_anti")
