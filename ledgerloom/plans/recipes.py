"""Ready answers to common questions, composed of the operators: each takes the archive's tables by name and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from ..operators import classify, details, layout, rates, records, views

Tables = dict[str, DataFrame]


def _classified(t: Tables, *keep: str) -> DataFrame:
    return classify.classify(details.match_details(t["matches"], t["documents"]), keep, classify.SHOWN)


def win_rates(t: Tables) -> DataFrame:
    """Share of wins among wins and losses, for each population and rule."""
    played = views.population_of(_classified(t), *classify.ANALYSIS_SETS).groupBy("analysis_set", "rule_raw")
    n = played.agg(F.count_if(F.col("judgement") == "WIN").alias("wins"), F.count_if(F.col("judgement") == "LOSE").alias("losses"))
    return n.withColumn("win_rate", F.try_divide("wins", F.col("wins") + F.col("losses")))


def match_sheet(t: Tables, account: str, kind: str, match_key: str) -> DataFrame:
    """One match with its class, its state and its whole detail."""
    one = records.get(views.detail_states(t["matches"], t["jobs"]), account, kind, match_key)
    return one.join(_classified(t, "json_text").drop("detail_response_id"), views.KEY, "left")


def weapon_results(t: Tables) -> DataFrame:
    """How the player's own weapons did: matches, and kills and paint on average."""
    mine = details.players_of(details.match_details(t["matches"], t["documents"]), texts=False).where("is_myself = 1")
    return mine.groupBy("account", "weapon").agg(F.count("*").alias("matches"), F.avg("kills").alias("kills"), F.avg("paint").alias("paint"))


def wave_totals(t: Tables) -> DataFrame:
    """Deliveries of each cooperative run over its waves, and in the best of them."""
    waves = details.salmon_waves(t["coop_details"]).withColumn("n", jsonx.integer(jsonx.parsed("json_text"), "$.teamDeliverCount"))
    return waves.groupBy("account", "match_key").agg(F.count("*").alias("waves"), F.sum("n").alias("delivered"), F.max("n").alias("best_wave"))


def courses(t: Tables) -> DataFrame:
    """Where each shown series of metrics stands, and how it moved last."""
    return rates.rate_summary(t["rate_points"])


def tagged_matches(t: Tables, tag: str) -> DataFrame:
    """The classified matches that carry a tag, with the parts they live in."""
    c = classify.classify(details.match_details(t["matches"], t["documents"]))
    homes = layout.match_home(t["matches"], c, t["documents"])
    index = layout.match_index(t["matches"], c, homes, t["match_tags"], t["documents"])
    return index.join(t["match_tags"].where(F.col("tag") == tag).select("account", "match_key"), ["account", "match_key"], "left_semi")


def refetched(t: Tables) -> DataFrame:
    """Responses that came again unchanged, with the time between the first and the last fetch in seconds."""
    f = t["response_fetches"].groupBy("response_id").agg(F.count("*").alias("times"), F.min("fetched_at").alias("first"), F.max("fetched_at").alias("last"))
    return f.where("times > 1").withColumn("span_seconds", F.unix_seconds(F.try_to_timestamp("last")) - F.unix_seconds(F.try_to_timestamp("first")))


def open_work(t: Tables) -> DataFrame:
    """What is still asked for: jobs by operation and state, the most first."""
    return t["jobs"].where(F.col("state").isin("pending", "retry")).groupBy("operation", "state").agg(F.count("*").alias("jobs"), F.max("attempts").alias("attempts")).orderBy(F.col("jobs").desc(), "operation", "state")


RECIPES: dict[str, Callable[..., DataFrame]] = {f.__name__: f for f in (win_rates, match_sheet, weapon_results, wave_totals, courses, tagged_matches, refetched, open_work)}
