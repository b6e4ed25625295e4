"""Classification of match details into disjoint populations."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx

#: Fixed codes.
PUBLIC_SETS = ("nawabari", "bankara_open", "bankara_challenge", "event", "xmatch", "fest")
MODE_GENRES = {"REGULAR": "nawabari", "X_MATCH": "xmatch", "LEAGUE": "event", "PRIVATE": "private", "FEST": "fest"}
COOP_GENRES = {"REGULAR": "salmon_regular", "BIG_RUN": "big_run", "TEAM_CONTEST": "team_contest"}
EVEN_ROSTERS = {4: "four_vs_four", 3: "three_vs_three", 2: "two_vs_two", 1: "one_vs_one"}
PRIVATE_SETS = tuple(f"private_{r}" for r in (*EVEN_ROSTERS.values(), "other"))
ANALYSIS_SETS = (*PUBLIC_SETS, *PRIVATE_SETS, *COOP_GENRES.values())


def _case(c: Column, table: dict, other: Column) -> Column:
    return F.coalesce(*[F.when(c == k, F.lit(v)) for k, v in table.items()], other)


def genre(mode: Column, bankara: Column) -> Column:
    ranked = F.when(bankara == "OPEN", "bankara_open").when(bankara == "CHALLENGE", "bankara_challenge").otherwise("bankara_unspecified")
    return F.when(mode == "BANKARA", ranked).otherwise(_case(mode, MODE_GENRES, F.lit("unknown")))


def roster(mine: Column, others: Column) -> Column:
    """Class of the team sizes; ``others`` is an array, null (or empty) if any size is unknown."""
    even = reduce(lambda c, kv: c.when(mine == kv[0], kv[1]), EVEN_ROSTERS.items(), F.when(F.lit(False), ""))
    same = F.when((F.size(others) == 1) & (others[0] == mine), even)
    return F.when(mine.isNull() | others.isNull() | (F.size(others) == 0), "unknown").otherwise(F.coalesce(same, F.lit("other")))


def analysis_set(genre: Column, roster: Column) -> Column:
    """The population; private matches alone are told apart by team sizes."""
    private = F.when((genre == "private") & (roster != "unknown"), F.concat(F.lit("private_"), roster))
    return F.when(genre.isin(*PUBLIC_SETS, *COOP_GENRES.values()), genre).otherwise(F.coalesce(private, F.lit("hold")))


#: What a result view shows of a detail besides its classes.
SHOWN = {"played_time": "$.playedTime", "judgement": "$.judgement"}


def classify(details: DataFrame, keep: tuple[str, ...] = (), also: dict[str, str | Callable[[Column], Column]] | None = None) -> DataFrame:
    """(account, kind, match_key, detail_response_id, genre ... opponent_counts) for ``match_details`` rows, and the columns ``keep``.

    ``also`` names texts (name: path), or functions of the Variant, that are taken out of the details in the same pass.
    """
    also = also or {}
    v = F.col("_v")
    d = jsonx.with_parsed(details, "_v").select("account", "kind", "match_key", "detail_response_id", *keep, "_v")
    sizes = F.transform(jsonx.elements(v, "$.otherTeams"), lambda t: F.size(F.try_variant_get(t, "$.players", "array<variant>")))
    taken = {name: jsonx.text(v, take) if isinstance(take, str) else take(v) for name, take in also.items()} | {
        "mode_raw": jsonx.text(v, "$.vsMode.mode"),
        "bankara_mode": jsonx.text(v, "$.bankaraMatch.mode"),
        "rule_raw": F.when(F.col("kind") == "coop", jsonx.text(v, "$.rule")).otherwise(jsonx.text(v, "$.vsRule.rule")),
        "rule_name": F.when(F.col("kind") != "coop", jsonx.text(v, "$.vsRule.name")),
        "_mine": F.size(jsonx.elements(v, "$.myTeam.players")),
        "_sizes": sizes,
    }
    # as one row of an array for the same reason as the Variant: filters on the classes then read these columns and are not copied into the paths
    d = d.select(*[c for c in d.columns if c != "_v"], F.inline(F.array(F.struct(*[c.alias(name) for name, c in taken.items()]))))
    mine, counts = F.col("_mine"), F.col("_sizes")
    d = d.select(
        *[c for c in d.columns if c not in ("_mine", "_sizes")],
        F.when(mine >= 0, mine).alias("my_player_count"),
        F.when(F.coalesce((F.size(counts) > 0) & ~F.exists(counts, lambda n: F.coalesce(n, F.lit(-1)) < 0), F.lit(False)) & (mine >= 0), counts).alias("opponent_counts"),
    )
    coop = F.col("kind") == "coop"
    d = d.withColumn("genre", F.when(coop, _case(F.col("rule_raw"), COOP_GENRES, F.lit("unknown"))).otherwise(genre(F.col("mode_raw"), F.col("bankara_mode"))))
    d = d.withColumn("roster_class", F.when(coop, "not_applicable").otherwise(roster(F.col("my_player_count"), F.col("opponent_counts"))))
    for c in ("mode_raw", "bankara_mode", "my_player_count", "opponent_counts"):
        d = d.withColumn(c, F.when(~coop, F.col(c)))
    return d.withColumn("team_count", F.size("opponent_counts") + 1).withColumn("team_count", F.when(F.col("opponent_counts").isNotNull(), F.col("team_count"))).withColumn("analysis_set", analysis_set(F.col("genre"), F.col("roster_class")))
