"""Rows out of match details: teams, players, gear, awards, and the same for cooperative runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsonx
from .classify import classify
from .views import KEY


def match_details(matches: DataFrame, documents: DataFrame) -> DataFrame:
    """Each match with its canonical detail document."""
    d = documents.withColumnRenamed("response_id", "detail_response_id")
    return matches.join(d, ["detail_response_id", "account", "kind", "match_key"]).select("account", "kind", "match_key", "first_seen", "last_seen", "detail_response_id", "json_text")


def classified(matches: DataFrame, documents: DataFrame, also: dict | None = None, how: str = "inner") -> DataFrame:
    """``classify`` of ``match_details``, or with ``how="left"`` of every match; classes are taken out where the documents lie, so no text is shuffled to its match."""
    c = classify(documents.withColumnRenamed("response_id", "detail_response_id"), also=also)
    return matches.select("detail_response_id", *KEY).join(c, ["detail_response_id", *KEY], how).select(*c.columns)


def _parsed(details: DataFrame, kind: str) -> DataFrame:
    return jsonx.with_parsed(details.where(F.col("kind") == kind), "_v")


def _first_and_rest(v: Column, first: str, rest: str) -> Column:
    """The object below ``first`` (if it is one) as (0, 1, it), then the elements below ``rest`` as (1, 0, it) and so on: one array, so one pass."""
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(1).alias("own"), F.try_variant_get(v, first, "variant").alias("e")))
    others = F.transform(jsonx.elements(v, rest), lambda e, i: F.struct((i + 1).alias("i"), F.lit(0).alias("own"), e.alias("e")))
    none = F.filter(one, lambda x: F.lit(False))
    return F.concat(F.when(jsonx.is_object(v, first), one).otherwise(none), F.coalesce(others, none))


def _each(frame: DataFrame, v: str, path: str, index: str, keep: list[str]) -> DataFrame:
    return frame.select(*keep, F.posexplode(jsonx.elements(F.col(v), path)).alias(index, "_e"))


def _teams(details: DataFrame) -> DataFrame:
    rows = _parsed(details, "vs").select("account", "match_key", F.inline(_first_and_rest(F.col("_v"), "$.myTeam", "$.otherTeams")))
    return rows.toDF("account", "match_key", "team_index", "is_my_team", "_t")


def battle_teams(details: DataFrame) -> DataFrame:
    """The own team as index 0 (if it is an object), then the other teams from 1."""
    return _teams(details).select("account", "match_key", "team_index", "is_my_team", F.to_json("_t").alias("json_text"))


#: A player's columns (name: path), and the fields that they come from, each with its own type.
TEXTS = {"player_id": "id", "name": "name", "weapon": "weapon.name"}
NUMBERS = {"is_myself": "isMyself", "paint": "paint", "kills": "result.kill", "assists": "result.assist", "deaths": "result.death", "specials": "result.special"}
_PLAYER = "struct<id: variant, name: variant, weapon: struct<name: variant>, isMyself: variant, paint: variant, result: struct<kill: variant, assist: variant, death: variant, special: variant>>"
_TEAM = f"struct<players: array<{_PLAYER}>>"


def _fields(p: Column) -> list[Column]:
    """The columns of a player whose fields were taken out; what is no object has nulls."""
    at = lambda path: reduce(lambda c, x: c[x], path.split("."), p)
    return [jsonx.as_text(at(x)).alias(n) for n, x in TEXTS.items()] + [jsonx.as_integer(at(x)).alias(n) for n, x in NUMBERS.items()]


def players_of(details: DataFrame, texts: bool = True) -> DataFrame:
    """``battle_players`` of all teams of ``details``, without printing and parsing the teams between.

    Without ``texts`` there is no ``json_text``, and only the fields are taken out, all teams' in one walk of a detail.
    """
    if texts:
        return _players(_teams(details))
    taken = F.try_variant_get(jsonx.parsed("json_text"), "$", f"struct<myTeam: {_TEAM}, otherTeams: array<{_TEAM}>>")
    no_players, no_teams = F.array().cast(f"array<{_PLAYER}>"), F.array().cast(f"array<array<{_PLAYER}>>")

    def rows(d: Column) -> Column:
        teams = F.concat(F.array(d["myTeam"]["players"]), F.coalesce(d["otherTeams"]["players"], no_teams))
        return F.flatten(F.transform(teams, lambda t, i: F.transform(F.coalesce(t, no_players), lambda p, j: F.struct(i.alias("team_index"), j.alias("player_index"), p.alias("_p")))))

    one = F.transform(F.array(taken), rows)  # an array of one, as in with_parsed, so that it is taken once
    p = details.where("kind = 'vs'").select("account", "match_key", F.inline(F.flatten(one)))
    return p.select("account", "match_key", "team_index", F.when(F.col("team_index") == 0, 1).otherwise(0).alias("is_my_team"), "player_index", *_fields(F.col("_p")))


def battle_players(teams: DataFrame) -> DataFrame:
    return _players(jsonx.with_parsed(teams, "_t"))


def _players(t: DataFrame) -> DataFrame:
    p = _each(t, "_t", "$.players", "player_index", ["account", "match_key", "team_index", "is_my_team"])
    p = p.select("*", F.inline(F.array(F.struct(F.try_variant_get("_e", "$", _PLAYER).alias("_p")))))
    return p.select("account", "match_key", "team_index", "is_my_team", "player_index", *_fields(F.col("_p")), F.to_json("_e").alias("json_text"))


def battle_gear(players: DataFrame) -> DataFrame:
    """A row for each of the three gear slots that a player object has."""
    p = jsonx.with_parsed(players, "_p")
    slots = F.array(*[F.struct(F.lit(s).alias("slot"), jsonx.subtree(F.col("_p"), f"$.{s}").alias("json_text")) for s in ("headGear", "clothingGear", "shoesGear")])
    return p.select("account", "match_key", "team_index", "player_index", F.inline(F.filter(slots, lambda s: s["json_text"].isNotNull())))


def _indexed(details: DataFrame, kind: str, path: str, index: str) -> DataFrame:
    return _each(_parsed(details, kind), "_v", path, index, ["account", "match_key"]).select("account", "match_key", index, F.to_json("_e").alias("json_text"))


def battle_awards(details: DataFrame) -> DataFrame:
    return _indexed(details, "vs", "$.awards", "award_index")


def salmon_waves(details: DataFrame) -> DataFrame:
    return _indexed(details, "coop", "$.waveResults", "wave_index")


def salmon_bosses(details: DataFrame) -> DataFrame:
    return _indexed(details, "coop", "$.enemyResults", "boss_index")


def salmon_players(details: DataFrame) -> DataFrame:
    """The own result as index 0 (if it is an object), then the members from 1."""
    rows = _parsed(details, "coop").select("account", "match_key", F.inline(_first_and_rest(F.col("_v"), "$.myResult", "$.memberResults")))
    return rows.select("account", "match_key", F.col("i").alias("player_index"), F.col("own").alias("is_myself"), F.to_json("e").alias("json_text"))


def salmon_runs(details: DataFrame) -> DataFrame:
    d, v = _parsed(details, "coop"), F.col("_v")
    return d.select("account", "match_key", "detail_response_id", jsonx.text(v, "$.playedTime").alias("played_time"), jsonx.text(v, "$.coopStage.name").alias("stage"), jsonx.text(v, "$.rule").alias("rule"), jsonx.number(v, "$.dangerRate").alias("danger_rate"), jsonx.integer(v, "$.resultWave").alias("result_wave"), "json_text")


#: What a battle row shows of its detail (the rule's name comes with the classes).
BATTLE = {"played_time": "$.playedTime", "mode": "$.vsMode.mode", "stage": "$.vsStage.name", "judgement": "$.judgement", "knockout": "$.knockout", "duration": lambda v: jsonx.integer(v, "$.duration")}


def battles(details: DataFrame) -> DataFrame:
    """A row for each battle with its classes, from one pass over the details."""
    c = classify(details.where("kind = 'vs'"), keep=("json_text",), also=BATTLE)
    return c.select(
        "account", "match_key", "detail_response_id", "played_time", "mode", F.col("rule_name").alias("rule"), "stage", "judgement", "knockout", "duration", "json_text", "genre", "roster_class", "analysis_set"
    )
