"""Metrics in match details as time series, and their summaries."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.shipping import ship

#: Fixed names of metrics.
METRIC_LABELS = {
    "weaponPower": "ブキチャレパワー",
    "lastXPower": "Xパワー",
    "entireXPower": "Xパワー",
    "xPowerAfter": "Xパワー",
    "myLeaguePower": "イベントパワー",
    "myFestPower": "フェスパワー",
    "earnedUdemaePoint": "ウデマエポイント増減",
    "jobRate": "評価レート",
    "jobScore": "バイトスコア",
    "jobPoint": "獲得ポイント",
    "dangerRate": "キケン度",
    "afterGradePoint": "評価ポイント",
    "goldenDeliverCount": "集めた金イクラ",
    "deliverCount": "集めたイクラ",
    "teamDeliverCount": "集めた金イクラ",
    "teamDeliverCountSum": "集めた金イクラ",
    "rankPercentile": "順位の百分位",
    "highestJobScore": "ハイスコア",
    "highestGradePoint": "最高評価ポイント",
    "maxBestNinePower": "ベストナイン合計パワー",
    "maxWeaponPowerTotal": "最高ブキチャレパワー合計",
    "regularGradePoint": "バイト評価ポイント",
    "gradePoint": "評価ポイント",
    "limitedPoint": "現在の期間限定ポイント",
    "regularPoint": "現在のポイント",
    "totalPoint": "るいけいポイント",
    "vibes": "チョーシ",
}
#: Fixed names that are no metrics although they end like one, subtrees that are not entered, and endings of metrics.
NOT_METRICS = frozenset((
    "kill", "death", "assist", "special", "paint", "width", "height", "duration", "order", "waveNumber", "waterLevel", "goldenPopCount", "defeatEnemyCount", "defeatCount",
    "goldenAssistCount", "rescueCount", "rescuedCount", "noroshi", "noroshiTry", "paintPoint", "paintRatio", "score", "festUniformBonusRate", "contribution",
))
NOT_ENTERED = frozenset(("memberResults", "enemyResults", "badges", "additionalGearPowers"))
ENDINGS = ("Power", "Rate", "Point", "Score", "Percentile")


def is_metric(key: str) -> bool:
    return key == "power" or key in METRIC_LABELS or (key not in NOT_METRICS and key.endswith(ENDINGS))


def metric_label(path: tuple[str, ...]) -> str:
    if path[-1] == "power":
        return "バンカラパワー" if "bankaraPower" in path else "パワー"
    return METRIC_LABELS.get(path[-1], path[-1])


def numbers(tree: object) -> Iterator[tuple[tuple[str, ...], float]]:
    """(path, value) of every number below the parts that are entered; waves count as one sum."""
    stack: list[tuple[tuple[str, ...], object]] = [((), tree)]
    real = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    while stack:
        path, value = stack.pop()
        if real(value):
            yield path, float(value)
        elif isinstance(value, dict):
            stack.extend((path + (k,), x) for k, x in reversed(value.items()) if not k.startswith("__") and k not in NOT_ENTERED)
        elif isinstance(value, list) and path[-1:] == ("waveResults",):
            counts = [w["teamDeliverCount"] for w in value if isinstance(w, dict) and real(w.get("teamDeliverCount"))]
            if counts:
                yield path + ("teamDeliverCountSum",), float(sum(counts))
        elif isinstance(value, list):
            stack.extend((path + (str(i),), x) for i, x in reversed(list(enumerate(value))))


def observations(details: DataFrame) -> DataFrame:
    """Rate points of classified details (account, match_key, genre, rule_raw, played_time, json_text).

    Nested paths of any depth have no built-in form, so trees are walked in Arrow batches.
    Of two points of a match in one series the later in the document stays.
    """
    ship(details.sparkSession)
    names = ["account", "match_key", "genre", "rule_raw", "played_time"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = {}
            for account, match, genre, rule, played, text in f.itertuples(index=False):
                try:
                    tree = json.loads(text)
                except (TypeError, ValueError):
                    continue
                for path, value in numbers(tree if isinstance(tree, dict) else {}):
                    if is_metric(path[-1]):
                        series = f"{genre}|{rule or ''}|{'.'.join(path)}"
                        second = genre in ("big_run", "team_contest") and path[-1] == "jobRate"
                        out[account, match, series] = (account, series, metric_label(path), genre, rule, match, played, value, "api", "secondary" if second else "primary")
            yield pd.DataFrame(list(out.values()), columns=["account", "series_id", "label", "genre", "rule_raw", "match_key", "played_time", "value", "source", "priority"])

    schema = "account string, series_id string, label string, genre string, rule_raw string, match_key string, played_time string, value double, source string, priority string"
    return details.select(*names, "json_text").mapInPandas(run, schema)


SERIES = ["account", "series_id", "label", "genre", "rule_raw", "source", "priority"]


def series_summary(points: DataFrame, keys: list[str] | None = None, time: str = "played_time", tie: str = "match_key") -> DataFrame:
    """Count, latest, previous, delta, min and max of each series, ordered by time (null first) and tie.

    Null and non-finite values are dropped before the order is taken. The two latest values are those
    of a row number up to 2, which Spark limits before the shuffle: of a long series each task passes on two rows.
    """
    keys = keys or SERIES
    fine = points.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf")))
    late_first = W.partitionBy(*keys).orderBy(F.col(time).isNotNull().desc(), F.col(time).desc(), F.col(tie).desc(), F.col("value").desc())
    two = fine.select(*keys, time, tie, "value").withColumn("_n", F.row_number().over(late_first)).where("_n <= 2")
    ends = two.groupBy(*keys).agg(F.max(F.when(F.col("_n") == 1, F.col("value"))).alias("latest"), F.max(F.when(F.col("_n") == 2, F.col("value"))).alias("previous"))
    ends = ends.select(*[F.col(k).alias(f"_{k}") for k in keys], "latest", "previous")
    one = fine.groupBy(*keys).agg(F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"))
    out = one.join(ends, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left")
    return out.select(*keys, "count", "latest", "previous", (F.col("latest") - F.col("previous")).alias("delta"), "min", "max")


def display_stats(points: DataFrame) -> DataFrame:
    """What a chart of each shown series says: latest, change (a dash for one point), least, most and count, as texts; ratios in percent."""
    s = rate_summary(points)
    shown = lambda c: F.when(F.col("unit") == "ratio", F.concat(labels.short_number(F.col(c) * 100), F.lit("%"))).otherwise(labels.short_number(F.col(c)))
    change = F.when(F.col("unit") == "ratio", F.concat(labels.signed_number(F.col("delta") * 100), F.lit("%"))).otherwise(labels.signed_number(F.col("delta")))
    return s.select(*SERIES, shown("latest").alias("latest"), F.coalesce(change, F.lit("—")).alias("change"), shown("min").alias("least"), shown("max").alias("most"), "count")


def rate_summary(points: DataFrame) -> DataFrame:
    """``series_summary`` of the series that are shown, with unit and display order."""
    s = series_summary(points.where(~labels.is_hidden(F.col("series_id"), F.col("label"))))
    unit = F.when(labels.is_ratio(F.col("series_id"), F.col("label")), "ratio").otherwise("number")
    return s.withColumn("unit", unit).orderBy(labels.genre_order(F.col("genre")), labels.rule_order(F.col("rule_raw")), "label", "series_id")


def streaks(rows: DataFrame, keys: list[str], order: list[str], result: str, win: list[str], lose: list[str]) -> DataFrame:
    """``rows`` with streak: signed length of the run of wins or losses that ends at each row; 0 for other results."""
    sign = F.when(F.col(result).isin(*win), 1).when(F.col(result).isin(*lose), -1).otherwise(0)
    w = W.partitionBy(*keys).orderBy(*order)
    r = rows.withColumn("_sign", sign)
    r = r.withColumn("_new", (F.col("_sign") != F.coalesce(F.lag("_sign").over(w), F.lit(9))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    n = F.row_number().over(W.partitionBy(*keys, "_run").orderBy(*order))
    return r.withColumn("streak", (n * F.col("_sign")).cast("long")).drop("_sign", "_new", "_run")


def history_gaps(heads: DataFrame, keys: list[str], order: str, members: str) -> DataFrame:
    """Rows whose array ``members`` shares nothing with that of the row before: something may be missing between."""
    w = W.partitionBy(*keys).orderBy(order)
    r = heads.withColumn("_before", F.lag(members).over(w))
    return r.withColumn("possible_gap", F.coalesce((F.size("_before") > 0) & (F.size(members) > 0) & ~F.arrays_overlap("_before", members), F.lit(False))).drop("_before")


def history_gaps_of_rows(rows: DataFrame, keys: list[str], order: str, member: str) -> DataFrame:
    """``history_gaps`` from rows of one member each: (keys, order, members as a count, possible_gap).

    No set is collected. A member's own row before is at most as late as the group's, and the same for one that both
    share; so two rows share a member if the latest of these is the row before. Null members do not count.
    """
    pairs = rows.select(*keys, order, member).distinct()
    last = F.when(F.col(member).isNotNull(), F.lag(F.struct(order)).over(W.partitionBy(*keys, member).orderBy(order)))
    heads = pairs.withColumn("_last", last).groupBy(*keys, order).agg(F.count(member).alias("members"), F.max("_last").alias("_last"))
    w = W.partitionBy(*keys).orderBy(order)
    apart = (F.lag("members").over(w) > 0) & (F.col("members") > 0) & ~F.col("_last").eqNullSafe(F.lag(F.struct(order)).over(w))
    return heads.withColumn("possible_gap", F.coalesce(apart, F.lit(False))).drop("_last")


def weapon_snapshots(responses: DataFrame, fetches: DataFrame) -> DataFrame:
    """(account, weapon_id, metric, value, event_id, fetched_at): up to three metrics of each weapon, at every fetch of its response."""
    v = F.try_parse_json("json_text")
    roots = [F.try_variant_get(v, f"$.data.{r}.nodes", "array<variant>") for r in ("weaponRecords", "allWeapons", "weapons")]
    nodes = F.flatten(F.transform(F.array(*roots), lambda a: F.coalesce(a, F.array().cast("array<variant>"))))
    n = responses.select(F.col("id").alias("response_id"), "account", F.posexplode(nodes).alias("i", "n"))
    paths = {"vibes": "$.stats.vibes", "maxWeaponPower": "$.stats.maxWeaponPower", "weaponPower": "$.stats.currentWeaponPowerOrder.weaponPower"}
    kind = lambda p: F.schema_of_variant(F.try_variant_get("n", p, "variant"))
    value = lambda p: F.when((kind(p) == "BIGINT") | (kind(p) == "DOUBLE") | kind(p).startswith("DECIMAL"), F.try_variant_get("n", p, "double"))
    each = F.array(*[F.struct(F.lit(m).alias("metric"), value(p).alias("value")) for m, p in paths.items()])
    rows = n.select("response_id", "account", "i", F.try_variant_get("n", "$.id", "string").alias("weapon_id"), F.inline(each)).where("weapon_id is not null and value is not null")
    last = rows.groupBy("response_id", "account", "weapon_id", "metric").agg(F.max_by("value", "i").alias("value"))
    # A Variant counts as 2 KB a row, so the planner takes what is left after it goes for a fiftieth of its size and would broadcast it.
    return last.hint("merge").join(fetches.select("response_id", "event_id", "fetched_at"), "response_id").drop("response_id")
