"""Display names and their order, number formatting."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed names of populations and rules, in display order.
GENRE_LABELS = {
    "fest": "フェスマッチ",
    "nawabari": "レギュラーマッチ",
    "bankara_challenge": "バンカラマッチ（チャレンジ）",
    "bankara_open": "バンカラマッチ（オープン）",
    "xmatch": "Xマッチ",
    "event": "イベントマッチ",
    "private": "プライベートマッチ",
    "private_four_vs_four": "プライベートマッチ（4対4）",
    "private_three_vs_three": "プライベートマッチ（3対3）",
    "private_two_vs_two": "プライベートマッチ（2対2）",
    "private_one_vs_one": "プライベートマッチ（1対1）",
    "private_other": "プライベートマッチ（その他）",
    "salmon_regular": "いつものバイト",
    "big_run": "ビッグラン",
    "team_contest": "バイトチームコンテスト",
    "hold": "区分保留",
}
RULE_LABELS = {
    "TURF_WAR": "ナワバリバトル",
    "AREA": "ガチエリア",
    "LOFT": "ガチヤグラ",
    "GOAL": "ガチホコバトル",
    "CLAM": "ガチアサリ",
    "REGULAR": "いつものバイト",
    "BIG_RUN": "ビッグラン",
    "TEAM_CONTEST": "バイトチームコンテスト",
}


def _lookup(c: Column, table: dict) -> Column:
    return reduce(lambda chain, kv: chain.when(c == kv[0], F.lit(kv[1])), list(table.items())[1:], F.when(c == next(iter(table)), F.lit(table[next(iter(table))])))


def genre_label(c: Column) -> Column:
    """Unknown codes are shown, not hidden; null and empty give the empty string."""
    other = F.when(c.startswith("private_"), F.concat(F.lit("プライベートマッチ（"), F.substring(c, 9, 1 << 20), F.lit("）")))
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.coalesce(_lookup(c, GENRE_LABELS), other, F.concat(F.lit("未対応のジャンル（"), c, F.lit("）"))))


def rule_label(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", "").otherwise(F.coalesce(_lookup(c, RULE_LABELS), F.concat(F.lit("未対応のルール（"), c, F.lit("）"))))


def genre_order(c: Column) -> Column:
    """Place in display order; unknown private ones come after private_other, other unknown ones last."""
    place = {g: float(i) for i, g in enumerate(GENRE_LABELS)}
    private = F.when(c.startswith("private"), F.lit(place["private_other"] + 0.5))
    return F.coalesce(_lookup(c, place), private, F.lit(float(len(place) + 1)))


def rule_order(c: Column) -> Column:
    place = {r: i for i, r in enumerate(RULE_LABELS)}
    return F.coalesce(_lookup(c, place), F.lit(len(place) + 1))


def metric_key(series_id: Column) -> Column:
    """The last dotted part of the last part between bars."""
    return F.substring_index(F.substring_index(series_id, "|", -1), ".", -1)


def is_ratio(series_id: Column, label: Column) -> Column:
    return (metric_key(series_id) == "dangerRate") | F.coalesce(label.contains("キケン度"), F.lit(False))


def is_hidden(series_id: Column, label: Column) -> Column:
    """Series that are kept but not shown."""
    return series_id.contains("derived_judgement") | (metric_key(series_id) == "earnedUdemaePoint") | F.coalesce(label == "ウデマエポイント増減", F.lit(False))


def short_number(value: Column) -> Column:
    """Integers without a point; else 2 places from 1 on and 4 below, closing zeros cut."""
    near = F.abs(value - F.round(value)) < 1e-9
    places = F.when(F.abs(value) >= 1, F.format_string("%.2f", value)).otherwise(F.format_string("%.4f", value))
    return F.when(near, F.round(value).cast("long").cast("string")).otherwise(F.regexp_replace(places, r"\.?0+$", ""))


def signed_number(value: Column) -> Column:
    return F.when(value > 0, F.concat(F.lit("+"), short_number(value))).when(value == 0, F.lit("±0")).otherwise(short_number(value))


def nice_ticks(low: float, high: float) -> list[float]:
    """Axis ticks around [low, high] at multiples of 1, 2, 2.5, 5 or 10 times a power of ten: the least step of at least a fifth of the span.

    Equal ends are first moved apart, by 2 at zero and else by a tenth of them, at least 1. If that gives fewer than four intervals, the next finer step is taken.
    """
    import math

    if low == high:
        apart = max(1.0, abs(low) / 10) if low else 2.0
        low, high = low - apart, high + apart
    fifth = (high - low) / 5
    unit = 10 ** math.floor(math.log10(fifth))
    factor = next(m for m in (1, 2, 2.5, 5, 10) if fifth / unit <= m)
    ends = lambda m: (math.floor(low / (m * unit)), math.ceil(high / (m * unit)))
    first, last = ends(factor)
    if last - first < 4 and factor != 2.5:
        factor = {10: 5, 5: 2, 2: 1, 1: 1}[factor]
        first, last = ends(factor)
    return [round(i * factor * unit, 6) for i in range(first, last + 1)]


#: Fixed ticks of the axis of grade points, and the distance of those outside of them.
GRADE_TICKS, GRADE_STEP = (0, 200, 400, 600, 800, 999), 200


def grade_ticks(low: float, high: float) -> list[int]:
    """The fixed ticks; outside of them multiples of 200, from 1200 upwards, up to less than a step beyond either end."""
    under = [-t for t in range(GRADE_STEP, int(-low) + GRADE_STEP + 1, GRADE_STEP) if -t >= low - GRADE_STEP] if low < 0 else []
    over = [t for t in range(1200, int(high) + 2 * GRADE_STEP, GRADE_STEP) if t < high + GRADE_STEP] if high > GRADE_TICKS[-1] else []
    return [*reversed(under), *GRADE_TICKS, *over]


def contrast(rgb1: tuple[int, int, int], rgb2: tuple[int, int, int]) -> float:
    """Contrast ratio of two sRGB colours, 1 to 21."""
    line = lambda c: c / 12.92 if c <= 0.04045 else ((c + 0.055) / 1.055) ** 2.4
    light = [sum(w * line(c / 255) for w, c in zip((0.2126, 0.7152, 0.0722), rgb, strict=True)) for rgb in (rgb1, rgb2)]
    return (max(light) + 0.05) / (min(light) + 0.05)
