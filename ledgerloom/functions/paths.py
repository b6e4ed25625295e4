"""Path segments, local-time buckets and file names of the partitioned layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN_DATE = "unknown-date"
LOCAL_ZONE = "+09:00"
#: Fixed list: operations whose responses have a part of their own.
RANKING_OPERATIONS = (
    "EventMatchRankingPeriodQuery",
    "EventMatchRankingSeasonPaginationQuery",
    "EventMatchRankingQuery",
    "RankingHoldersFestTeamRankingHoldersPaginationQuery",
    "WeaponRankingDetail_Ranking_RefetchQuery",
    "WeaponRankingDetailQuery",
    "XRankingDetailQuery",
    "XRankingRefetchQuery",
    "DetailRankingQuery",
    "DetailTabViewWeaponTopsArRefetchQuery",
    "DetailTabViewWeaponTopsClRefetchQuery",
    "DetailTabViewWeaponTopsGlRefetchQuery",
    "DetailTabViewWeaponTopsLfRefetchQuery",
    "DetailTabViewXRankingArRefetchQuery",
    "DetailTabViewXRankingClRefetchQuery",
    "DetailTabViewXRankingGlRefetchQuery",
    "DetailTabViewXRankingLfRefetchQuery",
)
_ZONED = r"^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}(:\d{2}){1,2}([.,]\d+)?(Z|[+-]\d{2}:?\d{2})\s*$"


def encode_segment(value: Column) -> Column:
    """Letters, digits, _ and - stay; every other UTF-8 byte becomes ~ and two hexadecimal digits. Empty and null give null."""
    pairs = F.regexp_extract_all(F.hex(F.encode(value, "UTF-8")), F.lit("(..)"), 1)
    one = lambda h: F.when(F.unhex(h).cast("string").rlike("^[A-Za-z0-9_-]$"), F.unhex(h).cast("string")).otherwise(F.concat(F.lit("~"), h))
    plain = F.when(value.rlike("^[A-Za-z0-9_-]+$"), value)
    return F.when(value != "", F.coalesce(plain, F.array_join(F.transform(pairs, one), "")))


def decode_segment(value: Column) -> Column:
    """The inverse of ``encode_segment``."""
    parts = F.regexp_extract_all(value, F.lit("(~[0-9A-F]{2}|[^~]+)"), 1)
    one = lambda p: F.when(p.startswith("~"), F.substring(p, 2, 2)).otherwise(F.hex(F.encode(p, "UTF-8")))
    return F.decode(F.unhex(F.array_join(F.transform(parts, one), "")), "UTF-8")


def instant(value: Column) -> Column:
    """The time of an ISO text with a zone; null without a zone, or if it cannot be read."""
    fixed = F.regexp_replace(F.regexp_replace(F.trim(value), ",", "."), r"([+-]\d{2})(\d{2})$", "$1:$2")
    return F.when(value.rlike(_ZONED), F.try_to_timestamp(fixed))


def _local(value: Column, pattern: str, unknown: str) -> Column:
    return F.coalesce(F.date_format(F.from_utc_timestamp(instant(value), LOCAL_ZONE), pattern), F.lit(unknown))


def local_month(value: Column) -> Column:
    return _local(value, "yyyy-MM", "unknown-month")


def local_day_path(value: Column) -> Column:
    """yyyy-MM/yyyy-MM-dd nine hours ahead of UTC."""
    return _local(value, "yyyy-MM/yyyy-MM-dd", UNKNOWN_DATE)


def local_hour_path(value: Column) -> Column:
    return _local(value, "yyyy-MM/yyyy-MM-dd/HH", UNKNOWN_DATE)


def response_period(operation: Column, fetched_at: Column) -> Column:
    return F.when(operation.isin(*RANKING_OPERATIONS), local_day_path(fetched_at)).otherwise(local_hour_path(fetched_at))


def rule_token(raw: Column) -> Column:
    """A safe name for a rule: itself if it is one, else a digest; null has a name of its own."""
    return F.when(raw.isNull(), "rule_unknown").when(raw.rlike("^[A-Za-z0-9_-]{1,64}$"), raw).otherwise(F.concat(F.lit("rule_"), F.substring(F.sha2(raw, 256), 1, 48)))
