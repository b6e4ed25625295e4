"""Which match an opaque remote id means."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decoded(remote: Column) -> Column:
    """The text behind a base64 id (missing padding is repaired); the id itself if it is not base64 of text."""
    body = F.regexp_replace(remote, "=+$", "")
    padded = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    raw = F.when(body.rlike("^[A-Za-z0-9+/]+$") & (F.length(body) % 4 != 1), F.try_to_binary(padded, F.lit("base64")))
    return F.coalesce(F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")), remote)


def identity(remote: Column) -> Column:
    """struct(kind, match_key): vs ids keep the first and last ``:`` piece, coop ids all that follows; else null."""
    plain = decoded(remote)
    vs = F.substring_index(plain, "VsHistoryDetail-", -1)
    return (
        F.when(plain.startswith("VsHistoryDetail-"), F.struct(F.lit("vs").alias("kind"), F.concat(F.substring_index(vs, ":", 1), F.lit(":"), F.substring_index(vs, ":", -1)).alias("match_key")))
        .when(plain.startswith("CoopHistoryDetail-"), F.struct(F.lit("coop").alias("kind"), F.substring_index(plain, "CoopHistoryDetail-", -1).alias("match_key")))
    )
