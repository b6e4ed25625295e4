"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_WS, broadcast_if, stage, unstage

#: A document's hash has LEVELS digits of BITS bits, most significant first.
BITS, LEVELS = 12, 5


def _size(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_WS)), F.lit(0)).cast("long")


def _hash(doc_id: str) -> Column:
    """60 bits of the id's MD5; a null id hashes as the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _key(source: str) -> Column:
    """Orders by code point with null last, and is never null."""
    return F.when(F.col(source).isNull(), "1").otherwise(F.concat(F.lit("0"), F.col(source)))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, k, h, size): the narrow table that planning needs."""
    return docs.select("doc_id", _key("source").alias("k"), _hash("doc_id").alias("h"), _size("text").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(k, source_size, target): the total shared by weight, no target above ``cap`` times its source.

    Sources in order of cap over weight: those that fill up form a prefix, found by
    running sums, so no repeated resharing is needed. The windows run over one row of some 50 bytes per
    source, in one task, which sorts and spills as any other: sources are counted in thousands, not as documents.
    """
    src = sizes.groupBy("k").agg(F.sum("size").alias("source_size"))
    every = W.partitionBy(F.lit(0))
    rank = F.row_number().over(every.orderBy("k"))
    src = src.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int")))
    src = src.withColumn("most", F.col("source_size").cast("double") * cap).withColumn("total", F.sum(F.col("source_size").cast("double")).over(every))
    fill = every.orderBy(F.col("most") / F.col("w"), "k")
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(fill.rowsBetween(0, W.unboundedFollowing))
    src = src.withColumn("full", (F.col("total") - before) * F.col("w") > F.col("most") * left)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(every), F.lit(0.0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    return src.select("k", "source_size", F.when(F.col("full"), F.col("most")).otherwise((F.col("total") - spent) * F.col("w") / open_w).alias("target"))


def thresholds(sizes: DataFrame, goals: DataFrame, cap: int = 3) -> DataFrame:
    """(k, source_size, target, times, edge, with_edge), one row per source.

    A document is taken ``times`` times, and once more if its hash is below ``edge``
    (or equal, with ``with_edge``). The edge is found digit by digit: a histogram of
    sizes by source and hash digit over the boundary bucket of the previous level only.
    """
    size = F.col("source_size").cast("double")
    times = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / size), F.lit(cap))).otherwise(0).cast("long")
    state = stage(goals.withColumn("times", times).withColumn("rest", F.greatest(F.col("target") - F.col("times") * size, F.lit(0.0))).withColumn("edge", F.lit(0).cast("long")), "mix")
    n = state.count()
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        at = broadcast_if(state.select("k", "edge"), n)
        digit = F.shiftright("h", shift).bitwiseAND((1 << BITS) - 1)
        hist = sizes.join(at, "k").where(F.shiftright("h", shift + BITS) == F.col("edge")).groupBy("k", digit.alias("b")).agg(F.sum("size").alias("s"))
        upto = F.sum("s").over(W.partitionBy("k").orderBy("b"))
        hist = hist.withColumn("upto", upto).join(broadcast_if(state.select("k", "rest"), n), "k").where(F.col("upto") > F.col("rest"))
        first = hist.groupBy("k").agg(F.min_by(F.struct("b", "s", "upto"), "b").alias("x"))
        new = state.join(first, "k", "left").select(
            "k", "source_size", "target", "times",
            (F.col("rest") - F.coalesce(F.col("x.upto") - F.col("x.s"), F.lit(0))).alias("rest"),
            F.coalesce(F.shiftleft("edge", BITS).bitwiseOR(F.col("x.b")), F.lit(-1)).cast("long").alias("edge"),
            (F.coalesce(F.col("x.s"), F.lit(0)) - F.col("rest") + F.coalesce(F.col("x.upto") - F.col("x.s"), F.lit(0))).alias("over"),
        )
        new = new.withColumn("with_edge", (F.col("edge") >= 0) & (F.col("over") < F.col("rest"))).drop("over")
        new = stage(new if level == LEVELS - 1 else new.drop("with_edge"), "mix")
        unstage(state)
        state = new
    return state.drop("rest")


def copies(cap: int) -> Column:
    """How often a document is taken: also one of size 0 never over ``cap`` times."""
    more = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("with_edge"))
    return F.least(F.col("times") + more.cast("long"), F.lit(cap).cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row of ``docs``.

    Null texts have size 0, a null source is a source of its own (last in order), rows
    that repeat an id are taken alike, an empty table gives no rows, other columns are ignored.
    Each source's taken words miss its target by at most half the words at one hash value.
    """
    sizes = stage(sized(docs), "mix-sizes")
    plan = thresholds(sizes, targets(sizes, weights, cap), cap)
    return sizes.join(broadcast_if(plan, plan.count()), "k").select("doc_id", "size", "source_size", "target", (F.col("size") * copies(cap)).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, copy: str = "mix_copy") -> DataFrame:
    """The documents of the mix: a row per copy taken, with its number (from 1) in a last column ``copy``.

    If ``docs`` has a column of that name, the new one gets underscores after it until it differs.
    Nulls, empty texts, repeated rows and empty tables are as in ``mix``; no row is taken over ``cap`` times.
    """
    while copy.lower() in map(str.lower, docs.columns):
        copy += "_"
    sizes = stage(sized(docs), "mix-sizes")
    plan = thresholds(sizes, targets(sizes, weights, cap), cap)
    wide = docs.select(_key("source").alias("k"), _hash("doc_id").alias("h"), F.struct(*docs.columns).alias("row"))
    taken = wide.join(broadcast_if(plan.select("k", "times", "edge", "with_edge"), plan.count()), "k").withColumn("n", copies(cap)).where("n > 0")
    return taken.select("row.*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias(copy))
