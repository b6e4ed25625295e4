"""SimHash near-duplicates: fingerprints of word shingles, linked through pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, connected_components, pieces, ship, stage

SHINGLE, DISTANCE, SEED = 4, 4, 42
#: Fingerprints that one block may hold to be compared in a task; those of larger blocks meet at their close variants instead.
BLOCK_LIMIT = 32_768
#: Rows from which a fingerprint is not left to the shuffle of a join.
HOT = 200_000
_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits, each set if it is in over half of the XXH64 hashes of the text's shingles (repeats included)."""
    words = text.translate(LOWER_BYTES).split()  # bytes.split() parts at space and \x09-\x0D, nothing else
    if not words:
        return 0
    line, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, SEED)
    cut = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    begin, end = np.concatenate([[0], cut[: n - shingle]]).tolist(), (cut[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter([digest(line[b:e], SEED) for b, e in zip(begin, end, strict=True)], np.uint64, n - shingle + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int((np.uint64(1) << _BITS[2 * ones > len(h)]).sum(dtype=np.uint64)) if (2 * ones > len(h)).any() else 0


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, fp as a signed long) and the binary columns ``more`` for every row of ``docs``; null texts and those without words have fp 0.

    Repeated rows are kept, other columns ignored, an empty table gives no rows.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            fps = np.array([fingerprint(t or b"") for t in b.column("text").cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64)), *b.columns[2:]], ["doc_id", "fp", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *more)
    names = rows.columns[2:]
    return rows.mapInArrow(run, ", ".join(["doc_id long, fp long", *[f"{n} binary" for n in names]]))


def block_masks(n: int, distance: int = DISTANCE) -> list[int]:
    """Masks of blocks, one of which any two fingerprints within ``distance`` share, with keys long enough for ``n`` fingerprints.

    The 64 bits are cut into distance + k parts; a close pair agrees on k of them. More parts
    mean longer keys and more masks; all choices find every close pair.
    """
    for k in (2, 3, 4):
        parts = np.array_split(np.arange(64), distance + k)
        masks = [sum(1 << int(i) for p in chosen for i in parts[p]) for chosen in combinations(range(distance + k), k)]
        if n < 1 << (min(m.bit_count() for m in masks) + 2) or k == 4:
            return masks
    return masks


def _signed(m: int) -> int:
    return m - (1 << 64) if m >= 1 << 63 else m


def _links_in_block(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the components of one block's distinct (signed) fingerprints: a forest, never all pairs.

    Grows each component from one member; a fingerprint that was reached is not compared as a target again.
    """
    links, left = [], fps.view(np.uint64)  # signed numbers would count the bits of their absolute values
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                new = left[near]
                links += [(int(x.view(np.int64)), y) for y in new.view(np.int64).tolist()]
                front.extend(new)
                left = left[~near]
    return links


def _small_blocks(keyed: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) within blocks of at most BLOCK_LIMIT fingerprints; ``keyed`` (mask, key, fp) is sorted by them in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = np.zeros((3, 0), np.int64)
        for b in chain(batches, [None]):
            now = rest if b is None else np.concatenate([rest, np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(3)])], 1)
            if not now.shape[1]:
                continue
            edge = np.flatnonzero((now[0, 1:] != now[0, :-1]) | (now[1, 1:] != now[1, :-1])) + 1
            cuts = np.concatenate([[0], edge, [now.shape[1]]])
            done = len(cuts) - 1 if b is None else len(cuts) - 2  # the last block may go on in the next batch
            size = np.diff(cuts)
            links = []
            pairs = np.flatnonzero(size[:done] == 2)
            if len(pairs):
                x, y = now[2, cuts[pairs]], now[2, cuts[pairs] + 1]
                near = np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= distance
                links += list(zip(x[near].tolist(), y[near].tolist(), strict=True))
            for i in np.flatnonzero(size[:done] > 2):
                links += _links_in_block(now[2, cuts[i] : cuts[i + 1]].copy(), distance)
            rest = now[:, cuts[done] :] if done < len(cuts) - 1 else np.zeros((3, 0), np.int64)
            if links:
                a, c = np.array(links, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(c)], ["a", "b"])

    return keyed.mapInArrow(run, "a long, b long")


def _large_blocks(keyed: DataFrame, distance: int) -> DataFrame:
    """Links within blocks of any size, with grouped minima only.

    Two fingerprints within 4 differ from some value by at most 2 bits each. Every fingerprint
    is sent to all values within half the distance that keep its block's key, and is linked to
    the least that came to the same value: linear in the size of the block, and no link is lost.
    Pairs that only share a value are at most ``distance`` apart, so no link is added either.
    Of an odd distance the larger half is sent, and the least is taken of those within the smaller.
    """
    bit = lambda c: F.when(F.col(c) < 64, F.expr(f"shiftleft(1L, cast({c} as int))")).otherwise(F.lit(0).cast("long"))
    near = keyed.select("mask", "fp", F.col("fp").alias("at"), F.lit(-1).alias("p"))
    for _ in range(distance - distance // 2):  # one more bit, above the last, or (64) none
        near = near.select("mask", "fp", "at", F.explode(F.sequence(F.least(F.col("p") + 1, F.lit(64)), F.lit(64))).alias("p"))
        near = near.where(bit("p").bitwiseAND(F.col("mask")) == 0).select("mask", "fp", F.col("at").bitwiseXOR(bit("p")).alias("at"), "p")
    at = near.select("mask", "fp", "at")
    close = at.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("at"))) <= distance // 2) if distance % 2 else at
    low = close.groupBy("mask", "at").agg(F.min("fp").alias("low"))
    return at.join(low, ["mask", "at"]).where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()


def links(distinct: DataFrame, distance: int = DISTANCE, block_limit: int = BLOCK_LIMIT) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp), enough to connect all that are ``distance`` or less apart."""
    spark = distinct.sparkSession
    masks = [_signed(m) for m in block_masks(distinct.count(), distance)]
    keyed = distinct.select("fp", F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask")).select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n")).where(F.col("n") > block_limit).select("mask", "key")
    sizes = stage(sizes, "blocks")
    n = sizes.count()
    ship(spark)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if not n:
        return _small_blocks(keyed.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key"), distance)
    small = keyed.join(sizes, ["mask", "key"], "left_anti")
    large = keyed.join(sizes, ["mask", "key"], "left_semi")
    return _small_blocks(small.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key"), distance).unionByName(_large_blocks(large, distance))


def components(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``: the smallest doc_id reachable over close fingerprints.

    Texts without words, null ones included, have fingerprint 0, which is linked like any
    other. Copies are one fingerprint, so their pairs are never formed. Repeated rows are
    kept; other columns are ignored; an empty table gives no rows; a component of null ids has a null id.
    """
    fps = stage(fingerprints(docs), "fps")
    return _with_names(fps, distance).select("doc_id", "fp", "component_id")


def _with_names(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``fps`` with root and component_id. Fingerprints of very many rows are looked up in a broadcast of those few, the others are joined."""
    named = _named(fps, distance)
    hot = named.where(F.col("n") > HOT).drop("n")
    n, most = hot.count(), 1_000_000
    if not n or n > most:
        return fps.join(named.drop("n"), "fp")
    few = F.broadcast(hot)
    return fps.join(few, "fp").unionByName(fps.join(few, "fp", "left_anti").join(named.where(F.col("n") <= HOT).drop("n"), "fp"))


def _named(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(fp, n, root, component_id) of every distinct fingerprint and its n rows: root, a fingerprint, tells components apart that share an id or have none."""
    distinct = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "fp")
    found = stage(links(distinct.select("fp"), distance), "links")
    ship(fps.sparkSession)
    roots = connected_components(found, "simhash")
    linked = distinct.join(roots, F.col("fp") == F.col("node"))
    least = linked.groupBy("root").agg(F.min("low").alias("least"))
    moved = linked.join(least, "root").select("fp", "root", "least")
    return stage(distinct.join(moved, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.least("low", "least").alias("component_id")), "component")


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint in hexadecimal, component_id) for every row of ``docs``; nulls, ties, repeated rows and empty tables are as in ``components``."""
    return components(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_digest(docs: DataFrame) -> Column:
    """32 bytes for the whole row; the text's own bytes count too, since JSON replaces those that are not UTF-8."""
    whole = F.to_json(F.struct(*docs.columns), {"ignoreNullFields": "false"})
    return F.unhex(F.sha2(F.concat_ws(" ", F.sha2(whole, 256), F.sha2(F.col("text").cast("binary"), 256)), 256))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, as it came: that with the smallest id (null ids last), of those the one with the least digest.

    Rows are known by their digest, so those that repeat an id, or have none, stay apart unless
    all their columns are equal. Null and empty texts are near-duplicates of each other (fingerprint 0);
    columns may have any names but _digest and _row; an empty table gives no rows; reruns agree.
    """
    fps = stage(fingerprints(docs, _row_digest(docs).alias("digest")), "fps")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    keep = stage(_with_names(fps).groupBy("root").agg(F.min(first).alias("first")).select(F.col("first.digest").alias("_digest")), "kept")
    wide = docs.select(_row_digest(docs).alias("_digest"), F.struct(*docs.columns).alias("_row"))
    n, rows = fps.agg(F.count("*"), F.countDistinct("digest")).first()
    if n != rows:  # equal rows: one of them, taken before the join so that each task passes on one
        wide = wide.groupBy("_digest").agg(F.first("_row").alias("_row"))
    return wide.join(keep, "_digest", "left_semi").select("_row.*")
