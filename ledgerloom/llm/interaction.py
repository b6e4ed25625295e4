"""How filters interact: an incidence histogram of each part times the outcomes of all orders.

Five filters fail a document or not, so a document is one of 32 masks. What every order of the filters would do to
a part is linear in its histogram of masks: the histograms (of all, good and toxic documents) are stacked as rows of a
matrix and multiplied by integer matrices of 32 masks by 600 columns (120 orders of 5 steps).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT_PERCENT, MOST_CAPITAL_PERCENT, SIGNS = 200, 50, 2, b"#$%&*|"
#: Bytes of a text that are taken into words at a time.
STRETCH = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Rows for null ids are dealt to so many keys of their own, since they meet no label.
_SALT = 4096


def _stretches(data: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(data):
        cut = _SPACE.search(data, at + STRETCH) if at + STRETCH < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def fail_mask(data: bytes) -> int:
    """Which of the filters A to D a text fails, as bits; words are what bytes.split() gives, so no list of a long text's words is held.

    Of a text's distinct words no more are held than decide filter B: half of the words.
    """
    n, found, counts = 0, set(), np.zeros(256, np.int64)
    for s in _stretches(data):
        words = s.split()
        n += len(words)
        counts += np.bincount(np.frombuffer(s, np.uint8), minlength=256)
        if len(data) <= STRETCH:
            found.update(words)
    if len(data) > STRETCH:
        for s in _stretches(data):
            found.update(s.split())
            if 100 * len(found) >= LEAST_DISTINCT_PERCENT * n:
                break
    points = len(data) - int(counts[128:192].sum())
    fails = (n < LEAST_WORDS, 100 * len(found) < LEAST_DISTINCT_PERCENT * n, 100 * int(counts[65:91].sum()) > MOST_CAPITAL_PERCENT * points, any(counts[b] for b in SIGNS))
    return sum(f << i for i, f in enumerate(fails))


def outcomes() -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The 600 columns (order, step), and the 32-by-600 matrix of each outcome: what a document of a mask counts in it.

    ``shapley`` sums a filter's ``removed`` over all orders, at whatever step it stands.
    """
    columns = [("".join(order), step) for order in permutations(FILTERS) for step in range(1, len(FILTERS) + 1)]
    bit = np.array([1 << FILTERS.index(order[step - 1]) for order, step in columns])
    earlier = np.array([sum(1 << FILTERS.index(x) for x in order[: step - 1]) for order, step in columns])
    mask = np.arange(MASKS)[:, None]
    fails, gone = mask & bit > 0, mask & earlier > 0
    removed = (fails & ~gone).astype(np.int64)
    shapley = np.zeros_like(removed)
    for b in np.unique(bit):
        shapley[:, bit == b] = removed[:, bit == b].sum(1, keepdims=True)
    found = {"kept": ~fails & ~gone, "removed": removed, "redundant": fails & gone, "unique_fails": mask == bit, "shapley": shapley}
    return columns, {k: m.astype(np.int64) for k, m in found.items()}


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) for every row: the part is the source (null: empty), the mask has the bits of A to D, the digest is the text's SHA-256."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = [t or b"" for t in pc.cast(b.column("text"), pa.binary()).to_pylist()]
            cols = [b.column("doc_id"), b.column("part"), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(map(fail_mask, texts), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "part", "digest", "mask"])

    narrow = docs.selectExpr("cast(doc_id as long) doc_id", "coalesce(cast(source as string), '') part", "cast(text as string) text")
    return narrow.mapInArrow(run, "doc_id long, part string, digest binary, mask int")


def histograms(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by what they fail, E (bit 16) included.

    E fails where a smaller doc_id has the same text, in any part; a null id is neither smaller nor larger than any.
    Rows that repeat a doc_id and its text fail alike. A document is good or toxic if any row of ``labels`` with its id says so.
    Texts travel as digests; copies are counted before they are sent, so a hot text, part or id is some rows a task.
    """
    rows = failures(docs).groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_SALT))).otherwise(F.lit(0)))
    said = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    said = said.agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = rows.join(said.withColumn("salt", F.lit(0).cast("long")), ["doc_id", "salt"], "left")
    count = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), F.col("n")).otherwise(F.lit(0).cast("long"))
    rows = rows.select("doc_id", "part", "digest", "mask", "n", count("good").alias("good"), count("toxic").alias("toxic"), F.col("doc_id").isNull().alias("no_id"))
    sums = [F.sum(c).alias(c) for c in ("n", "good", "toxic")]
    texts = rows.groupBy("digest", "part", "mask", "no_id").agg(*sums, F.min(F.struct("doc_id", "n", "good", "toxic")).alias("first"))
    low = texts.groupBy("digest").agg(F.min("first.doc_id").alias("low"))
    texts = texts.join(low, "digest")
    stays = F.col("no_id") | (F.col("first.doc_id") == F.col("low"))
    first = lambda c: F.when(F.col("no_id"), F.col(c)).when(stays, F.col(f"first.{c}")).otherwise(F.lit(0).cast("long"))
    split = F.array(
        F.struct(F.col("mask"), *[first(c).alias(c) for c in ("n", "good", "toxic")]),
        F.struct((F.col("mask") + MASKS // 2).alias("mask"), *[(F.col(c) - first(c)).alias(c) for c in ("n", "good", "toxic")]),
    )
    return texts.select("part", F.inline(split)).where("n > 0").groupBy("part", "mask").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters (``filter_order``) and step: what the filter at this step does to the part.

    kept (after the step), removed, redundant (failing it, but removed before), unique_fails (failing nothing else),
    good_lost and toxic_lost (removed here), shapley (the filter's removals summed over all orders).
    Null texts are empty, null sources the part ''; extra columns are ignored; an empty table has no parts and gives no
    rows; without labels the lost columns are 0. A part's histogram is at most 32 rows.
    """
    columns, by_name = outcomes()
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    which = {"good_lost": (1, "removed"), "toxic_lost": (2, "removed")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, rows=64):
            stacked = np.zeros((3, len(b), MASKS), np.int64)
            for i, cells in enumerate(b.column("cells").to_pylist()):
                for c in cells:
                    stacked[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
            product = {n: stacked[k] @ by_name[m] for n in names for k, m in [which.get(n, (0, n))]}
            cols = {"part": b.column("part").take(pa.array(np.repeat(np.arange(len(b)), len(columns)))), "filter_order": pa.array([o for o, _ in columns] * len(b)), "step": pa.array([s for _, s in columns] * len(b), pa.int32())}
            yield pa.RecordBatch.from_pydict(cols | {n: pa.array(product[n].ravel()) for n in names})

    parts = histograms(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    return parts.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(n + ' long' for n in names)}")
