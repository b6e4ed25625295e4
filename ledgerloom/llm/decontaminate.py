"""Benchmark decontamination: broadcast blocks of test windows, scanned over every document's words.

The documents are read once for each block and never written: what a block hits is kept by the digest of
the text, and joined in before the last block. One block holds all benchmarks of a million words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import LOWER, UPPER, WORD_ALNUM, broadcast_if, pieces, ship, stage, unstage

WINDOW = 13
#: Most benchmark words that are broadcast at a time (some 70 MB); a larger benchmark is scanned in several passes.
BLOCK_WORDS = 1_000_000
#: Lower-cases A-Z and blanks out every other ASCII byte that is no letter or digit.
_PLAIN = bytes(b if 48 <= b <= 57 or b > 127 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_PLAIN).split()


class Windows:
    """The windows of some benchmark items, ready to be looked up in long runs of word numbers."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = [None if item is None else str(item) for item, _ in items]
        grids: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, text) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)], np.int32)
            if len(ids):
                n = min(window, len(ids))
                grids.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(ids, n), k))
        #: For each length: hash factor, sorted hashes, the windows, where their owners begin, the owners.
        self.tables: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        for n, parts in sorted(grids.items()):
            grid, owner = np.concatenate([g for g, _ in parts]), np.repeat([k for _, k in parts], [len(g) for g, _ in parts])
            factor = 0x9E3779B97F4A7C15
            while True:
                h = self._hash(grid.T, factor)
                order = np.argsort(h, kind="stable")
                same = np.flatnonzero(h[order][1:] == h[order][:-1])
                if (grid[order[same]] == grid[order[same + 1]]).all():
                    break
                factor = (factor * 5 + 2) % 2**64 | 1  # another factor, until no two different windows share a hash
            first = np.flatnonzero(np.diff(h[order], prepend=~h[order[:1]]))
            self.tables.append((n, factor, h[order[first]], grid[order[first]], np.append(first, len(order)), owner[order]))

    @staticmethod
    def _hash(columns, factor: int) -> np.ndarray:
        h, f = np.zeros(len(columns[0]), np.uint64), np.uint64(factor)
        for c in columns:
            h = (h ^ c.astype(np.uint64)) * f
            h ^= h >> np.uint64(29)
        return h

    def scan(self, docs: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """For each document's words: which of them are hit (a mask), and the items that occur."""
        get = self.vocabulary.get
        lengths = np.array([len(d) for d in docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])  # a 0 after each document ends all windows
        ids = np.zeros(starts[-1], np.int64)
        for s, d in zip(starts[:-1], docs, strict=True):
            ids[s : s + len(d)] = [get(w, 0) for w in d]
        stops = np.append(np.flatnonzero(ids == 0), len(ids))
        run = stops[np.searchsorted(stops, np.arange(len(ids)))] - np.arange(len(ids)) if len(ids) else ids
        diff, items = np.zeros(len(ids) + 1, np.int32), [set() for _ in docs]
        for n, factor, hashes, grid, begin, owner in self.tables:
            at = np.flatnonzero(run >= n)
            if not len(at):
                continue
            h = self._hash([ids[at + j] for j in range(n)], factor)
            k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            at, k = at[same := hashes[k] == h], k[same]
            sure = np.all(ids[at[:, None] + np.arange(n)] == grid[k], axis=1) if len(at) else np.zeros(0, bool)
            at, k = at[sure], k[sure]
            np.add.at(diff, at, 1)
            np.add.at(diff, at + n, -1)
            for d, x in set(zip((np.searchsorted(starts, at, "right") - 1).tolist(), k.tolist(), strict=True)):
                items[d].update(self.names[o] for o in owner[begin[x] : begin[x + 1]])
        for found in items:
            found.discard(None)
        hit = np.cumsum(diff[:-1]) > 0
        return [(hit[s : s + n], i) for s, n, i in zip(starts[:-1], lengths, items, strict=True)]


def _n_blocks(benchmark: DataFrame, block_words: int) -> int:
    n = F.regexp_count(F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER), F.lit(WORD_ALNUM)).cast("long")
    total = benchmark.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return -(-2 * total // block_words) if total > block_words else 1


def _block(benchmark: DataFrame, k: int, of: int) -> list[tuple[object, bytes]]:
    """The items of block k, equal ones once: about half of ``block_words`` words, or one longer item."""
    b = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(of)) == k).distinct().collect()
    return [(r["item_id"], r["text"].encode("utf-8", "surrogatepass")) for r in rows]


def _texts(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in pc.cast(b.column("text"), pa.binary()).to_pylist()]


_HITS = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])
_HITS_TYPE = StructType().add("n_words", LongType()).add("hits", ArrayType(StructType().add("start", LongType()).add("end", LongType()))).add("items", ArrayType(StringType()))
_HITS_SQL = "struct<n_words: long, hits: array<struct<start: long, end: long>>, items: array<string>>"


def _scanned(b: pa.RecordBatch, windows: Windows, earlier: str | None = None) -> list[dict]:
    """Words, hits and items of each row; what earlier blocks hit comes in the column ``earlier``."""
    found = []
    before = b.column(earlier).to_pylist() if earlier else [None] * len(b)
    for (mask, items), old in zip(windows.scan([words_of(t) for t in _texts(b)]), before, strict=True):
        if old:
            for s in old["hits"]:
                mask[s["start"] : s["end"]] = True
            items = items | set(old["items"])
        edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
        found.append({"n_words": len(mask), "hits": [{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)], "items": sorted(items)})
    return found


def _free(name: str, columns: list[str]) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _scan(docs: DataFrame, benchmark: DataFrame, emit: Callable, schema: str | StructType, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Whatever ``emit(batch, hits)`` makes of the rows of ``docs``; a batch may have one more column at its end."""
    spark = docs.sparkSession
    ship(spark)
    n = _n_blocks(benchmark, block_words)
    digest, earlier = _free("_key", docs.columns), _free("_before", docs.columns)
    shared = [spark.sparkContext.broadcast(Windows(_block(benchmark, 0, n), window))]
    if n > 1:
        key = F.sha2(F.col("text").cast("string"), 256)
        parts = []
        for k in range(1, n):
            more = spark.sparkContext.broadcast(Windows(_block(benchmark, k, n), window))

            def some(batches: Iterator[pa.RecordBatch], more=more) -> Iterator[pa.RecordBatch]:
                for b in pieces(batches):
                    found = _scanned(b, more.value)
                    hit = [i for i, f in enumerate(found) if f["hits"]]
                    yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(hit, pa.int32())), pa.array([found[i] for i in hit], _HITS)], ["_key", "b"])

            one = docs.select(key.alias("_key"), F.col("text").cast("string").alias("text")).where("text is not null").mapInArrow(some, f"_key string, b {_HITS_SQL}")
            parts.append(stage(one.groupBy("_key").agg(F.first("b").alias("b")), "bench"))  # equal texts, equal hits
            more.destroy()
        hits = reduce(DataFrame.unionByName, parts).groupBy(F.col("_key").alias(digest)).agg(F.struct(F.max("b.n_words").alias("n_words"), F.flatten(F.collect_list("b.hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("b.items"))).alias("items")).alias(earlier))
        hits = stage(hits, "bench")
        unstage(*parts)
        docs = docs.withColumn(digest, key).join(broadcast_if(hits, hits.count(), 10_000), digest, "left").drop(digest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield emit(b, _scanned(b, shared[0].value, earlier if n > 1 else None))

    return docs.mapInArrow(run, schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A struct ``row`` of the columns ``keep`` (all) of ``docs``, and a struct ``bench``: n_words, hits (word spans start, end) and items.

    Words are runs of letters and digits after lower-casing A-Z; null texts have none. A window
    is ``window`` consecutive words of an item (all of a shorter one); an item's repeated rows count once.
    Items with a null id hit words but are not listed; an empty benchmark hits nothing, an empty table gives no rows.
    Columns of ``docs`` may have any names. Memory: one block and one slice of texts.
    """
    keep = keep or docs.columns
    fields = StructType([docs.schema[c] for c in keep])

    def emit(b: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        row = pa.StructArray.from_arrays([b.column(c) for c in keep], fields=[b.schema.field(c) for c in keep])
        return pa.RecordBatch.from_arrays([row, pa.array(found, _HITS)], ["row", "bench"])

    narrow = docs.select(*dict.fromkeys([*keep, "text"]))
    return _scan(narrow, benchmark, emit, StructType([StructField("row", fields, False), StructField("bench", _HITS_TYPE)]), window, block_words)


def n_hit():
    return F.aggregate("bench.hits", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def contaminated():
    """The contract's rule: any hit, and at least a twentieth of the words."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("bench.n_words"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every row of ``docs``.

    Null and empty texts have no words and are clean; repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    found = find_hits(docs, benchmark, ["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"), F.col("bench.n_words").alias("n_words"), n_hit().alias("n_hit"), F.size("bench.items").cast("long").alias("n_items"), F.sha2(F.array_join("bench.items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def _bad(f: dict) -> bool:
    n = sum(s["end"] - s["start"] for s in f["hits"])
    return n > 0 and 20 * n >= f["n_words"]


def without_contaminated(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents that are not contaminated, as they came, with any other columns; null and empty texts stay.

    Repeated rows stay or go alike; texts are scanned whole, one long text at a time; an empty table gives no rows, an
    empty benchmark removes none.
    """
    names = docs.columns

    def emit(b: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        return b.select(names).filter(pa.array([not _bad(f) for f in found], pa.bool_()))

    return _scan(docs, benchmark, emit, docs.schema, WINDOW, block_words)


def _cut(text: str, hits: list[dict]) -> str:
    """The text without its hit words and what is between them; A-Z and a-z have one byte each way, so places agree."""
    data = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(_PLAIN))]
    at, out = 0, []
    for s in hits:
        out.append(data[at : words[s["start"]][0]])
        at = words[s["end"] - 1][1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def without_hit_spans(docs: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """All documents, without the runs of hit words (the mildest remedy: the rest of a document stays); null texts stay null.

    Repeated rows are cut alike, any other columns carried along; an empty table gives no rows, an empty benchmark cuts nothing.
    """
    names = docs.columns

    def emit(b: pa.RecordBatch, found: list[dict]) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        new = pa.array([_cut(t, f["hits"]) if f["hits"] else t for t, f in zip(texts, found, strict=True)], b.schema.field("text").type)
        return pa.RecordBatch.from_arrays([new if c == "text" else b.column(c) for c in names], names)

    return _scan(docs, benchmark, emit, docs.schema, WINDOW, block_words)
