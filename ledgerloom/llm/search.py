"""Ranked lexical search: variable-block-max WAND over an index that is sharded by documents.

Documents are dealt to shards as Spark deals them to tasks; a shard is one row of a written table, with its documents
and the postings of its terms. The counts that scores need (documents, words, documents of a term) are summed from that
table. To search, each shard scores its posting lists and cuts each into blocks of unequal length by dynamic programming
(the cut that minimises what block maxima overstate). WAND's two tests then decide what is read: pivots are documents of
lists heavy enough to reach the tenth score so far, and a block is skipped where the block maxima of all lists, summed, do
not reach it. Both tests are made for all documents between block ends at once, not by moving one cursor at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, PLAIN_BYTES, UPPER, WORD_ALNUM, broadcast_if, pieces, ship, stage, unstage

#: A shard takes documents until it has so many bytes of text, or so many documents.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 1 << 16
#: Bytes of one text that are taken into words at a time.
STRETCH = 1 << 20
#: Most pairs of item and term in a block of items, and most terms that are broadcast; with more, every term is indexed.
BLOCK_TERMS, VOCABULARY = 500_000, 200_000
#: Blocks have at most so many postings; cuts are sought within runs of so many; a block costs as much as so many standard deviations.
LONGEST, RUN, BLOCK_COST = 64, 512, 8.0
_ROW = "doc_ids array<bigint>, lengths array<int>, n_docs bigint, n_words bigint, terms array<string>, counts array<int>, docs array<int>, tfs array<int>"


# -- the index ----------------------------------------------------------------------------------------------------


class _Shard:
    """Documents on their way into one shard."""

    def __init__(self, terms: dict[bytes, int] | None):
        self.fixed, self.terms = terms is not None, {} if terms is None else terms
        self.size, self.ids, self.lengths, self.found = 0, [], [], []

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """Term numbers from 1; 0 for terms that are not indexed."""
        if self.fixed:
            return np.fromiter((self.terms.get(w, 0) for w in words), np.int64, len(words))
        return np.fromiter((self.terms.setdefault(w, len(self.terms) + 1) for w in words), np.int64, len(words))

    def add(self, ids: list[int | None], texts: list[bytes]) -> None:
        """Texts of a slice, or one long text, which is walked in stretches."""
        if len(texts) == 1 and len(texts[0]) > STRETCH:
            tf, n = np.zeros(0, np.int64), 0
            for s in _stretches(texts[0]):
                words = s.translate(PLAIN_BYTES).split()
                n += len(words)
                more = np.bincount(self._numbers(words))
                if len(more) > len(tf):
                    tf, more = more, tf
                tf[: len(more)] += more
            term = np.flatnonzero(tf[1:]) + 1
            self.found.append((term, np.full(len(term), len(self.ids)), tf[term] if len(term) else term))
            self.lengths.append(n)
        else:
            words, lengths = [], []
            for t in texts:
                w = t.translate(PLAIN_BYTES).split()
                lengths.append(len(w))
                words += w
            number = self._numbers(words)
            doc = np.repeat(np.arange(len(texts)) + len(self.ids), lengths)[number > 0]
            pair, tf = np.unique(number[number > 0] << 20 | doc, return_counts=True)
            self.found.append((pair >> 20, pair & 0xFFFFF, tf))
            self.lengths += lengths
        self.ids += ids
        self.size += sum(map(len, texts))

    def row(self) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        term, doc, tf = (np.concatenate([f[i] for f in self.found]) for i in range(3))
        doc = place[doc]
        by = np.lexsort((doc, term))
        number, counts = np.unique(term, return_counts=True)
        names = [b"", *self.terms]
        lengths = np.array(self.lengths, np.int32)[order]
        cells = [
            pa.array([[self.ids[i] for i in order]], pa.list_(pa.int64())), _one(lengths), pa.array([int((lengths > 0).sum())], pa.int64()), pa.array([int(lengths.sum(dtype=np.int64))], pa.int64()),
            pa.array([[names[t].decode("utf-8", "replace") for t in number]], pa.list_(pa.string())), _one(counts), _one(doc[by]), _one(tf[by]),
        ]
        return pa.RecordBatch.from_arrays(cells, [c.split()[0] for c in _ROW.split(", ")])


def _one(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values.astype(np.int32)))


def _stretches(data: bytes) -> Iterator[bytes]:
    """The text in stretches that end before a byte that no term has."""
    at = 0
    while at < len(data):
        end = at + STRETCH
        while end < len(data) and PLAIN_BYTES[data[end]] != 32:
            end += 1
        yield data[at:end]
        at = end


def build_index(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """The index of ``docs``, written to the shared folder: a row a shard, with the postings of ``terms`` (None: of every term).

    doc_ids (in order) and lengths in words; n_docs with a word, n_words; terms and counts of their postings; docs (places in doc_ids) and tfs.
    Every document is in a shard, null and empty texts with length 0; nothing is shuffled. A task holds one shard: one text, or 16 MB of texts.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = None if terms is None else spark.sparkContext.broadcast({t.encode("utf-8", "surrogatepass"): i for i, t in enumerate(sorted(terms), 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = lambda: _Shard(None if shared is None else shared.value)
        shard = new()
        for b in pieces(batches):
            texts = [t or b"" for t in pc.cast(b.column("text"), pa.binary()).to_pylist()]
            shard.add(b.column("doc_id").to_pylist(), texts)
            if shard.size >= SHARD_BYTES or len(shard.ids) >= SHARD_DOCS:
                yield shard.row()
                shard = new()
        if shard.ids:
            yield shard.row()

    return stage(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, _ROW), "search-index")


# -- blocks -------------------------------------------------------------------------------------------------------


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The numbers of all [lo, hi), one range after the other."""
    n = hi - lo
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())


def _summed(docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents, in order, and the sum of each."""
    found, group = np.unique(docs, return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, group, scores)
    return found, total


def _cuts_of_runs(scores: np.ndarray, lengths: np.ndarray, cost: np.ndarray) -> list[np.ndarray]:
    """For runs (rows, padded) the lengths of their blocks, last to first: least sum of (block maximum - score), plus ``cost`` a block.

    All runs take a step of the dynamic program together; runs come longest first, so those that have ended are a tail.
    """
    n, width = scores.shape
    most = min(LONGEST, width)
    upto = np.concatenate([np.zeros((n, 1)), np.cumsum(scores, 1)], 1)
    best, back = np.zeros((n, width + 1)), np.zeros((n, width + 1), np.int32)
    high, base = np.zeros((n, most)), np.zeros((n, most))  # by start of the last block, in turns
    for j in range(1, width + 1):
        a = int(np.searchsorted(-lengths, -j, "right"))
        slot, some = (j - 1) % most, min(j, most)
        np.maximum(high[:a], scores[:a, j - 1, None], out=high[:a])
        high[:a, slot], base[:a, slot] = scores[:a, j - 1], best[:a, j - 1] + upto[:a, j - 1]
        long = (j - 1 - np.arange(most)) % most + 1
        total = base[:a, :some] + long[:some] * high[:a, :some]
        pick = total.argmin(1)
        best[:a, j] = total[np.arange(a), pick] + cost[:a] - upto[:a, j]
        back[:a, j] = long[pick]
    out = []
    for i, end in enumerate(lengths.tolist()):
        row, cuts = back[i], []
        while end:
            cuts.append(row[end])
            end -= row[end]
        out.append(np.array(cuts))
    return out


def cut_blocks(scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where blocks of the posting lists begin: ``starts`` has each list's first posting and the end; blocks never cross lists or runs of RUN postings."""
    if not len(scores):
        return np.zeros(0, np.int64)
    sizes = np.diff(starts)
    mean = np.add.reduceat(scores, starts[:-1]) / sizes
    deviation = np.sqrt(np.maximum(np.add.reduceat(scores.astype(float) ** 2, starts[:-1]) / sizes - mean**2, 0))
    runs = -(-sizes // RUN)
    first = np.repeat(starts[:-1], runs) + RUN * _ranges(np.zeros_like(runs), runs)
    length = np.minimum(np.repeat(starts[1:], runs) - first, RUN)
    cost = np.repeat(BLOCK_COST * deviation + 1, runs)
    begins = [first[length == 1]]
    for low, width in ((1, 8), (8, 64), (64, RUN)):
        of = np.flatnonzero((length > low) & (length <= width))
        of = of[np.argsort(-length[of], kind="stable")]
        for k in range(0, len(of), 2048):
            some = of[k : k + 2048]
            at = np.minimum(first[some, None] + np.arange(width), len(scores) - 1)
            padded = np.where(np.arange(width) < length[some, None], scores[at], 0).astype(float)
            for f, n, cuts in zip(first[some], length[some], _cuts_of_runs(padded, length[some], cost[some]), strict=True):
                begins.append(f + n - np.cumsum(cuts))
    return np.sort(np.concatenate(begins))


# -- search -------------------------------------------------------------------------------------------------------


class _View:
    """The posting lists of a shard that a block of items asks for, scored and cut into blocks."""

    def __init__(self, docs: np.ndarray, scores: np.ndarray, starts: np.ndarray, ids: np.ndarray, absent: np.ndarray):
        self.docs, self.scores, self.starts, self.ids, self.absent = docs, scores, starts, ids, absent
        self.keys = np.repeat(np.arange(len(starts) - 1), np.diff(starts)) << 32 | docs
        self.begin = cut_blocks(scores, starts)
        self.end = np.append(self.begin[1:], len(scores))
        self.first, self.after, self.high = docs[self.begin], docs[self.end - 1] + 1, np.maximum.reduceat(scores, self.begin)
        self.list_block, self.list_high = np.searchsorted(self.begin, starts), np.maximum.reduceat(scores, starts[:-1])


class Searcher:
    """The items of a block and the counts of the whole corpus; keeps each item's best documents over the shards it is shown."""

    def __init__(self, items: list[tuple[str | None, list[str]]], df: dict[str, int], n_docs: int, n_words: int, most: int = 10):
        self.names = [i for i, _ in items]
        self.terms = {t: k for k, t in enumerate(sorted({t for _, ts in items for t in ts if t in df}))}
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in self.terms], np.int64)
        self.items = [np.array(sorted(self.terms[t] for t in ts if t in self.terms), np.int64) for _, ts in items]
        self.n_docs, self.n_words, self.most = n_docs, n_words, most
        self.evaluated = self.postings = 0

    def start(self) -> None:
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)) for _ in self.items]

    def _m(self, lengths: np.ndarray) -> np.ndarray:
        if 90 * int(lengths.max(initial=0)) * self.n_docs < 2**63:
            return 10 + 90 * lengths.astype(np.int64) * self.n_docs // max(self.n_words, 1)
        return np.array([10 + 90 * n * self.n_docs // self.n_words for n in lengths.tolist()], np.int64)

    def show(self, shard: dict[str, np.ndarray], terms: list[str], absent: np.ndarray) -> None:
        """Merge in a shard's best documents; ``absent`` marks null ids."""
        number = np.array([self.terms.get(t, -1) for t in terms], np.int64)
        ends = np.cumsum(shard["counts"], dtype=np.int64)
        mine = np.flatnonzero(number >= 0)
        if not len(mine):
            return
        at = _ranges(ends[mine] - shard["counts"][mine], ends[mine])
        docs, tfs, counts = shard["docs"][at].astype(np.int64), shard["tfs"][at].astype(np.int64), shard["counts"][mine].astype(np.int64)
        weight = np.repeat(self.weight[number[mine]], counts)
        scores = weight * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * self._m(shard["lengths"])[docs]))
        starts = np.concatenate([[0], np.cumsum(counts)])
        view = _View(docs, scores, starts, shard["doc_ids"], absent)
        where = np.full(len(self.terms) + 1, -1)
        where[number[mine]] = np.arange(len(mine))
        for i, wanted in enumerate(self.items):
            lists = where[wanted]
            lists = lists[lists >= 0]
            if len(lists):
                self._search(i, lists[np.argsort(-view.list_high[lists], kind="stable")], view)

    def _least(self, i: int) -> int:
        """What a score must reach: the last of the best, as an equal score may have a smaller id."""
        return int(self.best[i][0][-1]) if len(self.best[i][0]) == self.most else 1

    def _search(self, i: int, lists: np.ndarray, v: _View) -> None:
        """``lists`` come by what they can give at most, the heaviest first."""
        size = v.starts[lists + 1] - v.starts[lists]
        self.postings += int(size.sum())
        heavy = lists[: int(np.searchsorted(np.cumsum(size), self.most)) + 1]
        p = _ranges(v.starts[heavy], v.starts[heavy + 1])
        docs, total = _summed(v.docs[p], v.scores[p])
        self.evaluated += len(p)
        # the best of what the heaviest lists hold give a first score to beat
        seen = np.sort(docs[np.argsort(-total, kind="stable")[: 4 * self.most]])
        self._evaluate(i, seen, np.zeros(len(seen), np.int64), lists, v)
        least = self._least(i)
        # a document none of whose terms is among the drivers cannot reach `least`, whatever lighter terms it has
        drivers = int((np.cumsum(v.list_high[lists][::-1])[::-1] >= least).sum())
        b = _ranges(v.list_block[lists], v.list_block[lists + 1])
        drives = np.arange(len(b)) < (v.list_block[lists[:drivers] + 1] - v.list_block[lists[:drivers]]).sum()
        edges = np.unique(np.concatenate([v.first[b], v.after[b]]))
        lo, hi = np.searchsorted(edges, v.first[b]), np.searchsorted(edges, v.after[b])

        def bound(of: np.ndarray) -> np.ndarray:
            """Summed block maxima for the documents from each edge up to the next."""
            change = np.zeros(len(edges) + 1, np.int64)
            np.add.at(change, lo[of], v.high[b[of]])
            np.subtract.at(change, hi[of], v.high[b[of]])
            return np.cumsum(change)[:-1]

        light = bound(~drives)
        opens = light + bound(drives) >= least
        opened = np.concatenate([[0], np.cumsum(opens)])
        live = b[drives & (opened[hi] > opened[lo])]
        p = _ranges(v.begin[live], v.end[live])
        p = p[opens[np.searchsorted(edges, v.docs[p], "right") - 1]]
        self.evaluated += len(p)
        docs, total = _summed(v.docs[p], v.scores[p])
        hope = total + light[np.searchsorted(edges, docs, "right") - 1]
        hope[np.isin(docs, seen)] = 0
        order = np.argsort(-hope, kind="stable")
        at, chunk = 0, 32
        while at < len(order):
            some = order[at : at + chunk]
            some = some[hope[some] >= self._least(i)]
            if not len(some):
                return
            self._evaluate(i, docs[some], total[some], lists[drivers:], v)
            at, chunk = at + chunk, chunk * 4

    def _evaluate(self, i: int, docs: np.ndarray, total: np.ndarray, lists: np.ndarray, v: _View) -> None:
        """Merge in ``docs`` (in order), which have ``total`` without ``lists``: their postings in these are sought."""
        wanted = (lists[:, None] << 32 | docs).ravel()
        at = np.minimum(np.searchsorted(v.keys, wanted), len(v.keys) - 1)
        self.evaluated += len(wanted)
        total = total + np.where(v.keys[at] == wanted, v.scores[at], 0).reshape(len(lists), len(docs)).sum(0)
        some = total >= self._least(i)
        self._merge(i, total[some], v.ids[docs[some]], v.absent[docs[some]])

    def _merge(self, i: int, total: np.ndarray, ids: np.ndarray, absent: np.ndarray) -> None:
        if len(total) > self.most:
            least = np.partition(total, -self.most)[-self.most]
            total, ids, absent = total[total >= least], ids[total >= least], absent[total >= least]
        total, ids, absent = (np.concatenate(x) for x in zip(self.best[i], (total, ids, absent), strict=True))
        top = np.lexsort((ids, absent, -total))[: self.most]
        self.best[i] = total[top], ids[top], absent[top]

    def found(self) -> Iterator[pa.RecordBatch]:
        names = np.repeat(np.arange(len(self.items)), [len(b[0]) for b in self.best])
        if len(names):
            total, ids, absent = (np.concatenate(x) for x in zip(*self.best, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([self.names[k] for k in names], pa.string()), pa.array(ids, pa.int64(), mask=absent), pa.array(total, pa.int64())], ["item", "doc_id", "score"])


def _pairs(items: DataFrame) -> DataFrame:
    """(item, term), each once; the rows of one item_id are one item."""
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(WORD_ALNUM), F.lit(0))
    return items.select(F.col("item_id").cast("string").alias("item"), F.explode(words).alias("term")).distinct()


def search(index: DataFrame, items: DataFrame, most: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``most`` best documents of ``index`` for each item, those with score above 0.

    Items are searched in blocks of ``block_terms`` terms at a time (an item's own terms are held whole); each block reads
    the index once. A task hands on each item's best documents over all of its shards, so what is shuffled is bounded by tasks.
    """
    spark = index.sparkSession
    ship(spark)
    pairs = stage(_pairs(items), "search-items")
    n_docs, n_words = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    total = pairs.count()
    of = 1 if total <= block_terms else -(-2 * total // block_terms)
    terms = pairs.select("term").distinct()
    df = index.select(F.inline(F.arrays_zip("terms", "counts"))).withColumnRenamed("terms", "term")
    df = df.join(broadcast_if(terms, total), "term", "left_semi").groupBy("term").agg(F.sum("counts").alias("df"))
    df = stage(df, "search-df")
    found = []
    for k in range(of):
        block = pairs.where(F.pmod(F.xxhash64("item"), F.lit(of)) == k)
        mine = {r["term"]: r["df"] for r in df.join(broadcast_if(block.select("term").distinct(), total), "term", "left_semi").collect()}  # at most `block_terms`
        listed = [(r["item"], r["terms"]) for r in block.groupBy("item").agg(F.collect_list("term").alias("terms")).collect()]
        shared = spark.sparkContext.broadcast(Searcher(sorted(listed, key=lambda x: (x[0] is None, x[0] or "")), mine, n_docs, n_words, most))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = shared.value
            searcher.start()
            for b in batches:
                for i in range(len(b)):
                    ids = b.column("doc_ids")[i].values
                    shard = {c: b.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("lengths", "counts", "docs", "tfs")}
                    absent = ids.is_null().to_numpy(zero_copy_only=False)
                    shard["doc_ids"] = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
                    searcher.show(shard, b.column("terms")[i].values.to_pylist(), absent)
            yield from searcher.found()

        best = index.select("doc_ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(run, "item string, doc_id long, score long")
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        ranked = best.withColumn("rank", place).where(F.col("rank") <= most)
        found.append(stage(ranked.select(F.col("item").cast(items.schema["item_id"].dataType).alias("item_id"), "rank", "doc_id", "score"), "search-found"))
        shared.destroy()
    unstage(pairs, df)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def rank(docs: DataFrame, items: DataFrame, most: int = 10, vocabulary: int = VOCABULARY, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score) for every item of ``items`` with a match in ``docs``: index, then search.

    Only terms of items are indexed where they are at most ``vocabulary``; else every term is. Null and empty texts have no
    terms; rows that repeat a doc_id are documents of their own, a null doc_id comes last among equal scores; rows that
    share an item_id are one item; an empty table on either side gives no rows; extra columns are ignored.
    """
    terms = _pairs(items).select("term").distinct().limit(vocabulary + 1).collect()
    index = build_index(docs, None if len(terms) > vocabulary else [r["term"] for r in terms])
    found = search(index, items, most, block_terms)
    unstage(index)
    return found
