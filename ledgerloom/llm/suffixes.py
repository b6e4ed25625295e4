"""Removal of long repeated byte strings, with sparse suffix arrays kept in a logarithmic family of levels.

Documents are put in order of their ids and cut into batches, so all with smaller ids are in a
batch or in those before it. A batch is turned into a sorted array of its sampled suffixes. Sampled is, for
every window of ``LENGTH`` bytes, the least-hashed ``GRAM``-byte gram in it, so two copies of a
window sample the same gram; neighbouring windows with the same gram are one segment, whose
key is (hash of the gram, hash of the bytes that its windows span), 104 bits by which strings are told apart.
Arrays are dealt to buckets by the gram. In a bucket each batch in turn is scanned against the
levels that hold the batches before it, which tells what an earlier document has, and is then added
to them; levels of like size merge. A segment that an earlier document has in full is removed
as a whole; where only the gram is shared, single windows are compared in a second round, by
the same arrays and levels.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship, stage, unstage

LENGTH, GRAM = 50, 24
#: Bytes of text in a batch and in a piece of a long text; bytes of sorted records that one bucket holds.
BATCH, PIECE, BUCKET = 8_000_000, 1 << 20, 24_000_000
#: What one step deals to: beyond so many buckets, or batches, rows go to groups of them first, so that rows do not become small.
FAN, BUNDLE = 4096, 64_000_000
#: Of so many batches, grams with at least so many different segments are dealt to all buckets.
SAMPLE_BATCHES, HOT = 8, 32
#: Second keys have so many bits.
LOW_BITS = 40
_R = 0x9E3779B97F4A7C15
_NULL_ID = (1 << 63) - 1  # a null doc_id comes after all others
U = np.uint64


# -- sorted runs and their levels -------------------------------------------------------------------------------


class Run:
    """Records sorted by (high, low), one for each pair, with the smallest document that has it."""

    def __init__(self, high: np.ndarray, low: np.ndarray, doc: np.ndarray):
        self.high, self.low, self.doc = high, low, doc
        self._names: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray, doc: np.ndarray, merge: bool = False) -> tuple[Run, np.ndarray]:
        """The run of some records, and where each of them is in it. ``merge``: they are a few sorted runs in a row."""
        order = np.argsort(high, kind="stable" if merge else None)
        tied = high[order]
        same = np.concatenate([[False], tied[1:] == tied[:-1]])
        at = np.flatnonzero(same | np.append(same[1:], False))  # records that share their high key with a neighbour
        order[at] = order[at][np.lexsort((low[order[at]], high[order[at]]))]
        high, low, doc = high[order], low[order], doc[order]
        if not len(high):
            return cls(high, low, doc), order
        new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])
        first = np.flatnonzero(new)
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return cls(high[first], low[first], np.minimum.reduceat(doc, first)), place

    def __len__(self) -> int:
        return len(self.high)

    def find(self, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each pair is, and whether it is there at all."""
        if not len(self):
            return np.zeros(len(high), np.int64), np.zeros(len(high), bool)
        if self._names is None:
            first = np.flatnonzero(np.concatenate([[True], self.high[1:] != self.high[:-1]]))
            rank = np.repeat(np.arange(len(first), dtype=U), np.diff(np.append(first, len(self))))
            self._names = self.high[first], rank << U(LOW_BITS) | self.low
        names, own = self._names
        at = np.minimum(np.searchsorted(names, high), len(names) - 1)
        key = at.astype(U) << U(LOW_BITS) | low
        k = np.minimum(np.searchsorted(own, key), len(own) - 1)
        return k, (names[at] == high) & (own[k] == key)

    def many(self) -> np.ndarray:
        """Which records share their high key with another low key."""
        new = np.concatenate([[True], self.high[1:] != self.high[:-1]]) if len(self) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        return np.bincount(group)[group] > 1 if len(self) else new

    def pack(self) -> bytes:
        """Compressed: differences of the high keys, then all numbers byte by byte of equal weight."""
        step = np.diff(self.high, prepend=U(0)).astype(U)
        return _pack(step, self.low, self.doc.view(U))

    @classmethod
    def unpack(cls, data: bytes) -> Run:
        step, low, doc = _unpack(data, 3)
        return cls(np.cumsum(step, dtype=U), low, doc.view(np.int64))


def _pack(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(c.view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns))


def _unpack(data: bytes, columns: int) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // (8 * columns)
    return [np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8 * n * i).reshape(8, n).T).view(U).ravel() for i in range(columns)]


def _joined(runs: list[Run]) -> Run:
    return Run.of(*(np.concatenate([getattr(r, f) for r in runs]) for f in ("high", "low", "doc")), merge=True)[0]


class IndexFamily:
    """Levels of runs, each at least twice the next: a new run is added as the last and merged while sizes are alike."""

    def __init__(self) -> None:
        self.levels: list[Run] = []

    def scan(self, run: Run) -> np.ndarray:
        """The smallest document with each record of ``run`` in any level (the largest number if none)."""
        best = np.full(len(run), _NULL_ID)
        for level in self.levels:
            at, there = level.find(run.high, run.low)
            best[there] = np.minimum(best[there], level.doc[at[there]])
        return best

    def add(self, run: Run) -> None:
        while self.levels and len(self.levels[-1]) < 2 * len(run):
            run = _joined([self.levels.pop(), run])
        self.levels.append(run)

    def fold(self) -> Run:
        """All levels as one."""
        while len(self.levels) > 1:
            last = self.levels.pop()
            self.levels[-1] = _joined([self.levels[-1], last])
        return self.levels[0] if self.levels else Run(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64))


# -- batches of texts ---------------------------------------------------------------------------------------------

_powers: list[np.ndarray] = [np.zeros(0, U)] * 2


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        up, down = np.full(n, _R, U), np.full(n, pow(_R, -1, 1 << 64), U)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)


class Texts:
    """Some whole documents, and the segments of their windows."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, data: bytes):
        self.ids, self.size, self.data = ids, size, data
        self.begin = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    @classmethod
    def of(cls, docs: list[tuple[int, bytes]]) -> Texts:
        return cls(np.array([i for i, _ in docs], np.int64), np.array([len(t) for _, t in docs], np.int64), b"".join(t for _, t in docs))

    def pack(self) -> bytes:
        return zstandard.ZstdCompressor(level=3).compress(b"".join([np.int64(len(self.ids)).tobytes(), self.ids.tobytes(), self.size.tobytes(), self.data]))

    @classmethod
    def unpack(cls, data: bytes) -> Texts:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        return cls(np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n), raw[8 + 16 * n :])

    def segments(self, shift: int, windows: Callable | None = None) -> list[tuple[np.ndarray, ...]]:
        """For each stretch of at most PIECE bytes: (high, low, document number, first window, windows), windows as places in ``data``.

        ``windows(k, total, down, offset)`` is called with each stretch, for hashes of single windows.
        """
        out = []
        for d0, d1, lo, hi in self._stretches():
            data = np.frombuffer(self.data, np.uint8, hi - lo, lo)
            if len(data) < LENGTH:
                continue
            up, down = _power(len(data) + 1)
            total = np.zeros(len(data) + 1, U)
            np.cumsum((data.astype(U) + U(1)) * up[:-1], out=total[1:])
            least = _mix((total[GRAM:] - total[:-GRAM]) * down[: len(data) - GRAM + 1])
            span, wide = 1, LENGTH - GRAM + 1
            while span * 2 <= wide:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if wide > span:
                least = np.minimum(least[: len(least) - (wide - span)], least[wide - span :])
            begin = np.maximum(self.begin[d0:d1] - lo, 0)
            end = np.minimum(self.begin[d0 + 1 : d1 + 1] - lo, hi - lo) - LENGTH + 1  # after the last window of each document
            full = np.flatnonzero(end > begin)
            fresh = np.concatenate([[True], least[1:] != least[:-1]])
            fresh[begin[full]] = True
            start = np.flatnonzero(fresh)
            doc = np.searchsorted(self.begin[d0 : d1 + 1] - lo, start, "right") - 1
            inside = start < end[doc]
            start, doc = start[inside], doc[inside]
            stop = np.minimum(np.append(start[1:], len(least)), end[doc])
            low = _mix((total[stop + LENGTH - 1] - total[start]) * down[start] + (stop - start).astype(U)) >> U(64 - LOW_BITS)
            out.append((least[start] >> U(shift), low, doc + d0, start + lo, stop - start))
            if windows:
                windows(len(out) - 1, total, down, lo)
        return out

    def _stretches(self) -> Iterator[tuple[int, int, int, int]]:
        """(first document, end document, first byte, end byte): whole documents up to PIECE bytes, or parts of a long one that overlap."""
        d = 0
        while d < len(self.ids):
            if self.size[d] > PIECE:
                for lo in range(int(self.begin[d]), int(self.begin[d + 1]), PIECE):
                    yield d, d + 1, lo, min(lo + PIECE + LENGTH - 1, int(self.begin[d + 1]))
                d += 1
                continue
            e = d + 1
            while e < len(self.ids) and self.begin[e + 1] - self.begin[d] <= PIECE:
                e += 1
            yield d, e, int(self.begin[d]), int(self.begin[e])
            d = e

    def decided(self, plan: Plan, answers: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
        """What the first round settles: places (start, end) of whole segments to remove, and the single windows left to compare.

        Those are, of every segment that shares its gram with a different one, the windows in the
        smallest document that has it: (high, low, document number, place) for each stretch.
        """
        hashed: dict[int, tuple] = {}
        found = self.segments(plan.shift, lambda k, *x: hashed.__setitem__(k, x))
        if not found:
            return np.zeros((0, 2), np.int64), []
        high, low, doc, start, n = (np.concatenate([f[i] for f in found]) for i in range(5))
        own, at = Run.of(high, low, self.ids[doc])
        earlier, many = told(own, plan, answers)
        gone = earlier[at] | (own.doc[at] < self.ids[doc])
        whole = np.stack([start[gone], start[gone] + n[gone] - 1 + LENGTH], 1)
        left, part = np.flatnonzero(many[at] & ~gone), np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
        out = []
        for k in range(len(found)):
            s = left[part[left] == k]
            if len(s):
                total, down, lo = hashed[k]
                place = np.repeat(start[s] - np.concatenate([[0], np.cumsum(n[s])[:-1]]), n[s]) + np.arange(n[s].sum())
                x = place - lo
                h = _mix((total[x + LENGTH] - total[x]) * down[x])
                out.append((h, np.repeat(high[s] & U(0xFFFF), n[s]), np.repeat(doc[s], n[s]), place))
        return whole, out

    def removed(self, plan: Plan, first: list[bytes], second: list[bytes]) -> np.ndarray:
        """A mask of the bytes to remove."""
        whole, windows = self.decided(plan, first)
        diff = np.zeros(len(self.data) + 1, np.int32)
        np.add.at(diff, whole[:, 0], 1)
        np.add.at(diff, whole[:, 1], -1)
        if windows:
            high, low, doc, place = (np.concatenate([w[i] for w in windows]) for i in range(4))
            own, at = Run.of(high, low, self.ids[doc])
            earlier, _ = told(own, plan._replace(hot=_NONE), second)
            gone = place[earlier[at] | (own.doc[at] < self.ids[doc])]
            np.add.at(diff, gone, 1)
            np.add.at(diff, gone + LENGTH, -1)
        return np.cumsum(diff[:-1]) > 0


_NONE = np.zeros(0, U)


class Plan(NamedTuple):
    """How records are dealt: bits that gram hashes lose, the number of buckets, sorted hashes of grams with many segments."""

    shift: int
    buckets: int
    hot: np.ndarray = _NONE

    def is_hot(self, high: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(high), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, high), len(self.hot) - 1)] == high

    def bucket_of(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """By the high key, so that all segments of a gram meet; those of a hot gram, which has many anyhow, by both keys."""
        key = np.where(self.is_hot(high), high ^ (low * U(_R)), high)
        return ((key * U(0xC2B2AE3D27D4EB4F)) >> U(33)).astype(np.int64) % self.buckets

    def parts(self, run: Run, per: int = 1) -> Iterator[tuple[int, np.ndarray]]:
        """(bucket // per, places of its records in the run, in order) for each that is not empty."""
        bucket = self.bucket_of(run.high, run.low) // per
        order = np.argsort(bucket, kind="stable")
        edge = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        for s, e in zip(edge, np.append(edge[1:], len(order)), strict=True):
            yield int(bucket[order[s]]), order[s:e]


def told(own: Run, plan: Plan, answers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each record of a batch's run: whether an earlier document outside has it, and whether its high key comes with several low ones.

    An answer names records by their places in what the batch sent to a bucket, so it is a byte or two for each.
    """
    earlier, many = np.zeros(len(own), bool), np.zeros(len(own), bool)
    parts = dict(plan.parts(own)) if answers else {}
    for a in answers:
        step, says = _unpack(a, 2)
        at = np.cumsum(step[1:]).astype(np.int64)
        part = parts[int(step[0])][at]
        earlier[part], many[part] = says[1:] & U(1) > 0, says[1:] & U(2) > 0
    return earlier, many


# -- the job --------------------------------------------------------------------------------------------------------


def _batches(docs: DataFrame, parts: int) -> DataFrame:
    """(batch, data): whole documents in batches of about BATCH bytes, numbered in order of the ids (null last).

    Rows of one id may be dealt to several tasks, since they do not count against each other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pa.RecordBatch.from_pydict({"batch": pa.array([(part << 32) + n], pa.int64()), "data": pa.array([Texts.of(held).pack()], pa.binary())})
        for b in pieces(batches):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                held.append((_NULL_ID if i is None else i, t or b""))
                size += len(held[-1][1])
                if size >= BATCH:
                    yield row()
                    n, held, size = n + 1, [], 0
        if held:
            yield row()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    in_order = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_last(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_last())
    return in_order.select("doc_id", "text").mapInArrow(run, "batch long, data binary")


def _bundle(items: list[tuple[int, bytes]]) -> bytes:
    """Some numbered byte strings as one."""
    head = np.array([len(items), *[i for i, _ in items], *[len(x) for _, x in items]], np.int64)
    return b"".join([head.tobytes(), *[x for _, x in items]])


def _unbundle(data: bytes) -> Iterator[tuple[int, bytes]]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, size = np.frombuffer(data, np.int64, 2 * n, 8).reshape(2, n)
    stop = 8 + 16 * n + np.cumsum(size)
    for i, s, e in zip(ids.tolist(), (stop - size).tolist(), stop.tolist(), strict=True):
        yield i, data[s:e]


def _rows(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


#: ``data`` is a bundle, for rows of a bucket (or a group of buckets) of the runs of batches, for those of a batch (or a group) of answers.
_DEALT, _ANSWER = "bucket int, batch long, data binary", "batch long, kind int, data binary"
_DEALT_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("data", pa.binary())])
_ANSWER_ARROW = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("data", pa.binary())])


def _per(plan: Plan) -> int:
    """Buckets in a group of those that a batch is dealt to."""
    return -(-plan.buckets // FAN)


def _dealt(run: Run, batch: int, plan: Plan) -> Iterator[dict]:
    """The run of a batch, cut into buckets, or into groups of them if they are very many."""
    for k, part in plan.parts(run, _per(plan)):
        yield {"bucket": k, "batch": batch, "data": _bundle([(batch, Run(run.high[part], run.low[part], run.doc[part]).pack())])}


def _held(arrived: Iterator[pa.RecordBatch], names: tuple[str, ...], split: Callable, most: int) -> Iterator[tuple[tuple, dict[int, list[tuple[int, bytes]]]]]:
    """(values of ``names``, what ``split`` makes of some rows that agree in them, by a number): never more than ``most`` bytes at a time."""
    now, out, size = None, {}, 0
    for b in pieces(arrived, 4 << 20):
        for r in b.to_pylist():
            key = tuple(r[n] for n in names)
            if out and (key != now or size >= most):
                yield now, out
                out, size = {}, 0
            now, size = key, size + len(r["data"])
            for to, item in split(r["data"]):
                out.setdefault(to, []).append(item)
    if out:
        yield now, out


def _regrouped(dealt: DataFrame, plan: Plan, parts: int) -> DataFrame:
    """Rows of single buckets out of rows of groups of them; a row takes in many batches, so their number grows with the bytes only."""
    if _per(plan) == 1:
        return dealt

    def split(data: bytes) -> Iterator[tuple[int, tuple[int, bytes]]]:
        for batch, packed in _unbundle(data):
            run = Run.unpack(packed)
            for k, part in plan.parts(run):
                yield k, (batch, Run(run.high[part], run.low[part], run.doc[part]).pack())

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, out in _held(arrived, ("bucket",), split, BUNDLE):
            yield _rows([{"bucket": k, "batch": items[0][0], "data": _bundle(items)} for k, items in sorted(out.items())], _DEALT_ARROW)

    return dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, _DEALT)


def _addressed(answers: DataFrame, groups: int, parts: int) -> DataFrame:
    """Rows of single batches out of rows of groups of them."""
    if not groups:
        return answers

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, kind), out in _held(arrived, ("batch", "kind"), lambda data: ((i, (i, x)) for i, x in _unbundle(data)), BUNDLE):
            yield _rows([{"batch": i, "kind": kind, "data": _bundle(items)} for i, items in out.items()], _ANSWER_ARROW)

    return answers.repartition(parts, "batch").sortWithinPartitions("batch", "kind").mapInArrow(run, _ANSWER)


def _answers(dealt: DataFrame, kind: int, plan: Plan, parts: int, groups: int) -> DataFrame:
    """(batch, kind, data): for each batch, the records that an earlier document has, or (flagged) whose high key comes with several low ones.

    Batches come to a bucket in order. Each is scanned against the levels, then enters them; a
    bucket is bounded, as hot grams are dealt to all of them.
    """

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, family, held, out, size = None, IndexFamily(), [], {}, 0

        def close() -> None:
            nonlocal size
            whole = family.fold() if kind == 0 else None
            many = whole.many() | plan.is_hot(whole.high) if kind == 0 else None
            for batch, own, earlier in held:
                says = earlier.astype(np.uint8)
                if kind == 0:
                    says |= many[whole.find(own.high, own.low)[0]].astype(np.uint8) << 1
                tell = np.flatnonzero(says)
                if len(tell):
                    data = _pack(np.concatenate([[now], np.diff(tell, prepend=0)]).astype(U), np.concatenate([[0], says[tell]]).astype(U))
                    out.setdefault(batch * 0x9E3779B1 % groups if groups else batch, []).append((batch, data))
                    size += len(data)

        def ready() -> Iterator[pa.RecordBatch]:
            nonlocal size
            if out:
                yield _rows([{"batch": k, "kind": kind, "data": _bundle(items)} for k, items in out.items()], _ANSWER_ARROW)
                out.clear()
                size = 0

        for b in pieces(arrived, 4 << 20):
            for r in b.to_pylist():
                if r["bucket"] != now:
                    close()
                    if size >= BUNDLE or not groups:
                        yield from ready()
                    now, family, held = r["bucket"], IndexFamily(), []
                for batch, packed in _unbundle(r["data"]):
                    own = Run.unpack(packed)
                    held.append((batch, own, family.scan(own) < own.doc))
                    family.add(own)
        close()
        yield from ready()

    found = _regrouped(dealt, plan, parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "batch").mapInArrow(run, _ANSWER)
    return _addressed(found, groups, parts)


def _with_texts(batches: DataFrame, answers: DataFrame, parts: int, step: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """``step(batch, texts, answers by kind)`` gives the rows of each batch; its texts come last of what is dealt to it."""
    both = answers.unionByName(batches.select("batch", F.lit(9).alias("kind"), "data"))

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, said = None, {}
        for b in pieces(arrived, 4 << 20):
            for r in b.to_pylist():
                if r["batch"] != now:
                    now, said = r["batch"], {}
                if r["kind"] < 9:
                    said.setdefault(r["kind"], []).extend(x for _, x in _unbundle(r["data"]))
                else:
                    yield _rows(list(step(now, Texts.unpack(r["data"]), said)), arrow)

    return both.repartition(parts, "batch").sortWithinPartitions("batch", "kind").mapInArrow(run, schema)


def _own_run(texts: Texts, shift: int) -> Run | None:
    found = texts.segments(shift)
    if not found:
        return None
    high, low, doc = (np.concatenate([f[i] for f in found]) for i in range(3))
    return Run.of(high, low, texts.ids[doc])[0]


def _hot_grams(batches: DataFrame, shift: int) -> np.ndarray:
    """Hashes of grams with HOT or more different segments in SAMPLE_BATCHES batches: at most a few of the sample's records.

    This decides only where records meet, never what is removed.
    """

    def run(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(arrived, 4 << 20):
            for data in b.column("data").to_pylist():
                own = _own_run(Texts.unpack(data), shift)
                if own is not None:
                    high, n = np.unique(own.high, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(high[n > 1].view(np.int64)), pa.array(n[n > 1])], ["high", "n"])

    some = batches.join(F.broadcast(batches.select("batch").orderBy(F.xxhash64("batch")).limit(SAMPLE_BATCHES)), "batch").select("data")
    hot = some.mapInArrow(run, "high long, n long").groupBy("high").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT).collect()
    return np.sort(np.array([r["high"] for r in hot], np.int64).view(U))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of ``docs``.

    Removed is every byte covered by a ``LENGTH``-byte string that also starts in a document with
    a smaller doc_id; documents with the same id do not count against each other, a null id
    comes after all others, a null text counts as empty. Other columns are ignored; an empty table gives no rows.
    Memory: one batch of texts and the records of one bucket.
    """
    spark = docs.sparkSession
    ship(spark)
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(16, -(-total * 2 // BUCKET))
    parts, text_parts = max(least, -(-buckets // 4)), max(least, -(-total // (4 * BATCH)))
    groups = FAN if total // BATCH > FAN else 0
    batches = stage(_batches(docs, text_parts), "batches")
    shift = max(0, 64 - (max(1, total).bit_length() + 16))
    plan = Plan(shift, buckets, _hot_grams(batches, shift))
    plan2 = plan._replace(hot=_NONE)

    def sort(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(arrived, 4 << 20):
            for r in b.to_pylist():
                own = _own_run(Texts.unpack(r["data"]), shift)
                if own is not None:
                    yield _rows(list(_dealt(own, r["batch"], plan)), _DEALT_ARROW)

    first = stage(_answers(batches.mapInArrow(sort, _DEALT), 0, plan, parts, groups), "first")

    def windows(batch: int, texts: Texts, said: dict) -> Iterator[dict]:
        _, left = texts.decided(plan, said.get(0, []))
        if left:
            high, low, doc = (np.concatenate([w[i] for w in left]) for i in range(3))
            yield from _dealt(Run.of(high, low, texts.ids[doc])[0], batch, plan2)

    second = stage(_answers(_with_texts(batches, first, text_parts, windows, _DEALT, _DEALT_ARROW), 1, plan2, parts, groups), "second")

    def finish(batch: int, texts: Texts, said: dict) -> Iterator[dict]:
        mask = texts.removed(plan, said.get(0, []), said.get(1, []))
        data = np.frombuffer(texts.data, np.uint8)
        for i, d in enumerate(texts.ids.tolist()):
            own = slice(texts.begin[i], texts.begin[i + 1])
            m = mask[own]
            starts = int(m[:1].sum() + (m[1:] & ~m[:-1]).sum())
            yield {"doc_id": None if d == _NULL_ID else d, "n_bytes": len(m), "n_removed": int(m.sum()), "n_spans": starts, "kept_sha256": hashlib.sha256(data[own][~m].tobytes()).hexdigest()}

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    out = _with_texts(batches, first.unionByName(second), text_parts, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", schema)
    out = stage(out, "repeats")
    unstage(batches, first, second)
    return out
