"""Quality rules: counts per text, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
#: Weights of each family of n-grams; words of 1 and 2, characters (UTF-8 bytes) of 2 and 4.
DIM, FAMILIES = 1 << 16, (("word", 1), ("word", 2), ("char", 2), ("char", 4))
#: Most labelled rows that are fitted on; texts below this calibrated probability of being good are rejected.
SAMPLE, KEEP_AT = 1500, 0.5
SCALE = 60.0
#: Texts of more bytes are walked in stretches of so many.
LONG, STRETCH = 4 << 20, 1 << 20
_SPACE, _NEXT_WORD = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[\x20\x09-\x0D]+[^\x20\x09-\x0D]*")
_R = 0x9E3779B97F4A7C15
#: Bytes that are white space or continue a character: what is left of a text has one byte for each character in a word.
_NOT_COUNTED = bytes([32, *range(9, 14), *range(0x80, 0xC0)])


_power_cache: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """r^i and r^-i modulo 2^64, kept up to a few MB."""
    if len(_power_cache[0]) < n:
        up, down = np.full(n, _R, np.uint64), np.full(n, pow(_R, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        made = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
        if n > 1 << 20:
            return tuple(made)
        _power_cache[:] = made
    return _power_cache[0][:n], _power_cache[1][:n]


class Grid:
    """The bytes of a batch of whole texts, a line end after each, with running polynomial hashes and the edges of words."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.data = np.frombuffer(b"".join(t + b"\n" for t in texts), np.uint8)
        self.stop = np.cumsum(np.array([len(t) + 1 for t in texts], np.int64))
        self.start = np.concatenate([[0], self.stop[:-1]]).astype(np.int64)
        up, self.down = _powers(len(self.data) + 1)
        self.total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=self.total[1:])
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.diff(np.concatenate([[True], space, [True]]).view(np.int8))
        self.first, self.last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.word_start, self.word_stop = np.searchsorted(self.first, self.start), np.searchsorted(self.first, self.stop)

    def word_hashes(self, n: int) -> np.ndarray:
        """A hash of every run of ``n`` words with what is between them."""
        s, e = self.first[: max(0, len(self.first) - n + 1)], self.last[n - 1 :]
        return (self.total[e] - self.total[s]) * self.down[s]

    def char_hashes(self, n: int) -> np.ndarray:
        return (self.total[n:] - self.total[:-n]) * self.down[: max(0, len(self.data) - n + 1)]

    def repeat_words(self) -> np.ndarray:
        """For each text: how many words stand in a 3-word window that is found at least twice in it.

        Hashes leave the few windows that may repeat; those are then compared word by word, so the count is exact.
        """
        h = self.word_hashes(1) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        owner = np.repeat(np.arange(len(self.texts)), self.word_stop - self.word_start)
        three = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + owner[2:].astype(np.uint64) * np.uint64(_R >> 7 | 1)
        ranked = np.sort(three)
        twice = ranked[1:][ranked[1:] == ranked[:-1]]
        counts = np.zeros(len(self.texts), np.int64)
        if not len(twice):
            return counts
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, three), len(twice) - 1)] == three)
        at = at[owner[at] == owner[at + 2]]
        for d in np.unique(owner[at]):
            own = at[owner[at] == d] - self.word_start[d]
            words = self.texts[d].split()
            number: dict[tuple, int] = {}
            ids = np.array([number.setdefault((words[i], words[i + 1], words[i + 2]), len(number)) for i in own.tolist()])
            own = own[np.bincount(ids)[ids] > 1]
            hit = np.zeros(len(words), bool)
            for j in range(3):
                hit[own + j] = True
            counts[d] = hit.sum()
        return counts


def base_counts(grid: Grid) -> list[tuple[int, int, int, int, int]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each UTF-8 text."""
    out = []
    for t, words, again in zip(grid.texts, (grid.word_stop - grid.word_start).tolist(), grid.repeat_words().tolist(), strict=True):
        lines, seen, dup = t.split(b"\n"), set(), 0
        for line in lines if len(lines) > 1 else ():
            if line in seen:
                dup += 1
            elif line and not line.isspace():
                seen.add(line)
        out.append((words, len(t.translate(None, _NOT_COUNTED)), len(t) - len(t.translate(None, SYMBOLS)), dup, again))
    return out


def features(grid: Grid) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each family: the slots of all n-grams in a row, and where each text's begin and end (none: begin = end).

    N-grams of characters run into the line end that closes a text, never into the next text.
    """
    mixer, shift = np.uint64(0xBF58476D1CE4E5B9), np.uint64(64 - DIM.bit_length() + 1)
    out = []
    for kind, n in FAMILIES:
        h, lo, hi = (grid.word_hashes(n), grid.word_start, grid.word_stop) if kind == "word" else (grid.char_hashes(n), grid.start, grid.stop)
        out.append((((h * mixer) >> shift).view(np.int64), lo, np.maximum(lo, hi - n + 1)))
    return out


def _sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sums over [lo, hi), each independent of what else is in the batch."""
    out, full = np.zeros(len(lo)), np.flatnonzero(hi > lo)
    if len(full):
        cuts = np.stack([lo[full], hi[full]], 1).ravel()
        out[full] = np.add.reduceat(np.append(values, 0.0), cuts)[::2]
    return out


@dataclass
class Model:
    """Weights by family and slot, a bias, and the two numbers of the calibration."""

    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def probability(self, grid: Grid) -> np.ndarray:
        """Calibrated probability that each text is good."""
        z = np.full(len(grid.texts), self.bias)
        for w, (slot, lo, hi) in zip(self.weights, features(grid), strict=True):
            z += SCALE * _sums(w[slot], lo, hi) / np.maximum(hi - lo, 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -30, 30)))


# -- long texts ---------------------------------------------------------------------------------------------------


def _stretches(text: bytes) -> Iterator[tuple[Grid, int, bool]]:
    """Grids over a long text in stretches, how many bytes of each belong to it, and whether it is the last.

    A stretch ends at white space; its grid goes on to the end of the next word, and for some bytes at least, so every n-gram that
    begins in the stretch is in its grid. A word that is longer than a stretch is held whole.
    """
    at = 0
    while True:
        cut = _SPACE.search(text, at + STRETCH) if at + STRETCH < len(text) else None
        if not cut:
            yield Grid([text[at:]]), len(text) - at, True
            return
        more = _NEXT_WORD.match(text, cut.start())
        yield Grid([text[at : max(more.end() if more else len(text), cut.start() + 4)]]), cut.start() - at, False
        at = cut.start()


def long_slots(text: bytes) -> Iterator[list[np.ndarray]]:
    """The slots of all n-grams of a long text, for each family, stretch by stretch."""
    mixer, shift = np.uint64(0xBF58476D1CE4E5B9), np.uint64(64 - DIM.bit_length() + 1)
    for grid, size, last in _stretches(text):
        out = []
        for kind, n in FAMILIES:
            h = grid.word_hashes(n) if kind == "word" else grid.char_hashes(n)
            if not last:
                h = h[: int(np.searchsorted(grid.first, size)) if kind == "word" else size]
            out.append(((h * mixer) >> shift).view(np.int64))
        yield out


def long_probability(text: bytes, model: Model) -> float:
    total, count = np.zeros(len(FAMILIES)), np.zeros(len(FAMILIES))
    for slots in long_slots(text):
        for k, slot in enumerate(slots):
            total[k] += model.weights[k][slot].sum()
            count[k] += len(slot)
    z = model.bias + float((SCALE * total / np.maximum(count, 1)).sum())
    return float(1 / (1 + np.exp(-np.clip(model.slope * z + model.shift, -30, 30))))


def long_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """``base_counts`` of a long text: of its words only hashes and places are held, of its lines the different ones."""
    hashes, first, last, at = [], [], [], 0
    for grid, size, _ in _stretches(text):
        n = int(np.searchsorted(grid.first, size))
        hashes.append(grid.word_hashes(1)[:n])
        first.append(grid.first[:n] + at)
        last.append(grid.last[:n] + at)
        at += size
    h, first, last = (np.concatenate(x) for x in (hashes, first, last))
    seen, dup = set(), 0
    for line in io.BytesIO(text):
        line = line.removesuffix(b"\n")
        if line in seen:
            dup += 1
        elif line and not line.isspace():
            seen.add(line)
    three = h[:-2] * np.uint64(3) + h[1:-1] * np.uint64(0x9E3779B97F4A7C15) + h[2:] * np.uint64(0xC2B2AE3D27D4EB4F)
    ranked = np.sort(three)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    again = 0
    if len(twice):
        own = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, three), len(twice) - 1)] == three)
        number: dict[tuple, int] = {}
        word = lambda i: text[first[i] : last[i]]
        ids = np.fromiter((number.setdefault((word(i), word(i + 1), word(i + 2)), len(number)) for i in own), np.int64, len(own))
        own = own[np.bincount(ids)[ids] > 1]
        hit = np.zeros(len(h), bool)
        for j in range(3):
            hit[own + j] = True
        again = int(hit.sum())
    return len(h), len(text.translate(None, _NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), dup, again


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], steps: int = 120, decay: float = 1e-3) -> Model:
    """Logistic regression (Adam on all rows) on (slots, values, label); a quarter of the rows, held out, calibrates it.

    With fewer than 8 rows, or one label only, the model calls every text good.
    """
    y = np.array([r[2] for r in rows], float)
    if len(rows) < 8 or y.min() == y.max():
        return Model(np.zeros((len(FAMILIES), DIM)), 0.0, 0.0, 30.0)
    held = np.arange(len(rows)) % 4 == 3
    col, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    balance = np.where(held, 0.0, np.where(y == 1, 0.5 / max((y * ~held).sum(), 1), 0.5 / max(((1 - y) * ~held).sum(), 1)))
    slots, col = np.unique(col, return_inverse=True)
    w, b, m, v = np.zeros(len(slots)), 0.0, np.zeros(len(slots) + 1), np.zeros(len(slots) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col] * val, minlength=len(rows)) + b
        g = balance * (1 / (1 + np.exp(-z)) - y)
        grad = np.append(np.bincount(col, g[row] * val, minlength=len(slots)) + decay * w / len(slots), g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    z = np.bincount(row, w[col] * val, minlength=len(rows)) + b
    a, c = _platt(z[held], y[held])
    weights = np.zeros(len(FAMILIES) * DIM)
    weights[slots] = w
    return Model(weights.reshape(len(FAMILIES), DIM), float(b), a, c)


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through scores and labels, with Platt's softened labels."""
    good = y.sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -30, 30)))
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * z * z).sum() + 1e-6, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
        d = np.linalg.solve(h, [((p - t) * z).sum(), (p - t).sum()])
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-9))
        a, c = a - d[0], c - d[1]
    return float(a), float(c)


def _bytes(b: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most ``sample`` labelled documents, those whose ids have the lowest hashes.

    Rows whose id is labelled both ways, or null, are left out; of documents that repeat an id the
    least text is taken. What reaches the driver is
    the hashed counts of the sampled texts, at most ``DIM`` values for each family.
    """
    both = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    some = both.where("quality = most").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id", "quality").collect()
    if not some:
        return fit([])
    quality = {r["doc_id"]: int(r["quality"]) for r in some}  # at most `sample` ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            ids, texts = b.column("doc_id").to_pylist(), _bytes(b)
            slots, values = [[] for _ in ids], [[] for _ in ids]
            long = len(texts) == 1 and len(texts[0]) > LONG
            if long:
                counts = np.zeros((len(FAMILIES), DIM), np.int64)
                for found in long_slots(texts[0]):
                    for k, slot in enumerate(found):
                        counts[k] += np.bincount(slot, minlength=DIM)
                for k, n in enumerate(counts):
                    key = np.flatnonzero(n)
                    slots[0].append((key + k * DIM).astype(np.int32))
                    values[0].append((SCALE * n[key] / max(n.sum(), 1)).astype(np.float32))
            for k, (slot, lo, hi) in enumerate(features(Grid(texts)) if texts and not long else []):
                for i in range(len(ids)):
                    key, n = np.unique(slot[lo[i] : hi[i]], return_counts=True)
                    slots[i].append((key + k * DIM).astype(np.int32))
                    values[i].append((SCALE * n / max(hi[i] - lo[i], 1)).astype(np.float32))
            cat = lambda xs, t: pa.array([np.concatenate(x) if x else [] for x in xs], pa.list_(t))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), cat(slots, pa.int32()), cat(values, pa.float32())], ["doc_id", "slots", "values"])

    picked = docs.selectExpr("cast(doc_id as long) doc_id", "text").where(F.col("doc_id").isin(list(quality)))
    picked = picked.groupBy("doc_id").agg(F.min("text").alias("text"))  # of rows that repeat an id, always the same one
    rows: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
    for b in picked.mapInArrow(run, "doc_id long, slots array<int>, values array<float>").toArrow().to_batches():
        slots, values = b.column("slots"), b.column("values")  # stay arrays: as Python numbers they would take ten times the memory
        for i, d in enumerate(b.column("doc_id").to_pylist()):
            rows[d] = (slots[i].values.to_numpy(), values[i].values.to_numpy(), quality[d])
    return fit([rows[k] for k in sorted(rows, key=lambda k: (k * _R) % 2**64)])


def judge(texts: list[bytes], model: Model, keep_at: float = KEEP_AT) -> dict[str, list]:
    if not texts:
        return {"counts": [], "failed": [], "p": [], "kept": []}
    if len(texts) == 1 and len(texts[0]) > LONG:
        counts, p = [long_counts(texts[0])], [long_probability(texts[0], model)]
    else:
        grid = Grid(texts)
        counts, p = base_counts(grid), model.probability(grid)
    failed = [c[0] < LEAST_WORDS or 100 * c[4] > MOST_REPEAT_PERCENT * c[0] for c in counts]
    return {"counts": counts, "failed": failed, "p": p, "kept": [not f and bool(x >= keep_at) for f, x in zip(failed, p, strict=True)]}


def report(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, the five counts, base_failed, probability, kept) for every row of ``docs``.

    A null text counts as empty and fails; repeated rows are judged alike; other columns
    are ignored; an empty table gives no rows; without usable labels only the base rules decide.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model or train(docs, labels))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            j = judge(_bytes(b), shared.value)
            cols = {"doc_id": b.column("doc_id")} | {n: pa.array([c[i] for c in j["counts"]], pa.int64()) for i, n in enumerate(names)}
            cols |= {"base_failed": pa.array(j["failed"], pa.bool_()), "probability": pa.array(j["p"], pa.float64()), "kept": pa.array(j["kept"], pa.bool_())}
            yield pa.RecordBatch.from_pydict(cols)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(n + ' long' for n in names)}, base_failed boolean, probability double, kept boolean")


def kept_documents(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """The documents that are kept, as they came: null, empty and short texts go, repeated rows stay or go alike.

    Any other columns are carried along; an empty table gives no rows; see ``report`` for missing labels.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            yield b.filter(pa.array(judge(_bytes(b), shared.value)["kept"], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
