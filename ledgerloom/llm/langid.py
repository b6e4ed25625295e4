"""Language identification by a small convolutional network over bytes.

Every text is cut into windows of one length; in each, filters of several widths run over embedded bytes, their maxima
over the window are pooled, and a softmax gives the languages' probabilities; a text's is the mean of its windows', by
letters. The network is trained in numpy on the driver, on a bounded sample of labelled texts. For scoring, embedding
and filters are multiplied out into tables by byte and by pair of bytes, so a window costs lookups and no products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, ship

#: Bytes from one window to the next; a window also sees the bytes that filters starting in it reach.
STRIDE = 128
WIDTHS, FILTERS, EMBEDDING = (2, 3, 4), 16, 8
REACH = STRIDE + max(WIDTHS) - 1
#: Texts that are fitted on, over all languages (at least 16 of each), and windows of a text.
SAMPLE, WINDOWS_OF_TEXT = 6_000, 2
UNKNOWN = "und"
#: Windows that are scored at a time.
_AT_ONCE = 256


@dataclass
class Network:
    """Parameters: embedding (256, d); for each width filters (width, d, f) and their bias; output weights (filters, languages) and bias."""

    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parameters(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.bias, self.out, self.out_bias]

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Probabilities, pooled features, and where each filter had its maximum, for windows (n, REACH) of bytes."""
        x = self.embedding[windows]
        pooled, where = [], []
        for w, b in zip(self.filters, self.bias, strict=True):
            z = sum(x[:, j : j + STRIDE] @ w[j] for j in range(len(w)))
            at = z.argmax(1)
            pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + b)
            where.append(at)
        h = np.maximum(np.concatenate(pooled, 1), 0)
        return softmax(h @ self.out + self.out_bias), h, where

    def gradients(self, windows: np.ndarray, truth: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy, in the order of ``parameters``; only the places of maxima carry any to filters and embedding."""
        p, h, where = self.forward(windows)
        g = p
        g[np.arange(len(truth)), truth] -= 1
        g /= len(truth)
        back = np.where(h > 0, g @ self.out.T, 0)
        d_embedding, d_filters, d_bias = np.zeros_like(self.embedding), [], []
        rows = np.arange(len(truth))[:, None]
        for k, (w, at) in enumerate(zip(self.filters, where, strict=True)):
            gk = back[:, k * FILTERS : (k + 1) * FILTERS]
            dw = np.zeros_like(w)
            for j in range(len(w)):
                byte = windows[rows, at + j]
                dw[j] = np.einsum("bf,bfd->df", gk, self.embedding[byte])
                np.add.at(d_embedding, byte, gk[:, :, None] * w[j].T)
            d_filters.append(dw)
            d_bias.append(gk.sum(0))
        return [d_embedding, *d_filters, *d_bias, h.T @ g, g.sum(0)]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(windows: np.ndarray, truth: np.ndarray, languages: list[str], least_steps: int = 1000, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Network:
    """Adam over shuffled batches, at least 6 times over all windows; the same windows give the same network."""
    epochs = max(6, -(-least_steps * batch // len(truth)))
    draw = np.random.default_rng(seed)
    normal = lambda *shape, by: (draw.standard_normal(shape) * by).astype(np.float32)
    n = FILTERS * len(WIDTHS)
    net = Network(
        languages, normal(256, EMBEDDING, by=0.5), [normal(w, EMBEDDING, FILTERS, by=(2 / (w * EMBEDDING)) ** 0.5) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS], normal(n, len(languages), by=(1 / n) ** 0.5), np.zeros(len(languages), np.float32),
    )
    slow, fast, t = [np.zeros_like(p) for p in net.parameters()], [np.zeros_like(p) for p in net.parameters()], 0
    steps = epochs * -(-len(truth) // batch)
    for _ in range(epochs if len(languages) > 1 else 0):
        order = draw.permutation(len(truth))
        for k in range(0, len(order), batch):
            t += 1
            for p, g, m, v in zip(net.parameters(), net.gradients(windows[order[k : k + batch]], truth[order[k : k + batch]]), slow, fast, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net


class Tables:
    """A network multiplied out: what each pair of bytes, and each single byte, adds to each filter."""

    def __init__(self, net: Network):
        self.languages, self.out, self.out_bias = net.languages, net.out, net.out_bias
        two, three, four = ([net.embedding @ w[j] for j in range(len(w))] for w in net.filters)
        pair = lambda a, b: (a[:, None] + b[None]).reshape(-1, FILTERS)
        self.here = np.ascontiguousarray(np.concatenate([pair(two[0], two[1]) + net.bias[0], pair(three[0], three[1]) + net.bias[1], pair(four[0], four[1]) + net.bias[2]], 1))
        self.third, self.later = np.ascontiguousarray(three[2]), pair(four[2], four[3])

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Of the languages, for windows (n, REACH) of bytes."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for k in range(0, len(windows), _AT_ONCE):
            w = windows[k : k + _AT_ONCE]
            pair = w[:, :-1].astype(np.int32) << 8 | w[:, 1:]
            z = self.here.take(pair[:, :STRIDE], 0)
            z[:, :, FILTERS : 2 * FILTERS] += self.third.take(w[:, 2 : STRIDE + 2], 0)
            z[:, :, 2 * FILTERS :] += self.later.take(pair[:, 2 : STRIDE + 2], 0)
            out[k : k + len(w)] = softmax(np.maximum(z.max(1), 0) @ self.out + self.out_bias)
        return out


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The windows of all texts, padded with zeros, and where each text's begin (and the end); an empty text has none."""
    counts = np.array([-(-len(t) // STRIDE) for t in texts], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.zeros(int(starts[-1]) * STRIDE, np.uint8)
    for t, s in zip(texts, starts[:-1].tolist(), strict=True):
        flat[s * STRIDE : s * STRIDE + len(t)] = np.frombuffer(t, np.uint8)
    own = flat.reshape(-1, STRIDE)
    more = np.zeros((len(own), REACH - STRIDE), np.uint8)
    more[:-1] = own[1:, : REACH - STRIDE]
    more[starts[1:][counts > 0] - 1] = 0  # a text's last window sees nothing of the next text
    return np.concatenate([own, more], 1), starts


_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b > 127 for b in range(256)])


def predict(texts: list[bytes], tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """The number of each text's language, and the mean of its windows' probabilities, weighted by letters; texts are not empty."""
    windows, starts = cut(texts)
    weight = _LETTER[windows[:, :STRIDE]].sum(1).astype(float) + 1e-6
    p = np.add.reduceat(tables.probabilities(windows).astype(float) * weight[:, None], starts[:-1], axis=0) / np.add.reduceat(weight, starts[:-1])[:, None]
    best = p.argmax(1)
    return best, np.clip(p[np.arange(len(best)), best], 0.0, 1.0)


def _held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 by 3; a null id is not held out (and not fitted on)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE) -> Network | None:
    """Fits on texts with an id that is not held out and a lang: for each lang the same number, with the lowest hashes; None without any.

    Langs are counted without reading texts; then about twice the wanted texts pass a hash threshold, so no lang is gathered whole.
    Only windows of the chosen texts reach the driver: at most ``sample`` texts (or 16 for each lang) and two windows of each.
    """
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~_held_out())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row a language
    if not counts:
        return None
    each = max(16, sample // len(counts))
    key = F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 30))
    share = F.broadcast(docs.sparkSession.createDataFrame([(lang, min(1 << 30, int((2 * each + 64) / n * (1 << 30)) + 1)) for lang, n in counts.items()], "lang string, below long"))
    some = rows.withColumn("key", key).join(share, "lang").where("key < below and text rlike '\\\\p{L}'")
    place = lambda k: (F.pmod(F.xxhash64(F.lit(k), "doc_id"), F.greatest(F.length("text") - STRIDE, F.lit(0)) + 1) + 1).cast("int")
    some = some.select("lang", "key", F.array(*[F.substring("text", place(k), F.lit(REACH)) for k in range(WINDOWS_OF_TEXT)]).alias("windows"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("key", "windows"))
    taken = some.withColumn("n", first).where(F.col("n") <= each).select("lang", "key", F.explode(F.array_distinct("windows")).alias("w")).collect()
    if not taken:
        return None
    languages = sorted({r["lang"] for r in taken})
    taken.sort(key=lambda r: (r["key"], r["lang"], r["w"]))
    windows = np.zeros((len(taken), REACH), np.uint8)
    for i, r in enumerate(taken):
        data = r["w"].encode("utf-8", "replace")[:REACH]
        windows[i, : len(data)] = np.frombuffer(data, np.uint8)
    return fit(windows, np.array([languages.index(r["lang"]) for r in taken]), languages)


def report(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; nothing but the text enters a prediction.

    A null text, or one without a letter, is ``und`` with score 0, as is everything if no row can be fitted on; texts are
    scored whole, in windows; repeated rows are judged alike; extra columns are ignored; an empty table gives no rows.
    No row is shuffled. A task holds the windows of one text, or of 1 MB of texts.
    """
    spark = docs.sparkSession
    ship(spark)
    network = network or train(docs)
    shared = spark.sparkContext.broadcast(network and Tables(network))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for b in pieces(batches):
            names, scores = [UNKNOWN] * len(b), [0.0] * len(b)
            some = pc.fill_null(b.column("letters"), False).to_pylist()
            at = [i for i, x in enumerate(some) if x and tables]
            if at:
                texts = pc.cast(b.column("text"), pa.binary()).take(pa.array(at, pa.int32())).to_pylist()
                for i, k, p in zip(at, *predict(texts, tables), strict=True):
                    names[i], scores[i] = tables.languages[k], float(p)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id"), _held_out().alias("held_out"), F.col("text").cast("string").alias("text")).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
