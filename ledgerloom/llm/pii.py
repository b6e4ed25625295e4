"""Personal data: pattern rules, and a character-level bidirectional LSTM with CRF transitions that adds spans."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship
from .pii_examples import Maker

KINDS = ("email", "ip", "card", "phone")
#: Length and step of the windows that are decoded; every position is read from the window it is most central in.
WINDOW, STEP = 128, 64
EDGE = (WINDOW - STEP) // 2
#: Most documents that windows to fit on are taken from, windows labelled by the rules, made examples; length of these; units of each direction.
SAMPLE_DOCS, SAMPLE_WINDOWS, EXAMPLES, TRAIN_WINDOW, HIDDEN = 2000, 768, 2304, 80, 16
LABELS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind

_ANCHOR = re.compile("[0-9@]")
_AT = re.compile(r"[(\[{<] ?[aA][tT] ?[)\]}>]")
_DOT = re.compile(r"[(\[{<] ?(?:[dD][oO][tT]|\.) ?[)\]}>]")
_ADDRESS = re.compile(r"[\w.%+-]+@[\w-]+(?:\.[\w-]+)+")
_FOUR = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does, which keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile("[0-9]")

Span = tuple[int, int]


def _emails(text: str) -> list[Span]:
    found, low, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        low = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            low = m.end()
        at = text.find("@", low)
    return found


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for c in digits[-2::-2])
    return total % 10 == 0


def _is_ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _is_card(s: str) -> bool:
    d = s.replace(" ", "").replace("-", "")
    return 16 <= len(d) <= 19 and luhn(d)


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each kind that pass its test; linear in the text, whatever it holds."""
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    if not _ANCHOR.search(text):
        return out
    out["email"] = _emails(text)
    out["ip"] = [m.span() for m in _IP.finditer(text) if _is_ip(m[0])]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and _is_card(m[0])]
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m[0])) <= 15]
    return out


def _class_table() -> np.ndarray:
    """Class of each ASCII character: by group, or its own; 0 pads windows, the last class is for all other characters."""
    own = " @.-+_%(),:;/=\""
    t = np.full(129, 3, np.uint8)
    t[[9, 10, 11, 12, 13]], t[48:58], t[97:123], t[65:91] = 4, 5, 6, 7
    for i, c in enumerate(own):
        t[ord(c)] = 8 + i
    t[128] = 8 + len(own)
    return t


_CLASS = _class_table()
CLASSES = int(_CLASS.max()) + 1


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASS[np.minimum(points, 128)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Tagger:
    """The network: class inputs, an LSTM in each direction, scores of labels, CRF transitions."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, 0.3, (CLASSES, 4 * n)).astype(np.float32)
            self.p[f"x{d}"][:, n : 2 * n] += 1  # remember at first
            self.p[f"u{d}"] = r.normal(0, 1 / np.sqrt(n), (n, 4 * n)).astype(np.float32)
            self.p[f"v{d}"] = r.normal(0, 1 / np.sqrt(n), (n, LABELS)).astype(np.float32)
        self.p |= {"bias": np.zeros(LABELS, np.float32), "move": np.zeros((LABELS, LABELS), np.float32), "first": np.zeros(LABELS, np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """Hidden states of one direction over windows x (T, B) of classes."""
        n, (steps, b) = HIDDEN, x.shape
        h, c = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
        out, saved = np.empty((steps, b, n), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = self.p[f"x{d}"][x[t]] + h @ self.p[f"u{d}"]
            g = np.tanh(z[:, 3 * n :])
            s = _sigmoid(z[:, : 3 * n])
            new = s[:, n : 2 * n] * c + s[:, :n] * g
            tc = np.tanh(new)
            if keep:
                saved.append((t, h, c, s, g, tc))
            c, h = new, s[:, 2 * n :] * tc
            out[t] = h
        return out, saved

    def scores(self, x: np.ndarray, keep: bool = False):
        hf, sf = self._run(x, "f", keep)
        hb, sb = self._run(x, "b", keep)
        e = hf @ self.p["vf"] + hb @ self.p["vb"] + self.p["bias"]
        return (e, hf, hb, sf, sb) if keep else e

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label path of each window: x and the result are (T, B)."""
        e, move = self.scores(x), self.p["move"]
        best, back = e[0] + self.p["first"], np.empty((len(x), x.shape[1], LABELS), np.int8)
        for t in range(1, len(x)):
            step = best[:, :, None] + move
            back[t] = step.argmax(1)
            best = step.max(1) + e[t]
        path = np.empty(x.shape, np.int8)
        path[-1] = best.argmax(1)
        for t in range(len(x) - 1, 0, -1):
            path[t - 1] = np.take_along_axis(back[t], path[t][:, None].astype(np.int64), 1)[:, 0]
        return path

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of label paths y (T, B), and its gradients."""
        e, hf, hb, sf, sb = self.scores(x, True)
        steps, b = x.shape
        move, g = self.p["move"], {k: np.zeros_like(v) for k, v in self.p.items()}
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0] + self.p["first"]
        for t in range(1, steps):
            alpha[t] = lse(alpha[t - 1][:, :, None] + move, 1) + e[t]
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(move + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        z = lse(alpha[-1], 1)
        rows = np.arange(b)
        gold = self.p["first"][y[0]] + sum(e[t, rows, y[t]] for t in range(steps)) + sum(move[y[t - 1], y[t]] for t in range(1, steps))
        de = np.exp(alpha + beta - z[:, None]) / b
        for t in range(1, steps):
            pair = np.exp(alpha[t - 1][:, :, None] + move + (e[t] + beta[t])[:, None, :] - z[:, None, None])
            g["move"] += pair.sum(0) / b
            np.add.at(g["move"], (y[t - 1], y[t]), np.float32(-1 / b))
        np.put_along_axis(de, y[:, :, None].astype(np.int64), np.take_along_axis(de, y[:, :, None].astype(np.int64), 2) - np.float32(1 / b), 2)
        g["first"], g["bias"] = de[0].sum(0), de.sum((0, 1))
        n, one = HIDDEN, np.eye(CLASSES, dtype=de.dtype)
        for d, h, saved in (("f", hf, sf), ("b", hb, sb)):
            g[f"v{d}"] = np.tensordot(h, de, ((0, 1), (0, 1)))
            from_out = de @ self.p[f"v{d}"].T
            dh, dc = np.zeros((b, n), np.float32), np.zeros((b, n), np.float32)
            for t, h0, c0, s, gate, tc in reversed(saved):
                dh = dh + from_out[t]
                dc = dc + dh * s[:, 2 * n :] * (1 - tc * tc)
                dz = np.concatenate([dc * gate, dc * c0, dh * tc], 1) * s * (1 - s)
                dz = np.concatenate([dz, dc * s[:, :n] * (1 - gate * gate)], 1)
                g[f"x{d}"] += one[x[t]].T @ dz
                g[f"u{d}"] += h0.T @ dz
                dh, dc = dz @ self.p[f"u{d}"].T, dc * s[:, n : 2 * n]
        return float((z - gold).mean()), g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 96) -> Tagger:
        """Adam on batches of windows x, labels y (both windows by positions)."""
        if not len(x):
            self.p["bias"][0] = 50  # nothing to learn from: no span anywhere
            return self
        r = np.random.default_rng(11)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        order, at = r.permutation(len(x)), 0
        for t in range(1, steps + 1):
            if at + batch > len(x):
                order, at = r.permutation(len(x)), 0
            pick = order[at : at + batch]
            at += batch
            _, g = self.gradients(np.ascontiguousarray(x[pick].T), np.ascontiguousarray(y[pick].T))
            norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
            for k, a in g.items():
                a *= min(1.0, 5.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * a, 0.99 * v[k] + 0.01 * a * a
                rate = 0.02 * (1 - 0.9 * t / steps)
                self.p[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)
        return self

    def spans(self, texts: list[str], block: int = 512, every: bool = False) -> list[list[tuple[str, int, int]]]:
        """Spans (kind, start, end) that the network finds in each whole text and that hold a mark.

        Windows overlap by half, and each position takes its label from the window whose middle
        it is in; a span goes on over the seam between two windows. Decoding starts at the windows
        of marks (digits, @ and written-out forms of it), without which no span is accepted, and goes
        on to the neighbour wherever a label reaches the seam, so the spans are those that decoding
        all windows (``every``) gives.
        """
        all_codes = [codes(t) for t in texts]
        labels = [np.zeros(len(c), np.int8) for c in all_codes]
        count = [max(1, -(-(len(c) - WINDOW) // STEP) + 1) for c in all_codes]
        done = [np.zeros(n, bool) for n in count]
        jobs = []
        for i, (t, c) in enumerate(zip(texts, all_codes, strict=True)):
            k = np.arange(count[i]) if every else np.unique(np.clip((marks(t, c) - EDGE) // STEP, 0, count[i] - 1))
            jobs += [(i, int(x)) for x in k]
        while jobs:
            more = set()
            for i, k in jobs:
                done[i][k] = True
            for j in range(0, len(jobs), block):
                part = jobs[j : j + block]
                x = np.zeros((WINDOW, len(part)), np.uint8)
                for n, (i, k) in enumerate(part):
                    c = all_codes[i][k * STEP : k * STEP + WINDOW]
                    x[: len(c), n] = c
                path = self.decode(x)
                for n, (i, k) in enumerate(part):
                    y = labels[i]
                    lo, hi = k * STEP + EDGE if k else 0, (k + 1) * STEP + EDGE if k < count[i] - 1 else len(y)
                    y[lo:hi] = path[lo - k * STEP : hi - k * STEP, n]
                    if k and y[lo : lo + 1].any() and y[lo] % 2 == 0 and not done[i][k - 1]:
                        more.add((i, k - 1))
                    if k < count[i] - 1 and y[hi - 1] and not done[i][k + 1]:
                        more.add((i, k + 1))
            jobs = sorted(more)
        return [_spans_of(y) for y in labels]


def marks(text: str, c: np.ndarray | None = None) -> np.ndarray:
    """Places of digits, of @, and of the written-out forms of it."""
    c = codes(text) if c is None else c
    plain = np.flatnonzero((c == _CLASS[48]) | (c == _CLASS[64]))
    said = [m.start() for m in _AT.finditer(text)]
    return np.concatenate([plain, np.array(said, np.int64)]) if said else plain


def _spans_of(y: np.ndarray) -> list[tuple[str, int, int]]:
    if not y.any():
        return []
    kind = (y.astype(np.int64) + 1) // 2  # 0 outside, then a number for each kind
    new = np.concatenate([[True], (kind[1:] != kind[:-1]) | ((y[1:] % 2 == 1) & (y[1:] > 0))])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(y))
    return [(KINDS[kind[s] - 1], int(s), int(e)) for s, e in zip(starts, ends, strict=True) if kind[s]]


def label_path(length: int, spans: dict[str, list[Span]]) -> np.ndarray:
    y = np.zeros(length, np.int8)
    for k, name in enumerate(KINDS):
        for s, e in spans[name]:
            y[s:e], y[s] = 2 + 2 * k, 1 + 2 * k
    return y


def accepted(text: str, kind: str, start: int, end: int) -> tuple[str, int, int] | None:
    """The span without outer blanks and stops, if it can be of its kind once written-out signs and blanks are taken back; else None."""
    while start < end and text[start] in " \t\r\n.,;:)":
        start += 1
    while end > start and text[end - 1] in " \t\r\n.,;:(-":
        end -= 1
    s = text[start:end]
    digits = "".join(_DIGITS.findall(s))
    plain = _DOT.sub(".", _AT.sub("@", s)).replace(" ", "")
    if kind == "email":
        fine = _ADDRESS.fullmatch(plain) is not None
    elif kind == "ip":
        fine = _FOUR.fullmatch(plain) is not None and _is_ip(plain)
    elif kind == "card":
        fine = 15 <= len(digits) <= 19 and luhn(digits)
    else:
        fine = 8 <= len(digits) <= 15 and (s[0] == "+" or len(set(s) & set(" ().-/\u00a0")) > 0) and s[-1] in "0123456789"
    return (kind, start, end) if fine and "\n" not in s else None


def find(texts: list[str], model: Tagger) -> list[tuple[dict[str, list[Span]], list[tuple[str, int, int]]]]:
    """For each text the base spans, and all spans in order of kind and start; the model's count where no base span is."""
    out = []
    base = [base_spans(t) for t in texts]
    some = [i for i, t in enumerate(texts) if _ANCHOR.search(t) or _AT.search(t)]
    added = dict(zip(some, model.spans([texts[i] for i in some]), strict=True))
    for i, t in enumerate(texts):
        spans = [(k, s, e) for k in KINDS for s, e in base[i][k]]
        taken = Taken((s, e) for _, s, e in spans)
        extra = []
        for kind, s, e in added.get(i, ()):
            if (a := accepted(t, kind, s, e)) and not taken.meets(a[1], a[2]):
                extra.append(a)
        out.append((base[i], sorted(spans + extra, key=lambda x: (KINDS.index(x[0]), x[1]))))
    return out


class Taken:
    """Some spans, which may overlap, ready to be asked whether a place meets any of them."""

    def __init__(self, spans: Iterable[Span]):
        self.spans = sorted(spans)
        self.reach = list(accumulate((e for _, e in self.spans), max))

    def meets(self, start: int, end: int) -> bool:
        k = bisect_left(self.spans, (end, -1))  # those that begin before the end
        return k > 0 and self.reach[k - 1] > start


def examples(plain: list[str], n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels of ``n`` made examples, set into stretches of clean text."""
    maker = Maker(seed)
    x, y = np.zeros((n, TRAIN_WINDOW), np.uint8), np.zeros((n, TRAIN_WINDOW), np.int8)
    for i in range(n):
        text, spans = maker.example(plain[i % len(plain)], TRAIN_WINDOW)
        x[i, : len(text)] = codes(text)
        y[i, : len(text)] = label_path(len(text), {k: [(s, e) for kind, s, e in spans if kind == k] for k in KINDS})
    return x, y


def train(docs: DataFrame) -> Tagger:
    """A tagger fitted on made examples with known spans, and on windows that the rules label.

    The sample: of the documents, those whose ids have the lowest hashes, so many that some
    ``SAMPLE_DOCS`` with a digit or an @ may be among them; at most 8 windows around base spans and
    other digits of each, of these ``SAMPLE_WINDOWS``; and stretches without either, into which
    ``EXAMPLES`` made ones are set. One scan; what reaches the driver is bounded by these numbers.
    """
    spark = docs.sparkSession
    ship(spark)
    n = docs.count()
    if not n:
        return Tagger().fit(np.zeros((0, TRAIN_WINDOW), np.uint8), np.zeros((0, TRAIN_WINDOW), np.int8))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    least = F.lit(int(-(1 << 63) + min(1.0, 8 * SAMPLE_DOCS / n) * ((1 << 64) - 1)) if n > 8 * SAMPLE_DOCS else (1 << 63) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = {"h": [], "x": [], "y": [], "plain": []}
            for h, t in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                c, spans = codes(t), base_spans(t)
                y = label_path(len(c), spans)
                places = [s for k in KINDS for s, _ in spans[k][:2]][:8]
                places += [m.start() for _, m in zip(range(2), _DIGITS.finditer(t), strict=False) if not y[m.start()]][: 8 - len(places)]
                rows = []
                for i, s in enumerate(places):
                    s = max(0, s - 7 - (s * 31 + i * 17) % 40)
                    x, z = np.zeros(TRAIN_WINDOW, np.uint8), np.zeros(TRAIN_WINDOW, np.int8)
                    part = slice(s, s + TRAIN_WINDOW)
                    x[: len(c[part])], z[: len(c[part])] = c[part], y[part]
                    rows.append((x.tobytes(), z.tobytes(), None))
                clean = max(re.split("[0-9@]", t), key=len)
                if len(clean) > 40:
                    rows.append((None, None, clean[len(clean) // 3 :][:TRAIN_WINDOW]))
                for r in rows:
                    for k, v in zip(out, (h, *r), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["h"], pa.int64()), pa.array(out["x"], pa.binary()), pa.array(out["y"], pa.binary()), pa.array(out["plain"], pa.string())], list(out))

    some = docs.select(h.alias("h"), "text").where((F.col("h") <= least) & F.col("text").isNotNull())
    marked = some.where(F.col("text").rlike("[0-9@]")).mapInArrow(run, "h long, x binary, y binary, plain string")
    rows = marked.orderBy("h", "x", "plain").limit(9 * SAMPLE_DOCS).collect()
    own = sorted({(bytes(r["x"]), bytes(r["y"])) for r in rows if r["x"] is not None}, key=lambda r: hashlib.md5(r[0]).digest())[:SAMPLE_WINDOWS]
    grid = lambda k, t: np.frombuffer(b"".join(r[k] for r in own), t).reshape(-1, TRAIN_WINDOW)
    plain = sorted({r["plain"] for r in rows if r["plain"]}) or ["and so it goes on for a while with nothing of note in it at all"]
    x, y = examples(plain, EXAMPLES, 5)
    return Tagger().fit(np.concatenate([grid(0, np.uint8), x]), np.concatenate([grid(1, np.int8), y]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def report(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """(doc_id, counts of base spans, base_sha256, spans) for every row of ``docs``.

    Offsets are code points. A null text counts as empty; repeated rows are treated alike;
    other columns are ignored; an empty table gives no rows. Memory: one Arrow batch and ``block`` windows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            found = find([t or "" for t in b.column("text").to_pylist()], shared.value)
            cols = {"doc_id": b.column("doc_id")} | {f"n_{k}": pa.array([len(f[k]) for f, _ in found], pa.int64()) for k in KINDS}
            base = [_joined([(k, s, e) for k in KINDS for s, e in f[k]]) for f, _ in found]
            cols["base_sha256"] = pa.array([hashlib.sha256(x.encode()).hexdigest() for x in base], pa.string())
            cols["spans"] = pa.array([_joined(s) for _, s in found], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span (overlapping ones as one, named by the first) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """The documents with their spans replaced, n_chars (if there is one) counted anew; null texts stay null.

    Repeated rows are treated alike, any other columns carried along; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or train(docs))
    ship(docs.sparkSession)
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts = b.column("text").to_pylist()
            found = find([t or "" for t in texts], shared.value)
            new = [None if t is None else redact(t, s) if s else t for t, (_, s) in zip(texts, found, strict=True)]
            cols = list(b.columns)
            cols[names.index("text")] = pa.array(new, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                old = b.column(k).to_pylist()
                cols[k] = pa.array([o if n is None or n is t or n == t else len(n) for o, n, t in zip(old, new, texts, strict=True)], b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, schema)
