"""Token counts by a deterministic transducer that is compiled from a tokenizer's pieces and their merge order."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ship

SPACE = "▁"
#: Bytes from which a text is cut into chunks (which have so many characters), and how many chunk maps one step composes.
CHUNK, FAN = 1 << 17, 64
#: Most bytes of a Spark string.
LONGEST_TEXT = 1 << 31
#: Most transitions and words that one Python worker keeps; beyond it both are compiled anew.
MOST_EDGES, MOST_WORDS, LONGEST_WORD = 500_000, 250_000, 48


class Merges:
    """Pieces that two neighbours may become, with their scores: the best score merges first, of equal ones the leftmost."""

    def __init__(self, score: dict[str, float]):
        self.score = score

    @classmethod
    def of_model(cls, model_path: str) -> Merges:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        if any(SPACE in p.lstrip(SPACE) for p in score):
            raise ValueError("this model has pieces that go on over a space")
        return cls(score)

    def apply(self, text: str) -> list[str]:
        """The pieces of a short text, by definition: merge after merge."""
        parts, get = list(text), self.score.get
        pair = [get(a + b) for a, b in zip(parts, parts[1:], strict=False)]  # score of merging each part with the next
        while True:
            at, best = -1, None
            for i, s in enumerate(pair):
                if s is not None and (best is None or s > best):
                    at, best = i, s
            if at < 0:
                return parts
            parts[at] += parts.pop(at + 1)
            del pair[at]
            if at < len(pair):
                pair[at] = get(parts[at] + parts[at + 1])
            if at:
                pair[at - 1] = get(parts[at - 1] + parts[at])


class Automaton(NamedTuple):
    """All pieces in one trie with failure links: after any text its node is the longest suffix that begins a piece."""

    go: list[dict[str, int]]
    fail: list[int]
    live: list[tuple[int, ...]]  # lengths of all suffixes that begin a piece, the longest first, 0 last
    ends: list[tuple[str, ...]]  # pieces that end here, the longest first
    score: dict[str, float]

    @classmethod
    def of(cls, merges: Merges) -> Automaton:
        go, depth, own = [{}], [0], [None]
        for piece in sorted(merges.score):
            if len(piece) > 1 and merges.apply(piece) != [piece]:
                continue  # no text has it as a token
            at = 0
            for c in piece:
                if c not in go[at]:
                    go[at][c] = len(go)
                    go.append({})
                    depth.append(depth[at] + 1)
                    own.append(None)
                at = go[at][c]
            own[at] = piece
        fail, ends, live, order = [0] * len(go), [()] * len(go), [(0,)] * len(go), [0]
        for at in order:
            for c, to in go[at].items():
                f = fail[at]
                while at and f and c not in go[f]:
                    f = fail[f]
                fail[to] = go[f].get(c, 0) if at else 0
                ends[to] = ((own[to],) if own[to] else ()) + ends[fail[to]]
                live[to] = (depth[to], *live[fail[to]])
                order.append(to)
        return cls(go, fail, live, ends, merges.score)

    def next(self, node: int, c: str) -> int:
        while node and c not in self.go[node]:
            node = self.fail[node]
        return self.go[node].get(c, 0)


class State(dict):
    """A state of the transducer, and its transitions as they are compiled: character to (state, tokens emitted).

    ``past`` holds, for each place from which on the text begins a piece (``live`` of the automaton's node),
    the token that the text up to there ends with and how many more tokens it has than the text so far.
    That is all that the future depends on, since a later token can only begin at such a place.
    """

    __slots__ = ("machine", "node", "past")

    def __missing__(self, c: str) -> tuple[State, int]:
        return self.machine.compile(self, c)


class Transducer:
    """Reads characters, emits numbers of tokens.

    The last token of a text is the one piece at its end that stands after the last token of what
    is before it: two tokens may stand together if merging both of their characters gives these
    two again. So the number of tokens after each character follows from that after a few before,
    a transition emits the difference, which may be none or negative, and the sums are the counts of
    the whole merging procedure. No piece has a space after another character, so a space after one
    leads to the same state from everywhere. Characters without a piece count as their bytes.
    Transitions are compiled when they are first taken, and kept up to a bound.
    """

    def __init__(self, automaton: Automaton):
        self.auto, self.merges = automaton, Merges(automaton.score)
        self.together: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        """Forget all transitions; ``reading`` keeps the collector from walking over them again and again."""
        self.states = {}
        gc.collect()
        self.states: dict[tuple, State] = {}
        self.edges = 0
        self.start = self.state(0, ((None, 0),))
        outer = self

        class Words(dict):
            """Tokens of a space and a word: transitions of the transducer, composed. When full it begins anew, but for what is asked again."""

            old: dict[str, int] = {}

            def __missing__(self, word: str) -> int:
                n = self.old.get(word)
                if n is None:
                    n = outer.run(outer.start, SPACE + word)[1]
                if len(word) <= LONGEST_WORD:
                    if len(self) >= MOST_WORDS:
                        self.old = dict(self)
                        self.clear()
                    self[word] = n
                return n

        self.words = Words()

    def state(self, node: int, past: tuple) -> State:
        key = node, past
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State()
            found.machine, found.node, found.past = self, node, past
        return found

    def fit_together(self, a: str | None, b: str) -> bool:
        """Whether tokens a and b may stand next to each other; anything may begin a text."""
        if a is None:
            return True
        known = self.together.get((a, b))
        if known is None:
            if len(self.together) >= MOST_EDGES:
                self.together.clear()
            known = self.together[a, b] = self.merges.apply(a + b) == [a, b]
        return known

    def compile(self, state: State, c: str) -> tuple[State, int]:
        last = state.past[-1][0]
        if c == SPACE and last is not None and last[-1] != SPACE:
            edge = self.start[c]
        else:
            node = self.auto.next(state.node, c)
            past = dict(zip(self.auto.live[state.node], state.past, strict=True))  # by how many characters before
            for token in self.auto.ends[node]:
                before, more = past[len(token) - 1]
                if self.fit_together(before, token):
                    n = more + 1
                    break
            else:  # no piece has this character
                token, n = c, len(c.encode("utf-8", "surrogatepass"))
            kept = [past[k - 1] for k in self.auto.live[node][:-1]]
            edge = self.state(node, (*((t, k - n) for t, k in kept), (token, 0))), n
        self.edges += 1
        state[c] = edge
        return edge

    def run(self, state: State, text: str) -> tuple[State, int]:
        """The state after ``text``, and the tokens that it emits."""
        n = 0
        for c in text:
            state, k = state[c]
            n += k
        return state, n

    def count(self, text: str) -> int:
        """Tokens of a whole text. The tokenizer puts one space before a text, not before none."""
        if not text:
            return 0
        if self.edges > MOST_EDGES:
            self.clear()
        if SPACE not in text and "  " not in text and text[0] != " " != text[-1]:
            return sum(map(self.words.__getitem__, text.split(" ")))
        return self.run(self.start, SPACE + text.replace(" ", SPACE))[1]

    # -- chunks ---------------------------------------------------------------------------------------------------

    def chunk(self, text: str, first: bool) -> StateMap:
        """The state map of a piece of a text, cut anywhere."""
        if self.edges > MOST_EDGES:
            self.clear()
        text = text.replace(" ", SPACE)
        if first:
            return self._open("", 0, SPACE + text)
        at = next((i for i in range(1, len(text)) if text[i] == SPACE != text[i - 1]), None)
        return StateMap(text, 0, None) if at is None else self._open(text[:at], 0, text[at:])

    def _open(self, head: str, count: int, text: str, state: State | None = None) -> StateMap:
        state, n = self.run(self.start if state is None else state, text)
        return StateMap(head, count + n, (state.node, state.past))

    def compose(self, a: StateMap, b: StateMap) -> StateMap:
        """The state map of two pieces in a row; associative, so pieces may be combined in any grouping."""
        if a.exit is not None:
            both = self._open(a.head, a.count, b.head, self.state(*a.exit))
        elif a.head[-1:] not in ("", SPACE) and b.head[:1] == SPACE:
            both = self._open(a.head, a.count, b.head)
        else:
            both = StateMap(a.head + b.head, 0, None)
        return both if b.exit is None else StateMap(both.head, both.count + b.count, b.exit)


class StateMap(NamedTuple):
    """What a piece of text does to the transducer, whatever state it enters in.

    ``head``, up to the first space that leads to one state from everywhere, depends on the state at
    entry; what is after it emits ``count`` tokens and ends in state ``exit`` (node, past). Without
    such a space all is head and ``exit`` is None.
    """

    head: str
    count: int
    exit: tuple[int, tuple] | None


def reading(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches; until the last is done Python does not look for cycles, as all that is kept stays in use."""
    gc.disable()
    try:
        yield from pieces(batches)
    finally:
        gc.enable()


_machines: dict[str, Transducer] = {}


def transducer(model_path: str, automaton: Automaton | None = None) -> Transducer:
    """One per Python worker and model."""
    if model_path not in _machines:
        _machines[model_path] = Transducer(automaton or Automaton.of(Merges.of_model(model_path)))
    return _machines[model_path]


def _written(maps: Iterable[tuple[str, int, StateMap]]) -> pd.DataFrame:
    rows = [(key, pos, m.head, m.count, None if m.exit is None else m.exit[0], None if m.exit is None else [t for t, _ in m.exit[1]], None if m.exit is None else [n for _, n in m.exit[1]]) for key, pos, m in maps]
    return pd.DataFrame(rows, columns=["key", "pos", "head", "count", "node", "tokens", "more"]).astype({"pos": "int64", "count": "int64", "node": "Int64"})


_MAP = "key string, pos long, head string, count long, node long, tokens array<string>, more array<long>"


def _rounds(chunk: int, fan: int) -> int:
    """Rounds of composing ``fan`` maps into one, until the longest text that there can be is one map."""
    n, rounds = -(-LONGEST_TEXT // chunk), 1
    while fan**rounds < n:
        rounds += 1
    return rounds


def _counts_of_long(long: DataFrame, shared, model_path: str, chunk: int) -> DataFrame:
    """(key, total) of each distinct text of ``long`` (key, doc_id, text): chunks are dealt over the tasks, their maps composed in rounds."""
    n, fan = F.ceil(F.length("text") / chunk).cast("int"), FAN
    cut = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("text"), i * chunk + 1, F.lit(chunk)))
    parts = long.select("key", "doc_id", F.posexplode(cut).alias("pos", "piece")).repartition("key", "doc_id", "pos")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path, shared.value)
        for b in reading(batches):
            done = [(k, p, machine.chunk(t, p == 0)) for k, p, t in zip(b.column("key").to_pylist(), b.column("pos").to_pylist(), b.column("piece").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pandas(_written(done), schema=_ARROW, preserve_index=False)

    def compose(frame: pd.DataFrame) -> pd.DataFrame:
        machine, all_ = transducer(model_path, shared.value), None
        for r in frame.sort_values("pos").itertuples():
            m = StateMap(r.head, r.count, None if r.tokens is None else (int(r.node), tuple(zip(r.tokens, map(int, r.more), strict=True))))
            all_ = m if all_ is None else machine.compose(all_, m)
        return _written([(frame["key"].iloc[0], frame["pos"].iloc[0] // fan, all_)])

    same = lambda d: d.groupBy("key", "pos").agg(F.first(F.struct("head", "count", "node", "tokens", "more")).alias("m")).select("key", "pos", "m.*")
    maps = same(parts.select("key", F.col("pos").cast("long").alias("pos"), "piece").mapInArrow(read, _MAP))
    for _ in range(_rounds(chunk, fan)):
        maps = maps.groupBy("key", F.floor(F.col("pos") / fan).alias("_up")).applyInPandas(compose, _MAP)
    return maps.select("key", F.col("count").alias("total"))


_ARROW = pa.schema([("key", pa.string()), ("pos", pa.int64()), ("head", pa.string()), ("count", pa.int64()), ("node", pa.int64()), ("tokens", pa.list_(pa.string())), ("more", pa.list_(pa.int64()))])


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs``.

    Texts of more than ``chunk`` bytes are cut into chunks that different tasks read, and the chunks'
    state maps are composed; the others are read whole. A null text counts as empty (0 tokens).
    Repeated rows are counted alike, other columns ignored, an empty table gives no rows.
    Memory: one slice of an Arrow batch and the bounded transitions; for a long text without spaces, that text.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(Automaton.of(Merges.of_model(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(model_path, shared.value)
        for b in reading(batches):
            n = [machine.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = rows.where(F.col("n_bytes") <= chunk).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    long = rows.where(F.col("n_bytes") > chunk).withColumn("key", F.sha2("text", 256))
    totals = _counts_of_long(long, shared, model_path, chunk).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    named = long.select("doc_id", "n_bytes", "key", F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int").alias("salt"))
    joined = named.join(totals, ["key", "salt"]).select("doc_id", "n_bytes", F.col("total").alias("n_tokens"))
    return short.unionByName(joined).withColumn("over_limit", F.col("n_tokens") > limit)
