"""Chat formatting of reply trees: each root-to-leaf path, or the best of each tree, becomes one conversation."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import pieces, ship, stage, unstage

#: Fixed control strings of the template.
START, END = "<|im_start|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*)\n((?:[^<]|<(?!\|))*)<\|im_end\|>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """No ``<|`` is left, so no control string can appear; ``unescape`` undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the loss mask: code-point spans of the assistant's (escaped) texts."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n", escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def _one_each(nodes: DataFrame) -> DataFrame:
    """One row for each (tree, node): of repeated ones that with the least parent (none last), score, and what else there is."""
    more = [c for c in nodes.columns if c not in ("tree", "node", "parent", "score")]
    least = F.min(F.struct(F.col("parent").isNull().alias("_none"), "parent", "score", *more))
    return nodes.groupBy("tree", "node").agg(least.alias("r")).select("tree", "node", "r.parent", "r.score", *[f"r.{c}" for c in more])


def _cycle_cuts(stuck: DataFrame, rounds: int) -> DataFrame:
    """(tree, node): the least node of each cycle among ``stuck`` (tree, node, parent), all of which lead into one."""
    walk = stage(stuck.select("tree", "node", F.col("parent").alias("up"), F.least("node", "parent").alias("low")), "cycle")
    for _ in range(rounds):
        far = walk.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("low").alias("low2"))
        new = stage(walk.join(far, ["tree", "up"]).select("tree", "node", F.col("up2").alias("up"), F.least("low", "low2").alias("low")), "cycle")
        unstage(walk)
        walk = new
    on = walk.select("tree", F.col("up").alias("node")).distinct()  # who walks that far ends on the cycle, at every node of it
    cuts = stage(walk.where("low = node").join(on, ["tree", "node"], "left_semi").select("tree", "node"), "cuts")
    unstage(walk)
    return cuts


def ranked_paths(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """The nodes of root-to-leaf paths: ``nodes`` (tree, node, parent, score) gives (tree, root, leaf, rank, node, depth), root depth 0.

    Pointer doubling: self-join i extends every node's jump from 2^i to 2^(i+1) ancestors and
    sums scores on the way, so a tree of depth d takes log2(d) joins. The leaves of each root are
    ranked from 1 by path score (ties: the deepest, then the smallest node); the paths of the
    first ``most`` are given, all if None.
    The jumps, replayed in reverse from each leaf, mark its ancestors. Every join is on
    (tree, node), so one large tree is dealt over all partitions; only the ranking sorts the
    leaves of one root (without texts) in one task.

    A parent that is null or absent makes a root. Of rows that repeat a node one is taken (see
    ``_one_each``). The least node of a cycle of replies becomes its root. A null score counts as 0.
    Rows without a tree or a node are left out; an empty table gives no rows; other columns are ignored.
    """
    up = nodes.where("tree is not null and node is not null").select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"))
    up = stage(_one_each(up), "tree")
    largest = up.groupBy("tree").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    rounds = int(largest).bit_length()  # so many joins reach over all nodes of a tree
    real = up.select("tree", F.col("node").alias("parent"), F.lit(True).alias("real"))
    base = up.join(real, ["tree", "parent"], "left").select("tree", "node", F.when(F.col("real"), F.col("parent")).alias("up"), F.col("score").alias("sum"), F.lit(1).cast("long").alias("len"))
    base = stage(base.withColumn("root", F.when(F.col("up").isNull(), F.col("node"))), "tree")  # known once up is null
    jumps = [base]
    while open_ := jumps[-1].where("up is not null").limit(1).count():
        if len(jumps) > rounds:
            break
        low = jumps[-1]
        on = low.where("up is not null").drop("root").withColumnsRenamed({"node": "at", "sum": "sum1", "len": "len1"})  # the others have reached their root
        far = on.join(low.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), "sum", "len", "root"), ["tree", "up"])
        far = far.select("tree", F.col("at").alias("node"), F.col("up2").alias("up"), (F.col("sum1") + F.col("sum")).alias("sum"), (F.col("len1") + F.col("len")).alias("len"), "root")
        jumps.append(stage(far.unionByName(low.where("up is null")), "tree"))
    if open_:
        stuck = base.join(jumps[-1].where("up is not null").select("tree", "node"), ["tree", "node"], "left_semi").select("tree", "node", F.col("up").alias("parent"))
        cuts = _cycle_cuts(stuck, rounds).withColumn("cut", F.lit(True))
        whole = up.join(cuts, ["tree", "node"], "left").select("tree", "node", F.when(F.col("cut").isNull(), F.col("parent")).alias("parent"), "score")
        unstage(*jumps)
        return ranked_paths(whole, most)
    whole = jumps[-1]
    inner = base.where("up is not null").select("tree", F.col("up").alias("node")).distinct()
    order = W.partitionBy("tree", "root").orderBy(F.col("sum").desc(), F.col("len").desc(), "node")
    leaves = whole.join(inner, ["tree", "node"], "left_anti").withColumn("rank", F.row_number().over(order).cast("long"))
    leaves = leaves if most is None else leaves.where(F.col("rank") <= most)
    path = stage(leaves.select("tree", "root", F.col("node").alias("leaf"), "rank", "node"), "path")
    for jump in reversed(jumps[:-1]):
        more = path.join(jump.where("up is not null").select("tree", "node", "up"), ["tree", "node"]).select("tree", "root", "leaf", "rank", F.col("up").alias("node"))
        new = stage(path.unionByName(more), "path")
        unstage(path)
        path = new
    unstage(up, *jumps[1:-1])
    return path.join(whole.select("tree", "node", "len"), ["tree", "node"]).select("tree", "root", "leaf", "rank", "node", (F.col("len") - 1).alias("depth"))


def chosen_paths(nodes: DataFrame) -> DataFrame:
    """The nodes of the best path of each root, as (tree, node, depth); all cases as in ``ranked_paths``."""
    return ranked_paths(nodes, 1).select("tree", "node", "depth")


def linear_trees(conversations: DataFrame) -> DataFrame:
    """Plain conversations as reply trees without branches: (tree, node, parent, score, conv_id, role, text).

    Rows answer the row before them by turn (null last), ties by role and text. Null roles and texts
    count as empty, repeated rows are turns of their own, rows without a conv_id are one conversation;
    other columns are ignored; an empty table gives no rows.
    """
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    node = F.row_number().over(order).cast("long")
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    return rows.select("conv_id", tree.alias("tree"), node.alias("node"), F.when(node > 1, node - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def format_trees(nodes: DataFrame, most: int | None = None) -> DataFrame:
    """(conv_id, formatted, loss, root, leaf, rank): one row per path of ``nodes`` (tree, node, parent, score, conv_id, role, text).

    ``loss`` lists the spans (start, end in code points) that a trainer should learn from.
    Of each root the ``most`` best paths are taken, all if None; null roles and texts count as
    empty, all other cases are as in ``ranked_paths``. A formatted path is one row and must fit into one.
    """
    ship(nodes.sparkSession)
    nodes = stage(nodes.select("tree", "node", "parent", "score", "conv_id", "role", "text"), "nodes")
    if nodes.groupBy("tree", "node").count().where("count > 1").limit(1).count():
        nodes = _one_each(nodes)
    path = ranked_paths(nodes.select("tree", "node", "parent", "score"), most)
    turns = nodes.join(path, ["tree", "node"]).groupBy("tree", "leaf").agg(
        F.first("conv_id").alias("conv_id"),
        F.first("root").cast("long").alias("root"),
        F.first("rank").alias("rank"),
        F.transform(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            done = [render([(t["role"] or "", t["text"] or "") for t in ts]) for ts in b.column("turns").to_pylist()]
            loss = pa.array([[{"start": s, "end": e} for s, e in m] for _, m in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([f for f, _ in done], pa.string()), loss, *b.columns[2:]], ["conv_id", "formatted", "loss", "root", "leaf", "rank"])

    return turns.select("conv_id", "turns", "root", F.col("leaf").cast("long"), "rank").mapInArrow(run, "conv_id long, formatted string, loss array<struct<start: long, end: long>>, root long, leaf long, rank long")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from ``format_trees``, for each of its rows: turn and loss digests.

    Null roles and texts were formatted as empty and are read back so; repeated rows of a conversation are turns of their own; an
    empty table gives no rows; a formatted conversation is read whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            texts, masks = b.column("formatted").to_pylist(), b.column("loss").to_pylist()
            turns = [parse(t) for t in texts]
            learnt = ["".join(unescape(t[s["start"] : s["end"]]) for s in m) for t, m in zip(texts, masks, strict=True)]
            sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
            cols = [b.column("conv_id"), pa.array([len(t) for t in turns], pa.int64()), pa.array([sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns])]
            cols += [pa.array([len(x) for x in learnt], pa.int64()), pa.array([sha(x) for x in learnt]), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
