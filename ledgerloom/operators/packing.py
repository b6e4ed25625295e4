"""Exact contiguous packing: the parts that filling one after the other in order would give, without a pass over all rows in order.

Each row's *next* pointer names the row that begins the next part if this row begins one; parts begin along these
pointers. A run of rows is summed up as a map from the bytes in the part that is open when the run is entered to those when it is left,
and the parts begun in between. Such maps compose, so runs are summed up by tasks of their own, maps are composed in a
tree, and what each run is entered with comes back down the tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shipping import ship
from ..sources import shared
from .lossless import EXTERNAL_BYTES, PART_BYTES, numbered

#: Rows of a run, and maps that one step of the tree composes.
RUN, FAN = 1 << 18, 64
#: Rows that look up their part among the same few that begin between them.
BLOCK = 128
#: Bytes that a row keeps of what was moved out of it.
POINTER_BYTES = 128
_MAP = "run bigint, upto array<bigint>, left array<bigint>, begun array<bigint>, rest bigint"


class RunMap:
    """Entered with b bytes in the open part: for b > upto[i-1] and b <= upto[i] the run is left with left[i] and has begun begun[i] parts.

    Up to upto[0] nothing begins, and the run is left with b + rest; its left is not used.
    """

    def __init__(self, upto: np.ndarray, left: np.ndarray, begun: np.ndarray, rest: int):
        self.upto, self.left, self.begun, self.rest = upto, left, begun, rest

    @classmethod
    def of(cls, sizes: np.ndarray, most: int) -> RunMap:
        total = np.concatenate([[0], np.cumsum(sizes)])
        at, count = jumps(total, most)
        n = len(sizes)
        # entered with b, the first part begins at row c if most - total[c + 1] < b <= most - total[c]
        c = np.arange(min(n, int(np.searchsorted(total, most, "right"))))[::-1]
        upto = np.concatenate([[most - total[n]], most - total[c]])
        left, begun = np.concatenate([[0], total[n] - total[at[c]]]), np.concatenate([[0], count[c]])
        return cls(upto, left, begun, int(total[n])).merged()

    def merged(self) -> RunMap:
        """Neighbouring pieces with one outcome are one piece."""
        last = np.append((self.left[2:] != self.left[1:-1]) | (self.begun[2:] != self.begun[1:-1]), True) if len(self.upto) > 1 else np.zeros(0, bool)
        keep = np.concatenate([[True], last])
        return RunMap(self.upto[keep], self.left[keep], self.begun[keep], self.rest)

    def through(self, open_: np.ndarray, begun: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.upto, open_, "left")
        return np.where(i == 0, open_ + self.rest, self.left[np.minimum(i, len(self.left) - 1)]), begun + self.begun[np.minimum(i, len(self.begun) - 1)]

    def then(self, after: RunMap) -> RunMap:
        """This run and the one after it as one."""
        shift = after.upto - self.rest  # of the second map, where nothing begins in this one
        i = np.arange(min(int(np.searchsorted(shift, self.upto[0], "left")) + 1, len(shift)))
        upto = np.append(shift[i[:-1]], self.upto[0])
        more, count = after.through(self.left[1:], self.begun[1:])
        return RunMap(np.concatenate([upto, self.upto[1:]]), np.concatenate([after.left[i], more]), np.concatenate([after.begun[i], count]), self.rest + after.rest).merged()


def jumps(total: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a run, if a part begins there: where the last part of the run begins, and how many begin, this one included. By doubling."""
    n = len(total) - 1
    to = np.maximum(np.searchsorted(total, total[:-1] + most, "right") - 1, np.arange(n) + 1)  # a row over the budget is alone
    to = np.append(to, n)
    at, count, step, steps = np.arange(n + 1), np.ones(n + 1, np.int64), to, np.ones(n + 1, np.int64)
    levels = []
    while (step[:n] < n).any():
        levels.append((step, steps))
        step, steps = step[step], steps + steps[step]
    levels.append((step, steps))
    for step, steps in reversed(levels):  # the longest way that stays inside the run
        go = step[at] < n
        count[go] += steps[at[go]]
        at = np.where(go, step[at], at)
    return at[:n], count[:n]


def _maps(frames: Iterator[tuple[int, RunMap]]) -> pd.DataFrame:
    rows = [(run, m.upto, m.left, m.begun, m.rest) for run, m in frames]
    return pd.DataFrame(rows, columns=["run", "upto", "left", "begun", "rest"])


def _read(r) -> RunMap:
    return RunMap(np.asarray(r.upto), np.asarray(r.left), np.asarray(r.begun), int(r.rest))


def pack(rows: DataFrame, order: str, size: Column, most: int = PART_BYTES, external: int = EXTERNAL_BYTES, run: int = RUN, fan: int = FAN) -> DataFrame:
    """``rows`` with part (from 0, no gaps) and external: filled in ``order`` (nulls first, unique), a part begins where a row would not fit.

    A row of more than ``external`` bytes is moved out: it counts POINTER_BYTES in its part. Null sizes count as 0. A row that is
    longer than ``most`` even so is alone in its part. Tasks hold the sizes of ``run`` rows; a map has at most as many pieces as rows fit into one part.
    """
    spark = rows.sparkSession
    ship(spark)
    taken = {c.lower() for c in rows.columns}
    at, own, block, few = (next(n for n in (c + "_" * k for k in range(99)) if n not in taken) for c in ("_ordinal", "_bytes", "_run", "_few"))
    b = F.coalesce(size.cast("long"), F.lit(0))
    placed = numbered(rows.withColumn(own, b), order, at).withColumns({"external": F.col(own) > external, own: F.when(F.col(own) > external, F.lit(POINTER_BYTES)).otherwise(F.col(own))})
    placed = placed.withColumn(block, F.floor(F.col(at) / run).cast("long"))
    path = shared.scratch(spark, "sizes")
    sizes = shared.written(placed.select(F.col(block).alias("run"), F.col(at).cast("long").alias("ordinal"), F.col(own).alias("bytes")), path)
    n = sizes.agg(F.coalesce(F.max("run"), F.lit(-1))).first()[0] + 1

    def summed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        return _maps([(int(frame["run"].iloc[0]), RunMap.of(frame["bytes"].to_numpy(), most))])

    def composed(frame: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for r in frame.sort_values("run").itertuples():
            whole = _read(r) if whole is None else whole.then(_read(r))
        return _maps([(int(frame["run"].iloc[0]) // fan, whole)])

    levels = [shared.written(sizes.groupBy("run").applyInPandas(summed, _MAP), shared.scratch(spark, "maps"))]
    while n > fan:
        n = -(-n // fan)
        levels.append(shared.written(levels[-1].groupBy(F.floor(F.col("run") / fan)).applyInPandas(composed, _MAP), shared.scratch(spark, "maps")))

    def entered(frame: pd.DataFrame) -> pd.DataFrame:
        open_, begun, out = np.array([frame["open"].iloc[0]]), np.array([frame["begun_before"].iloc[0]]), []
        for r in frame.sort_values("run").itertuples():
            out.append((r.run, int(open_[0]), int(begun[0])))
            open_, begun = _read(r).through(open_, begun)
        return pd.DataFrame(out, columns=["run", "open", "begun_before"])

    # the first row always begins a part: entered as if the part before it were over-full
    above = spark.createDataFrame([(0, most + 1, 0)], "up bigint, open bigint, begun_before bigint")
    for maps in reversed(levels):
        children = maps.withColumn("up", F.floor(F.col("run") / fan)).join(above, "up")
        above = children.groupBy("up").applyInPandas(entered, "run bigint, open bigint, begun_before bigint").withColumnRenamed("run", "up")

    def begins(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ordinal")
        total = np.concatenate([[0], np.cumsum(frame["bytes"].to_numpy())])
        first, open_, out = int(frame["ordinal"].iloc[0]), int(frame["open"].iloc[0]), []
        c = int(np.searchsorted(total, most - open_, "right")) - 1 if open_ <= most else 0
        while c < len(frame):
            out.append(first + c)
            c = max(int(np.searchsorted(total, total[c] + most, "right")) - 1, c + 1)
        # a row is held against the parts that begin in its own block, not against all of the run
        starts, blocks = np.array(out, np.int64), np.unique(frame["ordinal"].to_numpy() // BLOCK)
        ends = np.searchsorted(starts, [blocks * BLOCK, (blocks + 1) * BLOCK])
        rows = [(int(frame["run"].iloc[0]), int(b), int(frame["begun_before"].iloc[0]) + int(i), starts[i:j].tolist()) for b, i, j in zip(blocks, *ends, strict=True)]
        return pd.DataFrame(rows, columns=["run", "few", "before", "starts"])

    runs = sizes.join(above.withColumnRenamed("up", "run"), "run").groupBy("run").applyInPandas(begins, "run bigint, few bigint, before bigint, starts array<bigint>")
    runs = runs.withColumnsRenamed({"run": block, "few": few})
    part = F.col("before") - 1 + F.size(F.filter("starts", lambda s: s <= F.col(at)))
    return placed.withColumn(few, F.floor(F.col(at) / BLOCK).cast("long")).join(runs, [block, few]).withColumn("part", part.cast("long")).drop(at, own, block, few, "before", "starts")
