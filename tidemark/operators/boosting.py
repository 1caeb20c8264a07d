"""Gradient boosting on binned features, grown leaf by leaf, for squared errors.

Features are cut into bins once, by exact quantiles (bin 0: null), and stored with the target. A round fits a tree to the
residuals. Its leaves are split best first until it has `leaves` of them; the sums that this needs, residuals and rows by
(node, feature, bin), are one aggregate a step, over all nodes at once that the tree as it stands would split next.
There are about as many steps as the tree is deep, so some thousands of short jobs in all: they are the one place here that
reads an RDD, of arrays that the executors hold, with sums that tasks add up as a tree. Of two children only one is summed,
the other is the rest of its parent. A null goes to the side where the split gains more; where a node had none, to its larger side.

Residuals are summed as whole numbers of 2^-SCALE, so that the same rows give the same trees in whatever order they come. Trees
are small and live on the driver; predictions are stored every STORED rounds, and in between the tasks add the trees since.

Rows without a target are left out. A column without values, or with one, is never split on. No rows: the model predicts 0.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quality import quantiles, ranked
from tidemark.sources.paths import written

SCALE = 24
STORED = 25
#: Rows that a task of a step has at least: fewer do not pay for it.
TASK_ROWS = 50_000


@dataclass(frozen=True)
class Boosting:
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 31
    least_rows: int = 20
    bins: int = 255


@dataclass
class Tree:
    """Nodes by number: where each splits (-1: nowhere), its children, whether nulls go left, and its value."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    null_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float = 0.0) -> int:
        for to, x in ((self.feature, -1), (self.bin, 0), (self.null_left, False), (self.left, -1), (self.right, -1), (self.value, value)):
            to.append(x)
        return len(self.feature) - 1

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf that each row of bins comes to."""
        at = np.zeros(len(bins), np.int64)
        feature, cut, null_left, left, right = (np.array(x) for x in (self.feature, self.bin, self.null_left, self.left, self.right))
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return at
            n = at[inner]
            b = bins[inner, feature[n]]
            at[inner] = np.where(np.where(b == 0, null_left[n], b <= cut[n]), left[n], right[n])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.node_of(bins)]


@dataclass
class Split:
    gain: float
    feature: int
    bin: int
    null_left: bool


def best_split(g: np.ndarray, n: np.ndarray, least_rows: int) -> Split | None:
    """The split of a node with the greatest gain, from its sums by (feature, bin); the first of equal ones. None if none gains."""
    g = g.astype(np.float64) / 2.0**SCALE  # squares of whole sums would not fit
    total_g, total_n = g[0].sum(), n[0].sum()
    best = None
    for null_left in (False, True):
        lg, ln = np.cumsum(g[:, 1:], axis=1), np.cumsum(n[:, 1:], axis=1)
        if null_left:
            lg, ln = lg + g[:, :1], ln + n[:, :1]
        rg, rn = total_g - lg, total_n - ln
        fits = (ln >= least_rows) & (rn >= least_rows)
        gain = np.where(fits, lg**2 / np.maximum(ln, 1) + rg**2 / np.maximum(rn, 1) - total_g**2 / max(total_n, 1), -np.inf)
        k = int(gain.argmax())
        f, b = divmod(k, gain.shape[1])
        if gain[f, b] > 1e-9 and (best is None or gain[f, b] > best.gain):
            there = n[f, 0] > 0
            best = Split(float(gain[f, b]), f, b + 1, null_left if there else bool(ln[f, b] > rn[f, b]))
    return best


def grow(how: Boosting, sums_of: Callable[[Tree, list[int]], dict[int, tuple[np.ndarray, np.ndarray]]]) -> Tree:
    """A tree grown best first. `sums_of` gives the sums of nodes of a partial tree."""
    tree = Tree()
    tree.add()
    sums = dict(sums_of(tree, [0]))
    splits = {0: best_split(*sums[0], how.least_rows)}
    while True:
        chosen, ask, leaves = [], [], 1
        heap = [(-splits[0].gain, 0)] if splits[0] else []
        while heap and leaves < how.leaves:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            leaves += 1
            if tree.left[node] < 0:
                ask.append(node)
                continue
            for child in (tree.left[node], tree.right[node]):
                if splits[child]:
                    heapq.heappush(heap, (-splits[child].gain, child))
        if not ask:
            break
        for node in ask:
            s = splits[node]
            tree.feature[node], tree.bin[node], tree.null_left[node] = s.feature, s.bin, s.null_left
            tree.left[node], tree.right[node] = tree.add(), tree.add()
        found = sums_of(tree, [tree.left[node] for node in ask])
        for node in ask:
            left, right = tree.left[node], tree.right[node]
            sums[left] = found[left]
            sums[right] = tuple(a - b for a, b in zip(sums[node], found[left], strict=True))
            for child in (left, right):
                splits[child] = best_split(*sums[child], how.least_rows)
    for node in range(len(tree.feature)):
        g, n = sums[node]
        tree.value[node] = how.rate * float(g[0].sum()) / 2.0**SCALE / max(1, int(n[0].sum()))
        if node not in chosen:  # split to look further, but not among the best
            tree.feature[node] = -1
    return tree


@dataclass
class Model:
    """Edges of the bins of each column, the mean, and the trees."""

    columns: tuple[str, ...]
    edges: list[np.ndarray]
    start: float
    trees: list[Tree]

    def binned(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(values.shape, np.int16)
        for j, e in enumerate(self.edges):
            v = values[:, j]
            out[:, j] = np.where(np.isnan(v), 0, 1 + np.searchsorted(e, v, "left"))
        return out

    def predict(self, values: np.ndarray) -> np.ndarray:
        bins = self.binned(values)
        return self.start + sum((t.predict(bins) for t in self.trees), np.zeros(len(values)))

    def transform(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """`keep` of every row, and prediction."""
        ready = rows.select(*keep, F.array(*[F.col(c).cast("double") for c in self.columns]).alias("_x"))

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = _matrix(batch.column("_x"), len(self.columns))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(self.predict(values))], [*keep, "prediction"])

        schema = ready.select(*keep).schema.add("prediction", "double")
        return ready.mapInArrow(of, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _blocks(stored: DataFrame, width: int, tasks: int) -> RDD:
    """The stored rows as arrays (bins, y, f), held by the executors in so many tasks at most for the rounds that read them; what is lost is read again."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = _matrix(batch.column("bins"), width).astype(np.int16), *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "f"))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(held)], pa.binary())], ["block"])

    return stored.coalesce(tasks).mapInArrow(packed, "block binary").rdd.map(lambda r: pickle.loads(r.block)).persist(StorageLevel.MEMORY_AND_DISK)


def fit(rows: DataFrame, columns: tuple[str, ...], target: str, how: Boosting = Boosting()) -> Model:
    """Boosted trees of `target` by numeric (or boolean) columns."""
    known = rows.where(F.col(target).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(target).cast("double").alias("_y"))
    known = written(known, "boosting-rows")
    found = {r["feature"]: r["quantiles"] for r in quantiles(ranked(known, known.limit(0), columns), how.bins).collect()}  # a row a column
    edges = [np.unique(np.array(found.get(c) or [0.0]))[:-1] for c in columns]
    mean, n_rows = known.agg(F.coalesce(F.avg("_y"), F.lit(0.0)), F.count("*")).first()
    model = Model(columns, edges, mean, [])
    tasks = n_rows // TASK_ROWS + 1
    width, cells = len(columns), how.bins + 2

    def ready(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = model.binned(_matrix(batch.column("_x"), width))
            listed = pa.ListArray.from_arrays(np.arange(len(bins) + 1, dtype=np.int32) * width, pa.array(bins.ravel()))
            yield pa.RecordBatch.from_arrays([listed, batch.column("_y"), pa.array(np.full(len(bins), model.start))], ["bins", "y", "f"])

    stored = written(known.select(F.array(*columns).alias("_x"), "_y").mapInArrow(ready, "bins array<short>, y double, f double"), "boosting-bins")
    blocks, since = _blocks(stored, width, tasks), []

    def sums_of(tree: Tree, nodes: list[int]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        size = len(nodes) * width * cells
        slot = np.full(len(tree.feature), -1)
        slot[nodes] = range(len(nodes))
        trees = list(since)

        def partial(held: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            g, n = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for bins, y, f in held:
                at = slot[tree.node_of(bins)]
                here = at >= 0
                off = y - f - sum((t.predict(bins) for t in trees), np.zeros(len(bins)))
                cell = ((at[here, None] * width + np.arange(width)) * cells + bins[here]).ravel()
                np.add.at(g, cell, np.repeat(np.rint(off[here] * 2.0**SCALE).astype(np.int64), width))
                n += np.bincount(cell, minlength=size)
            yield g, n

        g, n = (x.reshape(len(nodes), width, cells) for x in blocks.mapPartitions(partial).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1])))
        return {node: (g[k], n[k]) for k, node in enumerate(nodes)}

    for turn in range(how.rounds):
        tree = grow(how, sums_of)
        if tree.feature[0] < 0:
            break  # nothing gains any more
        model.trees.append(tree)
        since.append(tree)
        if len(since) == STORED and turn + 1 < how.rounds:
            trees = list(since)

            def further(batches: Iterator[pa.RecordBatch], trees: list[Tree] = trees) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    bins = batch.column("bins").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    f = batch.column("f").to_numpy(zero_copy_only=False) + sum((t.predict(bins) for t in trees), np.zeros(len(bins)))
                    yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.array(f)], ["bins", "y", "f"])

            stored = written(stored.mapInArrow(further, "bins array<short>, y double, f double"), "boosting-bins")
            blocks.unpersist()
            blocks, since = _blocks(stored, width, tasks), []
    blocks.unpersist()
    return model
