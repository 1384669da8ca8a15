"""Gradient boosting on histograms, leaf by leaf or level by level, for squared, absolute and quantile loss.

Rows are binned once and dealt to blocks by their bins, so that rows of equal bins, a cell, lie side by side: all of them have one
prediction and fall in one leaf. The targets are looked at once a round, for the gradients of the cells and the loss, and once a tree
for the quantiles of its leaves. A pass looks at cells only: it adds up, for every open node, gradients and rows by feature and bin;
tasks return sums of fixed size and combine them as a tree. From these the driver picks splits: the open leaf with the largest gain
first, up to a number of leaves. A pass also looks at the children of leaves that may be split next, so a tree takes about as many
passes as it is deep. Several models (one per quantile) share all passes.

Gradients and losses are summed in fixed point, so a model does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.rdd import RDD
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvian.session import spread

POINT = 1 << 20
#: Rows of a block, about: blocks grow in number with the rows, and not in size.
BLOCK_ROWS = 1 << 21
#: Rows that a task puts in order before it deals them out, and rows looked at together in a block.
HELD_ROWS, SPAN = 1 << 20, 1 << 16
#: Rounds after which the predictions of all rows are worked out from the stored rows again, so that the lineage stays short.
REFRESH = 16
#: Partial sums that the driver adds itself; more are combined on the executors first.
DIRECT = 64
#: The residual sketch: cells grow by GROWTH from FINEST to FINEST * GROWTH^CELLS (about 10^8) on either side of zero, so a quantile
#: is off by half of GROWTH - 1 of its value at most, or by FINEST.
GROWTH, FINEST, CELLS = 1.004, 1e-4, 6922
WIDTH = 2 * CELLS + 3


@dataclass(frozen=True)
class Objective:
    """`squared`, `absolute`, or `quantile` at a level."""

    loss: str = "squared"
    level: float = 0.5

    def __post_init__(self) -> None:
        if self.loss not in ("squared", "absolute", "quantile") or not 0 < self.level < 1:
            raise ValueError(f"unknown objective {self}")

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        """What a tree fits: the negative gradient, times POINT."""
        if self.loss == "squared":
            return np.rint(residual * POINT)
        level = self.middle
        return np.where(residual > 0, np.rint(level * POINT), np.where(residual < 0, np.rint((level - 1) * POINT), 0.0))

    @property
    def middle(self) -> float:
        """Level of the quantile that a leaf takes."""
        return 0.5 if self.loss == "absolute" else self.level

    def value(self, residual: np.ndarray) -> np.ndarray:
        if self.loss == "squared":
            return residual * residual
        if self.loss == "absolute":
            return np.abs(residual)
        return np.where(residual > 0, self.level * residual, (self.level - 1) * residual)


class Signs(Objective):
    """Absolute loss as Spark ML takes it: a tree fits 1 or -1, and a leaf has the mean of these. The loss is in finer units."""

    FINER = 64

    def gradient(self, residual: np.ndarray) -> np.ndarray:
        return np.where(residual < 0, -float(POINT), float(POINT))

    def value(self, residual: np.ndarray) -> np.ndarray:
        return np.abs(residual) * self.FINER


@dataclass(frozen=True)
class BoostSettings:
    rounds: int = 100
    leaves: int = 31
    step: float = 0.05
    bins: int = 64
    least_rows: int = 20
    patience: int | None = 5
    partitions: int | None = None


@dataclass
class Tree:
    """Nodes of a tree; `feature` is -1 at a leaf, rows with a code up to `cut` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def place(self, codes: np.ndarray) -> np.ndarray:
        """Node at which each column of `codes` (features x rows) ends.

        A bit for each leaf, from left to right. A code that goes right at a node rules out the leaves on the left of it, so a table
        by feature and code has the leaves left over, and the first leaf that no feature rules out is the one.
        """
        if len(self.feature) < 2 or (self.feature < 0).sum() > 64:
            return self.walked(codes)
        leaves, under = [], {}

        def visit(i: int) -> int:
            """Bits of the leaves below a node."""
            if self.feature[i] < 0:
                leaves.append(i)
                return 1 << len(leaves) - 1
            under[i] = visit(int(self.left[i]))
            return under[i] | visit(int(self.right[i]))
        visit(0)
        left = None
        for f in sorted({int(self.feature[i]) for i in under}):
            table = np.full(256, (1 << 64) - 1, dtype=np.uint64)
            for i in under:
                if self.feature[i] == f:
                    table[self.cut[i] + 1:] &= np.uint64((1 << 64) - 1 ^ under[i])
            left = table[codes[f]] if left is None else left & table[codes[f]]
        return np.array(leaves, dtype=np.int32)[np.bitwise_count((left & -left) - np.uint64(1))]

    def walked(self, codes: np.ndarray) -> np.ndarray:
        """The same, from node to node."""
        at = np.zeros(codes.shape[1], dtype=np.int32)
        rows = np.arange(codes.shape[1])
        while len(rows):
            node = at[rows]
            inner = self.feature[node] >= 0
            rows, node = rows[inner], node[inner]
            at[rows] = np.where(codes[self.feature[node], rows] <= self.cut[node], self.left[node], self.right[node])
        return at

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.place(codes)]


@dataclass
class Booster:
    """A fitted model: `edges` are the cut points of each feature, `curve` the validation loss after 0, 1, ... trees of the fit."""

    objective: Objective
    edges: list[np.ndarray]
    start: float
    trees: list[Tree] = field(default_factory=list)
    curve: list[float] = field(default_factory=list)

    def predict(self, values: np.ndarray) -> np.ndarray:
        """Predictions for a rows x features array."""
        return self.predict_coded(coded(values, self.edges))

    def predict_coded(self, codes: np.ndarray) -> np.ndarray:
        out = np.full(codes.shape[1], self.start)
        for t in self.trees:
            out += t.predict(codes)
        return out

    def to_json(self) -> str:
        return json.dumps({"loss": self.objective.loss, "level": self.objective.level, "start": self.start, "curve": self.curve,
                           "edges": [e.tolist() for e in self.edges], "trees": [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Booster:
        x = json.loads(text)
        kinds = {"value": np.float64}
        trees = [Tree(**{k: np.array(v, dtype=kinds.get(k, np.int32)) for k, v in t.items()}) for t in x["trees"]]
        return Booster(Objective(x["loss"], x["level"]), [np.array(e) for e in x["edges"]], x["start"], trees, x["curve"])

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "model string").write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Booster:
        return Booster.from_json(spark.read.text(path, wholetext=True).first()[0])


def coded(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins of a rows x features array, as features x rows: the number of cut points below a value."""
    return np.stack([np.searchsorted(e, values[:, f], side="left") for f, e in enumerate(edges)]).astype(np.uint8)


def cut_points(rows: DataFrame, features: Sequence[str], bins: int) -> list[np.ndarray]:
    """Cut points of each feature, at most `bins` - 1: all but the largest of few distinct values, else quantiles."""
    if not 2 <= bins <= 256:
        raise ValueError("bins must be between 2 and 256")
    columns = [F.col(f).cast("double") for f in features]
    about = rows.agg(*[F.approx_count_distinct(c) for c in columns]).first()
    probs = [k / bins for k in range(1, bins)]
    # sets of few values only; their size is known from the count above
    found = rows.agg(*[F.collect_set(c) if n <= 2 * bins else F.percentile_approx(c, probs, 10_000) for c, n in zip(columns, about)]).first()
    out = []
    for c, n in zip(found, about):
        distinct = sorted(set(c or ()))
        if n <= 2 * bins and len(distinct) > bins:
            distinct = [distinct[len(distinct) * k // bins] for k in range(1, bins)]
        elif n <= 2 * bins:
            distinct = distinct[:-1]
        out.append(np.array(distinct, dtype=np.float64))
    return out


TRAIN, VALIDATE = 1, 2


def numbered(codes: np.ndarray) -> np.ndarray:
    """A number for each column, equal where columns are equal and only there."""
    key, width = np.zeros(codes.shape[1], dtype=np.int64), 1
    for row in codes:
        if width > 1 << 54:
            found, key = np.unique(key, return_inverse=True)
            width = len(found)
        key, width = key * 256 + row, width * 256
    return key


def gathered(y: np.ndarray, starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The stretches of `y` of length `n` at `starts`, one after the other."""
    return y[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def cells_of(codes: np.ndarray, n: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces (columns of `codes`, with `n` targets each) put together: codes, rows and targets cell by cell, in the order of codes."""
    key = numbered(codes)
    order = np.argsort(key, kind="stable")
    key, taken = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return codes[:, order[first]], np.add.reduceat(taken, first), gathered(y, (np.cumsum(n) - n)[order], taken)


def dealt(codes: np.ndarray, n: np.ndarray, y: np.ndarray, parts: int) -> Iterator[tuple]:
    """(block, codes, rows, targets) of each block that gets some of these cells. A cell goes to a block by its codes; one that would be
    more than an even share is cut into pieces, which go to blocks side by side."""
    most = -(-len(y) // parts)
    pieces = -(-n // most)
    cell = np.repeat(np.arange(len(n)), pieces)
    k = np.arange(len(cell)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    spot = np.zeros(codes.shape[1], dtype=np.uint64)
    for row in codes:
        spot = (spot ^ row) * np.uint64(0x9E3779B97F4A7C15)
        spot ^= spot >> np.uint64(31)
    block = ((spot[cell] % np.uint64(parts)).astype(np.int64) + k) % parts
    order = np.argsort(block, kind="stable")
    cell, size = cell[order], np.minimum(most, n[cell] - k * most)
    taken, y = size[order], gathered(y, (np.cumsum(size) - size)[order], size[order])
    upto = np.concatenate([[0], np.cumsum(taken)])
    cut = np.searchsorted(block[order], np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)):
        a, b = cut[p], cut[p + 1]
        yield int(p), codes[:, cell[a:b]], taken[a:b], y[upto[a]:upto[b]]


PIECES = ["x", "n", "y"]


def packed(codes: np.ndarray, n: np.ndarray, y: np.ndarray) -> list[bytes]:
    return [codes.tobytes(), n.astype("<i8").tobytes(), y.tobytes()]


def unpacked(x: bytes, n: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.frombuffer(n, "<i8")
    return np.frombuffer(x, np.uint8).reshape(-1, len(size)), size, np.frombuffer(y, "<f8")


def singly(rdd: RDD) -> RDD:
    """Each element pickled by itself, so that RDDs of blocks can be zipped as they are."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def binned(table: DataFrame, d: int, n: int, edges: list[np.ndarray], least: int | None = None) -> RDD:
    """RDD of blocks (codes, roles, rows, target), from a table of `d` features, target and `n` roles.

    `codes` are features x cells bins and `roles` folds x cells, `rows` counts the rows of each cell, whose targets follow each other.
    Cells are in the order of their roles. There are `least` blocks at least, and as many as the table has parts or cores
    can look at together. What is shuffled is the targets, once, and the bins of the cells of every task.
    """
    busy = min(table.rdd.getNumPartitions(), table.sparkSession.sparkContext.defaultParallelism)
    parts = max(least or 1, busy, -(-table.count() // BLOCK_ROWS))

    def batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        kinds = [pa.int32() if name == "part" else pa.binary() for name in names]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            x, y = (np.concatenate(part, axis=-1) for part in zip(*held))
            cells = cells_of(x, np.ones(len(y), dtype=np.int64), y)
            return batch([(p, *packed(*piece)) for p, *piece in dealt(*cells, parts)], ["part", *PIECES])
        for b in batches:
            if not b.num_rows:
                continue
            values = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in range(d)], axis=1)
            y, *roles = (b.column(d + k).to_numpy(zero_copy_only=False) for k in range(1 + n))
            if np.isnan(y).any():
                raise ValueError("a row has no target")
            held.append((np.concatenate([np.stack(roles).astype(np.uint8), coded(values, edges)]), y.astype("<f8")))
            size += b.num_rows
            if size >= HELD_ROWS:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpacked(*(b.column(c)[i].as_buffer() for c in PIECES)) for b in batches for i in range(b.num_rows)]
        if held:
            yield batch([packed(*cells_of(*(np.concatenate(part, axis=-1) for part in zip(*held))))], PIECES)

    def block(r) -> tuple:
        x, size, y = unpacked(*r)
        return x[n:], x[:n], size, y
    pieces = table.mapInArrow(deal, "part int, x binary, n binary, y binary").repartitionById(parts, F.col("part"))
    return singly(pieces.drop("part").mapInArrow(merge, "x binary, n binary, y binary").rdd.map(block))


def sketch_cells(residual: np.ndarray) -> np.ndarray:
    """Cell of each residual, from 0 (far below zero) over CELLS + 1 (zero) upwards."""
    size = np.abs(residual)
    k = np.clip(np.ceil(np.log(np.maximum(size, FINEST / 2) / FINEST) / np.log(GROWTH)), 0, CELLS).astype(np.int64) + 1
    return CELLS + 1 + np.where(size < FINEST / 2, 0, np.sign(residual).astype(np.int64) * k)


def sketch_quantile(sketch: Counts, level: float) -> float:
    """The value at which `level` of the residuals is reached."""
    upto = np.cumsum(sketch.n)
    cell = int(sketch.keys[np.searchsorted(upto, max(1, np.ceil(level * upto[-1])), side="left")]) - (CELLS + 1)
    return 0.0 if cell == 0 else float(np.sign(cell) * FINEST * GROWTH ** (abs(cell) - 1) * 2 / (1 + GROWTH))


@dataclass
class Counts:
    """Counts by key, of those keys that occur."""

    keys: np.ndarray
    n: np.ndarray

    @staticmethod
    def of(keys: np.ndarray) -> Counts:
        return Counts(*np.unique(keys, return_counts=True))

    @staticmethod
    def of_all(counts: np.ndarray) -> Counts:
        """From the counts of all keys from 0 up."""
        keys = np.flatnonzero(counts)
        return Counts(keys, counts[keys])

    def __add__(self, other: Counts) -> Counts:
        keys, place = np.unique(np.concatenate([self.keys, other.keys]), return_inverse=True)
        return Counts(keys, np.bincount(place, np.concatenate([self.n, other.n]), len(keys)).astype(np.int64))


@dataclass
class Node:
    depth: int
    rows: int = -1
    total: int = 0
    gain: float = 0.0
    feature: int = -1
    cut: int = 0
    left: tuple[int, int] = (0, 0)  # rows and total on the left of the cut
    children: tuple[int, int] | None = None


class Growing:
    """A tree while it grows: best leaf first, as far as the sums of the passes allow."""

    def __init__(self, settings: BoostSettings) -> None:
        self.settings, self.nodes, self.chosen = settings, [Node(0)], set()

    def open(self) -> list[int]:
        """Nodes whose sums are still unknown."""
        return [i for i, n in enumerate(self.nodes) if n.rows < 0]

    def shape(self) -> Tree:
        """All splits that are known, for placing rows."""
        inner = [n.children is not None for n in self.nodes]
        pick = lambda f: np.array([f(n) if i else -1 for n, i in zip(self.nodes, inner)], dtype=np.int32)
        return Tree(pick(lambda n: n.feature), pick(lambda n: n.cut), pick(lambda n: n.children[0]), pick(lambda n: n.children[1]), np.zeros(len(inner)))

    def take(self, node: int, gradient: np.ndarray, rows: np.ndarray) -> None:
        """Sums of one node: features x bins."""
        n = self.nodes[node]
        n.rows, n.total = int(rows[0].sum()), int(gradient[0].sum())
        left_n, left_total = rows.cumsum(axis=1)[:, :-1], gradient.cumsum(axis=1)[:, :-1]
        left_g = left_total.astype(np.float64)
        right_n, right_g = n.rows - left_n, n.total - left_g
        fits = (left_n >= self.settings.least_rows) & (right_n >= self.settings.least_rows)
        if not fits.any():
            return
        base = n.total / max(1, n.rows) * n.total
        gain = np.where(fits, left_g * left_g / np.maximum(left_n, 1) + right_g * right_g / np.maximum(right_n, 1) - base, -1.0)
        best = int(gain.argmax())
        if gain.flat[best] > 1e-9 * abs(base) + 1e-9:
            n.gain = float(gain.flat[best])
            n.feature, n.cut = divmod(best, gain.shape[1])
            n.left = int(left_n.flat[best]), int(left_total.flat[best])

    def grow(self) -> bool:
        """Split leaf by leaf; True when the tree is complete, else children whose sums are needed have been added."""
        self.chosen, leaves = set(), [0]
        while len(leaves) < self.settings.leaves:
            best = max(leaves, key=lambda i: (self.nodes[i].gain, -i))
            if self.nodes[best].gain <= 0:
                return True
            if self.nodes[best].children is None:
                able = sorted((i for i in leaves if self.nodes[i].gain > 0 and self.nodes[i].children is None), key=lambda i: -self.nodes[i].gain)
                for i in able[:self.settings.leaves - len(leaves)]:
                    self.nodes[i].children = (len(self.nodes), len(self.nodes) + 1)
                    self.nodes += [Node(self.nodes[i].depth + 1), Node(self.nodes[i].depth + 1)]
                return False
            self.chosen.add(best)
            leaves.remove(best)
            leaves += self.nodes[best].children
        return True

    def finished(self) -> tuple[Tree, list[Node]]:
        """The chosen splits, without values, and the nodes they have sums of."""
        order, number = [0], {0: 0}
        for i in order:
            if i in self.chosen:
                for c in self.nodes[i].children:
                    number[c] = len(order)
                    order.append(c)
        inner = [i in self.chosen for i in order]
        pick = lambda f: np.array([f(self.nodes[i]) if s else -1 for i, s in zip(order, inner)], dtype=np.int32)
        return Tree(pick(lambda n: n.feature), pick(lambda n: n.cut), pick(lambda n: number[n.children[0]]), pick(lambda n: number[n.children[1]]),
                    np.zeros(len(order))), [self.nodes[i] for i in order]


class GrowingLevels(Growing):
    """A tree that splits every leaf with a gain, down to a depth."""

    def __init__(self, settings: BoostSettings, depth: int) -> None:
        super().__init__(settings)
        self.depth = depth

    def grow(self) -> bool:
        for i in [i for i, n in enumerate(self.nodes) if n.gain > 0 and n.children is None and n.depth < self.depth]:
            n = self.nodes[i]
            left, right = Node(n.depth + 1), Node(n.depth + 1)
            if left.depth == self.depth:  # leaves, whose sums follow from the split
                (left.rows, left.total), (right.rows, right.total) = n.left, (n.rows - n.left[0], n.total - n.left[1])
            n.children = (len(self.nodes), len(self.nodes) + 1)
            self.nodes += [left, right]
            self.chosen.add(i)
        return not self.open()


@dataclass
class Request:
    """What a pass adds up for one model: sums of the nodes `open` of `shape`."""

    model: int
    fold: int
    shape: Tree
    open: list[int]

    def slots(self, codes: np.ndarray, roles: np.ndarray) -> np.ndarray:
        """The place in `open` of the node of each cell to learn from, else -1."""
        number = np.full(len(self.shape.feature), -1)
        number[self.open] = np.arange(len(self.open))
        return np.where(roles[self.fold] == TRAIN, number[self.shape.place(codes)], -1)


@dataclass
class Cells:
    """The cells of a block: their bins, roles and rows, and for each model prediction and sum of gradients. `loss` has, for each model,
    the loss over the validation rows and their number."""

    codes: np.ndarray
    roles: np.ndarray
    n: np.ndarray
    base: np.ndarray
    gradient: np.ndarray
    loss: list[tuple[int, int]]


def spans(n: np.ndarray) -> list[tuple[slice, slice]]:
    """Ranges of cells, and of their rows, of about SPAN rows."""
    upto = np.concatenate([[0], np.cumsum(n)])
    cut = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(SPAN, upto[-1], SPAN)), [len(n)]]))
    return [(slice(a, b), slice(upto[a], upto[b])) for a, b in zip(cut, cut[1:])]


def looked_at(block: tuple, base: np.ndarray, asked: dict[int, tuple[int, Objective]]) -> Cells:
    """The cells of a block under the predictions `base` (models x cells); `asked` has fold and objective of the models looked at."""
    codes, roles, n, y = block
    gradient, loss = np.zeros(base.shape, dtype=np.int64), [(0, 0)] * len(base)
    for cells, rows in spans(n):
        size, target = n[cells], y[rows]
        for m, (fold, objective) in asked.items():
            residual = target - np.repeat(base[m, cells], size)
            val = roles[fold, cells] == VALIDATE
            if not val.all():
                gradient[m, cells] = np.add.reduceat(objective.gradient(residual), np.cumsum(size) - size)
            if val.any():
                held = residual if val.all() else residual[np.repeat(val, size)]
                loss[m] = loss[m][0] + int(np.rint(objective.value(held) * POINT).sum()), loss[m][1] + len(held)
    return Cells(codes, roles, n, base, gradient, loss)


def first_look(block: tuple, starts: list[float], trees: list[list[Tree]], asked: dict[int, tuple[int, Objective]]) -> Cells:
    base = np.repeat(np.array(starts)[:, None], len(block[2]), axis=1)
    return looked_at(block, with_trees(block[0], base, trees), asked)


def next_look(pair: tuple[tuple, Cells], trees: list[list[Tree]], asked: dict[int, tuple[int, Objective]]) -> Cells:
    block, before = pair
    return looked_at(block, with_trees(block[0], before.base.copy(), trees), asked)


def with_trees(codes: np.ndarray, base: np.ndarray, trees: list[list[Tree]]) -> np.ndarray:
    for m, own in enumerate(trees):
        for t in own:
            base[m] += t.predict(codes)
    return base


def sums(parts: Iterator[Cells], requests: list[Request], bins: int) -> Iterator[list[tuple]]:
    """Per request: gradients and rows (node x feature x bin), cells that were added up, loss and rows of validation."""
    out = None
    for c in parts:
        d, found = len(c.codes), []
        for q in requests:
            slot, k = q.slots(c.codes, c.roles), len(q.open)
            use = np.flatnonzero(slot >= 0)
            cell, x, g, n = slot[use] * bins, c.codes[:, use], c.gradient[q.model, use], c.n[use]
            gradient, rows = (np.stack([np.bincount(cell + x[f], w, k * bins) for f in range(d)]).astype(np.int64) for w in (g, n))
            found.append((gradient.reshape(d, k, bins).swapaxes(0, 1), rows.reshape(d, k, bins).swapaxes(0, 1), len(use), *c.loss[q.model]))
        out = found if out is None else added(out, found)
    if out is not None:
        yield out


def residuals(pairs: Iterator[tuple[tuple, Cells]], requests: list[Request]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the request, slots, residuals) of rows to learn from, span by span."""
    for (codes, roles, n, y), c in pairs:
        for i, q in enumerate(requests):
            slot = q.slots(codes, roles)
            for cells, rows in spans(n):
                use = np.repeat(slot[cells], n[cells])
                known = use >= 0
                if known.any():
                    yield i, use[known], (y[rows] - np.repeat(c.base[q.model, cells], n[cells]))[known]


def sketches(pairs: Iterator[tuple[tuple, Cells]], requests: list[Request]) -> Iterator[list[tuple[Counts]]]:
    """Per request, counts of residuals by node and sketch cell."""
    out = [np.zeros(len(q.open) * WIDTH, dtype=np.int64) for q in requests]
    for i, slot, r in residuals(pairs, requests):
        np.add.at(out[i], slot * WIDTH + sketch_cells(r), 1)
    yield [(Counts.of_all(s),) for s in out]


REST = 1 << 31


def moments(pairs: Iterator[tuple[tuple, Cells]], requests: list[Request]) -> Iterator[list[tuple]]:
    """Per request and node, sums of residuals (in fixed point, and in units of 1 / REST what that leaves over) and of their squares."""
    out = [[np.zeros(len(q.open), dtype=np.int64), np.zeros(len(q.open), dtype=np.int64), np.zeros(len(q.open))] for q in requests]
    for i, slot, r in residuals(pairs, requests):
        whole = np.rint(r * POINT)
        for total, part in zip(out[i], (whole, np.rint((r * POINT - whole) * REST), r * r)):
            total += np.bincount(slot, part, len(total)).astype(total.dtype)
    yield [tuple(x) for x in out]


def added(a: list[tuple], b: list[tuple]) -> list[tuple]:
    return [tuple(x + y for x, y in zip(p, q)) for p, q in zip(a, b)]


class Fit:
    """Boosting of several objectives, in each of several folds, over the same rows."""

    def __init__(self, rows: RDD, edges: list[np.ndarray], objectives: Sequence[Objective], settings: BoostSettings, folds: int = 1) -> None:
        self.rows, self.settings, self.parts = rows.persist(StorageLevel.MEMORY_AND_DISK), settings, rows.getNumPartitions()
        self.models = [Booster(o, edges, 0.0) for _ in range(folds) for o in objectives]
        self.fold = [k for k in range(folds) for _ in objectives]
        self.bins = max(2, max(len(e) for e in edges) + 1)
        self.added, self.old, self.state = [0] * len(self.models), None, None

    def _advance(self, anew: bool, active: Sequence[int]) -> None:
        """Look at all targets under the predictions with all trees so far: from the last ones, or `anew` from the rows. The next pass
        works them out, and what executors lose is worked out again."""
        asked = {m: (self.fold[m], self.models[m].objective) for m in active}
        if anew:
            after = self.rows.map(partial(first_look, starts=[m.start for m in self.models], trees=[list(m.trees) for m in self.models], asked=asked))
        else:
            trees = [m.trees[n:] for m, n in zip(self.models, self.added)]
            after = self.rows.zip(self.state).map(partial(next_look, trees=trees, asked=asked))
        self.old, self.state = self.state, singly(after).persist(StorageLevel.MEMORY_AND_DISK)
        self.added = [len(m.trees) for m in self.models]

    def _combined(self, found: RDD) -> list[tuple]:
        out = found.reduce(added) if self.parts <= DIRECT else found.treeReduce(added)
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        return out

    def _pass(self, growing: dict[int, Growing]) -> list[tuple]:
        asked = [Request(m, self.fold[m], g.shape(), g.open()) for m, g in growing.items()]
        # the requests, a few trees, travel with the tasks: a broadcast would take longer than the pass
        out = self._combined(self.state.mapPartitions(partial(sums, requests=asked, bins=self.bins)))
        for g, (gradient, rows, *_) in zip(growing.values(), out):
            for k, node in enumerate(g.open()):
                g.take(node, gradient[k], rows[k])
        return out

    def _values(self, done: dict[int, tuple[Tree, list[Node]]]) -> None:
        """Sets the leaves of trees: means of the residuals from the sums of the passes, quantiles from a sketch."""
        asked = []
        for m, (tree, nodes) in done.items():
            leaves = np.flatnonzero(tree.feature < 0)
            if self.models[m].objective.loss == "squared":
                tree.value[leaves] = [nodes[i].total / nodes[i].rows / POINT if nodes[i].rows > 0 else 0.0 for i in leaves]
            else:
                asked.append(Request(m, self.fold[m], tree, leaves.tolist()))
        if not asked:
            return
        for q, (sketch,) in zip(asked, self._combined(self.rows.zip(self.state).mapPartitions(partial(sketches, requests=asked)))):
            cut = np.searchsorted(sketch.keys, WIDTH * np.arange(len(q.open) + 1))
            for k, leaf in enumerate(q.open):
                part = slice(cut[k], cut[k + 1])
                if cut[k] < cut[k + 1]:
                    q.shape.value[leaf] = sketch_quantile(Counts(sketch.keys[part] - WIDTH * k, sketch.n[part]), self.models[q.model].objective.middle)

    def run(self) -> list[Booster]:
        s = self.settings
        active = list(range(len(self.models)))
        self._advance(True, active)
        first = {m: Growing(s) for m in active}
        self._pass(first)
        if any(g.nodes[0].rows == 0 for g in first.values()):
            raise ValueError("no rows to learn from")
        whole = {m: g.finished() for m, g in first.items()}
        self._values(whole)
        for m, (tree, _) in whole.items():
            self.models[m].start = float(tree.value[0])
        self._advance(True, active)
        for done in range(s.rounds + 1):
            growing = {m: Growing(s) for m in active}
            out = self._pass(growing)
            for m, (*_, loss, n) in zip(list(active), out):
                if n:
                    self.models[m].curve.append(loss / POINT / n)
            active = [m for m in active if not self._settled(self.models[m])]
            growing = {m: g for m, g in growing.items() if m in active}
            if not active or done == s.rounds:
                break
            grown = {}
            while growing:
                grown |= {m: g.finished() for m, g in growing.items() if g.grow()}
                growing = {m: g for m, g in growing.items() if m not in grown}
                if growing:
                    self._pass(growing)
            self._values(grown)
            for m, (tree, _) in grown.items():
                tree.value *= s.step
                self.models[m].trees.append(tree)
            self._advance(done % REFRESH == REFRESH - 1, active)
        self.close()
        for m in self.models:
            if m.curve and s.patience is not None:
                del m.trees[int(np.argmin(m.curve)):]
        return self.models

    def close(self) -> None:
        self.state.unpersist()
        self.rows.unpersist()

    def _settled(self, model: Booster) -> bool:
        """No gain on the validation rows for `patience` rounds in a row."""
        s = self.settings
        return s.patience is not None and bool(model.curve) and len(model.curve) - 1 - int(np.argmin(model.curve)) >= s.patience


@dataclass
class Grown:
    """A tree with what each node has: gain of its split in variance, and number, sum and sum of squares of what the tree fits."""

    tree: Tree
    gain: np.ndarray
    stats: np.ndarray


class LevelFit(Fit):
    """Spark ML's boosted trees under absolute loss, from blocks of one fold: a first tree on the targets, then trees, times `step`, on the
    signs of the residuals. A tree splits all leaves of a level with a gain; a leaf has the mean."""

    def __init__(self, rows: RDD, edges: list[np.ndarray], rounds: int, depth: int, step: float) -> None:
        super().__init__(rows, edges, [Objective()], BoostSettings(rounds, 2 ** depth, step, least_rows=1, patience=None))
        self.depth, self.grown = depth, []

    def _grow(self, growing: Growing) -> None:
        while not growing.grow():
            self._pass({0: growing})
        tree, nodes = growing.finished()
        stats = np.array([(n.rows, n.total / POINT, n.rows) for n in nodes], dtype=np.float64)
        if not self.grown:
            # the targets themselves are summed with more digits than the passes have
            leaves = np.flatnonzero(tree.feature < 0)
            (found,) = self._combined(self.rows.zip(self.state).mapPartitions(partial(moments, requests=[Request(0, 0, tree, leaves.tolist())])))
            stats[:, 1:] = 0.0
            stats[leaves, 1] = [(int(a) * REST + int(b)) / (POINT * REST) for a, b in zip(*found[:2])]
            stats[leaves, 2] = found[2]
            for i in reversed(np.flatnonzero(tree.feature >= 0)):
                stats[i, 1:] = stats[tree.left[i], 1:] + stats[tree.right[i], 1:]
        tree.value = stats[:, 1] / stats[:, 0] * (self.settings.step if self.grown else 1.0)
        self.grown.append(Grown(tree, np.array([n.gain / POINT / POINT / n.rows for n in nodes]), stats))
        self.models[0].trees.append(tree)

    def run(self, tolerance: float | None) -> list[Grown]:
        """The trees up to the best round. Rounds end when the validation loss falls by less than a share `tolerance`; None takes all."""
        self._advance(True, [0])
        first = GrowingLevels(self.settings, self.depth)
        self._pass({0: first})
        if first.nodes[0].rows == 0:
            raise ValueError("no rows to learn from")
        self._grow(first)
        self.models[0].objective = Signs()
        best, keep = math.nan, 1
        for done in range(1, self.settings.rounds + 1):
            if done == self.settings.rounds and tolerance is None:
                break
            self._advance(done % REFRESH == 1, [0])
            growing = GrowingLevels(self.settings, self.depth)
            ((*_, loss, n),) = self._pass({0: growing})
            error = loss / POINT / Signs.FINER / n if n else math.nan
            if tolerance is not None:
                if done == 1:
                    best = error
                elif best - error < tolerance * max(error, 0.01):
                    break
                elif error < best:
                    best, keep = error, done
            if done < self.settings.rounds:
                self._grow(growing)
        self.close()
        return self.grown if tolerance is None else self.grown[:keep]


def fit(rows: DataFrame, features: Sequence[str], objectives: Sequence[Objective], target: str, settings: BoostSettings = BoostSettings()) -> list[Booster]:
    """A model per objective, fitted on the rows marked `is_train` and watched on those marked `is_val`.

    With `patience`, a model whose validation loss has not fallen for that many rounds stops, and every model is cut back to its best
    round; rows without validation, or `patience` None, use all rounds. Features have no nulls; rows without a target are an error.
    """
    return fit_folds(rows, features, objectives, target, [(F.col("is_train"), F.col("is_val"))], settings)[0]


def fit_folds(rows: DataFrame, features: Sequence[str], objectives: Sequence[Objective], target: str, folds: Sequence[tuple[Column, Column]],
              settings: BoostSettings = BoostSettings()) -> list[list[Booster]]:
    """For every fold, a (train, validation) pair of conditions, a model per objective.

    Rows are binned and stored once for all folds, and all models share the passes. Cut points come from the rows that any fold
    learns from; only their features are looked at.
    """
    folds = [(F.coalesce(train, F.lit(False)), F.coalesce(val, F.lit(False))) for train, val in folds]
    learned, used = F.lit(False), F.lit(False)
    for train, val in folds:
        learned, used = learned | (train & ~val), used | train | val
    roles = [F.when(val, VALIDATE).when(train, TRAIN).otherwise(0).cast("tinyint").alias(f"r{k}") for k, (train, val) in enumerate(folds)]
    names = [f"f{k}" for k in range(len(features))]
    # read several times, so the rows are worked out once
    table = spread(rows.where(used).select(*[F.col(f).cast("double").alias(n) for n, f in zip(names, features)],
                                           F.col(target).cast("double").alias("y"), learned.alias("_learned"), *roles), settings.partitions)
    edges = cut_points(table.where("_learned"), names, settings.bins)
    blocks = binned(table.drop("_learned"), len(names), len(folds), edges, settings.partitions)
    models = Fit(blocks, edges, objectives, settings, len(folds)).run()
    return [models[k * len(objectives):(k + 1) * len(objectives)] for k in range(len(folds))]


def predictions(rows: DataFrame, models: Sequence[Booster], features: Sequence[str], names: Sequence[str]) -> DataFrame:
    """`rows` with the prediction of each model under its name."""
    sent = rows.sparkSession.sparkContext.broadcast(list(models))  # trees of bounded number and size

    @F.pandas_udf(", ".join(f"m{k} double" for k in range(len(models))))
    def predicted(*values: pd.Series) -> pd.DataFrame:
        x, codes, out = np.stack([v.to_numpy(dtype=np.float64) for v in values], axis=1), {}, {}
        for k, m in enumerate(sent.value):
            if id(m.edges) not in codes:  # models of one fit share them
                codes[id(m.edges)] = coded(x, m.edges)
            out[f"m{k}"] = m.predict_coded(codes[id(m.edges)])
        return pd.DataFrame(out)

    with_all = rows.withColumn("_p", predicted(*[F.col(f).cast("double") for f in features]))
    return with_all.withColumns({n: F.col("_p")[f"m{k}"] for k, n in enumerate(names)}).drop("_p")
