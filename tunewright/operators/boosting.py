"""Gradient-boosted trees grown leaf by leaf from histograms.

Features are cut into at most BINS bins once, and rows keep their bins, label, weight and margin. A measurement adds up
gradients, second derivatives and counts per (leaf, feature, bin) in each task; one place sees these sums only, finds the
best split of each leaf, and always splits the leaf that gains most, up to LEAVES leaves. As the next leaves to split are
among the best known ones, one measurement covers the children of all of those, so a tree takes as many as it is deep, and
grows as if leaves had been split one after the other. Of two children only the one with fewer rows is measured, the other
is what its parent has beyond that. Sums are whole numbers of a fixed unit that doubles add exactly: their order, and a task
that runs again, change nothing. The measurement of the root of a tree also gives the held-out loss of the trees before, so
boosting ends in one run, and the model is cut to its best number of trees.

Few rows are boosted by one task. More are dealt to tasks that run together (a barrier stage): each holds its rows and which
leaf they are in, the first one grows the trees, and they pass requests and sums through files in the shared folder. Where
that cannot be, a measurement is a pass: the rows are packed into arrays that executors keep (a persisted RDD), and a pass is
one short job of one stage.
"""

from __future__ import annotations

import pickle
import sys
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import BarrierTaskContext, StorageLevel, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tunewright import session

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins per feature, rows and second derivatives that each side of a split needs, trees between checkpoints of the margins.
BINS, LEAST_ROWS, LEAST_HESSIAN, MARGIN_TREES = 255, 20, 1e-3, 20
#: Rows that one task boosts by itself (some 10 MB); a pass over all tasks costs more than they do.
TASK_ROWS = 200_000
#: Rows that pay for a task of their own in a pass, and rows of a task at most (some 100 bytes each).
DEALT_ROWS, HELD_ROWS = 50_000, 2_000_000
#: Rows from which tasks run together, and seconds without news after which one of them gives up.
GANG_ROWS, SILENCE = 200_000, 900.0
#: Bits of a sum that doubles hold, of the part of one row at most, and of the held-out loss.
SUM_BITS, ROW_BITS, LOSS_BITS = 52, 40, 61
#: Rows that are scored together, so that what a tree needs of them stays in the cache.
SCORED_ROWS = 8_192
#: The cell that holds the held-out loss.
LOSS = -1
FLOOR = 1e-15
#: What a split must gain: below, it is the rounding of sums.
LEAST_GAIN = 1e-7


@dataclass
class Tree:
    """Nodes as parallel lists, the root first; a leaf has feature -1. Rows at or below ``threshold`` go left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, cell in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0)):
            column.append(cell)
        return len(self.feature) - 1

    def leaf_of(self, columns: np.ndarray) -> np.ndarray:
        """The node that each row ends in; ``columns`` has one row per feature."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        node = np.zeros(columns.shape[1], dtype=np.int64)
        rows = np.arange(columns.shape[1])
        while len(rows):
            rows = rows[feature[node[rows]] >= 0]
            at = node[rows]
            # A value that is not known counts as larger than any.
            node[rows] = np.where(columns[feature[at], rows] <= threshold[at], left[at], right[at])
        return node

    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)


class Scorer:
    """The sum of trees for many rows, without a walk.

    Each value is looked up once among the thresholds of its feature. Per tree and feature a table has, for each place
    among the thresholds, one bit per leaf, from left to right, that a row there may still reach: the first bit that is
    left in all of them is its leaf. Two trees of up to 32 leaves share a word.
    """

    def __init__(self, trees: list[Tree], features: int):
        self.trees, self.features = trees, features
        self.words: list[tuple[dict[int, np.ndarray], list[np.ndarray]]] | None = None

    def _build(self) -> None:
        wide = max((t.leaves() for t in self.trees), default=0) > 32
        self.bits, self.shift, self.turn = (np.uint64, 58, 0x03F79D71B4CB0A89) if wide else (np.uint32, 27, 0x077CB531)
        size = 64 if wide else 32
        self.ends = []
        for f in range(self.features):
            self.ends.append(np.unique([t.threshold[n] for t in self.trees for n in range(len(t.feature)) if t.feature[n] == f]))
        self.words = []
        for first in range(0, len(self.trees), 1 if wide else 2):
            tables: dict[int, np.ndarray] = {}
            values = []
            for j, tree in enumerate(self.trees[first:first + (1 if wide else 2)]):
                of_leaf = np.zeros(size)

                def number(node: int, leaf: int) -> int:
                    """Numbers the leaves from ``leaf`` on; returns the next number."""
                    f = tree.feature[node]
                    if f < 0:
                        of_leaf[((1 << leaf) * self.turn % (1 << size)) >> self.shift] = tree.value[node]
                        return leaf + 1
                    middle = number(tree.left[node], leaf)
                    lost = ((1 << middle) - (1 << leaf)) << size * j
                    table = tables.setdefault(f, np.full(len(self.ends[f]) + 1, (1 << 64) - 1, dtype=np.uint64))
                    table[np.searchsorted(self.ends[f], tree.threshold[node]) + 1:] &= np.uint64((1 << 64) - 1 - lost)
                    return number(tree.right[node], middle)

                number(0, 0)
                values.append(of_leaf)
            self.words.append((tables, values))

    def margin(self, columns: np.ndarray) -> np.ndarray:
        """``columns`` has one row per feature; a value that is not known counts as larger than any."""
        total = np.zeros(columns.shape[1])
        if max((t.leaves() for t in self.trees), default=0) > 64:
            for tree in self.trees:
                total += np.array(tree.value)[tree.leaf_of(columns)]
            return total
        if self.words is None:
            self._build()
        for first in range(0, len(total), SCORED_ROWS):
            run = slice(first, first + SCORED_ROWS)
            out = total[run]
            place = [np.searchsorted(ends, c[run]) if len(ends) else None for ends, c in zip(self.ends, columns, strict=True)]
            word, part = np.empty(len(out), np.uint64), np.empty(len(out), np.uint64)
            for tables, values in self.words:
                word[:] = (1 << 64) - 1
                for f, table in tables.items():
                    word &= table.take(place[f], out=part, mode="clip")
                for j, of_leaf in enumerate(values):
                    left = (word >> np.uint64(32) if j else word).astype(self.bits)
                    left &= -left
                    left *= self.bits(self.turn)
                    out += of_leaf.take((left >> self.bits(self.shift)).astype(np.intp))
        return total

    def probability(self, columns: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(columns)))


@dataclass
class Ranker:
    """Trees over named features; values include the learning rate. ``losses`` are the held-out losses of the run."""

    features: list[str]
    trees: list[Tree]
    losses: list[float] = field(default_factory=list)

    def scorer(self) -> Scorer:
        return Scorer(self.trees, len(self.features))

    def probability(self) -> Column:
        """Probability of a positive label, from the columns named like the features."""
        scorer = self.scorer()

        @F.pandas_udf("double")
        def score(*columns: pd.Series) -> pd.Series:
            return pd.Series(scorer.probability(np.array([c.to_numpy(dtype=float) for c in columns])))

        return score(*[F.col(c).cast("double") for c in self.features])

    def importance(self) -> list[float]:
        """Share of each feature in the gain of all splits."""
        gains = np.zeros(len(self.features))
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    gains[f] += g
        return (gains / gains.sum() if gains.sum() > 0 else gains).tolist()

    def rows(self) -> list[tuple]:
        return [(i, n, *node) for i, t in enumerate(self.trees)
                for n, node in enumerate(zip(t.feature, t.threshold, t.left, t.right, t.value, t.gain, strict=True))]


NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double"


def to_table(model: Ranker) -> DataFrame:
    """One row per node of the model."""
    return SparkSession.active().createDataFrame(model.rows(), NODES)


def from_table(nodes: DataFrame, features: list[str]) -> Ranker:
    trees: list[Tree] = []
    for r in nodes.orderBy("tree", "node").collect():
        if r["node"] == 0:
            trees.append(Tree())
        at = trees[-1].add(r["value"])
        for name in ("feature", "threshold", "left", "right", "gain"):
            getattr(trees[-1], name)[at] = r[name]
    return Ranker(features, trees)


def cut_values(rows: DataFrame, features: list[str]) -> list[np.ndarray]:
    """Rising bin ends per feature, the largest value last: the distinct values, or quantiles where there are more than BINS.

    What is not known lies beyond the last end.
    """
    shares = [i / BINS for i in range(1, BINS + 1)]
    known = [F.when(~F.isnan(c), F.col(c)) for c in features]
    found = rows.agg(*[F.approx_count_distinct(c).alias(f"n_{i}") for i, c in enumerate(known)],
                     *[F.percentile_approx(c, shares, 20 * BINS).alias(f"q_{i}") for i, c in enumerate(known)]).first()
    cuts = []
    for i, name in enumerate(features):
        ends = np.unique(np.array(found[f"q_{i}"] or [], dtype=float))
        if found[f"n_{i}"] <= 2 * BINS:
            # Few values: each is a bin of its own.
            values = rows.where(~F.isnan(name)).select(name).distinct().orderBy(name).limit(2 * BINS).collect()
            if len(values) <= BINS:
                ends = np.array([r[0] for r in values], dtype=float)
        cuts.append(ends)
    return cuts


@dataclass
class Sums:
    """What a leaf's rows add up to per feature and bin: gradients, second derivatives, rows; each (features, bins)."""

    gradient: np.ndarray
    hessian: np.ndarray
    rows: np.ndarray

    def without(self, part: Sums) -> Sums:
        return Sums(self.gradient - part.gradient, self.hessian - part.hessian, self.rows - part.rows)

    def value(self, rate: float) -> float:
        return float(-rate * self.gradient[0].sum() / max(self.hessian[0].sum(), FLOOR))

    def best_split(self) -> tuple[float, int, int] | None:
        """(gain, feature, last bin that goes left); ties go to the first feature and bin."""
        g, h, n = (np.cumsum(x, axis=1) for x in (self.gradient, self.hessian, self.rows))
        total_g, total_h, total_n = g[:, -1:], h[:, -1:], n[:, -1:]
        rest_g, rest_h, rest_n = total_g - g, total_h - h, total_n - n
        fit = (n >= LEAST_ROWS) & (rest_n >= LEAST_ROWS) & (h >= LEAST_HESSIAN) & (rest_h >= LEAST_HESSIAN)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(fit, g * g / h + rest_g * rest_g / rest_h - total_g * total_g / total_h, -np.inf)
        best = int(np.argmax(gain))
        feature, at = divmod(best, gain.shape[1])
        return (float(gain[feature, at]), feature, at) if gain[feature, at] > LEAST_GAIN else None


class Growing:
    """A tree on bins, with more nodes measured than it will keep."""

    def __init__(self):
        self.tree = Tree()
        self.sums: dict[int, Sums] = {}
        self.split: dict[int, tuple[float, int, int] | None] = {}
        self.waiting = [self.tree.add(0.0)]
        #: Per waiting child its sibling and parent.
        self.beside: dict[int, tuple[int, int]] = {}

    def measured(self, found: dict[int, Sums]) -> None:
        for node in self.waiting:
            self.sums[node] = found[node]
            self.split[node] = found[node].best_split()
            if node in self.beside:
                other, parent = self.beside.pop(node)
                self.sums[other] = self.sums[parent].without(found[node])
                self.split[other] = self.sums[other].best_split()
        self.waiting = []

    def chosen(self, leaves: int) -> list[int]:
        """Nodes split so far, best gain first, until a split needs nodes that are not measured yet.

        Children of the leaves that can still be among the splits left are then asked for.
        """
        kept, ends = [], [0]
        while True:
            able = sorted((n for n in ends if self.split[n]), key=lambda n: (-self.split[n][0], n))
            left = leaves - len(ends)
            if not able or not left:
                return kept
            best = able[0]
            if self.tree.left[best] < 0:
                for node in able[:left]:
                    if self.tree.left[node] < 0:
                        self._open(node)
                return kept
            kept.append(best)
            ends.remove(best)
            ends += [self.tree.left[best], self.tree.right[best]]

    def _open(self, node: int) -> None:
        _, feature, at = self.split[node]
        self.tree.feature[node], self.tree.threshold[node] = feature, float(at)
        left, right = self.tree.left[node], self.tree.right[node] = self.tree.add(0.0), self.tree.add(0.0)
        rows = self.sums[node].rows[feature]
        fewer, other = (left, right) if 2 * rows[:at + 1].sum() <= rows.sum() else (right, left)
        self.waiting.append(fewer)
        self.beside[fewer] = other, node

    def finished(self, kept: list[int], cuts: list[np.ndarray], rate: float) -> tuple[Tree, Tree, dict[int, float]]:
        """The tree of the kept splits, on bins and on values, and the value of each node that it ends in."""
        binned, ends = Tree(), {}

        def copy(node: int) -> int:
            at = binned.add(self.sums[node].value(rate))
            if node not in kept:
                ends[node] = binned.value[at]
            else:
                gain, feature, end = self.split[node]
                binned.feature[at], binned.threshold[at], binned.gain[at], binned.value[at] = feature, float(end), gain, 0.0
                binned.left[at] = copy(self.tree.left[node])
                binned.right[at] = copy(self.tree.right[node])
            return at

        copy(0)
        real = Tree(**{n: list(getattr(binned, n)) for n in ("feature", "threshold", "left", "right", "value", "gain")})
        for at, f in enumerate(real.feature):
            if f >= 0:
                real.threshold[at] = float(cuts[f][int(real.threshold[at])])
        return binned, real, ends


def binned_rows(rows: DataFrame, features: list[str], cuts: list[np.ndarray]) -> DataFrame:
    """``b0, b1, ..., label, weight, held_out, margin``: each feature's number of bin ends below the value."""
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [pa.array(np.searchsorted(c, batch.column(f).to_numpy(zero_copy_only=False).astype(float), side="left").astype(np.int16))
                    for f, c in zip(features, cuts, strict=True)]
            rest = [batch.column(c) for c in ("label", "weight", "held_out")]
            yield pa.RecordBatch.from_arrays([*bins, *rest, pa.array(np.zeros(batch.num_rows))], names=names)

    names = [*[f"b{i}" for i in range(len(features))], "label", "weight", "held_out", "margin"]
    kinds = ["smallint"] * len(features) + ["double", "double", "boolean", "double"]
    chosen = rows.select(*features, F.col("label").cast("double").alias("label"), "weight", "held_out")
    return session.settle(chosen.mapInArrow(place, ", ".join(map(" ".join, zip(names, kinds, strict=True)))), "boosting-rows")


def whole_parts(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Whole gradients and second derivatives of the rows, as doubles that add exactly."""
    chance = 1.0 / (1.0 + np.exp(-margin))
    return np.rint(weight * (chance - label) * unit), np.rint(weight * chance * (1.0 - chance) * unit)


def whole_loss(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, unit: float) -> int:
    chance = 1.0 / (1.0 + np.exp(-margin))
    right = np.where(label > 0, chance, 1.0 - chance)
    return int(np.rint(-weight * np.log(np.maximum(right, FLOOR)) * unit).astype(np.int64).sum())


class Part:
    """Some of the rows, those that are learned from first, and the rows of each node of the tree that grows."""

    def __init__(self, bins: np.ndarray, margin: np.ndarray, label: np.ndarray, weight: np.ndarray, held_out: np.ndarray,
                 units: tuple[float, float]):
        order = np.argsort(held_out, kind="stable")
        self.bins = bins.astype(np.uint8)[:, order]
        self.margin, self.label, self.weight = margin[order], label[order], weight[order]
        self.learned, self.units = int(np.count_nonzero(~held_out)), units
        learned = self.bins[:, :self.learned]
        #: The bin of a feature that has only one.
        self.single = [int(b[0]) if len(b) and b.min() == b.max() else None for b in learned]
        self.rows: dict[int, np.ndarray] = {}
        self.loss = 0

    def begin(self) -> None:
        """A new tree: all rows are in its root."""
        n, (unit, loss_unit) = self.learned, self.units
        self.parts = whole_parts(self.margin[:n], self.label[:n], self.weight[:n], unit)
        self.loss = whole_loss(self.margin[n:], self.label[n:], self.weight[n:], loss_unit)
        self.rows = {0: np.arange(len(self.margin))}

    def split(self, growing: Tree) -> None:
        """Rows of nodes that were split go on to the children."""
        for node in range(len(growing.feature)):
            if growing.feature[node] >= 0 and node in self.rows:
                rows = self.rows.pop(node)
                left = self.bins[growing.feature[node]].take(rows) <= int(growing.threshold[node])
                self.rows[growing.left[node]] = rows.take(np.flatnonzero(left))
                self.rows[growing.right[node]] = rows.take(np.flatnonzero(~left))

    def sums(self, node: int) -> np.ndarray:
        """(gradients, second derivatives, rows) of a node per (feature, bin)."""
        rows = self.rows[node]
        rows = rows[:np.searchsorted(rows, self.learned)]
        gradient, hessian = (p if len(rows) == self.learned else p.take(rows) for p in self.parts)
        total = np.zeros((3, len(self.bins), BINS + 1))
        for f, bins in enumerate(self.bins):
            if self.single[f] is not None:
                total[:, f, self.single[f]] = gradient.sum(), hessian.sum(), len(rows)
            elif len(rows):
                cell = (bins[:self.learned] if len(rows) == self.learned else bins.take(rows)).astype(np.intp)
                total[0, f] = np.bincount(cell, gradient, BINS + 1)
                total[1, f] = np.bincount(cell, hessian, BINS + 1)
                total[2, f] = np.bincount(cell, minlength=BINS + 1)
        return total

    def measure(self, growing: Tree, waiting: list[int]) -> np.ndarray:
        """Whole sums per (waiting node, gradients or second derivatives or rows, feature, bin)."""
        if len(growing.feature) == 1 or not self.rows:
            self.begin()
        self.split(growing)
        return np.stack([self.sums(node) for node in waiting])

    def take(self, growing: Tree, ends: dict[int, float]) -> None:
        for node, value in ends.items():
            below = [node]
            for at in below:
                # Nodes below an end were measured but not kept.
                if at in self.rows:
                    self.margin[self.rows[at]] += value
                else:
                    below += [growing.left[at], growing.right[at]]


def sums_by_node(total: np.ndarray, waiting: list[int], unit: float) -> dict[int, Sums]:
    return {node: Sums(gradient / unit, hessian / unit, rows) for node, (gradient, hessian, rows) in zip(waiting, total, strict=True)}


def columns_of(batch: pa.RecordBatch | pa.Table, features: int) -> tuple[np.ndarray, ...]:
    """Bins (one row per feature), margin, label, weight, held_out."""
    bins = np.array([batch.column(i).to_numpy() for i in range(features)], dtype=np.uint8)
    margin, label, weight = (batch.column(c).to_numpy() for c in ("margin", "label", "weight"))
    held_out = batch.column("held_out")
    held_out = held_out.to_numpy() if isinstance(held_out, pa.ChunkedArray) else held_out.to_numpy(zero_copy_only=False)
    return bins, margin.copy(), label, weight, held_out.astype(bool)


class InTask:
    """Rows that one task holds."""

    def __init__(self, part: Part):
        self.part = part

    def measure(self, growing: Tree, waiting: list[int]) -> tuple[dict[int, Sums], float]:
        total = self.part.measure(growing, waiting)
        return sums_by_node(total, waiting, self.part.units[0]), self.part.loss / self.part.units[1]

    def take(self, growing: Tree, ends: dict[int, float], tree: Tree) -> None:
        self.part.take(growing, ends)


class Post:
    """Messages between tasks as files: each appears whole, under its name."""

    def __init__(self, folder: str):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.store.create_dir(self.folder)

    def send(self, name: str, message: bytes) -> None:
        with self.store.open_output_stream(f"{self.folder}/_{name}") as out:
            out.write(message)
        self.store.move(f"{self.folder}/_{name}", f"{self.folder}/{name}")

    def receive(self, name: str) -> bytes:
        path, pause, since = f"{self.folder}/{name}", 0.0005, time.monotonic()
        while self.store.get_file_info(path).type == fs.FileType.NotFound:
            if time.monotonic() - since > SILENCE:
                raise TimeoutError(f"no {name} after {SILENCE} s")
            time.sleep(pause)
            pause = min(1.2 * pause, 0.02)
        with self.store.open_input_stream(path) as found:
            return found.read()

    def drop(self, name: str) -> None:
        self.store.delete_file(f"{self.folder}/{name}")


class InGang(InTask):
    """The first of several tasks that run together, each with a part of the rows: it asks, all add up."""

    def __init__(self, part: Part, post: Post, tasks: int):
        super().__init__(part)
        self.post, self.tasks, self.asked = post, tasks, 0

    def ask(self, kind: str, growing: Tree | None = None, what: list[int] | dict[int, float] | None = None) -> None:
        self.asked += 1
        # Plain lists: the other tasks need no copy of this package.
        self.post.send(f"{self.asked}", pickle.dumps((kind, vars(growing) if growing else None, what)))

    def measure(self, growing: Tree, waiting: list[int]) -> tuple[dict[int, Sums], float]:
        self.ask("measure", growing, waiting)
        total, loss = self.part.measure(growing, waiting), self.part.loss
        for task in range(1, self.tasks):
            found = self.post.receive(f"{self.asked}-{task}")
            self.post.drop(f"{self.asked}-{task}")
            loss += int(np.frombuffer(found, np.int64, 1)[0])
            total += np.frombuffer(found, offset=8).reshape(total.shape)
        # All have answered, so all have read this and any earlier request.
        self.post.drop(f"{self.asked}")
        return sums_by_node(total, waiting, self.part.units[0]), loss / self.part.units[1]

    def take(self, growing: Tree, ends: dict[int, float], tree: Tree) -> None:
        self.ask("take", growing, ends)
        self.part.take(growing, ends)

    @staticmethod
    def answer(part: Part, post: Post, task: int) -> None:
        """What the other tasks do until they are told to stop."""
        asked = 0
        while True:
            asked += 1
            kind, columns, what = pickle.loads(post.receive(f"{asked}"))
            if kind == "stop":
                return
            if kind == "take":
                part.take(Tree(**columns), what)
            else:
                total = part.measure(Tree(**columns), what)
                post.send(f"{asked}-{task}", np.int64(part.loss).tobytes() + total.tobytes())


class InPasses:
    """Rows of any number, packed into arrays: each measurement is a pass in which every task adds up its own."""

    def __init__(self, rows: DataFrame, features: int, units: tuple[float, float], n: int):
        self.features, self.units, self.taken = features, units, 0
        session.shared_root(rows.sparkSession)
        tasks = max(tasks_of(rows.sparkSession, n), -(-n // HELD_ROWS))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [b for b in batches if b.num_rows]
            if held:
                bins, margin, label, weight, held_out = columns_of(pa.Table.from_batches(held), features)
                packed = bins.astype(np.uint8), margin, label, weight, held_out
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in packed], names=names)

        def arrays(row) -> tuple[np.ndarray, ...]:
            kinds = np.uint8, float, float, float, bool
            bins, *rest = (np.frombuffer(part, dtype=kind) for part, kind in zip(row, kinds, strict=True))
            return bins.reshape(features, -1), *rest

        names = ["bins", "margin", "label", "weight", "held_out"]
        # Dealt row by row, so that the tasks hold equally many.
        packed = rows.repartition(tasks).mapInArrow(pack, ", ".join(f"{c} binary" for c in names))
        self.rows = packed.rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)
        self.before = None

    def measure(self, growing: Tree, waiting: list[int]) -> tuple[dict[int, Sums], float]:
        units = self.units

        def add(parts: Iterator[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, bytes]]:
            for arrays in parts:
                part = Part(*arrays, units)
                total = part.measure(growing, waiting)
                yield part.loss, zlib.compress(total.astype(np.int64).tobytes(), 1)

        total, loss = np.zeros((len(waiting), 3, self.features, BINS + 1)), 0
        # Sums only, of one chunk per task.
        for lost, found in self.rows.mapPartitions(add).collect():
            loss += lost
            total += np.frombuffer(zlib.decompress(found), dtype=np.int64).reshape(total.shape)
        return sums_by_node(total, waiting, units[0]), loss / units[1]

    def take(self, growing: Tree, ends: dict[int, float], tree: Tree) -> None:
        def update(part: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
            bins, margin, *rest = part
            return bins, margin + np.array(tree.value)[tree.leaf_of(bins)], *rest

        self._drop()
        self.before, self.rows = self.rows, self.rows.map(update).persist(StorageLevel.MEMORY_AND_DISK)
        self.taken += 1
        if self.taken % MARGIN_TREES == 0:
            self.rows.checkpoint()

    def _drop(self) -> None:
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def close(self) -> None:
        self._drop()
        self.rows.unpersist()


def tasks_of(spark: SparkSession, n: int) -> int:
    return max(min(spark.sparkContext.defaultParallelism, -(-n // DEALT_ROWS)), 1)


def gang_of(spark: SparkSession, n: int) -> tuple[str, int] | None:
    """A shared folder and a number of tasks that can run together; none where they cannot, or would hold too many rows."""
    if n <= GANG_ROWS or spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    context = spark.sparkContext._jsc.sc()
    # What the scheduler holds against a barrier stage before it starts.
    tasks = min(tasks_of(spark, n), context.maxNumConcurrentTasks(context.resourceProfileManager().defaultResourceProfile()))
    if n > tasks * HELD_ROWS:
        return None
    folder = session.shared_path(spark, "boosting")
    try:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path)
    except (OSError, pa.ArrowInvalid, NotImplementedError, ImportError):
        return None
    return folder, tasks


def boosted(rows: InTask | InPasses, cuts: list[np.ndarray], trees: int, leaves: int, rate: float, patience: int,
            judged: bool) -> tuple[list[Tree], list[float]]:
    """The trees up to the least held-out loss (all of them if none is ``judged``), and the losses of the run."""
    grown: list[Tree] = []
    losses: list[float] = []
    best = 0
    while True:
        growing = Growing()
        found, loss = rows.measure(growing.tree, growing.waiting)
        if grown and judged:
            losses.append(loss)
            best = len(losses) - 1 if loss < losses[best] else best
            if len(losses) - 1 - best >= patience:
                break
        if len(grown) == trees:
            break
        growing.measured(found)
        kept = growing.chosen(leaves)
        while growing.waiting:
            growing.measured(rows.measure(growing.tree, growing.waiting)[0])
            kept = growing.chosen(leaves)
        on_bins, real, ends = growing.finished(kept, cuts, rate)
        grown.append(real)
        rows.take(growing.tree, ends, on_bins)
    return (grown[:best + 1] if losses else grown), losses


def fit(rows: DataFrame, features: list[str], trees: int, leaves: int, rate: float, patience: int) -> Ranker:
    """Boost on rows with the features, ``label`` 0 or 1, ``weight`` and ``held_out``.

    Nulls and NaNs count as larger than any value. Without held-out rows all trees are kept, otherwise as many as
    gave the least loss, and boosting ends ``patience`` trees after that. Up to TASK_ROWS rows are boosted by one task;
    beyond, by tasks that run together, or by passes over all tasks. All come to the same trees.
    """
    # Boosting reads its rows many times.
    rows = session.settle(rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in features],
                                      "label", "weight", "held_out"), "boosting-input")
    size = rows.agg(F.sum("weight").alias("w"), F.count_if("held_out").alias("held_out"), F.count(F.lit(1)).alias("n")).first()
    if not size["w"]:
        return Ranker(features, [])
    bits = int(np.ceil(np.log2(size["w"] + 1)))
    # The loss of a row is at most some 35 times its weight.
    units = 2.0 ** min(ROW_BITS, SUM_BITS - bits), 2.0 ** min(ROW_BITS, LOSS_BITS - 6 - bits)
    cuts = cut_values(rows.where("NOT held_out"), features)
    binned = binned_rows(rows, features, cuts)
    settings = (cuts, trees, leaves, rate, patience, bool(size["held_out"]))
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.float64()] + [pa.int32()] * 2 + [pa.float64()] * 2

    def part_of(batches: Iterator[pa.RecordBatch]) -> Part:
        held = list(batches)
        if held:
            return Part(*columns_of(pa.Table.from_batches(held), len(features)), units)
        return Part(np.zeros((len(features), 0)), *[np.zeros(0)] * 3, np.zeros(0, dtype=bool), units)

    def model_rows(rows: InTask) -> pa.RecordBatch:
        found, losses = boosted(rows, *settings)
        nodes = [*Ranker(features, found).rows(), *[(LOSS, i, 0, 0.0, 0, 0, loss, 0.0) for i, loss in enumerate(losses)]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*nodes, strict=True), kinds, strict=True)], names=names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield model_rows(InTask(part_of(batches)))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, context = part_of(batches), BarrierTaskContext.get()
        # A folder of its own for each attempt of the stage, named by the first task.
        run = context.allGather(uuid.uuid4().hex)[0]
        task, post = context.partitionId(), Post(f"{folder}/{run}")
        if task:
            InGang.answer(part, post, task)
            return
        first = InGang(part, post, tasks)
        yield model_rows(first)
        first.ask("stop")

    spark, n = rows.sparkSession, size["n"]
    if n <= TASK_ROWS:
        held = binned.coalesce(1).mapInArrow(alone, NODES)
    elif gang := gang_of(spark, n):
        folder, tasks = gang
        # Dealt row by row, so that the tasks hold equally many.
        held = binned.repartition(tasks).mapInArrow(together, NODES, barrier=True)
    else:
        passes = InPasses(binned, len(features), units, n)
        try:
            return Ranker(features, *boosted(passes, *settings))
        finally:
            passes.close()
    nodes = session.settle(held, "boosted-nodes")
    model = from_table(nodes.where(F.col("tree") >= 0), features)
    model.losses = [r["value"] for r in nodes.where(F.col("tree") == LOSS).orderBy("node").collect()]
    return model
