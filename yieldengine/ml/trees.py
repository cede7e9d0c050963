"""Histogram trees for boosting and forests, grown over a distributed table by split search on binned features.

Features are binned once. A row carries its bins, target, weight, fold and the scores that every model gives it so far,
so models that differ only in the fold they leave out (or in their parameters) are grown in the same passes over the
same rows, and held-out scores need no further pass.

The rows are kept as an RDD of blocks of numpy arrays, a pass being one short job over it. Its scores are brought up to
date by the first pass of a round; where a round of boosting has levels, the rows it draws are kept by themselves for its
passes. What a pass has shuffled is removed when it ends. A tree grows in two kinds of pass:

* Levels: nodes of more than LOCAL_ROWS rows. Tasks sum gradients per (node, bin) of every feature that a node may be split
  on. Up to DRIVER_BYTES of such sums, over all partitions, are added up and searched by the driver, which keeps them for
  the next level: of two children the one of fewer rows is summed, the other is the parent's sums less those. More are
  shuffled by tree and feature and added up there; the reducing task searches the feature's splits, so the driver then
  sees one record a node and feature and no histogram.
* Subtrees: nodes of at most LOCAL_ROWS rows (FOREST_FACTOR times that for forests of enough trees to busy every task).
  Their rows go to one task each, which grows the rest over the same bins.

Both search the same splits, so the bound on local rows moves work and not the result. Rows are sampled and weighted by
a hash of their key, which a retry or another partitioning repeats.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from yieldengine.staging import remove, remove_unreachable, stage, stage_objects

#: A node of so many rows or fewer is finished by one task.
LOCAL_ROWS = 1 << 20
#: Rows of one partition of the training table: at least and at most.
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 20
#: Rows of a block.
BLOCK_ROWS = 1 << 16
#: Rounds of boosting after which the table is written, which bounds its lineage.
PENDING = 25
#: Nodes of the forests of one pass, and their values (bounds what tasks are sent and the driver gets), and bytes of histograms a task holds.
PASS_NODES, PASS_VALUES, HELD_BYTES = 1 << 21, 1 << 23, 1 << 26
#: Rows that the trees of one pass draw (bounds what is shuffled): so many times those of the table, or enough to busy every task.
PASS_TABLES = 4
#: Partial histograms of a level of so many bytes or fewer, over all partitions, are added up by the driver.
DRIVER_BYTES = 1 << 26
#: Nodes of a tree in one pass of so many or fewer are found by their ranges of bins, and not by the tree.
RANGED_NODES = 24
#: Bytes of the trees that are sent, written or held at once where they are scored, and rows that are then scored together.
PART_BYTES, SCORED_ROWS = 1 << 25, 1 << 17
#: Cells of a feature's histograms that a subtree keeps for its next level.
KEPT_CELLS = 1 << 18
#: A subtree's nodes of so many rows or fewer are summed from them: there splits are often equal but for rounding.
SUMMED_ROWS = 1 << 12
#: A level of more rows is searched on a feature by the rows of those nodes alone that may be split on it.
PICKED_ROWS = 1 << 15
#: How many times LOCAL_ROWS a node of a forest may have to be finished by one task, if three tasks in four have a tree to grow.
FOREST_FACTOR = 4

_BLOCKS = "id long, key binary, x binary, y binary, w binary, part binary, score binary"


@dataclass(frozen=True)
class Growth:
    """When and how a node is split. A leaf's value is S(sum) / (weight + l2), with S shrinking by l1."""

    depth: int
    min_leaf: int = 1
    min_split: int = 2
    min_weight: float = 0.0
    l1: float = 0.0
    l2: float = 0.0
    tree_columns: int | None = None
    node_columns: int | None = None
    most: float = math.inf  # bound on a leaf's value: a class thought impossible has next to no second derivative

    def shrunk(self, total: np.ndarray) -> np.ndarray:
        return np.sign(total) * np.maximum(np.abs(total) - self.l1, 0.0) if self.l1 else total

    def value(self, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
        under = weight + self.l2
        return np.where(under > 0, self.shrunk(total) / np.where(under > 0, under, 1.0), 0.0)

    def gain(self, total: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """What a node is worth: the drop of the loss by its leaf values, twice."""
        return (self.value(total, weight) * self.shrunk(total)).sum(axis=-1)


@dataclass
class Tree:
    """Nodes in order of their place in the full binary tree (root 1, children 2i and 2i + 1). Leaves alone have a value."""

    place: np.ndarray
    feature: np.ndarray  # -1: leaf
    cut: np.ndarray  # bins up to the cut go left
    gain: np.ndarray
    left: np.ndarray  # the left child; of a leaf the place of its value
    value: np.ndarray

    def values(self, node: np.ndarray) -> np.ndarray:
        """The values of the leaves in which rows end."""
        return self.value.take(self.left.take(node), axis=0)

    def nodes(self, x: np.ndarray) -> np.ndarray:
        """The node in which every row ends."""
        leaf = self.feature < 0
        feature, cut = np.where(leaf, 0, self.feature).astype(np.int64), np.where(leaf, np.iinfo(np.int32).max, self.cut)
        left = np.where(leaf, np.arange(len(leaf)), self.left)  # a row stays in its leaf
        cells, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(int(self.place.max()).bit_length() - 1):
            node = left.take(node) + (cells.take(first + feature.take(node)) > cut.take(node))
        return node


@dataclass(frozen=True)
class Task:
    """One tree to grow: of which model, the number of its round, its seed and rules."""

    model: int
    seed: int
    growth: Growth


@dataclass
class Rows:
    """A block of rows; blocks by id have the rows in the order of their unsigned keys."""

    id: int
    key: np.ndarray
    x: np.ndarray
    y: np.ndarray
    w: np.ndarray
    part: np.ndarray
    score: np.ndarray
    drawn: dict = field(default_factory=dict, repr=False)  # the last draws: models of one seed draw alike

    def uniform(self, seed: int) -> np.ndarray:
        """A number in [0, 1) for every row, by its key."""
        return self._kept("uniform", seed, lambda: _uniform(self.key, seed))

    def times(self, seed: int) -> np.ndarray:
        """How often every row is drawn for a bagged tree."""
        return self._kept("times", seed, lambda: _times(self.uniform(seed)))

    def _kept(self, name: str, seed: int, make) -> np.ndarray:
        if self.drawn.get(name, (None,))[0] != seed:
            self.drawn[name] = seed, make()
        return self.drawn[name][1]


@dataclass
class Drawn:
    """Of a block the rows that a round of boosting draws for any of its trees: their bins, and by model how often a row counts, its
    target, weight and score as `Growing.drawn` gives them."""

    id: int
    x: np.ndarray
    own: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _block(row, columns: int) -> Rows:
    id_, key, x, y, w, part, score = row
    n = len(key) // 8
    return Rows(
        id_, np.frombuffer(key, np.uint64), np.frombuffer(x, np.uint8 if len(x) == n * columns else np.uint16).reshape(n, -1), np.frombuffer(y), np.frombuffer(w),
        np.frombuffer(part, np.int32), np.frombuffer(score).reshape(n, -1),
    )


def _hash(x: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) + np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _uniform(x: np.ndarray, seed: int) -> np.ndarray:
    return (_hash(x, seed) >> np.uint64(11)).astype(np.float64) / (1 << 53)


def _times(drawn: np.ndarray) -> np.ndarray:
    times = sum((drawn > p).view(np.int8) for p in _POISSON[:3])
    more = np.flatnonzero(times == 3)  # few
    times[more] = np.searchsorted(_POISSON, drawn[more])
    return times


def _allowed(places: np.ndarray, columns: int, task: Task) -> np.ndarray:
    """Which features each node may split on: those of least hash, per tree and per node."""
    allowed = np.ones((len(places), columns), dtype=bool)
    each = np.arange(columns, dtype=np.uint64)
    if task.growth.tree_columns is not None and task.growth.tree_columns < columns:
        h = _hash(each, task.seed * 2 + 1)
        allowed &= (h <= np.sort(h)[task.growth.tree_columns - 1])[None]
    if task.growth.node_columns is not None and task.growth.node_columns < columns:
        h = _hash(places.astype(np.uint64)[:, None] * np.uint64(64) + each[None], task.seed * 2)
        h = np.where(allowed, h, np.uint64(0xFFFFFFFFFFFFFFFF))
        allowed &= h <= np.sort(h, axis=1)[:, task.growth.node_columns - 1][:, None]
    return allowed


#: A split must better the loss by more than rounding does.
LEAST_GAIN = 1e-9


def _gains(left: np.ndarray, total: np.ndarray, worth: np.ndarray, growth: Growth, k: int) -> np.ndarray:
    """Gains of splits by the sums (g, h, rows) of their left sides; those that are not allowed have none."""
    right = total - left
    gain = growth.gain(left[..., :k], left[..., k:-1]) + growth.gain(right[..., :k], right[..., k:-1]) - worth
    bad = np.minimum(left[..., -1], right[..., -1]) < max(growth.min_leaf, 1)
    if growth.min_weight:
        bad |= np.minimum(left[..., k:-1].sum(axis=-1), right[..., k:-1].sum(axis=-1)) < growth.min_weight
    gain[bad] = -np.inf
    return gain


def _is_open(place: int, total: np.ndarray, growth: Growth) -> bool:
    """Whether a node may be split, by its depth and rows."""
    return total[-1] >= max(growth.min_split, 2 * growth.min_leaf) and place.bit_length() <= growth.depth


@dataclass(frozen=True)
class Shares:
    """The columns of class sums of rows that count for one class each: the row's class and weight in place of a column a class."""

    label: np.ndarray
    weight: np.ndarray
    classes: int

    def take(self, rows: np.ndarray) -> Shares:
        return Shares(self.label.take(rows), self.weight.take(rows), self.classes)

    def by(self, cell: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(cell * self.classes + self.label, self.weight, size * self.classes).reshape(size, -1)


def _by_cell(sums: list, cell: np.ndarray, size: int) -> np.ndarray:
    """Sums and rows by cell; a column of ones may be given as None."""
    rows = np.bincount(cell, minlength=size).astype(np.float64)
    told = [rows if c is None else c.by(cell, size) if isinstance(c, Shares) else np.bincount(cell, c, size) for c in sums]
    return np.concatenate([c.reshape(size, -1) for c in (*told, rows)], axis=1)


def _cells(sums: list, node: np.ndarray, value: np.ndarray, size: int, bins: int) -> np.ndarray:
    """Sums and rows by (node, bin)."""
    cell = np.multiply(node, bins, dtype=np.int64)
    cell += value
    return _by_cell(sums, cell, size * bins).reshape(size, bins, -1)


def _best_of_cells(cells: np.ndarray, total, worth, growth, k):
    """Per node the best cut of a feature and its gain, by the sums of its bins."""
    gain = _gains(np.cumsum(cells, axis=1)[:, :-1], total[:, None], worth[:, None], growth, k)
    cut = gain.argmax(axis=1)
    return cut, gain[np.arange(len(cells)), cut]


def _best_by_cells(sums: list[np.ndarray], node: np.ndarray, value: np.ndarray, bins: int, total, worth, growth, k):
    """Per node the best cut of a feature and its gain, over all bins: for nodes of more rows than bins."""
    return _best_of_cells(_cells(sums, node, value, len(total), bins), total, worth, growth, k)


def _best_by_rows(sums: list[np.ndarray], node: np.ndarray, value: np.ndarray, order: np.ndarray, total, worth, growth, k):
    """As above over the bins that occur in a node, by its rows in order."""
    size = len(total)
    if size > 1:
        of = node.astype(np.uint16) if size < 1 << 16 else node  # sorted by its digits, so in a few passes
        order = order.take(np.argsort(of.take(order), kind="stable"))
    rows = order
    if isinstance(sums[0], Shares):
        return _best_by_runs(sums, node[rows], value[rows], rows, total, worth, growth, k)
    of, value = node[rows], value[rows]
    last = np.flatnonzero((value[1:] != value[:-1]) & (of[1:] == of[:-1]))
    cut, best = np.zeros(size, dtype=np.int64), np.full(size, -np.inf)
    if not len(last):
        return cut, best
    count = total[:, -1].astype(np.int64)
    start = np.cumsum(count) - count
    whose = of[last].astype(np.int64)
    left = np.empty((len(last), len(sums) + 1))
    for j, column in enumerate(sums):
        run = np.cumsum(column[rows])
        left[:, j] = run[last] - np.where(start > 0, run[start - 1], 0.0)[whose]
    left[:, -1] = last + 1 - start[whose]
    return _best_of_cuts(left, whose, value[last], total, worth, growth, k)


def _best_by_runs(sums: list, of: np.ndarray, value: np.ndarray, rows: np.ndarray, total, worth, growth, k):
    """As above, by the sums of the runs of equal node and value, in order."""
    size = len(total)
    starts = np.append(True, (value[1:] != value[:-1]) | (of[1:] != of[:-1]))
    run = np.cumsum(starts) - 1
    head = np.flatnonzero(starts)
    whose, value = of[head].astype(np.int64), value[head]
    left = np.cumsum(_by_cell([c.take(rows) for c in sums], run, len(head)), axis=0)
    first = np.searchsorted(whose, np.arange(size))
    left -= np.concatenate([np.zeros((1, left.shape[1])), left])[first][whose]
    last = np.flatnonzero(whose[1:] == whose[:-1])
    if not len(last):
        return np.zeros(size, dtype=np.int64), np.full(size, -np.inf)
    return _best_of_cuts(left[last], whose[last], value[last], total, worth, growth, k)


def _best_of_cuts(left: np.ndarray, whose: np.ndarray, value: np.ndarray, total, worth, growth, k):
    """Per node the best of its cuts at `value`, which are in order of the node, by the sums of their left sides."""
    size = len(total)
    cut, best = np.zeros(size, dtype=np.int64), np.full(size, -np.inf)
    gain = _gains(left, total[whose], worth[whose], growth, k)
    head = np.flatnonzero(np.append(True, whose[1:] != whose[:-1]))
    top = np.maximum.reduceat(gain, head)
    first = np.full(size, len(gain))
    hit = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(head, len(gain)))))
    np.minimum.at(first, whose[hit], hit)
    best[whose[head]] = top
    cut[whose[head]] = value[first[whose[head]]]
    return cut, best


def _drawn_cells(sums: list, node: np.ndarray, x: np.ndarray, allowed: np.ndarray, bins: int, total, worth, growth, k):
    """Per node the best gain, feature and cut of the few features that it may be split on, by the sums of their bins.

    A row is summed once for each of its node's features, so the work goes with their number and not with that of all."""
    open_, best, feature, cut = allowed.any(axis=1), LEAST_GAIN * (1.0 + np.abs(worth)), np.full(len(total), -1), np.zeros(len(total), dtype=np.int64)
    places = np.flatnonzero(open_)
    if not len(places):
        return best, feature, cut
    first = np.arange(0, x.size, x.shape[1])
    if not open_.all():  # rows of leaves are not summed
        of = np.flatnonzero(open_.take(node))
        node, first, sums = (np.cumsum(open_) - 1).take(node.take(of)), first.take(of), [None if c is None else c.take(of) for c in sums]
        allowed, total, worth = allowed[places], total[places], worth[places]
    cells, begin = x.ravel(), node * bins
    order = np.argsort(~allowed, axis=1, kind="stable")  # a node's features, in order
    for at in range(int(allowed.sum(axis=1).max())):
        f = order[:, at]
        cell = f.take(node)
        cell += first
        cell = cells.take(cell) + begin
        where, gain = _best_of_cells(_by_cell(sums, cell, len(places) * bins).reshape(len(places), bins, -1), total, worth, growth, k)
        better = (gain > best[places]) & allowed[np.arange(len(places)), f]
        which = places[better]
        best[which], feature[which], cut[which] = gain[better], f[better], where[better]
    return best, feature, cut


def grow_subtree(x: np.ndarray, g: np.ndarray | Shares, h: np.ndarray, place: int, task: Task) -> dict[str, np.ndarray]:
    """The subtree under `place` for its rows: place, feature, cut, gain and sums (g, h, rows) of every node."""
    growth, out, k = task.growth, [], g.classes if isinstance(g, Shares) else g.shape[1]
    sums = [g, *h.T] if isinstance(g, Shares) else [np.ascontiguousarray(c) for c in (*g.T, *h.T)]
    whole, columns = np.ascontiguousarray(x), x.shape[1]
    by_row, whole = (None, whole) if growth.node_columns is None else (whole, None)  # rows whole, where all features are searched
    x = [np.ascontiguousarray(c) for c in x.T]
    bins = [int(c.max()) + 1 for c in x]
    node, places = np.zeros(len(h), dtype=np.int64), np.array([place], dtype=np.int64)
    alike = [None if not isinstance(c, Shares) and len(c) and c.min() == c.max() == 1.0 else c for c in sums]
    kept: dict[int, np.ndarray] = {}  # the last level's histograms of the nodes that were split
    while len(places):
        size = len(places)
        total = _by_cell(alike, node, size)
        worth = growth.gain(total[:, :k], total[:, k:-1])
        open_ = (total[:, -1] >= max(growth.min_split, 2 * growth.min_leaf)) & (int(places[0]).bit_length() <= growth.depth)
        allowed = _allowed(places, columns, task) & open_[:, None]
        if by_row is not None and (len(node) <= PICKED_ROWS or size * max(bins) > len(node)):
            x, by_row = [np.ascontiguousarray(c) for c in by_row.T], None
        if by_row is not None:
            best, feature, cut = _drawn_cells(alike, node, by_row, allowed, max(bins), total, worth, growth, k)
            allowed[:] = False  # searched
        else:
            best, feature, cut = LEAST_GAIN * (1.0 + np.abs(worth)), np.full(size, -1), np.zeros(size, dtype=np.int64)
        above, kept = kept, {}
        if above:  # of two large children the one of fewer rows is summed, its sibling is what the parent has beside it
            fewer = np.arange(0, size, 2) + (total[1::2, -1] < total[::2, -1])
            is_summed = total[:, -1] <= SUMMED_ROWS
            is_summed[fewer] = True
            summed, others = np.flatnonzero(is_summed), np.flatnonzero(~is_summed)
            few = np.flatnonzero(is_summed.take(node))
            picked = None if whole is None else whole.take(few, axis=0)  # all features of a row at once
            some, which = [None if c is None else c.take(few) for c in alike], (np.cumsum(is_summed) - 1).take(node.take(few))
        for f in np.flatnonzero(allowed.any(axis=0)):
            if bins[f] < 2:
                continue
            if growth.node_columns is None and size * bins[f] <= min(len(node), KEPT_CELLS):
                if f in above:
                    cells = np.empty((size, *above[f].shape[1:]))
                    cells[summed] = _cells(some, which, picked[:, f], len(summed), bins[f])
                    beside = above[f][others >> 1] - cells[others ^ 1]
                    beside[beside[..., -1] == 0] = 0.0  # no rounding where there are no rows, so cuts there are equal
                    cells[others] = beside
                else:
                    cells = _cells(alike, node, x[f], size, bins[f])
                kept[f] = cells
                at, gain = _best_of_cells(cells, total, worth, growth, k)
                better = (gain > best) & allowed[:, f]
                best[better], feature[better], cut[better] = gain[better], f, at[better]
                continue
            own = allowed[:, f]
            if size * bins[f] > len(node) > PICKED_ROWS and own.mean() < 0.75:
                of = np.flatnonzero(own.take(node))
                value, whose = x[f].take(of), (np.cumsum(own) - 1).take(node.take(of))
                given = [c.take(of) for c in sums], whose, value, np.argsort(value, kind="stable")
                at, gain = np.zeros(size, dtype=np.int64), np.full(size, -np.inf)
                at[own], gain[own] = _best_by_rows(*given, total[own], worth[own], growth, k)
            elif size * bins[f] > len(node):
                at, gain = _best_by_rows(sums, node, x[f], np.argsort(x[f], kind="stable"), total, worth, growth, k)
            elif own.mean() < 0.75:  # the others' rows need not be summed
                of = np.flatnonzero(own.take(node))
                given = [c.take(of) for c in sums], (np.cumsum(own) - 1).take(node.take(of)), x[f].take(of)
                at, gain = np.zeros(size, dtype=np.int64), np.full(size, -np.inf)
                at[own], gain[own] = _best_by_cells(*given, bins[f], total[own], worth[own], growth, k)
            else:
                at, gain = _best_by_cells(sums, node, x[f], bins[f], total, worth, growth, k)
            better = (gain > best) & allowed[:, f]
            best[better], feature[better], cut[better] = gain[better], f, at[better]
        split = feature >= 0
        out.append((places, feature, cut, np.where(split, best, 0.0), total))
        if not split.any():
            break
        kept = {f: cells[split] for f, cells in kept.items()}
        if not split.all():
            keep = np.flatnonzero(split.take(node))
            node, sums = node.take(keep), [c.take(keep) for c in sums]
            alike = [None if old is None else c for old, c in zip(alike, sums)]
            if whole is not None:
                whole = whole.take(keep, axis=0)
                x = [np.ascontiguousarray(c) for c in whole.T]
            elif by_row is None:
                x = [c.take(keep) for c in x]
            else:
                by_row = by_row.take(keep, axis=0)
        if by_row is not None:
            value = feature.take(node)
            value += np.arange(0, by_row.size, columns)
            right = by_row.ravel().take(value) > cut.astype(by_row.dtype).take(node)
            node = (2 * (np.cumsum(split) - 1)).take(node)
            node += right
            places = np.stack([2 * places[split], 2 * places[split] + 1], axis=1).ravel()
            continue
        # of the types of the bins and features, which are narrow
        by, at, right = feature.astype(np.int16).take(node), cut.astype(x[0].dtype).take(node), np.zeros(len(node), dtype=bool)
        for f in np.unique(feature[split]).astype(np.int16):
            right |= (x[f] > at) & (by == f)
        node = (2 * (np.cumsum(split) - 1)).take(node)
        node += right
        places = np.stack([2 * places[split], 2 * places[split] + 1], axis=1).ravel()
    names = ("place", "feature", "cut", "gain", "sums")
    return {name: np.concatenate(column) for name, column in zip(names, zip(*out))}


def _search(histogram: np.ndarray, task: Task, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best cuts of a feature by the histogram (node, bin, sums): gain, cut, sums of the left child and of the node."""
    total = histogram.sum(axis=1)
    if histogram.shape[1] < 2:
        return np.full(len(total), -np.inf), np.zeros(len(total), dtype=np.int64), total, total
    left = np.cumsum(histogram, axis=1)[:, :-1]
    worth = task.growth.gain(total[:, :k], total[:, k:-1])
    gain = _gains(left, total[:, None], worth[:, None], task.growth, k)
    cut, each = gain.argmax(axis=1), np.arange(len(total))
    return gain[each, cut], cut, left[each, cut], total


@dataclass(frozen=True)
class Squared:
    """Squared error of one target: sums are weighted residuals over weights."""

    outputs: int = 1

    def sums(self, y, w, score):
        return (y - score[:, 0])[:, None] * w[:, None], w[:, None]


@dataclass(frozen=True)
class Softmax:
    """Multinomial loss over `outputs` classes: one gradient and one second derivative a class."""

    outputs: int

    def sums(self, y, w, score):
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        hit = np.arange(self.outputs)[None] == y[:, None]
        return (hit - p) * w[:, None], np.maximum(p * (1.0 - p), 1e-16) * w[:, None]


@dataclass(frozen=True)
class Votes:
    """Class shares: what a forest averages over the rows of a leaf."""

    outputs: int

    def sums(self, y, w, score):
        return (np.arange(self.outputs)[None] == y[:, None]) * w[:, None], w[:, None]

    def shares(self, y, w):
        """The same sums without a column a class; rows of no class (null, none of the outputs) have weight 0 in one."""
        known = (y >= 0) & (y < self.outputs) & (y == np.floor(y))
        return Shares(np.where(known, y, 0).astype(np.int64), np.where(known, w, 0.0), self.outputs), w[:, None]


_POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(16)])


@dataclass
class Ensemble:
    """One model in training: the parts of the rows it leaves out, how rows are drawn for a tree, and its trees so far."""

    loss: object
    growth: Growth
    trees: int
    rate: float = 1.0
    rows: float = 1.0
    bagged: bool = False
    weighted: bool = False
    leave_out: tuple[int, ...] = ()
    seed: int = 42
    base: list[float] = field(default_factory=list)
    done: list[Tree] = field(default_factory=list)

    def fits(self, rows: Rows, seed: int) -> np.ndarray:
        """Whether a row is drawn for a tree."""
        fits = np.ones(len(rows.part), dtype=bool)
        for part in self.leave_out:
            fits &= rows.part != part
        if self.bagged:
            fits &= rows.times(seed) > 0
        elif self.rows < 1.0:
            fits &= rows.uniform(seed) < self.rows
        return fits

    def drawn(self, rows: Rows, seed: int, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of one tree (or those of them at `index`) and how often each counts."""
        if index is None:
            index = np.flatnonzero(self.fits(rows, seed))
        return index, rows.times(seed).take(index) if self.bagged else np.ones(len(index), dtype=np.int8)


@dataclass
class Growing:
    """What tasks need to make the rows of trees: the models, without their trees."""

    models: list[Ensemble]

    def slices(self) -> list[slice]:
        ends = np.cumsum([0, *(m.loss.outputs for m in self.models)])
        return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]

    def fits(self, rows: Rows | Drawn, task: Task) -> np.ndarray:
        """Whether a row is drawn for a tree."""
        return rows.own[task.model][0] if isinstance(rows, Drawn) else self.models[task.model].fits(rows, task.seed)

    def drawn(self, rows: Rows | Drawn, task: Task, index: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows drawn for a tree (or those of them at `index`): which, with their targets (for squared error what the scores leave
        of them), weights and scores."""
        if isinstance(rows, Drawn):
            fits, *given = rows.own[task.model]
            index = np.flatnonzero(fits) if index is None else index
            return index, *(c.take(index, axis=0) for c in given)
        model = self.models[task.model]
        index, times = model.drawn(rows, task.seed, index)
        y, score = rows.y[index], np.zeros((len(index), 0))
        if isinstance(model.loss, Squared) and not model.bagged:
            y = y - rows.score[:, self.slices()[task.model]][index, 0]  # all that its gradients need
        elif not model.bagged:
            score = rows.score[index, self.slices()[task.model]]
        return index, y, rows.w[index] * times if model.weighted else times, score

    def round(self, rows: Rows, tasks: list[Task]) -> Drawn:
        """What the passes of a round need of a block: one task a model, none of them bagged."""
        fits = {task.model: self.fits(rows, task) for task in tasks}
        index = np.flatnonzero(np.logical_or.reduce(list(fits.values())))
        own, y = {}, rows.y.take(index)
        for task in tasks:
            _, left, w, score = self.drawn(rows, task, index)
            own[task.model] = fits[task.model].take(index), left if not score.shape[1] else y, w, score
        return Drawn(rows.id, rows.x.take(index, axis=0), own)

    def sums(self, y: np.ndarray, w: np.ndarray, score: np.ndarray, task: Task) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and weights of drawn rows."""
        model = self.models[task.model]
        return model.loss.sums(y, w.astype(np.float64), score if score.shape[1] else np.zeros((len(y), model.loss.outputs)))

    def subtree_sums(self, y: np.ndarray, w: np.ndarray, score: np.ndarray, task: Task):
        """As above, for `grow_subtree`: of many rows that vote, not by columns."""
        loss = self.models[task.model].loss
        return loss.shares(y, w.astype(np.float64)) if isinstance(loss, Votes) and len(y) > PICKED_ROWS else self.sums(y, w, score, task)


def _small(models: list[Ensemble]) -> list[Ensemble]:
    return [replace(m, done=[]) for m in models]


def _by_task(wanted: list[tuple], trees: list[Tree | None]) -> dict[int, tuple[list[int], np.ndarray]]:
    """Of the wanted nodes (group, task, place), per task: the groups, and for each node of its tree so far which of them it is (-1: none)."""
    found: dict[int, list[tuple]] = {}
    for group, t, place in wanted:
        found.setdefault(t, []).append((place, group))
    told = {}
    for t, nodes in found.items():
        places, groups = (list(c) for c in zip(*nodes))
        which = np.full(1 if trees[t] is None else len(trees[t].place), -1)
        which[[0] if trees[t] is None else np.searchsorted(trees[t].place, places)] = np.arange(len(places))
        told[t] = groups, which
    return told


def _wanted_rows(growing: Growing, rows: Rows | Drawn, task: Task, tree: Tree | None, which: np.ndarray):
    """The bins, targets, weights and scores of the rows drawn for a tree that are in a wanted node, and in which."""
    index, *given = growing.drawn(rows, task)
    x = rows.x.take(index, axis=0)
    if tree is None:
        return x, *given, np.zeros(len(index), dtype=np.int64)
    node = which.take(tree.nodes(x))
    of = np.flatnonzero(node >= 0)
    return x.take(of, axis=0), *(c.take(of, axis=0) for c in given), node.take(of)


def _rows_in(growing: Growing, rows: Rows | Drawn, task: Task, ranges: list[np.ndarray], columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows drawn for a tree that are in its nodes of the given ranges of bins, in their order, and in which.

    `columns` are the block's bins by feature: few bins are bytes, of which many are compared at once."""
    fits, found = growing.fits(rows, task), []
    for least, most in ranges:
        inside = fits
        for f in np.flatnonzero(least > 0):
            inside = inside & (columns[f] >= columns[f].dtype.type(least[f]))
        for f in np.flatnonzero(most < _TOP):
            inside = inside & (columns[f] <= columns[f].dtype.type(most[f]))
        found.append(np.flatnonzero(inside))
    return np.concatenate(found), np.repeat(np.arange(len(found)), [len(of) for of in found])


#: Above any bin.
_TOP = 1 << 16


def _half(ranges: np.ndarray, feature: int, cut: int, right: bool) -> np.ndarray:
    """The ranges of bins of a child of a node."""
    own = ranges.copy()
    own[1 - right, feature] = cut + 1 if right else cut
    return own


def _places(wanted: list[tuple]) -> dict[int, np.ndarray]:
    """The places of the wanted nodes (task, place) by task."""
    found: dict[int, list[int]] = {}
    for t, place in wanted:
        found.setdefault(t, []).append(place)
    return {t: np.array(own, dtype=np.int64) for t, own in found.items()}


def _part_histograms(growing: Growing, tasks: list[Task], ranges: dict, wanted: list[tuple], columns: int, bins: int):
    """Sums by (node, bin) over the rows of a partition, by task and feature, of the wanted nodes (task, place) that may be split on it."""

    def run(blocks: Iterator[Rows]) -> Iterator[tuple]:
        held: dict[int, np.ndarray] = {}
        size, by_task = 0, _places(wanted)
        may = {t: _allowed(places, columns, tasks[t]) for t, places in by_task.items()}
        own_ranges = {t: [ranges[t, int(place)] for place in places] for t, places in by_task.items()}
        for rows in blocks:
            cells_of = [np.ascontiguousarray(c) for c in rows.x.T]
            for t in by_task:
                index, node = _rows_in(growing, rows, tasks[t], own_ranges[t], cells_of)
                if not len(node):
                    continue
                _, y, w, score = growing.drawn(rows, tasks[t], index)
                g, h = growing.sums(y, w, score, tasks[t])
                sums = [np.ascontiguousarray(c) for c in (*g.T, *h.T)]
                alike = h.shape[1] == 1 and bool((sums[-1] == 1.0).all())  # the weights' sums are the rows' numbers
                begin = node * bins
                for f in np.flatnonzero(may[t].any(axis=0)):
                    own, at, columns_, value = may[t][:, f], begin, sums, cells_of[f].take(index)
                    if not own.all():
                        of = np.flatnonzero(own.take(node))
                        at, columns_, value = (np.cumsum(own) - 1).take(node.take(of)) * bins, [c.take(of) for c in sums], value.take(of)
                    cells = int(own.sum()) * bins
                    cell = at + value
                    rows_ = np.bincount(cell, minlength=cells).astype(np.float64)
                    weighted = [np.bincount(cell, c, cells) for c in (columns_[:-1] if alike else columns_)]
                    told = np.stack([*weighted, *([rows_] if alike else []), rows_], axis=1).reshape(-1, bins, len(sums) + 1)
                    key = t * columns + int(f)
                    if key in held:
                        held[key] += told
                    else:
                        held[key] = told
                        size += told.nbytes
                if size > HELD_BYTES:
                    yield from held.items()
                    held, size = {}, 0
        yield from held.items()

    return run


def _split_nodes(tasks: list[Task], outputs: list[int], columns: int):
    """(task, feature, best cuts) by the partial histograms of a task and feature."""

    def run(given: Iterator[tuple]) -> Iterator[tuple]:
        parts: dict[int, np.ndarray] = {}
        for key, histogram in given:
            parts[key] = parts[key] + histogram if key in parts else histogram
        for key, histogram in parts.items():
            t, f = divmod(key, columns)
            yield t, f, _search(histogram, tasks[t], outputs[t])

    return run


def _local_rows(growing: Growing, tasks: list[Task], trees: list[Tree | None], wanted: list[tuple], bins: int, ranges: dict = {}):
    """The rows of the wanted nodes (group, task, place) with their block's id, by group. Few nodes are found by their `ranges`."""

    def run(blocks: Iterator[Rows]) -> Iterator[tuple]:
        by_task, places = _by_task(wanted, trees), {group: place for group, _, place in wanted}
        for rows in blocks:
            cells_of = [np.ascontiguousarray(c) for c in rows.x.T]
            for t, (groups, which) in by_task.items():
                if trees[t] is not None and len(groups) <= RANGED_NODES:
                    index, node = _rows_in(growing, rows, tasks[t], [ranges[t, places[group]] for group in groups], cells_of)
                    given = [c.take(index, axis=0) if c is rows.x else c for c in (rows.x, *growing.drawn(rows, tasks[t], index)[1:])]
                    given[0] = given[0].astype(np.uint8, copy=False) if bins <= 256 else given[0]
                    ends = np.cumsum(np.bincount(node, minlength=len(groups)))
                    for group, a, b in zip(groups, np.append(0, ends[:-1]), ends):
                        if a < b:
                            yield group, (rows.id, *(c[a:b].copy() for c in given))
                    continue
                *given, node = _wanted_rows(growing, rows, tasks[t], trees[t], which)
                given[0] = given[0].astype(np.uint8, copy=False) if bins <= 256 else given[0]
                if trees[t] is None:  # all of them, in the root
                    if len(node):
                        yield groups[0], (rows.id, *given)
                    continue
                order = np.argsort(node, kind="stable")
                ends = np.cumsum(np.bincount(node, minlength=len(groups)))
                given = [c.take(order, axis=0) for c in given]
                for group, a, b in zip(groups, np.append(0, ends[:-1]), ends):
                    if a < b:
                        yield group, (rows.id, *(c[a:b].copy() for c in given))

    return run


def _subtrees(growing: Growing, tasks: list[Task], groups: list[tuple]):
    """(task, nodes) of every group's subtree, by its rows."""

    def run(given: Iterator[tuple]) -> Iterator[tuple]:
        parts: dict[int, list[tuple]] = {}
        for group, cells in given:
            parts.setdefault(group, []).append(cells)
        while parts:
            group, own = parts.popitem()
            own.sort(key=lambda cells: cells[0])  # sums are added in the same order whatever the partitions
            x, y, w, score = (np.concatenate(column) for column in list(zip(*own))[1:])
            t, place = groups[group]
            nodes = grow_subtree(x, *growing.subtree_sums(y, w, score, tasks[t]), place, tasks[t])
            yield t, nodes | {"feature": nodes["feature"].astype(np.int16), "cut": nodes["cut"].astype(np.uint16)}

    return run


def _own_number(key: int) -> int:
    return key


def _tree(nodes: dict[str, np.ndarray], value) -> Tree:
    order = np.argsort(nodes["place"])
    place, feature, cut, gain = (nodes[n][order] for n in ("place", "feature", "cut", "gain"))
    leaf = feature < 0
    left = np.where(leaf, np.cumsum(leaf) - 1, np.searchsorted(place, 2 * place))
    place = place.astype(np.int32) if place[-1] < 1 << 31 else place
    return Tree(place, feature.astype(np.int16), cut.astype(np.uint16), gain, left.astype(np.int32), value(nodes["sums"][order[leaf]]))


class Table:
    """The training rows: binned features, target, weight, part, and a score for every output of every model."""

    def __init__(self, blocks: DataFrame, columns: int, bins: int, total: int, partitions: int):
        self.spark = blocks.sparkSession
        self.columns, self.bins, self.total, self.partitions = columns, bins, total, partitions
        self.width = max(partitions, self.spark.sparkContext.defaultParallelism)
        self.rows = stage(blocks, "tree-rows").rdd.map(lambda row: _block(row, columns)).persist(StorageLevel.MEMORY_AND_DISK)
        self.before: RDD | None = None  # what the rows are made from by the next pass
        self.unwritten = 0
        self.path: str | None = None  # of the table as last written

    def add(self, growing: Growing, trees: list[list[Tree]]) -> None:
        """Add the trees' values to the models' scores."""
        slices = growing.slices()

        def added(rows: Rows) -> Rows:
            score = rows.score.copy()
            for own, of in zip(trees, slices):
                for tree in own:
                    score[:, of] += tree.values(tree.nodes(rows.x))
            return replace(rows, score=score)

        before, self.rows = self.rows, self.rows.map(added)
        self.unwritten += 1
        if self.unwritten >= PENDING:
            path, self.rows = stage_objects(self.rows, self.spark, "tree-rows")
            before.unpersist()
            if self.path is not None:
                remove(self.spark, self.path)
            self.path, self.unwritten = path, 0
        else:
            self.before = before
        self.rows.persist(StorageLevel.MEMORY_AND_DISK)

    def _made(self) -> None:
        """A pass has brought the rows up to date."""
        if self.before is not None:
            self.before.unpersist()
            self.before = None

    def grow(self, growing: Growing, tasks: list[Task]) -> list[dict[str, np.ndarray]]:
        """The nodes of one tree per task, grown side by side."""
        nodes: list[list[dict]] = [[] for _ in tasks]
        trees: list[Tree | None] = [None] * len(tasks)
        cores = self.spark.sparkContext.defaultParallelism
        forest = all(growing.models[t.model].bagged for t in tasks) and 4 * len(tasks) >= 3 * cores
        most = LOCAL_ROWS * (FOREST_FACTOR if forest else 1)
        big = [(t, 1) for t in range(len(tasks))] if self.total > most else []  # task, place
        local = [] if big else [(t, 1, self.total) for t in range(len(tasks))]  # task, place, rows
        whole = np.stack([np.zeros(self.columns, dtype=np.int64), np.full(self.columns, _TOP)])
        ranges = {(t, 1): whole for t in range(len(tasks))}  # bins of a node's rows by feature, of the nodes still to grow
        rows = self.rows
        is_round = bool(big) and not any(growing.models[t.model].bagged for t in tasks)
        if is_round:  # its passes read the drawn rows alone
            rows = rows.map(lambda block: growing.round(block, tasks)).persist(StorageLevel.MEMORY_AND_DISK)
        above: dict[tuple[int, int], np.ndarray] = {}  # histograms of the last level's nodes with children to split
        count: dict[tuple[int, int], float] = {}
        while big:
            found, below = self._level(rows, growing, tasks, ranges, big, above, count)
            big, above = [], {}
            for t, place, feature, cut, gain, left, total in found:
                nodes[t].append({"place": [place], "feature": [feature], "cut": [cut], "gain": [gain], "sums": [total]})
                if feature < 0:
                    continue
                for child, sums in ((2 * place, left), (2 * place + 1, total - left)):
                    ranges[t, child], count[t, child] = _half(ranges[t, place], feature, cut, bool(child & 1)), sums[-1]
                    if not _is_open(child, sums, tasks[t].growth):
                        nodes[t].append({"place": [child], "feature": [-1], "cut": [0], "gain": [0.0], "sums": [sums]})
                    elif sums[-1] > most:
                        big.append((t, child))
                        if (t, place) in below:
                            above[t, place] = below[t, place]
                    else:
                        local.append((t, child, sums[-1]))
        if local:
            local.sort(key=lambda node: -node[2])  # like sizes to a task each
            wanted = [(i, t, place) for i, (t, place, _) in enumerate(local)]
            ends = _places([(t, place) for t, place, _ in local])
            trees = [self._partial(nodes[t], ends[t].tolist()) if t in ends else None for t in range(len(tasks))]
            held = 2 * LOCAL_ROWS  # rows that a task should hold
            least = self.width * (4 if forest else 1)  # trees of a forest differ in size, so tasks of few level the work
            width = min(len(local), max(least, math.ceil(sum(n for _, _, n in local) / held)))
            told = {(t, place): ranges[t, place] for t, place, _ in local}
            dealt = rows.mapPartitions(_local_rows(growing, tasks, trees, wanted, self.bins, told)).partitionBy(width, _own_number)
            for t, own in dealt.mapPartitions(_subtrees(growing, tasks, [(t, place) for t, place, _ in local])).collect():
                nodes[t].append(own)
            _remove_shuffled(dealt)
            self._made()
        if is_round:
            rows.unpersist()
        return [
            {n: np.concatenate([np.asarray(part[n]) for part in own]) for n in ("place", "feature", "cut", "gain", "sums")} if own else {}
            for own in nodes
        ]

    @staticmethod
    def _partial(found: list[dict], ends: list[int]) -> Tree | None:
        """The tree so far, with the nodes still to grow as its leaves."""
        if not found:
            return None
        joined = {n: np.concatenate([np.asarray(part[n]) for part in found]) for n in ("place", "feature", "cut", "gain")}
        more = np.array(sorted(ends), dtype=np.int64)
        joined = {n: np.concatenate([c, more if n == "place" else np.full(len(more), -1 if n == "feature" else 0)]) for n, c in joined.items()}
        return _tree(joined | {"sums": joined["gain"][:, None]}, lambda sums: sums)

    def _level(self, rows: RDD, growing: Growing, tasks: list[Task], ranges: dict, big: list[tuple], above: dict, count: dict) -> tuple[list[tuple], dict]:
        """The nodes (task, place) with their best splits: task, place, feature, cut, gain, sums of the left child and of the node;
        and the nodes' histograms, where the driver has added them up.

        Of two children of a node whose histogram is in `above` the one of fewer rows is summed, the other is the parent's
        sums less those."""
        outputs = [growing.models[t.model].loss.outputs for t in tasks]
        beside = {  # taken, not summed
            (t, place) for t, place in big
            if (t, place >> 1) in above and count[t, place] > SUMMED_ROWS and (count[t, place], place ^ 1) > (count[t, place ^ 1], place)
        }
        summed = sorted(set(big) - beside | {(t, place ^ 1) for t, place in beside})
        places = _places(summed)
        # siblings may be split on the same features where nodes do not draw their own
        may = {t: _allowed(own, self.columns, tasks[t]) for t, own in places.items()}
        told_ranges = {node: ranges[node] for node in summed}
        parts = rows.mapPartitions(_part_histograms(growing, tasks, told_ranges, summed, self.columns, self.bins))
        width = {t: (2 * outputs[t] if isinstance(growing.models[tasks[t].model].loss, Softmax) else outputs[t] + 1) + 1 for t in places}
        held = sum(int(may[t].sum()) * width[t] for t in places) * self.bins * 8 * self.partitions
        if held <= DRIVER_BYTES or beside:
            sums: dict[int, np.ndarray] = {}
            for key, histogram in parts.collect():
                sums[key] = sums[key] + histogram if key in sums else histogram
            self._made()
            return self._searched(tasks, outputs, big, beside, above, places, may, sums)
        parts = parts.partitionBy(min(len(tasks) * self.columns, self.width), _own_number)
        found: dict[tuple[int, int], tuple] = {}
        told = parts.mapPartitions(_split_nodes(tasks, outputs, self.columns)).collect()
        _remove_shuffled(parts)
        self._made()
        for t, f, cuts in sorted(told, key=lambda r: r[:2]):
            for place, *cut in zip(places[t][may[t][:, f]].tolist(), *cuts):
                _better(found, tasks[t], outputs[t], t, place, f, *cut)
        return [(*node, *split) for node, split in found.items()], {}

    def _searched(self, tasks, outputs, big, beside, above, places, may, sums) -> tuple[list[tuple], dict]:
        """As `_level`, by the sums of the summed nodes by task and feature."""
        found: dict[tuple[int, int], tuple] = {}
        histograms: dict[tuple[int, int], dict[int, np.ndarray]] = {}
        for key in sorted(sums):
            t, f = divmod(key, self.columns)
            for place, own in zip(places[t][may[t][:, f]].tolist(), sums[key]):
                histograms.setdefault((t, place), {})[f] = own
        for t, place in beside:
            fewer, own = histograms.get((t, place ^ 1), {}), {}
            for f, whole in above[t, place >> 1].items():
                own[f] = whole - fewer[f] if f in fewer else whole.copy()
                own[f][own[f][..., -1] == 0] = 0.0  # no rounding where there are no rows, so cuts there are equal
            histograms[t, place] = own
        for t, place in big:
            for f, own in sorted(histograms.get((t, place), {}).items()):
                _better(found, tasks[t], outputs[t], t, place, f, *(c[0] for c in _search(own[None], tasks[t], outputs[t])))
        kept = {node: own for node, own in histograms.items() if tasks[node[0]].growth.node_columns is None}
        return [(*node, *split) for node, split in found.items()], kept


def _better(found: dict, task: Task, k: int, t: int, place: int, f: int, gain: float, cut: int, left: np.ndarray, total: np.ndarray) -> None:
    """Note the best cut of a node on a feature, if it betters those on the features before."""
    if not total[-1]:
        return
    least = LEAST_GAIN * (1.0 + abs(task.growth.gain(total[:k], total[k:-1])))
    before = found.setdefault((t, place), (-1, 0, 0.0, total, total))
    if gain > max(before[2], least) and _is_open(place, total, task.growth):
        found[t, place] = f, int(cut), float(gain), left, total


def _remove_shuffled(rdd: RDD) -> None:
    """Remove what was shuffled for an RDD that is not read again; else its files stay until the driver collects its garbage."""
    rdd._jrdd.rdd().cleanShuffleDependencies(False)


def train(table: Table, models: list[Ensemble]) -> None:
    """Grow the models' trees. Rounds of boosting follow each other, with all models in the same passes; the trees of
    forests are grown many at a time. Their values end up in the table's scores."""
    remove_unreachable(table.spark)  # what the preparation and the rows were shuffled by, which the passes come on top of
    growing = Growing(_small(models))
    boosted = [i for i, m in enumerate(models) if not m.bagged]
    for number in range(max((models[i].trees for i in boosted), default=0)):
        _grow_some(table, models, growing, [(i, number) for i in boosted if number < models[i].trees])
    bagged = [(i, number) for i, m in enumerate(models) if m.bagged for number in range(m.trees)]
    while bagged:
        taken = _passes(bagged, models, table.total, table.spark.sparkContext.defaultParallelism)
        _grow_some(table, models, growing, bagged[:taken])
        bagged = bagged[taken:]


def _passes(bagged: list[tuple[int, int]], models: list[Ensemble], total: int, cores: int) -> int:
    """How many of the trees (model, number) are grown in the next pass: one at least."""
    most = PASS_NODES, PASS_VALUES, max(PASS_TABLES * total, cores * LOCAL_ROWS * FOREST_FACTOR)
    used = [0, 0, 0]
    for taken, (i, _) in enumerate(bagged):
        nodes = min(2 << models[i].growth.depth, 2 * total + 1)
        used = [a + b for a, b in zip(used, (nodes, nodes * models[i].loss.outputs, math.ceil(total * (1.0 - _POISSON[0]))))]
        if taken and any(a > b for a, b in zip(used, most)):
            return taken
    return len(bagged)


def _grow_some(table: Table, models: list[Ensemble], growing: Growing, wanted: list[tuple[int, int]]) -> None:
    tasks = [Task(i, models[i].seed * 1_000_003 + number, models[i].growth) for i, number in wanted]
    grown: list[list[Tree]] = [[] for _ in models]
    for task, nodes in zip(tasks, table.grow(growing, tasks)):
        model = models[task.model]
        k = model.loss.outputs
        factor = model.rate / model.trees if model.bagged else model.rate
        if not nodes:  # no row was drawn: a leaf of value 0
            nodes = {"place": np.ones(1, np.int64), "feature": np.full(1, -1), "cut": np.zeros(1, np.int64), "gain": np.zeros(1), "sums": np.zeros((1, 2 * k + 1))}
        most = model.growth.most
        tree = _tree(nodes, lambda sums: np.clip(model.growth.value(sums[:, :k], sums[:, k:-1]), -most, most) * factor)
        model.done.append(tree)
        grown[task.model].append(tree)
    table.add(growing, grown)


def importance(trees: list[Tree], columns: int) -> np.ndarray:
    """Share of the gain of each feature, of every tree alike."""
    total = np.zeros(columns)
    for tree in trees:
        own = np.bincount(np.maximum(tree.feature, 0), np.where(tree.feature >= 0, tree.gain, 0.0), columns)
        if own.sum() > 0:
            total += own / own.sum()
    return total / total.sum() if total.sum() > 0 else total


# ---------------------------------------------------------------- binning


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of at most `bins` bins per feature, at its quantiles; few distinct values have a bin each."""
    ranks = [i / bins for i in range(1, bins)] + [1.0]
    found = rows.agg(*[F.percentile_approx(F.col(f).cast("double"), ranks, 100 * bins).alias(f) for f in features]).first()
    return [np.unique(np.array(found[f] or [0.0], dtype=np.float64)) for f in features]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(values.shape, dtype=np.uint16)
    for f, edge in enumerate(edges):
        out[:, f] = np.searchsorted(edge[:-1], values[:, f])
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Batches of BLOCK_ROWS rows together, or more by less than a batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= BLOCK_ROWS:
            yield held
            held = []
    if held:
        yield held


def training_table(rows: DataFrame, features: list[str], edges: list[np.ndarray], base: list[float]) -> Table:
    """`rows` has key (long), the features, y, w and part; every row starts with the scores `base`."""
    narrow = max(len(e) for e in edges) <= 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for number, block in enumerate(_blocks(batches)):
            key, y, w, part, *columns = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in block]) for i in range(block[0].num_columns))
            score = np.tile(np.array(base, dtype=np.float64), (len(key), 1))
            x = binned(np.stack(columns, axis=1), edges)
            cells = [key.view(np.uint64), x.astype(np.uint8) if narrow else x, y, w, part, score]
            yield pa.RecordBatch.from_arrays(
                [pa.array([first + number], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)],
                names=[c.split()[0] for c in _BLOCKS.split(", ")],
            )

    given = rows.select("key", F.col("y").cast("double"), F.col("w").cast("double"), F.col("part").cast("int"), *[F.col(f).cast("double") for f in features])
    total = given.count()
    cores = rows.sparkSession.sparkContext.defaultParallelism
    partitions = max(1, min(cores * max(1, -(-total // (cores * MOST_ROWS))), -(-total // LEAST_ROWS)))  # alike for every core
    # keys are hashes: equal ranges of them are equal shares, in the order that the subtrees' sums are added in
    share = F.shiftright(F.shiftrightunsigned("key", 33) * F.lit(partitions), 31).cast("int")
    placed = given.repartitionById(partitions, share).sortWithinPartitions(F.col("key") < 0, "key")
    return Table(placed.mapInArrow(run, _BLOCKS), len(features), max(len(e) for e in edges), total, partitions)


def scores(table: Table, outputs: list[int]) -> DataFrame:
    """key, y, part and the scores of each model as an array column score_0, score_1, ..."""
    ends = np.cumsum([0, *outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, y, part, score in zip(*(c.to_pylist() for c in batch.columns)):
                score = np.frombuffer(score).reshape(len(key) // 8, -1)
                cells = []
                for a, b in zip(ends[:-1], ends[1:]):
                    own = np.ascontiguousarray(score[:, a:b]).ravel()
                    cells.append(pa.ListArray.from_arrays(pa.array(np.arange(len(score) + 1, dtype=np.int32) * (b - a)), pa.array(own)))
                names = ["key", "y", "part", *[f"score_{i}" for i in range(len(outputs))]]
                told = [pa.array(np.frombuffer(key, np.int64)), pa.array(np.frombuffer(y)), pa.array(np.frombuffer(part, np.int32))]
                yield pa.RecordBatch.from_arrays([*told, *cells], names=names)

    packed = table.rows.map(lambda rows: tuple(np.ascontiguousarray(c).tobytes() for c in (rows.key, rows.y, rows.part, rows.score)))
    blocks = table.spark.createDataFrame(packed, "key binary, y binary, part binary, score binary")
    return blocks.mapInArrow(run, "key long, y double, part int, " + ", ".join(f"score_{i} array<double>" for i in range(len(outputs))))


# ---------------------------------------------------------------- trained models


@dataclass
class TreeModel:
    """Trees with thresholds in place of bins, added up (`squared`, `votes`) or passed through a softmax."""

    kind: str
    features: list[str]
    base: list[float]
    trees: list[Tree]
    thresholds: list[np.ndarray]

    @classmethod
    def of(cls, model: Ensemble, features: list[str], edges: list[np.ndarray]) -> TreeModel:
        kind = {Squared: "squared", Softmax: "softmax", Votes: "votes"}[type(model.loss)]
        at = np.zeros((len(edges) + 1, max((len(e) for e in edges), default=0) + 1))  # the last row is that of leaves
        for f, edge in enumerate(edges):
            at[f, :len(edge)] = edge
        return cls(kind, features, model.base, model.done, [at[t.feature, np.where(t.feature < 0, 0, t.cut)] for t in model.done])

    @property
    def importances(self) -> np.ndarray:
        return importance(self.trees, len(self.features))

    def parts(self) -> Iterator[tuple[int, list[tuple]]]:
        """The trees in parts of at most PART_BYTES (or one tree), with the number of the first."""
        first, held, size = 0, [], 0
        for tree, cut in zip(self.trees, self.thresholds):
            own = cut.nbytes + tree.feature.nbytes + tree.left.nbytes + tree.value.nbytes
            if held and size + own > PART_BYTES:
                yield first, held
                first, held, size = first + len(held), [], 0
            held.append((tree, cut))
            size += own
        if held:
            yield first, held

    def outputs(self, values: np.ndarray, parts: Iterator[list[tuple]] | None = None) -> np.ndarray:
        """Outputs of the rows by the trees, or by those of `parts` (feature, left, value, threshold)."""
        total = np.tile(np.array(self.base, dtype=np.float64), (len(values), 1))
        for part in parts or (_scored(own) for _, own in self.parts()):
            for feature, left, value, cut in part:
                node = np.zeros(len(values), dtype=np.int64)
                row = np.arange(len(values)) if feature[0] >= 0 else np.zeros(0, dtype=np.int64)
                while len(row):
                    at = node[row]
                    node[row] = at = left[at] + (values[row, feature[at]] > cut[at])
                    row = row[feature[at] >= 0]
                total += value[left[node]]
        if self.kind == "softmax":
            total = np.exp(total - total.max(axis=1, keepdims=True))
        if self.kind != "squared":
            whole = total.sum(axis=1, keepdims=True)
            total = np.where(whole > 0, total / np.where(whole > 0, whole, 1.0), 1.0 / total.shape[1])
        return total

    def transform(self, df: DataFrame) -> DataFrame:
        """`df` with prediction, and for classes with the array of their probabilities.

        The trees are sent in parts, of which a task holds one at a time where there are several, for many rows at once."""
        context = df.sparkSession.sparkContext
        bare = replace(self, trees=[], thresholds=[])
        sent = [context.broadcast(_scored(own)) for _, own in self.parts()]
        width = len(self.features)

        @F.pandas_udf("array<double>")
        def scored(given: Iterator[pd.Series]) -> Iterator[pd.Series]:
            def told(held: list[np.ndarray]) -> Iterator[pd.Series]:
                parts = (part.value if len(sent) == 1 or hasattr(part, "_value") else part.load_from_path(part._path) for part in sent)
                out = bare.outputs(np.concatenate(held), parts)
                for own in np.split(out, np.cumsum([len(h) for h in held])[:-1]):
                    yield pd.Series(list(own))

            held: list[np.ndarray] = []
            for values in given:
                held.append(np.stack(values.to_numpy()) if len(values) else np.zeros((0, width)))
                if len(sent) < 2 or sum(len(h) for h in held) >= SCORED_ROWS:
                    yield from told(held)
                    held = []
            if held:
                yield from told(held)

        out = scored(F.array(*[F.col(f).cast("double") for f in self.features]))
        if self.kind == "squared":
            return df.withColumn("prediction", out[0])
        best = F.array_position("probability", F.array_max("probability")) - 1
        return df.withColumn("probability", out).withColumn("prediction", best.cast("double"))

    def tables(self, spark: SparkSession) -> Iterator[DataFrame]:
        """One row a tree, and one (tree -1) with what all share, in tables of a part of the trees each; `from_table` reads them."""
        yield spark.createDataFrame([(-1, self.kind, self.features, [], [], [], [], self.base)], TREES_SCHEMA)
        for first, part in self.parts():
            lists = [[t.feature.astype(np.int32), cut, t.left, t.gain, t.value.ravel()] for t, cut in part]
            cells = [
                pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(c) for c in own)]), pa.int32()), pa.array(np.concatenate(own)))
                for own in zip(*lists)
            ]
            shared = [pa.array(np.arange(first, first + len(part)), pa.int32()), pa.array([""] * len(part)), pa.array([[]] * len(part), pa.list_(pa.string()))]
            yield spark.createDataFrame(pa.table([*shared, *cells], names=[c.split()[0] for c in TREES_SCHEMA.split(", ")]), TREES_SCHEMA)

    def table(self, spark: SparkSession) -> DataFrame:
        return reduce(DataFrame.unionByName, self.tables(spark))

    def write(self, spark: SparkSession, path: str) -> None:
        """Write the model's table, a part of the trees at a time: a task is sent no more than that."""
        for part in self.tables(spark):
            part.coalesce(1).write.mode("append").parquet(path)

    @classmethod
    def from_table(cls, rows: DataFrame) -> TreeModel:
        shared = rows.where("tree < 0").first()
        k, made = len(shared["value"]), {}
        packed = rows.where("tree >= 0").select("tree", "feature", "threshold", "left", "gain", "value").mapInArrow(
            _packed, "tree int, feature binary, threshold binary, left binary, gain binary, value binary"
        )
        for number, *cells in packed.toLocalIterator():  # a part at a time, whatever their bytes together
            feature, cut, left, gain, value = (np.frombuffer(c, t) for c, t in zip(cells, (np.int32, np.float64, np.int32, np.float64, np.float64)))
            value, leaf = value.reshape(-1, k), feature < 0
            if len(value) == len(feature):  # with values of all nodes, as once written
                value, left = value[leaf], np.where(leaf, np.cumsum(leaf) - 1, left).astype(np.int32)
            none = np.zeros(len(feature), dtype=np.uint16)
            made[number] = Tree(none, feature.astype(np.int16), none, gain, left, value), cut
        ordered = [made[number] for number in sorted(made)]
        return cls(shared["kind"], list(shared["features"]), list(shared["value"]), [t for t, _ in ordered], [cut for _, cut in ordered])


def _scored(part: list[tuple]) -> list[tuple]:
    """What scoring reads of trees and their thresholds."""
    return [(t.feature, t.left, t.value, cut) for t, cut in part]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays as bytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            cells = [pa.array([c[i].values.to_numpy(zero_copy_only=False).tobytes()], pa.binary()) for c in batch.columns[1:]]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *cells], names=batch.schema.names)


TREES_SCHEMA = (
    "tree int, kind string, features array<string>, feature array<int>, threshold array<double>, left array<int>, "
    "gain array<double>, value array<double>"
)
