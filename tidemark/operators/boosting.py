"""The learner's work on batches of rows, without Spark: where features are cut, cells, and trees over them.

To a learner that cuts each feature into a few bins, rows of the same bins are one. A cell is such a
combination of bins with its rows of either class. All sums are sums of whole numbers, so they do not
depend on how rows and cells lie or on the order in which tasks end.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

Batches = Iterable[pa.RecordBatch]

# The first ranges of values agree in sign, exponent and two more bits; a range is cut into so many finer
# ones while it holds more than one in so many of the rows of a bin.
FIRST_BITS = 14
FINER = 64
SHARE = 8

WORD_BITS = 62

# The cut of a node that is not split: its rows all go left.
NEVER = 1 << 30

_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def ordered(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; 0 and -0 are one."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & _MOST)


def unordered(keys: np.ndarray) -> np.ndarray:
    return (keys ^ ((keys >> 63) & _MOST)).view(np.float64)


def by_feature(column: pa.ListArray) -> np.ndarray:
    """A batch's arrays as one row per feature."""
    return np.ascontiguousarray(column.flatten().to_numpy().reshape(len(column), -1).T)


# --- Ranges of values, and the cuts between them ---


def first_starts() -> np.ndarray:
    half = 1 << (FIRST_BITS - 1)
    return np.arange(-half, half) << (64 - FIRST_BITS)


def range_counter(starts: list[np.ndarray]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A function that counts rows by feature and range, with the least and the largest key in it.

    A range goes from its start up to the next one; of a feature without starts nothing is counted.
    """

    def count(batches: Batches) -> Iterator[pa.RecordBatch]:
        found = [(np.zeros(len(s), np.int64), np.full(len(s), _MOST), np.full(len(s), _LEAST)) for s in starts]
        for batch in batches:
            if not batch.num_rows:
                continue
            for values, start, (n, low, high) in zip(by_feature(batch.column(0)), starts, found, strict=True):
                if not len(start):
                    continue
                keys = np.sort(ordered(values))
                keys = keys[np.searchsorted(keys, start[0]) :]
                if not len(keys):
                    continue
                at = np.searchsorted(start, keys, side="right") - 1
                begin = np.flatnonzero(np.diff(at, prepend=-1))
                end = np.append(begin[1:], len(at))
                at = at[begin]
                n[at] += end - begin
                low[at] = np.minimum(low[at], keys[begin])
                high[at] = np.maximum(high[at], keys[end - 1])
        for feature, (n, low, high) in enumerate(found):
            at = np.flatnonzero(n)
            columns = [np.full(len(at), feature, np.int32), at, n[at], low[at], high[at]]
            names = ["feature", "at", "n", "low", "high"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return count


def finer_starts(ranges: np.ndarray, bins: int) -> np.ndarray:
    """Starts of finer ranges inside those of ``n, low, high`` that hold too many rows.

    Where a feature has no more ranges than bins, each must be of one value. The key after a range
    that is cut is a start too, and what is counted there is not used.
    """
    starts: set[int] = set()
    for low, high in ranges[_wide(ranges, bins), 1:].tolist():
        starts.update(range(low, high + 1, -(-(high - low + 1) // FINER)))
        if high < _MOST:
            starts.add(high + 1)
    return np.array(sorted(starts), np.int64)


def _wide(ranges: np.ndarray, bins: int) -> np.ndarray:
    n, low, high = ranges.T
    return (low < high) & ((n * (SHARE * bins) > n.sum()) | (len(n) <= bins))


def refined(ranges: np.ndarray, bins: int, starts: np.ndarray, at: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """The ranges, with what was counted by ``finer_starts`` in place of those that were cut."""
    wide = _wide(ranges, bins)
    cut, begin = ranges[wide], starts[at]
    own = np.searchsorted(cut[:, 1], begin, side="right") - 1
    merged = np.concatenate([ranges[~wide], counted[begin <= cut[own, 2]]])
    return merged[np.argsort(merged[:, 1])]


def cuts_of(ranges: np.ndarray, bins: int) -> np.ndarray:
    """At most ``bins - 1`` values to compare a feature with: between all its ranges, or at even counts."""
    n, low, high = ranges.T
    if len(n) <= bins:
        at = np.arange(len(n) - 1)
    else:
        upto = np.cumsum(n)[:-1]
        wanted = np.arange(1, bins) * (n.sum() / bins)
        right = np.searchsorted(upto, wanted).clip(0, len(upto) - 1)
        left = (right - 1).clip(0)
        at = np.unique(np.where(wanted - upto[left] <= upto[right] - wanted, left, right))
    below, above = unordered(high[at]), unordered(low[at + 1])
    middle = below / 2 + above / 2
    return np.where((below <= middle) & (middle < above), middle, below)


# --- Cells ---


@dataclass(frozen=True)
class Layout:
    """Where the bin of each feature is in a cell's words, and the number of bins."""

    word: list[int]
    shift: list[int]
    bits: list[int]
    bins: int

    @classmethod
    def of(cls, cuts: list[np.ndarray]) -> Layout:
        word, shift, bits = [], [], [len(c).bit_length() for c in cuts]
        last, used = 0, 0
        for b in bits:
            if used + b > WORD_BITS:
                last, used = last + 1, 0
            word.append(last)
            shift.append(used)
            used += b
        return cls(word, shift, bits, max([2, *[len(c) + 1 for c in cuts]]))

    @property
    def words(self) -> list[str]:
        return [f"w{i}" for i in range(self.word[-1] + 1)]


def cell_maker(cuts: list[np.ndarray], layout: Layout) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A function that puts the bins of each row into words, next to its class."""

    def make(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.zeros(batch.num_rows, np.int64) for _ in layout.words]
            if batch.num_rows:
                for i, values in enumerate(by_feature(batch.column(0))):
                    words[layout.word[i]] |= np.searchsorted(cuts[i], values) << layout.shift[i]
            columns = [*[pa.array(w) for w in words], batch.column(1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*layout.words, "y"])

    return make


class Cells:
    """Some of the cells in memory, with the score the trees so far give them and their node in the next."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, layout: Layout):
        self.layout = layout
        words = [batch.column(w).to_numpy() for w in layout.words]
        places = zip(layout.word, layout.shift, layout.bits, strict=True)
        self.bins = np.stack([((words[w] >> s) & ((1 << b) - 1)).astype(np.int16) for w, s, b in places])
        self.positives = batch.column("positives").to_numpy().astype(np.float64)
        self.negatives = batch.column("negatives").to_numpy().astype(np.float64)
        self.score = np.array(batch.column("score").to_numpy())
        self.node = np.ones(len(self.score), np.int64)

    def _side(self, tree: Tree, node: int) -> np.ndarray:
        return self.bins[tree.feature[node]] > tree.cut[node]

    def place(self, tree: Tree, level: int) -> None:
        """Find the cells' nodes at a level. Comparing all cells at each node is faster than looking up each cell's."""

        def at(node: int) -> np.ndarray | int:
            if node >= 1 << level:
                return node
            left = at(2 * node)
            return left if tree.cut[node] == NEVER else np.where(self._side(tree, node), at(2 * node + 1), left)

        self.node[:] = at(1)

    def add(self, tree: Tree, weight: float) -> None:
        """Score the cells by a tree."""

        def value(node: int) -> np.ndarray | float:
            if node >= 1 << tree.levels or tree.cut[node] == NEVER:
                return weight * tree.value[node]
            return np.where(self._side(tree, node), value(2 * node + 1), value(2 * node))

        self.score += value(1)

    def histogram(self, level: int, first: bool, squares: bool, scale: float) -> np.ndarray:
        """Rows, sums of what a tree is fitted to and, if asked for, of its squares, by feature, node and bin.

        The first tree is fitted to 2y - 1, a later one to the loss's gradient, 4y / (1 + exp(2yf)) for y
        of 1 and -1. Both sums are whole numbers of units: ``scale`` are 1, and a quarter of it for squares.
        """
        with np.errstate(over="ignore"):
            up = np.float64(1) if first else 4 / (1 + np.exp(2 * self.score))
            down = np.float64(1) if first else 4 / (1 + np.exp(-2 * self.score))
        weights = [self.positives + self.negatives, np.rint((self.positives * up - self.negatives * down) * scale)]
        if squares:
            weights.append(np.rint((self.positives * up**2 + self.negatives * down**2) * (scale / 4)))
        bins, nodes = self.layout.bins, 1 << level
        base = (self.node - nodes) * bins
        sums = np.empty((len(weights), len(self.bins), nodes * bins))
        for i, b in enumerate(self.bins):
            at = base + b
            for k, w in enumerate(weights):
                sums[k, i] = np.bincount(at, w, nodes * bins)
        return sums


# --- Trees ---


@dataclass(frozen=True)
class Tree:
    """A full tree, its nodes in heap order from 1: what they compare, and the rows and sums of each."""

    levels: int
    feature: np.ndarray
    cut: np.ndarray
    rows: np.ndarray
    total: np.ndarray
    squares: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, levels: int) -> Tree:
        n = 2 << levels
        return cls(levels, np.zeros(n, np.int64), np.full(n, NEVER), *[np.zeros(n) for _ in range(4)])

    def grow(self, level: int, sums: np.ndarray, bins: int, scale: float, split: bool = True) -> None:
        """Split the nodes of a level, each by the first of its best splits, and fill in their children.

        A split must leave rows on both sides and lower the squared error.
        """
        nodes = 1 << level
        upto = sums.reshape(len(sums), -1, nodes, bins).cumsum(axis=3)
        upto[1] /= scale
        upto[2:] *= 4 / scale
        for k in range(nodes):
            rows, total = upto[0, :, k], upto[1, :, k]
            left, right = rows[:, :-1], rows[:, -1:] - rows[:, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = total[:, :-1] ** 2 / left + (total[:, -1:] - total[:, :-1]) ** 2 / right
                gain = np.where((left > 0) & (right > 0), gain - total[:, -1:] ** 2 / rows[:, -1:], -np.inf)
            feature, cut = divmod(int(gain.argmax()), bins - 1)
            node = nodes + k
            if split and gain[feature, cut] > 0:
                self.feature[node], self.cut[node] = feature, cut
                end = cut
            else:
                end = bins - 1
            whole, part = upto[:, feature, k, -1], upto[:, feature, k, end]
            for at, found in ((node, whole), (2 * node, part), (2 * node + 1, whole - part)):
                self.rows[at], self.total[at] = found[:2]
                self.value[at] = found[1] / found[0] if found[0] else 0.0
                if len(found) > 2:
                    self.squares[at] = found[2]

    def settle(self) -> None:
        """Squares are counted at the last level; those above are sums of them."""
        for node in range((1 << self.levels - 1) - 1, 0, -1):
            self.squares[node] = self.squares[2 * node] + self.squares[2 * node + 1]


@dataclass(frozen=True)
class Rounds:
    """What the rounds need to know besides the cells."""

    layout: Layout
    rounds: int
    rate: float
    depth: int
    scale: float

    @classmethod
    def over(cls, layout: Layout, rows: int, rounds: int, rate: float, depth: int) -> Rounds:
        """Units are as small as sums over all rows allow: below 2 ** 53, doubles hold whole numbers exactly."""
        return cls(layout, rounds, rate, depth, 2.0 ** (51 - rows.bit_length()))

    def weight(self, tree: int) -> float:
        return self.rate if tree else 1.0

    def run(self, histogram: Callable[[Tree, int, bool, bool], np.ndarray], done: Callable[[Tree], None]) -> list[Tree]:
        """``histogram(tree, level, first, squares)`` sums over all cells; ``done`` is told of every tree."""
        trees, levels = [], max(1, self.depth)
        for i in range(self.rounds):
            tree = Tree.empty(levels)
            for level in range(levels):
                sums = histogram(tree, level, not i, level == levels - 1)
                tree.grow(level, sums, self.layout.bins, self.scale, split=self.depth > 0)
            tree.settle()
            trees.append(tree)
            done(tree)
        return trees


def whole_fit(rounds: Rounds) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A function that has all cells at once and returns the trees, a row for each node."""

    def fit(batches: Batches) -> Iterator[pa.RecordBatch]:
        cells = Cells(pa.Table.from_batches(batches).combine_chunks(), rounds.layout)
        seen = 0

        def histogram(tree: Tree, level: int, first: bool, squares: bool) -> np.ndarray:
            cells.place(tree, level)
            return cells.histogram(level, first, squares, rounds.scale)

        def done(tree: Tree) -> None:
            nonlocal seen
            cells.add(tree, rounds.weight(seen))
            seen += 1

        for i, tree in enumerate(rounds.run(histogram, done)):
            n = len(tree.rows)
            columns = [np.full(n, i), np.arange(n), tree.feature, tree.cut, tree.rows, tree.total, tree.squares]
            names = ["tree", "node", "feature", "cut", "rows", "total", "squares"]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, tree.value]], names=[*names, "value"])

    return fit


TREE_SCHEMA = (
    "tree bigint, node bigint, feature bigint, cut bigint, rows double, total double, squares double, value double"
)


def trees_of(table: pa.Table, levels: int) -> list[Tree]:
    """The trees of ``whole_fit``'s rows."""
    columns = {name: table.column(name).to_numpy() for name in table.column_names}
    order = np.lexsort((columns["node"], columns["tree"]))
    size = 2 << levels
    fields = [columns[f][order].reshape(-1, size) for f in ("feature", "cut", "rows", "total", "squares", "value")]
    return [Tree(levels, *parts) for parts in zip(*fields, strict=True)]


def level_sums(
    rounds: Rounds, before: list[tuple[Tree, float]], tree: Tree, level: int, first: bool, squares: bool
) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A function that sums a task's cells for one level; ``before`` are trees that the stored scores lack."""

    def add_up(batches: Batches) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = Cells(batch, rounds.layout)
            for earlier, weight in before:
                cells.add(earlier, weight)
            cells.place(tree, level)
            found = cells.histogram(level, first, squares, rounds.scale)
            sums = found if sums is None else sums + found
        if sums is not None:
            flat = sums.ravel().astype(np.int64)
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(flat[at])], names=["at", "n"])

    return add_up


def rescored(layout: Layout, trees: list[tuple[Tree, float]]) -> Callable[[Batches], Iterator[pa.RecordBatch]]:
    """A function that adds trees to the stored scores."""

    def score(batches: Batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = Cells(batch, layout)
                for tree, weight in trees:
                    cells.add(tree, weight)
                at = batch.schema.get_field_index("score")
                yield batch.set_column(at, "score", pa.array(cells.score))

    return score


# The functions travel to the workers by value, whether or not they can import this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
