"""A random forest whose trees grow side by side, each in one task over the packed train rows.

Numbers are cut into ``maxBins`` ranges at their quantiles over all train rows, or at each of their values where these
are few; every category is a feature of its own.  A row is its codes, a byte or so a column; equal rows are folded, and
their number in a tree's sample is drawn at once.  A tree grows level by level from counts per node, feature and range,
and scores the held rows in the task where it grew: no tree reaches the driver.  Rows are ordered by what they hold, and
draws are fixed by the seed and the tree's number, so neither partitions nor the number of tasks show in the scores.

Bounded by one task: the codes of all train and held rows lie in the memory of each task that grows trees.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.operators.design import Design, ranges, value_counts

#: Shares of trees are summed as whole numbers, so that the order of the sum doesn't show.
_UNIT = 1 << 40


def thresholds(train: DataFrame, numeric: list[str], bins: int) -> dict[str, list[float]]:
    """The values up to which the ranges of each number go, the last one left out; at most ``bins`` - 1 a column."""
    return ranges(value_counts(train, numeric), numeric, bins) if numeric else {}


@dataclass(frozen=True)
class Tree:
    """Per node its feature (-1 at a leaf), the highest code that goes left, the left child (the right one is next) and the share of ones."""

    feature: np.ndarray
    most: np.ndarray
    left: np.ndarray
    share: np.ndarray

    def scores(self, codes: np.ndarray, col: np.ndarray, value: np.ndarray) -> np.ndarray:
        at = np.zeros(len(codes), np.int64)
        open_ = np.arange(len(codes))
        while len(open_):
            f = self.feature[at[open_]]
            open_, f = open_[f >= 0], f[f >= 0]
            here = at[open_]
            at[open_] = self.left[here] + (_coded(codes, open_, f, col, value) > self.most[here])
        return self.share[at]


def _coded(codes: np.ndarray, rows: np.ndarray, f: np.ndarray, col: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Feature ``f`` of each of ``rows``: a number's range, or whether the category is the feature's."""
    x = codes.ravel().take(rows * codes.shape[1] + col.take(f))
    v = value.take(f)
    return np.where(v < 0, x, x == v)


def _drawn(rng: np.random.Generator, nodes: int, k: int, p: int) -> np.ndarray:
    """``k`` of ``p`` features for each node, none twice (Floyd's sampling)."""
    out = np.empty((nodes, k), np.int64)
    for i, j in enumerate(range(p - k, p)):
        t = rng.integers(0, j + 1, nodes)
        out[:, i] = np.where((out[:, :i] == t[:, None]).any(axis=1), j, t)
    return out


def grow(codes: np.ndarray, y: np.ndarray, times: np.ndarray, weight: np.ndarray, col: np.ndarray, value: np.ndarray, codes_of: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> Tree:
    """A tree over rows that count ``times`` each, zeros and ones with their ``weight``, by the decrease of weighted Gini impurity.

    Feature i is the number in column ``col[i]``, or whether the category there is ``value[i]``, if that is not negative; it has ``codes_of[i]`` values.
    Features of one column, as categories are, share its counts in a node.
    """
    k = math.ceil(math.sqrt(len(col)))
    feature, most, left, share = [], [], [], []
    there = np.flatnonzero(times > 0)
    there = there[np.argsort(y[there], kind="stable")]  # rows of a node lie side by side, zeros before ones, at every level
    codes, y, times = codes[there], y[there].astype(np.int64), times[there].astype(float)
    wide_of = codes.max(axis=0, initial=0).astype(np.int64) + 1
    node, n, made = np.zeros(len(y), np.int64), 1, 1
    for level in range(depth + 1):
        count = np.bincount(node * 2 + y, times, n * 2).reshape(n, 2)
        mass = count * weight
        total = mass.sum(axis=1)
        share.append(np.divide(mass[:, 1], total, out=np.zeros(n), where=total > 0))
        f_all, m_all, l_all = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        feature.append(f_all), most.append(m_all), left.append(l_all)
        may = (count > 0).all(axis=1) & (count.sum(axis=1) >= 2 * least)
        if level == depth or not may.any():
            break
        inner = np.flatnonzero(may)
        m = len(inner)
        place = np.cumsum(may) - 1
        stay = np.flatnonzero(may[node])
        to = place[node[stay]]
        order = np.argsort(to.astype(np.uint16) if m < 1 << 16 else to, kind="stable")
        rows = stay[order]
        codes, y, times, node = codes.take(rows, axis=0), y.take(rows), times.take(rows), to.take(order)
        count, mass = count[inner], mass[inner]
        drawn = _drawn(rng, m, k, len(col))
        gain, bound_of = _gains(codes.ravel(), codes.shape[1], np.bincount(node * 2 + y, minlength=2 * m), times, count, mass, weight, drawn, col, value, wide_of, least)
        at = gain.argmax(axis=1)  # the first drawn of equal ones
        better = gain[np.arange(m), at] > (mass**2).sum(axis=1) / mass.sum(axis=1) * (1 + 1e-12)
        chosen = np.where(better, drawn[np.arange(m), at], -1)
        bound = np.where(better, bound_of[np.arange(m), at], 0)
        nth = np.cumsum(better) - 1
        f_all[inner], m_all[inner] = chosen, bound
        l_all[inner[better]] = made + 2 * nth[better]
        stay = np.flatnonzero(better[node])
        codes, y, times, node = codes.take(stay, axis=0), y.take(stay), times.take(stay), node.take(stay)
        right = _coded(codes, np.arange(len(y)), chosen[node], col, value) > bound[node]
        node, n = 2 * nth[node] + right, 2 * int(better.sum())
        made += n
        if not n:
            break
    return Tree(np.concatenate(feature), np.concatenate(most), np.concatenate(left), np.concatenate(share))


def _gains(flat: np.ndarray, width: int, rows_of: np.ndarray, times: np.ndarray, count: np.ndarray, mass: np.ndarray, weight: np.ndarray, drawn: np.ndarray, col: np.ndarray, value: np.ndarray, wide_of: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each node and feature drawn for it the best gain, -inf where no split leaves ``least`` rows on both sides, and the first code with it.

    ``flat`` holds the codes of the rows, ``rows_of`` how many rows each node has, zeros and ones apart.
    """
    m, k = drawn.shape
    gains, codes_at = np.full((m, k), -np.inf), np.zeros((m, k), np.int64)
    sizes = count.sum(axis=1)
    start, of_node = np.arange(len(times)) * width, rows_of.reshape(m, 2).sum(axis=1)
    by_col = np.argsort(col[drawn], axis=1, kind="stable")
    cols = np.take_along_axis(col[drawn], by_col, axis=1)
    new = np.ones((m, k), bool)
    new[:, 1:] = cols[:, 1:] != cols[:, :-1]
    nth = new.cumsum(axis=1) - 1  # which of its node's columns a drawn feature needs

    def of(a0: np.ndarray, a1: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        a0, a1 = a0 * weight[0], a1 * weight[1]
        b0, b1 = mass[nodes, 0] - a0, mass[nodes, 1] - a1
        return (a0 * a0 + a1 * a1) / (a0 + a1) + (b0 * b0 + b1 * b1) / (b0 + b1)

    for s in range(int(nth.max()) + 1):
        here = np.flatnonzero(nth[:, -1] >= s)
        c = cols[here, (nth[here] == s).argmax(axis=1)]
        wide = wide_of[c]
        end = np.cumsum(wide)
        first = end - wide
        if len(here) == m:
            at, n_times, per = start, times, rows_of.reshape(m, 2)
        else:
            has = np.zeros(m, bool)
            has[here] = True
            rows = np.flatnonzero(np.repeat(has, of_node))
            at, n_times, per = start.take(rows), times.take(rows), rows_of.reshape(m, 2)[here]
        where = np.repeat(np.stack([first, first + end[-1]], axis=1).ravel(), per.ravel())
        where += flat.take(at + np.repeat(c, per.sum(axis=1)))
        zero, one = np.bincount(where, n_times, 2 * end[-1]).reshape(2, -1)
        i, j = np.nonzero(nth[here] == s)
        nodes, j = here[i], by_col[here[i], j]
        f = drawn[nodes, j]
        is_kind = value[f] >= 0
        # Categories: whoever isn't of it goes left.
        i1, n1, j1 = i[is_kind], nodes[is_kind], j[is_kind]
        v = value[f[is_kind]]
        known = v < wide[i1]
        spot = np.where(known, first[i1] + v, 0)
        r0, r1 = np.where(known, zero[spot], 0.0), np.where(known, one[spot], 0.0)
        fits = sizes[n1] - (r0 + r1)
        ok = (fits >= least) & (sizes[n1] - fits >= least)
        n1, j1 = n1[ok], j1[ok]
        gains[n1, j1] = of(count[n1, 0] - r0[ok], count[n1, 1] - r1[ok], n1)
        # Numbers: those up to a code go left.
        i2 = i[~is_kind]
        if not len(i2):
            continue
        n2, j2, w2 = nodes[~is_kind], j[~is_kind], wide[i2]
        upto2 = np.cumsum(w2)
        first2 = upto2 - w2
        spot = np.arange(upto2[-1]) + np.repeat(first[i2] - first2, w2)
        low = []
        for x in (zero[spot], one[spot]):
            upto = x.cumsum()
            low.append(upto - np.repeat(upto[first2] - x[first2], w2))
        fits, size = low[0] + low[1], np.repeat(sizes[n2], w2)
        at = np.flatnonzero((fits >= least) & (size - fits >= least))
        if not len(at):
            continue
        which = np.repeat(np.arange(len(i2)), w2)[at]
        gain = of(low[0][at], low[1][at], n2[which])
        begins = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1])))
        top, who = np.maximum.reduceat(gain, begins), which[begins]
        peak = np.flatnonzero(gain == np.repeat(top, np.diff(np.append(begins, len(which)))))[::-1]  # the first of equal ones is written last
        code = np.zeros(len(i2), np.int64)
        code[which[peak]] = at[peak] - first2[which[peak]]
        gains[n2[who], j2[who]], codes_at[n2[who], j2[who]] = top, code[who]
    return gains, codes_at


class RandomForestClassifier:
    """Balanced classes, samples with replacement, the root of the number of features tried at each node."""

    def __init__(self, labelCol: str, numTrees: int = 200, maxDepth: int = 30, minInstancesPerNode: int = 5, maxBins: int = 32, seed: int = 7) -> None:
        self.label, self.trees, self.depth, self.least, self.bins, self.seed = labelCol, numTrees, maxDepth, minInstancesPerNode, maxBins, seed

    def scores(self, design: Design, numeric: list[str], categorical: list[str]) -> DataFrame:
        """(_id, score) of the held rows: the mean share of ones over the trees grown on the train rows."""
        spark = design.blocks.sparkSession
        kinds = [len(design.kinds[c]) for c in categorical]
        col = np.array([i for i in range(len(numeric))] + [len(numeric) + i for i, k in enumerate(kinds) for _ in range(k)], np.int64)
        value = np.array([-1] * len(numeric) + [v for k in kinds for v in range(k)], np.int64)
        codes_of = np.array([len(design.bounds[c]) + 1 for c in numeric] + [2] * (len(col) - len(numeric)), np.int64)
        tasks = min(self.trees, 2 * spark.sparkContext.defaultParallelism)
        blocks = design.blocks.select("codes", "y", "codes_held", "ids")
        grown = (
            spark.range(0, tasks, 1, tasks).join(blocks.coalesce(1).hint("shuffle_replicate_nl"))
            .mapInArrow(self._grower(tasks, design, numeric + categorical, col, value, codes_of), "_id long, _share long")
        )
        return grown.groupBy("_id").agg((F.sum("_share") / F.lit(float(_UNIT * self.trees))).alias("score"))

    def _grower(self, tasks: int, design: Design, names: list[str], col: np.ndarray, value: np.ndarray, codes_of: np.ndarray) -> Callable:
        trees, depth, least, seed, wide = self.trees, self.depth, self.least, self.seed, design.wide
        there, labels, nth = design.numeric + design.categorical, len(design.labels), design.labels.index(self.label)
        width, mine = len(there), [there.index(c) for c in names]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task, parts = None, ([], [], [], [])
            for batch in batches:
                if batch.num_rows:
                    task = batch.column(0)[0].as_py()
                for i, part in enumerate(parts):
                    part += [v.as_buffer() for v in batch.column(i + 1)]
            if task is None:
                return
            codes, y, held, ids = (np.concatenate([np.frombuffer(b, t) for b in part]) for part, t in zip(parts, (wide, np.uint8, wide, np.int64)))
            codes, held = codes.reshape(-1, width)[:, mine], held.reshape(-1, width)[:, mine]
            codes, y, times = _folded(codes, y.reshape(-1, labels)[:, nth])
            n = np.bincount(y, times, 2)
            weight = n.sum() / (2.0 * n)
            total = np.zeros(len(ids), np.int64)
            for t in range(task, trees, tasks):
                rng = np.random.default_rng([seed, t])
                tree = grow(codes, y, rng.poisson(times), weight, col, value, codes_of, depth, least, rng)
                total += np.rint(tree.scores(held, col, value) * _UNIT).astype(np.int64)
            for i in range(0, len(ids), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 50_000]), pa.array(total[i : i + 50_000])], names=["_id", "_share"])

        return run


def _folded(codes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct rows in an order that follows from what they hold, and how often each is there."""
    odd = np.random.default_rng(1).integers(0, 1 << 63, codes.shape[1] + 1, np.uint64) * np.uint64(2) + np.uint64(1)
    mark = y * odd[-1]
    for i in range(codes.shape[1]):
        mark += (codes[:, i].astype(np.uint64) + np.uint64(1)) * odd[i]
        mark ^= mark >> np.uint64(29)
        mark *= odd[-1]
    _, first, times = np.unique(mark, return_index=True, return_counts=True)
    return codes[first], y[first], times
