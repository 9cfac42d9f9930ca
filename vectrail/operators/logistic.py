"""A balanced logistic regression over packed rows, by Newton's method: one pass over the blocks a step.

Numbers are brought to mean 0 and spread 1, every category is an indicator.  The squares of all coefficients but the
intercept are added to twice the weighted loss.  Tasks send sums only: their number follows from the features, not the
rows.  Scores are formed column by column, so that equal rows have equal scores wherever they lie.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectrail.operators.design import Design

#: Steps; the loss is convex and half steps are taken where it rises, so about ten are needed.
_STEPS = 100


def columns(design: Design, numeric: list[str], categorical: list[str]) -> int:
    return 1 + len(numeric) + sum(len(design.kinds[c]) for c in categorical)


class _Rows:
    """How blocks are read: a row's numbers to scale, and its categories."""

    def __init__(self, design: Design, numeric: list[str], categorical: list[str]) -> None:
        self.width, self.all, self.wide = len(design.numeric), len(design.numeric) + len(design.categorical), design.wide
        self.take = [design.numeric.index(c) for c in numeric]
        self.kinds = [(self.width + design.categorical.index(c), len(design.kinds[c])) for c in categorical]
        self.mean = np.array([design.mean[c] for c in numeric])
        self.by = np.array([1 / design.spread[c] if design.spread[c] else 0.0 for c in numeric])

    def read(self, numbers: pa.Scalar, codes: pa.Scalar) -> tuple[np.ndarray, list[np.ndarray]]:
        x = np.frombuffer(numbers.as_buffer(), float).reshape(-1, self.width) if self.width else np.empty((0, 0))
        k = np.frombuffer(codes.as_buffer(), self.wide).reshape(-1, self.all)
        return np.asfortranarray((x[:, self.take] - self.mean) * self.by if self.take else np.empty((len(k), 0))), [k[:, i].astype(np.int64) for i, _ in self.kinds]

    def line(self, beta: np.ndarray, x: np.ndarray, kinds: list[np.ndarray]) -> np.ndarray:
        out = np.full(len(x), beta[0])
        for i in range(x.shape[1]):
            out += x[:, i] * beta[1 + i]
        at = 1 + x.shape[1]
        for k, (_, n) in zip(kinds, self.kinds):
            out += np.append(beta[at : at + n], 0.0)[k]  # a category that no train row has
            at += n
        return out


def _chance(line: np.ndarray) -> np.ndarray:
    e = np.exp(-np.abs(line))
    return np.where(line >= 0, 1 / (1 + e), e / (1 + e))


def _sums(rows: _Rows, beta: np.ndarray, weight: tuple[float, float], nth: int, labels: int) -> Callable:
    """The loss, its gradient and its second derivatives, over the rows of a task."""
    p = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, slope, bend, any_ = 0.0, np.zeros(p), np.zeros((p, p)), False
        for batch in batches:
            for numbers, codes, ys in zip(*batch.columns):
                x, kinds = rows.read(numbers, codes)
                if not len(x):
                    continue
                any_ = True
                y = np.frombuffer(ys.as_buffer(), np.uint8).reshape(-1, labels)[:, nth].astype(float)
                w = np.where(y > 0, weight[1], weight[0])
                line = rows.line(beta, x, kinds)
                chance = _chance(line)
                loss += float((w * np.logaddexp(0, np.where(y > 0, -line, line))).sum())
                r, h = w * (chance - y), w * chance * (1 - chance)
                full = np.asfortranarray(np.column_stack([np.ones(len(x)), x]))
                scaled = full * h[:, None]
                q = full.shape[1]
                slope[:q] += full.T @ r
                bend[:q, :q] += full.T @ scaled
                at = q
                for i, (k, (_, n)) in enumerate(zip(kinds, rows.kinds)):
                    slope[at : at + n] += np.bincount(k, r, n + 1)[:n]
                    for j in range(q):
                        bend[j, at : at + n] += np.bincount(k, scaled[:, j], n + 1)[:n]
                    bend[np.arange(at, at + n), np.arange(at, at + n)] += np.bincount(k, h, n + 1)[:n]
                    to = at + n
                    for other, (_, n2) in zip(kinds[i + 1 :], rows.kinds[i + 1 :]):
                        bend[at : at + n, to : to + n2] += np.bincount(k * (n2 + 1) + other, h, (n + 1) * (n2 + 1)).reshape(n + 1, n2 + 1)[:n, :n2]
                        to += n2
                    at += n
        if any_:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([[loss], slope, bend.ravel()]).tobytes()], pa.binary())], names=["sums"])

    return run


def fit(design: Design, label: str, numeric: list[str], categorical: list[str]) -> np.ndarray:
    """Intercept and coefficients, of the numbers in their order and of every category."""
    rows, p = _Rows(design, numeric, categorical), columns(design, numeric, categorical)
    train = design.blocks.select("numbers", "codes", "y").coalesce(design.blocks.sparkSession.sparkContext.defaultParallelism)
    beta, step, last = np.zeros(p), np.zeros(p), np.inf
    free = np.append(0.0, np.ones(p - 1))
    for _ in range(_STEPS):
        got = train.mapInArrow(_sums(rows, beta, design.weights(label), design.labels.index(label), len(design.labels)), "sums binary").collect()  # one row a task
        sums = np.sum([np.frombuffer(r.sums, float) for r in got], axis=0)
        loss = sums[0] + (free * beta**2).sum() / 2
        if loss > last * (1 + 1e-12):
            step = step / 2
            beta = beta - step
            continue
        last = loss
        slope, upper = sums[1 : p + 1] + free * beta, sums[p + 1 :].reshape(p, p)
        bend = np.triu(upper) + np.triu(upper, 1).T + np.diag(free)
        step = -np.linalg.solve(bend, slope)
        beta = beta + step
        if -step @ slope < 1e-6:  # what a further step would change is of the order of its square
            return beta
    raise RuntimeError(f"no minimum after {_STEPS} steps")


def scores(design: Design, label: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """(_id, score) of the held rows."""
    rows, beta = _Rows(design, numeric, categorical), fit(design, label, numeric, categorical)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for numbers, codes, ids in zip(*batch.columns):
                chance = _chance(rows.line(beta, *rows.read(numbers, codes)))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids.as_buffer(), np.int64)), pa.array(chance)], names=["_id", "score"])

    return design.blocks.select("numbers_held", "codes_held", "ids").mapInArrow(run, "_id long, score double")
