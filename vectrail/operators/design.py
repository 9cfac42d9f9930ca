"""The rows of classifiers, packed once for every feature subset, estimator and label fitted on them.

What a fit needs of its train rows (fills, kept categories, ranges of numbers, means and spreads) comes from counts per
value, which are made in one pass over all features.  Rows then lie as blocks of bytes, the parts of a block in columns
of their own, so that a fit reads only those it needs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.operators.relational import counted_quantiles
from vectrail.session import cut, scratch


def number(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double") + 0.0)


def category(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("missing"))


def value_counts(df: DataFrame, numeric: list[str]) -> DataFrame:
    """(c, x, n) over the columns ``numeric``, stored; x is null where the number is missing."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), number(c).alias("x")) for c in numeric])).alias("e")
    return cut(df.select(each).select("e.*").groupBy("c", "x").agg(F.count(F.lit(1)).alias("n")))


def ranges(values: DataFrame, numeric: list[str], bins: int) -> dict[str, list[float]]:
    """The values up to which the ranges of each number go, the last one left out; at most ``bins`` - 1 a column."""
    few = [r.c for r in values.groupBy("c").count().where(F.col("count") <= bins).collect()]  # one row a column
    found: dict[str, list[float]] = {c: [] for c in numeric}
    for r in values.where(F.col("c").isin(few)).select("c", "x").collect():  # at most bins rows a column
        found[r.c].append(r.x)
    found = {c: sorted(x)[:-1] for c, x in found.items()}
    if many := [c for c in numeric if c not in few]:
        for r in counted_quantiles(values.where(F.col("c").isin(many)), ["c"], "x", "n", [i / bins for i in range(1, bins)]).collect():  # at most bins rows a column
            found[r.c].append(r.quantile)
    return {c: sorted(set(x)) for c, x in found.items()}


@dataclass(frozen=True)
class Design:
    """``rows`` have ``_id``; ``blocks`` have the bytes of train and of held rows. Codes, numbers and labels lie row by row."""

    rows: DataFrame
    blocks: DataFrame
    numeric: list[str]
    categorical: list[str]
    labels: list[str]
    bounds: dict[str, list[float]]
    kinds: dict[str, list[str]]  # listed on the driver
    mean: dict[str, float]
    spread: dict[str, float]
    wide: np.dtype
    n: int
    ones: dict[str, int]

    def covers(self, numeric: list[str], categorical: list[str], label: str) -> bool:
        return {*numeric} <= {*self.numeric} and {*categorical} <= {*self.categorical} and label in self.labels

    def weights(self, label: str) -> tuple[float, float]:
        """Of a zero and a one, so that both classes count the same."""
        return self.n / (2.0 * (self.n - self.ones[label])), self.n / (2.0 * self.ones[label])


def pack(df: DataFrame, numeric: list[str], categorical: list[str], labels: list[str], bins: int = 32) -> Design:
    """Numbers filled with their median, categories seen once folded together, both by the rows that aren't ``held``."""
    rows = cut(df.withColumn("_id", F.monotonically_increasing_id()))
    train = rows.where("NOT held")
    size = train.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(y).cast("long")).alias(f"_y{i}") for i, y in enumerate(labels)]).first()
    fill, bounds, mean, spread, kinds = {c: 0.0 for c in numeric}, {}, {}, {}, {c: [] for c in categorical}
    if numeric and size.n:
        values = value_counts(train, numeric)
        fill |= {r.c: r.quantile for r in counted_quantiles(values.where("x IS NOT NULL"), ["c"], "x", "n", [0.5]).collect()}  # one row a feature
        of = lambda x: F.create_map(*[F.lit(z) for c in numeric for z in (c, float(x[c]))])[F.col("c")]
        values = cut(values.groupBy("c", F.coalesce("x", of(fill)).alias("x")).agg(F.sum("n").alias("n")))
        bounds = ranges(values, numeric, bins)
        flat = {r.c: r for r in values.groupBy("c").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()}  # one row a feature
        mean = {c: flat[c].m for c in numeric}
        off = values.groupBy("c").agg(F.sum(F.col("n") * F.pow(F.col("x") - of(mean), 2)).alias("s")).collect()  # one row a feature
        spread = {r.c: (r.s / (size.n - 1)) ** 0.5 if flat[r.c].lo < flat[r.c].hi else 0.0 for r in off}
    if categorical:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), category(c).alias("v")) for c in categorical])).alias("e")
        seen = train.select(each).select("e.*").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        for r in seen.select("c", F.when(F.col("n") >= 2, F.col("v")).otherwise(F.lit("rare")).alias("v")).distinct().collect():
            kinds[r.c].append(r.v)
    kinds = {c: sorted(k) for c, k in kinds.items()}
    wide = np.dtype(np.uint8 if max(map(len, kinds.values()), default=0) < 255 else np.uint32)
    filled = rows.select(
        *[F.coalesce(number(c), F.lit(float(fill[c]))).alias(c) for c in numeric], *[category(c).alias(c) for c in categorical],
        *[F.col(y).cast("double").alias(f"_y{i}") for i, y in enumerate(labels)], "held", "_id",
    )
    bounds = {c: bounds.get(c, []) for c in numeric}
    blocks = scratch(filled.mapInArrow(_packer(len(numeric), len(labels), [bounds[c] for c in numeric], [kinds[c] for c in categorical], wide), "codes binary, numbers binary, y binary, codes_held binary, numbers_held binary, ids binary"))
    return Design(rows, blocks, numeric, categorical, labels, bounds, kinds, mean, spread, wide, size.n, {y: size[i + 1] or 0 for i, y in enumerate(labels)})


def _packer(numbers: int, labels: int, bounds: list[list[float]], kinds: list[list[str]], wide: np.dtype) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            plain = lambda i: batch.column(i).to_numpy(zero_copy_only=False)
            x = np.empty((batch.num_rows, numbers))
            codes = np.empty((batch.num_rows, numbers + len(kinds)), wide)
            y = np.empty((batch.num_rows, labels), np.uint8)
            for i, b in enumerate(bounds):
                x[:, i] = plain(i)
                codes[:, i] = np.searchsorted(np.array(b), x[:, i], side="left")
            for i, k in enumerate(kinds, numbers):
                known = pc.index_in(batch.column(i), pa.array(k, pa.string()))
                codes[:, i] = pc.fill_null(known, k.index("rare") if "rare" in k else len(k)).to_numpy(zero_copy_only=False)
            held = plain(batch.num_columns - 2).astype(bool)
            for i in range(labels):
                y[:, i] = pc.fill_null(batch.column(codes.shape[1] + i), 0.0).to_numpy(zero_copy_only=False)
            ids = plain(batch.num_columns - 1)
            parts = [codes[~held], x[~held], y[~held], codes[held], x[held], ids[held]]
            yield pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["codes", "numbers", "y", "codes_held", "numbers_held", "ids"])

    return run
