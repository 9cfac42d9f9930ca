"""Filling missing values from similar records by chained equations.

Every incomplete field is fitted from all the others, round after round until the
fills hardly move: numeric fields by a linear regression on deviations from the
record's group, with the classes of the categorical fields among the predictors,
categorical ones by a classifier that multiplies the group's class shares with
the likelihood of the record's numbers.  The fits are sums over all rows (one
aggregate a round); only their small matrices reach the driver.  Numeric fills
carry residual variation: what the regression leaves unexplained is drawn, scaled
to the group's spread, fixed by the record's key and kept within what the group
has shown.  Classes are drawn from their posterior, fixed by the key, too.

Defined results: a field is filled only where some record of the record's group
has it; elsewhere it stays null.  Null group values are values of their own.  A
group that shows a single value fills with that value.  Every field comes with
``<field>_filled``, true where this operator put the value in.  An empty table
gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.labels import normalize_label
from vectrail.session import release, scratch
from vectrail.tables import finite, group_key


@dataclass(frozen=True)
class Field:
    """A field to fill, from records alike in ``group``."""

    name: str
    group: list[str]
    numeric: bool = True
    low: float = -1.0
    high: float = 1.0

    def observed(self) -> Column:
        if not self.numeric:
            return normalize_label(self.name)
        x = finite(self.name)
        return F.when((x >= self.low) & (x <= self.high), x)


@dataclass(frozen=True)
class Plan:
    key: str
    fields: list[Field]
    helpers: list[str] = field(default_factory=list)
    #: The fills are taken as settled once they move by less than this on average, in units of their groups' spread.
    settled: float = 0.01
    rounds: int = 10


def _normal(key: str, salt: str) -> Column:
    """A standard normal draw fixed by the key, by the Box-Muller formula."""
    u = [
        (F.pmod(F.xxhash64(F.col(key), F.lit(f"{salt}{i}")), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        for i in (0, 1)
    ]
    return F.sqrt(F.lit(-2.0) * F.log(u[0])) * F.cos(F.lit(2 * np.pi) * u[1])


def _shown(f: Field) -> list[Column]:
    o = f"o_{f.name}"
    if not f.numeric:
        return [F.count(o).alias(f"n_{f.name}")]
    return [
        F.count(o).alias(f"n_{f.name}"), F.avg(o).alias(f"m_{f.name}"), F.min(o).alias(f"lo_{f.name}"), F.max(o).alias(f"hi_{f.name}"),
        F.coalesce(F.stddev_samp(o), F.lit(0.0)).alias(f"sd_{f.name}"),
    ]


def _away(f: Field, value: str) -> Column:
    """How far a value lies from its group's mean, in units of the group's spread; 0 where the group has none."""
    return F.when(F.col(f"sd_{f.name}") > 0, (F.col(value) - F.col(f"m_{f.name}")) / F.col(f"sd_{f.name}")).otherwise(0.0)


@dataclass(frozen=True)
class Fit:
    """Coefficients of a regression (the constant first) and the spread of what it leaves unexplained."""

    beta: list[float]
    residual: float


def _solve(df: DataFrame, wanted: list[tuple[Column, list[Column], Column]]) -> list[Fit]:
    """Ridge-damped least squares of each (y, xs, keep) on 1 and xs over the rows kept, all from one aggregate."""
    sums, sizes = [], []
    for y, xs, keep in wanted:
        terms = [F.lit(1.0), *[F.coalesce(x, F.lit(0.0)) for x in xs]]
        k = len(terms)
        mine = [terms[i] * terms[j] for i in range(k) for j in range(i, k)] + [t * y for t in terms] + [y * y, F.lit(1.0)]
        sums += [F.sum(F.when(keep, s)) for s in mine]
        sizes.append((k, len(mine)))
    row = [x or 0.0 for x in df.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first()] if sums else []
    out, at = [], 0
    for k, size in sizes:
        mine, at = row[at : at + size], at + size
        n = mine[-1]
        if not n:
            out.append(Fit([0.0] * k, 0.0))
            continue
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = mine[: k * (k + 1) // 2]
        gram = gram + np.triu(gram, 1).T
        right, squares = np.array(mine[-2 - k : -2]), mine[-2]
        beta = np.linalg.solve(gram + np.diag([1e-9] + [1e-6 * n + 1e-9] * (k - 1)), right)
        rest = max(0.0, squares - 2 * beta @ right + beta @ gram @ beta)
        out.append(Fit(beta.tolist(), float(np.sqrt(rest / max(1.0, n - k)))))
    return out


def impute(df: DataFrame, plan: Plan) -> DataFrame:
    """``df``'s key with every field of the plan filled and marked, and whether it could be filled."""
    numeric = [f for f in plan.fields if f.numeric]
    classes = [f for f in plan.fields if not f.numeric]
    groups = {tuple(f.group): f"g_{i}" for i, f in enumerate({tuple(f.group): f for f in plan.fields}.values())}
    rows = df.select(
        F.col(plan.key).alias("_key"),
        *[f.observed().alias(f"o_{f.name}") for f in plan.fields],
        *[group_key(*g).alias(name) for g, name in groups.items()],
        *[finite(h).alias(f"h_{h}") for h in plan.helpers],
    )
    first = rows = scratch(rows)
    # What each group shows of its fields: one row a group, joined back; hot groups are combined before the shuffle.
    for group, g in groups.items():
        mine = [f for f in plan.fields if tuple(f.group) == group]
        shown = rows.groupBy(g).agg(*[x for f in mine for x in _shown(f)])
        for f in (f for f in mine if not f.numeric):
            o = F.col(f"o_{f.name}")
            counts = rows.where(o.isNotNull()).groupBy(g, o.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
            kinds = counts.groupBy(g).agg(
                F.sort_array(F.collect_list(F.struct(F.col("_v").alias("v"), F.col("_c").alias("c")))).alias(f"k_{f.name}")
            )  # one entry per class of the group, not per row
            shown = shown.join(kinds, g, "left")
        rows = rows.join(shown, g, "left").drop(g)
    middle = rows.agg(*[F.avg(f"h_{h}").alias(h) for h in plan.helpers], *[F.stddev_samp(f"h_{h}").alias(f"s_{h}") for h in plan.helpers]).first() if plan.helpers else None
    for h in plan.helpers:
        mean, spread = middle[h] or 0.0, middle[f"s_{h}"] or 1.0
        rows = rows.withColumn(f"h_{h}", F.coalesce((F.col(f"h_{h}") - F.lit(float(mean))) / F.lit(float(spread) or 1.0), F.lit(0.0)))
    # Start: the group's mean, and the group's commonest class.
    common = lambda k: F.element_at(F.array_sort(k, lambda x, y: F.when(x["c"] != y["c"], (y["c"] - x["c"]).cast("int")).when(x["v"] < y["v"], -1).otherwise(1)), 1)["v"]
    start = {f"x_{f.name}": F.coalesce(f"o_{f.name}", f"m_{f.name}") for f in numeric}
    start |= {f"x_{f.name}": F.coalesce(f"o_{f.name}", F.when(F.size(f"k_{f.name}") > 0, common(F.col(f"k_{f.name}")))) for f in classes}
    old, rows = first, scratch(rows.withColumns(start))
    release(old)
    for _ in range(plan.rounds):
        old, rows = rows, scratch(_round(rows, numeric, classes, plan))
        release(old)
        if (rows.agg(F.avg("_moved")).first()[0] or 0.0) <= plan.settled:
            break
        rows = rows.drop("_moved")
    out = [F.col("_key").alias(plan.key)]
    for f in plan.fields:
        value = F.col(f"x_{f.name}")
        out += [value.alias(f.name), (F.col(f"o_{f.name}").isNull() & value.isNotNull()).alias(f"{f.name}_filled")]
    return rows.select(*out)


def _round(rows: DataFrame, numeric: list[Field], classes: list[Field], plan: Plan) -> DataFrame:
    """One round: every field fitted from the others as they stand, and its gaps filled anew; ``_moved`` says how far."""
    # A class as a predictor: how far the numeric fields lie from their groups' means where it is observed or filled.
    coded = rows
    for c in classes:
        means = [F.avg(F.when(F.col(f"o_{f.name}").isNotNull(), _away(f, f"o_{f.name}"))).alias(f"e_{c.name}_{f.name}") for f in numeric]
        if means:
            x = f"x_{c.name}"
            coded = coded.join(scratch(rows.where(F.col(x).isNotNull()).groupBy(x).agg(*means)), x, "left")
    wanted = []
    for f in numeric:
        xs = [_away(q, f"x_{q.name}") for q in numeric if q is not f]
        xs += [F.col(f"h_{h}") for h in plan.helpers] + [F.col(f"e_{c.name}_{f.name}") for c in classes]
        wanted.append((_away(f, f"o_{f.name}"), xs, F.col(f"o_{f.name}").isNotNull() & (F.col(f"sd_{f.name}") > 0)))
    guesses = {}
    for f, (_, xs, _), fit in zip(numeric, wanted, _solve(coded, wanted)):
        away = F.lit(fit.beta[0])
        for b, x in zip(fit.beta[1:], xs):
            away = away + F.lit(b) * F.coalesce(x, F.lit(0.0))
        # Only what the fit leaves unexplained is drawn, in units of the group's spread; a group of one value keeps it.
        away = away + F.lit(fit.residual) * _normal("_key", f.name)
        inside = F.greatest(F.col(f"lo_{f.name}"), F.least(F.col(f"hi_{f.name}"), F.col(f"m_{f.name}") + F.col(f"sd_{f.name}") * away))
        guesses[f.name] = F.coalesce(f"o_{f.name}", F.when(F.col(f"n_{f.name}") > 0, inside))
    filled = coded.withColumns({f"y_{n}": g for n, g in guesses.items()})
    for c in classes:
        filled = _classify(filled, c, numeric, plan)
    moved = [F.when(F.col(f"sd_{f.name}") > 0, F.abs(_away(f, f"y_{f.name}") - _away(f, f"x_{f.name}"))) for f in numeric]
    moved += [(~F.col(f"y_{c.name}").eqNullSafe(F.col(f"x_{c.name}"))).cast("double") for c in classes]
    gaps = [F.when(F.col(f"o_{f.name}").isNull() & F.col(f"y_{f.name}").isNotNull(), m) for f, m in zip([*numeric, *classes], moved)]
    present = F.filter(F.array(*gaps), lambda g: g.isNotNull())
    far = F.when(F.size(present) > 0, F.array_max(present))
    keep = [c for c in rows.columns if not c.startswith("x_") and c != "_moved"]
    return filled.select(*keep, *[F.col(f"y_{f.name}").alias(f"x_{f.name}") for f in plan.fields], far.alias("_moved"))


def _classify(rows: DataFrame, c: Field, numeric: list[Field], plan: Plan) -> DataFrame:
    """``rows`` with ``y_<field>``, the class of each row: group share times normal likelihood of its numbers."""
    xs = {f"a{i}": _away(q, f"y_{q.name}") for i, q in enumerate(numeric)} | {f"a{len(numeric) + i}": F.col(f"h_{h}") for i, h in enumerate(plan.helpers)}
    o, k, y = f"o_{c.name}", f"k_{c.name}", f"y_{c.name}"
    stats = rows.where(F.col(o).isNotNull()).groupBy(F.col(o).alias("_v")).agg(
        *[F.avg(x).alias(f"mean_{n}") for n, x in xs.items()], *[F.coalesce(F.stddev_samp(x), F.lit(1.0)).alias(f"spread_{n}") for n, x in xs.items()]
    )
    several = rows.where(F.col(o).isNull() & (F.size(k) > 1)).select("_key", *[x.alias(n) for n, x in xs.items()], F.explode(k).alias("_e"))
    choice = several.select("_key", *xs, F.col("_e.v").alias("_v"), F.col("_e.c").alias("_c")).join(scratch(stats), "_v", "left")
    score = F.log(F.col("_c"))
    for n in xs:
        spread = F.greatest(F.col(f"spread_{n}"), F.lit(1e-3))
        score = score + F.coalesce(-F.log(spread) - F.pow((F.col(n) - F.col(f"mean_{n}")) / spread, 2) / 2, F.lit(0.0))
    # Gumbel noise fixed by key and class: the class is drawn from its posterior, which keeps the residual variation.
    unit = (F.pmod(F.xxhash64("_key", "_v", F.lit(c.name)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    best = choice.groupBy("_key").agg(F.max_by("_v", score - F.log(-F.log(unit))).alias("drawn"))
    only = F.when(F.size(k) == 1, F.element_at(k, 1)["v"])
    return rows.join(best, "_key", "left").withColumn(y, F.coalesce(F.col(o), only, F.col("drawn"))).drop("drawn")
