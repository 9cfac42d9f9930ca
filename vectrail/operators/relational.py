"""Ranks, shares, curves and joins the reports are built from, in forms that scale.

Whole-table ranks and running sums never sort in one task: rows are range
partitioned, each range is ranked by itself and shifted by the count of the
ranges before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.session import scratch
from vectrail.tables import group_key


def null_nan(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """NaN becomes null, as aggregates and sorts expect."""
    kinds = dict(df.dtypes)
    names = [c for c in (columns or df.columns) if kinds[c] in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in names}) if names else df


def fill_columns(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Adds the columns ``df`` lacks, each with its default."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group; ``order`` should end in a unique column."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def purity(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n, total, purity) of the non-null labels of each group."""
    counts = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(group))
    return counts.withColumn("total", total).withColumn("purity", F.col("n") / F.col("total"))


def dominant_label(df: DataFrame, group: str, label: str, least: float = 0.8) -> DataFrame:
    """(group, label, purity): each group's dominant label where it is pure enough."""
    order = [F.col("purity").desc(), F.col("n").desc(), F.col(label)]
    return first_per(purity(df, group, label), [group], order).where(F.col("purity") >= least).select(group, label, "purity")


def with_share(df: DataFrame, keys: list[str], value: str, share: str) -> DataFrame:
    """Each row's part of its group's total; null where the total is zero."""
    total = F.sum(value).over(Window.partitionBy(*keys))
    return df.withColumn(share, F.try_divide(F.col(value), total))


def with_group_max(df: DataFrame, keys: list[str], value: str, flag: str, among: Column | None = None) -> DataFrame:
    """True where the row holds its group's maximum, all ties included; ``among`` limits the rows that compete."""
    x = F.col(value) if among is None else F.when(among, F.col(value))
    return df.withColumn(flag, F.coalesce(x == F.max(x).over(Window.partitionBy(*keys)), F.lit(False)))


def min_rank(keys: list[str], value: str) -> Column:
    """Rank from high to low within ``keys``, equal values sharing the smallest rank; null stays null."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.rank().over(w))


def _ranged(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``df`` in ranges of (group, order), kept in the shared folder so that both passes see the same ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.withColumn("_g", group_key(*keys) if keys else F.lit(0).cast("long"))
    return scratch(tagged.repartitionByRange(n, F.col("_g"), *order).withColumn("_part", F.spark_partition_id()))


def grouped_running(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Running sums within each group along ``order``, however large a group is.

    A group may span many ranges: each range sums its own rows, and what the group
    had in earlier ranges, one row a group and range, is added.  ``order`` should
    end in a unique column.
    """
    parts = _ranged(df, keys, order)
    per = parts.groupBy("_g", "_part").agg(*[F.sum(e).alias(f"_s_{c}") for c, e in sums.items()])
    earlier = Window.partitionBy("_g").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = per.select("_g", "_part", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums])
    inside = Window.partitionBy("_g", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = parts.join(before, ["_g", "_part"])
    out = out.withColumns({c: F.sum(e).over(inside) + F.col(f"_b_{c}") for c, e in sums.items()})
    return out.drop("_g", "_part", *[f"_b_{c}" for c in sums])


def grouped_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers within each group, however large a group is; ``order`` should end in a unique column."""
    return grouped_running(df, keys, order, {name: F.lit(1).cast("long")})


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Row numbers over the whole table; ``order`` should end in a unique column."""
    return grouped_rank(df, [], order, name)


def global_running(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Running sums over the whole table: ``sums`` maps the new column to the summed one."""
    return grouped_running(df, [], order, {c: F.col(x) for c, x in sums.items()})


def with_average_rank(df: DataFrame, keys: list[str], value: str, name: str = "rank") -> DataFrame:
    """Rank from low to high within ``keys``, equal values sharing their mean rank; rows without a value have none."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    upto = grouped_running(counts, keys, [F.col(value)], {"_upto": F.col("_n")})
    ranks = upto.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(value).alias("_v"), (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).alias(name))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col(value) == F.col("_v")]
    return df.join(ranks, on, "left").drop("_v", *[f"_k_{k}" for k in keys])


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """(keys, prob, quantile) by linear interpolation, exact, however large a group is and however many values are equal.

    Values are counted first, so that equal ones are one row; running counts then place the two ranks a quantile lies between.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    return counted_quantiles(rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), keys, "_v", "_c", probs)


def counted_quantiles(df: DataFrame, keys: list[str], value: str, n: str, probs: list[float]) -> DataFrame:
    """``grouped_quantiles`` of values that are there ``n`` times each, one row a group and value."""
    gk = (group_key(*keys) if keys else F.lit(0).cast("long")).alias("_gk")
    counts = df.select(*keys, F.col(value).alias("_v"), F.col(n).alias("_c"))
    upto = grouped_running(counts, keys, [F.col("_v")], {"_upto": F.col("_c")}).select(gk, *keys, "_v", "_c", "_upto")
    sizes = upto.groupBy("_gk", *keys).agg(F.max("_upto").alias("_n"))
    spots = F.explode(F.array(*[F.struct(F.lit(float(p)).alias("prob"), ((F.col("_n") - 1) * F.lit(float(p)) + 1).alias("spot")) for p in probs]))
    wanted = sizes.select("_gk", *keys, spots.alias("_w")).select("_gk", *keys, "_w.prob", "_w.spot")
    # A table of known size: broadcast while it is small, and with many groups its keys are spread.
    asked = scratch(wanted.withColumn("_at", F.explode(F.array_distinct(F.array(F.floor("spot"), F.ceil("spot"))))))
    got = asked.join(upto.drop(*keys), "_gk").where((F.col("_at") > F.col("_upto") - F.col("_c")) & (F.col("_at") <= F.col("_upto")))
    weight = F.when(F.col("spot") == F.col("_at"), F.lit(1.0)).otherwise(1 - F.abs(F.col("spot") - F.col("_at")))
    return got.groupBy("_gk", *keys, "prob").agg(F.sum(weight * F.col("_v")).alias("quantile")).drop("_gk")


def benjamini_hochberg(df: DataFrame, p: str, order: list[str], alpha: float = 0.05) -> DataFrame:
    """Adds p_value_fdr and reject over all rows of a table of tests."""
    ranked = global_rank(df, [F.col(p), *[F.col(c) for c in order]], "_k")
    m = df.count()
    up = global_running_min(ranked.withColumn("_q", F.col(p) * F.lit(float(m)) / F.col("_k")), "_k", "_q")
    return up.withColumn("p_value_fdr", F.least(F.lit(1.0), F.col("_min"))).withColumn(
        "reject", F.col("p_value_fdr") <= alpha
    ).drop("_k", "_q", "_min")


def global_running_min(df: DataFrame, key: str, value: str) -> DataFrame:
    """Adds _min: the smallest ``value`` at this key or any greater one."""
    parts = _ranged(df, [], [F.col(key).desc()])
    per = parts.groupBy("_part").agg(F.min(value).alias("m"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are partitions
    before = F.broadcast(per.select("_part", F.min("m").over(w).alias("_bm")))
    inside = Window.partitionBy("_part").orderBy(F.col(key).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.join(before, "_part").withColumn("_min", F.least(F.min(value).over(inside), "_bm")).drop("_part", "_bm", "_g")


def trapezoid(df: DataFrame, keys: list[str], x: str, y: str, tie: str, name: str = "area") -> DataFrame:
    """Area under y over x of each group, by the trapezoid rule along sorted x."""
    w = Window.partitionBy(*keys).orderBy(x, tie)
    strip = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.withColumn("_s", strip).groupBy(*keys).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias(name))


def quantile_bins(df: DataFrame, value: str, n: int, name: str = "bin") -> DataFrame:
    """Bins between the n-quantiles (linear interpolation), closed on the right, empty ones dropped."""
    edges = sorted({r[0] for r in grouped_quantiles(df, [], value, [i / n for i in range(n + 1)]).select("quantile").collect()})  # n + 1 numbers
    bin_of = F.lit(0)
    for e in edges[1:-1]:
        bin_of = bin_of + F.when(F.col(value) > F.lit(e), 1).otherwise(0)
    return df.withColumn(name, F.when(F.col(value).isNotNull(), bin_of).cast("int"))


def coalesced_left_join(left: DataFrame, right: DataFrame, on: list[str], suffix: str) -> DataFrame:
    """Left join in which columns both sides have take the right side's value where it has one."""
    shared = [c for c in right.columns if c in left.columns and c not in on]
    renamed = right.withColumnsRenamed({c: c + suffix for c in shared})
    out = left.join(renamed, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c + suffix), F.col(c)) for c in shared}).drop(*[c + suffix for c in shared])


def min_max_scale(df: DataFrame, value: str, name: str) -> DataFrame:
    """(x - min) / (max - min) over all rows; 0 where all are equal."""
    edge = F.broadcast(df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")))  # one row
    return df.join(edge).withColumn(
        name, F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    ).drop("_lo", "_hi")


def safe_ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b)


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within [low, high]; null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def log1p_or_zero(x: str) -> Column:
    v = F.col(x).try_cast("double")
    return F.coalesce(F.log1p(F.greatest(F.when(~F.isnan(v), v), F.lit(0.0))), F.lit(0.0))


def mean_of(columns: list[Column]) -> Column:
    """Mean of the values that are there."""
    there = F.filter(F.array(*columns), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(there, F.lit(0.0), lambda a, x: a + x), F.size(there))
