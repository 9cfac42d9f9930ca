"""Percentiles per group of very large numeric columns by distributed multi-select.

Every partition proposes the median of its values in each open range, the
weighted median of the proposals becomes the range's pivot, one pass counts
below / at / above it, and the part that holds no wanted rank is thrown away,
until a pivot is the wanted value.  That ends every range of every group, small
or large: a pivot is one of the range's values and never comes back.  Survivors
are written to the shared folder each round, so the data read shrinks
geometrically.  No group is ever gathered and no row leaves its partition while
the pivots are small enough to be broadcast: a round moves one proposal per
partition and range, and one count per range.

Results of days are combined through mergeable sketches (``daily_sketches``,
stored by ``store_days``, read and merged by ``combine_days``) whose rank error is
bounded by ``BOUND``; they never look at old rows.

Defined results: null, NaN and infinite values take no part; a null group value
is a group of its own; groups without a finite value give no row; ties and
repeated rows count as often as they occur; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectrail.session import release, scratch
from vectrail.tables import finite, group_key

#: Size of a day's sketch; rank error about 0.2 % of the rows at any number of days.
SKETCH_K = 1600
#: Rank error, as a share of the group's rows, that combined days never pass.
BOUND = 0.01


def multiselect(values: DataFrame, percents: list[int]) -> DataFrame:
    """(gid, pct, n, value) of ``values`` (gid long, v double): the value at rank ceil(pct/100 * n).

    ``values`` is read again in the first round and should be a stored table.
    """
    data = first = values.select(F.col("gid").alias("rid"), "v")
    wanted = F.explode(F.array(*[F.lit(int(p)) for p in percents]))
    rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n") * F.col("pct") / F.lit(100)).cast("long"))
    open_ = scratch(
        data.groupBy("rid").agg(F.count(F.lit(1)).alias("n"))
        .select("rid", "n", wanted.alias("pct"))
        .select(F.col("rid").alias("gid"), "pct", "n", "rid", rank.alias("rank"))
    )
    done: list[DataFrame] = []
    while not open_.isEmpty():
        proposals = data.groupBy(F.spark_partition_id().alias("pid"), "rid").agg(
            F.percentile_approx("v", F.lit(0.5), F.lit(200)).alias("m"), F.count(F.lit(1)).alias("w")
        )
        run, whole = Window.partitionBy("rid").orderBy("m", "pid"), Window.partitionBy("rid")
        # A table of known size, so that the joins below broadcast it while it is small and shuffle beyond that.
        pivots = scratch(
            proposals.select("rid", "m", F.sum("w").over(run).alias("upto"), F.sum("w").over(whole).alias("all"))
            .where(F.col("upto") * 2 >= F.col("all"))
            .groupBy("rid")
            .agg(F.min("m").alias("pivot"))
        )
        tagged = data.join(pivots, "rid")
        counts = tagged.groupBy("rid", "pivot").agg(
            F.count_if(F.col("v") < F.col("pivot")).alias("lt"), F.count_if(F.col("v") == F.col("pivot")).alias("eq")
        )
        child = lambda side: F.xxhash64("rid", "pivot", F.lit(side))
        below, above = F.col("rank") <= F.col("lt"), F.col("rank") > F.col("lt") + F.col("eq")
        settled = scratch(
            open_.join(counts, "rid").select(
                "gid", "pct", "n",
                F.when(below, child("l")).when(above, child("r")).alias("rid"),
                F.when(above, F.col("rank") - F.col("lt") - F.col("eq")).otherwise(F.col("rank")).alias("rank"),
                "pivot",
            )
        )
        done.append(settled.where("rid IS NULL").select("gid", "pct", "n", F.col("pivot").alias("value")))
        open_ = settled.where("rid IS NOT NULL").drop("pivot")
        alive = scratch(open_.select("rid").distinct())
        side = F.when(F.col("v") < F.col("pivot"), child("l")).when(F.col("v") > F.col("pivot"), child("r"))
        old, data = data, scratch(tagged.select(side.alias("rid"), "v").join(alive, "rid", "left_semi"))
        for spent in (pivots, alive, *((old,) if old is not first else ())):
            release(spent)
    found = done[0] if done else open_.select("gid", "pct", "n", F.lit(None).cast("double").alias("value"))
    for part in done[1:]:
        found = found.unionByName(part)
    return found


def percentiles(df: DataFrame, groups: list[str], value: str, percents: list[int]) -> DataFrame:
    """One row per group and percent: the groups' columns, pct, n and value."""
    rows = scratch(df.select(group_key(*groups).alias("gid"), *groups, finite(value).alias("v")).where("v IS NOT NULL"))
    names = rows.groupBy("gid").agg(*[F.first(g).alias(g) for g in groups])
    return multiselect(rows.select("gid", "v"), percents).join(names, "gid").select(*groups, "pct", "n", "value")


def daily_sketches(df: DataFrame, groups: list[str], value: str, day: str, k: int = SKETCH_K) -> DataFrame:
    """One mergeable sketch per group and day; a day is written once and never read again."""
    rows = df.select(*groups, F.to_date(day).alias("day"), finite(value).alias("_v")).where("_v IS NOT NULL")
    return rows.groupBy(*groups, "day").agg(
        F.kll_sketch_agg_double("_v", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n")
    )


def store_days(sketches: DataFrame, path: str) -> None:
    """Adds days to the store at ``path``; a day that is there already is replaced, others stay as they are."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def stored_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def combine_days(sketches: DataFrame, groups: list[str], percents: list[int]) -> DataFrame:
    """Percentiles of any set of days from their sketches alone."""
    merged = sketches.groupBy(*groups).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100.0))
    each = F.explode(F.array(*[F.struct(F.lit(int(p)).alias("pct"), at(p).alias("value")) for p in percents]))
    return merged.select(*groups, "n", each.alias("e")).select(*groups, "e.pct", "n", "e.value")


def rank_errors(combined: DataFrame, df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """``combined`` with the share of the group's rows by which each value's rank misses the wanted one."""
    rows = df.select(group_key(*groups).alias("gid"), finite(value).alias("_v")).where("_v IS NOT NULL")
    asked = combined.withColumn("gid", group_key(*groups))
    ranks = rows.join(asked.select("gid", "pct", "value"), "gid").groupBy("gid", "pct").agg(
        F.count_if(F.col("_v") < F.col("value")).alias("lt"), F.count_if(F.col("_v") <= F.col("value")).alias("le")
    )
    at = F.col("n") * F.col("pct") / F.lit(100)
    miss = F.greatest(F.lit(0.0), F.col("lt") - at, at - F.col("le")) / F.col("n")
    return asked.join(ranks, ["gid", "pct"]).select(*groups, "pct", "n", "value", miss.alias("rank_error"))
