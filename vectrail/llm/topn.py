"""The N best items of every group, for millions of groups of any size.

Scores are cut into descending bands at corpus quantiles.  Bands are processed
from the top: groups that already have N items are anti-joined away, and of the
rest no task forwards more than N items a group.  The band in which a group
fills up is its boundary band; there the tie rule (score from high to low, then
smaller id) is applied exactly, and rows below it are never read again.

Defined results: null, NaN and infinite scores take no part; null group values
are values of their own; -0.0 equals 0.0; groups of fewer than N items give all
they have.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectrail.session import cut, scratch
from vectrail.tables import finite, group_key

#: Share of all rows at or above the lower edge of each band but the last.
BANDS = (1 / 64, 1 / 16, 1 / 4)


def top_n(df: DataFrame, groups: list[str], score: str, item: str, n: int, bands: tuple[float, ...] = BANDS) -> DataFrame:
    """(gid, item, score, place): the first ``n`` items of every group."""
    rows = df.select(group_key(*groups).alias("gid"), F.col(item).alias("item"), finite(score).alias("score")).where(
        "score IS NOT NULL"
    )
    rows = scratch(rows)
    edges = rows.agg(
        F.percentile_approx("score", F.array(*[F.lit(1.0 - b) for b in bands]), F.lit(2000)).alias("e")
    ).first()[0]
    edges = sorted(set(edges or []), reverse=True)
    band = reduce(lambda c, ie: c.when(F.col("score") >= F.lit(ie[1]), F.lit(ie[0])), enumerate(edges), F.when(F.lit(False), F.lit(-1)))
    banded = scratch(rows.withColumn("band", band.otherwise(F.lit(len(edges)))), "band")
    best = Window.partitionBy("gid").orderBy(F.col("score").desc(), F.col("item"))
    chosen: list[DataFrame] = []
    have: DataFrame | None = None
    for b in range(len(edges) + 1):
        part = banded.where(F.col("band") == b).select("gid", "item", "score")
        if have is not None:
            part = part.join(have.where(F.col("c") >= n).select("gid"), "gid", "left_anti")
        part = scratch(part.withColumn("place", F.row_number().over(best)).where(F.col("place") <= n))
        if have is None:
            placed = part
        else:
            placed = (
                part.join(have, "gid", "left")
                .withColumn("place", F.col("place") + F.coalesce(F.col("c"), F.lit(0)))
                .where(F.col("place") <= n)
                .select("gid", "item", "score", "place")
            )
        chosen.append(placed)
        if b < len(edges):
            now = part.groupBy("gid").agg(F.count(F.lit(1)).alias("c"))
            if have is not None:
                now = have.unionByName(now).groupBy("gid").agg(F.sum("c").alias("c"))
            have = cut(now)
    return reduce(DataFrame.unionByName, chosen)
