"""A score cutoff per source that keeps a target fraction of the source's records.

One pass builds a mergeable rank-error-bounded sketch per source and asks it for
a bracket around the wanted quantile.  A second pass counts what is above the
bracket and the rows at each distinct score inside it, so the cutoff and the
kept rows, ties included, are exact.  A bracket that missed is moved outwards and
counted again.  The counts inside are summed along the scores in ranges, so a
bracket may hold any number of distinct scores and is never one task's.

Defined results: records with a null, NaN or infinite score, or that do not
qualify, take no part; a null source is a source of its own; all ties at the
cutoff are kept; sources without a record give no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectrail.operators.relational import grouped_running
from vectrail.session import scratch
from vectrail.tables import finite, group_key

SKETCH_K = 1024
_INF = float("inf")


def slack(k: int) -> float:
    """About three times the rank error of a sketch of size k; a bracket that misses is noticed and repaired."""
    return min(1.0, 8.0 / k)


def prepare(df: DataFrame, source: list[str], score: str, record: str) -> DataFrame:
    """(sid, record, score) of the rows that take part, written once for the passes."""
    return scratch(
        df.select(group_key(*source).alias("sid"), F.col(record).alias("record"), finite(score).alias("score"))
        .where("score IS NOT NULL")
    )


def cutoffs(records: DataFrame, keep: float, k: int = SKETCH_K) -> DataFrame:
    """(sid, n, cutoff): the largest score that at least ``keep`` of the source's records reach."""
    at = 1.0 - keep
    sketched = records.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("score", F.lit(k)).alias("s"))
    state = scratch(
        sketched.select(
            "sid",
            "n",
            F.ceil(F.col("n") * F.lit(keep) - F.lit(1e-9)).cast("long").alias("want"),
            F.kll_sketch_get_quantile_double("s", F.lit(min(1.0, max(0.0, at - slack(k))))).alias("lo"),
            F.kll_sketch_get_quantile_double("s", F.lit(max(0.0, min(1.0, at + slack(k))))).alias("hi"),
        )
    )
    inside = (F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi"))
    while True:
        seen = records.join(state, "sid").groupBy("sid").agg(F.count_if(F.col("score") > F.col("hi")).alias("above"), F.count_if(inside).alias("inside"))
        counted = scratch(state.join(seen, "sid"))
        low, high = F.col("above") >= F.col("want"), F.col("above") + F.col("inside") < F.col("want")
        if not counted.where(low | high).limit(1).count():
            break
        # The cutoff lies above the bracket, or below it: the next one reaches from there to the end.
        state = scratch(
            counted.select(
                "sid", "n", "want",
                F.when(low, F.col("hi")).when(high, F.lit(-_INF)).otherwise(F.col("lo")).alias("lo"),
                F.when(low, F.lit(_INF)).when(high, F.col("lo")).otherwise(F.col("hi")).alias("hi"),
            )
        )
    histogram = records.join(counted, "sid").where(inside).groupBy("sid", "score").agg(F.count(F.lit(1)).alias("c"))
    run = grouped_running(histogram, ["sid"], [F.col("score").desc()], {"upto": F.col("c")})
    return (
        run.join(counted, "sid")
        .where(F.col("above") + F.col("upto") >= F.col("want"))
        .groupBy("sid")
        .agg(F.first("n").alias("n"), F.max("score").alias("cutoff"))
    )


def kept(records: DataFrame, limits: DataFrame) -> DataFrame:
    """The records that reach their source's cutoff."""
    return records.join(limits, "sid").where(F.col("score") >= F.col("cutoff")).select("sid", "record", "score")


def report(records: DataFrame, limits: DataFrame) -> DataFrame:
    """(sid, n, cutoff, kept, ties): counted in a pass of its own over all records."""
    return records.join(limits, "sid").groupBy("sid").agg(
        F.first("n").alias("n"),
        F.first("cutoff").alias("cutoff"),
        F.count_if(F.col("score") >= F.col("cutoff")).alias("n_kept"),
        F.count_if(F.col("score") == F.col("cutoff")).alias("n_ties"),
    )
