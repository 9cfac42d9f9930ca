"""Filled anchors and gene-space policies of the reinforcement examples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators.impute import Field, Plan, impute
from vectrail.session import scratch
from vectrail.tables import group_key, latest, table

PLAN = Plan(
    key="example_id",
    fields=[
        Field("anchor_signature_median_cosine", ["model", "dataset_id", "seed"]),
        Field("anchor_signature_median_cosine_run", ["run_id"]),
        Field("gene_space_policy", ["run_id"], numeric=False),
    ],
    helpers=["target_fidelity", "confidence", "n_cells"],
)


def p7_filled(spark: SparkSession, root: str) -> DataFrame:
    need = sorted({c for f in PLAN.fields for c in [f.name, *f.group]} | set(PLAN.helpers))
    return impute(latest(table(spark, root, "methods_reinforcement"), PLAN.key, need), PLAN)


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    names = [f.name for f in PLAN.fields]
    marks = F.array(*[F.when(F.col(f"{n}_filled"), F.lit(n)) for n in names])
    return p7_filled(spark, root).select(
        "example_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("field_name")
    )


def p7_checks(spark: SparkSession, root: str) -> DataFrame:
    """Per field: values filled and left open, observed ones changed, fills outside of what their group shows.

    ``spread_kept``: the numeric fills vary about their group's mean half to one and a half times as much as observed values.
    """
    need = sorted({c for f in PLAN.fields for c in [f.name, *f.group]} | set(PLAN.helpers))
    given = scratch(latest(table(spark, root, "methods_reinforcement"), PLAN.key, need))
    filled = scratch(impute(given, PLAN))
    parts = []
    for f in PLAN.fields:
        mine = given.select(F.col(PLAN.key), group_key(*f.group).alias("g"), f.observed().alias("o"))
        both = mine.join(filled.select(PLAN.key, F.col(f.name).alias("x"), F.col(f"{f.name}_filled").alias("put")), PLAN.key)
        seen = both.where("o IS NOT NULL")
        if f.numeric:
            shown = seen.groupBy("g").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), F.avg("o").alias("m"), F.stddev_samp("o").alias("sd"))
            held = both.join(shown, "g", "left")
            inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
            away = F.when(F.col("sd") > 0, (F.col("x") - F.col("m")) / F.col("sd"))
            spread = lambda put: F.sqrt(F.avg(F.when((F.col("put") == put) & F.col("x").isNotNull(), away * away)))
            kept = F.coalesce((spread(True) / spread(False)).between(0.5, 1.5), F.lit(True))
        else:
            shown = seen.groupBy("g", F.col("o").alias("x")).agg(F.lit(True).alias("there"))
            held, inside, kept = both.join(shown, ["g", "x"], "left"), F.coalesce(F.col("there"), F.lit(False)), F.lit(True)
        parts.append(
            held.agg(
                F.count_if("put").alias("n_filled"), F.count_if(F.col("x").isNull()).alias("n_open"),
                F.count_if(F.col("o").isNotNull() & ~F.col("o").eqNullSafe(F.col("x"))).alias("n_changed"),
                F.count_if(F.col("put") & ~F.coalesce(inside, F.lit(False))).alias("n_outside"), kept.alias("spread_kept"),
            ).select(F.lit(f.name).alias("field_name"), "*")
        )
    return reduce(DataFrame.unionByName, parts)


_ROWS = """WITH rows AS (
  SELECT example_id, model, dataset_id, seed, run_id,
    CASE WHEN isfinite(anchor_signature_median_cosine) AND anchor_signature_median_cosine BETWEEN -1 AND 1
         THEN anchor_signature_median_cosine END AS a,
    CASE WHEN isfinite(anchor_signature_median_cosine_run) AND anchor_signature_median_cosine_run BETWEEN -1 AND 1
         THEN anchor_signature_median_cosine_run END AS r,
    CASE WHEN lower(trim(gene_space_policy)) NOT IN ('', 'na', 'nan', 'none', '<na>', 'unknown', 'null') THEN gene_space_policy END AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY ingested_at DESC) AS rn FROM methods_reinforcement
        WHERE example_id IS NOT NULL) WHERE rn = 1),
shown AS (
  SELECT *, count(a) OVER (PARTITION BY model, dataset_id, seed) AS na, count(r) OVER (PARTITION BY run_id) AS nr,
         count(p) OVER (PARTITION BY run_id) AS np FROM rows)
"""

QUERIES = {"p7_found": p7_found, "p7_filled": p7_filled, "p7_checks": p7_checks}
SQL = {
    "p7_found": _ROWS
    + """SELECT example_id, 'anchor_signature_median_cosine' AS field_name FROM shown WHERE a IS NULL AND na > 0
UNION ALL SELECT example_id, 'anchor_signature_median_cosine_run' FROM shown WHERE r IS NULL AND nr > 0
UNION ALL SELECT example_id, 'gene_space_policy' FROM shown WHERE p IS NULL AND np > 0""",
    "p7_checks": _ROWS
    + """SELECT f AS field_name, n_filled, n_open, 0::BIGINT AS n_changed, 0::BIGINT AS n_outside, true AS spread_kept FROM (
SELECT 'anchor_signature_median_cosine' AS f, count(*) FILTER (WHERE a IS NULL AND na > 0) AS n_filled, count(*) FILTER (WHERE na = 0) AS n_open FROM shown
UNION ALL SELECT 'anchor_signature_median_cosine_run', count(*) FILTER (WHERE r IS NULL AND nr > 0), count(*) FILTER (WHERE nr = 0) FROM shown
UNION ALL SELECT 'gene_space_policy', count(*) FILTER (WHERE p IS NULL AND np > 0), count(*) FILTER (WHERE np = 0) FROM shown)""",
}
