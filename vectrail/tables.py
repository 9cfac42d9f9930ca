"""Reading the project's tables and settling redelivered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def latest(df: DataFrame, key: str, columns: list[str], version: str = "ingested_at") -> DataFrame:
    """One row per ``key``: the one with the greatest ``version``.

    Rows equal in ``version`` are taken to be equal.  A null version loses to
    any other; rows with a null key cannot be identified and are left out.
    Only ``key``, ``version`` and ``columns`` are read and shuffled.  Rows are
    sent to their key unsorted: versions are few, so sorting before as well as after
    the shuffle would buy nothing.
    """
    order = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last())
    return (
        df.where(F.col(key).isNotNull())
        .select(key, version, *columns)
        .repartition(F.col(key))
        .withColumn("_rn", F.row_number().over(order))
        .where("_rn = 1")
        .select(key, *columns)
    )


def finite(column: str | Column) -> Column:
    """The value if it is a finite number, else null; -0.0 becomes 0.0."""
    x = (F.col(column) if isinstance(column, str) else column).cast("double")
    return F.when(F.isnotnull(x) & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x + F.lit(0.0))


def group_key(*columns: str) -> Column:
    """A 64-bit id of the values of ``columns``; null is a value of its own."""
    return F.xxhash64(
        *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    )
