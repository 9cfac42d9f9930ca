"""Readers of tables, documents and gene lists; schemas are given, never inferred from the data."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV table with a header; empty strings are null."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_optional(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The table, or an empty one of that schema where the file is missing."""
    if exists(spark, path):
        return read_table(spark, path, schema)
    return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV or JSON lines, by the path's suffix."""
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if kind == ".csv":
        if schema is None:
            raise ValueError("a CSV table needs a schema")
        return read_csv(spark, path, schema)
    if kind in (".json", ".jsonl"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.json(path)
    raise ValueError(f"unknown table format: {path}")


def present_columns(spark: SparkSession, path: str, wanted: list[str]) -> list[str]:
    """The wanted columns a Parquet table has, from its footer alone."""
    have = set(spark.read.parquet(path).schema.names)
    return [c for c in wanted if c in have]


def read_columns(spark: SparkSession, path: str, wanted: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*present_columns(spark, path, wanted))


SPLIT_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("split_family", "track", "dataset_scope", "status", "holdout_variable", "heldout_target", "unsupported_reason")]
    + [T.StructField("seed", T.IntegerType())]
    + [T.StructField(c, T.ArrayType(T.StringType())) for c in ("train_ids", "validation_ids", "test_ids")]
)


def read_split_documents(spark: SparkSession, path: str) -> DataFrame:
    """Split documents as a long table (split_id, split fields, unit_id, part)."""
    docs = spark.read.schema(SPLIT_SCHEMA).option("multiLine", True).json(path).withColumn(
        "split_id", F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    )
    sides = F.array(*[F.struct(F.lit(p).alias("part"), F.coalesce(f"{p}_ids", F.array().cast("array<string>")).alias("ids")) for p in ("train", "validation", "test")])
    return (
        docs.withColumn("_side", F.explode(sides))
        .withColumn("unit_id", F.explode("_side.ids"))
        .select("split_id", "split_family", "track", "dataset_scope", "seed", "heldout_target", "unit_id", F.col("_side.part").alias("part"))
    )


def read_gene_sets(spark: SparkSession, path: str) -> DataFrame:
    """(pathway, gene) of a document that maps names to lists."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("pathway", "genes")).select(
        "pathway", F.explode("genes").alias("gene")
    ).distinct()


def parse_gene_line(line: str) -> str | None:
    line = line.strip("\r\n")
    if not line.strip():
        return None
    if line.lstrip().startswith('"'):
        try:
            return json.loads(line)
        except ValueError:
            pass
    return line.strip()


def read_gene_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, gene): one gene a line, quoted or plain, blank lines skipped; order is kept."""
    with open(path, encoding="utf-8") as f:  # one gene space: thousands of lines at most
        genes = [g for g in map(parse_gene_line, f) if g is not None]
    return spark.createDataFrame(list(enumerate(genes)), "pos int, gene string")


def catalog_row(catalog: DataFrame, dataset_id: str) -> dict[str, object]:
    """A dataset's catalog row; raises where it has none."""
    row = catalog.where(F.col("dataset_id") == dataset_id).orderBy("dataset_id").first()
    if row is None:
        raise KeyError(f"unknown dataset {dataset_id}")
    return {k: (None if isinstance(v, str) and v.strip().lower() in ("", "nan") else v) for k, v in row.asDict().items()}


def shared_genes(genes: DataFrame) -> DataFrame:
    """(gene): genes every dataset has; ``genes`` is (dataset_id, gene)."""
    n = genes.select("dataset_id").distinct().count()
    return genes.where("gene IS NOT NULL").groupBy("gene").agg(F.countDistinct("dataset_id").alias("n")).where(F.col("n") == n).select("gene")


def even_sample(df: DataFrame, name: str, most: int = 256) -> DataFrame:
    """(name): at most ``most`` of the sorted distinct names, evenly spread, first and last included."""
    from vectrail.operators.relational import global_rank

    names = df.where(F.col(name).isNotNull()).select(name).distinct()
    n = names.count()
    if n <= most:
        return names
    wanted = sorted({int(i * (n - 1) / (most - 1)) + 1 for i in range(most)})
    return global_rank(names, [F.col(name)], "_rn").where(F.col("_rn").isin(wanted)).select(name)
