"""Writers of tables, documents and small reports."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """A CSV table with a header; ``single`` for report tables that fit one file."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_registry(df: DataFrame, path: str, columns: dict[str, str]) -> None:
    """Appends rows to the registry under its one schema; columns the rows lack are null."""
    df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]).write.mode("append").parquet(path)


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def split_documents(members: DataFrame, split: str = "split_id", unit: str = "unit_id") -> DataFrame:
    """(split_id, document): each split's ids as one JSON document, for export of splits that fit one."""
    ids = [F.array_sort(F.collect_list(F.when(F.col("part") == p, F.col(unit).cast("string")))).alias(f"{p}_ids") for p in ("train", "validation", "test")]
    return members.groupBy(split).agg(*ids).select(split, F.to_json(F.struct(split, "train_ids", "validation_ids", "test_ids")).alias("document"))


def write_json(value: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True, default=str)


def write_gene_list(genes: list[str], path: str) -> None:
    """One quoted gene a line, so that names with line breaks survive."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(g) + "\n" for g in genes)


def markdown_table(df: DataFrame, most: int = 1000) -> str:
    """A report table as Markdown; raises where it has more rows than a report should."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    show = lambda v: "NA" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(v) for v in r) + " |" for r in rows])


def latex_escape(text: str) -> str:
    return re.sub(r"([_%&#$])", r"\\\1", text)


def latex_table(df: DataFrame, most: int = 1000) -> str:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    body = [" & ".join(latex_escape("" if v is None else str(v)) for v in r) + r" \\" for r in rows]
    head = " & ".join(latex_escape(c) for c in df.columns) + r" \\"
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", r"\hline", head, r"\hline", *body, r"\hline", r"\end{tabular}"])
