"""One row per packed value, over the three tables that pack values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vectrail.operators.packed import unpack, unpack_all
from vectrail.tables import latest, table

_FIELDS = [
    ("make_splits", "unit_id", "perturbation_label", False),
    ("cbac_case_examples", "case_id", "top_true_genes", True),
    ("external_candidate_contract_audit", "audit_id", "obs_fields_detected", True),
]


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return unpack_all(
        [unpack(latest(table(spark, root, name), key, [field]), key, field, name, underscore) for name, key, field, underscore in _FIELDS]
    )


def _sql(name: str, key: str, field: str, underscore: bool) -> str:
    # Written with chr(34), chr(39) and chr(92) for the quote marks and the backslash.
    word = r"[\p{L}\p{N}.\-" + ("_" if underscore else "") + "]+"
    double, single = [f"{q}(?:[^{q}\\\\]|\\\\.|{q}{q})*{q}" for q in ('"', "''")]
    plain = "x[2:-2]"
    for q in (34, 39):
        plain = f"replace({plain}, chr(92) || chr({q}), chr({q}))"
    plain = f"replace({plain}, x[1] || x[1], x[1])"
    return f"""SELECT '{name}' AS source_table, row_id, (i - 1)::INTEGER AS pos, piece FROM (
  SELECT row_id, unnest(v) AS piece, unnest(range(1, len(v) + 1)) AS i FROM (
    SELECT {key} AS row_id, list_filter(list_transform(
      regexp_extract_all({field}, '{double}|{single}|{word}'),
      lambda x: CASE WHEN x[1] IN (chr(34), chr(39)) THEN {plain} ELSE x END), lambda x: x <> '') AS v
    FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ingested_at DESC) AS rn FROM {name} WHERE {key} IS NOT NULL)
    WHERE rn = 1))"""


QUERIES = {"p5_found": p5_found}
SQL = {"p5_found": " UNION ALL ".join(_sql(*f) for f in _FIELDS)}
