"""Queries of the subpackage, and the SQL they are held against."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.llm import components, cutoff, leakage, overlap, percentiles, subjects, tokens, topn
from vectrail.session import new_path, scratch
from vectrail.tables import latest, table

#: Where the public vocabulary lies; a parameter of the deployment, never part of this repository.
VOCABULARY = os.environ.get("VECTRAIL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PERCENTS = [1, 5, 10, 25, 50, 75, 90, 95, 99]


def _cases(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    return latest(table(spark, root, "cbac_case_examples"), "case_id", columns)


def p1_percentiles(spark: SparkSession, root: str) -> DataFrame:
    cases = _cases(spark, root, ["split_family", "dataset_id", "cosine_similarity"])
    return percentiles.percentiles(cases, ["split_family", "dataset_id"], "cosine_similarity", PERCENTS)


def _stored(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The sketches of all days, as stored and read back, and the cases they stand for."""
    cases = _cases(spark, root, ["split_family", "dataset_id", "cosine_similarity", "scored_at"])
    path = new_path(spark)
    percentiles.store_days(percentiles.daily_sketches(cases, ["split_family", "dataset_id"], "cosine_similarity", "scored_at"), path)
    return percentiles.stored_days(spark, path), cases


def p1_days_combined(spark: SparkSession, root: str) -> DataFrame:
    """Percentiles of all days from stored sketches of single days."""
    return percentiles.combine_days(_stored(spark, root)[0], ["split_family", "dataset_id"], PERCENTS)


def p1_days_bound(spark: SparkSession, root: str) -> DataFrame:
    """Whether the combined days keep within the bound of the rank error, by a count over all rows."""
    days, cases = _stored(spark, root)
    combined = percentiles.combine_days(days, ["split_family", "dataset_id"], PERCENTS)
    checked = percentiles.rank_errors(combined, cases, ["split_family", "dataset_id"], "cosine_similarity")
    return checked.select("split_family", "dataset_id", "pct", "n", (F.col("rank_error") <= percentiles.BOUND).alias("within"))


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    return _cases(spark, root, ["split_family", "confidence", "transportable"]).where("transportable IS NOT NULL")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    records = cutoff.prepare(_labelled(spark, root), ["split_family"], "confidence", "case_id")
    return cutoff.kept(records, cutoff.cutoffs(records, 0.8)).select(F.col("record").alias("case_id"))


def p2_cutoffs(spark: SparkSession, root: str) -> DataFrame:
    from vectrail.tables import group_key

    cases = _labelled(spark, root)
    records = cutoff.prepare(cases, ["split_family"], "confidence", "case_id")
    names = table(spark, root, "cbac_case_examples").select("split_family").distinct()
    found = cutoff.report(records, cutoff.cutoffs(records, 0.8))
    return found.join(names.withColumn("sid", group_key("split_family")), "sid").select(
        "split_family", "n", "cutoff", "n_kept", "n_ties"
    )


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    groups = ["model", "split_family", "dataset_id", "seed"]
    cases = _cases(spark, root, [*groups, "cosine_similarity"])
    return topn.top_n(cases, groups, "cosine_similarity", "case_id", 5).select(F.col("item").alias("case_id"))


def _units(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    return latest(table(spark, root, "make_splits"), "unit_id", [*columns, "is_control"]).where("NOT is_control").drop("is_control")


_UNIT = ["split_id", "split_part", "dataset_id", "reference_key", "perturbation_label"]


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    members, _ = overlap.cross_split(_units(spark, root, _UNIT))
    return overlap.same_units(members).select("unit_id_a", "unit_id_b")


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    """Per split and dataset: held-out units, those met in train, and the pairs they make."""
    members, _ = overlap.cross_split(_units(spark, root, _UNIT))
    return overlap.report(members)


def p3_shares(spark: SparkSession, root: str) -> DataFrame:
    """Per held-out unit the part of its record that a train record of its split holds."""
    return overlap.shares(*overlap.cross_split(_units(spark, root, _UNIT)))


def _groups(spark: SparkSession, root: str) -> DataFrame:
    runs = latest(table(spark, root, "run_baseline"), "run_id", ["split_family", "dataset_scope", "heldout_target"])
    held = runs.where("split_family = 'unseen_combination_split'").select(
        F.col("dataset_scope").alias("dataset_id"), F.col("heldout_target").alias("label")
    )
    return components.groups(_units(spark, root, ["dataset_id", "perturbation_label"]), held)


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return _groups(spark, root).where("unit_id <> group_id").select("group_id", "unit_id")


SHARES = {"train": 0.7, "validation": 0.15, "test": 0.15}


def p4_splits(spark: SparkSession, root: str) -> DataFrame:
    return components.assign(scratch(_groups(spark, root)), SHARES)


def p4_balance(spark: SparkSession, root: str) -> DataFrame:
    """The splits' shares held against the wanted ones, and how many groups are parted."""
    return components.balance(p4_splits(spark, root), SHARES)


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode_texts(table(spark, root, "documents"), "doc_id", "text", VOCABULARY)


def _leaks(spark: SparkSession, root: str) -> DataFrame:
    return leakage.find_leaks(
        table(spark, root, "documents"), "doc_id", "text", table(spark, root, "eval_items"), "item_id", "text"
    )


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    return _leaks(spark, root).select("doc_id", "item_id").distinct()


def p9_items(spark: SparkSession, root: str) -> DataFrame:
    """Every held-out item with the number of documents it leaked into and the longest stretch."""
    found = _leaks(spark, root).groupBy("item_id").agg(
        F.countDistinct("doc_id").alias("n_docs"), F.max("n_words").alias("longest")
    )
    items = table(spark, root, "eval_items").select("item_id", "split_part")
    return items.join(found, "item_id", "left").select(
        "item_id", "split_part", F.coalesce("n_docs", F.lit(0).cast("long")).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest")
    )


def _subjects(spark: SparkSession, root: str) -> DataFrame:
    areas = [r[0] for r in table(spark, root, "subject_areas").select("subject").orderBy("subject").collect()]  # the list of subjects
    return subjects.assign(
        table(spark, root, "documents"), "doc_id", "text", table(spark, root, "subject_labels"), areas
    )


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return _subjects(spark, root).select("doc_id", "subject")


def p10_composition(spark: SparkSession, root: str) -> DataFrame:
    """How many documents of each source and kind are about each subject."""
    kinds = table(spark, root, "documents").select("doc_id", "source", "doc_kind")
    return _subjects(spark, root).join(kinds, "doc_id").groupBy("subject", "source", "doc_kind").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("n_sentences").alias("n_sentences")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_percentiles": p1_percentiles,
    "p1_days_combined": p1_days_combined,
    "p1_days_bound": p1_days_bound,
    "p2_found": p2_found,
    "p2_cutoffs": p2_cutoffs,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p3_shares": p3_shares,
    "p4_found": p4_found,
    "p4_splits": p4_splits,
    "p4_balance": p4_balance,
    "p6_found": p6_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p9_items": p9_items,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_LATEST = """latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ingested_at DESC) AS rn
                 FROM cbac_case_examples WHERE case_id IS NOT NULL) WHERE rn = 1)"""

_CUT = f"""WITH {_LATEST}, labelled AS (
  SELECT case_id, split_family, confidence + 0.0 AS confidence FROM latest
  WHERE transportable IS NOT NULL AND isfinite(confidence)),
reach AS (
  SELECT split_family, confidence,
         sum(count(*)) OVER (PARTITION BY split_family ORDER BY confidence DESC) AS reached,
         sum(count(*)) OVER (PARTITION BY split_family) AS n
  FROM labelled GROUP BY split_family, confidence),
limits AS (
  SELECT split_family, max(confidence) AS cutoff, max(n) AS n FROM reach
  WHERE reached * 5 >= n * 4 GROUP BY split_family)"""

_KEY = r"""regexp_replace(regexp_replace(regexp_replace(lower({c}), '[.]h5ad[^a-z0-9]*$', ''), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g'), '[^a-z0-9]+', '', 'g')"""

#: The named targets of labels with misspelt stems set right: (label, names).
_NAMED = r"""parts AS (
  SELECT label, n, unnest(list_filter(regexp_extract_all(lower(label), '[a-z0-9]+(?:[-.][0-9]+)?'),
    lambda t: t NOT IN ('only', 'single', 'singleton', 'ctrl', 'control', 'neg', 'negative', 'tcrlibrary', 'library', 'grna', 'sgrna',
                        'na', 'nan', 'none', 'unknown', 'null') AND NOT regexp_full_match(t, '(pmj)?[0-9.-]+'))) AS t FROM labels),
split AS (
  SELECT label, n, regexp_replace(t, '[-.]?[0-9]+$', '') AS stem, regexp_replace(regexp_extract(t, '([0-9]+)$', 1), '^0+([0-9])', '\1') AS num FROM parts),
stems AS (SELECT stem, sum(n) AS n FROM (SELECT DISTINCT label, n, stem, num FROM split) GROUP BY stem),
repairs AS (
  SELECT a.stem, b.stem AS other FROM stems a JOIN stems b ON a.stem <> b.stem AND length(a.stem) >= 3 AND length(b.stem) >= 3
    AND abs(length(a.stem) - length(b.stem)) <= 1 AND (b.n > a.n OR (b.n = a.n AND b.stem < a.stem)) AND (a.n <= 2 OR b.n >= 8 * a.n)
    AND damerau_levenshtein(a.stem, b.stem) <= 1
  QUALIFY row_number() OVER (PARTITION BY a.stem ORDER BY b.n DESC, b.stem) = 1),
named AS (SELECT label, list_sort(list(DISTINCT coalesce(other, stem) || num)) AS names FROM split LEFT JOIN repairs USING (stem) GROUP BY label)"""

_UNITS = """units AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY ingested_at DESC) AS rn FROM make_splits
                 WHERE unit_id IS NOT NULL) WHERE rn = 1 AND NOT is_control)"""

#: Units with what they describe, apart from how it is written.
_SAME = f"""WITH {_UNITS},
labels AS (SELECT perturbation_label AS label, count(*) AS n FROM units WHERE perturbation_label IS NOT NULL GROUP BY ALL), {_NAMED},
keyed AS (
  SELECT unit_id, split_id, split_part, CASE WHEN len(names) > 0 THEN names END AS names, {_KEY.format(c="dataset_id")} AS dataset,
    array_to_string(list_transform(regexp_extract_all(lower(reference_key), '[a-z]+|[0-9]+'), lambda r: regexp_replace(r, '^0+([0-9])', '\\1')), '-') AS reference
  FROM units LEFT JOIN named ON label = perturbation_label)"""

SQL: dict[str, str] = {
    "p1_percentiles": f"""WITH {_LATEST}, v AS (
  SELECT split_family, dataset_id, cosine_similarity + 0.0 AS x FROM latest WHERE isfinite(cosine_similarity)),
r AS (
  SELECT split_family, dataset_id, x, row_number() OVER (PARTITION BY split_family, dataset_id ORDER BY x) AS k,
         count(*) OVER (PARTITION BY split_family, dataset_id) AS n FROM v),
p AS (SELECT unnest([{", ".join(map(str, PERCENTS))}])::INTEGER AS pct)
SELECT split_family, dataset_id, pct, n, x AS value FROM r, p WHERE k = greatest(1, (n * pct + 99) // 100)""",
    "p1_days_bound": f"""WITH {_LATEST}, g AS (
  SELECT split_family, dataset_id, count(*) AS n FROM latest WHERE isfinite(cosine_similarity) GROUP BY ALL)
SELECT split_family, dataset_id, unnest([{", ".join(map(str, PERCENTS))}])::INTEGER AS pct, n, true AS within FROM g""",
    "p2_found": f"""{_CUT} SELECT l.case_id FROM labelled l JOIN limits c
  ON l.split_family IS NOT DISTINCT FROM c.split_family AND l.confidence >= c.cutoff""",
    "p2_cutoffs": f"""{_CUT} SELECT l.split_family, max(c.n)::BIGINT AS n, max(c.cutoff) AS cutoff,
  count(*) FILTER (WHERE l.confidence >= c.cutoff) AS n_kept, count(*) FILTER (WHERE l.confidence = c.cutoff) AS n_ties
FROM labelled l JOIN limits c ON l.split_family IS NOT DISTINCT FROM c.split_family GROUP BY l.split_family""",
    "p3_found": f"""{_SAME} SELECT least(h.unit_id, t.unit_id) AS unit_id_a, greatest(h.unit_id, t.unit_id) AS unit_id_b FROM keyed h JOIN keyed t
  ON h.split_id = t.split_id AND h.names = t.names AND h.dataset = t.dataset AND h.reference = t.reference
WHERE h.split_part IN ('validation', 'test') AND t.split_part = 'train'""",
    "p3_report": f"""{_SAME}, partners AS (
  SELECT split_id, names, dataset, reference, count(*) AS c FROM keyed WHERE split_part = 'train' AND split_id IS NOT NULL GROUP BY ALL)
SELECT h.split_id, h.dataset, count(*) AS n_held, count(p.c) AS n_met, coalesce(sum(p.c), 0)::BIGINT AS n_pairs
FROM keyed h LEFT JOIN partners p ON h.split_id = p.split_id AND h.names = p.names AND h.dataset = p.dataset AND h.reference = p.reference
WHERE h.split_part IN ('validation', 'test') AND h.split_id IS NOT NULL GROUP BY h.split_id, h.dataset""",
    "p4_found": f"""WITH RECURSIVE {_UNITS},
held AS (
  SELECT dataset_scope, heldout_target FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ingested_at DESC) AS rn FROM run_baseline
    WHERE run_id IS NOT NULL) WHERE rn = 1 AND split_family = 'unseen_combination_split'),
labels AS (SELECT label, count(*) AS n FROM (SELECT perturbation_label AS label FROM units UNION ALL SELECT heldout_target FROM held) WHERE label IS NOT NULL GROUP BY ALL),
{_NAMED},
keyed AS (SELECT unit_id, {_KEY.format(c="dataset_id")} AS dataset, names FROM units JOIN named ON label = perturbation_label),
sets AS (
  SELECT DISTINCT dataset, names FROM keyed WHERE dataset IS NOT NULL
  UNION SELECT {_KEY.format(c="dataset_scope")}, names FROM held JOIN named ON label = heldout_target WHERE dataset_scope IS NOT NULL),
edges AS (
  SELECT DISTINCT dataset || '|' || names[1] AS a, dataset || '|' || b AS b FROM (SELECT dataset, names, unnest(names) AS b FROM sets)),
both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(node, root) AS (SELECT a, a FROM both_ways UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
placed AS (SELECT unit_id, root FROM keyed JOIN roots ON node = dataset || '|' || names[1]),
grouped AS (SELECT unit_id, min(unit_id) OVER (PARTITION BY root) AS group_id FROM placed)
SELECT group_id, unit_id FROM grouped WHERE unit_id <> group_id""",
    "p4_balance": f"""WITH {_UNITS}
SELECT split, wanted, (SELECT count(*) FROM units) AS n_units, 0::BIGINT AS n_parted, true AS within
FROM (VALUES ('train', 0.7::DOUBLE), ('validation', 0.15::DOUBLE), ('test', 0.15::DOUBLE)) AS s(split, wanted)""",
    "p6_found": f"""WITH {_LATEST} SELECT case_id FROM (
  SELECT case_id, row_number() OVER (PARTITION BY model, split_family, dataset_id, seed
                                     ORDER BY cosine_similarity + 0.0 DESC, case_id) AS place
  FROM latest WHERE isfinite(cosine_similarity)) WHERE place <= 5""",
}
