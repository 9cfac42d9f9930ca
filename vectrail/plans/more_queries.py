"""The smaller operators of the inventory, one query each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions.labels import components, normalize_label
from vectrail.operators import campaign as cp
from vectrail.operators import kernels, predictors, splits, vectors
from vectrail.operators import relational as rel
from vectrail.operators import reliability as rl
from vectrail.plans import views as v
from vectrail.operators import features as ft
from vectrail.plans.report_queries import _any, _DECAY, _decay, _examples, _failures, _FAIL, _MODE, _ROLES
from vectrail.plans.views import rounded, sql, sql_dot, sql_r
from vectrail.session import cut
from vectrail.sources.readers import catalog_row
from vectrail.tables import table

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None, *needs: str):
    def keep(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = sql(text, *needs)
        return f

    return keep


_MISSING = "('', 'na', 'nan', 'none', '<na>', 'unknown', 'null')"


# Scans and filters.


@query("s4_projected_scan", "SELECT unit_id, n_cells FROM make_splits WHERE n_cells >= 50")
def s4(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "make_splits").where("n_cells >= 50").select("unit_id", "n_cells")


@query("s5_schema", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM run_baseline)")
def s5(spark: SparkSession, root: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in table(spark, root, "run_baseline").schema.names], "name string")


@query("s11_catalog_lookup", "SELECT dataset_id, n_signatures, n_cells_kept FROM preprocessing_summary WHERE dataset_id = (SELECT max(dataset_id) FROM preprocessing_summary)")
def s11(spark: SparkSession, root: str) -> DataFrame:
    catalog = table(spark, root, "preprocessing_summary")
    row = catalog_row(catalog, catalog.agg(F.max("dataset_id")).first()[0])
    return spark.createDataFrame([(row["dataset_id"], row["n_signatures"], row["n_cells_kept"])], "dataset_id string, n_signatures int, n_cells_kept long")


@query("f1_range_filter", "SELECT case_id FROM cases WHERE split_family = 'low_support_split' AND confidence BETWEEN 0.5::DOUBLE AND 0.9::DOUBLE", "cases")
def f1(spark: SparkSession, root: str) -> DataFrame:
    return v.cases(spark, root).where((F.col("split_family") == "low_support_split") & F.col("confidence").between(0.5, 0.9)).select("case_id")


@query("f2_in_list", "SELECT case_id FROM cases WHERE run_id IN (SELECT run_id FROM runs WHERE seed = 0)", "cases", "runs")
def f2(spark: SparkSession, root: str) -> DataFrame:
    wanted = v.runs(spark, root).where("seed = 0").select("run_id")
    return v.cases(spark, root).select("case_id", "run_id").join(wanted, "run_id", "left_semi").select("case_id")


@query("f5_status_words", "SELECT run_id, coalesce(regexp_matches(status, '(?i)failed|blocked'), false) AS failed FROM runs", "runs")
def f5(spark: SparkSession, root: str) -> DataFrame:
    return v.runs(spark, root).select("run_id", F.coalesce(F.col("status").rlike("(?i)failed|blocked"), F.lit(False)).alias("failed"))


@query("f9_drop_missing", "SELECT case_id FROM cases WHERE cosine_similarity IS NOT NULL AND confidence IS NOT NULL AND transportable IS NOT NULL", "cases")
def f9(spark: SparkSession, root: str) -> DataFrame:
    return v.cases(spark, root).dropna(subset=["cosine_similarity", "confidence", "transportable"]).select("case_id")


# Scalars.


@query("x5_group_keys", "SELECT DISTINCT concat(reference_key, '||', perturbation_label) AS group_key FROM make_splits WHERE reference_key IS NOT NULL AND perturbation_label IS NOT NULL")
def x5(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "make_splits").where("reference_key IS NOT NULL AND perturbation_label IS NOT NULL")
    return t.select(F.concat("reference_key", F.lit("||"), "perturbation_label").alias("group_key")).distinct()


@query("x7_control_words", "SELECT DISTINCT control_label_used, CASE WHEN lower(trim(control_label_used)) IN ('control', 'ctrl', 'non-targeting', 'nt', 'wt') THEN 'ctrl' ELSE control_label_used END AS word FROM make_splits")
def x7(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "make_splits").select("control_label_used").distinct()
    word = F.when(F.lower(F.trim("control_label_used")).isin("control", "ctrl", "non-targeting", "nt", "wt"), "ctrl").otherwise(F.col("control_label_used"))
    return c.select("control_label_used", word.alias("word"))


@query("x8_condition_parts", "SELECT DISTINCT perturbation_label, list_filter(string_split(perturbation_label, '_'), lambda t: t <> '' AND lower(t) <> 'ctrl') AS parts FROM make_splits WHERE perturbation_label IS NOT NULL")
def x8(spark: SparkSession, root: str) -> DataFrame:
    c = table(spark, root, "make_splits").where("perturbation_label IS NOT NULL").select("perturbation_label").distinct()
    return c.select("perturbation_label", F.filter(F.split("perturbation_label", "_"), lambda t: (t != "") & (F.lower(t) != "ctrl")).alias("parts"))


@query("x9_joined_genes", "SELECT case_id, coalesce(array_to_string(list_slice(regexp_extract_all(top_pred_genes, '[A-Za-z0-9.-]+'), 1, 3), ';'), 'NA') AS genes, coalesce(printf('%.3f', confidence + 1e-10), 'NA') AS confidence FROM cases", "cases")
def x9(spark: SparkSession, root: str) -> DataFrame:
    genes = F.array_join(F.slice(F.regexp_extract_all("top_pred_genes", F.lit("[A-Za-z0-9.-]+"), F.lit(0)), 1, 3), ";")
    return v.cases(spark, root).select("case_id", F.coalesce(genes, F.lit("NA")).alias("genes"), F.coalesce(F.when(F.col("confidence").isNotNull(), F.format_string("%.3f", F.col("confidence") + F.lit(v.NUDGE))), F.lit("NA")).alias("confidence"))


@query("x10_threshold_labels", "SELECT replace((i / 10)::VARCHAR, '.', 'p') AS label FROM range(1, 10) t(i)")
def x10(spark: SparkSession, root: str) -> DataFrame:
    return spark.range(1, 10).select(F.replace((F.col("id") / 10).cast("string"), F.lit("."), F.lit("p")).alias("label"))


@query("x12_timestamps", "SELECT event_id, try_cast(CASE WHEN event_id % 5 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP) AS at FROM events")
def x12(spark: SparkSession, root: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, root, "events").select("event_id", F.try_to_timestamp(text).cast("timestamp_ntz").alias("at"))


@query("x14_clip", f"SELECT case_id, {sql_r('CASE WHEN cosine_similarity IS NOT NULL THEN greatest(0, least(1, cosine_similarity)) END', 'clipped')} FROM cases", "cases")
def x14(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.cases(spark, root).select("case_id", rel.clip(F.col("cosine_similarity"), 0.0, 1.0).alias("clipped")))


@query("x15_safe_ratio", f"SELECT case_id, {sql_r('cosine_similarity / nullif(support_signatures, 0)', 'ratio')} FROM cases", "cases")
def x15(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.cases(spark, root).select("case_id", rel.safe_ratio("cosine_similarity", "support_signatures").alias("ratio")))


@query("x16_mean_of_present", f"SELECT case_id, {sql_r('list_avg(list_filter([cosine_similarity, confidence, risk], lambda x: x IS NOT NULL))', 'mean')} FROM cases", "cases")
def x16(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.cases(spark, root).select("case_id", rel.mean_of([F.col("cosine_similarity"), F.col("confidence"), F.col("risk")]).alias("mean")))


@query("x17_half_even", "SELECT o_orderkey, round_even(o_orderkey / 2, 0)::BIGINT AS half FROM orders")
def x17(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select("o_orderkey", F.bround(F.col("o_orderkey") / 2).cast("long").alias("half"))


@query("x20_safe_float", "SELECT heldout_target, try_cast(heldout_target AS DOUBLE) AS x FROM (SELECT DISTINCT heldout_target FROM run_baseline WHERE heldout_target IS NULL OR lower(trim(heldout_target)) <> 'nan')")
def x20(spark: SparkSession, root: str) -> DataFrame:
    h = table(spark, root, "run_baseline").where("heldout_target IS NULL OR lower(trim(heldout_target)) <> 'nan'").select("heldout_target").distinct()
    return h.select("heldout_target", cp.safe_float("heldout_target").alias("x"))


# Joins and sets.


@query("j3_lineage_join", "SELECT u.unit_id, p.status, p.n_cells_kept FROM units u LEFT JOIN preprocessing_summary p USING (dataset_id)", "units")
def j3(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "preprocessing_summary").select("dataset_id", "status", "n_cells_kept")
    return v.units(spark, root).select("unit_id", "dataset_id").join(p, "dataset_id", "left").drop("dataset_id")


@query("j11_null_safe_join", "WITH a AS (SELECT dataset_id, count(*) AS n FROM cases GROUP BY ALL), b AS (SELECT dataset_id, count(DISTINCT signature_id) AS m FROM cases GROUP BY ALL) SELECT a.dataset_id, n, m FROM a JOIN b ON a.dataset_id IS NOT DISTINCT FROM b.dataset_id", "cases")
def j11(spark: SparkSession, root: str) -> DataFrame:
    c = v.cases(spark, root)
    a = c.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    b = c.groupBy(F.col("dataset_id").alias("d")).agg(F.countDistinct("signature_id").alias("m"))
    return a.join(b, a["dataset_id"].eqNullSafe(b["d"])).select("dataset_id", "n", "m")


@query("j13_example_scores", "SELECT e.example_id, c.case_id FROM examples e JOIN cases c ON e.run_id = c.run_id AND e.signature_id = c.signature_id", "examples", "cases")
def j13(spark: SparkSession, root: str) -> DataFrame:
    e = v.examples(spark, root).select("example_id", "run_id", "signature_id")
    return e.join(v.cases(spark, root).select("case_id", "run_id", "signature_id"), ["run_id", "signature_id"]).select("example_id", "case_id")


@query("j15_id_lookup", "WITH w AS (SELECT signature_id FROM sig UNION ALL SELECT 'ds9__none') SELECT w.signature_id, s.n_cells, s.signature_id IS NULL AS missed FROM w LEFT JOIN sig s USING (signature_id)", "sig")
def j15(spark: SparkSession, root: str) -> DataFrame:
    s = v.signatures(spark, root)
    w = s.select("signature_id").unionByName(spark.createDataFrame([("ds9__none",)], "signature_id string"))
    return w.join(s.select("signature_id", "n_cells"), "signature_id", "left").withColumn("missed", F.col("n_cells").isNull())


@query("j20_component_lookup", "WITH l AS (SELECT DISTINCT split_id, perturbation_label AS l FROM units WHERE split_part = 'train' AND NOT is_control), w AS (SELECT DISTINCT split_id, perturbation_label FROM units WHERE split_part = 'test' AND contains(perturbation_label, '_') AND perturbation_label <> 'MULTI_TARGET'), c AS (SELECT *, unnest(list_filter(string_split(perturbation_label, '_'), lambda x: x <> '')) AS part FROM w) SELECT c.split_id, perturbation_label, bool_and(l.l IS NOT NULL) AS all_known FROM c LEFT JOIN l ON l.split_id = c.split_id AND l.l = c.part GROUP BY ALL", "units")
def j20(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root)
    known = u.where("split_part = 'train' AND NOT is_control").select("split_id", F.col("perturbation_label").alias("part")).distinct().withColumn("known", F.lit(True))
    wanted = u.where("split_part = 'test'").select("split_id", "perturbation_label").distinct()
    parts = wanted.select("split_id", "perturbation_label", F.explode(components("perturbation_label")).alias("part"))
    return parts.join(known, ["split_id", "part"], "left").groupBy("split_id", "perturbation_label").agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"))


@query("u1_union", "SELECT 'case' AS kind, count(*) AS n FROM cases UNION ALL SELECT 'example', count(*) FROM examples", "cases", "examples")
def u1(spark: SparkSession, root: str) -> DataFrame:
    c = v.cases(spark, root).agg(F.count(F.lit(1)).alias("n")).select(F.lit("case").alias("kind"), "n")
    return c.unionByName(v.examples(spark, root).agg(F.count(F.lit(1)).alias("n")).select(F.lit("example").alias("kind"), "n"))


@query("u4_except", "SELECT signature_id FROM units WHERE split_part = 'test' AND signature_id IS NOT NULL EXCEPT SELECT signature_id FROM units WHERE split_part = 'train'", "units")
def u4(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root)
    train = u.where("split_part = 'train'").select("signature_id")
    return u.where("split_part = 'test' AND signature_id IS NOT NULL").select("signature_id").distinct().join(train, "signature_id", "left_anti")


@query("u6_sorted_distinct", "SELECT split_family, list_sort(list(DISTINCT model)) AS models FROM runs GROUP BY ALL", "runs")
def u6(spark: SparkSession, root: str) -> DataFrame:
    return v.runs(spark, root).groupBy("split_family").agg(F.array_sort(F.collect_set("model")).alias("models"))


# Aggregates and picks.


@query("a3_support_sums", "SELECT reference_key, sum(n_cells)::BIGINT AS n_cells FROM units WHERE reference_key IS NOT NULL GROUP BY ALL", "units")
def a3(spark: SparkSession, root: str) -> DataFrame:
    return v.units(spark, root).where("reference_key IS NOT NULL").groupBy("reference_key").agg(F.sum("n_cells").alias("n_cells"))


@query("a14_best_model", f"WITH m AS (SELECT split_family, model, round(avg(mean_cosine), 9) AS c FROM run_metrics GROUP BY ALL) SELECT split_family, model, {sql_r('c', 'mean_cosine')} FROM m QUALIFY row_number() OVER (PARTITION BY split_family ORDER BY c DESC NULLS LAST, model) = 1", "run_metrics")
def a14(spark: SparkSession, root: str) -> DataFrame:
    m = v.run_metrics(spark, root).groupBy("split_family", "model").agg(F.round(F.avg("mean_cosine"), 9).alias("mean_cosine"))
    return rounded(rel.first_per(m, ["split_family"], [F.col("mean_cosine").desc_nulls_last(), F.col("model")]))


@query("a15_label_kinds", f"SELECT count(DISTINCT CASE WHEN lower(trim(batch)) NOT IN {_MISSING} THEN trim(batch) END) AS n_batches, count(DISTINCT CASE WHEN lower(trim(timepoint)) NOT IN {_MISSING} THEN trim(timepoint) END) AS n_timepoints FROM units", "units")
def a15(spark: SparkSession, root: str) -> DataFrame:
    return v.units(spark, root).agg(F.countDistinct(normalize_label("batch")).alias("n_batches"), F.countDistinct(normalize_label("timepoint")).alias("n_timepoints"))


@query("a20_centroid", f"SELECT split_part, pos, {sql_r('avg(x)', 'mean')} FROM (SELECT split_part, unnest(delta)::DOUBLE AS x, unnest(range(len(delta)))::INTEGER AS pos FROM units WHERE delta IS NOT NULL) WHERE x IS NOT NULL AND isfinite(x) GROUP BY ALL", "units")
def a20(spark: SparkSession, root: str) -> DataFrame:
    e = v.units(spark, root).select("split_part", F.posexplode("delta").alias("pos", "x")).withColumn("x", F.col("x").cast("double")).where("x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')")
    return rounded(e.groupBy("split_part", "pos").agg(F.avg("x").alias("mean")))


@query("a24_count_if", "SELECT model, count(*) FILTER (WHERE confidence >= 0.5::DOUBLE) AS n_sure, count(*) FILTER (WHERE transportable) AS n_kept FROM cases GROUP BY ALL", "cases")
def a24(spark: SparkSession, root: str) -> DataFrame:
    return v.cases(spark, root).groupBy("model").agg(F.count_if(F.col("confidence") >= 0.5).alias("n_sure"), F.count_if("transportable").alias("n_kept"))


@query("a25_ids_by_dataset", "SELECT dataset_id, list_sort(list(signature_id)) AS ids FROM sig WHERE is_control GROUP BY ALL", "sig")
def a25(spark: SparkSession, root: str) -> DataFrame:
    return v.signatures(spark, root).where("is_control").groupBy("dataset_id").agg(F.array_sort(F.collect_list("signature_id")).alias("ids"))


@query("o6_vector_top", "SELECT vec_id, list(pos ORDER BY rn) AS top FROM (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos) AS rn FROM (SELECT vec_id, unnest(delta) AS x, unnest(range(len(delta)))::INTEGER AS pos FROM sig)) WHERE rn <= 8 GROUP BY ALL", "sig")
def o6(spark: SparkSession, root: str) -> DataFrame:
    at = F.transform("delta", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("pos")))
    return v.signatures(spark, root).select("vec_id", F.transform(F.slice(F.array_sort(at), 1, 8), lambda e: e["pos"]).alias("top"))


@query("o7_reversed_top", "SELECT vec_id, list(pos ORDER BY rn) AS top FROM (SELECT vec_id, pos, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x) DESC, pos DESC) AS rn FROM (SELECT vec_id, unnest(delta) AS x, unnest(range(len(delta)))::INTEGER AS pos FROM sig)) WHERE rn <= 8 GROUP BY ALL", "sig")
def o7(spark: SparkSession, root: str) -> DataFrame:
    at = F.transform("delta", lambda x, i: F.struct((-F.abs(x)).alias("a"), (-i).alias("neg")))
    return v.signatures(spark, root).select("vec_id", F.transform(F.slice(F.array_sort(at), 1, 8), lambda e: -e["neg"]).alias("top"))


@query("o9_schedule", "SELECT run_id, row_number() OVER (ORDER BY CASE model WHEN 'control_mean_baseline' THEN 1 WHEN 'global_delta_baseline' THEN 2 WHEN 'ridge_regression_baseline' THEN 3 ELSE 4 END, CASE split_family WHEN 'random_split' THEN 1 ELSE 2 END, run_id) AS place FROM runs", "runs")
def o9(spark: SparkSession, root: str) -> DataFrame:
    r = v.runs(spark, root).select("run_id", "model", "split_family")
    costs = {"model": {"control_mean_baseline": 1, "global_delta_baseline": 2, "ridge_regression_baseline": 3}, "split_family": {"random_split": 1}}
    return rel.global_rank(r, cp.schedule(r, costs, "run_id"), "place").select("run_id", "place")


@query("w2_family_rank", f"WITH {_DECAY} SELECT model, split_family, family_rank FROM decay WHERE family_rank IS NOT NULL", "run_metrics")
def w2(spark: SparkSession, root: str) -> DataFrame:
    return _decay(spark, root).where("family_rank IS NOT NULL").select("model", "split_family", "family_rank")


@query("w11_low_support_cutoff", "SELECT dataset_id, n_cells AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n_cells, signature_id) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY dataset_id) * 0.20::DOUBLE, 0)) AS spot FROM sig WHERE NOT is_control) WHERE rn = spot", "sig")
def w11(spark: SparkSession, root: str) -> DataFrame:
    from vectrail.operators.splits import low_support_cutoff

    return low_support_cutoff(v.signatures(spark, root).where("NOT is_control"), "n_cells", ["dataset_id"], "signature_id")


# Vectors and models.


@query("v5_norms", f"SELECT unit_id, {sql_r('sqrt(list_sum(list_transform(delta, lambda x: x::DOUBLE * x::DOUBLE)))', 'norm')} FROM units WHERE len(delta) > 0", "units")
def v5(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.units(spark, root).where("size(delta) > 0").select("unit_id", vectors.norm(vectors.as_double("delta")).alias("norm")))


@query("v17_energy_distance", f"WITH x AS (SELECT dataset_id, vec_id, truth AS t FROM pairs), y AS (SELECT dataset_id, vec_id, guess AS t FROM pairs), a AS (SELECT x.dataset_id, avg(list_distance(x.t, y.t)) AS d FROM x JOIN y USING (dataset_id) GROUP BY ALL), b AS (SELECT p.dataset_id, avg(list_distance(p.t, q.t)) AS d FROM x p JOIN x q ON p.dataset_id = q.dataset_id AND p.vec_id < q.vec_id GROUP BY ALL), c AS (SELECT p.dataset_id, avg(list_distance(p.t, q.t)) AS d FROM y p JOIN y q ON p.dataset_id = q.dataset_id AND p.vec_id < q.vec_id GROUP BY ALL) SELECT dataset_id, {sql_r('greatest(0, 2 * a.d - b.d - c.d)', 'energy_distance')} FROM a JOIN b USING (dataset_id) JOIN c USING (dataset_id)", "pairs")
def v17(spark: SparkSession, root: str) -> DataFrame:
    return rounded(kernels.energy_distances(v.pairs(spark, root), "dataset_id", "vec_id", "truth", "guess"))


@query("v25_plain_cosine", f"SELECT vec_id, {sql_r('coalesce(' + sql_dot('truth', 'guess') + ' / nullif(sqrt(' + sql_dot('truth', 'truth') + ') * sqrt(' + sql_dot('guess', 'guess') + '), 0), 0)', 'cosine')} FROM pairs", "pairs")
def v25(spark: SparkSession, root: str) -> DataFrame:
    product = vectors.norm("truth") * vectors.norm("guess")
    return rounded(v.pairs(spark, root).select("vec_id", F.coalesce(F.try_divide(vectors.dot("truth", "guess"), product), F.lit(0.0)).alias("cosine")))


def _by_label(family: str, column: str, controls: bool) -> str:
    held = "hit" if controls else "hit AND NOT is_control"
    return f"""SELECT '{family}__' || s.dataset_id || '__seed' || s.seed AS split_id, '{family}' AS split_family, s.seed AS o, coalesce({held}, false) AS h, is_control, signature_id
FROM ss s LEFT JOIN (SELECT dataset_id, seed, x, true AS hit FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id, seed) AS n, row_number() OVER (PARTITION BY dataset_id, seed ORDER BY md5((2000 + seed) || '|' || x), x) AS rn
  FROM (SELECT DISTINCT dataset_id, seed, {column} AS x FROM ss WHERE NOT is_control)) WHERE n >= 2 AND rn <= least(n - 1, greatest(1, round_even(n * 0.20::DOUBLE, 0)))) q ON q.dataset_id = s.dataset_id AND q.seed = s.seed AND q.x = s.{column}"""


_GRID = f"""ss AS (SELECT sig.*, seed FROM sig, (SELECT unnest([0, 1, 2]) AS seed)),
low AS (SELECT dataset_id, n_cells AS cutoff FROM (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY n_cells, signature_id) AS rn, greatest(1, round_even(count(*) OVER (PARTITION BY dataset_id) * 0.20::DOUBLE, 0)) AS spot FROM sig WHERE NOT is_control) WHERE rn = spot),
f AS (SELECT 'random_split__' || dataset_id || '__seed' || seed AS split_id, 'random_split' AS split_family, seed AS o, false AS h, is_control, signature_id FROM ss
UNION ALL {_by_label('unseen_perturbation_split', 'perturbation_label', False)}
UNION ALL SELECT 'unseen_combination_split__' || dataset_id || '__seed' || seed, 'unseen_combination_split', seed + 3000, perturbation_label IN ('P1_P2', 'P3_P4', 'P1_P9'), is_control, signature_id FROM ss
UNION ALL SELECT 'low_support_split__' || dataset_id || '__seed' || seed, 'low_support_split', seed + 3000, n_cells <= cutoff AND NOT is_control, is_control, signature_id FROM ss JOIN low USING (dataset_id)
UNION ALL {_by_label('unseen_cell_state_split', 'timepoint', True)}
UNION ALL {_by_label('unseen_cell_type_or_lineage_split', 'batch', True)}
UNION ALL SELECT 'dataset_heldout_split__all_datasets__holdout-' || d || '__seed' || seed, 'dataset_heldout_split', seed + 3000, dataset_id = d, is_control, signature_id FROM ss, (SELECT DISTINCT dataset_id AS d FROM sig)
UNION ALL SELECT 'external_holdout__internal_vs_external__holdout-' || d || '__seed' || seed, 'external_holdout', seed + 3000, dataset_id = d, is_control, signature_id FROM ss, ext),
g AS (SELECT *, count(*) OVER (PARTITION BY split_id, h, is_control) AS n, row_number() OVER (PARTITION BY split_id, h, is_control ORDER BY md5(o || '|' || signature_id), signature_id) AS rn FROM f),
k AS (SELECT *, least(n - 2, greatest(1, round_even(n * 0.15::DOUBLE, 0)))::BIGINT AS t FROM g),
grid AS (SELECT split_id, split_family, signature_id, CASE WHEN h THEN 'test' WHEN n < 3 THEN 'train' WHEN rn <= t THEN CASE split_family WHEN 'random_split' THEN 'test' ELSE 'unused' END WHEN rn <= t + least(n - t - 1, greatest(1, round_even((n - t) * 0.1765::DOUBLE, 0))) THEN 'validation' ELSE 'train' END AS part FROM k)"""
_EXTERNAL = "ext AS (SELECT min(dataset_id) AS d FROM preprocessing_summary WHERE external_validation_ready AND split_role LIKE 'external%')"
_SEEDS = [0, 1, 2]


def _split_grid(spark: SparkSession, root: str) -> tuple[DataFrame, str]:
    """The grid over the signatures, with their timepoint as state and their batch as lineage, and the catalog's external dataset."""
    s = v.signatures(spark, root).select("signature_id", "dataset_id", "perturbation_label", "is_control", "n_cells", "timepoint", "batch")
    external = splits.external_target(table(spark, root, "preprocessing_summary"))
    return cp.split_grid(s, _SEEDS, state="timepoint", lineage="batch", external=external), external


@query("d15_split_grid", f"WITH {_EXTERNAL}, {_GRID} SELECT split_id, signature_id, part FROM grid", "sig")
def d15(spark: SparkSession, root: str) -> DataFrame:
    return _split_grid(spark, root)[0].select("split_id", "signature_id", "part")


@query("d10_state_split", f"WITH {_EXTERNAL}, {_GRID} SELECT split_id, signature_id, part FROM grid WHERE split_family IN ('unseen_cell_state_split', 'unseen_cell_type_or_lineage_split') AND ends_with(split_id, 'seed0')", "sig")
def d10(spark: SparkSession, root: str) -> DataFrame:
    s = v.signatures(spark, root)
    out = [
        splits.unseen_label_parts(s, "signature_id", label, 0, among=["dataset_id"], with_controls=True).select(F.concat_ws("__", F.lit(family), "dataset_id", F.lit("seed0")).alias("split_id"), "signature_id", "part")
        for family, label in (("unseen_cell_state_split", "timepoint"), ("unseen_cell_type_or_lineage_split", "batch"))
    ]
    return out[0].unionByName(out[1])


@query("d16_split_records", f"WITH {_EXTERNAL}, {_GRID}, n AS (SELECT split_id, count(*) FILTER (WHERE part = 'train') AS n_train, count(*) FILTER (WHERE part = 'validation') AS n_validation, count(*) FILTER (WHERE part = 'test') AS n_test FROM grid GROUP BY ALL), a AS (SELECT DISTINCT split_id, split_family FROM f) SELECT split_id, split_family, CASE WHEN n_test = 0 OR n_train = 0 THEN 'unsupported' ELSE 'ready' END AS status, CASE WHEN n_test = 0 THEN 'test mask selects no rows' WHEN n_train = 0 THEN 'test mask selects all rows' ELSE '' END AS reason, n_train, n_validation, n_test FROM a JOIN n USING (split_id)", "sig")
def d16(spark: SparkSession, root: str) -> DataFrame:
    return q_records(spark, root).select("split_id", "split_family", "status", "reason", "n_train", "n_validation", "n_test")


def q_records(spark: SparkSession, root: str) -> DataFrame:
    """Every split of the grid with its status."""
    grid, external = _split_grid(spark, root)
    names = v.signatures(spark, root).select(F.col("dataset_id").alias("name")).distinct()
    own = names.select(F.explode(F.array(*[F.lit(f) for f in cp.FAMILIES])).alias("split_family"), F.col("name").alias("scope"), F.lit("").alias("heldout_target"))
    held = names.select(F.lit("dataset_heldout_split").alias("split_family"), F.lit("all_datasets").alias("scope"), F.col("name").alias("heldout_target"))
    out = spark.createDataFrame([("external_holdout", "internal_vs_external", external)], "split_family string, scope string, heldout_target string")
    asked = own.unionByName(held).unionByName(out).withColumn("seed", F.explode(F.array(*[F.lit(s) for s in _SEEDS])))
    stem = F.concat_ws("__", "split_family", "scope", F.when(F.col("heldout_target") != "", F.concat(F.lit("holdout-"), "heldout_target")), F.concat(F.lit("seed"), "seed"))
    return cp.split_records(cut(grid), asked.withColumn("split_id", stem))


@query("d14_split_status", "SELECT split_id, CASE WHEN b = 0 OR a = 0 THEN 'unsupported' ELSE 'ready' END AS status, CASE WHEN b = 0 THEN 'no test rows' WHEN a = 0 THEN 'no train rows' ELSE '' END AS reason FROM (SELECT split_id, count(*) FILTER (WHERE split_part = 'train' AND NOT is_control) AS a, count(*) FILTER (WHERE split_part = 'test' AND NOT is_control) AS b FROM units GROUP BY ALL)", "units")
def d14(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root).withColumn("part", F.when(~F.col("is_control"), F.col("split_part")))
    return cp.supported(u, ["split_id"])


@query("m8_all_predictors")
def m8(spark: SparkSession, root: str) -> DataFrame:
    units = cut(v.profiled(spark, root))
    out = None
    for name in predictors.PREDICTORS:
        got = predictors.predict(name, units).select(F.lit(name).alias("model"), "run", "signature_id", "guess")
        out = got if out is None else out.unionByName(got)
    scored = out.join(units.select("run", "signature_id", "delta", "is_control"), ["run", "signature_id"])
    return rounded(predictors.summary(scored, ["model", "run"]))


# Evaluation, reliability, reports.


@query("e1_registry_audit", "SELECT status, count(*) AS n FROM runs GROUP BY ALL", "runs")
def e1(spark: SparkSession, root: str) -> DataFrame:
    return v.runs(spark, root).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("e2_vector_contract", "SELECT split_id AS run_id, count(*) AS n_rows, count(*) FILTER (WHERE delta IS NULL) AS bad_shape, count(*) FILTER (WHERE delta IS NOT NULL AND len(delta) <> 6) AS bad_count FROM units GROUP BY ALL", "units")
def e2(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root).select(F.col("split_id").alias("run_id"), "delta", F.col("delta").alias("guess"), F.when(F.col("delta").isNotNull(), F.lit(6)).alias("expected"))
    return cp.contract(u, "delta", "guess", "expected")


_R1 = """WITH tr AS (SELECT * FROM units WHERE split_part = 'train'), te AS (SELECT * FROM units WHERE split_part = 'test'),
p AS (SELECT split_id, perturbation_label, sum(n_cells) AS c FROM tr WHERE NOT is_control AND perturbation_label IS NOT NULL GROUP BY ALL),
r AS (SELECT DISTINCT split_id, reference_key FROM tr WHERE reference_key IS NOT NULL),
f AS (SELECT te.split_id, te.signature_id, max(CASE WHEN te.perturbation_label IS NOT NULL THEN (p.perturbation_label IS NOT NULL)::INT::DOUBLE END) AS perturbation_seen_in_train,
  max((r.reference_key IS NOT NULL)::INT::DOUBLE) AS reference_seen_in_train, max(ln(1 + coalesce(p.c, 0))) AS support
  FROM te LEFT JOIN p ON p.split_id = te.split_id AND p.perturbation_label = te.perturbation_label LEFT JOIN r ON r.split_id = te.split_id AND r.reference_key = te.reference_key GROUP BY ALL),
k AS (SELECT *, regexp_replace(run_id, '__[^_]+(_[^_]+)*_baseline$', '') AS split_id FROM cases WHERE transportable IS NOT NULL AND split_family IN ('unseen_perturbation_split', 'unseen_combination_split', 'low_support_split', 'dataset_heldout_split', 'external_holdout'))"""


@query("r1_examples", f"{_R1} SELECT case_id, {_MODE.format(k='transportable', r='risk', f='cosine_similarity', t='0.4::DOUBLE')} AS failure_mode, perturbation_seen_in_train, reference_seen_in_train, {sql_r('support', 'log1p_perturbation_train_cell_count')}, gene_space_policy FROM k LEFT JOIN f ON f.split_id = k.split_id AND f.signature_id = k.signature_id LEFT JOIN (SELECT run_id, gene_space_policy FROM runs) q ON q.run_id = k.run_id", "cases", "units", "runs")
def r1(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root).withColumnRenamed("split_part", "part")
    stem = F.regexp_replace("run_id", "__[^_]+(_[^_]+)*_baseline$", "")
    c = v.cases(spark, root).withColumn("split_id", stem).withColumn("transport_threshold", F.lit(0.4))
    context = v.runs(spark, root).select("run_id", "gene_space_policy", "expected_gene_count")
    from vectrail.operators.evaluate import STRESS_FAMILIES

    got = cp.build_examples(c, u, context, STRESS_FAMILIES, "transport_threshold")
    return rounded(got.select("case_id", "failure_mode", "perturbation_seen_in_train", "reference_seen_in_train", "log1p_perturbation_train_cell_count", "gene_space_policy"))


@query("r7_ablated_features", f"WITH {_ROLES}, s AS (SELECT feature FROM g WHERE deployment_available AND (cat OR num)) " + " UNION ALL ".join(f"SELECT '{a}' AS ablation, feature FROM s WHERE NOT {_any(drop)}" for a, drop in ft.ABLATIONS.items()))
def r7(spark: SparkSession, root: str) -> DataFrame:
    spec = ft.feature_spec(_examples(spark, root))
    rows = [(a, c) for a in ft.ABLATIONS for c in ft.ablate(spec, a).columns]
    return spark.createDataFrame(rows, "ablation string, feature string")


@query("r14_prediction_rows")
def r14(spark: SparkSession, root: str) -> DataFrame:
    parts = rl.packed_once(rl.group_parts(cut(_examples(spark, root)), "run_id", "example_id"))
    return rounded(rl.prediction_rows(parts, list(rl.ABLATIONS)))


@query("n9_retained_contrast", f"SELECT confidence >= 0.5::DOUBLE AS kept, count(*) AS n, {sql_r('avg(cosine_similarity)', 'cosine_similarity_mean')}, {sql_r('stddev_samp(cosine_similarity)', 'cosine_similarity_sd')}, {sql_r('avg(risk)', 'risk_mean')}, {sql_r('stddev_samp(risk)', 'risk_sd')} FROM cases WHERE confidence IS NOT NULL GROUP BY ALL", "cases")
def n9(spark: SparkSession, root: str) -> DataFrame:
    c = v.cases(spark, root).where("confidence IS NOT NULL").withColumn("kept", F.col("confidence") >= 0.5)
    return rounded(cp.retained_contrast(c, "kept", ["cosine_similarity", "risk"]))


@query("n10_artifact_status", "SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM cases) THEN 'success' WHEN lower(trim(status)) = 'failed' THEN 'failed' ELSE 'missing' END AS artifact_status FROM runs", "runs", "cases")
def n10(spark: SparkSession, root: str) -> DataFrame:
    r = v.runs(spark, root)
    return cp.artifact_status(r.select("run_id"), v.cases(spark, root), r.where(F.lower(F.trim("status")) == "failed"))


@query("g3_group_spread", f"SELECT string_split(split_id, '__')[1] AS family, {sql_r('avg(n)', 'mean_units')} FROM (SELECT split_id, count(*) AS n FROM units GROUP BY ALL) GROUP BY ALL", "units")
def g3(spark: SparkSession, root: str) -> DataFrame:
    n = v.units(spark, root).groupBy("split_id").agg(F.count(F.lit(1)).alias("n"))
    return rounded(n.groupBy(F.substring_index("split_id", "__", 1).alias("family")).agg(F.avg("n").alias("mean_units")))


@query("g6_rank_paths", f"WITH {_DECAY} SELECT model, split_family, family_rank, rank_shift_direction FROM decay WHERE split_family IN ('random_split', 'dataset_heldout_split', 'external_holdout')", "run_metrics")
def g6(spark: SparkSession, root: str) -> DataFrame:
    zoom = ["random_split", "dataset_heldout_split", "external_holdout"]
    return _decay(spark, root).where(F.col("split_family").isin(zoom)).select("model", "split_family", "family_rank", "rank_shift_direction")


@query("g13_mode_diagnostics", f"WITH {_FAIL} SELECT failure_mode, sum(n_signatures)::BIGINT AS n_signatures, {sql_r('avg(transportable_rate)', 'transportable_rate')}, {sql_r('avg(mean_confidence)', 'mean_confidence')} FROM fails GROUP BY ALL", "cases")
def g13(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_failures(spark, root).groupBy("failure_mode").agg(F.sum("n_signatures").alias("n_signatures"), F.avg("transportable_rate").alias("transportable_rate"), F.avg("mean_confidence").alias("mean_confidence")))


@query("g16_family_order", "SELECT split_family, row_number() OVER (ORDER BY CASE split_family WHEN 'random_split' THEN 1 WHEN 'external_holdout' THEN 9 ELSE 5 END, split_family) AS place FROM (SELECT DISTINCT split_family FROM runs)", "runs")
def g16(spark: SparkSession, root: str) -> DataFrame:
    f = v.runs(spark, root).select("split_family").distinct()
    first = F.when(F.col("split_family") == "random_split", 1).when(F.col("split_family") == "external_holdout", 9).otherwise(5)
    return rel.global_rank(f, [first, F.col("split_family")], "place")
