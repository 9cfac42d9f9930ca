"""Strings, sources, joins, aggregates and windows over the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions.labels import components, is_combination, normalize_label
from vectrail.operators import relational as rel
from vectrail.operators.evaluate import latest_status, metric_fallback, select_runs
from vectrail.operators.reliability import novelty
from vectrail.operators.splits import part_counts
from vectrail.operators.reports import FORBIDDEN_TERMS
from vectrail.plans import views as v
from vectrail.plans.views import rounded, sql, sql_r
from vectrail.sources.readers import even_sample, shared_genes
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


@query("x1_normalize", f"SELECT unit_id, CASE WHEN lower(trim(batch)) NOT IN {_MISSING} THEN trim(batch) END AS batch, CASE WHEN lower(trim(timepoint)) NOT IN {_MISSING} THEN trim(timepoint) END AS timepoint FROM units", "units")
def x1(spark: SparkSession, root: str) -> DataFrame:
    return v.units(spark, root).select("unit_id", normalize_label("batch").alias("batch"), normalize_label("timepoint").alias("timepoint"))


_TOKENS = "len(list_filter(string_split(l, '_'), lambda t: t <> '' AND lower(t) NOT IN ('only','single','singleton','ctrl','control','neg','negative','tcrlibrary','library','grna','sgrna') AND NOT regexp_matches(lower(t), '^pmj[0-9]+$') AND NOT regexp_matches(t, '^[0-9]+$')))"


@query("x2_combination", f"SELECT perturbation_label, CASE WHEN l IS NULL OR l = 'MULTI_TARGET' THEN false WHEN regexp_matches(l, '[+,;|]') THEN true WHEN NOT contains(l, '_') THEN false ELSE {_TOKENS} >= 2 END AS is_combination FROM (SELECT DISTINCT perturbation_label, CASE WHEN lower(trim(perturbation_label)) NOT IN {_MISSING} THEN trim(perturbation_label) END AS l FROM make_splits)")
def x2(spark: SparkSession, root: str) -> DataFrame:
    labels = table(spark, root, "make_splits").select("perturbation_label").distinct()
    return labels.select("perturbation_label", is_combination("perturbation_label").alias("is_combination"))


@query("x3_components", "SELECT DISTINCT perturbation_label, CASE WHEN perturbation_label IS NULL OR perturbation_label IN ('', 'control', 'NT', 'WT', 'MULTI_TARGET') OR NOT contains(perturbation_label, '_') THEN '' ELSE array_to_string(list_filter(string_split(perturbation_label, '_'), lambda t: t <> ''), ' + ') END AS parts FROM make_splits")
def x3(spark: SparkSession, root: str) -> DataFrame:
    labels = table(spark, root, "make_splits").select("perturbation_label").distinct()
    return labels.select("perturbation_label", F.array_join(components("perturbation_label"), " + ").alias("parts"))


@query("x4_dataset_of_signature", "SELECT DISTINCT CASE WHEN contains(signature_id, '__') THEN string_split(signature_id, '__')[1] END AS dataset FROM cbac_case_examples")
def x4(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "cbac_case_examples").select("signature_id").distinct()
    return s.select(F.when(F.contains("signature_id", F.lit("__")), F.substring_index("signature_id", "__", 1)).alias("dataset")).distinct()


@query("x6_run_stem", "SELECT run_id, CASE WHEN ends_with(run_id, '__' || model) THEN left(run_id, length(run_id) - length(model) - 2) ELSE run_id END AS stem, sha256(run_id) AS digest FROM runs", "runs")
def x6(spark: SparkSession, root: str) -> DataFrame:
    tail = F.concat(F.lit("__"), F.col("model"))
    stem = F.when(F.endswith("run_id", tail), F.substring(F.col("run_id"), F.lit(1), F.length("run_id") - F.length(tail))).otherwise(F.col("run_id"))
    return v.runs(spark, root).select("run_id", stem.alias("stem"), F.sha2("run_id", 256).alias("digest"))


@query("x11_term_scan", "SELECT doc_id, coalesce(regexp_matches(lower(text), 'clinical|wet-lab|universal-best-model|drug discovery|final truth'), false) AS claims_too_much FROM documents")
def x11(spark: SparkSession, root: str) -> DataFrame:
    held = F.coalesce(F.lower("text").rlike("|".join(FORBIDDEN_TERMS)), F.lit(False))
    return table(spark, root, "documents").select("doc_id", held.alias("claims_too_much"))


@query("x13_log1p", f"SELECT case_id, {sql_r('coalesce(ln(1 + greatest(CASE WHEN isnan(support_signatures) THEN NULL ELSE support_signatures END, 0)), 0)', 'support')}, {sql_r('ln(1 + greatest(n_cells, 0))', 'cells')} FROM cbac_case_examples WHERE n_cells IS NOT NULL AND (support_signatures IS NULL OR isnan(support_signatures) OR isfinite(support_signatures)) GROUP BY ALL")
def x13(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "cbac_case_examples").where("n_cells IS NOT NULL AND (support_signatures IS NULL OR isnan(support_signatures) OR abs(support_signatures) < double('infinity'))")
    return rounded(t.select("case_id", rel.log1p_or_zero("support_signatures").alias("support"), rel.log1p_or_zero("n_cells").alias("cells")).distinct())


@query("x22_metric_fallback", "SELECT event_id, coalesce(t, p, m) AS n, CASE WHEN t IS NOT NULL THEN 'table' WHEN p IS NOT NULL THEN 'payload' WHEN m IS NOT NULL THEN 'payload.metrics' END AS n_source FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value END AS t, CASE WHEN event_id % 3 = 1 THEN json_extract_string(props, '$.n')::DOUBLE END AS p, CASE WHEN event_id % 3 = 2 THEN json_extract_string(props, '$.k')::DOUBLE END AS m FROM events)")
def x22(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "events").withColumn("payload", F.when(F.col("event_id") % 3 == 2, F.concat(F.lit('{"metrics": {"n": '), F.get_json_object("props", "$.k"), F.lit("}}"))).otherwise(F.lit("{}")))
    return e.select("event_id", *metric_fallback(F.when(F.col("event_id") % 3 == 0, F.col("value")), F.col("payload"), "n"))


@query("s12_even_sample", "WITH g AS (SELECT DISTINCT unnest(string_split(top_pred_genes, ';')) AS gene FROM cbac_case_examples WHERE top_pred_genes IS NOT NULL), r AS (SELECT gene, row_number() OVER (ORDER BY gene) - 1 AS pos, count(*) OVER () AS n FROM g WHERE gene <> '') SELECT gene FROM r WHERE n <= 256 OR pos IN (SELECT (i * (n - 1)) // 255 FROM range(256) t(i))")
def s12(spark: SparkSession, root: str) -> DataFrame:
    g = table(spark, root, "cbac_case_examples").select(F.explode(F.split("top_pred_genes", ";")).alias("gene")).where("gene <> ''")
    return even_sample(g, "gene")


@query("s13_shared_genes", "WITH g AS (SELECT DISTINCT seed, unnest(string_split(top_pred_genes, ';')) AS gene FROM cases WHERE top_pred_genes IS NOT NULL) SELECT gene FROM g WHERE seed IS NOT NULL AND gene <> '' GROUP BY gene HAVING count(DISTINCT seed) = (SELECT count(DISTINCT seed) FROM g)", "cases")
def s13(spark: SparkSession, root: str) -> DataFrame:
    g = v.cases(spark, root).where("seed IS NOT NULL").select(F.col("seed").alias("dataset_id"), F.explode(F.split("top_pred_genes", ";")).alias("gene")).where("gene <> ''")
    return shared_genes(g.distinct())


@query("j1_coalesced_join", "SELECT o_orderkey, coalesce(q.o_totalprice, o.o_totalprice) AS o_totalprice, o_orderstatus, q.flag FROM orders o LEFT JOIN (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice * 2 END AS o_totalprice, 'checked' AS flag FROM orders WHERE o_orderkey % 3 = 0) q USING (o_orderkey)")
def j1(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders")
    q = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") * 2).alias("o_totalprice"), F.lit("checked").alias("flag"))
    return rel.coalesced_left_join(o.select("o_orderkey", "o_totalprice", "o_orderstatus"), q, ["o_orderkey"], "_qc")


@query("j4_manifest_audit", "SELECT r.run_id, a.n_units, a.n_train FROM runs r LEFT JOIN (SELECT split_id, count(*) AS n_units, count(*) FILTER (WHERE split_part = 'train') AS n_train FROM units GROUP BY split_id) a ON regexp_extract(r.split_json_path, '([^/]+)[.]json$', 1) = a.split_id", "runs", "units")
def j4(spark: SparkSession, root: str) -> DataFrame:
    a = v.units(spark, root).groupBy("split_id").agg(F.count(F.lit(1)).alias("n_units"), F.count_if(F.col("split_part") == "train").alias("n_train"))
    r = v.runs(spark, root).withColumn("split_id", F.regexp_extract("split_json_path", r"([^/]+)\.json$", 1))
    return r.join(a, "split_id", "left").select("run_id", "n_units", "n_train")


@query("j5_cases_with_runs", "SELECT c.case_id, r.gene_space_policy, r.expected_gene_count, r.status FROM cases c LEFT JOIN runs r USING (run_id)", "cases", "runs")
def j5(spark: SparkSession, root: str) -> DataFrame:
    r = v.runs(spark, root).select("run_id", "gene_space_policy", "expected_gene_count", "status")
    return v.cases(spark, root).select("case_id", "run_id").join(r, "run_id", "left").select("case_id", "gene_space_policy", "expected_gene_count", "status")


@query("j19_run_selection", "WITH m AS (SELECT DISTINCT 'run_' || c_custkey AS run_id FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT run_id, status FROM (SELECT 'run_' || user_id AS run_id, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'signup' THEN 'cached' WHEN 'error' THEN 'failed' ELSE 'blocked' END AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1) SELECT m.run_id, n.status, coalesce(n.status IN ('success', 'cached'), false) AS selected, CASE WHEN n.status IS NULL THEN 'missing_in_registry' WHEN n.status IN ('success', 'cached') THEN 'selected' ELSE 'not_successful' END AS note FROM m LEFT JOIN n USING (run_id) UNION ALL SELECT run_id, status, false, 'not_in_manifest_smoke_or_extra' FROM n WHERE run_id NOT IN (SELECT run_id FROM m)")
def j19(spark: SparkSession, root: str) -> DataFrame:
    manifest = table(spark, root, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("run_"), "c_custkey").alias("run_id"))
    return select_runs(manifest, _registry(spark, root), "run_id", "ts", "event_id")


def _registry(spark: SparkSession, root: str) -> DataFrame:
    kinds = {"purchase": "success", "signup": "cached", "error": "failed"}
    status = F.lit("blocked")
    for k, s in kinds.items():
        status = F.when(F.col("event_type") == k, s).otherwise(status)
    return table(spark, root, "events").select("event_id", F.concat(F.lit("run_"), "user_id").alias("run_id"), "ts", status.alias("status"))


@query("w7_latest_status", "SELECT run_id, model, status FROM runs", "runs")
def w7(spark: SparkSession, root: str) -> DataFrame:
    return latest_status(table(spark, root, "run_baseline"), "run_id", "ingested_at").select("run_id", "model", "status")


@query("f3_anti_join", "SELECT r.run_id FROM runs r WHERE NOT EXISTS (SELECT 1 FROM cases c WHERE c.run_id = r.run_id)", "runs", "cases")
def f3(spark: SparkSession, root: str) -> DataFrame:
    return v.runs(spark, root).select("run_id").join(v.cases(spark, root).select("run_id").distinct(), "run_id", "left_anti")


@query("f7_first_rows", "SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn = 1")
def f7(spark: SparkSession, root: str) -> DataFrame:
    order = [F.col("l_extendedprice").desc(), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")]
    li = table(spark, root, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    return rel.first_per(li, ["l_orderkey"], order).select("l_orderkey", "l_partkey", "l_linenumber")


@query("fill_missing_columns", "SELECT n_nationkey, n_name, '' AS batch, 0 AS n_cells FROM nation")
def p3_fill(spark: SparkSession, root: str) -> DataFrame:
    return rel.fill_columns(table(spark, root, "nation").select("n_nationkey", "n_name"), {"batch": "", "n_cells": 0})


_PUR = f"WITH c AS (SELECT reference_key, CASE WHEN lower(trim(batch)) NOT IN {_MISSING} THEN trim(batch) END AS batch FROM units WHERE reference_key IS NOT NULL), n AS (SELECT reference_key, batch, count(*) AS n FROM c WHERE batch IS NOT NULL GROUP BY ALL), q AS (SELECT *, (sum(n) OVER (PARTITION BY reference_key))::BIGINT AS total FROM n)"


@query("a1_purity", f"{_PUR} SELECT reference_key, batch, n, total, {sql_r('n / total', 'purity')} FROM q", "units")
def a1(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root).where("reference_key IS NOT NULL").withColumn("batch", normalize_label("batch"))
    return rounded(rel.purity(u, "reference_key", "batch"))


@query("d12_dominant_label", f"{_PUR} SELECT reference_key, batch, {sql_r('n / total', 'purity')} FROM (SELECT *, row_number() OVER (PARTITION BY reference_key ORDER BY n / total DESC, n DESC, batch) AS rn FROM q) WHERE rn = 1 AND n / total >= 0.5", "units")
def d12(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root).where("reference_key IS NOT NULL").withColumn("batch", normalize_label("batch"))
    return rounded(rel.dominant_label(u, "reference_key", "batch", 0.5))


@query("a2_support", "SELECT split_id, perturbation_label, count(signature_id) AS n_signatures, sum(n_cells)::BIGINT AS n_cells FROM units WHERE split_part = 'train' AND NOT is_control GROUP BY ALL", "units")
def a2(spark: SparkSession, root: str) -> DataFrame:
    t = v.units(spark, root).where("split_part = 'train' AND NOT is_control")
    return t.groupBy("split_id", "perturbation_label").agg(F.count("signature_id").alias("n_signatures"), F.sum("n_cells").alias("n_cells"))


@query("a10_distinct_counts", f"SELECT model, split_family, failure_mode, count(DISTINCT signature_id) AS n_signatures, count(DISTINCT perturbation_label) AS n_labels, {sql_r('avg(risk)', 'mean_risk')}, {sql_r('avg(confidence)', 'mean_confidence')} FROM cases GROUP BY ALL", "cases")
def a10(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.cases(spark, root).groupBy("model", "split_family", "failure_mode").agg(
        F.countDistinct("signature_id").alias("n_signatures"), F.countDistinct("perturbation_label").alias("n_labels"), F.avg("risk").alias("mean_risk"), F.avg("confidence").alias("mean_confidence")))


@query("a16_decision_spread", f"SELECT transportable, count(*) AS n, {sql_r('avg(cosine_similarity)', 'mean_cosine')}, {sql_r('stddev_samp(cosine_similarity)', 'sd_cosine')} FROM cases GROUP BY ALL", "cases")
def a16(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.cases(spark, root).groupBy("transportable").agg(F.count(F.lit(1)).alias("n"), F.avg("cosine_similarity").alias("mean_cosine"), F.stddev_samp("cosine_similarity").alias("sd_cosine")))


@query("a17_part_counts", f"SELECT split_id, split_part AS part, count(*) AS n_units, count(DISTINCT CASE WHEN NOT is_control THEN perturbation_label END) AS n_perturbations, count(DISTINCT reference_key) AS n_reference_keys, count(*) FILTER (WHERE is_control) AS n_controls, count(*) FILTER (WHERE NOT is_control AND CASE WHEN l IS NULL OR l = 'MULTI_TARGET' THEN false WHEN regexp_matches(l, '[+,;|]') THEN true WHEN NOT contains(l, '_') THEN false ELSE {_TOKENS} >= 2 END) AS n_combinations FROM (SELECT *, CASE WHEN lower(trim(perturbation_label)) NOT IN {_MISSING} THEN trim(perturbation_label) END AS l FROM units) GROUP BY ALL", "units")
def a17(spark: SparkSession, root: str) -> DataFrame:
    return part_counts(v.units(spark, root).withColumnRenamed("split_part", "part"), ["split_id"], "perturbation_label", "reference_key")


@query("a19_population_slices", f"SELECT run, {sql_r('avg(n_cells) FILTER (WHERE NOT is_control)', 'mean_non_control')}, {sql_r('quantile_cont(n_cells, 0.5) FILTER (WHERE NOT is_control)', 'median_non_control')}, {sql_r('avg(n_cells) FILTER (WHERE is_control)', 'mean_control')}, {sql_r('avg(n_cells)', 'mean_overall')} FROM members GROUP BY run", "members")
def a19(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("n_cells").cast("double")
    real = F.when(~F.col("is_control"), n)
    return rounded(v.members(spark, root).groupBy("run").agg(F.avg(real).alias("mean_non_control"), F.percentile(real, 0.5).alias("median_non_control"), F.avg(F.when(F.col("is_control"), n)).alias("mean_control"), F.avg(n).alias("mean_overall")))


@query("a21_quantile", f"SELECT split_family, {sql_r('quantile_cont(1 - confidence, 0.2)', 'cutoff')} FROM cases GROUP BY ALL", "cases")
def a21(spark: SparkSession, root: str) -> DataFrame:
    c = v.cases(spark, root).select("split_family", (1 - F.col("confidence")).alias("off"))
    return rounded(rel.grouped_quantiles(c, ["split_family"], "off", [0.2]).select("split_family", F.col("quantile").alias("cutoff")))


_FAMS = ["dataset_heldout_split", "external_holdout", "low_support_split", "random_split", "unseen_cell_state_split", "unseen_cell_type_or_lineage_split", "unseen_combination_split", "unseen_perturbation_split"]


@query("a22_pivot", "SELECT model, " + ", ".join(sql_r(f"avg(cosine_similarity) FILTER (WHERE split_family = '{f}')", f) for f in _FAMS) + " FROM cases WHERE model IS NOT NULL GROUP BY model", "cases")
def a22(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.cases(spark, root).where("model IS NOT NULL").groupBy("model").pivot("split_family", _FAMS).agg(F.avg("cosine_similarity")))


@query("a23_min_max_scale", f"WITH m AS (SELECT o_custkey, ln(1 + sum(o_totalprice)) AS s FROM orders GROUP BY ALL) SELECT o_custkey, {sql_r('(s - min(s) OVER ()) / nullif(max(s) OVER () - min(s) OVER (), 0)', 'scaled')} FROM m")
def a23(spark: SparkSession, root: str) -> DataFrame:
    m = table(spark, root, "orders").groupBy("o_custkey").agg(F.log1p(F.sum("o_totalprice")).alias("s"))
    return rounded(rel.min_max_scale(m, "s", "scaled").select("o_custkey", "scaled"))


@query("u2_overlap_counts", "SELECT split_id, count(*) FILTER (WHERE a AND b) AS n_shared FROM (SELECT split_id, reference_key, bool_or(split_part = 'train') AS a, bool_or(split_part = 'test') AS b FROM units WHERE reference_key IS NOT NULL GROUP BY ALL) GROUP BY split_id", "units")
def u2(spark: SparkSession, root: str) -> DataFrame:
    from vectrail.operators.splits import overlap_counts

    return overlap_counts(v.units(spark, root).withColumnRenamed("split_part", "part"), ["split_id"], "reference_key", "n_shared")


@query("u5_top_gene_overlap", f"SELECT case_id, len(list_intersect(a, b)) AS shared, {sql_r('len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))', 'jaccard')} FROM (SELECT case_id, list_distinct(regexp_extract_all(top_true_genes, '[A-Za-z0-9.-]+')) AS a, list_distinct(regexp_extract_all(top_pred_genes, '[A-Za-z0-9.-]+')) AS b FROM cases) WHERE len(a) > 0 AND len(b) > 0", "cases")
def u5(spark: SparkSession, root: str) -> DataFrame:
    genes = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[A-Za-z0-9.-]+"), F.lit(0)))
    t = v.cases(spark, root).select("case_id", genes("top_true_genes").alias("a"), genes("top_pred_genes").alias("b")).where("size(a) > 0 AND size(b) > 0")
    n = F.size(F.array_intersect("a", "b")).cast("long")
    return rounded(t.select("case_id", n.alias("shared"), (n / F.size(F.array_union("a", "b"))).alias("jaccard")))


@query("w1_context_rank", "WITH m AS (SELECT split_family, seed, model, avg(confidence) AS c FROM cases GROUP BY ALL) SELECT split_family, seed, model, CASE WHEN c IS NOT NULL THEN rank() OVER (PARTITION BY split_family, seed ORDER BY round(c, 9) DESC NULLS LAST) END::INTEGER AS rank FROM m", "cases")
def w1(spark: SparkSession, root: str) -> DataFrame:
    m = v.cases(spark, root).groupBy("split_family", "seed", "model").agg(F.round(F.avg("confidence"), 9).alias("c"))
    return m.withColumn("rank", rel.min_rank(["split_family", "seed"], "c")).drop("c")


@query("w4_share", f"WITH n AS (SELECT model, split_family, failure_mode, count(*) AS n FROM cases GROUP BY ALL) SELECT *, {sql_r('n / sum(n) OVER (PARTITION BY model, split_family)', 'share')} FROM n", "cases")
def w4(spark: SparkSession, root: str) -> DataFrame:
    n = v.cases(spark, root).groupBy("model", "split_family", "failure_mode").agg(F.count(F.lit(1)).alias("n"))
    return rounded(rel.with_share(n, ["model", "split_family"], "n", "share"))


@query("w5_dominant", "WITH n AS (SELECT model, split_family, failure_mode, count(*) AS n FROM cases GROUP BY ALL) SELECT *, coalesce(n = max(n) OVER (PARTITION BY model, split_family), false) AS dominant, coalesce(CASE WHEN failure_mode <> 'transportable' THEN n END = max(CASE WHEN failure_mode <> 'transportable' THEN n END) OVER (PARTITION BY model, split_family), false) AS dominant_failure FROM n", "cases")
def w5(spark: SparkSession, root: str) -> DataFrame:
    n = v.cases(spark, root).groupBy("model", "split_family", "failure_mode").agg(F.count(F.lit(1)).alias("n"))
    n = rel.with_group_max(n, ["model", "split_family"], "n", "dominant")
    return rel.with_group_max(n, ["model", "split_family"], "n", "dominant_failure", F.col("failure_mode") != "transportable")


@query("w8_average_rank", "SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderstatus, o_orderdate) - 1) / 2 AS rank FROM orders")
def w8(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    return rel.with_average_rank(o, ["o_orderstatus"], "o_orderdate").select("o_orderkey", "rank")


@query("w10_global_running", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS rank, sum(o_custkey) OVER (ORDER BY o_orderdate, o_orderkey)::BIGINT AS running FROM orders")
def w10(spark: SparkSession, root: str) -> DataFrame:
    o = table(spark, root, "orders").select("o_orderkey", "o_orderdate", "o_custkey")
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    run = rel.global_running(o, order, {"running": "o_custkey"}).select("o_orderkey", "running")
    return rel.global_rank(o, order).join(run, "o_orderkey").select("o_orderkey", "rank", "running")


@query("w12_quantile_bins", "WITH e AS (SELECT list_distinct(quantile_cont(confidence, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS q, min(confidence) AS lo, max(confidence) AS hi FROM cases), b AS (SELECT list_filter(q, lambda x: x > lo AND x < hi) AS q FROM e) SELECT case_id, len(list_filter(q, lambda x: confidence > x))::INTEGER AS bin FROM cases, b WHERE confidence IS NOT NULL", "cases")
def w12(spark: SparkSession, root: str) -> DataFrame:
    return rel.quantile_bins(v.cases(spark, root).where("confidence IS NOT NULL"), "confidence", 8).select("case_id", "bin")


@query("w13_benjamini_hochberg", f"WITH t AS (SELECT o_custkey, (count(*) * 37 % 101 + 1) / 200.0 AS p FROM orders GROUP BY ALL), k AS (SELECT *, row_number() OVER (ORDER BY p, o_custkey) AS k, count(*) OVER () AS m FROM t), q AS (SELECT o_custkey, least(1.0, min(p * m / k) OVER (ORDER BY k DESC)) AS q FROM k) SELECT o_custkey, {sql_r('q', 'p_value_fdr')}, q <= 0.05 AS reject FROM q")
def w13(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "orders").groupBy("o_custkey").agg(((F.count(F.lit(1)) * 37 % 101 + 1) / F.lit(200.0)).alias("p"))
    return rounded(rel.benjamini_hochberg(t, "p", ["o_custkey"]).select("o_custkey", "p_value_fdr", "reject"))


@query("w14_trapezoid", f"WITH s AS (SELECT l_returnflag, l_linenumber AS x, avg(l_discount) AS y FROM lineitem GROUP BY ALL), d AS (SELECT l_returnflag, (x - lag(x) OVER w) * (y + lag(y) OVER w) / 2 AS a FROM s WINDOW w AS (PARTITION BY l_returnflag ORDER BY x)) SELECT l_returnflag, {sql_r('coalesce(sum(a), 0)', 'area')} FROM d GROUP BY ALL")
def w14(spark: SparkSession, root: str) -> DataFrame:
    s = table(spark, root, "lineitem").groupBy("l_returnflag", F.col("l_linenumber").alias("x")).agg(F.avg("l_discount").alias("y"))
    return rounded(rel.trapezoid(s, ["l_returnflag"], "x", "y", "x"))


@query("x21_novelty", "WITH k AS (SELECT DISTINCT split_id, perturbation_label AS l FROM units WHERE split_part = 'train' AND NOT is_control), t AS (SELECT unit_id, split_id, perturbation_label AS l FROM units WHERE split_part = 'test' AND NOT is_control), p AS (SELECT *, CASE WHEN contains(l, '_') AND l NOT IN ('control', 'NT', 'WT', 'MULTI_TARGET') THEN list_filter(string_split(l, '_'), lambda x: x <> '') ELSE [] END AS c FROM t), q AS (SELECT unit_id, split_id, l, len(c) > 0 AS comb, CASE WHEN len(c) = 0 AND l <> '' AND lower(l) <> 'control' THEN [l] ELSE c END AS c FROM p), s AS (SELECT q.unit_id, count(k.l) AS seen FROM (SELECT unit_id, split_id, unnest(c) AS x FROM q) q LEFT JOIN k ON k.split_id = q.split_id AND k.l = q.x GROUP BY 1) SELECT q.unit_id, CASE WHEN e.l IS NULL THEN 0.0 ELSE 1.0 END AS perturbation_seen_in_train, comb::DOUBLE AS is_combination, len(c)::DOUBLE AS component_count, " + sql_r("coalesce(coalesce(seen, 0) / nullif(len(c), 0), 0)", "component_seen_fraction") + ", (len(c) - coalesce(seen, 0))::DOUBLE AS unseen_component_count FROM q LEFT JOIN s USING (unit_id) LEFT JOIN k e ON e.split_id = q.split_id AND e.l = q.l", "units")
def x21(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root).where("NOT is_control").select("unit_id", "split_id", "split_part", "perturbation_label")
    train = u.where("split_part = 'train'").select("split_id", "perturbation_label").distinct()
    got = novelty("perturbation_label", "split_id", train, u.where("split_part = 'test'"))
    return rounded(got.select("unit_id", "perturbation_seen_in_train", "is_combination", "component_count", "component_seen_fraction", "unseen_component_count"))


@query("a18_status_counts", "SELECT count(*) AS n_total, count(*) FILTER (WHERE lower(trim(status)) IN ('success', 'cached')) AS n_done, count(*) FILTER (WHERE regexp_matches(lower(trim(status)), 'failed|blocked|error')) AS n_failed, count(*) FILTER (WHERE status IS NULL) AS n_unknown FROM runs", "runs")
def a18(spark: SparkSession, root: str) -> DataFrame:
    from vectrail.operators.reports import status_counts

    return status_counts(v.runs(spark, root), "status")


@query("b1_run_matrix", "WITH s AS (SELECT DISTINCT split_id FROM units), m AS (SELECT DISTINCT model FROM runs) SELECT split_id || '__' || model AS run_id, split_id, model, CASE WHEN split_id LIKE 'dataset_heldout%' OR split_id LIKE 'external%' THEN 'global_intersection_genes' ELSE 'native_dataset_genes' END AS gene_space_policy FROM s, m", "units", "runs")
def b1(spark: SparkSession, root: str) -> DataFrame:
    splits = v.units(spark, root).select("split_id").distinct()
    models = v.runs(spark, root).select("model").distinct()
    each = splits.join(models, F.lit(True))  # every split with every model: the matrix itself
    wide = F.col("split_id").startswith("dataset_heldout") | F.col("split_id").startswith("external")
    return each.select(F.concat_ws("__", "split_id", "model").alias("run_id"), "split_id", "model", F.when(wide, "global_intersection_genes").otherwise("native_dataset_genes").alias("gene_space_policy"))


@query("b4_pending_runs", "SELECT run_id, row_number() OVER (ORDER BY expected_gene_count NULLS LAST, run_id) AS place FROM runs r WHERE lower(trim(status)) NOT IN ('success', 'cached') OR status IS NULL", "runs")
def b4(spark: SparkSession, root: str) -> DataFrame:
    done = v.runs(spark, root).where(F.lower(F.trim("status")).isin("success", "cached")).select("run_id")
    todo = v.runs(spark, root).select("run_id", "expected_gene_count").join(done, "run_id", "left_anti")
    return rel.global_rank(todo, [F.col("expected_gene_count").asc_nulls_last(), F.col("run_id")], "place").select("run_id", "place")


