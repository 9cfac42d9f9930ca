"""Row metrics together, vectors to risk, biology per run, materialised splits, documents and figure data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail import runner
from vectrail.operators import campaign as cp
from vectrail.operators import evaluate as ev
from vectrail.operators import reliability as rl
from vectrail.operators import reports as rp
from vectrail.operators import vectors
from vectrail.plans import views as v
from vectrail.plans.more_queries import _EXTERNAL, _GRID, d16, q_records
from vectrail.plans.report_queries import _HELD, held_scores
from vectrail.plans.views import rounded, sql, sql_cos, sql_dot, sql_r
from vectrail.session import cut

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None, *needs: str):
    def keep(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = sql(text, *needs)
        return f

    return keep


def _tops(ks: tuple[int, ...]) -> tuple[str, str]:
    """CTEs of hits and running hits for every k, and the metrics as select items; vectors have 64 elements."""
    h = ", ".join(f"(rt <= {k} AND rp <= {k})::INT AS h{k}" for k in ks)
    c = ", ".join(f"sum(h{k}) OVER (PARTITION BY vec_id ORDER BY rp) AS c{k}" for k in ks)
    items = []
    for k in ks:
        n = min(k, 64)
        items += [
            sql_r(f"sum(h{k}) / ({2 * n} - sum(h{k}))", f"jaccard_top{k}"), sql_r(f"coalesce(sum(h{k} * (sign(t) = sign(p))::INT) / nullif(sum(h{k}), 0), 0)", f"direction_top{k}"),
            sql_r(f"sum(h{k}) / {n}", f"recall_top{k}"), sql_r(f"sum(CASE WHEN rp <= {n} THEN h{k} / log2(rp + 1) END) / (SELECT sum(1 / log2(i + 1)) FROM range(1, {n + 1}) t(i))", f"ndcg_top{k}"),
            sql_r(f"sum(CASE WHEN rp <= {n} THEN h{k} * c{k} / rp END) / {n}", f"map_top{k}"),
        ]
    return f"h AS (SELECT *, {h} FROM r), c AS (SELECT *, {c} FROM h)", ", ".join(items)


_CTES, _ITEMS = _tops(vectors.TOP_K)
_ELEMENTS = (
    "WITH e AS (SELECT vec_id, unnest(truth) AS t, unnest(guess) AS p, unnest(range(len(truth))) AS pos FROM pairs), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY abs(t) DESC, pos) AS rt, row_number() OVER (PARTITION BY vec_id ORDER BY abs(p) DESC, pos) AS rp, "
    "rank() OVER (PARTITION BY vec_id ORDER BY t) + (count(*) OVER (PARTITION BY vec_id, t) - 1) / 2 AS kt, rank() OVER (PARTITION BY vec_id ORDER BY p) + (count(*) OVER (PARTITION BY vec_id, p) - 1) / 2 AS kp FROM e), "
)


@query("v11_all_metrics", f"{_ELEMENTS}{_CTES} SELECT vec_id, {sql_r('sum(t * p) / (sqrt(sum(t * t)) * sqrt(sum(p * p)))', 'cosine_similarity')}, {sql_r('corr(t, p)', 'pearson')}, {sql_r('corr(kt, kp)', 'spearman')}, {sql_r('sqrt(avg((t - p) ** 2))', 'rmse')}, {sql_r('avg(abs(t - p))', 'mae')}, {sql_r('sqrt(sum(t * t))', 'delta_norm_true')}, {sql_r('sqrt(sum(p * p))', 'delta_norm_pred')}, {_ITEMS} FROM c GROUP BY vec_id", "pairs")
def v11(spark: SparkSession, root: str) -> DataFrame:
    return rounded(vectors.row_metrics(v.pairs(spark, root), ["vec_id"], "truth", "guess"))


@query("v8_recall", f"{_ELEMENTS}{_CTES} SELECT vec_id, {', '.join(sql_r(f'sum(h{k}) / {min(k, 64)}', f'recall_top{k}') for k in vectors.TOP_K)} FROM c GROUP BY vec_id", "pairs")
def v8(spark: SparkSession, root: str) -> DataFrame:
    return rounded(vectors.row_metrics(v.pairs(spark, root), ["vec_id"], "truth", "guess").select("vec_id", *[f"recall_top{k}" for k in vectors.TOP_K]))


@query("e3_vector_risk", f"WITH k AS (SELECT dataset_id, vec_id, is_control, {sql_cos('truth', 'guess')} AS c FROM pairs), a AS (SELECT dataset_id, quantile_cont(c, 0.5) AS anchor FROM k WHERE NOT is_control GROUP BY ALL) SELECT vec_id, {sql_r('c', 'cosine')}, {sql_r('1 - c', 'risk')}, CASE WHEN NOT is_control THEN c >= 0.8::DOUBLE * anchor END AS transportable FROM k LEFT JOIN a USING (dataset_id)", "pairs")
def e3(spark: SparkSession, root: str) -> DataFrame:
    """From predicted vectors to their risk and, against the median of their dataset, their label."""
    scored = cut(ev.vector_risk(v.pairs(spark, root), "truth", "guess").select("dataset_id", "vec_id", "is_control", "cosine", "risk"))
    anchor = ev.grouped_quantiles(scored.where("NOT is_control"), ["dataset_id"], "cosine", [0.5]).select("dataset_id", F.col("quantile").alias("anchor"))
    kept = F.when(~F.col("is_control"), F.col("cosine") >= F.lit(0.8) * F.col("anchor"))
    return rounded(scored.join(anchor, "dataset_id", "left").select("vec_id", "cosine", "risk", kept.alias("transportable")))


_BIO = (
    "s AS (SELECT 'set' || (i % 7) AS pathway, i AS pos FROM range(64) t(i)), e AS (SELECT vec_id, unnest(truth) AS t, unnest(guess) AS p, unnest(range(len(truth))) AS pos FROM pairs), "
    "w AS (SELECT vec_id, pathway, avg(t) AS t, avg(p) AS p FROM e JOIN s USING (pos) GROUP BY ALL HAVING count(*) >= 3), "
    "f AS (SELECT vec_id, sum(t * p) / (sqrt(sum(t * t)) * sqrt(sum(p * p))) AS pathway_cosine, count(*) FILTER (WHERE abs(t) > 1e-8 AND sign(t) = sign(p)) / greatest(count(*) FILTER (WHERE abs(t) > 1e-8), 1) AS pathway_direction FROM w GROUP BY vec_id), "
    f"n AS (SELECT p.dataset_id, p.vec_id, p.perturbation_label = t.perturbation_label AS hit, row_number() OVER (PARTITION BY p.vec_id ORDER BY round({sql_dot('p.guess', 't.truth')} / (sqrt({sql_dot('p.guess', 'p.guess')}) * sqrt({sql_dot('t.truth', 't.truth')})), 9) DESC, t.vec_id) AS rn FROM pairs p JOIN pairs t ON p.dataset_id = t.dataset_id), "
    "x AS (SELECT dataset_id, vec_id, max((hit AND rn <= 1)::INT)::DOUBLE AS top1, max((hit AND rn <= 5)::INT)::DOUBLE AS top5, max((hit AND rn <= 10)::INT)::DOUBLE AS top10 FROM n GROUP BY ALL), "
    "bio AS (SELECT dataset_id, avg(pathway_cosine) AS mean_pathway_cosine, avg(pathway_direction) AS mean_pathway_direction, avg(top1) AS mean_top1, avg(top5) AS mean_top5, avg(top10) AS mean_top10 FROM x JOIN f USING (vec_id) GROUP BY ALL)"
)
_BIO_COLUMNS = ["mean_pathway_cosine", "mean_pathway_direction", "mean_top1", "mean_top5", "mean_top10"]


def _biology(spark: SparkSession, root: str) -> DataFrame:
    sets = spark.range(64).select(F.concat(F.lit("set"), F.col("id") % 7).alias("pathway"), F.col("id").cast("int").alias("pos"))
    return ev.biology_summary(v.pairs(spark, root), "dataset_id", "vec_id", "perturbation_label", "truth", "guess", sets)


@query("e12_pathway_summary", f"WITH {_BIO} SELECT dataset_id, {', '.join(sql_r(c, c) for c in _BIO_COLUMNS)} FROM bio", "pairs")
def e12(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_biology(spark, root))


@query("j14_biology_join", f"WITH {_BIO}, k AS (SELECT dataset_id, vec_id, {sql_cos('truth', 'guess')} >= 0 AS kept FROM pairs) SELECT kept, dataset_id, count(*) AS n, {', '.join(sql_r(f'avg({c})', c) for c in _BIO_COLUMNS)} FROM k LEFT JOIN bio USING (dataset_id) GROUP BY ALL", "pairs")
def j14(spark: SparkSession, root: str) -> DataFrame:
    """Kept and rejected rows with what pathways and retrieval say of their run."""
    rows = ev.vector_risk(v.pairs(spark, root), "truth", "guess").select("dataset_id", (F.col("cosine") >= 0).alias("kept"))
    return rounded(rows.join(_biology(spark, root), "dataset_id", "left").groupBy("kept", "dataset_id").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in _BIO_COLUMNS]))


@query("m8_materialised_split", f"WITH {_EXTERNAL}, {_GRID}, sp AS (SELECT dataset_id, pos FROM (SELECT DISTINCT dataset_id FROM sig), (SELECT unnest(range(64)) AS pos) WHERE pos % 9 <> right(dataset_id, 1)::INT), sh AS (SELECT pos FROM sp GROUP BY pos HAVING count(DISTINCT dataset_id) = (SELECT count(DISTINCT dataset_id) FROM sp)), z AS (SELECT split_id, split_family, dataset_id, signature_id, part, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM grid JOIN sig USING (signature_id) WHERE split_family IN ('random_split', 'dataset_heldout_split')) SELECT split_id, signature_id, part, count(*) AS n_genes, {sql_r('sum(x)', 'total')} FROM z WHERE CASE split_family WHEN 'random_split' THEN pos % 9 <> right(dataset_id, 1)::INT ELSE pos IN (SELECT pos FROM sh) END GROUP BY ALL", "sig")
def m8_materialised(spark: SparkSession, root: str) -> DataFrame:
    """Splits with their vectors in the native gene space, or in the shared one where datasets are mixed."""
    s = v.signatures(spark, root)
    spaces = s.select("dataset_id").distinct().select("dataset_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("pos")).where(F.col("pos") % 9 != F.substring("dataset_id", -1, 1).cast("int"))
    grid = cp.split_grid(s.select("signature_id", "dataset_id", "perturbation_label", "is_control", "n_cells"), [0, 1, 2], families=["random_split", "dataset_heldout_split"])
    got = cp.materialise(grid, s.select("signature_id", "dataset_id", "delta"), spaces, "delta")
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x)
    return rounded(got.select("split_id", "signature_id", "part", F.size("vector").cast("long").alias("n_genes"), total.alias("total")))


@query("n16_supported_splits", f"WITH {_EXTERNAL}, {_GRID}, n AS (SELECT f.split_id, f.split_family, CASE f.split_family WHEN 'dataset_heldout_split' THEN 'all_datasets' WHEN 'external_holdout' THEN 'internal_vs_external' ELSE string_split(f.split_id, '__')[2] END AS scope, count(*) FILTER (WHERE part = 'train') AS a, count(*) FILTER (WHERE part = 'test') AS b FROM (SELECT DISTINCT split_id, split_family FROM f) f JOIN grid USING (split_id) GROUP BY ALL) SELECT split_family, scope, count(*) FILTER (WHERE a > 0 AND b > 0) AS n_ready, count(*) FILTER (WHERE a = 0 OR b = 0) AS n_unsupported FROM n GROUP BY ALL", "sig")
def n16(spark: SparkSession, root: str) -> DataFrame:
    return rp.supported_splits(q_records(spark, root))


@query("n13_method_comparison", "SELECT * FROM (VALUES ('control_mean_baseline', false, false, false), ('global_delta_baseline', false, false, false), ('perturbation_mean_delta_baseline', true, false, false), ('cell_context_knn_delta_baseline', true, true, true), ('ridge_regression_baseline', true, true, true)) AS t(model, uses_label, uses_context, tuned_on_validation)")
def n13(spark: SparkSession, root: str) -> DataFrame:
    return rp.method_comparison(spark).select("model", "uses_label", "uses_context", "tuned_on_validation")


@query("run_specs", "SELECT run_id, model, split_json_path, split_family, dataset_scope, seed, coalesce(heldout_target, '') AS heldout_target, gene_space_policy, coalesce(expected_gene_count, 0) AS expected_gene_count, output_dir, log_file FROM runs", "runs")
def run_specs(spark: SparkSession, root: str) -> DataFrame:
    return cp.run_specs(v.runs(spark, root))


@query("d11_label_column", "SELECT CASE WHEN count(DISTINCT timepoint) >= 2 THEN 'timepoint' WHEN count(DISTINCT batch) >= 2 THEN 'batch' END AS label_column FROM sig", "sig")
def d11(spark: SparkSession, root: str) -> DataFrame:
    found = cp.first_label_column(v.signatures(spark, root), ["cell_context", "timepoint", "batch"])
    return spark.createDataFrame([(found,)], "label_column string")


@query("guarded_columns", "SELECT * FROM (VALUES ('confidence', 'numeric'), ('n_cells', 'numeric'), ('model', 'categorical')) AS t(feature, kind)")
def guarded_columns(spark: SparkSession, root: str) -> DataFrame:
    numeric, categorical = cp.existing_columns(v.cases(spark, root), ["confidence", "n_cells", "model", "no_such"], ["model", "confidence", "no_such"])
    return spark.createDataFrame([(c, "numeric") for c in numeric] + [(c, "categorical") for c in categorical], "feature string, kind string")


@query("x24_environment", "SELECT * FROM (VALUES ('python', true), ('platform', true), ('pyspark', true), ('pyarrow', true), ('pandas', true), ('numpy', true), ('no_such_package', false)) AS t(package, present)")
def x24(spark: SparkSession, root: str) -> DataFrame:
    seen = runner.environment(("pyspark", "pyarrow", "pandas", "numpy", "no_such_package"))
    return spark.createDataFrame([(k, x != "absent") for k, x in seen.items()], "package string, present boolean")


@query("g7_false_rate_bars", f"WITH {_HELD} SELECT baseline, {sql_r('mean_false_transportability_rate', 'false_rate')}, {sql_r('(SELECT mean_false_transportability_rate FROM m WHERE baseline = ' + repr('naive_confidence') + ') - mean_false_transportability_rate', 'gain_vs_naive')} FROM m", "examples")
def g7(spark: SparkSession, root: str) -> DataFrame:
    rows = [(name, rl.selective_profile(held, "target_transportable", "target_risk", "score", "example_id").agg(F.avg("false_transportability_rate")).first()[0]) for name, held in held_scores(spark, root)]
    naive = dict(rows)["naive_confidence"]
    return rounded(spark.createDataFrame([(n, x, naive - x) for n, x in rows], "baseline string, false_rate double, gain_vs_naive double"))


@query("g9_risk_coverage", f"WITH {_HELD} SELECT baseline, c AS coverage, {sql_r('sr', 'selective_risk')}, {sql_r('fr', 'false_rate')} FROM k", "examples")
def g9(spark: SparkSession, root: str) -> DataFrame:
    out = None
    for name, held in held_scores(spark, root):
        got = rl.selective_profile(held, "target_transportable", "target_risk", "score", "example_id").select(
            F.lit(name).alias("baseline"), "coverage", "selective_risk", F.col("false_transportability_rate").alias("false_rate")
        )
        out = got if out is None else out.unionByName(got)
    return rounded(out)
