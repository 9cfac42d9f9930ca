"""Evaluation, reliability, report tables and figure data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators import evaluate as ev
from vectrail.operators import features as ft
from vectrail.operators import relational as rel
from vectrail.operators import reliability as rl
from vectrail.operators import reports as rp
from vectrail.plans import views as v
from vectrail.plans.views import rounded, sql, sql_r
from vectrail.session import cut
from vectrail.tables import latest, table

QUERIES, SQL = {}, {}


def query(name: str, text: str | None = None, *needs: str):
    def keep(f):
        QUERIES[name] = f
        if text is not None:
            SQL[name] = sql(text, *needs)
        return f

    return keep


def _r(*names: str) -> str:
    return ", ".join(sql_r(n, n) for n in names)


# Evaluation of runs.


@query("e4_anchors", f"SELECT run_id, {_r('anchor_mean', 'anchor_median')} FROM anchors", "anchors")
def e4(spark: SparkSession, root: str) -> DataFrame:
    return rounded(ev.anchors(v.cases(spark, root), v.runs(spark, root)))


_STRESS = "('unseen_perturbation_split', 'unseen_combination_split', 'low_support_split', 'dataset_heldout_split', 'external_holdout')"


@query("e5_transportable", f"SELECT case_id, CASE WHEN split_family IN {_STRESS} AND anchor_median IS NOT NULL AND cosine_similarity IS NOT NULL THEN cosine_similarity >= 0.8::DOUBLE * anchor_median END AS holds_up FROM cases c LEFT JOIN anchors a USING (run_id)", "cases", "anchors")
def e5(spark: SparkSession, root: str) -> DataFrame:
    c, r = v.cases(spark, root), v.runs(spark, root)
    got = c.join(ev.anchors(c, r), "run_id", "left")
    return got.select("case_id", ev.transportable("cosine_similarity", "anchor_median", "split_family", F.lit(False)).alias("holds_up"))


_RM = ["mean_cosine", "mean_risk", "anchor_mean", "random_to_stress_drop", "stress_retention"]


@query("e6_drop_and_retention", f"SELECT run_id, model, split_family, n_cases, {_r(*_RM)} FROM run_metrics", "run_metrics")
def e6(spark: SparkSession, root: str) -> DataFrame:
    return rounded(v.run_metrics(spark, root).select("run_id", "model", "split_family", "n_cases", *_RM))


_GRID = "WITH g AS (SELECT i / 10::DOUBLE AS tau FROM range(1, 11) t(i)), b AS (SELECT split_family, count(*) AS n, avg(risk) AS base_risk FROM cases GROUP BY ALL), s AS (SELECT c.split_family, tau, count(*) FILTER (WHERE confidence >= tau) AS accepted, avg(risk) FILTER (WHERE confidence >= tau) AS selective_risk, count(*) FILTER (WHERE confidence >= tau AND transportable IS NOT NULL) AS known, count(*) FILTER (WHERE confidence >= tau AND NOT transportable) AS n_false FROM cases c, g GROUP BY ALL), q AS (SELECT s.*, n, base_risk, accepted / n AS coverage FROM s JOIN b ON s.split_family IS NOT DISTINCT FROM b.split_family)"


@query("e7_selective_table", f"{_GRID} SELECT split_family, tau, n, accepted, known, n_false, {_r('base_risk', 'coverage', 'selective_risk')}, {sql_r('base_risk - selective_risk', 'abstention_gain')}, {sql_r('n_false / nullif(known, 0)', 'false_transportability_rate')} FROM q", "cases")
def e7(spark: SparkSession, root: str) -> DataFrame:
    return rounded(ev.selective_table(v.cases(spark, root), ["split_family"]))


@query("e7_selective_areas", f"{_GRID}, p AS (SELECT split_family, tau AS t, coverage, coalesce(selective_risk, base_risk) AS risk FROM q UNION ALL SELECT split_family, 0, 1, base_risk FROM b), d AS (SELECT split_family, (coverage - lag(coverage) OVER w) * (risk + lag(risk) OVER w) / 2 AS a FROM p WINDOW w AS (PARTITION BY split_family ORDER BY coverage, t)) SELECT split_family, {sql_r('sum(a)', 'area_under_selective_risk_curve')} FROM d GROUP BY ALL", "cases")
def e7_areas(spark: SparkSession, root: str) -> DataFrame:
    return rounded(ev.selective_areas(ev.selective_table(v.cases(spark, root), ["split_family"]), ["split_family"]))


@query("e7_coverage_area", f"{_GRID}, p AS (SELECT split_family, coverage FROM q UNION ALL SELECT split_family, 1 FROM b), d AS (SELECT split_family, (coverage + lag(coverage) OVER (PARTITION BY split_family ORDER BY coverage)) / 20 AS a FROM p) SELECT split_family, {sql_r('sum(a)', 'area_under_coverage_curve')} FROM d GROUP BY ALL", "cases")
def e7_coverage(spark: SparkSession, root: str) -> DataFrame:
    return rounded(ev.coverage_area(ev.selective_table(v.cases(spark, root), ["split_family"]), ["split_family"]))


def _wilson(c: str, n: str, name: str) -> str:
    p, z = f"({c} / {n})", "1.959964::DOUBLE"
    half = f"{z} * sqrt({p} * (1 - {p}) / {n} + {z} * {z} / (4 * {n} * {n}))"
    return ", ".join(sql_r(f"CASE WHEN {n} > 0 THEN greatest(0, least(1, ({p} + {z} * {z} / (2 * {n}) {s} {half}) / (1 + {z} * {z} / {n}))) END", f"{name}_{e}") for s, e in (("-", "low"), ("+", "high")))


@query("e8_wilson", f"{_GRID} SELECT split_family, tau, {_wilson('accepted', 'n', 'acceptance')}, {_wilson('n_false', 'known', 'false_rate')} FROM q", "cases")
def e8(spark: SparkSession, root: str) -> DataFrame:
    t = ev.selective_table(v.cases(spark, root), ["split_family"])
    return rounded(t.select("split_family", "tau", *ev.wilson("accepted", "n", "acceptance"), *ev.wilson("n_false", "known", "false_rate")))


@query("e9_pairwise_comparisons")
def e9(spark: SparkSession, root: str) -> DataFrame:
    return rounded(ev.pairwise_comparisons(v.run_metrics(spark, root), ["mean_cosine", "random_to_stress_drop"], ["split_family", "dataset_scope", "seed"]))


@query("e9_model_pairs", f"WITH m AS (SELECT split_family, dataset_scope, seed, model, avg(mean_cosine) AS v FROM run_metrics WHERE mean_cosine IS NOT NULL AND split_family IS NOT NULL AND dataset_scope IS NOT NULL AND seed IS NOT NULL GROUP BY ALL) SELECT a.split_family, a.dataset_scope, a.seed, a.model AS model_a, b.model AS model_b, {sql_r('a.v - b.v', 'diff')} FROM m a JOIN m b ON a.split_family = b.split_family AND a.dataset_scope = b.dataset_scope AND a.seed = b.seed AND a.model < b.model", "run_metrics")
def e9_pairs(spark: SparkSession, root: str) -> DataFrame:
    return rounded(ev.model_pairs(v.run_metrics(spark, root), "mean_cosine", ["split_family", "dataset_scope", "seed"]))


@query("e10_family_summary", f"SELECT model, split_family, count(run_id) AS n_runs, {sql_r('avg(mean_cosine)', 'mean_mean_cosine')}, {sql_r('quantile_cont(mean_cosine, 0.5)', 'median_mean_cosine')}, {sql_r('avg(random_to_stress_drop)', 'mean_random_to_stress_drop')}, {sql_r('avg(mean_risk)', 'mean_mean_risk')} FROM run_metrics GROUP BY ALL", "run_metrics")
def e10(spark: SparkSession, root: str) -> DataFrame:
    return rounded(ev.family_summary(v.run_metrics(spark, root), ["mean_cosine", "random_to_stress_drop", "mean_risk"]))


@query("e11_rank_instability", f"WITH p AS (SELECT split_family, seed, model, round(avg(mean_cosine), 9) AS v FROM run_metrics WHERE mean_cosine IS NOT NULL AND split_family IS NOT NULL AND seed IS NOT NULL GROUP BY ALL), r AS (SELECT *, rank() OVER (PARTITION BY split_family, seed ORDER BY v DESC) AS rank FROM p), s AS (SELECT model, avg(rank) AS mean_rank, stddev_samp(rank) AS std_rank, min(rank)::INTEGER AS best_rank, max(rank)::INTEGER AS worst_rank, count(*) AS n_contexts FROM r GROUP BY ALL), o AS (SELECT model, row_number() OVER (ORDER BY mean_rank, model) AS place FROM s), h AS (SELECT split_family, seed, r.model, row_number() OVER (PARTITION BY split_family, seed ORDER BY rank, r.model) AS here, place FROM r JOIN o USING (model)), t AS (SELECT a.model, count(*) AS reversals FROM h a JOIN h b ON a.split_family = b.split_family AND a.seed = b.seed AND a.model <> b.model WHERE sign(a.here - b.here) <> sign(a.place - b.place) GROUP BY ALL) SELECT model, {_r('mean_rank', 'std_rank')}, best_rank, worst_rank, n_contexts, coalesce(reversals, 0) AS reversals FROM s LEFT JOIN t USING (model)", "run_metrics")
def e11(spark: SparkSession, root: str) -> DataFrame:
    m = v.run_metrics(spark, root).where("mean_cosine IS NOT NULL AND split_family IS NOT NULL AND seed IS NOT NULL")
    m = m.groupBy("split_family", "seed", "model").agg(F.round(F.avg("mean_cosine"), 9).alias("v"))
    return rounded(ev.rank_instability(m, "v", ["split_family", "seed"]))


# Reliability.


def _supported(spark: SparkSession, root: str) -> DataFrame:
    u = v.units(spark, root).withColumnRenamed("split_part", "part").where("NOT is_control OR part = 'train'")
    return rl.support_features(u).where("NOT is_control")


_SUP = ["perturbation", "reference", "dataset"]


@query("r2_support_features", "WITH tr AS (SELECT * FROM units WHERE split_part = 'train'), t AS (SELECT * FROM units WHERE split_part = 'test' AND NOT is_control), p AS (SELECT split_id, perturbation_label, count(signature_id) AS n, sum(n_cells) AS c FROM tr WHERE NOT is_control GROUP BY ALL), r AS (SELECT split_id, reference_key, count(signature_id) AS n, sum(n_cells) AS c FROM tr GROUP BY ALL), d AS (SELECT split_id, dataset_id, count(signature_id) AS n, sum(n_cells) AS c FROM tr GROUP BY ALL), b AS (SELECT DISTINCT split_id, batch FROM tr WHERE batch IS NOT NULL) SELECT t.unit_id, coalesce(p.n, 0)::DOUBLE AS perturbation_train_signature_count, coalesce(p.c, 0)::DOUBLE AS perturbation_train_cell_count, coalesce(r.n, 0)::DOUBLE AS reference_train_signature_count, (r.n IS NOT NULL)::INT::DOUBLE AS reference_seen_in_train, (d.n IS NOT NULL)::INT::DOUBLE AS dataset_seen_in_train, (b.batch IS NOT NULL)::INT::DOUBLE AS batch_seen_in_train, " + sql_r("ln(1 + coalesce(d.c, 0))", "log1p_dataset_train_cell_count") + " FROM t LEFT JOIN p USING (split_id, perturbation_label) LEFT JOIN r ON r.split_id = t.split_id AND r.reference_key = t.reference_key LEFT JOIN d ON d.split_id = t.split_id AND d.dataset_id = t.dataset_id LEFT JOIN b ON b.split_id = t.split_id AND b.batch = t.batch", "units")
def r2(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_supported(spark, root).select("unit_id", "perturbation_train_signature_count", "perturbation_train_cell_count", "reference_train_signature_count", "reference_seen_in_train", "dataset_seen_in_train", "batch_seen_in_train", "log1p_dataset_train_cell_count"))


_MODE = "CASE WHEN {k} THEN 'transportable' WHEN {r} >= 1 THEN 'severe_failure' WHEN {r} >= 0.75 THEN 'high_risk_failure' WHEN {f} < {t} THEN 'below_transport_threshold' ELSE 'non_transportable' END"


@query("r3_failure_mode", f"SELECT case_id, transportable::INT AS target_transportable, {_MODE.format(k='transportable', r='risk', f='cosine_similarity', t='0.4::DOUBLE')} AS failure_mode FROM cases WHERE transportable IS NOT NULL", "cases")
def r3(spark: SparkSession, root: str) -> DataFrame:
    return rl.targets(v.cases(spark, root).withColumn("transport_threshold", F.lit(0.4))).select("case_id", "target_transportable", "failure_mode")


@query("r4_capped_sample", "WITH l AS (SELECT case_id, transportable, md5('7|' || case_id) AS o FROM cases WHERE transportable IS NOT NULL), n AS (SELECT transportable, count(*) AS n, sum(count(*)) OVER () AS total FROM l GROUP BY ALL), k AS (SELECT transportable, total, greatest(1, least(n, round_even(2000::DOUBLE * n / total, 0))) AS take FROM n), r AS (SELECT l.*, total, (row_number() OVER (PARTITION BY transportable ORDER BY o, case_id) > take)::INT AS late FROM l JOIN k USING (transportable)) SELECT case_id FROM (SELECT *, row_number() OVER (ORDER BY late, o, case_id) AS rn FROM r) WHERE total <= 2000 OR rn <= 2000", "cases")
def r4(spark: SparkSession, root: str) -> DataFrame:
    return rl.capped_sample(v.cases(spark, root).where("transportable IS NOT NULL").select("case_id", "transportable"), 2000, "transportable", "case_id").select("case_id")


#: The columns of the examples with their kinds, as the SQL of the feature rules takes them.
_EXAMPLE_COLUMNS = {
    "text": ["run_id", "signature_id", "model", "dataset_id", "split_family", "gene_space_policy", "failure_mode"],
    "number": [
        "example_id", "seed", "target_fidelity", "confidence", "anchor_signature_median_cosine", "anchor_signature_median_cosine_run", "n_cells",
        "transport_threshold", "target_transportable", "target_risk", "log1p_n_cells", "stress_family_flag", "train_units", "train_perturbations",
        "perturbation_seen_in_train", "is_combination", "component_count", "component_seen_fraction", "unseen_component_count",
        *[f"{p}{a}_train_{b}_count" for a in _SUP for b in ("signature", "cell") for p in ("", "log1p_")],
        "reference_seen_in_train", "dataset_seen_in_train", "batch_seen_in_train", "timepoint_seen_in_train",
    ],
}


def _listed(names: list[str] | tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _any(parts: list[str], x: str = "feature") -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")" if parts else "false"


_ROLES = (
    "c AS (SELECT unnest([" + ", ".join(f"{{'feature': '{n}', 'num': {k == 'number'}}}" for k, ns in _EXAMPLE_COLUMNS.items() for n in ns) + "], recursive := true)), "
    f"f AS (SELECT feature, num, feature IN {_listed(ft.CATEGORICAL)} AS cat, feature IN {_listed(ft.IDENTIFIERS)} OR regexp_matches(lower(feature), '(_path|_file)$') AS identifier, "
    f"feature IN {_listed(ft.OUTCOMES)} OR {_any(ft.OUTCOME_PARTS, 'lower(feature)')} AS target_or_label, feature IN {_listed(ft.DEPLOYMENT)} OR starts_with(feature, 'log1p_') OR starts_with(feature, 'bio_') AS listed FROM c), "
    "g AS (SELECT *, (cat OR listed) AND NOT identifier AND NOT target_or_label AS deployment_available, CASE WHEN cat THEN 'model_split_dataset_indicator' "
    + "".join(f"WHEN {_any(parts)}{' OR feature IN ' + _listed(ft.SUPPORT) if name == 'support_availability' else ''} THEN '{name}' " for name, parts in ft.GROUPS)
    + "WHEN starts_with(feature, 'bio_') OR contains(feature, 'pathway') THEN 'optional_biology' ELSE 'other' END AS ablation_group FROM f)"
)


@query("r5_feature_audit", f"WITH {_ROLES} SELECT feature, CASE WHEN cat THEN 'categorical' WHEN num THEN 'numeric' ELSE 'non_feature' END AS type, CASE WHEN identifier THEN 'identifier' WHEN target_or_label THEN 'target_or_evaluation_outcome' ELSE ablation_group END AS source_group, ablation_group, deployment_available, NOT deployment_available AND NOT identifier AND NOT target_or_label AS evaluation_only, target_or_label, identifier, NOT (deployment_available AND (cat OR num)) AS left_out FROM g")
def r5(spark: SparkSession, root: str) -> DataFrame:
    return ft.feature_audit(_examples(spark, root)).drop("reason")


@query("r6_feature_spec", f"WITH {_ROLES} SELECT m AS mode, feature, CASE WHEN cat THEN 'categorical' ELSE 'numeric' END AS kind FROM g, (VALUES ('deployment'), ('all')) AS q(m) WHERE (cat OR num) AND CASE m WHEN 'deployment' THEN deployment_available ELSE feature NOT IN {_listed(ft.OUTCOMES)} AND feature NOT IN {_listed(ft.IDENTIFIERS)} END")
def r6(spark: SparkSession, root: str) -> DataFrame:
    e = _examples(spark, root)
    rows = []
    for mode in ("deployment", "all"):
        spec = ft.feature_spec(e, mode)
        rows += [(mode, c, "numeric") for c in spec.numeric] + [(mode, c, "categorical") for c in spec.categorical]
    return spark.createDataFrame(rows, "mode string, feature string, kind string")


@query("r11_selective_profile", f"WITH l AS (SELECT case_id, transportable::INT AS y, risk, coalesce(confidence, 0) AS s FROM cases WHERE transportable IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY s DESC, case_id) AS rn, count(*) OVER () AS n, avg(risk) OVER () AS base FROM l), g AS (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS coverage), q AS (SELECT coverage, max(greatest(1, ceil(coverage * n)))::BIGINT AS kept, max(n) AS n, max(base) AS base, avg(risk) FILTER (WHERE rn <= greatest(1, ceil(coverage * n))) AS sr, avg(1 - y) FILTER (WHERE rn <= greatest(1, ceil(coverage * n))) AS fr FROM r, g GROUP BY coverage) SELECT coverage, kept, {sql_r('kept / n', 'observed')}, {sql_r('sr', 'selective_risk')}, {sql_r('fr', 'false_transportability_rate')}, {sql_r('base - sr', 'abstention_gain')} FROM q", "cases")
def r11(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rl.selective_profile(_labelled(spark, root), "y", "risk", "score", "case_id"))


def _labelled(spark: SparkSession, root: str) -> DataFrame:
    c = v.cases(spark, root).where("transportable IS NOT NULL")
    return c.select("case_id", F.col("transportable").cast("int").alias("y"), "risk", F.coalesce("confidence", F.lit(0.0)).alias("score"))


_AUC = "WITH l AS (SELECT transportable::INT AS y, coalesce(confidence, 0) AS s FROM cases WHERE transportable IS NOT NULL), f AS (SELECT avg(((s >= 0.5)::INT = y)::INT) AS accuracy, sum((s >= 0.5)::INT * y) / nullif(sum((s >= 0.5)::INT), 0) AS precision, sum((s >= 0.5)::INT * y) / nullif(sum(y), 0) AS recall, 2 * sum((s >= 0.5)::INT * y) / nullif(sum((s >= 0.5)::INT) + sum(y), 0) AS f1, avg((greatest(0, least(1, s)) - y) ** 2) AS brier, sum(y) AS p, sum(1 - y) AS n FROM l), r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS rk FROM l), d AS (SELECT s, sum(y) AS tp, count(*) AS c FROM l GROUP BY s), a AS (SELECT tp, sum(tp) OVER (ORDER BY s DESC) AS ct, sum(c) OVER (ORDER BY s DESC) AS cc FROM d)"


@query("r12_classifier_scores", f"{_AUC} SELECT {_r('accuracy', 'precision', 'recall', 'f1', 'brier')}, {sql_r('((SELECT sum(rk) FROM r WHERE y = 1) - p * (p + 1) / 2) / (p * n)', 'roc_auc')}, {sql_r('(SELECT sum(tp * ct / cc) FROM a) / p', 'average_precision')} FROM f", "cases")
def r12(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rl.classifier_scores(_labelled(spark, root), "y", "score"))


def _examples(spark: SparkSession, root: str, multiplier: float = 0.8) -> DataFrame:
    """Examples with targets against their anchor, run context, and the support their label, reference and dataset have in train."""
    e = rl.relative_threshold(v.examples(spark, root), multiplier).where("target_fidelity IS NOT NULL AND transport_threshold IS NOT NULL")
    u = v.units(spark, root)
    sizes = u.groupBy("split_id").agg(
        F.count_if(F.col("split_part") == "train").alias("train_units"), F.countDistinct(F.when(F.col("split_part") == "train", F.col("perturbation_label"))).alias("train_perturbations")
    )
    support = rl.support_features(u.withColumnRenamed("split_part", "part"))
    names = [c for c in support.columns if c.endswith(("_count", "_in_train", "_fraction", "is_combination"))]
    once = support.groupBy("split_id", "signature_id").agg(*[F.max(c).alias(c) for c in names])
    stem = F.regexp_replace("run_id", "__[^_]+(_[^_]+)*_baseline$", "")
    flags = {"split_id": stem, "log1p_n_cells": rel.log1p_or_zero("n_cells"), "stress_family_flag": F.coalesce(F.col("split_family").isin(ev.STRESS_FAMILIES), F.lit(False)).cast("double")}
    return e.withColumns(flags).join(sizes, "split_id", "left").join(once, ["split_id", "signature_id"], "left").drop("split_id")


@query("n7_relative_threshold", f"WITH m AS (SELECT unnest([0.6, 0.7, 0.8, 0.9])::DOUBLE AS multiplier), t AS (SELECT multiplier, target_fidelity >= multiplier * coalesce(anchor_signature_median_cosine, anchor_signature_median_cosine_run) AS k FROM examples, m) SELECT multiplier, count(*) AS n, {sql_r('avg(coalesce(k, false)::INT)', 'transportable_rate')} FROM t GROUP BY multiplier", "examples")
def n7(spark: SparkSession, root: str) -> DataFrame:
    e = v.examples(spark, root)
    grid = e.select("target_fidelity", "anchor_signature_median_cosine", "anchor_signature_median_cosine_run", F.explode(F.array(*[F.lit(x) for x in (0.6, 0.7, 0.8, 0.9)])).alias("multiplier"))
    kept = F.coalesce(F.col("target_fidelity") >= F.col("multiplier") * F.coalesce("anchor_signature_median_cosine", "anchor_signature_median_cosine_run"), F.lit(False))
    return rounded(grid.groupBy("multiplier").agg(F.count(F.lit(1)).alias("n"), F.avg(kept.cast("int")).alias("transportable_rate")))


@query("n7_threshold_sensitivity")
def n7_metrics(spark: SparkSession, root: str) -> DataFrame:
    """The suite refitted at every multiplier, beside the rate of ``n7_relative_threshold``, which is over all examples."""
    rates = {r.multiplier: r.transportable_rate for r in n7(spark, root).collect()}
    labels = {f"{rl.TARGET}_{i}": m for i, m in enumerate(sorted(rates))}
    e = cut(rl.label_columns(_examples(spark, root), labels))
    got = rl.label_suites(e, list(labels), ["full", "no_context_distance"], at=0.8)
    of = lambda x: F.create_map(*[F.lit(z) for y, m in labels.items() for z in (y, x[m])])[F.col("label")]
    return rounded(got.select(
        of({m: m for m in rates}).alias("threshold_multiplier"), "ablation", "estimator", of(rates).alias("transportable_rate"), "accuracy", "roc_auc", "average_precision",
        "mean_false_transportability_rate", "mean_selective_risk", "coverage_at_0p8", "false_transportability_rate_at_0p8",
    ))


@query("r13_ablation_suite")
def r13(spark: SparkSession, root: str) -> DataFrame:
    return rl.ablation_suite(cut(_examples(spark, root)), list(rl.ABLATIONS))


#: Held examples of the first seed, and the scores by confidence and by its excess over the train part's nonconformity.
_HELD = (
    "e AS (SELECT example_id, run_id, coalesce(confidence, 0) AS s, target_fidelity AS f, 0.8::DOUBLE * coalesce(anchor_signature_median_cosine, anchor_signature_median_cosine_run) AS t FROM examples), "
    "l AS (SELECT example_id, run_id, s, (f >= t)::INT AS y, 1 - f AS risk FROM e WHERE f IS NOT NULL AND t IS NOT NULL), "
    "h AS (SELECT run_id, row_number() OVER (ORDER BY md5('7|' || run_id), run_id) <= ceil(count(*) OVER () * 0.25::DOUBLE) AS held FROM (SELECT DISTINCT run_id FROM l)), "
    "p AS (SELECT l.*, held FROM l JOIN h USING (run_id)), q AS (SELECT quantile_cont(1 - s, 0.2) AS cutoff FROM p WHERE NOT held), "
    "b AS (SELECT 'naive_confidence' AS baseline, example_id, y, risk, s FROM p WHERE held UNION ALL SELECT 'conformal_confidence_proxy', example_id, y, risk, greatest(0, least(1, 1 - greatest(0, 1 - s - cutoff))) FROM p, q WHERE held), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY baseline ORDER BY s DESC, example_id) AS rn, count(*) OVER (PARTITION BY baseline) AS n, rank() OVER (PARTITION BY baseline ORDER BY s) + (count(*) OVER (PARTITION BY baseline, s) - 1) / 2 AS rk FROM b), "
    "k AS (SELECT baseline, c, avg(risk) FILTER (WHERE rn <= greatest(1, ceil(c * n))) AS sr, avg(1 - y) FILTER (WHERE rn <= greatest(1, ceil(c * n))) AS fr, avg(risk) AS base FROM r, (SELECT unnest([0.2, 0.4, 0.6, 0.8])::DOUBLE AS c) GROUP BY ALL), "
    "m AS (SELECT baseline, avg(sr) AS mean_selective_risk, avg(fr) AS mean_false_transportability_rate, avg(base - sr) AS mean_abstention_gain FROM k GROUP BY ALL), "
    "a AS (SELECT baseline, avg(((s >= 0.5)::INT = y)::INT) AS accuracy, avg((s - y) ** 2) AS brier, (sum(rk) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * sum(1 - y)) AS roc_auc FROM r GROUP BY ALL)"
)


@query("n8_score_baselines", f"WITH {_HELD} SELECT baseline, {_r('accuracy', 'brier', 'roc_auc', 'mean_selective_risk', 'mean_false_transportability_rate', 'mean_abstention_gain')} FROM a JOIN m USING (baseline)", "examples")
def n8_scores(spark: SparkSession, root: str) -> DataFrame:
    """The naive confidence and the conformal proxy on the held examples."""
    (a, naive), (b, proxy) = held_scores(spark, root)
    both = rl.score_row(naive, a, "", 1).unionByName(rl.score_row(proxy, b, "", 1))
    return rounded(both.select(F.col("ablation").alias("baseline"), "accuracy", "brier", "roc_auc", "mean_selective_risk", "mean_false_transportability_rate", "mean_abstention_gain"))


def held_scores(spark: SparkSession, root: str) -> list[tuple[str, DataFrame]]:
    """The held examples scored by their confidence, and by its excess over the train part's nonconformity."""
    e = rl.relative_threshold(v.examples(spark, root), 0.8).where("target_fidelity IS NOT NULL AND transport_threshold IS NOT NULL")
    parts = cut(rl.group_parts(e, "run_id", "example_id"))
    naive = parts.where("held").withColumn("score", F.coalesce("confidence", F.lit(0.0)))
    return [("naive_confidence", naive), ("conformal_confidence_proxy", rl.conformal_scores(parts))]


@query("n8_reliability_baselines")
def n8(spark: SparkSession, root: str) -> DataFrame:
    return rl.reliability_baselines(cut(_examples(spark, root)))


def _failures(spark: SparkSession, root: str) -> DataFrame:
    c = v.cases(spark, root).where("transportable IS NOT NULL").withColumn("transport_threshold", F.lit(0.4))
    t = rl.targets(c).withColumns({"perturbation_seen": (F.col("support_signatures") > 0).cast("double")})
    return rl.failure_summary(t, ["cosine_similarity", "risk", "confidence", "n_cells", "perturbation_seen"])


_FAIL = f"fails AS (SELECT model, split_family, failure_mode, count(signature_id) AS n_signatures, avg(transportable::INT) AS transportable_rate, avg(cosine_similarity) AS mean_cosine_similarity, avg(risk) AS mean_risk, avg(confidence) AS mean_confidence, avg(n_cells) AS mean_n_cells, avg((support_signatures > 0)::INT) AS mean_perturbation_seen FROM (SELECT * REPLACE ({_MODE.format(k='transportable', r='risk', f='cosine_similarity', t='0.4::DOUBLE')} AS failure_mode) FROM cases WHERE transportable IS NOT NULL) GROUP BY ALL)"
_FCOLS = ["transportable_rate", "mean_cosine_similarity", "mean_risk", "mean_confidence", "mean_n_cells", "mean_perturbation_seen"]


@query("r15_failure_summary", f"WITH {_FAIL} SELECT model, split_family, failure_mode, n_signatures, {_r(*_FCOLS)} FROM fails", "cases")
def r15(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_failures(spark, root))


# Reports.

_DECAY = """s AS (SELECT model, split_family, count(run_id) AS n_runs, avg(mean_cosine) AS m, quantile_cont(mean_cosine, 0.5) AS med, avg(random_to_stress_drop) AS d, avg(stress_retention) AS k FROM run_metrics GROUP BY ALL),
f AS (SELECT *, CASE WHEN m IS NOT NULL THEN rank() OVER (PARTITION BY split_family ORDER BY m DESC NULLS LAST) END::INTEGER AS family_rank FROM s),
j AS (SELECT f.*, b.family_rank AS random_split_rank, b.m AS random_split_mean, f.family_rank - b.family_rank AS change FROM f LEFT JOIN (SELECT * FROM f WHERE split_family = 'random_split') b ON f.model = b.model),
decay AS (SELECT *, CASE WHEN split_family = 'random_split' THEN 'anchor' WHEN change > 0 THEN 'worse_rank' WHEN change < 0 THEN 'better_rank' ELSE 'same_rank' END AS rank_shift_direction, CASE WHEN split_family = 'random_split' THEN 'anchor' WHEN k IS NULL THEN 'not_applicable' WHEN abs(k) > 10 THEN 'unstable_small_anchor_ratio' ELSE 'interpretable_ratio' END AS stress_retention_flag FROM j)"""


def _decay(spark: SparkSession, root: str) -> DataFrame:
    return rp.transfer_decay(v.run_metrics(spark, root), ["mean_cosine", "random_to_stress_drop", "stress_retention"])


@query("n1_transfer_decay", f"WITH {_DECAY} SELECT model, split_family, n_runs, {sql_r('m', 'mean_mean_cosine')}, {sql_r('med', 'median_mean_cosine')}, {sql_r('d', 'mean_random_to_stress_drop')}, family_rank, random_split_rank, coalesce(family_rank = 1, false) AS family_winner, change AS rank_change_vs_random, {sql_r('m - random_split_mean', 'cosine_change_vs_random')}, rank_shift_direction, rank_shift_direction IN ('worse_rank', 'better_rank') AS ranking_reversal_flag, stress_retention_flag FROM decay", "run_metrics")
def n1(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_decay(spark, root).select("model", "split_family", "n_runs", "mean_mean_cosine", "median_mean_cosine", "mean_random_to_stress_drop", "family_rank", "random_split_rank", "family_winner", "rank_change_vs_random", "cosine_change_vs_random", "rank_shift_direction", "ranking_reversal_flag", "stress_retention_flag"))


_SCORES = "scores AS (SELECT model AS ablation, CASE model WHEN 'control_mean_baseline' THEN 'naive_confidence' ELSE 'fitted' END AS estimator, avg(risk) AS mean_selective_risk, avg((NOT transportable)::INT) AS mean_false_transportability_rate FROM cases WHERE model IS NOT NULL GROUP BY ALL)"


@query("n2_selective_summary", f"WITH {_SCORES}, n AS (SELECT mean_selective_risk AS nr, mean_false_transportability_rate AS nf FROM scores WHERE estimator = 'naive_confidence') SELECT ablation, estimator, {_r('mean_selective_risk', 'mean_false_transportability_rate')}, {sql_r('mean_false_transportability_rate - nf', 'false_rate_delta_vs_naive')}, {sql_r('mean_selective_risk - nr', 'selective_risk_delta_vs_naive')}, coalesce(mean_false_transportability_rate - nf < 0, false) AS improves_filtering, 'completed' AS status, '' AS reason FROM scores, n", "cases")
def n2(spark: SparkSession, root: str) -> DataFrame:
    s = v.cases(spark, root).where("model IS NOT NULL").groupBy(F.col("model").alias("ablation")).agg(F.avg("risk").alias("mean_selective_risk"), F.avg((~F.col("transportable")).cast("int")).alias("mean_false_transportability_rate"))
    s = s.withColumn("estimator", F.when(F.col("ablation") == rp.CONTROL_MODEL, "naive_confidence").otherwise("fitted"))
    status = s.select("ablation", F.lit("completed").alias("status"), F.lit(None).cast("string").alias("reason"))
    got = rp.selective_summary(s, status)
    return rounded(got.select("ablation", "estimator", "mean_selective_risk", "mean_false_transportability_rate", "false_rate_delta_vs_naive", "selective_risk_delta_vs_naive", "improves_filtering", "status", "reason"))


_ATLAS = _FAIL + ", atlas AS (SELECT *, n_signatures / sum(n_signatures) OVER w AS failure_mode_share, CASE failure_mode WHEN 'transportable' THEN 0 WHEN 'high_risk_failure' THEN 2 WHEN 'severe_failure' THEN 3 ELSE 1 END AS failure_severity, coalesce(n_signatures = max(n_signatures) OVER w, false) AS dominant_failure, coalesce(CASE WHEN failure_mode <> 'transportable' THEN n_signatures END = max(CASE WHEN failure_mode <> 'transportable' THEN n_signatures END) OVER w, false) AS dominant_nontransportable_failure, CASE WHEN coalesce(mean_perturbation_seen, 1) < 0.25 THEN 'perturbation_novelty' WHEN coalesce(mean_n_cells, 100) < 20 THEN 'low_signature_support' ELSE 'mixed_or_supported_context' END AS context_signal FROM fails WINDOW w AS (PARTITION BY model, split_family))"


def _atlas(spark: SparkSession, root: str) -> DataFrame:
    f = _failures(spark, root).withColumns({c: F.lit(None).cast("double") for c in ("mean_component_seen_fraction", "mean_reference_seen")})
    return rp.failure_atlas(f)


@query("n3_failure_atlas", f"WITH {_ATLAS}, x AS (SELECT model, split_family, failure_mode, count(DISTINCT signature_id) AS n_unique_signatures FROM (SELECT * REPLACE ({_MODE.format(k='transportable', r='risk', f='cosine_similarity', t='0.4::DOUBLE')} AS failure_mode) FROM cases WHERE transportable IS NOT NULL) GROUP BY ALL) SELECT a.model, a.split_family, a.failure_mode, n_signatures, {_r('failure_mode_share')}, failure_severity, dominant_failure, dominant_nontransportable_failure, context_signal, n_unique_signatures FROM atlas a LEFT JOIN x ON a.model IS NOT DISTINCT FROM x.model AND a.split_family IS NOT DISTINCT FROM x.split_family AND a.failure_mode = x.failure_mode", "cases")
def n3(spark: SparkSession, root: str) -> DataFrame:
    c = rl.targets(v.cases(spark, root).withColumn("transport_threshold", F.lit(0.4)))
    extras = c.groupBy("model", "split_family", "failure_mode").agg(F.countDistinct("signature_id").alias("n_unique_signatures"))
    f = _failures(spark, root).withColumns({x: F.lit(None).cast("double") for x in ("mean_component_seen_fraction", "mean_reference_seen")})
    got = rp.failure_atlas(f, extras)
    return rounded(got.select("model", "split_family", "failure_mode", "n_signatures", "failure_mode_share", "failure_severity", "dominant_failure", "dominant_nontransportable_failure", "context_signal", "n_unique_signatures"))


_DIFF = "WITH m AS (SELECT model, split_family, count(run_id) AS n_runs, avg(mean_cosine) AS v FROM run_metrics GROUP BY ALL), a AS (SELECT m.*, b.v AS anchor FROM m LEFT JOIN (SELECT * FROM m WHERE split_family = 'random_split') b ON m.model = b.model), c AS (SELECT model, split_family, avg(support_signatures) AS s, avg((support_signatures > 0)::INT) AS seen, avg(n_cells) AS far FROM cases GROUP BY ALL), j AS (SELECT a.*, v / nullif(anchor, 0) AS score, ln(1 + coalesce(s, 0)) AS ls, seen, coalesce(far, 0) AS far FROM a LEFT JOIN c USING (model, split_family)), q AS (SELECT *, CASE WHEN max(ls) OVER () > min(ls) OVER () THEN 1 - (ls - min(ls) OVER ()) / (max(ls) OVER () - min(ls) OVER ()) ELSE 0 END AS d1, 1 - coalesce(seen, 1) AS d2, CASE WHEN max(far) OVER () > 0 THEN far / max(far) OVER () ELSE 0 END AS d3 FROM j), d AS (SELECT *, (greatest(0, least(1, d1)) + greatest(0, least(1, d2)) + greatest(0, least(1, d3))) / 3 AS difficulty_index FROM q)"


def n4_raw(spark: SparkSession, root: str) -> DataFrame:
    e = v.cases(spark, root).select("model", "split_family", F.col("support_signatures").alias("perturbation_train_signature_count"), (F.col("support_signatures") > 0).cast("double").alias("perturbation_seen_in_train"), F.lit(None).cast("double").alias("component_seen_fraction"), F.col("n_cells").cast("double").alias("train_test_centroid_l2"))
    return rp.split_difficulty(v.run_metrics(spark, root), "mean_cosine", e)


@query("n4_split_difficulty", f"{_DIFF} SELECT model, split_family, n_runs, {sql_r('score', 'normalized_transfer_score')}, {_r('difficulty_index')}, CASE WHEN split_family = 'random_split' THEN 'low_stress_anchor' WHEN score > 1 THEN 'above_anchor_after_normalization' WHEN difficulty_index >= 0.66 THEN 'high_difficulty_context' ELSE 'moderate_or_mixed_difficulty' END AS difficulty_interpretation FROM d", "run_metrics", "cases")
def n4(spark: SparkSession, root: str) -> DataFrame:
    return rounded(n4_raw(spark, root).select("model", "split_family", "n_runs", "normalized_transfer_score", "difficulty_index", "difficulty_interpretation"))


_FIND = (
    "SELECT * FROM (SELECT 'F1' AS finding, 'mean_mean_cosine' AS metric, split_family AS subject, avg(m) AS value FROM decay WHERE model <> 'control_mean_baseline' AND split_family <> 'random_split' GROUP BY split_family ORDER BY value NULLS LAST, split_family LIMIT 1) "
    "UNION ALL SELECT 'F2', 'family_rank', string_agg(CASE WHEN split_family <> 'random_split' THEN split_family || ': ' || model END, '; ' ORDER BY split_family || ': ' || model), count(DISTINCT model)::DOUBLE FROM decay WHERE model <> 'control_mean_baseline' AND family_rank = 1 "
    "UNION ALL SELECT 'F3', 'rank_change_vs_random', 'ridge_regression_baseline', avg(change)::DOUBLE FROM decay WHERE model = 'ridge_regression_baseline' AND split_family IN ('dataset_heldout_split', 'external_holdout') HAVING count(*) > 0 "
    "UNION ALL SELECT * FROM (SELECT 'F4', 'false_rate_gain_vs_naive', ablation || ' / ' || estimator, (SELECT mean_false_transportability_rate FROM scores WHERE estimator = 'naive_confidence') - mean_false_transportability_rate AS g FROM scores WHERE estimator <> 'naive_confidence' AND mean_false_transportability_rate IS NOT NULL ORDER BY g DESC, ablation LIMIT 1) "
    "UNION ALL SELECT * FROM (SELECT 'F5', 'failure_mode_share', concat_ws(' / ', failure_mode, model, split_family), failure_mode_share FROM atlas WHERE failure_severity > 0 ORDER BY failure_severity DESC, failure_mode_share DESC, model, split_family, failure_mode LIMIT 1) "
    f"UNION ALL SELECT 'F7', 'difficulty_index', split_family, difficulty_index FROM (SELECT * FROM ({_DIFF} SELECT model, split_family, difficulty_index FROM d) WHERE split_family <> 'random_split' ORDER BY difficulty_index DESC NULLS LAST, split_family, model LIMIT 1) "
    "UNION ALL SELECT 'F10', 'n_outcome_columns', 'feature audit', count(*) FILTER (WHERE target_or_label)::DOUBLE FROM g"
)


def _findings(spark: SparkSession, root: str, **more: DataFrame) -> tuple[DataFrame, DataFrame]:
    decay = cut(_decay(spark, root))
    return rp.main_findings(decay, "mean_mean_cosine", _atlas(spark, root), scores=n2(spark, root), difficulty=n4_raw(spark, root), audit=ft.feature_audit(_examples(spark, root)), **more), decay


@query("n5_main_findings", f"WITH {_DECAY.replace('s AS (', 's0 AS (', 1).replace('FROM s)', 'FROM s0)').replace('f AS (', 'f0 AS (', 1).replace('FROM f LEFT JOIN (SELECT * FROM f ', 'FROM f0 f LEFT JOIN (SELECT * FROM f0 ').replace('j AS (', 'j0 AS (', 1).replace('FROM j)', 'FROM j0)')}, {_ATLAS}, {_SCORES}, {_ROLES} SELECT finding, metric, subject, {sql_r('value', 'value')} FROM ({_FIND})", "run_metrics", "cases")
def n5(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_findings(spark, root)[0])


@query("n6_narrative")
def n6(spark: SparkSession, root: str) -> DataFrame:
    """All ten findings as a bounded text, one row a line."""
    p = cut(v.pairs(spark, root))
    sets = spark.range(64).select(F.concat(F.lit("set"), F.col("id") % 7).alias("pathway"), F.col("id").cast("int").alias("pos"))
    tests = ev.pairwise_comparisons(v.run_metrics(spark, root), ["mean_cosine", "mean_risk"], ["split_family", "dataset_scope", "seed"])
    found, decay = _findings(
        spark, root, pairwise=tests, pathway=ev.pathway_fidelity(p, ["vec_id"], "truth", "guess", sets), retrieval=ev.retrieval(p, "dataset_id", "vec_id", "perturbation_label", "truth", "guess"),
    )
    text = rp.narrative(found, decay, "mean_mean_cosine")
    return spark.createDataFrame(list(enumerate(text.splitlines())), "line int, text string")


@query("n11_screen_validation", f"WITH h AS (SELECT * FROM run_metrics WHERE split_family = 'dataset_heldout_split'), m AS (SELECT heldout_target, model, avg(mean_cosine) AS m FROM h GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY heldout_target ORDER BY m DESC NULLS LAST, model) = 1), s AS (SELECT heldout_target, count(DISTINCT run_id) AS n_runs, count(DISTINCT model) AS n_models, count(DISTINCT seed) AS n_seeds, avg(mean_cosine) AS mean_value FROM h GROUP BY ALL) SELECT dataset_id, n_cells_kept, coalesce(n_runs, 0) AS n_runs, coalesce(n_models, 0) AS n_models, coalesce(n_seeds, 0) AS n_seeds, {_r('mean_value')}, coalesce(b.model, '') AS best_model, {sql_r('b.m', 'best_mean')}, CASE WHEN n_runs > 0 THEN 'completed' ELSE 'no_completed_runs' END AS status FROM preprocessing_summary d LEFT JOIN s ON s.heldout_target = dataset_id LEFT JOIN b ON b.heldout_target = dataset_id", "run_metrics")
def n11(spark: SparkSession, root: str) -> DataFrame:
    return rounded(rp.screen_validation(v.run_metrics(spark, root), table(spark, root, "preprocessing_summary"), "mean_cosine"))


@query("n12_contract_profile", "SELECT contract_audit_status, adoption_status, count(*) AS n_candidates, count(DISTINCT dataset_label) AS n_datasets, sum(n_cells)::BIGINT AS n_cells, count(*) FILTER (WHERE has_perturbation_field) AS n_with_perturbation, count(*) FILTER (WHERE n_control_cells > 0) AS n_with_controls FROM (SELECT * FROM external_candidate_contract_audit QUALIFY row_number() OVER (PARTITION BY audit_id ORDER BY ingested_at DESC) = 1) GROUP BY ALL")
def n12(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "external_candidate_contract_audit")
    rows = latest(t, "audit_id", ["dataset_label", "n_cells", "has_perturbation_field", "n_control_cells", "contract_audit_status", "adoption_status"])
    return rp.contract_profile(rows, ["contract_audit_status", "adoption_status"])


@query("n14_case_examples", "WITH c AS (SELECT * FROM cases WHERE cosine_similarity IS NOT NULL AND signature_id IS NOT NULL), a AS (SELECT case_id, signature_id, 'retained_success' AS kind FROM c WHERE transportable AND confidence >= 0.5 ORDER BY confidence DESC NULLS LAST, cosine_similarity DESC NULLS LAST, case_id LIMIT 1), b AS (SELECT case_id, signature_id, 'rejected_failure' AS kind FROM c WHERE NOT transportable AND failure_mode IN ('severe_failure', 'high_risk_failure') AND signature_id NOT IN (SELECT signature_id FROM a) ORDER BY risk DESC NULLS LAST, confidence ASC NULLS FIRST, case_id LIMIT 1), d AS (SELECT case_id, signature_id, 'boundary_failure' AS kind FROM c WHERE split_family IN ('dataset_heldout_split', 'external_holdout') AND NOT transportable AND signature_id NOT IN (SELECT signature_id FROM a UNION ALL SELECT signature_id FROM b) ORDER BY cosine_similarity, case_id LIMIT 1) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d", "cases")
def n14(spark: SparkSession, root: str) -> DataFrame:
    return rp.case_examples(v.cases(spark, root)).select("case_id", "signature_id", "kind")


@query("n15_progress", "SELECT model, count(*) AS n_total, count(*) FILTER (WHERE lower(trim(status)) IN ('success', 'cached')) AS n_done FROM runs GROUP BY ALL", "runs")
def n15(spark: SparkSession, root: str) -> DataFrame:
    done = F.count_if(F.lower(F.trim("status")).isin("success", "cached"))
    return v.runs(spark, root).groupBy("model").agg(F.count(F.lit(1)).alias("n_total"), done.alias("n_done"))


# Data of the figures.


@query("g1_dataset_surface", "SELECT * FROM (SELECT dataset_scope, count(DISTINCT run_id) AS runs, count(DISTINCT heldout_target) AS targets FROM runs GROUP BY ALL) ORDER BY runs DESC, dataset_scope LIMIT 8", "runs")
def g1(spark: SparkSession, root: str) -> DataFrame:
    t = v.runs(spark, root).groupBy("dataset_scope").agg(F.countDistinct("run_id").alias("runs"), F.countDistinct("heldout_target").alias("targets"))
    return t.orderBy(F.col("runs").desc(), "dataset_scope").limit(8)


@query("g2_training_support", f"SELECT split_id, {sql_r('log10(greatest(count(*) FILTER (WHERE split_part = ' + chr(39) + 'train' + chr(39) + '), 1))', 'log_train_units')} FROM units GROUP BY ALL", "units")
def g2(spark: SparkSession, root: str) -> DataFrame:
    n = F.count_if(F.col("split_part") == "train")
    return rounded(v.units(spark, root).groupBy("split_id").agg(F.log10(F.greatest(n, F.lit(1))).alias("log_train_units")))


@query("g4_overlap_heatmap", f"WITH o AS (SELECT split_id, count(*) FILTER (WHERE a AND b) AS n FROM (SELECT split_id, reference_key, bool_or(split_part = 'train') AS a, bool_or(split_part = 'test') AS b FROM units WHERE reference_key IS NOT NULL GROUP BY ALL) GROUP BY ALL), f AS (SELECT string_split(split_id, '__')[1] AS family, avg(n) AS v FROM o GROUP BY ALL) SELECT family, {sql_r('v / CASE WHEN max(v) OVER () = 0 THEN 1 ELSE max(v) OVER () END', 'reference_overlap')} FROM f", "units")
def g4(spark: SparkSession, root: str) -> DataFrame:
    from vectrail.operators.splits import overlap_counts

    o = overlap_counts(v.units(spark, root).withColumnRenamed("split_part", "part"), ["split_id"], "reference_key", "n")
    f = o.groupBy(F.substring_index("split_id", "__", 1).alias("family")).agg(F.avg("n").alias("v"))
    top = F.broadcast(f.agg(F.when(F.max("v") == 0, 1.0).otherwise(F.max("v")).alias("top")))  # one row
    return rounded(f.join(top).select("family", (F.col("v") / F.col("top")).alias("reference_overlap")))


@query("g5_rank_matrix", f"WITH {_DECAY} SELECT model, split_family, family_rank, {sql_r('m', 'mean_mean_cosine')} FROM decay", "run_metrics")
def g5(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_decay(spark, root).select("model", "split_family", "family_rank", "mean_mean_cosine"))


@query("g8_roc_points", f"WITH l AS (SELECT transportable::INT AS y, coalesce(confidence, 0) AS s FROM cases WHERE transportable IS NOT NULL), d AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM l GROUP BY s) SELECT s AS score, {sql_r('sum(p) OVER (ORDER BY s DESC) / sum(p) OVER ()', 'tpr')}, {sql_r('sum(n) OVER (ORDER BY s DESC) / sum(n) OVER ()', 'fpr')} FROM d", "cases")
def g8(spark: SparkSession, root: str) -> DataFrame:
    d = _labelled(spark, root).groupBy("score").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n"))
    run = rel.global_running(d, [F.col("score").desc()], {"tp": "p", "fp": "n"})
    whole = F.broadcast(d.agg(F.sum("p").alias("np"), F.sum("n").alias("nn")))  # one row
    return rounded(run.join(whole).select("score", (F.col("tp") / F.col("np")).alias("tpr"), (F.col("fp") / F.col("nn")).alias("fpr")))


@query("g10_severe_share", f"WITH {_ATLAS} SELECT model, split_family, {sql_r('failure_mode_share * 100', 'severe_percent')} FROM atlas WHERE failure_mode = 'severe_failure'", "cases")
def g10(spark: SparkSession, root: str) -> DataFrame:
    return rounded(_atlas(spark, root).where("failure_mode = 'severe_failure'").select("model", "split_family", (F.col("failure_mode_share") * 100).alias("severe_percent")))


@query("g11_severity_composition", f"WITH {_FAIL}, n AS (SELECT split_family, failure_mode, sum(n_signatures)::BIGINT AS n_signatures FROM fails GROUP BY ALL) SELECT *, {sql_r('n_signatures / sum(n_signatures) OVER (PARTITION BY split_family)', 'share')} FROM n", "cases")
def g11(spark: SparkSession, root: str) -> DataFrame:
    n = _failures(spark, root).groupBy("split_family", "failure_mode").agg(F.sum("n_signatures").alias("n_signatures"))
    return rounded(rel.with_share(n, ["split_family"], "n_signatures", "share"))


@query("g12_context_enrichment", f"WITH {_FAIL} SELECT {sql_r('1 - avg(mean_perturbation_seen)', 'novelty')}, {sql_r('greatest(0, least(1, 1 - avg(log10(greatest(mean_n_cells, 1))) / 4))', 'low_support')} FROM fails WHERE failure_mode = 'severe_failure'", "cases")
def g12(spark: SparkSession, root: str) -> DataFrame:
    f = _failures(spark, root).where("failure_mode = 'severe_failure'")
    low = rel.clip(1 - F.avg(F.log10(F.greatest("mean_n_cells", F.lit(1.0)))) / 4, 0.0, 1.0)
    return rounded(f.agg((1 - F.avg("mean_perturbation_seen")).alias("novelty"), low.alias("low_support")))


@query("g14_calibration", f"WITH l AS (SELECT transportable::INT AS y, coalesce(confidence, 0) AS s FROM cases WHERE transportable IS NOT NULL), e AS (SELECT list_distinct(quantile_cont(s, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875])) AS q, min(s) AS lo, max(s) AS hi FROM l), b AS (SELECT list_filter(q, lambda x: x > lo AND x < hi) AS q FROM e), k AS (SELECT y, s, len(list_filter(q, lambda x: s > x))::INTEGER AS bin FROM l, b) SELECT bin, count(*) AS n, {sql_r('avg(s)', 'mean_score')}, {sql_r('avg(y)', 'rate')} FROM k GROUP BY bin", "cases")
def g14(spark: SparkSession, root: str) -> DataFrame:
    b = rel.quantile_bins(_labelled(spark, root), "score", 8)
    return rounded(b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("y").alias("rate")))


@query("g15_status_pivot", "SELECT split_family, count(*) FILTER (WHERE lower(trim(status)) = 'success') AS success, count(*) FILTER (WHERE lower(trim(status)) = 'cached') AS cached, count(*) FILTER (WHERE lower(trim(status)) = 'failed') AS failed FROM runs GROUP BY ALL", "runs")
def g15(spark: SparkSession, root: str) -> DataFrame:
    s = F.lower(F.trim("status"))
    return v.runs(spark, root).groupBy("split_family").agg(*[F.count_if(s == x).alias(x) for x in ("success", "cached", "failed")])
