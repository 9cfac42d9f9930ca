"""Views of the tables as the operators want them, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.functions.labels import normalize_label
from vectrail.operators.predictors import control_profiles, with_profiles
from vectrail.operators.splits import random_part
from vectrail.operators.vectors import as_double
from vectrail.tables import finite, latest, table

DIGITS = 6
#: Added before rounding: means of rounded numbers lie on ties, which the order of a sum would tip either way.
NUDGE = 1e-10


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show; -0.0 becomes 0.0."""
    return df.select(*[(F.round(F.col(c) + F.lit(NUDGE), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def runs(spark: SparkSession, root: str) -> DataFrame:
    return latest(table(spark, root, "run_baseline"), "run_id", [c for c in table(spark, root, "run_baseline").columns if c not in ("run_id", "ingested_at")])


def units(spark: SparkSession, root: str) -> DataFrame:
    t = table(spark, root, "make_splits")
    return latest(t, "unit_id", [c for c in t.columns if c not in ("unit_id", "ingested_at")])


def cases(spark: SparkSession, root: str) -> DataFrame:
    cols = ["run_id", "signature_id", "dataset_id", "perturbation_label", "model", "split_family", "seed", "cosine_similarity", "transportable", "confidence", "risk", "failure_mode", "n_cells", "support_signatures", "top_true_genes", "top_pred_genes", "scored_at"]
    got = latest(table(spark, root, "cbac_case_examples"), "case_id", cols)
    return got.withColumns({c: finite(c) for c in ("cosine_similarity", "confidence", "risk", "support_signatures")})


def examples(spark: SparkSession, root: str) -> DataFrame:
    cols = ["run_id", "signature_id", "model", "dataset_id", "split_family", "seed", "target_fidelity", "confidence", "anchor_signature_median_cosine", "anchor_signature_median_cosine_run", "gene_space_policy", "n_cells"]
    got = latest(table(spark, root, "methods_reinforcement"), "example_id", cols)
    anchors = ["anchor_signature_median_cosine", "anchor_signature_median_cosine_run"]
    clean = {c: F.when(F.abs(finite(c)) <= 1, finite(c)) for c in anchors}
    return got.withColumns({**clean, "target_fidelity": finite("target_fidelity"), "confidence": finite("confidence"), "gene_space_policy": normalize_label("gene_space_policy")})


def signatures(spark: SparkSession, root: str) -> DataFrame:
    label = F.when(F.col("label") == 0, "control")
    for k, v in {6: "P1_P2", 7: "P3_P4", 8: "P1_P9", 9: "P5_ctrl"}.items():
        label = label.when(F.col("label") == k, v)
    ds = F.concat(F.lit("ds"), F.col("vec_id") % 4)
    return table(spark, root, "embeddings").select(
        "vec_id", ds.alias("dataset_id"), F.concat(F.lit("r"), F.expr("(vec_id div 4) % 2")).alias("reference_key"),
        F.concat(ds, F.lit("__"), F.col("vec_id")).alias("signature_id"),
        label.otherwise(F.concat(F.lit("P"), F.col("label"))).alias("perturbation_label"), (F.col("label") == 0).alias("is_control"),
        (5 + (F.col("vec_id") * 37) % 200).cast("int").alias("n_cells"), F.concat(F.lit("b"), F.col("vec_id") % 3).alias("batch"),
        F.concat(F.lit("t"), F.col("vec_id") % 2).alias("timepoint"), as_double("embedding").alias("delta"),
    )


def members(spark: SparkSession, root: str) -> DataFrame:
    """Signatures in a random split of each dataset; the dataset is the run."""
    return random_part(signatures(spark, root), "signature_id", 0, "is_control", ["dataset_id"]).withColumn("run", F.col("dataset_id"))


def profiled(spark: SparkSession, root: str) -> DataFrame:
    got = members(spark, root)
    return with_profiles(got, control_profiles(got))


def pairs(spark: SparkSession, root: str) -> DataFrame:
    """Each signature as truth, with the next one as its guess."""
    s = signatures(spark, root)
    nxt = s.select((F.col("vec_id") - 1).alias("vec_id"), F.col("delta").alias("guess"))
    return s.select("vec_id", "dataset_id", "perturbation_label", "is_control", F.col("delta").alias("truth")).join(nxt, "vec_id")


def run_metrics(spark: SparkSession, root: str) -> DataFrame:
    """One row a run with cases: mean cosine and risk, anchor, drop and retention."""
    from vectrail.operators.evaluate import anchors, drop_and_retention

    c, r = cases(spark, root), runs(spark, root)
    per = c.groupBy("run_id").agg(
        F.avg("cosine_similarity").alias("mean_cosine"), F.avg("risk").alias("mean_risk"), F.avg("confidence").alias("mean_confidence"), F.count(F.lit(1)).alias("n_cases")
    )
    got = r.select("run_id", "model", "split_family", "dataset_scope", "heldout_target", "seed").join(per, "run_id").join(anchors(c, r), "run_id", "left")
    drop, kept = drop_and_retention("mean_cosine", "anchor_mean")
    stress = F.col("split_family") != "random_split"
    return got.withColumn("random_to_stress_drop", F.when(stress, drop)).withColumn("stress_retention", F.when(stress, kept))


_LATEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY ingested_at DESC) AS rn_ FROM {t} WHERE {k} IS NOT NULL) WHERE rn_ = 1)"
_FIN = "CASE WHEN isfinite({c}) THEN {c} + 0.0 END AS {c}"


def _latest(t: str, k: str) -> str:
    return _LATEST.format(t=t, k=k)


_ANCHOR = "CASE WHEN isfinite({c}) AND abs({c}) <= 1 THEN {c} + 0.0 END AS {c}"

CTE: dict[str, tuple[list[str], str]] = {
    "runs": ([], f"SELECT * FROM {_latest('run_baseline', 'run_id')}"),
    "units": ([], f"SELECT * FROM {_latest('make_splits', 'unit_id')}"),
    "cases": ([], "SELECT * REPLACE (" + ", ".join(_FIN.format(c=c) for c in ("cosine_similarity", "confidence", "risk", "support_signatures")) + f") FROM {_latest('cbac_case_examples', 'case_id')}"),
    "examples": ([], "SELECT * REPLACE (" + ", ".join([_ANCHOR.format(c="anchor_signature_median_cosine"), _ANCHOR.format(c="anchor_signature_median_cosine_run"), _FIN.format(c="target_fidelity"), _FIN.format(c="confidence"), "CASE WHEN lower(trim(gene_space_policy)) NOT IN ('', 'na', 'nan', 'none', '<na>', 'unknown', 'null') THEN trim(gene_space_policy) END AS gene_space_policy"]) + f") FROM {_latest('methods_reinforcement', 'example_id')}"),
    "sig": ([], "SELECT vec_id, 'ds' || (vec_id % 4) AS dataset_id, 'r' || ((vec_id // 4) % 2) AS reference_key, 'ds' || (vec_id % 4) || '__' || vec_id AS signature_id, CASE label WHEN 0 THEN 'control' WHEN 6 THEN 'P1_P2' WHEN 7 THEN 'P3_P4' WHEN 8 THEN 'P1_P9' WHEN 9 THEN 'P5_ctrl' ELSE 'P' || label END AS perturbation_label, label = 0 AS is_control, (5 + (vec_id * 37) % 200)::INTEGER AS n_cells, 'b' || (vec_id % 3) AS batch, 't' || (vec_id % 2) AS timepoint, list_transform(embedding, lambda x: x::DOUBLE) AS delta FROM embeddings"),
    "members": (["sig"], "SELECT * EXCLUDE (n_, rn_), dataset_id AS run, CASE WHEN n_ < 3 THEN 'train' WHEN rn_ <= t_ THEN 'test' WHEN rn_ <= t_ + least(n_ - t_ - 1, greatest(1, round_even((n_ - t_) * 0.1765::DOUBLE, 0))) THEN 'validation' ELSE 'train' END AS part FROM (SELECT *, least(n_ - 2, greatest(1, round_even(n_ * 0.15::DOUBLE, 0)))::BIGINT AS t_ FROM (SELECT *, count(*) OVER (PARTITION BY dataset_id, is_control) AS n_, row_number() OVER (PARTITION BY dataset_id, is_control ORDER BY md5('0|' || signature_id), signature_id) AS rn_ FROM sig))"),
    "prof": (["sig"], "SELECT dataset_id, reference_key, list(p ORDER BY pos) AS profile FROM (SELECT dataset_id, reference_key, pos, avg(x) AS p FROM (SELECT dataset_id, reference_key, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM sig WHERE is_control) GROUP BY ALL) GROUP BY ALL"),
    "profiled": (["members", "prof"], "SELECT m.*, profile FROM members m JOIN prof USING (dataset_id, reference_key)"),
    "gmean": (["members"], "SELECT run, list(g ORDER BY pos) AS g FROM (SELECT run, pos, sum(x * n_cells) / sum(n_cells) AS g FROM (SELECT run, n_cells, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM members WHERE part = 'train' AND NOT is_control) GROUP BY ALL) GROUP BY ALL"),
    "lmean": (["members"], "SELECT run, perturbation_label, list(g ORDER BY pos) AS m FROM (SELECT run, perturbation_label, pos, sum(x * n_cells) / sum(n_cells) AS g FROM (SELECT run, perturbation_label, n_cells, unnest(delta) AS x, unnest(range(len(delta))) AS pos FROM members WHERE part = 'train' AND NOT is_control) GROUP BY ALL) GROUP BY ALL"),
    "pairs": (["sig"], "SELECT a.vec_id, a.dataset_id, a.perturbation_label, a.is_control, a.delta AS truth, b.delta AS guess FROM sig a JOIN sig b ON b.vec_id = a.vec_id + 1"),
    "anchors": (["cases", "runs"], "SELECT r.run_id, c.anchor_mean, c.anchor_median FROM (SELECT *, CASE WHEN split_family IN ('dataset_heldout_split', 'external_holdout') THEN heldout_target ELSE dataset_scope END AS anchor FROM runs) r LEFT JOIN (SELECT model, dataset_scope, seed, min(run_id) AS anchor_run FROM runs WHERE split_family = 'random_split' GROUP BY ALL) q ON q.model = r.model AND q.dataset_scope = r.anchor AND q.seed = r.seed LEFT JOIN (SELECT run_id, avg(cosine_similarity) AS anchor_mean, quantile_cont(cosine_similarity, 0.5) AS anchor_median FROM cases GROUP BY ALL) c ON c.run_id = q.anchor_run"),
    "run_metrics": (["anchors", "cases", "runs"], "SELECT r.run_id, model, split_family, dataset_scope, heldout_target, seed, mean_cosine, mean_risk, mean_confidence, n_cases, anchor_mean, anchor_median, CASE WHEN split_family <> 'random_split' THEN anchor_mean - mean_cosine END AS random_to_stress_drop, CASE WHEN split_family <> 'random_split' THEN CASE WHEN anchor_mean IS NOT NULL THEN mean_cosine / greatest(anchor_mean, 1e-8) END END AS stress_retention FROM runs r JOIN (SELECT run_id, avg(cosine_similarity) AS mean_cosine, avg(risk) AS mean_risk, avg(confidence) AS mean_confidence, count(*) AS n_cases FROM cases GROUP BY run_id) p USING (run_id) LEFT JOIN anchors a ON a.run_id = r.run_id"),
}


def sql(body: str, *needs: str) -> str:
    """``body`` with the views it needs in front, each after those it needs itself."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in CTE[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order)
    body = body.strip()
    if not head:
        return body
    return f"WITH {head}, {body[5:].lstrip()}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"


def sql_dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def sql_cos(a: str, b: str) -> str:
    na, nb = f"sqrt({sql_dot(a, a)})", f"sqrt({sql_dot(b, b)})"
    return f"(CASE WHEN {na} <= 1e-8 AND {nb} <= 1e-8 THEN 1.0 WHEN {na} * {nb} > 1e-8 THEN greatest(-1.0, least(1.0, {sql_dot(a, b)} / ({na} * {nb}))) ELSE 0.0 END)"


def sql_r(x: str, name: str, digits: int = DIGITS) -> str:
    return f"round(({x}) + {NUDGE!r}, {digits}) + 0.0 AS {name}"
