"""Report tables: decay under transfer, selective gains, failures, difficulty, findings, cases, audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectrail.operators.evaluate import family_summary
from vectrail.operators.relational import clip, first_per, mean_of, min_max_scale, min_rank, safe_ratio, with_group_max, with_share

ANCHOR = "random_split"
CONTROL_MODEL = "control_mean_baseline"
# How grave each failure mode is (any other counts as 1); so are the words for shifts, flags,
# context signals and readings of difficulty below, with their thresholds.
SEVERITY = {"transportable": 0, "below_transport_threshold": 1, "non_transportable": 1, "high_risk_failure": 2, "severe_failure": 3}


def transfer_decay(metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Family summary with ranks, and what changed against the model's random-split row."""
    first = f"mean_{columns[0]}"
    s = family_summary(metrics, columns).withColumn("family_rank", min_rank(["split_family"], first))
    base = s.where(F.col("split_family") == ANCHOR).select("model", F.col("family_rank").alias("random_split_rank"), F.col(first).alias("random_split_mean"))
    s = s.join(F.broadcast(base), "model", "left")  # one row a model
    change = F.col("family_rank") - F.col("random_split_rank")
    anchor = F.col("split_family") == ANCHOR
    direction = F.when(anchor, "anchor").when(change > 0, "worse_rank").when(change < 0, "better_rank").otherwise("same_rank")
    kept = F.col("mean_stress_retention")
    return s.withColumns({
        "family_winner": F.coalesce(F.col("family_rank") == 1, F.lit(False)),
        "rank_change_vs_random": change, "cosine_change_vs_random": F.col(first) - F.col("random_split_mean"),
        "rank_shift_direction": direction,
        "stress_retention_flag": F.when(anchor, "anchor").when(kept.isNull(), "not_applicable").when(F.abs(kept) > 10, "unstable_small_anchor_ratio").otherwise("interpretable_ratio"),
    }).withColumn("ranking_reversal_flag", F.col("rank_shift_direction").isin("worse_rank", "better_rank"))


def selective_summary(scores: DataFrame, status: DataFrame) -> DataFrame:
    """Method scores against the naive row, with each ablation's status."""
    naive = scores.where("estimator = 'naive_confidence'").limit(1).select(
        F.col("mean_false_transportability_rate").alias("naive_false_rate"), F.col("mean_selective_risk").alias("naive_risk")
    )
    known = status.select("ablation", "status", "reason").dropDuplicates(["ablation"])
    out = scores.join(F.broadcast(naive)).join(F.broadcast(known), "ablation", "left")  # one row; one row an ablation
    less = F.col("mean_false_transportability_rate") - F.col("naive_false_rate")
    return out.withColumns({
        "false_rate_delta_vs_naive": less, "selective_risk_delta_vs_naive": F.col("mean_selective_risk") - F.col("naive_risk"),
        "improves_filtering": F.coalesce(less < 0, F.lit(False)),
        "status": F.when(F.col("ablation") == "naive_confidence", "baseline").otherwise(F.col("status")), "reason": F.coalesce("reason", F.lit("")),
    })


def severity(mode: str) -> Column:
    out = F.lit(1)
    for m, v in SEVERITY.items():
        out = F.when(F.col(mode) == m, F.lit(v)).otherwise(out)
    return out


def failure_atlas(summary: DataFrame, extras: DataFrame | None = None) -> DataFrame:
    """Failure summary with shares, severity, dominance and the context that goes with each failure."""
    keys = ["model", "split_family"]
    a = with_share(summary, keys, "n_signatures", "failure_mode_share").withColumn("failure_severity", severity("failure_mode"))
    a = with_group_max(a, keys, "n_signatures", "dominant_failure")
    a = with_group_max(a, keys, "n_signatures", "dominant_nontransportable_failure", F.col("failure_severity") > 0)
    signal = (
        F.when(F.coalesce("mean_perturbation_seen", F.lit(1.0)) < 0.25, "perturbation_novelty")
        .when(F.coalesce("mean_component_seen_fraction", F.lit(1.0)) < 0.25, "component_novelty")
        .when(F.coalesce("mean_reference_seen", F.lit(1.0)) < 0.5, "reference_context_novelty")
        .when(F.coalesce("mean_n_cells", F.lit(100.0)) < 20, "low_signature_support")
        .otherwise("mixed_or_supported_context")
    )
    a = a.withColumn("context_signal", signal)
    if extras is not None:
        e = extras.withColumnsRenamed({k: f"_{k}" for k in [*keys, "failure_mode"]})
        on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "failure_mode"]]
        a = a.join(e, on, "left").drop(*[f"_{k}" for k in [*keys, "failure_mode"]])
    return a


def split_difficulty(metrics: DataFrame, value: str, examples: DataFrame) -> DataFrame:
    """Transfer score against the random anchor, and a difficulty index of support, novelty and distance."""
    keys = ["model", "split_family"]
    m = metrics.groupBy(*keys).agg(F.count("run_id").alias("n_runs"), F.avg(value).alias("mean_value"))
    base = m.where(F.col("split_family") == ANCHOR).select("model", F.col("mean_value").alias("random_anchor"))
    m = m.join(F.broadcast(base), "model", "left").withColumn("normalized_transfer_score", safe_ratio("mean_value", "random_anchor"))
    context = examples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_signatures"), F.avg("perturbation_train_signature_count").alias("mean_signature_support"),
        F.avg("perturbation_seen_in_train").alias("mean_perturbation_seen"), F.avg("component_seen_fraction").alias("mean_component_seen_fraction"),
        F.avg("train_test_centroid_l2").alias("mean_centroid_l2"),
    )
    m = m.join(context, keys, "left").withColumn("_s", F.log1p(F.coalesce("mean_signature_support", F.lit(0.0))))
    m = min_max_scale(m, "_s", "_scaled")
    flat = m.agg((F.max("_s") > F.min("_s")).alias("_spread"), F.max(F.coalesce("mean_centroid_l2", F.lit(0.0))).alias("_far"))
    m = m.join(F.broadcast(flat))  # one row
    support = F.when(F.col("_spread"), 1 - F.col("_scaled")).otherwise(F.lit(0.0))
    novel = 1 - F.coalesce("mean_component_seen_fraction", "mean_perturbation_seen", F.lit(1.0))
    far = F.when(F.col("_far") > 0, F.coalesce("mean_centroid_l2", F.lit(0.0)) / F.col("_far")).otherwise(F.lit(0.0))
    m = m.withColumn("difficulty_index", mean_of([clip(x, 0.0, 1.0) for x in (support, novel, far)]))
    read = (
        F.when(F.col("split_family") == ANCHOR, "low_stress_anchor").when(F.col("normalized_transfer_score") > 1, "above_anchor_after_normalization")
        .when(F.col("difficulty_index") >= 0.66, "high_difficulty_context").otherwise("moderate_or_mixed_difficulty")
    )
    return m.withColumn("difficulty_interpretation", read).drop("_s", "_scaled", "_spread", "_far")


# The regimes in which the ridge model's rank is looked at, and the terms no narrative may hold.
TRANSFER = ["dataset_heldout_split", "external_holdout"]
RIDGE = "ridge_regression_baseline"
FORBIDDEN_TERMS = ["clinical", "wet-lab", "universal-best-model", "drug discovery", "final truth"]


def main_findings(
    decay: DataFrame, value: str, atlas: DataFrame, scores: DataFrame | None = None, pairwise: DataFrame | None = None, difficulty: DataFrame | None = None,
    pathway: DataFrame | None = None, retrieval: DataFrame | None = None, audit: DataFrame | None = None,
) -> DataFrame:
    """(finding, metric, subject, value): up to ten findings, each a one-row pick or count; those whose table is missing are left out.

    F1 hardest stress family, F2 models that win a family, F3 the ridge model's rank shift in transfer, F4 best gain over
    the naive scores, F5 gravest failure, F6 comparisons that hold after correction, F7 highest difficulty,
    F8 mean pathway cosine, F9 mean top-1 retrieval, F10 outcome columns kept from the classifier.
    """
    real = decay.where(F.col("model") != CONTROL_MODEL)
    stress = real.where(F.col("split_family") != ANCHOR)
    found = []

    def add(finding: str, metric: str, rows: DataFrame, subject: Column, x: Column) -> None:
        found.append(rows.select(F.lit(finding).alias("finding"), F.lit(metric).alias("metric"), subject.cast("string").alias("subject"), x.cast("double").alias("value")))

    hardest = stress.groupBy("split_family").agg(F.avg(value).alias("v")).orderBy(F.col("v").asc_nulls_last(), "split_family").limit(1)
    add("F1", value, hardest, F.col("split_family"), F.col("v"))
    named = F.when(F.col("split_family") != ANCHOR, F.concat_ws(": ", "split_family", "model"))
    winners = real.where("family_winner").agg(F.countDistinct("model").alias("v"), F.concat_ws("; ", F.array_sort(F.collect_set(named))).alias("s"))  # one row a family
    add("F2", "family_rank", winners, F.col("s"), F.col("v"))
    ridge = real.where((F.col("model") == RIDGE) & F.col("split_family").isin(TRANSFER)).agg(F.count(F.lit(1)).alias("n"), F.avg("rank_change_vs_random").alias("v")).where("n > 0")
    add("F3", "rank_change_vs_random", ridge, F.lit(RIDGE), F.col("v"))
    if scores is not None:
        gain = -F.col("false_rate_delta_vs_naive")
        best = scores.where((F.col("estimator") != "naive_confidence") & gain.isNotNull()).orderBy(gain.desc(), "ablation", "estimator").limit(1)
        add("F4", "false_rate_gain_vs_naive", best, F.concat_ws(" / ", "ablation", "estimator"), gain)
    worst = atlas.where("failure_severity > 0").orderBy(F.col("failure_severity").desc(), F.col("failure_mode_share").desc(), "model", "split_family", "failure_mode").limit(1)
    add("F5", "failure_mode_share", worst, F.concat_ws(" / ", "failure_mode", "model", "split_family"), F.col("failure_mode_share"))
    if pairwise is not None:
        add("F6", "n_fdr_significant", pairwise.agg(F.count_if("reject_fdr_0_05").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 0"), F.lit("pairwise tests"), F.col("v"))
    if difficulty is not None:
        top = difficulty.where(F.col("split_family") != ANCHOR).orderBy(F.col("difficulty_index").desc_nulls_last(), "split_family", "model").limit(1)
        add("F7", "difficulty_index", top, F.col("split_family"), F.col("difficulty_index"))
    if pathway is not None:
        add("F8", "mean_pathway_cosine", pathway.agg(F.avg("pathway_cosine").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 0"), F.lit("pathway profiles"), F.col("v"))
    if retrieval is not None:
        add("F9", "retrieval_top1", retrieval.agg(F.avg("top1").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 0"), F.lit("retrieval"), F.col("v"))
    if audit is not None:
        add("F10", "n_outcome_columns", audit.agg(F.count_if("target_or_label").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 0"), F.lit("feature audit"), F.col("v"))
    return reduce(DataFrame.unionByName, found)


def bounded(text: str) -> str:
    """``text`` if it holds none of the terms no narrative may hold; raises otherwise."""
    held = [t for t in FORBIDDEN_TERMS if t in text.lower()]
    if held:
        raise ValueError("the narrative claims too much: " + ", ".join(held))
    return text


_SENTENCES = {
    "F1": "The hardest stress family is `{s}`, with a mean of {v:.4f} over the models that predict an effect.",
    "F2": "{v:.0f} models win at least one family ({s}).",
    "F3": "In transfer to other datasets the rank of `{s}` changes by {v:.2f} on average.",
    "F4": "Of the fitted scores, {s} lowers the rate of false acceptance most, by {v:.4f} against the plain confidence.",
    "F5": "The gravest recurring failure is {s}, a share of {v:.4f} of its model's signatures there.",
    "F6": "{v:.0f} comparisons of models hold after correction for their number.",
    "F7": "By support, novelty and distance together, `{s}` is the most difficult family (index {v:.4f}).",
    "F8": "The mean cosine of pathway profiles is {v:.4f}.",
    "F9": "The right label comes first in retrieval for a share of {v:.4f} of predictions.",
    "F10": "{v:.0f} outcome columns are kept from the classifier.",
}


def narrative(findings: DataFrame, decay: DataFrame, value: str) -> str:
    """The findings as a short Markdown text with the winners of each family, kept to what the tables show."""
    rows = {r.finding: r for r in findings.collect()}  # ten rows
    lines = ["# Findings", ""]
    lines += [f"- {_SENTENCES[k].format(s=rows[k].subject, v=float('nan') if rows[k].value is None else rows[k].value)}" for k in _SENTENCES if k in rows]
    won = decay.where(F.col("family_winner") & (F.col("model") != CONTROL_MODEL)).orderBy("split_family", "model").collect()  # one row a family
    lines += ["", "## Winners", ""] + [f"- `{r.split_family}`: `{r.model}` ({'NA' if r[value] is None else format(r[value], '.4f')})" for r in won]
    lines += ["", "All of this describes the datasets and models that were run, and no others."]
    return bounded("\n".join(lines) + "\n")


def supported_splits(records: DataFrame) -> DataFrame:
    """(split_family, scope, n_ready, n_unsupported) of the splits that were asked for."""
    return records.groupBy("split_family", "scope").agg(
        F.count_if(F.col("status") == "ready").alias("n_ready"), F.count_if(F.col("status") == "unsupported").alias("n_unsupported")
    )


def benchmark_document(records: DataFrame, title: str = "Benchmark") -> str:
    """The benchmark's definition as Markdown: what is held out in each family, and where it could be."""
    held = {
        "random_split": "rows at random", "unseen_perturbation_split": "perturbation labels", "unseen_combination_split": "combinations of perturbations",
        "low_support_split": "rows of little support", "unseen_cell_state_split": "cell states", "unseen_cell_type_or_lineage_split": "cell types or lineages",
        "dataset_heldout_split": "whole datasets, each in turn", "external_holdout": "the external dataset",
    }
    rows = supported_splits(records).orderBy("split_family", "scope").collect()  # one row a family and scope
    lines = [f"# {title}", "", "| Family | Held out | Scope | Ready | Unsupported |", "|---|---|---|---|---|"]
    lines += [f"| {r.split_family} | {held.get(r.split_family, '')} | {r.scope} | {r.n_ready} | {r.n_unsupported} |" for r in rows]
    return "\n".join(lines) + "\n"


def method_comparison(spark: SparkSession) -> DataFrame:
    """(model, learns_from, uses_label, uses_context, tuned_on_validation, confidence_from) of the models here."""
    rows = [
        ("control_mean_baseline", "nothing", False, False, False, "none"),
        ("global_delta_baseline", "train mean", False, False, False, "reference similarity and support"),
        ("perturbation_mean_delta_baseline", "means of labels and their components", True, False, False, "reference similarity and label support"),
        ("cell_context_knn_delta_baseline", "nearest contexts of the label", True, True, True, "similarity of the neighbours"),
        ("ridge_regression_baseline", "profile and categories", True, True, True, "nearest train row and penalty"),
    ]
    return spark.createDataFrame(rows, "model string, learns_from string, uses_label boolean, uses_context boolean, tuned_on_validation boolean, confidence_from string")


def screen_validation(metrics: DataFrame, datasets: DataFrame, value: str) -> DataFrame:
    """Per held-out dataset: completed runs, models, seeds, mean, and the best model; datasets without runs are listed."""
    held = metrics.where("split_family = 'dataset_heldout_split'")
    per_model = held.groupBy("heldout_target", "model").agg(F.avg(value).alias("m"))
    best = first_per(per_model, ["heldout_target"], [F.col("m").desc_nulls_last(), F.col("model")]).select("heldout_target", F.col("model").alias("best_model"), F.col("m").alias("best_mean"))
    stats = held.groupBy("heldout_target").agg(
        F.countDistinct("run_id").alias("n_runs"), F.countDistinct("model").alias("n_models"), F.countDistinct("seed").alias("n_seeds"), F.avg(value).alias("mean_value")
    )
    got = stats.join(best, "heldout_target").withColumnRenamed("heldout_target", "dataset_id")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return datasets.select("dataset_id", "n_cells_kept").join(got, "dataset_id", "left").select(
        "dataset_id", "n_cells_kept", zero("n_runs"), zero("n_models"), zero("n_seeds"), "mean_value", F.coalesce("best_model", F.lit("")).alias("best_model"), "best_mean",
        F.when(F.col("n_runs") > 0, "completed").otherwise("no_completed_runs").alias("status"),
    )


def case_examples(cases: DataFrame, per_kind: int = 200) -> DataFrame:
    """One retained, one rejected and one boundary-failure case, by ranked filters; no signature twice."""
    ranked = {
        "retained_success": (F.col("transportable") & (F.col("confidence") >= 0.5), [F.col("confidence").desc(), F.col("cosine_similarity").desc()]),
        "rejected_failure": (~F.col("transportable") & F.col("failure_mode").isin("severe_failure", "high_risk_failure"), [F.col("risk").desc(), F.col("confidence").asc()]),
        "boundary_failure": (F.col("split_family").isin("dataset_heldout_split", "external_holdout") & ~F.col("transportable"), [F.col("cosine_similarity").asc()]),
    }
    out = used = None
    for kind, (keep, order) in ranked.items():
        rows = cases.where(keep & F.col("cosine_similarity").isNotNull() & F.col("signature_id").isNotNull())
        if used is not None:
            rows = rows.join(F.broadcast(used), "signature_id", "left_anti")  # a row or two
        pick = rows.orderBy(*[o.asc_nulls_last() if False else o for o in order], "case_id").limit(1).withColumn("kind", F.lit(kind))
        out = pick if out is None else out.unionByName(pick)
        used = out.select("signature_id")
    return out


def contract_profile(candidates: DataFrame, groups: list[str]) -> DataFrame:
    """What candidate tables bring along: counts, sizes, and how many have what the contract asks for."""
    return candidates.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_candidates"), F.countDistinct("dataset_label").alias("n_datasets"), F.sum("n_cells").alias("n_cells"),
        F.count_if(F.col("has_perturbation_field")).alias("n_with_perturbation"), F.count_if(F.col("n_control_cells") > 0).alias("n_with_controls"),
    )


def status_counts(registry: DataFrame, status: str) -> DataFrame:
    """One row: runs by outcome, words matched in any case."""
    s = F.lower(F.trim(status))
    bad = F.coalesce(s.rlike("failed|blocked|error"), F.lit(False))
    return registry.agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(s.isin("success", "cached")).alias("n_done"), F.count_if(bad).alias("n_failed"),
        F.count_if(s.isNull()).alias("n_unknown"),
    )
