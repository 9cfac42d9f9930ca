"""The keep-or-abstain layer: features known at deployment, targets, classifiers and their scores."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectrail.functions.labels import components
from vectrail.operators import logistic
from vectrail.operators.design import Design, pack
from vectrail.operators.features import ABLATIONS, FeatureSpec, ablate, baseline_specs, feature_audit, feature_spec  # noqa: F401
from vectrail.operators.forest import RandomForestClassifier
from vectrail.operators.relational import global_rank, grouped_quantiles, grouped_rank, grouped_running, log1p_or_zero
from vectrail.session import cut
from vectrail.tables import group_key

COVERAGES = (0.2, 0.4, 0.6, 0.8)
#: The label of the classifiers; columns whose names begin with it are labels too.
TARGET = "target_transportable"

def novelty(label: str, run: str, train_labels: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` with what their labels and label parts have in common with the labels of their run's train part.

    ``train_labels`` is (run, label) distinct.
    """
    parts = F.when(
        (F.size(components(label)) == 0) & (F.col(label) != "") & (F.lower(label) != "control"), F.array(F.col(label))
    ).otherwise(components(label))
    labels = rows.where(F.col(label).isNotNull()).select(run, label).distinct().withColumn("_parts", parts)
    known = train_labels.select(F.col(run).alias("_kr"), F.col(label).alias("_kl"))
    each = labels.select(run, label, F.explode("_parts").alias("_p"))
    hit = each.join(known, (each[run] == known["_kr"]) & (each["_p"] == known["_kl"]), "left_semi").groupBy(run, label).agg(F.count(F.lit(1)).alias("_seen"))
    exact = labels.join(known, (labels[run] == known["_kr"]) & (labels[label] == known["_kl"]), "left_semi").select(run, label, F.lit(1.0).alias("_exact"))
    n, seen = F.size("_parts"), F.coalesce("_seen", F.lit(0))
    features = labels.join(hit, [run, label], "left").join(exact, [run, label], "left").select(
        run, label,
        F.coalesce("_exact", F.lit(0.0)).alias("perturbation_seen_in_train"),
        (F.size(components(label)) > 0).cast("double").alias("is_combination"),
        n.cast("double").alias("component_count"),
        F.coalesce(F.try_divide(seen, n), F.lit(0.0)).alias("component_seen_fraction"),
        (n - seen).cast("double").alias("unseen_component_count"),
    )
    return rows.join(features, [run, label], "left")


def support_features(units: DataFrame, run: str = "split_id") -> DataFrame:
    """Test units with the support their label, reference and dataset have in the run's train part.

    Label support counts non-controls only; reference and dataset support count all train rows.
    """
    train, test = units.where("part = 'train'"), units.where("part = 'test'")
    counted = {
        "perturbation": (train.where("NOT is_control"), "perturbation_label"),
        "reference": (train, "reference_key"),
        "dataset": (train, "dataset_id"),
    }
    out = novelty("perturbation_label", run, train.where("NOT is_control").select(run, "perturbation_label").distinct(), test)
    for name, (rows, key) in counted.items():
        counts = rows.where(F.col(key).isNotNull()).groupBy(run, key).agg(
            F.count("signature_id").cast("double").alias(f"{name}_train_signature_count"),
            F.sum("n_cells").cast("double").alias(f"{name}_train_cell_count"),
        )
        out = out.join(counts, [run, key], "left")
        if name != "perturbation":
            out = out.withColumn(f"{name}_seen_in_train", F.col(f"{name}_train_signature_count").isNotNull().cast("double"))
        for c in (f"{name}_train_signature_count", f"{name}_train_cell_count"):
            out = out.withColumn(c, F.coalesce(c, F.lit(0.0))).withColumn(f"log1p_{c}", log1p_or_zero(c))
    for c in ("batch", "timepoint"):
        seen = train.where(F.col(c).isNotNull()).select(run, c).distinct().withColumn(f"{c}_seen_in_train", F.lit(1.0))
        out = out.join(seen, [run, c], "left").withColumn(f"{c}_seen_in_train", F.coalesce(f"{c}_seen_in_train", F.lit(0.0)))
    return out


def failure_mode(kept: Column, risk: Column, fidelity: Column, threshold: Column) -> Column:
    return (
        F.when(kept, "transportable").when(risk >= 1.0, "severe_failure").when(risk >= 0.75, "high_risk_failure")
        .when(fidelity < threshold, "below_transport_threshold").otherwise("non_transportable")
    )


def targets(df: DataFrame, threshold: str = "transport_threshold") -> DataFrame:
    """Labelled rows with their targets and failure mode."""
    kept = df.where(F.col("transportable").isNotNull())
    return kept.withColumns({
        "target_transportable": F.col("transportable").cast("int"),
        "target_fidelity": F.col("cosine_similarity").cast("double"),
        "target_risk": F.col("risk").cast("double"),
        "failure_mode": failure_mode(F.col("transportable"), F.col("risk"), F.col("cosine_similarity"), F.col(threshold)),
    })


def _anchored(multiplier: float) -> tuple[Column, Column]:
    """The threshold, a multiple of the anchor or of the run's anchor where the record's own is missing, and whether a record reaches it."""
    threshold = F.lit(multiplier) * F.coalesce("anchor_signature_median_cosine", "anchor_signature_median_cosine_run")
    return threshold, F.coalesce(F.col("target_fidelity") >= threshold, F.lit(False))


def relative_threshold(df: DataFrame, multiplier: float) -> DataFrame:
    """Targets against a multiple of the anchor, the run's anchor where the record's own is missing."""
    threshold, kept = _anchored(multiplier)
    risk = 1 - F.col("target_fidelity")
    return df.withColumns({
        "transport_threshold": threshold, "target_transportable": kept.cast("int"), "target_risk": risk,
        "failure_mode": failure_mode(kept, risk, F.col("target_fidelity"), threshold),
    })


def label_columns(df: DataFrame, multipliers: dict[str, float]) -> DataFrame:
    """Adds the label of ``relative_threshold`` at each multiplier under its name."""
    return df.withColumns({c: _anchored(m)[1].cast("int") for c, m in multipliers.items()})


def capped_sample(df: DataFrame, most: int, stratum: str, key: str, seed: int = 7) -> DataFrame:
    """At most ``most`` rows, each stratum in proportion and at least one of each, topped up in hash order."""
    n = df.count()
    if n <= most:
        return df
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    take = F.greatest(F.lit(1), F.least(F.col("_n"), F.bround(F.lit(float(most)) * F.col("_n") / F.lit(float(n))))).cast("long")
    joined = df.join(sizes.withColumn("_take", take).drop("_n"), stratum)
    ranked = grouped_rank(joined, [stratum], [order, F.col(key)], "_rn")
    return ranked.withColumn("_late", (F.col("_rn") > F.col("_take")).cast("int")).orderBy("_late", order, key).limit(most).drop("_rn", "_take", "_late")


def group_parts(df: DataFrame, group: str, key: str, label: str = "target_transportable", share: float = 0.25, seed: int = 7, tries: int = 20) -> DataFrame:
    """Adds ``held``: whole groups for testing, in hash order, from the first of ``tries`` seeds that leaves both classes on both sides.

    Where no seed does, or with fewer than four groups, single rows are held, in hash order within each class.
    """
    return label_parts(df, group, key, [label], share, seed, tries)[0][0]


def label_parts(df: DataFrame, group: str, key: str, labels: list[str], share: float = 0.25, seed: int = 7, tries: int = 20) -> list[tuple[DataFrame, list[str]]]:
    """``group_parts`` of each label; labels for which the same seed is the first share one frame."""
    sizes = cut(df.groupBy(group).agg(*[F.count_if(F.col(y) == v).alias(f"_{v}_{i}") for i, y in enumerate(labels) for v in (0, 1)]))
    n, left, out = sizes.count(), dict(enumerate(labels)), []
    for k in range(tries if n >= 4 else 0):
        if not left:
            break
        order = F.md5(F.concat_ws("|", F.lit(str(seed + k)), F.col(group)))
        ranked = global_rank(sizes, [order, F.col(group)], "_rn").withColumn("held", F.col("_rn") <= math.ceil(n * share))
        sides = ranked.groupBy("held").agg(*[F.sum(f"_{v}_{i}").alias(f"_{v}_{i}") for i in left for v in (0, 1)]).collect()  # two rows
        fit = [i for i in left if len(sides) == 2 and all(r[f"_0_{i}"] and r[f"_1_{i}"] for r in sides)]
        if fit:
            held = ranked.select(group_key(group).alias("_gk"), "held")
            out.append((df.withColumn("_gk", group_key(group)).join(held, "_gk").drop("_gk"), [left.pop(i) for i in fit]))
    for label in left.values():
        order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
        ranked = grouped_rank(df.select(key, label), [label], [order, F.col(key)], "_rn")
        total = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
        held = ranked.join(total, ranked[label].eqNullSafe(total[label])).select(key, (F.col("_rn") <= F.ceil(F.col("_n") * share)).alias("held"))
        out.append((df.join(held, key), [label]))
    return out


def packed_once(df: DataFrame) -> DataFrame:
    """``df``, stored, whose fits share one packing of all its features and labels."""
    df = cut(df)
    df._vectrail_design = None
    return df


def _designed(df: DataFrame, spec: FeatureSpec, label: str) -> Design:
    if not hasattr(df, "_vectrail_design"):
        return pack(df, spec.numeric, spec.categorical, [label])
    if df._vectrail_design is None or not df._vectrail_design.covers(spec.numeric, spec.categorical, label):
        whole = feature_spec(df)
        numeric, categorical = (list(dict.fromkeys(a + b)) for a, b in ((whole.numeric, spec.numeric), (whole.categorical, spec.categorical)))
        df._vectrail_design = pack(df, numeric, categorical, list(dict.fromkeys([*[c for c in df.columns if c.startswith(TARGET)], label])))
    return df._vectrail_design


def fit_scores(df: DataFrame, spec: FeatureSpec, estimator: str, label: str = "target_transportable", trees: int = 200) -> DataFrame:
    """``df``'s held rows with a ``score``: a balanced logistic regression or random forest on the other rows."""
    if estimator not in ("logistic_regression", "random_forest"):
        raise ValueError(f"unknown estimator {estimator}")
    design = _designed(df, spec, label)
    if design.ones[label] in (0, design.n):
        raise ValueError("both classes are needed")
    if estimator == "logistic_regression":
        score = logistic.scores(design, label, spec.numeric, spec.categorical)
    else:
        score = RandomForestClassifier(labelCol=label, numTrees=trees, minInstancesPerNode=5, maxDepth=30, seed=7).scores(design, spec.numeric, spec.categorical)
    return design.rows.where("held").join(score, "_id").drop("_id")


def selective_profile(df: DataFrame, label: str, risk: str, score: str, key: str, coverages: tuple[float, ...] = COVERAGES, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, coverage, kept, observed, selective_risk, false_rate, gain): the best-scored fractions, ranked without one big sort."""
    ranked = grouped_rank(df.select(*by, label, risk, score, key), [*by], [F.col(score).desc(), F.col(key)], "_rn")
    base = F.broadcast(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg(risk).alias("_base")))  # one row a group of ``by``
    kept = lambda c, n: F.greatest(F.lit(1), F.ceil(F.lit(c) * n)).cast("long")
    aggs = [F.coalesce(F.max("_n"), F.lit(0)).alias("_n"), F.max("_base").alias("_base")]
    for i, c in enumerate(coverages):
        here = F.col("_rn") <= kept(c, F.col("_n"))
        aggs += [F.avg(F.when(here, F.col(risk))).alias(f"r{i}"), F.avg(F.when(here, 1.0 - F.col(label))).alias(f"f{i}")]
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("coverage"), kept(c, F.col("_n")).alias("kept"), F.try_divide(kept(c, F.col("_n")), F.col("_n")).alias("observed"), F.col(f"r{i}").alias("selective_risk"), F.col(f"f{i}").alias("false_transportability_rate")) for i, c in enumerate(coverages)]))
    each = (ranked.join(base, [*by]) if by else ranked.join(base)).groupBy(*by).agg(*aggs)
    return each.select(*by, "_base", rows.alias("e")).select(*by, "_base", "e.*").withColumn("abstention_gain", F.col("_base") - F.col("selective_risk")).drop("_base")


def classifier_scores(df: DataFrame, label: str, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group of ``by``: accuracy, precision, recall, f1, brier, roc_auc and average_precision.

    AUC and average precision come from counts per distinct score, summed along the scores in ranges.
    """
    y, s = F.col(label).cast("int"), F.col(score)
    guess = (s >= 0.5).cast("int")
    flat = df.groupBy(*by).agg(
        F.avg((guess == y).cast("int")).alias("accuracy"),
        F.coalesce(F.try_divide(F.sum(guess * y), F.sum(guess)), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.sum(guess * y), F.sum(y)), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(2 * F.sum(guess * y), F.sum(guess) + F.sum(y)), F.lit(0.0)).alias("f1"),
        F.avg(F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)) - y, 2)).alias("brier"),
        F.sum(y).alias("_p"), F.sum(1 - y).alias("_n"),
    )
    per = df.groupBy(*by, s.alias("s")).agg(F.sum(y).alias("p"), F.sum(1 - y).alias("n"))
    sums = {"cp": F.col("p"), "cn": F.col("n"), "ca": F.col("p") + F.col("n")}
    run = grouped_running(per, [*by], [F.col("s").desc()], sums)
    areas = run.groupBy(*by).agg(
        F.sum(F.col("n") * (F.col("cp") - F.col("p") / 2)).alias("_auc"), F.sum(F.col("p") * F.col("cp") / F.col("ca")).alias("_ap")
    )
    both = (F.col("_p") > 0) & (F.col("_n") > 0)
    areas = F.broadcast(areas)  # one row a group of ``by``
    return (flat.join(areas, [*by]) if by else flat.join(areas)).select(
        *by, "accuracy", "precision", "recall", "f1", "brier",
        F.when(both, F.col("_auc") / (F.col("_p") * F.col("_n"))).alias("roc_auc"),
        F.when(both, F.col("_ap") / F.col("_p")).alias("average_precision"),
    )


def _scored(df: DataFrame, label: str, risk: str, score: str, key: str, at: float | None, by: tuple[str, ...] = ()) -> DataFrame:
    """The classifier scores and the means of the selective profile, and the profile at the coverage ``at``."""
    here = [F.max(F.when(F.col("coverage") == at, F.col(c))).alias(f"{n}_at_{at}".replace(".", "p")) for c, n in (("observed", "coverage"), ("false_transportability_rate", "false_transportability_rate"))] if at is not None else []
    profile = F.broadcast(selective_profile(df, label, risk, score, key, by=by).groupBy(*by).agg(
        F.avg("selective_risk").alias("mean_selective_risk"), F.avg("false_transportability_rate").alias("mean_false_transportability_rate"),
        F.avg("abstention_gain").alias("mean_abstention_gain"), *here,
    ))
    flat = classifier_scores(df, label, score, by)
    return flat.join(profile, [*by]) if by else flat.join(profile)  # one row each


def score_row(df: DataFrame, name: str, estimator: str, n_features: int, label: str = "target_transportable", risk: str = "target_risk", score: str = "score", key: str = "example_id", at: float | None = None) -> DataFrame:
    """One row with a method's classifier scores and the means of its selective profile, and its profile at the coverage ``at``."""
    head = [F.lit(name).alias("ablation"), F.lit(estimator).alias("estimator"), F.lit(n_features).alias("n_features")]
    return _scored(df, label, risk, score, key, at).select(*head, "*")


def score_rows(frames: list[tuple[DataFrame, str]], risk: str = "target_risk", score: str = "score", key: str = "example_id", at: float | None = None) -> list[dict[str, float]]:
    """What ``score_row`` gives for each scored frame and its label, in one go; a frame that comes twice with its label is scored once."""
    nth = {(id(df), y): i for i, (df, y) in reversed([*enumerate(frames)])}
    each = [frames[i][0].select(F.lit(i).alias("_f"), F.col(frames[i][1]).cast("int").alias("_y"), risk, score, key) for i in sorted(nth.values())]
    rows = _scored(cut(reduce(DataFrame.unionByName, each)), "_y", risk, score, key, at, ("_f",)).collect()  # one row a frame
    got = {r["_f"]: {k: v for k, v in r.asDict().items() if k != "_f"} for r in rows}
    return [got[nth[id(df), y]] for df, y in frames]


def skipped(spec: FeatureSpec, ablation: str) -> bool:
    """Whether an ablation has nothing to leave out: the one of pathway features, where there are none."""
    return ablation == "no_pathway_features" and ablate(spec, ablation).columns == spec.columns


def suite_scores(parts: DataFrame, ablations: list[str], estimators: tuple[str, ...] = ("logistic_regression", "random_forest"), trees: int = 200, label: str = TARGET) -> list[tuple[str, str, int, DataFrame]]:
    """(ablation, estimator, number of features, held rows with ``score``): the naive confidence, then each that isn't skipped.

    Ablations that leave the same features share one fit, which would come out the same.
    """
    spec = feature_spec(parts)
    naive = parts.where("held").withColumn("score", F.coalesce("confidence", F.lit(0.0)))
    out, fitted = [("naive_confidence", "naive_confidence", 1, naive)], {}
    for a in ablations:
        if skipped(spec, a):
            continue
        mine = ablate(spec, a)
        for e in estimators:
            key = (e, *mine.columns)
            if key not in fitted:
                fitted[key] = cut(fit_scores(parts, mine, e, label=label, trees=trees))
            out.append((a, e, len(mine.columns), fitted[key]))
    return out


def ablation_suite(df: DataFrame, ablations: list[str], estimators: tuple[str, ...] = ("logistic_regression", "random_forest"), trees: int = 200, at: float | None = None) -> DataFrame:
    """The naive confidence and every ablation with every estimator, one row each; one row without scores for a skipped ablation."""
    return label_suites(df, [TARGET], ablations, estimators, trees, at).drop("label")


def label_suites(df: DataFrame, labels: list[str], ablations: list[str], estimators: tuple[str, ...] = ("logistic_regression", "random_forest"), trees: int = 200, at: float | None = None) -> DataFrame:
    """``ablation_suite`` of every label, which is named in ``label``. Rows are packed once for all labels with the same parts, and scored together."""
    spec, each = feature_spec(df), []
    for parts, mine in label_parts(df, "run_id", "example_id", labels):
        parts = packed_once(parts)
        each += [(y, *fitted) for y in mine for fitted in suite_scores(parts, ablations, estimators, trees, y)]
    scores = score_rows([(held, y) for y, *_, held in each], at=at)
    kinds = {**{c: "double" for c in scores[0]}, "status": "string", "reason": "string"}
    rows = [(y, a, e, n, *s.values(), "completed", "") for (y, a, e, n, _), s in zip(each, scores)]
    none = (None,) * len(scores[0])
    rows += [(y, a, "", 0, *none, "skipped", "optional biological support features were unavailable") for y in labels for a in ablations if skipped(spec, a)]
    return df.sparkSession.createDataFrame(rows, "label string, ablation string, estimator string, n_features int, " + ", ".join(f"{c} {k}" for c, k in kinds.items()))


def prediction_rows(parts: DataFrame, ablations: list[str], estimators: tuple[str, ...] = ("logistic_regression", "random_forest"), trees: int = 200) -> DataFrame:
    """Every held row with its score, once for the naive confidence and for every ablation with every estimator."""
    keep = ["split_family", "model", "signature_id", "run_id", "target_risk", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "failure_mode"]
    rows = [
        held.select("example_id", F.lit(a).alias("ablation"), F.lit(e).alias("estimator"), F.col("target_transportable").cast("int").alias("y_true"), "score", *keep)
        for a, e, _, held in suite_scores(parts, ablations, estimators, trees)
    ]
    return reduce(DataFrame.unionByName, rows)


def conformal_scores(df: DataFrame, score: str = "confidence", quantile: float = 0.2) -> DataFrame:
    """Held rows scored by how far they exceed the train rows' nonconformity quantile."""
    off = 1 - F.coalesce(score, F.lit(0.0))
    row = grouped_quantiles(df.where("NOT held").select(off.alias("off")), [], "off", [quantile]).first()
    cutoff = row["quantile"] if row else 0.0
    return df.where("held").withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(F.lit(0.0), off - F.lit(cutoff)))))


def reliability_baselines(df: DataFrame, trees: int = 200) -> DataFrame:
    """The naive confidence, the conformal proxy and every feature subset, one row each, with the gain over the naive one."""
    parts = packed_once(group_parts(df, "run_id", "example_id"))
    naive = parts.where("held").withColumn("score", F.coalesce("confidence", F.lit(0.0)))
    each = [("naive_confidence", "confidence", 1, naive), ("conformal_confidence_proxy", "confidence_quantile", 1, conformal_scores(parts))]
    each += [(name, e, len(spec.columns), cut(fit_scores(parts, spec, e, trees=trees))) for name, (spec, e) in baseline_specs(parts).items()]
    scores = score_rows([(held, TARGET) for *_, held in each])
    rows = [(name, e, n, *s.values()) for (name, e, n, _), s in zip(each, scores)]
    out = df.sparkSession.createDataFrame(rows, "baseline string, estimator string, n_features int, " + ", ".join(f"{c} double" for c in scores[0]))
    return out.withColumn("false_transportability_gain_vs_naive", F.lit(scores[0]["mean_false_transportability_rate"]) - F.col("mean_false_transportability_rate"))


def failure_summary(df: DataFrame, means: list[str]) -> DataFrame:
    return df.groupBy("model", "split_family", "failure_mode").agg(
        F.count("signature_id").alias("n_signatures"), F.avg("target_transportable").alias("transportable_rate"), *[F.avg(c).alias(f"mean_{c}") for c in means]
    )
