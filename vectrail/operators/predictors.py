"""Reference predictors of effect vectors and their confidence.

Input is a long table of units with their part: (run, part, signature_id, dataset_id,
reference_key, perturbation_label, is_control, n_cells, batch, timepoint, delta, profile),
``profile`` being the matched control profile.  Each predictor gives the test rows a
``guess``; control rows are always guessed as no effect.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectrail.functions.labels import components
from vectrail.operators.kernels import ALPHAS, EPS, one_hot, ridge_dual, safe_cosine
from vectrail.operators.relational import clip
from vectrail.operators.vectors import cosine, mean_vectors, unit, zeros_like
from vectrail.session import cut

KS = (3, 5, 10, 20)
CATEGORIES = ["dataset_id", "batch", "timepoint", "perturbation_label"]


def control_profiles(signatures: DataFrame) -> DataFrame:
    """(dataset_id, reference_key, profile): mean control vector of each reference."""
    return mean_vectors(signatures.where("is_control"), ["dataset_id", "reference_key"], "delta", None, "profile")


def with_profiles(signatures: DataFrame, profiles: DataFrame) -> DataFrame:
    """Every signature with its matched control profile; raises where one has none."""
    missed = signatures.join(profiles, ["dataset_id", "reference_key"], "left_anti")
    if missed.limit(1).count():
        raise KeyError("a signature has no matched control profile")
    return signatures.join(profiles, ["dataset_id", "reference_key"])


def _train(units: DataFrame) -> DataFrame:
    return units.where("part = 'train' AND NOT is_control")


def _test(units: DataFrame) -> DataFrame:
    return units.where("part = 'test'")


def _settle(rows: DataFrame, guess: Column) -> DataFrame:
    return rows.withColumn("guess", F.when(F.col("is_control"), zeros_like("delta")).otherwise(guess))


def global_mean(units: DataFrame) -> DataFrame:
    """(run, g): the run's train mean, weighted by cells."""
    return mean_vectors(_train(units), ["run"], "delta", "n_cells", "g")


def control_mean(units: DataFrame) -> DataFrame:
    return _test(units).withColumn("guess", zeros_like("delta"))


def global_delta(units: DataFrame) -> DataFrame:
    """Each run's weighted mean effect; the means are one row a run."""
    return _settle(_test(units).join(F.broadcast(global_mean(units)), "run", "left"), F.col("g")).drop("g")


def label_means(units: DataFrame) -> DataFrame:
    return mean_vectors(_train(units), ["run", "perturbation_label"], "delta", "n_cells", "m")


def perturbation_mean(units: DataFrame) -> DataFrame:
    """The label's own mean; else the mean of its components' means if all are known; else the global mean."""
    means = label_means(units)
    single = means.where(F.size(components("perturbation_label")) == 0).select("run", F.col("perturbation_label").alias("c"), F.col("m").alias("cm"))
    test = _test(units)
    wanted = test.where("NOT is_control").select("run", "perturbation_label").distinct()
    parts = wanted.select("run", "perturbation_label", F.size(components("perturbation_label")).alias("k"), F.explode(components("perturbation_label")).alias("c"))
    known = parts.join(single, ["run", "c"])
    enough = known.groupBy("run", "perturbation_label").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k")).where("n = k").select("run", "perturbation_label")
    mixed = mean_vectors(known.join(enough, ["run", "perturbation_label"]), ["run", "perturbation_label"], "cm", None, "x")
    joined = (
        test.join(means, ["run", "perturbation_label"], "left")
        .join(mixed, ["run", "perturbation_label"], "left")
        .join(F.broadcast(global_mean(units)), "run", "left")
    )
    return _settle(joined, F.coalesce("m", "x", "g")).drop("m", "x", "g")


def _near_ids(train: DataFrame, queries: DataFrame, most: int, vector: str, distance) -> DataFrame:
    """(run, perturbation_label, qc, nid, dist, rn): the ``most`` nearest train rows of a label for each profile that asks.

    Rows of one context share a profile, so profiles are compared, each distinct pair once, and each passes on its
    first few rows only; how many rows ask, or share a profile, doesn't matter.  ``qc`` is the asking profile's hash.
    """
    key = ["run", "perturbation_label"]
    first = F.row_number().over(Window.partitionBy(*key, "tc").orderBy("signature_id"))
    own = train.withColumn("tc", F.xxhash64(vector))
    rows = own.select(*key, "tc", "signature_id").withColumn("_rn", first).where(F.col("_rn") <= most)
    seen = own.groupBy(*key, "tc").agg(F.first(vector).alias("_t"))
    asked = queries.groupBy(*key, F.xxhash64(vector).alias("qc")).agg(F.first(vector).alias("_q"))
    apart = asked.join(seen, key).select(*key, "qc", "tc", distance("_q", "_t").alias("dist"))
    near = apart.join(rows, [*key, "tc"]).select(*key, "qc", F.col("signature_id").alias("nid"), "dist")
    rn = F.row_number().over(Window.partitionBy(*key, "qc").orderBy("dist", "nid"))
    return near.withColumn("rn", rn).where(F.col("rn") <= most)


def nearest_contexts(units: DataFrame, queries: DataFrame, most: int) -> DataFrame:
    """(run, signature_id, rn, w, nd): up to ``most`` train rows of the same label, nearest by control profile first.

    A neighbour weighs its cells over its distance; where some neighbour has none, only such count, by their cells.
    """
    train = _train(units)
    q = queries.where("NOT is_control").select("run", "signature_id", "perturbation_label", F.xxhash64("profile").alias("qc"))

    def distance(a: str, b: str) -> Column:
        d = 1 - cosine(a, b)
        return F.when(d <= EPS, F.lit(0.0)).otherwise(d)

    near = _near_ids(train, queries.where("NOT is_control"), most, "profile", distance)
    there = near.join(train.select("run", F.col("signature_id").alias("nid"), F.col("n_cells").cast("double").alias("cells"), F.col("delta").alias("nd")), ["run", "nid"])
    asks = ["run", "perturbation_label", "qc"]
    least = F.min("dist").over(Window.partitionBy(*asks))  # ``most`` rows at most
    w = F.when(least == 0, F.when(F.col("dist") == 0, F.col("cells")).otherwise(F.lit(0.0))).otherwise(F.col("cells") / F.col("dist"))
    return q.join(there.select(*asks, "rn", w.alias("w"), "nd"), asks).select("run", "signature_id", "rn", "w", "nd")


def cell_context_knn(units: DataFrame, k: int | None = None) -> DataFrame:
    """Mean over the k nearest train contexts of the same label, else the global mean.

    Without ``k``, each run takes the k with the best mean validation cosine, ties to the smaller.
    """
    if k is not None:
        return _fill(units, _test(units), mean_vectors(nearest_contexts(units, _test(units), k), ["run", "signature_id"], "nd", "w", "x"))
    asked = cut(units.where("part IN ('validation', 'test')"))
    near = cut(nearest_contexts(units, asked, max(KS)))
    each = near.withColumn("k", F.explode(F.filter(F.array(*[F.lit(n) for n in KS]), lambda n: n >= F.col("rn"))))
    means = cut(mean_vectors(each, ["run", "signature_id", "k"], "nd", "w", "x"))
    tried = asked.where("part = 'validation' AND NOT is_control").select("run", "signature_id", "delta").join(means, ["run", "signature_id"])
    # A row with fewer neighbours than k has the same mean at every k beyond them.
    score = tried.groupBy("run", "signature_id").agg(F.map_from_entries(F.collect_list(F.struct("k", cosine("delta", "x").alias("c")))).alias("by"))
    all_k = F.explode(F.array(*[F.struct(F.lit(n).alias("k"), F.col("by")[n].alias("c")) for n in KS]))
    per = score.select("run", all_k.alias("e")).groupBy("run", "e.k").agg(F.round(F.avg("e.c"), 12).alias("c"))
    best = per.groupBy("run").agg(F.max_by("k", F.struct(F.col("c"), -F.col("k"))).alias("selected_k"))
    rows = _test(units).join(F.broadcast(best), "run", "left").withColumn("selected_k", F.coalesce("selected_k", F.lit(KS[0])))
    mine = means.withColumnRenamed("k", "selected_k")
    joined = rows.join(mine, ["run", "signature_id", "selected_k"], "left").join(F.broadcast(global_mean(units)), "run", "left")
    return _settle(joined, F.coalesce("x", "g")).drop("x", "g")


def _fill(units: DataFrame, rows: DataFrame, means: DataFrame) -> DataFrame:
    joined = rows.join(means, ["run", "signature_id"], "left").join(F.broadcast(global_mean(units)), "run", "left")
    return _settle(joined, F.coalesce("x", "g")).drop("x", "g")


def ridge(units: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> DataFrame:
    """(run, signature_id, guess, selected_alpha, confidence) of the test rows, by dual ridge on profile and categories.

    One run's train part is one matrix; runs are spread over the cluster.
    """
    kinds = dict(units.dtypes)
    cols = ["run", "part", "signature_id", "is_control", "delta", "profile", *CATEGORIES]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("signature_id")
        train = pdf[(pdf.part == "train") & ~pdf.is_control]
        val, test = pdf[(pdf.part == "validation") & ~pdf.is_control], pdf[pdf.part == "test"]
        if not len(test):
            return pd.DataFrame(columns=["run", "signature_id", "guess", "selected_alpha", "confidence"])
        width = len(test.iloc[0].delta)
        if not len(train):
            guess, alpha, conf = np.zeros((len(test), width)), alphas[0], np.zeros(len(test))
        else:
            y = np.array(train.delta.tolist(), float)

            def features(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
                a, b = one_hot(train, rows, CATEGORIES)
                return np.hstack([np.array(train.profile.tolist(), float), a]), np.hstack([np.array(rows.profile.tolist(), float).reshape(len(rows), -1), b])

            alpha = alphas[0]
            if len(val):
                x, q = features(val)
                truth = np.array(val.delta.tolist(), float)
                scores = {a: round(float(safe_cosine(truth, p).mean()), 12) for a, p in ridge_dual(x, y, q, alphas).items()}
                alpha = max(alphas, key=lambda a: (scores[a], -a))
            x, q = features(test)
            guess = ridge_dual(x, y, q, (alpha,))[alpha]
            rows = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), EPS)
            conf = np.clip(np.clip((rows(q) @ rows(x).T).max(1), 0, 1) / (1 + 0.5 * np.log10(alpha + 1.0)), 0, 1)
        guess[test.is_control.to_numpy(bool)] = 0.0
        return pd.DataFrame({"run": test.run, "signature_id": test.signature_id, "guess": list(guess), "selected_alpha": alpha, "confidence": conf})

    schema = f"run {kinds['run']}, signature_id {kinds['signature_id']}, guess array<double>, selected_alpha double, confidence double"
    return units.select(*cols).groupBy("run").applyInPandas(one, schema)


def support_scale(value: Column, most: Column) -> Column:
    """log(1 + value) over log(1 + the largest), within [0, 1]; 1 where there is no support at all."""
    top = F.log1p(F.greatest(most.cast("double"), F.lit(0.0)))
    return F.when(top <= EPS, F.lit(1.0)).otherwise(clip(F.log1p(F.greatest(value.cast("double"), F.lit(0.0))) / top, 0.0, 1.0))


def reference_similarity(units: DataFrame) -> DataFrame:
    """(run, signature_id, sim): cosine of a test row's profile with the run's mean train profile."""
    centre = mean_vectors(units.where("part = 'train'"), ["run"], "profile", None, "centre")
    return _test(units).join(F.broadcast(centre), "run").select("run", "signature_id", clip(cosine("profile", "centre"), 0.0, 1.0).alias("sim"))


def confidence_control(units: DataFrame) -> DataFrame:
    return _test(units).select("run", "signature_id", F.lit(0.0).alias("confidence"))


def confidence_global(units: DataFrame) -> DataFrame:
    """Similarity of the reference times the support of its key in train."""
    train = units.where("part = 'train'")
    support = train.groupBy("run", "reference_key").agg(F.sum("n_cells").alias("s"))
    most = train.groupBy("run").agg(F.max("n_cells").alias("most"))
    rows = _test(units).join(reference_similarity(units), ["run", "signature_id"]).join(support, ["run", "reference_key"], "left").join(F.broadcast(most), "run", "left")
    value = F.col("sim") * support_scale(F.coalesce("s", F.lit(0)), F.coalesce("most", F.lit(0)))
    return rows.select("run", "signature_id", clip(value, 0.0, 1.0).alias("confidence"))


def confidence_perturbation(units: DataFrame) -> DataFrame:
    """Reference similarity and label support, less for labels known by components only, least for unknown ones."""
    train = _train(units)
    support = train.groupBy("run", "perturbation_label").agg(F.sum("n_cells").alias("s"))
    single = support.where(F.size(components("perturbation_label")) == 0).select("run", F.col("perturbation_label").alias("c"), F.col("s").alias("cs"))
    most = train.groupBy("run").agg(F.max("n_cells").alias("most"))
    test = _test(units)
    labels = test.select("run", "perturbation_label").distinct()
    parts = labels.select("run", "perturbation_label", F.size(components("perturbation_label")).alias("k"), F.explode(components("perturbation_label")).alias("c"))
    mixed = parts.join(single, ["run", "c"]).groupBy("run", "perturbation_label").agg(F.count(F.lit(1)).alias("n"), F.first("k").alias("k"), F.avg("cs").alias("ms")).where("n = k")
    rows = (
        test.join(reference_similarity(units), ["run", "signature_id"])
        .join(support, ["run", "perturbation_label"], "left")
        .join(mixed.select("run", "perturbation_label", "ms"), ["run", "perturbation_label"], "left")
        .join(F.broadcast(most), "run", "left")
    )
    base = F.when(F.col("s").isNotNull(), 1.0).when(F.col("ms").isNotNull(), 0.6).otherwise(0.2)
    value = base * (0.5 * F.col("sim") + 0.5 * support_scale(F.coalesce("s", "ms", F.lit(0.0)), F.coalesce("most", F.lit(0))))
    return rows.select(
        "run", "signature_id",
        clip(F.when(F.col("is_control"), F.least(F.lit(1.0), 0.5 + 0.5 * F.col("sim"))).otherwise(value), 0.0, 1.0).alias("confidence"),
    )


def confidence_knn(units: DataFrame, k: int = 5) -> DataFrame:
    """Support-weighted mean similarity of the k nearest train contexts of the label.

    Contexts are compared as distinct control profiles, of which there is one a reference, not as rows.
    """
    train = _train(units).withColumn("np", unit("profile"))
    most = train.groupBy("run").agg(F.max("n_cells").alias("most"))
    test = _test(units).withColumn("qp", unit("profile"))
    seen = train.groupBy("run", "dataset_id", "reference_key").agg(F.first("np").alias("np"))
    asked = test.groupBy("run", "dataset_id", "reference_key").agg(F.first("qp").alias("qp")).withColumnsRenamed({"dataset_id": "qd", "reference_key": "qr"})
    product = F.aggregate(F.zip_with("qp", "np", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    best = asked.join(seen, "run").groupBy("run", "qd", "qr").agg(F.max(product).alias("best"))
    rows = test.join(best, (test["run"] == best["run"]) & (test["dataset_id"] == best["qd"]) & (test["reference_key"] == best["qr"]), "left").drop(best["run"])
    asks = ["run", "perturbation_label", "qc"]
    alike = lambda a, b: -F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    ids = _near_ids(train.withColumn("u", F.col("np")), test.where("NOT is_control").withColumn("u", F.col("qp")), k, "u", alike)
    found = ids.join(train.select("run", F.col("signature_id").alias("nid"), "n_cells"), ["run", "nid"]).select(*asks, (-F.col("dist")).alias("sim"), "n_cells")
    wanted = test.where("NOT is_control").select("run", "signature_id", "perturbation_label", F.xxhash64("qp").alias("qc"))
    near = wanted.join(found, asks).join(F.broadcast(most), "run")
    w = F.greatest(support_scale(F.col("n_cells"), F.col("most")), F.lit(EPS))
    weighted = near.groupBy("run", "signature_id").agg((F.sum(clip(F.col("sim"), 0.0, 1.0) * w) / F.sum(w)).alias("x"))
    up = F.greatest(F.lit(0.0), F.coalesce("best", F.lit(0.0)))
    value = F.when(F.col("is_control"), up).when(F.col("x").isNotNull(), F.col("x")).otherwise(0.1 * up)
    return rows.join(weighted, ["run", "signature_id"], "left").select("run", "signature_id", clip(value, 0.0, 1.0).alias("confidence"))


def confidence_ridge(units: DataFrame) -> DataFrame:
    return ridge(units).select("run", "signature_id", "confidence")


PREDICTORS = {
    "control_mean_baseline": control_mean,
    "global_delta_baseline": global_delta,
    "perturbation_mean_delta_baseline": perturbation_mean,
    "cell_context_knn_delta_baseline": cell_context_knn,
    "ridge_regression_baseline": ridge,
}
CONFIDENCE = {
    "control_mean_baseline": confidence_control,
    "global_delta_baseline": confidence_global,
    "perturbation_mean_delta_baseline": confidence_perturbation,
    "cell_context_knn_delta_baseline": confidence_knn,
    "ridge_regression_baseline": confidence_ridge,
}


def predict(model: str, units: DataFrame) -> DataFrame:
    if model not in PREDICTORS:
        raise ValueError(f"unknown model {model}")
    return PREDICTORS[model](units)


def confidence(model: str, units: DataFrame) -> DataFrame:
    if model not in CONFIDENCE:
        raise ValueError(f"unknown model {model}")
    return CONFIDENCE[model](units)


def summary(predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Per run: mean squared and absolute error over all elements and mean cosine, by population."""
    rows = predicted.select(
        *keys, "is_control",
        F.aggregate(F.zip_with("delta", "guess", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x).alias("sq"),
        F.aggregate(F.zip_with("delta", "guess", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, x: a + x).alias("ab"),
        F.size("delta").alias("n"), cosine("delta", "guess").alias("cos"),
    )
    slices = {"non_control": ~F.col("is_control"), "control": F.col("is_control"), "overall": F.lit(True)}
    out = []
    for s, c in slices.items():
        out += [
            F.try_divide(F.sum(F.when(c, F.col("sq"))), F.sum(F.when(c, F.col("n")))).alias(f"mse_{s}"),
            F.try_divide(F.sum(F.when(c, F.col("ab"))), F.sum(F.when(c, F.col("n")))).alias(f"mae_{s}"),
            F.avg(F.when(c, F.col("cos"))).alias(f"mean_cosine_{s}"),
        ]
    return rows.groupBy(*keys).agg(*out)
