import random

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from vectrail.operators import forest
from vectrail.operators import reliability as rl

SCHEMA = "example_id long, run_id string, confidence double, n_cells int, model string, split_family string, target_transportable int, target_risk double"


def rows(n=800, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, m = (None if i % 50 == 0 else r.random()), r.choice(["a", "b", "c", None, ""])
        y = int(((x or 0.5) > 0.5) != (m == "a")) if r.random() < 0.8 else r.randrange(2)
        out.append((i, f"run{i % 16}", x, r.randrange(100), "once" if i == 5 else m, r.choice(["f", "g"]), y, r.random()))
    return out


def parted(spark):
    return spark.createDataFrame(rows(), SCHEMA).withColumn("held", F.expr("example_id % 4 = 3"))


def test_logistic_is_the_minimum_spark_ml_comes_to(spark):
    spec = rl.FeatureSpec(["confidence", "n_cells"], ["model", "split_family"])
    got = {r.example_id: r.score for r in rl.fit_scores(parted(spark), spec, "logistic_regression").collect()}
    df = parted(spark)
    middle = df.where("NOT held").agg(F.percentile("confidence", 0.5)).first()[0]
    df = df.withColumns({
        "confidence": F.coalesce("confidence", F.lit(middle)), "n_cells": F.col("n_cells").cast("double"),
        "model": F.when(F.col("model") == "once", "rare").otherwise(F.coalesce(F.when(F.col("model") != "", F.col("model")), F.lit("missing"))),
    })
    train = df.where("NOT held")
    n, ones = train.count(), train.where("target_transportable = 1").count()
    train = train.withColumn("w", F.when(F.col("target_transportable") == 1, n / (2 * ones)).otherwise(n / (2 * (n - ones))))
    stages = [StringIndexer(inputCol=c, outputCol=f"i{c}", handleInvalid="keep") for c in spec.categorical]
    stages += [
        OneHotEncoder(inputCols=[f"i{c}" for c in spec.categorical], outputCols=[f"o{c}" for c in spec.categorical]), VectorAssembler(inputCols=spec.numeric, outputCol="num"),
        StandardScaler(inputCol="num", outputCol="scaled", withMean=True), VectorAssembler(inputCols=["scaled", "omodel", "osplit_family"], outputCol="x"),
        LogisticRegression(featuresCol="x", labelCol="target_transportable", weightCol="w", regParam=1 / n, standardization=False, maxIter=1000, tol=1e-13, probabilityCol="p"),
    ]
    want = {r.example_id: r.p for r in Pipeline(stages=stages).fit(train).transform(df.where("held")).select("example_id", vector_to_array("p")[1].alias("p")).collect()}
    assert set(got) == set(want) and max(abs(got[i] - want[i]) for i in want) < 1e-6


def test_held_rows_keep_their_own_values(spark):
    got = rl.fit_scores(parted(spark), rl.FeatureSpec(["confidence"], ["model"]), "random_forest", trees=3)
    assert {(r.example_id, r.confidence, r.model) for r in got.collect()} == {(r[0], r[2], r[4]) for r in rows() if r[0] % 4 == 3}


def test_labels_and_ablations_share_one_packing(spark, monkeypatch):
    packed, real = [], rl.pack
    monkeypatch.setattr(rl, "pack", lambda *a, **k: packed.append(1) or real(*a, **k))
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("target_transportable_1", (F.col("target_risk") > 0.5).cast("int")).cache()
    got = rl.label_suites(df, ["target_transportable", "target_transportable_1"], ["full", "no_uncertainty_features"], trees=4)
    assert got.count() == 10 and len(packed) == 1
    for y in ("target_transportable", "target_transportable_1"):
        alone = rl.ablation_suite(df.withColumn("target_transportable", F.col(y)).drop("target_transportable_1"), ["full", "no_uncertainty_features"], trees=4)
        assert sorted(map(tuple, alone.collect()), key=str) == sorted(map(tuple, got.where(F.col("label") == y).drop("label").collect()), key=str)
    df.unpersist()


def test_frames_scored_together_and_alone(spark):
    a = parted(spark).withColumn("score", F.coalesce("confidence", F.lit(0.0)))
    frames = [(a, "target_transportable"), (a.withColumn("score", F.col("n_cells") / 100), "target_transportable"), (a, "target_transportable")]
    got = rl.score_rows(frames, at=0.8)
    assert got[0] == got[2] != got[1]
    for (df, _), g in zip(frames, got):
        one = rl.score_row(df, "", "", 1, at=0.8).drop("ablation", "estimator", "n_features").first().asDict()
        assert list(one) == list(g) and all(abs(one[c] - g[c]) < 1e-12 for c in one)


def test_categories_of_a_column_are_counted_once(monkeypatch):
    r = np.random.default_rng(0)
    codes = r.integers(0, 100, (3000, 1)).astype(np.uint8)
    y = (r.random(3000) < 0.2 + 0.6 * (codes[:, 0] == 7)).astype(np.uint8)
    seen, real = [], np.bincount
    monkeypatch.setattr(forest.np, "bincount", lambda *a, **k: seen.append(1) or real(*a, **k))
    tree = forest.grow(codes, y, np.ones(3000, int), np.ones(2), np.zeros(100, int), np.arange(100), np.full(100, 2), 3, 5, r)
    assert len(seen) <= 4 * 4 and len(tree.feature) > 3  # not once for each of ten features at every level


def test_gains_against_counting_each_split():
    r = np.random.default_rng(1)
    codes = np.column_stack([r.integers(0, 6, 400), r.integers(0, 4, 400)]).astype(np.uint8)
    y, times = np.sort(r.integers(0, 2, 400)), r.integers(1, 4, 400).astype(float)
    col, value = np.array([0, 1, 1, 1, 1]), np.array([-1, 0, 1, 2, 3])
    weight = np.array([0.7, 1.6])
    sums = lambda s: np.bincount(y[s], times[s], 2)
    count = sums(np.ones(400, bool))[None]
    drawn = np.array([[3, 0, 1]])
    gains, at = forest._gains(codes.ravel(), 2, np.bincount(y, minlength=2), times, count, count * weight, weight, drawn, col, value, codes.max(axis=0).astype(int) + 1, 5)
    gain = lambda left: sum((m**2).sum() / m.sum() for m in (sums(left) * weight, sums(~left) * weight))
    for j, f in enumerate(drawn[0]):
        x = codes[:, 0] if value[f] < 0 else (codes[:, 1] == value[f]).astype(int)
        best = max(range(x.max()), key=lambda c: gain(x <= c))
        assert at[0, j] == best and abs(gains[0, j] - gain(x <= best)) < 1e-9
