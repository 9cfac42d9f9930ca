from pyspark.sql import functions as F

from vectrail.operators import reliability as rl
from vectrail.plans import QUERIES


def test_queries_run_the_whole_suite(spark, small, monkeypatch):
    trees_seen = set()

    def quick(df, spec, estimator, label="target_transportable", trees=200):
        trees_seen.add(trees)
        return df.where("held").withColumn("score", F.lit(0.5))

    monkeypatch.setattr(rl, "fit_scores", quick)
    rows = QUERIES["r13_ablation_suite"](spark, small).collect()
    fitted = ["full", "no_context_distance", "no_perturbation_novelty", "no_uncertainty_features"]
    want = {("naive_confidence", "naive_confidence")} | {(a, e) for a in fitted for e in ("logistic_regression", "random_forest")}
    assert {(r.ablation, r.estimator) for r in rows if r.status == "completed"} == want and len(rows) == 10
    left = [r for r in rows if r.status == "skipped"]
    assert [(r.ablation, r.n_features, r.accuracy) for r in left] == [("no_pathway_features", 0, None)]
    assert trees_seen == {200}
    got = QUERIES["r14_prediction_rows"](spark, small).groupBy("ablation", "estimator").count().collect()
    assert {(r.ablation, r.estimator) for r in got} == want and len({r["count"] for r in got}) == 1


def test_pathway_ablation_runs_where_there_are_columns(spark, monkeypatch):
    monkeypatch.setattr(rl, "fit_scores", lambda df, spec, e, **_: df.where("held").withColumn("score", F.lit(0.5)))
    rows = [(i, f"run{i % 8}", 0.5, i % 2, 0.3, 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "example_id long, run_id string, confidence double, target_transportable int, target_risk double, bio_support double")
    got = [(r.n_features, r.status) for r in rl.ablation_suite(df, ["no_pathway_features"]).collect() if r.ablation == "no_pathway_features"]
    assert got == [(1, "completed")] * 2


def test_sensitivity_refits_at_every_multiplier(spark, small, monkeypatch):
    monkeypatch.setattr(rl, "fit_scores", lambda df, spec, e, **_: df.where("held").withColumn("score", F.lit(0.5)))
    rows = QUERIES["n7_threshold_sensitivity"](spark, small).collect()
    methods = [("naive_confidence", "naive_confidence")] + [(a, e) for a in ("full", "no_context_distance") for e in ("logistic_regression", "random_forest")]
    assert {(r.threshold_multiplier, r.ablation, r.estimator) for r in rows} == {(m, *x) for m in (0.6, 0.7, 0.8, 0.9) for x in methods} and len(rows) == 20
    rates = {r.multiplier: r.transportable_rate for r in QUERIES["n7_relative_threshold"](spark, small).collect()}
    assert all(r.transportable_rate == rates[r.threshold_multiplier] and 0.8 <= r.coverage_at_0p8 < 0.85 and r.accuracy is not None for r in rows)


def test_forest_may_grow_as_deep_as_spark_allows(spark):
    rows = [(i, f"run{i % 8}", float(2 ** (i // 8)), (i // 8) % 2, i % 4 == 3) for i in range(320)]
    df = spark.createDataFrame(rows, "example_id long, run_id string, n_cells double, target_transportable int, held boolean")
    seen = {}
    real = rl.RandomForestClassifier

    def spy(**kw):
        seen.update(kw)
        return real(**kw)

    rl.RandomForestClassifier = spy
    try:
        assert rl.fit_scores(df, rl.FeatureSpec(["n_cells"], []), "random_forest", trees=2).count() == 80
    finally:
        rl.RandomForestClassifier = real
    assert seen["maxDepth"] == 30 and seen["minInstancesPerNode"] == 5
