import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vectrail.operators import kernels, vectors


def test_constant_vectors():
    m = vectors.metric_matrix(np.ones((1, 4)), np.ones((1, 4)))
    assert m["cosine_similarity"][0] == m["pearson"][0] == m["spearman"][0] == 1
    m = vectors.metric_matrix(np.zeros((1, 4)), np.ones((1, 4)))
    assert m["cosine_similarity"][0] == m["pearson"][0] == m["spearman"][0] == 0
    m = vectors.metric_matrix(np.zeros((1, 4)), np.zeros((1, 4)))
    assert m["cosine_similarity"][0] == 1 and m["rmse"][0] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-3, 3), min_size=1, max_size=12))
def test_average_ranks(values):
    v = np.array(values, float)
    want = [((v < x).sum() + 1 + (v <= x).sum()) / 2 for x in v]
    assert vectors._average_ranks(v[None, :])[0].tolist() == want


def test_top_k_ties_favour_lower_positions():
    t, p = np.array([[1.0, -1.0, 1.0, 0.0]]), np.array([[1.0, 1.0, 0.0, 0.0]])
    m = vectors.metric_matrix(t, p, (2,))
    assert m["jaccard_top2"][0] == 1 and m["direction_top2"][0] == 0.5 and m["ndcg_top2"][0] == 1 and m["map_top2"][0] == 1


def test_row_metrics_skips_unusable_rows(spark):
    rows = [(1, [1.0, 2.0], [1.0, 2.0]), (2, None, [1.0]), (3, [1.0], [1.0, 2.0]), (4, [], []), (5, [1.0, 0.0, 2.0], [0.0, 1.0, 2.0])]
    got = {r.i: r for r in vectors.row_metrics(spark.createDataFrame(rows, "i int, t array<double>, p array<float>"), ["i"], "t", "p", (2,)).collect()}
    assert set(got) == {1, 5} and got[1].cosine_similarity == pytest.approx(1)


def test_expressions_match_kernel(spark):
    r = np.random.default_rng(1)
    t, p = r.normal(size=(20, 9)), r.normal(size=(20, 9))
    df = spark.createDataFrame([(i, t[i].tolist(), p[i].tolist()) for i in range(20)], "i int, t array<double>, p array<double>")
    m = vectors.metric_matrix(t, p)
    for x in df.select("i", vectors.cosine("t", "p").alias("c"), vectors.rmse("t", "p").alias("r"), vectors.mae("t", "p").alias("a")).collect():
        assert (x.c, x.r, x.a) == pytest.approx((m["cosine_similarity"][x.i], m["rmse"][x.i], m["mae"][x.i]))


def test_weighted_means(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 3), ("b", [5.0, 6.0], 0), ("b", [7.0, 8.0], 0)], "k string, v array<double>, w int")
    got = {r.k: r.m for r in vectors.mean_vectors(df, ["k"], "v", "w", "m").collect()}
    assert got["a"] == [2.5, 3.5] and got["b"] == [6.0, 7.0]


def test_retrieval_identity(spark):
    rows = [("r", i, "ABC"[i], [float(i == j) for j in range(3)]) for i in range(3)]
    df = spark.createDataFrame(rows, "run string, k int, l string, t array<double>")
    got = vectors.retrieval(df.withColumn("p", df.t), "run", "k", "l", "t", "p").collect()
    assert all(r.top1 == 1 for r in got)


def test_pathways(spark):
    df = spark.createDataFrame([(1, [1.0, 3.0, -2.0, -4.0])], "i int, t array<double>")
    sets = spark.createDataFrame([("up", 0), ("up", 1), ("down", 2), ("down", 3), ("one", 0)], "pathway string, pos int")
    got = vectors.pathway_fidelity(df.withColumn("p", df.t), ["i"], "t", "p", sets, 2).first()
    assert got.pathway_cosine == pytest.approx(1) and got.pathway_direction == 1
    assert {r.pathway: r.value for r in vectors.pathway_profiles(df, ["i"], "t", sets, 2).collect()} == {"up": 2.0, "down": -3.0}


def test_ridge_is_primal_ridge():
    r = np.random.default_rng(0)
    x, y, q = r.normal(size=(12, 5)), r.normal(size=(12, 3)), r.normal(size=(4, 5))
    for alpha, got in kernels.ridge_dual(x, y, q).items():
        xc, yc = x - x.mean(0), y - y.mean(0)
        b = np.linalg.solve(xc.T @ xc + alpha * np.eye(5), xc.T @ yc)
        assert np.allclose(got, (q - x.mean(0)) @ b + y.mean(0))


def rank_test(spark, d):
    df = spark.createDataFrame([("a", "b", float(x)) for x in d] + [("a", "c", None)], "model_a string, model_b string, diff double")
    rows = kernels.rank_tests(df, ["model_a", "model_b"], "diff").collect()
    assert [(r.model_b, r.n_pairs) for r in rows] == [("b", len(d))]
    assert rows[0].median_diff == pytest.approx(float(np.median(d)))
    return rows[0].p_value_raw


def test_rank_test(spark):
    import itertools
    import math

    assert rank_test(spark, [0.0, 0.0]) == 1 and rank_test(spark, [1.0]) == 1
    assert rank_test(spark, range(1, 6)) == pytest.approx(2 / 32)
    d = np.array([1.5, -0.5, 2.5, 3.5, -1.0, 4.0])
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    obs = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    n = sum(sum(r for r, s in zip(ranks, signs) if s) <= obs for signs in itertools.product([0, 1], repeat=6))
    assert rank_test(spark, d) == pytest.approx(min(1, 2 * n / 64))
    # Ties and zeros: the normal approximation with the correction for ties.
    d = [1, 1, 2, -1, 0, 3, 3, -2]
    ranks = [2, 2, 4.5, 2, 6.5, 6.5, 4.5]
    plus, var = 2 + 2 + 4.5 + 6.5 + 6.5, 7 * 8 * 15 / 24 - (24 + 6 + 6) / 48
    assert sum(ranks) == 28 and rank_test(spark, d) == pytest.approx(math.erfc(abs(plus - 14) / math.sqrt(var) / math.sqrt(2)))


def test_blocks_agree_with_whole_runs(spark, monkeypatch):
    r = np.random.default_rng(2)
    rows = [("r", i, f"l{i % 5}", r.normal(size=3).tolist(), r.normal(size=3).tolist()) for i in range(60)] + [("q", 99, "l", [1.0, 0.0, 0.0], [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "run string, id long, l string, t array<double>, p array<double>")
    whole = vectors.retrieval(df, "run", "id", "l", "t", "p").orderBy("run", "id").collect()
    far = {x.run: x.energy_distance for x in kernels.energy_distances(df, "run", "id", "t", "p").collect()}
    monkeypatch.setattr(kernels, "BLOCK", 7)
    assert vectors.retrieval(df, "run", "id", "l", "t", "p").orderBy("run", "id").collect() == whole
    x, y = np.array([v[3] for v in rows[:60]]), np.array([v[4] for v in rows[:60]])
    for got in (far, {v.run: v.energy_distance for v in kernels.energy_distances(df, "run", "id", "t", "p").collect()}):
        assert got["r"] == pytest.approx(kernels.energy_distance(x, y)) and got["q"] == pytest.approx(2.0)


def test_transport_between_unequal_sizes():
    x, y = np.array([[0.0], [1.0]]), np.array([[0.0], [0.0], [1.0]])
    assert kernels.sliced_wasserstein(x, y) == pytest.approx(1 / 6)
    assert kernels.sliced_wasserstein(x, np.repeat(x, 3, axis=0)) == pytest.approx(0.0, abs=1e-12)


def test_distances():
    r = np.random.default_rng(0)
    x = r.normal(size=(30, 4))
    assert kernels.linear_mmd(x, x) == 0 and kernels.sliced_wasserstein(x, x) == 0
    assert kernels.energy_distance(x, x + 3) > kernels.energy_distance(x, x + 1) > 0
    y = r.normal(size=(20, 4))
    d = lambda a, b: np.linalg.norm(a[:, None] - b[None], axis=2)
    want = 2 * d(x, y).mean() - d(x, x)[np.triu_indices(30, 1)].mean() - d(y, y)[np.triu_indices(20, 1)].mean()
    assert kernels.energy_distance(x, y) == pytest.approx(want)


def test_distribution_needs_rows(spark):
    rows = [("r", "train" if i < 20 else "test", [float(i), i * i / 7.0], False) for i in range(32)] + [("s", "test", [1.0, 2.0], False)]
    df = spark.createDataFrame(rows, "run string, part string, t array<double>, is_control boolean")
    got = {r.run: r for r in kernels.distribution_distances(df.withColumn("p", df.t), "run", "part", "t", "p", "is_control").collect()}
    assert got["r"].status == "ok" and got["r"].mmd_linear == pytest.approx(0, abs=1e-9) and got["s"].status == "unsupported"


def test_nulls_stay_null(spark):
    from pyspark.sql import functions as F

    from vectrail.operators.relational import clip

    df = spark.createDataFrame([(None, [1.0], None)], "a array<double>, b array<double>, x double")
    r = df.select(vectors.cosine("a", "b").alias("c"), clip(F.col("x"), 0.0, 1.0).alias("k")).first()
    assert r.c is None and r.k is None
