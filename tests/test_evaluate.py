import pytest
from pyspark.sql import functions as F

from vectrail.operators import evaluate as ev
from vectrail.operators import relational as rel
from vectrail.operators import features as ft
from vectrail.operators import reliability as rl
from vectrail.operators import reports as rp


def test_selection(spark):
    manifest = spark.createDataFrame([("run_a",), ("run_b",), ("run_c",)], "run_id string")
    reg = spark.createDataFrame([("run_a", 1, "failed"), ("run_a", 2, "cached"), ("run_b", 1, "failed"), ("smoke__extra", 1, "success")], "run_id string, at int, status string")
    got = {r.run_id: (r.selected, r.note) for r in ev.select_runs(manifest, reg, "run_id", "at").collect()}
    assert got == {"run_a": (True, "selected"), "run_b": (False, "not_successful"), "run_c": (False, "missing_in_registry"), "smoke__extra": (False, "not_in_manifest_smoke_or_extra")}


def test_selective_metrics_are_monotone(spark):
    rows = [("r", 0.1 * i, 1 - 0.1 * i, None if i == 3 else i > 4) for i in range(10)]
    t = ev.selective_table(spark.createDataFrame(rows, "run string, confidence double, risk double, transportable boolean"), ["run"]).orderBy("tau").collect()
    cov = [r.coverage for r in t]
    assert cov == sorted(cov, reverse=True) and t[-1].accepted == 0 and t[-1].selective_risk is None and t[-1].false_transportability_rate is None


def test_wilson(spark):
    r = spark.createDataFrame([(5, 10), (0, 0), (10, 10)], "c long, n long").select(*ev.wilson("c", "n", "p")).collect()
    assert (r[0].p_low, r[0].p_high) == pytest.approx((0.23659, 0.76341), abs=1e-5)
    assert r[1].p_low is None and r[2].p_high == pytest.approx(1)


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.5, 0.02]
    got = {r.i: r.p_value_fdr for r in rel.benjamini_hochberg(spark.createDataFrame(list(enumerate(ps)), "i int, p double"), "p", ["i"]).collect()}
    order = sorted(range(5), key=lambda i: ps[i])
    want, low = {}, 1.0
    for k in range(5, 0, -1):
        low = min(low, ps[order[k - 1]] * 5 / k)
        want[order[k - 1]] = low
    assert got == pytest.approx(want)


def test_pairs_skip_null_contexts(spark):
    rows = [("a", "x", 0, 0.9), ("b", "x", 0, 0.4), ("a", None, 0, 1.0), ("b", None, 0, 0.0), ("a", "y", 1, None)]
    m = spark.createDataFrame(rows, "model string, f string, seed int, v double")
    got = ev.model_pairs(m, "v", ["f", "seed"]).collect()
    assert len(got) == 1 and got[0]["diff"] == pytest.approx(0.5)


def test_instability(spark):
    rows = [("a", "x", 0.9), ("b", "x", 0.1), ("a", "y", 0.8), ("b", "y", 0.2), ("a", "z", 0.1), ("b", "z", 0.7)]
    got = {r.model: r for r in ev.rank_instability(spark.createDataFrame(rows, "model string, f string, v double"), "v", ["f"]).collect()}
    assert got["a"].mean_rank == pytest.approx(4 / 3) and got["a"].reversals == got["b"].reversals == 1


def test_labels_need_an_anchor(spark):
    rows = [(0.5, 0.6, "low_support_split"), (0.4, 0.6, "low_support_split"), (0.5, None, "low_support_split"), (0.5, 0.6, "random_split")]
    got = spark.createDataFrame(rows, "c double, a double, f string").select(ev.transportable("c", "a", "f", F.lit(False)).alias("t")).collect()
    assert [r.t for r in got] == [True, False, None, None]


def test_fallback_order(spark):
    rows = [(0.61, '{"m": 0.1}'), (None, '{"m": 0.42, "metrics": {"m": 0.1}}'), (None, '{"metrics": {"m": 0.33}}'), (None, "{}")]
    got = spark.createDataFrame(rows, "t double, p string").select(*ev.metric_fallback(F.col("t"), F.col("p"), "m")).collect()
    assert [(r.m, r.m_source) for r in got] == [(0.61, "table"), (0.42, "payload"), (0.33, "payload.metrics"), (None, None)]


def test_scores_against_counts(spark):
    import random

    r = random.Random(1)
    rows = [(i, int(r.random() < 0.4), round(r.random(), 1)) for i in range(300)]
    got = rl.classifier_scores(spark.createDataFrame(rows, "i int, y int, s double"), "y", "s").first()
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert got.roc_auc == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted({s for _, _, s in rows}, reverse=True):
        tp, n = sum(s >= t for s in pos), sum(s >= t for _, _, s in rows)
        ap, last = ap + (tp / len(pos) - last) * tp / n, tp / len(pos)
    assert got.average_precision == pytest.approx(ap)
    one = rl.classifier_scores(spark.createDataFrame([(1, 1, 0.5)], "i int, y int, s double"), "y", "s").first()
    assert one.roc_auc is None and one.accuracy == 1


def test_novelty(spark):
    train = spark.createDataFrame([("r", "A"), ("r", "B")], "run string, l string")
    rows = spark.createDataFrame([("r", "A"), ("r", "A_C"), ("r", "Z"), ("r", "control"), ("q", "A"), ("r", None)], "run string, l string")
    got = {(r.run, r.l): r for r in rl.novelty("l", "run", train, rows).collect()}
    assert got["r", "A"].perturbation_seen_in_train == 1 and got["r", "A"].component_seen_fraction == 1
    assert got["r", "A_C"].component_seen_fraction == 0.5 and got["r", "A_C"].unseen_component_count == 1
    assert got["r", "Z"].component_count == 1 and got["r", "control"].component_count == 0 and got["q", "A"].perturbation_seen_in_train == 0
    assert len(got) == 6


def test_failure_modes(spark):
    rows = [(True, 0.1, 0.9), (False, 1.2, -0.2), (False, 0.8, 0.2), (False, 0.7, 0.3), (False, 0.2, 0.8), (None, 0.1, 0.9)]
    df = spark.createDataFrame(rows, "transportable boolean, risk double, cosine_similarity double").withColumn("transport_threshold", F.lit(0.5))
    assert [r.failure_mode for r in rl.targets(df).collect()] == ["transportable", "severe_failure", "high_risk_failure", "below_transport_threshold", "non_transportable"]


def test_gate_keeps_outcomes_out(spark):
    df = spark.createDataFrame(
        [(1.0, 1, 0.5, "m", 0.1, "x", 0.2, "p", 1.0, 0.3, True)],
        "confidence double, n_cells int, target_risk double, model string, train_test_centroid_cosine double, run_id string, pearson double, some_path string, bio_x double, odd double, log1p_flag boolean",
    )
    spec = ft.feature_spec(df)
    assert spec.numeric == ["bio_x", "confidence", "log1p_flag", "n_cells"] and spec.categorical == ["model"]
    assert ft.ablate(spec, "no_uncertainty_features").columns == ["bio_x", "log1p_flag", "n_cells", "model"]
    assert "bio_x" not in ft.ablate(spec, "no_pathway_features").columns
    assert set(ft.feature_spec(df, "all").numeric) == set(spec.numeric) | {"train_test_centroid_cosine", "pearson", "odd"}
    audit = {r.feature: r for r in ft.feature_audit(df).collect()}
    assert audit["train_test_centroid_cosine"].target_or_label and audit["pearson"].target_or_label and audit["run_id"].identifier and audit["some_path"].identifier
    assert audit["odd"].evaluation_only and audit["odd"].left_out and not audit["bio_x"].left_out
    with pytest.raises(KeyError):
        ft.ablate(spec, "no_such")
    with pytest.raises(ValueError):
        ft.feature_spec(df, "some")


def test_held_parts_have_both_classes(spark):
    rows = [(i, f"run{i % 6}", int(i % 6 == 0)) for i in range(120)]  # one run of six holds all the ones: no whole-run split has both on both sides
    df = spark.createDataFrame(rows, "example_id long, run_id string, target_transportable int")
    got = {(r.held, r.target_transportable): r["count"] for r in rl.group_parts(df, "run_id", "example_id").groupBy("held", "target_transportable").count().collect()}
    assert got == {(True, 1): 5, (False, 1): 15, (True, 0): 25, (False, 0): 75}
    rows = [(i, f"run{i % 8}", int(i % 8 in (0, 1))) for i in range(160)]
    df = spark.createDataFrame(rows, "example_id long, run_id string, target_transportable int")
    parts = rl.group_parts(df, "run_id", "example_id")
    assert parts.groupBy("run_id").agg(F.countDistinct("held").alias("k")).agg(F.max("k")).first()[0] == 1
    assert parts.select("held", "target_transportable").distinct().count() == 4


def test_quantiles_of_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0)] * 50 + [("a", 2.0)] * 50 + [("b", None), ("b", 5.0), (None, 1.0), (None, 4.0)], "g string, x double")
    got = {(r.g, r.prob): r.quantile for r in rel.grouped_quantiles(df, ["g"], "x", [0.25, 0.5, 1.0]).collect()}
    assert got == {("a", 0.25): 1.0, ("a", 0.5): 1.5, ("a", 1.0): 2.0, **{("b", p): 5.0 for p in (0.25, 0.5, 1.0)}, (None, 0.25): 1.75, (None, 0.5): 2.5, (None, 1.0): 4.0}


def test_suite_learns(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(400):
        x = r.random()
        y = int(x + r.gauss(0, 0.1) > 0.5)
        rows.append((i, f"run{i % 8}", r.random(), int(100 * x), y, 1.0 - y * 0.6, "m" if i % 3 else None))
    df = spark.createDataFrame(rows, "example_id long, run_id string, confidence double, n_cells int, target_transportable int, target_risk double, model string")
    got = {r.estimator: r for r in rl.ablation_suite(df, ["full"], trees=10).collect()}
    assert got["logistic_regression"].roc_auc > 0.9 and got["random_forest"].roc_auc > 0.9 and got["naive_confidence"].roc_auc < 0.7
    assert got["logistic_regression"].mean_false_transportability_rate < got["naive_confidence"].mean_false_transportability_rate


def test_capped_sample(spark):
    df = spark.createDataFrame([(i, i % 10 == 0) for i in range(1000)], "i int, s boolean")
    got = rl.capped_sample(df, 100, "s", "i")
    assert got.count() == 100 and got.where("s").count() == 10 and rl.capped_sample(df, 5000, "s", "i").count() == 1000


def test_decay_and_atlas(spark):
    rows = [("r1", "a", "random_split", 0.8, None, None), ("r2", "a", "external_holdout", 0.2, 0.6, 0.25), ("r3", "b", "random_split", 0.6, None, None), ("r4", "b", "external_holdout", 0.45, 0.15, 0.75)]
    m = spark.createDataFrame(rows, "run_id string, model string, split_family string, mean_cosine double, drop double, stress_retention double")
    got = {(r.model, r.split_family): r for r in rp.transfer_decay(m, ["mean_cosine", "drop", "stress_retention"]).collect()}
    assert got["a", "external_holdout"].rank_shift_direction == "worse_rank" and got["b", "external_holdout"].family_winner
    assert got["a", "random_split"].stress_retention_flag == "anchor"
    f = spark.createDataFrame([("a", "x", "severe_failure", 12, 0.1), ("a", "x", "transportable", 8, 0.9), (None, "x", "odd", 1, None)], "model string, split_family string, failure_mode string, n_signatures long, mean_perturbation_seen double")
    f = f.withColumns({c: F.lit(None).cast("double") for c in ("mean_component_seen_fraction", "mean_reference_seen", "mean_n_cells")})
    a = {r.failure_mode: r for r in rp.failure_atlas(f).collect()}
    assert a["severe_failure"].failure_mode_share == 0.6 and a["severe_failure"].dominant_failure and a["severe_failure"].context_signal == "perturbation_novelty"
    assert a["odd"].failure_severity == 1 and not a["transportable"].dominant_nontransportable_failure


def test_ranks_and_bins(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(50)], "i int, x double")
    got = rel.global_rank(df, [F.col("x"), F.col("i")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 51)) and [r.x for r in got] == sorted(float(i % 7) for i in range(50))
    assert {r.bin for r in rel.quantile_bins(df, "x", 4).collect()} == {0, 1, 2, 3}
    assert rel.global_rank(df.limit(0), [F.col("x")]).count() == 0


def test_findings_narrative_and_document(spark):
    rows = [("r1", m, f, 0.8 - 0.1 * i - 0.2 * (f != "random_split"), None, None) for i, m in enumerate(["ridge_regression_baseline", "global_delta_baseline", "control_mean_baseline"]) for f in ("random_split", "external_holdout", "low_support_split")]
    m = spark.createDataFrame(rows, "run_id string, model string, split_family string, mean_cosine double, drop double, stress_retention double")
    decay = rp.transfer_decay(m, ["mean_cosine", "drop", "stress_retention"])
    atlas = spark.createDataFrame([("severe_failure", "a", "x", 3, 0.6), ("transportable", "a", "x", 0, 0.4)], "failure_mode string, model string, split_family string, failure_severity int, failure_mode_share double")
    few = {r.finding: r for r in rp.main_findings(decay, "mean_mean_cosine", atlas).collect()}
    assert set(few) == {"F1", "F2", "F3", "F5"} and few["F5"].value == 0.6 and few["F3"].value == 0.0
    assert few["F2"].value == 1 and few["F2"].subject == "external_holdout: ridge_regression_baseline; low_support_split: ridge_regression_baseline"
    frame = spark.createDataFrame
    found = rp.main_findings(
        decay, "mean_mean_cosine", atlas,
        frame([("full", "random_forest", -0.2), ("naive", "naive_confidence", 0.0)], "ablation string, estimator string, false_rate_delta_vs_naive double"),
        frame([(True,), (False,)], "reject_fdr_0_05 boolean"), frame([("m", "low_support_split", 0.7), ("m", "random_split", 0.9)], "model string, split_family string, difficulty_index double"),
        frame([(0.5,), (0.7,)], "pathway_cosine double"), frame([(1.0,), (0.0,)], "top1 double"), frame([(True,), (True,), (False,)], "target_or_label boolean"),
    )
    got = {r.finding: r.value for r in found.collect()}
    assert set(got) == {f"F{i}" for i in range(1, 11)}
    assert (got["F4"], got["F6"], got["F7"], got["F9"], got["F10"]) == (0.2, 1.0, 0.7, 0.5, 2.0) and got["F8"] == pytest.approx(0.6)
    text = rp.narrative(found, decay, "mean_mean_cosine")
    assert "low_support_split" in text and "`random_split`: `ridge_regression_baseline` (0.8000)" in text
    with pytest.raises(ValueError):
        rp.bounded("A clinical result")
    records = frame([("random_split", "d", "ready"), ("random_split", "d", "unsupported")], "split_family string, scope string, status string")
    assert "| random_split | rows at random | d | 1 | 1 |" in rp.benchmark_document(records)


def test_vectors_in_their_gene_space(spark):
    from vectrail.operators import campaign as cp

    grid = spark.createDataFrame([("a", "random_split", "s1", "train"), ("b", "external_holdout", "s1", "test"), ("b", "external_holdout", "s2", "train")], "split_id string, split_family string, signature_id string, part string")
    sig = spark.createDataFrame([("s1", "d1", [1.0, 2.0, 3.0]), ("s2", "d2", [4.0, 5.0, 6.0])], "signature_id string, dataset_id string, delta array<double>")
    spaces = spark.createDataFrame([("d1", 0), ("d1", 2), ("d2", 1), ("d2", 2)], "dataset_id string, pos int")
    got = {(r.split_id, r.signature_id): r.vector for r in cp.materialise(grid, sig, spaces, "delta").collect()}
    assert got == {("a", "s1"): [1.0, 3.0], ("b", "s1"): [3.0], ("b", "s2"): [6.0]}
    with pytest.raises(Exception, match="lacks positions"):
        cp.materialise(grid, sig, spaces.unionByName(spark.createDataFrame([("d1", 9)], spaces.schema)), "delta").collect()
