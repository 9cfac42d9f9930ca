import pytest

from vectrail.operators import predictors as pr

SCHEMA = "run string, part string, signature_id string, dataset_id string, reference_key string, perturbation_label string, is_control boolean, n_cells int, batch string, timepoint string, delta array<double>, profile array<double>"


def frame(spark):
    rows = [
        ("r", "train", "a", "d", "k", "A", False, 10, "b", "t", [1.0, 0.0], [1.0, 1.0]),
        ("r", "train", "b", "d", "k", "A", False, 30, "b", "t", [3.0, 0.0], [1.0, 0.0]),
        ("r", "train", "c", "d", "k", "B", False, 20, "b", "t", [0.0, 6.0], [1.0, 1.0]),
        ("r", "train", "n", "d", "k", "control", True, 99, "b", "t", [9.0, 9.0], [1.0, 1.0]),
        ("r", "validation", "v", "d", "k", "A", False, 5, "b", "t", [1.0, 0.0], [1.0, 1.0]),
        ("r", "test", "t1", "d", "k", "A", False, 5, "b", "t", [1.0, 0.0], [1.0, 1.0]),
        ("r", "test", "t2", "d", "k", "A_B", False, 5, "b", "t", [1.0, 1.0], [1.0, 1.0]),
        ("r", "test", "t3", "d", "k", "C", False, 5, None, "t", [1.0, 1.0], [1.0, 1.0]),
        ("r", "test", "t4", "d", "z", "control", True, 5, "b", "t", [0.0, 0.0], [1.0, 1.0]),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def guesses(df):
    return {r.signature_id: r.guess for r in df.collect()}


def test_means(spark):
    g = guesses(pr.global_delta(frame(spark)))
    assert g["t1"] == pytest.approx([100 / 60, 2.0]) and g["t4"] == [0.0, 0.0]
    m = guesses(pr.perturbation_mean(frame(spark)))
    assert m["t1"] == [2.5, 0.0] and m["t2"] == [1.25, 3.0] and m["t3"] == g["t3"] and m["t4"] == [0.0, 0.0]
    assert guesses(pr.control_mean(frame(spark)))["t1"] == [0.0, 0.0]


def test_knn(spark):
    k = guesses(pr.cell_context_knn(frame(spark), 3))
    assert k["t1"] == [1.0, 0.0] and k["t3"] == pytest.approx([100 / 60, 2.0])
    auto = {r.signature_id: (r.selected_k, r.guess) for r in pr.cell_context_knn(frame(spark)).collect()}
    assert auto["t1"] == (3, [1.0, 0.0])


def test_ridge_and_confidence(spark):
    got = {r.signature_id: r for r in pr.ridge(frame(spark)).collect()}
    assert set(got) == {"t1", "t2", "t3", "t4"} and got["t4"].guess == [0.0, 0.0] and all(0 <= r.confidence <= 1 for r in got.values())
    for name in pr.CONFIDENCE:
        rows = pr.confidence(name, frame(spark)).collect()
        assert len(rows) == 4 and all(0 <= r.confidence <= 1 for r in rows)
    p = {r.signature_id: r.confidence for r in pr.confidence_perturbation(frame(spark)).collect()}
    assert p["t1"] > p["t2"] > p["t3"]
    with pytest.raises(ValueError):
        pr.predict("other", frame(spark))


def test_missing_profile_raises(spark):
    f = frame(spark).drop("profile")
    with pytest.raises(KeyError):
        pr.with_profiles(f, pr.control_profiles(f.where("reference_key = 'k'")))
