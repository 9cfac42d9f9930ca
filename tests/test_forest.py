import random

import numpy as np

from vectrail.operators import forest
from vectrail.operators import reliability as rl

SCHEMA = "example_id long, run_id string, confidence double, n_cells int, model string, target_transportable int, held boolean"


def noisy(n=1500, seed=4):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, m = r.random(), r.choice(["a", "b", "c", None])
        rows.append((i, f"run{i % 8}", x, r.randrange(100), m, int((x > 0.5) != (m == "a")) if r.random() < 0.8 else r.randrange(2), i % 4 == 3))
    return rows


SPEC = rl.FeatureSpec(["confidence", "n_cells"], ["model"])


def test_partitions_do_not_show_in_the_scores(spark):
    df = spark.createDataFrame(noisy(), SCHEMA)
    one, other = ({r.example_id: r.score for r in rl.fit_scores(df.repartition(k, "example_id"), SPEC, "random_forest", trees=20).collect()} for k in (1, 7))
    assert one == other and len(one) == 375 and all(0 <= s <= 1 for s in one.values())
    y = {r[0]: r[5] for r in noisy()}
    assert np.mean([(s >= 0.5) == y[i] for i, s in one.items()]) > 0.8


def test_more_trees_take_no_more_jobs(spark):
    df = spark.createDataFrame(noisy(), SCHEMA).repartition(2).cache()
    tracker, took = spark.sparkContext.statusTracker(), []
    for trees in (2, 40):
        spark.sparkContext.setJobGroup(f"trees{trees}", "")
        rl.fit_scores(df, SPEC, "random_forest", trees=trees).count()
        took.append(len(tracker.getJobIdsForGroup(f"trees{trees}")))
    spark.sparkContext.setJobGroup("", "")
    df.unpersist()
    assert abs(took[0] - took[1]) <= 5 and max(took) < 80  # adaptive plans may differ by a few


def plain_split(codes, y, weight, least):
    """The best (feature, code) at the root, by trying all."""
    best = None
    for f in range(codes.shape[1]):
        for c in range(codes[:, f].max()):
            left = codes[:, f] <= c
            if min(left.sum(), (~left).sum()) < least:
                continue
            gain = sum((m**2).sum() / m.sum() for m in (np.bincount(y[s], minlength=2) * weight for s in (left, ~left)))
            if best is None or gain > best[0] + 1e-9:
                best = (gain, f, c)
    return best[1:]


def test_a_tree_against_trying_all(spark):
    for seed in range(5):
        r = np.random.default_rng(seed)
        codes = r.integers(0, 9, (400, 1)).astype(np.uint8)
        y = (codes[:, 0] + r.normal(0, 3, 400) > 4).astype(np.uint8)
        n = np.bincount(y, minlength=2)
        args = (np.array([0]), np.array([-1]), np.array([9]))
        tree = forest.grow(codes, y, np.ones(400, int), n.sum() / (2 * n), *args, 30, 5, r)
        assert (tree.feature[0], tree.most[0]) == plain_split(codes, y, n.sum() / (2 * n), 5)
        # Grown out, each leaf gives the share of its own rows, of which there are five at least.
        got = tree.scores(codes, *args[:2])
        for s in np.unique(got):
            here = np.bincount(y[got == s], minlength=2) / n
            assert (got == s).sum() >= 5 and abs(here[1] / here.sum() - s) < 1e-9
    stump = forest.grow(codes, y, np.ones(400, int), np.ones(2), *args, 0, 5, r)
    assert len(stump.feature) == 1 and abs(stump.share[0] - y.mean()) < 1e-9


def test_few_values_keep_each_of_theirs(spark):
    rows = [(float(i == 0), float(i)) for i in range(2000)]
    got = forest.thresholds(spark.createDataFrame(rows, "flag double, x double"), ["flag", "x"], 32)
    assert got["flag"] == [0.0] and len(got["x"]) == 31
