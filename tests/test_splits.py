from pyspark.sql import functions as F

from vectrail.operators import splits
from vectrail.operators.relational import purity


def frame(spark, n=100):
    rows = [(f"s{i}", f"P{i % 10}" if i % 12 else "control", i % 12 == 0, 5 + i % 40, f"d{i % 2}") for i in range(n)]
    return spark.createDataFrame(rows, "signature_id string, label string, is_control boolean, n_cells int, dataset_id string")


def counts(df, *keys):
    return {tuple(r[k] for k in keys) + (r.part,): r["count"] for r in df.groupBy(*keys, "part").count().collect()}


def test_random_sizes(spark):
    c = counts(splits.random_part(frame(spark), "signature_id", 0))
    assert c == {("test",): 15, ("validation",): 15, ("train",): 70}
    assert counts(splits.random_part(frame(spark, 2), "signature_id", 0)) == {("train",): 2}


def test_seed_changes_order_and_repeats(spark):
    f = frame(spark)
    one, two, again = (splits.random_part(x, "signature_id", s).orderBy("signature_id").select("part").collect() for x, s in ((f, 0), (f, 1), (f.repartition(7), 0)))
    assert one == again and one != two


def test_unseen_labels_stay_unseen(spark):
    got = splits.unseen_label_parts(frame(spark), "signature_id", "label", 0).cache()
    test = {r.label for r in got.where("part = 'test'").collect()}
    train = {r.label for r in got.where("part <> 'test' AND NOT is_control").collect()}
    assert len(test) == 2 and not test & train and got.where("part = 'test' AND is_control").count() == 0
    assert got.count() == 100 and got.where("part = 'unused'").count() > 0


def test_low_support(spark):
    got = splits.low_support_parts(frame(spark), "signature_id", "n_cells", 0, ["dataset_id"])
    low = got.groupBy("dataset_id").agg(F.max(F.when(F.col("part") == "test", F.col("n_cells"))).alias("a"), F.min(F.when((F.col("part") != "test") & ~F.col("is_control"), F.col("n_cells"))).alias("b"))
    assert all(r.a < r.b for r in low.collect())


def test_null_held_flag_is_not_held(spark):
    f = frame(spark).withColumn("label", F.when(F.col("label") != "P1", F.col("label")))
    got = splits.combination_parts(f, "signature_id", "label", 0)
    assert got.where("part = 'test'").count() == 0 and got.count() == 100


def test_states(spark):
    rows = [(f"g{i % 9}", "up" if i % 9 < 5 else "down", None) for i in range(90)] + [("g0", "down", None)]
    found, column = splits.state_labels(spark.createDataFrame(rows, "g string, b string, a string"), "g", ["a", "b"])
    assert column == "b" and found.count() == 9
    assert purity(spark.createDataFrame(rows, "g string, b string, a string"), "g", "b").where("g = 'g0' AND b = 'up'").first().purity == 10 / 11


def test_record_marks_unsupported():
    r = splits.record("dataset_heldout_split", "signature", "cross_dataset", 0, "a/b", "too few")
    assert r["status"] == "unsupported" and "/" not in r["split_id"]
