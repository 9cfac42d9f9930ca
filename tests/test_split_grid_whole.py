from pyspark.sql import functions as F

from vectrail.operators.campaign import FAMILIES, split_grid, split_records
from vectrail.plans import QUERIES


def test_every_dataset_and_seed(spark, small):
    rows = QUERIES["d15_split_grid"](spark, small).groupBy("split_id").count().collect()
    names, seeds = [f"ds{i}" for i in range(4)], range(3)
    want = {f"{f}__{d}__seed{s}" for f in FAMILIES for d in names for s in seeds}
    want |= {f"dataset_heldout_split__all_datasets__holdout-{d}__seed{s}" for d in names for s in seeds}
    got = {r.split_id for r in rows}
    assert want <= got and all(x.startswith("external_holdout__") for x in got - want) and len(got - want) == 3


def test_external_state_and_records(spark):
    rows = [(f"s{i}", f"d{i % 3}", f"P{i % 5}" if i % 4 else "control", i % 4 == 0, i, f"t{i % 2}") for i in range(120)]
    u = spark.createDataFrame(rows, "signature_id string, dataset_id string, perturbation_label string, is_control boolean, n_cells int, state string")
    grid = split_grid(u, [0], state="state", external="d2", families=["unseen_cell_state_split", "external_holdout", "unseen_combination_split"]).cache()
    held = {r.signature_id for r in grid.where("split_family = 'external_holdout' AND part = 'test'").collect()}
    assert held == {r[0] for r in rows if r[1] == "d2"}
    states = grid.where("split_family = 'unseen_cell_state_split' AND part = 'test'").join(u, "signature_id").groupBy("scope").agg(F.countDistinct("state").alias("k"), F.count_if("is_control").alias("c"))
    assert {r.k for r in states.collect()} == {1}
    asked = grid.select("split_id", "split_family", "scope", "seed", "heldout_target").distinct()
    asked = asked.unionByName(spark.createDataFrame([("none", "random_split", "d9", 0, "")], asked.schema))
    got = {r.split_id: (r.status, r.reason) for r in split_records(grid, asked).collect()}
    assert got["none"][0] == "unsupported" and got["unseen_combination_split__d0__seed0"] == ("unsupported", "test mask selects no rows")
    assert got["external_holdout__internal_vs_external__holdout-d2__seed0"] == ("ready", "")
