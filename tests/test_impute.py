import random

from vectrail.operators.impute import Field, Plan, impute

SCHEMA = "id long, g string, h string, a double, b double, c string, z double, o_a string, _key int"
PLAN = Plan("id", [Field("a", ["g"]), Field("b", ["h"]), Field("c", ["h"], numeric=False)], ["z"])


def test_fills_within_groups_only(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, "g1", "h1", 0.5, 0.2, "x", 1.0, "", 0), (2, "g1", "h1", None, nan, " NA ", 2.0, "", 0), (3, "g1", "h1", inf, 7.0, None, None, "", 0),
        (4, "g2", "h2", None, None, "", 1.0, "", 0), (5, None, None, 0.1, 0.3, "y", 1.0, "", 0), (6, None, None, None, None, None, None, "", 0),
    ]
    got = {r.id: r for r in impute(spark.createDataFrame(rows, SCHEMA), PLAN).collect()}
    for i in (2, 3):
        assert (got[i].a, got[i].b, got[i].c) == (0.5, 0.2, "x") and got[i].a_filled and got[i].b_filled and got[i].c_filled
    assert got[4].a is None and got[4].c is None and not got[4].a_filled and not got[4].c_filled
    assert (got[6].a, got[6].b, got[6].c) == (0.1, 0.3, "y")
    assert not got[1].a_filled and not got[1].c_filled


def test_uses_other_fields_and_keeps_spread(spark):
    rnd = random.Random(2)
    rows, truth = [], {}
    for i in range(2000):
        z = rnd.gauss(0, 1)
        b = 0.3 + 0.1 * z
        a = 0.1 + 0.5 * (b - 0.3) + rnd.gauss(0, 0.005)
        truth[i] = a
        rows.append((i, f"g{i % 3}", f"h{i % 5}", None if i % 4 == 0 else a, b, "x" if z > 0 else "y", z, "", 0))
    got = {r.id: r for r in impute(spark.createDataFrame(rows, SCHEMA), PLAN).collect()}
    mean = sum(truth.values()) / len(truth)
    filled = [i for i in got if got[i].a_filled]
    assert len(filled) == 500
    fills = [got[i].a for i in filled]
    assert len(set(fills)) > 400
    cov = sum((got[i].a - mean) * (truth[i] - mean) for i in filled)
    assert cov > 0
    # What z and b explain is not drawn again: errors are those of two draws of the residual, a tenth of the spread.
    assert (sum((got[i].a - truth[i]) ** 2 for i in filled) / 500) ** 0.5 < 0.012
    again = {r.id: r.a for r in impute(spark.createDataFrame(rows, SCHEMA).repartition(3), PLAN).collect()}
    assert max(abs(again[i] - got[i].a) for i in got) < 1e-6


def test_classes_and_numbers_predict_each_other(spark):
    rnd = random.Random(4)
    rows, truth = [], {}
    for i in range(3000):
        c = rnd.choice("xy")
        a = (0.2 if c == "x" else 0.6) + rnd.gauss(0, 0.02)
        truth[i] = (a, c)
        gap = rnd.random()
        rows.append((i, "g", "h", None if gap < 0.2 else a, 0.0, None if 0.2 <= gap < 0.4 else c, 0.0, "", 0))
    got = {r.id: r for r in impute(spark.createDataFrame(rows, SCHEMA), PLAN).collect()}
    a_gaps = [i for i in got if got[i].a_filled]
    c_gaps = [i for i in got if got[i].c_filled]
    assert sum(abs(got[i].a - truth[i][0]) < 0.1 for i in a_gaps) > 0.98 * len(a_gaps)
    assert sum(got[i].c == truth[i][1] for i in c_gaps) > 0.98 * len(c_gaps)


def test_class_drawn_among_those_of_the_group(spark):
    rows = [(i, "g", "h" if i % 2 else "k", 0.1, 0.1, None if i % 7 == 0 else ("x" if i % 3 else "y") if i % 2 else "z", 1.0 * i, "", 0) for i in range(200)]
    for r in impute(spark.createDataFrame(rows, SCHEMA), PLAN).collect():
        assert r.c in (("x", "y") if r.id % 2 else ("z",)) and r.c_filled == (r.id % 7 == 0)


def test_empty(spark):
    assert impute(spark.createDataFrame([], SCHEMA), PLAN).count() == 0
