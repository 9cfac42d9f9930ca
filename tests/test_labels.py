import pytest
from pyspark.sql import functions as F

from vectrail.functions.labels import (
    canonical_targets, components, dataset_key, is_combination, normalize_label, reference_key, one_slip, spelling_repairs, targets,
)


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("r")).first()[0]


@pytest.mark.parametrize(
    "label, want",
    [("A_B", True), ("ATF6_PERK_IRE1_pMJ158", True), ("ATF6_only_pMJ145", False), ("ZAP70_1", False), ("Tcrlibrary_NFKB1_1", False),
     ("MULTI_TARGET", False), ("A+B", True), ("A;B", True), ("nan", False), (None, False), ("A", False), ("", False)],
)
def test_combination(spark, label, want):
    assert one(spark, is_combination, label) is want


@pytest.mark.parametrize("label, want", [("A_B", ["A", "B"]), ("ZAP70_1", ["ZAP70", "1"]), ("A", []), ("control", []), (None, []), ("_A_", ["A"])])
def test_components(spark, label, want):
    assert one(spark, components, label) == want


@pytest.mark.parametrize("value, want", [(" b1 ", "b1"), ("NaN", None), ("<NA>", None), ("", None), (None, None), ("0", "0")])
def test_normalize(spark, value, want):
    assert one(spark, normalize_label, value) == want


@pytest.mark.parametrize("value, want", [("Foo2031-jl6", "foo2031jl6"), (" FOO2031__JL06.h5ad ", "foo2031jl6"), ("Foo2031_jl7", "foo2031jl7"), ("--", None), (None, None)])
def test_dataset_key(spark, value, want):
    assert one(spark, dataset_key, value) == want


@pytest.mark.parametrize("value, want", [("Kp Rep 09 Rest", "kp-rep-9-rest"), ("kp.rep9.rest", "kp-rep-9-rest"), ("nan", None), (None, None)])
def test_reference_key(spark, value, want):
    assert one(spark, reference_key, value) == want


@pytest.mark.parametrize(
    "label, want",
    [("GATU2_ctrl", {("gatu", "2")}), ('"GATU-2", pelo.3', {("gatu", "2"), ("pelo", "3")}), ("sgRNA_GATU2_pMJ101_only", {("gatu", "2")}),
     ("GATU2_1", {("gatu", "2")}), ("GATU02", {("gatu", "2")}), ("ＧATU2＋PELO3", {("gatu", "2"), ("pelo", "3")}), ("control", set()), ("", set())],
)
def test_targets(spark, label, want):
    assert {(t.stem, t.num) for t in one(spark, targets, label)} == want


def test_repairs(spark):
    stems = [("dosuroko", 40), ("dosurko", 1), ("dosuorko", 1), ("dosurokoo", 1), ("dosuriko", 3), ("pelobuna", 40), ("abc", 1), ("abd", 9), ("ab", 1), ("h2ax", 9), ("h3ax", 1), ("dosuroka", 20)]
    got = {r.stem: r.repaired for r in spelling_repairs(spark.createDataFrame(stems, "stem string, n long")).collect()}
    assert got == {"dosurko": "dosuroko", "dosuorko": "dosuroko", "dosurokoo": "dosuroko", "dosuriko": "dosuroko", "abc": "abd"}


def test_canonical_targets(spark):
    labels = [("DOSUROKO1_PELOBUNA2", 9), ("pelobuna2; dosurko-1", 1), ("DOSUROKO2", 9), ("control", 5)]
    got = {r.label: r.names for r in canonical_targets(spark.createDataFrame(labels, "label string, n long")).collect()}
    assert got["DOSUROKO1_PELOBUNA2"] == got["pelobuna2; dosurko-1"] == ["dosuroko1", "pelobuna2"]
    assert got["DOSUROKO2"] == ["dosuroko2"] and "control" not in got


def test_one_slip(spark):
    rows = [("abcd", "abcd", True), ("abcd", "abd", True), ("abcd", "abcdd", True), ("abcd", "abxd", True), ("abcd", "acbd", True), ("abcd", "bacd", True), ("abcd", "abdc", True),
            ("abcd", "dbca", False), ("abcd", "badc", False), ("abcd", "ab", False), ("a1b", "a2b", False), ("", "a", True), ("x" * 30000 + "ab", "x" * 30000 + "ba", True), (None, "a", None)]
    got = spark.createDataFrame(rows, "x string, y string, want boolean").withColumn("got", one_slip("x", "y")).collect()
    assert [r.got for r in got] == [r.want for r in got]
