import json

import pytest
from pyspark.sql import functions as F

from vectrail.sources import readers, sinks
from vectrail.streaming.registry import keep_latest, read_registry_stream


def test_gene_list_round_trip(spark, tmp_path):
    genes = ["A", "odd\nname", 'q"x', "B"]
    path = str(tmp_path / "genes.txt")
    sinks.write_gene_list(genes, path)
    assert [r.gene for r in readers.read_gene_list(spark, path).orderBy("pos").collect()] == genes
    (tmp_path / "old.txt").write_text("A\n\nB\n")
    assert [r.gene for r in readers.read_gene_list(spark, str(tmp_path / "old.txt")).orderBy("pos").collect()] == ["A", "B"]


def test_split_documents(spark, tmp_path):
    doc = {"split_family": "random_split", "track": "signature", "dataset_scope": "d", "seed": 1, "train_ids": ["a", "b"], "validation_ids": [], "test_ids": ["c"]}
    (tmp_path / "s1.json").write_text(json.dumps(doc, indent=1))
    got = readers.read_split_documents(spark, str(tmp_path)).collect()
    assert {(r.split_id, r.unit_id, r.part) for r in got} == {("s1", "a", "train"), ("s1", "b", "train"), ("s1", "c", "test")}
    back = sinks.split_documents(readers.read_split_documents(spark, str(tmp_path))).first()
    assert json.loads(back.document)["train_ids"] == ["a", "b"]


def test_csv_round_trip_and_optional(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "i int, s string")
    path = str(tmp_path / "t.csv")
    sinks.write_csv(df, path, single=True)
    assert sorted(readers.read_table(spark, path, "i int, s string").collect()) == sorted(df.collect())
    assert readers.read_optional(spark, str(tmp_path / "none.parquet"), "i int").count() == 0
    with pytest.raises(ValueError):
        readers.read_table(spark, str(tmp_path / "x.xls"))


def test_registry_has_one_schema(spark, tmp_path):
    path, cols = str(tmp_path / "reg"), {"run_id": "string", "status": "string", "extra": "int"}
    sinks.append_registry(spark.createDataFrame([("a", "ok")], "run_id string, status string"), path, cols)
    sinks.append_registry(spark.createDataFrame([("b", "ok", 3)], "run_id string, status string, extra int"), path, cols)
    assert {(r.run_id, r.extra) for r in spark.read.parquet(path).collect()} == {("a", None), ("b", 3)}


def test_gene_sets_and_columns(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"p": ["A", "B", "A"], "q": ["C"]}))
    assert readers.read_gene_sets(spark, str(tmp_path / "g.json")).count() == 3
    path = str(tmp_path / "t.parquet")
    sinks.write_parquet(spark.createDataFrame([(1, 2)], "a int, b int"), path)
    assert readers.read_columns(spark, path, ["b", "z"]).columns == ["b"]


def test_catalog(spark):
    cat = spark.createDataFrame([("d", "nan")], "dataset_id string, path string")
    assert readers.catalog_row(cat, "d") == {"dataset_id": "d", "path": None}
    with pytest.raises(KeyError):
        readers.catalog_row(cat, "e")


def test_reports(spark):
    df = spark.createDataFrame([("a_b", 0.5), (None, None)], "x string, y double")
    assert "| a_b | 0.5000 |" in sinks.markdown_table(df) and "a\\_b" in sinks.latex_table(df)
    with pytest.raises(ValueError):
        sinks.markdown_table(df, most=1)


def test_even_sample(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("g"))
    got = sorted(r.g for r in readers.even_sample(df, "g", 11).collect())
    assert got == [f"{int(i * 999 / 10):04d}" for i in range(11)]
    assert readers.even_sample(df.limit(5), "g", 11).count() == 5


def test_stream_keeps_latest(spark, tmp_path):
    src, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "run_id string, timestamp timestamp, status string"

    def put(rows):
        spark.createDataFrame(rows, "run_id string, t string, status string").select("run_id", F.to_timestamp("t").alias("timestamp"), "status").write.mode("append").parquet(src)

    put([("a", "2026-01-01 01:00:00", "failed"), ("b", "2026-01-01 01:00:00", "success")])
    keep_latest(read_registry_stream(spark, src, schema), out, str(tmp_path / "cp")).awaitTermination(120)
    put([("a", "2026-01-01 02:00:00", "cached"), ("b", "2026-01-01 00:30:00", "failed")])
    keep_latest(read_registry_stream(spark, src, schema), out, str(tmp_path / "cp")).awaitTermination(120)
    assert {(r.run_id, r.status) for r in spark.read.parquet(f"{out}/v=1").collect()} == {("a", "cached"), ("b", "success")}


def test_npz_round_trip(spark, tmp_path):
    import numpy as np

    from vectrail.sources.arrays import read_npz, write_npz, write_split_pickle

    rows = [(i, [float(i), i + 0.5, -1.0]) for i in range(2500)]
    df = spark.createDataFrame(rows, "i int, v array<float>").repartition(3)
    at = str(tmp_path / "one.npz")
    assert write_npz(df, at, "v", ["i"]) == (2500, 3)
    back = read_npz(spark, at).orderBy("row").collect()
    assert [r.vector for r in back] == [v for _, v in rows] and [r.row for r in back] == list(range(2500))
    np.savez(tmp_path / "two.npz", a=np.ones(4), b=np.zeros((0, 4)))
    assert read_npz(spark, str(tmp_path / "two.npz"), "a").first().vector == [1.0] * 4
    assert read_npz(spark, str(tmp_path / "two.npz"), "b").count() == 0
    for bad in (None, "c"):
        with pytest.raises(Exception, match="name one|no array"):
            read_npz(spark, str(tmp_path / "two.npz"), bad).collect()
    with pytest.raises(ValueError):
        write_npz(df, at, "v", ["i"], most=10)
    assert write_npz(df.limit(0), str(tmp_path / "none.npz"), "v", ["i"]) == (0, 0)
    write_split_pickle({"train": ["b", "a"]}, str(tmp_path / "s.pkl"))
    import pickle

    assert pickle.loads((tmp_path / "s.pkl").read_bytes()) == {"train": ["a", "b"], "val": [], "test": []}


def test_campaign_records_and_resumes(spark, tmp_path):
    from vectrail import runner

    at, seen = str(tmp_path / "registry"), []

    def work(job):
        seen.append(job["run_id"])
        if job["run_id"] == "b":
            raise ValueError("no such split")
        return 7

    log = runner.run_logger(str(tmp_path / "run.log"))
    jobs = [{"run_id": "c", "g": 2}, {"run_id": "b", "g": 1}, {"run_id": "a", "g": 1}, {"run_id": "d", "g": 3, "needs": ["no_such_package"]}]
    rows = {r["run_id"]: r for r in runner.campaign(spark, jobs, at, work, most=3, group="g", log=log)}
    assert seen == ["a", "b", "c"] and rows["a"]["status"] == "success" and rows["a"]["rows"] == 7
    assert rows["b"]["status"] == "failed" and "no such split" in rows["b"]["notes"]
    seen.clear()
    again = {r["run_id"]: r["status"] for r in runner.campaign(spark, jobs, at, work, group="g")}
    assert seen == ["b"] and again == {"b": "failed", "d": "blocked"}
    assert {r.run_id for r in runner.completed(spark, at).collect()} == {"a", "c"} and spark.read.parquet(at).count() == 5
    assert "a success" in (tmp_path / "run.log").read_text() and runner.run_logger(str(tmp_path / "run.log")) is log
    assert runner.progress_bar(3, 6, 4) == "[##..] 3/6" and runner.environment(["numpy", "no_such_package"])["no_such_package"] == "absent"
    assert runner.campaign(spark, [], at, work) == []


def test_command_line(spark, small, tmp_path, capsys):
    from vectrail import runner

    assert runner.main([]) == 0 and "slice_global_delta" in capsys.readouterr().out
    out, registry = str(tmp_path / "out"), str(tmp_path / "registry")
    assert runner.main(["s5_schema", small, out, "--registry", registry]) == 0
    assert spark.read.parquet(out).count() == spark.read.parquet(registry).first().rows
    with pytest.raises(SystemExit):
        runner.main(["no_such_query", small, out])
