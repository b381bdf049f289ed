"""Sources, sinks and streaming forms on temporary files."""

import json
import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cohortloom.session import materialise
from cohortloom.sources import logs, sinks
from cohortloom.streaming import attempt_log


def test_jsonl(spark, tmp_path):
    assert logs.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a int").isEmpty()
    with pytest.raises(FileNotFoundError):
        logs.read_jsonl_strict(spark, str(tmp_path / "none.jsonl"), "a int")
    p = tmp_path / "x.jsonl"
    p.write_text('{"a":1}\n\n{"a":2}\n')
    assert logs.read_jsonl(spark, str(p), "a int").count() == 2
    p.write_text('{"a":1}\n{"a":\n{"a":3}\n')
    assert [r.line for r in logs.bad_lines(spark, str(p), "a int").collect()] == ['{"a":']


def test_torn_log(spark, tmp_path):
    p = tmp_path / "log.jsonl"
    p.write_text('{"a":1}\n{"a":')
    rows, torn = logs.read_torn_log(spark, str(p), "a int")
    assert [r.a for r in rows.collect()] == [1] and [r.value for r in torn.collect()] == ['{"a":']
    p.write_text('{"a":\n{"a":2}\n')
    with pytest.raises(ValueError):
        logs.read_torn_log(spark, str(p), "a int")


def test_dictionary(spark, tmp_path):
    p = tmp_path / "d.csv"
    p.write_text("itemid,label\n1,Sodium\n2, \n")
    d = logs.read_csv(spark, str(p), "itemid int, label string")
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "itemid int, label string")
    got = {r.itemid: r.label for r in logs.with_dictionary(rows, d, "itemid", "label", F.lit("lab")).collect()}
    assert got == {1: "Sodium", 2: "lab", 3: "lab"}
    with pytest.raises(ValueError):
        logs.with_dictionary(rows, d.unionByName(d), "itemid", "label", F.lit("lab"))


def test_snapshots_and_listings(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    before = materialise(logs.snapshot(spark, str(tmp_path)))
    (tmp_path / "a.txt").write_text("two")
    (tmp_path / "b.txt").write_text("x")
    assert sorted(r.state for r in logs.changed(before, logs.snapshot(spark, str(tmp_path))).collect()) == ["added", "changed"]
    files = spark.createDataFrame([("x/A.jpg",), ("x/a.json",), ("x/b.jpg",), ("x/c.jpg",), ("x/C.JPG",), ("x/c.json",)], "path string")
    assert {r.stem: r.state for r in logs.paired_files(files, "path", ["jpg"], ["json"]).collect()} == {"x/a": "paired", "x/b": "unpaired", "x/c": "ambiguous"}
    c = spark.createDataFrame([(1, ["q", "x/b.jpg", "x/A.jpg"]), (2, ["q"])], "id long, paths array<string>")
    assert [(r.id, r.path) for r in logs.first_existing(c, "id", files).collect()] == [(1, "x/b.jpg")]
    j = spark.createDataFrame([('{"Subject_ID": 5}',), ("no",)], "j string").select(logs.flat_fields(F.col("j")).alias("m")).collect()
    assert j[0].m == {"subject_id": "5"} and not j[1].m


def test_arrays(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(struct.pack("<6f", *range(6)))
    assert [list(r.vector) for r in logs.read_arrays(spark, str(tmp_path), 3).orderBy("row").collect()] == [[0, 1, 2], [3, 4, 5]]


def test_sinks(spark, tmp_path):
    sinks.write_document(str(tmp_path / "d.json"), sinks.finite_or_null({"a": float("nan"), "b": [1.0, float("inf")]}))
    assert json.loads((tmp_path / "d.json").read_text()) == {"a": None, "b": [1.0, None]}
    with pytest.raises(ValueError):
        sinks.write_document(str(tmp_path / "d.json"), {"a": float("nan")})
    assert json.loads((tmp_path / "d.json").read_text())["a"] is None
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    sinks.write_once(df, str(tmp_path / "t"))
    with pytest.raises(AnalysisException):
        sinks.write_once(df, str(tmp_path / "t"))
    one = sinks.freeze(spark, df, ["a", "b"], str(tmp_path / "f.json"))
    assert sinks.freeze(spark, df.repartition(3), ["a", "b"], str(tmp_path / "f.json")) == one
    with pytest.raises(ValueError):
        sinks.freeze(spark, df.limit(1), ["a", "b"], str(tmp_path / "f.json"))
    assert not sinks.write_csv([df.limit(0)], str(tmp_path / "c"))
    assert sinks.write_csv([df, spark.createDataFrame([(3, 4)], "a int, z int")], str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["a", "b", "z"]
    sinks.append_log(df, str(tmp_path / "l"))
    sinks.append_log(df, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).count() == 4
    assert sinks.resumed(df, df.unionByName(spark.createDataFrame([(3, "n")], "a int, b string")), ["a"]).count() == 3


def test_streaming(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "y")], "id long, key string, v string")
    df.coalesce(1).write.parquet(str(src))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(src))
    for n in (2, 3):
        q = attempt_log.append_pending(spark, read(), str(tmp_path / "log"), ["key"], str(tmp_path / "ck"))
        q.awaitTermination(60)
        assert q.exception() is None
        assert spark.read.parquet(str(tmp_path / "log")).count() == n
        if n == 2:
            df.where("id = 1").unionByName(spark.createDataFrame([(4, "c", "z")], df.schema)).coalesce(1).write.mode("append").parquet(str(src))
    timed = df.withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    timed.coalesce(1).write.parquet(str(tmp_path / "timed"))
    stream = attempt_log.first_deliveries(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "timed")), ["key"], "at", "1 hour")
    q = stream.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("firsts").count() == 2
    counts = attempt_log.windowed_counts(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "timed")), "at", ["key"])
    q = counts.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.key, r.n) for r in spark.table("counts").collect()) == [("a", 2), ("b", 1)]


def test_first_deliveries_keep_null_keys(spark, tmp_path):
    rows = [(1, "s", "c", None), (2, "s", "c", None), (3, "s", None, "c"), (4, "s", "c", "x"), (5, " S", "C", "x "), (6, None, None, None), (7, None, None, None), (8, "s", "c\u0001x", ""), (9, "s", "c", "\u0001x")]
    df = spark.createDataFrame(rows, "delivery_id long, sample_id string, condition string, context_signature string").withColumn("at", F.to_timestamp(F.lit("2024-01-01")))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = attempt_log.first_deliveries(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["sample_id", "condition", "context_signature"], "at", "1 hour")
    q = stream.writeStream.format("memory").queryName("null_keys").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert q.exception() is None and stream.columns == df.columns
    kept = sorted(r.delivery_id for r in spark.table("null_keys").collect())
    assert len(kept) == 8 and len({4, 5} & set(kept)) == 1
