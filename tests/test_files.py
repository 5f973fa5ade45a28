import json

import pytest
from pyspark.sql import functions as F

from quillmesh.functions import models
from quillmesh.sources import files
from quillmesh.streaming import ingest


def test_questions(spark, tmp_path):
    data = [{"id": "1", "question": "q", "answer": "a", "context": [["T", ["s1", "s2"]], ["U", []]]}, {"id": "2", "question": "r", "answer": None, "context": []}]
    (tmp_path / "q.json").write_text(json.dumps(data))
    got = {r.id: r for r in files.read_questions(spark, str(tmp_path / "q.json")).collect()}
    assert [(p.title, p.sentences) for p in got["1"].context] == [("T", ["s1", "s2"]), ("U", [])]
    assert got["2"].context == [] and got["2"].answer is None


def test_tolerant_scores(spark, tmp_path):
    for name, body in (("main/d/m/l", '{"em": 50, "f1": 60.5}'), ("main/d/n/l", "{broken"), ("main/d/o/l", "{}")):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "score.json").write_text(body)
    got = sorted(tuple(r) for r in files.read_scores(spark, str(tmp_path)).collect())
    assert got == [("main", "d", "m", "l", 50.0, 60.5), ("main", "d", "o", "l", None, None)]
    assert files.read_scores(spark, str(tmp_path / "none")).isEmpty()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "t", "failed", True, 0, "x"), (2, None, "ok", False, 3, "y")], "chunk_id int, title string, status string, is_table boolean, n_events int, raw string")
    files.write_results(df, str(tmp_path / "r"))
    assert "raw" not in spark.read.json(str(tmp_path / "r")).columns
    files.write_report(files.extraction_report(df), str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == [": 3 events", "[FAILED] [TABLE] t: 0 events"]
    files.write_graph(str(tmp_path), entity=df)
    assert spark.read.parquet(str(tmp_path / "entity.parquet")).count() == 2
    assert files.markdown(df.select("chunk_id", "title").orderBy("chunk_id")) == "| chunk_id | title |\n|---|---|\n| 1 | t |\n| 2 | -- |\n"
    with pytest.raises(ValueError):
        files.markdown(df, most=1)


def test_models(spark):
    df = spark.createDataFrame([(1, "ab"), (2, None)], "id int, text string")
    got = {r.id: list(r.v) for r in df.select("id", models.encode(F.col("text"), lambda: lambda ts: [[len(t), 1.0] for t in ts]).alias("v")).collect()}
    assert got == {1: [2.0, 1.0], 2: [0.0, 1.0]}

    def load():
        def model(p):
            if p == "bad":
                raise RuntimeError
            return p.upper()

        return model

    asked = spark.createDataFrame([("x",), ("bad",), (None,)], "prompt string")
    assert sorted((r.prompt or "", r.raw) for r in models.ask(asked, "prompt", load).collect()) == [("", None), ("bad", None), ("x", "X")]


def test_stream(spark, tmp_path):
    schema = "id int, at timestamp, kind string"
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = [(i % 50, f"2024-01-{1 + i % 20:02d} 10:00:00", "ab"[i % 2]) for i in range(100)] + [(900, None, "a")]
    spark.createDataFrame(rows, "id int, at string, kind string").selectExpr("id", "cast(at as timestamp) at", "kind").repartition(3).write.parquet(src)
    once = lambda: ingest.write_available(ingest.first_arrivals(ingest.read_stream(spark, src, schema), "id", "at", "60 days"), out, state).awaitTermination()
    once()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(50), 900]
    spark.createDataFrame([(7, "2024-01-21 00:00:00", "a"), (70, "2024-01-22 00:00:00", "a")], "id int, at string, kind string").selectExpr("id", "cast(at as timestamp) at", "kind").write.mode("append").parquet(src)
    once()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [*range(50), 70, 900]
    counts = ingest.counts_by_window(ingest.read_stream(spark, src, schema), "at", "kind", "1 day", "1 day")
    ingest.write_available(counts, out + "2", state + "2").awaitTermination()
    assert spark.read.parquet(out + "2").agg(F.sum("n")).first()[0] >= 80
