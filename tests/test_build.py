from pyspark.sql import functions as F

from quillmesh.functions import models
from quillmesh.operators import build as B
from quillmesh.operators import evaluation as E
from quillmesh.operators import retrieval as R
from quillmesh.sources import files


def letters(text):
    v = [0.0] * 27
    for c in text.lower():
        v[ord(c) - 97 if "a" <= c <= "z" else 26] += 1
    return v


def test_build_graph(spark):
    data = [(1, "r one", [("Ann Lee", "person", "singer"), ("Ann Leee", "person", "singer"), ("Ulm", "city", "town")], "Ulm", 1), (2, "r two", [("ULM (location)", None, None)], "Other", 1), (3, "r two", [("X", None, None)], None, 2)]
    df = spark.createDataFrame(data, "rel_id bigint, relation string, entities array<struct<name:string,attribute:string,definition:string>>, source_title string, chunk_id bigint")

    def load():  # defined here, so that the workers need not import this file
        abc = "abcdefghijklmnopqrstuvwxyz"
        return lambda ts: [[float(t.lower().count(c)) for c in abc] + [1.0 + sum(c not in abc for c in t.lower())] for t in ts]

    g = B.build_graph(df, lambda c: models.encode(c, load), 0.97)
    ents = {r.canonical: r for r in g["entity"].collect()}
    assert set(ents) == {"ann lee", "ann leee", "ulm", "other"} and ents["other"].attribute is None and ents["ulm"].attribute == "city"
    names = {r.ent_id: k for k, r in ents.items()}
    assert {tuple(sorted((names[r.a], names[r.b]))) for r in g["synonym"].collect()} == {("ann lee", "ann leee")}
    assert sorted((r.rel_id, names[r.ent_id], r.is_title_edge) for r in g["incidence"].collect()) == [(1, "ann lee", False), (1, "ann leee", False), (1, "ulm", False), (2, "other", True), (2, "ulm", False)]
    assert {r.rel_id: r.text for r in g["relation"].collect()} == {1: "(Ulm) r one", 2: "(Other) r two"}


def test_similar_pairs_in_blocks(spark, monkeypatch):
    rows = [(i, letters("abc" * (i % 5) + "xyz" * (i % 7)), letters("q" * (1 + i % 3) + "w")) for i in range(1, 60)] + [(99, None, None), (100, [0.0] * 27, [0.0] * 27), (101, [1.0], [1.0])]
    df = spark.createDataFrame(rows, "doc_id bigint, vec array<float>, name_vec array<float>")
    whole = sorted(map(tuple, R.similar_pairs(df, 0.9).collect()))
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    assert sorted(map(tuple, R.similar_pairs(df, 0.9).collect())) == whole and whole
    assert R.similar_pairs(df.limit(0), 0.9).isEmpty()


def test_extraction_rules(spark, rows):
    df = spark.createDataFrame([([(" A ", "d "), ("B", " "), (None, "x")],), (None,)], "e array<struct<name:string,definition:string>>")
    assert [r[0] for r in df.select(B.usable_entities(F.col("e"))).collect()] == [[("A", "d")], []]
    counts = spark.createDataFrame([(2, None, "ok"), (0, 3, "retry_ok"), (None, 1, "retry_ok"), (0, 0, "empty"), (None, 0, "empty"), (None, None, "failed")], "a int, b int, want string")
    assert counts.where(B.extraction_status(F.col("a"), F.col("b")) != F.col("want")).isEmpty()
    facts = spark.createDataFrame([(1, 0, ["A", "Z", None]), (1, 1, [])], "chunk_id int, fact_no int, names array<string>")
    refined = spark.createDataFrame([(1, 0, "A", "person", "d"), (1, 1, "A", "city", "e")], "chunk_id int, place int, name string, attribute string, definition string")
    assert rows(B.attach_refined(facts, refined)) == [(1, 0, 0, "A", "person", "d"), (1, 0, 1, "Z", "other", "")]


def test_anchors(spark, rows):
    slots = spark.createDataFrame([(1, "a", "Ulm", False), (1, "x", "y", True), (2, "b", "Bonn", False)], "question_id bigint, slot_key string, name string, virtual boolean")
    start = spark.createDataFrame([(1, 10), (1, 11), (2, 11)], "question_id bigint, ent_id bigint")
    ents = spark.createDataFrame([(10, "ULM"), (11, "Graz")], "ent_id bigint, display string")
    got = B.anchor_bindings(slots, start, ents)
    assert rows(got) == [(1, "a", 10), (2, "__all__", 11)]
    syn = spark.createDataFrame([(12, 10, 0.9)], "a bigint, b bigint, similarity double")
    assert rows(B.locate_anchors(got, syn)) == [(1, "a", 10), (1, "a", 12), (2, "__all__", 11)]
    subq = spark.createDataFrame([(1, 1, 0, "x", "person", True), (1, 0, 1, "x", "person", True), (1, 0, 0, "U", "", False)], "question_id int, qid int, slot int, name string, attribute string, virtual boolean")
    assert rows(B.virtual_keys(subq), "slot_key", "attribute", "place") == [("person x", "person", (0, 1))]


def test_texts(spark):
    df = spark.createDataFrame([("T", "x", ["a"], ["r", "s"]), (None, None, None, None)], "t string, x string, c array<string>, r array<string>")
    got = [tuple(r) for r in df.select(B.extraction_prompt(F.col("t"), F.col("x"), F.col("c")), B.listing(F.col("r"))).collect()]
    assert got == [('Title: "T"\nText: "x"\nCandidates: ["a"]', "1. r\n2. s"), ('Text: ""', None)]


def test_judges_timing_grid(spark, tmp_path):
    raw = spark.createDataFrame([('x {"score": 0.5} {"score": 1}',), ('{"a": {"score": 0.25}}',), ('{"score": "high"}',), ("none",), (None,)], "raw string")
    assert [r[0] for r in raw.select(E.judge_score(F.col("raw"), "score")).collect()] == [0.5, 0.25, None, None, None]
    ms = spark.createDataFrame([(1000.0,), (2001.0,), (None,)], "retrieve_total_ms double")
    assert tuple(E.timing_summary(ms).first()) == (3, 1.501) or tuple(E.timing_summary(ms).first()) == (3, 1.5)
    assert E.config_grid(spark, k=[1, 2, 2], t=["a", "b"]).count() == 4
    path = str(tmp_path / "p")
    assert files.read_or_default(spark, path, "a int", [(1,)]).count() == 1 and spark.read.json(path).count() == 1
    wide = spark.createDataFrame([("d", 1.0, 2.0)], "dataset string, x double, y double")
    assert E.unpivot(wide, ["dataset"], ["x", "y"]).count() == 2
