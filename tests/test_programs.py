"""The programs over tables of one's own, and the reports."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh import programs as P
from quillmesh.config import RetrievalConfig
from quillmesh.functions import models
from quillmesh.operators import graph as G
from quillmesh.operators import reports as R


def plain_pagerank(edges, anchors, extra, alpha=0.5, tolerance=1e-6):
    nodes = sorted({x for u, v, _ in edges for x in (u, v)} | extra)
    at = {v: i for i, v in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for u, v, w in edges:
        m[at[v], at[u]] += w
        m[at[u], at[v]] += w
    out = m.sum(axis=0)
    m = np.divide(m, out, where=out > 0, out=np.zeros_like(m))
    p = np.zeros(len(nodes))
    for v, w in anchors:
        p[at[v]] += w
    p /= p.sum()
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(200):
        new = alpha * (m @ x + x[out == 0].sum() * p) + (1 - alpha) * p
        if np.abs(new - x).sum() < len(nodes) * tolerance:
            return dict(zip(nodes, new))
        x = new
    return {}


@pytest.mark.parametrize("seed", range(3))
def test_pagerank_of_many_questions(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(-1 - rng.randrange(40), rng.choice([1, rng.randrange(15)])): rng.choice([1.0, 2.0]) for _ in range(90)}.items())
    edges = [(u, v, w) for (u, v), w in edges] + [(2, 3, 0.9)]
    anchors = [(q, v, rng.uniform(0.1, 1)) for q in range(4) for v in rng.sample(range(15), 2)] + [(5, 99, 1.0), (6, 99, 0.5), (6, 1, 0.5), (7, 1, 0.0)]
    got = {}
    for r in G.pagerank_top(spark.createDataFrame(edges, "u bigint, v bigint, w double"), spark.createDataFrame(anchors, "question_id bigint, vertex bigint, weight double"), 5).collect():
        got.setdefault(r.question_id, []).append((r["rank"], r.vertex, r.score))
    extra = {v for _, v, w in anchors if w > 0}
    for q in {q for q, _, w in anchors if w > 0}:
        x = plain_pagerank(edges, [(v, w) for k, v, w in anchors if k == q and w > 0], extra)
        want = sorted(((round(-s, 12), -v) for v, s in x.items() if v < 0))[:5]
        assert [v for _, v, _ in sorted(got[q])] == [-v for _, v in want]
        assert all(abs(s + a) < 1e-9 for (_, _, s), (a, _) in zip(sorted(got[q]), want))
    assert 7 not in got


@pytest.fixture(scope="module")
def world(spark):
    vec = lambda *x: [float(v) for v in x]
    ents = [(1, "Ann Lee", "Ann Lee: a painter", "person", vec(1, 0, 0), vec(1, 0, 0)), (2, "Wyk", "Wyk: a town", "city", vec(0, 1, 0), vec(0, 1, 0)), (3, "Esk", "Esk: a river", "place", vec(0, 0, 1), vec(0, 0, 1))]
    rels = [(10, "(T) Ann Lee was born in Wyk", "Ann Lee was born in Wyk", "T", 100, vec(0.7, 0.7, 0)), (11, "(T) Wyk lies on the Esk", "Wyk lies on the Esk", "T", 101, vec(0, 0.7, 0.7)), (12, "(U) Esk is long", "Esk is long", "U", 102, vec(0, 0, 1))]
    inc = [(10, 1, False), (10, 2, False), (11, 2, False), (11, 3, False), (12, 3, False)]
    store = P.Store(
        spark.createDataFrame(ents, "ent_id bigint, display string, text string, attribute string, vec array<double>, name_vec array<double>"),
        spark.createDataFrame(rels, "rel_id bigint, text string, index_text string, source_title string, chunk_id bigint, vec array<double>"),
        spark.createDataFrame(inc, "rel_id bigint, ent_id bigint, is_title_edge boolean"),
        spark.createDataFrame([], "a bigint, b bigint, similarity double"),
    )
    question = [(1, "On which river lies the town where Ann Lee was born?", vec(0.6, 0.6, 0.5)), (2, "Which river is long?", vec(0, 0, 1)), (3, "??", vec(0, 1, 0))]
    subq = [(1, 0, "Ann Lee was born in town x", vec(0.7, 0.7, 0)), (1, 1, "town x lies on river y", vec(0, 0.7, 0.7)), (2, 0, "river y is long", vec(0, 0, 1)), (3, 0, "??", vec(0, 1, 0))]
    slots = [(1, 0, 0, "Ann Lee", "Ann Lee", "person", False, "person Ann Lee", vec(1, 0, 0)), (1, 0, 1, "city x", "x", "city", True, "city x", vec(0, 1, 0)), (1, 1, 0, "city x", "x", "city", True, "city x", vec(0, 1, 0)), (1, 1, 1, "place y", "y", "place", True, "place y", vec(0, 0, 1)), (2, 0, 0, "place y", "y", "place", True, "place y", vec(0, 0, 1)), (3, 0, 0, "??", "??", "", False, "??", vec(0, 1, 0))]
    asked = P.Asked(
        spark.createDataFrame(question, "question_id bigint, text string, vec array<double>"),
        spark.createDataFrame(subq, "question_id bigint, qid bigint, text string, vec array<double>"),
        spark.createDataFrame(slots, "question_id bigint, qid bigint, slot int, slot_key string, name string, attribute string, virtual boolean, embed_text string, vec array<double>"),
    )
    return store, asked, P.prepare(store, asked)


@pytest.mark.parametrize("engine", ["iterative", "anchored"])
def test_retrieve(world, engine):
    store, asked, ready = world
    got = {r.question_id: r for r in P.retrieve(store, asked, engine=engine, prepared=ready).collect()}
    assert "(T) Ann Lee was born in Wyk (T) Wyk lies on the Esk" in got[1].context and got[1].fallback == "no" and got[1].n_paths > 0
    assert got[2].fallback == "no_anchor_direct_search" and got[2].context.split("\n\n")[0] == "(U) Esk is long" and got[2].n_paths == 0
    assert got[3].fallback == "no_ke1" and got[3].context == "" and len(got) == 3


def test_retrieve_by_pagerank_and_chunks(spark, world):
    store, asked, ready = world
    got = {r.question_id: r for r in P.retrieve(store, asked, RetrievalConfig(pagerank_top=2), engine="pagerank").collect()}
    assert all(r.context.count("\n") == 1 for r in got.values()) and len(got) == 3
    texts = spark.createDataFrame([(100, "Passage one."), (101, "Passage two."), (102, "")], "chunk bigint, text string")
    got = {r.question_id: r.context for r in P.retrieve(store, asked, mode="chunk", prepared=ready, chunks=texts).collect()}
    assert got[1].startswith("Passage one.\n\nPassage two.")


def test_answers_are_asked_for_twice(spark, world):
    def load():
        return lambda prompt, think: (None, 3) if think and "river" in prompt else ("Answer: Esk", 5)

    rows = spark.createDataFrame([(1, "c", 1, "no"), (2, "", 0, "yes_empty")], "question_id bigint, context string, n_paths int, fallback string")
    q = spark.createDataFrame([(1, "Which river?", "esk"), (2, "Where?", "x")], "question_id bigint, question string, gold string")
    got = {r.question_id: r for r in P.answer(rows, q, load).collect()}
    assert (got[1].pred, got[1].em, got[1].tokens) == ("Esk", 1, 8) and (got[2].error, got[2].tokens) == ("no_context", 0)


def test_extraction_programs(spark):
    chunks = spark.createDataFrame([(1, "T", "one"), (2, None, "two"), (3, "T", "three"), (4, "T", None)], "chunk_id bigint, title string, text string")

    def load():
        def say(prompt):
            if "one" in prompt or "two" in prompt and "simple" in prompt:
                return 'so: {"events": [{"relation": "r", "entities": []}]}'
            if "three" in prompt:
                raise RuntimeError
            return '{"events": []}'

        return say

    got = {r.chunk_id: r for r in P.extract(chunks, load, lambda t: F.concat(F.lit("simple "), t)).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "retry_ok", 3: "failed", 4: "empty"} and got[2].payload and not got[3].payload
    two = P.extract_refined(
        chunks.where("chunk_id < 3"),
        lambda: lambda texts: [t.split() for t in texts],
        lambda: lambda prompt: json.dumps([{"name": "one", "attribute": "number", "definition": "d"}]) if "one" in prompt else "none",
        lambda: lambda prompt: json.dumps([{"relation": "r", "entities": ["one"]}]),
    )
    rows = {r.chunk_id: r for r in two.collect()}
    assert rows[1].refined[0].attribute == "number" and rows[1].events[0].entities == ["one"] and rows[2].refined is None and rows[2].names == ["two"]


def test_encoder_batches_and_unit_vectors(spark):
    df = spark.createDataFrame([("a",), (None,), ("bb",)], "t string")
    sizes = df.coalesce(1).select(models.encode(F.col("t"), lambda: lambda texts: [[len(t) * 1.0, 0.0, len(texts)] for t in texts], batch=2, unit=True).alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-6 for r in sizes) and sizes[2].v[0] > 0.8


def test_reports(spark, tmp_path):
    def put(path, value):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(value if isinstance(value, str) else json.dumps(value))

    put("main_table/d1/m1/big/score.json", {"em": 50, "f1": 60.25})
    put("main_table/d2/m1/big/score.json", {"em": 40, "f1": 50})
    put("main_table/d2/m2/big/score.json", "{broken")
    put("ablation/d1/full/big/score.json", {"em": 1, "f1": 2})
    put("ablation/d1/full/small/score.json", {"em": 9, "f1": 9})
    put("efficiency/d1/m1/timing.json", {"retrieve_sec_per_q": 1.234, "tokens_per_q": {"total_tokens": 99.6}})
    put("kg_stats/d1/kg_stats.json", {"build_time_min": 3})
    put("appendix_B_embedding/d1/embedding_probe.json", {"by_strategy": {"name": {"syn_recall": 90, "f1": 80}}})
    put("appendix_C_sensitivity/d1/k/5/score.json", {"em": 7, "f1": 8})
    put("appendix_E_failures/d1/failures.json", {"distribution_fraction": {"annotation_noise": 0.5}})
    put("appendix_G_cot/d1/first/score.json", {"em": 3, "f1": 4})
    put("appendix_H_ner/d1/g/ner_stats.json", {"recall": 70, "over_extract": 5})
    put("appendix_I_ragas/d1/m1/ragas.json", {"faithfulness_mean": 0.75})
    at = R.Layout(("d1", "d2"), ("m1", "m2"), ("big",), "m1", ("full", "none"), ("m1", "m2"), ("name", "both"), {"k": (5, 10)}, ("first",), ("g",))
    t = {name: [tuple(r) for r in df.collect()] for name, df in R.report(spark, str(tmp_path), at).items()}
    assert sorted(t["main"]) == [("m1", "big", "50.0", "60.3", "40.0", "50.0", "45.0", "55.1"), ("m2", "big", *["--"] * 6)]
    assert t["ablation"] == [("full", "1.0", "2.0"), ("none", "--", "--")]
    assert t["efficiency"] == [("m1", "1.23", "100", "3.0"), ("m2", "--", "--", "--")]
    assert t["probe"] == [("d1", "name", "90.0", "--", "80.0"), ("d1", "both", *["--"] * 3), ("d2", "name", *["--"] * 3), ("d2", "both", *["--"] * 3)]
    assert t["sensitivity k"] == [("d1", "7.0/8.0", "--"), ("d2", "--", "--")]
    assert ("annotation_noise", "0.5", "--", "0.5") in t["failures"] and len(t["failures"]) == 6
    assert t["priming"] == [("first", "3.0", "4.0")] and t["recogniser"][0] == ("d1", "g", "70.0", "5.0", "--") and t["judge"][0] == ("d1", "m1", "0.8", "--")
    empty = R.report(spark, str(tmp_path / "nothing"), at)
    assert all(set(r[1:]) <= {"--", "big", "name", "both", "g", "m1", "m2"} for df in empty.values() for r in df.collect())


def test_status_report_and_trials(spark):
    rows = spark.createDataFrame([(2, "B", "empty", True, []), (1, "A", "ok", False, ["x", None]), (3, None, None, False, None)], "chunk_id bigint, title string, status string, is_table boolean, events array<string>")
    lines = [r.line for r in R.status_report(rows).orderBy("at").collect()]
    assert lines == ["empty: 1", "ok: 1", "unknown: 1", "A: 2 events", "  - x", "  - ", "[EMPTY] [TABLE] B: 0 events", ": 0 events"] or lines[-1].startswith(":")
    assert [r.chunk_id for r in R.nth(rows, [F.col("chunk_id")], limit=2).collect()] == [1, 2]
    assert [r.chunk_id for r in R.nth(rows, [F.col("chunk_id")], index=1).collect()] == [2] and R.nth(rows, []).count() == 3
