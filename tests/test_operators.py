import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.operators import evaluation as E
from quillmesh.operators import graph as G
from quillmesh.operators import passages as P
from quillmesh.operators import retrieval as R
from quillmesh.operators import skeleton as S
from quillmesh.operators import skew
from quillmesh.operators import variants as V


def fold(sents):
    """The greedy rule, plainly."""
    if len(sents) <= 8 and sum(map(len, sents)) <= 800:
        return [t for t in [" ".join(sents).strip()] if t]
    out, buf, n = [], [], 0
    for s in sents:
        buf.append(s)
        n += len(s)
        if len(buf) >= 5 or n >= 800:
            out.append(" ".join(buf))
            buf, n = [], 0
    return [t for t in (x.strip() for x in [*out, " ".join(buf)]) if t]


def test_chunk_sentences(spark):
    rng = random.Random(1)
    cases = [["x" * rng.choice([0, 3, 100, 300, 900]) for _ in range(rng.randint(0, 20))] for _ in range(60)] + [[], [""], ["", " "] * 9]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, s array<string>")
    for r in df.select("i", P.chunk_sentences(F.col("s")).alias("c")).collect():
        assert r.c == fold(cases[r.i])
    null = spark.createDataFrame([(None,), ([None, "a"],)], "s array<string>").select(P.chunk_sentences(F.col("s")).alias("c")).collect()
    assert [r.c for r in null] == [[], ["a"]]


def test_build_chunks_keeps_first(spark, rows):
    q = spark.createDataFrame([("b", [("t2", ["same"])]), ("a", [("t1", ["same"]), (None, ["other"])]), ("a", [("t1", ["same"]), (None, ["other"])]), ("c", [])], "id string, context array<struct<title:string,sentences:array<string>>>")
    assert set(rows(P.build_chunks(q), "title", "text", "id")) == {("t1", "same", "a"), (None, "other", "a")}


def facts(spark, data):
    return spark.createDataFrame(data, "rel_id bigint, relation string, entities array<struct<name:string,attribute:string,definition:string>>, source_title string, chunk_id bigint")


def test_fact_fold(spark, rows):
    df = facts(spark, [(1, " r ", [], "T", 1), (2, "r", [("A", "x", "d")], "T", 1), (3, "s", [("Bob (person)", "person", "d1"), ("bob", "role", "d2"), ("BOB", "role", "d1")], "bob", 1), (4, None, [("N", None, None)], None, None), (5, "u", [("Z", None, None), ("", "a", "b"), (None, None, None)], "New", 2), (6, "v", None, "x", 1)])
    kept = P.deduplicate_facts(df)
    assert rows(kept, "rel_id") == [(3,), (5,)], "an empty first copy takes later ones with it"
    places = P.fact_entities(kept)
    ents = {r.canonical: r for r in P.fold_entities(places).collect()}
    assert (ents["bob"].display, ents["bob"].definition, ents["bob"].attribute) == ("Bob", "d1; d2", "role")
    assert (ents["z"].definition, ents["z"].attribute) == ("", "other")
    assert rows(P.title_entities(kept, places.select("canonical"))) == [("new", "New")]
    inc = P.build_incidence(kept, places)
    assert Counter(map(tuple, inc.collect())) == Counter({(3, "bob", False): 3, (5, "z", False): 1, (5, "new", True): 1})
    stats = P.arity_stats(inc, df).first()
    assert (stats["edges"], stats["max_arity"], stats["mean_arity"], stats["nary"], stats["nary_fraction"]) == (5, 3, 2.5, 1, round(1 / 6, 4))
    empty = facts(spark, [])
    assert P.fold_entities(P.fact_entities(P.deduplicate_facts(empty))).isEmpty()


def test_merge_spans(spark, rows):
    df = spark.createDataFrame([("d", "person", 0, 4, "John", 0.5), ("d", "person", 5, 8, "Doe", 0.9), ("d", "place", 9, 12, "Ulm", 0.7), ("d", "person", 20, 25, "Ann", 0.4)], "doc string, label string, start int, stop int, text string, score double")
    assert rows(P.merge_spans(df, ["doc"], "label", "start", "stop", "text", "score"), "label", "start", "stop", "text", "score") == [("person", 0, 8, "John Doe", 0.9), ("person", 20, 25, "Ann", 0.4), ("place", 9, 12, "Ulm", 0.7)]


def bm25(docs, query):
    toks = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, toks)) / len(docs)
    df = Counter(w for t in toks for w in set(t))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(w, 0) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in query.split()) for t in toks]


def test_bm25(spark):
    docs = ["a b c", "a a d", "b", "e f g h a", "", "c c c b"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(docs)] + [(6, None)], "doc_id bigint, text string")
    q = spark.createDataFrame([(1, "a c c"), (2, "zz"), (3, "")], "query_id bigint, text string")
    want = bm25([*docs, ""], "a c c")
    got = {r.doc_id: r.score for r in R.bm25_scores(d, q).collect()}
    assert set(got) == {0, 1, 3, 5} and all(abs(got[i] - want[i]) < 1e-12 for i in got)
    filled = R.with_zero_fill(R.bm25_scores(d, q), d, q, 5)
    assert [(r.query_id, r.n) for r in filled.groupBy("query_id").agg(F.count("*").alias("n")).orderBy("query_id").collect()] == [(1, 5), (2, 5), (3, 5)]
    assert {r.doc_id for r in filled.where("query_id = 2").collect()} == {0, 1, 2, 3, 4}


def test_dense_top_k(spark):
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((7, 8))
    bad = [(900, None), (901, []), (902, [0.0] * 8), (903, [float("nan")] * 8), (904, [1.0] * 7)]
    docs = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + bad, "doc_id bigint, vec array<float>").repartition(5)
    queries = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(q)], "query_id bigint, vec array<float>")
    x32, q32 = x.astype(np.float32).astype(float), q.astype(np.float32).astype(float)
    sims = (q32 / np.linalg.norm(q32, axis=1, keepdims=True)) @ (x32 / np.linalg.norm(x32, axis=1, keepdims=True)).T
    for r in R.dense_top_k(docs, queries, 4).collect():
        assert r.doc_id == np.argsort(-sims[r.query_id])[r["rank"] - 1]
    assert R.dense_top_k(docs, queries.limit(0), 4).isEmpty()


@pytest.mark.parametrize("sims, adjacent, top1", [([0.9, 0.88, 0.86, 0.84, 0.5], 4, 3), ([0.9, 0.5, 0.49, 0.48], 4, 2), ([0.9], 1, 1), ([0.9, 0.9, 0.8, 0.79], 2, 2)])
def test_gap_rules(spark, sims, adjacent, top1):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(sims)], "g int, i int, s double")
    assert R.adjacent_gap(df, ["g"], "s", "i", 2, 5, 0.05).count() == adjacent
    assert R.top1_gap(df, ["g"], "s", "i", 2, 5, 0.05).count() == top1


def test_winners(spark, rows):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (2, 1, 0.5), (2, 2, 0.88)], "item int, who int, score double")
    assert rows(R.assign_winners(df, ["item"], "who", 0.03), "item", "who") == [(1, 1), (2, 2)]
    assert rows(R.tied_winners(df, ["item"], 0.05, 0.5), "item", "who") == [(1, 1), (1, 2), (2, 2)]
    paths = spark.createDataFrame([(1, i, c, s) for i, (c, s) in enumerate([(0, 0.9), (0, 0.8), (1, 0.1), (0, 0.7)])], "query_id int, path_id int, chain int, score double")
    assert rows(R.best_per_chain(paths, 2), "path_id", "place") == [(0, 1), (2, 2)]


def test_pagerank(spark):
    edges = [(-1, 1, 2.0), (-1, 2, 1.0), (-2, 2, 1.0), (1, 2, 0.5)]
    df = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    anchors = spark.createDataFrame([(1, 2.0), (77, 1.0)], "vertex bigint, weight double")
    got = {r.vertex: r.score for r in G.pagerank(df, anchors).collect()}
    names = sorted(got)
    w = np.zeros((5, 5))
    for u, v, x in edges:
        w[names.index(u), names.index(v)] += x
        w[names.index(v), names.index(u)] += x
    p = np.array([2 / 3 if n == 1 else 1 / 3 if n == 77 else 0 for n in names])
    x = np.full(5, 0.2)
    for _ in range(200):
        out = w.sum(axis=1)
        x = 0.5 * (np.divide(x, out, where=out > 0, out=np.zeros(5)) @ w + x[out == 0].sum() * p) + 0.5 * p
    assert abs(sum(got.values()) - 1) < 1e-9
    assert all(abs(got[n] - v) < 1e-5 for n, v in zip(names, x))


def test_chains_levels_neighbours(spark, rows):
    data = [(1, 0, "a", False), (1, 0, "x", True), (1, 1, "x", True), (1, 1, "y", True), (1, 2, "b", False), (1, 3, "y", True), (2, 5, "q", True)]
    slots = spark.createDataFrame(data, "question_id bigint, qid bigint, slot_key string, virtual boolean")
    assert rows(S.chains(slots)) == [(1, 0, 0), (1, 1, 0), (1, 2, 1), (1, 3, 0), (2, 5, 0)]
    assert rows(S.slot_levels(slots)) == [(1, 0, 1), (1, 1, 3), (1, 2, 1), (1, 3, 5)]
    assert rows(S.neighbours(slots)) == [(1, 0, 1), (1, 1, 0), (1, 1, 3), (1, 3, 1)]


def test_parse_subquestions(spark, rows):
    good = '<think>x</think>[{"relation": " r ", "entities": [{"name": " A ", "attribute": "Person", "virtual": "false"}, {"name": "B", "virtual": false}, {"name": " "}]}, {"relation": "one", "entities": [{"name": "A"}]}, 7, {"relation": "old", "subject": {"name": "s"}, "object": {"name": "o", "virtual": 1}}]'
    df = spark.createDataFrame([(1, good), (2, "[broken"), (3, None), (4, "no array"), (5, "[]")], "id int, raw string")
    assert rows(S.parse_subquestions(df, "id", "raw")) == [(1, 0, "r", 0, "A", "person", True), (1, 0, "r", 1, "B", "", False), (1, 1, "old", 0, "s", "", False), (1, 1, "old", 1, "o", "", True)]


def test_compatible(spark):
    ok = lambda s, e: spark.range(1).select(S.compatible(F.lit(s), F.lit(e).cast("string"))).first()[0]
    assert ok("government", "country") and not ok("country", "government")
    assert ok("nothing known", "x") and ok("person", None) and not ok("person", "other") and not ok("director", "director")


def test_variants_and_paths(spark):
    slots = spark.createDataFrame([(1, 0, 0, "a", False), (1, 0, 1, "x", True), (1, 1, 0, "x", True), (1, 1, 1, "y", True)], "question_id bigint, qid bigint, slot int, slot_key string, virtual boolean")
    bindings = spark.createDataFrame([(1, "x", 10 + i, 0.9 - i / 100) for i in range(7)], "question_id bigint, slot_key string, ent_id bigint, sim double")
    anchors = spark.createDataFrame([(1, "a", 1), (1, "a", 2)], "question_id bigint, slot_key string, ent_id bigint")
    v = V.build_variants(slots, bindings, anchors).orderBy("variant_id").collect()
    assert [(r.qid, [tuple(c) for c in r.combo]) for r in v] == [(0, [("x", 10 + i)]) for i in range(5)] + [(1, [("x", 10 + i), ("y", None)]) for i in range(5)]
    assert v[0].bound == [1, 2, 10] and v[5].bound == [10]
    df = spark.createDataFrame(v, V.build_variants(slots, bindings, anchors).schema)
    paths = V.variant_paths(df, V.variant_edges(df)).orderBy("path_id").collect()
    assert [r.steps for r in paths] == [[i, 5 + i] for i in range(5)]
    capped = V.build_variants(slots, bindings, anchors, RetrievalConfig(variants_per_subquestion=3))
    assert capped.count() == 6


def test_variant_solutions_fall_back(spark, rows):
    v = spark.createDataFrame([(1, 0, 0, [5]), (1, 1, 0, [99]), (1, 2, 0, [])], "question_id bigint, variant_id int, qid bigint, bound array<bigint>")
    s = spark.createDataFrame([(1, 0, 100, 0.9), (1, 0, 200, 0.8)], "question_id bigint, qid bigint, rel_id bigint, sim double")
    inc = spark.createDataFrame([(100, 5), (200, 6)], "rel_id bigint, ent_id bigint")
    assert rows(V.variant_solutions(v, s, inc), "variant_id", "rel_id") == [(0, 100), (1, 100), (1, 200), (2, 100), (2, 200)]


def test_evaluation(spark, rows):
    df = spark.createDataFrame([("c", "Answer: The Cup", "cup"), ("", "Answer: x", "x"), ("c", None, "y"), ("c", "Answer: red cup", "cup tie")], "context string, raw string, gold string")
    assert rows(E.evaluate(df), "pred", "em", "mark", "error") == [("", 0, "wrong", "llm_call_failed"), ("", 0, "wrong", "no_context"), ("The Cup", 1, "ok", None), ("red cup", 0, "partial", None)]
    assert tuple(E.summary(E.evaluate(df)).first()) == (4, 25.0, 37.5)
    pairs = spark.createDataFrame([(0.9, True), (0.8, True), (0.95, False), (None, False)], "s double, p boolean")
    assert tuple(E.confusion(pairs, "s", "p", 0.85).first()) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    grid = spark.createDataFrame([("m",), ("n",)], "method string")
    scores = spark.createDataFrame([("m", "d1", 10.0), ("m", "d2", 20.0)], "method string, dataset string, em double")
    assert rows(E.grid_table(scores, grid, ["method"], "dataset", ["d1", "d2", "d3"], ["em"])) == [("m", "10.0", "20.0", "--", "15.0"), ("n", "--", "--", "--", "--")]
    assert rows(E.pending(grid, scores, ["method"])) == [("n",)]


def test_skew_helpers(spark):
    n = 20_000
    hot = spark.range(n).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    lookup = spark.range(n).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    assert skew.salted_join(hot, lookup, ["k"]).count() == n
    assert skew.salted_join(hot.withColumn("k", F.lit(None).cast("bigint")), lookup, ["k"], how="left").where("w is null").count() == n
    ranked = skew.range_rank(hot, [F.col("k"), F.col("v")]).orderBy("rank").collect()
    assert [r["rank"] for r in ranked] == list(range(1, n + 1))
    assert [(r.k, r.v) for r in ranked] == sorted((r.k, r.v) for r in ranked)
    counts = hot.groupBy("k").agg(F.count("*").alias("n"))
    cum = skew.range_cumulate(counts, ["k"], "n").orderBy("k").collect()
    total = 0
    for r in cum:
        total += r.n
        assert r.cum == total
    assert skew.range_rank(hot.limit(0), [F.col("k")]).isEmpty() and skew.range_cumulate(counts.limit(0), ["k"], "n").isEmpty()


@pytest.mark.parametrize("block", [3, 1000])
def test_similar_pairs_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((6, 3))
    rows = [(i, [float(x) for x in base[i % 6] + 0.1 * rng.standard_normal(3)], [float(x) for x in base[i % 6]]) for i in range(25)]
    rows += [(30, None, [1.0] * 3), (31, [0.0] * 3, [1.0] * 3), (32, [1.0, 2.0], [1.0] * 3), (33, [1.0, 2.0], [1.0] * 3)]
    cos = lambda a, b: float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    want = {(i, j): round(round((cos(x, a) + cos(y, b)) / 2, 9), 4) for i, x, y in rows[:25] for j, a, b in rows[:25] if i < j and round((cos(x, a) + cos(y, b)) / 2, 9) >= 0.9} | {(32, 33): 1.0}
    df = spark.createDataFrame(rows, "doc_id bigint, vec array<double>, name_vec array<double>")
    assert {(r.a, r.b): r.similarity for r in R.similar_pairs(df, 0.9, block=block).collect()} == want
    assert R.similar_pairs(df.limit(0), 0.9).isEmpty()
