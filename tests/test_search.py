"""The batch engine against a plain one-question-at-a-time version of the same rules."""

import random

import numpy as np
import pytest

from quillmesh.config import RetrievalConfig
from quillmesh.functions.fixed import ATTRIBUTE_FAMILIES
from quillmesh.operators import anchors as A
from quillmesh.operators import search as S

CONFIG = RetrievalConfig(match_threshold=0.2, later_round_floor=0.1, max_rounds=3)
DIM = 4


def unit(rng):
    v = rng.standard_normal(DIM) + 0.4
    return v / np.linalg.norm(v)


def world(seed, questions=3, relations=40, entities=25):
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    w = {
        "rel": {r: unit(rng) for r in range(relations)},
        "ent": {e: (unit(rng), unit(rng), pick.choice(["person", "city", "other", None, "year"])) for e in range(entities)},
        "inc": [(r, pick.randrange(entities), pick.random() < 0.2) for r in range(relations) for _ in range(pick.choice([2, 3, 4]))],
        "syn": [(pick.randrange(entities), pick.randrange(entities)) for _ in range(4)],
        "q": {},
    }
    for q in range(questions):
        slots = [(0, "a", False, ""), (0, "person x", True, "person"), (1, "person x", True, "person"), (1, "city y", True, "city"), (2, "b", False, "")]
        if q == 2:
            slots = [s for s in slots if not s[2]]
        keys = {s[1]: unit(rng) for s in slots}
        w["q"][q] = {"subq": {i: unit(rng) for i in sorted({s[0] for s in slots})}, "slots": slots, "vec": keys, "start": pick.sample(range(entities), 2), "lex": {(i, r): pick.random() for i in (0, 2) for r in pick.sample(range(relations), 6)}, "seeds": pick.sample(range(relations), 4)}
    return w


def fits(slot, ent):
    fam = ATTRIBUTE_FAMILIES.get(slot)
    return fam is None or ent is None or ent in fam.split()


def plain(w, q):
    """Solutions {rel: (qid, sim, round)}, visited, bindings, similarities of one question."""
    x = w["q"][q]
    ents, rels = {}, {}
    for r, e, _ in w["inc"]:
        ents.setdefault(r, set()).add(e)
        rels.setdefault(e, set()).add(r)
    syn = {}
    for a, b in w["syn"]:
        if a != b:
            syn.setdefault(a, set()).add(b)
            syn.setdefault(b, set()).add(a)
    virtual = {k: a for _, k, v, a in x["slots"] if v}
    near = {i: {j for j, kj, *_ in x["slots"] for k, kk, *_ in x["slots"] if k == i and kk == kj and j != i} for i in x["subq"]}
    sol, visited, bind, sims = {}, set(x["start"]), set(), {}
    number = [0]

    def play(cands, first):
        score = {}
        for r in cands:
            for i, v in x["subq"].items():
                s = float(v @ w["rel"][r]) + CONFIG.hybrid_boost * x["lex"].get((i, r), 0.0)
                if not first:
                    pool = set()
                    for j in near[i]:
                        best = sorted(((-round(s2, 9), r2) for r2, (k, s2, _) in sol.items() if k == j))[:3]
                        pool |= {e for _, r2 in best for e in ents[r2]}
                    s += min(CONFIG.overlap_weight * len(pool & ents[r]), CONFIG.overlap_cap)
                score[i, r] = s
        new = {}
        for i in x["subq"]:
            mine = [s for _, (k, s, _) in sol.items() if k == i]
            thr = max((score[i, r] for r in cands), default=9) - CONFIG.first_round_slack if first else max(CONFIG.later_round_floor, np.mean(mine) if mine else 0)
            for r in cands:
                if round(score[i, r] - thr, 9) >= 0 and (r not in new or round(score[i, r], 9) > round(new[r][1], 9)):
                    new[r] = (i, score[i, r], number[0])
        sol.update(new)
        number[0] += 1
        return bool(new)

    def match(reach):
        got = set()
        for k, attr in virtual.items():
            v = x["vec"][k]
            here = {e: float((v @ w["ent"][e][0] + v @ w["ent"][e][1]) / 2) for e in reach}
            sims.update({(k, e): s for e, s in here.items()})
            ok = sorted(((-round(s, 9), e) for e, s in here.items() if s > CONFIG.match_threshold and fits(attr, w["ent"][e][2])))[:3]
            got |= {(k, e) for s, e in ok if round(here[ok[0][1]] - here[e], 9) <= CONFIG.match_slack}
        return got

    def candidates():
        return {r for e in visited for r in rels.get(e, ())} - set(sol)

    def reached():
        return {e for r in sol for e in ents[r]} - visited

    alive = play(candidates(), True)
    for _ in range(CONFIG.max_rounds):
        reach = reached() if alive else set()
        if not reach:
            break
        got = match(reach)
        bind |= got
        matched = {e for _, e in got} if virtual else reach
        if not matched:
            break
        visited |= matched | {s for e in matched for s in syn.get(e, ())}
        alive = bool(candidates()) and play(candidates(), False)
    play(set(x["seeds"]) - set(sol), False)
    for _ in range(CONFIG.extra_rounds):
        reach = reached()
        if not reach:
            break
        got = match(reach)
        bind |= got
        titles = {e for r, e, t in w["inc"] if t and r in sol} & reach
        for e in titles:
            for k, attr in virtual.items():
                if w["ent"][e][2] and w["ent"][e][2] in ATTRIBUTE_FAMILIES.get(attr, "").split():
                    bind.add((k, e))
                    sims[k, e] = min(1.0, sims.get((k, e), 0.5) + CONFIG.promote_bonus)
        matched = {e for _, e in got} | titles
        if not matched:
            break
        visited |= matched | {s for e in matched for s in syn.get(e, ())}
        if not candidates() or not play(candidates(), False):
            break
    return {r: (i, s) for r, (i, s, _) in sol.items()}, visited, bind, sims


def tables(spark, w):
    vec = lambda v: [float(x) for x in v]
    graph = S.Graph(
        spark.createDataFrame([(r, vec(v)) for r, v in w["rel"].items()], "rel_id bigint, vec array<double>"),
        spark.createDataFrame([(e, vec(a), vec(b), t) for e, (a, b, t) in w["ent"].items()], "ent_id bigint, vec array<double>, name_vec array<double>, attribute string"),
        spark.createDataFrame(w["inc"], "rel_id bigint, ent_id bigint, is_title_edge boolean"),
        spark.createDataFrame([(a, b, 0.9) for a, b in w["syn"]], "a bigint, b bigint, similarity double"),
    )
    q = w["q"].items()
    questions = S.Questions(
        spark.createDataFrame([(k, i, vec(v)) for k, x in q for i, v in x["subq"].items()], "question_id bigint, qid bigint, vec array<double>"),
        spark.createDataFrame([(k, i, n, key, virt, attr, vec(x["vec"][key])) for k, x in q for n, (i, key, virt, attr) in enumerate(x["slots"])], "question_id bigint, qid bigint, slot int, slot_key string, virtual boolean, attribute string, vec array<double>"),
        spark.createDataFrame([(k, e) for k, x in q for e in x["start"]], "question_id bigint, ent_id bigint"),
        spark.createDataFrame([(k, i, r, s) for k, x in q for (i, r), s in x["lex"].items()], "question_id bigint, qid bigint, rel_id bigint, score double"),
        spark.createDataFrame([(k, r) for k, x in q for r in x["seeds"]], "question_id bigint, rel_id bigint"),
    )
    return graph, questions


@pytest.mark.parametrize("seed", [1, 2])
def test_iterative_search(spark, seed):
    w = world(seed)
    state = S.iterative_search(*tables(spark, w), CONFIG)
    solutions = state.solutions.collect()
    for q in w["q"]:
        sol, visited, bind, sims = plain(w, q)
        mine = {r.rel_id: (r.qid, r.sim) for r in solutions if r.question_id == q}
        assert {r: i for r, (i, _) in mine.items()} == {r: i for r, (i, _) in sol.items()}
        assert all(abs(mine[r][1] - sol[r][1]) < 1e-9 for r in sol)
        assert {r.ent_id for r in state.visited.where(f"question_id = {q}").collect()} == visited
        assert {(r.slot_key, r.ent_id) for r in state.bindings.where(f"question_id = {q}").collect()} == bind
        assert {(r.slot_key, r.ent_id): round(r.sim, 9) for r in state.similar.where(f"question_id = {q}").collect()} == {k: round(v, 9) for k, v in sims.items()}
    assert len({(r.question_id, r.rel_id) for r in solutions}) == len(solutions), "a relation has one winner"


def test_lock_in_order(spark, rows):
    data = [(1, 0, 10, 0, 0.9), (1, 0, 11, 0, 0.6), (1, 0, 12, 0, 0.55), (1, 0, 13, 0, 0.5), (1, 1, 10, 1, 0.99), (1, 1, 14, 1, 0.7), (1, 1, 14, 0, 0.69), (2, 5, 10, 5, 0.5)]
    df = spark.createDataFrame(data, "question_id bigint, grp int, rel_id bigint, var_id int, score double")
    assert rows(A.lock_in_order(df, RetrievalConfig())) == [(1, 0, 10, 0.9), (1, 0, 11, 0.6), (1, 0, 14, 0.69), (1, 1, 14, 0.7), (2, 5, 10, 0.5)]


def test_spawn_and_lineage(spark, rows):
    variants = spark.createDataFrame([(1, 0, 0, None, '{"a":7}', [], 0)], A.VARIANT)
    slots = spark.createDataFrame([(1, 0, "x", True), (1, 1, "x", True), (1, 2, "y", True), (1, 1, "b", False)], "question_id bigint, qid bigint, slot_key string, virtual boolean")
    solved = spark.createDataFrame([(1, 0, "x", [3, 4])], "question_id bigint, var_id int, slot_key string, ents array<bigint>")
    born = A.spawn(solved, slots, variants, 1, RetrievalConfig())
    assert rows(born, "var_id", "qid", "parent", "chain", "ancestors") == [(1, 1, 0, '{"a":7,"x":3}', (0,)), (2, 1, 0, '{"a":7,"x":4}', (0,))]
    every = variants.unionByName(born)
    assert A.spawn(solved, slots, every, 2, RetrievalConfig()).isEmpty(), "the same chain is not born twice"
    assert A.spawn(solved, slots, variants, 1, RetrievalConfig(max_lineage_variants=1)).count() == 1
    locked = spark.createDataFrame([(1, 1, 50, 0.5)], "question_id bigint, var_id int, rel_id bigint, sim double")
    assert rows(A.lineage_paths(every, locked)) == [(1, 0, (0, 1))]


def test_anchor_search_runs_to_an_end(spark):
    w = world(3)
    variants, locked = A.anchor_search(*tables(spark, w), CONFIG)
    v = variants.collect()
    assert len({(r.question_id, r.qid, r.chain) for r in v}) == len(v)
    known = {(r.question_id, r.var_id) for r in v}
    assert all(r.parent is None or (r.question_id, r.parent) in known for r in v)
    assert all((r.question_id, r.var_id) in known and r.sim >= CONFIG.match_threshold for r in locked.collect())


def test_registered_queries_run_all_rounds():
    from quillmesh.plans import search as P

    assert (P.CONFIG.max_rounds, P.CONFIG.extra_rounds) == (RetrievalConfig().max_rounds, RetrievalConfig().extra_rounds) == (5, 2)


def test_all_facts_have_their_lexical_score(spark, tmp_path):
    from quillmesh.plans import search as P

    v = [1.0] + [0.5] * 63
    tables = {
        "entity": ([(1, "mill", "Mill", "a mill", v, v, "place")], "ent_id bigint, canonical string, display string, definition string, embedding array<double>, name_embedding array<double>, attribute string"),
        "fact": ([(i, "Mill", f"mill fact{i}", 1) for i in range(150)], "rel_id bigint, source_title string, relation string, chunk_id bigint"),
        "incidence": ([(i, 1, None) for i in range(150)], "rel_id bigint, ent_id bigint, is_title_edge boolean"),
        "synonym_pair": ([], "pair_id bigint, a string, b string, similarity double"),
        "eval_item": ([(1, "which fact7 of the mill")], "item_id bigint, question string"),
        "embeddings": ([(1, v)], "vec_id bigint, embedding array<double>"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    q = P.prepared(spark, str(tmp_path))[2].questions
    assert q.lexical.count() == 2 * 150 and q.seeds.count() == 10
