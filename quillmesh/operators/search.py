"""Thresholded expansion of the graph for a batch of questions at once.

All questions move through the same rounds; each has its own flag, and what a question has found is rows under its
question_id, in five tables: visited entities, solutions, bindings of virtual slots, similarities of entities to virtual
slots, active questions. A round reads only what earlier rounds wrote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.functions import text as T
from quillmesh.operators import graph as G
from quillmesh.operators import scan as C
from quillmesh.operators.skeleton import compatible, neighbours
from quillmesh.operators.skew import bounded
from quillmesh.session import cut

#: Vectors of sub-questions or slots that are broadcast at most (half a kilobyte each at 64 dimensions).
VECTORS = 50_000
#: Reached entities that are broadcast at most (some 40 bytes each).
REACHED = 200_000
ENDS = "question_id bigint, qid bigint, rel_id bigint, sim double, round int"


@dataclass
class Graph:
    """relation(rel_id, vec), entity(ent_id, vec, name_vec, attribute), incidence(rel_id, ent_id, is_title_edge),
    synonym(a, b, similarity); cards of the relations (see scan.cards), made from these where they are not given."""

    relation: DataFrame
    entity: DataFrame
    incidence: DataFrame
    synonym: DataFrame
    cards: DataFrame | None = None


@dataclass
class Questions:
    """subq(question_id, qid, vec), slots(question_id, qid, slot_key, virtual, attribute, vec), start(question_id, ent_id)
    found for the real slots, lexical(question_id, qid, rel_id, score) normalised, seeds(question_id, rel_id),
    found(question_id, slot_key, ent_id) by real slot; without it every real slot has all of `start`. index: the lexical
    scores in factors, which the engines read; made from `lexical` where it is not given."""

    subq: DataFrame
    slots: DataFrame
    start: DataFrame
    lexical: DataFrame
    seeds: DataFrame
    found: DataFrame | None = None
    index: C.Index | None = None


@dataclass
class State:
    visited: DataFrame
    solutions: DataFrame
    bindings: DataFrame
    similar: DataFrame


def indexed(graph: Graph, q: Questions) -> tuple[DataFrame, C.Index]:
    """(cards, index) that the engines scan."""
    index = q.index or C.index_scores(q.lexical)
    return graph.cards or C.cards(graph.relation.select("rel_id", "vec"), graph.incidence, index), index


def relation_round(cards: DataFrame, index: C.Index, graph: Graph, q: Questions, members: DataFrame, solutions: DataFrame, first: bool, number: int, config: RetrievalConfig, ents: str = "ents") -> DataFrame:
    """New solutions (question_id, qid, rel_id, sim, round) among the relations of members(question_id, ent_id).

    score = cosine + boost * lexical score + overlap with the entities of the neighbours' best solutions (later rounds).
    A sub-question's threshold is its best score less a slack in the first round, later the mean of what it has, at least
    a floor. Each relation goes to the eligible sub-question with the best score, the smallest qid on ties.
    """
    members = members.select("question_id", F.lit(0).cast("bigint").alias("grp"), "ent_id")
    asked = q.subq.join(members.select("question_id").distinct(), "question_id", "left_semi").withColumn("grp", F.lit(0).cast("bigint"))
    if first:
        eligible = C.scan(cards, index, asked.withColumn("floor", F.lit(None).cast("double")), members, config.hybrid_boost, config.first_round_slack, ents=ents)
    else:
        means = solutions.groupBy("question_id", "qid").agg(F.avg("sim").alias("mean"))
        asked = asked.join(means, ["question_id", "qid"], "left").withColumn("floor", F.greatest(F.lit(config.later_round_floor), F.coalesce("mean", F.lit(0.0))))
        near = neighbour_entities(graph.incidence, q.slots, solutions, config)
        eligible = C.scan(cards, index, asked, members, config.hybrid_boost, None, near, (config.overlap_weight, config.overlap_cap), ents)
    fresh = eligible.join(solutions.select("question_id", "rel_id"), ["question_id", "rel_id"], "left_anti")
    best = fresh.groupBy("question_id", "rel_id").agg(F.min(F.struct((-F.round("score", 9)).alias("neg"), "qid", "score")).alias("b"))
    return best.select("question_id", "b.qid", "rel_id", F.col("b.score").alias("sim"), F.lit(number).alias("round"))


def neighbour_entities(incidence: DataFrame, slots: DataFrame, solutions: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(question_id, qid, ent_id): distinct entities of the best solutions of the sub-question's neighbours."""
    w = Window.partitionBy("question_id", "qid").orderBy(F.desc(F.round("sim", 9)), "rel_id")
    best = solutions.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= config.overlap_top)
    near = neighbours(slots).join(best.select("question_id", F.col("qid").alias("other"), "rel_id"), ["question_id", "other"])
    return near.join(incidence.select("rel_id", "ent_id"), "rel_id").select("question_id", "qid", "ent_id").distinct()


def match_virtual(graph: Graph, slots: DataFrame, reach: DataFrame, config: RetrievalConfig) -> tuple[DataFrame, DataFrame]:
    """(bindings, similar) of newly reached (question_id, ent_id) and the question's virtual slots.

    similar holds the mean cosine of every pair; a binding needs a compatible attribute, more than the threshold, and to
    be within a slack of the slot's best, at most the first few.
    """
    virtual = slots.where("virtual").groupBy("question_id", "slot_key").agg(F.min_by(F.struct("attribute", "vec"), "qid").alias("s"))
    # as long as they are few, the reached come to the entities, so that no vectors are shuffled
    pairs = bounded(reach, REACHED).join(graph.entity.select("ent_id", F.col("vec").alias("evec"), "name_vec", F.col("attribute").alias("ent_attr")), "ent_id").join(bounded(virtual, VECTORS), "question_id")
    sims = pairs.select("question_id", "slot_key", "ent_id", ((T.dot(F.col("s.vec"), F.col("evec")) + T.dot(F.col("s.vec"), F.col("name_vec"))) / 2).alias("sim"), compatible(F.col("s.attribute"), F.col("ent_attr"), config.treat_other_as_unknown).alias("fits"))
    sims = cut(sims)
    w = Window.partitionBy("question_id", "slot_key").orderBy(F.desc(F.round("sim", 9)), "ent_id")
    kept = sims.where(F.col("fits") & (F.col("sim") > config.match_threshold)).withColumn("rn", F.row_number().over(w)).withColumn("best", F.first("sim").over(w))
    bindings = kept.where((F.col("rn") <= config.match_top) & (F.round(F.col("best") - F.col("sim"), 9) <= config.match_slack)).select("question_id", "slot_key", "ent_id")
    return bindings, sims.select("question_id", "slot_key", "ent_id", "sim")


def _reach(graph: Graph, state: State, active: DataFrame) -> DataFrame:
    """Entities of an active question's solutions that it has not visited."""
    found = state.solutions.select("question_id", "rel_id").join(active, "question_id").join(graph.incidence.select("rel_id", "ent_id"), "rel_id")
    return cut(found.select("question_id", "ent_id").distinct().join(state.visited, ["question_id", "ent_id"], "left_anti"))


def _remember(state: State, bindings: DataFrame, similar: DataFrame) -> None:
    """Adds bindings; a similarity that is found again replaces the old one."""
    state.bindings = cut(state.bindings.unionByName(bindings).distinct())
    old = state.similar.join(similar, ["question_id", "slot_key", "ent_id"], "left_anti")
    state.similar = cut(old.unionByName(similar))


def iterative_search(graph: Graph, q: Questions, config: RetrievalConfig = RetrievalConfig()) -> State:
    """Runs all rounds for all questions; see State for what comes out.

    A question stops when it reaches no new entity, matches none, has no candidate or wins none; the others go on. Then
    its unlocked seeds get one round, and two more expansions follow in which entities at title edges may be promoted to
    bindings.
    """
    spark = q.subq.sparkSession
    empty_b = spark.createDataFrame([], "question_id bigint, slot_key string, ent_id bigint")
    empty_s = spark.createDataFrame([], "question_id bigint, slot_key string, ent_id bigint, sim double")
    state = State(cut(q.start.select("question_id", "ent_id").distinct()), spark.createDataFrame([], ENDS), empty_b, empty_s)
    has_virtual = cut(q.slots.where("virtual").select("question_id").distinct())
    everyone = cut(q.subq.select("question_id").distinct())
    cards, index = indexed(graph, q)
    number = 0

    def play(members: DataFrame, first: bool, table: DataFrame = cards, ents: str = "ents") -> DataFrame:
        nonlocal number
        new = cut(relation_round(table, index, graph, q, members, state.solutions, first, number, config, ents))
        state.solutions = cut(state.solutions.unionByName(new))
        number += 1
        return cut(new.select("question_id").distinct())

    active = play(state.visited, True)
    for _ in range(config.max_rounds):
        reach = _reach(graph, state, active)
        if reach.isEmpty():
            break
        bindings, similar = match_virtual(graph, q.slots, reach, config)
        bindings = cut(bindings)
        _remember(state, bindings, similar)
        free = reach.join(has_virtual, "question_id", "left_anti")
        matched = cut(bindings.select("question_id", "ent_id").unionByName(free).distinct())
        if matched.isEmpty():
            break
        state.visited = cut(state.visited.unionByName(matched).unionByName(G.synonyms_of(graph.synonym, matched).select("question_id", "ent_id")).distinct())
        active = play(state.visited.join(matched.select("question_id").distinct(), "question_id"), False)
        if active.isEmpty():
            break
    play(q.seeds.select("question_id", F.col("rel_id").alias("ent_id")), False, cards.withColumn("self", F.array("rel_id")), "self")
    active = everyone
    for _ in range(config.extra_rounds):
        reach = _reach(graph, state, active)
        if reach.isEmpty():
            break
        bindings, similar = match_virtual(graph, q.slots, reach, config)
        bindings = cut(bindings)
        _remember(state, bindings, similar)
        titles = state.solutions.select("question_id", "rel_id").join(graph.incidence.where("is_title_edge"), "rel_id").select("question_id", "ent_id").distinct().join(reach, ["question_id", "ent_id"], "left_semi")
        titles = cut(titles)
        slots = q.slots.where("virtual").groupBy("question_id", "slot_key").agg(F.min_by("attribute", "qid").alias("attribute"))
        ends = titles.join(graph.entity.select("ent_id", F.col("attribute").alias("ent_attr")), "ent_id").where("ent_attr <> ''").join(slots, "question_id")
        promoted = ends.where(compatible(F.col("attribute"), F.col("ent_attr")) & compatible(F.col("attribute"), F.lit("no such attribute")).eqNullSafe(F.lit(False)))
        promoted = promoted.join(state.similar, ["question_id", "slot_key", "ent_id"], "left").select("question_id", "slot_key", "ent_id", F.least(F.lit(1.0), F.coalesce("sim", F.lit(0.5)) + config.promote_bonus).alias("sim"))
        promoted = cut(promoted)
        _remember(state, promoted.drop("sim"), promoted)
        matched = cut(bindings.select("question_id", "ent_id").unionByName(titles).distinct())
        if matched.isEmpty():
            break
        state.visited = cut(state.visited.unionByName(matched).unionByName(G.synonyms_of(graph.synonym, matched).select("question_id", "ent_id")).distinct())
        active = play(state.visited.join(matched.select("question_id").distinct(), "question_id"), False)
        if active.isEmpty():
            break
    return state
