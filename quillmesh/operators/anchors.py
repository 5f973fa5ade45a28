"""The anchor-driven engine: variants spawn variants, relations are locked in a fixed order.

Rounds run for all questions together. Within a round the order of groups decides who locks a relation, so that one step
and the spawning are done question by question on small tables (a question has at most `max_lineage_variants` variants);
everything that touches the graph is joins.
"""

from __future__ import annotations

import itertools
import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.functions import text as T
from quillmesh.operators import graph as G
from quillmesh.operators import scan as C
from quillmesh.operators.search import Graph, Questions, indexed
from quillmesh.operators.retrieval import top1_gap
from quillmesh.operators.skeleton import compatible
from quillmesh.session import cut

VARIANT = "question_id bigint, var_id int, qid bigint, parent int, chain string, ancestors array<int>, born int"


def _closure(graph: Graph, ents: DataFrame) -> DataFrame:
    """The given (.., ent_id) with their synonyms."""
    return ents.unionByName(G.synonyms_of(graph.synonym, ents).select(*ents.columns)).distinct()


def root_variants(graph: Graph, slots: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(variants, anchors): one variant a sub-question with a real slot that was found; anchors(question_id, var_id,
    ent_id) are the found entities and their synonyms. found(question_id, slot_key, ent_id)."""
    real = slots.where("not virtual").select("question_id", "qid", "slot_key").join(found, ["question_id", "slot_key"])
    chain = real.groupBy("question_id", "qid", "slot_key").agg(F.min("ent_id").alias("ent_id")).groupBy("question_id", "qid").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("slot_key", "ent_id"))))).alias("chain"))
    number = (F.row_number().over(Window.partitionBy("question_id").orderBy("qid")) - 1).cast("int")
    variants = cut(chain.select("question_id", number.alias("var_id"), "qid", F.lit(None).cast("int").alias("parent"), "chain", F.array().cast("array<int>").alias("ancestors"), F.lit(0).alias("born")))
    anchors = variants.select("question_id", "var_id", "qid").join(real, ["question_id", "qid"]).select("question_id", "var_id", "ent_id").distinct()
    return variants, cut(_closure(graph, anchors))


def lock_in_order(scored: DataFrame, config: RetrievalConfig) -> DataFrame:
    """(question_id, var_id, rel_id, sim) that a round locks, from scored (question_id, grp, rel_id, var_id, score).

    Groups come in order; what a group keeps is gone for those behind it. A relation goes to all contestants within the
    tie slack of its best; each keeps its best ones by the top-1 gap rule, and only what is kept is locked.
    """
    kmin, kmax, gap = config.tight

    def resolve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        locked: set[int] = set()
        out = []
        for _, group in rows.groupby("grp", sort=True):
            free = group[~group["rel_id"].isin(locked)]
            best = free.groupby("rel_id")["score"].transform("max")
            won = free[(best - free["score"]).round(9) <= config.tied_slack].sort_values(["var_id", "score", "rel_id"], ascending=[True, False, True])
            for var, mine in won.groupby("var_id", sort=True):
                top = mine["score"].iloc[0]
                kept = mine.iloc[:kmax]
                kept = kept[(pd.Series(range(len(kept)), index=kept.index) < kmin) | ((top - kept["score"]).round(9) <= gap)]
                out += [(key[0], int(var), int(r), float(s)) for r, s in zip(kept["rel_id"], kept["score"])]
                locked |= set(kept["rel_id"])
        return pd.DataFrame(out, columns=["question_id", "var_id", "rel_id", "sim"]).astype({"question_id": "int64", "var_id": "int32", "rel_id": "int64", "sim": "float64"})

    return scored.groupBy("question_id").applyInPandas(resolve, "question_id bigint, var_id int, rel_id bigint, sim double")


def spawn(solved: DataFrame, slots: DataFrame, variants: DataFrame, number: int, config: RetrievalConfig) -> DataFrame:
    """New variants from solved (question_id, var_id, slot_key, ents): for every other sub-question that shares a solved
    slot with something new, the product of the options; one for each (sub-question, chain)."""
    virtual = slots.where("virtual").groupBy("question_id").agg(F.collect_set(F.struct("qid", "slot_key")).alias("virtual"))
    known = variants.groupBy("question_id").agg(F.collect_list(F.struct("qid", "chain")).alias("known"), F.max("var_id").alias("last"))
    rows = solved.join(variants.select("question_id", "var_id", "qid", "chain", "ancestors"), ["question_id", "var_id"]).join(virtual, "question_id").join(known, "question_id")

    def grow(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        seen = {(r["qid"], r["chain"]) for r in g["known"].iloc[0]}
        keys: dict[int, list[str]] = {}
        for r in g["virtual"].iloc[0]:
            keys.setdefault(r["qid"], []).append(r["slot_key"])
        nxt, out = int(g["last"].iloc[0]) + 1, []
        for var, mine in g.sort_values("var_id").groupby("var_id", sort=True):
            first = mine.iloc[0]
            chain, options = json.loads(first["chain"]), {r.slot_key: list(r.ents) for r in mine.itertuples()}
            for qid in sorted(keys):
                shared = sorted(set(keys[qid]) & set(options))
                if qid == first["qid"] or not shared:
                    continue
                for combo in itertools.product(*(options[k] for k in shared)):
                    text = json.dumps(dict(sorted((chain | {k: int(e) for k, e in zip(shared, combo)}).items())), separators=(",", ":"), ensure_ascii=False)
                    if (qid, text) not in seen and nxt <= config.max_lineage_variants:
                        seen.add((qid, text))
                        out.append((key[0], nxt, qid, int(var), text, [*map(int, first["ancestors"]), int(var)], number))
                        nxt += 1
        return pd.DataFrame(out, columns=["question_id", "var_id", "qid", "parent", "chain", "ancestors", "born"])

    return rows.groupBy("question_id").applyInPandas(grow, VARIANT)


def anchor_search(graph: Graph, q: Questions, config: RetrievalConfig = RetrievalConfig()) -> tuple[DataFrame, DataFrame]:
    """(variants, locked): all variants, and locked(question_id, var_id, rel_id, sim).

    A question ends when it has no new variants; what would go beyond config.max_lineage_variants is not spawned.
    """
    spark = q.subq.sparkSession
    found = q.found if q.found is not None else q.start.join(q.slots.where("not virtual").select("question_id", "slot_key").distinct(), "question_id").select("question_id", "slot_key", "ent_id")
    variants, anchors = root_variants(graph, q.slots, found)
    locked = spark.createDataFrame([], "question_id bigint, var_id int, rel_id bigint, sim double")
    own = found.select("question_id", "slot_key", "ent_id")
    cards, index = indexed(graph, q)
    for number in itertools.count(1):
        queue = variants.where(F.col("born") == number - 1)
        if queue.isEmpty():
            break
        sets = anchors.join(queue.select("question_id", "var_id"), ["question_id", "var_id"]).groupBy("question_id", "var_id").agg(F.array_sort(F.collect_set("ent_id")).alias("anchors"))
        sets = sets.withColumn("grp", F.min("var_id").over(Window.partitionBy("question_id", "anchors")))
        sets = cut(sets)
        members = sets.join(queue.select("question_id", "var_id", "ancestors"), ["question_id", "var_id"])
        contest = members.select("question_id", "grp", F.explode(F.concat(F.array("var_id"), "ancestors")).alias("var_id")).distinct().join(variants.select("question_id", "var_id", "qid"), ["question_id", "var_id"])
        contest = cut(contest)
        reach = sets.where("var_id = grp").select("question_id", F.col("grp").cast("bigint").alias("grp"), F.explode("anchors").alias("ent_id"))
        units = contest.select("question_id", F.col("grp").cast("bigint").alias("grp"), "qid").distinct().join(q.subq, ["question_id", "qid"]).withColumn("floor", F.lit(config.match_threshold))
        found_by = C.scan(cards, index, units, reach, config.hybrid_boost).where(F.col("score") >= config.match_threshold)
        free = found_by.withColumn("grp", F.col("grp").cast("int")).join(locked.select("question_id", "rel_id").distinct(), ["question_id", "rel_id"], "left_anti")
        scored = free.join(contest, ["question_id", "grp", "qid"]).select("question_id", "grp", "rel_id", "var_id", "score")
        new = cut(lock_in_order(cut(scored), config))
        if new.isEmpty():
            break
        locked = cut(locked.unionByName(new))
        touched = new.select("question_id", "var_id").distinct()
        ents = locked.join(touched, ["question_id", "var_id"]).join(graph.incidence.select("rel_id", "ent_id"), "rel_id").select("question_id", "var_id", "ent_id").distinct().join(anchors, ["question_id", "var_id", "ent_id"], "left_anti")
        state = variants.join(touched, ["question_id", "var_id"]).join(q.slots.where("virtual"), ["question_id", "qid"]).where(F.try_element_at(F.from_json("chain", "map<string,bigint>"), F.col("slot_key")).isNull())
        options = ents.join(state.select("question_id", "var_id", "slot_key", "attribute", "vec"), ["question_id", "var_id"]).join(graph.entity.select("ent_id", F.col("vec").alias("evec"), "name_vec", F.col("attribute").alias("ent_attr")), "ent_id").where(compatible(F.col("attribute"), F.col("ent_attr"), config.treat_other_as_unknown))
        sims = options.select("question_id", "var_id", "slot_key", "ent_id", ((T.dot(F.col("vec"), F.col("evec")) + T.dot(F.col("vec"), F.col("name_vec"))) / 2).alias("sim"))
        kept = top1_gap(sims, ["question_id", "var_id", "slot_key"], "sim", "ent_id", 1, config.bindings_per_virtual, config.match_slack, config.match_threshold)
        solved = kept.groupBy("question_id", "var_id", "slot_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "ent_id"))), lambda x: x["ent_id"]).alias("ents"))
        children = cut(spawn(solved, q.slots, variants, number, config))
        if children.isEmpty():
            break
        variants = cut(variants.unionByName(children))
        bound = children.select("question_id", "var_id", "qid", F.explode(F.from_json("chain", "map<string,bigint>")).alias("slot_key", "ent_id"))
        mine = bound.join(q.slots.where("virtual").select("question_id", "qid", "slot_key"), ["question_id", "qid", "slot_key"]).select("question_id", "var_id", "ent_id")
        real = children.select("question_id", "var_id", "qid").join(q.slots.where("not virtual").select("question_id", "qid", "slot_key"), ["question_id", "qid"]).join(own, ["question_id", "slot_key"]).select("question_id", "var_id", "ent_id")
        anchors = cut(anchors.unionByName(_closure(graph, mine.unionByName(real).distinct())))
    return variants, locked


def lineage_paths(variants: DataFrame, locked: DataFrame) -> DataFrame:
    """(question_id, path_id, steps): from each leaf up to its root, if any variant on the way has locked a relation;
    the longest first."""
    leaves = variants.join(variants.select("question_id", F.col("parent").alias("var_id")).where("var_id is not null").distinct(), ["question_id", "var_id"], "left_anti")
    paths = leaves.select("question_id", F.concat("ancestors", F.array("var_id")).alias("steps"))
    has = locked.select("question_id", "var_id").distinct()
    kept = paths.select("question_id", "steps", F.explode("steps").alias("var_id")).join(has, ["question_id", "var_id"]).select("question_id", "steps").distinct()
    number = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc(F.size("steps")), "steps")) - 1
    return kept.select("question_id", number.alias("path_id"), "steps")
