"""From solutions to contexts: variants of bindings, the graph of variants, scored paths, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.operators.retrieval import adjacent_gap, top_k
from quillmesh.session import cut


def build_variants(slots: DataFrame, bindings: DataFrame, anchors: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(question_id, variant_id, qid, combo array<struct<slot_key, ent_id>>, bound array<bigint>).

    bindings(question_id, slot_key, ent_id, sim); anchors(question_id, slot_key, ent_id), with the key `__all__` for
    entities found for no slot in particular. A sub-question's variants are the product of the best bindings of its
    virtual slots (a slot without any is left open), the last slot fastest, cut after a fixed number; a product grows slot by slot and is cut at every step, as only its head can stay.
    bound: the entities of its real slots, or all found ones where it has a real slot but none of its own, and the
    bound ones.
    """
    w = Window.partitionBy("question_id", "slot_key").orderBy(F.desc(F.round("sim", 9)), "ent_id")
    best = bindings.withColumn("place", F.row_number().over(w)).where(F.col("place") <= config.bindings_per_virtual)
    options = best.groupBy("question_id", "slot_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "ent_id"))), lambda x: x["ent_id"]).alias("options"))
    virtual = slots.where("virtual").select("question_id", "qid", "slot", "slot_key").join(options, ["question_id", "slot_key"], "left")
    open_ = F.array(F.lit(None).cast("bigint"))
    lists = virtual.groupBy("question_id", "qid").agg(F.array_sort(F.collect_list(F.struct("slot", "slot_key", F.coalesce("options", open_).alias("options")))).alias("lists"))
    every = slots.select("question_id", "qid").distinct().join(lists, ["question_id", "qid"], "left")
    kind = "array<array<struct<slot_key:string,ent_id:bigint>>>"
    start = F.array(F.array()).cast(kind)
    grow = lambda acc, s: F.slice(F.flatten(F.transform(acc, lambda c: F.transform(s["options"], lambda e: F.concat(c, F.array(F.struct(s["slot_key"].alias("slot_key"), e.alias("ent_id"))))))), 1, config.variants_per_subquestion).cast(kind)
    combos = every.select("question_id", "qid", F.posexplode(F.aggregate(F.coalesce("lists", F.array().cast(lists.schema["lists"].dataType)), start, grow)).alias("place", "combo"))
    real = slots.where("not virtual").select("question_id", "qid", "slot_key")
    own = real.join(anchors, ["question_id", "slot_key"]).groupBy("question_id", "qid").agg(F.collect_set("ent_id").alias("own"))
    shared = anchors.where("slot_key = '__all__'").groupBy("question_id").agg(F.collect_set("ent_id").alias("shared"))
    has_real = real.select("question_id", "qid").distinct().withColumn("is_anchor", F.lit(True))
    rows = combos.join(own, ["question_id", "qid"], "left").join(shared, "question_id", "left").join(has_real, ["question_id", "qid"], "left")
    none = F.array().cast("array<bigint>")
    mine = F.coalesce("own", F.when(F.col("is_anchor"), F.col("shared")), none)
    bound = F.array_sort(F.array_distinct(F.concat(mine, F.filter(F.transform("combo", lambda c: c["ent_id"]), lambda e: e.isNotNull()))))
    number = F.row_number().over(Window.partitionBy("question_id").orderBy("qid", "place")) - 1
    return rows.select("question_id", number.alias("variant_id"), "qid", "combo", bound.alias("bound"), F.coalesce("is_anchor", F.lit(False)).alias("is_anchor"))


def variant_edges(variants: DataFrame) -> DataFrame:
    """(question_id, a, b): variants of different sub-questions that share a bound entity, both ways."""
    ends = variants.select("question_id", "variant_id", "qid", F.explode("bound").alias("ent_id"))
    other = ends.toDF("question_id", "other", "other_qid", "ent_id")
    return ends.join(other, ["question_id", "ent_id"]).where("qid <> other_qid").select("question_id", F.col("variant_id").alias("a"), F.col("other").alias("b")).distinct()


def variant_solutions(variants: DataFrame, solutions: DataFrame, incidence: DataFrame) -> DataFrame:
    """(question_id, variant_id, qid, rel_id, sim): the solutions of a variant's sub-question that share an entity with
    what it binds; all of them where none does or nothing is bound."""
    ents = solutions.join(incidence.select("rel_id", "ent_id"), "rel_id").groupBy("question_id", "qid", "rel_id", "sim").agg(F.collect_set("ent_id").alias("ents"))
    known = solutions.select("question_id", "qid", "rel_id", "sim").distinct().join(ents, ["question_id", "qid", "rel_id", "sim"], "left")
    pairs = variants.select("question_id", "variant_id", "qid", "bound").join(known, ["question_id", "qid"])
    hit = F.coalesce(F.arrays_overlap("bound", "ents"), F.lit(False))
    marked = pairs.withColumn("hit", hit).withColumn("any", F.max("hit").over(Window.partitionBy("question_id", "variant_id")))
    return marked.where("hit or not any").select("question_id", "variant_id", "qid", "rel_id", "sim")


def variant_paths(variants: DataFrame, edges: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(question_id, path_id, steps array<int>): simple paths over sub-questions, from anchor variants to the variants
    of the deepest level.

    Levels are steps from the anchors; only if there is no deeper level than theirs are single variants paths. Paths with
    the same sub-questions and bindings count once; the longest come first, a question keeps a fixed number of them. The
    number of steps is at most that of sub-questions.
    """
    v = cut(variants.select("question_id", "variant_id", "qid", "combo", "is_anchor"))
    any_anchor = v.groupBy("question_id").agg(F.max("is_anchor").alias("any"))
    starts = v.join(any_anchor, "question_id").where("is_anchor or not any").select("question_id", F.col("variant_id").alias("node"))
    from quillmesh.operators.graph import levels

    depth = levels(edges, ["question_id"], starts)
    deepest = depth.groupBy("question_id").agg(F.max("level").alias("level"))
    ends = cut(depth.join(deepest, ["question_id", "level"]).select("question_id", F.col("node").alias("end"), "level"))
    most = v.groupBy("question_id").agg(F.countDistinct("qid").alias("n")).agg(F.max("n")).first()[0] or 0
    front = cut(starts.join(v.select("question_id", F.col("variant_id").alias("node"), "qid"), ["question_id", "node"]).select("question_id", F.array("node").alias("steps"), F.array("qid").alias("qids")))
    done = front
    out = edges.join(v.select("question_id", F.col("variant_id").alias("b"), "qid"), ["question_id", "b"])
    out = cut(out.select("question_id", F.col("a").alias("at"), "b", "qid"))
    for _ in range(most - 1):
        grown = front.withColumn("at", F.element_at("steps", -1)).join(out, ["question_id", "at"]).where(~F.array_contains("qids", F.col("qid")))
        front = cut(grown.select("question_id", F.concat("steps", F.array("b")).alias("steps"), F.concat("qids", F.array("qid")).alias("qids")))
        if front.isEmpty():
            break
        done = cut(done.unionByName(front))
    reached = done.withColumn("end", F.element_at("steps", -1)).join(ends, ["question_id", "end"]).where((F.size("steps") > 1) | (F.col("level") == 0))
    combos = v.select("question_id", F.col("variant_id").alias("step"), "combo")
    keys = reached.select("question_id", "steps", "qids", F.explode("steps").alias("step")).join(combos, ["question_id", "step"]).groupBy("question_id", "steps", "qids").agg(F.array_sort(F.flatten(F.collect_list(F.transform("combo", lambda c: F.concat_ws("=", c["slot_key"], c["ent_id"].cast("string")))))).alias("bindings"))
    order = [F.desc(F.size("steps")), F.col("steps")]
    once = keys.withColumn("set", F.array_sort("qids")).withColumn("rn", F.row_number().over(Window.partitionBy("question_id", "set", "bindings").orderBy(*order))).where("rn = 1")
    numbered = once.withColumn("path_id", F.row_number().over(Window.partitionBy("question_id").orderBy(*order)) - 1)
    return numbered.where(F.col("path_id") < config.max_paths).select("question_id", "path_id", "steps")


def score_paths(paths: DataFrame, found: DataFrame, n_subq: DataFrame, config: RetrievalConfig = RetrievalConfig(), rule=adjacent_gap) -> tuple[DataFrame, DataFrame]:
    """(scores, segments) of paths from variant_solutions.

    scores(question_id, path_id, score): the sum, over the steps, of the mean similarity of the tightly chosen solutions,
    by the number of sub-questions; paths without any solution drop out. segments(question_id, path_id, place,
    variant_id, rel_id, sim, rn) are the widely chosen solutions of each step. `rule` chooses: adjacent_gap for variants,
    top1_gap for lineages.
    """
    by = ["question_id", "variant_id"]
    tight = rule(found, by, "sim", "rel_id", *config.tight).groupBy(*by).agg(F.avg("sim").alias("mean"))
    wide = rule(found, by, "sim", "rel_id", *config.wide)
    steps = paths.select("question_id", "path_id", F.posexplode("steps").alias("place", "variant_id"))
    sums = steps.join(tight, by).groupBy("question_id", "path_id").agg(F.sum("mean").alias("total"))
    scores = sums.join(n_subq, "question_id").select("question_id", "path_id", (F.col("total") / F.col("n")).alias("score"))
    segments = steps.join(wide, by).select("question_id", "path_id", "place", "variant_id", "rel_id", "sim", "rn")
    return scores, segments


def path_context(kept: DataFrame, segments: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, context): a paragraph a path in order of `place`, in it the texts of its relations, each once a path;
    paragraphs are set apart by an empty line. kept(question_id, path_id, place)."""
    rows = segments.withColumnRenamed("place", "step").join(kept.select("question_id", "path_id", "place"), ["question_id", "path_id"]).join(texts, "rel_id")
    first = rows.groupBy("question_id", "path_id", "place", "rel_id").agg(F.min(F.struct("step", "rn", "text")).alias("f"))
    lines = first.groupBy("question_id", "path_id", "place").agg(F.array_sort(F.collect_list(F.struct("f.step", "f.rn", "rel_id", "f.text"))).alias("l"))
    para = lines.select("question_id", "place", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("paragraph"))
    return para.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "paragraph"))), lambda x: x["paragraph"]), "\n\n").alias("context"))


def chunk_votes(segments: DataFrame, source: DataFrame, keep: int = 5) -> DataFrame:
    """(question_id, title, chunk, votes, rank): source passages by where a path first needs them, then by the number of
    different relations they gave; the first few. source(rel_id, title, chunk)."""
    rows = segments.join(source, "rel_id").groupBy("question_id", "title", "chunk").agg(F.countDistinct("rel_id").alias("votes"), F.min(F.struct("path_id", "place")).alias("first"))
    w = Window.partitionBy("question_id").orderBy("first", F.desc("votes"), "title", "chunk")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep).drop("first")


def chunk_context(votes: DataFrame, texts: DataFrame) -> DataFrame:
    """(question_id, context): the texts of the passages that chunk_votes kept, in its order, equal texts once.
    texts(chunk, text)."""
    rows = votes.join(texts, "chunk").where("text <> ''").groupBy("question_id", "text").agg(F.min("rank").alias("rank"))
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))


#: Fixed value: what heads a context of solutions that lie on no path.
SUPPLEMENT = "[Supplementary evidence (no valid reasoning path found)]"


def supplementary_context(solutions: DataFrame, texts: DataFrame, k: int = 20) -> DataFrame:
    """(question_id, context): the k most similar solutions of a question, a line each, under a heading."""
    best = top_k(solutions.groupBy("question_id", "rel_id").agg(F.max("sim").alias("sim")), ["question_id"], [F.desc("sim"), F.desc("rel_id")], k).join(texts, "rel_id")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")
    return best.groupBy("question_id").agg(F.concat(F.lit(SUPPLEMENT + "\n"), lines).alias("context"))
