"""The programs a user runs over tables of their own: retrieve, evaluate, extract, report.

Tables are DataFrames with the columns named below; further columns are ignored. Vectors come from an encoder
(functions/models.py) or are precomputed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.functions import models
from quillmesh.functions import text as T
from quillmesh.operators import anchors as A
from quillmesh.operators import build as B
from quillmesh.operators import evaluation as E
from quillmesh.operators import graph as G
from quillmesh.operators import retrieval as R
from quillmesh.operators import scan as C
from quillmesh.operators import search as S
from quillmesh.operators import skeleton
from quillmesh.operators import variants as V
from quillmesh.operators.skew import bounded
from quillmesh.session import cut

ENGINES = ("iterative", "anchored", "pagerank")


@dataclass
class Store:
    """entity(ent_id, display, text, attribute, vec, name_vec), relation(rel_id, text, index_text, source_title, chunk_id,
    vec), incidence(rel_id, ent_id, is_title_edge), synonym(a, b, similarity). entity.text and relation.index_text are
    what the lexical index sees."""

    entity: DataFrame
    relation: DataFrame
    incidence: DataFrame
    synonym: DataFrame


@dataclass
class Asked:
    """question(question_id, text, vec), subq(question_id, qid, text, vec), slots(question_id, qid, slot, slot_key, name,
    attribute, virtual, embed_text, vec), see skeleton.slots_of."""

    question: DataFrame
    subq: DataFrame
    slots: DataFrame


@dataclass
class Prepared:
    """What the engines read; made once for a store and its questions."""

    graph: S.Graph
    questions: S.Questions
    chains: DataFrame
    bindings: DataFrame


def prepare(store: Store, asked: Asked, config: RetrievalConfig = RetrievalConfig()) -> Prepared:
    """Anchors of real slots with their synonyms, lexical scores and seed relations, as the engines need them.

    A name that several slots have is looked up once. Relations are scored lexically once for every different text among
    questions and sub-questions. Seeds are, for the question and its sub-questions with a real slot, the lexically best
    relations, of these the most similar.
    """
    graph = S.Graph(store.relation.select("rel_id", "vec"), cut(store.entity.select("ent_id", "vec", "name_vec", "attribute")), store.incidence, cut(store.synonym))
    real = store_slots = asked.slots.where("not virtual")
    names = real.select(F.col("embed_text").alias("query_id"), F.col("embed_text").alias("text"), "vec").dropDuplicates(["query_id"])
    docs = store.entity.select(F.col("ent_id").alias("doc_id"), "text", "vec", "name_vec")
    meant = R.composed_retrieve(docs, names, config.bm25_top).select(F.col("query_id").alias("embed_text"), F.col("doc_id").alias("ent_id"))
    found = cut(B.locate_anchors(store_slots.select("question_id", "slot_key", "embed_text").join(meant, "embed_text").select("question_id", "slot_key", "ent_id"), graph.synonym))
    start = cut(found.select("question_id", "ent_id").distinct())

    anchored = asked.subq.join(real.select("question_id", "qid").distinct(), ["question_id", "qid"], "left_semi")
    texts = asked.question.select("text", "vec").unionByName(asked.subq.select("text", "vec")).where("text is not null").dropDuplicates(["text"]).select(F.col("text").alias("query_id"), "text", "vec")
    rel_docs = store.relation.select(F.col("rel_id").alias("doc_id"), F.col("index_text").alias("text"))
    postings, weights, pool = C.index_texts(rel_docs, texts.select("query_id", "text"), config.bm25_top)
    index = C.Index(postings, cut(asked.subq.select("question_id", "qid", F.col("text").alias("query_id")).join(weights, "query_id").drop("query_id")))
    graph.cards = C.cards(graph.relation, store.incidence, index)
    # the few relations of the pool are picked before vectors are shuffled
    pool = cut(pool)
    rel_docs = graph.cards.select(F.col("rel_id").alias("doc_id"), "vec").join(bounded(pool.select("doc_id").distinct(), R.BROADCAST_ROWS), "doc_id", "left_semi")
    near = R.top_k(R.rerank(pool.select("query_id", "doc_id"), rel_docs, texts, ("vec",)), ["query_id"], [F.desc("sim"), F.col("doc_id")], config.seed_top)
    sought = asked.question.join(anchored.select("question_id").distinct(), "question_id", "left_semi").select("question_id", "text").unionByName(anchored.select("question_id", "text")).withColumnRenamed("text", "query_id").distinct()
    seeds = sought.join(near, "query_id").select("question_id", F.col("doc_id").alias("rel_id")).distinct()
    vec = F.col("vec").cast("array<double>").alias("vec")
    questions = S.Questions(cut(asked.subq.select("question_id", "qid", vec)), cut(asked.slots.withColumn("vec", vec)), start, index.scores(), cut(seeds), found, index)
    bindings = B.anchor_bindings(asked.slots, start, store.entity)
    return Prepared(graph, questions, cut(skeleton.chains(asked.slots)), cut(bindings))


def subquestion_counts(q: S.Questions) -> DataFrame:
    return q.subq.groupBy("question_id").agg(F.countDistinct("qid").alias("n"))


def solve(p: Prepared, config: RetrievalConfig) -> tuple[S.State, DataFrame, DataFrame, DataFrame]:
    """The iterative engine: (state, variants, scores of paths, segments of paths)."""
    state = S.iterative_search(p.graph, p.questions, config)
    bound = state.bindings.join(state.similar, ["question_id", "slot_key", "ent_id"])
    variants = cut(V.build_variants(p.questions.slots, bound, p.bindings, config))
    found = cut(V.variant_solutions(variants, state.solutions.select("question_id", "qid", "rel_id", "sim"), p.graph.incidence))
    paths = cut(V.variant_paths(variants, cut(V.variant_edges(variants)), config))
    scores, segments = V.score_paths(paths, found, subquestion_counts(p.questions), config)
    first = paths.select("question_id", "path_id", F.element_at("steps", 1).alias("variant_id")).join(variants.select("question_id", "variant_id", "qid"), ["question_id", "variant_id"])
    return state, variants, _with_chain(scores, first, p.chains), segments


def solve_anchored(p: Prepared, config: RetrievalConfig) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The anchor-driven engine: (variants, locked, scores of paths, segments of paths)."""
    variants, locked = A.anchor_search(p.graph, p.questions, config)
    paths = cut(A.lineage_paths(variants, locked))
    scores, segments = V.score_paths(paths, locked.withColumn("variant_id", F.col("var_id")), subquestion_counts(p.questions), config, R.top1_gap)
    first = paths.select("question_id", "path_id", F.element_at("steps", 1).alias("var_id")).join(variants.select("question_id", "var_id", "qid"), ["question_id", "var_id"])
    return variants, locked, _with_chain(scores, first, p.chains), segments


def _with_chain(scores: DataFrame, first: DataFrame, chains: DataFrame) -> DataFrame:
    """Adds the chain of a path's first sub-question; -1 where it has none."""
    mine = first.select("question_id", "path_id", "qid").join(chains, ["question_id", "qid"], "left").select("question_id", "path_id", F.coalesce("chain", F.lit(-1)).alias("chain"))
    return scores.join(mine, ["question_id", "path_id"])


def shown_paths(scores: DataFrame, config: RetrievalConfig, by_chain: bool = True) -> DataFrame:
    """(question_id, path_id, place): the paths that are shown, the best of each chain first, or just the best."""
    ranked = scores.select(F.col("question_id").alias("query_id"), "path_id", (F.col("chain") if by_chain else F.lit(0)).alias("chain"), F.round("score", 9).alias("score"))
    return cut(R.best_per_chain(ranked, config.top_paths).withColumnRenamed("query_id", "question_id"))


def direct_context(store: Store, questions: DataFrame, k: int = 20) -> DataFrame:
    """(question_id, context): the k relations most similar to a question, set apart by empty lines; for questions that
    name nothing to start from."""
    near = R.dense_top_k(store.relation.select(F.col("rel_id").alias("doc_id"), "vec"), questions.select(F.col("question_id").alias("query_id"), "vec"), k)
    rows = near.join(store.relation.select(F.col("rel_id").alias("doc_id"), "text"), "doc_id")
    return rows.groupBy(F.col("query_id").alias("question_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))


def pagerank_context(store: Store, questions: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(question_id, context): the best relations of every question by PageRank from the entities most similar to it, a
    line each."""
    docs = store.entity.select(F.col("ent_id").alias("doc_id"), "vec", "name_vec")
    near = R.dense_top_k(docs, questions.select(F.col("question_id").alias("query_id"), "vec"), config.pagerank_anchors, ("vec", "name_vec"))
    anchors = R.anchors_above(near, config.pagerank_anchors, config.pagerank_floor).select(F.col("query_id").alias("question_id"), F.col("doc_id").alias("vertex"), F.greatest("sim", F.lit(1e-3)).alias("weight"))
    best = G.pagerank_top(G.weighted_edges(store.incidence, store.synonym), cut(anchors), config.pagerank_top, config.pagerank_alpha)
    rows = best.withColumn("rel_id", -1 - F.col("vertex")).join(store.relation.select("rel_id", "text"), "rel_id").where("text <> ''")
    return rows.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("context"))


def retrieve(store: Store, asked: Asked, config: RetrievalConfig = RetrievalConfig(), engine: str = "iterative", mode: str = "relation", prepared: Prepared | None = None, chunks: DataFrame | None = None) -> DataFrame:
    """(question_id, context, n_paths, fallback) of every question.

    engine: iterative (thresholded rounds, variants, paths), anchored (lineages of anchors) or pagerank. mode: relation
    or, for the iterative engine, chunk (whole source passages by vote; chunks(chunk, text)). A question without a real
    slot gets the relations most similar to it (no_anchor_direct_search); one whose slots mean nothing an empty context
    (no_ke1), as does one without a path (yes_empty).
    """
    assert engine in ENGINES and mode in ("relation", "chunk")
    everyone = asked.question.select("question_id").distinct()
    texts = store.relation.select("rel_id", "text")
    if engine == "pagerank":
        made = pagerank_context(store, asked.question, config)
        return everyone.join(made, "question_id", "left").select("question_id", F.coalesce("context", F.lit("")).alias("context"), F.col("context").isNotNull().cast("int").alias("n_paths"), F.when(F.col("context").isNull(), "ppr_empty").otherwise("no").alias("fallback"))
    p = prepared or prepare(store, asked, config)
    if engine == "iterative":
        _, _, scores, segments = solve(p, config)
    else:
        _, _, scores, segments = solve_anchored(p, config)
    kept = shown_paths(scores, config, by_chain=engine == "iterative")
    if mode == "chunk":
        source = store.relation.select("rel_id", F.coalesce("source_title", F.lit("")).alias("title"), F.col("chunk_id").alias("chunk")).where("chunk is not null")
        placed = segments.join(kept.select("question_id", "path_id", F.col("place").alias("at")), ["question_id", "path_id"]).drop("path_id").withColumnRenamed("at", "path_id")
        context = V.chunk_context(V.chunk_votes(placed, source), chunks)
    else:
        context = V.path_context(kept, segments, texts)
    paths = scores.groupBy("question_id").agg(F.count("*").cast("int").alias("n_paths"))
    open_ = asked.question.join(asked.slots.where("not virtual").select("question_id").distinct(), "question_id", "left_anti")
    direct = direct_context(store, open_).select("question_id", F.col("context").alias("direct"))
    rows = everyone.join(context, "question_id", "left").join(paths, "question_id", "left").join(p.questions.start.select("question_id").distinct().withColumn("found", F.lit(True)), "question_id", "left")
    rows = rows.join(open_.select("question_id").distinct().withColumn("open", F.lit(True)), "question_id", "left").join(direct, "question_id", "left")
    reason = F.when(F.col("open"), "no_anchor_direct_search").when(F.col("found").isNull(), "no_ke1").when(F.coalesce("context", F.lit("")) == "", "yes_empty").otherwise("no")
    shown = F.when(F.col("open"), F.col("direct")).otherwise(F.col("context"))
    return rows.select("question_id", F.coalesce(shown, F.lit("")).alias("context"), F.when(F.col("open"), 0).otherwise(F.coalesce("n_paths", F.lit(0))).alias("n_paths"), reason.alias("fallback"))


def answer(retrieved: DataFrame, questions: DataFrame, load, priming: str = "reasoning-first") -> DataFrame:
    """Answers of a language model over retrieve's contexts, scored: adds raw, pred, reasoning, em, f1, mark, error.

    questions(question_id, question, gold). Questions without context are not asked. load() gives a function from
    (prompt, may it think?) to (text, tokens); an empty text is asked for once more without thinking, and tokens add up.
    """
    rows = retrieved.join(questions.select("question_id", "question", "gold"), "question_id")
    prompt = F.when(F.coalesce(F.trim("context"), F.lit("")) != "", E.answer_prompt(F.col("context"), F.col("question"), priming))
    return E.evaluate(models.ask_twice(rows.withColumn("prompt", prompt), "prompt", load).drop("prompt"))


def extract(chunks: DataFrame, load, simple_prompt=None, candidates: Column | None = None) -> DataFrame:
    """(chunk_id, title, status, payload, is_table) of an extraction by one call, and one more with a simpler prompt where the
    first gave no event. chunks(chunk_id, title, text); payload is for build.load_events.

    load() gives a function from a prompt to JSON text. Null candidates are left out of the prompt.
    """
    none = F.lit(None).cast("array<string>")
    prompt = B.extraction_prompt(F.col("title"), F.col("text"), candidates if candidates is not None else none)
    first = models.ask(chunks.withColumn("prompt", prompt), "prompt", load, "first")
    again = simple_prompt(F.col("text")) if simple_prompt else B.extraction_prompt(F.lit(None).cast("string"), F.col("text"), none)
    counted = first.withColumn("n1", B.event_count(F.col("first")))
    second = models.ask(counted.withColumn("prompt", F.when(F.coalesce("n1", F.lit(0)) == 0, again)), "prompt", load, "second").withColumn("n2", B.event_count(F.col("second")))
    payload = F.when(F.col("n1") > 0, F.col("first")).when(F.col("n2") > 0, F.col("second"))
    return second.select("chunk_id", "title", B.extraction_status(F.col("n1"), F.col("n2")).alias("status"), payload.alias("payload"), T.is_table_or_list(F.col("text")).alias("is_table"))


def extract_refined(chunks: DataFrame, recognise, refine, decouple) -> DataFrame:
    """(chunk_id, title, names, refined, events) by two calls: refine turns recognised names into entity records, decouple
    splits the text into events over these. The three are loaders: recognise() gives a function from texts to lists of
    names, the others from a prompt to JSON text. An answer that cannot be read gives null."""
    named = chunks.withColumn("names", models.recognise(F.col("text"), recognise))
    a = models.ask(named.withColumn("prompt", B.refine_prompt(F.col("title"), F.col("text"), F.col("names"))), "prompt", refine, "raw")
    records = F.from_json(T.json_array(F.col("raw")), "array<struct<name:string,attribute:string,definition:string>>")
    kept = a.withColumn("refined", records).drop("raw")
    b = models.ask(kept.withColumn("prompt", B.decouple_prompt(F.col("text"), F.col("refined"))), "prompt", decouple, "raw")
    events = F.from_json(T.json_array(F.col("raw")), "array<struct<relation:string,entities:array<string>>>")
    return b.select("chunk_id", "title", "names", "refined", events.alias("events"))
