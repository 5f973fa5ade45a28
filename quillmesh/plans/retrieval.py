"""Queries of lexical and dense retrieval and of the rules of choice.

The queries are the questions of `eval_item` (a fixed set); their vectors stand in `embeddings` under the same number.
Documents are entities (index text and both vectors) or facts (index text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import retrieval as R
from quillmesh.sources.tables import table


def entity_docs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entity").dropDuplicates(["ent_id"])
    return e.select(F.col("ent_id").alias("doc_id"), T.entity_index_text(F.col("display"), F.col("definition")).alias("text"), F.col("embedding").alias("vec"), F.col("name_embedding").alias("name_vec"))


def fact_docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "fact").select(F.col("rel_id").alias("doc_id"), T.relation_index_text(F.col("source_title"), F.col("relation")).alias("text"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_item").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    return items.join(vectors, "query_id")


def bm25_facts(spark: SparkSession, d: str) -> DataFrame:
    s = R.bm25_scores(fact_docs(spark, d), asked(spark, d).select("query_id", "text")).withColumn("score", F.round("score", 9))
    return R.top_k(s, ["query_id"], [F.desc("score"), F.col("doc_id")], 20).select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def bm25_norm(spark: SparkSession, d: str) -> DataFrame:
    s = R.normalized_scores(R.bm25_scores(entity_docs(spark, d).select("doc_id", "text"), asked(spark, d).select("query_id", "text")))
    return s.select("query_id", "doc_id", F.round("score", 6).alias("score"))


def hybrid_retrieve(spark: SparkSession, d: str) -> DataFrame:
    return R.hybrid_retrieve(entity_docs(spark, d), asked(spark, d)).select("query_id", "doc_id", F.col("sim"), "rank")


def seed_documents(spark: SparkSession, d: str) -> DataFrame:
    """What the queries find together, each once."""
    return R.hybrid_retrieve(entity_docs(spark, d), asked(spark, d)).select("doc_id").distinct()


def composed_entity(spark: SparkSession, d: str) -> DataFrame:
    return R.composed_retrieve(entity_docs(spark, d), asked(spark, d)).select("query_id", "doc_id", F.col("sim"))


def _dense(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return R.dense_top_k(entity_docs(spark, d), asked(spark, d), k)


def _dual(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return R.dense_top_k(entity_docs(spark, d), asked(spark, d), k, ("vec", "name_vec"))


def dense_direct(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d).select("query_id", "doc_id", F.col("sim"), "rank")


def pagerank_anchors(spark: SparkSession, d: str) -> DataFrame:
    return R.anchors_above(_dual(spark, d, 5), 5, 0.3).select("query_id", "doc_id", F.col("sim"), "rank")


def adaptive_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return R.adjacent_gap(_dense(spark, d), ["query_id"], "sim", "doc_id", 2, 8, 0.01).select("query_id", "doc_id", "rn")


def adaptive_top1(spark: SparkSession, d: str) -> DataFrame:
    return R.top1_gap(_dense(spark, d), ["query_id"], "sim", "doc_id", 1, 5, 0.05, 0.2).select("query_id", "doc_id", "rn")


def winner_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Each entity goes to the best of the questions that it is near enough to: within 0.1 of the question's nearest."""
    near = R.dense_above(entity_docs(spark, d), asked(spark, d), slack=0.1)
    scores = near.select("doc_id", "query_id", F.col("sim").alias("score"))
    return R.assign_winners(scores, ["doc_id"], "query_id", 0.1).select("doc_id", "query_id", F.col("score"))


def tied_winners(spark: SparkSession, d: str) -> DataFrame:
    """All questions that an entity is as near to as to the nearest, but for 0.05, and at 0.3 at least."""
    near = R.dense_above(entity_docs(spark, d), asked(spark, d), floor=0.3)
    scores = near.select("doc_id", "query_id", F.col("sim").alias("score"))
    return R.tied_winners(scores, ["doc_id"], 0.05, 0.3).select("doc_id", "query_id", F.col("score"))


def synonym_edges(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of entities whose mean cosine of both vectors is at least 0.85."""
    return R.similar_pairs(entity_docs(spark, d), 0.85)


def error_sample(spark: SparkSession, d: str) -> DataFrame:
    return R.seeded_sample(table(spark, d, "chunk").where("status = 'failed'").select("chunk_id"), "chunk_id", 50, 42).select("chunk_id")


QUERIES = {f.__name__: f for f in (bm25_facts, bm25_norm, hybrid_retrieve, seed_documents, composed_entity, dense_direct, pagerank_anchors, adaptive_adjacent, adaptive_top1, winner_assignment, tied_winners, synonym_edges, error_sample)}

_ASKED = "asked as (select item_id query_id, question as text, embedding::double[] vec from eval_item join embeddings on vec_id = item_id)"
_ENT = "ent as (select distinct on (ent_id) ent_id doc_id, display || ': ' || coalesce(definition, '') as text, embedding::double[] vec, name_embedding::double[] name_vec from entity order by ent_id, loaded_at)"
_FACT = "ent as (select rel_id doc_id, case when coalesce(source_title, '') <> '' then '(' || source_title || ': (' || source_title || ') ' || relation || ')' else relation end as text from fact)"
_BM25 = """dt as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') t from ent), dl as (select doc_id, len(t) dl from dt), st as (select count(*) n, avg(dl) avgdl from dl),
    tf as (select doc_id, term, count(*) tf from (select doc_id, unnest(t) term from dt) group by 1, 2), df as (select term, count(*) df from tf group by 1),
    idf0 as (select term, ln(n - df + 0.5e0) - ln(df + 0.5e0) idf from df, st), mi as (select avg(idf) m from idf0), idf as (select term, case when idf < 0 then 0.25e0 * m else idf end idf from idf0, mi),
    qt as (select query_id, term, count(*) times from (select query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) term from asked) group by 1, 2),
    sc as (select query_id, doc_id, sum(times * idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) score from qt join idf using (term) join tf using (term) join dl using (doc_id), st group by 1, 2)"""


def _ok(v: str) -> str:
    return f"(len({v}) = 64 and list_bool_and(list_transform({v}, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform({v}, lambda x: x <> 0)))"


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"


_DENSE = f"sims as (select query_id, doc_id, round({_cos('a.vec', 'e.vec')}, 9) sim from asked a, (select * from ent where {_ok('vec')}) e), top as (select *, row_number() over (partition by query_id order by sim desc, doc_id) rank from sims qualify rank <= 20)"
_DUAL = f"sims as (select query_id, doc_id, round(({_cos('a.vec', 'e.vec')} + {_cos('a.vec', 'e.name_vec')}) / 2e0, 9) sim from asked a, (select * from ent where {_ok('vec')} and {_ok('name_vec')}) e), top as (select *, row_number() over (partition by query_id order by sim desc, doc_id) rank from sims qualify rank <= 20)"
_HYBRID = f"pool as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) r from sc qualify r <= 100), re as (select query_id, doc_id, round({_cos('a.vec', 'e.vec')}, 9) sim from pool join asked a using (query_id) join (select doc_id, vec from ent where {_ok('vec')}) e using (doc_id)), fin as (select *, row_number() over (partition by query_id order by sim desc, doc_id) rank from re qualify rank <= 10)"

SQL = {
    "bm25_facts": f"with {_ASKED}, {_FACT}, {_BM25} select query_id, doc_id, round(score, 6) score, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) rank from sc qualify rank <= 20",
    "bm25_norm": f"with {_ASKED}, {_ENT}, {_BM25}, p as (select query_id, max(score) peak from sc group by 1) select query_id, doc_id, round(case when peak > 0 then score / peak else 0 end, 6) score from sc join p using (query_id)",
    "hybrid_retrieve": f"with {_ASKED}, {_ENT}, {_BM25}, {_HYBRID} select query_id, doc_id, sim, rank from fin",
    "seed_documents": f"with {_ASKED}, {_ENT}, {_BM25}, {_HYBRID} select distinct doc_id from fin",
    "composed_entity": f"""with {_ASKED}, {_ENT}, {_BM25}, allp as (select a.query_id, e.doc_id, coalesce(round(score, 9), 0) score from asked a cross join ent e left join sc on sc.query_id = a.query_id and sc.doc_id = e.doc_id),
        pool as (select *, row_number() over (partition by query_id order by score desc, doc_id) r from allp qualify r <= 100),
        re as (select query_id, doc_id, round(({_cos('a.vec', 'e.vec')} + {_cos('a.vec', 'e.name_vec')}) / 2e0, 9) sim from pool join asked a using (query_id) join (select * from ent where {_ok('vec')} and {_ok('name_vec')}) e using (doc_id))
        select query_id, doc_id, sim from re qualify row_number() over (partition by query_id order by sim desc, doc_id) = 1""",
    "dense_direct": f"with {_ASKED}, {_ENT}, {_DENSE} select query_id, doc_id, sim, rank from top",
    "pagerank_anchors": f"with {_ASKED}, {_ENT}, {_DUAL} select query_id, doc_id, sim, rank from top where (rank <= 5 and sim >= 0.3e0) or rank = 1",
    "adaptive_adjacent": f"with {_ASKED}, {_ENT}, {_DENSE}, g as (select query_id, doc_id, rank rn, round(lag(sim) over (partition by query_id order by rank) - sim, 9) drp from top), b as (select *, max(case when rn > 2 and drp > 0.01e0 then 1 else 0 end) over (partition by query_id order by rn rows unbounded preceding) br from g where rn <= 8) select query_id, doc_id, rn from b where rn <= 2 or br = 0",
    "adaptive_top1": f"with {_ASKED}, {_ENT}, {_DENSE}, g as (select query_id, doc_id, sim, row_number() over (partition by query_id order by sim desc, doc_id) rn, max(sim) over (partition by query_id) best from top where sim >= 0.2e0) select query_id, doc_id, rn from g where rn <= 5 and (rn <= 1 or round(best - sim, 9) <= 0.05e0)",
    "winner_assignment": f"with {_ASKED}, {_ENT}, {_DENSE}, e as (select *, max(sim) over (partition by query_id) best from sims) select doc_id, query_id, sim score from e where round(sim - best, 9) >= -0.1e0 qualify row_number() over (partition by doc_id order by sim desc, query_id) = 1",
    "tied_winners": f"with {_ASKED}, {_ENT}, {_DENSE}, e as (select *, max(sim) over (partition by doc_id) best from sims where sim >= 0.3e0) select doc_id, query_id, sim score from e where round(best - sim, 9) <= 0.05e0",
    "synonym_edges": f"with {_ENT}, u as (select doc_id, vec, name_vec from ent where {_ok('vec')} and {_ok('name_vec')}), p as (select x.doc_id a, y.doc_id b, round(({_cos('x.vec', 'y.vec')} + {_cos('x.name_vec', 'y.name_vec')}) / 2e0, 9) s from u x join u y on x.doc_id < y.doc_id) select a, b, round(s, 4) similarity from p where s >= 0.85e0",
    "error_sample": "select chunk_id from chunk where status = 'failed' order by md5('42|' || chunk_id::varchar), chunk_id limit 50",
}
