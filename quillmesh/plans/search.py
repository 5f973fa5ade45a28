"""The whole retrieval over the graph tables, for the questions of `eval_item` (a fixed set).

A question stands for two sub-questions: the entity it means (composed retrieval) with an unknown person, and that person
with an unknown place. Its vector in `embeddings` serves for the question, its sub-questions and its slots; a relation's
vector is the mean of its entities' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh import programs as P
from quillmesh.config import RetrievalConfig
from quillmesh.functions import text as T
from quillmesh.operators import anchors as A
from quillmesh.operators import retrieval as R
from quillmesh.operators import search as S
from quillmesh.operators import variants as V
from quillmesh.plans.graphs import synonyms
from quillmesh.plans.retrieval import _ASKED, _cos, _ok, asked
from quillmesh.session import cut, parallelism
from quillmesh.sources.tables import table

#: The vectors stand in for a text encoder and are less alike than its vectors, so an entity matches from 0.3 on.
CONFIG = RetrievalConfig(match_threshold=0.3)
DIM = 64
#: Entity vectors that are broadcast at most (some 30 MB at single precision).
ENTITIES = 100_000
_TABLES: dict[tuple[str, str], tuple[P.Store, P.Asked]] = {}
_KEPT: dict[tuple[str, str], P.Prepared] = {}


def _mean_vectors(inc: DataFrame, ent: DataFrame) -> DataFrame:
    """(rel_id, vec): the mean of the vectors of a relation's entities, each at length 1 and as often as it stands in inc, at length 1.

    A relation's rows meet in one task, in order, and are summed up as a stream; where the entities' vectors fit into a
    broadcast, the narrow rows of inc are all that is shuffled.
    """
    parts, few = parallelism(inc.sparkSession), ent.limit(ENTITIES + 1).count() <= ENTITIES
    rows = inc.repartition(parts, "rel_id").join(F.broadcast(ent), "ent_id") if few else inc.join(ent, "ent_id").repartition(parts, "rel_id")
    rows = rows.where("rel_id is not null").select("rel_id", "ent_id", "vec").sortWithinPartitions("rel_id", "ent_id").select("rel_id", "vec")

    def means(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rel: np.ndarray, sums: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            ends = pa.array(np.arange(len(rel) + 1) * DIM, pa.int32())
            mean = sums / n[:, None]
            unit = mean / np.maximum(np.sqrt((mean * mean).sum(axis=1, keepdims=True)), 1e-8)
            return pa.RecordBatch.from_arrays([pa.array(rel, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(unit.ravel()))], ["rel_id", "vec"])

        rest = None
        for b in batches:
            rel = b.column(0).to_numpy()
            if not len(rel):
                continue
            vec = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM).astype(np.float64)
            vec = vec / np.sqrt((vec * vec).sum(axis=1, keepdims=True))
            first = np.flatnonzero(np.concatenate(([True], rel[1:] != rel[:-1])))
            ids, sums, n = rel[first], np.add.reduceat(vec, first, axis=0), np.diff(np.append(first, len(rel)))
            if rest is not None and rest[0][0] == ids[0]:
                sums[0] += rest[1][0]
                n[0] += rest[2][0]
            elif rest is not None:
                yield made(*rest)
            rest = ids[-1:], sums[-1:], n[-1:]
            yield made(ids[:-1], sums[:-1], n[:-1])
        if rest is not None:
            yield made(*rest)

    return rows.mapInArrow(means, "rel_id bigint, vec array<double>")


def store(spark: SparkSession, d: str) -> P.Store:
    e = table(spark, d, "entity").dropDuplicates(["ent_id"])
    usable = e.where(R._usable(F.col("embedding"), DIM) & R._usable(F.col("name_embedding"), DIM))
    # the norm stands outside the function of the elements, which would compute it again for each
    norm = lambda c: F.zip_with(F.col(c), F.array_repeat(F.sqrt(T.dot(F.col(c), F.col(c))), F.size(c)), lambda x, n: x / n)
    raw = cut(usable.select("ent_id", "display", T.entity_index_text(F.col("display"), F.col("definition")).alias("text"), "embedding", "name_embedding", "attribute"))
    ent = raw.select("ent_id", "display", "text", norm("embedding").alias("vec"), norm("name_embedding").alias("name_vec"), "attribute")
    inc = cut(table(spark, d, "incidence").select("rel_id", "ent_id", F.coalesce("is_title_edge", F.lit(False)).alias("is_title_edge")))
    unit = _mean_vectors(inc.select("rel_id", "ent_id"), raw.select("ent_id", F.col("embedding").alias("vec")))
    t, r = F.col("source_title"), F.col("relation")
    rel = table(spark, d, "fact").select("rel_id", T.relation_text(t, r).alias("text"), T.relation_index_text(t, r).alias("index_text"), "source_title", "chunk_id")
    return P.Store(ent, rel.join(unit, "rel_id"), inc, cut(synonyms(spark, d)))


def questions(spark: SparkSession, d: str) -> P.Asked:
    q = cut(asked(spark, d).select(F.col("query_id").alias("question_id"), F.col("vec").cast("array<double>").alias("vec"), "text"))
    subq = q.select("question_id", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("qid"), "text", "vec")
    slot = lambda qid, n, name, attribute: F.struct(F.lit(qid).cast("bigint").alias("qid"), F.lit(n).alias("slot"), F.lit(name).alias("name"), F.lit(attribute).alias("attribute"))
    unknown = q.select("question_id", "vec", F.explode(F.array(slot(0, 1, "x", "person"), slot(1, 0, "x", "person"), slot(1, 1, "y", "place"))).alias("s"))
    virtual = unknown.select("question_id", "vec", "s.*", F.lit(True).alias("virtual"), F.concat_ws(" ", "s.attribute", "s.name").alias("slot_key"), F.concat_ws(" ", "s.attribute", "s.name").alias("embed_text"))
    real = q.select("question_id", "vec", F.lit(0).cast("bigint").alias("qid"), F.lit(0).alias("slot"), F.col("text").alias("name"), F.lit("").alias("attribute"), F.lit(False).alias("virtual"), F.col("text").alias("slot_key"), F.col("text").alias("embed_text"))
    return P.Asked(q, subq, cut(real.unionByName(virtual)))


def tables(spark: SparkSession, d: str) -> tuple[P.Store, P.Asked]:
    """Store and questions; made once a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = store(spark, d), questions(spark, d)
    return _TABLES[key]


def prepared(spark: SparkSession, d: str) -> tuple[P.Store, P.Asked, P.Prepared]:
    """Store, questions and what the engines need of them; made once a session and folder."""
    s, q = tables(spark, d)
    key = (spark.sparkContext.applicationId, d)
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = P.prepare(s, q, CONFIG)
    return s, q, _KEPT[key]


def search_rounds(spark: SparkSession, d: str) -> DataFrame:
    _, _, p = prepared(spark, d)
    state = S.iterative_search(p.graph, p.questions, CONFIG)
    return state.solutions.select("question_id", "qid", "rel_id", F.round("sim", 6).alias("sim"), "round")


def variant_table(spark: SparkSession, d: str) -> DataFrame:
    _, _, p = prepared(spark, d)
    _, v, _, _ = P.solve(p, CONFIG)
    return v.select("question_id", "variant_id", "qid", F.array_join(F.transform("combo", lambda c: F.concat_ws("=", c["slot_key"], c["ent_id"].cast("string"))), ",").alias("combo"), F.size("bound").alias("n_bound"))


def contexts(spark: SparkSession, d: str) -> DataFrame:
    """The context of every question: paths of variants, scored, the best of each chain first, as text."""
    s, q, p = prepared(spark, d)
    return P.retrieve(s, q, CONFIG, "iterative", prepared=p)


def chunk_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Source passages of every question by the votes of its relations."""
    s, q, p = prepared(spark, d)
    chunks = table(spark, d, "chunk").select(F.col("chunk_id").alias("chunk"), "text")
    return P.retrieve(s, q, CONFIG, "iterative", "chunk", p, chunks)


def anchor_search(spark: SparkSession, d: str) -> DataFrame:
    """What the anchor-driven engine locks for each question."""
    _, _, p = prepared(spark, d)
    _, locked = A.anchor_search(p.graph, p.questions, CONFIG)
    return locked.select("question_id", "var_id", "rel_id", F.round("sim", 6).alias("sim"))


def anchor_contexts(spark: SparkSession, d: str) -> DataFrame:
    s, q, p = prepared(spark, d)
    return P.retrieve(s, q, CONFIG, "anchored", prepared=p)


def pagerank_contexts(spark: SparkSession, d: str) -> DataFrame:
    """Text of the best relations of every question by personalised PageRank from its anchors."""
    s, q = tables(spark, d)
    return P.retrieve(s, q, CONFIG, "pagerank")


def supplements(spark: SparkSession, d: str) -> DataFrame:
    """The most similar solutions of every question, for one that has no path."""
    s, _, p = prepared(spark, d)
    state = S.iterative_search(p.graph, p.questions, CONFIG)
    return V.supplementary_context(state.solutions, s.relation.select("rel_id", "text"))


def direct_contexts(spark: SparkSession, d: str) -> DataFrame:
    """What every question would get if it named nothing to start from: the relations most similar to it."""
    s, q = tables(spark, d)
    return P.direct_context(s, q.question)


QUERIES = {f.__name__: f for f in (search_rounds, variant_table, contexts, chunk_contexts, anchor_search, anchor_contexts, pagerank_contexts, supplements, direct_contexts)}

#: The engines are checked against plain versions in tests; what SQL can state is stated.
SQL: dict[str, str] = {
    "direct_contexts": f"""with {_ASKED}, e as (select distinct on (ent_id) ent_id, embedding::double[] v from entity where {_ok('embedding')} and {_ok('name_embedding')} order by ent_id), u as (select ent_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v from e),
        parts as (select rel_id, unnest(v) x, generate_subscripts(v, 1) i from incidence join u using (ent_id)), m as (select rel_id, i, avg(x) x from parts group by 1, 2), r as (select rel_id, list(x order by i) v from m group by 1),
        f as (select rel_id, v, case when coalesce(source_title, '') <> '' then '(' || source_title || ') ' || relation else relation end as text from r join fact using (rel_id)), ok as (select * from f where list_bool_or(list_transform(v, lambda x: x <> 0))),
        s as (select query_id question_id, text, row_number() over (partition by query_id order by round({_cos('a.vec', 'f.v')}, 9) desc, rel_id) rank from (select query_id, vec from asked) a, ok f qualify rank <= 20)
        select question_id, string_agg(text, chr(10) || chr(10) order by rank) context from s group by 1""",
}
