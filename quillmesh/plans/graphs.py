"""Queries over the graph tables and over sub-questions.

A fact stands for a sub-question of the chunk it comes from; its entities are the slots; dates, years and numbers are
virtual slots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.operators import skeleton as S
from quillmesh.sources.tables import table

#: Rounds that the SQL writes out; far fewer are needed.
ROUNDS = 16


def synonyms(spark: SparkSession, d: str) -> DataFrame:
    return G.named_synonyms(table(spark, d, "synonym_pair"), table(spark, d, "entity"))


def entity_relations(spark: SparkSession, d: str) -> DataFrame:
    inc = table(spark, d, "incidence")
    ents = table(spark, d, "entity").select("ent_id", F.col("ent_id").alias("entity")).distinct()
    return G.relations_of(inc, ents).groupBy("entity").agg(F.count("*").alias("n_relations"), F.sum("rel_id").alias("rel_sum"))


def relation_entities(spark: SparkSession, d: str) -> DataFrame:
    rels = table(spark, d, "fact").select("rel_id", F.col("rel_id").alias("relation"))
    return G.entities_of(table(spark, d, "incidence"), rels).groupBy("relation").agg(F.count("*").alias("n_entities"), F.sum("ent_id").alias("ent_sum"))


def synonym_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return G.symmetric(synonyms(spark, d)).groupBy("ent_id").agg(F.count("*").alias("n"), F.max("similarity").alias("nearest"), F.sum("other").alias("other_sum"))


def two_hop(spark: SparkSession, d: str) -> DataFrame:
    """Entities that share a relation with an entity and are no synonym of it."""
    inc = table(spark, d, "incidence")
    ents = table(spark, d, "entity").select("ent_id", F.col("ent_id").alias("entity")).distinct()
    reached = G.entities_of(inc, G.relations_of(inc, ents)).where("ent_id <> entity")
    known = G.symmetric(synonyms(spark, d)).select(F.col("ent_id").alias("entity"), F.col("other").alias("ent_id"))
    return reached.join(known, ["entity", "ent_id"], "left_anti").groupBy("entity").agg(F.count("*").alias("n"), F.sum("ent_id").alias("ent_sum"))


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    """From the ten entities that everything mentions, until it has converged."""
    edges = G.weighted_edges(table(spark, d, "incidence"), synonyms(spark, d))
    anchors = table(spark, d, "entity").where("ent_id <= 10").select(F.col("ent_id").alias("vertex")).distinct().withColumn("weight", F.lit(1.0))
    return G.pagerank(edges, anchors).select("vertex", F.round("score", 9).alias("score"))


def slots(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "fact").where("chunk_id is not null").select(F.col("chunk_id").alias("question_id"), F.col("rel_id").alias("qid"), F.posexplode("entities").alias("slot", "e"))
    rows = f.select("question_id", "qid", "slot", F.lower("e.name").alias("name"), F.coalesce("e.attribute", F.lit("")).alias("attribute"))
    return S.slots_of(rows.withColumn("virtual", F.col("attribute").isin("date", "year", "number")))


def slot_table(spark: SparkSession, d: str) -> DataFrame:
    return slots(spark, d).select("question_id", "qid", "slot_key", "slot", "virtual", "embed_text")


def subquestion_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return S.neighbours(slots(spark, d)).groupBy("question_id", "qid").agg(F.count("*").alias("n"), F.sum("other").alias("other_sum"))


def chains(spark: SparkSession, d: str) -> DataFrame:
    return S.chains(slots(spark, d))


def slot_levels(spark: SparkSession, d: str) -> DataFrame:
    return S.slot_levels(slots(spark, d))


def attribute_fit(spark: SparkSession, d: str) -> DataFrame:
    """How many entities may fill a slot of each attribute that has a family."""
    fam = S.attribute_families(spark).select("slot_attr").distinct()
    ents = table(spark, d, "entity").dropDuplicates(["ent_id"]).groupBy("attribute").agg(F.count("*").alias("n"))
    # both sides are vocabularies
    fits = fam.join(F.broadcast(ents), S.compatible(F.col("slot_attr"), F.col("attribute")))
    return fits.groupBy("slot_attr").agg(F.sum("n").alias("n"))


QUERIES = {f.__name__: f for f in (entity_relations, relation_entities, synonym_neighbours, two_hop, pagerank, slot_table, subquestion_neighbours, chains, slot_levels, attribute_fit)}

_KEY = "trim(regexp_replace(lower(regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '^ent::', ''))"
_SYN = f"names as (select distinct {_KEY.format('canonical')} k, ent_id from entity), prs as (select distinct pair_id, {_KEY.format('a')} ka, {_KEY.format('b')} kb, similarity from synonym_pair), syn as (select x.ent_id a, y.ent_id b, similarity from prs join names x on x.k = ka join names y on y.k = kb), sym as (select ent_id, other, max(similarity) similarity from (select a ent_id, b other, similarity from syn union all select b, a, similarity from syn) t where ent_id <> other group by 1, 2)"
_SLOTS = "raw as (select chunk_id question_id, rel_id qid, unnest(entities) e, generate_subscripts(entities, 1) - 1 slot from fact where chunk_id is not null), named as (select question_id, qid, slot, lower(e.name) as name, coalesce(e.attribute, '') attribute, coalesce(e.attribute, '') in ('date', 'year', 'number') virtual from raw), keyed as (select *, case when virtual then regexp_replace(concat_ws(' ', attribute, name), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') else name end slot_key, regexp_replace(concat_ws(' ', attribute, name), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') embed_text from named), slots as (select * from keyed qualify row_number() over (partition by question_id, qid, slot_key order by slot) = 1)"


def _pagerank_sql() -> str:
    steps = ["x0 as (select vertex, p, 1e0 / (select count(*) from nodes) score from nodes)"]
    for i in range(1, ROUNDS + 1):
        steps.append(f"x{i} as (select n.vertex, n.p, 0.5e0 * coalesce(g.got, 0) + (0.5e0 * l.lost + 0.5e0) * n.p score from nodes n left join (select v, sum(score * share) got from shares join x{i - 1} on vertex = u group by v) g on g.v = n.vertex, (select coalesce(sum(score), 0) lost from x{i - 1} where vertex not in (select u from both_ways)) l)")
    return f"""with {_SYN}, e0 as (select -1 - rel_id u, ent_id v, 1e0 w from incidence union all select least(a, b), greatest(a, b), similarity from syn where a <> b), e1 as (select u, v, sum(w) w from e0 group by 1, 2),
        both_ways as (select u, v, w from e1 union all select v, u, w from e1), shares as (select u, v, w / sum(w) over (partition by u) share from both_ways), anchors as (select distinct ent_id vertex from entity where ent_id <= 10),
        nodes as (select coalesce(b.u, a.vertex) vertex, case when a.vertex is null then 0 else 1e0 / (select count(*) from anchors) end p from (select distinct u from both_ways) b full join anchors a on a.vertex = b.u), {', '.join(steps)},
        every as ({' union all '.join(f'select {i} i, n.vertex, n.score, abs(n.score - o.score) moved from x{i} n join x{i - 1} o using (vertex)' for i in range(1, ROUNDS + 1))}), ends as (select i from every group by i having sum(moved) < (select count(*) from nodes) * 1e-6)
        select vertex, round(score, 9) score from every where i = (select min(i) from ends)"""


SQL = {
    "entity_relations": "select e.ent_id entity, count(distinct rel_id) n_relations, sum(distinct rel_id)::bigint rel_sum from (select distinct ent_id from entity) e join incidence using (ent_id) group by 1",
    "relation_entities": "select rel_id relation, count(distinct ent_id) n_entities, sum(distinct ent_id)::bigint ent_sum from fact join incidence using (rel_id) group by 1",
    "synonym_neighbours": f"with {_SYN} select ent_id, count(*) n, max(similarity) nearest, sum(other)::bigint other_sum from sym group by 1",
    "two_hop": f"with {_SYN}, r as (select distinct x.ent_id entity, y.ent_id from incidence x join incidence y using (rel_id) where x.ent_id <> y.ent_id and x.ent_id in (select ent_id from entity)) select entity, count(*) n, sum(ent_id)::bigint ent_sum from r where not exists (select 1 from sym where sym.ent_id = entity and other = r.ent_id) group by 1",
    "pagerank": _pagerank_sql(),
    "slot_table": f"with {_SLOTS} select question_id, qid, slot_key, slot, virtual, embed_text from slots",
    "subquestion_neighbours": f"with {_SLOTS} select x.question_id, x.qid, count(distinct y.qid) n, sum(distinct y.qid)::bigint other_sum from slots x join slots y on x.question_id = y.question_id and x.slot_key = y.slot_key and x.qid <> y.qid group by 1, 2",
    "chains": f"""with recursive {_SLOTS}, nb as (select distinct x.question_id, x.qid a, y.qid b from slots x join slots y using (question_id, slot_key)), r(question_id, qid, o) as (select question_id, a, b from nb union select r.question_id, r.qid, nb.b from r join nb on nb.question_id = r.question_id and nb.a = r.o),
        m as (select question_id, qid, min(o) first from r group by 1, 2) select question_id, qid, dense_rank() over (partition by question_id order by first) - 1 chain from m""",
    "slot_levels": f"""with recursive {_SLOTS}, b as (select question_id, 'q' || qid a, 's' || slot_key b from slots), nb as (select * from b union all select question_id, b, a from b), r(question_id, node, level) as (select distinct question_id, 's' || slot_key, 0 from slots where not virtual union select r.question_id, nb.b, r.level + 1 from r join nb on nb.question_id = r.question_id and nb.a = r.node where r.level < 8)
        select question_id, substr(node, 2)::bigint qid, min(level)::int level from r where node[1] = 'q' group by 1, 2""",
    "attribute_fit": "select slot_attr, sum(n)::bigint n from (values " + ", ".join(f"('{s}', {es.split()})" for s, es in S.ATTRIBUTE_FAMILIES.items()) + ") f(slot_attr, fam) join (select attribute, count(*) n from (select distinct on (ent_id) ent_id, attribute from entity) e group by 1) e on attribute is null or attribute = '' or list_contains(fam, attribute) group by 1",
}
