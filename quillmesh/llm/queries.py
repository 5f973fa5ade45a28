"""Queries and SQL of the training-data operators, as __spark_entry__ registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import components, duplicates, leaks, names, neighbours, packing, quality, splitting


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    _, facts = duplicates.fact_duplicates(_t(spark, d, "fact"))
    _, chunks = duplicates.chunk_duplicates(_t(spark, d, "chunk"))
    rows = facts.select(F.lit("fact").alias("src"), "first_id", F.col("id").alias("other_id")).unionAll(chunks.select(F.lit("chunk").alias("src"), "first_id", F.col("id").alias("other_id")))
    return rows.where("first_id <> other_id")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    facts, _ = duplicates.fact_duplicates(_t(spark, d, "fact"))
    chunks, _ = duplicates.chunk_duplicates(_t(spark, d, "chunk"))
    return facts.select(F.lit("fact").alias("src"), "*").unionAll(chunks.select(F.lit("chunk").alias("src"), "*"))


FIELDS = ("embedding", "name_embedding")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    entity = _t(spark, d, "entity")
    one, two = (neighbours.close_pairs(entity, "ent_id", f).select(F.lit(f).alias("field"), F.col("a").alias("ent_a"), F.col("b").alias("ent_b")) for f in FIELDS)
    return one.unionAll(two)


def p2_topk(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar entities of every entity whose id is divisible by 20, against all entities."""
    entity, asked = _t(spark, d, "entity"), F.col("id") % 20 == 0
    one, two = (neighbours.similar_vectors(entity, "ent_id", f, 10, probes=48, margin=2.0, queries=asked).select(F.lit(f).alias("field"), "*") for f in FIELDS)
    return one.unionAll(two)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(_t(spark, d, "mention"), _t(spark, d, "entity")).select("mention_id", "ent_id")


def p3_links(spark: SparkSession, d: str) -> DataFrame:
    return names.link_names(_t(spark, d, "mention"), _t(spark, d, "entity"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return components.entity_groups(_t(spark, d, "synonym_pair"), _t(spark, d, "entity"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.chunk_items(_t(spark, d, "chunk")).unionByName(splitting.question_items(_t(spark, d, "question")))
    return splitting.oversized(items)


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    items = splitting.chunk_items(_t(spark, d, "chunk")).unionByName(splitting.question_items(_t(spark, d, "question").dropDuplicates(["id"])))
    return splitting.pieces_table(items)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack_documents(packing.token_counts(_t(spark, d, "documents")))
    return packed.where("n_parts > 1 and part_no = 0").select("doc_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(packing.token_counts(_t(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(_t(spark, d, "documents"), _t(spark, d, "eval_item"))


def p8_stretches(spark: SparkSession, d: str) -> DataFrame:
    return leaks.repeated_items(_t(spark, d, "documents"), _t(spark, d, "eval_item"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.prose_report(_t(spark, d, "documents")).where("not is_prose").select("doc_id")


def p9_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.prose_report(_t(spark, d, "documents"), outliers=True)


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_topk, p3_found, p3_links, p5_found, p6_found, p6_pieces, p7_found, p7_containers, p8_found, p8_stretches, p9_found, p9_stats)}
_KEY = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g'), '^ent::', ''), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_TRIM = "regexp_replace({0}, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g')"

_OK = "(len({0}) = 64 and list_bool_and(list_transform({0}, lambda x: x is not null and isfinite(x))) and list_bool_or(list_transform({0}, lambda x: x <> 0)))"
_NEAR = """{0}_v as (select distinct ent_id id, {0}::double[] v from entity where ent_id is not null and """ + _OK.format("{0}") + """), {0}_u as (select id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) v from {0}_v),
        {0}_s as (select x.id a, y.id b, max(list_dot_product(x.v, y.v)) s from {0}_u x join {0}_u y on x.id <> y.id group by 1, 2), {0}_n as (select *, row_number() over (partition by a order by s desc, b) r from {0}_s)"""

#: Problems whose result SQL can state; the others are tested against brute force, round trips or planted cases.
SQL: dict[str, str] = {
    "p2_found": f"with {_NEAR.format('embedding')}, {_NEAR.format('name_embedding')} select distinct 'embedding' field, least(a, b) ent_a, greatest(a, b) ent_b from embedding_n where r <= 5 and s >= 0.85e0 union all select distinct 'name_embedding', least(a, b), greatest(a, b) from name_embedding_n where r <= 5 and s >= 0.85e0",
    "p5_found": f"""with recursive names as (select distinct {_KEY.format('canonical')} k, ent_id from entity), links as (select distinct x.ent_id a, y.ent_id b from synonym_pair p join names x on x.k = {_KEY.format('p.a')} join names y on y.k = {_KEY.format('p.b')} where x.ent_id <> y.ent_id),
        edges as (select a, b from links union select b, a from links), reach(ent_id, other) as (select a, b from edges union select r.ent_id, e.b from reach r join edges e on e.a = r.other)
        select ent_id, least(ent_id, min(other)) group_id from reach group by ent_id""",
    "p6_found": f"""with q as (select distinct on (id) id, context from question order by id), p as (select id, unnest(context) par, generate_subscripts(context, 1) - 1 ctx_no from q),
        t as (select id, ctx_no, array_to_string(list_filter(list_transform(par.sentences, lambda s: {_TRIM.format('s')}), lambda s: s is not null and regexp_matches(s, '[^\\s\\p{{Z}}]')), ' ') as text from p)
        select 'chunk' src, chunk_id::varchar item_id, 0 ctx_no from chunk where length({_TRIM.format('text')}) > 800 union all select 'question', id, ctx_no from t where length(text) > 800""",
}
