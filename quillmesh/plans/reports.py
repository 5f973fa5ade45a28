"""Queries of parsing, evaluation, reports, resuming and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.fixed import FAILURE_CATEGORIES
from quillmesh.operators import evaluation as E
from quillmesh.operators import skeleton as S
from quillmesh.plans.graphs import _SYN, synonyms
from quillmesh.plans import scalars
from quillmesh.plans.scalars import NORM, STRIP
from quillmesh.session import ensure_checkpoint_dir
from quillmesh.sources import files
from quillmesh.sources.tables import table
from quillmesh.streaming import ingest

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def parse_subquestions(spark: SparkSession, d: str) -> DataFrame:
    """Facts written as a model would write sub-questions, and read back."""
    ents = F.transform("entities", lambda e: F.struct(e["name"].alias("name"), e["attribute"].alias("attribute"), F.coalesce(e["attribute"].isin("date", "number"), F.lit(False)).alias("virtual")))
    raw = table(spark, d, "fact").select("rel_id", F.concat(F.lit("<think>[1]</think>```json\n["), F.to_json(F.struct("relation", ents.alias("entities"))), F.lit("]\n```")).alias("raw"))
    return S.parse_subquestions(raw, "rel_id", "raw").withColumnRenamed("key", "rel_id")


def answers(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question").dropDuplicates(["id"])
    title = F.try_element_at("context", F.lit(1))["title"]
    return E.evaluate(q.select("id", F.coalesce(title, F.lit("")).alias("context"), F.concat(F.lit("Reasoning: "), F.col("question"), F.lit("\nAnswer: "), F.coalesce(title, F.lit("none"))).alias("raw"), F.col("answer").alias("gold")))


def eval_rows(spark: SparkSession, d: str) -> DataFrame:
    return answers(spark, d).select("id", "pred", "em", F.round("f1", 6).alias("f1"), "mark", "error")


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return E.summary(answers(spark, d))


def status_distribution(spark: SparkSession, d: str) -> DataFrame:
    return E.distribution(table(spark, d, "chunk"), "status")


def failure_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Classifier answers made of the chunks: every category in turn, some only mentioned, some unreadable."""
    name = F.element_at(F.array(*map(F.lit, FAILURE_CATEGORIES)), (F.col("chunk_id") % 6 + 1).cast("int"))
    raw = F.when(F.col("chunk_id") % 5 == 0, F.concat(F.lit("I would say "), name)).when(F.col("chunk_id") % 7 == 0, "no idea").otherwise(F.concat(F.lit("Reason: x\nCategory: "), F.translate(F.initcap(F.translate(name, "_", " ")), "_", " ")))
    return E.distribution(table(spark, d, "chunk").select(T.failure_category(raw).alias("label")), "label")


def judge_means(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "synonym_pair").dropDuplicates(["pair_id"])
    return E.judge_means(rows, "similarity")


def probe_confusion(spark: SparkSession, d: str) -> DataFrame:
    """Named pairs: same attribute or not, told by their similarity."""
    ent = table(spark, d, "entity").dropDuplicates(["ent_id"]).select("ent_id", "attribute")
    rows = synonyms(spark, d).join(ent.toDF("a", "aa"), "a").join(ent.toDF("b", "ab"), "b")
    return E.confusion(rows.withColumn("same", F.col("aa").eqNullSafe(F.col("ab"))), "similarity", "same", 0.9)


def report_grid(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    scores = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("method"), F.col("c_mktsegment").alias("dataset"), F.col("c_acctbal").alias("em"))
    return E.grid_table(scores, nation.select(F.col("n_name").alias("method")), ["method"], "dataset", SEGMENTS, ["em"])


def resume_grid(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    grid = nation.select("n_nationkey").join(F.broadcast(region.select(F.col("r_regionkey").alias("n_regionkey"))), how="cross")
    return E.pending(grid, nation, ["n_nationkey", "n_regionkey"])


def latest_mentions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "mention").select("mention_id", "typed_by", "received_at")
    return E.latest(rows, "mention_id", [F.desc_nulls_last("received_at"), F.desc_nulls_last("typed_by")])


def extraction_report(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "fact").groupBy("chunk_id").agg(F.count("*").alias("n_events"))
    rows = table(spark, d, "chunk").select("chunk_id", "title", "status", T.is_table_or_list(F.col("text")).alias("is_table")).join(events, "chunk_id", "left")
    return files.extraction_report(rows.withColumn("n_events", F.coalesce("n_events", F.lit(0))))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "question").dropDuplicates(["id"])
    return q.select("id", E.answer_prompt(F.lit("x"), F.col("question"), "answer-only").alias("prompt"))


def stream_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions taken in as a stream, each once however often it is delivered."""
    base = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "mention").schema
    try:
        rows = ingest.read_stream(spark, f"{d}/mention.parquet", schema)
        once = ingest.first_arrivals(rows.select("mention_id", "typed_at"), "mention_id", "typed_at")
        ingest.write_available(once.select("mention_id"), f"{base}/out", f"{base}/state").awaitTermination()
    except Exception as e:  # noqa: BLE001  a table that is a single file is read through its folder
        if "basePath" not in str(e) and "not a directory" not in str(e).lower() and "directory" not in str(e).lower():
            raise
        rows = ingest.read_stream(spark, d, schema, "mention.parquet")
        once = ingest.first_arrivals(rows.select("mention_id", "typed_at"), "mention_id", "typed_at")
        ingest.write_available(once.select("mention_id"), f"{base}/out2", f"{base}/state2").awaitTermination()
        return spark.read.parquet(f"{base}/out2")
    return spark.read.parquet(f"{base}/out")


QUERIES = {f.__name__: f for f in (parse_subquestions, eval_rows, eval_summary, status_distribution, failure_distribution, judge_means, probe_confusion, report_grid, resume_grid, latest_mentions, extraction_report, prompts, stream_mentions)}

_EV = f"""q as (select distinct id, question, answer, coalesce(context[1].title, '') context, 'x' raw, coalesce(context[1].title, 'none') said from question),
    p as (select id, answer gold, case when trim(context) = '' then 'no_context' when question is null then 'llm_call_failed' end error, case when trim(context) = '' or question is null then '' else trim(said, ' \t\r\n"''`') end pred from q),
    n as (select *, {NORM.format('pred')} np, {NORM.format('gold')} ng from p), t as (select *, list_filter(string_split(np, ' '), lambda x: x <> '') ps, list_filter(string_split(ng, ' '), lambda x: x <> '') gs from n),
    s as (select *, coalesce(list_sum(list_transform(list_distinct(ps), lambda w: least(len(list_filter(ps, lambda y: y = w)), len(list_filter(gs, lambda y: y = w))))), 0) shared from t),
    ev as (select id, pred, error, (np = ng)::int em, case when len(ps) = 0 or len(gs) = 0 then (len(ps) = len(gs))::int::double else 2e0 * shared / (len(ps) + len(gs)) end f1 from s)"""
_LABEL = "[" + ", ".join(f"'{c}'" for c in FAILURE_CATEGORIES) + "][(chunk_id % 6 + 1)::int]"

SQL = {
    "parse_subquestions": f"with r as (select rel_id, {STRIP.format('relation')} relation, list_filter(list_transform(entities, lambda e, i: {{'slot': i - 1, 'name': {STRIP.format('e.name')}, 'attribute': lower({STRIP.format("coalesce(e.attribute, '')")}), 'virtual': coalesce(e.attribute in ('date', 'number'), false)}}), lambda e: e.name <> '') es from fact where {STRIP.format('relation')} <> ''), x as (select rel_id, relation, unnest(es) e, generate_subscripts(es, 1) - 1 place from r where len(es) >= 2) select rel_id, 0 qid, relation, place slot, e.name as name, e.attribute attribute, e.virtual as \"virtual\" from x",
    "eval_rows": f"with {_EV} select id, pred, em, round(f1, 6) f1, case when em = 1 then 'ok' when f1 > 0.3e0 then 'partial' else 'wrong' end mark, error from ev",
    "eval_summary": f"with {_EV} select count(*) n, round(avg(em) * 100, 2) em, round(avg(f1) * 100, 2) f1 from ev",
    "status_distribution": "select coalesce(status, 'unparseable') label, count(*) n, round(count(*)::double / (select count(*) from chunk), 4) fraction from chunk group by 1",
    "failure_distribution": f"with l as (select case when chunk_id % 5 <> 0 and chunk_id % 7 = 0 then 'unparseable' else {_LABEL} end label from chunk) select label, count(*) n, round(count(*)::double / (select count(*) from l), 4) fraction from l group by 1",
    "judge_means": "with p as (select distinct on (pair_id) similarity from synonym_pair) select count(*) n_questions, round(avg(similarity), 4) similarity_mean, count(similarity) n_similarity from p",
    "probe_confusion": f"with {_SYN}, e as (select distinct on (ent_id) ent_id, attribute from entity), r as (select coalesce(similarity, -1) >= 0.9e0 said, x.attribute is not distinct from y.attribute same from syn join e x on x.ent_id = a join e y on y.ent_id = b), c as (select count(*) filter (where said and same) tp, count(*) filter (where not said and same) fn, count(*) filter (where said and not same) fp, count(*) filter (where not said and not same) tn from r) select *, round(tp::double / (tp + fn), 4) recall, round(fp::double / (fp + tn), 4) false_merge, round(tp::double / (tp + fp), 4) as precision, round(2e0 * tp / (2 * tp + fp + fn), 4) f1 from c",
    "report_grid": "with s as (select n_name method, c_mktsegment dataset, avg(c_acctbal) em from customer join nation on c_nationkey = n_nationkey group by 1, 2) select n_name method, " + ", ".join(f"coalesce(printf('%.1f', max(em) filter (where dataset = '{s}')), '--') \"{s}_em\"" for s in SEGMENTS) + ", coalesce(printf('%.1f', avg(em)), '--') avg_em from nation left join s on method = n_name group by 1",
    "extraction_report": f"""with t as ({scalars.SQL['table_heuristic']}), n as (select chunk_id, count(*) n from fact group by 1)
        select chunk_id, case status when 'retry_ok' then '[RETRY] ' when 'empty' then '[EMPTY] ' when 'failed' then '[FAILED] ' else '' end || case when is_table then '[TABLE] ' else '' end || coalesce(title, '') || ': ' || coalesce(n, 0) || ' events' line from chunk join t using (chunk_id) left join n using (chunk_id)""",
    "resume_grid": "select n.n_nationkey, r_regionkey n_regionkey from nation n, region where not exists (select 1 from nation m where m.n_nationkey = n.n_nationkey and m.n_regionkey = r_regionkey)",
    "latest_mentions": "select mention_id, typed_by, received_at from mention qualify row_number() over (partition by mention_id order by received_at desc nulls last, typed_by desc nulls last) = 1",
    "prompts": "select distinct id, ('Context:\nx\n\nQuestion: ' || coalesce(question, '') || '\n\nGive the answer only.\nAnswer:') prompt from question",
    "stream_mentions": "select distinct mention_id from mention",
}
