"""Queries of the text functions and of passages, spans and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.fixed import ATTRIBUTES, ENTITY_LABELS, STATUSES, TABLE_HEADERS
from quillmesh.operators import passages as P
from quillmesh.sources.tables import table

LABELS = "|".join(ENTITY_LABELS)
STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
#: SQL of the answer normaliser, for a column.
NORM = (
    "trim(regexp_replace(regexp_replace(array_to_string(list_transform(regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+'),"
    " lambda x: case when x in ('a', 'an', 'the') then ' ' else x end), ''), '[[:punct:]]', '', 'g'), '\\s+', ' ', 'g'))"
)
DEF = f"regexp_replace({STRIP}, '\\)+$', '')"
FIXED_DEF = f"case when length(regexp_extract({DEF}, '^\\w[\\w /\\-]*\\)\\s*\\((.+)$', 1)) > 3 then regexp_extract({DEF}, '^\\w[\\w /\\-]*\\)\\s*\\((.+)$', 1) else {DEF} end"
CLEAN = STRIP.replace("{0}", f"regexp_replace({{0}}, '(?i)[\\s\\p{{{{Z}}}}]*\\((?:{LABELS})\\)[\\s\\p{{{{Z}}}}]*$', '')")


def tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = T.bm25_tokens(F.col("text"))
    return table(spark, d, "chunk").select("chunk_id", F.size(toks).alias("n_tokens"), F.size(F.array_distinct(toks)).alias("n_distinct"), F.try_element_at(toks, F.lit(-1)).alias("last_token"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "question").select("id", T.embedding_text(F.col("question")).alias("text")).distinct()


def entity_cleaning(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "fact").select("rel_id", F.posexplode("entities").alias("pos", "e"))
    attr = T.attribute_key(F.col("e.attribute"))
    return rows.select("rel_id", "pos", T.clean_entity_name(F.col("e.name")).alias("name"), T.repair_definition(F.col("e.definition")).alias("definition"), F.when(attr.isin(ATTRIBUTES), attr).otherwise("other").alias("attribute"))


def relation_texts(spark: SparkSession, d: str) -> DataFrame:
    t, r = F.col("source_title"), F.col("relation")
    return table(spark, d, "fact").select("rel_id", T.relation_text(t, r).alias("shown"), T.relation_embed_text(t, r).alias("embed_text"), T.relation_index_text(t, r).alias("index_text"))


def entity_texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity").select("ent_id", T.entity_index_text(F.col("display"), F.col("definition")).alias("index_text")).distinct()


def table_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk").select("chunk_id", T.is_table_or_list(F.col("text")).alias("is_table"))


def wrapped_json(spark: SparkSession, d: str) -> DataFrame:
    raw = F.col("payload")
    return table(spark, d, "extraction").select("raw_id", T.strip_wrappers(raw).alias("bare"), T.json_array(raw).alias("array_text"))


def normalized_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "question").select("id", T.normalize_answer(F.col("answer")).alias("answer"), T.normalize_answer(F.col("question")).alias("question")).distinct()


def em_f1(spark: SparkSession, d: str) -> DataFrame:
    """Prediction: the name as typed; gold: the definition that was typed with it."""
    p, g = F.col("name"), F.col("definition")
    rows = table(spark, d, "mention").select("mention_id", "name", "definition").distinct()
    return rows.select("mention_id", T.exact_match(p, g).alias("em"), F.round(T.token_f1(p, g), 6).alias("f1")).withColumn("mark", T.mark(F.col("em"), F.col("f1")))


def answer_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Transcripts made of the questions: one answer line, the answer as the last line, or below its label."""
    q = table(spark, d, "question").select("id", "question", "answer").distinct()
    lined = F.concat(F.lit("Reasoning: "), F.col("question"), F.lit("\nFinal Answer: \""), F.col("answer"), F.lit("\"\n"))
    bare = F.concat(F.col("question"), F.lit("\n\n`"), F.col("answer"), F.lit("` "))
    below = F.concat(F.lit("answer :\n\n"), F.col("answer"), F.lit("\nHope this helps"))
    return q.select("id", T.extract_answer(lined).alias("lined"), T.extract_answer(bare).alias("bare"), T.extract_answer(below).alias("below"), T.reasoning_of(lined).alias("reasoning"))


def status_counts(spark: SparkSession, d: str) -> DataFrame:
    kinds = spark.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = table(spark, d, "chunk").groupBy("status").agg(F.count("*").alias("n"))
    return kinds.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def question_sizes(spark: SparkSession, d: str) -> DataFrame:
    return P.largest_questions(table(spark, d, "question"), 0).select("id", "size")


def largest_questions(spark: SparkSession, d: str) -> DataFrame:
    return P.largest_questions(table(spark, d, "question"), 10).select("id", "size")


def chunk_passages(spark: SparkSession, d: str) -> DataFrame:
    return P.build_chunks(table(spark, d, "question"))


def span_merge(spark: SparkSession, d: str) -> DataFrame:
    """Events as spans: label = type, start = second within its user, text = type, score = value."""
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("label"), F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("start"), "event_id", F.round("value", 3).alias("score"))
    spans = e.select("user_id", "label", "start", (F.col("start") + 3600).alias("stop"), F.col("event_id").cast("string").alias("text"), "score")
    return P.merge_spans(spans, ["user_id"], "label", "start", "stop", "text", "score")


def ner_candidates(spark: SparkSession, d: str) -> DataFrame:
    kept = P.first_seen(F.col("ner_entities"), F.lower)
    return table(spark, d, "chunk").select("chunk_id", F.size(kept).alias("n"), F.array_join(kept, "; ").alias("candidates"))


def fact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return P.deduplicate_facts(table(spark, d, "fact")).select("rel_id", "relation", F.size("entities").alias("n_entities"))


def entity_fold(spark: SparkSession, d: str) -> DataFrame:
    return P.fold_entities(P.fact_entities(P.deduplicate_facts(table(spark, d, "fact"))))


def new_titles(spark: SparkSession, d: str) -> DataFrame:
    facts = P.deduplicate_facts(table(spark, d, "fact"))
    return P.title_entities(facts, P.fact_entities(facts).select("canonical").distinct())


def graph_incidence(spark: SparkSession, d: str) -> DataFrame:
    facts = P.deduplicate_facts(table(spark, d, "fact"))
    return P.build_incidence(facts, P.fact_entities(facts)).groupBy("rel_id", "canonical", "is_title_edge").agg(F.count("*").alias("n"))


def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return P.arity_stats(table(spark, d, "incidence"), table(spark, d, "fact"))


QUERIES = {f.__name__: f for f in (tokens, embedding_text, entity_cleaning, relation_texts, entity_texts, table_heuristic, wrapped_json, normalized_answers, em_f1, answer_extraction, status_counts, question_sizes, largest_questions, chunk_passages, span_merge, ner_candidates, fact_dedup, entity_fold, new_titles, graph_incidence, graph_stats)}

_TITLE = "coalesce(source_title, '') <> ''"
_LINES = "list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\\r\\n]+'), lambda x: regexp_replace(x, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')), lambda x: x <> '')"
_VERBLESS = "list_filter(l, lambda x: length(x) < 80 and not regexp_matches(x, '(?i)(^|[^\\p{L}\\p{N}_])(is|was|were|has|have|had|are)($|[^\\p{L}\\p{N}_])'))"
_NAMED = f"list_filter(entities, lambda e: coalesce({CLEAN.format('e.name')}, '') <> '')"
_FIRST = f"""first_facts as (select f.* from (select arg_min({{'rel_id': rel_id, 'source_title': source_title, 'entities': entities}}, rel_id) f, {STRIP.format('relation')} relation from fact where {STRIP.format('relation')} <> '' group by {STRIP.format('relation')}) x),
facts as (select f.rel_id, f.source_title, {_NAMED.replace('entities', 'f.entities')} entities, relation from (select arg_min({{'rel_id': rel_id, 'source_title': source_title, 'entities': entities}}, rel_id) f, {STRIP.format('relation')} relation from fact where {STRIP.format('relation')} <> '' group by {STRIP.format('relation')}) x where len({_NAMED.replace('entities', 'f.entities')}) > 0),
places0 as (select rel_id, unnest(entities) e, generate_subscripts(entities, 1) - 1 pos from facts),
places as (select rel_id, pos, lower({CLEAN.format('e.name')}) canonical, {CLEAN.format('e.name')} as name, {FIXED_DEF.format("coalesce(e.definition, '')")} definition, lower({STRIP.format("coalesce(e.attribute, '')")}) attribute from places0)"""
_FIRST = _FIRST[_FIRST.index("facts as (select f.rel_id") :]
_SIZE = "coalesce(list_sum(list_transform(flatten(list_transform(context, lambda p: coalesce(p.sentences, []))), lambda s: coalesce(length(s), 0))), 0)"

SQL = {
    "tokens": "select chunk_id, len(t) n_tokens, len(list_distinct(t)) n_distinct, t[-1] last_token from (select chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') t from chunk)",
    "embedding_text": "select distinct id, trim(regexp_replace(regexp_replace(regexp_replace(replace(question, '?', ' '), '([a-z])([A-Z])', '\\1 \\2', 'g'), '(^|[^\\p{L}\\p{N}_])[A-Z](\\s|$)', '\\1\\2', 'g'), '\\s+', ' ', 'g')) as text from question",
    "entity_cleaning": f"select rel_id, pos, {CLEAN.format('e.name')} as name, {FIXED_DEF.format('e.definition')} definition, case when lower({STRIP.format("coalesce(e.attribute, '')")}) in ({', '.join(repr(a) for a in ATTRIBUTES)}) then lower({STRIP.format('e.attribute')}) else 'other' end attribute from (select rel_id, unnest(entities) e, generate_subscripts(entities, 1) - 1 pos from fact)",
    "relation_texts": f"select rel_id, case when {_TITLE} then '(' || source_title || ') ' || relation else relation end shown, case when {_TITLE} then '(' || source_title || ': ' || relation || ')' else relation end embed_text, case when {_TITLE} then '(' || source_title || ': (' || source_title || ') ' || relation || ')' else relation end index_text from fact",
    "entity_texts": "select distinct ent_id, display || ': ' || coalesce(definition, '') index_text from entity",
    "table_heuristic": f"select chunk_id, regexp_matches(coalesce(text, ''), 'Born\\s*:\\s*\\(\\d{{4}}-\\d{{2}}-\\d{{2}}\\)') or (len(l) >= 3 and regexp_matches(coalesce(text, ''), '(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(TABLE_HEADERS)})($|[^\\p{{L}}\\p{{N}}_])')) or (len(l) >= 4 and len({_VERBLESS})::double / len(l) > 0.7e0) is_table from (select chunk_id, text, {_LINES} l from chunk)",
    "wrapped_json": "select raw_id, t bare, nullif(regexp_extract(t, '(?s)\\[.*\\]'), '') array_text from (select raw_id, trim(regexp_replace(regexp_replace(payload, '(?s)<think>.*?</think>', '', 'g'), '```[a-zA-Z]*', '', 'g')) t from extraction)",
    "normalized_answers": f"select distinct id, {NORM.format('answer')} answer, {NORM.format('question')} question from question",
    "em_f1": f"""with m as (select distinct mention_id, name, definition from mention), n as (select mention_id, {NORM.format('name')} p, {NORM.format('definition')} g from m),
        t as (select mention_id, p, g, list_filter(string_split(p, ' '), lambda x: x <> '') ps, list_filter(string_split(g, ' '), lambda x: x <> '') gs from n),
        s as (select *, coalesce(list_sum(list_transform(list_distinct(ps), lambda w: least(len(list_filter(ps, lambda y: y = w)), len(list_filter(gs, lambda y: y = w))))), 0) shared from t),
        f as (select mention_id, (p = g)::int em, round(case when len(ps) = 0 or len(gs) = 0 then (len(ps) = len(gs))::int::double else 2e0 * shared / (len(ps) + len(gs)) end, 6) f1 from s)
        select *, case when em = 1 then 'ok' when f1 > 0.3e0 then 'partial' else 'wrong' end mark from f""",
    "answer_extraction": "select distinct id, coalesce(trim(answer, ' \t\r\n\"''`'), '') lined, coalesce(trim(answer, ' \t\r\n\"''`'), '') bare, case when answer is null then '' when trim(answer, ' \t\r\n') = '' then 'Hope this helps' else trim(answer, ' \t\r\n\"''`') end below, coalesce(left(case when answer is null then '' else trim(question) end, 300), '') reasoning from question",
    "chunk_passages": f"""with recursive q as (select distinct on (id) id, context from question order by id), p as (select id, generate_subscripts(context, 1) - 1 passage_no, unnest(context) par from q),
        n as (select id, passage_no, par.title title, list_transform(par.sentences, lambda x: coalesce(x, '')) ss from p where len(par.sentences) > 0),
        rec as (select id, passage_no, title, ss, len(ss) <= 8 and list_sum(list_transform(ss, lambda x: length(x))) <= 800 small, 1 i, 1 cnt, length(ss[1]) chars, 0 c from n
            union all select id, passage_no, title, ss, small, i + 1, case when brim then 1 else cnt + 1 end, case when brim then 0 else chars end + length(ss[i + 1]), c + brim::int from (select *, not small and (cnt >= 5 or chars >= 800) brim from rec) r where i < len(ss)),
        t as (select id, passage_no, title, c, {STRIP.format("string_agg(ss[i], ' ' order by i)")} as text from rec group by 1, 2, 3, 4), k as (select *, row_number() over (partition by id, passage_no order by c) - 1 chunk_no from t where text <> '')
        select distinct on (text) title, text, id, passage_no, chunk_no from k order by text, id, passage_no, chunk_no""",
    "status_counts": f"select s status, count(chunk_id) n from (select unnest([{', '.join(repr(s) for s in STATUSES)}]) s) k left join chunk on status = s group by s",
    "question_sizes": f"select distinct id, {_SIZE} size from question",
    "largest_questions": f"select distinct id, {_SIZE} size from question order by size desc, id desc limit 10",
    "span_merge": """with s as (select user_id, event_type label, floor(epoch(ts))::bigint start, floor(epoch(ts))::bigint + 3600 stop, event_id::varchar as text, round(value, 3) score from events),
        m as (select *, case when lag(label) over w = label and start - lag(stop) over w <= 1 then 0 else 1 end nw from s window w as (partition by user_id order by start, stop, text)),
        i as (select *, sum(nw) over (partition by user_id order by start, stop, text rows unbounded preceding) island from m)
        select user_id, any_value(label) label, min(start) start, arg_max(stop, (start, stop, text)) stop, string_agg(text, ' ' order by start, stop, text) as text, max(score) score from i group by user_id, island""",
    "ner_candidates": "with k as (select chunk_id, list_filter(coalesce(ner_entities, []), lambda x: x is not null) l from chunk), f as (select chunk_id, list_filter(l, lambda x, i: list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i) l from k) select chunk_id, len(l) n, coalesce(array_to_string(l, '; '), '') candidates from f",
    "fact_dedup": f"with {_FIRST} select rel_id, relation, len(entities) n_entities from facts",
    "entity_fold": f"""with {_FIRST}, d as (select canonical, arg_min(name, (rel_id, pos)) display from places group by 1),
        f as (select canonical, definition, min((rel_id, pos)) o from places where definition <> '' group by 1, 2), m as (select canonical, string_agg(definition, '; ' order by o) definition from f group by 1),
        v as (select canonical, attribute, count(*) n, min((rel_id, pos)) o from places where attribute not in ('', 'other') group by 1, 2), c as (select canonical, arg_min(attribute, (-n, o)) attribute from v group by 1)
        select canonical, display, coalesce(definition, '') definition, coalesce(attribute, 'other') attribute from d left join m using (canonical) left join c using (canonical)""",
    "new_titles": f"with {_FIRST} select lower({STRIP.format('source_title')}) canonical, max({STRIP.format('source_title')}) display from facts where {STRIP.format('source_title')} <> '' and lower({STRIP.format('source_title')}) not in (select canonical from places) group by 1",
    "graph_incidence": f"with {_FIRST}, t as (select rel_id, lower({STRIP.format('source_title')}) canonical from facts where {STRIP.format('source_title')} <> '') select rel_id, canonical, false is_title_edge, count(*) n from places group by 1, 2 union all select rel_id, canonical, true, count(*) from t where not exists (select 1 from places p where p.rel_id = t.rel_id and p.canonical = t.canonical) group by 1, 2",
    "graph_stats": "with a as (select rel_id, count(*) n from incidence group by 1), r as (select count(distinct rel_id) relations from fact) select sum(n)::bigint edges, max(n) max_arity, round(avg(n), 3) mean_arity, count(*) filter (where n >= 3) nary, any_value(relations) relations, round(coalesce(count(*) filter (where n >= 3)::double / any_value(relations), 0), 4) nary_fraction from a, r",
}
