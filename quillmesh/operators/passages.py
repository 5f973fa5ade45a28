"""Questions to passages, entity spans and facts: chunking, first-seen deduplication, ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.config import RetrievalConfig
from quillmesh.functions import text as T

_FOLD = "struct<buf:array<string>,chars:int,out:array<string>>"


def question_size(context: Column) -> Column:
    """Characters of all sentences of a question's context."""
    sentences = F.flatten(F.transform(context, lambda p: F.coalesce(p["sentences"], F.array().cast("array<string>"))))
    return F.coalesce(F.aggregate(sentences, F.lit(0), lambda n, s: n + F.coalesce(F.length(s), F.lit(0))), F.lit(0))


def largest_questions(questions: DataFrame, n: int) -> DataFrame:
    """The n questions with the most context; n <= 0: all. Ties go to the larger id. Questions delivered again count once."""
    once = questions.dropDuplicates(["id"]).withColumn("size", question_size(F.col("context")))
    return once if n <= 0 else once.orderBy(F.desc("size"), F.desc("id")).limit(n)


def chunk_sentences(sentences: Column, config: RetrievalConfig = RetrievalConfig()) -> Column:
    """Texts of the chunks of one passage.

    A passage of few sentences and characters is one chunk. Otherwise sentences fill a chunk until, with the one just
    added, it has enough sentences or characters. Chunks are trimmed, blank ones dropped. Null sentences count as empty.
    """
    sents = F.transform(F.coalesce(sentences, F.array().cast("array<string>")), lambda s: F.coalesce(s, F.lit("")))
    chars = F.aggregate(sents, F.lit(0), lambda n, s: n + F.length(s))
    start = F.struct(F.array().cast("array<string>").alias("buf"), F.lit(0).alias("chars"), F.array().cast("array<string>").alias("out")).cast(_FOLD)

    def add(acc: Column, s: Column) -> Column:
        buf, n = F.concat(acc["buf"], F.array(s)), acc["chars"] + F.length(s)
        full = (F.size(buf) >= config.chunk_sentences) | (n >= config.chunk_chars)
        return F.when(full, F.struct(F.array().cast("array<string>").alias("buf"), F.lit(0).alias("chars"), F.concat(acc["out"], F.array(F.array_join(buf, " "))).alias("out")).cast(_FOLD)).otherwise(F.struct(buf.alias("buf"), n.alias("chars"), acc["out"].alias("out")).cast(_FOLD))

    folded = F.aggregate(sents, start, add, lambda a: F.when(F.size(a["buf"]) > 0, F.concat(a["out"], F.array(F.array_join(a["buf"], " ")))).otherwise(a["out"]))
    small = (F.size(sents) <= config.chunk_keep_sentences) & (chars <= config.chunk_chars)
    return F.filter(F.transform(F.when(small, F.array(F.array_join(sents, " "))).otherwise(folded), lambda t: T.strip(t)), lambda t: t != "")


def build_chunks(questions: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(title, text, id, passage_no, chunk_no) of all chunks, each text once, where it is first seen (by id, passage,
    place). The first of many equal texts is kept by a map-side minimum, not by a window over all of them."""
    once = questions.dropDuplicates(["id"])
    passages = once.select("id", F.posexplode("context").alias("passage_no", "p"))
    chunks = passages.select("id", "passage_no", F.col("p.title").alias("title"), F.posexplode(chunk_sentences(F.col("p.sentences"), config)).alias("chunk_no", "text"))
    first = chunks.groupBy("text").agg(F.min(F.struct("id", "passage_no", "chunk_no", "title")).alias("f"))
    return first.select("f.title", "text", "f.id", "f.passage_no", "f.chunk_no")


def merge_spans(spans: DataFrame, group: list[str], label: str, start: str, end: str, text: str, score: str) -> DataFrame:
    """Joins spans of one label that follow each other with a gap of at most one; text joined, score the largest."""
    order = Window.partitionBy(*group).orderBy(start, end, text)
    prev_end, prev_label = F.lag(end).over(order), F.lag(label).over(order)
    new = F.when((prev_label == F.col(label)) & (F.col(start) - prev_end <= 1), 0).otherwise(1)
    marked = spans.withColumn("__new", new).withColumn("__island", F.sum("__new").over(order))
    parts = F.array_sort(F.collect_list(F.struct(start, end, text)))
    return marked.groupBy(*group, "__island").agg(F.first(label).alias(label), F.min(start).alias(start), F.element_at(parts, -1)[end].alias(end), F.array_join(F.transform(parts, lambda x: x[text]), " ").alias(text), F.max(score).alias(score)).drop("__island")


def first_seen(items: Column, key) -> Column:
    """Elements of an array whose key (a function of the element) is seen for the first time, in order."""
    empty = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(F.array_contains(a["keys"], key(x)) | x.isNull(), a).otherwise(F.struct(F.concat(a["keys"], F.array(key(x))).alias("keys"), F.concat(a["out"], F.array(x)).alias("out")))
    return F.aggregate(F.coalesce(items, F.array().cast("array<string>")), empty, step, lambda a: a["out"])


def deduplicate_facts(facts: DataFrame, order: str = "rel_id") -> DataFrame:
    """The first fact of each trimmed relation text that has entities.

    The first is chosen before entities are looked at, so a first copy without usable entities takes the later ones with
    it. Facts without relation text are dropped. A text that many facts share is reduced by a map-side minimum.
    """
    usable = facts.withColumn("relation", T.strip(F.col("relation"))).where(F.col("relation") != "")
    first = usable.groupBy("relation").agg(F.min_by(F.struct("rel_id", "source_title", "chunk_id", "entities"), F.col(order)).alias("f"))
    rows = first.select("f.rel_id", "relation", "f.source_title", "f.chunk_id", "f.entities")
    named = F.filter(F.coalesce("entities", F.array().cast(facts.schema["entities"].dataType)), lambda e: F.coalesce(T.clean_entity_name(e["name"]), F.lit("")) != "")
    return rows.withColumn("entities", named).where(F.size("entities") > 0)


def fact_entities(facts: DataFrame) -> DataFrame:
    """(rel_id, pos, canonical, name, definition, attribute): the cleaned entities of facts, one row a place."""
    rows = facts.select("rel_id", F.posexplode("entities").alias("pos", "e"))
    name = T.clean_entity_name(F.col("e.name"))
    out = rows.select("rel_id", "pos", F.lower(name).alias("canonical"), name.alias("name"), T.repair_definition(F.coalesce("e.definition", F.lit(""))).alias("definition"), T.attribute_key(F.col("e.attribute")).alias("attribute"))
    return out.where(F.col("name") != "")


def fold_entities(places: DataFrame) -> DataFrame:
    """(canonical, display, definition, attribute) of each entity named in facts.

    display is the spelling seen first; definition all different definitions in the order they are first seen, joined by
    `; `; attribute the most frequent one that is not empty or `other` (ties: seen first), else `other`. All three are
    counted over distinct values first, so an entity that a third of all facts name does not reach one task whole.
    """
    at = F.struct("rel_id", "pos")
    display = places.groupBy("canonical").agg(F.min_by("name", at).alias("display"))
    defs = places.where("definition <> ''").groupBy("canonical", "definition").agg(F.min(at).alias("first"))
    merged = defs.groupBy("canonical").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "definition"))), lambda x: x["definition"]), "; ").alias("definition"))
    votes = places.where("attribute not in ('', 'other')").groupBy("canonical", "attribute").agg(F.count("*").alias("n"), F.min(at).alias("first"))
    chosen = votes.groupBy("canonical").agg(F.min_by("attribute", F.struct((-F.col("n")).alias("n"), "first")).alias("attribute"))
    out = display.join(merged, "canonical", "left").join(chosen, "canonical", "left")
    return out.select("canonical", "display", F.coalesce("definition", F.lit("")).alias("definition"), F.coalesce("attribute", F.lit("other")).alias("attribute"))


def title_entities(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(canonical, display) of source titles that are no entity yet; of titles that differ in case the last one stays."""
    titles = facts.select(T.strip(F.col("source_title")).alias("display")).where("display <> ''").distinct()
    new = titles.withColumn("canonical", F.lower("display")).join(entities.select("canonical"), "canonical", "left_anti")
    return new.groupBy("canonical").agg(F.max("display").alias("display"))


def build_incidence(facts: DataFrame, places: DataFrame) -> DataFrame:
    """(rel_id, canonical, is_title_edge): a bag with one edge a place, and a title edge where the title is not among the
    fact's entities."""
    edges = places.select("rel_id", "canonical", F.lit(False).alias("is_title_edge"))
    titles = facts.select("rel_id", F.lower(T.strip(F.col("source_title"))).alias("canonical")).where("canonical <> ''")
    extra = titles.join(places.select("rel_id", "canonical"), ["rel_id", "canonical"], "left_anti")
    return edges.unionByName(extra.withColumn("is_title_edge", F.lit(True)))


def arity_stats(incidence: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: edges, relations, largest and mean arity (edges counted as often as they occur, relations without edges
    left out), relations of arity three or more and their share of all relations."""
    arity = incidence.groupBy("rel_id").agg(F.count("*").alias("n"))
    total = relations.select("rel_id").distinct().agg(F.count("*").alias("relations"))
    one = arity.agg(F.sum("n").alias("edges"), F.max("n").alias("max_arity"), F.round(F.avg("n"), 3).alias("mean_arity"), F.count_if(F.col("n") >= 3).alias("nary"))
    # both sides are one row
    return one.join(F.broadcast(total)).withColumn("nary_fraction", F.round(F.coalesce(F.try_divide("nary", "relations"), F.lit(0.0)), 4))
