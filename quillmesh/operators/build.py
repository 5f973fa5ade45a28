"""From extracted facts to graph tables, and from named slots to where a search starts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.operators import graph as G
from quillmesh.operators import nested, passages
from quillmesh.operators.retrieval import similar_pairs
from quillmesh.operators.skeleton import slot_key
from quillmesh.operators.skew import range_rank


def usable_entities(entities: Column) -> Column:
    """Entities of a one-call extraction that have a name and a definition; an attribute is not kept."""
    kept = F.filter(F.coalesce(entities, F.array().cast("array<struct<name:string,definition:string>>")), lambda e: (F.coalesce(F.trim(e["name"]), F.lit("")) != "") & (F.coalesce(F.trim(e["definition"]), F.lit("")) != ""))
    return F.transform(kept, lambda e: F.struct(F.trim(e["name"]).alias("name"), F.trim(e["definition"]).alias("definition")))


def extraction_status(first: Column, second: Column) -> Column:
    """ok, retry_ok, empty or failed, from the numbers of events of the first and the second attempt (null: unreadable)."""
    return F.when(first > 0, "ok").when(second > 0, "retry_ok").when(first.isNull() & second.isNull(), "failed").otherwise("empty")


def attach_refined(facts: DataFrame, refined: DataFrame) -> DataFrame:
    """(chunk_id, fact_no, pos, name, attribute, definition): a two-call extraction's entity names with the records refined
    for them. A name without a record is kept as `other` without definition; facts without entities drop out."""
    places = facts.select("chunk_id", "fact_no", F.posexplode("names").alias("pos", "name")).where("name is not null")
    records = refined.groupBy("chunk_id", "name").agg(F.min_by(F.struct("attribute", "definition"), "place").alias("r"))
    return places.join(records, ["chunk_id", "name"], "left").select("chunk_id", "fact_no", "pos", "name", F.coalesce("r.attribute", F.lit("other")).alias("attribute"), F.coalesce("r.definition", F.lit("")).alias("definition"))


def load_events(payloads: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """Facts of all extraction payloads in the shape of the fact table: (rel_id, relation, entities, source_title,
    chunk_id), numbered in the order of key, chunk and event; the first of equal relation texts is kept."""
    t = nested.flatten_records(payloads, key, payload)
    keys = [key, "chunk_no", "event_no"]
    ents = t["entity"].where("name is not null").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("entity_no", "name", "attribute", "definition"))).alias("e"))
    facts = t["event"].join(t["chunk"].select(key, "chunk_no", "title"), [key, "chunk_no"]).join(ents, keys, "left")
    entities = F.transform(F.coalesce("e", F.array().cast(ents.schema["e"].dataType)), lambda x: F.struct(x["name"].alias("name"), x["attribute"].alias("attribute"), x["definition"].alias("definition")))
    numbered = range_rank(facts.select(*keys, "relation", "title", "e"), [F.col(k) for k in keys], "rel_id")
    return passages.deduplicate_facts(numbered.select("rel_id", "relation", entities.alias("entities"), F.col("title").alias("source_title"), F.col(key).alias("chunk_id")))


def build_graph(facts: DataFrame, encode, merge_threshold: float = 0.85) -> dict[str, DataFrame]:
    """entity, relation, incidence and synonym tables of facts.

    encode(text column) gives a vector column. Entities are told apart by their lower-cased clean name and
    numbered by a 64-bit digest of it, title-only entities included (without attribute). Synonyms link entities of facts only, by the mean cosine of
    name and of name with definition.
    """
    kept = passages.deduplicate_facts(facts)
    places = passages.fact_entities(kept)
    named = passages.fold_entities(places).withColumn("is_title", F.lit(False))
    titles = passages.title_entities(kept, named).select("canonical", "display", F.col("display").alias("definition"), F.lit(None).cast("string").alias("attribute"), F.lit(True).alias("is_title"))
    every = named.unionByName(titles).withColumn("ent_id", F.xxhash64("canonical"))
    entity = every.withColumn("vec", encode(F.concat(F.col("display"), F.lit(": "), F.col("definition")))).withColumn("name_vec", encode(F.col("display")))
    relation = kept.select("rel_id", T.relation_text(F.col("source_title"), F.col("relation")).alias("text"), "source_title", "chunk_id", encode(T.relation_embed_text(F.col("source_title"), F.col("relation"))).alias("vec"))
    incidence = passages.build_incidence(kept, places).withColumn("ent_id", F.xxhash64("canonical")).select("rel_id", "ent_id", "is_title_edge")
    synonym = similar_pairs(entity.where("not is_title").select(F.col("ent_id").alias("doc_id"), "vec", "name_vec"), merge_threshold)
    return {"entity": entity, "relation": relation, "incidence": incidence, "synonym": synonym}


def locate_anchors(found: DataFrame, synonym: DataFrame) -> DataFrame:
    """(question_id, slot_key, ent_id): what the real slots mean, with the synonyms of it."""
    near = found.join(G.symmetric(synonym).select("ent_id", "other"), "ent_id").select("question_id", "slot_key", F.col("other").alias("ent_id"))
    return found.select("question_id", "slot_key", "ent_id").unionByName(near).distinct()


def anchor_bindings(slots: DataFrame, start: DataFrame, entities: DataFrame) -> DataFrame:
    """(question_id, slot_key, ent_id): start entities whose display is a real slot's name, ignoring case; a question of
    which no slot finds one gets all of them under the key `__all__`."""
    shown = start.select("question_id", "ent_id").distinct().join(entities.select("ent_id", F.lower("display").alias("low")), "ent_id")
    named = slots.where("not virtual").select("question_id", "slot_key", F.lower("name").alias("low")).join(shown, ["question_id", "low"]).select("question_id", "slot_key", "ent_id").distinct()
    rest = start.select("question_id", "ent_id").distinct().join(named.select("question_id").distinct(), "question_id", "left_anti")
    return named.unionByName(rest.select("question_id", F.lit("__all__").alias("slot_key"), "ent_id"))


def virtual_keys(subq: DataFrame) -> DataFrame:
    """(question_id, slot_key, attribute): each virtual slot once, with the attribute of its first sighting, in `place` order."""
    keyed = subq.where("virtual").withColumn("slot_key", slot_key(F.col("name"), F.col("attribute"), F.lit(True)))
    first = keyed.groupBy("question_id", "slot_key").agg(F.min(F.struct("qid", "slot", "attribute")).alias("f"))
    return first.select("question_id", "slot_key", "f.attribute", F.struct("f.qid", "f.slot").alias("place"))


def listing(relations: Column) -> Column:
    """Sub-questions as numbered lines."""
    return F.array_join(F.transform(relations, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")


def extraction_prompt(title: Column, text: Column, candidates: Column) -> Column:
    """What the extracting model is sent: the text, its title if there is one, and the recognised candidates if any."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit('Title: "'), title, F.lit('"\n'))).otherwise("")
    tail = F.when(F.coalesce(F.size(candidates), F.lit(0)) > 0, F.concat(F.lit("\nCandidates: "), F.to_json(candidates))).otherwise("")
    return F.concat(head, F.lit('Text: "'), F.coalesce(text, F.lit("")), F.lit('"'), tail)


def event_count(raw: Column) -> Column:
    """Events in an extracting model's answer; null if it cannot be read."""
    text = T.strip_wrappers(raw)
    parsed = F.try_parse_json(F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text))
    return F.size(F.try_variant_get(parsed, "$.events", "array<variant>"))


def refine_prompt(title: Column, text: Column, names: Column) -> Column:
    """What the refining model is sent: the extraction prompt with the recognised names as candidates."""
    return extraction_prompt(title, text, names)


def decouple_prompt(text: Column, records: Column) -> Column:
    """What the decoupling model is sent: the text and the refined entities, as JSON."""
    return F.concat(F.lit('Text: "'), F.coalesce(text, F.lit("")), F.lit('"\nEntities: '), F.coalesce(F.to_json(records), F.lit("[]")))
