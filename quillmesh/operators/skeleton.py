"""Decomposed questions: sub-questions with typed slots, how they hang together, and how model output is parsed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.functions.fixed import ATTRIBUTE_FAMILIES
from quillmesh.operators import graph


def slot_key(name: Column, attribute: Column, virtual: Column) -> Column:
    """What a slot is known by: its name, or attribute and alias where it stands for something unknown."""
    return F.when(virtual, T.strip(F.concat_ws(" ", attribute, name))).otherwise(name)


def slot_embed_text(name: Column, attribute: Column) -> Column:
    return T.strip(F.concat_ws(" ", attribute, name))


def _text(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return F.when(kind == "STRING", F.try_variant_get(v, "$", "string"))


def _explode(df: DataFrame, variant: str, value: str) -> DataFrame:
    """A row for each element of a variant array: the columns of df with pos and the element."""
    return df.selectExpr("*", f"inline(transform(try_cast({variant} as array<variant>), (x, i) -> struct(i as pos, x as {value})))").drop(variant)


def parse_subquestions(raw: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, qid, relation, slot, name, attribute, virtual) out of a model's JSON array of sub-questions.

    An item needs a relation text and two valid entities; others are dropped, and qid numbers what is kept in order. The
    old form {relation, subject, object} is read as two entities. An entity is valid with a name that is not blank;
    `virtual` is true for anything but false, null, 0, an empty string, array or object, so for "false" too. A text
    without a readable array gives no rows.
    """
    arrays = raw.select(F.col(key).alias("key"), F.try_parse_json(T.json_array(F.col(payload))).alias("v")).where(F.schema_of_variant("v").startswith("ARRAY"))
    items = _explode(arrays, "v", "value").withColumnRenamed("pos", "place")
    items = items.where(F.schema_of_variant("value").startswith("OBJECT"))
    items = items.select("key", "place", T.strip(_text(F.try_variant_get("value", "$.relation", "variant"))).alias("relation"), F.try_variant_get("value", "$.entities", "variant").alias("entities"), F.try_variant_get("value", "$.subject", "variant").alias("s"), F.try_variant_get("value", "$.object", "variant").alias("o"))
    items = items.where("relation <> ''")
    legacy = items.where("entities is null").select("key", "place", "relation", F.posexplode(F.array("s", "o")).alias("slot", "e"))
    modern = _explode(items.where("entities is not null"), "entities", "e").select("key", "place", "relation", F.col("pos").alias("slot"), "e")
    rows = modern.unionByName(legacy).where("e is not null").where(F.schema_of_variant("e").startswith("OBJECT"))
    flag = F.try_variant_get("e", "$.virtual", "variant")
    shape = F.schema_of_variant(flag)
    truth = F.when(flag.isNull() | (shape == "VOID"), False).when(shape == "BOOLEAN", F.try_variant_get(flag, "$", "boolean")).when(shape == "STRING", F.try_variant_get(flag, "$", "string") != "").when(shape.startswith("ARRAY") | shape.startswith("OBJECT"), ~F.to_json(flag).isin("[]", "{}")).otherwise(F.try_variant_get(flag, "$", "double") != 0)
    named = rows.select("key", "place", "relation", "slot", T.strip(_text(F.try_variant_get("e", "$.name", "variant"))).alias("name"), F.lower(T.strip(F.coalesce(_text(F.try_variant_get("e", "$.attribute", "variant")), F.lit("")))).alias("attribute"), F.coalesce(truth, F.lit(False)).alias("virtual")).where("name <> ''")
    # a question's sub-questions are few: the lists below hold one model answer each
    grouped = named.groupBy("key", "place", "relation").agg(F.array_sort(F.collect_list(F.struct("slot", "name", "attribute", "virtual"))).alias("slots")).where(F.size("slots") >= 2)
    ordered = grouped.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("place", "relation", "slots"))).alias("items"))
    subq = ordered.select("key", F.posexplode("items").alias("qid", "x")).select("key", "qid", "x.relation", F.posexplode("x.slots").alias("slot", "s"))
    return subq.select("key", "qid", "relation", "slot", "s.name", "s.attribute", "s.virtual")


def slots_of(subq: DataFrame) -> DataFrame:
    """Adds `slot_key` and `embed_text` and keeps a key once a sub-question, where it is first seen."""
    keyed = subq.withColumn("slot_key", slot_key(F.col("name"), F.col("attribute"), F.col("virtual"))).withColumn("embed_text", slot_embed_text(F.col("name"), F.col("attribute")))
    first = keyed.groupBy("question_id", "qid", "slot_key").agg(F.min_by(F.struct("slot", "name", "attribute", "virtual", "embed_text"), "slot").alias("s"))
    return first.select("question_id", "qid", "slot_key", "s.*")


def neighbours(slots: DataFrame) -> DataFrame:
    """(question_id, qid, other): sub-questions of a question that share a slot, both ways."""
    other = slots.select("question_id", "slot_key", F.col("qid").alias("other"))
    return slots.select("question_id", "slot_key", "qid").join(other, ["question_id", "slot_key"]).where("qid <> other").select("question_id", "qid", "other").distinct()


def _bipartite(slots: DataFrame) -> DataFrame:
    return slots.select("question_id", F.concat(F.lit("q"), F.lpad(F.col("qid").cast("string"), 12, "0")).alias("a"), F.concat(F.lit("s"), "slot_key").alias("b"))


def chains(slots: DataFrame) -> DataFrame:
    """(question_id, qid, chain): sub-questions linked by slots share a chain; chains are numbered by their smallest qid.

    Works on sub-question to slot edges, so a slot that many sub-questions share costs one edge each and no pairs.
    """
    comp = graph.components(_bipartite(slots), ["question_id"])
    mine = comp.where(F.col("node").startswith("q")).select("question_id", F.substring("node", 2, 12).cast("bigint").alias("qid"), "component")
    first = mine.groupBy("question_id", "component").agg(F.min("qid").alias("first"))
    ranked = first.groupBy("question_id").agg(F.array_sort(F.collect_list("first")).alias("firsts"))
    return mine.join(first, ["question_id", "component"]).join(ranked, "question_id").select("question_id", "qid", (F.array_position("firsts", F.col("first")) - 1).alias("chain"))


def slot_levels(slots: DataFrame) -> DataFrame:
    """(question_id, qid, level): steps from the nearest real slot, over slots and sub-questions."""
    starts = slots.where("not virtual").select("question_id", F.concat(F.lit("s"), "slot_key").alias("node"))
    found = graph.levels(_bipartite(slots), ["question_id"], starts)
    return found.where(F.col("node").startswith("q")).select("question_id", F.substring("node", 2, 12).cast("bigint").alias("qid"), "level")


def attribute_families(spark) -> DataFrame:
    """(slot_attr, ent_attr) of all pairs that go together; directed."""
    return spark.createDataFrame([(s, e) for s, es in ATTRIBUTE_FAMILIES.items() for e in es.split()], "slot_attr string, ent_attr string")


def compatible(slot_attr: Column, ent_attr: Column, other_is_unknown: bool = False) -> Column:
    """May an entity with this attribute fill the slot? A slot attribute without a family takes anything, and so does an
    entity without attribute; `other` is in no family (unless it is to count as unknown)."""
    family = F.create_map(*(x for s, es in ATTRIBUTE_FAMILIES.items() for x in (F.lit(s), F.array(*map(F.lit, es.split())))))
    mine = F.try_element_at(family, F.coalesce(slot_attr, F.lit("")))
    open_ = mine.isNull() | ent_attr.isNull() | (ent_attr == "")
    if other_is_unknown:
        open_ = open_ | (ent_attr == "other")
    return open_ | F.coalesce(F.array_contains(mine, F.coalesce(ent_attr, F.lit(""))), F.lit(False))
