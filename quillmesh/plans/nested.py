"""Queries over extraction payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import build, nested
from quillmesh.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    entities = nested.flatten_level(table(spark, d, "extraction"), "raw_id", "payload", "entity")
    return entities.where(F.col("definition").isNotNull()).select("raw_id", "chunk_no", "event_no", "entity_no")


def p4_chunks(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_level(table(spark, d, "extraction"), "raw_id", "payload", "chunk")


def p4_events(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_level(table(spark, d, "extraction"), "raw_id", "payload", "event")


def p4_entities(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_level(table(spark, d, "extraction"), "raw_id", "payload", "entity")


def payload_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the extraction payloads, ready to build a graph of."""
    f = build.load_events(table(spark, d, "extraction"))
    return f.select("rel_id", "relation", "source_title", "chunk_id", F.size("entities").alias("n_entities"))


QUERIES = {f.__name__: f for f in (p4_found, p4_chunks, p4_events, p4_entities, payload_facts)}
SQL: dict[str, str] = {}
