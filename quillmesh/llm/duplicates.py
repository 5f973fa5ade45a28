"""Copies that differ in formatting only: white space, case, punctuation, invisible characters, field order.

Byte-identical rows are collapsed first with their count and smallest id; only distinct survivors are brought into
canonical form; then they are grouped again on the whole canonical text and the counts are summed. Both groupings
combine on the map side, so a text that makes up a third of all rows leaves each map task as one row. The way back from
a group to its ids goes over 128-bit digests and never gathers a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.skew import salted_join
from quillmesh.session import cut

#: Everything but letters, digits and the marks that belong to letters; selectors and joiners among the marks show nothing.
_IGNORED = r"[^\p{L}\p{N}\p{M}]+|[\x{FE00}-\x{FE0F}\x{034F}\x{180B}-\x{180D}]+"
#: A field's label: words that begin the field and end in a colon, however many.
_LABEL = r"\p{L}[\p{L}\p{N}'’()/ _.\-]*+:"
#: What may stand between two fields, if a label follows.
_BREAK = rf"(?:[\s\p{{Z}}]*[\r\n;|•·▪‣,/\t]+[\s\p{{Z}}\-*•·–—]*)(?=[\p{{Pi}}\p{{Ps}}\"']?{_LABEL})"


def letters_and_digits(text: Column) -> Column:
    """The letters and digits of a text in order, in one case. Upper case first, so that ß and SS agree."""
    return F.regexp_replace(F.lower(F.upper(text)), _IGNORED, "")


def canonical_text(text: Column) -> Column:
    """Canonical form of a passage. If it consists of `label: value` fields only, the fields are sorted.

    A passage counts as such an infobox if it splits into two or more parts that all are `label: value`; anything else is
    compared as it stands. Null gives null; a text without letters and digits gives the empty string.
    """
    trimmed = F.regexp_replace(text, r"^[\s\p{Z}\p{Cf}\-*•·–—]+", "")
    parts = F.filter(F.split(trimmed, _BREAK), lambda p: F.length(letters_and_digits(p)) > 0)
    is_box = F.coalesce(F.size(parts) >= 2, F.lit(False)) & F.forall(parts, lambda p: p.rlike(rf"^[\s\p{{Z}}\p{{P}}]*{_LABEL}\s*\S"))
    fields = F.array_join(F.array_sort(F.transform(parts, letters_and_digits)), "|")
    # any infobox begins with a label, which is cheap to look for
    maybe = trimmed.rlike(rf"^[^\p{{L}}\p{{N}}]*+{_LABEL}")
    return F.when(maybe & is_box, F.concat(F.lit("|"), fields)).otherwise(letters_and_digits(text))


def canonical_fact(relation: Column, names: Column) -> Column:
    """Canonical form of a fact: the relation, then the entity names in sorted order, each as often as it occurs."""
    return F.concat_ws("|", letters_and_digits(F.coalesce(relation, F.lit(""))), F.array_sort(F.transform(F.coalesce(names, F.array().cast("array<string>")), lambda n: letters_and_digits(F.coalesce(n, F.lit(""))))))


def duplicate_groups(df: DataFrame, id_col: str, raw: Column, canonical) -> tuple[DataFrame, DataFrame]:
    """(groups, members) of one collection.

    raw: the bytes that are compared first, as one string column; canonical: makes the canonical form out of the column
    `raw`. groups has a row for each canonical text: first_id, n_copies, n_forms. members has a row for each record that
    has copies: id, first_id. Rows whose raw value is null are no records. A table without rows gives two empty ones.
    """
    rows = df.select(F.col(id_col).alias("id"), raw.alias("raw")).where("id is not null and raw is not null")
    exact = rows.groupBy("raw").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    forms = exact.select("id", "n", F.md5("raw").alias("raw_key"), canonical(F.col("raw")).alias("canon"))
    forms = cut(forms.select("id", "n", "raw_key", "canon").where("canon is not null"))
    groups = forms.groupBy("canon").agg(F.min("id").alias("first_id"), F.sum("n").alias("n_copies"), F.count("*").alias("n_forms"))
    several = groups.where("n_copies > 1").select(F.md5("canon").alias("canon_key"), "first_id")
    keys = forms.select("raw_key", F.md5("canon").alias("canon_key"))
    named = salted_join(keys, several, ["canon_key"]).select("raw_key", "first_id")
    members = salted_join(rows.select("id", F.md5("raw").alias("raw_key")), named, ["raw_key"]).select("id", "first_id")
    return groups.drop("canon"), members


#: Sets the parts of a fact's raw form apart; occurs in no text that a reader could write.
_UNIT = "\u001f"


def fact_raw(relation: Column, entities: Column) -> Column:
    """One string of relation and names as they stand; a fact of which both are missing is no record."""
    names = F.transform(F.coalesce(entities.getField("name"), F.array().cast("array<string>")), lambda n: F.coalesce(n, F.lit("")))
    return F.when(relation.isNotNull() | (F.size(names) > 0), F.concat_ws(_UNIT, F.coalesce(relation, F.lit("")), names))


def fact_canonical(raw: Column) -> Column:
    parts = F.split(raw, _UNIT)
    return canonical_fact(parts[0], F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))))


def fact_duplicates(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    return duplicate_groups(facts, "rel_id", fact_raw(F.col("relation"), F.col("entities")), fact_canonical)


def chunk_duplicates(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return duplicate_groups(chunks, "chunk_id", F.col("text"), canonical_text)
