import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.llm import duplicates as D


def key(text):
    return "".join(c for c in text.upper().lower() if c.isalnum())


def chunks(spark, texts):
    rows = [(i + 1, t, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id bigint, text string, id string")


def members(spark, texts):
    _, m = D.chunk_duplicates(chunks(spark, texts))
    return sorted((r.first_id, r.id) for r in m.where("id <> first_id").collect())


def test_looks(spark):
    texts = ["Ann met Bob in 1990.", "ANN MET BOB IN 1990", "- ann, m\ufe0fet ​bob «in» 1990…", "Ann met Bob in 1991.", "Bob met Ann in 1990.", None, "", "Ann met Bob in 1990."]
    assert members(spark, texts) == [(1, 2), (1, 3), (1, 8)]


@pytest.mark.parametrize("sep", ["\n", "\n- ", " | ", "; ", " • ", ", ", "\r\n", " / ", "\t"])
def test_infobox_fields_in_any_order(spark, sep):
    fields = ["Name: Ann Lee", "Born: 1 May 1900", "Height: 180 cm", "Known for: One Bridge"]
    assert members(spark, ["\n".join(fields), sep.join(reversed(fields)), sep.join(f.upper() for f in fields), sep.join(fields[:3])]) == [(1, 2), (1, 3)]


def test_prose_keeps_its_order(spark):
    assert members(spark, ["Title: A went. B came.", "B came. Title: A went.", "One. Two.", "Two. One."]) == []


def test_facts(spark):
    e = lambda *names: [(n, "a", None) for n in names]
    data = [(1, "R x.", e("A", "B"), "p"), (2, "r X", e("b", "a."), None), (3, "r x", e("a", "b", "b"), None), (4, "r x", e("a"), None), (5, None, None, None), (6, "r x", None, None), (7, None, e("q"), None), (8, "", e("Q", ), None), (9, "R, x", [None, ("A", None, None), ("B", None, None)], None)]
    df = spark.createDataFrame(data, "rel_id bigint, relation string, entities array<struct<name:string,attribute:string,definition:string>>, raw string")
    groups, m = D.fact_duplicates(df)
    assert sorted((r.first_id, r.id) for r in m.where("id <> first_id").collect()) == [(1, 2), (7, 8)]
    assert groups.agg(F.sum("n_copies")).first()[0] == 8


def test_counts_and_hot_group(spark):
    hot = ["The same text again."] * 3000 + ["THE SAME TEXT AGAIN"] * 2000 + [f"text {i}" for i in range(5000)]
    groups, m = D.chunk_duplicates(chunks(spark, hot))
    top = groups.orderBy(F.desc("n_copies")).first()
    assert (top.first_id, top.n_copies, top.n_forms) == (1, 5000, 2)
    assert m.where("id <> first_id").count() == 4999 and groups.count() == 5001


def test_empty_and_long(spark):
    assert members(spark, []) == []
    long = "Lorem ipsum, dolor. " * 50_000
    assert members(spark, [long, long.upper(), long + "x"]) == [(1, 2)]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="aAbB1 .,\n-é", max_size=6), min_size=1, max_size=40))
def test_against_brute_force(spark, texts):
    first, want = {}, []
    for i, t in enumerate(texts, 1):
        k = key(t)
        if k in first:
            want.append((first[k], i))
        first.setdefault(k, i)
    assert members(spark, texts) == sorted(want)


def test_shuffled_infoboxes_against_brute_force(spark):
    rng = random.Random(3)
    texts, want, first = [], [], {}
    for i in range(200):
        fields = [f"{label}: {rng.choice('xyz')}" for label in rng.sample(["Name", "Born", "Club"], rng.choice([2, 3]))]
        k = tuple(sorted(map(key, fields)))
        if k in first:
            want.append((first[k], i + 1))
        first.setdefault(k, i + 1)
        texts.append(rng.choice(["\n", " | ", "; "]).join(fields))
    assert members(spark, texts) == sorted(want)


def test_long_labels_and_late_colons(spark):
    """Labels of any length make a field; an infobox may begin with any number of marks."""
    one, two = f"{'Name of the largest tributary ' * 3}: Esk", "Born: 1900"
    assert members(spark, [f"{one}\n{two}", f"{two} | {one}", f"{'# ' * 40}{two}\n{one}"]) == [(1, 2), (1, 3)]
