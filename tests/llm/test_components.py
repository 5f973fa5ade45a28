import random

import pytest

from quillmesh.llm import components as C


def brute(edges):
    par = {}

    def find(x):
        par.setdefault(x, x)
        while par[x] != x:
            x = par[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            par[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in par}


def groups(spark, edges):
    df = spark.createDataFrame([(a, b, 7) for a, b in edges], "a bigint, b bigint, u int")
    return {tuple(r) for r in C.connected_groups(df, "a", "b").collect()}


def shapes():
    rng = random.Random(5)
    yield "path", [(i, i + 1) for i in range(200)]
    order = list(range(100))
    rng.shuffle(order)
    yield "shuffled path", list(zip(order, order[1:]))
    yield "star", [(0, i) for i in range(1, 500)] + [(i, 0) for i in range(1, 50)]
    yield "random", [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    yield "bad rows", [(None, 1), (2, None), (3, 3), (4, 5), (5, 4), (4, 5), (None, None)]
    yield "negative", [(-5, 3), (3, -9), (10, 11)]
    yield "empty", []
    yield "loops only", [(1, 1)]


@pytest.mark.parametrize("edges", [e for _, e in shapes()], ids=[n for n, _ in shapes()])
def test_connected_groups(spark, edges):
    assert groups(spark, edges) == brute(edges)


def test_entity_groups(spark):
    ents = spark.createDataFrame([(1, "old rite church"), (2, "ann lee"), (3, "bob"), (2, "ann lee"), (4, "lonely"), (5, None)], "ent_id bigint, canonical string")
    pairs = [("ent::Ann Lee", "\tBOB "), (" ent::bob", "ANN LEE"), ("nobody", "bob"), (None, "bob"), ("  ", "lonely"), ("lonely", "Lonely"), ("Ent::old rite church ", "ent::nobody")]
    df = spark.createDataFrame([(i, a, b, None) for i, (a, b) in enumerate(pairs)], "pair_id bigint, a string, b string, similarity double")
    assert {tuple(r) for r in C.entity_groups(df, ents).collect()} == {(2, 2), (3, 2)}
