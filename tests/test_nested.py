import json

import pytest

from quillmesh.operators import nested as N

EVENT = {"entities": [{"name": "a", "definition": "d"}, "text", None, {"name": "b", "definition": [" ", {"text": "deep"}]}], "relation": "r"}


def flat(spark, payloads):
    df = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(payloads)], "raw_id bigint, payload string, chunk_no string, key string")
    return N.flatten_records(df, "raw_id", "payload")


def found(spark, *payloads):
    e = flat(spark, payloads)["entity"].where("definition is not null")
    return sorted(tuple(r) for r in e.select("raw_id", "chunk_no", "event_no", "entity_no").collect())


def test_shapes(spark):
    record = {"title": "t", "events": [EVENT]}
    assert found(spark, json.dumps(record)) == [(0, 0, 0, 0), (0, 0, 0, 3)]
    assert found(spark, json.dumps([None, record])) == [(0, 1, 0, 0), (0, 1, 0, 3)]
    assert found(spark, json.dumps({"run": "r", "chunks": [3, record, record]})) == [(0, c, 0, n) for c in (1, 2) for n in (0, 3)]
    assert found(spark, json.dumps({"run": "r", "chunks": record})) == [(0, 0, 0, 0), (0, 0, 0, 3)]
    assert found(spark, json.dumps({"title": "t", "result": {"events": EVENT}})) == [(0, 0, 0, 0), (0, 0, 0, 3)]
    lone = {"title": "t", "events": {"entities": {"name": "a", "definition": {"text": "x", "lang": "en"}}}}
    assert found(spark, json.dumps(lone)) == [(0, 0, 0, 0)]
    old = {"title": "t", "events": [{"subject": {"definition": "s"}, "object": "o"}, {"subject": None, "object": {"definition": "o"}}]}
    assert found(spark, json.dumps(old)) == [(0, 0, 0, 0), (0, 0, 1, 1)]


@pytest.mark.parametrize("definition", [None, "", " \n", [], [None, " "], {}, {"text": " "}, {"lang": "en"}, 3])
def test_unusable_definitions(spark, definition):
    assert found(spark, json.dumps({"title": "t", "events": [{"entities": [{"name": "a", "definition": definition}]}]})) == []


def test_text_around(spark):
    body = json.dumps({"title": "t", "events": [EVENT]}, indent=1)
    for wrapped in (f"```json\n{body}\n```", f"﻿  {body}", f"<think>some [part] {{of it}}</think>\n{body}", f"Sure [1], see {{below}}: {body} done"):
        assert found(spark, wrapped) == [(0, 0, 0, 0), (0, 0, 0, 3)]


def test_nothing(spark):
    body = json.dumps({"run": "r", "chunks": [{"title": "t", "events": [EVENT]}]})
    for bad in (None, "", "  ", "null", "[]", "{}", "no json", body[:-2], body[:-40], "[" * 100_000):
        assert found(spark, bad) == []


def test_tables_and_parents(spark):
    t = flat(spark, [json.dumps([{"title": "t", "text": "x", "events": [EVENT, {"relation": None}]}, {"title": None, "events": None}]), "{}"])
    assert [tuple(r) for r in t["chunk"].orderBy("raw_id", "chunk_no").select("chunk_no", "title", "text").collect()] == [(0, "t", "x"), (1, None, None), (0, None, None)]
    assert [tuple(r) for r in t["event"].orderBy("event_no").select("chunk_no", "event_no", "relation").collect()] == [(0, 0, "r"), (0, 1, None)]
    assert [tuple(r) for r in t["entity"].orderBy("entity_no").select("entity_no", "name", "definition").collect()] == [(0, "a", "d"), (3, "b", "deep")]
    assert t["entity"].join(t["event"], ["raw_id", "chunk_no", "event_no"], "left_anti").isEmpty()


def test_long_and_empty(spark):
    long = json.dumps({"title": "t", "events": [{"entities": [{"name": "n", "definition": "d" * 1_000_000}] * 5}] * 3})
    assert len(found(spark, long)) == 15
    empty = spark.createDataFrame([], "raw_id bigint, payload string")
    assert all(df.isEmpty() for df in N.flatten_records(empty, "raw_id", "payload").values())


@pytest.mark.parametrize("before", [0, 150, 500])
def test_values_are_left_as_they_are(spark, before):
    """Fences and thought tags inside a string are part of it, wherever they stand."""
    value = "use ```py x``` and <think>this</think> here"
    body = json.dumps({"title": value, "text": "x" * before, "events": [{"entities": [{"name": "a", "definition": value}]}]})
    for wrapped in (body, f"```json\n{body}\n```", f"<think>no {{record}} </think>{body}"):
        t = flat(spark, [wrapped])
        assert t["chunk"].first().title == value and t["entity"].first().definition == value


def test_stream_against_the_json_module():
    """Triples put together again are what the json module reads, and what it refuses is refused."""
    import random

    rng = random.Random(7)

    def value(depth):
        if depth and rng.random() < 0.6:
            if rng.random() < 0.5:
                return [value(depth - 1) for _ in range(rng.randrange(4))]
            return {rng.choice(["a", "b.c", "d[]", 'e"', "é\n", ""]) + str(i): value(depth - 1) for i in range(rng.randrange(4))}
        return rng.choice([None, True, False, 0, -1.5, 1e30, "", "x\\y", 'q"', "\t", "𝒳", "[{"])

    def build(out):
        root = [None]
        for path, ordinals, kind, text in out:
            at, key, numbers = root, 0, iter(ordinals)
            for k in path:
                at, key = at[key], next(numbers) if k is None else k
            made = {} if kind == N.OBJECT else [] if kind == N.LIST else text if kind == "string" else None if kind == "null" else json.loads(text)
            if isinstance(at, list) and key == len(at):
                at.append(made)
            else:
                at[key] = made
        return root[0]

    for _ in range(400):
        v = value(5)
        text = json.dumps(v, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        out, end = N.read_triples(text + " rest")
        assert build(out) == v and end == len(text)
        if isinstance(v, (dict, list)):
            with pytest.raises(N.Broken):
                N.read_triples(text[: rng.randrange(len(text))])
    for bad in ("{'a': 1}", '{"a" 1}', "[1,]", "[1 2]", '{"a":1,}', '["\\x"]', "[01]", "[nul]", "]", '{1: 2}'):
        with pytest.raises(N.Broken):
            N.read_triples(bad)


@pytest.mark.parametrize("piece", ["[1,", "[ ", '["a",', "x [y "])
def test_many_open_brackets_take_linear_time(piece):
    import time

    start = time.perf_counter()
    assert N.decode(piece * 50_000) is None
    assert time.perf_counter() - start < 10


def test_any_shape(spark):
    records = [{"id": 1, "lines": [{"sku": "a", "tags": ["x", "y"], "size": {"w": 2}}, {"sku": None}], "to": {"city": "Wyk"}}, {"id": 2, "lines": []}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, "{broken"), (None, "{}")], "k bigint, doc string")
    t = N.flatten_any(df, "k", "doc")
    assert set(t) == {"", "lines[]", "lines[].tags[]"}
    assert sorted((r.k, r.id, r["to.city"]) for r in t[""].collect()) == [(0, "1", "Wyk"), (1, "2", None)]
    assert sorted((r.k, r.ordinals, r.sku, r["size.w"]) for r in t["lines[]"].collect()) == [(0, [0], "a", "2"), (0, [1], None, None)]
    assert sorted((r.ordinals, r.value) for r in t["lines[].tags[]"].collect()) == [([0, 0], "x"), ([0, 1], "y")]
    assert N.flatten_any(df.limit(0), "k", "doc") == {}
