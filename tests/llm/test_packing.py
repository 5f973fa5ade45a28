import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import packing as P


@pytest.mark.parametrize("seed", range(8))
def test_histogram_packing(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(1, 20), 100, 7]) for _ in range(rng.randint(0, 3000))]
    segments, used = P.pack_histogram(Counter(sizes), 100)
    room, taken = defaultdict(int), defaultdict(int)
    for s in segments:
        assert s.start == taken[s.size] and s.each > 0 and s.count > 0
        taken[s.size] += s.each * s.count
        for c in range(s.base, s.base + s.count):
            room[c] += s.each * s.size
    assert taken == Counter(sizes) and len(room) == used and all(v <= 100 for v in room.values())
    assert used <= -(-sum(sizes) // 100) * 1.25 + 2


def packed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens bigint, container string")
    return P.pack_documents(df, capacity).collect()


@pytest.mark.parametrize("seed", range(3))
def test_documents(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 33, 40, 99, 100, 101, 250, 999, rng.randint(1, 120)]) for _ in range(800)] + [33] * 600
    rows = packed(spark, sizes, 100)
    fill, parts = Counter(), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        if r.container is None:
            assert sizes[r.doc_id] == 0
        else:
            fill[r.container] += r.n_tokens
    assert set(parts) == set(range(len(sizes))) and max(fill.values()) <= 100
    for i, p in parts.items():
        assert sum(r.n_tokens for r in p) == sizes[i] and len(p) == max(1, -(-sizes[i] // 100)) == p[0].n_parts
        assert sorted(r.part_no for r in p) == list(range(len(p)))
    assert sum(fill.values()) / (100 * len(fill)) > 0.9


def test_edges(spark):
    assert packed(spark, [], 100) == []
    assert [r.container for r in packed(spark, [0, 0], 100)] == [None, None]
    assert sorted((r.container, r.n_tokens) for r in packed(spark, [100, 100], 100)) == [(0, 100), (1, 100)]


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world, hello."), (2, ""), (3, None), (None, "x"), (4, "été 東京 " * 3), (5, "word " * 20_000)], "doc_id bigint, text string").withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r.n_tokens for r in P.token_counts(df).collect()}
    enc = P.encoder(P.VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in [(1, "Hello world, hello."), (2, ""), (3, ""), (4, "été 東京 " * 3), (5, "word " * 20_000)]}
    assert enc.decode(enc.encode_ordinary("Any text, 12 été\n\n  x")) == "Any text, 12 été\n\n  x"


def test_shortest_pack_first():
    """The 1 goes to the container with the most room, where best fit would fill the 9 up."""
    segments, used = P.pack_histogram({9: 1, 5: 1, 1: 1}, 10)
    assert used == 2 and [(s.size, s.base) for s in segments] == [(9, 0), (5, 1), (1, 1)]


@pytest.mark.parametrize("seed", range(6))
def test_as_item_by_item(seed):
    """Runs of containers give what placing one item at a time into the emptiest container gives."""
    rng = random.Random(seed)
    sizes = sorted((rng.choice([rng.randint(1, 60), 7, 3]) for _ in range(rng.randint(1, 400))), reverse=True)
    rooms: list[int] = []
    for s in sizes:
        at = max(range(len(rooms)), key=lambda i: rooms[i], default=None)
        if at is not None and rooms[at] >= s:
            rooms[at] -= s
        else:
            rooms.append(60 - s)
    segments, used = P.pack_histogram(Counter(sizes), 60)
    filled = Counter()
    for s in segments:
        for c in range(s.base, s.base + s.count):
            filled[c] += s.each * s.size
    assert used == len(rooms) and sorted(60 - v for v in filled.values()) == sorted(rooms)
