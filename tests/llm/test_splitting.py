import random
import time

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import splitting as S


def pieces(spark, texts, limit=80, overlap=15):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r.i: r.p for r in df.select("i", S.split_pieces(F.col("t"), limit, overlap).alias("p")).collect()}


def sample(rng, n):
    out = ""
    while len(out) < n:
        out += rng.choice(["word ", "a", "Sentence ends. ", "line\n", "x" * 120, "   ", "é𝒳z ", "\n\n", "He said “no.” ", " "])
    return out.strip(" \t\r\n")


@pytest.mark.parametrize("limit, overlap", [(80, 15), (80, 0), (800, 100), (2, 1)])
def test_round_trip(spark, limit, overlap):
    rng = random.Random(limit + overlap)
    texts = [sample(rng, rng.choice([10, 300, 2000])) for _ in range(30)] + ["", "x", "y" * 5000, "z " * 3000, "𝒳" * 500]
    for i, got in pieces(spark, texts, limit, overlap).items():
        text = texts[i]
        end, body = 0, ""
        for k, p in enumerate(got):
            assert len(p.piece) <= limit and text[p.start : p.start + len(p.piece)] == p.piece
            stop = p.start + len(p.piece)
            assert stop > end and not text[end : max(p.start, end)].strip(), "what is skipped is blank"
            body += text[max(p.start, end) : stop]
            if p.start:
                assert p.start + overlap >= end and not text[end : p.start + overlap].strip(), "the overlap ends where the new text begins"
            end = stop
        assert "".join(body.split()) == "".join(text.split())
        assert (len(got) > 1) == (len(text) > limit) or not text


def test_boundaries(spark):
    text = "First sentence stands here. Second one is a little longer than that. Third one. " * 5
    got = pieces(spark, [text.strip()], 80, 0)[0]
    assert all(p.piece.rstrip().endswith(".") for p in got)
    got = pieces(spark, ["wordword " * 40], 80, 0)[0]
    assert all(p.piece.strip().split(" ")[0] == "wordword" for p in got)


def test_items(spark):
    c = spark.createDataFrame([(1, "\t\r\n" + "a" * 801 + " ", "x"), (2, " " * 900 + "b", None), (3, None, None), (4, "c" * 800, None)], "chunk_id bigint, text string, src string")
    q = spark.createDataFrame([("q", [("t", ["d" * 400, None, " ", "\t" + "e" * 400 + "\n"]), (None, None), (None, ["f" * 400, "g" * 399])])] * 2 + [("r", None), (None, [("t", ["h" * 900])])], "id string, context array<struct<title:string,sentences:array<string>>>")
    items = S.chunk_items(c).unionByName(S.question_items(q))
    assert {tuple(r) for r in S.oversized(items).collect()} == {("chunk", "1", 0), ("question", "q", 0), ("question", None, 0)}
    table = S.pieces_table(items.where("item_id = '1'"))
    assert [(r.piece_no, r.start, r.n_chars) for r in table.orderBy("piece_no").collect()] == [(0, 0, 700), (1, 600, 201)]
    assert S.oversized(items.limit(0)).isEmpty()


def test_giant_text(spark):
    """One text of 4 million code points is cut in time in proportion to its length."""
    rng = random.Random(5)
    text = sample(rng, 20_000)
    text = ((text + " ") * (4_000_000 // len(text))).strip()
    start = time.perf_counter()
    got = pieces(spark, [text], 800, 100)[0]
    took = time.perf_counter() - start
    assert len(got) > 5000 and all(text[p.start : p.start + len(p.piece)] == p.piece for p in got[:: len(got) // 50])
    assert took < 60
