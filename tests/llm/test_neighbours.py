import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.llm import neighbours as V


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 12 + 1, dim))
    return (centres[rng.integers(0, len(centres), n)] + 0.25 * rng.standard_normal((n, dim))).astype(np.float32) * rng.uniform(0.5, 3, (n, 1)).astype(np.float32)


def frame(spark, x, bad=()):
    return spark.createDataFrame([(i, [float(v) for v in r], "c") for i, r in enumerate(x)] + [(b[0], b[1], "c") for b in bad], "ent_id bigint, vec array<float>, cell string").repartition(4)


def truth(x, k, least):
    u = x.astype(np.float64) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(a, int(b)) for a in range(len(x)) for b in np.argsort(-s[a], kind="stable")[:k] if s[a, b] >= least}


@pytest.mark.parametrize("dim", [64, 24, 100])
def test_recall(spark, dim):
    x = clustered(2500, dim, dim)
    got = {(r["query"], r["id"]) for r in V.similar_vectors(frame(spark, x), "ent_id", "vec", 5, dim, 0.6).collect()}
    want = truth(x, 5, 0.6)
    assert len(got & want) / len(want) >= 0.95 and len(got - want) <= 0.05 * len(want)


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, rot = V._unit(clustered(400, 64, 1)).astype(np.float32), V._rotation(64)
    centre = x.mean(axis=0)
    low, high = V.Codes(x, centre, rot).bounds(x[:100], centre, rot)
    real = x[:100] @ x.T
    assert ((low <= real + 1e-5) & (real <= high + 1e-5)).mean() > 0.97 and rng is not None
    assert np.allclose(rot @ rot.T, np.eye(64), atol=1e-5)


def test_blocks_give_the_same(spark, monkeypatch):
    x = clustered(900, 32, 3)
    take = lambda: sorted(tuple(r) for r in V.similar_vectors(frame(spark, x), "ent_id", "vec", 4, 32, probes=1000, margin=9.0).select("query", "id", "rank").collect())
    whole = take()
    monkeypatch.setattr(V, "BLOCK", 60)
    assert take() == whole
    assert {(a, b) for a, b, _ in whole} == truth(x, 4, -1.0)


def test_queries_and_bad_rows(spark):
    x = clustered(300, 16, 5)
    bad = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [float("inf")] + [1.0] * 15), (905, [1.0] * 15), (906, [None] * 16), (None, [1.0] * 16), (7, [float(v) for v in x[7]])]
    out = V.similar_vectors(frame(spark, x, bad), "ent_id", "vec", 3, 16, queries=F.col("id") % 20 == 0, probes=99, margin=9.0).collect()
    assert {r["query"] for r in out} == set(range(0, 300, 20)) and len(out) == 45 and all(r["id"] < 300 for r in out)
    assert V.similar_vectors(frame(spark, x[:0]), "ent_id", "vec", 3, 16).isEmpty()
    one = V.similar_vectors(frame(spark, x[:1]), "ent_id", "vec", 3, 16)
    assert one.isEmpty()


def test_ties_and_copies(spark):
    x = np.repeat(clustered(5, 16, 9), 40, axis=0)
    pairs = V.close_pairs(frame(spark, x), "ent_id", "vec", 5, 0.85, 16).collect()
    assert all(r.a < r.b and r.a // 40 == r.b // 40 for r in pairs)
    near = V.similar_vectors(frame(spark, x), "ent_id", "vec", 5, 16, 0.85).groupBy("query").count().collect()
    assert len(near) == 200 and all(r["count"] == 5 for r in near)


def test_cells_inside_a_cell(spark, monkeypatch):
    """One cell for everything, cut inside: with enough probes nothing is lost, with few hardly anything."""
    x = clustered(3000, 48, 11)
    monkeypatch.setattr(V, "MAX_CELLS", 1)
    want = truth(x, 5, 0.6)
    for probes, margin, share in ((99, 9.0, 1.0), (8, 0.15, 0.9)):
        got = {(r["query"], r["id"]) for r in V.similar_vectors(frame(spark, x), "ent_id", "vec", 5, 48, 0.6, probes, margin).collect()}
        assert len(got & want) >= share * len(want)
