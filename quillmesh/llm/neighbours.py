"""The most similar vectors of every vector, by rotated one-bit codes inside cells.

Cells come from a k-means of a bounded sample; every vector is coded and kept in its nearest cell, and is sent as a query
to the cells whose centres are nearly as close. Inside a cell each vector is one bit a dimension: the signs of its
randomly rotated residual, with two correction scalars. Queries are cut to four bits a dimension, so an inner product is
estimated with four AND-and-count steps on packed words. The estimate has an error bound; only vectors whose upper bound
reaches the best lower bounds (or the least similarity that is asked for) are ranked by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors a cell should hold, and limits of the number of cells and of the k-means sample (rows).
CELL_SIZE, MAX_CELLS, SAMPLE_PER_CELL, MAX_SAMPLE = 200, 16_384, 24, 131_072
#: Vectors or queries of one cell that meet in one task at most.
BLOCK = 4_096
#: A block with more vectors than this is cut into cells of its own.
SPLIT_SIZE = 5 * CELL_SIZE
#: Width of the error bound in standard deviations of the estimate.
EPSILON = 2.4
#: Bits of a query's dimension.
QUERY_BITS = 4


def usable(vec: Column, dim: int) -> Column:
    """Exactly `dim` finite values, not all zero."""
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vec) == dim) & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def _rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(7).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centres of a spherical k-means; the start is spread evenly over the sample's order."""
    centres = sample[np.linspace(0, len(sample) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-6, sums / np.maximum(norm, 1e-6), centres).astype(np.float32)
    return centres


class Codes:
    """One-bit codes of vectors around a centre."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, rotation: np.ndarray):
        self.dim = vectors.shape[1]
        residual = vectors - centre
        self.far = np.linalg.norm(residual, axis=1)
        turned = (residual @ rotation) / np.maximum(self.far, 1e-9)[:, None]
        bits = turned > 0
        self.words = _pack(bits)
        self.ones = bits.sum(axis=1)
        # inner product of the residual with its own code; how well the code stands for it
        self.fit = np.maximum(np.abs(turned).sum(axis=1) / np.sqrt(self.dim), 1e-3)
        self.slack = EPSILON * np.sqrt(np.maximum(1 - self.fit**2, 0)) / self.fit / np.sqrt(max(self.dim - 1, 1))

    def bounds(self, queries: np.ndarray, centre: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the cosine of every query (rows) with every vector (columns)."""
        residual = queries - centre
        far = np.linalg.norm(residual, axis=1)
        turned = (residual @ rotation) / np.maximum(far, 1e-9)[:, None]
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << QUERY_BITS) - 1), 1e-9)
        cut4 = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        counted = np.zeros((len(queries), len(self.ones)), np.float32)
        for bit in range(QUERY_BITS):
            plane = _pack((cut4 >> bit) & 1)
            for w in range(plane.shape[1]):
                counted += np.float32(1 << bit) * np.bitwise_count(plane[:, w : w + 1] & self.words[:, w])
        # sum over dimensions of +-(low + step * value): twice what the set bits give, less the whole
        total = low * self.dim + step * cut4.sum(axis=1, dtype=np.int64)
        dots = 2 * (low[:, None] * self.ones + step[:, None] * counted) - total[:, None]
        estimate = dots / np.sqrt(self.dim) / self.fit
        error = self.slack + (step[:, None] / 2) / self.fit
        scale = far[:, None] * self.far
        base = 1 - (far[:, None] ** 2 + self.far**2) / 2
        return base + scale * (estimate - error), base + scale * (estimate + error)


def _pack(bits: np.ndarray) -> np.ndarray:
    """Rows of bits in 64-bit words."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits.astype(np.uint8), ((0, 0), (0, pad))), axis=1).view(np.uint64)


def search_cells(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, centre: np.ndarray, rotation: np.ndarray, k: int, least: float, probes: int, margin: float) -> list[tuple]:
    """As search_block; a block of more than SPLIT_SIZE vectors is cut into cells of its own first, and a query meets those
    whose centre is nearly as close as the nearest. So the work of a vector does not grow with its cell."""
    if len(ids) <= SPLIT_SIZE:
        return search_block(ids, vectors, qids, queries, centre, rotation, k, least)
    cells = len(ids) // CELL_SIZE
    centres = fit_cells(vectors[:: max(len(ids) // (cells * SAMPLE_PER_CELL), 1)], cells)
    home = (vectors @ centres.T).argmax(axis=1)
    sims = queries @ centres.T
    m = min(probes, cells)
    near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    close = np.take_along_axis(sims, near, axis=1)
    sent = close >= close.max(axis=1, keepdims=True) - margin
    out: list[tuple] = []
    for c in np.unique(home):
        mine, asks = home == c, ((near == c) & sent).any(axis=1)
        if asks.any():
            out.extend(search_block(ids[mine], vectors[mine], qids[asks], queries[asks], centres[c], rotation, k, least))
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, qids: np.ndarray, queries: np.ndarray, centre: np.ndarray, rotation: np.ndarray, k: int, least: float) -> list[tuple]:
    """(query, id, cosine) of up to k vectors for each query, without the query itself; ties by id."""
    codes, out = Codes(vectors, centre, rotation), []
    for at in range(0, len(qids), 512):
        q, mine = queries[at : at + 512], qids[at : at + 512]
        low, high = codes.bounds(q, centre, rotation)
        self_hit = mine[:, None] == ids
        low[self_hit] = -9
        floor = np.full(len(q), least)
        if len(ids) > k + 1:
            floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
        rows, cols = np.nonzero((high >= floor[:, None]) & ~self_hit)
        exact = np.einsum("ij,ij->i", q[rows].astype(np.float64), vectors[cols].astype(np.float64))
        keep = exact >= least
        rows, cols, exact = rows[keep], cols[keep], exact[keep]
        order = np.lexsort((ids[cols], -exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < k
        out.extend(zip(mine[rows[top]], ids[cols[top]], exact[top]))
    return out


def similar_vectors(df: DataFrame, id_col: str, vec_col: str, k: int, dim: int = 64, least: float = -1.0, probes: int = 8, margin: float = 0.15, queries: Column | None = None) -> DataFrame:
    """(query, id, cosine, rank) of up to k most similar vectors for each query vector.

    Only usable vectors take part (see usable). A row that is delivered again is seen once, where it meets its twin in a
    cell; an id that has several vectors is searched with each of them and keeps its best. `queries` is a condition on `id` that
    names the queries (all, if none). A query goes to at most `probes` cells, those whose centre's similarity is less than
    the best by at most `margin`, and inside a cell with many vectors to as many cells of its own; this alone can lose neighbours. least: pairs below this cosine are not reported. A cell
    of more than BLOCK vectors or queries is cut into blocks of both, so no task grows with a cell's share of the data.
    """
    spark = df.sparkSession
    schema = "query bigint, id bigint, cosine double"
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v"), dim))
    n = rows.count()
    if not n:
        return spark.createDataFrame([], schema + ", rank int")
    cells = int(min(max(n // CELL_SIZE, 1), MAX_CELLS))
    want = min(cells * SAMPLE_PER_CELL, MAX_SAMPLE, n)
    sample = rows.withColumn("h", F.xxhash64("id")).orderBy("h").limit(want).select("v").toPandas()["v"]
    rotation, centres = _rotation(dim), fit_cells(_unit(np.stack(sample.to_numpy())).astype(np.float32), cells)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x = _unit(np.stack(b["v"].to_numpy()).astype(np.float64)).astype(np.float32)
            sims = x @ centres.T
            m = min(probes, cells)
            near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1, kind="stable"), axis=1)
            s = np.take_along_axis(sims, near, axis=1)
            r, c = np.nonzero(s >= s[:, :1] - margin)
            packed = [v.tobytes() for v in x]
            yield pd.DataFrame({"id": b["id"].to_numpy()[r], "cell": near[r, c], "home": c == 0, "vec": [packed[i] for i in r]})

    spread = rows.mapInPandas(assign, "id bigint, cell int, home boolean, vec binary")
    asks = queries if queries is not None else F.lit(True)
    spread = spread.withColumn("asks", asks).where("home or asks")
    sizes = spread.groupBy("cell").agg(F.count_if("home").alias("n"), F.count_if("asks").alias("m")).where(f"n > {BLOCK} or m > {BLOCK}").collect()
    big = {r["cell"]: (-(-r["n"] // BLOCK), -(-r["m"] // BLOCK)) for r in sizes}  # of at most MAX_CELLS cells
    if big:
        table = F.create_map(*[F.lit(x) for c, (a, b) in big.items() for x in (c, f"{a},{b}")])
        parts = F.coalesce(F.element_at(table, F.col("cell")), F.lit("1,1"))
    else:
        parts = F.lit("1,1")
    spread = spread.withColumn("nb", F.split(parts, ",")[0].cast("int")).withColumn("qb", F.split(parts, ",")[1].cast("int"))
    # one row for each block that a vector is data or a query in; both at once in a cell that is one block
    h = F.xxhash64("id")
    lone = (F.col("nb") == 1) & (F.col("qb") == 1)
    of = lambda b, a, data, both: F.struct(b.cast("int").alias("b"), a.cast("int").alias("a"), data.alias("data"), both.alias("both"))
    none = F.array().cast("array<struct<b:int,a:int,data:boolean,both:boolean>>")
    as_data = F.when(F.col("home"), F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda a: of(F.pmod(h, F.col("nb")), a, F.lit(True), lone & F.col("asks")))).otherwise(none)
    as_query = F.when(F.col("asks") & ~(F.col("home") & lone), F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda b: of(b, F.pmod(h, F.col("qb")), F.lit(False), F.lit(False)))).otherwise(none)
    blocks = spread.withColumn("at", F.explode(F.concat(as_data, as_query))).select("cell", "at.a", "at.b", "id", "vec", "at.data", "at.both")

    def search(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates(["id", "vec", "data"])
        x = np.frombuffer(b"".join(g["vec"]), np.float32).reshape(len(g), dim)
        ids, data, q = g["id"].to_numpy(), g["data"].to_numpy(bool), (~g["data"] | g["both"]).to_numpy(bool)
        got = search_cells(ids[data], x[data], ids[q], x[q], centres[key[0]], rotation, k, least, probes, margin) if data.any() and q.any() else []
        return pd.DataFrame(got, columns=["query", "id", "cosine"]).astype({"query": "int64", "id": "int64", "cosine": "float64"})

    found = blocks.groupBy("cell", "a", "b").applyInPandas(search, schema)
    found = found.groupBy("query", "id").agg(F.max("cosine").alias("cosine"))
    best = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def close_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = 5, least: float = 0.85, dim: int = 64) -> DataFrame:
    """(a, b), a < b, once each: cosine at least `least`, and one among the k most similar of the other."""
    near = similar_vectors(df, id_col, vec_col, k, dim, least)
    return near.select(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).distinct()
