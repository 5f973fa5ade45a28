"""Lexical and dense retrieval for a bounded set of queries against tables of any size.

The corpus is never repeated: term statistics come from map-side counts, only terms that some query holds are kept as
postings, and dense scores are made batch by batch against the query matrix, with a top-k cut inside each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions import text as T
from quillmesh.session import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: A query set beyond this many vectors is scored in several passes over the corpus.
QUERY_BLOCK = 4_096
#: Terms of queries, with their weights, that are broadcast at most (some 60 bytes each).
BROADCAST_ROWS = 200_000


def bm25_scores(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, score) for docs(doc_id, text) and queries(query_id, text) that share a term.

    Okapi BM25; negative idf is replaced by EPSILON times the mean idf over all terms of the corpus; a term that a query
    repeats counts as often. Statistics cover all documents, with null texts as empty ones. Term rows are narrow: per
    document and term a count, and only for the queries' terms; those of the whole vocabulary are reduced to counts.
    """
    counted = docs.select("doc_id", T.bm25_tokens(F.col("text")).alias("terms")).select("doc_id", F.size("terms").alias("length"), "terms")
    # one pass for the vocabulary: a document's length comes along under the empty term
    row = lambda term, length: F.struct(term.alias("term"), length.alias("length"))
    marks = F.concat(F.array(row(F.lit(""), F.col("length"))), F.transform(F.array_distinct("terms"), lambda t: row(t, F.lit(0))))
    vocabulary = cut(counted.select(F.explode(marks).alias("m")).groupBy("m.term").agg(F.count("*").alias("df"), F.sum("m.length").alias("length")))
    whole = vocabulary.where("term = ''").first()
    asked = cut(queries.select("query_id", F.explode(T.bm25_tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
    n, average = (whole["df"], whole["length"] / whole["df"]) if whole else (0, 0.0)
    idf = vocabulary.where("term <> ''").select("term", (F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("idf"))
    mean = idf.agg(F.avg("idf")).first()[0]
    weights = asked.join(idf, "term").select("query_id", "term", "times", F.when(F.col("idf") < 0, EPSILON * F.lit(mean)).otherwise(F.col("idf")).alias("idf"))
    weights = cut(weights)
    # as a rule queries are few: their terms go to the documents, so that a common word is nobody's hot key
    few = weights.count() <= BROADCAST_ROWS
    wanted = weights.select("term").distinct()
    postings = counted.select("doc_id", "length", F.explode("terms").alias("term")).join(F.broadcast(wanted) if few else wanted, "term", "left_semi").groupBy("doc_id", "length", "term").agg(F.count("*").alias("tf"))
    hits = postings.join(F.broadcast(weights) if few else weights, "term")
    gain = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(average or 1.0)))
    return hits.select("query_id", "doc_id", gain.alias("g")).groupBy("query_id", "doc_id").agg(F.sum("g").alias("score"))


def top_k(scores: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the row_number filter lets each map task keep k rows a group before the shuffle."""
    return scores.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def with_zero_fill(scores: DataFrame, docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k documents a query, where documents without a shared term fill up with score 0, smallest id first.

    At most k fillers are needed, and among the 2k smallest ids at most k can be scored already.
    """
    spare = docs.select("doc_id").distinct().orderBy("doc_id").limit(2 * k)
    fill = queries.select("query_id").distinct().join(F.broadcast(spare), how="cross").withColumn("score", F.lit(0.0))
    best = top_k(scores.withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), F.col("doc_id")], k)
    filled = fill.join(scores.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    return top_k(best.drop("rank").unionByName(filled), ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def normalized_scores(scores: DataFrame) -> DataFrame:
    """Scores by the largest of their query; 0 where that is not positive. Stays sparse."""
    peak = scores.groupBy("query_id").agg(F.max("score").alias("peak"))
    return scores.join(peak, "query_id").withColumn("score", F.when(F.col("peak") > 0, F.col("score") / F.col("peak")).otherwise(0.0)).drop("peak")


def dense_above(docs: DataFrame, queries: DataFrame, slack: float | None = None, floor: float | None = None, vectors: tuple[str, ...] = ("vec",)) -> DataFrame:
    """(query_id, doc_id, sim) of all documents whose mean cosine is at least `floor`, or within `slack` of the query's
    best. A batch gives what may still count against its own best; the best of all is known behind the batches."""
    keep = lambda sims: sims >= (floor if floor is not None else sims.max(axis=1, keepdims=True) - slack - 1e-8)
    found = _dense_scan(docs, queries, keep, vectors)
    if slack is None:
        return found
    best = found.groupBy("query_id").agg(F.max("sim").alias("__best"))
    return found.join(F.broadcast(best), "query_id").where(F.round(F.col("sim") - F.col("__best"), 9) >= -slack).drop("__best")


def dense_top_k(docs: DataFrame, queries: DataFrame, k: int, vectors: tuple[str, ...] = ("vec",)) -> DataFrame:
    """(query_id, doc_id, sim, rank): the k documents with the largest mean cosine over the given vector columns."""

    def keep(sims: np.ndarray) -> np.ndarray:
        take = min(k, sims.shape[1])
        return sims >= -np.partition(-sims, take - 1, axis=1)[:, take - 1 : take]

    return top_k(_dense_scan(docs, queries, keep, vectors).distinct(), ["query_id"], [F.desc("sim"), F.col("doc_id")], k)


def _dense_scan(docs: DataFrame, queries: DataFrame, keep, vectors: tuple[str, ...]) -> DataFrame:
    """(query_id, doc_id, sim) of what `keep` lets through of each batch's matrix of cosines (queries x documents).

    queries(query_id, vec). Vectors that are null, of another length, not finite or all zero take no part. The queries
    reach the tasks as a matrix, QUERY_BLOCK at a time.
    """
    found = None
    order = queries.where(_usable(F.col("vec"), None)).select("query_id", "vec").orderBy("query_id")
    block: list = []

    def score(rows: list) -> DataFrame:
        ids = np.array([r[0] for r in rows])
        matrix = np.array([r[1] for r in rows], np.float64)
        matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
        dim = matrix.shape[1]
        fits = docs
        for v in vectors:
            fits = fits.where(_usable(F.col(v), dim))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if not len(b):
                    continue
                sims = 0.0
                for v in vectors:
                    x = np.stack(b[v].to_numpy()).astype(np.float64)
                    sims = sims + matrix @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                sims = np.round(sims / len(vectors), 9)
                doc = b["doc_id"].to_numpy()
                r, c = np.nonzero(keep(sims))
                yield pd.DataFrame({"query_id": ids[r], "doc_id": doc[c], "sim": sims[r, c]})

        return fits.select("doc_id", *vectors).mapInPandas(run, "query_id bigint, doc_id bigint, sim double")

    for r in order.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            part = score(block)
            found, block = part if found is None else found.unionAll(part), []
    if block:
        part = score(block)
        found = part if found is None else found.unionAll(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, sim double")
    return found


def _usable(vec: Column, dim: int | None) -> Column:
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    fits = F.size(vec) == dim if dim else F.size(vec) > 0
    return F.coalesce(fits & fine & F.exists(vec, lambda x: x != 0), F.lit(False))


def rerank(candidates: DataFrame, docs: DataFrame, queries: DataFrame, vectors: tuple[str, ...]) -> DataFrame:
    """Adds `sim`, the mean cosine, to candidate (query_id, doc_id) pairs; candidates without usable vectors drop out."""
    dim = F.size("q")
    pairs = candidates.join(queries.select("query_id", F.col("vec").alias("q")), "query_id").join(docs.select("doc_id", *vectors), "doc_id")
    for v in vectors:
        pairs = pairs.where(_usable(F.col(v), None) & (F.size(v) == dim))
    total = sum((T.cosine(F.col("q"), F.col(v)) for v in vectors), F.lit(0.0))
    return pairs.withColumn("sim", F.round(total / len(vectors), 9)).drop("q", *vectors)


def composed_retrieve(docs: DataFrame, queries: DataFrame, candidates: int = 100, vectors: tuple[str, ...] = ("vec", "name_vec")) -> DataFrame:
    """(query_id, doc_id, sim): the entity a query means: of the lexically best `candidates` (documents without a shared
    term fill up), the one with the largest mean cosine. Queries without terms give nothing."""
    worded = queries.where(F.size(T.bm25_tokens(F.col("text"))) > 0)
    pool = with_zero_fill(bm25_scores(docs, worded), docs, worded, candidates)
    return top_k(rerank(pool.select("query_id", "doc_id"), docs, worded, vectors), ["query_id"], [F.desc("sim"), F.col("doc_id")], 1).drop("rank")


def hybrid_retrieve(docs: DataFrame, queries: DataFrame, candidates: int = 100, keep: int = 10, vectors: tuple[str, ...] = ("vec",)) -> DataFrame:
    """(query_id, doc_id, sim, rank): the lexically best candidates of a query, ordered by cosine, the first `keep`."""
    worded = queries.where(F.size(T.bm25_tokens(F.col("text"))) > 0)
    pool = top_k(bm25_scores(docs, worded).withColumn("score", F.round("score", 9)), ["query_id"], [F.desc("score"), F.col("doc_id")], candidates)
    return top_k(rerank(pool.select("query_id", "doc_id"), docs, worded, vectors), ["query_id"], [F.desc("sim"), F.col("doc_id")], keep)


def anchors_above(similar: DataFrame, k: int, floor: float) -> DataFrame:
    """The first k of each query with sim at least the floor; if none reaches it, the first."""
    return similar.where(((F.col("rank") <= k) & (F.col("sim") >= floor)) | (F.col("rank") == 1))


# --- rules of choice over ranked lists ---------------------------------------------------------------------------


def adjacent_gap(rows: DataFrame, by: list[str], sim: str, tie: str, kmin: int, kmax: int, gap: float) -> DataFrame:
    """Keeps kmin rows a group, then goes on to kmax until the similarity drops by more than `gap` from one row to the
    next. Adds `rn`."""
    w = Window.partitionBy(*by).orderBy(F.desc(sim), tie)
    ranked = rows.withColumn("rn", F.row_number().over(w)).withColumn("__drop", F.lag(sim).over(w) - F.col(sim)).where(F.col("rn") <= kmax)
    broken = F.max(((F.col("rn") > kmin) & (F.round("__drop", 9) > gap)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ranked.withColumn("__broken", broken).where((F.col("rn") <= kmin) | (F.col("__broken") == 0)).drop("__drop", "__broken")


def top1_gap(rows: DataFrame, by: list[str], sim: str, tie: str, kmin: int, kmax: int, gap: float, floor: float | None = None) -> DataFrame:
    """Keeps kmin rows a group, then goes on to kmax while the similarity is within `gap` of the best. Rows below `floor`
    are left out first. Adds `rn`."""
    rows = rows if floor is None else rows.where(F.col(sim) >= floor)
    w = Window.partitionBy(*by).orderBy(F.desc(sim), tie)
    ranked = rows.withColumn("rn", F.row_number().over(w)).withColumn("__best", F.first(sim).over(w)).where(F.col("rn") <= kmax)
    return ranked.where((F.col("rn") <= kmin) | (F.round(F.col("__best") - F.col(sim), 9) <= gap)).drop("__best")


def assign_winners(scores: DataFrame, item: list[str], contestant: str, slack: float) -> DataFrame:
    """Each item goes to the contestant with the best score among those that reach their own threshold, which lies
    `slack` below their best; ties to the smallest contestant."""
    best = scores.groupBy(contestant).agg(F.max("score").alias("__best"))
    eligible = scores.join(best, contestant).where(F.round(F.col("score") - F.col("__best"), 9) >= -slack).drop("__best")
    return top_k(eligible, item, [F.desc("score"), F.col(contestant)], 1).drop("rank")


def tied_winners(scores: DataFrame, item: list[str], slack: float, floor: float) -> DataFrame:
    """All contestants of an item that reach the floor and are within `slack` of the item's best."""
    best = F.max("score").over(Window.partitionBy(*item))
    return scores.where(F.col("score") >= floor).withColumn("__best", best).where(F.round(F.col("__best") - F.col("score"), 9) <= slack).drop("__best")


def best_per_chain(paths: DataFrame, k: int) -> DataFrame:
    """(query_id, path_id, chain, score) to the k that are shown: the best path of each chain is reserved first, by
    score, the rest fills up by score; `place` numbers what is kept by score."""
    order = [F.desc("score"), F.col("path_id")]
    own = F.row_number().over(Window.partitionBy("query_id", "chain").orderBy(*order))
    ranked = paths.withColumn("__own", own)
    kept = top_k(ranked, ["query_id"], [F.asc((F.col("__own") != 1).cast("int")), *order], k)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("__own", "rank")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a digest of seed and key: the same on every run and engine."""
    return rows.withColumn("digest", F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")))).orderBy("digest", key).limit(n)


def similar_pairs(docs: DataFrame, least: float, vectors: tuple[str, ...] = ("vec", "name_vec"), block: int = 2_048) -> DataFrame:
    """(a, b, similarity), a < b, of all pairs whose mean cosine is at least `least`; exact, rounded to four places.

    Rows are hashed into blocks, and every two blocks meet in a task as two matrices; nothing but links leaves it, and
    nothing goes through the driver. The work is quadratic, as is a row's number of copies in the number of blocks: for
    millions of vectors an approximate search is the better choice. Vectors of different length are not compared.
    """
    usable = docs
    for v in vectors:
        usable = usable.where(_usable(F.col(v), None))
    usable = usable.select("doc_id", *vectors).dropDuplicates(["doc_id"])
    blocks = max(-(-usable.count() // block), 1)
    own = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")
    spread = usable.select("doc_id", *vectors, F.concat_ws(",", *(F.size(v).cast("string") for v in vectors)).alias("dims"), own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    spread = spread.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")

    def meet(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        def side(rows: pd.DataFrame) -> tuple[np.ndarray, list[np.ndarray]]:
            units = [np.stack(rows[v].to_numpy()).astype(np.float64) for v in vectors]
            return rows["doc_id"].to_numpy(), [x / np.linalg.norm(x, axis=1, keepdims=True) for x in units]

        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64), "similarity": np.empty(0)})
        one, two = g[g["own"] == key[1]], g[g["own"] == key[2]]
        if not len(one) or not len(two):
            return none
        (ids, xs), (others, ys) = side(one), side(two)
        sims = np.round(sum(x @ y.T for x, y in zip(xs, ys)) / len(vectors), 9)
        r, c = np.nonzero(sims >= least)
        a, b, s = ids[r], others[c], np.round(sims[r, c], 4)
        if key[1] == key[2]:
            a, b, s = a[a < b], b[a < b], s[a < b]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "similarity": s})

    return spread.groupBy("dims", "i", "j").applyInPandas(meet, "a bigint, b bigint, similarity double")
