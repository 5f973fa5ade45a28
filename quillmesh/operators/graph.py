"""The hypergraph as tables: neighbours, components, levels, PageRank.

A vertex is a relation or an entity; incidence(rel_id, ent_id, is_title_edge) is a bag of edges, synonym(a, b,
similarity) links entities in both directions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.operators.skew import hot_keys, salted_join, spread_join
from quillmesh.session import cut


def relations_of(incidence: DataFrame, entities: DataFrame, hubs: list | tuple = ()) -> DataFrame:
    """Distinct relations of the given entities: the other columns of `entities` with rel_id. The incidence of `hubs`
    (see skew.hot_keys) is spread over several tasks."""
    return spread_join(incidence.select("ent_id", "rel_id"), entities, "ent_id", list(hubs)).drop("ent_id").distinct()


def entities_of(incidence: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct entities of the given relations."""
    return relations.join(incidence.select("rel_id", "ent_id"), "rel_id").drop("rel_id").distinct()


def symmetric(synonym: DataFrame) -> DataFrame:
    """(ent_id, other, similarity) in both directions, each neighbour once with its largest similarity."""
    both = synonym.select(F.col("a").alias("ent_id"), F.col("b").alias("other"), "similarity").unionAll(synonym.select(F.col("b").alias("ent_id"), F.col("a").alias("other"), "similarity"))
    return both.where("ent_id <> other").groupBy("ent_id", "other").agg(F.max("similarity").alias("similarity"))


def synonyms_of(synonym: DataFrame, entities: DataFrame) -> DataFrame:
    """Neighbours of the given entities: the other columns of `entities` with the neighbour as ent_id."""
    return entities.join(symmetric(synonym).select("ent_id", "other"), "ent_id").drop("ent_id").withColumnRenamed("other", "ent_id").distinct()


def named_synonyms(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(a, b, similarity) between entity ids, from pairs whose sides are names; sides that name nothing drop out."""
    clean = lambda c: F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), r"^ent::", ""))
    names = entities.select(clean(F.col("canonical")).alias("k"), "ent_id").distinct()
    rows = pairs.dropDuplicates(["pair_id"]).select(clean(F.col("a")).alias("k"), clean(F.col("b")).alias("kb"), "similarity")
    first = salted_join(rows, names, ["k"]).select(F.col("ent_id").alias("a"), F.col("kb").alias("k"), "similarity")
    return salted_join(first, names, ["k"]).select("a", F.col("ent_id").alias("b"), "similarity")


def components(edges: DataFrame, group: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """(group.., node, component) by spreading the smallest node, a neighbour and a pointer jump at a time.

    Meant for many small graphs side by side (the sub-questions of one question each): the number of rounds follows the
    widest of them. Nodes are what stands in a or b; a node with an edge to itself only is its own component.
    """
    both = cut(edges.select(*group, F.col(a).alias("node"), F.col(b).alias("to")).unionAll(edges.select(*group, F.col(b).alias("node"), F.col(a).alias("to"))).distinct())
    label = cut(both.groupBy(*group, "node").agg(F.least(F.col("node"), F.min("to")).alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("node", "to"), [*group, "to"]).groupBy(*group, "node").agg(F.min("component").alias("near"))
        jump = label.select(*group, F.col("node").alias("component"), F.col("component").alias("jump"))
        step = label.join(near, [*group, "node"]).join(jump, [*group, "component"], "left")
        new = cut(step.select(*group, "node", F.least("component", "near", F.coalesce("jump", "component")).alias("component"), "component").toDF(*group, "node", "component", "old"))
        label = new.drop("old")
        if new.where("component <> old").isEmpty():
            return label


def levels(edges: DataFrame, group: list[str], starts: DataFrame, most: int = 64) -> DataFrame:
    """(group.., node, level): steps from the nearest start, over undirected edges; nodes out of reach are left out."""
    both = cut(edges.select(*group, F.col("a").alias("node"), F.col("b").alias("to")).unionAll(edges.select(*group, F.col("b").alias("node"), F.col("a").alias("to"))).distinct())
    seen = cut(starts.select(*group, "node").distinct().withColumn("level", F.lit(0)))
    front = seen
    for level in range(1, most + 1):
        front = front.join(both, [*group, "node"]).select(*group, F.col("to").alias("node")).distinct().join(seen, [*group, "node"], "left_anti")
        front = cut(front.withColumn("level", F.lit(level)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
    return seen


def weighted_edges(incidence: DataFrame, synonym: DataFrame) -> DataFrame:
    """(u, v, w) with u < v: parallel edges summed, a hyperedge weighs 1, a synonym its similarity.

    Entities keep their number; relation r is vertex -1 - r.
    """
    hyper = incidence.select((-1 - F.col("rel_id")).alias("u"), F.col("ent_id").alias("v"), F.lit(1.0).alias("w"))
    syn = synonym.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), F.col("similarity").alias("w"))
    return hyper.unionAll(syn).groupBy("u", "v").agg(F.sum("w").alias("w"))


def _shares(edges: DataFrame) -> tuple[DataFrame, DataFrame, list]:
    """(shares, linked, hot): (u, v, share) of what u gives to v, both ways; (vertex) with edges; vertices with many."""
    both = cut(edges.select("u", "v", "w").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "w")))
    out = both.groupBy("u").agg(F.sum("w").alias("total"))
    hot = hot_keys(both, "u")
    shares = cut(spread_join(both, out, "u", hot).select("u", "v", (F.col("w") / F.col("total")).alias("share")))
    return shares, out.select(F.col("u").alias("vertex")), hot


def pagerank(edges: DataFrame, anchors: DataFrame, alpha: float = 0.5, rounds: int = 200, tolerance: float = 1e-6, check: bool = True) -> DataFrame:
    """(vertex, score): personalised PageRank by power iteration over undirected weighted edges.

    anchors(vertex, weight) are made to sum to 1. Starts at 1/N; stops when the sum of changes is below N * tolerance
    (check=False: after exactly `rounds`). Vertices are all ends of edges and the anchors; a vertex without edges gives
    its score back to the anchors. Shares are summed on the map side, so a hub that a third of all edges reach is no
    single task's work; the join on the sending side spreads hubs. Without convergence the result is empty.
    """
    shares, linked, hot = _shares(edges)
    sums = anchors.groupBy("vertex").agg(F.sum("weight").alias("weight"))
    total = sums.agg(F.sum("weight")).first()[0]
    nodes = linked.withColumn("linked", F.lit(True)).join(sums, "vertex", "full").select("vertex", F.coalesce("linked", F.lit(False)).alias("linked"), (F.coalesce("weight", F.lit(0.0)) / F.lit(total or 1.0)).alias("p"))
    nodes = cut(nodes)
    n = nodes.count()
    if not n or not total:
        return nodes.limit(0).select("vertex", F.lit(0.0).alias("score"))
    x = nodes.select("vertex", "linked", "p", F.lit(1.0 / n).alias("score"))
    lost = x.where(~F.col("linked")).count() / n
    for _ in range(rounds):
        sent = spread_join(shares, x.select(F.col("vertex").alias("u"), "score"), "u", hot).groupBy(F.col("v").alias("vertex")).agg(F.sum(F.col("score") * F.col("share")).alias("got"))
        moved = x.join(sent, "vertex", "left").select("vertex", "linked", "p", (alpha * F.coalesce("got", F.lit(0.0)) + (alpha * lost + 1 - alpha) * F.col("p")).alias("score"), F.col("score").alias("old"))
        x = cut(moved)
        change, lost = x.agg(F.sum(F.abs(F.col("score") - F.col("old"))), F.coalesce(F.sum(F.when(~F.col("linked"), F.col("score"))), F.lit(0.0))).first()
        if check and change < n * tolerance:
            return x.select("vertex", "score")
        x = x.drop("old")
    return x.select("vertex", "score") if not check else x.limit(0).select("vertex", "score")


def pagerank_top(edges: DataFrame, anchors: DataFrame, k: int, alpha: float = 0.5, rounds: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """(question_id, vertex, score, rank): the k relations (vertices below 0) with the highest personalised PageRank of every
    question, for anchors(question_id, vertex, weight); all questions in one iteration.

    What a question gets at step t is the sum of a part that all have in common (the even start, passed on t times) and
    of what its own anchors have sent out; the second part only is kept by question, as far as it has come. Steps, start
    and stop (changes below N * tolerance) are those of `pagerank`, for each question by itself; one that has not
    stopped after `rounds` gets nothing. Anchors without a positive weight count for nothing.
    """
    spark = edges.sparkSession
    shares, linked, hot = _shares(edges)
    sums = anchors.where("weight > 0").groupBy("question_id", "vertex").agg(F.sum("weight").alias("w"))
    whole = sums.groupBy("question_id").agg(F.sum("w").alias("total"))
    linked = cut(linked.withColumn("linked", F.lit(True)))
    p = sums.join(whole, "question_id").join(linked, "vertex", "left").select("question_id", "vertex", (F.col("w") / F.col("total")).alias("p"), F.coalesce("linked", F.lit(False)).alias("linked"))
    p = cut(p)
    alone = p.where(~F.col("linked")).select("vertex").distinct()
    nodes = cut(linked.select("vertex").unionAll(alone))
    n = nodes.count()
    done = spark.createDataFrame([], "question_id bigint, vertex bigint, score double, rank int")
    if not n:
        return done
    common = nodes.withColumn("score", F.lit(1.0 / n))
    own = spark.createDataFrame([], "question_id bigint, vertex bigint, y double")
    idle = alone.count() / n

    def pass_on(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
        sent = spread_join(shares, rows.withColumnRenamed("vertex", "u"), "u", hot)
        return sent.groupBy(*by, F.col("v").alias("vertex")).agg((alpha * F.sum(F.col(value) * F.col("share"))).alias(value))

    for _ in range(rounds):
        if p.isEmpty():
            break
        after = cut(common.withColumnRenamed("score", "old").join(pass_on(common, "score", []), "vertex", "left").select("vertex", "old", F.coalesce("score", F.lit(0.0)).alias("score")))
        base = after.agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0]
        kept = own.join(p.where(~F.col("linked")).select("question_id", "vertex"), ["question_id", "vertex"]).groupBy("question_id").agg(F.sum("y").alias("lost"))
        fed = p.join(kept, "question_id", "left").select("question_id", "vertex", ((1 - alpha + alpha * (F.coalesce("lost", F.lit(0.0)) + idle)) * F.col("p")).alias("y"))
        new = cut(pass_on(own, "y", ["question_id"]).unionByName(fed).groupBy("question_id", "vertex").agg(F.sum("y").alias("y")))
        moved = new.join(own.withColumnRenamed("y", "was"), ["question_id", "vertex"], "full").join(after, "vertex", "left")
        shift = F.col("score") - F.col("old")
        change = moved.groupBy("question_id").agg(F.sum(F.abs(shift + F.coalesce("y", F.lit(0.0)) - F.coalesce("was", F.lit(0.0))) - F.abs(shift)).alias("c"))
        over = cut(change.where(F.col("c") + base < n * tolerance).select("question_id"))
        common, idle = after.select("vertex", "score"), 0.0
        if not over.isEmpty():
            # of relations that a question has not reached, the k best in common are enough
            best = [r[0] for r in common.where("vertex < 0").orderBy(F.desc("score"), F.desc("vertex")).limit(k).collect()]
            rest = over.select("question_id", F.explode(F.lit(best).cast("array<bigint>")).alias("vertex")).withColumn("y", F.lit(0.0))
            mine = new.join(over, "question_id").where("vertex < 0").unionByName(rest).groupBy("question_id", "vertex").agg(F.sum("y").alias("y"))
            scored = mine.join(common, "vertex").select("question_id", "vertex", F.round(F.col("score") + F.col("y"), 12).alias("score"))
            w = Window.partitionBy("question_id").orderBy(F.desc("score"), F.desc("vertex"))
            done = cut(done.unionByName(scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)))
            p = cut(p.join(over, "question_id", "left_anti"))
            new = new.join(over, "question_id", "left_anti")
        own = cut(new)
    return done
