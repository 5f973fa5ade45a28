"""One group identifier for all records that are linked, directly or through others.

Deterministic Borůvka hooking over relabelled edges: each component picks its smallest outgoing edge, the resulting
trees collapse to their root by pointer doubling, the edges are relabelled with the roots and deduplicated, until no
edge is left. Edges are ordered by (smaller end, larger end); then a component's smallest edge leads to its smallest
neighbour, the only cycles are pairs that pick each other, and a tree's root is the smallest id in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.skew import salted_join
from quillmesh.session import cut


def _undirected(edges: DataFrame, a: str, b: str) -> DataFrame:
    return edges.where(f"{a} <> {b}").select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def _collapse(parents: DataFrame) -> DataFrame:
    """(c, root) for a forest of (c, p) whose roots have p = c, by pointer doubling.

    A step doubles twice before it is written, so depth d takes about log2(d) / 2 written steps.
    """
    while True:
        up = parents.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        twice = salted_join(parents, up, ["p"]).select("c", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved"))
        up = twice.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        parents = cut(salted_join(twice, up, ["p"]).select("c", F.col("pp").alias("p"), (F.col("moved") | (F.col("p") != F.col("pp"))).alias("moved")))
        if parents.where("moved").isEmpty():
            return parents.select("c", F.col("p").alias("root"))
        parents = parents.select("c", "p")


def connected_groups(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group) for every node with an edge to another node; group is the smallest node of its group.

    Null ends and edges from a node to itself link nothing; direction and repeats do not matter. Nodes need an order and
    equality only (bigint, string). Each round at least halves the number of components that still have edges, and its
    tables are written to the checkpoint folder, so that lineage stays short. A node that all edges share is one row after
    the map-side minimum, and joins on it are salted.
    """
    left = cut(_undirected(edges.where(f"{a} is not null and {b} is not null"), a, b))
    nodes = left.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        ends = left.select(F.col("u").alias("c"), F.col("v").alias("o")).unionAll(left.select("v", "u"))
        picked = cut(ends.groupBy("c").agg(F.min("o").alias("p")))
        back = picked.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        hooked = salted_join(picked, back, ["p"]).select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        roots = _collapse(hooked)
        rounds.append(roots)
        by_u = salted_join(left.withColumnRenamed("u", "c"), roots, ["c"]).select(F.col("root").alias("ru"), F.col("v").alias("c"))
        both = salted_join(by_u, roots, ["c"]).select("ru", F.col("root").alias("rv"))
        left = cut(_undirected(both, "ru", "rv"))
    if not rounds:
        return nodes.select("node", F.col("node").alias("group"))
    # the maps of the rounds, from the last back to the first; each has at most half as many rows as the one before
    total = rounds.pop()
    while rounds:
        step = rounds.pop()
        later = total.select(F.col("c").alias("root"), F.col("root").alias("to"))
        total = salted_join(step, later, ["root"], how="left").select("c", F.coalesce("to", "root").alias("root"))
    return total.select(F.col("c").alias("node"), F.col("root").alias("group"))


_EDGE_SPACE = r"^[\s\p{Z}\p{Cf}]+|[\s\p{Z}\p{Cf}]+$"


def entity_key(side: Column) -> Column:
    """A side of a pair as a canonical name: outer white space, case and a leading node prefix `ent::` removed."""
    bare = F.regexp_replace(F.lower(side), _EDGE_SPACE, "")
    return F.regexp_replace(F.regexp_replace(bare, r"^ent::", ""), _EDGE_SPACE, "")


def entity_groups(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """(ent_id, group_id) of all entities that a pair links to another entity.

    Sides that name no entity, null and blank sides link nothing. Rows delivered again change nothing.
    """
    links = pairs.select(entity_key(F.col("a")).alias("ka"), entity_key(F.col("b")).alias("kb")).where("ka <> '' and kb <> '' and ka <> kb").distinct()
    names = entities.select(entity_key(F.col("canonical")).alias("k"), "ent_id").where("k <> '' and ent_id is not null").groupBy("k").agg(F.min("ent_id").alias("id"))
    one = salted_join(links.withColumnRenamed("ka", "k"), names, ["k"]).select(F.col("id").alias("ea"), F.col("kb").alias("k"))
    two = salted_join(one, names, ["k"]).select("ea", F.col("id").alias("eb"))
    return connected_groups(two, "ea", "eb").select(F.col("node").alias("ent_id"), F.col("group").alias("group_id"))
