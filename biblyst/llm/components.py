"""Connected components by alternating large-star and small-star rewrites.

Edges are kept as (hi, lo) with hi > lo. A large star moves every larger
neighbour of a node to the smallest node the node knows; a small star moves
the smaller neighbours of a node, and the node, to the smallest of them. Both
are a minimum per node (map-side combined) joined back to the edges; hub nodes
are salted by ``salted_lookup``. Rounds end when a round changes no edge; each
star's edges are written to the shared folder, so lineage stays short, and
counted and hashed once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from biblyst.operators.skew import salted_lookup
from biblyst.session import materialize

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("lo", "hi"))).first()
    return tuple(r)


def _large_star(e: DataFrame, total: int) -> DataFrame:
    # n counts the edges in which the node is the smaller end: those are joined back
    near = e.select(F.col("lo").alias("u"), F.col("lo").alias("m"), F.lit(1).alias("_n")).unionByName(e.select(F.col("hi").alias("u"), F.col("lo").alias("m"), F.lit(0).alias("_n")))
    least = near.groupBy("u").agg(F.min("m").alias("m"), F.sum("_n").alias("_n")).where("_n > 0").withColumnRenamed("u", "lo")
    return salted_lookup(e, least, ["lo"], total=total).select("hi", F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame, total: int) -> DataFrame:
    least = e.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("_n"))
    moved = salted_lookup(e, least, ["hi"], total=total).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, a: str, b: str, node: str = "node", group: str = "group") -> DataFrame:
    """(node, group): every node at either end of an edge with the smallest node linked to it.

    Edges are undirected; repeats and both directions change nothing. A loop
    makes its node known, in a group of its own if it has no other edge. Edges
    with a NULL end are ignored. An empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    pairs = materialize(pairs.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct(), "pairs")
    e = pairs.where("hi <> lo")
    before = _state(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        # a large star never adds edges, so the count bounds both stars; each is written, which keeps the plans small
        e = materialize(_small_star(materialize(_large_star(e, before[0]), "edges"), before[0]), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    # settled edges are stars: hi -> minimum of its component
    stars = e.select(F.col("hi").alias(node), F.col("lo").alias(group)).unionByName(e.select(F.col("lo").alias(node), F.col("lo").alias(group)))
    loops = pairs.where("hi = lo").select(F.col("lo").alias(node), F.col("lo").alias(group))
    return stars.unionByName(loops).groupBy(node).agg(F.min(group).alias(group))
