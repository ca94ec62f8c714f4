"""Connected components of a graph given as edges between long numbers, by large-star and small-star rounds.

Each round replaces the edges of a node by edges to its smallest neighbour, so that every component becomes a star
around its smallest node after a number of rounds that grows with the logarithm of its longest path. A round is two
aggregations and two joins over edges; nothing is gathered per node, the minimum combines before the shuffle, and nodes
that hold a large share of the edges are joined through ``join_counted``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetrail.llm.rows import join_counted
from casetrail.session import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half of a round. ``edges``: ``u``, ``v`` with ``u > v``."""
    if large:
        edges = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stash(edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    met = join_counted(edges, least, "u", how="inner")
    if large:
        new = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        new = (met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
               .union(least.select("u", F.col("m").alias("v"))))
    return stash(new.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")),
                           F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_003)))).first())


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """``node``, ``component`` (the smallest node that can be reached) for every node of ``edges`` (``u``, ``v``: long).

    Loops, repeated edges and edges in both directions are allowed; edges with a null end are left out. Nodes that only
    have a loop are their own component. No edges: no rows.
    """
    named = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u is not null and v is not null")
    named = stash(named.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    now = named.where("u <> v")
    sign = _sign(now)
    for _ in range(most_rounds if sign[0] else 0):
        now = _star(_star(now, large=True), large=False)
        before, sign = sign, _sign(now)
        if sign == before:
            break
    else:
        if sign[0]:
            raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    # a star's centre, and nodes with a loop only, are their own component
    ends = named.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    alone = ends.join(members.select("node"), "node", "left_anti").withColumn("component", F.col("node"))
    return members.unionByName(alone)
