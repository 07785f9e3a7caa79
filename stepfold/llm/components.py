"""Connected components by alternating large-star and small-star steps, each a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfold.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """id, component of every id in `links` (a, b); the component is its smallest id.

    A step needs the least neighbour of each node, which aggregates before it shuffles, and hands it to the node's
    edges by a join of two tables, in which adaptive execution splits the edges of a node that has many. Edges only
    move to smaller ids; the steps end when none does, in about as many rounds as the logarithm of a component's length.
    An empty table has no components; links of a node to itself count as none.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.write(edges, "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = scratch.write(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        scratch.drop(least)
        least = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = scratch.write(small, "edges")
        scratch.drop(edges, least, large)
        edges, before, state = new, state, _state(new)
        if state == before:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
