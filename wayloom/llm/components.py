"""Connected components by contraction: each round every node moves to the neighbour of least hash, and the edges with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import side, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, component) for every node of an edge; component is the least node it reaches.

    A node moves to the one of least hash among itself and its neighbours; the hash is another one each round. Of
    the nodes that still have edges, a fixed share is expected to go in each round, whatever the graph's shape (half
    of a path's), so rounds grow with the logarithm of the nodes. Only whether edges are left reaches the driver.
    Repeated edges and loops are allowed; no edges give no rows.
    """
    current = written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    moves: list[DataFrame] = []
    while not moves or not current.isEmpty():
        rank = lambda c, turn=len(moves): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("to"))
        both = current.select(F.col("a").alias("node"), rank("b").alias("x")).union(current.select(F.col("b").alias("node"), rank("a").alias("x")))
        found = both.groupBy("node").agg(F.min("x").alias("x"))
        moves.append(written(found.select("node", F.least("x", rank("node"))["to"].alias("to"))))
        at = lambda c: side(moves[-1]).select(F.col("node").alias(f"n{c}"), F.col("to").alias(f"t{c}"))
        moved = current.join(at("a"), F.col("a") == F.col("na")).join(at("b"), F.col("b") == F.col("nb")).filter("ta <> tb")
        current = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
    labels = moves.pop()
    while moves:
        further = side(labels).select(F.col("node").alias("n"), F.col("to").alias("further"))
        last: Column = F.coalesce("further", "to")
        labels = written(moves.pop().join(further, F.col("to") == F.col("n"), "left").select("node", last.alias("to")))
    least = labels.groupBy("to").agg(F.min("node").alias("component")).withColumnRenamed("to", "of")
    return written(labels.join(side(written(least)), F.col("to") == F.col("of")).select("node", "component"))
