"""Connected components of a distributed graph by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """Pairs (a, b) of longs -> (node, root): root is the least node of the class.

    Each round hangs every node on its least smaller neighbour, shortens the
    chains by doubling, and contracts the graph to the roots; nodes at least
    halve.  All tables are written to the shared folder, nothing is collected.
    Minima are aggregated in each task first and joins are plain equi-joins,
    so a node with many neighbours costs no single task.
    """
    graph = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph")
    result = None
    while not graph.isEmpty():
        up = written(graph.groupBy("a").agg(F.min("b").alias("up")), "up")
        while True:
            over = up.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
            longer = up.join(over, up["up"] == over["_a"], "left")
            if longer.where("_up is not null").isEmpty():
                break
            up = written(longer.select("a", F.coalesce("_up", "up").alias("up")), "up")
        if result is None:
            result = up.select(F.col("a").alias("node"), F.col("up").alias("root"))
        else:
            over = up.select(F.col("a").alias("_a"), F.col("up").alias("_up"))
            moved = result.join(over, result["root"] == over["_a"], "left").select("node", F.coalesce("_up", "root").alias("root"))
            # roots that hang on others only now are nodes of their own
            result = written(moved.union(up.select(F.col("a").alias("node"), F.col("up").alias("root"))).distinct(), "classes")
        ends = []
        for end in ("a", "b"):
            over = up.select(F.col("a").alias(f"_{end}"), F.col("up").alias(f"up_{end}"))
            ends.append(over)
        moved = graph.join(ends[0], graph["a"] == ends[0]["_a"], "left").join(ends[1], graph["b"] == ends[1]["_b"], "left")
        moved = moved.select(F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b")).where("a <> b")
        graph = written(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "graph")
    if result is None:
        return graph.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return result
