"""Connected components by repeated contraction, for graphs that no one machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loculus.llm.common import drop_table, write_table


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component for each node of edges (a, b: long); component is one of its nodes.

    In each round each node joins the neighbour, or itself, whose hash of the round is least; joined nodes become one and edges
    within it go. Edges shrink by a share each round whatever the graph's shape, so rounds grow with the logarithm of its size.
    Aggregates are partial before they are shuffled, so a node with very many edges is no hot spot.
    """
    at = write_table(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    result = None
    for round_no in range(1000):
        h = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(round_no)).alias("h"), F.col(c).alias("node"))  # noqa: B023, E731
        ends = at.select(F.col("a").alias("node"), h("b").alias("x")).unionByName(at.select(F.col("b").alias("node"), h("a").alias("x")))
        joined = ends.groupBy("node").agg(F.min("x").alias("x")).select("node", F.least("x", h("node"))["node"].alias("to"))
        joined = write_table(joined, f"{name}-nodes")
        if result is None:
            result = joined.withColumnRenamed("to", "component")
        else:
            step = joined.select(F.col("node").alias("_at"), "to")
            result = result.join(step, result["component"] == step["_at"], "left").select("node", F.coalesce("to", "component").alias("component"))
        a, b = joined.select(F.col("node").alias("a"), F.col("to").alias("_a")), joined.select(F.col("node").alias("b"), F.col("to").alias("_b"))
        less = at.join(a, "a").join(b, "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct()
        less = write_table(less, f"{name}-edges")
        drop_table(at)
        at = less
        if at.isEmpty():
            return write_table(result, name)
    raise RuntimeError("components were not found in 1000 rounds")
