"""Connected components by alternating star contraction, DataFrame operations only.

Each round replaces edges by edges to smaller nodes (large star, then small
star) until every component is a star around its smallest node. All state is a
written edge table; nothing is collected, and a table goes once the next is written.
Minima are pre-aggregated before the shuffle, and joins on a hub are plain
equi-joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.llm.scratch import discard, materialize


def _is_forest_of_stars(edges: DataFrame) -> bool:
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    wrong = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)")
    return wrong.isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; the component is its smallest node.

    ``edges``: columns a, b of one orderable type, in any orientation, repeats and
    self-loops allowed. Empty input gives an empty result.
    """
    a, b = F.col("a"), F.col("b")
    ordered = edges.where(a != b).select(F.when(a > b, a).otherwise(b).alias("a"), F.when(a > b, b).otherwise(a).alias("b"))
    cur = materialize(ordered.distinct(), "cc")
    for _ in range(max_rounds):
        if _is_forest_of_stars(cur):
            found = cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                cur.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
            )
            classes = materialize(found, "cc-classes")
            discard(cur)
            return classes
        lowest = cur.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        large = cur.join(lowest, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low.select(F.col("a").alias("u"), "m"), F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialize(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "cc")
        discard(cur)
        cur = new
    raise RuntimeError("components did not settle")
