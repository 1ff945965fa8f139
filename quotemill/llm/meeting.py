"""Components of rows that meet on keys, found without listing the pairs of a key.

Every member of a key is compared with the key's least member, which is linear in
the number of members: first each node with the least of all its keys, then, where
that has not put both in one component, with the least of each single key. What is
then still in another component than its key's least member is compared with the
other members of the key that are in other components. So every link that could join two components is
tried, and the pairs of a group of copies are not.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.llm.components import connected_components
from quotemill.llm.scratch import discard, materialize

Verify = Callable[[DataFrame], DataFrame]
Near = Callable[[str, str], Column]


def meetings(marks: DataFrame, label: str) -> DataFrame:
    """(key, node, least) of every key that two nodes or more have. ``marks``: key, node, no row twice."""
    on = Window.partitionBy("key")
    found = marks.select("key", "node").withColumn("least", F.min("node").over(on)).withColumn("most", F.max("node").over(on))
    return materialize(found.where("least < most").select("key", "node", "least"), label)


def components_of(met: DataFrame, verify: Verify, label: str, nodes: DataFrame | None = None, passes: Sequence[Near] = ()) -> DataFrame:
    """(node, component) of every node with a link; ``verify`` keeps the linked ones of pairs (a, b).

    ``nodes`` and ``passes``: columns of each node (node, sig) and conditions on two sigs,
    of which linked nodes meet one; they spare joins the rows of other pairs, and what an
    earlier one has put together is not compared by a later.
    """
    first = met.where("node <> least").groupBy("node").agg(F.min("least").alias("first"))
    first = materialize(first, f"{label}-first")
    links = materialize(verify(first.select(F.col("node").alias("a"), F.col("first").alias("b"))), f"{label}-links")
    classes = connected_components(links)

    def placed() -> DataFrame:
        own = met.join(classes.select("node", F.col("component").alias("c")), "node", "left")
        both = own.join(classes.select(F.col("node").alias("least"), F.col("component").alias("hc")), "least", "left")
        return both.select("key", "node", "least", F.coalesce("c", "node").alias("c"), F.coalesce("hc", "least").alias("hc"))

    others = placed().where("c <> hc").join(first, "node").where("least <> first").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    more = materialize(verify(others), f"{label}-links")
    if not more.isEmpty():
        links = materialize(links.unionAll(more), f"{label}-links")
        classes = connected_components(links)
    for near in passes or (None,):
        apart = placed().where("c <> hc").select("key", F.col("node").alias("m"), F.col("c").alias("mc"))
        apart = materialize(apart, f"{label}-apart")
        if not apart.isEmpty():
            member = placed().where("node <> least").select("key", "node", "c").join(apart.select("key").distinct(), "key", "left_semi")
            other, far = apart, F.col("c") != F.col("mc")
            if near is not None:
                member = member.join(nodes.select("node", F.col("sig").alias("sa")), "node")
                other = apart.join(nodes.select(F.col("node").alias("m"), F.col("sig").alias("sb")), "m")
                far = far & near("sa", "sb")
            joined = member.join(other, (member["key"] == other["key"]) & far)
            rest = joined.select(F.greatest("node", "m").alias("a"), F.least("node", "m").alias("b")).distinct()
            last = materialize(verify(rest), f"{label}-links")
            if not last.isEmpty():
                links = materialize(links.unionAll(last), f"{label}-links")
                classes = connected_components(links)
        discard(apart)
    discard(first)
    return classes
