"""Connected components of a table of links, by contraction."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appconv.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """links (a, b) of longs -> node, component: the smallest node that can be reached. Every node takes the smallest of itself
    and its neighbours as parent, and then the parent's parent; links between different parents remain. Each round is
    written, so none is computed twice; the links that remain get fewer by a factor each time."""
    links = staged(links.select("a", "b").filter("a <> b").distinct())
    found = None
    while not links.isEmpty():
        both = links.select("a", "b").unionByName(links.selectExpr("b as a", "a as b"))
        parents = staged(both.groupBy("a").agg(F.least("a", F.min("b")).alias("p")))
        upper = parents.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        jump = staged(parents.join(upper, "p").select("a", F.col("pp").alias("to")))
        left = links.join(jump, "a").select(F.col("to").alias("x"), "b")
        rest = left.join(jump.withColumnRenamed("a", "b"), "b").select(F.col("x").alias("a"), F.col("to").alias("b"))
        links = staged(rest.filter("a <> b").distinct())
        if found is None:
            found = jump.select(F.col("a").alias("node"), F.col("to").alias("component"))
        else:
            to = F.coalesce("to", "component").alias("component")
            found = found.join(jump.withColumnRenamed("a", "component"), "component", "left").select("node", to)
        found = staged(found)
    return found if found is not None else links.selectExpr("a as node", "b as component")
