"""Connected components of a graph of links, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import written


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every end of the links (a, b); component is the least id that can be reached.

    Each round points every node at its least neighbour (or itself), follows the pointers to their
    ends, and contracts the links to these. Nodes that stay are smaller than all their neighbours, so
    at most half of the nodes that still have links remain: the rounds grow with the logarithm of
    the links. Hot nodes are pre-aggregated before the shuffle. Self links and repeats do no harm.
    Each step is a table of known size, and none is sent to the driver to be broadcast.
    """
    links = written(links.select("a", "b").filter("a <> b").distinct(), "links")
    labels = written(links.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), "labels")
    while not links.isEmpty():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("id"), F.least("a", "least").alias("up")), "pointers")
        while True:  # follow pointers, twice as far each time
            far = up.select(F.col("id").alias("up"), F.col("up").alias("far"))
            longer = written(up.join(far.hint("merge"), "up").selectExpr("id", "far as up", "far <> up as moved"), "pointers")
            up = longer.select("id", "up")
            if longer.filter("moved").isEmpty():
                break
        labels = written(labels.join(up.select(F.col("id").alias("component"), "up").hint("merge"), "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")
        a, b = up.select(F.col("id").alias("a"), F.col("up").alias("up_a")), up.select(F.col("id").alias("b"), F.col("up").alias("up_b"))
        links = written(links.join(a.hint("merge"), "a").join(b.hint("merge"), "b").select(F.col("up_a").alias("a"), F.col("up_b").alias("b")).filter("a <> b").distinct(), "links")
    return labels
