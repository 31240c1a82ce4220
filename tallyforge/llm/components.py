"""Connected components by repeated contraction, with durable tables between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable


def connected_components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (smallest node reachable) for every node of links (a, b).

    Each round sends every node to its smallest neighbour, follows that pointer once more, and
    contracts the links; a round at least halves the nodes that still have links, so the number of
    rounds is logarithmic.  The driver sees one count a round.  Self links, repeated links and null
    ends are allowed; nodes whose links all are null-ended are not returned.
    """
    known = links.filter("a is not null and b is not null")
    edges = durable(known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "components-edges")
    named = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node"))
    edges = edges.filter("a != b")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("p"))
        up = durable(up, "components-up")
        next_up = up.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        up = durable(up.join(next_up, "p").select("v", F.col("pp").alias("p")), "components-up")
        named = named.join(up, named["component"] == up["v"], "left").select("node", F.coalesce("p", "component").alias("component"))
        named = durable(named, "components-named")
        ends = edges.join(up.select(F.col("v").alias("a"), F.col("p").alias("pa")), "a").join(up.select(F.col("v").alias("b"), F.col("p").alias("pb")), "b")
        ends = ends.filter("pa != pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = durable(ends, "components-edges")
    return named
