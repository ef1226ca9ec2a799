"""Connected components of an edge table, to a fixed point, in O(log n) rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunedata.operators.keyfilter import written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``node, component`` (the smallest node of the component) for every node of an edge.

    Each node points to a node of its component, at first to its smallest neighbour. A round

    * finds for each node the smallest pointer among its neighbours,
    * gives that to the node and to the node it points to (so that whole trees hook onto smaller
      ones, not node by node), and
    * lets each pointer jump to its target's pointer, which halves the depth of the trees.

    Pointers only ever fall. The loop ends when a round changes none: every edge then joins nodes of
    one pointer. Messages are reduced by grouped minima with map-side combine; the two joins on
    pointers read written tables, so that adaptive execution can split a pointer shared by many.
    Only the number of changed pointers reaches the driver. Null ends and loops are ignored."""
    pairs = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null and a <> b")
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "components")
    at = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("to")), "components")
    while True:
        heard = (both.join(at, F.col("b") == F.col("node")).groupBy("a").agg(F.min("to").alias("low")))
        # What a node heard goes to itself and to the node it points to.
        told = heard.join(at, F.col("a") == F.col("node")).select("node", "to", F.least("low", "to").alias("low"))
        best = (told.select(F.explode(F.array(F.struct("node", "low"), F.struct(F.col("to").alias("node"), "low"))).alias("m"))
                .groupBy("m.node").agg(F.min("m.low").alias("low")))
        hooked = written(at.join(best, "node").select("node", F.least("to", "low").alias("to"), F.col("to").alias("was")), "components")
        above = hooked.select(F.col("node").alias("mid"), F.col("to").alias("top"))
        after = written(hooked.join(above, F.col("to") == F.col("mid")).select("node", F.least("to", "top").alias("to"), "was"), "components")
        changed = after.filter("to <> was").limit(1).count()
        at = after.select("node", "to")
        if not changed:
            return at.withColumnRenamed("to", "component")
