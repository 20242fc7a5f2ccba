"""Connected components by randomised contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.shared import materialise, release


def components(edges: DataFrame, most_rounds: int = 80) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every end of ``edges`` (a, b).

    In each round a node joins the one of itself and its neighbours that comes first in a random order, and edges are
    drawn between the joined nodes instead; edges that fall together leave. A node that v joins stays connected with v's
    own choice, as their edge is redrawn too. A round removes a constant share of the nodes on average, whatever the
    shape, so their number falls as a power. Rounds are written to the shared folder. Nodes of very many edges are met
    by partial minima and by joins that Spark can split.
    """
    edges = materialise(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    for r in range(most_rounds):
        if edges.isEmpty():
            break
        both = edges.union(edges.select("b", "a")).toDF("node", "next")
        order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(r)), F.col(c).alias("to"))
        first = both.groupBy("node").agg(F.min(order("next")).alias("next"))
        to = materialise(first.select("node", F.least(order("node"), "next")["to"].alias("to")), "joined")
        before = labels, edges, to
        labels = materialise(labels.join(to.toDF("label", "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        redrawn = edges.join(to.toDF("a", "a2"), "a").join(to.toDF("b", "b2"), "b")
        edges = materialise(redrawn.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).where("a <> b").distinct(), "edges")
        release(*before)
    else:
        raise RuntimeError("components did not settle")
    smallest = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(smallest, "label").select("node", "component")
