"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpimill.llm.common import Staged, hot_keys, join_hot


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` reaches.

    Labels spread as minima over neighbours, then each label takes its own label (pointer jumping), so that the rounds
    grow with the logarithm of the longest path.  Every round is a partial aggregation and joins on table columns;
    nothing but whether a label changed reaches the driver.  Nodes with many neighbours and labels of many nodes are
    hot keys of these joins, and stay where they are.  Edges with a null end are ignored; an empty table gives an empty
    table.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    links = Staged(e.union(e.select("v", "u")).distinct(), "links")
    labels = Staged(links.df().groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    many = hot_keys(links.df(), "v")
    while True:
        old = labels.df()
        up = old.withColumnRenamed("node", "v")
        near = (links.df().join(up, "v") if many is None else join_hot(links.df(), up, "v", hot=many)).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        step = Staged(old.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "m").alias("m")), "step")
        jump = old.select(F.col("node").alias("m"), F.col("component").alias("up"))
        new = Staged(join_hot(step.df(), jump, "m").select("node", "was", F.least("m", "up").alias("component")), "labels")
        changed = not new.df().where("component <> was").isEmpty()
        for x in (labels, step):
            x.drop()
        labels = new
        if not changed:
            links.drop()
            return labels.df().select("node", "component")
