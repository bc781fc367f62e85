"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultlore.llm.common import written


def components(edges: DataFrame, store: Callable[[DataFrame, str], DataFrame] = written) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b); the component is its smallest node.

    Each round takes the smallest label of a node's neighbours and then the
    label of that label, so paths shorten by half.  Rounds are written to the
    shared folder; only a count of changes comes to the driver.  Self links are
    allowed, null ends are ignored, an empty table gives an empty result.  ``store``
    stores the tables of the rounds.
    """
    both = edges.select("a", "b").dropna()
    both = store(both.union(both.select("b", "a")).distinct(), "edges")
    labels = store(both.groupBy(F.col("a").alias("node"))
                     .agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("near")))
        step = (labels.join(near, "node")
                .select("node", F.col("component").alias("old"), F.least("component", "near").alias("to")))
        of = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        step = store(step.join(of, "to", "left")
                       .select("node", "old", F.least("to", F.coalesce("far", "to")).alias("component")), "labels")
        labels = step.select("node", "component")
        if step.filter("component <> old").isEmpty():
            return labels
