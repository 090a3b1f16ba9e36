"""Connected components of a link table, by the least label of the neighbours with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskflow.llm.store import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp): the smallest node reachable, for every node that has a link.

    Each round takes the least label of a node and its neighbours, then that label's own label, so chains halve.
    Labels are written to the shared folder each round; the driver sees the number of changes only. The
    aggregate combines map-side, so a node with very many links is no burden."""
    both = materialize(links.select(F.col(a).alias("node"), F.col(b).alias("next")).unionByName(
        links.select(F.col(b).alias("node"), F.col(a).alias("next"))).distinct(), "links")
    labels = materialize(both.groupBy("node").agg(F.min("next").alias("least")).select(
        "node", F.least("node", "least").alias("comp")), "labels")
    while True:
        seen = (both.join(labels.select(F.col("node").alias("next"), F.col("comp").alias("other")), "next")
                .groupBy("node").agg(F.min("other").alias("other")))
        near = labels.join(seen, "node").select("node", "comp", F.least("comp", "other").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("comp").alias("far"))
        after = materialize(near.join(jump, "near").select("node", F.least("near", "far").alias("comp"),
                                                           (F.least("near", "far") != F.col("comp")).alias("moved")), "labels")
        labels = after.select("node", "comp")
        if after.filter("moved").isEmpty():
            return labels
