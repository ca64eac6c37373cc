"""Connected components of a link table, by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ffspark.llm.shared import discard, lookup, materialise


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, comp (the smallest node reachable) for all nodes in ``links`` (a, b).

    Each round takes the smallest label among a node and its neighbours (partial aggregation, so a node of any degree
    is no hot spot), then the label of that label; a chain of length n ends after about log n rounds. Looking up the
    label of a node with very many neighbours, or of very many nodes with one label, is spread over parts. Only whether
    labels changed comes to the driver. Raises RuntimeError if ``max_rounds`` don't suffice.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp")), "labels")
    both = materialise(both, "links")
    for _ in range(max_rounds):
        heard = lookup(both, "b", labels.withColumnRenamed("node", "b")).groupBy("a").agg(F.min("comp").alias("low"))
        lower = materialise(labels.join(heard, labels["node"] == heard["a"]).select("node", "comp", F.least("comp", "low").alias("new")), "lower")
        jump = lower.select(F.col("new").alias("far"), F.col("node").alias("new"))
        nxt = materialise(lookup(lower, "new", jump, "left").select("node", "comp", F.least("new", F.coalesce("far", "new")).alias("new")), "labels")
        discard(labels, lower)
        labels = nxt.select("node", F.col("new").alias("comp"))
        if nxt.where("new <> comp").isEmpty():
            discard(both)
            return labels
    raise RuntimeError(f"labels still change after {max_rounds} rounds")
