"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.io import forget, written


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node reachable) for every node of links (a, b), as a table.

    Each round takes the smallest label among a node and its neighbours, then the
    label of that label, so long chains halve; rounds are tables in the shared folder.
    A hub's many links are many rows against one row of the other side, summed up
    before they are shuffled. No links give no rows.
    """
    links = links.select("a", "b")
    both = written(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        lowered = labels.join(near.withColumnRenamed("a", "node"), "node", "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("lower"))
        # the label of the label; a hot label is one side's many rows against a single row of the other
        jumped = lowered.join(labels.select(F.col("node").alias("lower"), F.col("label").alias("next")), "lower", "left")
        after = written(jumped.select("node", F.least("lower", F.coalesce("next", "lower")).alias("label"), F.col("label").alias("was")), "labels")
        changed = after.where("label <> was").limit(1).count()
        forget(labels)
        labels = after
        if not changed:
            forget(both)
            return labels


def relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (node, label) after further links (a, b), whose nodes labels may lack, as a table."""
    for side in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left")
    links = written(links, "links")
    fresh = links.where("label_a is null").select("a").unionByName(links.where("label_b is null").select(F.col("b").alias("a"))).distinct()
    merged = components(links.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")))
    nodes = labels.select("node", "label").unionByName(fresh.select(F.col("a").alias("node"), F.col("a").alias("label")))
    after = nodes.join(merged.select(F.col("node").alias("label"), F.col("label").alias("lower")), "label", "left")
    out = written(after.select("node", F.coalesce("lower", "label").alias("label")), "labels")
    forget(links, merged)
    return out
