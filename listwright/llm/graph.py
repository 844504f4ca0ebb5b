"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listwright.llm.frames import staged


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; a component's name is its smallest node.

    Labels sink to the smallest one nearby and then follow their label's own label, so a
    chain halves with each round. Each round is written out, and only a count comes back.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = staged(both.filter(F.col("a") != F.col("b")).distinct(), "links")
    label = staged(
        both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("component")),
        "labels",
    )
    while True:
        near = (
            both.join(label.select(F.col("node").alias("b"), "component"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        )
        sunk = label.join(near, "node").select(
            "node", F.col("component").alias("was"), F.least("component", "near").alias("now")
        )
        further = label.select(F.col("node").alias("now"), F.col("component").alias("further"))
        moved = staged(sunk.join(further, "now").select(
            "node", "was", F.least("now", "further").alias("component")), "labels")
        label = moved.select("node", "component")
        if moved.filter(F.col("was") != F.col("component")).isEmpty():
            return label
