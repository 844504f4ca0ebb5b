"""Groups of what hangs together by links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from listwright.session import written


def linked_groups(links: DataFrame) -> DataFrame:
    """``(node, group_id)`` for every node of ``links(a, b)``; a group is named by its smallest node.

    Each round a node takes the smallest name among its neighbours and then that name's own
    name, so long chains halve; every round is written, and only whether something moved
    comes back to the driver.
    """
    ends = F.explode(F.array(F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    both = written(links.filter("a <> b").select(ends.alias("e")).select("e.*").distinct(), "group-links")
    names = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("group_id"))
    while True:
        names = written(names, "group-names")
        around = both.join(names.select(F.col("node").alias("b"), "group_id"), "b").groupBy("a").agg(F.min("group_id").alias("low"))
        lower = names.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("group_id").alias("was"), F.least("group_id", "low").alias("now"))
        of_name = names.select(F.col("node").alias("now"), F.col("group_id").alias("further"))
        moved = written(lower.join(of_name, "now").select("node", "was", F.least("now", "further").alias("group_id")), "group-names")
        names = moved.select("node", "group_id")
        if moved.filter("was <> group_id").isEmpty():
            return names
