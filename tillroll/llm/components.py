"""Connected components of links that stay distributed: labels spread by joins, in few rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of links (a, b); comp is the smallest node that it reaches.

    Each round gives a node the smallest label among its own and its neighbours', then follows
    labels once (the label of its label), so paths shorten by half and more. A round is staged,
    which cuts the lineage; only the number of changed labels comes to the driver. The minimum
    over neighbours combines inside tasks, so a node with very many links is no hot group. Null
    ends, self-links and repeated links are allowed; no links give no rows.
    """
    links = links.filter("a IS NOT NULL AND b IS NOT NULL")
    both = staged(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp"))
    labels = staged(labels, "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.least("comp", "near").alias("to"), F.col("comp").alias("was"))
        follow = labels.select(F.col("node").alias("to"), F.col("comp").alias("next"))
        moved = lower.join(follow, "to").select("node", F.least("to", "next").alias("comp"), "was")
        moved = staged(moved, "labels")
        labels = moved.select("node", "comp")
        if moved.filter("comp <> was").isEmpty():
            return labels
