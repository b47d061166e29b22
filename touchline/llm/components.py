"""Connected components of a link table, by smallest id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.lineage import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """``id``, ``component`` (smallest id reachable) for every id in the columns ``a`` and ``b`` of ``links``.

    Each round takes the smallest label next to an id and then the label of that label, so that long chains halve;
    it ends with the first round that changes nothing.
    """
    both = cut_lineage(links.select(F.col("a").alias("id"), F.col("b").alias("next")).union(links.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy("id").agg(F.least("id", F.min("next")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("next"), F.col("component").alias("c")), "next").groupBy("id").agg(F.min("c").alias("c"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "c").alias("component"))
        least = cut_lineage(least)
        jump = least.select(F.col("id").alias("component"), F.col("component").alias("further"))
        labels = cut_lineage(least.join(jump, "component").select("id", "old", F.col("further").alias("component")))
        if labels.filter("component <> old").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")
