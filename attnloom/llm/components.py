"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, stored


def _settled(edges: DataFrame) -> bool:
    """Every node points to one smaller node which points nowhere."""
    if edges.groupBy("hi").count().agg(F.max("count")).first()[0] not in (None, 1):
        return False
    inner = edges.select(F.col("lo").alias("hi")).distinct().join(edges.select("hi"), "hi", "left_semi")
    return inner.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of `edges` (a, b) that is not the smallest of its component.

    `component` is the smallest node reachable. Null ends and loops are ignored;
    repeated edges count once. Rounds grow with the logarithm of the number of
    nodes; each is stored in the shared folder, and a hub of any degree is
    spread by `spread_join`.
    """
    hi, lo = F.greatest("a", "b"), F.least("a", "b")
    links = edges.filter("a is not null and b is not null and a <> b").select(hi.alias("hi"), lo.alias("lo")).distinct()
    links = stored(links, "links")
    while not _settled(links):
        lowest = stored(links.groupBy(F.col("hi").alias("lo")).agg(F.min("lo").alias("below")), "lowest")
        large = spread_join(links, lowest, "lo", "left").select("hi", F.coalesce("below", "lo").alias("lo")).distinct()
        large = stored(large, "large")
        lowest = stored(large.groupBy("hi").agg(F.min("lo").alias("below")), "lowest")
        small = spread_join(large, lowest, "hi").filter("lo <> below").select(F.col("lo").alias("hi"), F.col("below").alias("lo"))
        links = stored(small.unionByName(lowest.select("hi", F.col("below").alias("lo"))).distinct(), "links")
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
