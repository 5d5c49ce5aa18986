"""Connected components of link tables by alternating stars, in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm._common import checkpointed, hot_lookup


def _stars(links: DataFrame, larger: bool) -> DataFrame:
    """Link each node's neighbours (the larger ones, or the smaller ones and itself) to its least neighbour.

    links has u > v.  A node that many link to is met through salted lookups only.
    """
    pairs = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if larger else links
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    found = hot_lookup(pairs, least, "u", F.col("v"))
    if larger:
        out = found.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = found.select(F.explode(F.array("u", "v")).alias("u"), F.col("least").alias("v"))
    return out.where("u <> v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of (a, b) links; root is the least node that can be reached.

    Alternating large and small stars shorten paths until each node links to its root only, in a
    number of rounds that grows with the logarithm of the longest path.  Each round is written to the
    checkpoint folder.  Self links and repeats are allowed; no links give no rows.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    links = checkpointed(links)
    state = None
    while True:
        links = checkpointed(_stars(_stars(links, larger=True), larger=False))
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = links.select("v").distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
