"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.storage import discard, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: every larger neighbour is linked to the smallest of the
    neighbourhood; small star: every smaller neighbour and the node itself are."""
    if large:
        rows = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        rows = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = rows.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("u", "low"))
    joined = rows.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node with an edge; ``edges`` has long columns
    u and v. component is the smallest node reached. Every round is written to
    the shared folder; rounds grow with the logarithm of the longest chain."""
    current = stored(edges.filter("u <> v").distinct(), name)
    mark = None
    while True:
        following = stored(_stars(_stars(current, True), False), name)
        discard(current)
        current = following
        # order-free fingerprint of the edge set: two figures, not the edges
        found = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            break
        mark = tuple(found)
    # every node now hangs below the smallest of its component
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    out = stored(current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots), name)
    discard(current)
    return out
