"""Connected components of a graph kept in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.shared import Scratch

# Up to so many links a round's minima go to every executor (twice as many rows at most, of about 80 bytes each
# on the driver, which holds those of several joins at a time).
FEW_LINKS = 50_000
FEW_FILES = 8


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node is tied to one root, and no root to anything."""
    ends = edges.select(F.col("u").alias("node"), "v", F.lit(True).alias("tied"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(None).alias("v"), F.lit(False).alias("tied")))
    low_high = [f("v") for f in (F.min, F.max)] + [f("tied") for f in (F.min, F.max)]
    seen = ends.groupBy("node").agg(*[c.alias(n) for c, n in zip(low_high, ("v0", "v1", "t0", "t1"), strict=True)])
    return seen.where("v0 <> v1 OR t0 <> t1").isEmpty()


def components(scratch: Scratch, links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of a link; the root is the smallest node it can reach.

    Links are rewired in rounds: neighbours of a node are tied to the smallest of them, first
    the larger ones, then the smaller ones, until every component is a star around its root.
    The number of rounds grows with the logarithm of the longest path. A node with very many
    links is reduced to a minimum in the map tasks; the minima and what they are joined back to are
    tables, so that the join can be split, and nothing of them comes to the driver. Where the links
    were counted to be few, the minima are broadcast and the rows kept in few files.
    """
    edges = scratch.save(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "edges")
    few = edges.count() <= FEW_LINKS
    sent = F.broadcast if few else lambda df: scratch.save(df, "minima")
    while not _is_forest_of_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(sent(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large if few else scratch.save(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(low), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        stars = small.where("u <> v").distinct()
        edges = scratch.save(stars.coalesce(FEW_FILES) if few else stars, "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).distinct()
