"""Connected components of a table of links, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from litevidence.llm.common import staged


def _both(links: DataFrame) -> DataFrame:
    return links.unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y")))


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Hangs neighbours of each node on the least of them: larger neighbours, or smaller ones and itself."""
    near = _both(links) if large else links.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = near.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
    hung = near.join(least, "x")
    if large:
        return hung.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
    own = least.where("x > m").select("x", F.col("m").alias("y"))
    return hung.where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(own).distinct()


def _done(links: DataFrame) -> bool:
    """Whether links are stars: no node hangs on two others, and none that hangs has others hanging on it."""
    ends = links.select(F.col("x").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(
        links.select(F.col("y").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("holds"))
    )
    seen = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return seen.where((F.col("hangs") > 1) | ((F.col("hangs") == 1) & (F.col("holds") == 1))).isEmpty()


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (x, y) that is not itself the least of its component.

    Large and small stars in turn (Kiveris and others, 2014) until only stars are left. Each step is a written
    table; nothing of the links reaches the driver.
    """
    ordered = links.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    links = staged(ordered.distinct(), "links")
    while not _done(links):
        links = staged(_star(_star(links, large=True), large=False), "links")
    return links.select(F.col("x").alias("node"), F.col("y").alias("root"))
