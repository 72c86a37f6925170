"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import settled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a, b), a > b.  Large: larger neighbours move to the least; small: smaller ones do."""
    if large:
        near = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = settled(near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
    met = near.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return settled(out.where("a > b").distinct(), "edges")


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for links (a, b) between long ids; component is the least id that can be reached.

    Only nodes with a link to another appear.  Links may be repeated, reversed or to oneself.
    The number of rounds grows with the logarithm of the longest path; every round is a few
    aggregations and joins of narrow rows, written to the shared folder.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, last = settled(edges, "edges"), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if state == last:
            break
        last = state
        edges = _star(_star(edges, large=True), large=False)
    ends = edges.select("b").distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(ends.select(F.col("b").alias("node"), F.col("b").alias("component")))
