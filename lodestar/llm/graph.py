"""Connected components of large graphs by alternating large and small stars.

Every step is a grouped minimum (combined before the shuffle) joined back, so
that a node with very many neighbours never has them gathered in one task; a
large join partition is split by adaptive execution.  Each round is written to
the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.store import kept, release


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b), a > b, reconnected to the least neighbour."""
    ways = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        ways = ways.union(edges.select("b", "a"))
    least = ways.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
    # a second key gives the join exchanges of its own, of which a large part can be split
    salt = F.xxhash64("u").alias("h")
    met = ways.select("u", "v", salt).join(least.select("u", "m", salt).hint("merge"), ["u", "h"])
    out = met.where(F.col("v") > F.col("u")) if large else met
    out = out.select(F.col("v").alias("x"), "m")
    if not large:
        out = out.union(least.select("u", "m"))
    return out.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every node that has an edge to another; a component is
    named by its least node.  Null ends and loops count for nothing."""
    pairs = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(f"{a} is not null and {b} is not null and {a} <> {b}")
    now = kept(pairs.distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    seen = state(now)
    while seen[0]:
        later = kept(_stars(_stars(now, large=True), large=False), "edges")
        release(now)
        now, before, seen = later, seen, state(later)
        if seen == before:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )
