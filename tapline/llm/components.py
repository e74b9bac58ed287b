"""Connected components of a graph given as a table of links, by alternating large and small stars.

Every round is a minimum over each node's neighbours (pre-aggregated before the shuffle) and a join back; no
neighbourhood is ever gathered in one place, and the links of each round are written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, remove_folder, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest of their neighbourhood: those above the centre, or those below and itself."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        moved = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter("a != b").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether every link (a, b) joins a node that has no other link to its centre: what the rounds lead to."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.filter("up + down > 1 AND up > 0").count() == 0


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node that a link (columns a, b) has, as a written table.

    Links may repeat, point either way or to themselves; nulls link nothing. Links that are such stars already, as
    those of components found before, take no round.
    """
    some = edges.select("a", "b").dropna().filter("a != b")
    now, path = written(some.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_stars(now):
        last = path
        now, path = written(_star(_star(now, True), False))
        remove_folder(edges.sparkSession, last)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    out = cut(stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct()))
    remove_folder(edges.sparkSession, path)
    return out


def star_links(components: DataFrame) -> DataFrame:
    """Links a, b that join what `components` (node, component) says, one for each node but the smallest."""
    return components.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))
