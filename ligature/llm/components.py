"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored


def _with_least(links: DataFrame) -> DataFrame:
    """Each (u, v) with the least node among u and all its v. The least is pre-aggregated; the join splits a hub's rows."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return links.join(least, links.u == least.k).select("u", "v", "m")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    tied = _with_least(down)
    own = tied.select("u", F.col("m").alias("v"))
    return tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own).where("u <> v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u long, v long) whose root, the least node reachable, is another one.

    Nodes without such a row are their own root. Links to null and self links count for nothing. Every round is written to the shared
    folder, so that a lost executor costs one round, and the driver sees two numbers a round only.
    """
    links = stored(links.select("u", "v").where("u <> v").distinct(), "links")
    before = _state(links)
    while before[0]:
        after = stored(_small_star(_large_star(links)), "links")
        drop_stored(links)
        links, now = after, _state(after)
        if now == before:
            break
        before = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
