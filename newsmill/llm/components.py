"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, joined, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is linked to the least of u and u's neighbours."""
    both = edges.select("a", "b").union(edges.select("b", "a").toDF("a", "b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return joined(both.where("b > a"), least, "a", ["b"]).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them. ``edges`` have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(a, b) links of any orderable type -> stored table (node, root): the least node that each node with a link reaches.

    Each round is written to the shared folder and the round before deleted. In the large star, links of a node with very
    many neighbours are dealt out over several tasks. Links with a null end and self-links are ignored; no links give no rows.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b")))
    e = stored(e.distinct(), "cc")
    digest = lambda d: tuple(d.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = digest(e)
    while seen[0]:
        new = stored(_small_star(_large_star(e)), "cc")
        drop_stored(e)
        e, last, seen = new, seen, digest(new)
        if seen == last:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
