"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import remove, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node with an edge to another; root is the least node reachable, roots included.

    Each round links every node's larger neighbours, then its smaller ones, to the least node it sees, until every
    node hangs on a root; the number of rounds grows with the logarithm of the longest path.  Rounds are written to
    the shared folder.  Edges with a null end and loops are left out; repeated edges do no harm; no edges give an
    empty table.
    """
    e, path = written(_tidy(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "components")
    while not _done(e):
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _tidy(large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(down.select("u", "m")))
        old = path
        e, path = written(small, "components")
        remove(e.sparkSession, old)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def _done(e: DataFrame) -> bool:
    """Whether every larger end has one edge, and no smaller end is a larger one too."""
    ups = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
    again = e.join(ups.select(F.col("u").alias("v")), "v", "left_semi").select(F.lit(1).alias("x")).limit(1)
    return again.union(ups.where("n > 1").select(F.lit(1).alias("x")).limit(1)).isEmpty()


def _tidy(e: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller end."""
    return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
