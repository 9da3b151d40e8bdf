"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_paths, written


def _settled(edges: DataFrame) -> bool:
    """Whether every node with a parent has one, which has none itself.

    Then the edges are stars and another round would change nothing.
    """
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _smallest(edges: DataFrame, key: str, other: str) -> tuple[DataFrame, str]:
    """Smallest end seen from each node, as a table.

    Written out so that the join that follows reads two plain exchanges,
    which adaptive execution can split when a node has very many links.
    """
    return written(edges.groupBy(F.col(key).alias("u")).agg(F.least(F.min(other), F.min(key)).alias("m")), "star")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with a link; root is the smallest node.

    Each round pulls every neighbourhood to its smallest member, from both
    sides, so the number of rounds grows with the logarithm of the longest
    path. Null ends and self links say nothing and are dropped; an empty table
    gives an empty result. Tables of earlier rounds are removed.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    e, path = written(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    while not _settled(e):
        both = e.union(e.select("b", "a")).toDF("u", "v")
        least, star = _smallest(both, "u", "v")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large, wide = written(large.distinct(), "edges")
        least, second = _smallest(large, "a", "b")
        joined = large.withColumnRenamed("a", "u").join(least, "u")
        small = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        e, new = written(small.select("e.*").where("a <> b").distinct(), "edges")
        drop_paths(spark, path, star, wide, second)
        path = new
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
