"""Helpers the operators share: word pattern, row keys, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineax.session import materialize

#: A word, as in every operator here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the like of it that no column of ``df`` has (columns' names don't differ by case alone)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit_hash(*cols: Column | str, salt: str = "") -> Column:
    """A number in [0, 1) from md5 (the same in SQL engines); null counts as its own value."""
    parts = [F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\x00")) for c in cols]
    digest = F.md5(F.concat_ws("|", F.lit(salt), *parts))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def connected_components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(node, component) of every node of ``edges`` (columns a, b: any orderable type); component: its smallest node.

    Alternating large-star and small-star steps: each joins edges to the
    smallest neighbour of their node (a partial aggregate), so a node with very
    many neighbours is a join key that adaptive execution may split, never a
    list.  A round's edges are written once; rounds end when every edge leads
    from a component's smallest node, after about log(longest path) rounds.
    """
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), name)
    while not _is_forest_of_stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        large = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        # small star: smaller neighbours of u, and u, go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").union(least.select(F.col("m").alias("a"), "b"))
        edges = materialize(small.distinct(), name)
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each node is either a centre or has one edge to a centre."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("centre"), F.lit(0).alias("leaf")).union(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.max("centre").alias("centre"), F.sum("leaf").alias("leaf")).where("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty()
