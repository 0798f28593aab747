"""Connected components of an edge table by large and small stars, without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, unstage


def components(edges: DataFrame) -> DataFrame:
    """v, label (the smallest vertex of its component) for every vertex of edges (a, b: long).

    A round sends the larger neighbours of each vertex to the smallest of it and its neighbours,
    then each vertex and its smaller neighbours to the smallest of these (Kiveris et al., 2014).
    It is one written table, so lineage stays short, and the rounds end when nothing moves, as
    every component is a star by then. Windows go up the neighbours in order, so a hot vertex costs no memory.
    """
    near = Window.partitionBy("a").orderBy("b", F.desc("moved"))
    now, written = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), F.lit(False).alias("moved")), False
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"), "moved"))
        large = both.select("a", "b", F.least("a", F.first("b").over(near)).alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"), (F.col("m") < F.col("a")).alias("moved"))
        least = large.select("a", "b", "moved", F.first("b").over(near).alias("m"), F.row_number().over(near).alias("k")).where("b > m or k = 1")
        small = least.select(F.when(F.col("b") > F.col("m"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("m").alias("b"), (F.col("moved") | (F.col("b") > F.col("m"))).alias("moved"))
        after = staged(small, "stars")
        if written:
            unstage(now)
        now, written = after, True
        if not now.where("moved").limit(1).count():
            return now.select(F.col("a").alias("v"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("v"), F.col("b").alias("label")).distinct())
