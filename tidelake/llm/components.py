"""Connected components of a graph held in a DataFrame, by alternating large-star and small-star steps.

After Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step takes the least neighbour by a
partial aggregation and a join that Spark can split where a node has very many neighbours; nothing is collected. Each
round is written to the shared folder, so lost executors cost no more than a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelake.llm.common import dropped, written


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Large star: larger neighbours go to the least one; small star: the smaller ones and u."""
    both = edges.select(F.col("u").alias("n"), F.col("v").alias("o"))
    if large:
        both = both.unionAll(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
    least = both.groupBy("n").agg(F.min(F.least("n", "o")).alias("m"))
    joined = both.join(least.withColumnRenamed("n", "n_of_least"), F.col("n") == F.col("n_of_least"))
    if large:
        moved = joined.filter("o > n").select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("o").alias("u"), F.col("m").alias("v")).unionAll(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node that has an edge; ``edges`` has columns u and v of one orderable type.

    The component is the least node of it. Loops and repeated edges are allowed; no edges give an empty result.
    """
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        if not seen["n"]:
            break
        before, now = now, written(_stars(_stars(now, True), False))
        dropped(before)
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
