"""Connected components of an undirected graph by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize


def _smallest(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour, or itself, to its larger neighbours."""
    arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(arcs).withColumn("m", F.least("u", "m"))
    return arcs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smallest neighbour to its smaller neighbours and itself."""
    least = _smallest(edges)
    handed = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return handed.union(least.withColumnRenamed("m", "v")).where("u != v")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; the component is its smallest node.

    `edges` has two columns of node numbers. Each round is written, so a lost executor costs one
    round, and the joins are plain, so a node with very many neighbours is split. The number of
    rounds grows with the logarithm of the graph.
    """
    a, b = (F.col(c).cast("bigint") for c in edges.columns)
    kept = materialize(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u != v")
        .distinct(),
        "edges",
    )
    mark = None
    while True:
        found = kept.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if tuple(found) == mark or found[0] == 0:
            break
        mark = tuple(found)
        kept = materialize(_small_star(_large_star(kept).distinct()).distinct(), "edges")
    own = kept.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return kept.select(F.col("u").alias("node"), F.col("v").alias("component")).union(own)
