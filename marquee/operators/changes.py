"""Tables brought up to date from change logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.plans.skew import join_lookup


def last_write(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, ranked once before and once after the shuffle."""
    newest = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return (
        rows.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")
    )


def upsert_ratings(base: DataFrame, changes: DataFrame, order: list[str]) -> DataFrame:
    """A rating replaces the earlier one of the same user and movie."""
    return last_write(base.unionByName(changes), ["userId", "movieId"], order)


def watchlist_snapshot(ops: DataFrame, order: list[str]) -> DataFrame:
    """Watch list after a log of add, del and clear; clear empties a user's list."""
    at = F.struct(*order)
    entries = ops.where(F.col("op") != "clear")
    last = last_write(entries, ["userId", "movieId"], order).where(F.col("op") == "add")
    cleared = ops.where(F.col("op") == "clear").groupBy("userId").agg(F.max(at).alias("_cleared"))
    kept = join_lookup(last, cleared, "userId", "left")
    alive = F.col("_cleared").isNull() | (at > F.col("_cleared"))
    return kept.where(alive).select("userId", "movieId", "timestamp")
