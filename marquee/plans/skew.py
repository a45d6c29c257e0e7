"""Windows and lookup joins when one key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marquee.plans.lineage import materialize
from marquee.plans.ordered import number_rows

# A sequence longer than this is split over several tasks.
LONG_SEQUENCE = 2_000_000


def heavy_keys(df: DataFrame, key: str, limit: int = LONG_SEQUENCE) -> tuple[DataFrame | None, int]:
    """Keys with more than `limit` rows, as a written table, and the rows that they hold.

    One aggregation over the key column alone; None without such keys.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    rows = counts.agg(F.sum("n")).first()[0]
    return (materialize(counts, "heavy"), rows) if rows else (None, 0)


def _split(df: DataFrame, key: str, heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of other keys, and rows of heavy keys. Spark broadcasts the keys only if they are few."""
    listed = heavy.select(key)
    return df.join(listed, key, "left_anti"), df.join(listed, key, "left_semi")


def join_lookup(facts: DataFrame, lookup: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join `facts` to a computed table with one row per key, such as an aggregate of them.

    The lookup is written first, which costs little as it is far smaller than the facts. Spark
    then plans with its true size: below the broadcast threshold the facts are not shuffled
    at all. Above it both sides of the join are plain shuffles, the only shape in which
    adaptive execution splits the partition of a popular key.
    """
    return facts.join(materialize(lookup, "lookup"), key, how)


def _ranges(rows: int, limit: int) -> int:
    return max(2, -(-rows // max(1, limit)))


def add_over_sequences(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    lookback: int,
    stages: Sequence[Callable[[WindowSpec], dict[str, Column]]],
    limit: int = LONG_SEQUENCE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add window columns that depend on at most the `lookback` previous rows of a key.

    Short sequences use one window partition each. A long one is cut into blocks of `limit`
    rows, each with a copy of the `lookback` rows before it, so its blocks run in parallel.
    `stages` are applied in turn; each maps a window (key, in order) to new columns.
    `counted` names a cheaper table with the same key distribution as `df`.
    """

    def apply(rows: DataFrame, window: WindowSpec) -> DataFrame:
        for stage in stages:
            rows = rows.withColumns(stage(window))
        return rows

    heavy, rows = heavy_keys(df if counted is None else counted, key, limit)
    if heavy is None:
        return apply(df, W.partitionBy(key).orderBy(*order))
    light, long = _split(df, key, heavy)
    size = max(limit, lookback)
    numbered = number_rows(long, [key], order, "_pos", _ranges(rows, limit))
    block = F.floor(F.col("_pos") / size)
    reused = F.pmod(F.col("_pos"), F.lit(size)) >= size - lookback
    copies = F.array(
        F.struct(block.alias("_block"), F.lit(True).alias("_own")),
        F.struct(F.when(reused, block + 1).alias("_block"), F.lit(False).alias("_own")),
    )
    blocked = numbered.select("*", F.inline(copies)).where(F.col("_block").isNotNull())
    done = apply(blocked, W.partitionBy(key, "_block").orderBy(*order)).where("_own")
    plain = apply(light, W.partitionBy(key).orderBy(*order))
    return plain.unionByName(done.drop("_pos", "_block", "_own"))


def number_sequences(
    df: DataFrame, key: str, order: Sequence[str], name: str, limit: int = LONG_SEQUENCE
) -> DataFrame:
    """Add `name`: 0-based position of each row in its key's sequence."""

    def plain(rows: DataFrame) -> DataFrame:
        at = F.row_number().over(W.partitionBy(key).orderBy(*order))
        return rows.withColumn(name, (at - 1).cast("bigint"))

    heavy, rows = heavy_keys(df, key, limit)
    if heavy is None:
        return plain(df)
    light, long = _split(df, key, heavy)
    numbered = number_rows(long, [key], order, name, _ranges(rows, limit))
    return plain(light).unionByName(numbered)
