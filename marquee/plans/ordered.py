"""Positions and running totals along an order, without one task per key.

A plain window sorts all rows of a key in one task. Here rows are range-partitioned on
(keys, order), so a key with a third of the table is spread over a third of the tasks; each
range is numbered on its own and shifted by what lies before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize

RANGE = "_range"


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, Column],
    ranges: int | None = None,
) -> DataFrame:
    """Add a column per entry of `values`: the sum over the rows before this one within `keys`.

    `order` must make rows unique inside a key. The offsets table has one row per key and range.
    """
    keys, order = list(keys), list(order)
    summed = {name: f"_value{i}" for i, name in enumerate(values)}
    ranged = materialize(
        df.withColumns({summed[name]: value for name, value in values.items()})
        .repartitionByRange(ranges or _ranges(df), *keys, *order)
        .withColumn(RANGE, F.spark_partition_id()),
        "ranges",
    )
    totals = ranged.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(c) for c in summed.values()])
    before = W.partitionBy(*keys).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        RANGE,
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_offset") for c in summed.values()],
    )
    inside = W.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return (
        ranged.withColumns(
            {f"{c}_inside": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in summed.values()}
        )
        .join(offsets, [*keys, RANGE])
        .withColumns(
            {name: F.col(f"{c}_inside") + F.col(f"{c}_offset") for name, c in summed.items()}
        )
        .drop(RANGE, *[c + end for c in summed.values() for end in ("", "_inside", "_offset")])
    )


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add `name`: the sum of `value` over the rows before this one within `keys`."""
    return running_totals(df, keys, order, {name: value}, ranges)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    ranges: int | None = None,
) -> DataFrame:
    """Add `name`: 0-based position of each row in its key's order."""
    return running_total(df, keys, order, F.lit(1).cast("bigint"), name, ranges)
