"""Row numbers for tables whose id may be null or repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize
from marquee.plans.ordered import number_rows

ROW = "_row"


def with_rows(df: DataFrame, key: str, tie: str) -> tuple[DataFrame, bool]:
    """Add `_row`, a distinct long per row that sorts like (key, tie), and say if it is the key.

    Where `key` is distinct and never null, as in a sound table, it is the row number itself and
    no row moves. Otherwise all rows are numbered along (key, tie), null first; equal rows get
    numbers in any order, which no result depends on, and the numbered table is written once so
    that every later pass sees the same numbers.
    """
    unsound = (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where((F.col("_n") > 1) | F.col(key).isNull())
        .limit(1)
        .count()
    )
    if not unsound:
        return df.withColumn(ROW, F.col(key).cast("bigint")), True
    salted = df.withColumn("_any", F.monotonically_increasing_id())
    numbered = number_rows(salted, [], [key, tie, "_any"], ROW).drop("_any")
    return materialize(numbered, "rows"), False


def name_rows(
    rows: DataFrame, numbered: DataFrame, sound: bool, column: str, key: str, name: str
) -> DataFrame:
    """Replace the row number in `column` by that row's key, called `name`."""
    if sound:
        return rows.withColumnRenamed(column, name)
    keys = numbered.select(F.col(ROW).alias(column), F.col(key).alias(name))
    return rows.join(keys, column, "left").drop(column)
