"""Train and test sets."""

from __future__ import annotations

import math
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.plans.ordered import running_total

# Share of the training set, demo sample share, error of the quantile.
TRAIN = Decimal("0.8")
DEMO = 0.1
QUANTILE_ERROR = 0.05


def random_split(samples: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    train, test = samples.randomSplit([float(TRAIN), 1 - float(TRAIN)], seed)
    return train, test


def demo_sample(samples: DataFrame, seed: int) -> DataFrame:
    """The 10 % demonstration sample; an operator of its own, never a shortcut."""
    return samples.sample(fraction=DEMO, seed=seed)


def hash_bucket() -> Column:
    """Bucket 0..9 that depends on the ids only, so a row never changes sides."""
    mixed = F.col("userId").cast("bigint") * 31 + F.col("movieId").cast("bigint") * 17
    return F.pmod(mixed, F.lit(10))


def hash_split(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    inside = hash_bucket() < 8
    return samples.where(inside), samples.where(~inside)


def approx_quantile(samples: DataFrame, column: str, share: Decimal = TRAIN) -> DataFrame:
    """One row with the approximate quantile, from mergeable summaries."""
    accuracy = round(1 / QUANTILE_ERROR)
    return samples.agg(F.percentile_approx(column, float(share), accuracy).alias("split"))


def approx_quantiles(
    rows: DataFrame, columns: Sequence[str], shares: Sequence[float], error: float
) -> DataFrame:
    """(column, share, value) for every column and share, in one pass over the rows.

    Each task keeps a summary per column, and summaries are merged; a value's rank is off by at
    most `error` of the rows that have one. Columns without values have null.
    """
    accuracy = math.ceil(1 / error)
    wanted = F.array(*[F.lit(s) for s in shares])
    found = rows.agg(
        *[F.percentile_approx(F.col(c).cast("double"), wanted, accuracy).alias(c) for c in columns]
    )
    each = [
        F.struct(F.lit(c).alias("column"), F.lit(s).alias("share"), F.col(c)[i].alias("value"))
        for c in columns
        for i, s in enumerate(shares)
    ]
    return found.select(F.inline(F.array(*each)))


def rank_errors(rows: DataFrame, quantiles: DataFrame) -> DataFrame:
    """(column, share, value, rows, error): how far a value's ranks are from its share.

    One pass for all values, which are as few as the columns and shares asked for. Equal values
    cover a range of ranks; the error is 0 inside of it.
    """
    found = quantiles.collect()
    counts = []
    for i, q in enumerate(found):
        of = F.col(q["column"])
        counts += [
            F.count_if(of < q["value"]).alias(f"below{i}"),
            F.count_if(of <= q["value"]).alias(f"upto{i}"),
            F.count(of).alias(f"n{i}"),
        ]
    each = []
    for i, q in enumerate(found):
        n, target = F.col(f"n{i}"), F.col(f"n{i}") * q["share"]
        off = F.greatest(F.col(f"below{i}") - target, target - F.col(f"upto{i}"), F.lit(0.0))
        value = F.lit(q["value"]).cast("double").alias("value")
        each.append(
            F.struct(
                F.lit(q["column"]).alias("column"),
                F.lit(q["share"]).alias("share"),
                value,
                n.alias("rows"),
                F.try_divide(off, n).alias("error"),
            )
        )
    return rows.agg(*counts).select(F.inline(F.array(*each)))


def exact_quantile(samples: DataFrame, column: str, share: Decimal = TRAIN) -> DataFrame:
    """One row with the smallest value that has at least `share` of the rows up to it.

    Values are counted first and the counts summed range by range, so no task holds them all.
    """
    counts = samples.groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_total(counts, [], [column], F.col("_n"), "_before")
    total = placed.agg(F.sum("_n")).scalar()
    reached = (F.col("_before") + F.col("_n")) >= total * F.lit(share)
    return placed.where(reached).agg(F.min(column).alias("split"))


def split_at(samples: DataFrame, column: str, quantile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows up to the quantile, and rows after it."""
    edge = quantile.scalar()
    return samples.where(F.col(column) <= edge), samples.where(F.col(column) > edge)


def split_by_time(samples: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    quantile = exact_quantile if exact else approx_quantile
    return split_at(samples, "timestamp", quantile(samples, "timestamp"))
