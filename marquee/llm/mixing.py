"""Mixing sources to target weights: whole documents repeated at their source's rate.

Rows of a source with no words, and empty or null texts, have size 0: they add nothing to a target
and are repeated like the rest of their source (rate 0 if the source has no words). A null source
is a source of its own, last in order. Every row has a draw of its own: from its doc_id where ids are
distinct and never null, else from its place in the order of (doc_id, digest of source and text), so
rows with equal or null ids don't stand or fall together. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm.ids import ROW, with_rows
from marquee.plans.lineage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
LIMIT = 2.0
# Digits of the digest that make a draw: 13 hexadecimal digits are 52 bits, exact in a double.
DRAW_DIGITS = 13


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def draw(row: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from a digest of a row's number, the same on every run and engine."""
    key = F.concat(F.lit(f"{seed}:"), row.cast("string"))
    digits = F.substring(F.md5(key), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(16**DRAW_DIGITS))


def source_targets(
    sized: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    limit: float = LIMIT,
) -> DataFrame:
    """(source, source_size, target): one row per source, from rows with source and size.

    All sizes times `share` are dealt out by weight, at most `limit` times its size to a source.
    What a full source can't take goes to the others by weight. That ends at one common level,
    target = min(cap, level * weight): with sources in order of cap / weight and the first k of
    them full, the rest share what is left at level (total - caps) / weights, and the level
    wanted is the highest of these.
    """
    totals = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    # one row per source from here on
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place % len(weights) + 1)
    named = totals.select(
        "source",
        "source_size",
        weight.alias("weight"),
        (F.col("source_size") * F.lit(limit)).alias("cap"),
    )
    every = W.partitionBy()
    full = W.orderBy(
        F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(share) - F.coalesce(
        F.sum("cap").over(full), F.lit(0.0)
    )
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(full), F.lit(0.0))
    return (
        named.withColumn("level", left / open_weight)
        .withColumn("level", F.max("level").over(every))
        .select(
            "source",
            "source_size",
            F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def plan_copies(sized: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """Add source_size, target and copies to rows with _row, source and size.

    copies = floor(rate) plus one with probability equal to the rest of the rate, where
    rate = target / source_size. The targets have one row per source; Spark broadcasts them when
    their measured size is small, and otherwise splits a source that holds much of the table.
    """
    known = targets.withColumnRenamed("source", "_source")
    joined = sized.join(known, sized["source"].eqNullSafe(known["_source"]), "left").drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = (draw(F.col(ROW), seed) < rate - F.floor(rate)).cast("bigint")
    return joined.withColumn("copies", F.floor(rate) + extra)


def _rows(documents: DataFrame) -> DataFrame:
    """(_row, doc_id, source, _document) of every row; the number is what its draw is made of."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    tie = F.md5(F.concat_ws(":", F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))))
    packed = documents.select(
        F.struct(*columns).alias("_document"), "doc_id", "source", tie.alias("_tie")
    )
    return with_rows(packed, "doc_id", "_tie")[0]


def _planned(documents: DataFrame, seed: int) -> DataFrame:
    rows = _rows(documents).withColumn("size", words(F.col("_document.text")))
    targets = materialize(source_targets(rows.select("source", "size")), "targets")
    return plan_copies(rows, targets, seed)


def _copies(planned: DataFrame) -> DataFrame:
    each = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return planned.where("copies > 0").select(ROW, "_document", each)


def mix(documents: DataFrame, seed: int = 0) -> DataFrame:
    """Every document as often as the mix takes it, with the columns it came with."""
    return _copies(_planned(documents, seed)).select("_document.*")


def account(documents: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, taken) per document, from the mix as it is emitted.

    `taken` are the words of a document's copies; a document that the mix leaves out has 0.
    """
    planned = _planned(documents, seed)
    taken = (
        _copies(planned)
        .select(ROW, words(F.col("_document.text")).alias("words"))
        .groupBy(ROW)
        .agg(F.sum("words").alias("taken"))
    )
    return (
        planned.drop("_document", "_tie")
        .join(taken, ROW, "left")
        .select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            "size",
            F.coalesce("source_size", F.lit(0)).cast("bigint").alias("source_size"),
            F.coalesce("target", F.lit(0.0)).alias("target"),
            F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"),
        )
    )
