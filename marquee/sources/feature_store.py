"""Feature rows as key, field map and expiry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.samples import TWO_DECIMALS

# Key prefixes and lifetime.
USER_PREFIX = "uf"
MOVIE_PREFIX = "mf"
LIFETIME = 60 * 60 * 24 * 30


def _as_text(name: str) -> Column:
    """Statistics with two decimals, everything else as it is; missing becomes ''."""
    c = F.col(name)
    text = F.format_number(c, 2) if name in TWO_DECIMALS else c.cast("string")
    return F.coalesce(text, F.lit(""))


def feature_rows(
    features: DataFrame, prefix: str, key: str, fields: Sequence[str], written_at: Column
) -> DataFrame:
    """One row per key; nothing passes through the driver."""
    pairs = [x for f in fields for x in (F.lit(f), _as_text(f))]
    return features.select(
        F.concat_ws(":", F.lit(prefix), F.col(key).cast("string")).alias("key"),
        F.create_map(*pairs).alias("features"),
        (written_at + LIFETIME).cast("bigint").alias("expireAt"),
    )


def write_feature_store(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def lookup(
    rows: DataFrame, prefix: str, key: str, fields: dict[str, str], now: Column | int
) -> DataFrame:
    """Unexpired rows of a prefix as typed columns; empty text becomes NULL.

    `fields` maps a field name to its SQL type.
    """
    live = rows.where(F.col("key").startswith(prefix + ":") & (F.col("expireAt") > now))

    def typed(name: str, kind: str) -> Column:
        text = F.nullif(F.replace(F.col("features")[name], F.lit(","), F.lit("")), F.lit(""))
        return (text if kind == "string" else text.try_cast(kind)).alias(name)

    return live.select(
        F.split("key", ":")[1].try_cast("int").alias(key),
        *[typed(name, kind) for name, kind in fields.items()],
    )
