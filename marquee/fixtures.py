"""Recommendation-shaped inputs derived from the given tables."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400
CHANGES_FROM = 1_705_276_800_000_000  # 2024-01-15 in microseconds


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _epoch_day(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("bigint") * DAY


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, whatever the session zone is."""
    epoch = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
    return F.expr(f"timestampdiff(MICROSECOND, {epoch}, {name})")


def ratings(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """Latest rating of each (user, movie), from order lines not older than `since` if given.

    Time and half-step score are packed into one number, so that the deduplication is a plain
    hash aggregate with partial maxima instead of a sort.
    """
    raw = table(spark, sf_dir, "lineitem")
    if since is not None:
        # on the column as stored, so that the scan can skip row groups
        first = date(1970, 1, 1) + timedelta(days=-(-since // DAY))
        raw = raw.where(F.col("l_shipdate") >= F.lit(first).cast(raw.schema["l_shipdate"].dataType))
    lines = raw.select(
        "l_orderkey",
        F.col("l_partkey").cast("int").alias("movieId"),
        ((F.col("l_quantity").cast("int") - 1) % 10 + 1).alias("_halves"),
        _epoch_day(F.col("l_shipdate")).alias("_ts"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("int").alias("userId")
    )
    packed = F.col("_ts") * 16 + F.col("_halves")
    # Joins would add these filters on some branches only, and then nothing could be reused.
    known = F.col("userId").isNotNull() & F.col("movieId").isNotNull()
    newest = lines.join(orders, "l_orderkey").where(known).groupBy("userId", "movieId").agg(
        F.max(packed).alias("_packed")
    )
    halves = F.pmod(F.col("_packed"), F.lit(16))
    return newest.select(
        "userId",
        "movieId",
        (halves / 2).cast("double").alias("rating"),
        F.floor((F.col("_packed") - halves) / 16).cast("bigint").alias("timestamp"),
    )


def movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    dated = F.concat("p_name", F.lit(" ("), (F.col("p_size") + 1950).cast("string"), F.lit(")"))
    return table(spark, sf_dir, "part").select(
        key.cast("int").alias("movieId"),
        F.when(key % 50 == 0, F.col("p_name")).otherwise(dated).alias("title"),
        F.when(key % 3 == 0, F.col("p_type"))
        .when(key % 3 == 1, F.concat_ws("|", "p_type", first))
        .otherwise(F.concat_ws("|", F.col("p_type"), first, second))
        .alias("genres"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key.cast("int").alias("movieId"),
        F.lpad((key * 7).cast("string"), 7, "0").alias("imdbId"),
        F.when(key % 89 == 0, F.lit(""))
        .otherwise((key + 10000).cast("string"))
        .alias("tmdbId"),
    )


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def rating_events_of(events: DataFrame) -> DataFrame:
    """Event rows, batch or stream, as rating events with a microsecond time."""
    return events.select(
        "event_id",
        F.col("user_id").cast("int").alias("userId"),
        _k().alias("movieId"),
        ((F.floor("value").cast("int") % 10 + 1) / 2).cast("double").alias("rating"),
        micros("ts").alias("timestamp"),
    )


def rating_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rating_events_of(table(spark, sf_dir, "events"))


def watchlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = (
        table(spark, sf_dir, "lineitem")
        .where("l_returnflag = 'R' AND l_linestatus = 'O'")
        .select(
            "l_orderkey",
            F.col("l_partkey").cast("int").alias("movieId"),
            _epoch_day(F.col("l_shipdate")).alias("timestamp"),
        )
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").cast("int").alias("userId")
    )
    return (
        lines.join(orders, "l_orderkey")
        .groupBy("userId", "movieId")
        .agg(F.max("timestamp").alias("timestamp"))
    )


def watchlist_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a watch-list change: errors delete, sign-ups clear, the rest add."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").cast("int").alias("userId"),
        _k().alias("movieId"),
        micros("ts").alias("timestamp"),
        F.when(kind == "error", "del").when(kind == "signup", "clear").otherwise("add").alias("op"),
    )


def item_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("int").alias("movieId"), F.col("embedding").alias("emb")
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("text")
