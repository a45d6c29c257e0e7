"""Ratings, catalogue, links and users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.functions.titles import clean_title, genre_list, release_year

RATING_SCHEMA = "userId INT, movieId INT, rating DOUBLE, timestamp BIGINT"
MOVIE_SCHEMA = "movieId INT, title STRING, genres STRING"
LINK_SCHEMA = "movieId INT, imdbId STRING, tmdbId STRING"
NO_YEAR = 0


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    # '"' doubled inside a quoted field, as spreadsheets and pandas write it
    return (
        spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"')
    ).csv(path)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with numeric columns; time is a number, so it never sorts as text."""
    return _csv(spark, path, RATING_SCHEMA)


def read_movies(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV; quoted titles may contain commas."""
    return _csv(spark, path, MOVIE_SCHEMA)


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV; ids stay text to keep leading zeros."""
    return _csv(spark, path, LINK_SCHEMA)


def parse_movies(raw: DataFrame) -> DataFrame:
    """Catalogue: title without year, genres as an array, year 0 where the title has none."""
    return raw.select(
        "movieId",
        clean_title(F.col("title")).alias("title"),
        genre_list(F.col("genres")).alias("genres"),
        release_year(F.col("title"), NO_YEAR).alias("releaseYear"),
    )


def _text_or_null(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def enrich_links(movies: DataFrame, links: DataFrame) -> DataFrame:
    """Attach external ids; a movie keeps its row without them."""
    known = links.select(
        "movieId", *[_text_or_null(c).alias(c) for c in ("imdbId", "tmdbId")]
    )
    return movies.join(known, "movieId", "left")


def derive_users(ratings: DataFrame) -> DataFrame:
    return ratings.select("userId").distinct().withColumn(
        "username", F.concat(F.lit("User"), F.col("userId").cast("string"))
    )


def between(ratings: DataFrame, low: int, high: int) -> DataFrame:
    """Rows with a time from `low` to `high`, both included; pushed down to the scan."""
    return ratings.where(F.col("timestamp").between(low, high))


def time_slices(low: int, high: int, slices: int) -> list[str]:
    """Disjoint conditions that together cover the times from `low` to `high`."""
    edges = [low + (high + 1 - low) * i // slices for i in range(slices + 1)]
    return [f"timestamp >= {a} AND timestamp < {b}" for a, b in zip(edges, edges[1:]) if a < b]


def read_ratings_jdbc(
    spark: SparkSession,
    url: str,
    low: int,
    high: int,
    slices: int = 16,
    properties: dict[str, str] | None = None,
    columns: Sequence[str] = ("userId", "movieId", "score", "timestamp"),
) -> DataFrame:
    """The same range from a database table, read by `slices` tasks over disjoint times."""
    predicates = time_slices(low, high, slices)
    rows = spark.read.jdbc(url, "ratings", predicates=predicates, properties=properties or {})
    return rows.select(*columns).withColumnRenamed("score", "rating")


def genre_vocabulary(movies: DataFrame) -> DataFrame:
    """Distinct genres of a catalogue with their alphabetical position, starting at 0."""
    genres = movies.select(F.explode("genres").alias("genre")).distinct()
    return genres.select(
        "genre", (F.row_number().over(W.orderBy("genre")) - 1).alias("position")
    )
