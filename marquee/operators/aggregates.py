"""Counts and statistics per rating, user, movie, genre and word."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.functions.moments import sample_variance
from marquee.functions.titles import genre_list, slot
from marquee.operators.samples import USER_GENRES, liked
from marquee.plans.skew import join_lookup

# Bounds a user's extremes start from, and ratings kept per movie.
HIGHEST_START = 0.0
LOWEST_START = 5.0
TOP_RATINGS = 10


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """Rows per rating value and their share of the total, from one pass over the ratings."""
    counts = ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("cnt"))
    # the window runs over one row per rating value
    return counts.withColumn("share", F.col("cnt") / F.sum("cnt").over(W.partitionBy()))


def movie_rating_variance(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(
        F.count(F.lit(1)).alias("ratingCount"),
        F.avg("rating").alias("avgRating"),
        sample_variance(F.col("rating")).alias("ratingVar"),
    )


def movie_averages(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("movieId").agg(
        F.avg("rating").alias("averageRating"), F.count(F.lit(1)).alias("ratingNumber")
    )


def user_rating_stats(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("userId").agg(
        F.avg("rating").alias("averageRating"),
        F.greatest(F.max("rating"), F.lit(HIGHEST_START)).alias("highestRating"),
        F.least(F.min("rating"), F.lit(LOWEST_START)).alias("lowestRating"),
        F.count(F.lit(1)).alias("ratingCount"),
    )


def movie_top_ratings(ratings: DataFrame, size: int = TOP_RATINGS) -> DataFrame:
    """The best ratings of each movie; among equals the earliest stay.

    `position` counts from the lowest kept score up, newest first within a score. The rank
    filter also runs before the shuffle, so a popular movie sends `size` rows per task.
    """
    best = W.partitionBy("movieId").orderBy(F.desc("rating"), "timestamp", "userId")
    kept = ratings.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= size)
    return kept.withColumn(
        "position", F.count(F.lit(1)).over(W.partitionBy("movieId")) - F.col("_rank") + 1
    ).drop("_rank")


def genre_index(catalogue: DataFrame) -> DataFrame:
    """(genre, movie) rows with the size of the genre."""
    rows = catalogue.select(F.explode("genres").alias("genre"), "movieId")
    sizes = rows.groupBy("genre").agg(F.count(F.lit(1)).alias("genreSize"))
    return join_lookup(rows, sizes, "genre")


def word_count(texts: DataFrame) -> DataFrame:
    """Occurrences of each word; lines end at a newline, words at one space, empty words count."""
    words = texts.select(F.explode(F.split("text", "[ \n]")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def user_genres_ranked(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Top genres over all liked movies of a user; ties go to the genre seen first.

    Counts and first appearances are aggregated before anything is ordered, so the final
    window sees one row per user and genre.
    """
    genres = movies.select("movieId", F.posexplode(genre_list(F.col("genres"))))
    seen = ratings.where(liked(F.col("rating"))).join(genres, "movieId")
    per_genre = seen.groupBy("userId", F.col("col").alias("genre")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("timestamp", "movieId", "pos")).alias("_first"),
    )
    order = W.partitionBy("userId").orderBy(F.desc("_n"), "_first")
    top = per_genre.withColumn("_rank", F.row_number().over(order)).where(
        F.col("_rank") <= len(USER_GENRES)
    )
    names = F.collect_list(F.struct("_rank", "genre"))
    ranked = top.groupBy("userId").agg(F.array_sort(names).alias("_g"))
    return ranked.select(
        "userId", *[slot(F.col("_g"), i)["genre"].alias(c) for i, c in enumerate(USER_GENRES)]
    )
