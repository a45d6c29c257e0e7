"""Ordered lists: top movies, per-genre lists, pages, recent items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.operators.aggregates import movie_averages

# Rows per recommendation page, genres and movies on the home page.
LIST_PAGE = 7
HOME_GENRES = 6
HOME_MOVIES = 7


def scored_movies(catalogue: DataFrame, ratings: DataFrame) -> DataFrame:
    """Catalogue with averageRating and ratingNumber; 0 where a movie has no rating."""
    return catalogue.join(movie_averages(ratings), "movieId", "left").fillna(
        0, ["averageRating", "ratingNumber"]
    )


def top_per(
    rows: DataFrame, key: str | list[str], order: list[Column], size: int, rank: str = "position"
) -> DataFrame:
    """The first `size` rows of each key.

    `order` ends in a unique column. Spark filters by rank before the shuffle as well, so a
    large group contributes at most `size` rows per task.
    """
    keys = [key] if isinstance(key, str) else key
    ranked = rows.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= size)


def top_movies(scored: DataFrame, by: str, size: int) -> DataFrame:
    """The `size` movies with the highest `by`."""
    order = [F.desc(by), F.col("movieId")]
    best = scored.orderBy(*order).limit(size)
    return best.withColumn("position", F.row_number().over(W.orderBy(*order)))


def top_movies_per_genre(scored: DataFrame, by: str, size: int) -> DataFrame:
    rows = scored.select(F.explode("genres").alias("genre"), "movieId", by)
    return top_per(rows, "genre", [F.desc(by), F.col("movieId")], size)


def genre_page(catalogue: DataFrame, page: int, size: int) -> DataFrame:
    """Page `page` (from 1) of every genre's movies."""
    rows = catalogue.select(F.explode("genres").alias("genre"), "movieId", "title")
    upto = top_per(rows, "genre", [F.col("movieId")], page * size)
    return upto.where(F.col("position") > (page - 1) * size)


def list_pages(lists: DataFrame, key: str, rank: str, size: int = LIST_PAGE) -> DataFrame:
    """Every page of each short list; the last page shows the last `size` rows.

    A row of the last page may thus be on the page before as well.
    """
    n = F.count(F.lit(1)).over(W.partitionBy(key))
    own = F.ceil(F.col(rank) / size).cast("int")
    last = F.ceil(F.col("_n") / size).cast("int")
    shown_last = F.when(F.col(rank) > F.col("_n") - size, last)
    pages = F.array_distinct(F.array_compact(F.array(own, shown_last)))
    return lists.withColumn("_n", n).withColumn("page", F.explode(pages)).drop("_n")


def home_page(
    catalogue: DataFrame, genres: int = HOME_GENRES, movies: int = HOME_MOVIES
) -> DataFrame:
    """The first genres by name with their first movies."""
    rows = catalogue.select(F.explode("genres").alias("genre"), "movieId")
    chosen = rows.select("genre").distinct().orderBy("genre").limit(genres)
    listed = rows.join(F.broadcast(chosen), "genre", "left_semi")  # at most `genres` rows
    return top_per(listed, "genre", [F.col("movieId")], movies)


def recent_ratings(ratings: DataFrame, size: int) -> DataFrame:
    """Each user's newest ratings."""
    order = [F.desc("timestamp"), F.desc("movieId")]
    return top_per(ratings, "userId", order, size)


def watchlist_latest(watchlist: DataFrame, catalogue: DataFrame, size: int) -> DataFrame:
    """Each user's newest watch-list entries that exist in the catalogue."""
    known = watchlist.join(catalogue.select("movieId", "title"), "movieId")
    return top_per(known, "userId", [F.desc("timestamp"), F.col("movieId")], size)


def display_rating(scored: DataFrame) -> DataFrame:
    """Average rating rounded up to two decimals."""
    shown = F.ceil(F.col("averageRating") * 100).cast("double") / 100
    return scored.select("movieId", shown.alias("displayRating"))
