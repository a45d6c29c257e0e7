"""Bulk forms of point lookups and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.samples import MOVIE_FEATURES, MOVIE_GENRES, RATED_MOVIES, USER_FEATURES
from marquee.plans.skew import join_lookup

# Fixed value: answer for a pair without a rating.
NO_RATING = -1.0


def rating_lookup(requests: DataFrame, ratings: DataFrame) -> DataFrame:
    """The rating of each requested (user, movie), or -1."""
    known = ratings.select("userId", "movieId", "rating")
    return requests.join(known, ["userId", "movieId"], "left").select(
        "userId", "movieId", F.coalesce("rating", F.lit(NO_RATING)).alias("rating")
    )


def watchlist_flags(asked: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Whether each asked movie is on the user's watch list; nobody is on it without a user."""
    listed = watchlist.select("userId", "movieId", F.lit(True).alias("_in"))
    return asked.join(listed, ["userId", "movieId"], "left").select(
        "userId", "movieId", F.coalesce("_in", F.lit(False)).alias("inWatchlist")
    )


def valid_inserts(inserts: DataFrame, users: DataFrame, movies: DataFrame) -> DataFrame:
    """Rows whose user and movie both exist."""
    return inserts.join(users.select("userId"), "userId", "left_semi").join(
        movies.select("movieId"), "movieId", "left_semi"
    )


def ranking_features(
    pairs: DataFrame, user_features: DataFrame, movie_features: DataFrame
) -> DataFrame:
    """Typed model inputs of each (user, movie) pair that has both feature rows.

    Missing history slots become 0, missing genres ''.
    """
    # a popular movie may be a candidate of very many users, a user has a short list
    with_movie = join_lookup(pairs, movie_features.select("movieId", *MOVIE_FEATURES), "movieId")
    joined = with_movie.join(user_features.select("userId", *USER_FEATURES), "userId")
    texts = {c for c in USER_FEATURES if c.startswith("userGenre")} | set(MOVIE_GENRES)

    def filled(name: str) -> Column:
        if name in texts:
            return F.coalesce(name, F.lit("")).alias(name)
        if name in RATED_MOVIES:
            return F.coalesce(name, F.lit(0)).alias(name)
        return F.col(name)

    return joined.select(*pairs.columns, *[filled(c) for c in (*USER_FEATURES, *MOVIE_FEATURES)])
