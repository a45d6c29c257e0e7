"""Labelled samples with item features and history-only user features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marquee.functions.frequency import by_frequency
from marquee.functions.moments import sample_variance
from marquee.functions.titles import MISSING_YEAR, genre_list, release_year, slot
from marquee.plans.skew import LONG_SEQUENCE, add_over_sequences, join_lookup, number_sequences

# Rating from which an item counts as liked, rows of history looked at, and how
# many recent items, top genres and item genres become columns.
LIKED = 3.5
HISTORY_ROWS = 100
MOVIE_SLOTS = 5
USER_GENRE_SLOTS = 5
MOVIE_GENRE_SLOTS = 3

RATED_MOVIES = [f"userRatedMovie{i}" for i in range(MOVIE_SLOTS)]
USER_GENRES = [f"userGenre{i}" for i in range(USER_GENRE_SLOTS)]
MOVIE_GENRES = [f"genre{i}" for i in range(MOVIE_GENRE_SLOTS)]
USER_STATS = [
    "userRatingCount",
    "userRatedMovieAvgReleaseYear",
    "userRatedMovieReleaseYearStddev",
    "userAvgRating",
    "userRatingStddev",
]
MOVIE_STATS = ["movieRatingCount", "movieAvgRating", "movieRatingStddev"]
USER_FEATURES = [*RATED_MOVIES, *USER_STATS, *USER_GENRES]
MOVIE_FEATURES = ["releaseYear", *MOVIE_GENRES, *MOVIE_STATS]
TWO_DECIMALS = [
    "userRatedMovieReleaseYearStddev",
    "userAvgRating",
    "userRatingStddev",
    "movieAvgRating",
    "movieRatingStddev",
]
# Order of a user's events and of a movie's events; ids break ties in time.
USER_ORDER = ["timestamp", "movieId"]
MOVIE_ORDER = ["timestamp", "userId"]


def liked(rating: Column) -> Column:
    return rating >= LIKED


def add_label(ratings: DataFrame) -> DataFrame:
    return ratings.withColumn("label", F.when(liked(F.col("rating")), 1).otherwise(0))


def movie_rating_features(ratings: DataFrame) -> DataFrame:
    """Count, mean and sample deviation of all ratings of a movie; one rating has deviation 0."""
    return ratings.groupBy("movieId").agg(
        F.count(F.lit(1)).alias("movieRatingCount"),
        F.avg("rating").alias("movieAvgRating"),
        F.coalesce(F.sqrt(sample_variance(F.col("rating"))), F.lit(0.0)).alias("movieRatingStddev"),
    )


def movie_profile(movies: DataFrame, ratings: DataFrame) -> DataFrame:
    """One row per rated movie: release year, genres, rating features."""
    genres = genre_list(F.col("genres"))
    described = movies.select(
        "movieId",
        release_year(F.col("title")).alias("_year"),
        genres.alias("_genres"),
    )
    return (
        movie_rating_features(ratings)
        .join(described, "movieId", "left")
        .withColumn("releaseYear", F.coalesce("_year", F.lit(MISSING_YEAR)))
        .withColumns({f"genre{i}": slot(F.col("_genres"), i) for i in range(MOVIE_GENRE_SLOTS)})
        .drop("_year")
    )


def with_movie_features(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """Labelled ratings with the features of their movie.

    Catalogue and rating features meet in one row per movie first, so the ratings are joined
    once.
    """
    return join_lookup(add_label(ratings), movie_profile(movies, ratings), "movieId", "left")


def join_rating_features(ratings: DataFrame) -> DataFrame:
    """Ratings with the rating features of their movie alone."""
    return join_lookup(ratings, movie_rating_features(ratings), "movieId", "left")


def _item() -> Column:
    return F.struct(F.col("movieId").alias("id"), F.col("_genres").alias("genres"))


def _totals(window: WindowSpec) -> dict[str, Column]:
    """Running sums before each row."""
    earlier = window.rowsBetween(W.unboundedPreceding, -1)
    rating, year = F.col("rating"), F.col("releaseYear").cast("bigint")

    def total(x: Column, zero: Column) -> Column:
        return F.coalesce(F.sum(x).over(earlier), zero)

    zero, none = F.lit(0.0), F.lit(0).cast("bigint")
    return {
        "_n": F.row_number().over(window) - 1,
        "_r1": total(rating, zero),
        "_r2": total(rating * rating, zero),
        "_y1": total(year, none),
        "_y2": total(year * year, none),
    }


def _frame_totals(window: WindowSpec) -> dict[str, Column]:
    """Sums over the history frame as differences of running sums, one subtraction per row.

    The lists of liked items are made here, in the last stage, so that no window ever buffers them.
    """
    frame = window.rowsBetween(-HISTORY_ROWS, -1)

    def recent(name: str) -> Column:
        return F.col(name) - F.coalesce(F.lag(name, HISTORY_ROWS).over(window), F.lit(0))

    names = ["_r1", "_r2", "_y1", "_y2"]
    return {
        "_n": F.least(F.col("_n"), F.lit(HISTORY_ROWS)).cast("bigint"),
        **{name: recent(name) for name in names},
        "_liked": F.collect_list(F.when(F.col("label") == 1, _item())).over(frame),
    }


def _sample_stddev(n: Column, s1: Column, s2: Column) -> Column:
    spread = n * s2 - s1 * s1
    variance = F.greatest(spread.cast("double"), F.lit(0.0)) / (n * (n - 1))
    return F.when(n > 1, F.sqrt(variance))


def add_user_history(
    samples: DataFrame,
    long_sequence: int = LONG_SEQUENCE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Features of the user's last 100 events before each event; no future data enters."""
    framed = add_over_sequences(
        samples,
        "userId",
        USER_ORDER,
        HISTORY_ROWS,
        [_totals, _frame_totals],
        long_sequence,
        counted,
    )
    return _history_columns(framed)


def _history_columns(framed: DataFrame) -> DataFrame:
    """User features from the totals and the liked items, in time order, of a history frame."""
    n, some = F.col("_n"), F.col("_n") > 0
    newest = F.size("_liked") - 1
    seen = F.flatten(F.transform("_liked", lambda m: m["genres"]))
    # the lists go before the genres are ranked, as rows wait for their batch there
    return (
        framed.withColumns(
            {
                **{c: F.get("_liked", newest - i)["id"] for i, c in enumerate(RATED_MOVIES)},
                "userRatingCount": n,
                "userRatedMovieAvgReleaseYear": F.when(some, F.col("_y1") / n).cast("int"),
                "userRatedMovieReleaseYearStddev": _sample_stddev(n, F.col("_y1"), F.col("_y2")),
                "userAvgRating": F.when(some, F.col("_r1") / n),
                "userRatingStddev": _sample_stddev(n, F.col("_r1"), F.col("_r2")),
                "_seen": seen,
            }
        )
        .drop("_n", "_r1", "_r2", "_y1", "_y2", "_liked")
        .withColumn("_top", by_frequency(F.col("_seen"), USER_GENRE_SLOTS))
        .withColumns({c: slot(F.col("_top"), i) for i, c in enumerate(USER_GENRES)})
        .drop("_seen", "_top")
    )


def user_history(
    ratings: DataFrame, movies: DataFrame, long_sequence: int = LONG_SEQUENCE
) -> DataFrame:
    """Every rating with movie and user features, cold-start rows included."""
    described = with_movie_features(ratings, movies)
    return add_user_history(described, long_sequence, ratings).drop("_genres")


def mixed_samples(
    ratings: DataFrame, movies: DataFrame, long_sequence: int = LONG_SEQUENCE
) -> DataFrame:
    """Training samples: a user's first two events are dropped, as they have too little history."""
    return user_history(ratings, movies, long_sequence).where(F.col("userRatingCount") > 1)


def rounded(samples: DataFrame, digits: int = 2) -> DataFrame:
    """Statistics rounded to the precision in which samples are stored."""
    present = [c for c in TWO_DECIMALS if c in samples.columns]
    return samples.withColumns({c: F.round(c, digits) for c in present})


def latest_per(samples: DataFrame, key: str, order: list[str], keep: list[str]) -> DataFrame:
    """The newest sample of each key.

    The rank filter runs before the shuffle too, so each task sends one row per key.
    """
    newest = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return (
        samples.withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") == 1)
        .select(key, "timestamp", *keep)
    )


def user_features_latest(samples: DataFrame) -> DataFrame:
    return latest_per(samples, "userId", USER_ORDER, USER_FEATURES)


def latest_user_features(ratings: DataFrame, movies: DataFrame) -> DataFrame:
    """The same rows from a user's last events alone: the newest and the frame before it.

    The rank filter runs before the shuffle, and one aggregate over at most HISTORY_ROWS + 1 rows
    takes the place of a frame for every event.
    """
    newest = W.partitionBy("userId").orderBy(*[F.desc(c) for c in USER_ORDER])
    last = ratings.withColumn("_rank", F.row_number().over(newest)).where(
        F.col("_rank") <= HISTORY_ROWS + 1
    )
    described = movies.select(
        "movieId",
        release_year(F.col("title")).alias("_year"),
        genre_list(F.col("genres")).alias("_genres"),
    )
    recent = join_lookup(add_label(last), described, "movieId", "left").withColumn(
        "releaseYear", F.coalesce("_year", F.lit(MISSING_YEAR))
    )
    past = F.col("_rank") > 1
    rating, year = F.col("rating"), F.col("releaseYear").cast("bigint")

    def total(x: Column) -> Column:
        return F.sum(F.when(past, x))

    item = F.struct((-F.col("_rank")).alias("_at"), "movieId", F.col("_genres").alias("genres"))
    framed = recent.groupBy("userId").agg(
        F.max("timestamp").alias("timestamp"),
        F.count_if(past).alias("_n"),
        total(rating).alias("_r1"),
        total(rating * rating).alias("_r2"),
        total(year).alias("_y1"),
        total(year * year).alias("_y2"),
        F.array_sort(F.collect_list(F.when(past & (F.col("label") == 1), item))).alias("_items"),
    )
    liked_items = F.transform(
        "_items", lambda x: F.struct(x["movieId"].alias("id"), x["genres"].alias("genres"))
    )
    known = framed.where(F.col("_n") > 1).withColumn("_liked", liked_items)
    return _history_columns(known).select("userId", "timestamp", *USER_FEATURES)


def latest_movie_features(
    ratings: DataFrame, movies: DataFrame, long_sequence: int = LONG_SEQUENCE
) -> DataFrame:
    """The newest sample of each movie from the events' positions in their users' sequences."""
    placed = number_sequences(
        ratings.select("userId", "movieId", "timestamp"), "userId", USER_ORDER, "_pos", long_sequence
    )
    seen = placed.where(F.col("_pos") > 1).groupBy("movieId").agg(F.max("timestamp").alias("timestamp"))
    return movie_profile(movies, ratings).join(seen, "movieId").select(
        "movieId", "timestamp", *MOVIE_FEATURES
    )


def movie_features_latest(samples: DataFrame) -> DataFrame:
    return latest_per(samples, "movieId", MOVIE_ORDER, MOVIE_FEATURES)
