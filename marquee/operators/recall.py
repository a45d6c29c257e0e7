"""Candidate retrieval and ranking for all movies or all users at once."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions import traffic
from marquee.functions.vectors import sigmoid
from marquee.operators.factorisation import FactorisationModel
from marquee.operators.models import fm_parts, wide_parts
from marquee.operators.ranking import top_movies, top_per
from marquee.operators.samples import liked
from marquee.operators.scoring import top_by_parts, top_by_product
from marquee.plans.lineage import materialize
from marquee.plans.skew import join_lookup

# Movies recalled per genre for a similar-movie list and for a user, from the
# two global lists, the ranking pool and the pool of similar movies; weights of the genre score.
SIMILAR_PER_GENRE = 100
HISTORY_PER_GENRE = 20
GLOBAL_LIST = 100
RANKING_POOL = 800
EMBEDDING_POOL = 10_000
GENRE_WEIGHT = 0.7
RATING_WEIGHT = 0.3
RATING_SCALE = 5


def genre_score(seed_genres: Column, genres: Column, average: Column) -> Column:
    """Weighted genre overlap and candidate rating.

    The overlap is common / (|A| + |B|) / 2, so identical genre lists reach 0.25.
    """
    common = F.size(F.array_intersect(seed_genres, genres)).cast("double")
    sizes = F.size(seed_genres) + F.size(genres)
    overlap = F.when(sizes > 0, common / F.nullif(sizes, F.lit(0)) / 2).otherwise(0.0)
    return overlap * GENRE_WEIGHT + average / RATING_SCALE * RATING_WEIGHT


def genre_pool(scored: DataFrame, per_genre: int) -> DataFrame:
    """(genre, movieId): the best rated movies of each genre."""
    rows = scored.select(F.explode("genres").alias("genre"), "movieId", "averageRating")
    order = [F.desc("averageRating"), F.col("movieId")]
    return top_per(rows, "genre", order, per_genre).select("genre", "movieId")


def recall_by_genre(
    profiles: DataFrame, scored: DataFrame, per_genre: int = SIMILAR_PER_GENRE
) -> DataFrame:
    """(profile, movieId) with the movie's genres and rating: the best of each profile genre.

    A profile is a sorted genre list. A movie found through several genres is kept for the
    first one only, which needs no shuffle: it carries the genres it was listed under.
    """
    pool = genre_pool(scored, per_genre)
    listed = pool.groupBy("movieId").agg(F.collect_set("genre").alias("_listed"))
    members = pool.join(listed, "movieId").join(
        scored.select("movieId", "genres", "averageRating"), "movieId"
    )
    wanted = profiles.select("profile", F.explode("profile").alias("genre"))
    first = F.get(F.array_intersect("profile", "_listed"), F.lit(0))
    # genres x per_genre rows; once written, Spark sees that they fit a broadcast
    return (
        wanted.join(materialize(members, "pool"), "genre")
        .where(first == F.col("genre"))
        .select("profile", "movieId", "genres", "averageRating")
    )


def similar_movies_by_genre(
    scored: DataFrame, size: int, per_genre: int = SIMILAR_PER_GENRE
) -> DataFrame:
    """Each movie's `size` best candidates by genre score.

    The score depends on the seed's genres only, so candidates are ranked once per distinct
    genre list and not once per movie. One more than `size` is kept, as a seed drops itself.
    """
    seeds = scored.select(
        F.col("movieId").alias("seed"), F.sort_array("genres").alias("profile")
    )
    recalled = recall_by_genre(seeds.select("profile").distinct(), scored, per_genre)
    score = genre_score(F.col("profile"), F.col("genres"), F.col("averageRating"))
    rows = recalled.select("profile", "movieId", score.alias("score"))
    best = top_per(rows, "profile", [F.desc("score"), F.col("movieId")], size + 1)
    candidate = F.struct("position", "movieId", "score")
    lists = best.groupBy("profile").agg(F.sort_array(F.collect_list(candidate)).alias("_list"))
    others = F.filter("_list", lambda c: c["movieId"] != F.col("seed"))
    return (
        join_lookup(seeds, lists, "profile")
        .select("seed", F.posexplode(F.slice(others, 1, size)).alias("_at", "_c"))
        .select(
            "seed",
            F.col("_c.movieId").alias("movieId"),
            F.col("_c.score").alias("score"),
            (F.col("_at") + 1).alias("position"),
        )
    )


def multi_recall(ratings: DataFrame, catalogue: DataFrame, scored: DataFrame) -> DataFrame:
    """(userId, movieId) from three lists, without what the user has rated.

    The lists are the best of each genre in the history, the best rated and the newest
    movies. Lists and the part of a history that can occur in them meet as one short array
    per user, so candidates become rows only at the very end, already distinct.
    """
    pool = genre_pool(scored, HISTORY_PER_GENRE)
    lists = pool.groupBy("genre").agg(F.collect_list("movieId").alias("_ids"))
    best = top_movies(scored, "averageRating", GLOBAL_LIST)
    newest = top_movies(scored, "releaseYear", GLOBAL_LIST)
    both = best.select("movieId").union(newest.select("movieId")).distinct()
    ids = sorted(r[0] for r in both.collect())  # at most 2 x GLOBAL_LIST
    everywhere = F.array(*[F.lit(i) for i in ids]).cast("array<int>")

    # one pass over the ratings finds each user's genres and what of the lists has been seen
    recallable = pool.select("movieId").union(both).distinct().withColumn("_listed", F.lit(True))
    described = catalogue.select("movieId", "genres").join(recallable, "movieId", "full")
    seen = join_lookup(ratings.select("userId", "movieId"), described, "movieId", "left")
    # no longer than the genres and the lists, however many movies a user has rated
    history = materialize(
        seen.groupBy("userId").agg(
            F.array_distinct(F.flatten(F.collect_set("genres"))).alias("_genres"),
            F.collect_set(F.when(F.col("_listed"), F.col("movieId"))).alias("_seen"),
        ),
        "history",
    )
    user_genres = history.select("userId", F.explode("_genres").alias("genre"))
    by_genre = (
        join_lookup(user_genres, lists, "genre")
        .groupBy("userId")
        .agg(F.flatten(F.collect_list("_ids")).alias("_genre"))
    )
    none = F.array().cast("array<int>")
    candidates = F.array_union(F.coalesce("_genre", none), everywhere)
    return history.join(by_genre, "userId", "left").select(
        "userId", F.explode(F.array_except(candidates, "_seen")).alias("movieId")
    )


def similar_movies_by_embedding(
    scored: DataFrame, embeddings: DataFrame, size: int, pool_size: int = EMBEDDING_POOL
) -> DataFrame:
    """Each embedded movie's nearest movies among the best rated `pool_size`."""
    best = top_movies(scored, "averageRating", pool_size).select("movieId")
    pool = best.join(embeddings, "movieId")
    seeds = embeddings.join(scored.select("movieId"), "movieId", "left_semi")
    seeds = seeds.select(F.col("movieId").alias("seed"), "emb")
    return top_by_product(seeds, "seed", pool, size, drop_self=True)


def user_embeddings(ratings: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Mean vector of a user's liked movies that have one.

    The vectors are summed in the JVM with partial sums per task; no dimension becomes a row.
    """
    vectors = embeddings.select("movieId", array_to_vector("emb").alias("_v"))
    return (
        ratings.where(liked(F.col("rating")))
        .join(vectors, "movieId")
        .groupBy("userId")
        .agg(vector_to_array(Summarizer.mean(F.col("_v"))).alias("emb"))
    )


def recommend_for_users(
    users: DataFrame,
    user_vectors: DataFrame,
    scored: DataFrame,
    embeddings: DataFrame,
    size: int,
    pool_size: int = RANKING_POOL,
) -> DataFrame:
    """Each user's `size` best movies of the ranking pool by cosine."""
    pool = top_movies(scored, "averageRating", pool_size).select("movieId")
    pool = pool.join(embeddings, "movieId", "left")
    seeds = users.select("userId").join(user_vectors, "userId", "left")
    return top_by_product(seeds, "userId", pool, size)


def recommend_by_factors(
    user_factors: DataFrame,
    item_factors: DataFrame,
    scored: DataFrame,
    size: int,
    pool_size: int = RANKING_POOL,
) -> DataFrame:
    """The same pool ranked by the dot product of trained factors, as a probability.

    Both factor tables have `id` and `features`. Pool movies the model has never seen are left
    out, as are unknown users.
    """
    pool = top_movies(scored, "averageRating", pool_size).select("movieId")
    items = item_factors.select(F.col("id").alias("movieId"), F.col("features").alias("emb"))
    users = user_factors.select(F.col("id").alias("userId"), F.col("features").alias("emb"))
    best = top_by_product(users, "userId", pool.join(items, "movieId"), size, normalized=False)
    return best.withColumn("score", sigmoid(F.col("score")))


def recommend_by_click_model(
    model: PipelineModel,
    users: DataFrame,
    user_features: DataFrame,
    movie_features: DataFrame,
    scored: DataFrame,
    size: int,
    pool_size: int = RANKING_POOL,
) -> DataFrame:
    """The same pool ranked by a linear click model, for every user.

    The model's margin is a sum of a user part, a movie part and one crossed term, so users and
    pool are each scored once and meet in blocks; pairs never become rows. Users and movies
    without features count with missing values.
    """
    pool = top_movies(scored, "averageRating", pool_size).select("movieId")
    parts = wide_parts(
        model, users.select("userId").join(user_features, "userId", "left"),
        pool.join(movie_features, "movieId", "left"),
    )
    return top_by_parts(*parts, size)


def recommend_by_factorisation(
    model: FactorisationModel,
    users: DataFrame,
    user_features: DataFrame,
    movie_features: DataFrame,
    scored: DataFrame,
    size: int,
    pool_size: int = RANKING_POOL,
) -> DataFrame:
    """The same pool ranked by a factorisation machine, for every user.

    Its margin is one inner product of a user's and a movie's vector, so the block scorer ranks it
    and pairs never become rows. Users and movies without features count with missing values.
    """
    pool = top_movies(scored, "averageRating", pool_size).select("movieId")
    user_vectors, movie_vectors = fm_parts(
        model,
        users.select("userId").join(user_features, "userId", "left"),
        pool.join(movie_features, "movieId", "left"),
    )
    best = top_by_product(user_vectors, "userId", movie_vectors, size, normalized=False)
    return best.withColumn("score", sigmoid(F.col("score")))


def rank_scored_pairs(scored_pairs: DataFrame, size: int) -> DataFrame:
    """Each user's `size` best candidates among pairs a model has scored."""
    rows = scored_pairs.select("userId", "movieId", "score")
    return top_per(rows, "userId", [F.desc("score"), F.col("movieId")], size)


def routed_users(users: DataFrame, testing: bool = True) -> DataFrame:
    """Users with their bucket, routed model and the scorer behind it."""
    model = traffic.routed_model(F.col("userId"), testing)
    return (
        users.select("userId", traffic.bucket(F.col("userId")).alias("bucket"))
        .withColumn("model", model)
        .withColumn("scorer", traffic.scorer(F.col("model")))
    )
