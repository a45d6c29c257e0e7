"""Feature encodings as Spark ML transformers or plain columns."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    MinMaxScaler,
    OneHotEncoder,
    QuantileDiscretizer,
    VectorAssembler,
)
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize

# Buckets of the crossed feature and of the rating count.
CROSS_BUCKETS = 10_000
COUNT_BUCKETS = 100
# Words of a vocabulary that may become a model on the driver.
VOCABULARY = 100_000
# Multipliers and modulus of the hash of a pair of movies.
CROSS_FACTORS = (73_856_093, 19_349_663)
CROSS_PRIME = (1 << 31) - 1
NUMERIC = [
    "releaseYear",
    "movieRatingCount",
    "movieAvgRating",
    "movieRatingStddev",
    "userRatingCount",
    "userAvgRating",
    "userRatingStddev",
]


def one_hot_movie(movies: DataFrame) -> DataFrame:
    """Sparse one-hot vector of the movie id, with a slot for every id up to the largest."""
    encoder = OneHotEncoder(inputCols=["movieId"], outputCols=["vector"], dropLast=False)
    return encoder.fit(movies).transform(movies).select("movieId", "vector")


def sparse_parts(vector: Column | str) -> Column:
    """Struct (type, size, indices, values) of a Spark ML vector."""
    return F.unwrap_udt(vector)


def genre_indices(catalogue: DataFrame) -> DataFrame:
    """Genres by falling frequency, then name, numbered from 0."""
    counts = (
        catalogue.select(F.explode("genres").alias("genre"))
        .groupBy("genre")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    # one row per genre reaches the window
    order = W.orderBy(F.desc("cnt"), "genre")
    return counts.withColumn("genreIndex", F.row_number().over(order) - 1)


def multi_hot_genres(catalogue: DataFrame, limit: int = VOCABULARY) -> DataFrame:
    """movieId, sorted genre indices, vocabulary size and the sparse 0/1 vector.

    Movies without genres have an empty list. The vocabulary stays a table, whatever its size; up
    to `limit` words it also makes a model, whose vectors are built by the JVM. Beyond, the list
    of indices is the result and the vector is null.
    """
    known = materialize(genre_indices(catalogue).select("genre", "genreIndex"), "vocabulary")
    listed = catalogue.select("movieId", F.explode_outer("genres").alias("genre"))
    indexes = F.sort_array(F.collect_set("genreIndex"))
    hot = listed.join(known, "genre", "left").groupBy("movieId").agg(
        indexes.alias("genreIndexes"), F.collect_set("genre").alias("_genres")
    )
    size = known.count()
    sized = hot.withColumn("indexSize", F.lit(size).cast("int"))
    if not 0 < size <= limit:
        none = F.lit(None).cast(VectorUDT())
        return sized.drop("_genres").withColumn("vector", none)
    words = [r["genre"] for r in known.orderBy("genreIndex").collect()]
    model = CountVectorizerModel.from_vocabulary(words, "_genres", "vector")
    return model.transform(sized).drop("_genres")


def min_max(df: DataFrame, column: str, name: str) -> DataFrame:
    """Column scaled to [0, 1]; the bounds are one-row subqueries."""
    low, high = df.agg(F.min(column)).scalar(), df.agg(F.max(column)).scalar()
    span = F.nullif(high - low, F.lit(0.0))
    return df.withColumn(name, F.coalesce((F.col(column) - low) / span, F.lit(0.5)))


def count_discretizer(buckets: int = COUNT_BUCKETS) -> QuantileDiscretizer:
    return QuantileDiscretizer(
        numBuckets=buckets, inputCol="ratingCount", outputCol="ratingCountBucket"
    )


def rating_pipeline(movie_stats: DataFrame) -> PipelineModel:
    """Rating-count buckets and scaled average rating, fitted together."""
    stages = [
        count_discretizer(),
        VectorAssembler(inputCols=["avgRating"], outputCol="avgRatingVec"),
        MinMaxScaler(inputCol="avgRatingVec", outputCol="scaleAvgRating"),
    ]
    return Pipeline(stages=stages).fit(movie_stats)


def vocabulary_index(rows: DataFrame, column: str, words: DataFrame, name: str) -> DataFrame:
    """Position of `column` in a (genre, position) vocabulary, -1 when it is not in it."""
    known = words.select(F.col("genre").alias(column), F.col("position").alias(name))
    return rows.join(known, column, "left").withColumn(name, F.coalesce(name, F.lit(-1)))


def id_column(rows: DataFrame, column: str, name: str, space: str) -> DataFrame:
    """An id as a category: itself below the largest known id + 1, which is its space, else 0."""
    size = rows.agg((F.max(column) + 1).cast("int")).scalar()
    known = F.col(column).between(0, size - 1)
    return rows.withColumns({name: F.when(known, F.col(column)).otherwise(0), space: size})


def cross_bucket(movie: Column, newest: Column, buckets: int = CROSS_BUCKETS) -> Column:
    """Bucket of a pair of movies in integer arithmetic that any engine has."""
    a, b = CROSS_FACTORS
    mixed = movie.cast("bigint") * a + newest.cast("bigint") * b
    return (F.pmod(mixed, F.lit(CROSS_PRIME)) % buckets).cast("int")


def crossed(buckets: int = CROSS_BUCKETS) -> Column:
    """Bucket of the movie together with the newest liked movie; NULL without history."""
    return cross_bucket(F.col("movieId"), F.col("userRatedMovie0"), buckets)


def cross_counts(samples: DataFrame) -> DataFrame:
    """How often each movie follows each newest liked movie, and how often it was liked."""
    return (
        samples.where(F.col("userRatedMovie0").isNotNull())
        .groupBy("movieId", "userRatedMovie0")
        .agg(F.count(F.lit(1)).alias("cnt"), F.sum("label").alias("likedCnt"))
    )


def numeric_features(samples: DataFrame) -> DataFrame:
    """The seven numeric inputs with missing values as 0."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in NUMERIC]
    return samples.select("userId", "movieId", "label", *filled)
