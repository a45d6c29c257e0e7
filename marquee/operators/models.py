"""Models fitted with Spark ML on ratings, sequences and samples."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    MultilayerPerceptronClassifier,
)
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import (
    BucketedRandomProjectionLSH,
    FeatureHasher,
    StandardScaler,
    VectorAssembler,
    Word2Vec,
    Word2VecModel,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.functions.vectors import dot, sigmoid
from marquee.operators import factorisation, perceptron
from marquee.operators.encoders import CROSS_BUCKETS, NUMERIC, cross_bucket, crossed
from marquee.operators.factorisation import FactorisationModel
from marquee.operators.indexing import CategoryIndex
from marquee.operators.samples import MOVIE_GENRES, USER_GENRES
from marquee.operators.scoring import top_by_factors, top_by_product
from marquee.plans.lineage import fresh_path, materialize, reclaim, set_checkpoints

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Factorisation, item2vec, hashing search, validation and network parameters.
REGULARIZATION = 0.01
ALS_ITERATIONS = 5
RECOMMENDATIONS = 10
SUBSET = 3
EMBEDDING_SIZE = 10
WINDOW = 5
WORD2VEC_ITERATIONS = 10
SYNONYMS = 20
HASH_TABLES = 3
BUCKET_LENGTH = 0.1
NEIGHBOURS = 5
FOLDS = 10
HIDDEN = [128, 128]
WIDE_MOVIE = ["movieId", *MOVIE_GENRES]
FM_MOVIE = ["movieId", "genre0"]
FM_USER = ["userId", "userGenre0"]
# Slots of the hashed inputs: far more than crossed buckets, ids and genres together.
HASHED = 1 << 18
EPOCHS = 5


# ---- matrix factorisation ----
# Rows per block of factors and per training partition. Both follow the data and never the
# machine, as the result depends on them. A row of factors is sent to every block that needs it in
# each iteration, so blocks are as large as a task holds easily: 8 bytes a rating, 20 while built.
BLOCK_RATINGS = 12_000_000
PARTITION_ITEMS = 1_000_000


def als(ratings: DataFrame, seed: int = 7) -> ALS:
    """Unfitted model with as many blocks as `ratings` asks for.

    Each iteration writes its factors and deletes what the one before has shuffled.
    """
    set_checkpoints(ratings.sparkSession)
    n = max(10, -(-ratings.count() // BLOCK_RATINGS))
    return ALS(
        numUserBlocks=n,
        numItemBlocks=n,
        regParam=REGULARIZATION,
        maxIter=ALS_ITERATIONS,
        userCol="userId",
        itemCol="movieId",
        ratingCol="rating",
        coldStartStrategy="drop",
        checkpointInterval=1,
        seed=seed,
    )


def fit_als(ratings: DataFrame, train: DataFrame, seed: int = 7) -> ALSModel:
    """Model of `train` with the blocks of `ratings`, stored and read back.

    The fitted model holds on to all that its iterations have shuffled, the stored one to nothing.
    """
    spark = train.sparkSession
    path = fresh_path(spark, "als")
    als(ratings, seed).fit(train).write().save(path)
    reclaim(spark)
    return ALSModel.load(path)


class _Reclaiming(RegressionEvaluator):
    """Evaluator after whose work the files of earlier folds go."""

    def evaluate(self, dataset: DataFrame, params: dict | None = None) -> float:
        value = super().evaluate(dataset, params)
        reclaim(dataset.sparkSession)
        return value


def rmse_evaluator(made: type[RegressionEvaluator] = RegressionEvaluator) -> RegressionEvaluator:
    return made(labelCol="rating", predictionCol="prediction", metricName="rmse")


def factors(model: ALSModel) -> DataFrame:
    """Item and user factors in one table."""
    items = model.itemFactors.select(F.lit("item").alias("side"), "id", "features")
    return items.unionByName(model.userFactors.select(F.lit("user").alias("side"), "id", "features"))


def flat_recommendations(recs: DataFrame, key: str, other: str) -> DataFrame:
    """One row per recommendation, best first."""
    return recs.select(key, F.posexplode("recommendations").alias("_at", "_rec")).select(
        key,
        (F.col("_at") + 1).alias("position"),
        F.col("_rec")[other].alias(other),
        F.col("_rec")["rating"].alias("score"),
    )


def recommendations(model: ALSModel, key: str, other: str, k: int = RECOMMENDATIONS) -> DataFrame:
    """(key, position, other, score): the k best users or movies, as `other` says, of every `key`.

    The same lists as recommendForAllUsers and recommendForAllItems. Those score every pair of
    blocks in one product with a queue per row; here members that can't reach a list are screened
    out first.
    """
    sides = {"userId": model.userFactors, "movieId": model.itemFactors}
    seeds = sides[key].select(F.col("id").alias("_asked"), F.col("features").alias("emb"))
    pool = sides[other].select(F.col("id").alias("movieId"), F.col("features").alias("emb"))
    return top_by_factors(seeds, "_asked", pool, k).select(
        F.col("_asked").alias(key), "position", F.col("movieId").alias(other), "score"
    )


def first_ids(ratings: DataFrame, column: str, size: int = SUBSET) -> DataFrame:
    """The smallest distinct ids; a stable choice for the subset reports."""
    return ratings.select(column).distinct().orderBy(column).limit(size)


def cross_validate(train: DataFrame, folds: int = FOLDS, seed: int = 7) -> CrossValidatorModel:
    """Cross validation over the regularisation grid, on training data."""
    model = als(train, seed)
    grid = ParamGridBuilder().addGrid(model.regParam, [REGULARIZATION]).build()
    return CrossValidator(
        estimator=model,
        estimatorParamMaps=grid,
        evaluator=rmse_evaluator(_Reclaiming),
        numFolds=folds,
        seed=seed,
    ).fit(train)


def two_tower_scores(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """sigmoid(user . item) for each pair with both factors."""
    users = model.userFactors.select(F.col("id").alias("userId"), F.col("features").alias("_u"))
    items = model.itemFactors.select(F.col("id").alias("movieId"), F.col("features").alias("_v"))
    joined = pairs.join(users, "userId").join(items, "movieId")
    return joined.withColumn("score", sigmoid(dot(F.col("_u"), F.col("_v")))).drop("_u", "_v")


# ---- embeddings ----
def item2vec(
    sequences: DataFrame, column: str, seed: int = 7, least: int = 1
) -> Word2VecModel:
    """Skip-gram vectors of the items that occur at least `least` times.

    Partitions train side by side and are averaged after each iteration; Spark asks for at
    least as many partitions as iterations. A partition has about PARTITION_ITEMS items, so that
    each model that is averaged has seen enough.
    """
    items = sequences.agg(F.sum(F.size(column))).first()[0] or 0
    return Word2Vec(
        vectorSize=EMBEDDING_SIZE,
        windowSize=WINDOW,
        maxIter=WORD2VEC_ITERATIONS,
        numPartitions=max(WORD2VEC_ITERATIONS, -(-items // PARTITION_ITEMS)),
        minCount=least,
        inputCol=column,
        seed=seed,
    ).fit(sequences)


def vectors_of(model: Word2VecModel) -> DataFrame:
    return model.getVectors().select(
        F.col("word").try_cast("int").alias("movieId"),
        vector_to_array("vector", "float32").alias("emb"),
    )


def synonyms(vectors: DataFrame, k: int = SYNONYMS) -> DataFrame:
    """(item, position, movieId, similarity): the k nearest items of every item by cosine.

    The vocabulary meets itself chunk by chunk inside tasks, so it needn't fit anywhere in whole.
    """
    seeds = vectors.select(F.col("movieId").alias("item"), "emb")
    near = top_by_product(seeds, "item", vectors, k, drop_self=True)
    return near.withColumnRenamed("score", "similarity")


def nearest_by_hashing(
    embeddings: DataFrame, vector: list[float], k: int = NEIGHBOURS, seed: int = 7
) -> DataFrame:
    """The k approximately nearest movies of a vector by Euclidean distance."""
    dense = embeddings.select("movieId", array_to_vector("emb").alias("emb"))
    model = BucketedRandomProjectionLSH(
        inputCol="emb",
        outputCol="hashes",
        bucketLength=BUCKET_LENGTH,
        numHashTables=HASH_TABLES,
        seed=seed,
    ).fit(dense)
    found = model.approxNearestNeighbors(dense, Vectors.dense(vector), k, "distance")
    return found.select("movieId", "distance")


# ---- click models on samples ----
def _inputs(samples: DataFrame) -> DataFrame:
    texts = [*MOVIE_GENRES, *USER_GENRES]
    return (
        samples.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in NUMERIC})
        .withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in texts})
        .withColumn("crossed", F.coalesce(crossed().cast("string"), F.lit("none")))
        .withColumns({c: F.col(c).cast("string") for c in ("movieId", "userId")})
        .withColumn("label", F.col("label").cast("double"))
    )


def wide_model(train: DataFrame) -> PipelineModel:
    """Logistic regression on the crossed feature and the hashed categories."""
    hasher = FeatureHasher(
        inputCols=["crossed", *WIDE_MOVIE, *USER_GENRES], outputCol="features", numFeatures=HASHED
    )
    # the sparse inputs are 0/1, so they need no scaling
    fit = LogisticRegression(maxIter=EPOCHS * 4, regParam=REGULARIZATION, standardization=False)
    return Pipeline(stages=[hasher, fit]).fit(_inputs(train))


def wide_parts(
    model: PipelineModel, users: DataFrame, pool: DataFrame
) -> tuple[DataFrame, list[tuple[int, float]], list[float]]:
    """A wide model taken apart for (users, pool): rows (userId, base, crossed), the pool's
    (movieId, margin), and the margin of every crossed bucket, the one for no history last.

    `users` has userId, userRatedMovie0 and the user genres, `pool` movieId and the movie genres;
    the margins of a user, a movie and their bucket add up to the model's margin of the pair.
    """
    hasher, fitted = model.stages
    margin = vector_to_array("rawPrediction")[1]

    def margins(rows: DataFrame, columns: list[str]) -> DataFrame:
        blank = rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})
        part = hasher.copy({hasher.inputCols: columns})
        return fitted.transform(part.transform(blank)).withColumn("margin", margin)

    def alone(rows: DataFrame, columns: list[str], order: str) -> list:
        return margins(rows, columns).orderBy(order).select(order, "margin").collect()

    keyed = pool.withColumn("_id", F.col("movieId"))
    found = alone(keyed, WIDE_MOVIE, "_id")  # one row per pool movie
    ids = F.array(*[F.lit(r["_id"]) for r in found]).cast("array<int>")
    spark = users.sparkSession
    buckets = spark.range(CROSS_BUCKETS + 1).withColumn(
        "crossed",
        F.when(F.col("id") < CROSS_BUCKETS, F.col("id").cast("string")).otherwise("none"),
    )
    crosses = alone(buckets, ["crossed"], "id")
    newest = F.col("userRatedMovie0")
    bucket = F.transform(
        ids,
        lambda movie: F.coalesce(cross_bucket(movie, newest), F.lit(CROSS_BUCKETS)),
    )
    rows = margins(users, USER_GENRES).select(
        "userId", F.col("margin").alias("base"), bucket.alias("crossed")
    )
    intercept = float(fitted.intercept)
    return (
        rows,
        [(r["_id"], r["margin"] - intercept) for r in found],
        [r["margin"] - intercept for r in crosses],
    )


def fm_model(train: DataFrame, seed: int = 7) -> FactorisationModel:
    """Factorisation machine: first order and pairwise terms of ids and genres.

    The index space comes from the data, so no two values share a coefficient; coefficients are
    as many as there are values and stay in a table.
    """
    rows = _inputs(train)
    index = CategoryIndex.fit(rows, [*FM_MOVIE, *FM_USER])
    numbered = index.add(rows).select("label", *[f"_{c}" for c in index.known])
    return factorisation.fit(
        materialize(numbered, "indexed"),
        index,
        "movieId",
        "userId",
        factors=EMBEDDING_SIZE,
        steps=EPOCHS * 10,
        rate=0.05,
        decay=0.001,
        seed=seed,
    )


def fm_parts(
    model: FactorisationModel, users: DataFrame, pool: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(userId, emb) and (movieId, emb) whose inner product is the model's margin of a pair.

    With the factors of a side's values summed to s, a pair's margin is the margins of both sides
    alone plus the product of their sums: a user's vector is (s, own margin, 1), a movie's
    (s, 1, own margin), with the intercept on the user's side.
    """

    def side(rows: DataFrame, key: str, columns: list[str], extra: float, own_last: bool):
        texts = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns}
        asked = rows.withColumn("_key", F.col(key).cast("int")).withColumns(texts)
        names = [f"_{c}_coefficients" for c in columns]
        found = model.add(asked, columns).select(F.col("_key").alias(key), *names)

        def vectors(batches):
            for batch in batches:
                if not len(batch):
                    continue
                total, alone = factorisation.sums([batch[n] for n in names])
                own = extra + alone + (total * total).sum(axis=1) / 2
                one = np.ones(len(own))
                ends = [one, own] if own_last else [own, one]
                yield pd.DataFrame(
                    {
                        key: batch[key],
                        "emb": list(np.column_stack([total, *ends])),
                    }
                )

        return found.mapInPandas(vectors, f"{key} int, emb array<double>")

    return (
        side(users, "userId", FM_USER, model.intercept, False),
        side(pool, "movieId", FM_MOVIE, 0.0, True),
    )


class VectorModel:
    """A fitted pipeline behind vectors joined to users and movies."""

    def __init__(self, vectors: dict[str, DataFrame], widths: dict[str, int]) -> None:
        self.vectors, self.widths = vectors, widths
        self.model: PipelineModel | None = None

    @classmethod
    def of(cls, vectors: dict[str, DataFrame]) -> VectorModel:
        """`vectors` maps a key column to a table of (key, emb)."""
        stored, widths = {}, {}
        for key, table in vectors.items():
            text = F.col(key).cast("string").alias(key)
            named = table.select(text, F.col("emb").cast("array<double>").alias(f"_{key}_emb"))
            stored[key] = materialize(named, "vectors")
            widths[key] = stored[key].agg(F.max(F.size(f"_{key}_emb"))).first()[0] or 1
        return cls(stored, widths)

    def columns(self) -> list[str]:
        return [f"_{key}_vector" for key in self.vectors]

    def add(self, rows: DataFrame) -> DataFrame:
        """Attach each row's vectors; an unknown id has zeros."""
        for key, table in self.vectors.items():
            none = F.array_repeat(F.lit(0.0), self.widths[key])
            vector = array_to_vector(F.coalesce(f"_{key}_emb", none)).alias(f"_{key}_vector")
            rows = rows.join(table, key, "left").select("*", vector).drop(f"_{key}_emb")
        return rows

    def transform(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self.add(rows))


def mlp_model(
    train: DataFrame, vectors: dict[str, DataFrame] | None = None, seed: int = 7
) -> VectorModel:
    """Perceptron on the scaled numeric inputs, hashed genres, and vectors of ids.

    `vectors` maps movieId and userId to tables (id, emb), such as trained factors.
    """
    hashed = 32
    joined = VectorModel.of(vectors or {})
    stages = [
        FeatureHasher(inputCols=[*MOVIE_GENRES, *USER_GENRES], outputCol="_hashed", numFeatures=hashed),
        VectorAssembler(inputCols=NUMERIC, outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True),
        VectorAssembler(inputCols=["_scaled", "_hashed", *joined.columns()], outputCol="features"),
    ]
    layers = [len(NUMERIC) + hashed + sum(joined.widths.values()), *HIDDEN, 2]
    rows = materialize(joined.add(_inputs(train)), "joined") if vectors else _inputs(train)
    inputs = Pipeline(stages=stages).fit(rows)
    # Spark's own start, and a model of the weights: no iteration over one row of each class
    width = layers[0]
    blank = train.sparkSession.createDataFrame(
        [(Vectors.sparse(width, []), 0.0), (Vectors.sparse(width, []), 1.0)], ["features", "label"]
    )
    bare = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed)
    start = bare.fit(blank).weights.toArray()
    weights = perceptron.train(inputs.transform(rows), layers, start, EPOCHS * 4)
    fitted = bare.setInitialWeights(Vectors.dense(weights)).fit(blank)
    joined.model = PipelineModel(stages=[*inputs.stages, fitted])
    return joined


def factor_vectors(model: ALSModel) -> dict[str, DataFrame]:
    """Factors as the vectors of users and movies."""
    return {
        "movieId": model.itemFactors.select(F.col("id").alias("movieId"), F.col("features").alias("emb")),
        "userId": model.userFactors.select(F.col("id").alias("userId"), F.col("features").alias("emb")),
    }


def score(model: PipelineModel | FactorisationModel | VectorModel, samples: DataFrame) -> DataFrame:
    """Predictions of a fitted click model for whole sample tables."""
    return model.transform(_inputs(samples))
