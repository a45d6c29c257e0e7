"""Index spaces, vectors as inputs, factorisation by parts, and neighbours of all items."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from marquee.operators import factorisation, models, neighbours, perceptron, ranking, recall, samples, splits
from marquee.operators.evaluation import classification_metrics
from marquee.operators.indexing import CategoryIndex
from marquee.sources.tables import parse_movies
from marquee.sources.vector_store import VectorStore


def test_no_two_values_share_a_position(spark):
    n = 300_000
    rows = spark.range(n).select(
        F.concat(F.lit("u"), "id").alias("userId"), (F.col("id") % 7).cast("string").alias("genre")
    )
    index = CategoryIndex.fit(rows, ["userId", "genre"])
    assert index.sizes == {"userId": n, "genre": 7}
    assert index.offsets == {"userId": 0, "genre": n + 1} and index.width == n + 1 + 8
    placed = index.add(rows).select(index.slots(["userId", "genre"]).alias("at"))
    used = placed.select(F.explode("at").alias("at"))
    low, high, distinct = used.agg(F.min("at"), F.max("at"), F.countDistinct("at")).first()
    assert (low, high, distinct) == (0, n + 7, n + 7)


def test_unknown_and_null_values_have_a_position_of_their_own(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    index = CategoryIndex.fit(rows, ["x"])
    asked = spark.createDataFrame([("b",), ("?",), (None,)], "x string")
    assert sorted(r["_x"] for r in index.add(asked).collect()) == [1, 2, 2]
    from pyspark.ml import Pipeline

    pipe = Pipeline(stages=index.stages("f")).fit(index.add(rows.where("x is not null")))
    hot = pipe.transform(index.add(asked)).select("x", vector_to_array("f").alias("v")).collect()
    assert {r["x"]: r["v"] for r in hot} == {"b": [0, 1, 0], "?": [0, 0, 1], None: [0, 0, 1]}


def test_blocks_of_factors_are_few(spark):
    """Every block that needs a row of factors is sent it in each iteration."""
    assert models.als(spark.range(1000)).getNumUserBlocks() == 10
    assert models.als(spark.range(216_000_000)).getNumItemBlocks() == 18


@pytest.fixture(scope="module")
def clicks(make_ratings, make_movies):
    """Users of even number like movies of even number; genres tell nothing."""
    ratings = make_ratings(
        [(u, m, 5.0 if (u + m) % 2 else 1.0, (u * 7 + m * 13) % 97) for u in range(40) for m in range(30)]
    )
    movies = make_movies([(m, f"M ({1990 + m % 3})", "Same") for m in range(30)])
    return ratings, movies


def test_perceptron_learns_from_vectors(clicks):
    ratings, movies = clicks
    rows = samples.mixed_samples(ratings, movies).cache()
    train, test = splits.hash_split(rows)
    known, _ = splits.hash_split(ratings)
    vectors = models.factor_vectors(models.als(known).fit(known))
    without = classification_metrics(models.score(models.mlp_model(train), test))
    with_them = classification_metrics(models.score(models.mlp_model(train, vectors), test))
    assert with_them["rocAuc"] > without["rocAuc"] + 0.1
    assert with_them["rocAuc"] > 0.9


def test_unknown_ids_have_zero_vectors(spark):
    joined = models.VectorModel.of(
        {"movieId": spark.createDataFrame([(1, [1.0, 2.0])], "movieId int, emb array<float>")}
    )
    asked = spark.createDataFrame([("1",), ("2",), (None,)], "movieId string")
    got = {r[0]: r[1] for r in joined.add(asked).select("movieId", vector_to_array("_movieId_vector")).collect()}
    assert got == {"1": [1.0, 2.0], "2": [0.0, 0.0], None: [0.0, 0.0]}


def test_factorisation_by_parts(spark, clicks):
    """Inner products give the model's own probability for every pair, unknown users included."""
    ratings, movies = clicks
    model = models.fm_model(samples.mixed_samples(ratings, movies))
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 999)], "userId int")
    user_features = samples.latest_user_features(ratings, movies)
    movie_features = samples.latest_movie_features(ratings, movies)
    scored = ranking.scored_movies(parse_movies(movies), ratings)
    found = recall.recommend_by_factorisation(
        model, users, user_features, movie_features, scored, 8, pool_size=20
    ).collect()
    pool = ranking.top_movies(scored, "averageRating", 20).select("movieId")
    pairs = (
        users.crossJoin(pool)
        .join(user_features.drop("timestamp"), "userId", "left")
        .join(movie_features.drop("timestamp"), "movieId", "left")
        .withColumn("label", F.lit(0))
    )
    probability = vector_to_array("probability")[1].alias("p")
    wanted = {
        (int(r.userId), int(r.movieId)): r.p
        for r in models.score(model, pairs).select("userId", "movieId", probability).collect()
    }
    assert len(found) == 4 * 8
    for r in found:
        assert r.score == pytest.approx(wanted[r.userId, r.movieId], abs=1e-6)
        better = [p for (u, m), p in wanted.items() if u == r.userId and p > r.score + 1e-6]
        assert len(better) < r.position


def test_synonyms_of_every_item(spark):
    rnd = np.random.default_rng(2)
    sequences = spark.createDataFrame(
        [([str(int(x)) for x in rnd.integers(0, 30, 12)],) for _ in range(200)], "words array<string>"
    )
    model = models.item2vec(sequences, "words")
    vectors = models.vectors_of(model)
    found = {}
    for r in models.synonyms(vectors, 5).orderBy("item", "position").collect():
        found.setdefault(r["item"], []).append((r["movieId"], r["similarity"]))
    assert len(found) == 30
    for item in (0, 7, 29):
        wanted = [(int(r["word"]), r["similarity"]) for r in model.findSynonyms(str(item), 5).collect()]
        assert [m for m, _ in found[item]] == [m for m, _ in wanted]
        assert [s for _, s in found[item]] == pytest.approx([s for _, s in wanted], abs=1e-5)


# ---- neighbours ----
def exact_lists(rows, k):
    ids = np.array([i for i, _ in rows])
    points = np.array([v for _, v in rows], float)
    out = {}
    for i, p in zip(ids, points):
        d = np.round(np.sqrt(((points - p) ** 2).sum(axis=1)), 6)
        out.setdefault(i, sorted((x, j) for x, j in zip(d, ids) if j != i)[:k])
    return out


def lists_of(df):
    out = {}
    for r in df.orderBy("movieId", "position").collect():
        out.setdefault(r["movieId"], []).append((r["distance"], r["neighbour"]))
    return out


@pytest.mark.parametrize("chunk", [64, 2_048])
def test_neighbours_of_clusters_and_copies(spark, chunk):
    rnd = np.random.default_rng(3)
    centres = rnd.standard_normal((12, 8)) * 20
    rows = [(i, (centres[i % 12] + rnd.standard_normal(8)).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0] * 8) for i in range(40)]  # a crowd of equal vectors
    rows += [(2000, [0.0] * 8)]
    odd = [(3000, None), (3001, [float("nan")] * 8), (3002, [1.0]), (None, [1.0] * 8), (3003, [])]
    df = spark.createDataFrame(rows + odd, "movieId int, emb array<double>")
    found = lists_of(neighbours.nearest_for_all(df, 5, chunk=chunk))
    wanted = exact_lists(rows, 5)
    assert set(found) == set(wanted)
    hits = sum(len(set(found[i]) & set(wanted[i])) for i in wanted)
    assert hits >= 0.95 * 5 * len(wanted)
    for i in range(1000, 1040):
        assert found[i] == wanted[i]
    for i, near in found.items():
        assert near == sorted(near) and len({j for _, j in near} | {i}) == len(near) + 1


def test_a_block_compares_few_pairs_exactly():
    """Only pairs that can reach a list are subtracted; ties after rounding are among them."""
    rnd = np.random.default_rng(4)
    points = rnd.standard_normal((600, 16))
    points[400:500] = points[0] + rnd.standard_normal((100, 16)) * 1e-8  # equal after rounding
    points[500] = 1e-160
    other = ~np.eye(600, dtype=bool)
    row, column = neighbours._near(points[100:400], points, other[100:400], 5)
    assert len(row) <= 2 * 5 * 300
    rows = [(int(i), p.tolist()) for i, p in enumerate(points)]
    for scale in (1.0, 1e3, 1e160):  # the last has squares that are too long
        ids = np.tile(np.arange(600), 2)
        block = pd.DataFrame({"movieId": ids, "emb": [*(points * scale)] * 2, "asks": np.arange(1200) >= 600})
        with np.errstate(over="ignore"):
            found = neighbours._compared(5)(block)
            wanted = exact_lists([(i, np.array(p) * scale) for i, p in rows], 5)
        lists = {i: list(zip(g["distance"], g["neighbour"])) for i, g in found.groupby("movieId", sort=False)}
        assert lists == {i: near for i, w in wanted.items() if (near := [x for x in w if np.isfinite(x[0])])}


def test_cells_and_probes():
    places = np.array([[0.1, 5.8], [-0.5, 2.5]])
    own, looked = neighbours._cells(places, 2)
    assert own.tolist() == [[0, 5], [-1, 2]]
    # nearest borders: below on the first axis, above on the second
    assert looked[0].tolist() == [[0, 5], [-1, 5], [0, 6]]
    assert len({tuple(c) for c in looked[1].tolist()}) == 3


def test_no_neighbours(spark):
    none = spark.createDataFrame([], "movieId int, emb array<float>")
    assert neighbours.nearest_for_all(none, 5).count() == 0
    alone = spark.createDataFrame([(1, [1.0, 2.0])], "movieId int, emb array<float>")
    assert neighbours.nearest_for_all(alone, 5).count() == 0


def test_vector_store_replaces_as_a_whole(spark, tmp_path):
    store = VectorStore(spark, str(tmp_path / "store"))
    assert store.read("i2vEmb").count() == 0
    one = spark.createDataFrame([(1, [0.1, 2.0]), (2, [3.0, -1e-20])], "movieId int, emb array<float>")
    store.write(one, "i2vEmb")
    store.write(one.where("movieId = 1").withColumnRenamed("movieId", "userId"), "uEmb", "userId")
    assert sorted(map(tuple, store.read("i2vEmb").collect())) == sorted(map(tuple, one.collect()))
    assert [r.userId for r in store.read("uEmb", "userId").collect()] == [1]
    store.write(one.where("movieId = 2"), "i2vEmb")
    # a version that was never pointed at isn't seen
    one.selectExpr("'i2vEmb:9' AS key", "'1.0' AS value").write.parquet(str(tmp_path / "store/i2vEmb/half"))
    assert [r.movieId for r in store.read("i2vEmb").collect()] == [2]


# ---- files of finished work ----
def shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return sum("shuffle_" in str(f) for f in str(blocks.getAllFiles().mkString("\n")).split("\n"))


def settled(spark, most):
    """Files left, once Spark's cleaner, which works beside, has come down to `most` or 10 s are over."""
    for _ in range(20):
        left = shuffle_files(spark)
        if left <= most:
            break
        time.sleep(0.5)
    return left


def test_stored_factors_are_those_of_the_fit(clicks):
    ratings, _ = clicks
    model = models.fit_als(ratings, ratings)
    wanted = models.als(ratings).fit(ratings)
    assert sorted(map(tuple, models.factors(model).collect())) == sorted(
        map(tuple, models.factors(wanted).collect())
    )
    # nothing of the fit is needed any more
    assert model.userFactors.inputFiles() and not wanted.userFactors.inputFiles()
    assert model.transform(ratings).count() == ratings.count()


def test_folds_leave_no_files(spark, clicks):
    """Ten blocks are shuffled in each iteration of each fold; the folds' files don't add up."""
    ratings, _ = clicks
    before = shuffle_files(spark)
    fitted = models.cross_validate(ratings, folds=4)
    assert settled(spark, before + 400) <= before + 400  # 918 when all are kept
    assert fitted.avgMetrics[0] > 0


# ---- factorisation machine in blocks ----
def test_random_start_is_that_of_java(spark):
    rnd = spark.sparkContext._jvm.java.util.Random(7)
    wanted = [rnd.nextGaussian() for _ in range(300)]
    before = factorisation._accepted(spark, 7, 150)
    assert factorisation._gaussians(7, before, 0, 300) == pytest.approx(wanted, rel=1e-13)
    assert factorisation._gaussians(7, before, 31, 150) == pytest.approx(wanted[31:150], rel=1e-13)
    pairs = factorisation._pairs(7, 0, 4000)
    assert factorisation._pairs(7, 1000, 3000) == pytest.approx(pairs[len(pairs) - len(factorisation._pairs(7, 1000, 3000)) :])


@pytest.mark.parametrize("cell", [factorisation.CELL, 40])
def test_same_model_as_spark_fits(spark, clicks, cell, monkeypatch):
    """Many blocks and dealt cells give the probabilities of a fit with all coefficients at hand."""
    monkeypatch.setattr(factorisation, "CELL", cell)
    ratings, movies = clicks
    train, test = splits.hash_split(samples.mixed_samples(ratings, movies))
    rows = models._inputs(train).cache()
    index = CategoryIndex.fit(rows, [*models.FM_MOVIE, *models.FM_USER])
    fit = FMClassifier(factorSize=10, maxIter=4, stepSize=0.05, regParam=0.001, seed=7)
    wanted = Pipeline(stages=[*index.stages("features"), fit]).fit(index.add(rows))
    model = factorisation.fit(index.add(rows), index, "movieId", "userId", 10, 4, 0.05, 0.001, 7)
    asked = models._inputs(test).withColumn(
        "userId", F.when(F.col("movieId") == "3", "stranger").otherwise(F.col("userId"))
    )
    columns = ["movieId", "userId", vector_to_array("probability")[1].alias("p"), "prediction"]
    one = sorted(map(tuple, wanted.transform(index.add(asked)).select(*columns).collect()))
    two = sorted(map(tuple, model.transform(asked).select(*columns).collect()))
    assert [r[:2] for r in one] == [r[:2] for r in two]
    assert np.array([r[2:] for r in two]) == pytest.approx(np.array([r[2:] for r in one]), abs=1e-9)
    for name in ("linear", "factors"):
        assert not hasattr(model, name)  # nothing as long as the index is on the driver


# ---- perceptron ----
def test_same_perceptron_as_spark_trains(spark):
    rnd = np.random.default_rng(5)
    x = np.column_stack([rnd.standard_normal((1000, 3)), rnd.integers(0, 3, (1000, 2))])
    rows = [(Vectors.dense(r), float(r[0] * r[1] + r[3] > 1)) for r in x]
    df = spark.createDataFrame(rows, ["features", "label"]).repartition(3).cache()
    network = MultilayerPerceptronClassifier(layers=[5, 6, 4, 2], seed=7, maxIter=20)
    start = network.copy({network.maxIter: 0}).fit(df).weights.toArray()
    wanted = network.fit(df).weights.toArray()
    assert perceptron.train(df, [5, 6, 4, 2], start, 0) == pytest.approx(start)
    assert perceptron.train(df, [5, 6, 4, 2], start, 20) == pytest.approx(wanted, rel=1e-5, abs=1e-6)
    # columns that single numbers hold are packed as such
    kinds = perceptron.pack(df).select("kinds").distinct().collect()
    assert [r[0] for r in kinds] == ["f8,f8,f8,i1,i1"]


def test_packed_samples_lose_nothing():
    rows = np.array([[1.0, 0.1, 1e300, np.nan], [-3.0, 0.5, 2.0, 1.0]])
    packed = perceptron._packed(np.array([1.0, 0.0]), rows)
    labels, found = perceptron._unpacked(**packed)
    assert labels.tolist() == [1, 0] and np.array_equal(found, rows, equal_nan=True)
    assert packed["kinds"] == "i1,f8,f8,f4"
