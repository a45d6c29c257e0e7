import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from marquee.operators import models, ranking, recall, samples, scoring
from marquee.sources.tables import parse_movies


@pytest.fixture(scope="module")
def movies(make_movies):
    genres = ["Action", "Drama|Action", "War", "War|Drama|Action"]
    return make_movies([(m, f"M{m} ({1950 + m * 7 % 40})", genres[m % 4]) for m in range(40)])


@pytest.fixture(scope="module")
def catalogue(movies):
    return parse_movies(movies)


@pytest.fixture(scope="module")
def ratings(make_ratings):
    return make_ratings(
        [(u, (u * 3 + k * 5) % 40, 0.5 + ((u + k) % 10) / 2, k) for u in range(12) for k in range(7)]
    )


def test_list_pages_overlap_at_the_end(spark):
    rows = [(1, r) for r in range(1, 17)] + [(2, r) for r in range(1, 4)]
    pages = ranking.list_pages(spark.createDataFrame(rows, "userId int, position int"), "userId", "position")
    shown = {}
    for r in pages.collect():
        shown.setdefault((r.userId, r.page), []).append(r.position)
    assert {k: sorted(v) for k, v in shown.items()} == {
        (1, 1): list(range(1, 8)),
        (1, 2): list(range(8, 15)),
        (1, 3): list(range(10, 17)),
        (2, 1): [1, 2, 3],
    }


def test_genre_pages_are_disjoint_and_whole(catalogue):
    pages = [ranking.genre_page(catalogue, p, 6).collect() for p in range(1, 7)]
    seen = [(r.genre, r.movieId) for page in pages for r in page]
    assert len(seen) == len(set(seen))
    assert len(seen) == catalogue.select(F.explode("genres")).count()


def test_unrated_movies_score_zero(catalogue, make_ratings):
    scored = ranking.scored_movies(catalogue, make_ratings([(1, 5, 4.0, 1)]))
    by_id = {r.movieId: r.averageRating for r in scored.collect()}
    assert by_id[5] == 4.0 and by_id[6] == 0.0
    shown = ranking.display_rating(scored.where("movieId = 5")).first()
    assert shown.displayRating == 4.0


def test_home_page(catalogue):
    out = ranking.home_page(catalogue, genres=2, movies=3).collect()
    assert {r.genre for r in out} == {"Action", "Drama"}
    assert len(out) == 6


def brute_similar(scored, size, per_genre):
    pool = {}
    for m in sorted(scored.values(), key=lambda r: (-r.averageRating, r.movieId)):
        for g in m.genres:
            pool.setdefault(g, []).append(m.movieId)
    out = {}
    for seed in scored.values():
        found = {c for g in seed.genres for c in pool[g][:per_genre]} - {seed.movieId}
        score = {}
        for c in found:
            common = len(set(seed.genres) & set(scored[c].genres))
            overlap = common / (len(seed.genres) + len(scored[c].genres)) / 2
            score[c] = overlap * 0.7 + scored[c].averageRating / 5 * 0.3
        out[seed.movieId] = sorted(found, key=lambda c: (-score[c], c))[:size]
    return out


def test_similar_by_genre_against_brute_force(catalogue, ratings):
    scored = ranking.scored_movies(catalogue, ratings)
    local = {r.movieId: r for r in scored.collect()}
    for size, per_genre in ((5, 4), (3, 100), (50, 6)):
        found = {}
        rows = recall.similar_movies_by_genre(scored, size, per_genre)
        for r in rows.orderBy("seed", "position").collect():
            found.setdefault(r.seed, []).append(r.movieId)
        assert found == brute_similar(local, size, per_genre)


def test_multi_recall_leaves_out_the_history(catalogue, ratings):
    scored = ranking.scored_movies(catalogue, ratings)
    out = recall.multi_recall(ratings, catalogue, scored)
    assert out.count() == out.distinct().count()
    assert out.join(ratings, ["userId", "movieId"], "left_semi").count() == 0
    # all 40 movies are among the newest 100, so everything unseen is recalled
    assert out.count() == 12 * 40 - ratings.select("userId", "movieId").distinct().count()


def test_top_by_product_against_brute_force(spark):
    rng = np.random.default_rng(3)
    pool = [(i, rng.normal(size=6).tolist()) for i in range(60)] + [(60, None), (61, [1.0])]
    pool.append((62, pool[7][1]))
    seeds = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(40, None)]
    seeds[7] = (7, pool[7][1])
    out = scoring.top_by_product(
        spark.createDataFrame(seeds, "seed int, emb array<double>").repartition(3),
        "seed",
        spark.createDataFrame(pool, "movieId int, emb array<double>"),
        5,
        drop_self=True,
    )
    found = {}
    for r in out.orderBy("seed", "position").collect():
        found.setdefault(r.seed, []).append((r.movieId, r.score))

    def score(a, b):
        if a is None or b is None or len(a) != len(b):
            return -1.0
        a, b = np.array(a), np.array(b)
        return round(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)), 6)

    for seed, vector in dict(seeds).items():
        ranked = sorted(((-score(vector, v), m) for m, v in pool if m != seed))[:5]
        assert [m for m, _ in found[seed]] == [m for _, m in ranked]
    assert [s for _, s in found[40]] == [-1.0] * 5


@pytest.mark.parametrize("normalized", [True, False])
def test_pool_beyond_a_block(spark, monkeypatch, normalized):
    """Scored in blocks, a pool gives the same lists, ties, missing and zero vectors included."""
    rows = [(i, [float(i % 5), float(i % 3 - 1)] if i % 7 else None) for i in range(40)]
    pool = spark.createDataFrame(rows, "movieId int, emb array<double>")
    seeds = pool.withColumnRenamed("movieId", "seed")

    def lists():
        out = scoring.top_by_product(seeds, "seed", pool, 6, drop_self=True, normalized=normalized)
        return sorted((r.seed, r.position, r.movieId, repr(r.score)) for r in out.collect())

    whole = lists()
    monkeypatch.setattr(scoring, "POOL_BLOCK", 7)
    assert lists() == whole


@pytest.mark.parametrize("normalized", [True, False])
def test_chunks_of_seeds_and_pool(spark, monkeypatch, normalized):
    """Chunks give a block's lists and the driver gets no vectors; copies, ties, odd vectors."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(700)]
    rows += [(700 + i, rows[i % 3][1]) for i in range(60)]
    rows += [(800, None), (801, [1.0]), (802, [0.0] * 4), (803, [float("inf"), 1.0, 0.0, 0.0])]
    rows += [(804, [float("nan")] * 4), (805, [1e20, 0.0, 0.0, 1.0]), (5, rows[9][1])]
    pool = spark.createDataFrame(rows, "movieId int, emb array<double>").cache()
    seeds = pool.withColumnRenamed("movieId", "seed").where("seed % 3 = 0 or seed > 795")

    def lists():
        out = scoring.top_by_product(seeds, "seed", pool, 6, drop_self=True, normalized=normalized)
        return sorted((r.seed, r.position, r.movieId, repr(r.score)) for r in out.collect())

    whole = lists()

    def collected(self):
        raise AssertionError("a large pool went through the driver")

    for name, value in {"POOL_BLOCK": 7, "SEED_CHUNK": 90, "POOL_CHUNK": 300, "SCREENED": 64}.items():
        monkeypatch.setattr(scoring, name, value)
    monkeypatch.setattr(type(pool), "toPandas", collected)
    assert lists() == whole


def test_recommendations_are_those_of_als(spark, inputs, monkeypatch):
    """Every user's and every movie's list, found by screening."""
    model = models.als(inputs.ratings).fit(inputs.ratings)
    monkeypatch.setattr(scoring, "POOL_CHUNK", 70)

    def told(rows, key):
        return {(r[key], r.position): r.score for r in rows.collect()}

    theirs = {
        "userId": models.flat_recommendations(model.recommendForAllUsers(10), "userId", "movieId"),
        "movieId": models.flat_recommendations(model.recommendForAllItems(10), "movieId", "userId"),
    }
    for key, other in (("userId", "movieId"), ("movieId", "userId")):
        ours = models.recommendations(model, key, other)
        assert ours.dtypes == theirs[key].dtypes
        assert told(ours, key) == pytest.approx(told(theirs[key], key), rel=1e-6)


def test_click_model_by_parts(spark, ratings, movies):
    """Blocks of users and pool give the model's own probability for every pair."""
    rows = samples.mixed_samples(ratings, movies)
    model = models.wide_model(rows)
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 999)], "userId int")
    user_features = samples.latest_user_features(ratings, movies)
    movie_features = samples.latest_movie_features(ratings, movies)
    scored = ranking.scored_movies(parse_movies(movies), ratings)
    size = 8
    found = recall.recommend_by_click_model(
        model, users, user_features, movie_features, scored, size, pool_size=20
    ).collect()
    pool = ranking.top_movies(scored, "averageRating", 20).select("movieId")
    pairs = (
        users.crossJoin(pool)
        .join(user_features.drop("timestamp"), "userId", "left")
        .join(movie_features.drop("timestamp"), "movieId", "left")
        .withColumn("label", F.lit(0))
    )
    probability = F.round(vector_to_array("probability")[1], 6).alias("p")
    scores = {}
    for r in models.score(model, pairs).select("userId", "movieId", probability).collect():
        scores.setdefault(int(r.userId), []).append((-r.p, int(r.movieId)))
    lists = {}
    for r in sorted(found, key=lambda r: (r.userId, r.position)):
        lists.setdefault(r.userId, []).append((-r.score, r.movieId))
    assert set(lists) == {1, 2, 3, 999}
    for user, best in lists.items():
        wanted = sorted(scores[user])[:size]
        assert [m for _, m in best] == [m for _, m in wanted]
        assert [s for s, _ in best] == pytest.approx([s for s, _ in wanted], abs=1.1e-6)


def test_users_without_vector_rank_by_id(spark, catalogue, ratings):
    emb = spark.createDataFrame([(3, [1.0, 0.0]), (4, [0.0, 1.0])], "movieId int, emb array<float>")
    scored = ranking.scored_movies(catalogue, ratings)
    users = spark.createDataFrame([(1,), (999,)], "userId int")
    vectors = spark.createDataFrame([(1, [0.0, 2.0])], "userId int, emb array<double>")
    out = recall.recommend_for_users(users, vectors, scored, emb, 3, pool_size=40)
    rows = {}
    for r in out.orderBy("userId", "position").collect():
        rows.setdefault(r.userId, []).append((r.movieId, r.score))
    assert rows[1] == [(4, 1.0), (3, 0.0), (0, -1.0)]
    assert rows[999] == [(0, -1.0), (1, -1.0), (2, -1.0)]


def test_user_embedding_is_the_mean_of_liked(spark, make_ratings):
    emb = spark.createDataFrame([(1, [1.0, 3.0]), (2, [3.0, 5.0]), (3, [9.0, 9.0])], "movieId int, emb array<float>")
    ratings = make_ratings([(1, 1, 4.0, 1), (1, 2, 5.0, 2), (1, 3, 1.0, 3), (2, 3, 1.0, 4)])
    out = recall.user_embeddings(ratings, emb).collect()
    assert [(r.userId, r.emb) for r in out] == [(1, [2.0, 4.0])]


def test_factors_rank_by_probability(spark, catalogue, ratings):
    scored = ranking.scored_movies(catalogue, ratings)
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, -1.0])], "id int, features array<float>")
    items = spark.createDataFrame([(3, [2.0, 1.0]), (4, [0.5, 3.0])], "id int, features array<float>")
    out = recall.recommend_by_factors(users, items, scored, 2, pool_size=40)
    rows = {(r.userId, r.position): (r.movieId, round(r.score, 4)) for r in out.collect()}
    assert rows == {
        (1, 1): (3, round(1 / (1 + np.exp(-2)), 4)),
        (1, 2): (4, round(1 / (1 + np.exp(-0.5)), 4)),
        (2, 1): (3, round(1 / (1 + np.exp(1)), 4)),
        (2, 2): (4, round(1 / (1 + np.exp(3)), 4)),
    }


def test_best_of_scored_pairs(spark):
    pairs = spark.createDataFrame(
        [(1, 5, 0.5), (1, 4, 0.5), (1, 6, 0.9), (2, 1, 0.1)], "userId int, movieId int, score double"
    )
    out = recall.rank_scored_pairs(pairs, 2).orderBy("userId", "position").collect()
    assert [(r.userId, r.movieId) for r in out] == [(1, 6), (1, 4), (2, 1)]


@pytest.mark.parametrize("unequal", [False, True])
def test_runs_out_of_reach_change_nothing(monkeypatch, unequal):
    """Lists of a chunk are the exact ones, with runs of members that are passed over."""
    monkeypatch.setattr(scoring, "SCREENED", 64)
    rnd = np.random.default_rng(8)
    centres = rnd.standard_normal((40, 6))
    members = centres[rnd.integers(0, 40, 4000)] + 0.05 * rnd.standard_normal((4000, 6))
    if unequal:
        members *= rnd.lognormal(0, 1, (4000, 1))
    seeds = members[:300]

    def table(rows, **columns):
        ends = np.arange(len(rows) + 1, dtype=np.int32) * 6
        return pa.table({**columns, "emb": pa.ListArray.from_arrays(pa.array(ends), rows.ravel())})

    numbers = pa.array(np.arange(300)), pa.array(np.arange(300), pa.int32())
    met = []
    monkeypatch.setattr(scoring, "_pair_scores", lambda *a, f=scoring._pair_scores: met.append(len(a[0])) or f(*a))
    found = scoring._chunk_scorer(5, True, not unequal, False, 6)(
        table(seeds, _row=numbers[0], _key=numbers[1]),
        table(members, movieId=pa.array(np.arange(4000), pa.int32())),
    )
    scaled = (lambda v: v) if unequal else scoring._unit
    scores = np.round(scaled(seeds) @ scaled(members).T, 6)
    scores[np.arange(300), np.arange(300)] = -np.inf
    wanted = np.argsort(-scores, axis=1, kind="stable")[:, :5]
    lists = dict(zip(found["_row"].to_pylist(), found["ids"].to_pylist()))
    assert [lists[i] for i in range(300)] == wanted.tolist()
    # the first run met lies near the seeds, so few pairs are looked at in full
    assert sum(met) < 300 * 4000 / 10


def test_neighbours_lie_together():
    rnd = np.random.default_rng(9)
    points = rnd.random((10_000, 2))
    order = scoring._neighbouring(points)
    assert sorted(order) == list(range(10_000))
    assert np.mean(scoring._balls(points[order])[1]) < 0.6 * np.mean(scoring._balls(points)[1])
