"""Exact variances, and the newest features without a frame per event."""

import statistics

import pytest
from pyspark.sql import functions as F

from marquee.functions.moments import sample_variance
from marquee.operators import models, samples


def test_variance_is_exact_on_half_steps(spark):
    ratings = [0.5, 1.0, 2.5, 2.5, 3.0, 5.0, 4.5, 0.5] * 4
    off = [1.1, 2.7, 3.14]
    rows = [(1, x) for x in ratings] + [(2, x) for x in off] + [(3, 4.0), (4, None)]
    df = spark.createDataFrame(rows, "movieId int, rating double").repartition(5)
    found = dict(
        map(tuple, df.groupBy("movieId").agg(sample_variance(F.col("rating"))).collect())
    )
    assert found[1] == statistics.variance(ratings)
    assert found[2] == pytest.approx(statistics.variance(off))
    assert found[3] is None and found[4] is None


def test_latest_features_equal_the_newest_samples(spark, make_ratings, make_movies):
    movies = make_movies([(m, f"T{m} ({1960 + m})", "a|b" if m % 2 else "c") for m in range(1, 40)])
    ratings = make_ratings(
        [(u, 1 + (u * 7 + i * 5) % 45, 0.5 * (1 + (u + i * 3) % 10), (i * 13) % 97 + u % 2)
         for u in range(12) for i in range(u * u + u % 3)]
    ).dropDuplicates(["userId", "movieId"])
    rows = samples.mixed_samples(ratings, movies)

    def same(a, b):
        return sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(
            map(repr, b.select(*sorted(b.columns)).collect())
        )

    assert same(samples.user_features_latest(rows), samples.latest_user_features(ratings, movies))
    assert same(samples.movie_features_latest(rows), samples.latest_movie_features(ratings, movies))


def test_no_window_buffers_the_liked_lists(spark, make_ratings, make_movies):
    ratings = make_ratings([(1, 1, 4.0, 1), (1, 2, 3.5, 2), (1, 3, 1.0, 3)])
    movies = make_movies([(1, "A (1999)", "x"), (2, "B (2000)", "y"), (3, "C (2001)", "x")])
    plan = samples.mixed_samples(ratings, movies)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and all("_liked" not in line for line in windows[1:])


def test_every_liked_item_gets_a_vector(spark):
    rows = [(["1", "2", "3"],), (["1", "4"],), (["2", "5"],)]
    df = spark.createDataFrame(rows, "movieIds array<string>")
    found = models.vectors_of(models.item2vec(df, "movieIds"))
    assert sorted(r.movieId for r in found.collect()) == [1, 2, 3, 4, 5]
    assert models.vectors_of(models.item2vec(df, "movieIds", least=2)).count() == 2
