import os

import pytest
from pyspark.sql import functions as F

from marquee.operators import aggregates, attention, encoders, lookups, samples


@pytest.fixture(scope="module")
def movies(make_movies):
    return make_movies(
        [
            (1, "One (1999)", "Action|War"),
            (2, "Two (2001)", "Drama"),
            (3, "Three", "Action|Drama|War|IMAX"),
            (4, None, None),
        ]
    )


def test_single_rating_has_deviation_zero(make_ratings):
    out = samples.movie_rating_features(make_ratings([(1, 1, 4.0, 1), (1, 2, 3.0, 2), (2, 2, 5.0, 3)]))
    by_id = {r.movieId: r for r in out.collect()}
    assert by_id[1].movieRatingStddev == 0.0
    assert by_id[2].movieRatingStddev == pytest.approx(2**0.5)
    variance = aggregates.movie_rating_variance(make_ratings([(1, 1, 4.0, 1)])).first()
    assert variance.ratingVar is None


def test_label_starts_at_three_and_a_half(make_ratings):
    rows = samples.add_label(make_ratings([(1, 1, 3.5, 1), (1, 2, 3.0, 1)])).collect()
    assert [r.label for r in rows] == [1, 0]


def test_movie_profile(make_ratings, movies):
    ratings = make_ratings([(1, m, 4.0, m) for m in (1, 3, 4, 5)])
    by_id = {r.movieId: r for r in samples.movie_profile(movies, ratings).collect()}
    assert by_id[1].releaseYear == 1999
    assert (by_id[3].releaseYear, by_id[3].genre2) == (1990, "War")
    assert (by_id[4].releaseYear, by_id[4].genre0) == (1990, None)
    # a movie that is not in the catalogue
    assert (by_id[5].releaseYear, by_id[5].genre0) == (1990, None)


def test_history_is_strictly_earlier(make_ratings, movies):
    ratings = make_ratings(
        [(1, 1, 4.0, 10), (1, 2, 2.0, 20), (1, 3, 5.0, 30), (1, 4, 1.0, 40)]
    )
    out = samples.user_history(ratings, movies).orderBy("timestamp").collect()
    assert [r.userRatingCount for r in out] == [0, 1, 2, 3]
    assert [r.userRatedMovie0 for r in out] == [None, 1, 1, 3]
    assert [r.userRatedMovie1 for r in out] == [None, None, None, 1]
    assert out[0].userAvgRating is None
    assert out[1].userRatingStddev is None
    assert out[2].userAvgRating == 3.0
    assert out[3].userRatedMovieAvgReleaseYear == int((1999 + 2001 + 1990) / 3)
    # Action and War were seen twice, Action first
    assert [out[3][f"userGenre{i}"] for i in range(5)] == ["Action", "War", "Drama", "IMAX", None]


def test_nine_and_ten_digit_times_sort_as_numbers(make_ratings, movies):
    ratings = make_ratings([(1, 1, 5.0, 1_000_000_000), (1, 2, 5.0, 999_999_999)])
    out = samples.user_history(ratings, movies).where("movieId = 1").first()
    assert out.userRatedMovie0 == 2


def test_ties_are_ordered_by_movie(make_ratings, movies):
    ratings = make_ratings([(1, 3, 5.0, 7), (1, 1, 5.0, 7), (1, 2, 5.0, 7)])
    out = samples.user_history(ratings, movies).where("movieId = 3").first()
    assert (out.userRatedMovie0, out.userRatedMovie1) == (2, 1)


def test_first_two_events_are_dropped(make_ratings, movies):
    ratings = make_ratings(
        [(1, 1, 4.0, 1)]
        + [(2, m, 4.0, m) for m in (1, 2)]
        + [(3, m, 4.0, m) for m in (1, 2, 3)]
    )
    out = samples.mixed_samples(ratings, movies).collect()
    assert [(r.userId, r.movieId) for r in out] == [(3, 3)]
    assert samples.user_features_latest(samples.mixed_samples(ratings, movies)).count() == 1


def test_no_likes_leave_slots_empty(make_ratings, movies):
    ratings = make_ratings([(1, m, 2.0, m) for m in (1, 2, 3)])
    out = samples.mixed_samples(ratings, movies).first()
    assert all(out[c] is None for c in (*samples.RATED_MOVIES, *samples.USER_GENRES))
    features = lookups.ranking_features(
        samples.mixed_samples(ratings, movies).select("userId", "movieId"),
        samples.user_features_latest(samples.mixed_samples(ratings, movies)),
        samples.movie_features_latest(samples.mixed_samples(ratings, movies)),
    ).first()
    assert features.userRatedMovie0 == 0
    assert features.userGenre0 == ""


def test_statistics_of_unusual_scores(make_ratings, movies):
    scores = [4.37, 1.13, 2.71, 3.33]
    ratings = make_ratings([(1, m + 1, s, m) for m, s in enumerate(scores)])
    last = samples.user_history(ratings, movies).where("movieId = 4").first()
    mean = sum(scores[:3]) / 3
    spread = (sum((s - mean) ** 2 for s in scores[:3]) / 2) ** 0.5
    assert last.userAvgRating == pytest.approx(mean)
    assert last.userRatingStddev == pytest.approx(spread)


def test_user_stats_start_values(make_ratings):
    out = aggregates.user_rating_stats(make_ratings([(1, 1, 2.0, 1), (1, 2, 4.0, 2)])).first()
    assert (out.highestRating, out.lowestRating, out.ratingCount) == (4.0, 2.0, 2)


def test_top_ratings_keep_earliest_of_equals(make_ratings):
    rows = [(u, 1, 4.0, u) for u in range(12)] + [(50, 1, 5.0, 99)]
    out = aggregates.movie_top_ratings(make_ratings(rows)).orderBy("position").collect()
    assert [r.userId for r in out] == [8, 7, 6, 5, 4, 3, 2, 1, 0, 50]


def test_word_count_keeps_empty_words(spark):
    texts = spark.createDataFrame([("a  b\na",), ("",)], "text string")
    counts = {r.word: r.cnt for r in aggregates.word_count(texts).collect()}
    assert counts == {"a": 2, "": 2, "b": 1}


def test_encoders(spark, make_movies):
    from marquee.sources.tables import parse_movies

    catalogue = parse_movies(make_movies([(1, "A", "x|y"), (2, "B", "y"), (4, "C", "z|y")]))
    index = {r.genre: r.genreIndex for r in encoders.genre_indices(catalogue).collect()}
    assert index == {"y": 0, "x": 1, "z": 2}
    hot = {r.movieId: r for r in encoders.multi_hot_genres(catalogue).collect()}
    assert list(hot[4].vector.toArray()) == [1.0, 0.0, 1.0]
    assert hot[1].genreIndexes == [0, 1]
    one = {r.movieId: r.vector for r in encoders.one_hot_movie(catalogue.select("movieId")).collect()}
    assert one[4].size == 5 and list(one[4].indices) == [4]
    flat = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id int, x double")
    assert [r.y for r in encoders.min_max(flat, "x", "y").collect()] == [0.5, 0.5]


def test_attention_masks_missing_items(spark):
    rows = spark.createDataFrame(
        [(1, 10, 11, None, 12, 99, None)],
        "userId int, movieId int, " + ", ".join(f"{c} int" for c in samples.RATED_MOVIES),
    )
    emb = spark.createDataFrame(
        [(10, [1.0, 0.0]), (11, [0.0, 1.0]), (12, [2.0, 2.0])], "movieId int, emb array<float>"
    )
    out = attention.history_attention_pool(rows, emb).first()
    w = 1 / (1 + 2.718281828459045**-2)
    assert out.slots == 2
    assert out.pooled == pytest.approx([2 * w, 0.5 + 2 * w])
    assert rows.select(F.col("movieId")).count() == 1
    # vectors too large to be copied meet samples by id
    apart = attention.history_attention_pool(rows, emb, broadcast_bytes=0).first()
    assert (apart.slots, apart.weight, apart.pooled) == (out.slots, out.weight, out.pooled)
    plan = attention.history_attention_pool(rows, emb)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan
    nobody = rows.withColumns({c: F.lit(None).cast("int") for c in samples.RATED_MOVIES})
    assert attention.history_attention_pool(nobody, emb).count() == 0
    assert attention.history_attention_pool(rows, emb.limit(0)).count() == 0


def test_stored_samples_go_when_both_files_are_written(spark):
    from conftest import SF_DIR

    from marquee.catalog import Inputs

    inputs = Inputs(spark, SF_DIR)
    files = inputs.stored_samples.inputFiles()
    assert files and all(os.path.exists(f.removeprefix("file://")) for f in files)
    inputs.drop_samples()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
