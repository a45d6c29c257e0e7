"""Splitting heavy keys changes how work is spread, never the rows."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import aggregates, changes, evaluation, graph, samples
from marquee.plans import lineage, ordered, skew
from marquee.sources import payloads


def rows(df):
    # sums of squares may end in another digit when partial results merge in another order
    doubles = {c: F.round(c, 9) for c, kind in df.dtypes if kind == "double"}
    return sorted(map(repr, df.withColumns(doubles).select(*sorted(df.columns)).collect()))


def skewed_ratings(make_ratings):
    """One user and one movie each hold about a third of the rows."""
    out = [(1, m, 0.5 + (m * 7 % 10) / 2, 1000 + m // 3) for m in range(400)]
    out += [(u, 9999, 0.5 + (u * 3 % 10) / 2, 500 + u) for u in range(2, 402)]
    out += [
        (u, m, 0.5 + ((u + m) % 10) / 2, 2000 + (u * m) % 97)
        for u in range(2, 42)
        for m in range(10)
    ]
    return make_ratings(out)


def some_movies(make_movies):
    genres = ["Action", "Drama|War", "Comedy|Action|War"]
    return make_movies([(m, f"M{m} ({1950 + m % 60})", genres[m % 3]) for m in range(400)])


def test_heavy_keys(make_ratings):
    found, total = skew.heavy_keys(skewed_ratings(make_ratings), "userId", 50)
    assert [tuple(r) for r in found.collect()] == [(1, 400)] and total == 400
    assert skew.heavy_keys(skewed_ratings(make_ratings), "userId", 400) == (None, 0)
    # any number of keys may be heavy
    found, total = skew.heavy_keys(skewed_ratings(make_ratings), "userId", 0)
    assert (found.count(), total) == (401, 1200)


def test_number_rows_and_running_total(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    placed = ordered.number_rows(df, [], ["x"], "at", ranges=7)
    assert [r.at for r in placed.orderBy("x").collect()] == list(range(1000))
    total = ordered.running_total(df, [], ["x"], F.col("x"), "before", ranges=5)
    assert all(r.before == r.x * (r.x - 1) // 2 for r in total.collect())


def test_numbers_within_keys(spark):
    df = spark.range(900).select((F.col("id") % 3).alias("k"), F.col("id").alias("x"))
    placed = ordered.number_rows(df, ["k"], ["x"], "at", ranges=8)
    assert all(r.at == r.x // 3 for r in placed.collect())


def test_samples_are_the_same_when_split(make_ratings, make_movies):
    ratings, movies = skewed_ratings(make_ratings), some_movies(make_movies)
    plain = samples.user_history(ratings, movies)
    split = samples.user_history(ratings, movies, long_sequence=120)
    assert rows(plain) == rows(split)


def test_pairs_and_sequences_are_the_same_when_split(make_ratings):
    ratings = skewed_ratings(make_ratings)
    assert rows(graph.item_pairs(ratings)) == rows(graph.item_pairs(ratings, 30))
    assert rows(graph.item_sequences(ratings)) == rows(graph.item_sequences(ratings, 30))
    assert rows(payloads.ratings_as_json(ratings)) == rows(payloads.ratings_as_json(ratings, 30))


def test_lookup_join_splits_a_popular_key(spark, make_ratings):
    """With a lookup too large to broadcast, adaptive execution splits the hot partition."""
    ratings = skewed_ratings(make_ratings)
    expected = rows(samples.join_rating_features(ratings))
    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2000",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        joined = samples.join_rating_features(ratings.repartition(6))
        assert rows(joined) == expected
        joined = samples.join_rating_features(ratings.repartition(6))
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin(skew=true)" in plan
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_small_lookup_is_broadcast(make_ratings):
    """Its size is known from the files, so the ratings are not shuffled for it."""
    joined = samples.join_rating_features(skewed_ratings(make_ratings))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_long_history_sees_one_hundred_rows(make_ratings, make_movies):
    ratings = make_ratings([(1, m, 4.0 if m < 25 else 1.0, m) for m in range(130)])
    movies = make_movies([(m, f"M ({1900 + m})", "A" if m < 25 else "B") for m in range(130)])
    for limit in (skew.LONG_SEQUENCE, 100):
        last = samples.user_history(ratings, movies, limit).where("movieId = 129").first()
        # rows 29..128 are in the frame, and none of them is liked
        assert last.userRatingCount == 100
        assert last.userRatedMovie0 is None
        assert last.userGenre0 is None
        assert last.userAvgRating == 1.0
        assert last.userRatingStddev == 0.0
        assert last.userRatedMovieAvgReleaseYear == int(1900 + (29 + 128) / 2)


def test_rank_filter_runs_before_the_shuffle(make_ratings):
    ratings = skewed_ratings(make_ratings).repartition(4)
    for df in (
        aggregates.movie_top_ratings(ratings),
        changes.last_write(ratings, ["userId", "movieId"], ["timestamp"]),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        partial = plan.index("WindowGroupLimit", plan.index("WindowGroupLimit") + 1)
        assert "Exchange hashpartitioning" in plan[:partial]


class FakeSession:
    """Just the settings that decide where intermediate results go."""

    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}
        self.sparkContext = self
        self.master = master

    def getConf(self):
        return self.conf

    def getCheckpointDir(self):
        return None


def test_shared_folder_follows_the_session(spark):
    named = FakeSession("hdfs://shared/folder/", "yarn")
    assert lineage.shared_folder(named) == "hdfs://shared/folder"
    with pytest.raises(RuntimeError):
        lineage.shared_folder(FakeSession(None, "yarn"))
    assert lineage.shared_folder(spark).startswith("/")


def test_auc_matches_all_pairs(make_ratings):
    scored = make_ratings(
        [(i, i, 1.0 if i % 3 == 0 else 0.0, (i * 37) % 11) for i in range(60)]
    )
    found = evaluation.auc(scored, "rating", "timestamp").first()
    data = [(r.rating, r.timestamp) for r in scored.collect()]
    pos = [s for y, s in data if y == 1]
    neg = [s for y, s in data if y == 0]
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert abs(found.auc - wins / (len(pos) * len(neg))) < 1e-12


def test_intermediate_results_can_be_released(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "shared_folder", lambda _: str(tmp_path))
    written = lineage.materialize(spark.range(5), "numbers")
    assert written.count() == 5 and list(tmp_path.iterdir())
    lineage.release(spark)
    assert not list(tmp_path.iterdir())
