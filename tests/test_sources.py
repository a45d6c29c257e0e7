import json

from pyspark.sql import functions as F

from marquee.operators import changes, lookups
from marquee.sources import embeddings, feature_store, payloads, sample_files, tables


def test_csv_tables(spark, tmp_path):
    (tmp_path / "ratings.csv").write_text(
        "userId,movieId,rating,timestamp\n1,31,2.5,1260759144\n1,32,4,999999999\n"
    )
    (tmp_path / "movies.csv").write_text(
        'movieId,title,genres\n31,"American President, The (1995)",Comedy|Drama\n'
        '32,"Say ""Hi"" (2000)",War\n33,Plain,\n'
    )
    (tmp_path / "links.csv").write_text("movieId,imdbId,tmdbId\n31,0112346,9087\n32,0000007,\n")
    ratings = tables.read_ratings(spark, str(tmp_path / "ratings.csv"))
    assert [tuple(r) for r in ratings.orderBy("timestamp").collect()] == [
        (1, 32, 4.0, 999_999_999),
        (1, 31, 2.5, 1_260_759_144),
    ]
    movies = tables.parse_movies(tables.read_movies(spark, str(tmp_path / "movies.csv")))
    linked = tables.enrich_links(movies, tables.read_links(spark, str(tmp_path / "links.csv")))
    by_id = {r.movieId: r for r in linked.collect()}
    assert by_id[31].title == "American President, The"
    assert (by_id[31].releaseYear, by_id[31].genres) == (1995, ["Comedy", "Drama"])
    assert by_id[31].imdbId == "0112346"
    assert (by_id[32].title, by_id[32].imdbId, by_id[32].tmdbId) == ('Say "Hi"', "0000007", None)
    assert (by_id[33].releaseYear, by_id[33].genres, by_id[33].imdbId) == (0, [], None)
    users = tables.derive_users(ratings).collect()
    assert [tuple(r) for r in users] == [(1, "User1")]
    both = tables.between(ratings, 999_999_999, 1_260_759_144)
    assert both.count() == 2


def test_range_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([(1, 2, 3.0, 4)], tables.RATING_SCHEMA).write.parquet(path)
    df = tables.between(spark.read.parquet(path), 1, 9).select("userId")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(timestamp,1)" in plan and "LessThanOrEqual(timestamp,9)" in plan
    assert "ReadSchema: struct<userId:int,timestamp:bigint>" in plan


def test_time_slices_cover_each_time_once(spark):
    for low, high, n in ((0, 99, 7), (5, 5, 16), (10, 12, 3)):
        times = spark.range(low - 3, high + 4).withColumnRenamed("id", "timestamp")
        found = [r[0] for p in tables.time_slices(low, high, n) for r in times.where(p).collect()]
        assert sorted(found) == list(range(low, high + 1))


def test_embedding_lines(spark, tmp_path):
    (tmp_path / "e.csv").write_text("1:0.5 -1.0\nbroken\n2:1:2\n3:2.0 4.0\n")
    out = embeddings.read_embeddings(spark, str(tmp_path / "e.csv")).orderBy("movieId").collect()
    assert [(r.movieId, r.emb) for r in out] == [(1, [0.5, -1.0]), (3, [2.0, 4.0])]
    df = spark.createDataFrame([(1, [0.5, 1.0])], "movieId int, emb array<float>")
    rows = embeddings.embedding_rows(df, embeddings.GRAPH)
    assert [tuple(r) for r in rows.collect()] == [("graphEmb:1", "0.5 1.0")]
    back = embeddings.embeddings_from_rows(rows, embeddings.GRAPH).first()
    assert (back.movieId, back.emb) == (1, [0.5, 1.0])
    assert embeddings.embeddings_from_rows(rows, embeddings.ITEM2VEC).count() == 0


def test_feature_store_expires(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 7, 1234.125, None, 100), (2, None, 0.375, "War", 200)],
        "userId int, userRatedMovie0 int, userAvgRating double, userGenre0 string, timestamp bigint",
    )
    fields = ["userRatedMovie0", "userAvgRating", "userGenre0"]
    rows = feature_store.feature_rows(df, "uf", "userId", fields, F.col("timestamp"))
    path = str(tmp_path / "store")
    feature_store.write_feature_store(rows, path)
    stored = spark.read.parquet(path)
    maps = {r.key: r.features for r in stored.collect()}
    assert maps["uf:1"] == {"userRatedMovie0": "7", "userAvgRating": "1,234.12", "userGenre0": ""}
    kinds = {"userRatedMovie0": "int", "userAvgRating": "double", "userGenre0": "string"}
    now = 150 + feature_store.LIFETIME
    live = feature_store.lookup(stored, "uf", "userId", kinds, now).collect()
    assert [tuple(r) for r in live] == [(2, None, 0.38, "War")]
    early = feature_store.lookup(stored, "uf", "userId", kinds, 0).where("userId = 1").first()
    assert (early.userAvgRating, early.userGenre0) == (1234.12, None)


def test_bad_sample_lines_are_skipped(spark, tmp_path):
    names = sample_files.SAMPLE_COLUMNS
    good = {c: "" for c in names} | {"movieId": "5", "userId": "6", "label": "1", "genre0": "War"}
    bad = good | {"movieId": "not-a-number"}
    lines = [",".join(names)] + [",".join(row[c] for c in names) for row in (good, bad)]
    (tmp_path / "s.csv").write_text("\n".join(lines) + "\n")
    out = sample_files.read_training_samples(spark, str(tmp_path / "s.csv")).collect()
    assert len(out) == 1
    assert (out[0].movieId, out[0].userRatedMovie0, out[0].userAvgRating) == (5, 0, 0.0)
    assert (out[0].genre0, out[0].genre1) == ("War", "")


def test_rating_documents(spark, make_ratings, monkeypatch):
    monkeypatch.setattr(payloads, "RATINGS_PER_DOCUMENT", 2)
    out = payloads.ratings_as_json(make_ratings([(1, m, 4.0, 10 - m) for m in range(3)]))
    rows = out.orderBy("document").collect()
    assert [r.ratings for r in rows] == [2, 1]
    assert json.loads(rows[0].json) == [
        {"rating": {"userId": 1, "movieId": m, "score": 4.0, "timestamp": 10 - m}} for m in (2, 1)
    ]


def test_requests_and_predictions(spark):
    pairs = spark.createDataFrame(
        [(1, 30, 1), (1, 20, 0), (2, 30, 0)], "userId int, movieId int, position int"
    )
    out = payloads.scoring_requests(pairs).orderBy("userId").collect()
    assert json.loads(out[0].request) == {
        "instances": [{"userId": 1, "movieId": 20}, {"userId": 1, "movieId": 30}]
    }
    responses = spark.createDataFrame(
        [(1, '{"predictions": [[0.25],[0.5]]}'), (2, '{"predictions": [[0.75]]}')],
        "userId int, response string",
    )
    scores = payloads.parse_predictions(responses, pairs).collect()
    assert {(r.userId, r.movieId): r.score for r in scores} == {
        (1, 20): 0.25,
        (1, 30): 0.5,
        (2, 30): 0.75,
    }


def test_lookups(spark, make_ratings):
    ratings = make_ratings([(1, 1, 4.0, 1)])
    asked = spark.createDataFrame([(1, 1), (1, 2), (None, 1)], "userId int, movieId int")
    found = {(r.userId, r.movieId): r.rating for r in lookups.rating_lookup(asked, ratings).collect()}
    assert found == {(1, 1): 4.0, (1, 2): -1.0, (None, 1): -1.0}
    listed = spark.createDataFrame([(1, 2)], "userId int, movieId int")
    flags = {(r.userId, r.movieId): r.inWatchlist for r in lookups.watchlist_flags(asked, listed).collect()}
    assert flags == {(1, 1): False, (1, 2): True, (None, 1): False}
    users = tables.derive_users(ratings)
    valid = lookups.valid_inserts(asked, users, listed)
    assert [tuple(r) for r in valid.collect()] == [(2, 1)] or [
        (r.userId, r.movieId) for r in valid.collect()
    ] == [(1, 2)]


def test_watchlist_log(spark):
    ops = spark.createDataFrame(
        [
            (1, 1, 10, 100, "add"),
            (2, 1, 11, 110, "add"),
            (3, 1, 10, 120, "del"),
            (4, 2, 10, 100, "add"),
            (5, 2, None, 130, "clear"),
            (6, 2, 12, 130, "add"),
            (7, 3, 10, 100, "add"),
            (8, 3, 10, 100, "del"),
        ],
        "event_id int, userId int, movieId int, timestamp int, op string",
    )
    out = changes.watchlist_snapshot(ops, ["timestamp", "event_id"]).collect()
    assert {(r.userId, r.movieId) for r in out} == {(1, 11), (2, 12)}


def test_last_write_wins(spark):
    schema = "userId int, movieId int, rating double, timestamp int"
    base = spark.createDataFrame([(1, 1, 2.0, 5), (1, 2, 3.0, 5)], schema)
    new = spark.createDataFrame([(1, 1, 4.0, 9), (1, 3, 1.0, 6), (1, 2, 0.5, 4)], schema)
    out = changes.upsert_ratings(base, new, ["timestamp"])
    assert {(r.movieId, r.rating) for r in out.collect()} == {(1, 4.0), (2, 3.0), (3, 1.0)}
