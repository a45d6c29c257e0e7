"""Registered queries: each operator over the given tables, with equivalent SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import fixtures
from marquee.functions import traffic
from marquee.functions.vectors import cosine
from marquee.operators import (
    aggregates,
    attention,
    changes,
    encoders,
    evaluation,
    graph,
    lookups,
    models,
    neighbours,
    ranking,
    recall,
    samples,
    splits,
)
from marquee.operators.scoring import top_by_product
from marquee.oracle_tables import sql
from marquee.plans.lineage import delete, fresh_path, materialize, reclaim
from marquee.sources import embeddings as embedding_files
from marquee.sources import feature_store, payloads, sample_files, tables
from marquee.sources.vector_store import VectorStore
from marquee.streaming import ratings as rating_stream


class Inputs:
    """The tables a query reads, built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    @cached_property
    def ratings(self) -> DataFrame:
        return fixtures.ratings(self.spark, self.dir)

    @cached_property
    def stored_ratings(self) -> DataFrame:
        """The ratings written once, for queries that read them several times.

        Every further read is a scan of four narrow columns instead of another join of the
        order lines with their orders and another deduplication.
        """
        return materialize(self.ratings, "ratings")

    @cached_property
    def movies(self) -> DataFrame:
        return fixtures.movies(self.spark, self.dir)

    @cached_property
    def catalogue(self) -> DataFrame:
        return tables.parse_movies(self.movies)

    @cached_property
    def scored(self) -> DataFrame:
        return ranking.scored_movies(self.catalogue, self.ratings)

    @cached_property
    def stored_scores(self) -> DataFrame:
        """The scored catalogue, written once for queries that read it several times."""
        scored = ranking.scored_movies(self.catalogue, self.stored_ratings)
        return materialize(scored, "scored")

    @cached_property
    def embeddings(self) -> DataFrame:
        return fixtures.item_embeddings(self.spark, self.dir)

    @cached_property
    def watchlist(self) -> DataFrame:
        return fixtures.watchlist(self.spark, self.dir)

    @cached_property
    def events(self) -> DataFrame:
        return fixtures.rating_events(self.spark, self.dir)

    @cached_property
    def asked(self) -> DataFrame:
        """Distinct (user, movie) pairs somebody asks about."""
        return self.events.select("userId", "movieId").distinct()

    @cached_property
    def samples(self) -> DataFrame:
        return samples.mixed_samples(self.stored_ratings, self.movies)

    @cached_property
    def stored_samples(self) -> DataFrame:
        """The samples written once; what their windows shuffled goes before the next step begins."""
        rows = materialize(self.samples, "mixed")
        reclaim(self.spark)
        return rows

    def drop_samples(self) -> None:
        """Delete the written samples, when all that was made of them is written too."""
        for folder in {f.rsplit("/", 1)[0] for f in self.stored_samples.inputFiles()}:
            delete(self.spark, folder)
        del self.stored_samples

    @cached_property
    def pairs(self) -> DataFrame:
        return graph.item_pairs(self.stored_ratings)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.pair_counts(self.pairs)

    def event_stream(self) -> DataFrame:
        schema = fixtures.table(self.spark, self.dir, "events").schema
        raw = rating_stream.read_stream(self.spark, self.dir, schema, "events.parquet")
        return fixtures.rating_events_of(raw)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None, *names: str):
    """Register a query under its function name, with SQL over `names` when given."""

    def add(build: Callable[[Inputs], DataFrame]):
        QUERIES[build.__name__] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if oracle is not None:
            ORACLE[build.__name__] = sql(oracle, *names)
        return build

    return add


def _rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _int(name: str) -> Column:
    return F.col(name).cast("int").alias(name)


def _long(name: str) -> Column:
    return F.col(name).cast("bigint").alias(name)


def _metrics(t: Inputs, values: dict[str, float]) -> DataFrame:
    rows = [(name, float(value)) for name, value in values.items()]
    return t.spark.createDataFrame(rows, "metric string, value double")


# ---- sources ----------------------------------------------------------------------------
@query("SELECT userId, movieId, rating, timestamp FROM ratings", "ratings")
def scan_ratings(t: Inputs) -> DataFrame:
    return t.ratings


@query(
    """SELECT movieId, title, featureYear AS releaseYear, releaseYear AS catalogueYear,
 array_to_string(genres, '|') AS genres FROM catalogue""",
    "catalogue",
)
def movies_parsed(t: Inputs) -> DataFrame:
    years = t.movies.select("movieId", samples.release_year(F.col("title")).alias("year"))
    return t.catalogue.join(years, "movieId").select(
        "movieId",
        "title",
        F.col("year").alias("releaseYear"),
        F.col("releaseYear").alias("catalogueYear"),
        F.array_join("genres", "|").alias("genres"),
    )


@query(
    """SELECT c.movieId, c.title, nullif(trim(l.imdbId),'') AS imdbId, nullif(trim(l.tmdbId),'') AS tmdbId
FROM catalogue c LEFT JOIN links l USING (movieId)""",
    "catalogue",
    "links",
)
def movies_with_links(t: Inputs) -> DataFrame:
    linked = tables.enrich_links(t.catalogue, fixtures.links(t.spark, t.dir))
    return linked.select("movieId", "title", "imdbId", "tmdbId")


@query("SELECT DISTINCT userId, concat('User', userId) AS username FROM ratings", "ratings")
def users_derived(t: Inputs) -> DataFrame:
    return tables.derive_users(t.ratings)


RANGE_LOW, RANGE_HIGH = 852_076_800, 946_684_800  # 1997-01-01 to 2000-01-01


@query(f"SELECT * FROM ratings WHERE timestamp BETWEEN {RANGE_LOW} AND {RANGE_HIGH}", "ratings")
def ratings_between(t: Inputs) -> DataFrame:
    # an older line is never the newest within the range
    recent = fixtures.ratings(t.spark, t.dir, since=RANGE_LOW)
    return tables.between(recent, RANGE_LOW, RANGE_HIGH)


@query(
    """SELECT movieId, CAST(len(emb) AS INT) AS dims,
 round(list_sum(CAST(emb AS DOUBLE[])), 4) AS total FROM item_embeddings""",
    "item_embeddings",
)
def embeddings_roundtrip(t: Inputs) -> DataFrame:
    path = fresh_path(t.spark, "embeddings")
    embedding_files.write_embeddings(t.embeddings, path)
    return _vector_totals(embedding_files.read_embeddings(t.spark, path))


def _vector_totals(df: DataFrame, key: str = "movieId") -> DataFrame:
    total = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return df.select(key, F.size("emb").alias("dims"), F.round(total, 4).alias("total"))


@query(
    """SELECT concat('i2vEmb:', movieId) AS key, CAST(len(emb) AS INT) AS dims,
 round(list_sum(CAST(emb AS DOUBLE[])), 4) AS total FROM item_embeddings""",
    "item_embeddings",
)
def embedding_kv(t: Inputs) -> DataFrame:
    rows = embedding_files.embedding_rows(t.embeddings, embedding_files.ITEM2VEC)
    parsed = rows.select("key", embedding_files.from_text(F.col("value")).alias("emb"))
    return _vector_totals(parsed, "key")


@query(
    """SELECT genre, CAST(row_number() OVER (ORDER BY genre) - 1 AS INT) AS position
FROM (SELECT DISTINCT genre FROM movie_genres) g""",
    "movie_genres",
)
def genre_vocab(t: Inputs) -> DataFrame:
    return tables.genre_vocabulary(t.catalogue)


_USER_TEXT = ", ".join(
    f"('{c}', coalesce({expr}, ''))"
    for c, expr in [
        *[(c, f"CAST({c} AS VARCHAR)") for c in samples.RATED_MOVIES],
        ("userRatingCount", "CAST(userRatingCount AS VARCHAR)"),
        ("userRatedMovieAvgReleaseYear", "CAST(userRatedMovieAvgReleaseYear AS VARCHAR)"),
        *[
            (c, f"format('{{:,.2f}}', {c})")
            for c in ("userRatedMovieReleaseYearStddev", "userAvgRating", "userRatingStddev")
        ],
        *[(c, c) for c in samples.USER_GENRES],
    ]
)
_USER_LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY userId
 ORDER BY timestamp DESC, movieId DESC) r FROM mixed) x WHERE r=1)"""
_MOVIE_LATEST = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY movieId
 ORDER BY timestamp DESC, userId DESC) r FROM mixed) x WHERE r=1)"""


def _flat_store(rows: DataFrame) -> DataFrame:
    return rows.select("key", F.explode("features").alias("field", "value"), "expireAt")


@query(
    f"""SELECT concat('uf:', userId) AS key, f.field, f.value,
 (SELECT max(timestamp) FROM ratings) + 2592000 AS expireAt
FROM {_USER_LATEST} u, LATERAL (VALUES {_USER_TEXT}) f(field, value)""",
    "mixed",
)
def user_feature_kv(t: Inputs) -> DataFrame:
    latest = samples.latest_user_features(t.stored_ratings, t.movies)
    now = t.stored_ratings.agg(F.max("timestamp")).scalar()
    return _flat_store(
        feature_store.feature_rows(
            latest, feature_store.USER_PREFIX, "userId", samples.USER_FEATURES, now
        )
    )


_MOVIE_TEXT = ", ".join(
    f"('{c}', coalesce({expr}, ''))"
    for c, expr in [
        ("releaseYear", "CAST(releaseYear AS VARCHAR)"),
        *[(c, c) for c in samples.MOVIE_GENRES],
        ("movieRatingCount", "CAST(movieRatingCount AS VARCHAR)"),
        ("movieAvgRating", "format('{:,.2f}', movieAvgRating)"),
        ("movieRatingStddev", "format('{:,.2f}', movieRatingStddev)"),
    ]
)


@query(
    f"""SELECT concat('mf:', movieId) AS key, f.field, f.value,
 (SELECT max(timestamp) FROM ratings) + 2592000 AS expireAt
FROM {_MOVIE_LATEST} u, LATERAL (VALUES {_MOVIE_TEXT}) f(field, value)""",
    "mixed",
)
def movie_feature_kv(t: Inputs) -> DataFrame:
    latest = samples.latest_movie_features(t.stored_ratings, t.movies)
    now = t.stored_ratings.agg(F.max("timestamp")).scalar()
    return _flat_store(
        feature_store.feature_rows(
            latest, feature_store.MOVIE_PREFIX, "movieId", samples.MOVIE_FEATURES, now
        )
    )


_USER_TYPES = {
    **{c: "int" for c in samples.RATED_MOVIES},
    "userRatingCount": "bigint",
    "userRatedMovieAvgReleaseYear": "int",
    "userRatedMovieReleaseYearStddev": "double",
    "userAvgRating": "double",
    "userRatingStddev": "double",
    **{c: "string" for c in samples.USER_GENRES},
}
HALF_A_YEAR = 15_552_000


@query(
    f"""SELECT userId, {", ".join(samples.RATED_MOVIES)}, userRatingCount, userRatedMovieAvgReleaseYear,
 CAST(format('{{:.2f}}', userRatedMovieReleaseYearStddev) AS DOUBLE) AS userRatedMovieReleaseYearStddev,
 CAST(format('{{:.2f}}', userAvgRating) AS DOUBLE) AS userAvgRating,
 CAST(format('{{:.2f}}', userRatingStddev) AS DOUBLE) AS userRatingStddev, {", ".join(samples.USER_GENRES)}
FROM {_USER_LATEST} u
WHERE timestamp + 2592000 > (SELECT max(timestamp) FROM ratings) - {HALF_A_YEAR}""",
    "mixed",
)
def feature_store_lookup(t: Inputs) -> DataFrame:
    """Rows written at each user's latest event, read half a year before the last one."""
    latest = samples.latest_user_features(t.stored_ratings, t.movies)
    store = feature_store.feature_rows(
        latest, feature_store.USER_PREFIX, "userId", samples.USER_FEATURES, F.col("timestamp")
    )
    now = t.stored_ratings.agg(F.max("timestamp") - HALF_A_YEAR).scalar()
    return feature_store.lookup(store, feature_store.USER_PREFIX, "userId", _USER_TYPES, now)


_SPLIT_SQL = "CASE WHEN (CAST(userId AS BIGINT)*31 + CAST(movieId AS BIGINT)*17) % 10 < 8"


@query(
    f"""SELECT {_SPLIT_SQL} THEN 'train' ELSE 'test' END AS split, userId, movieId, label,
 coalesce(userRatedMovie0, 0) AS userRatedMovie0, coalesce(userRatedMovie4, 0) AS userRatedMovie4,
 userRatingCount, releaseYear, coalesce(genre1, '') AS genre1, coalesce(userGenre4, '') AS userGenre4
FROM mixed""",
    "mixed",
)
def samples_roundtrip(t: Inputs) -> DataFrame:
    folder = fresh_path(t.spark, "samples")
    rows = t.stored_samples  # both files come from one computation
    train, test = splits.hash_split(rows)
    sample_files.write_samples(train, test, folder)
    t.drop_samples()
    return sample_files.read_split(t.spark, folder).select(
        "split",
        "userId",
        "movieId",
        "label",
        "userRatedMovie0",
        "userRatedMovie4",
        "userRatingCount",
        "releaseYear",
        "genre1",
        "userGenre4",
    )


@query(
    f"""SELECT userId, document, CAST(count(*) AS INT) AS ratings,
 string_agg(concat(userId, '/', movieId, '@', timestamp, '=', rating), ' ' ORDER BY part) AS listed FROM (
 SELECT *, CAST(part // {payloads.RATINGS_PER_DOCUMENT} AS INT) AS document FROM (
  SELECT *, row_number() OVER (PARTITION BY userId ORDER BY timestamp, movieId) - 1 AS part FROM ratings) x) y
GROUP BY userId, document""",
    "ratings",
)
def user_ratings_json(t: Inputs) -> DataFrame:
    """Every field of every rating as a reader of the documents finds it, in their order."""
    documents = payloads.ratings_as_json(t.stored_ratings)
    fields = "userId: INT, movieId: INT, score: DOUBLE, timestamp: BIGINT"
    parsed = F.from_json("json", f"ARRAY<STRUCT<rating: STRUCT<{fields}>>>")

    def line(x: Column) -> Column:
        r = x["rating"]
        return F.concat(r["userId"], F.lit("/"), r["movieId"], F.lit("@"), r["timestamp"], F.lit("="), r["score"])

    listed = F.array_join(F.transform(parsed, line), " ")
    return documents.select("userId", "document", "ratings", listed.alias("listed"))


def _watch_pairs(t: Inputs) -> DataFrame:
    """Candidates to score: each user's newest watch-list entries."""
    latest = ranking.watchlist_latest(t.watchlist, t.catalogue, WATCH_SIZE)
    return latest.select("userId", "movieId", (F.col("position") - 1).alias("position"))


def _ranking_rows(t: Inputs) -> DataFrame:
    return lookups.ranking_features(
        _watch_pairs(t),
        samples.latest_user_features(t.stored_ratings, t.movies),
        samples.latest_movie_features(t.stored_ratings, t.movies),
    )


@query(
    f"""SELECT p.userId, CAST(count(*) AS INT) AS instances, CAST(sum(p.movieId) AS BIGINT) AS movieIds,
 CAST(sum(u.userRatingCount) AS BIGINT) AS ratingCounts, CAST(sum(coalesce(u.userRatedMovie4, 0)) AS BIGINT) AS fifthMovies,
 string_agg(coalesce(m.genre0, ''), '|' ORDER BY p.position) AS genres
FROM (SELECT * FROM (SELECT w.userId, w.movieId,
  row_number() OVER (PARTITION BY w.userId ORDER BY w.timestamp DESC, w.movieId) AS position
  FROM watchlist w JOIN movies x USING (movieId)) y WHERE position <= 20) p
JOIN {_USER_LATEST} u ON u.userId=p.userId JOIN {_MOVIE_LATEST} m ON m.movieId=p.movieId
GROUP BY p.userId""",
    "mixed",
    "watchlist",
    "movies",
)
def scoring_payload(t: Inputs) -> DataFrame:
    """What a scorer finds in the requests."""
    requests = payloads.scoring_requests(_ranking_rows(t), payloads.FEATURE_FIELDS)
    instance = "movieId BIGINT, userRatingCount BIGINT, userRatedMovie4 BIGINT, genre0 STRING"
    parsed = F.from_json("request", f"instances ARRAY<STRUCT<{instance}>>")["instances"]

    def total(field: str) -> Column:
        return F.aggregate("_all", F.lit(0).cast("bigint"), lambda s, x: s + x[field])

    return requests.withColumn("_all", parsed).select(
        "userId",
        "instances",
        total("movieId").alias("movieIds"),
        total("userRatingCount").alias("ratingCounts"),
        total("userRatedMovie4").alias("fifthMovies"),
        F.array_join(F.transform("_all", lambda x: x["genre0"]), "|").alias("genres"),
    )


@query(
    """SELECT userId, movieId, CAST(position - 1 AS INT) AS position,
 round(movieId / 100000.0, 6) AS score FROM (
 SELECT w.userId, w.movieId, row_number() OVER (PARTITION BY w.userId ORDER BY w.timestamp DESC, w.movieId) position
 FROM watchlist w JOIN movies m USING (movieId)) x WHERE position <= 20""",
    "watchlist",
    "movies",
)
def predictions_joined(t: Inputs) -> DataFrame:
    """Responses that score a movie by its id, parsed and matched by position."""
    pairs = _watch_pairs(t)
    item = F.struct("position", F.array(F.col("movieId") / 100000.0).alias("p"))
    scores = F.transform(F.sort_array(F.collect_list(item)), lambda x: x["p"])
    responses = pairs.groupBy("userId").agg(
        F.to_json(F.struct(scores.alias("predictions"))).alias("response")
    )
    return _rounded(payloads.parse_predictions(responses, pairs), ["score"], 6)


# ---- projections and lookups ------------------------------------------------------------
@query("SELECT userId, movieId, rating, CAST(label AS INT) AS label FROM labelled", "labelled")
def ratings_labelled(t: Inputs) -> DataFrame:
    return samples.add_label(t.ratings).select("userId", "movieId", "rating", "label")


@query(
    """SELECT movieId, genres[1] AS genre0, genres[2] AS genre1, genres[3] AS genre2
FROM catalogue""",
    "catalogue",
)
def movie_genre_slots(t: Inputs) -> DataFrame:
    return t.catalogue.select(
        "movieId",
        *[samples.slot(F.col("genres"), i).alias(c) for i, c in enumerate(samples.MOVIE_GENRES)],
    )


@query(
    """SELECT e.userId, e.movieId, coalesce(r.rating, -1.0) AS rating
FROM (SELECT DISTINCT userId, movieId FROM rating_events) e
LEFT JOIN ratings r USING (userId, movieId)""",
    "rating_events",
    "ratings",
)
def rating_lookup(t: Inputs) -> DataFrame:
    return lookups.rating_lookup(t.asked, t.ratings)


@query(
    "SELECT movieId, CAST(ceil(av*100) AS DOUBLE)/100 AS displayRating FROM scored_movies",
    "scored_movies",
)
def movie_display_rating(t: Inputs) -> DataFrame:
    return ranking.display_rating(t.scored)


@query(
    """SELECT userId, max(CASE WHEN k=1 THEN genre END) userGenre0,
 max(CASE WHEN k=2 THEN genre END) userGenre1, max(CASE WHEN k=3 THEN genre END) userGenre2,
 max(CASE WHEN k=4 THEN genre END) userGenre3, max(CASE WHEN k=5 THEN genre END) userGenre4
FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY c DESC, f) k FROM (
 SELECT n.userId, g.genre, count(*) c, min(n.rn*10+g.at) f
 FROM numbered n JOIN movie_genres g USING (movieId) WHERE n.label=1 GROUP BY 1,2) a) b
GROUP BY userId""",
    "numbered",
    "movie_genres",
)
def user_genre_ranked(t: Inputs) -> DataFrame:
    return aggregates.user_genres_ranked(t.ratings, t.movies)


_EDGES = """SELECT src, dst, count(*) AS cnt FROM (
 SELECT userId, lag(movieId) OVER (PARTITION BY userId ORDER BY timestamp, movieId) AS src,
  movieId AS dst FROM labelled WHERE label=1) p WHERE src IS NOT NULL GROUP BY src, dst"""


@query(
    f"""SELECT e.src, e.dst, CASE WHEN a.emb IS NULL OR b.emb IS NULL THEN -1.0 ELSE
 round(list_cosine_similarity(CAST(a.emb AS DOUBLE[]), CAST(b.emb AS DOUBLE[])), 6) END AS similarity
FROM ({_EDGES}) e LEFT JOIN item_embeddings a ON a.movieId=e.src
LEFT JOIN item_embeddings b ON b.movieId=e.dst""",
    "labelled",
    "item_embeddings",
)
def item_cosine_pairs(t: Inputs) -> DataFrame:
    """Cosine of every two movies liked one after the other."""
    a = t.embeddings.select(F.col("movieId").alias("src"), F.col("emb").alias("_a"))
    b = t.embeddings.select(F.col("movieId").alias("dst"), F.col("emb").alias("_b"))
    pairs = t.edges.join(a, "src", "left").join(b, "dst", "left")
    return pairs.select(
        "src", "dst", F.round(cosine(F.col("_a"), F.col("_b")), 6).alias("similarity")
    )


@query(
    f"""SELECT e.src, e.dst, round(0.7 * (CAST(len(list_intersect(a.genres, b.genres)) AS DOUBLE)
  / (len(a.genres) + len(b.genres)) / 2) + 0.3 * (b.av / 5), 9) AS score
FROM ({_EDGES}) e JOIN scored_movies a ON a.movieId=e.src JOIN scored_movies b ON b.movieId=e.dst""",
    "labelled",
    "scored_movies",
)
def genre_similarity(t: Inputs) -> DataFrame:
    """Genre score of every two movies liked one after the other."""
    a = t.scored.select(F.col("movieId").alias("src"), F.col("genres").alias("_a"))
    b = t.scored.select(
        F.col("movieId").alias("dst"), F.col("genres").alias("_b"), "averageRating"
    )
    score = recall.genre_score(F.col("_a"), F.col("_b"), F.col("averageRating"))
    joined = t.edges.join(a, "src").join(b, "dst")
    return joined.select("src", "dst", F.round(score, 9).alias("score"))


_HASH = """list_reduce(list_transform(string_split(CAST(userId AS VARCHAR), ''),
  lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: ((h*31 + c + 2147483648) % 4294967296) - 2147483648,
  CAST(0 AS BIGINT))"""
_BUCKETS = f"SELECT userId, CAST({_HASH} % 5 AS INT) AS bucket FROM (SELECT DISTINCT userId FROM ratings) u"
_MODEL = "CASE bucket WHEN 0 THEN 'NeuralCF' WHEN 1 THEN 'DIN' ELSE 'DefaultEmbedding' END"


@query(f"SELECT userId, bucket, {_MODEL} AS model FROM ({_BUCKETS}) b", "ratings")
def ab_bucket(t: Inputs) -> DataFrame:
    return recall.routed_users(tables.derive_users(t.ratings)).select("userId", "bucket", "model")


@query(
    f"""SELECT {_MODEL} AS model, {_MODEL} AS scorer, count(*) AS users,
 round(count(*) / sum(count(*)) OVER (), 6) AS share FROM ({_BUCKETS}) b GROUP BY 1, 2""",
    "ratings",
)
def ab_traffic_share(t: Inputs) -> DataFrame:
    users = recall.routed_users(tables.derive_users(t.ratings))
    counts = users.groupBy("model", "scorer").agg(F.count(F.lit(1)).alias("users"))
    total = counts.agg(F.sum("users")).scalar()
    return counts.withColumn("share", F.round(F.col("users") / total, 6))


@query(
    """SELECT word, count(*) AS cnt FROM (
 SELECT unnest(string_split(line, ' ')) AS word FROM (
  SELECT unnest(string_split(text, chr(10))) AS line FROM documents) l) w GROUP BY word"""
)
def word_count(t: Inputs) -> DataFrame:
    return aggregates.word_count(fixtures.documents(t.spark, t.dir))


# ---- joins ------------------------------------------------------------------------------
@query(
    """SELECT r.userId, r.movieId, r.rating, m.title, m.genres
FROM ratings r LEFT JOIN movies m USING (movieId)""",
    "ratings",
    "movies",
)
def ratings_with_movies(t: Inputs) -> DataFrame:
    return t.ratings.join(t.movies, "movieId", "left").select(
        "userId", "movieId", "rating", "title", "genres"
    )


@query(
    """SELECT r.userId, r.movieId, r.rating, s.cnt AS movieRatingCount,
 round(s.av, 4) AS movieAvgRating, round(s.sd, 4) AS movieRatingStddev
FROM ratings r LEFT JOIN movie_stats s USING (movieId)""",
    "movie_stats",
)
def movie_features_joined(t: Inputs) -> DataFrame:
    joined = _rounded(samples.join_rating_features(t.stored_ratings), ["movieAvgRating", "movieRatingStddev"])
    return joined.select("userId", "movieId", "rating", *samples.MOVIE_STATS)


WATCH_SIZE = 20


@query(
    f"""SELECT userId, movieId, title, CAST(position AS INT) AS position FROM (
 SELECT w.userId, w.movieId, c.title,
  row_number() OVER (PARTITION BY w.userId ORDER BY w.timestamp DESC, w.movieId) AS position
 FROM watchlist w JOIN catalogue c USING (movieId)) x WHERE position <= {WATCH_SIZE}""",
    "watchlist",
    "catalogue",
)
def watchlist_latest(t: Inputs) -> DataFrame:
    latest = ranking.watchlist_latest(t.watchlist, t.catalogue, WATCH_SIZE)
    return latest.select("userId", "movieId", "title", "position")


@query(
    """SELECT e.userId, e.movieId, CAST(w.userId IS NOT NULL AS INT) AS inWatchlist
FROM (SELECT DISTINCT userId, movieId FROM rating_events) e
LEFT JOIN watchlist w USING (userId, movieId)""",
    "rating_events",
    "watchlist",
)
def watchlist_flags(t: Inputs) -> DataFrame:
    flags = lookups.watchlist_flags(t.asked, t.watchlist)
    return flags.withColumn("inWatchlist", _int("inWatchlist"))


@query(
    """SELECT o.event_id, o.userId, o.movieId FROM watchlist_ops o
WHERE o.op='add' AND o.userId IN (SELECT userId FROM ratings)
 AND o.movieId IN (SELECT movieId FROM movies)""",
    "watchlist_ops",
    "ratings",
    "movies",
)
def watchlist_insert_valid(t: Inputs) -> DataFrame:
    inserts = fixtures.watchlist_ops(t.spark, t.dir).where("op = 'add'")
    users = tables.derive_users(t.ratings)
    return lookups.valid_inserts(inserts, users, t.movies).select("event_id", "userId", "movieId")


_RANKED_STATS = ["userAvgRating", "userRatingStddev", "movieAvgRating", "movieRatingStddev"]


@query(
    f"""SELECT p.userId, p.movieId,
 {", ".join(f"coalesce(u.{c}, 0) AS {c}" for c in samples.RATED_MOVIES)},
 {", ".join(f"coalesce(u.{c}, '') AS {c}" for c in samples.USER_GENRES)},
 {", ".join(f"coalesce(m.{c}, '') AS {c}" for c in samples.MOVIE_GENRES)},
 u.userRatingCount, m.movieRatingCount, m.releaseYear,
 round(u.userAvgRating, 4) AS userAvgRating, round(u.userRatingStddev, 4) AS userRatingStddev,
 round(m.movieAvgRating, 4) AS movieAvgRating, round(m.movieRatingStddev, 4) AS movieRatingStddev
FROM (SELECT * FROM (SELECT w.userId, w.movieId,
  row_number() OVER (PARTITION BY w.userId ORDER BY w.timestamp DESC, w.movieId) AS position
  FROM watchlist w JOIN movies x USING (movieId)) y WHERE position <= {WATCH_SIZE}) p
JOIN {_USER_LATEST} u ON u.userId=p.userId JOIN {_MOVIE_LATEST} m ON m.movieId=p.movieId""",
    "mixed",
    "watchlist",
    "movies",
)
def ranking_features(t: Inputs) -> DataFrame:
    rows = _rounded(_ranking_rows(t), _RANKED_STATS)
    return rows.select(*payloads.FEATURE_FIELDS)


# ---- aggregates and features ------------------------------------------------------------
@query(
    """SELECT rating, count(*) AS cnt, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM ratings GROUP BY rating""",
    "ratings",
)
def rating_distribution(t: Inputs) -> DataFrame:
    return _rounded(aggregates.rating_distribution(t.ratings), ["share"], 6)


@query(
    """SELECT movieId, cnt AS movieRatingCount, round(av, 4) AS movieAvgRating,
 round(sd, 4) AS movieRatingStddev FROM movie_stats""",
    "movie_stats",
)
def movie_features(t: Inputs) -> DataFrame:
    out = samples.movie_rating_features(t.ratings)
    return _rounded(out, ["movieAvgRating", "movieRatingStddev"])


@query(
    """SELECT movieId, cnt AS ratingCount, round(av, 4) AS avgRating, round(va, 4) AS ratingVar
FROM movie_stats""",
    "movie_stats",
)
def movie_rating_variance(t: Inputs) -> DataFrame:
    return _rounded(aggregates.movie_rating_variance(t.ratings), ["avgRating", "ratingVar"])


@query(
    """SELECT userId, round(avg(rating), 4) AS averageRating, greatest(max(rating), 0.0) AS highestRating,
 least(min(rating), 5.0) AS lowestRating, count(*) AS ratingCount FROM ratings GROUP BY userId""",
    "ratings",
)
def user_rating_stats(t: Inputs) -> DataFrame:
    return _rounded(aggregates.user_rating_stats(t.ratings), ["averageRating"])


@query(
    """SELECT movieId, userId, rating, timestamp, count(*) OVER (PARTITION BY movieId) - r + 1 AS position
FROM (SELECT *, row_number() OVER (PARTITION BY movieId ORDER BY rating DESC, timestamp, userId) r
 FROM ratings) x WHERE r <= 10""",
    "ratings",
)
def movie_top_ratings(t: Inputs) -> DataFrame:
    return aggregates.movie_top_ratings(t.ratings)


@query(
    """SELECT genre, movieId, count(*) OVER (PARTITION BY genre) AS genreSize FROM movie_genres""",
    "movie_genres",
)
def genre_index(t: Inputs) -> DataFrame:
    return aggregates.genre_index(t.catalogue)


_HISTORY = ", ".join(samples.RATED_MOVIES)
_GENRES = ", ".join(samples.USER_GENRES)


def _history(t: Inputs) -> DataFrame:
    return samples.user_history(t.stored_ratings, t.movies)


@query(f"SELECT userId, movieId, {_HISTORY} FROM history_slots", "history_slots")
def user_history_slots(t: Inputs) -> DataFrame:
    return _history(t).select("userId", "movieId", *samples.RATED_MOVIES)


_STATS_SQL = """userRatingCount, userRatedMovieAvgReleaseYear,
 round(userRatedMovieReleaseYearStddev, 4) AS userRatedMovieReleaseYearStddev,
 round(userAvgRating, 4) AS userAvgRating, round(userRatingStddev, 4) AS userRatingStddev"""
_USER_ROUND = ["userRatedMovieReleaseYearStddev", "userAvgRating", "userRatingStddev"]


@query(f"SELECT userId, movieId, {_STATS_SQL} FROM window_stats", "window_stats")
def user_window_stats(t: Inputs) -> DataFrame:
    out = _history(t).select("userId", "movieId", *samples.USER_STATS)
    return _rounded(out, _USER_ROUND)


@query(f"SELECT userId, movieId, {_GENRES} FROM genre_slots", "genre_slots")
def user_genre_slots(t: Inputs) -> DataFrame:
    return _history(t).select("userId", "movieId", *samples.USER_GENRES)


_MOVIE_ROUND_SQL = "round(movieAvgRating, 4) AS movieAvgRating, round(movieRatingStddev, 4) AS movieRatingStddev"


@query(
    f"""SELECT userId, movieId, rating, timestamp, CAST(label AS INT) AS label, releaseYear,
 genre0, genre1, genre2, movieRatingCount, {_MOVIE_ROUND_SQL}, {_HISTORY}, {_STATS_SQL}, {_GENRES}
FROM mixed""",
    "mixed",
)
def mixed_samples(t: Inputs) -> DataFrame:
    return samples.rounded(t.samples, 4)


@query(
    f"SELECT userId, timestamp, {_HISTORY}, {_STATS_SQL}, {_GENRES} FROM {_USER_LATEST} u", "mixed"
)
def user_features_latest(t: Inputs) -> DataFrame:
    return samples.rounded(samples.latest_user_features(t.stored_ratings, t.movies), 4)


@query(
    f"""SELECT movieId, timestamp, releaseYear, genre0, genre1, genre2, movieRatingCount, {_MOVIE_ROUND_SQL}
FROM {_MOVIE_LATEST} u""",
    "mixed",
)
def movie_features_latest(t: Inputs) -> DataFrame:
    return samples.rounded(samples.latest_movie_features(t.stored_ratings, t.movies), 4)


# ---- sequences and graph ----------------------------------------------------------------
@query(
    """SELECT userId, CAST((p-1)//1000 AS INT) AS segment, CAST(count(*) AS INT) AS items,
 string_agg(CAST(movieId AS VARCHAR), ' ' ORDER BY p) AS sequence
FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY timestamp, movieId) p
 FROM labelled WHERE label=1) x GROUP BY 1, 2""",
    "labelled",
)
def item_sequences(t: Inputs) -> DataFrame:
    rows = graph.item_sequences(t.stored_ratings)
    return rows.select("userId", "segment", F.size("movieIds").alias("items"), "sequence")


@query(
    """SELECT * FROM (SELECT userId,
 lag(movieId) OVER (PARTITION BY userId ORDER BY timestamp, movieId) AS src, movieId AS dst
 FROM labelled WHERE label=1) p WHERE src IS NOT NULL""",
    "labelled",
)
def item_pairs(t: Inputs) -> DataFrame:
    return t.pairs


@query(_EDGES, "labelled")
def item_pair_counts(t: Inputs) -> DataFrame:
    return t.edges


@query(
    f"""SELECT src, dst, cnt, round(cnt / sum(cnt) OVER (PARTITION BY src), 6) AS prob
FROM ({_EDGES}) e""",
    "labelled",
)
def transition_matrix(t: Inputs) -> DataFrame:
    return _rounded(graph.transition_matrix(t.edges), ["prob"], 6)


@query(
    f"""SELECT src AS movieId, CAST(sum(cnt) AS BIGINT) AS outCount,
 round(sum(cnt) / (SELECT sum(cnt) FROM ({_EDGES}) t), 6) AS prob
FROM ({_EDGES}) e GROUP BY src""",
    "labelled",
)
def item_distribution(t: Inputs) -> DataFrame:
    return _rounded(graph.item_distribution(t.edges), ["prob"], 6)


def _draw_sql(step: str, part: int) -> str:
    first = 1 + part * graph.DRAW_DIGITS
    digits = f"substr(md5('7:' || walk || ':' || {step}), {first}, {graph.DRAW_DIGITS})"
    return f"CAST('0x' || {digits} AS BIGINT)"


# Slots to draw from, of every node and, under the key -1, of all starts.
_SLOTS = f"""e AS MATERIALIZED ({_EDGES}),
weights AS (SELECT src AS k, dst AS item, cnt AS c FROM e
 UNION ALL SELECT -1, src, CAST(sum(cnt) AS BIGINT) FROM e GROUP BY src),
shares AS (SELECT *, count(*) OVER (PARTITION BY k) AS n,
 CAST(sum(c) OVER (PARTITION BY k) AS BIGINT) AS total FROM weights),
kinds AS (SELECT *, n * c > total AS rich, greatest(total - n * c, 0) AS lack,
 greatest(n * c - total, 0) AS spare FROM shares),
lines AS (SELECT *, row_number() OVER o - 1 AS slot, sum(CAST(rich AS INT)) OVER o AS upto,
 CASE WHEN rich THEN sum(spare) OVER o ELSE sum(lack) OVER o - lack END AS pos
 FROM kinds WINDOW o AS (PARTITION BY k ORDER BY item)),
met AS (SELECT *, sum(lack) OVER m - lack AS filled,
 CASE WHEN rich THEN upto ELSE sum(CAST(rich AS INT)) OVER m END AS wanted
 FROM lines WINDOW m AS (PARTITION BY k ORDER BY pos, rich DESC, item)),
slots AS MATERIALIZED (SELECT a.k, a.slot, a.item, b.item AS other,
 CASE WHEN a.rich THEN a.total - (a.filled - a.pos) ELSE a.n * a.c END AS keep
 FROM met a LEFT JOIN met b ON b.k = a.k AND b.rich AND b.upto - 1 = a.wanted),
sizes AS MATERIALIZED (SELECT DISTINCT k, n, total FROM shares)"""


@query(
    f"""SELECT walk, CAST(max(step) AS INT) AS length, arg_max(path, step) AS path FROM (
 WITH RECURSIVE {_SLOTS},
 starts AS (SELECT walk, {_draw_sql("0", 0)} % n AS slot, {_draw_sql("0", 1)} % total AS coin
  FROM range({graph.WALKS}) r(walk), sizes WHERE k = -1),
 paths AS (
  SELECT walk, 1 AS step, node, CAST(node AS VARCHAR) AS path
  FROM (SELECT walk, CASE WHEN coin < keep THEN item ELSE other END AS node
   FROM starts JOIN slots ON k = -1 AND starts.slot = slots.slot) s
  UNION ALL
  SELECT walk, step + 1, CASE WHEN coin < keep THEN item ELSE other END,
   path || ' ' || CASE WHEN coin < keep THEN item ELSE other END
  FROM (SELECT paths.*, {_draw_sql("step", 0)} % n AS draw, {_draw_sql("step", 1)} % total AS coin
   FROM paths JOIN sizes ON sizes.k = paths.node WHERE step < {graph.WALK_LENGTH}) p
  JOIN slots ON slots.k = p.node AND slots.slot = p.draw)
 SELECT * FROM paths) w GROUP BY walk""",
    "labelled",
)
def random_walks(t: Inputs) -> DataFrame:
    walks = graph.random_walks(t.pairs)
    return walks.select("walk", F.size("nodes").alias("length"), F.array_join("nodes", " ").alias("path"))


# ---- ordered lists ----------------------------------------------------------------------
TOP, PER_GENRE, PAGE, PAGE_SIZE, RECENT = 800, 20, 2, 30, 20


@query(
    f"""SELECT movieId, round(av, 4) AS averageRating, CAST(position AS INT) AS position FROM (
 SELECT *, row_number() OVER (ORDER BY av DESC, movieId) position FROM scored_movies) x
WHERE position <= {TOP}""",
    "scored_movies",
)
def top_movies_by_rating(t: Inputs) -> DataFrame:
    top = ranking.top_movies(t.scored, "averageRating", TOP)
    return _rounded(top.select("movieId", "averageRating", "position"), ["averageRating"])


@query(
    """SELECT movieId, releaseYear, CAST(position AS INT) AS position FROM (
 SELECT *, row_number() OVER (ORDER BY releaseYear DESC, movieId) position FROM catalogue) x
WHERE position <= 100""",
    "catalogue",
)
def top_movies_by_year(t: Inputs) -> DataFrame:
    top = ranking.top_movies(t.catalogue, "releaseYear", recall.GLOBAL_LIST)
    return top.select("movieId", "releaseYear", "position")


@query(
    f"""SELECT genre, movieId, CAST(position AS INT) AS position, sortedBy FROM (
 SELECT g.genre, g.movieId, 'rating' AS sortedBy,
  row_number() OVER (PARTITION BY g.genre ORDER BY s.av DESC, g.movieId) position
 FROM movie_genres g JOIN scored_movies s USING (movieId)
 UNION ALL SELECT g.genre, g.movieId, 'releaseYear',
  row_number() OVER (PARTITION BY g.genre ORDER BY s.releaseYear DESC, g.movieId)
 FROM movie_genres g JOIN scored_movies s USING (movieId)) x WHERE position <= {PER_GENRE}""",
    "movie_genres",
    "scored_movies",
)
def top_movies_per_genre(t: Inputs) -> DataFrame:
    by_rating = ranking.top_movies_per_genre(t.scored, "averageRating", PER_GENRE)
    by_year = ranking.top_movies_per_genre(t.catalogue, "releaseYear", PER_GENRE)
    names = ["genre", "movieId", "position"]
    return by_rating.select(*names, F.lit("rating").alias("sortedBy")).unionByName(
        by_year.select(*names, F.lit("releaseYear").alias("sortedBy"))
    )


@query(
    f"""SELECT genre, movieId, title, CAST(position AS INT) AS position FROM (
 SELECT g.genre, g.movieId, c.title, row_number() OVER (PARTITION BY g.genre ORDER BY g.movieId) position
 FROM movie_genres g JOIN catalogue c USING (movieId)) x
WHERE position BETWEEN {(PAGE - 1) * PAGE_SIZE + 1} AND {PAGE * PAGE_SIZE}""",
    "movie_genres",
    "catalogue",
)
def genre_page(t: Inputs) -> DataFrame:
    return ranking.genre_page(t.catalogue, PAGE, PAGE_SIZE)


_RECENT = f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY userId
 ORDER BY timestamp DESC, movieId DESC) AS INT) AS position FROM ratings) x WHERE position <= {RECENT}"""


@query(
    f"""SELECT r.userId, p.page, r.movieId, r.position
FROM (SELECT *, count(*) OVER (PARTITION BY userId) n FROM ({_RECENT}) q) r
JOIN (SELECT CAST(unnest(range(1, {RECENT // 7 + 2})) AS INT) AS page) p ON p.page <= ceil(r.n/7.0)
WHERE r.position BETWEEN least((p.page-1)*7, greatest(r.n-7,0))+1 AND least((p.page-1)*7, greatest(r.n-7,0))+7""",
    "ratings",
)
def rec_list_pages(t: Inputs) -> DataFrame:
    lists = ranking.recent_ratings(t.ratings, RECENT)
    return ranking.list_pages(lists, "userId", "position").select(
        "userId", "page", "movieId", "position"
    )


@query(
    """SELECT genre, movieId, CAST(position AS INT) AS position FROM (
 SELECT genre, movieId, dense_rank() OVER (ORDER BY genre) g,
  row_number() OVER (PARTITION BY genre ORDER BY movieId) position FROM movie_genres) x
WHERE g <= 6 AND position <= 7""",
    "movie_genres",
)
def home_page_lists(t: Inputs) -> DataFrame:
    return ranking.home_page(t.catalogue)


@query(f"SELECT userId, movieId, rating, timestamp, position FROM ({_RECENT}) x", "ratings")
def user_recent_ratings(t: Inputs) -> DataFrame:
    return ranking.recent_ratings(t.ratings, RECENT)


# ---- retrieval --------------------------------------------------------------------------
SIMILAR = 10


def _pool_sql(size: int) -> str:
    return f"""SELECT g.genre, g.movieId FROM (SELECT g.genre, g.movieId,
  row_number() OVER (PARTITION BY g.genre ORDER BY s.av DESC, g.movieId) r
  FROM movie_genres g JOIN scored_movies s USING (movieId)) g WHERE r <= {size}"""


@query(
    f"""SELECT seed, movieId, round(score, 9) AS score, CAST(position AS INT) AS position FROM (
 SELECT seed, movieId, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, movieId) position
 FROM (SELECT c.seed, c.movieId, (0.7 * (CAST(len(list_intersect(a.genres, b.genres)) AS DOUBLE)
   / (len(a.genres) + len(b.genres)) / 2) + 0.3 * (b.av / 5)) AS score
  FROM (SELECT DISTINCT s.movieId AS seed, p.movieId FROM movie_genres s
   JOIN ({_pool_sql(recall.SIMILAR_PER_GENRE)}) p USING (genre) WHERE s.movieId <> p.movieId) c
  JOIN scored_movies a ON a.movieId=c.seed JOIN scored_movies b ON b.movieId=c.movieId) x) y
WHERE position <= {SIMILAR}""",
    "movie_genres",
    "scored_movies",
)
def similar_movies_genre(t: Inputs) -> DataFrame:
    return _rounded(recall.similar_movies_by_genre(t.stored_scores, SIMILAR), ["score"], 9)


@query(
    f"""SELECT userId, movieId FROM (
 SELECT DISTINCT h.userId, p.movieId FROM ratings h JOIN movie_genres g USING (movieId)
  JOIN ({_pool_sql(recall.HISTORY_PER_GENRE)}) p ON p.genre=g.genre
 UNION SELECT u.userId, m.movieId FROM (SELECT DISTINCT userId FROM ratings) u,
  (SELECT movieId FROM (SELECT movieId, row_number() OVER (ORDER BY av DESC, movieId) a,
   row_number() OVER (ORDER BY releaseYear DESC, movieId) b FROM scored_movies) z WHERE a<=100 OR b<=100) m) c
WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.userId=c.userId AND r.movieId=c.movieId)""",
    "ratings",
    "movie_genres",
    "scored_movies",
)
def multi_recall(t: Inputs) -> DataFrame:
    return recall.multi_recall(t.stored_ratings, t.catalogue, t.stored_scores)


_COS = "round(list_cosine_similarity(CAST(a.emb AS DOUBLE[]), CAST(b.emb AS DOUBLE[])), 6)"


@query(
    f"""SELECT seed, movieId, score, CAST(position AS INT) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, movieId) position FROM (
  SELECT a.movieId AS seed, b.movieId, {_COS} AS score FROM item_embeddings a
  JOIN movies m ON m.movieId=a.movieId JOIN (SELECT e.* FROM item_embeddings e JOIN (
   SELECT movieId FROM scored_movies ORDER BY av DESC, movieId LIMIT 10000) t USING (movieId)) b
  ON a.movieId <> b.movieId) x) y WHERE position <= {SIMILAR}""",
    "item_embeddings",
    "scored_movies",
)
def similar_movies_embedding(t: Inputs) -> DataFrame:
    return recall.similar_movies_by_embedding(t.stored_scores, t.embeddings, SIMILAR)


_USER_EMB = """SELECT userId, dim, avg(v) AS v FROM (
 SELECT l.userId, CAST(unnest(CAST(e.emb AS DOUBLE[])) AS DOUBLE) AS v, unnest(range(len(e.emb))) AS dim
 FROM labelled l JOIN item_embeddings e USING (movieId) WHERE l.label=1) x GROUP BY userId, dim"""


@query(
    f"SELECT userId, CAST(dim AS INT) AS dim, round(v, 6) AS value FROM ({_USER_EMB}) u",
    "labelled",
    "item_embeddings",
)
def user_embeddings(t: Inputs) -> DataFrame:
    vectors = recall.user_embeddings(t.ratings, t.embeddings)
    out = vectors.select("userId", F.posexplode("emb").alias("dim", "value"))
    return _rounded(out, ["value"], 6)


@query(
    f"""SELECT userId, movieId, score, CAST(position AS INT) AS position FROM (
 SELECT *, row_number() OVER (PARTITION BY userId ORDER BY score DESC, movieId) position FROM (
  SELECT u.userId, p.movieId, CASE WHEN a.emb IS NULL OR b.emb IS NULL THEN -1.0 ELSE {_COS} END AS score
  FROM (SELECT DISTINCT userId FROM ratings) u
  CROSS JOIN (SELECT movieId FROM scored_movies ORDER BY av DESC, movieId LIMIT 800) p
  LEFT JOIN (SELECT userId, list(v ORDER BY dim) AS emb FROM ({_USER_EMB}) q GROUP BY userId) a
   ON a.userId=u.userId
  LEFT JOIN item_embeddings b ON b.movieId=p.movieId) x) y WHERE position <= {SIMILAR}""",
    "labelled",
    "item_embeddings",
    "scored_movies",
)
def user_rank_embedding(t: Inputs) -> DataFrame:
    return recall.recommend_for_users(
        tables.derive_users(t.stored_ratings),
        recall.user_embeddings(t.stored_ratings, t.embeddings),
        t.stored_scores,
        t.embeddings,
        SIMILAR,
    )


@query()
def user_rank_two_tower(t: Inputs) -> DataFrame:
    """The ranking pool ordered by factors trained on all ratings."""
    model = models.fit_als(t.stored_ratings, t.stored_ratings)
    return recall.recommend_by_factors(
        model.userFactors, model.itemFactors, t.stored_scores, SIMILAR
    )


def _rank_by_model(t: Inputs, users: DataFrame) -> DataFrame:
    """The ranking pool ordered by a click model trained on the samples."""
    return recall.recommend_by_click_model(
        models.wide_model(t.stored_samples),
        users,
        samples.latest_user_features(t.stored_ratings, t.movies),
        samples.latest_movie_features(t.stored_ratings, t.movies),
        t.stored_scores,
        SIMILAR,
    )


@query()
def user_rank_model(t: Inputs) -> DataFrame:
    """Each user's ranking pool ordered by a click model."""
    return _rank_by_model(t, tables.derive_users(t.stored_ratings))


@query()
def user_rank_fm(t: Inputs) -> DataFrame:
    """Each user's ranking pool ordered by a factorisation machine."""
    return recall.recommend_by_factorisation(
        models.fm_model(t.stored_samples),
        tables.derive_users(t.stored_ratings),
        samples.latest_user_features(t.stored_ratings, t.movies),
        samples.latest_movie_features(t.stored_ratings, t.movies),
        t.stored_scores,
        SIMILAR,
    )


def _rank_routed(t: Inputs) -> DataFrame:
    """Every user's list from the scorer the user is routed to."""
    routed = materialize(recall.routed_users(tables.derive_users(t.stored_ratings)), "routed")

    def sent(scorer: str) -> DataFrame:
        return routed.where(F.col("scorer") == scorer).select("userId")

    trained = models.fit_als(t.stored_ratings, t.stored_ratings)
    factors = trained.userFactors.withColumnRenamed("id", "userId").join(
        sent("NeuralCF"), "userId", "left_semi"
    )
    by_factors = recall.recommend_by_factors(
        factors.withColumnRenamed("userId", "id"), trained.itemFactors, t.stored_scores, SIMILAR
    )
    by_vectors = recall.recommend_for_users(
        sent(traffic.DEFAULT_MODEL),
        recall.user_embeddings(t.stored_ratings, t.embeddings),
        t.stored_scores,
        t.embeddings,
        SIMILAR,
    )
    lists = by_factors.unionByName(_rank_by_model(t, sent("DIN"))).unionByName(by_vectors)
    return lists.join(routed.select("userId", "model", "scorer"), "userId")


@query()
def user_rank_routed(t: Inputs) -> DataFrame:
    return _rank_routed(t)


@query(
    f"""SELECT userId, {_MODEL} AS model, {_MODEL} AS scorer,
 CAST(least({SIMILAR}, (SELECT count(*) FROM scored_movies)) AS BIGINT) AS movies FROM ({_BUCKETS}) b""",
    "ratings",
    "scored_movies",
)
def user_rank_routed_lists(t: Inputs) -> DataFrame:
    """How many movies each routed user is shown, all different and in unbroken positions."""
    shown = _rank_routed(t).groupBy("userId", "model", "scorer").agg(
        F.countDistinct("movieId").alias("movies"), F.max("position").alias("_last")
    )
    return shown.where(F.col("movies") == F.col("_last")).drop("_last")


@query()
def lsh_neighbors(t: Inputs) -> DataFrame:
    """Approximate neighbours of the embedding with the lowest movie id."""
    first = t.embeddings.orderBy("movieId").first()
    found = models.nearest_by_hashing(t.embeddings, [float(x) for x in first["emb"]])
    return _rounded(found, ["distance"], 6)


@query()
def lsh_neighbors_all(t: Inputs) -> DataFrame:
    """Approximate neighbours of every item."""
    return neighbours.nearest_for_all(t.embeddings, models.NEIGHBOURS)


_SEEDS = 20


@query(
    f"""SELECT count(*) AS seeds, count(*) * least({models.NEIGHBOURS}, (SELECT count(*) FROM item_embeddings) - 1) AS listed,
 true AS distancesRight, true AS recallReached FROM item_embeddings WHERE movieId % {_SEEDS} = 0""",
    "item_embeddings",
)
def lsh_recall(t: Inputs) -> DataFrame:
    """The lists of every 20th item against the exact ones: is the recall 0.9 or more?"""
    k = models.NEIGHBOURS
    found = materialize(neighbours.nearest_for_all(t.embeddings, k), "found")
    norm = F.aggregate("emb", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    wide = F.transform("emb", lambda x: x.cast("double"))
    # |u - v|^2 = |u|^2 - 2 (u v - |v|^2 / 2): the exact lists come from the block scorer
    seeds = t.embeddings.where(F.col("movieId") % _SEEDS == 0).select(
        F.col("movieId").alias("seed"), F.concat(wide, F.array(F.lit(1.0))).alias("emb")
    )
    pool = t.embeddings.select("movieId", F.concat(wide, F.array(-norm / 2)).alias("emb"))
    exact = top_by_product(seeds, "seed", pool, k, drop_self=True, normalized=False)
    lists = found.where(F.col("movieId") % _SEEDS == 0)
    pairs = lists.select(F.col("movieId").alias("seed"), F.col("neighbour").alias("movieId"), "distance")
    hits = exact.join(pairs, ["seed", "movieId"], "left").agg(
        (F.count("distance") / F.count(F.lit(1)) >= 0.9).alias("recallReached")
    )
    one, other = (t.embeddings.select(F.col("movieId").alias(n), F.col("emb").alias(f"_{n}")) for n in ("seed", "movieId"))
    apart = F.zip_with("_seed", "_movieId", lambda a, b: (a.cast("double") - b.cast("double")))
    checked = pairs.join(one, "seed").join(other, "movieId").select(
        F.abs(F.sqrt(F.aggregate(apart, F.lit(0.0), lambda s, x: s + x * x)) - F.col("distance")).alias("off")
    )
    listed = checked.agg(F.count(F.lit(1)).alias("listed"), (F.max("off") < 1e-5).alias("distancesRight"))
    return seeds.agg(F.count(F.lit(1)).alias("seeds")).crossJoin(listed).crossJoin(hits)


# ---- encodings --------------------------------------------------------------------------
@query(
    """SELECT movieId, CAST((SELECT max(movieId) + 1 FROM movies) AS INT) AS size, movieId AS hot,
 1.0::DOUBLE AS value FROM movies""",
    "movies",
)
def one_hot_movie(t: Inputs) -> DataFrame:
    parts = encoders.sparse_parts("vector")
    return encoders.one_hot_movie(t.movies.select("movieId")).select(
        "movieId",
        parts["size"].alias("size"),
        parts["indices"][0].alias("hot"),
        parts["values"][0].alias("value"),
    )


_GENRE_INDEX = """SELECT genre, count(*) AS cnt,
 row_number() OVER (ORDER BY count(*) DESC, genre) - 1 AS genreIndex FROM movie_genres GROUP BY genre"""


@query(f"SELECT genre, cnt, CAST(genreIndex AS INT) AS genreIndex FROM ({_GENRE_INDEX}) g", "movie_genres")
def genre_index_map(t: Inputs) -> DataFrame:
    return encoders.genre_indices(t.catalogue)


@query(
    f"""SELECT m.movieId, string_agg(CAST(g.genreIndex AS VARCHAR), '|' ORDER BY g.genreIndex) AS indexes,
 string_agg(CAST(g.genreIndex AS VARCHAR), '|' ORDER BY g.genreIndex) AS hot, CAST(count(*) AS DOUBLE) AS ones,
 (SELECT CAST(count(*) AS INT) FROM ({_GENRE_INDEX}) c) AS indexSize
FROM movie_genres m JOIN ({_GENRE_INDEX}) g USING (genre) GROUP BY m.movieId""",
    "movie_genres",
)
def multi_hot_genres(t: Inputs) -> DataFrame:
    parts = encoders.sparse_parts("vector")
    return encoders.multi_hot_genres(t.catalogue).select(
        "movieId",
        F.array_join("genreIndexes", "|").alias("indexes"),
        F.array_join(parts["indices"], "|").alias("hot"),
        F.aggregate(parts["values"], F.lit(0.0), lambda s, x: s + x).alias("ones"),
        "indexSize",
    )


@query()
def rating_count_buckets(t: Inputs) -> DataFrame:
    stats = aggregates.movie_rating_variance(t.ratings).select("movieId", "ratingCount")
    fitted = encoders.count_discretizer().fit(stats).transform(stats)
    return fitted.withColumn("ratingCountBucket", _int("ratingCountBucket"))


@query(
    """SELECT movieId, round(av, 4) AS avgRating,
 round((av - min(av) OVER ()) / (max(av) OVER () - min(av) OVER ()), 6) AS scaledRating FROM movie_stats""",
    "movie_stats",
)
def avg_rating_scaled(t: Inputs) -> DataFrame:
    stats = aggregates.movie_rating_variance(t.ratings).select("movieId", "avgRating")
    scaled = encoders.min_max(stats, "avgRating", "scaledRating")
    return _rounded(_rounded(scaled, ["scaledRating"], 6), ["avgRating"])


@query()
def chained_features(t: Inputs) -> DataFrame:
    stats = aggregates.movie_rating_variance(t.ratings)
    out = encoders.rating_pipeline(stats).transform(stats)
    return out.select(
        "movieId",
        _int("ratingCountBucket"),
        F.round(vector_to_array("scaleAvgRating")[0], 6).alias("scaledRating"),
    )


@query(
    """SELECT * FROM (WITH v AS (
 SELECT genre, CAST(row_number() OVER (ORDER BY genre) - 1 AS INT) AS position
 FROM (SELECT DISTINCT genre FROM movie_genres) g)
SELECT c.movieId, c.genres[1] AS genre0, c.genres[2] AS genre1, c.genres[3] AS genre2,
 coalesce(a.position, -1) AS genre0Index, coalesce(b.position, -1) AS genre1Index,
 coalesce(d.position, -1) AS genre2Index
FROM catalogue c LEFT JOIN v a ON a.genre=c.genres[1] LEFT JOIN v b ON b.genre=c.genres[2]
LEFT JOIN v d ON d.genre=c.genres[3]) q""",
    "catalogue",
    "movie_genres",
)
def genre_vocab_index(t: Inputs) -> DataFrame:
    names = samples.MOVIE_GENRES
    rows = t.catalogue.select(
        "movieId", *[F.get("genres", F.lit(i)).alias(c) for i, c in enumerate(names)]
    )
    words = tables.genre_vocabulary(t.catalogue)
    for c in names:
        rows = encoders.vocabulary_index(rows, c, words, f"{c}Index")
    return rows


_USER_GENRE_SQL = " UNION ALL ".join(
    f"SELECT userId, {i} AS slot, {c} AS genre FROM {_USER_LATEST} u{i}"
    for i, c in enumerate(samples.USER_GENRES)
)


@query(
    f"""SELECT * FROM (WITH v AS (
 SELECT genre, CAST(row_number() OVER (ORDER BY genre) - 1 AS INT) AS position
 FROM (SELECT DISTINCT genre FROM movie_genres) g)
SELECT s.userId, CAST(s.slot AS INT) AS slot, s.genre, coalesce(v.position, -1) AS genreIndex
FROM ({_USER_GENRE_SQL}) s LEFT JOIN v USING (genre)) q""",
    "mixed",
    "movie_genres",
)
def user_genre_vocab_index(t: Inputs) -> DataFrame:
    """The five genre columns of every user as vocabulary positions."""
    latest = samples.latest_user_features(t.stored_ratings, t.movies)
    slots = F.array(*[F.col(c) for c in samples.USER_GENRES])
    rows = latest.select("userId", F.posexplode(slots).alias("slot", "genre"))
    return encoders.vocabulary_index(rows, "genre", tables.genre_vocabulary(t.catalogue), "genreIndex")


@query(
    """SELECT userId, movieId, CASE WHEN userId < (SELECT max(userId) + 1 FROM ratings) THEN userId ELSE 0 END AS userIndex,
 CASE WHEN movieId < (SELECT max(movieId) + 1 FROM ratings) THEN movieId ELSE 0 END AS movieIndex,
 (SELECT CAST(max(userId) + 1 AS INT) FROM ratings) AS userSpace,
 (SELECT CAST(max(movieId) + 1 AS INT) FROM ratings) AS movieSpace FROM ratings""",
    "ratings",
)
def id_columns(t: Inputs) -> DataFrame:
    """User and movie ids as category columns whose bounds come from the data."""
    out = encoders.id_column(t.stored_ratings, "userId", "userIndex", "userSpace")
    return encoders.id_column(out, "movieId", "movieIndex", "movieSpace").select(
        "userId", "movieId", "userIndex", "movieIndex", "userSpace", "movieSpace"
    )


@query(
    f"""SELECT userId, movieId, userRatedMovie0,
 CAST((CAST(movieId AS BIGINT) * {encoders.CROSS_FACTORS[0]} + CAST(userRatedMovie0 AS BIGINT) * {encoders.CROSS_FACTORS[1]})
  % {encoders.CROSS_PRIME} % {encoders.CROSS_BUCKETS} AS INT) AS crossed FROM mixed""",
    "mixed",
)
def crossed_feature(t: Inputs) -> DataFrame:
    return t.samples.select(
        "userId", "movieId", "userRatedMovie0", encoders.crossed().alias("crossed")
    )


@query(
    """SELECT movieId, userRatedMovie0, count(*) AS cnt, CAST(sum(label) AS BIGINT) AS likedCnt
FROM mixed WHERE userRatedMovie0 IS NOT NULL GROUP BY 1, 2""",
    "mixed",
)
def cross_counts(t: Inputs) -> DataFrame:
    return encoders.cross_counts(t.samples)


@query(
    "SELECT userId, movieId, CAST(label AS INT) AS label, "
    + ", ".join(f"round(CAST(coalesce({c}, 0) AS DOUBLE), 4) AS {c}" for c in encoders.NUMERIC)
    + " FROM mixed",
    "mixed",
)
def numeric_features(t: Inputs) -> DataFrame:
    return _rounded(encoders.numeric_features(t.samples), encoders.NUMERIC)


@query(
    """SELECT userId, movieId, CAST(max(cnt) AS INT) AS slots, round(max(weight), 6) AS weight,
 string_agg(CAST(CAST(round(pooled * 1e6) AS BIGINT) AS VARCHAR), ' ' ORDER BY dim) AS pooled
FROM (SELECT userId, movieId, dim, count(*) AS cnt, sum(w) AS weight, sum(w * v) AS pooled
FROM (SELECT x.userId, x.movieId, unnest(CAST(p.emb AS DOUBLE[])) AS v, generate_subscripts(p.emb, 1) AS dim,
  1.0 / (1.0 + exp(-list_dot_product(CAST(p.emb AS DOUBLE[]), CAST(c.emb AS DOUBLE[])))) AS w
 FROM (SELECT userId, movieId, unnest([userRatedMovie0, userRatedMovie1, userRatedMovie2,
   userRatedMovie3, userRatedMovie4]) AS past FROM mixed) x
 JOIN item_embeddings p ON p.movieId=x.past JOIN item_embeddings c ON c.movieId=x.movieId) y
GROUP BY userId, movieId, dim) z GROUP BY userId, movieId""",
    "mixed",
    "item_embeddings",
)
def history_attention_pool(t: Inputs) -> DataFrame:
    """All dimensions of the pooled vectors, in millionths."""
    pooled = attention.history_attention_pool(t.samples, t.embeddings)
    millionths = F.transform("pooled", lambda x: F.round(x * 1e6).cast("bigint").cast("string"))
    out = pooled.select(
        "userId", "movieId", "slots", "weight", F.array_join(millionths, " ").alias("pooled")
    )
    return _rounded(out, ["weight"], 6)


# ---- splits and metrics -----------------------------------------------------------------
def _split_report(train: DataFrame, test: DataFrame) -> DataFrame:
    both = train.withColumn("split", F.lit("train")).unionByName(
        test.withColumn("split", F.lit("test"))
    )
    return both.groupBy("split").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min("timestamp").alias("firstTime"),
        F.max("timestamp").alias("lastTime"),
    )


@query()
def split_random(t: Inputs) -> DataFrame:
    train, test = splits.random_split(t.stored_ratings, seed=7)
    return _split_report(train, test)


@query()
def demo_sample(t: Inputs) -> DataFrame:
    return splits.demo_sample(t.ratings, seed=7)


@query(
    f"SELECT userId, movieId, {_SPLIT_SQL} THEN 'train' ELSE 'test' END AS split FROM ratings",
    "ratings",
)
def split_hash(t: Inputs) -> DataFrame:
    inside = splits.hash_bucket() < 8
    return t.ratings.select(
        "userId", "movieId", F.when(inside, "train").otherwise("test").alias("split")
    )


_QUANTILE = """SELECT min(timestamp) AS split FROM (SELECT timestamp,
 sum(count(*)) OVER (ORDER BY timestamp) AS upto, sum(count(*)) OVER () AS n
 FROM ratings GROUP BY timestamp) q WHERE 5*upto >= 4*n"""


@query(
    f"""SELECT CASE WHEN timestamp <= split THEN 'train' ELSE 'test' END AS split, count(*) AS cnt,
 min(timestamp) AS firstTime, max(timestamp) AS lastTime
FROM ratings, ({_QUANTILE}) s GROUP BY 1""",
    "ratings",
)
def split_by_time(t: Inputs) -> DataFrame:
    return _split_report(*splits.split_by_time(t.stored_ratings, exact=True))


@query()
def split_by_time_approx(t: Inputs) -> DataFrame:
    return _split_report(*splits.split_by_time(t.stored_ratings))


_SHARES, _RANK_ERROR = [i / 10 for i in range(1, 10)], 0.01


@query(
    f"""SELECT c AS "column", share, n AS "rows", true AS within
FROM (SELECT count(*) AS n FROM ratings) t, (SELECT unnest(['userId', 'movieId', 'rating', 'timestamp']) AS c) x,
 (SELECT CAST(unnest({_SHARES}) AS DOUBLE) AS share) y""",
    "ratings",
)
def quantiles_approx(t: Inputs) -> DataFrame:
    """Deciles of four columns from merged summaries, held against their exact ranks."""
    columns = ["userId", "movieId", "rating", "timestamp"]
    found = splits.approx_quantiles(t.stored_ratings, columns, _SHARES, _RANK_ERROR)
    ranked = splits.rank_errors(t.stored_ratings, found)
    return ranked.select(
        "column", "share", "rows", (F.col("error") <= _RANK_ERROR).alias("within")
    )


@query(_QUANTILE, "ratings")
def quantile_split_exact(t: Inputs) -> DataFrame:
    return splits.exact_quantile(t.stored_ratings, "timestamp")


@query(
    """SELECT round(sqrt(avg((r.rating - s.av) * (r.rating - s.av))), 6) AS rmse, count(*) AS cnt
FROM ratings r JOIN movie_stats s USING (movieId)""",
    "movie_stats",
)
def baseline_rmse(t: Inputs) -> DataFrame:
    out = evaluation.rmse(evaluation.movie_mean_predictions(t.stored_ratings), "rating", "prediction")
    return _rounded(out, ["rmse"], 6)


@query(
    """SELECT round(sum(CAST(pos AS DOUBLE) * (2*(below - neg) + neg)) / (2.0 * sum(pos) * sum(neg)), 6) AS auc,
 CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives
FROM (SELECT av, sum(label) AS pos, sum(1-label) AS neg,
  sum(sum(1-label)) OVER (ORDER BY av) AS below
 FROM labelled JOIN movie_stats USING (movieId) GROUP BY av) x""",
    "labelled",
    "movie_stats",
)
def auc_rank_sum(t: Inputs) -> DataFrame:
    """How well a movie's mean rating ranks liked above disliked events."""
    scored = samples.add_label(evaluation.movie_mean_predictions(t.stored_ratings))
    return _rounded(evaluation.auc(scored, "label", "prediction"), ["auc"], 6)


# ---- models -----------------------------------------------------------------------------
def _fitted_als(t: Inputs):
    train, test = splits.hash_split(t.stored_ratings)
    return models.fit_als(t.stored_ratings, train), train, test


@query()
def als_rmse(t: Inputs) -> DataFrame:
    model, _, test = _fitted_als(t)
    return _metrics(t, {"rmse": models.rmse_evaluator().evaluate(model.transform(test))})


@query()
def als_factors(t: Inputs) -> DataFrame:
    return models.factors(_fitted_als(t)[0])


@query()
def als_user_recs(t: Inputs) -> DataFrame:
    return models.recommendations(_fitted_als(t)[0], "userId", "movieId")


@query()
def als_item_recs(t: Inputs) -> DataFrame:
    return models.recommendations(_fitted_als(t)[0], "movieId", "userId")


@query()
def als_subset_recs(t: Inputs) -> DataFrame:
    model, train, _ = _fitted_als(t)
    users = model.recommendForUserSubset(
        models.first_ids(train, "userId"), models.RECOMMENDATIONS
    )
    items = model.recommendForItemSubset(
        models.first_ids(train, "movieId"), models.RECOMMENDATIONS
    )
    names = ["side", "id", "position", "other", "score"]
    by_user = models.flat_recommendations(users, "userId", "movieId")
    by_item = models.flat_recommendations(items, "movieId", "userId")
    return (
        by_user.select(F.lit("user"), "userId", "position", "movieId", "score")
        .toDF(*names)
        .union(by_item.select(F.lit("movie"), "movieId", "position", "userId", "score").toDF(*names))
    )


@query()
def als_cv(t: Inputs) -> DataFrame:
    train, _ = splits.hash_split(t.stored_ratings)
    fitted = models.cross_validate(train)
    return _metrics(t, {"averageRmse": fitted.avgMetrics[0], "folds": models.FOLDS})


@query()
def two_tower_scores(t: Inputs) -> DataFrame:
    model, _, test = _fitted_als(t)
    return models.two_tower_scores(model, test.select("userId", "movieId", "rating"))


def _item2vec(t: Inputs):
    sequences = graph.item_sequences(t.stored_ratings).select("movieIds")
    return models.item2vec(materialize(sequences, "sequences"), "movieIds")


@query()
def item2vec_vectors(t: Inputs) -> DataFrame:
    return models.vectors_of(_item2vec(t))


@query()
def item2vec_synonyms(t: Inputs) -> DataFrame:
    """The nearest items of every item."""
    return models.synonyms(materialize(models.vectors_of(_item2vec(t)), "vectors"))


@query(
    """SELECT prefix, vectors, 10 AS width, true AS unchanged FROM (
 SELECT 'i2vEmb' AS prefix, count(DISTINCT movieId) AS vectors FROM labelled WHERE label=1
 UNION ALL SELECT 'uEmb', count(DISTINCT userId) FROM labelled WHERE label=1) x""",
    "labelled",
)
def trained_vectors_stored(t: Inputs) -> DataFrame:
    """Item2vec vectors and the users' means of them, stored and read back by prefix."""
    store = VectorStore(t.spark, fresh_path(t.spark, "vectors"))
    items = materialize(models.vectors_of(_item2vec(t)), "vectors")
    users = recall.user_embeddings(t.stored_ratings, items).select(
        "userId", F.col("emb").cast("array<float>").alias("emb")
    )
    users = materialize(users, "vectors")
    made = {embedding_files.ITEM2VEC: (items, "movieId"), embedding_files.USER: (users, "userId")}
    reports = None
    for prefix, (vectors, key) in made.items():
        store.write(vectors, prefix, key)
        read = store.read(prefix, key).select(key, F.col("emb").alias("_read"))
        report = vectors.join(read, key, "full").agg(
            F.lit(prefix).alias("prefix"),
            F.count(F.lit(1)).alias("vectors"),
            F.max(F.size("_read")).alias("width"),
            F.bool_and(F.col("emb").eqNullSafe(F.col("_read"))).alias("unchanged"),
        )
        reports = report if reports is None else reports.unionByName(report)
    return reports


@query()
def graph_embedding(t: Inputs) -> DataFrame:
    walks = materialize(graph.random_walks(t.pairs), "walks")
    words = walks.select(F.transform("nodes", lambda n: n.cast("string")).alias("words"))
    store = VectorStore(t.spark, fresh_path(t.spark, "vectors"))
    store.write(models.vectors_of(models.item2vec(words, "words")), embedding_files.GRAPH)
    return store.read(embedding_files.GRAPH)


def _sample_split(t: Inputs) -> tuple[DataFrame, DataFrame]:
    return splits.hash_split(t.stored_samples)


def _model_metrics(t: Inputs, fit: Callable) -> DataFrame:
    train, test = _sample_split(t)
    scored = materialize(
        models.score(fit(train), test).select("label", "prediction", "probability", "rawPrediction"),
        "scored",
    )
    return _metrics(t, evaluation.classification_metrics(scored))


@query()
def wide_lr_metrics(t: Inputs) -> DataFrame:
    return _model_metrics(t, models.wide_model)


@query()
def fm_metrics(t: Inputs) -> DataFrame:
    return _model_metrics(t, models.fm_model)


@query()
def mlp_metrics(t: Inputs) -> DataFrame:
    """The perceptron with trained factors of users and movies among its inputs."""
    known, _ = splits.hash_split(t.stored_ratings)
    vectors = models.factor_vectors(models.fit_als(t.stored_ratings, known))
    return _model_metrics(t, lambda train: models.mlp_model(train, vectors))


@query()
def wide_predictions(t: Inputs) -> DataFrame:
    """Label and predicted probability of every held-out sample."""
    train, test = _sample_split(t)
    scored = models.score(models.wide_model(train), test)
    return scored.select(
        "userId", "movieId", "label", vector_to_array("probability")[1].alias("probability")
    )


# ---- streams and changes ----------------------------------------------------------------
@query(
    """SELECT epoch_us(date_trunc('hour', make_timestamp(timestamp))) AS windowStart, userId,
 arg_max(event_id, timestamp) AS eventId, arg_max(movieId, timestamp) AS latestMovieId,
 arg_max(rating, timestamp) AS rating, max(timestamp) AS ts FROM rating_events GROUP BY 1, 2""",
    "rating_events",
)
def stream_latest_rating(t: Inputs) -> DataFrame:
    out = rating_stream.run_latest(t.event_stream())
    return out.withColumns({c: F.unix_micros(c) for c in ("windowStart", "ts")})


@query(
    """SELECT concat('uf:', userId) AS key, userId, arg_max(movieId, timestamp) AS latestMovieId,
 arg_max(rating, timestamp) AS rating, max(timestamp) AS updatedAt FROM rating_events GROUP BY userId""",
    "rating_events",
)
def stream_feature_upsert(t: Inputs) -> DataFrame:
    return rating_stream.run_feature_upserts(t.event_stream())


_DELIVERIES = 4
# Every delivery covers the whole month, so later ones are late for closed hours.
_DELIVERED = f"""WITH delivered AS (SELECT *, event_id % {_DELIVERIES} AS delivery FROM rating_events),
closing AS (SELECT delivery + 1 AS delivery,
  max(max(timestamp)) OVER (ORDER BY delivery) - {rating_stream.DELAY_MICROS} AS closed
 FROM delivered GROUP BY delivery),
judged AS (SELECT d.*, coalesce(epoch_us(date_trunc('hour', make_timestamp(d.timestamp))) + {rating_stream.HOUR_MICROS} <= c.closed, false) AS late
 FROM delivered d LEFT JOIN closing c USING (delivery))"""


def _delivered(t: Inputs) -> rating_stream.HourLedger:
    """All events in four deliveries, each processed by a run of its own."""
    events = fixtures.table(t.spark, t.dir, "events")
    folder = fresh_path(t.spark, "deliveries")
    for part in range(_DELIVERIES):
        arrived = events.where(F.col("event_id") % _DELIVERIES == part)
        arrived.write.parquet(f"{folder}/in/delivery={part}")
        stream = rating_stream.read_stream(t.spark, f"{folder}/in/*", events.schema)
        job = rating_stream.HourLedger(fixtures.rating_events_of(stream), folder)
        job.run()
    return job


@query(
    f"""SELECT * FROM ({_DELIVERED} SELECT event_id AS eventId, userId, movieId, rating, timestamp AS ts,
 CAST(delivery AS BIGINT) AS batch FROM judged WHERE late) q""",
    "rating_events",
)
def stream_late_rows(t: Inputs) -> DataFrame:
    """Events that came after their hour had closed, and with which delivery."""
    return _delivered(t).late.read().select(
        F.col("event_id").alias("eventId"),
        "userId",
        "movieId",
        "rating",
        F.unix_micros("ts").alias("ts"),
        "batch",
    )


@query(
    f"""SELECT * FROM ({_DELIVERED} SELECT epoch_us(date_trunc('hour', make_timestamp(timestamp))) AS windowStart,
 userId, arg_max(event_id, (timestamp, event_id)) AS eventId,
 arg_max(movieId, (timestamp, event_id)) AS latestMovieId,
 arg_max(rating, (timestamp, event_id)) AS rating, max(timestamp) AS ts
FROM judged WHERE NOT late GROUP BY 1, 2) q""",
    "rating_events",
)
def stream_hours_in_time(t: Inputs) -> DataFrame:
    """Hourly latest ratings from the events that came in time."""
    out = _delivered(t).hours.read()
    return out.withColumns({c: F.unix_micros(c) for c in ("windowStart", "ts")})


@query(
    """SELECT event_id, userId, movieId, rating, CAST(rating >= 3.5 AS INT) AS label, timestamp AS ts
FROM rating_events""",
    "rating_events",
)
def stream_samples_appended(t: Inputs) -> DataFrame:
    """Training samples appended by the sink of the rating stream."""
    _, log = rating_stream.run_sink(t.event_stream(), fresh_path(t.spark, "sink"))
    return log.read().withColumn("ts", F.unix_micros("ts"))


_UPSERTED = f"""SELECT userId, movieId, rating, timestamp FROM (
 SELECT *, row_number() OVER (PARTITION BY userId, movieId ORDER BY timestamp DESC, event_id DESC) r
 FROM rating_events) x WHERE r=1"""


@query(_UPSERTED, "rating_events")
def ratings_upserted(t: Inputs) -> DataFrame:
    """Events before the cut-off as table, later ones as changes."""
    later = F.col("timestamp") >= fixtures.CHANGES_FROM
    out = changes.upsert_ratings(
        t.events.where(~later), t.events.where(later), ["timestamp", "event_id"]
    )
    return out.select("userId", "movieId", "rating", "timestamp")


@query(_UPSERTED, "rating_events")
def stream_ratings_upserted(t: Inputs) -> DataFrame:
    """The same with the changes as a stream."""
    later = F.col("timestamp") >= fixtures.CHANGES_FROM
    out = rating_stream.run_rating_upserts(t.event_stream().where(later), t.events.where(~later))
    return out.select("userId", "movieId", "rating", "timestamp")


@query(
    """SELECT l.userId, l.movieId, l.timestamp FROM (
 SELECT *, row_number() OVER (PARTITION BY userId, movieId ORDER BY timestamp DESC, event_id DESC) r
 FROM watchlist_ops WHERE op <> 'clear') l
LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY timestamp DESC, event_id DESC) r
 FROM watchlist_ops WHERE op='clear') q WHERE r=1) c ON c.userId=l.userId
WHERE l.r=1 AND l.op='add' AND (c.userId IS NULL OR l.timestamp > c.timestamp
 OR (l.timestamp = c.timestamp AND l.event_id > c.event_id))""",
    "watchlist_ops",
)
def watchlist_snapshot(t: Inputs) -> DataFrame:
    return changes.watchlist_snapshot(
        fixtures.watchlist_ops(t.spark, t.dir), ["timestamp", "event_id"]
    )
