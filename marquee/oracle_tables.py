"""The inputs of `fixtures.py` as DuckDB common table expressions, and shared derived ones."""

from __future__ import annotations

DAY = "CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT)*86400"
K = "CAST(json_extract_string(props,'$.k') AS INT)"

# name -> (names it builds on, SQL)
TABLES: dict[str, tuple[list[str], str]] = {
    "ratings": (
        [],
        f"""SELECT userId, movieId, rating, ts AS timestamp FROM (
 SELECT *, row_number() OVER (PARTITION BY userId, movieId ORDER BY ts DESC, rating DESC) rn FROM (
  SELECT CAST(o_custkey AS INT) userId, CAST(l_partkey AS INT) movieId,
   CAST(0.5 + 0.5*((CAST(l_quantity AS INT)-1)%10) AS DOUBLE) rating, {DAY} ts
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey) a) b WHERE rn=1""",
    ),
    "movies": (
        [],
        """SELECT CAST(p_partkey AS INT) movieId,
 CASE WHEN p_partkey%50=0 THEN p_name
  ELSE concat(p_name,' (',CAST(1950+p_size AS STRING),')') END title,
 CASE p_partkey%3 WHEN 0 THEN p_type WHEN 1 THEN concat_ws('|',p_type,split_part(p_name,' ',1))
  ELSE concat_ws('|',p_type,split_part(p_name,' ',1),split_part(p_name,' ',2)) END genres
FROM part""",
    ),
    "links": (
        [],
        """SELECT CAST(p_partkey AS INT) movieId, lpad(CAST(p_partkey*7 AS STRING),7,'0') imdbId,
 CASE WHEN p_partkey%89=0 THEN '' ELSE CAST(p_partkey+10000 AS STRING) END tmdbId FROM part""",
    ),
    "rating_events": (
        [],
        f"""SELECT event_id, CAST(user_id AS INT) userId, {K} movieId,
 CAST(0.5+0.5*(CAST(floor(value) AS INT)%10) AS DOUBLE) rating, epoch_us(ts) AS timestamp
FROM events""",
    ),
    "watchlist": (
        [],
        f"""SELECT CAST(o_custkey AS INT) userId, CAST(l_partkey AS INT) movieId,
 max({DAY}) AS timestamp
FROM lineitem JOIN orders ON l_orderkey=o_orderkey
WHERE l_returnflag='R' AND l_linestatus='O' GROUP BY 1,2""",
    ),
    "watchlist_ops": (
        [],
        f"""SELECT event_id, CAST(user_id AS INT) userId, {K} movieId, epoch_us(ts) AS timestamp,
 CASE event_type WHEN 'error' THEN 'del' WHEN 'signup' THEN 'clear' ELSE 'add' END op FROM events""",
    ),
    "item_embeddings": (
        [],
        "SELECT CAST(vec_id AS INT) movieId, embedding emb FROM embeddings",
    ),
    # ---- derived ----
    "catalogue": (
        ["movies"],
        r"""SELECT movieId,
 trim(regexp_replace(trim(title), '\((\d{4})\)\s*$', '')) title,
 coalesce(TRY_CAST(nullif(regexp_extract(title, '\((\d{4})\)\s*$', 1), '') AS INT), 0) releaseYear,
 coalesce(TRY_CAST(nullif(regexp_extract(title, '\((\d{4})\)\s*$', 1), '') AS INT), 1990) featureYear,
 string_split(genres, '|') genres FROM movies""",
    ),
    "movie_genres": (
        ["catalogue"],
        """SELECT movieId, unnest(genres) genre, generate_subscripts(genres, 1) AS at,
 len(genres) AS n FROM catalogue""",
    ),
    "movie_stats": (
        ["ratings"],
        """SELECT movieId, cnt, av, coalesce(sqrt(va), 0.0) AS sd, va FROM (
 SELECT *, CASE WHEN cnt > 1 THEN CAST(cnt * h2 - h1 * h1 AS DOUBLE) / (4 * cnt * (cnt - 1)) END AS va FROM (
  SELECT movieId, count(*) AS cnt, avg(rating) AS av, sum(CAST(round(rating * 2) AS BIGINT)) AS h1,
   sum(CAST(round(rating * 2) AS BIGINT) * CAST(round(rating * 2) AS BIGINT)) AS h2
  FROM ratings GROUP BY movieId) x) y""",
    ),
    "scored_movies": (
        ["catalogue", "movie_stats"],
        """SELECT c.movieId, c.title, c.releaseYear, c.genres, coalesce(s.av, 0.0) av
FROM catalogue c LEFT JOIN movie_stats s USING (movieId)""",
    ),
    "labelled": (
        ["ratings"],
        "SELECT *, CASE WHEN rating >= 3.5 THEN 1 ELSE 0 END AS label FROM ratings",
    ),
    "numbered": (
        ["labelled", "catalogue"],
        """SELECT l.*, coalesce(c.featureYear, 1990) yr, c.genres,
 row_number() OVER (PARTITION BY userId ORDER BY timestamp, movieId) rn
FROM labelled l LEFT JOIN catalogue c USING (movieId)""",
    ),
    "history_slots": (
        ["numbered"],
        """SELECT userId, movieId,
 max(CASE WHEN k=1 THEN past END) userRatedMovie0, max(CASE WHEN k=2 THEN past END) userRatedMovie1,
 max(CASE WHEN k=3 THEN past END) userRatedMovie2, max(CASE WHEN k=4 THEN past END) userRatedMovie3,
 max(CASE WHEN k=5 THEN past END) userRatedMovie4
FROM (SELECT a.userId, a.movieId, b.movieId past,
  row_number() OVER (PARTITION BY a.userId, a.movieId ORDER BY b.rn DESC) k
 FROM numbered a LEFT JOIN numbered b
  ON a.userId=b.userId AND b.label=1 AND b.rn BETWEEN a.rn-100 AND a.rn-1) h
GROUP BY userId, movieId""",
    ),
    "window_stats": (
        ["numbered"],
        """SELECT userId, movieId, count(*) OVER w userRatingCount,
 CAST(floor(avg(yr) OVER w) AS INT) userRatedMovieAvgReleaseYear,
 stddev_samp(yr) OVER w userRatedMovieReleaseYearStddev,
 avg(rating) OVER w userAvgRating, stddev_samp(rating) OVER w userRatingStddev
FROM numbered WINDOW w AS (PARTITION BY userId ORDER BY timestamp, movieId
 ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)""",
    ),
    "genre_slots": (
        ["numbered"],
        """SELECT userId, movieId,
 max(CASE WHEN k=1 THEN genre END) userGenre0, max(CASE WHEN k=2 THEN genre END) userGenre1,
 max(CASE WHEN k=3 THEN genre END) userGenre2, max(CASE WHEN k=4 THEN genre END) userGenre3,
 max(CASE WHEN k=5 THEN genre END) userGenre4
FROM (SELECT userId, movieId, genre,
  row_number() OVER (PARTITION BY userId, movieId ORDER BY c DESC, f) k
 FROM (SELECT a.userId, a.movieId, b.genre, count(b.genre) c, min(b.rn*10+b.at) f
  FROM numbered a LEFT JOIN (SELECT userId, rn, unnest(genres) genre,
    generate_subscripts(genres,1) AS at FROM numbered WHERE label=1) b
   ON a.userId=b.userId AND b.rn BETWEEN a.rn-100 AND a.rn-1
  GROUP BY a.userId, a.movieId, b.genre) g) r
GROUP BY userId, movieId""",
    ),
    "mixed": (
        ["numbered", "history_slots", "window_stats", "genre_slots", "movie_stats"],
        """SELECT n.userId, n.movieId, n.rating, n.timestamp, n.label, n.yr releaseYear,
 n.genres[1] genre0, n.genres[2] genre1, n.genres[3] genre2,
 s.cnt movieRatingCount, s.av movieAvgRating, s.sd movieRatingStddev,
 h.* EXCLUDE (userId, movieId), w.* EXCLUDE (userId, movieId), g.* EXCLUDE (userId, movieId)
FROM numbered n JOIN movie_stats s USING (movieId) JOIN history_slots h USING (userId, movieId)
JOIN window_stats w USING (userId, movieId) JOIN genre_slots g USING (userId, movieId)
WHERE w.userRatingCount > 1""",
    ),
}


def sql(body: str, *names: str) -> str:
    """`body` after the definitions of `names` and of all they build on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in order:
            return
        for needed in TABLES[name][0]:
            add(needed)
        order.append(name)

    for name in names:
        add(name)
    if not order:
        return body
    defined = ",\n".join(f"{n} AS (\n{TABLES[n][1]}\n)" for n in order)
    return f"WITH {defined}\n{body}"
