"""JSON documents: rating lists, scoring requests, score responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.samples import MOVIE_FEATURES, USER_FEATURES, USER_ORDER
from marquee.plans.skew import LONG_SEQUENCE, number_sequences

# Ratings per JSON document; a longer list continues in the next document.
RATINGS_PER_DOCUMENT = 1000
ID_FIELDS = ["userId", "movieId"]
# The aggregate release-year statistics are stored but never sent to a scorer.
UNSENT = {"userRatedMovieAvgReleaseYear", "userRatedMovieReleaseYearStddev"}
FEATURE_FIELDS = [*ID_FIELDS, *[f for f in USER_FEATURES if f not in UNSENT], *MOVIE_FEATURES]


def ratings_as_json(ratings: DataFrame, long_sequence: int = LONG_SEQUENCE) -> DataFrame:
    """Each user's ratings in time order as arrays of {"rating": {...}} objects.

    A document holds at most RATINGS_PER_DOCUMENT ratings, so no row grows with a user's
    activity; `document` numbers the parts.
    """
    placed = number_sequences(ratings, "userId", USER_ORDER, "_pos", long_sequence)
    rating = F.struct("userId", "movieId", F.col("rating").alias("score"), "timestamp")
    item = F.struct("_pos", F.struct(rating.alias("rating")).alias("wrapped"))
    document = F.floor(F.col("_pos") / RATINGS_PER_DOCUMENT).cast("int")
    grouped = (
        placed.select("userId", document.alias("document"), item.alias("_item"))
        .groupBy("userId", "document")
        .agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    )
    ordered = F.transform("_items", lambda x: x["wrapped"])
    return grouped.select(
        "userId",
        "document",
        F.size("_items").alias("ratings"),
        F.to_json(ordered).alias("json"),
    )


def scoring_requests(pairs: DataFrame, fields: Sequence[str] = tuple(ID_FIELDS)) -> DataFrame:
    """Per user {"instances": [...]} over its candidates in `position` order.

    Candidate lists are cut to a fixed size before this point, so a request is bounded.
    """
    instance = F.struct("position", F.struct(*fields).alias("fields"))
    grouped = pairs.groupBy("userId").agg(F.sort_array(F.collect_list(instance)).alias("_all"))
    instances = F.transform("_all", lambda x: x["fields"])
    return grouped.select(
        "userId",
        F.size("_all").alias("instances"),
        F.to_json(F.struct(instances.alias("instances"))).alias("request"),
    )


def parse_predictions(responses: DataFrame, candidates: DataFrame) -> DataFrame:
    """Scores of {"predictions": [[p], ...]} joined to the candidates by position.

    `responses` has userId and response, `candidates` userId, position (from 0) and movieId.
    """
    parsed = F.from_json("response", "predictions ARRAY<ARRAY<DOUBLE>>")["predictions"]
    scores = responses.select("userId", F.posexplode(parsed).alias("position", "_score"))
    return scores.join(candidates, ["userId", "position"]).select(
        "userId", "movieId", "position", F.get("_score", F.lit(0)).alias("score")
    )
