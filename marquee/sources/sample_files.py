"""Training samples as header CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.samples import (
    MOVIE_GENRES,
    RATED_MOVIES,
    USER_GENRES,
    rounded,
)

TRAINING = "trainingSamples.csv"
TEST = "testSamples.csv"

SAMPLE_SCHEMA = (
    "movieId INT, userId INT, rating DOUBLE, timestamp BIGINT, label INT, releaseYear INT, "
    + ", ".join(f"{c} STRING" for c in MOVIE_GENRES)
    + ", movieRatingCount BIGINT, movieAvgRating DOUBLE, movieRatingStddev DOUBLE, "
    + ", ".join(f"{c} INT" for c in RATED_MOVIES)
    + ", userRatingCount BIGINT, userRatedMovieAvgReleaseYear INT"
    + ", userRatedMovieReleaseYearStddev DOUBLE, userAvgRating DOUBLE, userRatingStddev DOUBLE, "
    + ", ".join(f"{c} STRING" for c in USER_GENRES)
)
SAMPLE_COLUMNS = [part.split()[0] for part in SAMPLE_SCHEMA.split(", ")]


def write_samples(train: DataFrame, test: DataFrame, folder: str) -> None:
    """Both splits with two-decimal statistics; as many files as there are partitions."""
    for df, name in ((train, TRAINING), (test, TEST)):
        out = rounded(df).select(*SAMPLE_COLUMNS)
        out.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")


def read_training_samples(spark: SparkSession, path: str) -> DataFrame:
    """Missing numbers read as 0, missing text as ''; lines that do not fit are skipped."""
    rows = (
        spark.read.schema(SAMPLE_SCHEMA)
        .option("header", True)
        .option("mode", "DROPMALFORMED")
        .csv(path)
    )
    return rows.fillna(0).fillna("")


def read_split(spark: SparkSession, folder: str) -> DataFrame:
    """Both splits with a `split` column."""
    parts = [
        read_training_samples(spark, f"{folder}/{name}").withColumn("split", F.lit(label))
        for name, label in ((TRAINING, "train"), (TEST, "test"))
    ]
    return parts[0].unionByName(parts[1])
