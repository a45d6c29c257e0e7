"""Rating streams: hourly latest rating, feature upserts, rating upserts, late rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marquee.operators.samples import add_label
from marquee.plans.lineage import fresh_path
from marquee.streaming.tables import AppendLog, Ledger, UpsertTable

# Fixed value: length of the tumbling window. The delay for late rows is our choice.
WINDOW = "1 hour"
DELAY = "10 minutes"
HOUR_MICROS = 3_600_000_000
DELAY_MICROS = 600_000_000


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    pattern: str = "*.parquet",
    files_per_batch: int | None = None,
) -> DataFrame:
    """Files of a folder as they appear."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def read_csv_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("header", True).csv(folder)


def to_samples(ratings: DataFrame) -> DataFrame:
    """Rating rows, with time in microseconds, as stream samples."""
    return ratings.select(
        "event_id",
        "userId",
        "movieId",
        "rating",
        F.timestamp_micros("timestamp").alias("ts"),
        F.col("movieId").alias("latestMovieId"),
    )


def latest_per_window(samples: DataFrame) -> DataFrame:
    """Each user's last sample of each hour of event time; later arrival wins a tie.

    The state is one row per user and open hour. Rows older than the watermark are dropped.
    """
    return _latest(samples.withWatermark("ts", DELAY), F.window("ts", WINDOW))


def hourly_latest(samples: DataFrame) -> DataFrame:
    """The same of the samples at hand, without state."""
    return _latest(samples, F.struct(F.date_trunc("hour", "ts").alias("start")))


def _latest(samples: DataFrame, hour: Column) -> DataFrame:
    newest = F.max(F.struct("ts", "event_id", "latestMovieId", "rating")).alias("_last")
    return (
        samples.groupBy(hour.alias("_hour"), "userId")
        .agg(newest)
        .select(
            F.col("_hour.start").alias("windowStart"),
            "userId",
            F.col("_last.event_id").alias("eventId"),
            F.col("_last.latestMovieId").alias("latestMovieId"),
            F.col("_last.rating").alias("rating"),
            F.col("_last.ts").alias("ts"),
        )
    )


def run_available(
    stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str, offsets: str
) -> StreamingQuery:
    """Process the data that is there and stop; the next run goes on after `offsets`."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", offsets)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def run_into_table(
    stream: DataFrame,
    mode: str,
    keys: list[str],
    order: list[str],
    folder: str | None = None,
    base: DataFrame | None = None,
) -> UpsertTable:
    """A table with the newest row of each key after all available data, on top of `base`.

    `folder` keeps the table and the offsets between runs: an hourly job that names the same
    folder reads only what has arrived since, whatever the clock says, and what it rereads of
    the table is the last compaction and the few deltas after it.
    """
    spark = stream.sparkSession
    folder = folder or fresh_path(spark, "stream")
    table = UpsertTable(spark, f"{folder}/table", stream.schema, keys, order)
    if base is not None:
        table.start(base)
    run_available(stream, table.append, mode, f"{folder}/offsets")
    return table


def run_latest(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Latest sample per user and hour after all available data."""
    latest = latest_per_window(to_samples(stream))
    # an hour's row only ever grows, so the larger one is the newer one
    return run_into_table(
        latest, "update", ["windowStart", "userId"], ["ts", "eventId"], folder
    ).read()


def run_feature_upserts(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Feature table with each user's newest movie, kept current batch by batch."""
    table = run_into_table(to_samples(stream), "append", ["userId"], ["ts", "event_id"], folder)
    return table.read().select(
        F.concat(F.lit("uf:"), F.col("userId").cast("string")).alias("key"),
        "userId",
        "latestMovieId",
        "rating",
        F.unix_micros("ts").alias("updatedAt"),
    )


def run_rating_upserts(
    stream: DataFrame, base: DataFrame, folder: str | None = None
) -> DataFrame:
    """Ratings after all available changes: insert new pairs, overwrite known ones."""
    keys, order = ["userId", "movieId"], ["timestamp", "event_id"]
    return run_into_table(stream, "append", keys, order, folder, base).read()


def training_rows(ratings: DataFrame) -> DataFrame:
    """What the sink appends per rating event: the sample and its label."""
    return add_label(to_samples(ratings)).select(
        "event_id", "userId", "movieId", "rating", "label", "ts"
    )


def run_sink(stream: DataFrame, folder: str, run: str = "ratings") -> tuple[UpsertTable, AppendLog]:
    """Both results of every batch: users' newest features upserted, training samples appended."""
    spark, samples = stream.sparkSession, to_samples(stream)
    table = UpsertTable(
        spark, f"{folder}/features", samples.schema, ["userId"], ["ts", "event_id"]
    )
    log = AppendLog(spark, f"{folder}/samples", training_rows(stream).schema)

    def write(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            table.append(to_samples(held), number)
            log.append(training_rows(held), run, number)
        finally:
            held.unpersist()

    run_available(stream, write, "append", f"{folder}/offsets")
    return table, log


class HourLedger:
    """Hourly latest ratings that lose no event: what comes after its hour closed is set apart.

    An hour is closed for a batch when the latest event before that batch is DELAY or more past
    the hour's end; the rule of a watermark, kept in a ledger, so that it can be replayed. Events in
    time go to the table of hours, late ones to a log of their own.
    """

    def __init__(self, stream: DataFrame, folder: str) -> None:
        spark, self.folder = stream.sparkSession, folder
        self.samples = to_samples(stream)
        hours = hourly_latest(self.samples)
        self.hours = UpsertTable(
            spark, f"{folder}/hours", hours.schema, ["windowStart", "userId"], ["ts", "eventId"]
        )
        self.late = AppendLog(spark, f"{folder}/late", self._with_batch(self.samples, 0).schema)
        self.ledger = Ledger(spark, f"{folder}/ledger")

    @staticmethod
    def _with_batch(samples: DataFrame, batch: int) -> DataFrame:
        return samples.withColumn("batch", F.lit(batch).cast("bigint"))

    def write(self, batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            latest = self.ledger.before(number)
            end = F.unix_micros(F.date_trunc("hour", "ts")) + HOUR_MICROS
            late = F.lit(False) if latest is None else end <= F.lit(latest - DELAY_MICROS)
            self.late.append(self._with_batch(held.where(late), number), "late", number)
            self.hours.append(hourly_latest(held.where(~late)), number)
            self.ledger.note(number, held.agg(F.max(F.unix_micros("ts"))).first()[0])
        finally:
            held.unpersist()

    def run(self) -> None:
        """Process what is there; the next run goes on after it."""
        run_available(self.samples, self.write, "append", f"{self.folder}/offsets")
