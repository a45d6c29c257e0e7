import datetime as dt

from pyspark.sql import functions as F

from marquee.streaming import ratings as rating_stream
from marquee.streaming.tables import AppendLog, UpsertTable

SCHEMA = "event_id bigint, userId int, movieId int, rating double, timestamp bigint"


def at(hour, minute, day=1):
    moment = dt.datetime(2024, 1, day, hour, minute, tzinfo=dt.timezone.utc)
    return int(moment.timestamp() * 1_000_000)


def deliver(spark, tmp_path, deliveries):
    """A stream that gets one file per batch."""
    for i, rows in enumerate(deliveries):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.parquet(str(tmp_path / f"delivery={i}"))
    schema = spark.createDataFrame([], SCHEMA).schema
    return rating_stream.read_stream(spark, str(tmp_path / "*"), schema, files_per_batch=1)


def latest(df):
    return {
        (r.windowStart.strftime("%H"), r.userId): r.latestMovieId for r in df.collect()
    }


def test_latest_of_each_hour(spark, tmp_path):
    stream = deliver(
        spark,
        tmp_path,
        [
            [(1, 1, 10, 3.0, at(1, 5)), (2, 1, 11, 3.0, at(1, 50)), (3, 2, 12, 3.0, at(1, 1))],
            # an update of an open hour, a tie won by the later event, and a new hour
            [(4, 1, 13, 3.0, at(1, 55)), (5, 2, 14, 3.0, at(1, 1)), (6, 1, 15, 3.0, at(2, 0))],
        ],
    )
    out = rating_stream.run_latest(stream)
    assert latest(out) == {("01", 1): 13, ("01", 2): 14, ("02", 1): 15}


def test_rows_behind_the_watermark_are_dropped(spark, tmp_path):
    stream = deliver(
        spark,
        tmp_path,
        [
            [(1, 1, 10, 3.0, at(1, 5))],
            [(2, 1, 11, 3.0, at(9, 0))],
            # rows are judged by the watermark the batch before them ran with
            [(3, 1, 12, 3.0, at(9, 1))],
            [(4, 1, 13, 3.0, at(1, 59)), (5, 2, 14, 3.0, at(8, 55))],
        ],
    )
    out = latest(rating_stream.run_latest(stream))
    # hour 1 had closed; 08:55 is within the ten minutes
    assert out == {("01", 1): 10, ("09", 1): 12, ("08", 2): 14}


def test_feature_table_keeps_the_newest(spark, tmp_path):
    stream = deliver(
        spark,
        tmp_path,
        [
            [(1, 1, 10, 3.0, at(5, 0)), (2, 2, 20, 3.0, at(1, 0))],
            [(3, 1, 11, 3.0, at(4, 0)), (4, 2, 21, 3.0, at(2, 0))],
        ],
    )
    out = rating_stream.run_feature_upserts(stream).collect()
    assert {(r.key, r.latestMovieId) for r in out} == {("uf:1", 10), ("uf:2", 21)}


def test_rating_upserts(spark, tmp_path):
    base = spark.createDataFrame([(0, 1, 10, 1.0, at(0, 0)), (0, 9, 9, 5.0, at(0, 0))], SCHEMA)
    stream = deliver(
        spark,
        tmp_path,
        [[(1, 1, 10, 2.0, at(1, 0))], [(2, 1, 10, 3.0, at(2, 0)), (3, 1, 11, 4.0, at(1, 0))]],
    )
    out = rating_stream.run_rating_upserts(stream, base).collect()
    assert {(r.userId, r.movieId, r.rating) for r in out} == {
        (1, 10, 3.0),
        (1, 11, 4.0),
        (9, 9, 5.0),
    }


def test_next_run_goes_on_where_the_last_one_stopped(spark, tmp_path):
    first = [[(1, 1, 10, 3.0, at(1, 5)), (2, 1, 11, 3.0, at(2, 5))]]
    folder = str(tmp_path / "state")
    arrivals = tmp_path / "in"
    out = rating_stream.run_latest(deliver(spark, arrivals, first), folder)
    assert latest(out) == {("01", 1): 10, ("02", 1): 11}
    late = spark.createDataFrame([(3, 1, 12, 3.0, at(2, 50))], SCHEMA).coalesce(1)
    late.write.parquet(str(arrivals / "delivery=9"))
    schema = spark.createDataFrame([], SCHEMA).schema
    again = rating_stream.read_stream(spark, str(arrivals / "*"), schema, files_per_batch=1)
    out = rating_stream.run_latest(again, folder)
    assert latest(out) == {("01", 1): 10, ("02", 1): 12}
    # the second run wrote only the hour it changed
    table = rating_stream.UpsertTable(
        spark, f"{folder}/table", out.schema, ["windowStart", "userId"], ["ts", "eventId"]
    )
    written = [spark.read.parquet(folder).count() for folder in table.folders()]
    assert [n for n in written if n] == [2, 1]  # batches that only close hours write no rows


def test_empty_stream(spark, tmp_path):
    (tmp_path / "none").mkdir()
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = rating_stream.read_stream(spark, str(tmp_path / "none"), schema)
    assert rating_stream.run_latest(stream).count() == 0


def test_csv_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text(
        f"event_id,userId,movieId,rating,timestamp\n1,1,10,3.5,{at(1, 0)}\n"
    )
    stream = rating_stream.read_csv_stream(spark, str(tmp_path / "in"), SCHEMA)
    assert latest(rating_stream.run_latest(stream)) == {("01", 1): 10}


def test_stream_equals_batch(spark, inputs, tmp_path):
    samples = rating_stream.to_samples(inputs.events)
    hour = F.date_trunc("hour", "ts").alias("windowStart")
    batch = samples.groupBy(hour, "userId").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    streamed = rating_stream.run_latest(inputs.event_stream())
    joined = batch.select("windowStart", "userId", "m.event_id").exceptAll(
        streamed.select("windowStart", "userId", "eventId")
    )
    assert joined.count() == 0
    assert streamed.count() == batch.count()


def table_of(spark, tmp_path, **more):
    schema = spark.createDataFrame([], SCHEMA).schema
    return UpsertTable(
        spark, str(tmp_path / "t"), schema, ["userId", "movieId"], ["timestamp", "event_id"], **more
    )


def change(spark, event, user, movie, rating):
    return spark.createDataFrame([(event, user, movie, rating, event)], SCHEMA)


def test_a_later_run_reads_no_file_older_than_the_compaction(spark, tmp_path):
    table = table_of(spark, tmp_path, compact_after=3)
    table.start(change(spark, 0, 1, 1, 0.5))
    seen = set(table.read().inputFiles())
    for batch in range(3):
        table.append(change(spark, batch + 1, 1, batch, 1.0 + batch), batch)
        seen |= set(table.read().inputFiles()) if batch < 2 else set()
    assert len(table.folders()) == 1 and table.state()["batch"] == 2
    before = table.read()
    assert not seen & set(before.inputFiles())
    assert {(r.movieId, r.rating) for r in before.collect()} == {(0, 1.0), (1, 2.0), (2, 3.0)}
    table.append(change(spark, 9, 1, 1, 5.0), 3)
    assert not seen & set(table.read().inputFiles())
    assert {(r.movieId, r.rating) for r in table.read().collect()} == {(0, 1.0), (1, 5.0), (2, 3.0)}
    table.vacuum()
    assert before.count() == 3  # the current base is still there
    assert table.read().count() == 3
    left = {p.name for p in (tmp_path / "t" / "data").iterdir()}
    assert left == {f.rsplit("/", 1)[1] for f in table.folders()}


def test_replayed_and_half_written_batches_change_nothing(spark, tmp_path):
    table = table_of(spark, tmp_path)
    table.append(change(spark, 5, 1, 1, 2.0), 0)
    table.append(change(spark, 6, 1, 1, 4.0), 0)  # a replay of a batch that is in
    assert [r.rating for r in table.read().collect()] == [2.0]
    # a crash before publishing leaves a folder that nobody names
    table._write(change(spark, 7, 1, 1, 5.0), "delta-1")
    assert [r.rating for r in table.read().collect()] == [2.0]
    table.append(change(spark, 7, 1, 1, 5.0), 1)
    assert [r.rating for r in table.read().collect()] == [5.0]
    table.start(change(spark, 99, 2, 2, 1.0))  # the table has begun
    assert table.read().count() == 1


def test_append_log_takes_a_batch_once(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    log = AppendLog(spark, str(tmp_path / "log"), schema)
    assert log.read().count() == 0
    log.append(change(spark, 1, 1, 1, 1.0), "a", 0)
    # a crash between rows and marker: not visible, and replayed from scratch
    change(spark, 2, 1, 1, 1.0).union(change(spark, 3, 1, 1, 1.0)).write.parquet(log._folder("a-1"))
    assert [r.event_id for r in log.read().collect()] == [1]
    log.append(change(spark, 2, 1, 1, 1.0), "a", 1)
    log.append(change(spark, 2, 1, 1, 1.0), "a", 1)
    log.append(change(spark, 4, 1, 1, 1.0), "b", 1)  # another job's batch of that number
    assert sorted(r.event_id for r in log.read().collect()) == [1, 2, 4]


def test_sink_replayed_after_a_crash(spark, tmp_path, monkeypatch):
    first = [[(1, 1, 10, 3.0, at(1, 0)), (2, 1, 11, 4.0, at(2, 0))], [(3, 2, 12, 5.0, at(3, 0))]]
    stream = deliver(spark, tmp_path / "in", first)
    folder, real = str(tmp_path / "out"), AppendLog.append
    calls = []

    def failing(self, rows, run, batch):
        calls.append(batch)
        if calls == [0, 1]:
            raise RuntimeError("lost")  # features of this batch are in, its samples aren't
        real(self, rows, run, batch)

    monkeypatch.setattr(AppendLog, "append", failing)
    try:
        rating_stream.run_sink(stream, folder)
    except Exception as lost:
        assert "lost" in str(lost)
    table, log = rating_stream.run_sink(stream, folder)
    assert calls == [0, 1, 1]
    assert sorted((r.event_id, r.label) for r in log.read().collect()) == [(1, 0), (2, 1), (3, 1)]
    assert {(r.userId, r.latestMovieId) for r in table.read().collect()} == {(1, 11), (2, 12)}


def test_ledger_loses_no_event(spark, tmp_path):
    deliveries = [
        [(1, 1, 10, 3.0, at(1, 5)), (2, 2, 11, 3.0, at(2, 9))],
        # the hour to two closed at 02:10, which only the second delivery reaches
        [(3, 1, 12, 3.0, at(1, 59)), (4, 1, 13, 3.0, at(2, 10))],
        [(5, 1, 14, 3.0, at(1, 58)), (6, 1, 15, 3.0, at(2, 0))],
        [],
        [(7, 1, 16, 3.0, at(0, 1))],
    ]
    stream = deliver(spark, tmp_path / "in", deliveries)
    job = rating_stream.HourLedger(stream, str(tmp_path / "out"))
    job.run()
    late = {r.event_id for r in job.late.read().collect()}
    assert late == {5, 7}
    assert latest(job.hours.read()) == {("01", 1): 12, ("02", 1): 13, ("02", 2): 11}
    # a replayed batch is judged as it was the first time
    job.write(job.late.spark.createDataFrame([(5, 1, 14, 3.0, at(1, 58), 14)],
              "event_id bigint, userId int, movieId int, rating double, timestamp bigint, latestMovieId int")
              .withColumn("ts", F.timestamp_micros("timestamp")).drop("timestamp"), 2)
    assert {r.event_id for r in job.late.read().collect()} == late
