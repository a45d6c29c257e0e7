"""Web archives of pages: writing, reading back, and an index by external merge.

A page is one record; of equal payloads of some length the one with the largest id is a response
and the others revisit it. Records are written by Spark's text writer: a record's end is the line
separator, so any file system that Spark writes to will do. Reading takes each file apart by the
lengths in its headers, so payloads may hold anything. A file holds 64 MB of records, or a single longer
one, however long or short pages are.

The index is built from sorted runs, one per reading task. Runs are dealt out by ranges of (URL key,
time, record) and each range merges its k runs by a tree of losers, so that ranges in order hold the
capture histories in order. A URL with very many captures spans several ranges.

A null page is an empty payload, a null URL is urn:unknown; blanks and control characters in URLs are
percent-encoded. Rows with equal ids are pages of their own, null ids come first. An empty table
gives an archive without records.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.ids import ROW, name_rows, with_rows
from marquee.plans.lineage import fresh_path, materialize

# Payloads shorter than this are never revisits.
REVISIT_BYTES = 1_000
# Bytes of records in one archive file before compression, which a reading task holds at a time; a
# longer record is a file of its own.
FILE_BYTES = 64 << 20
# Records are written by classes of length, each bound this many times the one before.
SHORT, STEP, CLASSES = 1 << 16, 16, 5
# Headers of a record without its address, at most.
HEADERS = 1_024
# Captures of the index that a range holds, about.
RANGE_ROWS = 100_000
# Time of the record numbered 0 for pages that come without times; one second per number.
FIRST_CAPTURE = 1_704_067_200

# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LINE = "\r\n"
END = LINE * 2


def describe(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(_row, url, payload, size, digest, original): original is the record that holds the
    payload, null if that is the page itself. `pages` has _row, url and html."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    known = pages.select(
        ROW,
        "url",
        payload.alias("payload"),
        F.octet_length(payload).cast("bigint").alias("size"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"),
        F.sha2(payload, 256).alias("_same"),
    )
    # payloads that occur once, or are short, need no lookup; the rest is one narrow row each
    firsts = (
        known.where(F.col("size") >= revisit_bytes)
        .groupBy("_same")
        .agg(F.max(ROW).alias("_original"), F.count(F.lit(1)).alias("_n"))
        .where("_n > 1")
        .drop("_n")
    )
    copies = known.where(F.col("size") >= revisit_bytes).select(ROW, "_same")
    revisits = (
        copies.join(materialize(firsts, "payloads"), "_same")
        .where(F.col(ROW) != F.col("_original"))
        .select(F.col(ROW).alias("_copy"), F.col("_original").alias("original"))
    )
    lookup = materialize(revisits, "revisits")
    return known.join(lookup, known[ROW] == lookup["_copy"], "left").drop("_copy", "_same")


def records(described: DataFrame) -> DataFrame:
    """The text of each record up to its end mark."""
    revisit = F.col("original").isNotNull()
    number = F.col(ROW).cast("string")
    address = F.regexp_replace(
        F.coalesce("url", F.lit("urn:unknown")), r"[\x00-\x20\x7f]", "%20"
    )
    instant = F.timestamp_seconds(F.lit(FIRST_CAPTURE) + F.col(ROW))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=utf-8{LINE}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(END),
    )
    block = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("size"))
    profile = F.concat(
        F.lit(f"WARC-Profile: {PROFILE}{LINE}WARC-Refers-To: <urn:page:"),
        F.col("original").cast("string"),
        F.lit(f">{LINE}"),
    )
    header = F.concat(
        F.lit(f"{VERSION}{LINE}WARC-Type: "),
        F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{LINE}WARC-Record-ID: <urn:page:"),
        number,
        F.lit(f">{LINE}WARC-Date: "),
        F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        F.lit(f"{LINE}WARC-Target-URI: "),
        address,
        F.lit(f"{LINE}WARC-Payload-Digest: sha1:"),
        F.col("digest"),
        F.lit(LINE),
        F.when(revisit, profile).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http; msgtype=response{LINE}Content-Length: "),
        block.cast("string"),
        F.lit(END),
    )
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return described.select(F.concat(header, http, body).alias("value"))


def write_archive(described: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> None:
    """Compressed archive files below `folder` of at most `file_bytes` before compression.

    Spark rolls files by their number of records. Records of a class are no longer than its bound,
    so each class, most tables have one or two, is written with as many records a file as fit.
    """
    body = F.when(F.col("original").isNull(), F.col("size")).otherwise(0)
    # a blank or control character of an address becomes three characters
    length = HEADERS + 3 * F.coalesce(F.octet_length("url"), F.lit(0)) + body
    bounds = [SHORT * STEP**k for k in range(CLASSES)]
    number = F.lit(CLASSES)
    for k in reversed(range(CLASSES)):
        number = F.when(length <= bounds[k], k).otherwise(number)
    classed = described.withColumn("_class", number)
    present = sorted(r["_class"] for r in classed.groupBy("_class").count().collect())
    for k in present or [0]:
        fit = max(1, file_bytes // bounds[k]) if k < CLASSES else 1
        (
            records(classed.where(F.col("_class") == k))
            .write.mode("errorifexists" if k == (present or [0])[0] else "append")
            .option("lineSep", END)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", fit)
            .text(folder)
        )


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8").split(LINE)[1:]:
        name, _, value = line.partition(": ")
        out[name.lower()] = value
    return out


def parse_archive(data: bytes) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """(offset, record fields, HTTP fields, payload) of every record of a file."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    end, at = END.encode(), 0
    while at < len(data):
        stop = data.index(end, at)
        fields = _fields(data[at:stop])
        begin = stop + len(end)
        close = begin + int(fields["content-length"])
        split = data.index(end, begin, close)
        if data[close : close + len(end)] != end:
            raise ValueError(f"record at {at} does not end where its length says")
        yield at, fields, _fields(data[begin:split]), data[split + len(end) : close]
        at = close + len(end)


def url_key(url: str) -> str:
    """Host turned round, then the rest, so that pages of a domain sort together."""
    try:
        parts = urlsplit(url)
        host = parts.hostname
    except ValueError:
        return url
    if not host:
        return url
    turned = ",".join(reversed(host.split(".")))
    query = f"?{parts.query}" if parts.query else ""
    return f"{turned}){parts.path or '/'}{query}"


CAPTURE = (
    "url_key string, captured string, record bigint, run bigint, file string, at bigint, "
    "record_type string, payload_bytes bigint, payload_digest string, refers_to bigint"
)
_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]
_ORDER = ("url_key", "captured", "record")


def _number(urn: str) -> int:
    return int(urn.strip("<>").rpartition(":")[2])


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of an archive, each reading task's in order: a sorted run."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        run = task.partitionId() if task else 0
        found = []
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                file = path.as_py().rpartition("/")[2]
                for at, fields, http, payload in parse_archive(content.as_py()):
                    revisit = fields["warc-type"] == "revisit"
                    stated = fields["warc-payload-digest"].partition(":")[2]
                    digest = stated if revisit else hashlib.sha1(payload).hexdigest()
                    size = int(http["content-length"]) if revisit else len(payload)
                    if digest != stated:
                        raise ValueError(f"{file}: payload at {at} differs from its digest")
                    found.append(
                        (
                            url_key(fields["warc-target-uri"]),
                            fields["warc-date"],
                            _number(fields["warc-record-id"]),
                            run,
                            file,
                            at,
                            fields["warc-type"],
                            size,
                            digest,
                            _number(fields["warc-refers-to"]) if revisit else None,
                        )
                    )
        found.sort()
        yield _batch(found)

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(read, CAPTURE)


_TYPES = [
    pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(),
    pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES
    )


def merge_runs(runs: list[list]) -> Iterator:
    """Rows of sorted runs in order, by a tree of losers.

    A leaf is a run, an inner node keeps the run that lost there, and the winner is on top. After a
    row leaves, only its run's path to the top is played again.
    """
    k = len(runs)
    if not k:
        return
    at = [0] * k
    heads = [run[0] if run else None for run in runs]

    def beats(a: int, b: int) -> bool:
        """Does run a come before run b? An ended run comes last, equal rows by run."""
        if heads[a] is None or heads[b] is None:
            return heads[a] is not None
        return (heads[a], a) < (heads[b], b)

    # winners of the first round from the leaves k .. 2k - 1 up; losers stay
    winner = [0] * k + list(range(k))
    loser = [0] * k
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    top = winner[1] if k > 1 else 0
    while heads[top] is not None:
        yield heads[top]
        at[top] += 1
        heads[top] = runs[top][at[top]] if at[top] < len(runs[top]) else None
        node = (top + k) // 2
        while node:
            if beats(loser[node], top):
                loser[node], top = top, loser[node]
            node //= 2


def build_index(runs: DataFrame) -> DataFrame:
    """Captures in order of (url_key, captured, record) over all partitions in turn.

    `runs` is written first, as range bounds are drawn from it. There are as many ranges as its
    rows ask for, so that what a merging task holds does not grow with the archive.
    """
    stored = materialize(runs, "runs")
    ranges = max(1, -(-stored.count() // RANGE_ROWS))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _NAMES)):
                parts.setdefault(row[3], []).append(row)
        for run in parts.values():
            # blocks of one run may arrive in any order
            if any(a[:3] > b[:3] for a, b in zip(run, run[1:])):
                run.sort()
        out: list[tuple] = []
        for row in merge_runs([parts[k] for k in sorted(parts)]):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return stored.repartitionByRange(ranges, *_ORDER).mapInArrow(merge, CAPTURE)


def archive_pages(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html) as an archive, read it back and index it.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url_key, captured, file, at)
    per page, in index order.
    """
    spark = pages.sparkSession
    numbered, sound = with_rows(pages.select("page_id", "url", "html"), "page_id", "html")
    folder = folder or fresh_path(spark, "archive")
    write_archive(describe(numbered), folder)
    index = build_index(read_runs(spark, folder)).drop("run")
    named = name_rows(index, numbered, sound, "record", "page_id", "page_id")
    named = name_rows(
        named.withColumnRenamed("refers_to", "_original"),
        numbered,
        sound,
        "_original",
        "page_id",
        "refers_to",
    )
    return named.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
        "url_key",
        "captured",
        "file",
        "at",
    )
