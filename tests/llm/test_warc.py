"""Archives written, read back and indexed."""

import gzip
import hashlib
import random

from marquee.llm import warc

PAGES = "page_id bigint, url string, html string, record_type int"


def pages():
    rnd = random.Random(2)
    big = "<p>" + "é" * 600 + "</p>"
    rows = [(i, f"http://h{i % 3}.example/p{i % 5}?q={i}", f"<b>{rnd.random()}</b>" * 90, 0) for i in range(40)]
    rows += [(50 + i, "https://h1.example/", big, 0) for i in range(7)]
    rows += [
        (70, "http://h0.example/\r\nX: y z", "short", 0), (71, None, "short", 0), (72, "nonsense", None, 0),
        (73, "http://[bad", "", 0), (74, "http://h2.example", "WARC/1.1\r\n\r\n" * 200 + "\x00", 0),
        (75, "http://h2.example", "WARC/1.1\r\n\r\n" * 200 + "\x00", 0),
    ]
    return rows


def test_archive(spark):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES).repartition(4)
    found = warc.archive_pages(df).collect()
    got = {r["page_id"]: r for r in found}
    assert len(found) == len(rows)
    last = {}
    for i, _, html, _ in rows:
        data = (html or "").encode()
        if len(data) >= 1_000:
            last[data] = max(last.get(data, i), i)
    for i, _, html, _ in rows:
        data = (html or "").encode()
        r, top = got[i], last.get(data, i)
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert r["record_type"] == ("response" if top == i else "revisit")
        assert r["refers_to"] == (None if top == i else top)
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in found]
    assert keys == sorted(keys)


def test_payloads_round_trip(spark, tmp_path):
    df = spark.createDataFrame(pages(), PAGES)
    described = warc.describe(df.withColumn("_row", df["page_id"]))
    folder = str(tmp_path / "archive")
    warc.write_archive(described, folder)
    read = {}
    for path in (tmp_path / "archive").glob("*.gz"):
        for _, fields, _, payload in warc.parse_archive(path.read_bytes()):
            if fields["warc-type"] == "response":
                read[warc._number(fields["warc-record-id"])] = payload
    wanted = {i: (html or "").encode() for i, _, html, _ in pages()}
    assert all(wanted[i] == p for i, p in read.items())
    assert set(wanted) - set(read) == {*range(50, 56), 74}


def test_files_are_bounded_by_bytes(spark, tmp_path):
    """Long pages are rolled by their length, a page beyond the bound is a file of its own."""
    rnd = random.Random(5)
    sizes = [100] * 30 + [60_000] * 9 + [500_000] * 7 + [3_000_000] * 3
    rows = [(i, f"http://h/{i}", chr(97 + rnd.randrange(26)) * n + str(i), 0) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, PAGES).coalesce(1)
    described = warc.describe(df.withColumn("_row", df["page_id"]))
    limit, folder = 2 << 20, tmp_path / "archive"
    warc.write_archive(described, str(folder), limit)
    seen = []
    for path in folder.glob("*.gz"):
        data = gzip.decompress(path.read_bytes())
        held = [warc._number(f["warc-record-id"]) for _, f, _, _ in warc.parse_archive(data)]
        assert len(data) <= limit or len(held) == 1
        seen += held
    assert sorted(seen) == list(range(len(rows)))
    found = warc.read_runs(spark, str(folder)).collect()
    assert {r["record"]: r["payload_bytes"] for r in found} == {i: len(h) for i, _, h, _ in rows}


def test_index_in_many_ranges(spark, monkeypatch):
    """The ranges in turn hold the captures in order, however few rows a range has."""
    df = spark.createDataFrame(pages(), PAGES).repartition(5)
    wanted = warc.archive_pages(df).drop("file", "at").collect()
    monkeypatch.setattr(warc, "RANGE_ROWS", 7)
    index = warc.archive_pages(df)
    assert index.rdd.getNumPartitions() >= 7
    assert index.drop("file", "at").collect() == wanted


def test_repeated_ids_and_no_pages(spark):
    same = "<i>" + "x" * 1_200
    rows = [(1, "http://a.b/", same, 0), (1, "http://a.b/", same, 0), (None, "http://a.b/", same, 0)]
    df = spark.createDataFrame(rows, PAGES)
    found = warc.archive_pages(df).collect()
    assert sorted(r["record_type"] for r in found) == ["response", "revisit", "revisit"]
    assert {r["refers_to"] for r in found if r["record_type"] == "revisit"} == {1}
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_loser_tree():
    rnd = random.Random(1)
    for k in range(0, 12):
        runs = [sorted(rnd.randint(0, 30) for _ in range(rnd.randint(0, 9))) for _ in range(k)]
        assert list(warc.merge_runs(runs)) == sorted(x for run in runs for x in run)


def test_url_keys_sort_by_domain():
    assert warc.url_key("http://www.Example.org/a?b=1") == "org,example,www)/a?b=1"
    assert warc.url_key("urn:unknown") == "urn:unknown"
    assert warc.url_key("http://x.y") == "y,x)/"
