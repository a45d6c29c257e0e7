import math

import pytest
from pyspark.sql import functions as F

from marquee.functions import frequency, titles, traffic, vectors


def column(spark, rows, schema, make):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(make).collect()]


def test_titles(spark):
    raw = [None, "abc", "Name (1999)", "Name (1999) ", "Name", "A, B (2001)"]
    rows = [(x,) for x in raw]
    years = column(spark, rows, "t string", titles.release_year(F.col("t")))
    assert years == [1990, 1990, 1999, 1999, 1990, 2001]
    online = column(spark, rows, "t string", titles.release_year(F.col("t"), 0))
    assert online == [0, 0, 1999, 1999, 0, 2001]
    clean = column(spark, rows, "t string", titles.clean_title(F.col("t")))
    assert clean == [None, "abc", "Name", "Name", "Name", "A, B"]


def test_genres(spark):
    rows = [(None,), ("",), ("Action",), ("Action|War|Drama|IMAX",)]
    lists = column(spark, rows, "g string", titles.genre_list(F.col("g")))
    assert lists == [[], [], ["Action"], ["Action", "War", "Drama", "IMAX"]]
    slots = column(spark, rows, "g string", titles.slot(titles.genre_list(F.col("g")), 2))
    assert slots == [None, None, None, "Drama"]


def test_by_frequency_breaks_ties_by_first_appearance(spark):
    rows = [
        (["Action", "Adventure", "Sci-Fi", "Thriller", "Crime", "Horror", "Thriller"],),
        ([],),
    ]
    out = column(spark, rows, "g array<string>", frequency.by_frequency(F.col("g")))
    assert out == [["Thriller", "Action", "Adventure", "Sci-Fi", "Crime", "Horror"], []]


def test_by_frequency_of_batches(spark):
    """Only the most frequent, over rows of a batch, with long lists and missing ones."""
    long = [f"g{i % 5000}" for i in range(20_000)] + ["g7", "g3", "g7"]
    rows = [(["b", "a", "a", "c"],), (None,), (long,), ([],), (["c"],)]
    out = column(spark, rows, "g array<string>", frequency.by_frequency(F.col("g"), 2))
    assert out == [["a", "b"], None, ["g7", "g3"], [], ["c"]]
    joined = spark.createDataFrame([(i,) for i in range(30)], "i int").select(
        frequency.by_frequency(F.array(F.lit("x"), F.col("i").cast("string"), F.lit("x"))).alias("g"), "i"
    )
    assert {r.i: r.g for r in joined.collect()} == {i: ["x", str(i)] for i in range(30)}


def test_cosine(spark):
    rows = [
        ([1.0, 0.0], [1.0, 0.0]),
        ([1.0, 0.0], [0.0, 2.0]),
        (None, [1.0]),
        ([1.0], [1.0, 2.0]),
        ([0.0, 0.0], [1.0, 2.0]),
    ]
    out = column(
        spark, rows, "a array<float>, b array<float>", vectors.cosine(F.col("a"), F.col("b"))
    )
    assert out[:4] == [1.0, 0.0, -1.0, -1.0]
    assert math.isnan(out[4])


def test_vector_text(spark):
    rows = [([0.5, -1.25, 1e-05],)]
    text = column(spark, rows, "v array<float>", vectors.to_text(F.col("v")))
    assert text[0].split()[0] == "0.5"
    back = column(
        spark, rows, "v array<float>", vectors.from_text(vectors.to_text(F.col("v")))
    )
    assert back[0] == pytest.approx([0.5, -1.25, 1e-05], rel=1e-6)


def polynomial_hash(text):
    h = 0
    for c in text:
        h = (h * 31 + ord(c)) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def test_string_hash_and_buckets(spark):
    ids = ["10351", "7", "123456789012", "zzzzzzzzzzzz", "polygenelubricants"]
    rows = [(x,) for x in ids]
    hashes = column(spark, rows, "u string", traffic.string_hash(F.col("u")))
    assert hashes == [polynomial_hash(x) for x in ids]
    assert hashes[0] == 46733200
    assert min(hashes) < 0
    expected = [int(math.fmod(h, 5)) for h in hashes]
    assert column(spark, rows, "u string", traffic.bucket(F.col("u"))) == expected


def test_routing(spark):
    rows = [(None,), ("",), ("10351",)]
    models = column(spark, rows, "u string", traffic.routed_model(F.col("u")))
    assert models[:2] == ["DefaultEmbedding"] * 2
    assert models[2] == "NeuralCF"
    off = column(spark, rows, "u string", traffic.routed_model(F.col("u"), testing=False))
    assert off == ["DIN"] * 3
    names = [("EmbeddingMLP",), ("WideNDeep",), ("DeepFM",), ("DefaultEmbedding",)]
    scorers = column(spark, names, "m string", traffic.scorer(F.col("m")))
    assert scorers == ["NeuralCF", "DIN", "DIN", "DefaultEmbedding"]
