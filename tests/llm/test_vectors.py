"""Neighbours and near-duplicate vectors against all pairs."""

import math

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from marquee.llm import near_vectors, projection_forest
from marquee.llm.components import components

NAN = float("nan")
SCHEMA = "vec_id bigint, embedding array<float>, label int"


def exact(ids, x, queries, k):
    out = {}
    for q in queries:
        scores = (x[q] * x).sum(axis=1)
        order = [i for i in np.lexsort([ids, -scores]) if i != q][:k]
        out[int(ids[q])] = [(int(ids[i]), float(scores[i])) for i in order]
    return out


def test_forest_recall(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = np.array([r["embedding"] for r in rows], float)
    df = spark.createDataFrame(
        [(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<float>"
    )
    found = projection_forest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    wanted = exact(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, best in wanted.items():
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        scores = dict(zip(ids.tolist(), (x[ids == q][0] * x).sum(axis=1)))
        assert all(m[2] == pytest.approx(scores[m[1]], abs=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & {b[0] for b in best})
    assert hits / (20 * len(wanted)) >= 0.9


@pytest.mark.parametrize("lengths", ["one long", "lognormal"])
def test_forest_recall_on_unequal_lengths(spark, lengths):
    draw = np.random.default_rng(8)
    x = draw.standard_normal((2_000, 64))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    if lengths == "one long":
        x[7] *= 30
    else:
        x *= draw.lognormal(0, 1, (2_000, 1))
    ids = np.arange(2_000)
    df = spark.createDataFrame(
        [(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>"
    )
    found = projection_forest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    got = {(r["query_id"], r["vec_id"]) for r in found}
    wanted = exact(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    hits = sum((q, i) in got for q, best in wanted.items() for i, _ in best)
    assert hits / (20 * len(wanted)) >= 0.9


def test_forest_is_exact_when_all_leaves_open(spark):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((900, 8)).round(2) * draw.uniform(0.2, 5, (900, 1)).round(1)
    x[100:160] = x[100]
    ids = np.arange(900)
    df = spark.createDataFrame(
        [(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id bigint, embedding array<double>"
    )
    found = projection_forest.nearest(df, F.col("vec_id") % 20 == 0, visit=1.0).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    wanted = exact(ids, x, np.flatnonzero(ids % 20 == 0), 20)
    assert got == {q: [i for i, _ in best] for q, best in wanted.items()}


def test_forest_edge_rows(spark):
    rows = [
        (0, [1.0, 0.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (2, None, 1), (3, [NAN, 1.0], 1),
        (4, [0.0, 0.0], 1), (5, [None, 1.0], 1), (None, [2.0, 0.0], 1), (20, [float("inf"), 0.0], 1),
        (40, [1.0, 2.0, 3.0], 1), (60, [0.0, 3.0], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "score")
    found = projection_forest.nearest(df, F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got[0] == [(None, 2.0), (1, 0.5), (1, 0.5), (60, 0.0)]
    assert got[60][0] == (1, 1.5) and set(got) == {0, 60}
    assert projection_forest.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def brute_links(ids, vectors, least):
    good = [v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v) for v in vectors]
    n = len(ids)
    near = [[] for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j and good[i] and good[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / math.sqrt((a @ a) * (b @ b)) >= least:
                    near[i].append(j)
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([root[i], *(root[j] for j in near[i])])
            if low < root[i]:
                root[i], changed = low, True
    return [(ids[i], len(near[i]), ids[root[i]], root[i] == i) for i in range(n)]


@pytest.mark.parametrize("chunk", [near_vectors.CHUNK, 7])
def test_links_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_vectors, "CHUNK", chunk)
    draw = np.random.default_rng(chunk)
    centres = draw.standard_normal((30, 16))
    x = np.concatenate(
        [centres + 0.12 * s * draw.standard_normal(centres.shape) for s in (0, 1, 1, 2, 3)]
        + [np.repeat(centres[:1], 25, axis=0)]
        + [centres[1] + 0.03 * draw.standard_normal((30, 16))]
    ).astype(np.float32)
    ids = draw.permutation(len(x) * 3)[: len(x)]
    order = np.argsort(ids)
    ids, x = ids[order].tolist(), x[order].tolist()
    df = spark.createDataFrame(list(zip(ids, x)), "vec_id bigint, embedding array<float>")
    found = near_vectors.link_vectors(df.repartition(3), recall=0.9999999)
    assert sorted(map(tuple, found.collect())) == brute_links(ids, x, 0.9)


def test_link_edge_rows(spark):
    rows = [
        (5, [1.0, 0.0], 1), (3, [1.0, 0.01], 2), (3, [0.0, 1.0], 3), (4, None, 1), (6, [NAN, 1.0], 1),
        (7, [0.0, 0.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0, 0.0], 1), (10, [5.0, 0.0], 1),
        (None, [1.0, 0.0], 1), (11, [], 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "kept")
    found = near_vectors.link_vectors(df).collect()
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in found)
    assert got[0] == (0, 3, None, True)
    assert (5, 3, None, False) in got and (10, 3, None, False) in got and (3, 3, None, False) in got
    alone = [g for g in got if g[1] == 0]
    assert [g[0] for g in alone] == [3, 4, 6, 7, 8, 9, 11]
    assert all(g[2] == g[0] and g[3] for g in alone)
    assert near_vectors.link_vectors(df.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, 500), (500, 7), (9, 9), (7, 1)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    found = dict(map(tuple, components(df).collect()))
    assert {found[i] for i in range(100, 161)} == {100}
    assert [found[i] for i in (1, 7, 500)] == [1, 1, 1] and 9 not in found
