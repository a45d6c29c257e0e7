"""Linked documents and components against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from marquee.llm import jaccard_join as op

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text, width):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return set()
    if len(words) < width:
        return {tuple(words)}
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(rows[i][0], len(sets[i]), rows[find(i)][0]) for i in range(len(rows))]


def corpus(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefghiß") for _ in range(rnd.randint(1, 6))) for _ in range(400)]
    out = []
    for size in (0, 1, 2, 3, 5, 9, 12, 17, 30, 60, 120, 300, 900):
        base = [rnd.choice(words) for _ in range(size)]
        out.append(base)
        for _ in range(6):
            near = list(base)
            for _ in range(rnd.randint(0, max(1, size // 25))):
                if near:
                    near[rnd.randrange(len(near))] = rnd.choice(words)
            out.append(near + [rnd.choice(words)] * rnd.randint(0, max(0, size // 40)))
    texts = [rnd.choice([" ", "\n", "  \t"]).join(w) for w in out]
    texts = [t.upper() if rnd.random() < 0.2 and "ß" not in t else t for t in texts]
    return texts + ["", None, " \n\t", "same words", "Same  WORDS"]


@pytest.mark.parametrize("seed,width,percent", [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_all_pairs(spark, seed, width, percent):
    rows = [(i * 3 + 1, t) for i, t in enumerate(corpus(seed))]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = op.link_documents(df, width, percent).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == sorted(brute(sorted(rows), width, percent))


def test_chain_of_near_copies(spark):
    """A crowd in which most pairs do not link directly, but all are connected."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(5_000)]
    base = [rnd.choice(words) for _ in range(200)]
    rows = []
    for i in range(40):
        base[(i * 5) % 200] = rnd.choice(words)
        rows.append((100 - i, " ".join(base)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = op.link_documents(df).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, found.collect())) == sorted(brute(sorted(rows), 3, 90))


def test_sketches_of_partners_meet():
    for percent in (90, 80, 60):
        for b in [*range(1, 400), 1_000, 5_000]:
            own = set(op.sketch_sizes(b, percent).tolist())
            for a in range(-(-b * percent // 100), b + 1, 1 + b // 300):
                m = int(op.sketch_sizes(a, percent)[-1])
                assert m in own and m > op.allowance(a, b, percent)


def test_sketch_bounds_difference():
    rnd = np.random.default_rng(1)
    for _ in range(300):
        n = int(rnd.integers(10, 400))
        a = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        drop = int(rnd.integers(0, max(1, len(a) // 10)))
        b = np.unique(np.append(a[drop:], rnd.integers(0, 2**63, drop // 2).astype(np.uint64)))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 90 * (len(a) + len(b) - both):
            assert set(op.keys_of(a, 90, None).tolist()) & set(op.keys_of(b, 90, None).tolist())


def test_edge_rows(spark):
    rows = [(1, "a b c d", 5), (1, "a b c d", 6), (1, "x y z", 7), (None, "a b c d", 8), (None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_shingles int")
    found = op.link_documents(df).collect()
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in found) == [(0, 0), (0, 2), (1, 1), (1, 2), (1, 2)]
    assert {r["component_id"] for r in found if r["n_shingles"] == 2} == {None}
    assert op.link_documents(df.limit(0)).count() == 0
    left = sorted((r["doc_id"] or 0, r["text"] or "") for r in op.keep_one(df).collect())
    assert left == [(0, ""), (0, "a b c d"), (1, "x y z")]


def test_long_pair_that_differs_in_the_first_segments(spark):
    a = [f"w{i}" for i in range(20_000)]
    triples = pa.array([" ".join(a[i : i + 3]) for i in range(len(a) - 2)])
    blocks = op.shingle_sets(triples, 3)
    place = np.concatenate([values for _, _, values, _ in blocks]) >> np.uint64(32)
    b = list(a)
    for size in op.sketch_sizes(len(place), 90):
        segment = (place * np.uint64(size) >> np.uint64(32)).astype(int)
        for n in range(64):
            b[int(np.flatnonzero(segment == n)[0])] = f"other{size}x{n}"
    docs = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b))], "doc_id bigint, text string")
    found = op.link_documents(docs).collect()
    assert {r["component_id"] for r in found} == {1}


def test_keys_move_once(spark):
    rows = [(1, 7), (2, 7), (3, 8), (4, None), (5, 9), (5, 9), *((i, 10) for i in range(5_000))]
    keyed = spark.createDataFrame(rows, "rep bigint, key bigint")
    found = op._met(keyed)
    assert found.columns == ["key", "rep"]
    wanted = [(k, r) for r, k in rows if k in (7, 9, 10)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
