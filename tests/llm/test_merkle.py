"""The manifest against a tree built in one place."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from marquee.llm import merkle_manifest as m

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, root string, proof int"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    values = (doc_id, source, lang, n_chars, text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels, i, fanout):
    out = []
    for nodes in levels[:-1]:
        first = i - i % fanout
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
        i //= fanout
    return out


def plain(rows, fanout=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row."""
    by_source = {}
    for doc_id, text, lang, source, n_chars, *_ in rows:
        by_source.setdefault(source, []).append((doc_id, source, lang, n_chars, text))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by_source[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[name] = tree([leaf(*r) for r in by_source[name]], fanout)
    top = tree([trees[name][-1][0] for name in names], fanout)
    out = []
    for s, name in enumerate(names):
        for i, row in enumerate(by_source[name]):
            proof = siblings(trees[name], i, fanout) + siblings(top, s, fanout)
            now = row
            if row[0] is not None and row[4] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                now = (*row[:4], row[4].replace("\n", ""))
            node = leaf(*now)
            for before, after in proof:
                node = h(before + node + after)
            root = top[-1][0]
            joined = h("".join(b + a for b, a in proof))
            out.append((row[0], leaf(*row), trees[name][-1][0], root, joined, node, node == root))
    return sorted(out, key=repr)


def audited(df):
    found = m.audit(df).select(
        "doc_id", "leaf", "subroot", "root", m.proof_digest(F.col("proof")), "folded_root", "verified"
    )
    return sorted(map(tuple, found.collect()), key=repr)


def documents():
    rows = []
    # sources of 1 to 200 rows, so that subtrees of a group differ much in size
    for s, n in enumerate([1, 200, 3, 10, 27, 28, 2, 81]):
        name = [None, "", "a", "é", "z", "Z", "aa", "𝔸"][s]
        rows += [(1000 * s + i, f"text {i}\nmore {i * i}", "en", name, i, "x", 1) for i in range(n)]
    rows += [(None, "null id\n", None, "a", None, "x", 1)] * 2
    rows += [(1, None, "en", "a", 3, "x", 1), (1, "", "en", "a", 3, "x", 1), (1, "", "en", "a", 3, "x", 1)]
    rows += [(5, "line\n" * 50_000, "é", "z", 9, "x", 1), (-5, "no line feed", "en", "z", 9, "x", 1)]
    return rows


@pytest.mark.parametrize("fanout, levels", [(3, 1), (3, 2), (3, 7), (2, 2)])
def test_same_as_a_tree_in_one_place(spark, monkeypatch, fanout, levels):
    monkeypatch.setattr(m.manifest, "__defaults__", (fanout, levels))
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = audited(df)
    assert got == plain(rows, fanout)
    assert {r[-1] for r in got} == {True, False}


def test_one_source_and_no_rows(spark):
    rows = [(i, "t", "en", "only", 1, "x", 1) for i in range(10)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert audited(df) == plain(rows)
    assert audited(df.limit(1)) == plain(rows[:1])
    assert audited(df.limit(0)) == []


def test_every_round_keeps_one_row_per_block_and_lane(spark):
    """A subtree serves the lanes its neighbours have more, and no lane is served twice."""
    leaves = spark.createDataFrame(
        [(i, s, f"{s}{i}") for s, n in [("a", 90), ("b", 1), ("c", 7)] for i in range(n)],
        "doc_id bigint, source string, leaf string",
    )
    found = m.manifest(leaves, 3, 1).collect()
    assert len(found) == 98 and len({r["root"] for r in found}) == 1
    for r in found:
        node = r["leaf"]
        for level in r["proof"]:
            node = h(level["before"] + node + level["after"])
        assert node == r["root"]
