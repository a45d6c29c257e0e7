"""Repeated passages against a brute-force search."""

import hashlib
import random

import numpy as np
import pytest

from marquee.llm import suffix_dedup as op


def brute(rows, window):
    """rows: (doc_id, text) in order; what op1 promises, string by string."""
    seen, out = set(), []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - window + 1):
            piece = data[s : s + window]
            if piece in seen:
                gone[s : s + window] = True
            seen.add(piece)
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        left = bytes(b for b, g in zip(data, gone) if not g)
        out.append(
            (doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
        )
    return out


def texts(seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 7))) for _ in range(80)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, line = say(60), say(30)
    made = [say(rnd.randint(0, 120)) for _ in range(12)]
    made += [f"{say(20)} {passage} {say(20)}" for _ in range(6)]
    made += [f"{line}\n{line}\n{say(5)}", made[3], made[3], "", None, "short", "x" * 700]
    made += ["ab" * 300, passage, f"{passage}{passage}"]
    made[5] = made[4][:150] + "Q" + made[4][150:]
    rnd.shuffle(made)
    return made


def rows_of(df):
    return sorted(
        (r["_doc"]["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"])
        for r in df.collect()
    )


@pytest.mark.parametrize("seed,window,gram,crowd", [(1, 100, 32, 100_000), (2, 40, 16, 2), (3, 30, 8, 0)])
def test_brute_force(spark, seed, window, gram, crowd):
    rows = [(i * 7, t) for i, t in enumerate(texts(seed))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = op.remove_repeats(df, window, gram, crowd=crowd, group_bytes=2_000)
    assert rows_of(found) == sorted(brute(rows, window))


def test_previous_factors():
    rnd = np.random.default_rng(0)
    for _ in range(200):
        text = rnd.integers(0, 2, rnd.integers(1, 30)).tolist()
        order = sorted(range(len(text)), key=lambda i: text[i:])

        def shared(i, j):
            n = 0
            while max(i, j) + n < len(text) and text[i + n] == text[j + n]:
                n += 1
            return n

        common = [0] + [shared(a, b) for a, b in zip(order, order[1:])]
        found = op.previous_factors(np.array(order), np.array(common))
        wanted = [max([shared(j, i) for j in range(i)], default=0) for i in order]
        assert found.tolist() == wanted


def test_texts_keep_whole_characters(spark):
    body = "".join(chr(0x100 + i) for i in range(70))
    df = spark.createDataFrame(
        [(1, f"a{body}"), (2, f"bb{body}c"), (3, f"{body[:51]}Ā")], "doc_id int, text string"
    )
    rows = {r["_doc"]["doc_id"]: r["kept"] for r in op.remove_repeats(df, texts=True).collect()}
    assert rows[1] == f"a{body}" and rows[2] == "bbc" and rows[3] == "Ā"


def test_edge_rows(spark):
    text = "word by word this sentence is long enough to be found again in a copy of itself " * 2
    rows = [(1, text, 9), (1, text, 8), (None, text, 7), (None, None, 6), (2, "", 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_removed int")
    found = op.remove_repeats(df).collect()
    assert len(found) == 5
    removed = sorted((r["_doc"]["doc_id"] or 0, r["n_bytes"] - r["n_removed"]) for r in found)
    left = len(text) - next(
        r["n_removed"] for r in found if r["_doc"]["doc_id"] is None and r["n_bytes"]
    )
    assert removed == [(0, 0), (0, left), (1, 0), (1, 0), (2, 0)]
    assert op.remove_repeats(df.limit(0)).count() == 0


def test_columns_with_the_names_of_helpers_come_back(spark):
    text = "a passage of more than a hundred bytes which comes again in a later document as it is " * 2
    names = ["_row", "_value", "_any", "_doc", "_group", "_text", "row", "place", "_range"]
    rows = [(i, text, *[i * 100 + j for j in range(len(names))]) for i in (3, 3, 1)]
    schema = "doc_id bigint, text string, " + ", ".join(f"{n} int" for n in names)
    found = op.remove_repeats(spark.createDataFrame(rows, schema)).collect()
    assert sorted(r["n_removed"] > 0 for r in found) == [False, True, True]
    for r in found:
        assert [r["_doc"][n] for n in names] == [r["_doc"]["doc_id"] * 100 + j for j in range(len(names))]
    assert next(r for r in found if not r["n_removed"])["_doc"]["doc_id"] == 1


def test_order_of_numbers_whose_upper_bits_are_equal():
    rnd = np.random.default_rng(1)
    values = rnd.integers(0, 1 << 63, 500).astype(np.uint64)
    values[200:300] = values[:100]
    assert op._stable_order(values).tolist() == np.argsort(values, kind="stable").tolist()
    values[400] = values[0] ^ np.uint64(1)  # differs in a bit that gives way to the position
    values[0], values[400] = max(values[0], values[400]), min(values[0], values[400])
    assert op._stable_order(values).tolist() == np.argsort(values, kind="stable").tolist()


def test_order_of_texts_looks_further_at_ties_only():
    rnd = random.Random(2)
    texts_ = [bytes(rnd.choices(b"ab", k=6)) + bytes(rnd.choices(b"xy", k=14)) for _ in range(300)]
    texts_ = sorted(set(texts_), key=lambda t: t[::-1])
    data = np.frombuffer(b"".join(texts_), np.uint8)
    order = op._text_order(op._words(data), np.arange(len(texts_)) * 20, [0, 8, 12])
    assert [texts_[i] for i in order] == sorted(texts_)
