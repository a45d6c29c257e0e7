"""Token counts, BPE, mixing, toxicity and licences."""

import hashlib
import math
import os
import random
import re
import uuid
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marquee.llm import (
    bpe_automaton,
    jaccard_join,
    licenses,
    mixing,
    token_counts,
    toxicity,
    worker,
)
from marquee.llm.textbytes import byte_table, column_bytes, join_words, words_of

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")


def odd_texts():
    rnd = random.Random(4)
    texts = [
        "", None, " ", "\n\n a\t b ", "It's we've I'LL they'd 12345", "a<|endoftext|>b <|startoftext|>",
        "café café ﬁ ΟΔΥΣΣΕΥΣ İ 中文 字 😀👍🏽", "\x1c\x1d a\x1cb\x85c d", "the" * 3_000,
        "!!!???... --- ''s 's 't", "x" * 40_000, "Straße NAÏVE, élan; ÀÉÎ: ÿ!", "́a ͅ",
    ]
    letters = "aabcdeeghilnorstuvw '’éßñ1 \n.,"
    return texts + ["".join(rnd.choice(letters) for _ in range(200)) for _ in range(60)]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i // 2 if i % 9 else None, t, 1) for i, t in enumerate(odd_texts())]
    schema = "doc_id bigint, text string, n_tokens int"
    stored = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").limit(60)
    more = stored.withColumn("n_tokens", F.lit(1))
    return spark.createDataFrame(rows, schema).union(more).repartition(3)


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(BYTE)
    wanted = sorted(
        (r["doc_id"] or 0, len((r["text"] or "").encode()), len(library.encode(r["text"] or "").ids))
        for r in texts.collect()
    )
    found = token_counts.count_tokens(texts, BYTE).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in found) == wanted
    assert all(r["over_limit"] == (r["n_tokens"] > 1024) for r in found)
    assert token_counts.count_tokens(texts.limit(0), BYTE).count() == 0


def test_token_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 700)
    library = Tokenizer.from_file(BYTE)
    lengths = token_counts.Lengths({" the": 1}, library)
    for text in filter(None, odd_texts()):
        assert token_counts.count_one(text, lengths, ("<|endoftext|>",)) == len(library.encode(text).ids)
    assert len(lengths) <= 7
    held = len(lengths)
    assert lengths["y" * 5_000] == len(library.encode("y" * 5_000).ids) and len(lengths) == held


def test_frequent_pieces_describe_all_documents(spark):
    """Each tenth of the files has a word of its own; all are in the table, and counts are merged."""
    rows = [(f"common w{i % 10} " * 30 + f"rare{i}x" + "z" * 300,) for i in range(400)]
    df = spark.createDataFrame(rows, "text string").repartitionByRange(10, F.col("text"))
    definition = Path(BYTE).read_text(encoding="utf-8")
    library = Tokenizer.from_file(BYTE)
    for fan in (2, 3, 16):
        found = token_counts.frequent_pieces(df, definition, 64, fan)
        assert {" common", " w", *"0123456789"} <= set(found) and len(found) <= 64
        assert all(n == len(library.encode(p).ids) for p, n in found.items())
        assert max(map(len, found)) <= token_counts.LONG
    assert token_counts.unpack(token_counts.pack(found)) == found
    assert token_counts.frequent_pieces(df.limit(0), definition) == {}
    assert token_counts.unpack(token_counts.pack({})) == {}


def test_thinned_counts_are_short_by_a_bounded_share():
    rnd = random.Random(8)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(20_000)]
    merged, exact = Counter(), Counter(words)
    for i in range(0, len(words), 500):
        merged = token_counts.thin(merged + token_counts.thin(Counter(words[i : i + 500]), 40), 40)
    assert len(merged) <= 40
    assert all(0 <= n - merged[w] <= len(words) / 40 for w, n in exact.items())


def test_bpe(spark, texts):
    library = Tokenizer.from_file(WORD)
    wanted = []
    for r in texts.collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        wanted.append(
            (r["doc_id"] or 0, len(ids), digest, hashlib.sha256(text.encode()).hexdigest(), ids, text)
        )
    found = [((r[0] or 0), *r[1:]) for r in bpe_automaton.encode_documents(texts, WORD).collect()]
    assert sorted(found) == sorted(wanted)
    assert bpe_automaton.encode_documents(texts.limit(0), WORD).count() == 0


def plain_bpe(word, ranks, suffix):
    parts = [*word[:-1], word[-1] + suffix]
    while len(parts) > 1:
        rank, at = min((ranks.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank == 1 << 30:
            break
        pair = tuple(parts[at : at + 2])
        out, i = [], 0
        while i < len(parts):
            if tuple(parts[i : i + 2]) == pair:
                out.append(pair[0] + pair[1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return parts


def test_automaton_on_random_merges():
    rnd = random.Random(0)
    for _ in range(60):
        symbols = [a + s for a in "abc" for s in ("", "$")]
        vocabulary = {s: i for i, s in enumerate(symbols)}
        merges = []
        for _ in range(rnd.randint(1, 25)):
            u = rnd.choice([s for s in vocabulary if not s.endswith("$")])
            v = rnd.choice(list(vocabulary))
            if (u, v) not in merges and u + v not in vocabulary:
                merges.append((u, v))
                vocabulary[u + v] = len(vocabulary)
        machine = bpe_automaton.Automaton(vocabulary, merges, "$")
        ranks = {m: i for i, m in enumerate(merges)}
        for _ in range(120):
            word = "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 12)))
            assert machine.decode(machine.encode(word)) == plain_bpe(word, ranks, "$")


def test_a_plain_word_is_kept_once():
    """Tables that hold a word twice forget it sooner, and spelling it again is the costly part."""
    definition = Path(WORD).read_text(encoding="utf-8")
    codec, library = bpe_automaton.Codec(definition), Tokenizer.from_file(WORD)
    for text in ("word the. Word, WORD! naïve x</w>y the", "", " \x1c ", "日本 the</w> é?!"):
        tokens = codec.encode(text)
        wanted = library.encode(text, add_special_tokens=False).ids
        assert tokens.tolist() == wanted
        assert codec.decode(tokens) == library.decode(wanted, skip_special_tokens=False)
    assert "word" in codec.joined.young and "word" not in codec.known.young
    assert "Word," in codec.joined.young and "naïve" in codec.joined.young


def test_mix_repeats_documents(spark):
    rows = [(i, " ".join(["w"] * (i % 7)), "abc"[i % 3] if i % 10 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    df = df.withColumn("copies", F.lit(9)).withColumn("size", F.lit("x"))
    account = {r["doc_id"]: r for r in mixing.account(df).collect()}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert len(account) == 400 and max(counts.values()) <= 2
    for i, text, _ in rows:
        size = len(text.split())
        assert (account[i]["size"], account[i]["taken"]) == (size, size * counts.get(i, 0))
    assert mixing.mix(df.limit(0)).count() == 0


def test_targets_by_hand(spark):
    sizes = {"a": 10, "b": 100, "c": 1_000, None: 0, "d": 390}
    df = spark.createDataFrame(list(sizes.items()), "source string, size bigint")
    found = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    # deal out, cap, deal the rest out again
    weight = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    target = dict.fromkeys(sizes, 0.0)
    left, open_ = 1.5 * sum(sizes.values()), set(sizes)
    while left > 1e-9:
        unit = left / sum(weight[s] for s in open_)
        left = 0.0
        for s in list(open_):
            target[s] += unit * weight[s]
            if target[s] > 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    assert found == pytest.approx(target)
    mixed = {r["source"]: r["target"] for r in mixing.source_targets(df.where("size = 0")).collect()}
    assert mixed == {None: 0.0}


def test_taken_words_come_near_targets(spark):
    rows = [(i, 1 + i % 50, f"s{i % 4}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "_row bigint, size bigint, source string")
    planned = mixing.plan_copies(df, mixing.source_targets(df))
    taken = planned.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("t"))
    assert all(r["t"] == pytest.approx(r["target"], rel=0.05) for r in taken.collect())


@pytest.mark.parametrize("doc_id", [None, 7])
@pytest.mark.parametrize("distinct", [True, False])
def test_targets_are_met_without_sound_ids(spark, doc_id, distinct):
    """Null and repeated ids, and equal rows, don't stand or fall together."""
    rows = [(doc_id, f"w w w {i}" if distinct else "w w w w", "abc"[i % 3], 1, 2) for i in range(6_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _row int, copies int")
    account = mixing.account(df)
    totals = account.groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert sum(r["t"] for r in totals) > 0
    by_source = mixing.mix(df).groupBy("source").agg(F.sum(mixing.words(F.col("text"))).alias("t"))
    taken = sorted(r["t"] for r in by_source.collect())
    wanted = sorted(r["target"] for r in mixing.source_targets(
        df.select("source", mixing.words(F.col("text")).alias("size"))).collect())
    assert taken == pytest.approx(wanted, rel=0.05)
    assert mixing.mix(df).columns == df.columns
    again = {tuple(r) for r in mixing.account(df).groupBy("target").agg(F.sum("taken")).collect()}
    assert again == {tuple(r) for r in account.groupBy("target").agg(F.sum("taken")).collect()}


def test_a_worker_keeps_the_tables_of_one_operator():
    made = []
    first = worker.keep("a", lambda: made.append(1) or [1])
    assert worker.keep("a", lambda: made.append(2) or [2]) is first and made == [1]
    worker.keep("b", lambda: [3])
    assert worker.keep("a", lambda: [4]) == [4]
    column_bytes(pa.array(["x"]))
    assert not worker._kept


def test_a_worker_hands_its_memory_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096 / 2**20

    def run(batches):
        for batch in batches:
            blocks = [bytearray(b"x" * 100_000) for _ in range(1_000)]
            ends.append(blocks[-1])  # what stays at the end of the heap keeps the rest in memory
            del blocks
            yield batch

    batch, ends = pa.record_batch({"x": [1]}), []
    worker.trim()
    low = resident()
    assert list(run(iter([batch]))) == [batch]
    assert resident() > low + 60
    assert list(worker.trimming(run)(iter([batch, batch]))) == [batch, batch]
    assert resident() < low + 30
    list(run(iter([batch])))
    assert worker.trimmed(batch) is batch and resident() < low + 30


def test_operators_of_the_pipeline_hand_memory_back(spark, tmp_path, monkeypatch):
    def handed_back():
        (tmp_path / f"{os.getpid()}-{uuid.uuid4().hex}").touch()

    def tidied(run):
        def tidy(batches):
            yield from run(batches)
            handed_back()

        return tidy

    monkeypatch.setattr(worker, "trimming", tidied)
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(8)], "doc_id bigint, text string")
    model = spark.createDataFrame([(1, 0.5)], "slot bigint, weight double")
    for make in (
        lambda: toxicity.keep(docs, model),
        lambda: toxicity.score(docs, model),
        lambda: jaccard_join.link_documents(docs),
        lambda: bpe_automaton.encode_documents(docs, WORD),
    ):
        before = len(list(tmp_path.iterdir()))
        make().collect()
        assert len(list(tmp_path.iterdir())) > before


def test_recent_tables_are_bounded_by_bytes():
    table = bpe_automaton.Recent(100_000)
    for i in range(5_000):
        table.put(f"word{i}", (1, "12", "ab"))
    entries = len(table.young) + len(table.old)
    assert entries * bpe_automaton.ENTRY_BYTES <= 2 * 100_000
    table.put("x" * 2_000, (1, "", ""))
    assert table.get("x" * 2_000) is None and table.get("word4999") == (1, "12", "ab")


def test_words_and_hashes():
    texts = ["Ab  c\tab", "", None, "ab", "c ab"]
    data, offsets = column_bytes(pa.array(texts))
    member, to = byte_table()
    hashes, docs = words_of(data, offsets, member, to)
    assert docs.tolist() == [0, 0, 0, 3, 4, 4]
    assert hashes[0] == hashes[2] == hashes[3] == hashes[5] and hashes[1] == hashes[4] != hashes[0]
    pair = join_words([hashes[:1], hashes[1:2]])
    assert pair != join_words([hashes[1:2], hashes[:1]])


def test_toxicity_learns_held_out_labels(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1_500):
        toxic = rnd.random() < 0.2
        text = [rnd.choice(words) for _ in range(rnd.randint(3, 60))]
        if toxic:
            text[rnd.randrange(len(text))] = rnd.choice(["Vile", "vile,", "awful!"])
        rows.append((i, " ".join(text), "en"))
        labels.append((i, 1, int(toxic)))
    rows += [(5_000, "", "en"), (5_001, None, "en"), (None, "vile", "en"), (5_002, "vile " * 50_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    known = spark.createDataFrame(
        labels + [(None, 1, 1), (9_999, 1, 1), (3, 1, None)], "doc_id bigint, quality int, toxic int"
    )
    found = {r["doc_id"]: r for r in toxicity.score_documents(docs, known).collect()}
    assert len(found) == len(rows)
    held = [found[i] for i, _, _ in labels if found[i]["held_out"]]
    assert all(
        r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items() if i is not None
    )
    truth = {i: t for i, _, t in labels}
    right = [r["predicted"] == truth[r["doc_id"]] for r in held]
    assert np.mean(right) > 0.97
    assert found[5_000]["score"] == found[5_001]["score"] and 0 <= found[5_000]["score"] <= 1
    assert found[5_002]["predicted"] == 1 and found[None]["predicted"] == 1
    model = toxicity.fit(docs, known, ~toxicity.held_out(F.col("doc_id")))
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns
    clean = {i for i, r in found.items() if r["score"] < toxicity.REJECT}
    assert {r["doc_id"] for r in kept.collect()} == clean
    nothing = toxicity.score_documents(docs, known.limit(0)).collect()
    assert {r["score"] for r in nothing} == {0.5}
    assert toxicity.score_documents(docs.limit(0), known).count() == 0


def test_ftrl_ignores_held_out_labels(spark):
    rows = [(i, f"word{i % 5} other", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, x int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id bigint, quality int, toxic int")
    flipped = labels.withColumn(
        "toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    )
    first = sorted(map(tuple, toxicity.score_documents(docs, labels).collect()))
    assert first == sorted(map(tuple, toxicity.score_documents(docs, flipped).collect()))


LICENSED = {"MIT License": "MIT", "Apache License": "Apache-2.0", "CC BY-NC": "CC-BY-NC", "GNU General": "GPL"}


def test_licenses(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = {r["doc_id"]: r["licenses"] for r in licenses.scan_licenses(docs).collect()}
    for r in docs.collect():
        wanted = sorted({v for k, v in LICENSED.items() if k in r["text"]})
        assert (found[r["doc_id"]] or "") == ",".join(wanted)


def test_license_edge_rows(spark):
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, f"some prose here\n{notice}\nRELEASED UNDER THE MIT LICENSE.", 0),
        (1, "the version of the work and the license plate of a general", 0),
        (None, notice, 0), (2, None, 0), (3, "", 0), (4, "a\n" * 5_000 + notice, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, licenses int")
    found = licenses.scan_licenses(docs).collect()
    got = sorted((r["doc_id"] or 0, r["n_paragraphs"], r["licenses"]) for r in found if r["licenses"])
    assert got == [(0, 1, "GPL"), (1, 3, "GPL,MIT"), (4, 5_001, "GPL")]
    assert sorted(r["n_paragraphs"] for r in found if not r["licenses"]) == [0, 0, 1]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_notices_inside_long_lines(spark):
    rnd = random.Random(5)
    stored = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("text is not null").limit(40)
    prose = [w for r in stored.collect() for w in r["text"].split()[:300]]
    ordinary = "the of to and in a is that for it as with be by on not this are or from".split()
    rows, wanted = [], {}
    for family, templates in licenses.TEMPLATES.items():
        for template in templates:
            for n in (200, 1_000):
                for share in (0.0, 0.5):
                    words = [rnd.choice(ordinary if rnd.random() < share else prose) for _ in range(n)]
                    at = rnd.randrange(n)
                    wanted[len(rows)] = family
                    rows.append((len(rows), " ".join([*words[:at], template, *words[at:]])))
    mit, cc = licenses.TEMPLATES["MIT"][0], licenses.TEMPLATES["CC0"][0]
    wanted[len(rows)] = "CC0,MIT"
    rows.append((len(rows), f"{mit} {cc} " + " ".join(prose[:300])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lines = [r["text"] for r in stored.collect()]
    model = licenses.Model([x for t in lines for x in t.split("\n") if x.strip()][:500])
    found = licenses.scan_licenses(docs, model).collect()
    assert {r["doc_id"]: r["licenses"] for r in found} == wanted
    assert all(r["n_licensed"] == 1 for r in found)


def plain_licenses(model, text):
    """(families, licensed lines, unconfirmed lines, best probability, best similarity), by sets of
    named n-grams, unit by unit."""
    number = {}

    def hash_of(gram):
        known = [licenses._grams_of([" ".join(g)])[0] for g in (gram, gram[:-1], gram[1:])]
        return (set(known[0].tolist()) - set(known[1].tolist()) - set(known[2].tolist())).pop()

    def spelled(line):
        return re.findall(r"[0-9a-z\x80-\U0010ffff]+", line.lower())

    place = {h: i for i, h in enumerate(model.grams.tolist())}
    own = []
    for _, template in model.templates:
        words = spelled(template)
        own.append({tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)})
        for gram in own[-1]:
            number.setdefault(gram, place[hash_of(gram)])
    families, licensed, named, probabilities, similarities = set(), set(), set(), [], []
    for at, line in enumerate((text or "").split("\n")):
        words = spelled(line)
        hits = [
            (i, i + n, tuple(words[i : i + n]))
            for n in (1, 2, 3)
            for i in range(len(words) - n + 1)
            if tuple(words[i : i + n]) in number
        ]
        units = [(0, len(words), True)]
        for width in licenses.WINDOWS:
            step = width // 4
            if len(words) > width:
                last = -(-(len(words) - width) // step)
                units += [(k * step, k * step + width, False) for k in range(last + 1)]
        found = []
        for low, high, whole in units:
            first = {}
            for a, b, gram in hits:
                if low <= a and b <= high:
                    first.setdefault(gram, (a, b))
            if len(first) < model.least:
                continue
            scores = model.weights[-1] + sum(model.weights[number[g]] for g in first)
            share = np.exp(scores - scores.max())
            share /= share.sum()
            family = int(share.argmax())
            if not family or share[family] < licenses.LEAST_PROBABILITY:
                continue
            named.add(at)
            best = (-1.0, 0)
            for t, (name, _) in enumerate(model.templates):
                if name == licenses.FAMILIES[family]:
                    both = len(own[t] & set(first))
                    near = both / len(own[t])
                    if whole and len(words) >= licenses.LEAST_WORDS:
                        near = max(near, both / sum(max(len(words) - n, 0) for n in range(3)))
                    best = max(best, (min(1.0, near), -t))
            if best[0] >= licenses.LEAST_SIMILARITY:
                spans = [first[g] for g in own[-best[1]] & set(first) if len(g) > 1]
                span = min(a for a, _ in spans), max(b for _, b in spans)
                found.append((family, share[family], best[0], -best[1], *span))
        for f, p, s, _, a, b in found:
            if not any(
                g != f and z > s and d - c <= model.words[t]
                and min(b, d) - max(a, c) >= licenses.LEAST_SIMILARITY * (b - a)
                for g, _, z, t, c, d in found
            ):
                families.add(licenses.FAMILIES[f])
                licensed.add(at)
                probabilities.append(p)
                similarities.append(s)
    return (
        ",".join(sorted(families)) or None, len(licensed), len(named - licensed),
        max(probabilities, default=None), max(similarities, default=None),
    )


def test_licenses_against_plain_sets(spark):
    rnd = random.Random(8)
    prose = "some plain words about rivers and the work of a license for public use in version".split()
    rows = [(0, None), (1, ""), (2, "license license license"), (3, "a\n\nb")]
    for _, templates in licenses.TEMPLATES.items():
        for template in templates:
            for lost in (0.0, 0.25, 0.5):
                words = [w for w in template.split() if rnd.random() >= lost]
                around = [rnd.choice(prose) for _ in range(rnd.choice([0, 4, 90]))]
                cut = rnd.randint(0, len(around))
                line = " ".join([*around[:cut], *words, *around[cut:]])
                rows.append((len(rows), f"{' '.join(prose)}\n{line}" + "\n" * rnd.randint(0, 1)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = licenses.Model([" ".join(rnd.choice(prose) for _ in range(12)) for _ in range(60)])
    found = {r["doc_id"]: r for r in licenses.scan_licenses(docs, model).collect()}
    unconfirmed = 0
    for i, text in rows:
        names, licensed, left, probability, similarity = plain_licenses(model, text)
        got = found[i]
        assert (got["licenses"], got["n_licensed"], got["n_unconfirmed"]) == (names, licensed, left)
        assert got["probability"] == pytest.approx(probability)
        assert got["similarity"] == pytest.approx(similarity)
        unconfirmed += left
    assert unconfirmed  # the classifier names families by itself


def test_license_prose_comes_from_all_rows(spark, monkeypatch):
    fitted = []
    monkeypatch.setattr(licenses, "Model", lambda prose: fitted.append(prose))
    rows = [(i, f"{'early' if i < 600 else 'late'} words of {i}\n" + "long " * 4_000) for i in range(1_200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for n in (1, 5):
        licenses.fit(docs.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id"))
    first = fitted[0]
    assert first == fitted[1] and len(first) <= licenses.PROSE_PARAGRAPHS
    assert sum(p.startswith("early") for p in first) > 100 < sum(p.startswith("late") for p in first)


def plain_features(text):
    words = re.findall(r"[a-z0-9]+", text.lower())
    pairs = {("pair", *p) for p in zip(words, words[1:])} | {("skip", *p) for p in zip(words, words[2:])}
    return {*words, "constant"} | pairs


def test_ftrl_equals_a_loop_over_coordinates():
    """Weights by a plain loop over named features give the margins of the hashed model."""
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(25)]
    rows = []
    for i in range(240):
        label = i % 3 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(0, 12))] + ["Vile"] * (label and rnd.random() < 0.9)
        rnd.shuffle(text)
        rows.append((i, " ".join(text), int(label), rnd.random()))
    table = pa.table(dict(zip(("doc_id", "text", "toxic", "draw"), map(list, zip(*rows)))))
    fitted = toxicity._fit(table).to_pydict()
    weights = dict(zip(fitted["slot"], fitted["weight"]))

    z, n = Counter(), Counter()

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        pulled = z[f] - math.copysign(toxicity.L1, z[f])
        return -pulled / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for _, text, label, _ in sorted(rows, key=lambda r: r[3]):
            named = plain_features(text)
            held = {f: weight(f) for f in named}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(held.values()))))) - label
            for f, w in held.items():
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w
                n[f] += g * g
    texts = [text for _, text, _, _ in rows]
    margins = [weights.get(1 << toxicity.BITS, 0.0)] * len(texts)
    for first, last, slots, owners in toxicity.features(pa.array(texts)):
        for slot, owner in sorted(set(zip(slots.tolist(), owners.tolist()))):
            margins[first + owner] += weights.get(slot, 0.0)
    wanted = [sum(map(weight, plain_features(t))) for t in texts]
    assert any(abs(w) > 1 for w in wanted) and len(weights) > 5
    np.testing.assert_allclose(margins, wanted, rtol=1e-9, atol=1e-9)


def test_codec_hands_back_what_building_it_took(monkeypatch):
    calls = []
    monkeypatch.setattr(worker, "trim", lambda: calls.append(1))
    worker._kept.clear()
    definition = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")
    bpe_automaton.codec(definition)
    assert calls
    worker._kept.clear()
    tables = bpe_automaton.ARC_BYTES + bpe_automaton.WORD_BYTES + bpe_automaton.CHUNK_BYTES
    assert 2 * tables <= 100 << 20
