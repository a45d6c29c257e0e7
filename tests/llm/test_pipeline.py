"""The pipeline's stages on planted documents, against plain versions of the same rules."""

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from marquee.llm import mixing

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus():
    rnd = random.Random(11)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = say(60)
    rows, labels = [], []
    for i in range(120):
        text = say(rnd.randint(60, 160))
        if i % 4 == 0:
            text += " vile rotten"
        labels.append((i, 1, int(i % 4 == 0)))
        if i in (9, 21, 33):
            text = f"{text} {passage} {say(20)}"
        rows.append((i, text))
    rows[50] = (50, rows[49][1])
    near = rows[53][1].split()
    near[5] = "changed"
    rows[54] = (54, " ".join(near))
    rows += [(200, ""), (201, None), (201, None), (None, rows[57][1])]
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in rows]
    return rows, labels, passage


def test_stages(spark, tmp_path):
    rows, labels, passage = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after[name] = docs
        if name != "encode":
            assert docs.columns == COLUMNS
    ids = lambda name: [r["doc_id"] for r in after[name].collect()]
    clean = ids("toxicity")
    assert not {i for i, _, t in labels if t} & set(clean)
    assert {i for i, _, t in labels if not t} <= set(clean) and clean.count(201) == 2
    single = ids("near copies")
    gone = set(clean) - set(single)
    # 50 copies 49, 54 is near 53, and the row without id, which is first, keeps 57 out
    assert gone == {50, 54, 57} and None in single and single.count(201) == 2
    texts = {r["doc_id"]: r for r in after["repeated passages"].collect()}
    assert set(texts) == set(single)
    assert [i for i in (9, 21, 33) if passage in (texts[i]["text"] or "")] == [9]
    assert all(r["n_chars"] == len(r["text"] or "") for r in texts.values())
    mixed = {}
    for r in after["mix"].collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + 1
    plan = mixing._planned(after["repeated passages"], 0).collect()
    wanted = {}
    for r in plan:
        wanted[r["doc_id"]] = wanted.get(r["doc_id"], 0) + r["copies"]
    assert mixed == {i: n for i, n in wanted.items() if n}
    library = Tokenizer.from_file(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for r in after["encode"].collect():
        assert r["ids"] == library.encode(texts[r["doc_id"]]["text"] or "", add_special_tokens=False).ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == after["encode"].count()


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet")
    )
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
