"""Toxicity scores: logistic regression by FTRL-proximal over hashed word n-grams and skip-grams.

A word is a run of ASCII letters and digits or non-ASCII bytes, lower case. A document's features
are its distinct words, word pairs and pairs with one word skipped, hashed to 2**BITS slots, each
with value 1, and a constant. Nothing but the text enters a score.

A null or empty text has the constant alone and gets its score; a very long text is read whole,
block by block; equal texts get equal scores. Labelled rows with a null id, a null label or no
document are not learned from. Without any labelled row every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm import worker
from marquee.llm.textbytes import byte_table, column_bytes, join_words, word_sequences
from marquee.plans.lineage import materialize

BITS = 20
# Bounds of the labelled sample that the model is fitted on, by one task: rows, and bytes of a text.
TRAIN_ROWS = 12_000
TRAIN_TEXT = 1 << 18
PASSES = 8
ALPHA, BETA, L1, L2 = 1.5, 1.0, 4.0, 0.0
REJECT = 0.7

_LETTERS = bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_KINDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0], np.uint64)


def features(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of texts: first, last, slots, text number within the block; slots may repeat."""
    data, offsets = column_bytes(column)
    member, to = byte_table(_LETTERS)
    mask = np.uint64((1 << BITS) - 1)
    for first, last, words, texts in word_sequences(data, offsets, member, to):
        slots, owners = [], []
        for kind, gap in enumerate((0, 1, 2)):
            if gap:
                same = texts[gap:] == texts[:-gap]
                hashed = join_words([words[:-gap][same], words[gap:][same]])
                owner = texts[gap:][same]
            else:
                hashed, owner = words, texts
            slots.append(((hashed ^ _KINDS[kind]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & mask)
            owners.append(owner)
        yield first, last, np.concatenate(slots).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """Per-coordinate learning rates; a weight is zero until its gradients add up beyond L1."""

    def __init__(self) -> None:
        size = (1 << BITS) + 1
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, slots: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        pulled = np.sign(z) * np.maximum(np.abs(z) - L1, 0.0)
        return -pulled / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, slots: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = 1.0 / (1.0 + np.exp(-min(max(w.sum(), -35.0), 35.0))) - label
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def _fit(table: pa.Table) -> pa.Table:
    """Weights from the sample of labelled texts, read in order of their draws."""
    table = table.sort_by([("draw", "ascending"), ("doc_id", "ascending")])
    rows: list[np.ndarray] = []
    for first, last, slots, texts in features(table.column("text")):
        order = np.argsort(texts, kind="stable")
        bounds = np.searchsorted(texts[order], np.arange(last - first + 1))
        for a, b in zip(bounds[:-1], bounds[1:]):
            rows.append(np.append(np.unique(slots[order[a:b]]), 1 << BITS))
    labels = table.column("toxic").to_pylist()
    model = Ftrl()
    for _ in range(PASSES):
        for slots, label in zip(rows, labels):
            model.learn(slots, label)
    weights = model.weights()
    kept = np.flatnonzero(weights)
    return pa.table({"slot": pa.array(kept, pa.int64()), "weight": pa.array(weights[kept])})


def fit(
    documents: DataFrame,
    labels: DataFrame,
    usable: Column,
    rows: int = TRAIN_ROWS,
    text_bytes: int = TRAIN_TEXT,
) -> DataFrame:
    """(slot, weight) of the model, from at most `rows` labelled documents.

    The sample is the rows of the labelled ids with the smallest hashes, of texts of at most
    `text_bytes`; longer ones teach nothing, but are scored. Of rows with equal ids one is taken,
    by a hash of its text, and an id that is labelled several times is toxic if it is so once. `usable` is a
    condition on doc_id that labels must meet.
    """
    known = (
        labels.where(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("draw", F.xxhash64("doc_id"))
        .orderBy("draw", "doc_id")
        .limit(rows)
    )
    # at most `rows` narrow rows, so the texts need no shuffle to find them
    chosen = materialize(known, "labelled")
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # ids may be repeated, and texts may be long
    short = found.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= text_bytes)
    one = W.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    texts = short.withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    return texts.groupBy(F.lit(0).alias("sample")).applyInArrow(
        lambda t: worker.trimmed(_fit(t)), "slot bigint, weight double"
    )


def _scorer(documents: DataFrame, model: DataFrame):
    """Scores of an Arrow column of texts; the model has at most 2**BITS + 1 weights."""
    rows = model.toPandas()
    slots, weights = rows["slot"].to_numpy(np.int64), rows["weight"].to_numpy(np.float64)
    shared = documents.sparkSession.sparkContext.broadcast((slots, weights))

    def scores(column: pa.Array) -> np.ndarray:
        table = np.zeros((1 << BITS) + 1)
        table[shared.value[0]] = shared.value[1]
        used, low = table != 0, np.int64((1 << (BITS + 1)) - 1)
        total = np.full(len(column), table[-1])
        for first, last, found, texts in features(column):
            hit = used[found]
            # a slot counts once per text
            pairs = np.unique((texts[hit] << (BITS + 1)) | found[hit])
            total[first:last] += np.bincount(
                pairs >> (BITS + 1), weights=table[pairs & low], minlength=last - first
            )
        return 1.0 / (1.0 + np.exp(-np.clip(total, -35, 35)))

    return scores


def score(documents: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, score) per document."""
    scores = _scorer(documents, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array(scores(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), found], names=["doc_id", "score"]
            )

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        worker.trimming(run), "doc_id bigint, score double"
    )


def keep(documents: DataFrame, model: DataFrame, reject: float = REJECT) -> DataFrame:
    """The documents that score below `reject`, as they came."""
    scores = _scorer(documents, model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(batch.column(at)) < reject))

    return documents.mapInArrow(worker.trimming(run), documents.schema)


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learned from."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % 3 == 1


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) per document, learned from labels not held out."""
    model = fit(documents, labels, ~held_out(F.col("doc_id")))
    scored = score(documents, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= REJECT).cast("int").alias("predicted"),
    )
