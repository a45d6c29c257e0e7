"""A training corpus from raw documents: clean, without copies, mixed and encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last
return the columns of documents; the last returns the encoded corpus, one row per document of the
mix. Rows with equal ids are documents of their own up to the mix, which repeats documents on
purpose. Null texts count as empty. An empty table passes through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import bpe_automaton, jaccard_join, mixing, suffix_dedup, toxicity
from marquee.plans.lineage import materialize

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
TOKENIZER = "word_bpe_49k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score doesn't reject, as they came.

    Learns from labels that are not held out; a document's score depends on its text alone.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.keep(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group that shares most shingles of five words."""
    return jaccard_join.keep_one(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur earlier, in whole characters; n_chars follows.

    A document of which nothing is left goes; one that came empty or null stays as it is.
    """
    left = suffix_dedup.remove_repeats(docs, texts=True)
    changed = {
        "text": F.col("kept").alias("text"),
        "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("bigint"))
        .otherwise(F.col("_doc.n_chars"))
        .alias("n_chars"),
    }
    return left.where("n_removed = 0 or kept != ''").select(
        *[changed.get(c, F.col(f"_doc.`{c}`").alias(c)) for c in docs.columns]
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, at the rate of their source."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of every document of the mix."""
    return bpe_automaton.encode_documents(
        docs, public_tokenizers.path(TOKENIZER), ids=True, decoded=False
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("repeated passages", drop_repeats),
    ("mix", mix_sources),
    ("encode", encode),
]

# The stages learn a classifier, sort suffixes and merge tokens, which SQL can't express; the tests
# hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
