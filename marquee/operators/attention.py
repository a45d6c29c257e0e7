"""A user's recent items weighted by how close each is to the candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.vectors import dot, sigmoid
from marquee.operators.samples import RATED_MOVIES

# Vectors of at most this size, as doubles, are copied to the executors.
BROADCAST_BYTES = 64 << 20


def _pooled(items: str) -> list[Column]:
    """slots, weight and pooled vector of an array of (w, v)."""
    first = F.get(items, F.lit(0))["v"]
    others = F.slice(items, 2, len(RATED_MOVIES))
    pooled = F.aggregate(
        others, first, lambda total, item: F.zip_with(total, item["v"], lambda a, b: a + b)
    )
    return [
        F.size(items).alias("slots"),
        F.aggregate(items, F.lit(0.0), lambda t, i: t + i["w"]).alias("weight"),
        pooled.alias("pooled"),
    ]


def _weighted(vector: Column, weight: Column) -> Column:
    return F.transform(vector, lambda x: x.cast("double") * weight)


def history_attention_pool(
    samples: DataFrame, embeddings: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """(userId, movieId, slots, weight, pooled): weighted sum of the history vectors of each sample.

    The weight of a history item is sigmoid(history . candidate). Empty slots and items
    without a vector do not take part; candidates without a vector, and samples of which no slot
    takes part, have no row. At most five vectors meet per sample.

    The size of the vectors is measured first. Up to `broadcast_bytes` every task has them all, a
    sample is pooled where it lies, and nothing is exchanged. Beyond, samples meet vectors by id.
    """
    size = embeddings.agg(F.sum(F.size("emb").cast("bigint") * 8 + 8)).first()[0] or 0
    if size > broadcast_bytes:
        return _pool_by_id(samples, embeddings)
    # the joins share one broadcast, as they read the same two columns by the same key
    vectors = F.broadcast(embeddings.select(F.col("movieId").alias("_id"), "emb"))
    joined = samples.select("userId", "movieId", *RATED_MOVIES).join(
        vectors.alias("candidate"), F.col("movieId") == F.col("candidate._id")
    )
    weights, items, taken = {}, [], F.lit(False)
    for slot in RATED_MOVIES:
        past = F.col(f"{slot}_.emb")
        joined = joined.join(
            vectors.alias(f"{slot}_"), F.col(slot) == F.col(f"{slot}_._id"), "left"
        )
        # a column first, or else every dimension would ask for it again
        weights[f"{slot}_w"] = sigmoid(dot(past, F.col("candidate.emb")))
        weight = F.col(f"{slot}_w")
        item = F.struct(weight.alias("w"), _weighted(past, weight).alias("v"))
        items.append(F.when(past.isNotNull(), item))
        taken = taken | past.isNotNull()
    return (
        joined.where(taken)
        .withColumns(weights)
        .select("userId", "movieId", F.array_compact(F.array(*items)).alias("_items"))
        .select("userId", "movieId", *_pooled("_items"))
    )


def _pool_by_id(samples: DataFrame, embeddings: DataFrame) -> DataFrame:
    candidate = embeddings.select("movieId", F.col("emb").alias("_candidate"))
    past = embeddings.select(F.col("movieId").alias("_past"), F.col("emb").alias("_emb"))
    slots = F.array(*[F.col(c) for c in RATED_MOVIES])
    weight = sigmoid(dot(F.col("_emb"), F.col("_candidate")))
    weighted = (
        samples.select("userId", "movieId", F.posexplode(slots).alias("_slot", "_past"))
        .where(F.col("_past").isNotNull())
        .join(past, "_past")
        .join(candidate, "movieId")
        .select("userId", "movieId", "_slot", "_emb", weight.alias("w"))
    )
    item = F.struct("_slot", "w", _weighted(F.col("_emb"), F.col("w")).alias("v"))
    return (
        weighted.groupBy("userId", "movieId")
        .agg(F.sort_array(F.collect_list(item)).alias("_items"))
        .select("userId", "movieId", *_pooled("_items"))
    )
