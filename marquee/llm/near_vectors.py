"""Near-duplicate embeddings: sign hashing in several tables, exact cosines, components.

Equal vectors are one class from the start and are compared once. A class meets others in one
bucket per table; a bucket is checked by matrix products, and what leaves a task is a number of
links and one edge per member, never a pair per link.

A pair is found with probability RECALL or more (at the threshold itself; nearer pairs more
surely), and none below the threshold is linked. Vectors that are null, zero or hold null or
non-finite components link with nothing and are their own component; vectors of different lengths
never link. Repeated ids are vectors of their own; a null id sorts first. An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.components import components
from marquee.llm.ids import ROW, name_rows, with_rows
from marquee.llm.vectors import matrix, packed, unit
from marquee.plans.lineage import materialize

THRESHOLD = 0.9
RECALL = 0.998
# Classes that share a bucket on average, if vectors were spread evenly.
BUCKET = 64
# Larger buckets are cut into chunks of about this many members, checked chunk against chunk.
CHUNK = 2_048
# Rows that one task checks at a time.
TASK_ROWS = 20_000


def plan_tables(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): bits by the number of classes, tables so that a pair at the threshold
    shares a bucket with probability `recall`."""
    bits = max(4, math.ceil(math.log2(max(rows, 1) / BUCKET))) if rows > BUCKET else 4
    same = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same**bits))


def _codes(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """Sign pattern of every row in every table."""
    planes = np.random.default_rng([seed, vectors.shape[1]]).standard_normal(
        (vectors.shape[1], bits * tables)
    )
    signs = (vectors @ planes > 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _linked(
    units: np.ndarray, codes: np.ndarray, table: int, left: np.ndarray, right: np.ndarray, least: float
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows with cosine of at least `least`, and whether this is their first table."""
    same = left is right
    i, j = np.nonzero(units[left] @ units[right].T >= least)
    if same:
        i, j = i[i < j], j[i < j]
    i, j = left[i], right[j]
    first = ~(codes[i, :table] == codes[j, :table]).any(axis=1)
    return i, j, first


def _check(rows: pa.Table, least: float) -> pa.Table:
    """Links and edges of the buckets in one task."""
    keys = [rows.column(c).to_numpy() for c in ("table", "bucket", "low", "high")]
    chunk, ids, weight = (rows.column(c).to_numpy() for c in ("chunk", "rep", "n"))
    lengths = rows.column("size").to_numpy()
    codes_all = matrix(rows.column("codes")).astype(np.int64)
    order = np.lexsort([ids, *keys[::-1], lengths])
    stacked = np.stack([k[order] for k in [lengths, *keys]])
    cuts = np.flatnonzero((np.diff(stacked, axis=1) != 0).any(axis=0)) + 1
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    column = rows.column("unit").combine_chunks()
    for members in np.split(order, cuts):
        if len(members) < 2:
            continue
        units = matrix(column.take(pa.array(members)))
        codes, table = codes_all[members], int(keys[0][members[0]])
        low, high = keys[2][members[0]], keys[3][members[0]]
        everyone = np.arange(len(members))
        if low == high:
            i, j, first = _linked(units, codes, table, everyone, everyone, least)
        else:
            left, right = (everyone[chunk[members] == c] for c in (low, high))
            i, j, first = _linked(units, codes, table, left, right, least)
        if not len(i):
            continue
        own, n = ids[members], weight[members]
        links = np.bincount(i[first], n[j[first]], len(own)) + np.bincount(
            j[first], n[i[first]], len(own)
        )
        root = np.arange(len(own))
        while True:  # members are in order of id, so the smallest position is the smallest id
            low_end = np.minimum(root[i], root[j])
            new = root.copy()
            np.minimum.at(new, i, low_end)
            np.minimum.at(new, j, low_end)
            if (new == root).all():
                break
            root = new
        touched = np.unique(np.concatenate([i, j]))
        out.append((own[touched], links[touched].astype(np.int64), own[root[touched]]))
    found = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table({name: pa.array(c, pa.int64()) for name, c in zip(("rep", "links", "root"), found)})


def link_vectors(
    embeddings: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 0
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per vector; see the module."""
    numbered, sound = with_rows(embeddings.select("vec_id", "embedding"), "vec_id", "embedding")
    vectors = packed(numbered, "embedding")
    classes = materialize(
        vectors.groupBy("embedding").agg(
            F.min(ROW).alias("rep"), F.count(F.lit(1)).cast("bigint").alias("n")
        ),
        "classes",
    )
    bits, tables = plan_tables(classes.count(), threshold, recall)

    def hashed(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column("embedding")).to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                units = unit(matrix(part.column("embedding")))
                codes = _codes(units, bits, tables, seed)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("rep"),
                        part.column("n"),
                        pa.array(np.full(len(units), size, np.int32)),
                        pa.array(list(units), pa.list_(pa.float64())),
                        pa.array(list(codes), pa.list_(pa.int64())),
                    ],
                    names=["rep", "n", "size", "unit", "codes"],
                )

    coded = materialize(
        classes.mapInArrow(
            hashed, "rep bigint, n bigint, size int, unit array<double>, codes array<bigint>"
        ),
        "codes",
    )
    spread = coded.select("rep", "size", F.posexplode("codes").alias("table", "bucket"))
    crowded = materialize(
        spread.groupBy("size", "table", "bucket")
        .agg(F.count(F.lit(1)).alias("members"))
        .where(F.col("members") > 1)
        .withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int")),
        "buckets",
    )
    # a member of a chunked bucket meets each chunk once, its own included
    chunk = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    met = (
        spread.join(crowded, ["size", "table", "bucket"])
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "rep",
            "table",
            "bucket",
            "chunk",
            F.least("chunk", "other").alias("low"),
            F.greatest("chunk", "other").alias("high"),
        )
    )
    # a member of a cut bucket comes once for each of its chunks
    rows = crowded.agg(F.sum(F.col("members") * F.col("chunks"))).first()[0] or 0
    parts = max(1, math.ceil(rows / TASK_ROWS))
    place = F.pmod(F.xxhash64("table", "bucket", "low", "high"), F.lit(parts))
    found = materialize(
        met.join(coded, "rep")
        .withColumn("part", place)
        .groupBy("part")
        .applyInArrow(lambda t: _check(t, threshold), "rep bigint, links bigint, root bigint"),
        "links",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.select("rep", "root"))
    result = (
        classes.join(links, "rep", "left")
        .join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            F.col("embedding").alias("_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("_component"),
        )
    )
    mine = vectors.join(result, vectors["embedding"] == result["_vector"]).select(
        ROW, "n_links", "_component"
    )
    every = numbered.select(ROW, "vec_id").join(mine, ROW, "left")
    every = every.withColumn("_component", F.coalesce("_component", ROW)).withColumn(
        "kept", F.col("_component") == F.col(ROW)
    )
    named = name_rows(every, numbered, sound, "_component", "vec_id", "component_id")
    return named.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.col("component_id").cast("bigint").alias("component_id"),
        "kept",
    )
