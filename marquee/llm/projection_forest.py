"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

Each tree halves a bounded sample by random hyperplanes at the median until leaves hold about LEAF
sample rows; every vector is then indexed in every tree. Inner products are searched as nearness
after one more coordinate is added, which brings all vectors to the length of the longest. A query
is stretched to that length, which leaves the order of its inner products as it is, and
searches all trees through one priority queue ordered by the smallest margin on the path, opens the
best VISIT of all leaves, and the members of those leaves are ranked by their inner products with
the original vectors in double precision.

Members of a leaf meet the queries that open it in one task, in blocks; a leaf with very many
members is cut into chunks. Only the best k of each task leave it. The forest's size depends on the
sample bound alone, so it is broadcast; recall against all rows is measured in the tests.

Vectors that are null, zero or hold null or non-finite components take no part. Vectors are compared
with those of their own length. Rows with equal ids are vectors of their own, null ids come first;
ties go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.llm.ids import ROW, name_rows, with_rows
from marquee.llm.vectors import matrix, packed, unit
from marquee.plans.lineage import materialize

K = 20
TREES = 16
# Bound of the sample that the trees are fitted on, and sample rows in a leaf.
SAMPLE = 32_768
LEAF = 128
# Share of all leaves of the forest that a query opens.
VISIT = 0.09
# Members of a leaf that are ranked at a time, and indexed rows that a task holds.
CHUNK = 2_048
TASK_ROWS = 20_000
_STRIDE = 7_919
_FOUND = pa.schema(
    [("query", pa.int64()), ("rows", pa.list_(pa.int64())), ("scores", pa.list_(pa.float64()))]
)


class Forest:
    """Complete binary trees over vectors of one length; node i of a tree has 2i+1 and 2i+2."""

    def __init__(self, sample: np.ndarray, longest: float, seed: int) -> None:
        self.longest = longest
        self.depth = max(0, int(math.log2(max(len(sample), 1) / LEAF))) if len(sample) else 0
        self.leaves = 1 << self.depth
        draw = np.random.default_rng(seed)
        points = self.lifted(sample)
        inner = self.leaves - 1
        self.planes = draw.standard_normal((TREES, inner, points.shape[1]))
        self.cuts = np.zeros((TREES, inner))
        for tree in range(TREES):
            node = np.zeros(len(points), np.int64)
            for level in range(self.depth):
                for i in range((1 << level) - 1, (2 << level) - 1):
                    here = node == i
                    if here.any():
                        along = points[here] @ self.planes[tree, i]
                        self.cuts[tree, i] = np.median(along)
                        node[here] = 2 * i + 1 + (along > self.cuts[tree, i])

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with the coordinate that makes them all `longest` long."""
        rest = self.longest**2 - (vectors * vectors).sum(axis=1)
        return np.column_stack([vectors, np.sqrt(np.maximum(rest, 0.0))])

    def stretched(self, queries: np.ndarray) -> np.ndarray:
        """Queries as long as all lifted vectors; their own added coordinate is 0, as they only seek
        large products. In their own length the cuts would outweigh them."""
        return np.column_stack([unit(queries) * self.longest, np.zeros(len(queries))])

    def margins(self, points: np.ndarray) -> np.ndarray:
        """Signed distance of every point from every hyperplane: point, tree, node."""
        flat = self.planes.reshape(-1, points.shape[1])
        return (points @ flat.T).reshape(len(points), TREES, -1) - self.cuts

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """Leaf of every vector in every tree, numbered through the forest."""
        margins = self.margins(self.lifted(vectors))
        node = np.zeros((len(vectors), TREES), np.int64)
        row, tree = np.ogrid[: len(vectors), :TREES]
        for _ in range(self.depth):
            node = 2 * node + 1 + (margins[row, tree, node] > 0)
        return node - (self.leaves - 1) + np.arange(TREES) * self.leaves

    def search(self, margins: np.ndarray, leaves: int) -> list[int]:
        """The first `leaves` leaves that one queue over all trees gives up.

        The queue holds (smallest margin on the path, negated; tree; node); the far side of a
        hyperplane counts with its negative margin.
        """
        inner = self.leaves - 1
        sides = margins.tolist()
        queue = [(-math.inf, tree, 0) for tree in range(TREES)]
        found: list[int] = []
        while queue and len(found) < leaves:
            worst, tree, node = heapq.heappop(queue)
            if node >= inner:
                found.append(tree * self.leaves + node - inner)
                continue
            side = sides[tree][node]
            heapq.heappush(queue, (max(worst, side), tree, 2 * node + 1))
            heapq.heappush(queue, (max(worst, -side), tree, 2 * node + 2))
        return found


def _ranked(
    owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per owner the k best distinct ids, best first, with their ranks."""
    order = np.lexsort([ids, -scores, owner])
    owner, ids, scores = owner[order], ids[order], scores[order]
    # a candidate met in several trees has the same score each time
    new = np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1]))[: len(ids)]
    owner, ids, scores = owner[new], ids[new], scores[new]
    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])[: len(owner)])
    rank = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner)))) + 1
    top = rank <= k
    return owner[top], ids[top], scores[top], rank[top]


def _search_part(members: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The best k of one task's members for each query that opens one of its leaves; a query's
    list is one row."""
    if not members.num_rows or not queries.num_rows:
        return _FOUND.empty_table()
    unit = members.column("unit").to_numpy()
    ids = members.column(ROW).to_numpy()
    order = np.lexsort([ids, unit])
    unit, ids = unit[order], ids[order]
    vectors = members.column("embedding").combine_chunks().take(pa.array(order))
    asked = matrix(queries.column("embedding"))
    asking = queries.column(ROW).to_numpy()
    lists = queries.column("units").combine_chunks()
    opened = lists.flatten().to_numpy()
    by = np.repeat(np.arange(len(asking)), lists.value_lengths().to_numpy())
    order = np.argsort(opened, kind="stable")
    opened, by = opened[order], by[order]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = np.append(np.flatnonzero(np.append(True, unit[1:] != unit[:-1])), len(unit))
    for a, b in zip(cuts[:-1], cuts[1:]):
        low, high = np.searchsorted(opened, [unit[a], unit[a] + 1])
        if low == high:
            continue
        block, own = matrix(vectors.slice(a, b - a)), ids[a:b]
        for begin in range(low, high, CHUNK):
            who = by[begin : min(high, begin + CHUNK)]
            scores = asked[who] @ block.T
            scores[own == asking[who][:, None]] = -np.inf
            wanted = min(k, len(own))
            least = np.partition(scores, len(own) - wanted, axis=1)[:, len(own) - wanted]
            # products of equal vectors may differ in the last bits here, so near ties stay in
            slack = 1e-9 * (1 + np.abs(least))
            near = (scores >= (least - slack)[:, None]) & np.isfinite(scores)
            i, j = np.nonzero(near)
            exact = (asked[who[i]] * block[j]).sum(axis=1)
            top = _ranked(who[i], own[j], exact, k)
            found.append(top[:3])
    if not sum(len(f[0]) for f in found):
        return _FOUND.empty_table()
    who, row, score, _ = _ranked(*(np.concatenate(c) for c in zip(*found)), k)
    heads = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
    bounds = pa.array(np.append(heads, len(who)), pa.int32())
    lists = [pa.ListArray.from_arrays(bounds, pa.array(c)) for c in (row, score)]
    return pa.Table.from_arrays([pa.array(asking[who[heads]]), *lists], schema=_FOUND)


def _nearest(vectors: DataFrame, length: int, k: int, seed: int, visit: float) -> DataFrame:
    """(query, rows, scores): best candidates of each task among vectors of one length; `vectors`
    has _query."""
    spark = vectors.sparkSession
    squares = F.aggregate(
        F.transform("embedding", lambda x: x.cast("double") * x.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    rows, longest = vectors.agg(F.count(F.lit(1)), F.sqrt(F.max(squares))).first()
    # a bounded sample, the same on every run
    sample = vectors.orderBy(F.xxhash64(ROW), ROW).limit(SAMPLE).select("embedding").toArrow()
    forest = Forest(matrix(sample.column(0)), float(longest), seed)
    parts = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * TREES / TASK_ROWS)
    )
    shared = spark.sparkContext.broadcast(forest)
    wide = vectors.select(ROW, "embedding", "_query")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1_024):
                part = batch.slice(begin, 1_024)
                leaves = shared.value.place(matrix(part.column("embedding")))
                lists = pa.ListArray.from_arrays(
                    pa.array(np.arange(0, leaves.size + 1, TREES), pa.int32()),
                    pa.array(leaves.ravel(), pa.int64()),
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(ROW), part.column("embedding"), part.column("_query"), lists],
                    names=[ROW, "embedding", "_query", "leaves"],
                )

    kind = vectors.schema["embedding"].dataType.simpleString()
    indexed = materialize(
        wide.mapInArrow(
            index, f"{ROW} bigint, embedding {kind}, _query boolean, leaves array<bigint>"
        ),
        "index",
    )
    placed = indexed.select(ROW, "embedding", F.explode("leaves").alias("leaf"))
    # one count per leaf of the forest
    counts = placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()
    chunks = np.ones(TREES * forest.leaves, np.int64)
    for r in counts:
        chunks[r["leaf"]] = -(-r["n"] // CHUNK)
    sizes = spark.createDataFrame(
        [(i, int(c)) for i, c in enumerate(chunks)], "leaf bigint, chunks bigint"
    )
    chunk = F.pmod(F.xxhash64(ROW), F.col("chunks"))
    members = (
        placed.join(F.broadcast(sizes), "leaf")
        .withColumn("_chunk", chunk)
        .select(
            F.pmod(F.col("leaf") + F.col("_chunk") * _STRIDE, F.lit(parts)).alias("part"),
            (F.col("leaf") * F.lit(1 << 32) + F.col("_chunk")).alias("unit"),
            ROW,
            "embedding",
        )
    )
    dealt = spark.sparkContext.broadcast(chunks)
    budget = max(1, math.ceil(TREES * forest.leaves * visit))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, chunk_counts = shared.value, dealt.value
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                block = batch.slice(begin, 256)
                vectors = matrix(block.column("embedding"))
                margins = tree.margins(tree.stretched(vectors))
                where, part, units = [], [], []
                for i in range(len(vectors)):
                    leaves = np.array(tree.search(margins[i], budget))
                    n = chunk_counts[leaves]
                    leaf = np.repeat(leaves, n)
                    number = np.arange(len(leaf)) - np.repeat(np.cumsum(n) - n, n)
                    home = (leaf + number * _STRIDE) % parts
                    order = np.argsort(home, kind="stable")
                    home, unit = home[order], (leaf * (1 << 32) + number)[order]
                    heads = np.flatnonzero(np.append(True, home[1:] != home[:-1]))
                    where += [i] * len(heads)
                    part += home[heads].tolist()
                    units += np.split(unit, heads[1:])
                pick = pa.array(where, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part, pa.int64()),
                        pa.array(units, pa.list_(pa.int64())),
                        block.column(ROW).take(pick),
                        block.column("embedding").take(pick),
                    ],
                    names=["part", "units", ROW, "embedding"],
                )

    asked = (
        indexed.where("_query")
        .select(ROW, "embedding")
        .mapInArrow(ask, f"part bigint, units array<bigint>, {ROW} bigint, embedding {kind}")
    )
    return (
        members.groupBy("part")
        .cogroup(asked.groupBy("part"))
        .applyInArrow(
            lambda m, q: _search_part(m, q, k),
            "query bigint, rows array<bigint>, scores array<double>",
        )
    )


def nearest(
    embeddings: DataFrame, queries: Column, k: int = K, seed: int = 0, visit: float = VISIT
) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows that meet `queries`, the k nearest found."""
    numbered, sound = with_rows(embeddings.select("vec_id", "embedding"), "vec_id", "embedding")
    vectors = packed(numbered, "embedding").withColumn(
        "_query", F.coalesce(queries, F.lit(False))
    )
    sizes = vectors.select(F.size("embedding").alias("n")).groupBy("n").count().collect()
    found = None
    for length in sorted(r["n"] for r in sizes):
        own = vectors.where(F.size("embedding") == length)
        part = _nearest(own, length, k, seed, visit)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = embeddings.sparkSession.createDataFrame(
            [], "query bigint, rows array<bigint>, scores array<double>"
        )
    best = found.groupBy("query").applyInArrow(
        lambda t: _merge(t, k), "query bigint, rank int, row bigint, score double"
    )
    named = name_rows(best, numbered, sound, "query", "vec_id", "query_id")
    named = name_rows(named, numbered, sound, "row", "vec_id", "vec_id")
    return named.select(
        F.col("query_id").cast("bigint").alias("query_id"),
        "rank",
        F.col("vec_id").cast("bigint").alias("vec_id"),
        "score",
    )


def _merge(found: pa.Table, k: int) -> pa.Table:
    """One query's best of all tasks, at most k from each."""
    lists = [found.column(c).combine_chunks() for c in ("rows", "scores")]
    row, score = (c.flatten().to_numpy() for c in lists)
    query = np.repeat(found.column("query").to_numpy(), lists[0].value_lengths().to_numpy())
    who, row, score, rank = _ranked(query, row, score, k)
    return pa.table({"query": who, "rank": pa.array(rank, pa.int32()), "row": row, "score": score})
