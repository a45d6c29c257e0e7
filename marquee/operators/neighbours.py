"""Nearest items of all items at once, by bucketed random projections.

Every item is hashed in several tables by the cells its projections fall in, as wide as WIDTH
standard deviations of the projection over all items. An item looks into its own cell of a table and
into the cells next to it that are nearest to its projections (multi-probing). Items that share a
cell are compared in blocks inside tasks; what leaves a task is a short list per item, never a
pair per comparison. A crowded cell is cut into chunks that meet in blocks of at most CHUNK by
CHUNK, so it is spread over many tasks, and equal vectors count once, so a crowd of copies is one
member. Whatever shares no probed cell is missed: the result is approximate, and distances are exact.

Null, ragged (unlike the most frequent length) and non-finite vectors take no part.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.operators.ranking import top_per
from marquee.plans.lineage import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = 6
PROBES = 6
WIDTH = 2.0
# Items that share a cell on average, if projections were spread evenly.
CELL = 256
# Bits that one projection of WIDTH standard deviations tells of a normal distribution.
BITS = 1.2
CHUNK = 2_048
DIGITS = 6


def projections_for(items: int) -> int:
    """Projections per table, so that a cell holds about CELL items."""
    return max(1, math.ceil(math.log2(max(1.0, items / CELL)) / BITS))


def _usable(embeddings: DataFrame) -> DataFrame:
    """(movieId, emb of double) with finite vectors of the most frequent length."""
    emb = F.transform("emb", lambda x: x.cast("double"))
    broken = F.exists(emb, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("movieId").cast("int").alias("movieId"), emb.alias("emb"))
    rows = rows.where(F.col("emb").isNotNull() & ~F.coalesce(broken, F.lit(True)))
    return rows.where((F.size("emb") > 0) & F.col("movieId").isNotNull())


def _cells(places: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Own cell of every row, and the cells to look into: own and the nearest neighbours.

    `places` is (rows, projections). A neighbour differs in one projection; the nearest are those
    whose border is nearest.
    """
    own = np.floor(places).astype(np.int64)
    inside = places - own
    n, k = places.shape
    to_border = np.concatenate([inside, 1 - inside], axis=1)  # one cell down, one cell up
    chosen = np.argsort(to_border, axis=1, kind="stable")[:, : min(probes, 2 * k)]
    looked = np.repeat(own[:, None, :], chosen.shape[1] + 1, axis=1)
    rows = np.arange(n)[:, None]
    at = np.arange(1, chosen.shape[1] + 1)[None, :]
    looked[rows, at, chosen % k] += np.where(chosen < k, -1, 1)
    return own, looked


def _named(cells: np.ndarray) -> np.ndarray:
    """One number per cell of k projections."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for j in range(cells.shape[-1]):
        out = (out * np.int64(1_000_003)) ^ (cells[..., j] + np.int64(j * 7_919))
    return out


def _hashed(planes: np.ndarray, widths: np.ndarray, shifts: np.ndarray, tables: int, probes: int):
    """Rows (movieId, table, cell, asks) of every vector: asks is false for its own entry."""
    k = planes.shape[1] // tables

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            vectors = np.stack(batch["emb"].to_numpy())
            ids = batch["movieId"].to_numpy()
            places = vectors @ planes / widths + shifts
            for t in range(tables):
                own, looked = _cells(places[:, t * k : (t + 1) * k], probes)
                yield pd.DataFrame(
                    {"movieId": ids, "table": np.int32(t), "cell": _named(own), "asks": False}
                )
                asked = _named(looked)
                yield pd.DataFrame(
                    {
                        "movieId": np.repeat(ids, asked.shape[1]),
                        "table": np.int32(t),
                        "cell": asked.ravel(),
                        "asks": True,
                    }
                )

    return run


def _near(asking: np.ndarray, members: np.ndarray, other: np.ndarray, k: int):
    """(asking, member) positions of all pairs that can be among the k nearest of an asking vector,
    judged by one matrix product; `other` says which pairs count.

    |u - v|^2 from inner products is off by little against the lengths, and rounded distances tie
    within a unit of the last digit; both are allowed for, so that no pair of a list is lost.
    """
    far = np.einsum("ij,ij->i", asking, asking)[:, None]
    long = np.einsum("ij,ij->i", members, members)
    if not np.isfinite(far.max() + long.max()):
        return np.nonzero(other)  # too long to be screened
    apart = far + long - 2 * (asking @ members.T)
    apart[~other] = np.inf
    at = min(k, apart.shape[1]) - 1
    bound = np.partition(apart, at, axis=1)[:, at : at + 1]
    off = 1e-11 * (far + long.max())
    reach = np.sqrt(np.maximum(bound, 0) + off) + 2 * 10.0**-DIGITS
    return np.nonzero(other & (apart <= reach * reach + off))


def _compared(k: int):
    """The k nearest members of a block for each item that asks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"movieId": [], "neighbour": [], "distance": []})
        ids = rows["movieId"].to_numpy()
        vectors = np.stack(rows["emb"].to_numpy())
        members = np.flatnonzero(~asks)
        members = members[np.argsort(ids[members], kind="stable")]
        asking = np.flatnonzero(asks)
        out = []
        pool = vectors[members]
        step = max(1, 2_000_000 // len(members))
        pairs = max(1, 4_000_000 // vectors.shape[1])
        for begin in range(0, len(asking), step):
            part = asking[begin : begin + step]
            other = ids[part][:, None] != ids[members][None, :]
            row, column = _near(vectors[part], pool, other, k)
            distance = np.empty(len(row))
            for first in range(0, len(row), pairs):
                some = slice(first, first + pairs)
                apart = vectors[part[row[some]]] - pool[column[some]]
                distance[some] = np.round(np.sqrt((apart * apart).sum(axis=1)), DIGITS)
            # pairs come row by row, members by id; order them by distance within a row
            order = np.lexsort((distance, row))
            row, column, distance = row[order], column[order], distance[order]
            place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
            keep = (place < k) & np.isfinite(distance)
            out.append(
                pd.DataFrame(
                    {
                        "movieId": ids[part][row[keep]],
                        "neighbour": ids[members][column[keep]],
                        "distance": distance[keep],
                    }
                )
            )
        return pd.concat(out)

    return run


def _widths(vectors: DataFrame, planes: np.ndarray) -> np.ndarray:
    """WIDTH standard deviations along each projection, over all vectors."""

    def sums(batches):
        for batch in batches:
            if len(batch):
                places = np.stack(batch["emb"].to_numpy()) @ planes
                mean = places.mean(axis=0)
                yield pd.DataFrame(
                    {
                        "at": np.arange(planes.shape[1], dtype=np.int32),
                        "n": float(len(places)),
                        "total": len(places) * mean,
                        "inner": ((places - mean) ** 2).sum(axis=0) + len(places) * mean * mean,
                    }
                )

    found = (
        vectors.select("emb")
        .mapInPandas(sums, "at int, n double, total double, inner double")
        .groupBy("at")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("inner").alias("inner"))
        .orderBy("at")
        .collect()  # one row per projection
    )
    spread = [math.sqrt(max(0.0, r["inner"] / r["n"] - (r["total"] / r["n"]) ** 2)) for r in found]
    return np.array([WIDTH * s if s > 0 else 1.0 for s in spread])


def nearest_for_all(
    embeddings: DataFrame,
    k: int,
    tables: int = TABLES,
    probes: int = PROBES,
    chunk: int = CHUNK,
    seed: int = 7,
) -> DataFrame:
    """(movieId, position, neighbour, distance): approximately the k nearest others of every item.

    Distances are Euclidean, at six digits, ties to the smaller id.
    """
    usable = _usable(embeddings)
    lengths = usable.groupBy(F.size("emb").alias("n")).agg(F.count(F.lit(1)).alias("items"))
    common = lengths.orderBy(F.desc("items"), F.desc("n")).first()
    spark = embeddings.sparkSession
    result = "movieId int, position int, neighbour int, distance double"
    if common is None:
        return spark.createDataFrame([], result)
    # equal vectors are one class, named by its smallest id
    same = usable.where(F.size("emb") == common["n"])
    reps = materialize(same.groupBy("emb").agg(F.min("movieId").alias("movieId")), "reps")
    classed = materialize(
        same.join(reps.withColumnRenamed("movieId", "rep"), "emb").select("movieId", "rep"),
        "classed",
    )
    count = reps.count()
    per_table = projections_for(count)
    random = np.random.default_rng(seed)
    planes = random.standard_normal((common["n"], per_table * tables))
    planes /= np.sqrt((planes * planes).sum(axis=0))
    widths = _widths(reps, planes)
    shifts = random.random(len(widths))
    hashed = materialize(
        reps.mapInPandas(
            _hashed(planes, widths, shifts, tables, probes),
            "movieId int, table int, cell bigint, asks boolean",
        ),
        "hashed",
    )
    sizes = hashed.groupBy("table", "cell").agg(
        F.count_if(~F.col("asks")).alias("members"), F.count_if("asks").alias("askers")
    )
    alive = sizes.where("members > 0 and askers > 0").select(
        "table",
        "cell",
        F.ceil(F.col("members") / chunk).cast("int").alias("m"),
        F.ceil(F.col("askers") / chunk).cast("int").alias("a"),
    )
    # a member goes to every chunk of askers and the other way round
    dealt = hashed.join(alive, ["table", "cell"])
    pick = F.xxhash64("movieId")
    blocks = F.when(
        F.col("asks"),
        F.transform(
            F.sequence(F.lit(0), F.col("m") - 1),
            lambda i: F.struct(i.alias("mc"), F.pmod(pick, F.col("a")).cast("int").alias("ac")),
        ),
    ).otherwise(
        F.transform(
            F.sequence(F.lit(0), F.col("a") - 1),
            lambda i: F.struct(F.pmod(pick, F.col("m")).cast("int").alias("mc"), i.alias("ac")),
        )
    )
    met = (
        dealt.select("movieId", "table", "cell", "asks", F.inline(blocks))
        .join(reps, "movieId")
        .groupBy("table", "cell", "mc", "ac")
        .applyInPandas(_compared(k), "movieId int, neighbour int, distance double")
    )
    nearest = top_per(met.distinct(), "movieId", [F.col("distance"), F.col("neighbour")], k)
    # back from classes to items: a class's own members are at distance 0
    members = top_per(classed, "rep", [F.col("movieId")], k + 1).select(
        F.col("rep").alias("neighbour"), F.col("movieId").alias("other")
    )
    lists = nearest.select(F.col("movieId").alias("rep"), "neighbour", "distance").unionByName(
        reps.select(
            F.col("movieId").alias("rep"),
            F.col("movieId").alias("neighbour"),
            F.lit(0.0).alias("distance"),
        )
    )
    of_class = lists.join(members, "neighbour").select("rep", "other", "distance")
    short = top_per(of_class, "rep", [F.col("distance"), F.col("other")], k + 1)
    short = short.select("rep", "other", "distance")
    every = classed.join(short, "rep").where("movieId != other")
    return top_per(every, "movieId", [F.col("distance"), F.col("other")], k).select(
        "movieId",
        F.col("position").cast("int").alias("position"),
        F.col("other").alias("neighbour"),
        "distance",
    )
