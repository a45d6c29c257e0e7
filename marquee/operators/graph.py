"""Item sequences, transition graph and random walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from marquee.operators.samples import USER_ORDER, liked
from marquee.plans.lineage import materialize
from marquee.plans.ordered import running_totals
from marquee.plans.skew import (
    LONG_SEQUENCE,
    add_over_sequences,
    join_lookup,
    number_sequences,
)

# Walks and steps per walk.
WALKS = 20_000
WALK_LENGTH = 10
# Items per sequence row. Word2Vec cuts sentences at the same length, so training sees the
# same sentences whether a long history is one row or several.
SEQUENCE_ROWS = 1000
# Hexadecimal digits of a digest that make a draw: 60 bits, and a digest makes two.
DRAW_DIGITS = 15
# Walks of at most this size are copied to the tasks that hold the slots, others meet them by key.
WALK_BYTES = 32 << 20
# Keys beside the nodes: where all walks begin, and where ended ones stay, in slots of their own.
START, END, END_SLOTS = -(2**63), 1 - 2**63, 64
# Steps after which the walks are written, so that a plan stays short however long they are.
PLAN_STEPS = 10


def liked_events(ratings: DataFrame) -> DataFrame:
    return ratings.where(liked(F.col("rating"))).select("userId", "movieId", "timestamp")


def item_sequences(ratings: DataFrame, long_sequence: int = LONG_SEQUENCE) -> DataFrame:
    """Liked movies of each user in time order, in segments of at most SEQUENCE_ROWS items."""
    placed = number_sequences(liked_events(ratings), "userId", USER_ORDER, "_pos", long_sequence)
    segment = F.floor(F.col("_pos") / SEQUENCE_ROWS).cast("int")
    items = F.sort_array(F.collect_list(F.struct("_pos", "movieId")))
    grouped = placed.groupBy("userId", segment.alias("segment")).agg(items.alias("_items"))
    return grouped.select(
        "userId",
        "segment",
        F.transform("_items", lambda x: x["movieId"].cast("string")).alias("movieIds"),
    ).withColumn("sequence", F.array_join("movieIds", " "))


def item_pairs(ratings: DataFrame, long_sequence: int = LONG_SEQUENCE) -> DataFrame:
    """(userId, src, dst) for each two neighbouring liked movies of a user."""

    def previous(window: WindowSpec) -> dict[str, Column]:
        return {"_src": F.lag("movieId").over(window)}

    events = add_over_sequences(
        liked_events(ratings), "userId", USER_ORDER, 1, [previous], long_sequence
    )
    return events.where(F.col("_src").isNotNull()).select(
        "userId", F.col("_src").alias("src"), F.col("movieId").alias("dst")
    )


def pair_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("cnt"))


def transition_matrix(counts: DataFrame) -> DataFrame:
    """Edges with their probability among the edges leaving `src`.

    Totals are aggregated and joined back, so a node with many edges is never one task.
    """
    out = counts.groupBy("src").agg(F.sum("cnt").alias("_out"))
    return join_lookup(counts, out, "src").select(
        "src", "dst", "cnt", (F.col("cnt") / F.col("_out")).alias("prob")
    )


def item_distribution(counts: DataFrame) -> DataFrame:
    """Probability of each node as the start of a pair."""
    out = counts.groupBy("src").agg(F.sum("cnt").alias("outCount"))
    total = counts.agg(F.sum("cnt")).scalar()
    return out.select(F.col("src").alias("movieId"), "outCount", (F.col("outCount") / total).alias("prob"))


def draw(seed: int, walk: Column, step: int, below: Column, part: int = 0) -> Column:
    """Number from 0 to below-1 that depends only on seed, walk, step and part (0 or 1).

    Digits of a digest, as an integer, modulo `below`: any engine gets the same number.
    """
    key = F.concat_ws(":", F.lit(str(seed)), walk.cast("string"), F.lit(str(step)))
    digits = F.conv(F.substring(F.md5(key), 1 + part * DRAW_DIGITS, DRAW_DIGITS), 16, 10)
    return F.pmod(digits.cast("bigint"), below)


def _totals(weights: DataFrame, key: str, weight: str) -> DataFrame:
    return weights.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).cast("bigint").alias("total")
    )


def alias_table(
    weights: DataFrame, key: str, item: str, weight: str, totals: DataFrame | None = None
) -> DataFrame:
    """(key, slot, item, keep, other, n, total): items of a key to be drawn in constant time.

    A key with n items of whole weights that sum to `total` has the slots 0 to n-1. A uniform slot
    and a uniform number below `total` draw the slot's item if the number is below `keep`, else
    `other`; items come up exactly in proportion to their weights.

    A slot has room for `total`. Items with n times their weight above that have some to spare,
    the others lack some. In order of items, what is lacking and what there is to spare make two
    lines of equal length. A lacking item is filled up by the item to spare on whose stretch its own
    begins. Where its own ends beyond that stretch, the item to spare is in turn filled up by the
    next one. So running sums place all slots, and a key with any number of items is spread over
    tasks. `totals` has (key, n, total) where the caller knows them.
    """
    if totals is None:
        totals = materialize(_totals(weights, key, weight), "totals")
    longest = totals.agg(F.max(F.col("n") * F.col("total").cast("double"))).first()[0] or 0
    # no sum is longer than the longest line
    wide = "bigint" if longest < 2**62 else "decimal(38,0)"
    factor = "bigint" if longest < 2**62 else "decimal(19,0)"
    listed = weights.select(
        key, F.col(item).alias("item"), F.col(weight).cast(factor).alias("_w")
    )
    share = F.col("n").cast(factor) * F.col("_w")
    known = listed.join(totals, key).withColumn(
        "_spare", (share - F.col("total")).cast(wide)
    )
    rich, lack = F.col("_spare") > 0, F.greatest(-F.col("_spare"), F.lit(0).cast(wide))
    lines = running_totals(
        known,
        [key],
        ["item"],
        {
            "slot": F.lit(1).cast("bigint"),
            "_rank": rich.cast("bigint"),
            "_lacked": lack,
            "_spared": F.greatest("_spare", F.lit(0).cast(wide)),
        },
    )
    # a stretch to spare counts where it ends, one that lacks where it begins
    at = F.when(rich, F.col("_spared") + F.col("_spare")).otherwise(F.col("_lacked"))
    met = running_totals(
        lines.withColumns({"_at": at, "_poor": (~rich).cast("int")}),
        [key],
        ["_at", "_poor", "item"],
        {"_passed": rich.cast("bigint"), "_filled": lack},
    )
    keep = F.when(rich, F.col("total") - (F.col("_filled") - F.col("_at"))).otherwise(
        F.col("total") + F.col("_spare")
    )
    slots = met.withColumn(
        "_next", F.when(rich, F.col("_rank") + 1).otherwise(F.col("_passed"))
    ).withColumn("keep", keep.cast("bigint"))
    others = slots.where(rich).select(
        key, F.col("_rank").alias("_next"), F.col("item").alias("other")
    )
    return slots.join(others, [key, "_next"], "left").select(
        key, "slot", "item", "keep", "other", "n", "total"
    )


def walk_slots(counts: DataFrame) -> tuple[DataFrame, int, int]:
    """Slots (src, slot, keep, _item, _other) of all nodes, and the nodes and pairs to start from.

    An item is (node, n, total): where a walk goes and what it draws from there, null without a way
    out. START has a slot per node with outgoing pairs, and END, where ended walks stay, has none
    to go to.
    """
    sizes = materialize(_totals(counts.select(F.col("src").cast("bigint"), "cnt"), "src", "cnt"), "sizes")
    nodes, total = sizes.agg(F.count(F.lit(1)), F.sum("total")).first()
    ids = {"src": "bigint", "dst": "bigint", "cnt": "bigint"}
    edges = counts.select(*[F.col(c).cast(kind).alias(c) for c, kind in ids.items()])
    begin = F.lit(START)
    starts = sizes.select(begin.alias("src"), F.col("src").alias("dst"), F.col("total").alias("cnt"))
    one = sizes.limit(1).select(
        begin.alias("src"), F.lit(nodes).cast("bigint").alias("n"), F.lit(total).cast("bigint").alias("total")
    )
    table = alias_table(edges.unionByName(starts), "src", "dst", "cnt", sizes.unionByName(one))
    for name in ("item", "other"):
        own = sizes.select(
            F.col("src").alias(name), F.col("n").alias(f"_{name}_n"), F.col("total").alias(f"_{name}_total")
        )
        place = F.struct(
            F.col(name).alias("node"), F.col(f"_{name}_n").alias("n"), F.col(f"_{name}_total").alias("total")
        )
        table = table.join(own, name, "left").withColumn(
            f"_{name}", F.when(F.col(name).isNotNull(), place)
        )
    table = table.select("src", "slot", "keep", "_item", "_other")
    kind = table.schema["_item"].dataType
    ended = counts.sparkSession.range(END_SLOTS).select(
        F.lit(END).alias("src"),
        F.col("id").alias("slot"),
        F.lit(1).cast("bigint").alias("keep"),
        F.lit(None).cast(kind).alias("_item"),
        F.lit(None).cast(kind).alias("_other"),
    )
    return materialize(table.unionByName(ended), "steps"), nodes, total


def random_walks(
    pairs: DataFrame,
    walks: int = WALKS,
    length: int = WALK_LENGTH,
    seed: int = 7,
    broadcast_bytes: int = WALK_BYTES,
) -> DataFrame:
    """`walks` paths of at most `length` nodes; a path ends at a node without outgoing pair.

    Starts are drawn in proportion to the pairs that leave a node, steps in proportion to the
    counts of pairs. A step is one equality join of walks and slots on (node, slot), whatever the
    degree of a node.
    """
    spark = pairs.sparkSession
    counts = materialize(pair_counts(pairs), "edges")
    if counts.isEmpty():
        return spark.createDataFrame([], "walk bigint, nodes array<int>")
    slots, nodes, total = walk_slots(counts)
    few = walks * (64 + 8 * length) <= broadcast_bytes
    walk, ended = F.col("walk"), F.col("at.n").isNull()
    state = spark.range(walks).select(
        F.col("id").alias("walk"),
        F.array().cast("array<int>").alias("nodes"),
        F.struct(
            F.lit(START).alias("node"),
            F.lit(nodes).cast("bigint").alias("n"),
            F.lit(total).cast("bigint").alias("total"),
        ).alias("at"),
    )
    for step in range(length):
        asked = state.select(
            "walk",
            "nodes",
            F.when(ended, F.lit(END)).otherwise(F.col("at.node")).alias("src"),
            F.coalesce(draw(seed, walk, step, F.col("at.n")), walk % END_SLOTS).alias("slot"),
            F.coalesce(draw(seed, walk, step, F.col("at.total"), 1), F.lit(0)).alias("_coin"),
        )
        at = F.when(F.col("_coin") < F.col("keep"), F.col("_item")).otherwise(F.col("_other"))
        moved = slots.join(F.broadcast(asked) if few else asked, ["src", "slot"]).select(
            "walk", "nodes", at.alias("at")
        )
        longer = F.concat("nodes", F.array(F.col("at.node").cast("int")))
        state = moved.select(
            "walk", F.when(F.col("at").isNull(), F.col("nodes")).otherwise(longer).alias("nodes"), "at"
        )
        if step and step % PLAN_STEPS == 0:
            state = materialize(state, "walks")
    return state.select("walk", "nodes")
