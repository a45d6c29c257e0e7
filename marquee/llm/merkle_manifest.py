"""Merkle manifest of a dataset: digests of its rows, of each source, and of the whole, with proofs.

Per source the leaves ascend by doc_id (null first; equal ids by digest); FANOUT consecutive nodes
become one, level by level, until one is left, the subroot. The subroots, by source (null first,
bytewise), become the root in the same way.

The tree is built by a butterfly exchange. Leaves are dealt out in aligned blocks of
FANOUT**BLOCK_LEVELS per source, and each block hashes its own subtree. Then, round by round, the
blocks of FANOUT neighbouring subtrees swap their roots: a block sends its subtree's root to the
block in the same lane of each other subtree, so every block of the group hashes the common parent
itself and notes the siblings. After the last round every block holds its upper proof and the root;
nothing is handed down. A subtree with fewer blocks than its neighbours serves all their lanes. The
rounds over sources work alike, with subtrees of unequal numbers of blocks. A round is one
shuffle of one narrow row per block and lane, and the number of rounds is logarithmic, so no task
holds more than one block's leaves and a source with most rows is spread over its blocks.

A null value is written `-` and thus differs from an empty text. Repeated rows are leaves of their
own, with proofs of their own. A null doc_id is never tampered with, as it has no digits. Texts of
any length are hashed whole by Spark; an empty table has no rows and no root. Other columns than the
five hashed ones aren't read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.plans.lineage import materialize
from marquee.plans.ordered import number_rows

FANOUT = 3
BLOCK_LEVELS = 7
PROOF = "array<struct<before: string, after: string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """A value with its length in front, so that neighbours can't run into each other."""
    text = value.cast("string")
    sized = F.concat(F.octet_length(text).cast("string"), F.lit(":"), text)
    return F.coalesce(sized, F.lit("-"))


def leaf_digest(
    doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column
) -> Column:
    return digest(F.concat(*[field(c) for c in (doc_id, source, lang, n_chars, text)]))


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings, level by level, lead to."""
    return F.aggregate(
        proof, leaf, lambda node, level: digest(F.concat(level["before"], node, level["after"]))
    )


def proof_digest(proof: Column) -> Column:
    siblings = F.transform(proof, lambda level: F.concat(level["before"], level["after"]))
    return digest(F.array_join(siblings, ""))


def _rise(nodes: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """All levels above `nodes`: a given number of them, or until one node is left."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        below = out[-1]
        out.append(
            [
                hashlib.sha256("".join(below[i : i + fanout]).encode()).hexdigest()
                for i in range(0, len(below), fanout)
            ]
        )
    return out


def _siblings(nodes: list[str], fanout: int) -> list[tuple[str, str]]:
    """What stands before and after each node in its run."""
    out = []
    for i in range(len(nodes)):
        first = i - i % fanout
        out.append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + fanout])))
    return out


def _block_levels(rows: pa.Table, fanout: int, levels: int) -> tuple[pa.Table, list[list[str]]]:
    rows = rows.take(pa.array(np.argsort(rows.column("pos").to_numpy(), kind="stable")))
    leaves = rows.column("leaf").to_pylist()
    alone = rows.column("leaves")[0].as_py() <= fanout**levels
    return rows, _rise(leaves, fanout, None if alone else levels)


def _block_roots(fanout: int, levels: int):
    def root(rows: pa.Table) -> pa.Table:
        _, tree = _block_levels(rows, fanout, levels)
        return pa.table(
            {
                "tree": rows.column("tree").slice(0, 1),
                "block": rows.column("block").slice(0, 1),
                "leaves": rows.column("leaves").slice(0, 1),
                "root": pa.array([tree[-1][0]], pa.string()),
            }
        )

    return root


def _block_proofs(fanout: int, levels: int, extra: list[str], schema: pa.Schema):
    def proofs(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows, tree = _block_levels(rows, fanout, levels)
        above = upper.column("proof")[0].as_py()
        pairs = [_siblings(nodes, fanout) for nodes in tree[:-1]]
        before: list[str] = []
        after: list[str] = []
        for i in range(rows.num_rows):
            for level in pairs:
                b, a = level[i]
                before.append(b)
                after.append(a)
                i //= fanout
            for level in above:
                before.append(level["before"])
                after.append(level["after"])
        depth = len(pairs) + len(above)
        levels_of = pa.StructArray.from_arrays(
            [pa.array(before, pa.string()), pa.array(after, pa.string())], ["before", "after"]
        )
        starts = pa.array(np.arange(rows.num_rows + 1, dtype=np.int32) * depth)

        def repeated(name: str) -> pa.Array:
            return pa.array([upper.column(name)[0].as_py()] * rows.num_rows, pa.string())

        made = {c: rows.column(c) for c in extra}
        made |= {
            "leaf": rows.column("leaf"),
            "subroot": repeated("subroot"),
            "root": repeated("root"),
            "proof": pa.ListArray.from_arrays(starts, levels_of),
        }
        return pa.table(made).cast(schema)

    return proofs


def _exchange(state: DataFrame, fanout: int) -> DataFrame:
    """One round: blocks in the same lane of a group's subtrees swap roots and hash the parent.

    `state` has one row per block: `group` of subtrees, `digit` of its own subtree among them, its
    index `member` among the subtree's `members`, the group's number of `lanes`, root and proof.
    Per lane there is one root of each subtree. Gives the state with the parent as the subtree;
    blocks that aren't `open` have their whole tree already and come back as they were.
    """
    lane = F.explode(F.sequence("member", F.col("lanes") - 1, "members"))
    sent = state.withColumn("lane", lane)
    own = F.col("lane") == F.col("member")
    message = F.struct(
        "digit",
        "members",
        "root",
        F.when(own, F.struct("tree", "block", "blocks", "leaves", "subroot", "proof", "open")).alias("to"),
    )
    # at most one row per subtree, so a list never has more than `fanout` entries
    met = sent.groupBy("scope", "group", "lane").agg(
        F.array_sort(F.collect_list(message)).alias("run")
    )
    run = F.col("run")
    parent = met.select(
        "scope",
        "group",
        "lane",
        run,
        digest(F.array_join(F.transform(run, lambda m: m["root"]), "")).alias("parent"),
        F.explode(run).alias("own"),
    ).where("own.to is not null")
    earlier = F.filter(run, lambda m: m["digit"] < F.col("own.digit"))
    later = F.filter(run, lambda m: m["digit"] > F.col("own.digit"))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("bigint"), lambda n, m: n + m["members"])

    def roots(part: Column) -> Column:
        return F.array_join(F.transform(part, lambda m: m["root"]), "")

    level = F.struct(roots(earlier).alias("before"), roots(later).alias("after"))
    return parent.select(
        "scope",
        F.col("group").alias("node"),
        (F.col("lane") + total(earlier)).alias("member"),
        total(run).alias("members"),
        F.when(F.col("own.to.open"), F.col("parent")).otherwise(F.col("own.root")).alias("root"),
        "own.to.tree",
        "own.to.block",
        "own.to.blocks",
        "own.to.leaves",
        "own.to.subroot",
        F.when(F.col("own.to.open"), F.concat("own.to.proof", F.array(level)))
        .otherwise(F.col("own.to.proof"))
        .alias("proof"),
    )


def _rounds(nodes: int, fanout: int) -> int:
    rounds = 0
    while nodes > 1:
        nodes, rounds = -(-nodes // fanout), rounds + 1
    return rounds


def _ceil(count: Column, by: int) -> Column:
    return F.floor((count + (by - 1)) / by)


def _within_sources(state: DataFrame, rounds: int, fanout: int) -> DataFrame:
    """Rounds among the blocks of each source; a source with one subtree left passes through."""
    for r in range(rounds):
        covered = fanout**r  # blocks below a node of this round
        left = (F.col("blocks") - F.col("group") * (fanout * covered)).cast("bigint")
        lanes = F.when(F.col("open"), F.least(F.lit(covered).cast("bigint"), left))
        state = _exchange(
            state.withColumn("open", F.col("blocks") > covered)
            .withColumn("group", F.floor(F.col("node") / fanout))
            .withColumn("digit", F.pmod("node", F.lit(fanout)))
            .withColumn("lanes", lanes.otherwise(F.col("members"))),
            fanout,
        )
    return state


def _across_sources(state: DataFrame, sources: DataFrame, count: int, fanout: int) -> DataFrame:
    """Rounds among sources; the lanes of a group are the blocks of its largest subtree."""
    state = state.withColumn("scope", F.lit(-1).cast("bigint")).withColumn("node", F.col("tree"))
    sizes = sources.select(F.col("tree").alias("node"), F.col("blocks").alias("n"))
    for _ in range(_rounds(count, fanout)):
        group = F.floor(F.col("node") / fanout).alias("group")
        lanes = sizes.groupBy(group).agg(F.max("n").alias("lanes"), F.sum("n").alias("n"))
        dealt = (
            state.withColumn("group", F.floor(F.col("node") / fanout))
            .withColumn("digit", F.pmod("node", F.lit(fanout)))
            .withColumn("open", F.lit(True))
            .join(lanes.drop("n"), "group")
        )
        state = _exchange(dealt, fanout)
        sizes = lanes.select(F.col("group").alias("node"), "n")
    return state


def manifest(
    leaves: DataFrame, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS
) -> DataFrame:
    """Add subroot, root and proof to rows with doc_id, source and leaf; others are carried.

    `proof` has a struct per level from the leaf up: what stands before and after the node in its
    run, as concatenated hex digests, within the source first and then among the sources.
    """
    spark = leaves.sparkSession
    carried = [c for c in leaves.columns if c != "leaf"]
    written = materialize(leaves, "leaves")
    counted = written.groupBy("source").agg(F.count(F.lit(1)).alias("leaves"))
    size = fanout**block_levels
    sources = materialize(
        number_rows(counted, [], ["source"], "tree").withColumn(
            "blocks", _ceil(F.col("leaves"), size)
        ),
        "sources",
    )
    known = sources.select(F.col("source").alias("_source"), "tree", "leaves")
    placed = written.join(known, written["source"].eqNullSafe(known["_source"])).drop("_source")
    numbered = materialize(
        number_rows(placed, ["tree"], ["doc_id", "leaf"], "pos").withColumn(
            "block", F.floor(F.col("pos") / size)
        ),
        "numbered",
    )
    count, most = sources.agg(F.count(F.lit(1)), F.coalesce(F.max("blocks"), F.lit(0))).first()
    roots = numbered.groupBy("tree", "block").applyInArrow(
        _block_roots(fanout, block_levels),
        "tree bigint, block bigint, leaves bigint, root string",
    )
    state = roots.select(
        F.col("tree").alias("scope"),
        F.col("block").alias("node"),
        F.lit(0).cast("bigint").alias("member"),
        F.lit(1).cast("bigint").alias("members"),
        "root",
        "tree",
        "block",
        _ceil(F.col("leaves"), size).alias("blocks"),
        "leaves",
        F.lit(None).cast("string").alias("subroot"),
        F.array().cast(PROOF).alias("proof"),
    )
    state = _within_sources(state, _rounds(most, fanout), fanout)
    state = _across_sources(state.withColumn("subroot", F.col("root")), sources, count, fanout)
    upper = state.select("tree", "block", "subroot", "root", "proof")
    kinds = {f.name: f.dataType.simpleString() for f in leaves.schema}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in carried)
    schema += f", leaf string, subroot string, root string, proof {PROOF}"
    arrow = _arrow_schema(spark, schema)
    return (
        numbered.groupBy("tree", "block")
        .cogroup(upper.groupBy("tree", "block"))
        .applyInArrow(_block_proofs(fanout, block_levels, carried, arrow), schema)
    )


def _arrow_schema(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def tampered(doc_id: Column) -> Column:
    """Rows that the audit tampers with: 2 divides the crc32 of the id's digits."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def audit(documents: DataFrame) -> DataFrame:
    """The manifest of `documents`, and each row's own check against the root after tampering.

    Tampering deletes the line feeds of the chosen rows' texts; a row is verified if its leaf as
    it is now and its original siblings lead to the original root.
    """
    text = F.col("text")
    others = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    changed = tampered(F.col("doc_id")) & text.contains("\n")
    leaves = documents.select(
        "doc_id",
        "source",
        leaf_digest(*others, text).alias("leaf"),
        F.when(
            changed, leaf_digest(*others, F.replace(text, F.lit("\n"), F.lit("")))
        ).alias("now"),
    )
    return (
        manifest(leaves)
        .withColumn("folded_root", fold(F.coalesce("now", "leaf"), F.col("proof")))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
        .drop("now")
    )
