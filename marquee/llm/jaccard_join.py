"""N-gram Jaccard join by parity sketches.

Every distinct shingle of a document toggles one bit of one segment of a sketch, so two sketches
differ in at most as many bits, and in at most as many segments, as the sets differ in shingles. A
segment has 2**32 bits, nearly all clear, and is kept as a hash of those that are set. Documents similar enough to link differ in at most `allowance` shingles; a sketch of more
segments than that keeps at least one segment equal (pigeonhole). Equal segments are an equality
join on (segments in the sketch, segment number, bits), done per size band: the number of segments
depends on the size of the set, sizes fall into bands of growing width, and a document near a bound
has a sketch for both bands. Segments of very few bits, which unrelated documents share, are left
out where enough others remain. Sketches keep all their segments, unless a caller gives a number
(`segments`): for larger sets the pigeonhole is then a probability, and with 64 a linked pair is
missed with less than 2e-13.

Documents with equal sets are one class from the start. Candidates are compared as class pairs and
verified on the whole sets of their texts. Not every pair of a crowd that shares segments is compared: each such
crowd is tried against members that many others are near to; what then is still apart is screened
completely, block by block inside tasks, by a second parity sketch of fixed length, and pairs that
pass are verified, so components are exact.

A null or empty text, or one of blanks, has the empty set and links with nothing. A text of fewer
words than a shingle is one shingle. Rows with equal ids are documents of their own; null ids come
first. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marquee.llm import worker
from marquee.llm.components import components
from marquee.llm.ids import ROW, name_rows, with_rows
from marquee.llm.textbytes import byte_table, column_bytes, join_words, mix, word_sequences
from marquee.plans.lineage import materialize

SHINGLE = 3
PERCENT = 90
# Bits below which a segment of a long sketch says little; in a short one only an empty segment does.
FEW_BITS = 2
MANY_SEGMENTS = 16
# Segments in a sketch for each that the pigeonhole needs, at least.
SPARE = 1.2
# Sketch sizes are powers of this.
BAND = 1.5
# Bits of the second sketch, which screens candidates before their sets are fetched.
SCREEN = 1024
# Bits of the bitmap that screens texts; 2 MB.
BITMAP = 1 << 24
# Members of a crowd that are compared at a time, and rows that one task holds for it.
CHUNK = 2_048
TASK_ROWS = 50_000
# Rounds of comparing crowds with chosen members before the rest is compared completely.
ROUNDS = 3


def allowance(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of linked sets of sizes a and b.

    With u shingles in the union, the sets differ in u - i <= u * (1 - t), and u + i = a + b gives
    u <= (a + b) / (1 + t).
    """
    return (a + b) * (100 - percent) // (100 + percent)


def _need(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Segments that a set and its largest possible partner need; grows with the size."""
    return allowance(sizes, sizes * 100 // percent, percent) + 1


def _band(need: np.ndarray) -> np.ndarray:
    """Segments of the band that covers a need."""
    step = np.ceil(np.log(need * SPARE) / np.log(BAND) - 1e-9)
    return np.where(need <= 1, 1, np.ceil(BAND**step).astype(np.int64))


def sketch_sizes(size: int, percent: int) -> np.ndarray:
    """Sketches of a set: its own, last, and those of all smaller sets it may link with."""
    low, high = _need(np.array([-(-size * percent // 100), size]), percent)
    return np.unique(_band(np.arange(low, high + 1)))


def shingle_sets(
    column: pa.Array | pa.ChunkedArray, width: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per block of texts: first, last, sorted distinct shingles, bounds of each text's set."""
    data, offsets = column_bytes(column)
    member, to = byte_table()
    for first, last, words, texts in word_sequences(data, offsets, member, to):
        count = np.bincount(texts, minlength=last - first)
        begins = np.append(0, np.cumsum(count))
        hashed, owner = [], []
        if len(words) >= width:
            same = texts[width - 1 :] == texts[: len(texts) - width + 1]
            parts = [words[i : len(words) - width + 1 + i][same] for i in range(width)]
            hashed.append(join_words(parts))
            owner.append(texts[width - 1 :][same])
        for n in range(1, width):  # short texts: all their words are one shingle
            short = np.flatnonzero(count == n)
            if len(short):
                hashed.append(join_words([words[begins[short] + i] for i in range(n)]))
                owner.append(short)
        if not hashed:
            yield first, last, np.zeros(0, np.uint64), np.zeros(last - first + 1, np.int64)
            continue
        values, docs = np.concatenate(hashed), np.concatenate(owner)
        order = np.lexsort([values, docs])
        values, docs = values[order], docs[order]
        new = np.append(True, (values[1:] != values[:-1]) | (docs[1:] != docs[:-1]))
        values, docs = values[new], docs[new]
        yield first, last, values, np.searchsorted(docs, np.arange(last - first + 1))


def _sketch(values: np.ndarray, size: int, limit: int | None, spare: int) -> np.ndarray:
    """Join keys of one set's sketch of `size` segments, `spare` of which may be left out."""
    # values ascend, and so do their segments; the lower half of a value is its bit
    segment = (values >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)
    place, times = np.unique(
        segment << np.uint64(32) | values & np.uint64(0xFFFFFFFF), return_counts=True
    )
    place = place[times % 2 == 1]  # a bit toggled twice is clear again
    owner = (place >> np.uint64(32)).astype(np.int64)
    count = np.bincount(owner, minlength=size)
    total = np.zeros(size, np.uint64)
    if len(place):
        total[count > 0] = np.add.reduceat(mix(place.copy()), np.flatnonzero(np.diff(owner, prepend=-1)))
    few = count < (FEW_BITS if size >= MANY_SEGMENTS else 1)
    number = np.arange(size, dtype=np.uint64)
    chosen = np.ones(size, bool) if few.sum() > spare else ~few
    if limit is not None:
        chosen &= number < limit
    salt = np.full(int(chosen.sum()), size, np.uint64)
    return join_words([salt, number[chosen], total[chosen]]).view(np.int64)


def keys_of(values: np.ndarray, percent: int, limit: int | None) -> np.ndarray:
    """Join keys of one set: its own band's sketch, and those of its smaller partners' bands."""
    n = np.array([len(values)])
    sizes = sketch_sizes(len(values), percent)
    spares = sizes - allowance(n, n, percent) - 1  # a partner in a lower band is no larger
    spares[-1] = sizes[-1] - _need(n, percent)[0]
    return np.concatenate([_sketch(values, int(m), limit, int(x)) for m, x in zip(sizes, spares)])


def _screen(values: np.ndarray) -> bytes:
    place = (values >> np.uint64(11)) % np.uint64(SCREEN)
    odd = np.bincount(place.astype(np.int64), minlength=SCREEN) % 2
    return np.packbits(odd.astype(bool)).tobytes()


_PROFILE = "n bigint, digest binary, screen binary, keys array<bigint>"


def _profiles(documents: DataFrame, shingle: int, percent: int, limit: int | None) -> DataFrame:
    """(_row, n, digest, screen, keys) per document: what the join needs of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, screen, keys = [], [], [], []
            for first, last, values, bounds in shingle_sets(batch.column("text"), shingle):
                for a, b in zip(bounds[:-1], bounds[1:]):
                    own = values[a:b]
                    n.append(len(own))
                    digest.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                    screen.append(_screen(own))
                    keys.append(keys_of(own, percent, limit) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(ROW),
                    pa.array(n, pa.int64()),
                    pa.array(digest, pa.binary()),
                    pa.array(screen, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=[ROW, "n", "digest", "screen", "keys"],
            )

    return documents.select(ROW, "text").mapInArrow(worker.trimming(run), f"{ROW} bigint, {_PROFILE}")


def _mark(documents: DataFrame, named: DataFrame) -> DataFrame:
    """Add `_marked`: false only for rows that are not in `named`.

    A bitmap of hashed row numbers, BITMAP bits whatever the data, is broadcast, so that the exact
    lookup moves few texts besides those looked for.
    """
    place = F.pmod(F.xxhash64(ROW), F.lit(BITMAP))
    block, bit = F.floor(place / 32_768), F.pmod(place, F.lit(32_768))
    bitmaps = (
        named.select(block.alias("_block"), bit.alias("_bit"))
        .groupBy("_block")
        .agg(F.bitmap_construct_agg("_bit").alias("_map"))
    )
    byte = F.conv(F.hex(F.expr("substring(_map, cast(_bit div 8 as int) + 1, 1)")), 16, 10)
    return (
        documents.withColumns({"_block": block, "_bit": bit})
        .join(F.broadcast(materialize(bitmaps, "bitmaps")), "_block", "left")
        .withColumn("_byte", F.coalesce(byte.cast("int"), F.lit(0)))
        .withColumn("_marked", F.expr("shiftright(_byte, cast(_bit % 8 as int)) & 1 = 1"))
        .drop("_block", "_bit", "_map", "_byte")
    )


def _texts_of(documents: DataFrame, named: DataFrame) -> DataFrame:
    """(_row, text) of the rows in `named`."""
    likely = _mark(documents.select(ROW, "text"), named).where("_marked")
    return likely.select(ROW, "text").join(named, ROW, "left_semi")


def _verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, judged on the whole sets."""
    left = texts.select(F.col(ROW).alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col(ROW).alias("b"), F.col("text").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                keep = []
                for u, v in zip(_sets(part.column("x"), shingle), _sets(part.column("y"), shingle)):
                    both = len(np.intersect1d(u, v, assume_unique=True))
                    keep.append(100 * both >= percent * (len(u) + len(v) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(left, "a").join(right, "b")
    return met.mapInArrow(worker.trimming(run), "a bigint, b bigint")


def _sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    return [
        values[a:b]
        for _, _, values, bounds in shingle_sets(column, shingle)
        for a, b in zip(bounds[:-1], bounds[1:])
    ]


def _near(x: np.ndarray, y: np.ndarray, n_x: np.ndarray, n_y: np.ndarray, percent: int) -> np.ndarray:
    """Do sizes and screens allow a link? Screens differ in at most as many bits as the sets."""
    apart = np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)
    return (apart <= allowance(n_x, n_y, percent)) & (
        100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)
    )


def _screens(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(column_bytes(column)[0].tobytes(), np.uint64).reshape(-1, SCREEN // 64)


def _screened(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs whose sizes and screens don't rule a link out."""
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("screen").alias("x"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("screen").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_screens(batch.column(c)) for c in ("x", "y"))
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            near = _near(x, y, n_a, n_b, percent)
            yield batch.select(["a", "b"]).filter(pa.array(near))

    ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    met = ordered.join(left, "a").join(right, "b")
    return met.mapInArrow(worker.trimming(run), "a bigint, b bigint")


def _screen_blocks(rows: pa.Table, percent: int) -> pa.Table:
    """Pairs of one task's crowds that are not yet connected and may link, each once."""
    names = ("key", "low", "high", "chunk", "rep", "component", "n")
    key, low, high, chunk, rep, component, n = (rows.column(c).to_numpy() for c in names)
    order = np.lexsort([rep, high, low, key])
    blocks = np.stack([key[order], low[order], high[order]])
    cuts = np.flatnonzero((np.diff(blocks, axis=1) != 0).any(axis=0)) + 1
    screens = _screens(rows.column("screen"))
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own in np.split(order, cuts):
        if low[own[0]] == high[own[0]]:
            left = right = own
        else:
            left, right = (own[chunk[own] == c] for c in (low[own[0]], high[own[0]]))
        step = max(1, 2_000_000 // max(1, len(right) * SCREEN // 64))
        for begin in range(0, len(left), step):
            i = left[begin : begin + step, None]
            apart = component[i] != component[right]
            if left is right:
                apart &= rep[i] < rep[right]
            if apart.any():
                apart &= _near(screens[i], screens[right], n[i], n[right], percent)
                at, other = np.nonzero(apart)
                first.append(rep[i[at, 0]])
                second.append(rep[right[other]])
    a, b = np.concatenate(first), np.concatenate(second)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return pa.table({"a": pairs[0], "b": pairs[1]})


def _remaining(open_: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a key, are not yet connected and may link.

    A key's members meet in blocks of CHUNK by CHUNK inside tasks; only pairs that pass the screen
    become rows.
    """
    sizes = open_.groupBy("key").agg(F.count(F.lit(1)).alias("members"))
    chunked = materialize(
        sizes.withColumn("chunks", F.ceil(F.col("members") / CHUNK).cast("int")), "chunked"
    )
    # a member of a cut key comes once for each of its chunks
    total = chunked.agg(F.sum(F.col("members") * F.col("chunks"))).first()[0] or 0
    parts = max(1, -(-total // TASK_ROWS))
    return (
        open_.join(chunked.select("key", "chunks"), "key")
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(
            "key",
            "rep",
            "component",
            "chunk",
            F.least("chunk", "other").alias("low"),
            F.greatest("chunk", "other").alias("high"),
        )
        .withColumn("part", F.pmod(F.xxhash64("key", "low", "high"), F.lit(parts)))
        .join(classes, "rep")
        .groupBy("part")
        .applyInArrow(
            lambda t: worker.trimmed(_screen_blocks(t, percent)), "a bigint, b bigint"
        )
        .distinct()
    )


def _links(
    met: DataFrame, classes: DataFrame, documents: DataFrame, shingle: int, percent: int
) -> DataFrame:
    """(rep, component) of classes with links. `met` has (key, rep) of keys with several classes."""
    spark = met.sparkSession
    degree = met.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    weight = met.join(degree, "key").groupBy("rep").agg(F.sum("size").alias("near"))
    members = materialize(met.join(weight, "rep"), "members")
    named = members.select(F.col("rep").alias(ROW)).distinct()
    texts = materialize(_texts_of(documents, named), "texts")
    labels = spark.createDataFrame([], "node bigint, component bigint")
    tested = spark.createDataFrame([], "a bigint, b bigint")
    pivots = members.groupBy("key").agg(F.max(F.struct("near", "rep")).alias("pivot"))
    for turn in range(ROUNDS + 1):
        if not turn:
            open_ = members.withColumn("component", F.col("rep"))
        else:  # keys whose members are not yet all in one component; a closed key stays closed
            known = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn(
                "component", F.coalesce("component", "rep")
            )
            apart = known.groupBy("key").agg(
                F.min("component").alias("low"), F.max("component").alias("high")
            )
            open_ = materialize(
                known.join(apart.where("low != high").select("key"), "key", "left_semi"), "open"
            )
            if open_.isEmpty():
                break
            members = open_.drop("component")
        if turn < ROUNDS:
            if turn:  # the next member in order of nearness
                below = pivots.withColumnRenamed("pivot", "last")
                pivots = (
                    open_.join(below, "key")
                    .where(F.struct("near", "rep") < F.col("last"))
                    .groupBy("key")
                    .agg(F.max(F.struct("near", "rep")).alias("pivot"))
                )
            pivots = materialize(pivots, "pivots")
            chosen = pivots.select("key", F.col("pivot.rep").alias("b")).join(
                open_.select("key", F.col("rep").alias("b"), F.col("component").alias("beyond")),
                ["key", "b"],
            )
            pairs = open_.join(chosen, "key").where("component != beyond")
            pairs = _screened(pairs.select(F.col("rep").alias("a"), "b"), classes, percent)
        else:
            pairs = _remaining(open_, classes, percent)
        asked = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "asked")
        linked = materialize(_verified(asked, texts, shingle, percent), "linked")
        tested = tested.union(asked)
        labels = materialize(components(labels.toDF("a", "b").union(linked)), "labels")
    return labels.select(F.col("node").alias("rep"), "component")


def _met(keyed: DataFrame) -> DataFrame:
    """The rows (key, rep) of keys that come more than once.

    Nearly all keys come once, so a count per key would hold as many groups as there are rows, and
    joining it would move all rows a second time; sorted by key, they move once.
    """
    times = F.count(F.lit(1)).over(W.partitionBy("key"))
    return keyed.withColumn("_times", times).where("_times > 1").select("key", "rep")


def _link_rows(
    numbered: DataFrame, shingle: int, percent: int, segments: int | None
) -> DataFrame:
    """(_row, n, _component) of numbered documents; the component is its smallest row."""
    documents = numbered.select(ROW, "text")
    profiles = materialize(_profiles(documents, shingle, percent, segments), "profiles")
    classes = materialize(
        profiles.where("n > 0").groupBy("digest").agg(F.min(ROW).alias("rep")), "classes"
    )
    own = profiles.join(classes.select(F.col("rep").alias(ROW)), ROW).withColumnRenamed(ROW, "rep")
    met = materialize(_met(own.select("rep", F.explode("keys").alias("key"))), "met")
    screens = own.select("rep", "n", "screen")
    labels = _links(met, screens, documents, shingle, percent)
    of_class = classes.join(labels, "rep", "left").select(
        "digest", F.coalesce("component", "rep").alias("_component")
    )
    return (
        profiles.select(ROW, "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest"))
        .join(of_class, "digest", "left")
        .select(ROW, "n", F.coalesce("_component", ROW).alias("_component"))
    )


def link_documents(
    documents: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    segments: int | None = None,
) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document.

    Documents link when 100 * shared >= percent * united shingles; a component is all that links
    reach, named by its smallest document.
    """
    numbered, sound = with_rows(documents.select("doc_id", "text"), "doc_id", "text")
    every = _link_rows(numbered, shingle, percent, segments)
    if sound:
        every = every.withColumn("doc_id", F.col(ROW))
    else:
        every = every.join(numbered.select(ROW, "doc_id"), ROW)
    named = name_rows(every, numbered, sound, "_component", "doc_id", "component_id")
    return named.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.col("component_id").cast("bigint").alias("component_id"),
    )


def keep_one(
    documents: DataFrame,
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    segments: int | None = None,
) -> DataFrame:
    """The first document of every component, as it came; documents without words all stay."""
    columns = [F.col(f"`{c}`") for c in documents.columns]
    whole = documents.select("doc_id", "text", F.struct(*columns).alias("_doc"))
    numbered, _ = with_rows(whole, "doc_id", "text")
    linked = _link_rows(numbered, shingle, percent, segments)
    gone = materialize(linked.where(F.col("_component") != F.col(ROW)).select(ROW), "gone")
    marked = _mark(numbered.select(ROW, "_doc"), gone)
    kept = marked.where("_marked").join(gone, ROW, "left_anti")
    return marked.where("not _marked").unionByName(kept).select("_doc.*")
