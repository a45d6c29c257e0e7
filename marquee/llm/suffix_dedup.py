"""Removal of repeated passages by longest-previous-factor arrays over partitioned suffixes.

A byte goes if a string of WINDOW bytes around it also starts earlier: in a document with a smaller
id or earlier in its own. The suffixes that can share WINDOW bytes are brought together by content:
the smallest hash of the 32-byte substrings of a window names the window, so equal windows have
equal names, and runs of neighbouring windows share one. Names that occur once in the whole corpus
are set aside by an exchange of name lists. What is left goes, as short segments of text, to the
task that owns its name. There the suffixes are sorted, neighbours' common prefixes measured, and
the longest previous factor of each suffix read off at its previous and next smaller positions in
suffix order. Before they leave, a task's own segments go through the same arrays, so of a passage
that many documents share one copy per task moves on; a name whose windows still differ in very many
documents is dealt out window by window.

The text moves once, by document; that exchange serves the naming, the cutting and the result.

Null and empty texts and texts shorter than WINDOW lose nothing. Rows that share an id are documents
of their own, in order of their texts; null ids come first. Equal rows are copies: one of them
keeps its text. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marquee.llm import worker
from marquee.llm.ids import ROW, with_rows
from marquee.llm.textbytes import CHUNK, column_bytes, mix, window_hash

WINDOW = 100
GRAM = 32
# Text of the documents that a task holds at a time, and text whose names one owner compares.
GROUP_BYTES = 2 << 20
OWNER_BYTES = 64 << 20
# A name with more occurrences than this is dealt out by window.
CROWD = 100_000
# Lower bits of a hash that give way to its place in a piece of CHUNK + WINDOW bytes.
_PLACE = np.uint64((2 * CHUNK) - 1)


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span < width:
        step = min(span, width - span)
        values = np.minimum(values[:-step], values[step:])
        span += step
    return values


def named_runs(
    data: np.ndarray, offsets: np.ndarray, window: int, gram: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first start, last start + 1) of runs of windows that share the substring that names
    them; none crosses a document's end."""
    names, lows, highs = [], [], []
    short = np.maximum(offsets[:-1], offsets[1:] - window + 1)  # from here no window fits
    n = int(offsets[-1])
    for begin in range(0, n, CHUNK):
        piece = data[begin : min(n, begin + CHUNK + window - 1)]
        if len(piece) < window:
            continue
        hashes = window_hash(piece, gram)
        # the smallest hash by its upper bits, the leftmost of equals
        marked = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_min(marked, window - gram + 1)
        size = len(least)
        gaps = np.zeros(size + 1, np.int32)
        np.add.at(gaps, np.clip(short - begin, 0, size), 1)
        np.add.at(gaps, np.clip(offsets[1:] - begin, 0, size), -1)
        fits = np.cumsum(gaps[:size]) == 0
        change = np.ones(size + 1, bool)
        change[1:size] = (least[1:] != least[:-1]) | (fits[1:] != fits[:-1])
        edges = np.flatnonzero(change)
        inside = fits[edges[:-1]]
        # smallest hashes crowd at the low end; mixed again they spread over all owners
        names.append(mix(hashes[(least[edges[:-1]][inside] & _PLACE).astype(np.int64)]))
        lows.append(edges[:-1][inside] + begin)
        highs.append(edges[1:][inside] + begin)
    if not names:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(names), np.concatenate(lows), np.concatenate(highs)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted names as differences, byte plane by byte plane, which compress well."""
    deltas = np.diff(keys, prepend=np.uint64(0))
    return deltas.view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _owner(names: np.ndarray, owners: int) -> np.ndarray:
    """Which of `owners` tasks a name belongs to; grows with the name."""
    return ((names >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int64)


def previous_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factors of suffixes given in suffix order.

    `position` is each suffix's place in the text, `common[i]` the common prefix of suffixes i - 1
    and i. A suffix shares most with an earlier one at its previous or next smaller position in
    suffix order; both are found for all suffixes at once by jumps that double.
    """
    n = len(position)
    best = np.zeros(n, common.dtype)
    if n < 2:
        return best
    rises = position[1:] > position[:-1]  # the neighbour before starts earlier
    best[1:][rises] = common[1:][rises]
    _jump(position, common, best, np.flatnonzero(~rises) + 1)
    # Next smaller ones, from the other end. One that starts later than its neighbour before is next
    # smaller to none, and one that shares the most there is needs no other.
    kept = np.append(True, ~rises) | (best < common.max())
    kept = np.flatnonzero(kept)[::-1]
    between = np.minimum.reduceat(common, kept[:0:-1] + 1)[::-1] if len(kept) > 1 else common[:0]
    position, common, found = position[kept], np.append(common[:1], between), best[kept]
    rises = position[1:] > position[:-1]
    found[1:][rises] = np.maximum(found[1:], common[1:])[rises]
    _jump(position, common, found, np.flatnonzero(~rises) + 1)
    best[kept] = found
    return best


def _jump(position: np.ndarray, common: np.ndarray, best: np.ndarray, todo: np.ndarray) -> None:
    """Raise `best` of the suffixes `todo`, whose neighbours before start later, to what they share
    with their previous smaller ones."""
    at = np.arange(-1, len(position) - 1)
    # common prefix with the suffix jumped to
    shared = common.copy()
    every = todo
    while len(todo):
        via = at[todo]
        at[todo], shared[todo] = at[via], np.minimum(shared[todo], shared[via])
        todo = todo[at[todo] >= 0]
        todo = todo[position[at[todo]] > position[todo]]
    found = every[at[every] >= 0]
    best[found] = np.maximum(best[found], shared[found])


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position on, as numbers; byte-swapped they sort like the bytes."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


def _stable_order(values: np.ndarray) -> np.ndarray:
    """Positions of 64-bit numbers in stable order of the numbers.

    Upper bits and position are sorted as one number each; if that parts equal upper bits wrongly,
    the numbers are sorted in full.
    """
    bits = np.uint64(max(1, (len(values) - 1).bit_length()))
    place = (np.uint64(1) << bits) - np.uint64(1)
    packed = np.sort((values & ~place) | np.arange(len(values), dtype=np.uint64))
    order = (packed & place).astype(np.int64)
    packed &= ~place
    ordered = values[order]
    if ((packed[1:] == packed[:-1]) & (ordered[1:] != ordered[:-1])).any():
        return np.argsort(values, kind="stable")
    return order


def _text_order(words: np.ndarray, first: np.ndarray, steps: list[int]) -> np.ndarray:
    """Order of the texts from `first` on by their words at `steps`; only ties look further."""
    keys = words[first + steps[0]].byteswap()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    tied, run = np.arange(len(first)), np.zeros(len(first), np.int64)
    for s in steps[1:]:
        # runs that agree so far
        new = np.append(True, (keys[1:] != keys[:-1]) | (run[1:] != run[:-1]))
        again = ~(new & np.append(new[1:], True))
        tied, run = tied[again], np.cumsum(new)[again]
        if not len(tied):
            break
        keys = words[first[order[tied]] + s].byteswap()
        within = np.lexsort((keys, run))
        order[tied], keys = order[tied][within], keys[within]
    return order


def repeated_starts(data: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """Which `starts`, in text order, begin a window that also begins at an earlier one.

    Suffixes are first classed by a fingerprint of their window. Those alone in their class share
    no window with any other and are left out of the suffix array.
    """
    flags = np.zeros(len(starts), bool)
    if len(starts) < 2:
        return flags
    prints = np.empty(len(starts), np.uint64)
    for begin in range(0, len(data) - window + 1, CHUNK):
        a, b = np.searchsorted(starts, [begin, begin + CHUNK])
        if a < b:
            hashes = window_hash(data[begin : begin + CHUNK + window - 1], window)
            prints[a:b] = hashes[starts[a:b] - begin]
    order = _stable_order(prints)
    ordered = prints[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.append(False, same) | np.append(same, False)
    order, ordered = order[shared], ordered[shared]
    if not len(order):
        return flags
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    words = _words(data)
    steps = [*range(0, window - 7, 8), max(0, window - 8)]
    by_text = _text_order(words, starts[order[heads]], steps)
    # suffix order: classes by their bytes, equal windows by position
    sizes = np.diff(np.append(heads, len(order)))
    spans = np.repeat(heads[by_text] - np.append(0, np.cumsum(sizes[by_text])[:-1]), sizes[by_text])
    order = order[np.arange(len(order)) + spans]
    suffix = starts[order]
    alike = np.ones(len(suffix) - 1, bool)
    depth = np.zeros(len(suffix), np.int32)  # whole words in common so far
    for s in steps:
        word = words[suffix + s]
        alike &= word[1:] == word[:-1]
        depth[1:] += alike
    # the last step ends at the window
    common = np.array([0, *[s + 8 for s in steps[:-1]], window], np.int32)[depth]
    flags[order] = previous_factors(order, common) >= window
    return flags


def _runs(rows: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start + 1) of maximal runs; both inputs in order."""
    if not len(starts):
        return rows, starts, starts
    cut = np.append(True, (np.diff(starts) != 1) | (rows[1:] != rows[:-1]))
    heads = np.flatnonzero(cut)
    tails = np.append(heads[1:], len(starts)) - 1
    return rows[heads], starts[heads], starts[tails] + 1


def _expand(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges, and the range each belongs to."""
    sizes = high - low
    which = np.repeat(np.arange(len(low)), sizes)
    before = np.cumsum(sizes) - sizes
    return np.arange(len(which)) - before[which] + low[which], which


_LISTS = "owner int, grouped int, names binary, counts binary"
_MOVED = "place int, row bigint, low bigint, high bigint, data binary"
_COVERED = "row bigint, low bigint, high bigint"


def _list_names(docs: pa.Table, owners: int, window: int, gram: int) -> pa.Table:
    """The distinct names of a group of documents, one list per owner."""
    data, offsets = column_bytes(docs.column("_text"))
    names, counts = np.unique(named_runs(data, offsets, window, gram)[0], return_counts=True)
    counts = np.minimum(counts, 65_535).astype(np.uint16)
    owner = _owner(names, owners)
    used = np.unique(owner)
    cuts = np.append(np.searchsorted(owner, used), len(owner))
    group = docs.column("_group")[0].as_py()
    return pa.table(
        {
            "owner": pa.array(used, pa.int32()),
            "grouped": pa.array([group] * len(used), pa.int32()),
            "names": pa.array([_pack(names[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
            "counts": pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
        }
    )


def _repeated_names(lists: pa.Table, crowd: int) -> pa.Table:
    """Of each list of one owner, the names that occur more than once anywhere; a count of 0 marks
    a crowded name."""
    names = [_unpack(b.as_py()) for b in lists.column("names")]
    counts = [np.frombuffer(b.as_py(), np.uint16) for b in lists.column("counts")]
    every, where = np.unique(np.concatenate(names), return_inverse=True)
    total = np.bincount(where, np.concatenate(counts), len(every))
    out_names, out_counts, at = [], [], 0
    for own in names:
        times = total[where[at : at + len(own)]]
        at += len(own)
        kept = times > 1
        out_names.append(_pack(own[kept]))
        out_counts.append(np.where(times[kept] > crowd, 0, 1).astype(np.uint16).tobytes())
    return pa.table(
        {
            "owner": lists.column("owner").cast(pa.int32()),
            "grouped": lists.column("grouped").cast(pa.int32()),
            "names": pa.array(out_names, pa.binary()),
            "counts": pa.array(out_counts, pa.binary()),
        }
    )


def _moved(place, row, low, high, data) -> pa.Table:
    return pa.table(
        {
            "place": pa.array(place, pa.int32()),
            "row": pa.array(row, pa.int64()),
            "low": pa.array(low, pa.int64()),
            "high": pa.array(high, pa.int64()),
            "data": data,
        }
    )


def _slices(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.Array:
    """Binary values data[low:high]."""
    index, _ = _expand(low, high)
    offsets = np.append(0, np.cumsum(high - low)).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(low), [None, pa.py_buffer(offsets), pa.py_buffer(data[index])]
    )


def _cut_segments(docs: pa.Table, lists: pa.Table, places: int, window: int, gram: int) -> pa.Table:
    """Segments of a group's documents under names that occur elsewhere too.

    Windows that repeat within the group are settled here: they leave as covered ranges (no data).
    """
    docs = docs.sort_by(ROW)
    data, offsets = column_bytes(docs.column("_text"))
    rows = docs.column(ROW).to_numpy()
    empty = [_moved([], [], [], [], pa.array([], pa.binary()))]
    if not lists.num_rows or not len(data):
        return empty[0]
    known = np.concatenate([_unpack(b.as_py()) for b in lists.column("names")])
    plain = np.concatenate([np.frombuffer(b.as_py(), np.uint16) for b in lists.column("counts")])
    order = np.argsort(known)
    known, plain = known[order], plain[order]
    names, low, high = named_runs(data, offsets, window, gram)
    if not len(known) or not len(names):
        return empty[0]
    at = np.minimum(np.searchsorted(known, names), len(known) - 1)
    hit = known[at] == names
    names, low, high, crowded = names[hit], low[hit], high[hit], plain[at[hit]] == 0
    starts, run = _expand(low, high)
    again = repeated_starts(data, starts, window)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    row, lo, hi = _runs(rows[doc[again]], (starts - offsets[doc])[again])
    out = empty + [
        _moved(row % places, row, lo, hi, pa.nulls(len(row), pa.binary()))
    ]
    # what is still open of each run, as one segment
    starts, run, doc = starts[~again], run[~again], doc[~again]
    heads = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else run
    tails = np.append(heads[1:], len(run)) - 1 if len(run) else run
    low, high, doc = starts[heads], starts[tails] + 1, doc[heads]
    alone = crowded[run[heads]]
    place = _owner(names[run[heads]], places)
    out.append(_segments(data, offsets, rows, place[~alone], low[~alone], high[~alone], doc[~alone], window))
    if alone.any():
        # a crowded name: each window goes where its own hash says
        each, of = _expand(low[alone], high[alone])
        prints = np.empty(len(each), np.uint64)
        for begin in range(0, len(data) - window + 1, CHUNK):
            a, b = np.searchsorted(each, [begin, begin + CHUNK])
            if a < b:
                hashes = window_hash(data[begin : begin + CHUNK + window - 1], window)
                prints[a:b] = hashes[each[a:b] - begin]
        out.append(
            _segments(
                data, offsets, rows, _owner(prints, places), each, each + 1, doc[alone][of], window
            )
        )
    return pa.concat_tables(out)


def _segments(data, offsets, rows, place, low, high, doc, window: int) -> pa.Table:
    return _moved(
        place,
        rows[doc],
        low - offsets[doc],
        high - offsets[doc],
        _slices(data, low, high + window - 1),
    )


def _settle(moved: pa.Table, window: int) -> pa.Table:
    """Covered ranges of the segments in one place, with those that came covered."""
    covered = moved.filter(pc.is_null(moved.column("data")))
    open_ = moved.filter(pc.is_valid(moved.column("data")))
    parts = [covered.select(["row", "low", "high"])]
    if open_.num_rows:
        open_ = open_.sort_by([("row", "ascending"), ("low", "ascending")])
        data, offsets = column_bytes(open_.column("data"))
        row, low = open_.column("row").to_numpy(), open_.column("low").to_numpy()
        starts, which = _expand(offsets[:-1], offsets[1:] - window + 1)
        again = repeated_starts(data, starts, window)
        which = which[again]
        found = _runs(row[which], (starts[again] - offsets[which]) + low[which])
        parts.append(pa.table(dict(zip(("row", "low", "high"), map(pa.array, found)))))
    return pa.concat_tables(parts)


def _result(docs: pa.Table, covered: pa.Table, window: int, texts: bool) -> pa.Table:
    """What is left of each document."""
    docs = docs.sort_by(ROW)
    data, offsets = column_bytes(docs.column("_text"))
    rows = docs.column(ROW).to_numpy()
    size = len(data)
    steps = np.zeros(size + 1, np.int32)
    if covered.num_rows:
        doc = np.searchsorted(rows, covered.column("row").to_numpy())
        np.add.at(steps, offsets[doc] + covered.column("low").to_numpy(), 1)
        np.add.at(steps, offsets[doc] + covered.column("high").to_numpy() + window - 1, -1)
    gone = np.cumsum(steps[:size]) > 0
    total = np.append(0, np.cumsum(gone))
    removed = total[offsets[1:]] - total[offsets[:-1]]
    begins = gone.copy()
    if size:
        begins[1:] &= ~gone[:-1]
        heads = offsets[:-1][np.diff(offsets) > 0]
        begins[heads] = gone[heads]
    count = np.append(0, np.cumsum(begins))
    ends = offsets - total[offsets]
    left = pa.Array.from_buffers(
        pa.binary(), len(docs), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[~gone])]
    )
    out = {
        "_doc": docs.column("_doc"),
        "n_bytes": pa.array(np.diff(offsets), pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(count[offsets[1:]] - count[offsets[:-1]], pa.int64()),
        "left": left,
    }
    if texts:
        left_text = _whole_characters(data, offsets, gone)
        came = pc.is_valid(docs.column("_text"))
        out["kept"] = pc.if_else(came, left_text, pa.scalar(None, pa.string()))
    return pa.table(out)


def _whole_characters(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray) -> pa.Array:
    """The texts left; a character of which any byte stays, stays whole."""
    if len(data):
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        stays = np.logical_or.reduceat(~gone, starts)
        stays = np.repeat(stays, np.diff(np.append(starts, len(data))))
    else:
        stays = np.zeros(0, bool)
    total = np.append(0, np.cumsum(stays))
    return pa.Array.from_buffers(
        pa.string(),
        len(offsets) - 1,
        [None, pa.py_buffer(total[offsets].astype(np.int32)), pa.py_buffer(data[stays])],
    )


def remove_repeats(
    documents: DataFrame,
    window: int = WINDOW,
    gram: int = GRAM,
    texts: bool = False,
    crowd: int = CROWD,
    group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """(_doc, n_bytes, n_removed, n_spans, kept_sha256) per document, and with `texts` also kept.

    `_doc` is a struct of the columns that came, but for the text. n_removed counts bytes, n_spans
    maximal runs of them, kept_sha256 is taken from the bytes left. `kept` is the text left, in whole
    characters, and null where the text was.
    """
    spark = documents.sparkSession
    # the text itself travels once; the other columns are packed, so that no name can clash
    columns = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    packed = documents.select("doc_id", "text", F.struct(*columns).alias("_doc"))
    numbered, _ = with_rows(packed, "doc_id", "text")
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(least, math.ceil(size / group_bytes))
    owners = max(least, math.ceil(size / OWNER_BYTES))
    docs = numbered.select(
        F.pmod(F.xxhash64(ROW), F.lit(groups)).cast("int").alias("_group"),
        ROW,
        F.col("text").cast("string").alias("_text"),
        "_doc",
    )
    by_group = docs.groupBy("_group")
    repeated = (
        by_group.applyInArrow(lambda t: worker.trimmed(_list_names(t, owners, window, gram)), _LISTS)
        .groupBy("owner")
        .applyInArrow(lambda t: worker.trimmed(_repeated_names(t, crowd)), _LISTS)
    )
    covered = (
        by_group.cogroup(repeated.groupBy("grouped"))
        .applyInArrow(
            lambda d, t: worker.trimmed(_cut_segments(d, t, groups, window, gram)), _MOVED
        )
        .groupBy("place")
        .applyInArrow(lambda t: worker.trimmed(_settle(t, window)), _COVERED)
        .withColumn("grouped", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    )
    schema = T.StructType(
        [
            docs.schema["_doc"],
            *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")),
            T.StructField("left", T.BinaryType()),
            *([T.StructField("kept", T.StringType())] if texts else []),
        ]
    )
    result = by_group.cogroup(covered.groupBy("grouped")).applyInArrow(
        lambda d, c: worker.trimmed(_result(d, c, window, texts)), schema
    )
    return result.select(
        "_doc",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.sha2("left", 256).alias("kept_sha256"),
        *(["kept"] if texts else []),
    )
