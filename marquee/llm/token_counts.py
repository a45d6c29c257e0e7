"""Token counts of whole texts by a two-tier lookup on the map side.

Tier one is a broadcast table of the lengths of frequent pre-tokens, tier two a cache in each
Python worker, filled by encoding what the table lacks. The table comes from all texts: each task
keeps a summary of frequent pre-tokens of bounded size, one row per task leaves it, and summaries
are merged sixteen at a time. Pre-tokens themselves are never shuffled. The table only decides how
much is looked up; every count is the library's own.

A null text counts as empty and has no tokens; rows with equal ids are counted one by one; a very
long text is cut into pre-tokens like any other.
"""

from __future__ import annotations

import sys
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import worker
from marquee.llm.bytelevel import byte_symbols
from marquee.plans.lineage import materialize

# Pre-tokens in a summary and in the broadcast table. A pre-token that makes up more than one in
# TABLE_ENTRIES of all is in the table.
TABLE_ENTRIES = 32_768
# Summaries that one task merges.
FAN = 16
# Longer pre-tokens, in characters, are neither in the table nor in a cache.
LONG = 64
# A worker's cache starts anew beyond this many bytes; what an entry takes beside its string.
CACHE_BYTES = 96 << 20
ENTRY_BYTES = 100
OVER = 1024

# Between entries of the packed table; no entry holds it, as `_unsure` names it.
SEPARATOR = "\x1c"

# The byte-level pattern of the tokenizer files.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
_piece = regex.compile(PATTERN)
# Letters, digits and blanks outside these ranges may be classed differently by other versions of
# Unicode; a text with any of them is encoded by the library as a whole.
_unsure = regex.compile(
    r"[\x1c-\x1f]|[^\x00-ɏЀ-џ‐-‧‰-⁞一-龥]"
)


@lru_cache(maxsize=4)
def tokenizer(definition: str):
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(definition)
    made.no_truncation()
    made.no_padding()
    return made


class Lengths(dict):
    """Tokens per pre-token: the broadcast table, then what this worker has met."""

    def __init__(self, frequent: dict[str, int], library) -> None:
        super().__init__(frequent)
        self.frequent, self.encode, self.merge = frequent, library.encode, library.model.tokenize
        self.room = CACHE_BYTES

    def __missing__(self, piece: str) -> int:
        n = len(self.merge(byte_symbols(piece)))
        if len(piece) > LONG:
            return n
        if self.room <= 0:
            self.clear()
            self.update(self.frequent)
            self.room = CACHE_BYTES
        self.room -= sys.getsizeof(piece) + ENTRY_BYTES
        self[piece] = n
        return n


def pack(frequent: dict[str, int]) -> tuple[bytes, bytes]:
    """The table as two strings of bytes, to be broadcast."""
    return SEPARATOR.join(frequent).encode(), array("H", frequent.values()).tobytes()


def unpack(packed: tuple[bytes, bytes]) -> dict[str, int]:
    if not packed[1]:
        return {}
    return dict(zip(packed[0].decode().split(SEPARATOR), array("H", packed[1])))


def _lengths(definition: str, packed: tuple[bytes, bytes]) -> Lengths:
    """This worker's table; counts depend on the definition alone, so later tasks go on with it."""
    return worker.keep(
        ("lengths", definition), lambda: Lengths(unpack(packed), tokenizer(definition))
    )


def count_one(text: str, lengths: Lengths, specials: tuple[str, ...]) -> int:
    if any(s in text for s in specials) or _unsure.search(text):
        return len(lengths.encode(text, add_special_tokens=False).ids)
    return sum(map(lengths.__getitem__, _piece.findall(text)))


def thin(counts: Counter[str], entries: int) -> Counter[str]:
    """The `entries` most frequent, each less the count of the next one.

    A count is short by at most 1 in `entries` of all that was counted, however often summaries are
    thinned and added up on the way.
    """
    if len(counts) <= entries:
        return counts
    cut = sorted(counts.values(), reverse=True)[entries]
    return Counter({p: n - cut for p, n in counts.items() if n > cut})


SUMMARY = "part bigint, pieces array<string>, counts array<bigint>"


def _summary_row(part: int, counts: Counter[str]) -> pa.RecordBatch:
    columns = [
        pa.array([part], pa.int64()),
        pa.array([list(counts)], pa.list_(pa.string())),
        pa.array([list(counts.values())], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["part", "pieces", "counts"])


def summaries(documents: DataFrame, entries: int) -> DataFrame:
    """(part, pieces, counts): one summary of at most `entries` pre-tokens per task."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.release()
        seen: Counter[str] = Counter()
        for batch in batches:
            met: Counter[str] = Counter()
            for text in batch.column("text"):
                met.update(_piece.findall(text.as_py()))
            seen.update({p: n for p, n in met.items() if len(p) <= LONG})
            if len(seen) > 2 * entries:
                seen = thin(seen, entries)
        task = TaskContext.get()
        if seen:
            yield _summary_row(task.partitionId() if task else 0, thin(seen, entries))

    return documents.select("text").where("text != ''").mapInArrow(summarize, SUMMARY)


def frequent_pieces(
    documents: DataFrame, definition: str, entries: int = TABLE_ENTRIES, fan: int = FAN
) -> dict[str, int]:
    """Lengths of the most frequent pre-tokens of all documents, `entries` at most.

    The driver receives one merged summary.
    """

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        total: Counter[str] = Counter()
        for pieces, counts in zip(table.column("pieces"), table.column("counts")):
            total.update(dict(zip(pieces.as_py(), counts.as_py())))
        return pa.Table.from_batches([_summary_row(key[0].as_py(), thin(total, entries))])

    found = materialize(summaries(documents, entries), "frequent")
    last = found.agg(F.max("part")).first()[0]
    while last:
        group = F.floor(F.col("part") / fan).alias("group")
        found = materialize(found.groupBy(group).applyInArrow(merge, SUMMARY), "frequent")
        last //= fan
    row = found.first()
    lengths = Lengths({}, tokenizer(definition))
    return {p: lengths[p] for p in (row["pieces"] if row else ()) if not _unsure.search(p)}


def count_tokens(documents: DataFrame, tokenizer_file: str, limit: int = OVER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per document.

    `tokenizer_file` is a definition for the tokenizers library, read on the driver. Special
    strings inside a text become their special token, as the library does by default.
    """
    definition = Path(tokenizer_file).read_text(encoding="utf-8")
    specials = tuple(
        t.content for t in tokenizer(definition).get_added_tokens_decoder().values()
    )
    frequent = frequent_pieces(documents, definition)
    shared = documents.sparkSession.sparkContext.broadcast((definition, pack(frequent)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _lengths(*shared.value)
        for batch in batches:
            counts = [
                count_one(text, lengths, specials) if text else 0
                for text in (t.as_py() for t in batch.column("text"))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    sized = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        "text",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
    )
    return sized.mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )
