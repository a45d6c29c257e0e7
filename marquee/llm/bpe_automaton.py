"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton starts with one state that loops on every byte symbol and accepts every sequence of
symbols. Each merge (u, v) -> w, in order, applies a gadget: the state p behind u is copied, the
copy loses its v arc and becomes the target of all u arcs, and every state with a u arc gets a w
arc to where v led from p. After the last gadget exactly one token path spells any word, and it
is the one that BPE gives.

Copies are not written out. A state is the one it was copied from with one arc less, and a later arc
w exists where its left part u does; `has_arc` walks back to the gadget that decides and keeps the
answer, so the transition table fills with the arcs that words use.

A null text counts as empty: no tokens, empty decoded text. Every row is encoded on its own, so
equal rows get equal results.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm import worker
from marquee.llm.bytelevel import byte_symbols

# Bytes of a worker's tables of arcs, words and chunks in a generation; two are kept. Words of a-z are
# chunks too and are kept there only. An entry counts
# its characters, its tokens and ENTRY_BYTES for the objects around them. Tables of twice that size
# save a quarter of the time, but two workers and a heap at its limit then need all of an executor.
ARC_BYTES = 12 << 20
WORD_BYTES = 6 << 20
CHUNK_BYTES = 30 << 20
ENTRY_BYTES = 170
# Symbols by which the lengths of tokens are looked up.
HEAD = 4
# Documents that a worker encodes before it hands them on.
BATCH = 1_000
# The blanks of Unicode's White_Space property.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_blank = re.compile(f"[{BLANKS}]+")
_odd = re.compile("[\x1c-\x1f]")
# A word of Latin letters, perhaps with punctuation behind it: the commonest chunk by far.
_plain = re.compile("([a-zß-öø-ÿ]+)([.,;:!?]*)")
_simple = re.compile("[a-z]+").fullmatch


class Recent:
    """A table that forgets what has not been used for long: at most two generations of entries,
    each of about `size` bytes. What would take a hundredth of that isn't kept."""

    def __init__(self, size: int) -> None:
        self.size, self.held, self.young, self.old = size, 0, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, value) -> None:
        weight = ENTRY_BYTES
        if type(key) is str:
            weight += len(key) + len(value)
            if weight > self.size // 100:
                return
        self.held += weight
        if self.held > self.size:
            self.old, self.young, self.held = self.young, {}, weight
        self.young[key] = value


class Automaton:
    """States and arcs of the merges; see the module."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str) -> None:
        self.ids, self.suffix = vocabulary, suffix
        self.size = size = max(vocabulary.values()) + 1
        self.labels: list[str] = [""] * size
        for label, token in vocabulary.items():
            self.labels[token] = label
        self.born = [-1] * size  # gadget that made the token's arcs, -1 for symbols
        self.left = [-1] * size
        # per token: the states that were behind it, first to last, and the gadgets that made them
        self.behind: list[list[int]] = [[0] for _ in range(size)]
        self.changes: list[list[int]] = [[-1] for _ in range(size)]
        # per state: the token it stands behind by its own gadget, and that gadget
        self.owner, self.made = [-1], [-1]
        self.rank: dict[int, int] = {}
        self.table = Recent(ARC_BYTES)
        self.dead: set[int] = set()
        for rank, pair in enumerate(merges):
            u, v = pair if not isinstance(pair, str) else pair.split(" ")
            self._gadget(rank, vocabulary[u], vocabulary[v], vocabulary[u + v])
        # per first HEAD symbols: how long the tokens are that begin so, longest first; shorter
        # tokens may follow anywhere
        lengths: dict[str, set[int]] = {}
        for label in vocabulary:
            if len(label) >= HEAD:
                lengths.setdefault(label[:HEAD], set()).add(len(label))
        self.short = tuple(range(HEAD - 1, 0, -1))
        every: dict[tuple, tuple] = {}  # most heads share theirs
        self.lengths = {
            head: every.setdefault(key := (*sorted(found, reverse=True), *self.short), key)
            for head, found in lengths.items()
        }

    def _gadget(self, rank: int, u: int, v: int, w: int) -> None:
        """Merge (u, v) -> w: a copy without the v arc moves behind u, w leads where v led."""
        if self.born[w] < 0:  # else w is spelled a second way and keeps its arcs
            if u in self.dead or not self.has_arc(self.behind[u][-1], v):
                self.dead.add(w)  # u and v never meet, so no state has a w arc
            self.born[w], self.left[w] = rank, u
            self.behind[w], self.changes[w] = [self.behind[v][-1]], [rank]
        self.rank[u * self.size + v] = rank
        self.owner.append(u)
        self.made.append(rank)
        self.behind[u].append(len(self.made) - 1)
        self.changes[u].append(rank)

    def has_arc(self, state: int, token: int) -> bool:
        """Does `state` have an arc labelled `token`?"""
        key = state * self.size + token
        known = self.table.get(key)
        if known is None:
            known = self._walk(state, token)
            self.table.put(key, known)
        return known

    def _walk(self, state: int, token: int) -> bool:
        """Back through the copies: an arc younger than the copy is there if its left part is,
        an older one unless a gadget of the copied token took it away."""
        made, owner, born, size = self.made, self.owner, self.born, self.size
        while state and token not in self.dead:
            gadget = made[state]
            if born[token] >= gadget:
                token = self.left[token]
                continue
            u = owner[state]
            lost = self.rank.get(u * size + token)
            if lost is not None and lost <= gadget:
                return False
            # the state that stood behind u when the arc was made, or u's first
            at = bisect_right(self.changes[u], born[token]) - 1
            state = self.behind[u][max(at, 0)]
        return token not in self.dead

    def encode(self, word: str) -> list[int]:
        """Tokens of one pre-split word, given as its byte symbols.

        Takes the longest arc that leaves the state reached and goes back where none does. Every
        prefix has one path, so a position that failed once is never tried again.
        """
        n, ids, behind, born = len(word), self.ids.get, self.behind, self.born
        lengths, short = self.lengths.get, self.short
        arcs, size = self.table.young.get, self.size
        whole = word + self.suffix
        last = len(whole)
        path: list[int] = []
        ends: list[int] = [0]
        failed: set[int] = set()
        state = start = 0
        while start < n:
            for length in lengths(whole[start : start + HEAD], short):
                end = start + length
                if end >= n:  # the word's last token has the whole suffix
                    if end != last:
                        continue
                    end = n
                if end in failed:
                    continue
                token = ids(whole[start : start + length])
                if token is None or (born[token] < 0 and end - start > 1):
                    continue
                arc = arcs(state * size + token)
                if self.has_arc(state, token) if arc is None else arc:
                    path.append(token)
                    ends.append(end)
                    state, start = behind[token][-1], end
                    break
            else:
                if not path:
                    raise ValueError(f"no token path for {word!r}")
                failed.add(ends.pop())
                path.pop()
                start = ends[-1]
                state = behind[path[-1]][-1] if path else 0
        return path

    def decode(self, tokens: list[int]) -> list[str]:
        """Arc labels of a token path."""
        return [self.labels[t] for t in tokens]


class Codec:
    """Encodes and decodes whole texts as the definition says, with a cache of text chunks."""

    def __init__(self, definition: str) -> None:
        from tokenizers import Tokenizer

        parsed = json.loads(definition)
        model = parsed["model"]
        library = Tokenizer.from_str(definition)
        # normalisation and splitting into words are the definition's own
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.automaton = Automaton(
            model["vocab"], model["merges"], model["end_of_word_suffix"] or ""
        )
        self.specials = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        labels = dict(enumerate(self.automaton.labels)) | {i: t for t, i in self.specials.items()}
        self.pieces = [labels.get(i, "") + " " for i in range(max(labels) + 1)]
        self._special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")")
        self.joined, self.known = Recent(CHUNK_BYTES), Recent(WORD_BYTES)
        # the short way knows words that the rules lower-case and keep whole
        self.latin = all(
            self.words(probe) == [byte_symbols(w) for w in wanted]
            for probe, wanted in (("Straße,", ["straße", ","]), ("NAÏVE...", ["naïve", "..."]))
        )

    def words(self, part: str) -> list[str]:
        """Byte symbols of the words of a chunk, by the definition's own rules."""
        text = self.normalizer.normalize_str(part) if self.normalizer else part
        return [word for word, _ in self.splitter.pre_tokenize_str(text)]

    def word(self, word: str) -> bytes:
        """Tokens of one word, four bytes each."""
        # a plain word is spelled as the chunk that it is alone
        table = self.joined if self.latin and _simple(word) else self.known
        known = table.get(word)
        if known is None:
            known = array("i", self.automaton.encode(word)).tobytes()
            table.put(word, known)
        return known

    def chunk(self, chunk: str) -> bytes:
        """Tokens of a chunk without blanks; a special string is one token."""
        if self.latin:
            plain = _plain.fullmatch(chunk.lower())
            if plain:
                word, marks = plain.groups()
                tokens = self.word(word if word.isascii() else byte_symbols(word))
                return tokens + self.word(marks) if marks else tokens
        out = []
        for part in self._special.split(chunk) if self.specials else [chunk]:
            if part in self.specials:
                out.append(array("i", [self.specials[part]]).tobytes())
            elif part:
                out += map(self.word, self.words(part))
        return b"".join(out)

    def spelled(self, chunk: str) -> bytes:
        """Tokens of a chunk that the table lacks, kept for the next time."""
        known = self.joined.get(chunk)
        if known is None:
            known = self.chunk(chunk)
            if not (self.latin and _simple(chunk)):  # else kept as a word
                self.joined.put(chunk, known)
        return known

    def encode(self, text: str) -> np.ndarray:
        """Tokens of a whole text.

        Words never hold a blank and no rule looks across one, so blanks cut a text into chunks
        that are encoded apart.
        """
        chunks = _blank.split(text) if _odd.search(text) else text.split()
        # one pass over the table for all chunks; what it lacks is looked at one by one
        found = list(map(self.joined.young.get, chunks))
        if None in found:
            for i, known in enumerate(found):
                if known is None:
                    found[i] = self.spelled(chunks[i])
        return np.frombuffer(b"".join(found), np.int32)

    def decode(self, tokens: np.ndarray) -> str:
        """Labels of a text's tokens, joined by blanks."""
        pieces = self.pieces
        return "".join([pieces[t] for t in tokens.tolist()])[:-1]


def codec(definition: str) -> Codec:
    """This worker's codec, until it works for another operator. What building it took goes back."""
    return worker.keep(("bpe", definition), lambda: worker.trimmed(Codec(definition)))


def encode_documents(
    documents: DataFrame, tokenizer_file: str, ids: bool = True, decoded: bool = True
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per document, with `ids` also the token ids
    as array<int>, and with `decoded` the decoded text. The digests are taken from these two.

    `tokenizer_file` is a definition for the tokenizers library whose words end in a suffix; it
    is read on the driver and broadcast.
    """
    definition = Path(tokenizer_file).read_text(encoding="utf-8")
    shared = documents.sparkSession.sparkContext.broadcast(definition)
    schema = "doc_id bigint, n_tokens bigint, ids array<int>, decoded string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = codec(shared.value)
        for batch in (b.slice(i, BATCH) for b in batches for i in range(0, b.num_rows, BATCH)):
            spelled = [one.encode(text.as_py() or "") for text in batch.column("text")]
            texts = list(map(one.decode, spelled))
            counts = list(map(len, spelled))
            offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
            columns = [
                batch.column("doc_id"),
                pa.array(counts, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(spelled))),
                pa.array(texts, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            worker.trim()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.mapInArrow(worker.trimming(run), schema).select(
        "doc_id",
        "n_tokens",
        F.sha2(joined, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(["ids"] if ids else []),
        *(["decoded"] if decoded else []),
    )
