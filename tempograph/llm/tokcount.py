"""Operator 7: token counts by a compiled finite-state tokenizer.

The vocabulary's merges are compiled, as far as texts ask for it, into a
deterministic transducer over bytes. A state holds the longest end of the
input that some token may still go on from, and for each border in it the last
token and the count of tokens before it. A transition is annotated with the
number of tokens that it emits (net: a longer token may take the place of two).

Texts are cut into chunks anywhere. What has been read since the last white
space is a text's state there. A chunk's state map takes any state to the
tokens that end within the chunk and to the next state. It is constant behind
the chunk's first white space; before it, it is kept as the input that it
reads. So a map is (head, count, tail), maps compose associatively, and a
prefix scan gives the count before each chunk and at the end: the maps of
``FAN`` neighbouring chunks are scanned as a balanced tree, each such block in
its own row, and then the blocks' maps of a text are scanned with one another.

Null and empty texts have no tokens; repeated rows and ids give a row each; an
empty table gives no rows; other columns are not looked at and not returned. A
text of any length works; only what stands between two white spaces must fit
into memory at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import normalizers

from tempograph.llm.common import doc_columns, slices, strings, tokenizer_path
from tempograph.llm.merges import Merges

#: Characters of a chunk; words and states that a task remembers; the longest word it keeps.
CHUNK, WORDS, STATES, WORD_CHARS = 65_536, 500_000, 300_000, 64
LIMIT = 2048
#: Chunks of a block of the scan: blocks of a text are as few again, as a row holds at most 2**31 bytes.
FAN = 256

#: The pre-tokenizer's pattern (fixed value); white space is no part of a word.
TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0  -     　\p{L}\p{N}]+")
#: White space that no normalisation joins with its neighbours.
BLANK = re.compile(r"[\t-\r ]")


class ChunkMap(NamedTuple):
    """What a chunk does to any state: reads head, emits count tokens between blanks, and stays within tail; joined: it has no blank, and all of it is head."""

    head: str
    count: int
    tail: str
    joined: bool


NOTHING = ChunkMap("", 0, "", True)


class Transducer:
    """Counts the tokens of byte strings; states and transitions are compiled when first met."""

    START = -1

    def __init__(self, merges: Merges):
        self.merges = merges
        self.open = {t[:n] for t in [*merges.inner, *merges.final] for n in range(1, len(t))}
        self.reset()

    def reset(self) -> None:
        start = (b"", (self.START,), (0,))
        self.ids = {start: 0}
        self.states = [start]
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.end: list[dict[int, int]] = [{}]

    def _last(self, tail: bytes, tokens: tuple[int, ...], known: dict[bytes, int]) -> tuple[int, int]:
        """The token that the input ends with, and the place of the border before it."""
        for at in range(len(tail)):
            t = known.get(tail[at:])
            if t is not None and (tokens[at] == self.START or self.merges.apart(tokens[at], t)):
                return t, at
        raise ValueError(f"no token ends {tail!r}")

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        tail, tokens, counts = self.states[state]
        tail += bytes([byte])
        t, at = self._last(tail, tokens, self.merges.inner)
        emitted = counts[at] + 1
        tokens, counts = (*tokens, t), (*counts, emitted)
        cut = next((k for k in range(len(tail)) if tail[k:] in self.open), len(tail))
        key = (tail[cut:], tokens[cut:], tuple(c - emitted for c in counts[cut:]))
        to = self.ids.get(key)
        if to is None:
            to = self.ids[key] = len(self.states)
            self.states.append(key)
            self.next.append({})
            self.end.append({})
        made = self.next[state][byte] = (to, emitted)
        return made

    def _finish(self, state: int, byte: int) -> int:
        tail, tokens, counts = self.states[state]
        _, at = self._last(tail + bytes([byte]), tokens, self.merges.final)
        made = self.end[state][byte] = counts[at] + 1
        return made

    def count(self, word: bytes) -> int:
        """Tokens of one word, from the start state to its end."""
        if len(self.states) > STATES:
            self.reset()
        state = total = 0
        steps = self.next
        for byte in word[:-1]:
            go = steps[state].get(byte)
            state, n = go if go is not None else self._step(state, byte)
            total += n
        n = self.end[state].get(word[-1])
        return total + (n if n is not None else self._finish(state, word[-1]))


class Counter:
    """Token counts of texts and state maps of chunks."""

    def __init__(self, path: str):
        merges = Merges(path)
        self.machine = Transducer(merges)
        # The library's tables of letters are newer than Python's.
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.special = re.compile("(" + "|".join(map(re.escape, merges.special)) + ")")
        self.marks = tuple(merges.special)
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of what stands between blanks."""
        if any(m in word for m in self.marks):
            parts = self.special.split(word)
            return len(parts) // 2 + sum(self._plain(x) for x in parts[::2])
        return self._plain(word)

    def _plain(self, word: str) -> int:
        word = word.lower() if word.isascii() else self.normal(word)
        return sum(self.machine.count(t.encode()) for t in TOKENS.findall(word))

    def total(self, words: list[str]) -> int:
        known = self.words
        if len(known) > WORDS:
            known.clear()
        long = []
        for w in {w for w in words if w not in known}:
            known[w] = self.word(w)
            if len(w) > WORD_CHARS:
                long.append(w)
        n = sum(map(known.__getitem__, words))
        for w in long:
            del known[w]
        return n

    def chunk(self, text: str) -> ChunkMap:
        first = BLANK.search(text)
        if first is None:
            return ChunkMap(text, 0, "", True)
        words = split_blanks(text)
        tail = words.pop() if text[-1] not in "\t\n\v\f\r " else ""
        head = words.pop(0) if first.start() else ""
        return ChunkMap(head, self.total(words), tail, False)

    def join(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First a, then b."""
        if a.joined and b.joined:
            return ChunkMap(a.head + b.head, 0, "", True)
        if a.joined:
            return ChunkMap(a.head + b.head, b.count, b.tail, False)
        if b.joined:
            return ChunkMap(a.head, a.count, a.tail + b.head, False)
        middle = a.tail + b.head
        return ChunkMap(a.head, a.count + b.count + (self.word(middle) if middle else 0), b.tail, False)

    def before(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """The composition of all maps before each one, and of all of them; neighbours are joined in pairs first, up a balanced tree and down again."""
        if len(maps) < 2:
            return [NOTHING, *maps]
        evens = self.before([self.join(*maps[k : k + 2]) for k in range(0, len(maps) - 1, 2)])
        out = []
        for k, m in enumerate(maps):
            out.append(self.join(evens[k // 2], maps[k - 1]) if k % 2 else evens[k // 2])
        return [*out, self.join(out[-1], maps[-1]) if len(maps) % 2 else evens[-1]]

    def ended(self, m: ChunkMap) -> int:
        """Tokens that have ended by the last white space, from the start state."""
        return 0 if m.joined else m.count + (self.word(m.head) if m.head else 0)

    def applied(self, m: ChunkMap) -> int:
        """Tokens that the whole input emits from the start state."""
        return m.count + sum(self.word(w) for w in (m.head, m.tail) if w)


def split_blanks(text: str) -> list[str]:
    """The words between the six ASCII blanks; str.split() alone would cut at other white space too, which normalisation may change."""
    return text.split() if text.isascii() and not ASCII_MORE.search(text) else [w for w in BLANK.split(text) if w]


#: Separators that str.split() takes for white space and the tokenizer does not.
ASCII_MORE = re.compile(r"[\x1c-\x1f]")
_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def chunk_maps(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each text: row (a number of the input row), doc_id, seq, n_bytes and the chunk's state map."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in slices(batches):
            rows = []
            for row, doc, text in zip(b["row"].to_pylist(), b["doc_id"].to_pylist(), strings(b["text"])):
                for seq, at in enumerate(range(0, max(1, len(text)), chunk)):
                    part = text[at : at + chunk]
                    rows.append((row, doc, seq, len(part.encode()), *count.chunk(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), CHUNK_TYPES)], CHUNK_NAMES)

    numbered = doc_columns(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(run, "row long, doc_id long, seq int, n_bytes long, head string, count long, tail string, joined boolean")


CHUNK_NAMES = ["row", "doc_id", "seq", "n_bytes", "head", "count", "tail", "joined"]
CHUNK_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]


def _map_column() -> Column:
    return F.struct("head", "count", "tail", "joined").alias("map")


def _of(m: dict) -> ChunkMap:
    return ChunkMap(m["head"], m["count"], m["tail"], m["joined"])


def scanned_blocks(maps: DataFrame, path: str, fan: int = FAN) -> DataFrame:
    """A row for each block of a text's chunks: row, block, doc_id, n_bytes, its state map, and within: the count before each of its chunks (null if no white space has come yet), relative to its beginning."""
    lists = maps.groupBy("row", F.expr(f"seq div {fan}").cast("int").alias("block")).agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("seq", _map_column()))).alias("maps"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches):
            totals, within = [], []
            for maps in b["maps"].to_pylist():
                *before, total = c.before([_of(m["map"]) for m in maps])
                totals.append(total)
                within.append([None if m.joined else m.count for m in before])
            cols = [pa.array(x, t) for x, t in zip(zip(*totals), CHUNK_TYPES[4:])]
            yield pa.RecordBatch.from_arrays([b["row"], b["block"], b["doc_id"], b["n_bytes"], *cols, pa.array(within, pa.list_(pa.int64()))], ["row", "block", "doc_id", "n_bytes", *CHUNK_NAMES[4:], "within"])

    return lists.mapInArrow(run, "row long, block int, doc_id long, n_bytes long, head string, count long, tail string, joined boolean, within array<long>")


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Token and byte counts of each text: doc_id, n_bytes, n_tokens, over_limit, and chunk_starts, the tokens that ended before each chunk."""
    blocks = scanned_blocks(chunk_maps(docs, path, id_col, text_col, chunk), path, fan)
    lists = blocks.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum("n_bytes").alias("n_bytes"), F.sort_array(F.collect_list(F.struct("block", _map_column(), "within"))).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in slices(batches):
            totals, starts = [], []
            for blocks in b["blocks"].to_pylist():
                maps = [_of(x["map"]) for x in blocks]
                *before, total = c.before(maps)
                totals.append(c.applied(total))
                at = []
                for x, m, p in zip(blocks, maps, before):
                    first = c.ended(c.join(p, m._replace(count=0))) if any(n is not None for n in x["within"]) else 0
                    at += [c.ended(p) if n is None else first + n for n in x["within"]]
                starts.append(at)
            n = pa.array(totals, pa.int64())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["n_bytes"], n, pa.array([t > limit for t in totals]), pa.array(starts, pa.list_(pa.int64()))], ["doc_id", "n_bytes", "n_tokens", "over_limit", "chunk_starts"])

    return lists.select("doc_id", "n_bytes", "blocks").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, chunk_starts array<long>")


def op7(docs: DataFrame) -> DataFrame:
    """The counts of every document."""
    return count_tokens(docs, tokenizer_path("word_bpe_49k.json")).drop("chunk_starts")
