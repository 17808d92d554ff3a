"""Operator 2: BPE encoding and decoding over a prefix-sharing trie.

The distinct words of a few hundred documents that are not yet known go into a
trie (a sorted list of words is its depth-first order). Going down, each node
gets the last token of its prefix from the states above it, so shared prefixes
are encoded once. Documents are then put together from their words. Nothing is
shuffled: each task has its own bounded memory of words, which a retried task
builds again and which goes when the task ends, so that workers that wait hold
no more than the vocabulary.

Null and empty texts have no tokens; repeated rows and ids give a row each;
other columns are not looked at and not returned. A text of any length works:
beyond ``LONG`` characters it is worked off in parts that end at single spaces,
where tokens never meet.
"""

from __future__ import annotations

import hashlib
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tempograph.llm.common import doc_columns, slices, strings, tokenizer_path
from tempograph.llm.merges import Merges

#: Words, and parts of words, of a generation that a task remembers; it keeps no part of more characters.
WORDS, PARTS, PART_CHARS = 100_000, 200_000, 64
LONG = 1_000_000

#: White space as the tokenizer sees it (fixed values).
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The pre-tokenizer's pattern (fixed value), with white space spelt out.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A single space between other characters: a piece starts there whatever stands around it.
CUT = re.compile(r"(?<=\S) (?=\S)")
LOOSE = re.compile(r"\s\s")


def trie_encode(merges: Merges, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
    """Each distinct word with its token ids; words that share a prefix share its states."""
    tokens: list[int] = []
    lengths: list[int] = []
    before = b""
    known, reach, memo, apart = merges.inner, merges.reach, merges.memo, merges.apart
    for word in sorted(set(words)):
        same = 0
        for x, y in zip(before, word):
            if x != y:
                break
            same += 1
        del tokens[same:], lengths[same:]
        for end in range(same + 1, len(word) + 1):
            n = end if end < 3 else min(end, reach.get(word[end - 3 : end], 2))
            while True:  # just one of the tokens that end here follows what stands before it
                t = known.get(word[end - n : end])
                if t is not None:
                    if n == end:
                        break
                    pair = (tokens[end - n - 1], t)
                    if memo[pair] if pair in memo else apart(*pair):
                        break
                n -= 1
            tokens.append(t)
            lengths.append(n)
        ids, end = [], len(word)
        while end:
            ids.append(tokens[end - 1])
            end -= lengths[end - 1]
        yield word, ids[::-1]
        before = word


def packed(ids: Iterable[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def unpacked(data: bytes) -> array:
    a = array("I")
    a.frombytes(data)
    if sys.byteorder == "big":
        a.byteswap()
    return a


class Recent:
    """What has been found for keys that were asked for lately, in two generations; the older one goes when the younger one is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, wanted: set[str], most: int) -> list[str]:
        """Those of the wanted keys that are in neither generation; the others are in the younger one then."""
        new = [k for k in wanted if k not in self.young]
        if len(self.young) + len(new) > most:
            self.old, self.young, new = self.young, {}, list(wanted)
        self.young.update((k, self.old[k]) for k in new if k in self.old)
        return [k for k in new if k not in self.old]


class Encoder:
    """Encodes and decodes texts; keeps the ids of up to twice WORDS words, each with and without a space before it."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        self.special = re.compile("(" + "|".join(map(re.escape, self.merges.special)) + ")") if self.merges.special else None
        self.forget()

    def forget(self) -> None:
        """Only the vocabulary stays in memory."""
        self.spaced, self.bare, self.pieces = Recent(), Recent(), Recent()  # spaced: by the word after a single space
        self.merges.memo.clear()

    def parts(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """The words of a text, cut at single spaces; True if the first one has no space before it."""
        at, bare = 0, True
        while at < len(text):
            end = len(text)
            if end - at > LONG and (m := CUT.search(text, at + LONG)):
                end = m.start()
            part = text[at:end]
            yield bare, CUT.split(part) if LOOSE.search(part) or part[0].isspace() or part[-1].isspace() else part.split(" ")
            at, bare = end + 1, False

    def plan(self, text: str) -> list[tuple[bool, list[str]] | int]:
        """Words and special ids of a text, in order."""
        if self.special is None or not any(s in text for s in self.merges.special):
            return list(self.parts(text))
        out: list = []
        for k, x in enumerate(self.special.split(text)):
            out += [self.merges.special[x]] if k % 2 else self.parts(x)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        at = 0
        while at < len(texts):  # some texts at a time, a long one alone
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= LONG):
                chars += len(texts[end])
                end += 1
            plans = [self.plan(t) for t in texts[at:end]]
            self._learn(plans)
            for k, plan in enumerate(plans, at):
                out[k] = b"".join(self._put(x) for x in plan)
            for known, w in self.once:
                known.young.pop(w, None)
            at = end
        return out

    def _put(self, x: tuple[bool, list[str]] | int) -> bytes:
        if isinstance(x, int):
            return packed([x])
        bare, words = x
        get = self.spaced.young.__getitem__
        return self.bare.young[words[0]] + b"".join(map(get, words[1:])) if bare else b"".join(map(get, words))

    def _learn(self, plans: list) -> None:
        spaced: set[str] = set()
        bare: set[str] = set()
        self.once = []  # long words are not worth their place once the texts are put together
        for plan in plans:
            for x in plan:
                if not isinstance(x, int):
                    if x[0]:
                        bare.add(x[1][0])
                        spaced.update(x[1][1:])
                    else:
                        spaced.update(x[1])
        for known, wanted, before in ((self.spaced, spaced, " "), (self.bare, bare, "")):
            missing = known.missing(wanted, WORDS)
            self.once += [(known, w) for w in missing if len(w) > PART_CHARS]
            known.young.update(zip(missing, self._encode_words([before + w for w in missing])))

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words, each encoded as a text of its own."""
        split = [PIECES.findall(w) for w in words]
        self._learn_pieces({p for x in split for p in x})
        out = [b"".join(map(self.pieces.young.__getitem__, x)) for x in split]
        for p in [p for x in split for p in x if len(p) > PART_CHARS]:
            self.pieces.young.pop(p, None)
        return out

    def _learn_pieces(self, pieces: set[str]) -> None:
        missing = {p.encode(): p for p in self.pieces.missing(pieces, PARTS)}
        self.pieces.young.update((missing[w], packed(ids)) for w, ids in trie_encode(self.merges, missing))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that are not UTF-8 become U+FFFD."""
        return b"".join(map(self.merges.bytes_of.__getitem__, unpacked(ids))).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", emit_ids: bool = True) -> DataFrame:
    """Encodes each text and decodes it again.

    Returns doc_id, ids (packed; only with emit_ids), n_tokens, ids_sha256,
    decoded_sha256, one row for each input row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches):
            ids = enc.encode(strings(b["text"]))
            cols = {
                "doc_id": b["doc_id"],
                "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string()),
            }
            if emit_ids:
                cols["ids"] = pa.array(ids, pa.binary())
            yield pa.RecordBatch.from_pydict(cols)
        enc.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * emit_ids
    return doc_columns(docs, id_col, text_col).mapInArrow(run, schema)


def op2(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    return encode_documents(docs, tokenizer_path("byte_bpe_50k.json"), emit_ids=False)
