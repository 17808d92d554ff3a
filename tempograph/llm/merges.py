"""Byte-pair merges: which tokens can stand side by side, and the last-token states that follow from it.

A sequence of tokens is the BPE encoding of its text exactly if no pair of
neighbours would have been merged across their border. So the encoding of a
prefix is fixed by its last token and by the encoding of the shorter prefix
before that token. That is what the prefix trie and the counting transducer
propagate.
"""

from __future__ import annotations

import json

#: Entries of the memo of neighbours; it is emptied when full.
PAIRS = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself if visible, else the next code point from 256."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Merges:
    """Tokens of a byte-level vocabulary and its merges, as byte strings and ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        symbols, end = byte_symbols(), model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.has_end = bool(end)
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}  # tokens that close a word
        self.bytes_of: dict[int, bytes] = {i: s.encode() for s, i in self.special.items()}
        ids = model["vocab"]
        for token, i in ids.items():
            closes = bool(end) and token.endswith(end)
            body = token[: -len(end)] if closes else token
            if all(c in symbols for c in body):
                raw = bytes(symbols[c] for c in body)
                (self.final if closes else self.inner)[raw] = i
                self.bytes_of.setdefault(i, raw)
        if not end:
            self.final = self.inner
        self.longest = max(map(len, {*self.inner, *self.final}))
        self.rank: dict[tuple[int, int], int] = {}
        self.born: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for at, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, made = (ids[a], ids[b]), ids[a + b]
            self.rank.setdefault(pair, at)
            if made not in self.born:
                self.born[made], self.parts[made] = at, pair
        self.memo: dict[tuple[int, int], bool] = {}
        self.reach: dict[bytes, int] = {}  # by the last three bytes, the length of the longest inner token that ends so
        for t in self.inner:
            self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 2))

    def apart(self, a: int, b: int) -> bool:
        """True if the merges leave the border between the neighbours a and b alone."""
        known = self.memo.get((a, b))
        if known is None:
            if len(self.memo) >= PAIRS:
                self.memo.clear()
            known = self.memo[a, b] = self._decide(a, b)
        return known

    def _decide(self, a: int, b: int) -> bool:
        # Go back in time: undo the younger of the two tokens at the border, and look whether the
        # two symbols that met there could have merged before one of them was used up. Of equal
        # merges the left one comes first.
        rank, born, parts = self.rank, self.born, self.parts
        until = len(rank) + 1
        while True:
            r = rank.get((a, b))
            if r is not None and r < until:
                return False
            age_a, age_b = born.get(a, -1), born.get(b, -1)
            if age_a > age_b:
                until, a = age_a, parts[a][1]
            elif age_b >= 0:
                until, b = age_b + 1, parts[b][0]
            else:
                return True
