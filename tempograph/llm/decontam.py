"""Operator 1: benchmark decontamination.

The benchmark's word windows go into a broadcast hash set, in slices of at
most ``SLICE_WORDS`` words, so no broadcast grows with the benchmark; a longer
item is cut into parts that overlap by a window, and a larger benchmark is
scanned for slice by slice. Each task turns texts into word ids, rolls a hash
over the ids, looks the hashes up, and verifies every hit word by word. Texts
stay where they are; with several slices the documents are first written to the
shared folder, so that a row keeps its number, and only hit spans are shuffled.

Null and empty texts have no words and no hits. Items without words, or with a
null id, are left out; equal items are all reported. Repeated documents and
null ids give a row each. An empty table of documents gives no rows, an empty
benchmark no hits. A text must fit into memory with its words. Other columns
are passed on where rows are filtered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import cut, slices, stored, utf8

#: Words of a window, words of benchmark text in one broadcast, and bytes that count as a word at least.
WINDOW, SLICE_WORDS, WORD_BYTES = 13, 1_000_000, 16
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BITS = 22


def words(text: bytes) -> list[bytes]:
    """Lower-case words of letters, digits and all that is not ASCII."""
    return text.translate(_LOWER).split()


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n ids."""
    k = len(ids) - n + 1
    h = np.zeros(k, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            h = h * _BASE + ids[j : j + k]
        return h ^ (h >> np.uint64(29))


class Windows:
    """The windows of one length: their distinct hashes in order, where the words of one such window lie, and the items that have it."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, owners: np.ndarray, n: int):
        h = rolled(ids, n)[starts]
        order = np.lexsort((owners, h))
        h, starts, owners = h[order], starts[order], owners[order]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        self.n, self.ids, self.hashes, self.starts = n, ids, h[first], starts[first]
        self.bitmap = np.zeros(1 << _BITS, np.bool_)
        self.bitmap[(self.hashes >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        group = np.cumsum(np.bincount(first, minlength=len(h))) - 1
        same = self._equal(ids, self.starts[group], starts)
        # Other words under the same hash are kept aside.
        self.others: dict[bytes, set[int]] = {}
        for at, owner in zip(starts[~same].tolist(), owners[~same].tolist()):
            self.others.setdefault(ids[at : at + n].tobytes(), set()).add(owner)
        self.owners = owners[same]
        self.upto = np.concatenate(([0], np.cumsum(np.bincount(group[same], minlength=len(first)))))

    def _equal(self, ids: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether the words of own windows are those of ids at some places."""
        out = np.ones(len(at), np.bool_)
        for j in range(self.n):
            out &= self.ids[own + j] == ids[at + j]
        return out

    def hits(self, ids: np.ndarray) -> tuple[list[int], set[int]]:
        """Where windows begin in a text's word ids, and the items that have them."""
        h = rolled(ids, self.n)
        at = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at):
            return [], set()
        group = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        there = self.hashes[group] == h[at]
        at, group = at[there], group[there]
        same = self._equal(ids, self.starts[group], at)
        items: set[int] = set()
        for g in np.unique(group[same]).tolist():
            items.update(self.owners[self.upto[g] : self.upto[g + 1]].tolist())
        found = at[same].tolist()
        for k in at[~same].tolist() if self.others else ():
            if owners := self.others.get(ids[k : k + self.n].tobytes()):
                items |= owners
                found.append(k)
        return found, items


class WindowSet:
    """Windows of some items as arrays of word ids."""

    def __init__(self, items: list[tuple[int, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        parts, starts, owners = [], {}, {}
        at = 0
        for item, text in items:
            w = words(text)
            n = min(window, len(w))
            if n:
                parts.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.uint64))
                starts.setdefault(n, []).append(np.arange(at, at + len(w) - n + 1))
                owners.setdefault(n, []).append(np.full(len(w) - n + 1, item))
                at += len(w)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        self.windows = [Windows(ids, np.concatenate(starts[n]), np.concatenate(owners[n]), n) for n in sorted(starts)]

    def hits(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Disjoint spans of hit words, and the items whose windows occur."""
        ids = np.fromiter(map(self.vocabulary.get, w, _zeros()), np.uint64, len(w))
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        for known in self.windows:
            if len(w) >= known.n:
                at, owners = known.hits(ids)
                items |= owners
                found += [(k, k + known.n) for k in at]
        return merged(found), items


def _zeros() -> Iterator[int]:
    while True:
        yield 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans as few disjoint ones in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def item_slices(benchmark: DataFrame, item_col: str, text_col: str, window: int = WINDOW) -> Iterator[list[tuple[int, bytes]]]:
    """The items in lists of at most SLICE_WORDS words, longer ones in overlapping parts; the driver holds one list at a time."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    most = max(SLICE_WORDS, 2 * window)
    items: list[tuple[int, bytes]] = []
    size = 0
    for r in rows.toLocalIterator():
        w = words(r["text"].encode())
        for at in range(0, max(1, len(w) - window + 1), most - window + 1):
            part = w[at : at + most]
            text = b" ".join(part)
            n = max(len(part), len(text) // WORD_BYTES)
            if items and size + n > SLICE_WORDS:
                yield items
                items, size = [], 0
            items.append((r["item_id"], text))
            size += n
    yield items


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Each document with its hit spans.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans
    (of words, end excluded), items, and the columns of docs named in keep.
    """
    spark = docs.sparkSession
    keep = keep or []
    inputs = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("_kept"))
    kept_type = inputs.schema["_kept"].dataType.simpleString()
    parts = []
    lists = item_slices(benchmark, item_col, item_text_col, window)
    waiting = [next(lists), *([more] if (more := next(lists, None)) else [])]
    if len(waiting) > 1:
        inputs = stored(inputs, "documents")
    for items in chain(waiting, lists):
        shared = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = WindowSet(shared.value, window)
            for b in slices(batches):
                n, spans, found = [], [], []
                for text in utf8(b["_text"]):
                    w = words(text)
                    s, i = known.hits(w) if known.windows else ([], set())
                    n.append(len(w))
                    spans.append([{"start": x, "end": y} for x, y in s])
                    found.append(sorted(i))
                yield pa.RecordBatch.from_arrays([b["_id"], b["_row"], b["_kept"], pa.array(n, pa.int64()), pa.array(spans, _SPANS), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "_row", "_kept", "n_words", "spans", "items"])

        parts.append(inputs.mapInArrow(run, f"doc_id long, _row long, _kept {kept_type}, n_words long, spans array<struct<start:int,end:int>>, items array<long>"))
    found = parts[0]
    if len(parts) > 1:  # only rows with hits of the later slices meet the first one's rows
        more = cut(_union([p.where(F.size("spans") > 0).select("_row", "spans", "items") for p in parts[1:]]).groupBy("_row").agg(F.flatten(F.collect_list("spans")).alias("more_spans"), F.flatten(F.collect_list("items")).alias("more_items")))
        empty = F.array()
        found = found.join(more, "_row", "left").withColumns({"spans": F.concat("spans", F.coalesce("more_spans", empty.cast("array<struct<start:int,end:int>>"))), "items": F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", empty.cast("array<long>")))))}).drop("more_spans", "more_items")
        found = found.withColumn("spans", _disjoint("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    joined = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"), "spans", "items", *[F.col("_kept")[c].alias(c) for c in keep]
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _disjoint(name: str) -> F.Column:
    """Spans of several slices as few disjoint ones."""
    kind = "array<struct<start:int,end:int>>"

    def add(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (s["start"] <= F.try_element_at(done, F.lit(-1))["end"]), grown).otherwise(F.concat(done, F.array(s))).cast(kind)

    return F.aggregate(F.array_sort(name), F.array().cast(kind), add)


def remove_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{how.get('id_col', 'doc_id')}`").alias("_scan_id"), F.col(f"`{how.get('text_col', 'text')}`").alias("_scan_text"))
    found = scan(plain, benchmark, **how | {"id_col": "_scan_id", "text_col": "_scan_text", "keep": ["_doc"]})
    return found.where(~F.col("contaminated")).select("_doc.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """doc_id and text of all documents, the text as lower-case words without the hit ones."""
    found = scan(docs.withColumn("_scan_text", F.col(f"`{how.get('text_col', 'text')}`")), benchmark, **how | {"keep": ["_scan_text"]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, spans in zip(utf8(b["_scan_text"]), b["spans"].to_pylist()):
                w = words(text)
                for s in reversed(spans):
                    del w[s["start"] : s["end"]]
                out.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(out, pa.string())], ["doc_id", "text"])

    return found.select("doc_id", "_scan_text", "spans").mapInArrow(run, "doc_id long, text string")


def op1(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The verdict on every document."""
    return scan(docs, benchmark).drop("spans", "items")


def items_digest(items: list[int]) -> str:
    """The digest of item ids as the operator returns it."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
