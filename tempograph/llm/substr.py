"""Operator 6: removal of repeated word spans by De Bruijn compaction.

Each window of 50 words is an edge of the De Bruijn graph of words. The 26
word 25-mers inside a window have a smallest hash, its minimizer; neighbouring
windows mostly share it, so a document falls into short paths of edges, about
one for every 14 words, of which only the minimizer, a digest of the path's
words and its source coordinates are kept. Equal windows have equal
minimizers, so through Spark joins on the minimizer:

* a minimizer in one document only ends there, no window of it repeats;
* one whose paths are all equal does not branch: the path is compacted, and
  its windows start first where the path does;
* at the others paths branch. One path of each kind is read again at its
  source coordinates and split into its windows, whose digests are joined.

Digests are of the words themselves (128 bits, beside the minimizer's 64), so
equal ones verify equal spans. A hot passage has one row per document in the
first grouping, which is pre-aggregated, and one path in the last; where its
documents get to know the passage's class, the class is broadcast.

Null and empty texts have no words and stay. Rows with equal ids count as one
document; equal rows are cut up once for each, and treated alike. Rows with a
null id keep all words and repeat nothing. An empty table gives no rows. A text
must fit into memory with its words. Other columns are passed on by
``deduplicate``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import HEAVY, cut, join_classes, slices, stored, utf8

WINDOW, KMER = 50, 25
#: Words whose hashes a task remembers.
WORDS = 100_000

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_BASE = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = WordHashes()


def word_ids(words: list[bytes]) -> np.ndarray:
    if len(_hashes) > WORDS:
        _hashes.clear()
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def runs(ids: np.ndarray, n: int) -> np.ndarray:
    """A mixed hash of each run of n ids, put together from runs of powers of two."""
    with np.errstate(over="ignore"):
        power, size, out, done, b = ids, 1, None, 0, _BASE
        while True:
            if n & size:
                if out is None:
                    out = power
                else:
                    k = len(ids) - done - size + 1
                    out = out[:k] * np.uint64(pow(_BASE, size, 1 << 64)) + power[done : done + k]
                done += size
            if size * 2 > n:
                break
            k = len(power) - size
            power = power[:k] * np.uint64(b) + power[size : size + k]
            size, b = size * 2, b * b % (1 << 64)
        h = out ^ (out >> np.uint64(33))
        h = h * _MIX
        return h ^ (h >> np.uint64(29))


def lowest(h: np.ndarray, n: int) -> np.ndarray:
    """The minimum of each run of n."""
    size, m = 1, h
    while size * 2 <= n:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - n + 1], m[n - size : n - size + len(h) - n + 1])


def paths(words: list[bytes], window: int = WINDOW, kmer: int = KMER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, first window and number of windows of each path; at most as many windows as a minimizer can have."""
    wide = window - kmer + 1
    least = lowest(runs(word_ids(words), kmer), wide)
    starts = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    ends = np.append(starts[1:], len(least))
    if (ends - starts).max() > wide:  # repeated k-mers; where a long path is split does not matter
        starts = np.concatenate([np.arange(a, b, wide) for a, b in zip(starts.tolist(), ends.tolist())])
        ends = np.append(starts[1:], len(least))
    return least[starts].view(np.int64), starts, ends - starts


def _offsets(words: list[bytes]) -> tuple[bytes, list[int]]:
    """The words joined by single spaces, and where each starts, with the end at last."""
    at = np.zeros(len(words) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1, out=at[1:])
    return b" ".join(words), at.tolist()


def _two(digests: list[bytes]) -> tuple[pa.Array, pa.Array]:
    a = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.array(a[:, 0].copy()), pa.array(a[:, 1].copy())


_PATH = "doc_id long, content long, minimizer long, d1 long, d2 long, start int, windows int"


def _path_rows(window: int, kmer: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in slices(batches):
            cols: list[list] = [[], [], [], [], []]
            digests: list[bytes] = []
            for doc, text, content in zip(b["doc_id"].to_pylist(), utf8(b["text"]), b["content"].to_pylist()):
                w = text.split()
                if len(w) < window:
                    continue
                mins, starts, n = paths(w, window, kmer)
                joined, at = _offsets(w)
                digests += [digest(joined[at[s] : at[s + k + window - 1] - 1]) for s, k in zip(starts.tolist(), n.tolist())]
                for col, x in zip(cols, (np.full(len(n), doc), np.full(len(n), content), mins, starts.astype(np.int32), n.astype(np.int32))):
                    col.append(x)
            if digests:
                d1, d2 = _two(digests)
                doc, content, mins, starts, n = (pa.array(np.concatenate(c)) for c in cols)
                yield pa.RecordBatch.from_arrays([doc, content, mins, d1, d2, starts, n], ["doc_id", "content", "minimizer", "d1", "d2", "start", "windows"])

    return run


def _window_rows(window: int):
    """Splits the listed paths of a text into windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for b in slices(batches):
            path: tuple[list, list, list] = ([], [], [])
            place: list[int] = []
            digests: list[bytes] = []
            for text, listed in zip(utf8(b["text"]), b["listed"].to_pylist()):
                joined, at = _offsets(text.split())
                for p in listed:
                    for k in range(p["windows"]):
                        s = p["start"] + k
                        digests.append(digest(joined[at[s] : at[s + window] - 1]))
                        place.append(k)
                        for col, x in zip(path, (p["d1"], p["d2"], p["first"])):
                            col.append(x)
            if digests:
                w1, w2 = _two(digests)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in path), pa.array(place, pa.int32()), w1, w2], ["d1", "d2", "first", "place", "w1", "w2"])

    return run


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, content (a hash of the text) and spans (start, end of words) of all windows that start in a document with a smaller id too."""
    named = _documents(docs, id_col, text_col).where("doc_id is not null")
    path = stored(named.mapInArrow(_path_rows(window, kmer), _PATH), "paths")
    total = path.count()
    kinds = path.groupBy("minimizer", "d1", "d2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n"))
    of_each = kinds.groupBy("minimizer").agg(F.count("*").alias("n_kinds"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"))
    kinds_of = cut(of_each.where((F.col("first") < F.col("last")) | (F.col("n") > total // HEAVY)))
    again = stored(join_classes(path, kinds_of, "minimizer", "doc_id", total, wanted="first < last").drop("last"), "repeated")
    span_end = (F.col("start") + F.col("windows") + (window - 1)).alias("end")
    whole = again.where("n_kinds = 1 and doc_id > first").select("doc_id", "content", "start", span_end)

    branching = again.where("n_kinds > 1").withColumn("path", F.concat_ws(":", "d1", "d2"))
    sources = cut(branching.groupBy("path", "d1", "d2").agg(F.min(F.struct("doc_id", "content", "start", "windows")).alias("s"), F.count("*").alias("n")).select("path", "d1", "d2", "n", "s.*"))
    listed = sources.groupBy("doc_id", "content").agg(F.collect_list(F.struct("d1", "d2", F.col("doc_id").alias("first"), "start", "windows")).alias("listed"))
    # A row that is repeated is read once.
    read = named.join(listed.hint("shuffle_hash"), ["doc_id", "content"]).dropDuplicates(["doc_id", "content"]).select("text", "listed")
    split = stored(read.mapInArrow(_window_rows(window), "d1 long, d2 long, first long, place int, w1 long, w2 long"), "windows")
    starts = split.groupBy("w1", "w2").agg(F.min("first").alias("first"), F.max("first").alias("last"), F.count("*").alias("n"))
    # A window of one path only repeats with the path itself; the rest start first in the smallest of their paths' documents.
    per_path = split.drop("first").join(starts.where("n > 1 and first < last").select("w1", "w2", "first"), ["w1", "w2"]).groupBy(F.concat_ws(":", "d1", "d2").alias("path")).agg(F.collect_set(F.struct("place", "first")).alias("earlier"))
    classes = cut(sources.select("path", "n", F.col("doc_id").alias("source")).join(per_path, "path", "left"))
    some = join_classes(branching, classes, "path", "doc_id", branching.count())
    own = F.col("source") < F.col("doc_id")
    all_of_it = some.where(own).select("doc_id", "content", "start", span_end)
    few = some.where(~own & F.col("earlier").isNotNull()).select("doc_id", "content", "start", F.explode(F.filter("earlier", lambda e: e["first"] < F.col("doc_id"))).alias("e")).select("doc_id", "content", (F.col("start") + F.col("e.place")).alias("start")).withColumn("end", F.col("start") + window)
    return whole.unionByName(all_of_it).unionByName(few).groupBy("doc_id", "content").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def deduplicate(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, only_digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, text (kept words joined by one space; the text as it was if none goes) or, with only_digest, kept_sha256; and the columns of docs named in keep."""
    keep = keep or []
    spans = repeated_spans(docs, window, kmer, id_col, text_col)
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("content"), F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("kept"))
    kept_type = rows.schema["kept"].dataType.simpleString()
    joined = rows.join(spans.hint("shuffle_hash"), ["doc_id", "content"], "left").select("doc_id", "text", "kept", "spans")
    name, kind = ("kept_sha256", "string") if only_digest else ("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n, gone, out = [], [], []
            for t, raw, s in zip(utf8(b["text"]), b["text"], b["spans"].to_pylist()):
                w = t.split()
                n.append(len(w))
                left: list[bytes] = w
                if s:
                    left, at = [], 0
                    for x in s:
                        left += w[at : x["start"]]
                        at = max(at, x["end"])
                    left += w[at:]
                gone.append(len(w) - len(left))
                if only_digest:
                    out.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    out.append(b" ".join(left).decode() if len(left) < len(w) else raw.as_py())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["kept"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(out, pa.string())], ["doc_id", "kept", "n_words", "n_removed", name])

    done = joined.mapInArrow(run, f"doc_id long, kept {kept_type}, n_words long, n_removed long, {name} {kind}")
    return done.select("doc_id", "n_words", "n_removed", name, *[F.col("kept")[c].alias(c) for c in keep])


def op6(docs: DataFrame) -> DataFrame:
    """The counts and digests of every document."""
    return deduplicate(docs, only_digest=True)

