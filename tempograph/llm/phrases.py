"""Operator 12: phrase collocations by vertical positional inverted lists.

Texts are cut into blocks of one language and a bounded number of words. A block
keeps its words as numbers and, for phrases of each length, an inverted list of
the positions at which each phrase starts. Phrases grow a word at a time: the
positions of a frequent phrase, moved on by its length, meet the postings of the
words that stand there, which gives the lists of the longer phrases; a list's
length is the phrase's exact frequency in the block. Only those lengths are
shuffled, packed for segments of hashes: added up over all blocks by phrase and
next word, they tell which phrases are frequent, and each block hears of its own
and drops the other lists. There are so many segments that one fits into memory.

Two tests spare most phrases the shuffle, and neither can drop a frequent one: a
phrase that starts where the phrase after its first word isn't frequent is left
out at once; and the lists' lengths are first added up by a hash of the phrase,
in a number of buckets that grows with the input up to ``BUCKETS``, as packed
numbers. What falls into a bucket with too few occurrences is no candidate. Of
the buckets only one bit each is broadcast, 32 MiB at most; in inputs so large that
all buckets fill up, all lists are candidates.

Phrases have numbers (the smallest block and place that has them), so pairs of
number and next word are exact. Frequencies, scores and ranks are Spark joins
and groupings over the frequent phrases alone; products are decimals of 38
digits. A hot phrase has one entry for each block, however often it occurs. Of each language every task keeps only the first ranks before they meet.

Null texts are empty, null languages are ``und``; ids are not read, so null,
equal and repeated rows each count; ties stand in the order of the phrase's
bytes. A long text is cut into several blocks, each with the few words that
follow it, so phrases across a cut are counted once. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.llm.common import discard, slices, stored, utf8

#: Words of the longest phrase, occurrences of a frequent one, and phrases of a language that are returned.
LONGEST, LEAST, TOP = 5, 100, 2000
#: Words and separators of a block, those that a task holds in all its open blocks, and bytes of a text that are split at one time.
BLOCK, HELD, PART = 1 << 20, 1 << 21, 1 << 20
#: Most buckets (a power of two), occurrences for one bucket, buckets of a segment at least, and most segments: a block gives a row for each, so they don't grow with the blocks.
BUCKETS, LOAD, SEGMENT, SEGMENTS = 1 << 28, 4, 1 << 16, 64
#: Occurrences whose phrases are put together at one time.
TOGETHER = 1 << 20
#: Rows of words of a batch; bits of a phrase's number for its place in a block, and for the block's place in its partition.
_SOME, _PLACE, _SEQ = 1 << 16, 23, 18

_MARK = b"\xff"  # occurs in no UTF-8
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 255 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))

_KINDS = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}


def _schema(fields: str) -> pa.Schema:
    return pa.schema([(f.split()[0], _KINDS[f.split()[1]]) for f in fields.split(", ")])


#: A block with its words or a word of it; a block with its postings and lists; phrases of a block; those of a block that are frequent, or one frequent phrase; the buckets of a segment.
_TEXT = "block long, lang string, before int, words binary, place int, word string, n long"
_LISTS = "block long, lang string, before int, words binary, numbers binary, starts binary, counts binary, phrases binary"
_FOUND = "segment int, block long, lang string, packed binary"
_SETTLED = "block long, packed binary, lang string, prefix long, next long, number long, f long"
_COUNTS = "segment int, packed binary"


def _filled(fields: str, n: int, /, **columns) -> pa.RecordBatch:
    schema = _schema(fields)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


@cache
def _zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def packed(a: np.ndarray) -> bytes:
    """Numbers as compressed bytes, all first bytes before all second ones."""
    size = a.dtype.itemsize
    return _zstd()[0].compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, size).T.tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(_zstd()[1].decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).reshape(-1)


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time, with a mark wherever a phrase must end."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            end = min((x for x in (text.find(c, end) for c in (b" ", b"\t", _MARK)) if x >= 0), default=len(text))
        yield text[at:end].replace(_MARK, b" \xff ").split()
        at = end


class _Numbers(dict):
    """Numbers of words in the order of their first use; the mark's is 0."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


class _Block:
    """Words of one language; those before the first own word were counted in the block before."""

    def __init__(self, before: list[bytes]) -> None:
        self.numbers, self.parts, self.before, self.last, self.size = _Numbers({_MARK: 0}), [], len(before), [], 0
        self.add(before)

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.last = [*self.last, *words[1 - LONGEST :]][1 - LONGEST :]
        self.size += len(words)

    def rows(self, block: int, lang: str) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate(self.parts)
        if not ids[self.before :].any():
            return
        n = np.bincount(ids[self.before :], minlength=len(self.numbers))
        names = [w.decode() for w in self.numbers if w != _MARK]
        yield _filled(_TEXT, 1, block=[block], lang=[lang], before=[self.before], words=[packed(ids)])
        for k in range(0, len(names), _SOME):
            some = names[k : k + _SOME]
            yield _filled(_TEXT, len(some), block=np.full(len(some), block), lang=[lang] * len(some), place=np.arange(k + 1, k + 1 + len(some), dtype=np.int32), word=some, n=n[k + 1 : k + 1 + len(some)])


def _blocks(size: int, most: int):
    """Cuts texts into blocks of about size words; gives a row for each block and one for each of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        held, seq, part = 0, 0, TaskContext.get().partitionId()

        def close(langs: list[str]) -> Iterator[pa.RecordBatch]:
            nonlocal held, seq
            for lang in langs:
                block = blocks.pop(lang)
                held -= block.size
                yield from block.rows((part << _SEQ | seq) << _PLACE, lang)
                seq += 1

        for b in batches:
            for s in slices([b]):
                for lang, text in zip(s["lang"].to_pylist(), utf8(s["text"])):
                    for words in pieces(text):
                        if lang not in blocks:
                            blocks[lang] = _Block([])
                        blocks[lang].add(words)
                        held += len(words)
                        if blocks[lang].size >= size:
                            before = blocks[lang].last
                            yield from close([lang])
                            blocks[lang] = _Block(before)  # the text may go on
                            held += len(before)
                    if lang in blocks:
                        blocks[lang].add([_MARK])
                        held += 1
                    if held >= most:
                        yield from close(list(blocks))
        yield from close(list(blocks))

    return run


class _Lists:
    """The inverted lists of a block: where its frequent phrases of some length start, and what grows out of them."""

    def __init__(self, row: dict, length: int) -> None:
        self.block, self.lang, self.before, self.length = row["block"], row["lang"], row["before"], length
        self.words, self.numbers = unpacked(row["words"], np.int32), unpacked(row["numbers"], np.int64)
        if length == 1:
            starts = np.argsort(self.words, kind="stable").astype(np.int32)
            starts = starts[self.words[starts] > 0]
            phrase, self.phrases = self.words[starts] - 1, self.numbers
        else:
            self.phrases = unpacked(row["phrases"], np.int64)
            starts = unpacked(row["starts"], np.int32)
            phrase = np.repeat(np.arange(len(self.phrases), dtype=np.int32), unpacked(row["counts"], np.int32))
        begins = np.zeros(len(self.words) + 1, bool)
        begins[starts] = True
        # Where the next word's phrase begins too, a posting of a frequent word follows.
        able = begins[starts + 1] & (starts + length < len(self.words))
        starts, phrase = starts[able], phrase[able]
        key = phrase.astype(np.int64) << 32 | self.words[starts + length]
        order = np.argsort(key, kind="stable")
        key, self.starts = key[order], starts[order]
        self.heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        self.counts = np.diff(np.append(self.heads, len(key))).astype(np.int32)
        self.prefix, self.next = self.phrases[key[self.heads] >> 32], self.numbers[(key[self.heads] & 0xFFFFFFFF) - 1]

    def own(self) -> np.ndarray:
        """How often each longer phrase ends in a word that this block counts."""
        return np.add.reduceat(self.starts >= self.before - self.length, self.heads, dtype=np.int64) if len(self.heads) else np.zeros(0, np.int64)

    def buckets(self, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.prefix.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (self.next.view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
            h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return (h >> np.uint64(64 - bits)).astype(np.int64)

    def kept(self, place: np.ndarray, number: np.ndarray) -> pa.RecordBatch:
        """The lists of those longer phrases that are frequent (their places and numbers), with the postings that they can meet."""
        order = np.argsort(place)
        place, number = place[order], number[order]
        chosen = np.zeros(len(self.heads), bool)
        chosen[place] = True
        reach = np.zeros_like(self.words)
        at = self.starts + self.length
        reach[at] = self.words[at]
        starts = self.starts[np.repeat(chosen, self.counts)]
        return _filled(_LISTS, 1, block=[self.block], lang=[self.lang], before=[self.before], words=[packed(reach)], numbers=[packed(self.numbers)], starts=[packed(starts)], counts=[packed(self.counts[place])], phrases=[packed(number)])


def _each(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[_Lists]:
    for b in batches:
        for k in range(b.num_rows):
            yield _Lists(b.slice(k, 1).to_pylist()[0], length)


def _width(bits: int) -> int:
    """Buckets of a segment."""
    return max(SEGMENT, (1 << bits) // SEGMENTS)


def _counted(length: int, bits: int, least: int, width: int):
    """Occurrences by bucket, up to least, packed for each segment of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _each(batches, length):
            bucket, which = np.unique(x.buckets(bits), return_inverse=True)
            n = np.minimum(np.bincount(which, weights=x.own()), least).astype(np.int64)
            bucket, n = bucket[n > 0], n[n > 0]
            cuts = np.flatnonzero(np.diff(bucket // width)) + 1
            each = [(int(at[0] // width), packed(np.stack((np.diff(at % width, prepend=0), some)).astype(np.uint32).reshape(-1))) for at, some in zip(np.split(bucket, cuts), np.split(n, cuts)) if len(at)]
            if each:
                yield _filled(_COUNTS, len(each), segment=[k for k, _ in each], packed=[d for _, d in each])

    return run


def _summed(least: int, width: int):
    """Of each segment whose rows stand together, a bit for each bucket: whether it has enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, total = None, np.zeros(width, np.int64)
        for b in batches:
            for s, data in zip(b["segment"].to_pylist(), b["packed"]):
                if s != segment:
                    if segment is not None:
                        yield _filled(_COUNTS, 1, segment=[segment], packed=[np.packbits(total >= least).tobytes()])
                    segment, total = s, np.zeros(width, np.int64)
                gaps, n = unpacked(data.as_py(), np.uint32).astype(np.int64).reshape(2, -1)
                total[np.cumsum(gaps)] += n
        if segment is not None:
            yield _filled(_COUNTS, 1, segment=[segment], packed=[np.packbits(total >= least).tobytes()])

    return run


def _grown(length: int, bits: int, enough, parts: int):
    """The longer phrases of a block whose bucket has enough: place, prefix, next and n, packed for each of 2 ** parts segments of buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _each(batches, length):
            bucket = x.buckets(bits)
            place = np.flatnonzero(enough.value[bucket >> 3] >> (7 - (bucket & 7)) & 1)
            segment = bucket[place] >> (bits - parts)
            order = np.argsort(segment, kind="stable")
            place, segment, n = place[order], segment[order], x.own()
            each = [(int(segment[at[0]]), packed(np.stack((p := place[at], x.prefix[p], x.next[p], n[p])).reshape(-1))) for at in np.split(np.arange(len(place)), np.flatnonzero(np.diff(segment)) + 1) if len(at)]
            if each:
                yield _filled(_FOUND, len(each), segment=[k for k, _ in each], block=[x.block] * len(each), lang=[x.lang] * len(each), packed=[d for _, d in each])

    return run


def _settled(least: int):
    """Of each segment whose rows stand together: each block's places and numbers of frequent phrases, packed, and each of these phrases once."""

    def settle(rows: list[tuple[int, str, bytes]]) -> Iterator[pa.RecordBatch]:
        each = [unpacked(data, np.int64).reshape(4, -1) for _, _, data in rows]
        sizes = [e.shape[1] for e in each]
        place, prefix, next_, n = np.concatenate(each, 1)
        block = np.repeat(np.array([b for b, _, _ in rows]), sizes)
        lang = np.repeat(np.arange(len(rows)), sizes)
        order = np.lexsort((next_, prefix))
        p, q = prefix[order], next_[order]
        heads = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1]) | (q[1:] != q[:-1]))))
        f, number = np.add.reduceat(n[order], heads), np.minimum.reduceat((block + place)[order], heads)
        some = f >= least
        if not some.any():
            return
        h = heads[some]
        yield _filled(_SETTLED, len(h), lang=[rows[k][1] for k in lang[order[h]].tolist()], prefix=p[h], next=q[h], number=number[some], f=f[some])
        numbers = np.empty(len(order), np.int64)
        numbers[order] = np.repeat(np.where(some, number, -1), np.diff(np.append(heads, len(order))))
        kept = np.flatnonzero(numbers >= 0)
        each = [(int(block[at[0]]), packed(np.stack((place[at], numbers[at])).reshape(-1))) for at in np.split(kept, np.flatnonzero(np.diff(block[kept])) + 1)]
        yield _filled(_SETTLED, len(each), block=[k for k, _ in each], packed=[d for _, d in each])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, rows = None, []
        for b in batches:
            for s, *row in zip(*(b[c].to_pylist() for c in ("segment", "block", "lang", "packed"))):
                if s != segment and rows:
                    yield from settle(rows)
                    rows = []
                segment = s
                rows.append(tuple(row))
        if rows:
            yield from settle(rows)

    return run


def _posted(text: pa.Table, frequent: pa.Table) -> pa.Table:
    """A block with the postings of its frequent words only."""
    if not text.num_rows or not frequent.num_rows:
        return pa.Table.from_batches([], _schema(_LISTS))
    row = text.slice(0, 1).to_pylist()[0]
    place, number = frequent["place"].to_numpy(), frequent["number"].to_numpy()
    order = np.argsort(place)
    words = unpacked(row["words"], np.int32)
    new = np.zeros(max(int(words.max()), int(place.max())) + 1, np.int32)
    new[place[order]] = np.arange(1, len(place) + 1)
    return pa.Table.from_batches([_filled(_LISTS, 1, block=[row["block"]], lang=[row["lang"]], before=[row["before"]], words=[packed(new[words])], numbers=[packed(number[order])])])


def _chosen(length: int):
    """A block with the lists of its frequent phrases that are one word longer."""

    def run(lists: pa.Table, frequent: pa.Table) -> pa.Table:
        if not lists.num_rows or not frequent.num_rows:
            return pa.Table.from_batches([], _schema(_LISTS))
        x = _Lists(lists.slice(0, 1).to_pylist()[0], length)
        return pa.Table.from_batches([x.kept(*np.concatenate([unpacked(d, np.int64).reshape(2, -1) for d in frequent["packed"].to_pylist()], 1))])

    return run


def _enough(lists: DataFrame, length: int, occurrences: int, least: int):
    """The buckets that have enough occurrences of longer phrases, as a broadcast array of bits, and the number of bits of a bucket's number."""
    bits = min(max(16, (max(1, occurrences // LOAD) - 1).bit_length()), BUCKETS.bit_length() - 1)
    width = _width(bits)
    counts = lists.mapInArrow(_counted(length, bits, least, width), _COUNTS).repartition("segment").sortWithinPartitions("segment")
    flags = np.zeros((1 << bits) // 8, np.uint8)
    for row in counts.mapInArrow(_summed(least, width), _COUNTS).collect():  # a bit for each bucket in all
        flags[row["segment"] * (width // 8) : (row["segment"] + 1) * (width // 8)] = np.frombuffer(row["packed"], np.uint8)
    return bits, lists.sparkSession.sparkContext.broadcast(flags)


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """Rows of words that are frequent over all blocks, with f (how often they occur) and number."""
    same = W.partitionBy("lang", "word")
    found = rows.withColumn("f", F.sum("n").over(same)).withColumn("number", F.min(F.col("block") + F.col("place")).over(same)).where(F.col("f") >= least)
    return found.select("block", "place", "lang", "word", "f", "number")


def frequencies(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, length and f of every phrase of up to longest words that occurs at least so often; and lang and n (all words)."""
    if not 1 <= longest <= LONGEST:
        raise ValueError(f"phrases have 1 to {LONGEST} words")
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    read = stored(texts.mapInArrow(_blocks(block, HELD), _TEXT), "blocks")
    spoken = read.where("word is not null").select("block", "lang", "place", "word", "n")
    totals = stored(spoken.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    known = stored(_frequent(spoken, least), "frequent-1")
    owner = F.col("number") == F.col("block") + F.col("place")
    words = stored(known.where(owner).select("lang", "number", F.col("word").alias("phrase"), "f"), "phrases-1")
    found = [words]
    if longest > 1:
        text = read.where("words is not null").select("block", "lang", "before", "words").groupBy("block")
        lists = stored(text.cogroup(known.select("block", "place", "number").groupBy("block")).applyInArrow(_posted, _LISTS), "lists-1")
        discard(read, known)
    for length in range(1, longest):
        occurrences = found[-1].agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        bits, enough = _enough(lists, length, occurrences, least)
        parts = min(bits, (max(1, occurrences // TOGETHER) - 1).bit_length())
        grown = stored(lists.mapInArrow(_grown(length, bits, enough, parts), _FOUND), f"grown-{length + 1}")
        known = stored(grown.repartition("segment").sortWithinPartitions("segment", "block").mapInArrow(_settled(least), _SETTLED), f"frequent-{length + 1}")
        enough.destroy()
        discard(grown)
        heads = found[-1].select(F.col("number").alias("prefix"), F.col("phrase").alias("head"))
        tails = words.select(F.col("number").alias("next"), F.col("phrase").alias("tail"))
        found.append(stored(known.where("f is not null").join(heads, "prefix").join(tails, "next").select("lang", "number", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), f"phrases-{length + 1}"))
        if length + 1 < longest:
            longer = stored(lists.groupBy("block").cogroup(known.where("packed is not null").select("block", "packed").groupBy("block")).applyInArrow(_chosen(length), _LISTS), f"lists-{length + 1}")
            discard(lists, known)
            lists = longer
        else:
            discard(lists, known)
    all_of_them = found[0].withColumn("length", F.lit(1))
    for k, f in enumerate(found[1:], 2):
        all_of_them = all_of_them.unionByName(f.withColumn("length", F.lit(k)))
    return all_of_them.drop("number"), totals


def scored(phrases: DataFrame, totals: DataFrame, percent: int = 100) -> DataFrame:
    """lang, phrase, a, l, r, n and score of every phrase of two or more words that no longer one nearly always holds; phrases and totals as frequencies() gives them."""
    some = phrases.where("length > 1").withColumnRenamed("f", "a")
    part = F.split("phrase", " ")

    def words(start, count):
        return F.array_join(F.slice(part, start, count), " ")

    shorter = some.where("length > 2").select("lang", F.explode(F.array(words(F.lit(1), F.col("length") - 1), words(F.lit(2), F.col("length") - 1))).alias("phrase"), "a")
    # Of phrases that hold a phrase, one that is a word longer is the most frequent.
    held = shorter.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = some.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * percent))
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("length") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", words(F.lit(1), F.col("k")).alias("first"), words(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    f = phrases.select("lang", "phrase", "f")
    met = cuts.join(f.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(f.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    wide = [F.col(c).cast("decimal(19,0)") for c in ("n", "l", "r")]
    score = F.expr("(thousand_a * wide_n) div (wide_l * wide_r)")
    met = met.select("*", (F.col("a") * 1000).cast("decimal(19,0)").alias("thousand_a"), *[w.alias(f"wide_{c}") for w, c in zip(wide, "nlr")]).withColumn("score", score)
    return met.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, longest: int = LONGEST, percent: int = 100, block: int = BLOCK, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first phrases of each language by score, with their ranks."""
    found = scored(*frequencies(docs, least, longest, block, text_col, lang_col), percent)
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


op12 = collocations
