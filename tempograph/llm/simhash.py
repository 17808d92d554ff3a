"""Operator 3: near-duplicates by SimHash.

A text's fingerprint is the bitwise majority of its shingles' hashes. Equal
fingerprints are first brought down to one representative. Of four blocks of
16 bits, two fingerprints that differ in at most two bits share two or more,
so representatives are joined on the six pairs of blocks and verified by their
Hamming distance. A pair of blocks that more than ``BUCKET`` representatives
share makes no pairs: there each representative is written once for itself
and for every flip of one bit, and all that meet at one value, which lie
within two bits of each other, are linked to the smallest. No link is lost
that way, and rows grow with the members, not with their square.

Links become components by alternating star contraction, checkpointed in the
shared folder. A fingerprint that many documents have is joined by broadcast, so
its documents stay dealt out. Null and empty texts have the fingerprint zero.
Repeated rows give a row each. A null id is larger than any other. A text must
fit into memory with its shingles' hashes. An empty table gives no rows. Other
columns are not looked at.

``similar`` finds documents alike in a wider sense, a share of common shingles
of 0.8 or more. Fingerprints then have ``WIDE`` bits, of which such pairs differ
in about one in seven. A block is a drawn set of bit places, so many that by
chance ``2 ** MEET`` representatives at most share one on average, and there are
so many blocks that a pair at the limit shares ``SHARED`` of them on average, one
in fifty none; both grow with the input. Fingerprints go along to their blocks
whole. Where up to ``CROWD`` share one, all that are not yet connected are
compared there, as arrays, by the first 64 bits and then by all, and only as many
links come out as connect them, fewer than the block has rows. In a more crowded
block all are compared with one of them first. Those that are linked to it count
as one from then on. A block in which all count as one is done; where no more than
``BUCKET`` stand apart from the rest, these are compared with all; what is left is
split by ``FURTHER`` more bits, in ``AGAIN`` ways, and after ``ROUNDS`` of that
taken apart by one after the other. So crowded blocks lose hardly more links than
others, rows don't grow with the square of a group, and a large group of copies is
done in one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import cut, doc_columns, join_classes, slices, stored, utf8
from tempograph.llm.substr import runs, word_ids

SHINGLE, DISTANCE, SEED = 3, 2, 42
#: Representatives that may share a pair of blocks and still be compared in pairs.
BUCKET = 16

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    w = text.translate(_LOWER).split()
    if not w:
        return 0
    digest = xxhash.xxh64_intdigest
    grams = map(b" ".join, zip(*[w[k:] for k in range(shingle)])) if len(w) > shingle else [b" ".join(w)]
    h = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(h) < 400:
        ones = np.unpackbits(octets, axis=1).sum(0)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BYTE_BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in utf8(b["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fp)], ["doc_id", "fp"])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


#: Bits of a wide fingerprint, words of its shingles, and blocks that a pair at the limit shares on average.
WIDE, WIDE_SHINGLE, SHARED = 512, 5, 4
#: Standard deviations that are added to the expected distance, of all bits and of the first 64.
SPREAD, ROUGH = 1.6, 3
#: Bits that split a crowded block and ways to draw them, and rounds in which blocks are split.
FURTHER, AGAIN, ROUNDS = 8, 12, 6
#: Bits by which a block is narrower than the number of representatives, the least bits of one, and representatives that may share one and still be compared in one task.
MEET, NARROW, CROWD = 8, 8, 4096
#: Comparisons that are made at one time.
TILE = 1 << 17
_SEEDS = (np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def wide_fingerprint(text: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """WIDE bits as uint64: the bitwise majority of the hashes of a text's different shingles; zero for none."""
    w = text.translate(_LOWER).split()
    if not w:
        return np.zeros(WIDE // 64, np.uint64)
    h = np.unique(runs(word_ids(w), min(shingle, len(w))))
    with np.errstate(over="ignore"):
        x = h[None, :] + _SEEDS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    out = []
    for row in x:
        ones = np.zeros(64, np.int64)
        for at in range(0, len(row), 8192):
            ones += np.unpackbits(row[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(row)).view(">u8")[0])
    return np.array(out, np.uint64)


def share_of_bits(similarity: float) -> float:
    """The expected share of bits in which two texts differ that share so much of all their shingles, each having as many."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def wide_distance(similarity: float, bits: int = WIDE, spread: float = SPREAD) -> int:
    """Bits in which texts of a similarity differ: what is expected, and some standard deviations."""
    p = share_of_bits(similarity)
    return int(bits * p + spread * (bits * p * (1 - p)) ** 0.5)


def shape(n: int, similarity: float) -> tuple[int, int]:
    """Bits of a block and number of blocks for n representatives."""
    bits = max(NARROW, min(48, (max(n, 1) - 1).bit_length() - MEET))
    return bits, int(np.ceil(SHARED / (1 - share_of_bits(similarity)) ** bits))


_WIDE_COLUMNS = [f"f{k}" for k in range(WIDE // 64)]
#: Columns of a row in its block.
_ROW = ["block", "rep", "part", *_WIDE_COLUMNS]


def wide_fingerprints(docs: DataFrame, shingle: int = WIDE_SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the fingerprint as signed longs f0, f1 ... of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([wide_fingerprint(t, shingle) for t in utf8(b["text"])], np.uint64).reshape(-1, WIDE // 64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(np.ascontiguousarray(c)) for c in fp.T)], ["doc_id", *_WIDE_COLUMNS])

    return doc_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _WIDE_COLUMNS))


def _places(bits: int, blocks: int, salt: int) -> np.ndarray:
    """The bit places of each block, drawn alike everywhere."""
    rng = np.random.default_rng([bits, blocks, salt])
    return np.stack([rng.permutation(WIDE)[:bits] for _ in range(blocks)])


def wide_blocks(reps: DataFrame, bits: int, blocks: int, salt: int) -> DataFrame:
    """(block, rep, part, f0, f1 ...) for each block of each row (within, rep, part, f0, f1 ...): block is a hash of the block that the row stands in, the block's number and its bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, powers = _places(bits, blocks, salt), np.uint64(1) << np.arange(bits, dtype=np.uint64)
        number = np.arange(blocks, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in slices(batches, 1024):
            octets = np.stack([b[c].to_numpy(zero_copy_only=False) for c in _WIDE_COLUMNS], 1).astype(">i8").view(np.uint8).reshape(b.num_rows, -1)
            ones = np.unpackbits(octets, axis=1)
            with np.errstate(over="ignore"):
                within = b["within"].to_numpy(zero_copy_only=False).view(np.uint64)[:, None]
                h = np.stack([(ones[:, p] * powers).sum(1, dtype=np.uint64) for p in places], 1)
                h = (h + number) * np.uint64(0xBF58476D1CE4E5B9) ^ within * np.uint64(0x94D049BB133111EB)
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(32)
            repeated = [pa.array(np.repeat(b[c].to_numpy(zero_copy_only=False), len(places))) for c in ("rep", "part", *_WIDE_COLUMNS)]
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), *repeated], _ROW)

    return reps.select("within", "rep", "part", *_WIDE_COLUMNS).mapInArrow(run, ", ".join(f"{c} long" for c in _ROW))


def connecting(part: np.ndarray, bits: np.ndarray, most: int, rough: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with a part and a fingerprint: as many pairs (i, j) within the distance as connect the parts that any such pairs connect."""
    label = np.unique(part, return_inverse=True)[1]
    first, every = np.ascontiguousarray(bits[:, 0]), np.arange(len(part))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # Open rows have not been compared with all others; one alone first, so that most of a group are connected before many are compared.
    open_, step = every, 1
    while (label[open_] != label[open_[0]]).any():
        now = open_[:step]
        x, y = np.nonzero(np.bitwise_count(first[now][:, None] ^ first[open_][None, :]) <= rough)
        x, y = now[x], open_[y]
        x, y = (z[label[x] != label[y]] for z in (x, y))
        near = np.bitwise_count(bits[x] ^ bits[y]).sum(1, dtype=np.int64) <= most
        x, y = x[near], y[near]
        for k in np.unique(x):
            at = y[x == k]
            new, where = np.unique(label[at], return_index=True)
            where = where[new != label[k]]
            if len(where):
                found.append((np.full(len(where), k), at[where]))
                label[np.isin(label, label[at[where]])] = label[k]
        # Then those of small parts: rows of the largest one need no comparison among themselves.
        rest = open_[len(now) :]
        open_ = rest[np.argsort(np.bincount(label)[label[rest]], kind="stable")]
        if not len(open_):
            break
        step = max(1, TILE // len(open_))
    return tuple(np.concatenate([z[k] for z in found]) if found else every[:0] for k in (0, 1))


def _met(crowd: int, most: int, rough: int):
    """Of rows sorted by block: pairs that connect the parts in blocks of up to so many; the rows of crowded ones."""

    def made(pairs: list, rows: list) -> pa.RecordBatch:
        x = np.concatenate([np.empty((0, 2), np.int64), *pairs])
        y = np.concatenate([np.empty((0, len(_ROW)), np.int64), *rows])
        full = [pa.concat_arrays([pa.array(c.copy()), pa.nulls(len(y), pa.int64())]) for c in x.T] + [pa.concat_arrays([pa.nulls(len(x), pa.int64()), pa.array(c.copy())]) for c in y.T]
        return pa.RecordBatch.from_arrays(full, ["a", "b", *_ROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        pairs: list[np.ndarray] = []
        rows: list[np.ndarray] = []

        def close() -> None:
            if 1 < size <= crowd:
                block = np.concatenate(held)
                i, j = connecting(block[:, 2], block[:, 3:].view(np.uint64), most, rough)
                pairs.append(np.stack([block[i, 1], block[j, 1]], 1))

        for batch in batches:
            table = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in _ROW], 1)
            ends = [*(np.flatnonzero(table[1:, 0] != table[:-1, 0]) + 1).tolist(), len(table)]
            for start, end in zip([0, *ends], ends):
                if start == end:
                    continue
                if table[start, 0] != now:
                    close()
                    now, held, size = table[start, 0], [], 0
                held.append(table[start:end].copy())
                size += end - start
                if size > crowd:
                    rows.extend(held)
                    held = []
            yield made(pairs, rows)
            pairs.clear()
            rows.clear()
        close()
        yield made(pairs, rows)

    return run


def _apart(x: str | F.Column, y: str | F.Column) -> F.Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, d: n + d)


def wide_links(reps: DataFrame, similarity: float, crowd: int, shape: tuple[int, int]) -> DataFrame:
    """Pairs (a, b) of representatives (rep, f0, f1 ...) that lie within the similarity's distance, as many as connect those that also share a block."""
    most, rough = wide_distance(similarity), wide_distance(similarity, 64, ROUGH)
    rows = wide_blocks(reps.select(F.lit(0).cast("long").alias("within"), "rep", F.col("rep").alias("part"), *_WIDE_COLUMNS), *shape, 0)
    links, turn, few_at_most = [], 0, min(crowd, BUCKET)
    while True:
        ordered = rows.repartition("block").sortWithinPartitions("block", "rep")
        met = stored(ordered.mapInArrow(_met(crowd, most, rough), ", ".join(f"{c} long" for c in ["a", "b", *_ROW])), "met")
        links.append(met.where("a is not null").select("a", "b"))
        crowded = met.where("block is not null").select("block", "rep", "part", F.array(*_WIDE_COLUMNS).alias("bits"))
        size = crowded.count()
        if not size:
            break
        # Blocks of one part are done.
        mixed = cut(crowded.groupBy("block").agg(F.count("*").alias("n"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("block", "n"))
        crowded = cut(join_classes(crowded, mixed, "block", "rep", size))
        # One of the smallest part of each crowded block, another one in each, is compared with all others; those it is linked to are of its part then.
        inside = crowded.groupBy("block", "part").agg(F.count("*").alias("c"), F.min(F.struct(F.hash("rep", "block").alias("h"), "rep", "bits")).alias("p"))
        pivot = inside.groupBy("block").agg(F.min(F.struct("c", "p.h", "p.rep", "part", "p.bits")).alias("p"), F.sum("c").alias("n")).select("block", "n", F.col("p.rep").alias("pivot"), F.col("p.part").alias("pivot_part"), F.col("p.bits").alias("pivot_bits"))
        told = cut(join_classes(crowded, cut(pivot), "block", "rep", size).withColumn("near", _apart("pivot_bits", "bits") <= most).drop("pivot_bits"))
        links.append(told.where("near and part <> pivot_part").select(F.col("rep").alias("a"), F.col("pivot").alias("b")))
        left = told.where("rep <> pivot").withColumn("part", F.when(F.col("near"), F.col("pivot_part")).otherwise(F.col("part"))).select("block", "rep", "part", "bits")
        sizes = left.groupBy("block", "part").agg(F.count("*").alias("c"))
        blocks = cut(sizes.groupBy("block").agg(F.sum("c").alias("n"), F.max(F.struct("c", "part")).alias("largest"), F.count("*").alias("parts")).where("parts > 1").select("block", "n", F.col("largest.part").alias("largest"), (F.col("n") - F.col("largest.c")).alias("others")))
        marked = cut(join_classes(left, blocks, "block", "rep", size))
        # Where few are not of the largest part, they are compared with all.
        some = marked.where(F.col("others") <= few_at_most)
        few = some.where(F.col("part") != F.col("largest")).groupBy("block").agg(F.collect_list(F.struct(F.col("rep").alias("o"), F.col("part").alias("q"), F.col("bits").alias("w"))).alias("os"))
        few = cut(few.join(blocks.select("block", "n"), "block"))
        near = F.transform(F.filter("os", lambda o: (o["q"] != F.col("part")) & (_apart(o["w"], F.col("bits")) <= most)), lambda o: o["o"])
        links.append(cut(join_classes(some.select("block", "rep", "part", "bits"), few, "block", "rep", size).select(F.col("rep").alias("a"), F.explode(near).alias("b"))))
        turn += 1
        further = (FURTHER, AGAIN) if turn <= ROUNDS else (0, 1)
        open_ = marked.where(F.col("others") > few_at_most).select(F.col("block").alias("within"), "rep", "part", *[F.col("bits")[k].alias(c) for k, c in enumerate(_WIDE_COLUMNS)])
        rows = wide_blocks(open_, *further, turn)
    every = links[0]
    for f in links[1:]:
        every = every.unionByName(f)
    return every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar(docs: DataFrame, similarity: float, shingle: int = WIDE_SHINGLE, bucket: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest doc_id that links between similar texts lead to, of each row."""
    fps = stored(wide_fingerprints(docs, shingle, id_col, text_col).withColumn("rep", F.xxhash64(*_WIDE_COLUMNS)), "fingerprints")
    reps = cut(fps.groupBy("rep", *_WIDE_COLUMNS).agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    links = wide_links(reps, similarity, bucket, shape(reps.count(), similarity))
    return _classes(fps.select("doc_id", "rep"), reps.select("rep", "first", "n"), components(links), "rep").select("doc_id", "component_id")


def _classes(rows: DataFrame, reps: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """rows (doc_id and key) with component_id, from representatives (key, first, n) and the components of some of them (node, root)."""
    linked = cut(nodes.join(reps.select(F.col(key).alias("node"), "first"), "node"))
    sizes = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    moved = join_classes(linked, sizes, "root", "node", linked.count()).select(F.col("node").alias(key), "component_id")
    classes = reps.join(moved, key, "left").select(key, "n", F.coalesce("component_id", "first").alias("component_id"))
    return join_classes(rows, classes, key, "doc_id", rows.count())


def _blocks() -> F.Column:
    """The six pairs of 16-bit blocks as (which, value)."""
    block = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF)) for k in range(4)]
    return F.array(*[F.struct(F.lit(n).cast("byte").alias("which"), F.shiftleft(block[i], 16).bitwiseOR(block[j]).alias("value")) for n, (i, j) in enumerate(combinations(range(4), 2))])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in column fp that connect all within DISTANCE, and no others."""
    keyed = fps.select("fp", F.explode(_blocks()).alias("k")).select("fp", "k.which", "k.value")
    sizes = keyed.groupBy("which", "value").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(keyed.join(sizes, ["which", "value"]))
    small = shared.where(F.col("n") <= bucket)
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = small.select("which", "value", F.col("fp").alias("a")).join(small.select("which", "value", F.col("fp").alias("b")), ["which", "value"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    crowd = shared.where(F.col("n") > bucket).select("fp").distinct()
    meet = crowd.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])).alias("at"))
    centre = meet.groupBy("at").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = meet.join(centre, "at").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the smallest node of its component, for all nodes of the edges."""
    e = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"))
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p")).select("p.u", "p.v").where("u <> v").distinct()
        before, e = e, cut(small)
        same = before.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(same) == tuple(e.select(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()):
            break
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, bucket: int = BUCKET, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that links lead to, of each row."""
    fps = cut(fingerprints(docs, shingle, id_col, text_col))
    reps = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    found = _classes(fps, reps, components(links(reps.select("fp"), bucket)), "fp")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float | None = None, **how) -> DataFrame:
    """The documents, with all their columns, that have the smallest id of their component; components by a similarity, or by two differing bits where none is given.

    Rows that repeat a kept id stay beside it; rows with a null id stay if one of them has a component without ids.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **how) if similarity is None else similar(docs, similarity, id_col=id_col, text_col=text_col, **how)
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_stay")).distinct()
    return docs.join(stay, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("_stay")), "left_semi")


op3 = near_duplicates
