"""Operator 4: token ids in a compressed binary file.

Documents are range-partitioned by id, encoded, and each partition's ids are
packed into blocks of whole documents. A block is reset, checksummed and
decoded by itself. In it an adaptive model predicts each id from the two ids
before it (order 2), from the one before it (order 1), and from the ids so far
(order 0). The three predictions are added up with weights that are counted for
each state of confidence, and a range coder codes the id in the mixture's interval. Ids run
in up to ``LANES`` stretches side by side, so that the coder works on arrays;
the model learns after each round of ``STEPS`` ids in every lane, for encoder
and decoder alike.

Blocks are binary values of a Parquet table, so they go to any store that
Spark can write to, and a lost executor's tasks are simply run again. Reading
needs nothing but that table: blocks are decoded where they lie, and only a
row of counts for each partition is brought together to give the starts.

Null and empty texts have only the end id. Equal ids and repeated rows are
each written, ordered by text hash; null ids come first. Other columns are not
looked at. An empty table gives an empty file and no rows. A text's ids must
fit into memory, any number of texts may not.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.llm.bpe import CUT, LONG
from tempograph.llm.common import cut, doc_columns, fresh_path, slices, strings, tokenizer_path
from tempograph.llm.merges import Merges

#: Ids of a block (whole documents), lanes, ids of a lane in a round, and bytes of text in a partition.
BLOCK, LANES, STEPS, PARTITION_BYTES = 2_097_152, 4096, 32, 32 << 20
END_ID = 2
#: The pre-tokenizer's pattern (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAGIC = b"TIDX\x02"

#: Bits of the orders' weights and of order 0's total; all ids, and slots of order 2.
_MIX_BITS, _ID_BITS = 10, 20
_ALL, _TOTAL, _HASHED = 1 << 16, 1 << _ID_BITS, 1 << 17
_IDS = np.arange(_ALL, dtype=np.uint16)
_U = np.uint64
_WORD, _LOW, _UNIT = _U(32), _U(1 << 32), _U(_MIX_BITS + _ID_BITS)


class TextEncoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary file, by tiktoken's core on the same merges, which takes half the library's time."""

    def __init__(self, path: str):
        merges = Merges(path)
        made = sorted(merges.born, key=merges.born.__getitem__)
        if made != sorted(made):
            raise ValueError("the vocabulary's merges aren't in the order of their ids")
        self.core = tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=merges.inner, special_tokens=merges.special)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; a long one is cut at single spaces, where tokens never meet."""
        if len(text) <= LONG:
            return self.core.encode_to_numpy(text, allowed_special="all")
        parts, at = [], 0
        while at < len(text):
            m = CUT.search(text, at + LONG)
            end = m.start() if m else len(text)
            parts.append(self.core.encode_to_numpy(text[at:end], allowed_special="all"))
            at = end
        return np.concatenate(parts)


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """The encoder of this worker process."""
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


class Model:
    """Order-0 to order-2 predictions of ids below 2**16, mixed; learns in rounds.

    Order 2 and order 1 each predict one id, order 0 all of them by their
    counts. All fits into 32 bits, so arrays are of such numbers. Ids lie side by side in order; each is as wide as its order-0
    probability times that order's weight, and the two predicted ones are wider
    by their orders' weights. The weights follow how often each order was right
    in the same state of sureness.
    """

    def __init__(self):
        self.counts = np.ones(_ALL, np.int64)
        # What followed one id, and two ids, and how sure that is (0 to 3): id * 4 + sureness.
        self.after1, self.after2 = np.zeros(_ALL, np.int32), np.zeros(_HASHED, np.int32)
        # How often order 2, order 1 and neither of them was right, by the sureness of both and whether they agree.
        self.hits = np.tile(np.array([2, 2, 8], np.int64), (32, 1))
        self._freeze()

    def _freeze(self) -> None:
        """The distributions that hold for the next round."""
        self.freq = (1 + self.counts * (_TOTAL - _ALL) // int(self.counts.sum())).astype(np.int32)
        self.upto = np.zeros(_ALL + 1, np.int32)
        np.cumsum(self.freq, out=self.upto[1:])
        self.at = np.full(_TOTAL, _ALL - 1, np.uint16)
        self.at[: self.upto[-1]] = np.repeat(_IDS, self.freq)
        one = 1 << _MIX_BITS
        weight = self.hits * (one - 1) // self.hits.sum(1, keepdims=True)
        self.w2, self.w1, self.w0 = (x.astype(np.int32) for x in (weight[:, 0] << _ID_BITS, weight[:, 1] << _ID_BITS, one - weight[:, 0] - weight[:, 1]))

    @staticmethod
    def slot2(p2: np.ndarray, p1: np.ndarray) -> np.ndarray:
        return ((p2.view(np.uint32) * np.uint32(40_503) + p1.view(np.uint32) * np.uint32(2_654_435_761)) >> np.uint32(7)) & np.uint32(_HASHED - 1)

    def guesses(self, p2: np.ndarray, p1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order-2 guess, order-1 guess, and the state of sureness."""
        a, b = self.after2[self.slot2(p2, p1)], self.after1[p1]
        g2, g1 = a >> 2, b >> 2
        return g2, g1, ((a & 3) << 3) + ((b & 3) << 1) + (g2 == g1)

    def intervals(self, g2: np.ndarray, g1: np.ndarray, state: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and width of each id in the mixture's total."""
        return self._interval(self.w2[state], self.w1[state], self.w0[state], g2, g1, ids)

    def _interval(self, w2: np.ndarray, w1: np.ndarray, w0: np.ndarray, g2: np.ndarray, g1: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return w0 * self.upto[ids] + (ids > g2) * w2 + (ids > g1) * w1, w0 * self.freq[ids] + (ids == g2) * w2 + (ids == g1) * w1

    def find(self, g2: np.ndarray, g1: np.ndarray, state: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids in whose intervals values lie, with start and width."""
        w2, w1, w0 = self.w2[state], self.w1[state], self.w0[state]
        low, high, low_w = np.minimum(g2, g1), np.maximum(g2, g1), np.where(g2 < g1, w2, w1)
        # Take out of the value what the two predicted ids are wider; the lower one's width comes first.
        for end, w in ((w0 * self.upto[low + 1], low_w), (w0 * self.upto[high + 1], w2 + w1 - low_w)):
            value = value - np.minimum(np.maximum(value - end + 1, 0), w)
        # Quotients of such small numbers are far enough from the next one for floats.
        ids = self.at[(value / w0).astype(np.intp)].astype(np.int32)
        return ids, *self._interval(w2, w1, w0, g2, g1, ids)

    def learn(self, p2: np.ndarray, p1: np.ndarray, ids: np.ndarray, g2: np.ndarray, g1: np.ndarray, state: np.ndarray) -> None:
        by = state * 3 + np.where(ids == g2, 0, np.where(ids == g1, 1, 2))
        self.hits += np.bincount(by, minlength=96).reshape(32, 3)
        heavy = self.hits.sum(1) > 60_000
        self.hits[heavy] = self.hits[heavy] // 2 + 1
        self.counts += 32 * np.bincount(ids, minlength=_ALL)
        for after, at in ((self.after1, p1), (self.after2, self.slot2(p2, p1))):
            told = after[at]
            sure = told & 3
            right = told >> 2 == ids
            # A right guess gets surer, a wrong one less sure, and one that isn't sure at all gives way.
            after[at] = np.where(right, told + (sure < 3), np.where(sure > 0, told - 1, ids * 4))
        self._freeze()


def _shape(n: int) -> tuple[int, int]:
    """Lanes and ids of a lane for n ids."""
    lanes = max(1, min(LANES, n // 256))
    return lanes, -(-n // lanes)


def pack_ids(ids: np.ndarray) -> bytes:
    """A block of ids below 2**16."""
    lanes, length = _shape(len(ids))
    grid = np.zeros(lanes * length, np.int32)
    grid[: len(ids)] = ids
    grid = np.concatenate([np.zeros((2, lanes), np.int32), grid.reshape(lanes, length).T])
    model = Model()
    low, span = np.zeros(lanes, _U), np.full(lanes, ~_U(0))
    sizes = np.zeros(lanes, np.int64)
    words: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    carries: list[tuple[np.ndarray, np.ndarray]] = []
    with np.errstate(over="ignore"):
        for at in range(0, length, STEPS):
            n = min(STEPS, length - at)
            p2, p1, now = (grid[at + k : at + k + n].ravel() for k in range(3))
            guessed = model.guesses(p2, p1)
            start, width = (x.astype(_U).reshape(n, lanes) for x in model.intervals(*guessed, now))
            for k in range(n):
                unit = span >> _UNIT
                before = low
                low = low + unit * start[k]
                over = np.flatnonzero(low < before)
                if len(over):
                    carries.append((over, sizes[over] - 1))
                span = unit * width[k]
                out = np.flatnonzero(span < _LOW)
                if len(out):
                    words.append(low[out] >> _WORD)
                    owners.append(out)
                    sizes[out] += 1
                    low[out] <<= _WORD
                    span[out] <<= _WORD
            model.learn(p2, p1, now, *guessed)
    for part in (low >> _WORD, low & (_LOW - _U(1))):
        words.append(part)
        owners.append(np.arange(lanes))
    sizes += 2
    values = np.concatenate(words)[np.argsort(np.concatenate(owners), kind="stable")]
    first = np.cumsum(sizes) - sizes
    for lane, place in carries:  # a carry goes into the lane's last word so far, and on to the left
        values[first[lane] + place] += _U(1)
    while (over := np.flatnonzero(values >> _WORD)).size:
        values[over] &= _LOW - _U(1)
        values[over - 1] += _U(1)
    return sizes.astype("<u4").tobytes() + values.astype("<u4").tobytes()


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    """The n ids of a block."""
    lanes, length = _shape(n)
    sizes = np.frombuffer(data, "<u4", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(data, "<u4", offset=4 * lanes), np.zeros(2, "<u4")]).astype(_U)
    pos = np.cumsum(sizes) - sizes
    grid = np.zeros((length + 2, lanes), np.int32)
    model = Model()
    span, code = np.full(lanes, ~_U(0)), words[pos] << _WORD | words[pos + 1]
    pos += 2
    most = _U((1 << (_MIX_BITS + _ID_BITS)) - 1)
    with np.errstate(over="ignore"):
        for at in range(0, length, STEPS):
            steps = min(STEPS, length - at)
            guessed = []
            for k in range(steps):
                g = model.guesses(grid[at + k], grid[at + k + 1])
                unit = span >> _UNIT
                ids, start, width = model.find(*g, np.minimum(code // unit, most).astype(np.int32))
                code = code - unit * start.astype(_U)
                span = unit * width.astype(_U)
                out = np.flatnonzero(span < _LOW)
                if len(out):
                    code[out] = code[out] << _WORD | words[pos[out]]
                    pos[out] += 1
                    span[out] <<= _WORD
                guessed.append(g)
                grid[at + k + 2] = ids
            p2, p1, now = (grid[at + k : at + k + steps].ravel() for k in range(3))
            model.learn(p2, p1, now, *(np.concatenate(x) for x in zip(*guessed)))
    return grid[2:].T.ravel()[:n]


def pack_block(docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    """A block: magic, counts, checksum of all that follows, each document's id and length, the coded ids."""
    ids = np.concatenate([x for _, x in docs])
    head = np.array([d if d is not None else 0 for d, _ in docs], "<i8").tobytes() + np.array([d is None for d, _ in docs], "u1").tobytes() + np.array([len(x) for _, x in docs], "<u4").tobytes()
    body = zlib.compress(head, 1)
    body = struct.pack("<I", len(body)) + body + pack_ids(ids)
    return MAGIC + struct.pack("<III", len(docs), len(ids), zlib.crc32(body)) + body


def unpack_block(data: bytes) -> list[tuple[int | None, np.ndarray]]:
    """The documents of a block; raises ValueError if it isn't whole."""
    if data[: len(MAGIC)] != MAGIC:
        raise ValueError("not a block of token ids")
    n_docs, n, crc = struct.unpack_from("<III", data, len(MAGIC))
    body = data[len(MAGIC) + 12 :]
    if zlib.crc32(body) != crc:
        raise ValueError("a block's checksum is wrong")
    (size,) = struct.unpack_from("<I", body)
    head = zlib.decompress(body[4 : 4 + size])
    names = np.frombuffer(head, "<i8", n_docs)
    null = np.frombuffer(head, "u1", n_docs, 8 * n_docs)
    lengths = np.frombuffer(head, "<u4", n_docs, 9 * n_docs)
    ids = unpack_ids(body[4 + size :], n)
    return [(None if z else int(d), x) for d, z, x in zip(names, null, np.split(ids, np.cumsum(lengths)[:-1]))]


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> None:
    """Writes the ids of all documents, each with end_id behind it, in ascending order of their ids, as a table of blocks below path."""
    rows = doc_columns(docs, id_col, text_col)
    if partitions is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(docs.sparkSession.sparkContext.defaultParallelism, size // PARTITION_BYTES + 1)
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(partitions, F.col("doc_id").asc_nulls_first(), "h").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = encoder(vocabulary), TaskContext.get().partitionId(), 0
        waiting: list[tuple[int | None, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, waiting, size
            done = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([seq], pa.int32()), "n_docs": pa.array([len(waiting)], pa.int64()), "n_ids": pa.array([size], pa.int64()), "data": pa.array([pack_block(waiting)], pa.binary())})
            seq, waiting, size = seq + 1, [], 0
            return done

        for b in slices(batches, 64):
            for doc, text in zip(b["doc_id"].to_pylist(), strings(b["text"])):
                ids = np.append(enc.encode(text), end_id).astype(np.int32)
                if waiting and size + len(ids) > block:
                    yield flush()
                waiting.append((doc, ids))
                size += len(ids)
        if waiting:
            yield flush()

    ordered.select("doc_id", "text").mapInArrow(run, "part int, block int, n_docs long, n_ids long, data binary").write.option("compression", "uncompressed").parquet(path)


def read_ids(spark: SparkSession, path: str, emit_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, with emit_ids, ids (32-bit little-endian) of each document of the table of blocks."""
    blocks = spark.read.schema("part int, block int, n_docs long, n_ids long, data binary").parquet(path)
    # A row for each partition in one window, then a window for each partition's blocks.
    parts = cut(blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).withColumn("base", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "base"))
    index = blocks.select("part", "block", "n_ids").join(parts, "part").withColumn("start", F.col("base") + F.sum("n_ids").over(W.partitionBy("part").orderBy("block")) - F.col("n_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 4):
            for start, data in zip(b["start"].to_pylist(), b["data"].to_pylist()):
                docs = unpack_block(data)
                n = np.array([len(x) for _, x in docs], np.int64)
                raw = [x.astype("<u4").tobytes() for _, x in docs]
                cols = {"doc_id": pa.array([d for d, _ in docs], pa.int64()), "start": pa.array(start + np.cumsum(n) - n), "n_tokens": pa.array(n), "ids_crc32": pa.array([zlib.crc32(x) for x in raw], pa.int64())}
                if emit_ids:
                    cols["ids"] = pa.array(raw, pa.binary())
                yield pa.RecordBatch.from_pydict(cols)

    there = blocks.select("part", "block", "data").join(index.select("part", "block", "start"), ["part", "block"])
    return there.select("start", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * emit_ids)


def op4(docs: DataFrame) -> DataFrame:
    """Writes the file and reads it back."""
    path = fresh_path(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer_path("byte_bpe_50k.json"))
    return read_ids(docs.sparkSession, path, emit_ids=False)
