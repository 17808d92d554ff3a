"""Operator 5: toxicity by compression distance.

Two zstandard dictionaries are trained on labelled texts: one on windows of
ordinary texts, one on those parts of toxic texts that set them apart, the
words that are clearly more common there. A window of a text is compressed
twice, with the ordinary dictionary alone and with the toxic one before it; the
bytes that the toxic one saves are the window's gain, close to nothing in
ordinary text. A text's score comes from its gains by a logistic curve.

Curve, the gain from which a window counts and how clear a contrast must be are
chosen by likelihood on gains that dictionaries of other rows give: the
training rows are dealt into ``PARTS``, and up to ``CALIBRATION_DOCS`` of either
class in each are scored by dictionaries trained on the other parts. The curve's constant allows for how many labelled rows of
each class there are, and for ``COST``.

The model is fitted on the whole texts of at most ``TRAIN_DOCS`` labelled
documents of each class, taken by a hash of their ids; a document with which
a class would have more than ``TRAIN_BYTES`` bytes is passed over. Only rows
outside the held-out fifth (crc32 of the id) and with a label are used for
fitting; scores look at texts only. The curve sees the share of windows that
gain, so a text does not score higher for being long.

Null and empty texts have no windows and the score of texts without gain, as
all such texts have. Without labelled texts of both classes every score is the
share of toxic labels, or 0. A repeated id with several labels counts as toxic
if one is; of its texts, one counts. Repeated rows give a row each; a null id is
held out. An empty table gives no rows. A text must fit into memory. Columns
named in keep are passed on whatever they are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tempograph.llm.common import slices, utf8

TRAIN_DOCS, TRAIN_BYTES, CALIBRATION_DOCS = 3000, 24_000_000, 1000
#: Words of a window, and bytes of the two dictionaries.
WINDOW, ORDINARY_BYTES, TOXIC_BYTES = 8, 16_384, 16_384
#: How many standard deviations more common a word of toxic texts can have to be, how many times it must be, and the gains that can be a window's threshold.
CONTRASTS, RATIO, GAINS = (3.0, 5.0), 4, (2, 3, 4, 5)
#: The held-out share of ids is one in so many; the parts into which training rows are dealt.
FOLDS, PARTS = 5, 2
#: How many clean documents lost weigh as much as a toxic one left in.
COST = 2
#: The longest window in bytes; longer words are cut.
WINDOW_BYTES = 1024

_CLEAN = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


class Model(NamedTuple):
    """Dictionaries, the gain from which a window counts, and the curve's constant and slopes."""

    ordinary: bytes
    toxic: bytes
    least: int
    curve: tuple[float, float, float]


def words(text: bytes) -> list[bytes]:
    return text.translate(_CLEAN).split()


def windows(text: bytes) -> Iterator[bytes]:
    """All words of a text, a few at a time."""
    w = words(text)
    for k in range(0, len(w), WINDOW):
        part = b" ".join(w[k : k + WINDOW])
        for at in range(0, len(part), WINDOW_BYTES):
            yield part[at : at + WINDOW_BYTES]


class Scorer:
    """Scores texts by a model."""

    def __init__(self, model: Model):
        self.model = model
        # A thorough search: with a hasty one the two lengths differ by chance.
        params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_BTLAZY2, window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=4, target_length=0, write_content_size=False, write_checksum=False, write_dict_id=False)
        both = [model.ordinary, model.toxic + model.ordinary]
        self.pair = [zstandard.ZstdCompressor(dict_data=_dictionary(d, params), compression_params=params).compress for d in both]

    def gains(self, text: bytes) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        plain, toxic = self.pair
        return np.fromiter((len(plain(w)) - len(toxic(w)) for w in windows(text)), np.int64)

    def score(self, text: bytes) -> float:
        if not self.model.toxic:
            return 1 / (1 + float(np.exp(-self.model.curve[0])))
        return float(_curve(self.model.curve, features(self.gains(text), self.model.least)))


def _dictionary(content: bytes, params: zstandard.ZstdCompressionParameters) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=params)
    return d


def features(gains: np.ndarray, least: int) -> np.ndarray:
    """The percentage of windows that gain enough, on a log scale, and by how much they do at most."""
    enough = gains[gains >= least]
    return np.array([np.log1p(100 * len(enough) / max(1, len(gains))), min(12, enough.max()) / 12 if len(enough) else 0.0])


def _curve(c: tuple[float, float, float], x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(c[0] + x @ np.array(c[1:]), -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Constant and slopes, by Newton's method with a slight pull to zero."""
    a = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ c, -30, 30)))
        grad = a.T @ (y - p) - 0.1 * c * (0, 1, 1)
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 0.1, 0.1])
        c = c + np.linalg.solve(hess, grad)
    return float(c[0]), max(0.0, float(c[1])), max(0.0, float(c[2]))


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary, or the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[:size]


def _spread(texts: list[bytes]) -> Counter[bytes]:
    """In how many texts a word stands between neighbours that it had in none before; copies of a text count once."""
    seen: set[int] = set()  # hashes of a word and its neighbours
    out: Counter[bytes] = Counter()
    for t in texts:
        w = words(t)
        around = {hash(x): x[1] for x in zip([b"", *w], w, [*w[1:], b""])}
        new = around.keys() - seen
        out.update({around[h] for h in new})
        seen |= new
    return out


def contrasts(toxic: list[bytes], ordinary: list[bytes]) -> dict[bytes, float]:
    """By how many standard deviations each word is more common in toxic texts, of the words that are at least RATIO times as common there."""
    around = [_spread(texts) for texts in (toxic, ordinary)]
    n, m = len(toxic), len(ordinary)
    out = {}
    for w, a in around[0].items():
        b = around[1][w]
        if len(w) > 2 and a > 2 and a / n > RATIO * b / m:
            share = (a + b) / (n + m)
            out[w] = (a / n - b / m) / (share * (1 - share) * (1 / n + 1 / m)) ** 0.5 if share < 1 else float("inf")
    return out


def toxic_dictionary(toxic: list[bytes], apart: dict[bytes, float], least: float) -> bytes:
    """A dictionary of what sets toxic texts apart; empty where nothing does."""
    parts = [x for t in toxic if (x := b" ".join(w for w in words(t) if apart.get(w, 0.0) > least))]
    return _trained([b" " + x + b" " for x in parts], TOXIC_BYTES) if parts else b""


def ordinary_dictionary(ordinary: list[bytes]) -> bytes:
    return _trained([w for t in ordinary for w in windows(t)], ORDINARY_BYTES)


def fit(toxic: list[bytes], ordinary: list[bytes], seen: tuple[int, int] | None = None) -> Model:
    """Dictionaries and thresholds from labelled texts; seen: how many labelled rows of either class they stand for."""
    n, m = seen or (len(toxic), len(ordinary))
    if not toxic or not ordinary:
        share = (n + 1e-9) / (n + m + 1e-6)
        return Model(b"", b"", GAINS[0], (float(np.log(share / (1 - share))) if 0 < share < 1 else -20.0, 0.0, 0.0))
    gains: dict[float, list[np.ndarray]] = {c: [] for c in CONTRASTS}
    y: list[float] = []
    for k in range(PARTS):
        learnt = [[t for j, t in enumerate(texts) if j % PARTS != k] for texts in (toxic, ordinary)]
        scored = [[t for j, t in enumerate(texts) if j % PARTS == k][:CALIBRATION_DOCS] for texts in (toxic, ordinary)]
        y += [1.0] * len(scored[0]) + [0.0] * len(scored[1])
        apart, plain = contrasts(*learnt) if all(learnt) else {}, ordinary_dictionary(learnt[1])
        scorers = [Scorer(Model(plain, toxic_dictionary(learnt[0], apart, c), 0, (0.0, 0.0, 0.0))) for c in CONTRASTS]
        for t in [t for texts in scored for t in texts]:
            parts = list(windows(t))
            before = [len(scorers[0].pair[0](w)) for w in parts]
            for c, scorer in zip(CONTRASTS, scorers):
                gains[c].append(np.array([n - len(scorer.pair[1](w)) for n, w in zip(before, parts)], np.int64))
    label, best = np.array(y), None
    for c in CONTRASTS:
        for least in GAINS:
            x = np.array([features(g, least) for g in gains[c]])
            curve = _logistic(x, label)
            p = _curve(curve, x)
            likelihood = float(np.mean(np.log(np.where(label > 0, p, 1 - p) + 1e-9)))
            if best is None or likelihood > best[0]:
                best = likelihood, c, least, curve
    _, contrast, least, (constant, *slopes) = best
    n_toxic = int(label.sum())
    constant += float(np.log(COST * n / max(1, n_toxic)) - np.log(m / max(1, len(label) - n_toxic)))
    tox = toxic_dictionary(toxic, contrasts(toxic, ordinary), contrast)
    if not tox:
        return Model(b"", b"", least, (float(np.log(n / m)), 0.0, 0.0))
    return Model(ordinary_dictionary(ordinary), tox, least, (constant, *slopes))


def held_out(id_col: Column) -> Column:
    """True for the fifth of ids that no label is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.encode(id_col.cast("string"), "utf-8")), F.lit(FOLDS)) == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits a model on a bounded sample of the labelled documents outside the held-out fifth."""
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_y")).where("_id is not null and _y is not null").where(~held_out(F.col("_id"))).groupBy("_id").agg(F.max("_y").alias("_y"))
    seen = known.agg(F.count_if(F.col("_y") > 0), F.count_if(F.col("_y") <= 0)).first()
    sample = None
    for y in (0, 1):
        some = known.where((F.col("_y") > 0) == bool(y)).withColumn("_h", F.xxhash64("_id")).orderBy("_h", "_id").limit(TRAIN_DOCS).withColumn("_y", F.lit(y))
        sample = some if sample is None else sample.unionByName(some)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text_col}`").cast("string").alias("_t")).where("_t is not null")
    # Of the texts of a repeated id the one that sorts last by hash counts.
    sizes = texts.join(F.broadcast(sample), "_id").groupBy("_y", "_h", "_id").agg(F.max(F.struct(F.xxhash64("_t").alias("h"), F.octet_length("_t").alias("n"))).alias("t")).select("_y", "_h", "_id", "t.*").collect()  # at most 2 * TRAIN_DOCS rows
    left, taken = [TRAIN_BYTES, TRAIN_BYTES], []
    for r in sorted(sizes):
        if r["n"] <= left[r["_y"]]:
            left[r["_y"]] -= r["n"]
            taken.append((r["_id"], r["_y"], r["h"]))
    chosen = docs.sparkSession.createDataFrame(taken, "_id long, _y int, _text long")
    same = (texts["_id"] == chosen["_id"]) & (F.xxhash64("_t") == chosen["_text"])
    rows = texts.join(F.broadcast(chosen), same).select("_y", "_t", texts["_id"]).groupBy("_id", "_y").agg(F.first("_t").alias("_t")).collect()  # at most 2 * TRAIN_BYTES
    rows.sort(key=lambda r: (r["_id"], r["_t"]))
    return fit([r["_t"].encode() for r in rows if r["_y"]], [r["_t"].encode() for r in rows if not r["_y"]], tuple(seen))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted, and the columns of docs named in keep, for each row."""
    keep = keep or []
    # A text that is kept goes to the tasks once and comes back as it went.
    same = text_col in keep and isinstance(docs.schema[text_col].dataType, StringType)
    others = [c for c in keep if not (same and c == text_col)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))  # two dictionaries of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*shared.value))
        for b in slices(batches):
            names = ["doc_id", "kept", *["text"] * same]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in names), pa.array([scorer.score(t) for t in utf8(b["text"])], pa.float64())], [*names, "score"])

    scored = rows.mapInArrow(run, f"doc_id long, kept {rows.schema['kept'].dataType.simpleString()}, {'text string, ' * same}score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[(F.col("kept")[c] if c in others else F.col("text")).alias(c) for c in keep])


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not predicted to be toxic."""
    model = train(docs, labels, id_col, text_col)
    others = [c for c in docs.columns if c != text_col]
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(0).alias("none")]).alias("_doc"), F.col(f"`{id_col}`").alias("_score_id"), F.col(f"`{text_col}`").alias("_score_text"))
    left = score_documents(plain, model, "_score_id", "_score_text", keep=["_doc", "_score_text"]).where("predicted = 0")
    return left.select(*[(F.col("_doc")[c] if c in others else F.col("_score_text")).alias(c) for c in docs.columns])


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns and scores."""
    return score_documents(docs, train(docs, labels))
