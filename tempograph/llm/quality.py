"""Operator 13: quality rules whose cutoffs have a controlled risk.

A text is described by counts, and each rule turns counts into a value from 0
to 1000, higher for worse; a rule rejects values from its cutoff on. Cutoffs are
chosen for each stratum (language) from the labelled documents that pass the
fixed base rules, in two steps on different documents:

* a quarter of them, by a checksum of the id, proposes: rule after rule, the
  cutoff with the largest gain (bad documents rejected, less ``WORTH`` for each
  good one; of equal gains the mildest cutoff) is taken, on what earlier rules
  left, until none has a gain;
* the others hold out: with n good ones in a stratum, a cutoff is certified if
  so few of them, k, are rejected that the exact binomial chance of k or fewer at
  a rate of ``RISK`` / (the stratum's rules) is at most ``ERROR`` / (all proposed
  rules). Cutoffs are tried from the mildest on down to the proposed one, and the
  first that fails ends the row (a fixed sequence, which needs no correction);
  over rules and strata the correction is Bonferroni's.

So with a chance of at least 1 - ``ERROR`` no stratum rejects over ``RISK`` of the
good documents that pass the base rules. A stratum with too few labelled ones
for any certificate, or without labels, rejects nothing beyond the base rules.

Counts are per stratum, rule and value, so hot languages are added up before
they are shuffled. Null texts have no words and fail the base rules; null
languages are ``und``. Repeated ids are one labelled document (that of the
smallest values, with the worst of its labels); every row gets a verdict. Null
labels are none. An empty table gives no rows, and one without labels certifies
nothing. A text must fit into memory with its words. Other columns are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.llm.common import cut, slices, stored, utf8

#: Share of good documents that a stratum may reject, chance of error over all strata, and bad documents that a good one is worth.
RISK, ERROR, WORTH = 0.02, 0.05, 10
#: Words of a text, and percent of repeated words, from which and up to which the base rules pass.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The highest value of a rule; the cutoff above rejects nothing.
TOP = 1000
#: Strata that are broadcast with their cutoffs; more meet by shuffle.
FEW = 10_000

_SPACE, _SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
_LATER = _SPACE + bytes(range(0x80, 0xC0))  # white space, and all bytes of a code point but its first
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: list[bytes], wide: int = 3) -> int:
    """Words that lie in runs of some words that are found twice or more, the first included."""
    if len(words) <= wide:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    run = ids
    for k in range(1, wide):
        _, run = np.unique(run[:-1] << 32 | ids[k:], return_inverse=True)
    twice = np.flatnonzero(np.bincount(run)[run] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    edges[twice] += 1
    np.subtract.at(edges, twice + wide, 1)
    return int((np.cumsum(edges) > 0).sum())


def counts(text: bytes) -> tuple[int, ...]:
    """The counts of one text: words, code points in words, symbols, repeated lines, repeated words, lines with a word."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(text.translate(None, _LATER)), len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for s in slices([b]):
            columns = zip(*map(counts, utf8(s["text"])))
            yield pa.RecordBatch.from_arrays([s["doc_id"], s["stratum"], *[pa.array(c, pa.int64()) for c in columns]], ["doc_id", "stratum", *_COUNTS])


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, stratum, the counts and base_failed of each row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("stratum"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = rows.mapInArrow(_counted, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in _COUNTS))
    return made.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))


def _share(part: str, whole: str, of: int = TOP) -> Column:
    return F.least(F.lit(TOP), F.floor(F.col(part) * of / F.greatest(F.col(whole), F.lit(1)))).cast("int")


def rules() -> dict[str, Column]:
    """The rules by name: symbols and repeated words and lines per thousand, and the mean length of words in hundredths, from both ends."""
    length = _share("word_chars", "n_words", 100)
    return {"symbols": _share("n_symbols", "word_chars"), "long_words": length, "short_words": F.lit(TOP) - length, "dup_lines": _share("n_dup_lines", "n_lines"), "repeats": _share("n_repeat_words", "n_words")}


def most_allowed(n: int, rate: float, chance: float) -> int:
    """The largest k for which a binomial of n and rate is at most k with no more than the chance; -1 if there is none."""

    def at_most(k: int) -> float:
        logs = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(rate) + (n - k) * math.log1p(-rate)
        term = total = 1.0
        for j in range(k, 0, -1):  # terms fall from here on, as k is below the mean
            term *= j * (1 - rate) / ((n - j + 1) * rate)
            total += term
            if term < total * 1e-17:
                break
        return math.exp(logs) * total

    low, high = -1, int(n * rate)
    while low < high:
        k = (low + high + 1) // 2
        if at_most(k) <= chance:
            low = k
        else:
            high = k - 1
    return low


def _values(rows: DataFrame) -> DataFrame:
    """A row for each row and rule: stratum, rule, value, good."""
    return rows.select("stratum", "good", F.posexplode("values").alias("rule", "value"))


def _from_top(rows: DataFrame) -> DataFrame:
    """stratum, rule, cutoff, and how many good and bad rows have at least that value, for each value above 0 that occurs."""
    at = _values(rows).where("value > 0").groupBy("stratum", "rule", F.col("value").alias("cutoff")).agg(F.sum("good").alias("g"), F.sum(1 - F.col("good")).alias("b"))
    down = W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    return at.select("stratum", "rule", "cutoff", F.sum("g").over(down).alias("good"), F.sum("b").over(down).alias("bad"))


def _with(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined to a cut table of strata, which is broadcast if it is small."""
    return rows.join(F.broadcast(table) if table.count() <= FEW else table, "stratum", how)


def proposed(rows: DataFrame, n_rules: int, worth: int = WORTH) -> DataFrame:
    """stratum, rule, cutoff: what the labelled rows (stratum, values, good) speak for."""
    found, left = [], rows
    for _ in range(n_rules):
        gains = _from_top(left).withColumn("gain", F.col("bad") - F.col("good") * worth).where("gain > 0")
        best = cut(gains.groupBy("stratum").agg(F.max(F.struct("gain", "cutoff", -F.col("rule"))).alias("best")).select("stratum", (-F.col("best.col3")).alias("rule"), F.col("best.cutoff").alias("cutoff")))
        found.append(best)
        if best.isEmpty():
            break
        left = cut(_with(left, best, "left").where(F.col("rule").isNull() | (F.get("values", F.col("rule")) < F.col("cutoff"))).select("stratum", "values", "good"))
    return reduce(DataFrame.unionByName, found)


def certified(rows: DataFrame, wished: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """stratum, rule, cutoff: the cutoffs nearest to those wished that the held-out rows certify."""
    wished = cut(wished)
    tests = wished.count()
    good = rows.where("good = 1")
    n = good.groupBy("stratum").agg(F.count("*").alias("n"))
    share = wished.groupBy("stratum").agg(F.count("*").alias("rules"))

    def allow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = [most_allowed(m, risk / r, error / tests) for m, r in zip(b["n"].to_pylist(), b["rules"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["stratum"], pa.array(k, pa.int64())], ["stratum", "allowed"])

    allowed = n.join(share, "stratum").mapInArrow(allow, "stratum string, allowed long").where("allowed >= 0")
    steps = _from_top(good).withColumnRenamed("cutoff", "value").drop("bad")
    # Good rows from the last value that is too many, and so what lies above it is certified.
    met = wished.join(allowed, "stratum").join(steps, ["stratum", "rule"], "left")
    failing = F.max(F.when(F.col("good") > F.col("allowed"), F.col("value")))
    return met.groupBy("stratum", "rule", "cutoff").agg(failing.alias("failing")).select("stratum", "rule", F.greatest("cutoff", F.coalesce(F.col("failing") + 1, F.lit(1))).cast("int").alias("cutoff"))


def labelled(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", quality_col: str = "quality") -> DataFrame:
    """doc_id, stratum, values and good (1 or 0) of each document that passes the base rules and has a label; rows as described() gives them."""
    values = F.array(*rules().values())
    own = rows.where("not base_failed and doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("stratum", values.alias("values"))).alias("d"))
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{quality_col}`").cast("int").alias("quality")).where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    return own.join(known, "doc_id").select("doc_id", "d.stratum", "d.values", "good")


def cutoffs(rows: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, worth: int = WORTH) -> DataFrame:
    """stratum, rule (its place among rules()) and certified cutoff."""
    known = cut(labelled(rows, labels).withColumn("fits", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0))
    wished = proposed(known.where("fits").drop("fits", "doc_id"), len(rules()), worth)
    return certified(known.where("not fits"), wished, risk, error)


def judged(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, worth: int = WORTH) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and which rules reject (a list of names)."""
    rows = stored(described(docs), "described")
    names = F.array(*[F.lit(r) for r in rules()])
    limits = cut(cutoffs(rows, labels, risk, error, worth).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits")))
    met = _with(rows.withColumn("values", F.array(*rules().values())), limits, "left")
    over = F.filter(F.sequence(F.lit(0), F.lit(len(rules()) - 1)), lambda r: F.get("values", r) >= F.coalesce(F.col("limits")[r], F.lit(TOP + 1)))
    rejecting = F.when(F.col("base_failed") | F.col("limits").isNull(), F.array().cast("array<string>")).otherwise(F.transform(over, lambda r: F.get(names, r)))
    return met.withColumn("rejected_by", rejecting).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).select("doc_id", *_COUNTS[:5], "base_failed", "kept", "rejected_by")


op13 = judged
