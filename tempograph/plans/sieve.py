"""Leaving out rows that no key can match before they are shuffled, and dealing out the pairs of hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

#: Bits of a table: so many for a key, at least and at most; 32 MiB is the largest.
PER_KEY, FEWEST, MOST = 16, 1 << 16, 1 << 28
#: Rows of one key that meet the other side's in one task.
CHUNK = 1 << 12


def _places(keys: list[Column], bits: int) -> tuple[Column, Column, Column]:
    """The row of the table, its word of 64 bits and the bit in it."""
    at = F.pmod(F.xxhash64(*keys), F.lit(bits))
    return F.shiftright(at, 10), F.shiftright(at, 6).bitwiseAND(F.lit(15)), at.bitwiseAND(F.lit(63)).cast("int")


def sieved(rows: DataFrame, keys: list[str | Column], wanted: DataFrame, same: list[str | Column], most: int = MOST) -> DataFrame:
    """The rows of which the keys may stand among the same columns of wanted: all that do, and a few others.

    wanted is read twice: its rows are counted, then a bit is set for each of
    them by a hash of its keys. The table of bits grows with the count up to
    most bits and is broadcast; with more keys more other rows pass. Keys are
    whole numbers of any width and strings; with other kinds, or unlike ones,
    all rows pass.
    """
    own, other = rows.select(*keys).schema, wanted.select(*same).schema
    whole = [isinstance(a.dataType, IntegralType) and isinstance(b.dataType, IntegralType) for a, b in zip(own, other)]
    if not all(w or (a.dataType == b.dataType == StringType()) for w, a, b in zip(whole, own, other)):
        return rows

    def hashed(names: list[str | Column]) -> list[Column]:
        cols = [F.col(n) if isinstance(n, str) else n for n in names]
        return [c.cast("long") if w else c for c, w in zip(cols, whole)]

    bits = min(max(FEWEST, 1 << (PER_KEY * max(1, wanted.count()) - 1).bit_length()), most)
    row, word, bit = _places(hashed(same), bits)
    each = wanted.select(row.alias("_row"), word.alias("_word"), bit.alias("_bit")).selectExpr("_row", "_word", "shiftleft(1L, _bit) AS _set")
    table = each.groupBy("_row").agg(F.array(*[F.bit_or(F.when(F.col("_word") == k, F.col("_set")).otherwise(0)) for k in range(16)]).alias("_words"))
    row, word, bit = _places(hashed(keys), bits)
    met = rows.withColumns({"_row": row, "_word": word, "_bit": bit}).join(F.broadcast(table), "_row")
    return met.where(F.expr("getbit(_words[_word], _bit) = 1")).drop("_row", "_word", "_bit", "_words")


def dealt(left: DataFrame, right: DataFrame, keys: list[str], id: str, many: DataFrame, n: str = "n") -> DataFrame:
    """left joined with right, where the left rows of a key in many (keys, and n of its left rows) are dealt by their id over tasks of about CHUNK and meet the right rows in each; many has at most one in CHUNK of the left rows."""
    chunks = many.where(F.col(n) > CHUNK).select(*keys, F.ceil(F.col(n) / CHUNK).alias("_chunks"))
    count = F.coalesce("_chunks", F.lit(1))
    a = left.join(F.broadcast(chunks), keys, "left").withColumn("_chunk", F.pmod(F.xxhash64(id), count)).drop("_chunks")
    b = right.join(F.broadcast(chunks), keys, "left").withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), count - 1))).drop("_chunks")
    return a.join(b, [*keys, "_chunk"]).drop("_chunk")
