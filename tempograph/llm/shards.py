"""Operator 8: sharding by sampled splitters, with DataFrame functions only.

Records have a key (a hash of their text, so equal texts stand together) and a
size. A size-weighted sample of keys, about ``SAMPLE`` whatever the input,
gives quantile boundaries; records are range-partitioned by them; a range that
came out overfull, such as one with a hot text, is subdivided by a hash of the
id. Positions in bytes then run through all ranges in order, and a record goes
to the shard that its first byte falls into, so shards differ by less than two
records (law ``bytes``). Slots number a shard's records without gaps.

Null texts have no bytes and the empty text's checksum. Equal ids and repeated
rows each get a slot of their own; null ids sort first. Only the sample's
boundaries and the totals per range (at most ``RANGES`` and their divisions)
are broadcast. Other columns are passed on where named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.llm.common import cut

#: Shards, bytes that a record has besides its text, expected keys of the sample, and ranges.
SHARDS, EXTRA, SAMPLE, RANGES = 40, 16, 8_000, 800
#: Leading bits of a key that find its boundaries.
_BITS = 12


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, key and tie of each row, with the columns named in keep as kept."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    kept = [F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")] if keep else []
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(EXTRA)).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("key"), *kept).withColumn("tie", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit("tie")))


def boundaries(rows: DataFrame, total: int, ranges: int = RANGES) -> DataFrame:
    """Keys that cut the rows into ranges of about equal size, from a sample in which a row of s bytes has the chance s / step, up to 1."""
    step = max(1, total // SAMPLE)
    chance = F.pmod(F.xxhash64("key", "tie", F.lit("sample")), F.lit(step))
    drawn = rows.where(chance < F.col("size")).groupBy("key").agg(F.sum(F.greatest("size", F.lit(step))).alias("weight"))
    # The sample is bounded, so one window over all of it is.
    upto = drawn.withColumn("upto", F.sum("weight").over(W.orderBy("key"))).withColumn("all", F.sum("weight").over(W.partitionBy()))
    return upto.withColumn("q", F.floor(F.col("upto") * ranges / F.col("all"))).groupBy("q").agg(F.max("key").alias("cut")).select("cut").distinct()


def into_ranges(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows with range: how many boundaries lie below their key. Boundaries are looked up by the key's leading bits."""
    lead = F.shiftright(F.col("cut"), 64 - _BITS) + F.lit(1 << (_BITS - 1))
    near = cuts.groupBy(lead.alias("lead")).agg(F.sort_array(F.collect_list("cut")).alias("cuts"))
    slots = cuts.sparkSession.range(1 << _BITS).select(F.col("id").alias("lead")).join(F.broadcast(near), "lead", "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<long>")))
    slots = slots.withColumn("below", F.sum(F.size("cuts")).over(W.orderBy("lead")) - F.size("cuts"))
    keyed = rows.withColumn("lead", F.shiftright(F.col("key"), 64 - _BITS) + F.lit(1 << (_BITS - 1)))
    found = keyed.join(F.broadcast(slots), "lead")
    return found.withColumn("range", (F.col("below") + F.size(F.filter("cuts", lambda c: c < F.col("key")))).cast("int")).drop("lead", "below", "cuts")


def shard(docs: DataFrame, shards: int = SHARDS, ranges: int = RANGES, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) and the columns of docs named in keep, for each row."""
    rows = records(docs, id_col, text_col, keep)
    narrow = cut(rows.select("key", "tie", "size")) if keep else cut(rows)
    total = narrow.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    cuts = cut(boundaries(narrow, total, ranges))  # at most as many as there are ranges, and one
    ranged = into_ranges(rows if keep else narrow, cuts)
    sizes = (into_ranges(narrow, cuts) if keep else ranged).groupBy("range").agg(F.sum("size").alias("in_range"))
    fair = max(1, total // ranges)
    parts = cut(sizes.where(F.col("in_range") > 2 * fair).select("range", F.ceil(F.col("in_range") / fair).cast("long").alias("parts")))
    divided = ranged.join(F.broadcast(parts), "range", "left").withColumn("part", F.coalesce(F.pmod("tie", "parts"), F.lit(0)).cast("int")).drop("parts")
    by = ["range", "part"]
    filled = divided.groupBy(*by).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = cut(filled.withColumn("start", F.sum("bytes").over(W.orderBy(*by)) - F.col("bytes")).select(*by, "start"))  # a row for each division
    inside = W.partitionBy(*by).orderBy("key", F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    placed = divided.join(F.broadcast(before), by).withColumn("at", F.col("start") + F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    placed = placed.withColumn("shard", F.least(F.floor(F.col("at") * shards / F.lit(max(1, total))), F.lit(shards - 1)).cast("int"))
    counts = placed.groupBy(*by, "shard").agg(F.count("*").alias("n"))
    first = cut(counts.withColumn("base", F.sum("n").over(W.partitionBy("shard").orderBy(*by)) - F.col("n")).select(*by, "shard", "base"))
    numbered = placed.withColumn("nth", F.row_number().over(W.partitionBy(*by, "shard").orderBy("at", "doc_id", "text_crc32")) - 1).join(F.broadcast(first), [*by, "shard"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.col("kept")[c].alias(c) for c in keep or []])


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, **how) -> None:
    """Writes the rows with all their columns below path, in a folder shard=K for each shard, in slot order."""
    out = shard(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record"), F.col(f"`{how.pop('id_col', 'doc_id')}`").alias("_id"), F.col(f"`{how.pop('text_col', 'text')}`").alias("_text")), shards, id_col="_id", text_col="_text", keep=["record"], **how)
    out.select("shard", "slot", "record").repartitionByRange(shards * 4, "shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


op8 = shard
