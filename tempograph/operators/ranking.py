"""How good rankings are, and whether they have changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def at_k(ranked: DataFrame, truth: DataFrame, key: str, k: int = 5) -> DataFrame:
    """key, hits, recall and precision of the first k results (key, id, rank) against what is expected (key, id): recall is 1 if nothing is, precision 0 if nothing was found."""
    first = ranked.where(F.col("rank") <= k).select(key, "id", F.lit(True).alias("found"))
    both = first.join(truth.select(key, "id").distinct().withColumn("wanted", F.lit(True)), [key, "id"], "full")
    n = both.groupBy(key).agg(F.count_if(F.col("found") & F.col("wanted")).alias("hits"), F.count("found").alias("returned"), F.count("wanted").alias("expected"))
    recall = F.when(F.col("expected") == 0, 1.0).otherwise(F.col("hits") / F.greatest("expected", F.lit(1)))
    return n.select(key, "hits", recall.alias("recall"), (F.col("hits") / F.greatest("returned", F.lit(1))).alias("precision"))


def rates(checked: DataFrame, **conditions: Column) -> DataFrame:
    """One row: the share of rows for which each condition holds, 0 without rows."""
    return checked.agg(*[(F.count_if(c) / F.greatest(F.count("*"), F.lit(1))).alias(name) for name, c in conditions.items()])


def digests(ranked: DataFrame, key: str, n: int = 20) -> DataFrame:
    """key and a digest of its first n ids and scores (columns id, score and rank) in their order."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: F.concat(x["id"].cast("string"), F.lit(":"), F.round(x["score"] * 1e6).cast("bigint").cast("string")))
    return ranked.where(F.col("rank") <= n).groupBy(key).agg(F.md5(F.array_join(parts, ",").cast("binary")).alias("digest"))


def changed(now: DataFrame, last: DataFrame, key: str) -> DataFrame:
    """Digests that are new or differ from the last run's, with what became of those whose ranking is gone (a null digest)."""
    both = now.join(last.select(key, F.col("digest").alias("_last")), key, "full")
    return both.where(~F.col("digest").eqNullSafe(F.col("_last"))).select(key, "digest")
