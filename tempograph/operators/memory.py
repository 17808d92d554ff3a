"""Ranked memory of subjects, and upcoming facts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import visible
from tempograph.functions.scalars import temporal_boost
from tempograph.operators.aggregates import centrality
from tempograph.streaming.folds import fold_sorted

#: Buckets of memory, and the bytes of a budget that identity facts have first (fixed values).
IDENTITY, GENERAL, IDENTITY_BYTES = 1, 5, 200


def ranked_memory(facts: DataFrame, entities: DataFrame, categories: DataFrame, fact_categories: DataFrame, now: Column, min_confidence: float, limit: int | None = None) -> DataFrame:
    """The facts of each subject by confidence, category weight, time and the subject's centrality, with their bucket; all, or the best up to a limit."""
    weights = fact_categories.join(categories.select(F.col("id").alias("category_id"), "memory_weight", "memory_bucket_id"), "category_id").groupBy(F.col("fact_id").alias("id")).agg(F.max("memory_weight").alias("weight"), F.min("memory_bucket_id").alias("bucket"))
    rows = facts.where(visible() & (F.col("confidence") >= min_confidence)).join(weights, "id", "left").join(centrality(facts).select(F.col("id").alias("subject_id"), "centrality"), "subject_id", "left")
    score = F.col("confidence") * F.coalesce("weight", F.lit(0.5)) * temporal_boost(F.col("valid_from"), now) * F.coalesce("centrality", F.lit(1.0))
    scored = rows.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(W.partitionBy("subject_id").orderBy(F.desc("score"), "id")))
    if limit is not None:
        scored = scored.where(F.col("rank") <= limit)
    names = entities.select(F.col("id").alias("object_id"), "name")
    return scored.join(names, "object_id", "left").select("subject_id", "id", F.coalesce("name", "object_literal").alias("object"), F.coalesce("bucket", F.lit(GENERAL)).cast("int").alias("bucket"), "score", "rank")


def budgeted(ranked: DataFrame, budget: int, excluded: tuple[int, ...] = ()) -> DataFrame:
    """The facts of each subject whose objects' bytes fit into a budget.

    First come identity facts, by rank, as far as they fit into IDENTITY_BYTES
    of it; the others of them join the rest, which comes by rank. A fact that
    doesn't fit is cut once, and that uses the budget up; where nothing of it
    would be left it is passed over. Buckets in excluded cost nothing, but for
    identity facts that fit first. A subject's rows are folded in order, none
    are held. Without a column bucket there are no identity facts.
    """
    bucket = F.coalesce("bucket", F.lit(GENERAL)) if "bucket" in ranked.columns else F.lit(GENERAL)
    rows = ranked.select("subject_id", "id", "object", "rank", bucket.alias("bucket"))
    reserve = min(budget, IDENTITY_BYTES)

    def size(row) -> int:
        return len((row.object or "").encode())

    def reserved(used, row):
        used, n = used or 0, size(row)
        fits = used + n <= reserve
        return used + n * fits, (fits,)

    def fill(left, row):
        left, n = budget if left is None else left, size(row)
        if row.phase > 0 and row.bucket in excluded:
            return left, (True, row.object)
        if n <= left:
            return left - n, (True, row.object)
        short = row.object.encode()[: max(0, left - 3)].decode("utf-8", "ignore")
        return (0, (True, short + "…")) if short else (left, (False, None))

    first = fold_sorted(rows.where(F.col("bucket") == IDENTITY), "subject_id", ["rank"], reserved, "fits boolean")
    phased = first.withColumn("phase", F.when(F.col("fits"), 0).otherwise(1)).drop("fits").unionByName(rows.where(F.col("bucket") != IDENTITY).withColumn("phase", F.lit(1)))
    return fold_sorted(phased, "subject_id", ["phase", "rank"], fill, "kept boolean, text string").where("kept").select("subject_id", "id", "text", "rank")


def upcoming(facts: DataFrame, entities: DataFrame, now: Column, until: Column) -> DataFrame:
    """Visible facts that begin within a horizon, with days to go."""
    rows = facts.where(visible() & (F.col("valid_from") > now) & (F.col("valid_from") <= until))
    names = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    return rows.join(names, "subject_id").select("subject", "id", F.datediff("valid_from", now).alias("days"))


def merged_duplicates(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Greedy merging of duplicate pairs (a, b) in order: b goes into a unless one of them has gone before. Not a closure.

    A group is the pairs of one triple.
    """
    keyed = pairs.join(facts.select(F.col("id").alias("a"), "subject_id", "predicate", "object_id", "object_literal"), "a")

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        gone: dict[str, str] = {}
        for a, b in sorted(zip(rows["a"], rows["b"])):
            if a not in gone and b not in gone:
                gone[b] = a
        return pd.DataFrame(sorted((k, v) for v, k in gone.items()), columns=["kept", "merged"])

    return keyed.groupBy("subject_id", "predicate", "object_id", "object_literal").applyInPandas(merge, "kept string, merged string")


__all__ = ["budgeted", "merged_duplicates", "ranked_memory", "upcoming"]
