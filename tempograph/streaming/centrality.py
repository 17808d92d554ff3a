"""Degree centrality kept up to date by signed changes instead of a scan of all facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.functions.predicates import FORGOTTEN, SUPERSEDED

#: Ends of facts that count at most (fixed value).
FULL = 50


def deltas(changes: DataFrame) -> DataFrame:
    """entity_id and delta of changes of facts, for both ends.

    A change has subject_id, object_id, old_status (null: the fact is new) and
    new_status (null: it is gone for good). A fact counts for its ends unless it
    is superseded or forgotten, so a change that doesn't alter that gives
    nothing, and changes add up in any order.
    """
    counts = lambda s: F.coalesce(~F.col(s).isin(SUPERSEDED, FORGOTTEN), F.lit(False)).cast("int")
    moved = changes.withColumn("delta", (counts("new_status") - counts("old_status")).cast("long")).where("delta <> 0")
    return moved.select(F.explode(F.array_compact(F.array("subject_id", "object_id"))).alias("entity_id"), "delta")


def boost(n: Column) -> Column:
    return 1 + F.least(n, F.lit(FULL)) / F.lit(float(FULL))


def brought_forward(counts: DataFrame, changed: DataFrame) -> DataFrame:
    """entity_id and n after changes (entity_id, delta): entities without an end left go. Only sums of changes meet the counts."""
    sums = changed.groupBy("entity_id").agg(F.sum("delta").alias("delta"))
    both = counts.select("entity_id", "n").join(sums, "entity_id", "full")
    return both.select("entity_id", (F.coalesce("n", F.lit(0)) + F.coalesce("delta", F.lit(0))).alias("n")).where("n > 0")


def maintained(changes: DataFrame) -> DataFrame:
    """Of a stream of changes, entity_id, n and centrality of the entities that each batch touches; Spark's state store holds a number for each entity. For output mode update (or complete)."""
    sums = deltas(changes).groupBy("entity_id").agg(F.sum("delta").alias("n"))
    return sums.select("entity_id", "n", boost(F.greatest("n", F.lit(0))).alias("centrality"))
