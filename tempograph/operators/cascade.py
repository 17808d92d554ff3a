"""Changes that travel along dependencies, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.functions.scalars import inferred_confidence
from tempograph.plans.lineage import cut

#: Changes up to this size go no further; a fact below the second value is disputed (fixed values).
SMALL, DOUBTFUL = 0.001, 0.20


def _recalculated(children: DataFrame, dependencies: DataFrame, confidence: DataFrame) -> DataFrame:
    """id, depth and the confidence that the parents give, for children (id, depth)."""
    told = dependencies.join(children.select(F.col("id").alias("child_fact_id")), "child_fact_id", "left_semi").join(confidence.select(F.col("id").alias("parent_fact_id"), "confidence"), "parent_fact_id")
    sums = told.groupBy(F.col("child_fact_id").alias("id")).agg(F.sum(F.when(F.col("is_positive"), F.col("confidence")).otherwise(-F.col("confidence"))).alias("total"), F.count("*").alias("n"))
    total, n = F.coalesce("total", F.lit(0.0)), F.coalesce("n", F.lit(0))
    return children.join(sums, "id", "left").select("id", "depth", inferred_confidence(total, F.col("depth"), n).alias("confidence"))


def _involved(facts: DataFrame, dependencies: DataFrame, *columns: str) -> DataFrame:
    """Only facts that depend on others, or on which others depend, narrowed and kept: rounds read these, not all facts."""
    ids = dependencies.select(F.explode(F.array("parent_fact_id", "child_fact_id")).alias("id")).distinct()
    return cut(facts.join(ids, "id", "left_semi").select("id", *columns))


def cascade(facts: DataFrame, dependencies: DataFrame, changed: DataFrame, levels: int = 10_000) -> DataFrame:
    """Confidence of all facts that a change of some (id, confidence) reaches.

    facts has id, confidence, depth. Children are recalculated from all their
    parents; a change of more than SMALL goes on to their children until none is
    left. On a cycle changes get smaller, as depth and breadth weigh them down;
    should some be left after so many levels, that is an error.
    """
    facts, dependencies = _involved(facts, dependencies, "depth", "confidence"), cut(dependencies)
    now = cut(changed.select("id", "confidence"))
    front = now.select("id")
    for _ in range(levels):
        state = facts.select("id", "depth", F.col("confidence").alias("_old")).join(now.withColumnRenamed("confidence", "_new"), "id", "left").select("id", "depth", F.coalesce("_new", "_old").alias("confidence"))
        reached = dependencies.join(front.select(F.col("id").alias("parent_fact_id")), "parent_fact_id", "left_semi").select(F.col("child_fact_id").alias("id")).distinct()
        fresh = _recalculated(state.join(reached, "id", "left_semi").select("id", "depth"), dependencies, state)
        moved = cut(fresh.join(state.select("id", F.col("confidence").alias("_was")), "id").where(F.abs(F.col("confidence") - F.col("_was")) > SMALL).select("id", "confidence"))
        if moved.isEmpty():
            break
        now, front = cut(now.join(moved, "id", "left_anti").unionByName(moved)), moved.select("id")
    else:
        raise RuntimeError(f"confidence still changes after {levels} levels")
    return now


def forget(facts: DataFrame, dependencies: DataFrame, chosen: DataFrame) -> DataFrame:
    """What forgetting facts (id) does: they and inferred facts without any parent left are forgotten, level by level; other children get new confidence, and are disputed if it is low.

    facts has id, confidence, depth, inferred. Returns id, change (forgotten,
    disputed or recalculated) and confidence (null if forgotten).
    """
    facts, dependencies = _involved(facts, dependencies, "depth", "confidence", "inferred"), cut(dependencies)
    gone = front = cut(chosen.select("id").distinct())
    while True:  # ends, as only facts that were there before go
        left = dependencies.join(gone.select(F.col("id").alias("parent_fact_id")), "parent_fact_id", "left_anti").select(F.col("child_fact_id").alias("id"))
        reached = dependencies.join(front.select(F.col("id").alias("parent_fact_id")), "parent_fact_id", "left_semi").select(F.col("child_fact_id").alias("id")).distinct()
        front = cut(facts.where("inferred").select("id").join(reached, "id", "left_semi").join(left, "id", "left_anti").join(gone, "id", "left_anti"))
        if front.isEmpty():
            break
        gone = cut(gone.unionByName(front))
    stays = dependencies.join(gone.select(F.col("id").alias("parent_fact_id")), "parent_fact_id", "left_anti")
    hurt = dependencies.join(gone.select(F.col("id").alias("parent_fact_id")), "parent_fact_id", "left_semi").select(F.col("child_fact_id").alias("id")).distinct().join(gone, "id", "left_anti")
    fresh = _recalculated(facts.join(hurt, "id", "left_semi").select("id", "depth"), stays, facts)
    change = F.when(F.col("confidence") < DOUBTFUL, "disputed").otherwise("recalculated")
    return gone.select("id", F.lit("forgotten").alias("change"), F.lit(None).cast("double").alias("confidence")).unionByName(fresh.select("id", change.alias("change"), "confidence"))
