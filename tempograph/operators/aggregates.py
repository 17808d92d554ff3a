"""Counts, bands, centrality and totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import ACTIVE, FORGOTTEN, SUPERSEDED, visible

#: Confidence bands (fixed values): name and upper bound, excluded.
BANDS = (("0.0-0.2", 0.2), ("0.2-0.4", 0.4), ("0.4-0.6", 0.6), ("0.6-0.8", 0.8), ("0.8-1.0", None))


def live(facts: DataFrame) -> DataFrame:
    """All but forgotten facts; counts take pending and superseded ones too."""
    return facts.where(F.col("fact_status_id") != FORGOTTEN)


def totals(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts, entities and mean confidence, 0 for none."""
    return live(facts).agg(F.count("*").alias("n_facts"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence")).crossJoin(entities.agg(F.count("*").alias("n_entities")))  # one row each


def top_entities(facts: DataFrame, entities: DataFrame, limit: int) -> DataFrame:
    """The subjects with most facts; counted before names are joined."""
    n = live(facts).groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"))
    return n.join(entities, "id").select("id", "name", "n").orderBy(F.desc("n"), "name", "id").limit(limit)


def by_month(facts: DataFrame) -> DataFrame:
    """Facts by the month in which they begin, or were made (created_at) if that isn't known."""
    return live(facts).groupBy(F.date_format(F.coalesce("valid_from", "created_at"), "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def confidence_bands(facts: DataFrame) -> DataFrame:
    """Every band with its number of facts."""
    band = F.lit(BANDS[-1][0])
    for name, below in reversed(BANDS[:-1]):
        band = F.when(F.col("confidence") < below, name).otherwise(band)
    counts = live(facts).groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    names = facts.sparkSession.createDataFrame([(b,) for b, _ in BANDS], "band string")
    return names.join(F.broadcast(counts), "band", "left").select("band", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # at most five rows


def centrality(facts: DataFrame) -> DataFrame:
    """1 to 2 by how many facts an entity is an end of; each side is counted before the two meet."""
    rows = facts.where(~F.col("fact_status_id").isin(SUPERSEDED, FORGOTTEN))
    ends = [rows.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("n")) for c in ("subject_id", "object_id")]
    n = ends[0].unionByName(ends[1]).where("id is not null").groupBy("id").agg(F.sum("n").alias("n"))
    return n.select("id", "n", (1 + F.least("n", F.lit(50)) / 50).alias("centrality"))


def category_counts(categories: DataFrame, fact_categories: DataFrame) -> DataFrame:
    """Categories with their number of facts, 0 for none."""
    n = fact_categories.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("n"))
    return categories.join(n, "id", "left").select("id", "name", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def matching_all(fact_categories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts that have every wanted category (column category_id)."""
    n = wanted.distinct().agg(F.count("*").alias("n_wanted"))
    hit = fact_categories.join(wanted.distinct(), "category_id", "left_semi").groupBy("fact_id").agg(F.count_distinct("category_id").alias("n"))
    return hit.crossJoin(F.broadcast(n)).where("n = n_wanted").select("fact_id")  # one row


def matching_any(fact_categories: DataFrame, wanted: DataFrame) -> DataFrame:
    """Facts that have a wanted category, with all their categories in order."""
    hit = fact_categories.join(wanted.distinct(), "category_id", "left_semi").select("fact_id").distinct()
    return fact_categories.join(hit, "fact_id", "left_semi").groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set("category_id")), ",").alias("categories"))


def catalogue(facts: DataFrame, fact_categories: DataFrame, asked: DataFrame, match_all: bool, limit: int) -> DataFrame:
    """The visible facts for each ask (ask_id, category_id) that have all or any of its categories: ask_id, rank by confidence, fact_id and all categories of the fact; the limit is held between 1 and 50."""
    wanted = asked.distinct()
    n = wanted.groupBy("ask_id").agg(F.count("*").alias("n_wanted"))
    hits = fact_categories.distinct().join(wanted, "category_id").groupBy("ask_id", "fact_id").agg(F.count("*").alias("n")).join(n, "ask_id")
    hits = hits.where("n = n_wanted") if match_all else hits
    best = W.partitionBy("ask_id").orderBy(F.desc("confidence"), "fact_id")
    rows = hits.join(facts.where(visible()).select(F.col("id").alias("fact_id"), "confidence"), "fact_id").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= min(max(limit, 1), 50))
    lists = fact_categories.join(rows.select("fact_id").distinct(), "fact_id", "left_semi").groupBy("fact_id").agg(F.array_sort(F.collect_set("category_id")).alias("categories"))
    return rows.join(lists, "fact_id").select("ask_id", "rank", "fact_id", "categories")


def repeated_rejections(facts: DataFrame, least: int) -> DataFrame:
    """Rejected actions that a subject has stated often enough."""
    rows = facts.where((F.col("predicate") == "rejected_action") & (F.col("fact_status_id") == ACTIVE))
    return rows.groupBy("subject_id", "object_id", "object_literal").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def parent_confidence(facts: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Signed sum of the parents' confidence, and how many parents there are, of each child."""
    parents = dependencies.join(facts.select(F.col("id").alias("parent_fact_id"), "confidence"), "parent_fact_id")
    return parents.groupBy("child_fact_id").agg(F.sum(F.when(F.col("is_positive"), F.col("confidence")).otherwise(-F.col("confidence"))).alias("total"), F.count("*").alias("n"))


def session_tokens(messages: DataFrame) -> DataFrame:
    """Estimated tokens and user turns of each session."""
    return messages.groupBy("session_id").agg(F.coalesce(F.sum(F.expr("chars div 4")), F.lit(0)).alias("tokens"), F.count_if(F.col("role") == "user").alias("user_turns"))


def turns(messages: DataFrame) -> DataFrame:
    """Each message with the number of its turn; a turn begins when the user speaks."""
    so_far = W.partitionBy("session_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return messages.withColumn("segment", F.sum((F.col("role") == "user").cast("long")).over(so_far))


def trimmed(messages: DataFrame, budget: int) -> DataFrame:
    """The newest messages of each session whose tokens fit into the budget together."""
    after = W.partitionBy("session_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)
    return messages.withColumn("tokens", F.sum(F.expr("chars div 4")).over(after)).where(F.col("tokens") <= budget)
