"""Writing preferences: who wins, and what the audit says, for all writes at once.

A preference is identified by entity (null for everyone), key and its set of
contexts. A write meets what the writes before it have left; that state is
known from two running values, whether an explicit write came before and the
highest confidence so far, so windows settle a whole batch without a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_KEYS = ["entity_id", "key", "context_set"]


def context_set(contexts: DataFrame, key: str = "preference_id") -> DataFrame:
    """The contexts of each preference as a sorted list without repetitions: equal lists are equal sets."""
    return contexts.groupBy(key).agg(F.array_sort(F.collect_set(F.struct("context_key", "context_value"))).alias("context_set"))


def identified(preferences: DataFrame, contexts: DataFrame, id_col: str = "id") -> DataFrame:
    """Preferences with their set of contexts, an empty list without any."""
    sets = context_set(contexts).withColumnRenamed("preference_id", id_col)
    rows = preferences.join(sets, id_col, "left")
    return rows.withColumn("context_set", F.coalesce("context_set", F.array().cast(sets.schema["context_set"].dataType)))


def valid(confidence: Column, explicit: Column) -> Column:
    """Explicit preferences are certain, others have a confidence from 0 to 1."""
    return F.coalesce(F.when(explicit, confidence == 1.0).otherwise(confidence.between(0.0, 1.0)), F.lit(False))


def upserted(there: DataFrame, writes: DataFrame) -> DataFrame:
    """What each write does, in the order of arrival within its preference.

    there and writes have id, entity_id, key, context_set, value, confidence and
    overridden_by_user; writes have arrival, and what is there counts as before
    all of them. The rules: an inferred write never replaces an explicit
    preference; an explicit one always does; of two inferred ones the more
    confident stays, the earlier one if they tie. Writes whose confidence isn't
    valid change nothing.

    Returns for each write: its id and keys, action (created, overwritten,
    rejected, kept or invalid), preference_id (of the row it met or made),
    old_value, new_value, and reason, which is null where no audit row is
    written.
    """
    rows = there.withColumn("arrival", F.lit(None).cast("long")).unionByName(writes.withColumn("arrival", F.col("arrival").cast("long")).select(*there.columns, "arrival"))
    rows = rows.withColumn("ok", F.col("arrival").isNull() | valid(F.col("confidence"), F.col("overridden_by_user")))
    order = W.partitionBy(*_KEYS).orderBy(F.col("arrival").asc_nulls_first(), "id")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    explicit = F.coalesce(F.max((F.col("ok") & F.col("overridden_by_user")).cast("int")).over(before), F.lit(0)) == 1
    best = F.max(F.when(F.col("ok"), F.col("confidence"))).over(before)
    some = F.count(F.when(F.col("ok"), 1)).over(before) > 0
    seen = rows.withColumn("_explicit", explicit).withColumn("_best", best).withColumn("_some", some)
    action = (
        F.when(~F.col("ok"), "invalid")
        .when(~F.col("_some"), "created")
        .when(F.col("overridden_by_user"), "overwritten")
        .when(F.col("_explicit"), "rejected")
        .when(F.col("confidence") > F.col("_best"), "overwritten")
        .otherwise("kept")
    )
    reason = F.when(F.col("action") == "created", "").when(F.col("action") == "overwritten", F.when(F.col("_explicit"), "updated by user").when(F.col("overridden_by_user"), "overridden by user").otherwise("higher confidence inferred preference")).when((F.col("action") == "kept") & (F.col("confidence") == F.col("_best")), "equal confidence inferred preference")
    acted = seen.withColumn("action", action).withColumn("reason", reason)
    held = F.last(F.when(F.col("action").isin("created", "overwritten"), F.struct("value")), ignorenulls=True).over(before)["value"]
    made = F.first(F.when(F.col("action") == "created", F.col("id")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    done = acted.withColumn("old_value", held).withColumn("preference_id", made)
    return done.where("arrival is not null").select("id", *_KEYS, "arrival", "action", "preference_id", "old_value", F.col("value").alias("new_value"), "confidence", "overridden_by_user", "reason")


def preference_audit(steps: DataFrame) -> DataFrame:
    """The audit rows of writes, as upserted() gives them: preference_id, change (created or confidence_change), old_value, new_value, reason."""
    change = F.when(F.col("action") == "created", "created").otherwise("confidence_change")
    return steps.where("reason is not null and action <> 'invalid'").select("preference_id", "arrival", change.alias("change"), F.when(F.col("action") != "created", F.col("old_value")).alias("old_value"), "new_value", F.nullif(F.col("reason"), F.lit("")).alias("reason"))


def preferences_after(there: DataFrame, steps: DataFrame) -> DataFrame:
    """The preferences as the writes leave them: preference_id, keys, value, confidence, overridden_by_user and the write they come from (null for what was there)."""
    last = steps.where("action in ('created', 'overwritten')").groupBy("preference_id").agg(F.max_by(F.struct(*_KEYS, F.col("new_value").alias("value"), "confidence", "overridden_by_user", F.col("id").alias("written_by")), "arrival").alias("w")).select("preference_id", "w.*")
    rest = there.select(F.col("id").alias("preference_id"), *_KEYS, "value", "confidence", "overridden_by_user", F.lit(None).cast(steps.schema["id"].dataType).alias("written_by"))
    return rest.join(last.select("preference_id"), "preference_id", "left_anti").unionByName(last)
