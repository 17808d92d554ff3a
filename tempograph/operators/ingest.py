"""Incoming facts: words of a closed vocabulary, staging of what it doesn't know, corrections, and facts that wait for the user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import ACTIVE, DISPUTED, FORGOTTEN, is_sensitive
from tempograph.functions.render import initial_confidence
from tempograph.functions.scalars import alias_key


def known_predicates(incoming: DataFrame, vocabulary: DataFrame, name: str = "predicate") -> DataFrame:
    """incoming with canonical, the predicate that may be stated which its word stands for, and default_category; both null where the vocabulary (name, alias, emit_eligible, default_category) has none. Words meet by their normalised form."""
    known = vocabulary.where("emit_eligible").select(F.explode(F.array("name", "alias")).alias("_word"), F.col("name").alias("canonical"), "default_category")
    known = known.select(alias_key(F.col("_word")).alias("_key"), "canonical", "default_category").where("_key is not null").groupBy("_key").agg(F.min(F.struct("canonical", "default_category")).alias("k"))
    return incoming.withColumn("_key", alias_key(F.col(name))).join(known, "_key", "left").withColumn("canonical", F.col("k.canonical")).withColumn("default_category", F.col("k.default_category")).drop("_key", "k")


def staged(unknown: DataFrame, there: DataFrame) -> DataFrame:
    """Facts with unknown predicates for review: stage_id (the first arrival that said the same), arrival, newly_staged, status and payload.

    What says the same, by connector, reference, word and payload, is staged
    once; there are the rows staged before, with those columns and stage_id.
    """
    keys = ["connector_id", "raw_reference", "predicate", "payload"]
    rows = unknown.select("arrival", *keys)
    same = [F.coalesce("connector_id", F.lit(-1)).alias("_c"), F.coalesce("raw_reference", F.lit("")).alias("_r"), F.col("predicate").alias("_p"), F.col("payload").alias("_t")]
    first = rows.groupBy(*same).agg(F.min("arrival").alias("first"))
    old = there.select(*same, F.col("stage_id").alias("_old")).groupBy("_c", "_r", "_p", "_t").agg(F.min("_old").alias("_old"))
    found = rows.select("*", *same).join(first, ["_c", "_r", "_p", "_t"]).join(old, ["_c", "_r", "_p", "_t"], "left")
    return found.select(F.coalesce("_old", "first").alias("stage_id"), "arrival", (F.col("_old").isNull() & (F.col("arrival") == F.col("first"))).alias("newly_staged"), F.lit("unmapped").alias("status"), *keys)


def reviewed(stages: DataFrame, decisions: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Staged facts (stage_id, status) after decisions (stage_id, to: a predicate to map to, null to reject): only unmapped ones change, and only to predicates that may be stated. error says what was refused."""
    may = vocabulary.where("emit_eligible").select(F.col("name").alias("to"), F.lit(True).alias("_may")).distinct()
    met = decisions.join(may, "to", "left").join(stages.select("stage_id", "status"), "stage_id", "left")
    error = F.when(F.col("status").isNull() | (F.col("status") != "unmapped"), "not unmapped").when(F.col("to").isNotNull() & F.col("_may").isNull(), "no predicate that may be stated")
    return met.withColumn("error", error).select("stage_id", F.when(error.isNotNull(), F.col("status")).when(F.col("to").isNull(), "rejected").otherwise("mapped").alias("status"), F.when(error.isNull(), F.col("to")).alias("to"), "error")


def normalized(incoming: DataFrame, vocabulary: DataFrame, categories: DataFrame, now: Column) -> DataFrame:
    """Incoming facts as they are to be written, with outcome: staged (an unknown predicate), refused (a connector's without a reference), pending (sensitive) or insert.

    incoming has arrival, predicate, object (its text), categories (array),
    flagged, confidence, source_type_id, connector, connector_id, raw_reference,
    valid_from, valid_until, correction and scope. Unknown categories are left
    out, and the predicate's own takes their place if none is left. Confidence
    is the explicit one, else the source's, between 0 and 1. A correction counts
    from now on, from the instant that its scope names, or (scope always) for
    the window it states.
    """
    known = known_predicates(incoming, vocabulary)
    listed = known.select("arrival", F.explode("categories").alias("id")).join(categories.select("id"), "id", "left_semi").groupBy("arrival").agg(F.array_sort(F.collect_set("id")).alias("_known"))
    rows = known.join(listed, "arrival", "left")
    numbers = F.coalesce("_known", F.when(F.col("default_category").isNotNull(), F.array("default_category")), F.array().cast("array<bigint>"))
    rows = rows.withColumn("categories", numbers.cast("array<bigint>"))
    confidence = F.least(F.greatest(initial_confidence(F.col("source_type_id"), F.col("connector"), F.col("confidence")), F.lit(0.0)), F.lit(1.0))
    since = F.when(F.col("correction") & F.col("scope").isNull(), now).when(F.col("correction") & (F.col("scope") != "always"), F.coalesce(F.col("scope").try_cast("timestamp"), F.col("valid_from"))).otherwise(F.col("valid_from"))
    outcome = (
        F.when(F.col("canonical").isNull(), "staged")
        .when(F.col("connector_id").isNotNull() & F.col("raw_reference").isNull(), "refused")
        .when(is_sensitive(F.col("flagged"), F.col("categories"), F.col("object")), "pending")
        .otherwise("insert")
    )
    state = F.when(outcome == "pending", DISPUTED).when(outcome == "insert", ACTIVE)
    done = rows.withColumn("outcome", outcome).withColumn("fact_status_id", state).withColumn("pending", F.col("outcome") == "pending").withColumn("confidence", confidence).withColumn("valid_from", since)
    return done.withColumn("predicate", F.coalesce("canonical", "predicate")).drop("canonical", "default_category", "_known")


def corrected(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Active facts (id) that corrections for always (subject_id, predicate, valid_from, valid_until) replace: those whose windows meet; they are forgotten, and their children looked at as forget() does.

    Of a subject and predicate the corrections' windows are put together first,
    and each fact looks up the last of these that begins before it ends, so no
    pairs are made.
    """
    keys = ["subject_id", "predicate"]
    low, high = F.lit(-(2**61)), F.lit(2**61)
    said = corrections.select(*keys, F.coalesce(F.unix_micros("valid_from"), low).alias("at"), F.coalesce(F.unix_micros("valid_until"), high).alias("upto"), F.lit(None).cast("string").alias("id"), F.lit(None).cast("long").alias("since"))
    touched = corrections.select(*keys).distinct()
    # A window [a, b) meets [c, d) if c < b and a < d: of those that begin before d, the latest end decides.
    own = facts.where(F.col("fact_status_id") == ACTIVE).join(touched, keys, "left_semi").select(*keys, F.coalesce(F.unix_micros("valid_until"), high).alias("at"), F.lit(None).cast("long").alias("upto"), "id", F.coalesce(F.unix_micros("valid_from"), low).alias("since"))
    before = W.partitionBy(*keys).orderBy("at", F.col("id").isNull(), "id").rowsBetween(W.unboundedPreceding, -1)
    return said.unionByName(own).withColumn("latest", F.max("upto").over(before)).where("id is not null and since < latest").select("id")


def confirmed(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """What confirming facts (id) changes: the new state, certain and active, and the audit's values; error where a fact isn't there or doesn't wait."""
    met = ids.select("id").distinct().join(facts.select("id", "fact_status_id", "confidence", "pending"), "id", "left")
    waits = F.coalesce("pending", F.lit(False))
    value = lambda s, c, p: F.to_json(F.struct(s.alias("fact_status_id"), c.alias("confidence"), p.alias("pending_confirmation")))
    return met.select("id", F.when(waits, ACTIVE).otherwise(F.col("fact_status_id")).alias("fact_status_id"), F.when(waits, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(waits, value(F.col("fact_status_id"), F.col("confidence"), F.lit(True))).alias("old_value"), F.when(waits, value(F.lit(ACTIVE), F.lit(1.0), F.lit(False))).alias("new_value"), F.when(~waits, "not awaiting confirmation").alias("error"))


def rejected(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """The facts that are left when the user rejects waiting ones (id); others stay whatever is asked."""
    gone = ids.select("id").distinct().join(facts.where(F.col("pending") & (F.col("fact_status_id") != FORGOTTEN)).select("id"), "id", "left_semi")
    return facts.join(gone, "id", "left_anti")
