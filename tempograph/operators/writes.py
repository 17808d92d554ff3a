"""Writes as pure functions: state and a batch give the new state, or the rows that change."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import ACTIVE, DISPUTED, FORGOTTEN, MULTI_VALUED, SUPERSEDED
from tempograph.plans import sieve
from tempograph.plans.lineage import cut

#: Kinds of source whose word replaces what was known (fixed values).
EXPLICIT = (1, 6)
#: What one more independent source adds, and up to where (fixed values).
BOOST, MOST = 0.05, 0.95


def _claim(several: tuple[str, ...]) -> Column:
    """The object, where a predicate has several values."""
    return F.when(F.col("predicate").isin(*several), F.coalesce(F.concat(F.lit("#"), F.col("object_id").cast("string")), F.concat(F.lit("="), F.col("object_literal"))))


def _islands(rows: DataFrame, several: tuple[str, ...]) -> DataFrame:
    """Rows with the number of their stretch of meeting windows within subject, predicate and, where a predicate has several values, object."""
    start = F.coalesce(F.unix_micros("valid_from"), F.lit(-(2**62)))
    end = F.coalesce(F.unix_micros("valid_until"), F.lit(2**62))
    keys = ["subject_id", "predicate", "claim"]
    ordered = W.partitionBy(*keys).orderBy("_start", "id")
    rows = rows.withColumn("claim", _claim(several)).withColumn("_start", start).withColumn("_end", end)
    before = F.max("_end").over(ordered.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.when(before.isNull() | (F.col("_start") >= before), 1).otherwise(0))
    return rows.withColumn("island", F.sum("_new").over(ordered)).drop("_start", "_end", "_new")


def _provenance() -> Column:
    """A source as its kind and reference."""
    return F.concat_ws(":", F.col("source_type_id").cast("string"), F.coalesce("raw_reference", F.lit("")))


def _explicit(provenance: str) -> bool:
    return int(provenance.split(":")[0]) in EXPLICIT


def _settle(rows: list[dict]) -> list[tuple]:
    """Takes the new facts of one stretch in order of arrival against those that are there."""
    state: list[dict] = []
    for r in sorted(rows, key=lambda r: (-1 if r["arrival"] is None else r["arrival"], r["id"])):
        fact = {"id": r["id"], "since": r["valid_from"], "until": r["valid_until"], "object": r["object_id"], "literal": r["object_literal"], "status": r["fact_status_id"], "pending": r["pending"], "inferred": r["inferred"], "confidence": r["confidence"], "known": set(r["provenance"]), "added": 0, "against": [], "new": r["arrival"] is not None}
        if not fact["new"]:
            state.append(fact)
            continue
        sound = lambda a: a["since"] is None or a["until"] is None or a["since"] < a["until"]
        before = lambda a, b: a["since"] is None or b["until"] is None or a["since"] < b["until"]
        met = sorted((x for x in state if sound(x) and sound(fact) and before(x, fact) and before(fact, x)), key=lambda x: x["id"])
        explicit = any(_explicit(x) for x in fact["known"])
        same = next((x for x in met if (x["object"], x["literal"]) == (fact["object"], fact["literal"]) and (x["status"] == ACTIVE or x["pending"])), None)
        if same is not None and not explicit:
            if not fact["known"] <= same["known"]:
                backed = any(_explicit(x) for x in same["known"])
                same["known"] |= fact["known"]
                same["added"] += 1
                if not (same["inferred"] or backed) and same["confidence"] < MOST:
                    same["confidence"] = min(same["confidence"] + BOOST, MOST)
            continue
        if explicit:
            if len(met) == 1 and met[0]["until"] is None and fact["since"] is not None:
                met[0]["until"] = fact["since"]
            for x in met:
                x["status"] = SUPERSEDED
        elif met:
            fact["status"] = DISPUTED
            for x in met:
                if x["status"] not in (SUPERSEDED, FORGOTTEN):
                    x["status"] = DISPUTED
                    fact["against"].append(x["id"])
        state.append(fact)
    return [(x["id"], x["new"], x["status"], x["confidence"], x["until"], x["added"], x["against"]) for x in state]


_SETTLED = "id string, is_new boolean, fact_status_id int, confidence double, valid_until timestamp, added_sources int, contradicts array<string>"
_ARROW = pa.schema([("id", pa.string()), ("is_new", pa.bool_()), ("fact_status_id", pa.int32()), ("confidence", pa.float64()), ("valid_until", pa.timestamp("us", "UTC")), ("added_sources", pa.int32()), ("contradicts", pa.list_(pa.string()))])


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Settles the stretches of a partition whose rows stand together, one after the other."""
    stretch: list[dict] = []
    key, out = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, x)) for x in out], _ARROW)

    for b in batches:
        for r in b.to_pylist():
            k = (r["subject_id"], r["predicate"], r["claim"], r["island"])
            if k != key and stretch:
                out += _settle(stretch)
                stretch = []
            key = k
            stretch.append(r)
        if out:
            yield made()
            out = []
    if stretch:
        out = _settle(stretch)
        yield made()


def insert_batch(facts: DataFrame, sources: DataFrame, batch: DataFrame, several: tuple[str, ...] = MULTI_VALUED) -> DataFrame:
    """Inserts a batch of facts, each with its source, in order of arrival.

    A fact whose window meets one with the same object, active or pending, adds
    its source to it (nothing, if that source is known) and is no row of its
    own. An explicit one supersedes all that it meets and closes the only one if
    that was open. Any other one that meets facts is disputed, and they are.
    Of the predicates in several a subject can have several objects at a time.
    Facts whose windows don't meet, even by way of others, can't touch each
    other, so such stretches are settled apart and those without a new fact
    don't reach Python. Facts of which subject and predicate, or object too, are
    not in the batch, and their sources, are not shuffled, but for a few.

    batch has the columns of facts and arrival, source_type_id, raw_reference.
    Returns id, is_new, fact_status_id, confidence, valid_until, added_sources,
    contradicts for each fact of the stretches that the batch reaches.
    """
    columns = ["id", "subject_id", "predicate", "object_id", "object_literal", "valid_from", "valid_until", "confidence", "fact_status_id", "pending", "inferred"]
    claimed = ["subject_id", "predicate", _claim(several)]
    new = cut(batch.select(*columns, F.col("arrival").cast("long"), F.array(_provenance()).alias("provenance")))
    old = sieve.sieved(facts.select(*columns).where("subject_id is not null and predicate is not null"), claimed, new, claimed)
    known = sieve.sieved(sources.withColumnRenamed("fact_id", "id"), ["id"], old, ["id"]).groupBy("id").agg(F.collect_set(_provenance()).alias("provenance"))
    old = old.join(known, "id", "left").withColumn("arrival", F.lit(None).cast("long")).withColumn("provenance", F.coalesce("provenance", F.array().cast("array<string>")))
    split = _islands(old.unionByName(new), several)
    keys = ["subject_id", "predicate", "claim", "island"]
    rows = split.withColumn("_reached", F.count("arrival").over(W.partitionBy(*keys))).where("_reached > 0").drop("_reached")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_settled, _SETTLED)


def merged_entities(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts after merging pairs of entities (first, second; no entity in two pairs): of each the one with more facts stays, the first one if they tie."""
    ends = facts.select(F.col("subject_id").alias("entity_id")).unionAll(facts.where("object_id is not null and object_id <> subject_id").select("object_id"))
    wanted = pairs.select(F.explode(F.array("first", "second")).alias("entity_id"))
    counts = ends.join(wanted, "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("n"))
    sized = pairs.join(counts.select(F.col("entity_id").alias("first"), F.col("n").alias("n1")), "first", "left").join(counts.select(F.col("entity_id").alias("second"), F.col("n").alias("n2")), "second", "left")
    stays = F.coalesce("n1", F.lit(0)) >= F.coalesce("n2", F.lit(0))
    moved = sized.select(F.when(stays, F.col("second")).otherwise(F.col("first")).alias("gone"), F.when(stays, F.col("first")).otherwise(F.col("second")).alias("kept"))
    out = facts.join(moved.select(F.col("gone").alias("subject_id"), F.col("kept").alias("_s")), "subject_id", "left").join(moved.select(F.col("gone").alias("object_id"), F.col("kept").alias("_o")), "object_id", "left")
    return out.withColumn("subject_id", F.coalesce("_s", "subject_id")).withColumn("object_id", F.coalesce("_o", "object_id")).drop("_s", "_o")


def audit_of_patch(facts: DataFrame, patch: DataFrame, fields: list[str]) -> DataFrame:
    """One row for each field that a patch (id and some of the fields, null for unchanged) changes: fact_id, field, old_value, new_value."""
    there = patch.select("id", *[F.col(f).alias(f"new_{f}") for f in fields]).join(facts.select("id", *fields), "id")
    changes = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"new_{f}").cast("string").alias("new_value")) for f in fields])
    return there.select(F.col("id").alias("fact_id"), F.explode(changes).alias("c")).select("fact_id", "c.*").where("new_value is not null and not (new_value <=> old_value)")


def without_sources(sources: DataFrame, gone: Column) -> DataFrame:
    """Facts of which all sources go (fact_id, n), for the trash; facts with another source stay."""
    return sources.groupBy("fact_id").agg(F.count("*").alias("n"), F.count_if(gone).alias("gone")).where("n = gone").select("fact_id", "n")


def trash(facts: DataFrame, chosen: Column, now: Column) -> DataFrame:
    """Trash rows of the chosen facts: what they were as JSON, and when they went."""
    payload = F.to_json(F.struct("id", "subject_id", "predicate", "object_id", "object_literal", "confidence", "fact_status_id"))
    return facts.where(chosen & (F.col("fact_status_id") != FORGOTTEN)).select(F.col("id").alias("fact_id"), payload.alias("payload"), now.alias("deleted_at"))


def restored(rows: DataFrame) -> DataFrame:
    """The facts in trash rows."""
    schema = "id string, subject_id long, predicate string, object_id long, object_literal string, confidence double, fact_status_id int"
    return rows.select(F.from_json("payload", schema).alias("f")).select("f.*")


def expired_pending(facts: DataFrame, now: Column, days: int) -> DataFrame:
    """Facts that have waited for confirmation for more than so many days."""
    return facts.where(F.col("pending") & (F.col("valid_from") < now - F.make_dt_interval(F.lit(days))))


def preferences_in(preferences: DataFrame, contexts: DataFrame, asked: list[tuple[str, str]]) -> DataFrame:
    """For each entity and key the preference that fits a context best: most matches, without any match the least specific, then confidence, then the newest."""
    hit = F.lit(False)
    for key, value in asked:
        hit = hit | ((F.col("context_key") == key) & (F.col("context_value") == value))
    n = contexts.groupBy(F.col("preference_id").alias("id")).agg(F.count_if(hit).alias("matches"), F.count("*").alias("specific"))
    rows = preferences.join(n, "id", "left").na.fill(0, ["matches", "specific"])
    best = W.partitionBy("entity_id", "key").orderBy(F.desc("matches"), F.when(F.col("matches") == 0, F.col("specific")).otherwise(0), F.desc("confidence"), F.desc("updated_at"), "id")
    return rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "specific")


def event_changes(overlays: DataFrame, facts: DataFrame, now: Column) -> DataFrame:
    """What a scan does to active events before a time: one-time ones that complete by themselves are completed, recurring ones advanced, all whose fact has gone retired."""
    live = facts.select(F.col("id").alias("fact_id"), F.col("fact_status_id").isin(SUPERSEDED, FORGOTTEN).alias("gone"))
    rows = overlays.where("status = 'active'").join(live, "fact_id")
    past = F.col("trigger_at") < now
    change = F.when(F.col("gone"), "retire").when(past & (F.col("recurrence") != "none"), "advance").when(past & F.col("auto_complete"), "complete")
    return rows.withColumn("change", change).where("change is not null").drop("gone")
