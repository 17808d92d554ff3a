"""The trash: facts with all that hangs on them, and their way back."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.functions.predicates import ACTIVE, DISPUTED, FORGOTTEN, SUPERSEDED
from tempograph.functions.scalars import inferred_confidence

_FACT = ["id", "subject_id", "predicate", "object_id", "object_literal", "valid_from", "valid_until", "confidence", "fact_status_id", "pending", "inferred", "depth"]
_PAYLOAD = (
    "fact struct<id:string,subject_id:bigint,predicate:string,object_id:bigint,object_literal:string,valid_from:timestamp,valid_until:timestamp,confidence:double,fact_status_id:int,pending:boolean,inferred:boolean,depth:int>,"
    "sources array<struct<source_type_id:int,raw_reference:string>>,dependencies array<struct<parent_fact_id:string,is_positive:boolean>>"
)


def thrown_away(facts: DataFrame, sources: DataFrame, dependencies: DataFrame, chosen: DataFrame, now: Column) -> DataFrame:
    """Trash rows of the chosen facts (id): trash_id, original_id, payload and deleted_at. The payload holds the fact, its sources and the facts it was inferred from, and each chosen fact goes once."""
    ids = chosen.select("id").distinct()
    gone = facts.select(*_FACT).join(ids, "id", "left_semi")
    told = sources.join(ids.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source_type_id", "raw_reference"))).alias("sources"))
    parents = dependencies.join(ids.select(F.col("id").alias("child_fact_id")), "child_fact_id", "left_semi").groupBy(F.col("child_fact_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("parent_fact_id", "is_positive"))).alias("dependencies"))
    whole = gone.join(told, "id", "left").join(parents, "id", "left")
    none = [F.coalesce(c, F.array().cast(whole.schema[c].dataType)).alias(c) for c in ("sources", "dependencies")]
    payload = F.to_json(F.struct(F.struct(*_FACT).alias("fact"), *none))
    return whole.select(F.concat(F.lit("t"), "id").alias("trash_id"), F.col("id").alias("original_id"), payload.alias("payload"), now.alias("deleted_at"))


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whether each restored window meets one that is there or was restored before it; the windows so far are kept as their union."""
    key, starts, ends = None, [], []
    for b in batches:
        ids, met = [], []
        for r in b.to_pylist():
            k = r["subject_id"], r["predicate"]
            if k != key:
                key, starts, ends = k, [], []
            since, until = r["since"], r["until"]
            # Stretches that the closed window [since, until] touches.
            a, z = bisect_left(ends, since), bisect_left(starts, until + 1)
            if r["trash_id"] is not None:
                ids.append(r["trash_id"])
                met.append(a < z and since <= until)
            if since <= until:
                low, high = min([since, *starts[a:z][:1]]), max([until, *ends[a:z][-1:]])
                starts[a:z], ends[a:z] = [low], [high]
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(met)], ["trash_id", "met"])


def restored_all(facts: DataFrame, trash: DataFrame) -> DataFrame:
    """The facts of trash rows on their way back, in the order of trash_id: the columns of a fact with a new id, old_id, sources, parents (id and sign, of facts that come back too, under their new ids), and confidence.

    A fact whose window meets one of the same subject and predicate, ends
    included, that is there or came back before it is disputed; otherwise a
    forgotten or superseded one is active, and any other one what it was. What
    was inferred is worth what the parents that came back give, as in the
    confidence cascade; the others keep their confidence.
    """
    back = trash.select("trash_id", F.from_json("payload", _PAYLOAD).alias("p")).select("trash_id", "p.*")
    ends = [F.coalesce(F.unix_micros("valid_from"), F.lit(-(2**61))).alias("since"), F.coalesce(F.unix_micros("valid_until"), F.lit(2**61)).alias("until")]
    claims = back.select("trash_id", "fact.*").select("trash_id", "subject_id", "predicate", *ends)
    touched = claims.select("subject_id", "predicate").distinct()
    there = facts.select(F.lit(None).cast("string").alias("trash_id"), "subject_id", "predicate", *ends).join(touched, ["subject_id", "predicate"], "left_semi")
    keys = ["subject_id", "predicate"]
    order = there.unionByName(claims).repartition(*keys).sortWithinPartitions(*keys, F.col("trash_id").asc_nulls_first())
    met = order.mapInArrow(_settle, "trash_id string, met boolean")
    new_id = lambda c: F.concat(c, F.lit("~"))
    status = F.when(F.col("met"), DISPUTED).when(F.col("fact.fact_status_id").isin(FORGOTTEN, SUPERSEDED), ACTIVE).otherwise(F.col("fact.fact_status_id"))
    fresh = back.join(met, "trash_id").withColumn("status", status)
    # First all ids, then the edges between them.
    ids = back.select(F.col("fact.id").alias("old_id"), new_id(F.col("fact.id")).alias("new_id"), F.col("fact.confidence").alias("c"))
    edges = back.select(F.col("fact.id").alias("child"), F.explode("dependencies").alias("d")).select("child", "d.*").join(ids, F.col("parent_fact_id") == F.col("old_id"))
    parents = edges.groupBy(F.col("child").alias("old_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("new_id").alias("id"), "is_positive"))).alias("parents"), F.sum(F.when(F.col("is_positive"), F.col("c")).otherwise(-F.col("c"))).alias("total"), F.count("*").alias("n"))
    found = fresh.select(new_id(F.col("fact.id")).alias("id"), F.col("fact.id").alias("old_id"), *[F.col(f"fact.{c}").alias(c) for c in _FACT if c not in ("id", "fact_status_id")], F.col("status").alias("fact_status_id"), "sources").join(parents, "old_id", "left")
    worth = F.when(F.col("inferred"), inferred_confidence(F.coalesce("total", F.lit(0.0)), F.col("depth"), F.coalesce("n", F.lit(0)))).otherwise(F.col("confidence"))
    return found.withColumn("confidence", worth).drop("total", "n")


def restore_audit(restored: DataFrame, now: Column) -> DataFrame:
    """The audit rows of restored facts."""
    return restored.select(F.col("id").alias("fact_id"), F.lit("restored").alias("change"), F.to_json(F.struct(F.col("id").alias("restored_fact_id"))).alias("new_value"), now.alias("changed_at"))
