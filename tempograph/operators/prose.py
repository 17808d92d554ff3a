"""Memory as text: facts as sentences, buckets as paragraphs, and what comes up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import visible
from tempograph.functions.render import bounds, relative_day

#: How predicates are said; others are said by their name (fixed values).
SAID = {
    "has_partner": "is partnered with", "has_parent": "has parent", "born_on": "was born on", "died_on": "died on", "works_as": "works as", "located_in": "is in", "resides_in": "resides in", "owns": "owns", "visited": "visited",
    "has_event": "has an event", "attending": "is attending", "took_photo_at": "took a photo at", "took_photo": "took a photo of", "has_flight": "has a flight", "departs_from": "departs from", "arrives_at": "arrives at",
    "operated_by": "is operated by", "has_booking": "has a booking", "has_order": "has an order", "purchased_from": "was purchased from", "has_delivery": "has a delivery", "shipped_by": "was shipped by", "delivered_to": "was delivered to",
    "has_ticket": "has a ticket", "issued_by": "was issued by", "created_on": "created on", "rejected_action": "rejected action",
}
#: Buckets by number, in the order of the text; the first has no heading (fixed values).
BUCKETS = {1: "", 2: "Relationships", 3: "Preferences", 4: "Upcoming", 5: "General"}


def fact_line(subject: Column, predicate: Column, object_: Column, start: Column, end: Column) -> Column:
    """A fact as a sentence without its full stop, with its window behind it."""
    table = F.create_map(*[F.lit(x) for pair in SAID.items() for x in pair])
    said = F.coalesce(F.try_element_at(table, predicate), F.replace(predicate, F.lit("_"), F.lit(" ")))
    window = bounds(start, end)
    return F.concat(F.concat_ws(" ", subject, said, F.coalesce(object_, F.lit(""))), F.when(window != "", F.concat(F.lit(" ("), window, F.lit(")"))).otherwise(""))


def _said(day: Column) -> Column:
    return F.concat(F.date_format(day, "EEEE "), F.dayofmonth(day).cast("string"), F.date_format(day, " MMMM yyyy"))


def now_line(now: Column) -> Column:
    """The anchor that tells a reader what time it is."""
    return F.concat(F.lit("Now: "), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" ("), _said(now), F.lit(")"))


def refreshed(memory: Column, now: Column) -> Column:
    """A memory with the anchor of now: in place of its first line if that is an anchor whose two dates agree, else before it."""
    line = F.regexp_extract(memory, r"^(Now: [^\n]*)", 1)
    then = F.regexp_extract(line, r"^Now: (\S+) \(", 1).try_cast("timestamp")
    anchored = F.coalesce(then.isNotNull() & (F.regexp_extract(line, r"^Now: \S+ \((.*)\)$", 1) == _said(then)), F.lit(False))
    rest = F.substr(memory, F.length(line) + 1)
    return F.when(anchored, F.concat(now_line(now), rest)).when(memory == "", now_line(now)).otherwise(F.concat(now_line(now), F.lit("\n\n"), memory))


def rendered(facts: DataFrame) -> DataFrame:
    """subject_id and memory, the text of its facts (subject_id, bucket, rank, line): each bucket a paragraph under its heading, its facts by rank."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: F.concat(x["line"], F.lit("."))), " ")
    each = facts.groupBy("subject_id", "bucket").agg(text.alias("text"))
    heading = F.create_map(*[F.lit(x) for k, name in BUCKETS.items() for x in (k, f"{name}: " if name else "")])
    whole = each.withColumn("text", F.concat(F.coalesce(F.try_element_at(heading, F.col("bucket").cast("int")), F.lit("")), "text"))
    return whole.groupBy("subject_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "text"))), lambda x: x["text"]), "\n").alias("memory"))


def coming_up(facts: DataFrame, entities: DataFrame, events: DataFrame, now: Column, days: int, limit: int) -> DataFrame:
    """subject_id, place and line of what comes up for each subject within some days, in the order of time: facts that begin then (confident ones, without an event or with a one-time one that isn't over) and the next dates of recurring events, each kind up to the limit and then both.

    events has fact_id, entity_id, trigger_at, recurrence and status.
    """
    until = now + F.make_dt_interval(F.lit(days))
    names = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    objects = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object_name"))
    said = facts.join(names, "subject_id").join(objects, "object_id", "left").withColumn("object", F.coalesce("object_name", "object_literal", F.lit("")))
    times = events.select(F.col("fact_id").alias("id"), "entity_id", "trigger_at", "recurrence", "status")
    once = said.where(visible() & (F.col("confidence") >= 0.5) & F.col("valid_from").between(now, until)).join(times, "id", "left")
    once = once.where("recurrence is null or (status in ('pending', 'active', 'snoozed') and recurrence = 'none')").withColumn("at", F.col("valid_from")).withColumn("whose", F.col("subject_id"))
    again = said.where("fact_status_id not in (5, 6)").join(times.where((F.col("status") == "active") & (F.col("recurrence") != "none") & F.col("trigger_at").between(now, until)), "id").withColumn("at", F.col("trigger_at")).withColumn("whose", F.col("entity_id"))
    columns = ["whose", "id", "subject", "predicate", "object", "at", "valid_until"]
    first = lambda rows, kind: rows.select(*columns, F.lit(kind).alias("kind"), F.row_number().over(W.partitionBy("whose").orderBy("at", "id")).alias("_r")).where(F.col("_r") <= limit)
    order = W.partitionBy("whose").orderBy("at", "kind", "id")
    both = first(once, 0).unionByName(first(again, 1)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)
    line = F.concat(F.lit("- "), F.concat_ws(" ", "subject", F.replace("predicate", F.lit("_"), F.lit(" ")), "object"), F.lit(" ("), bounds(F.col("at"), F.col("valid_until")), F.lit(", "), F.date_format("at", "dd MMMM"), F.lit(", "), relative_day(F.datediff("at", now)), F.lit(")"))
    return both.select(F.col("whose").alias("subject_id"), "id", "place", line.alias("line"))
