"""Anti joins, self joins with interval overlap, inference joins and proximity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import ACTIVE, DISPUTED, FORGOTTEN, INFERRED, SUPERSEDED, overlaps, visible
from tempograph.functions.scalars import EARTH_KM, haversine, inferred_confidence
from tempograph.plans import sieve


def duplicate_facts(facts: DataFrame) -> DataFrame:
    """Pairs of live facts with the same triple whose windows overlap, a before b."""
    rows = facts.where(F.col("fact_status_id").isin(ACTIVE, INFERRED)).select("id", "subject_id", "predicate", "object_id", "object_literal", "valid_from", "valid_until")
    a, b = rows.alias("a"), rows.alias("b")
    same = (F.col("a.subject_id") == F.col("b.subject_id")) & (F.col("a.predicate") == F.col("b.predicate")) & F.col("a.object_id").eqNullSafe(F.col("b.object_id")) & F.col("a.object_literal").eqNullSafe(F.col("b.object_literal"))
    meet = overlaps(F.col("a.valid_from"), F.col("a.valid_until"), F.col("b.valid_from"), F.col("b.valid_until"))
    return a.join(b, same & (F.col("a.id") < F.col("b.id")) & meet).select(F.col("a.id").alias("a"), F.col("b.id").alias("b"))


_TRIPLE = ["subject_id", "predicate", "object_id", "object_literal"]


def duplicate_classes(facts: DataFrame) -> DataFrame:
    """id, class_id and n_links of live facts that have duplicates: class_id is the smallest id of the facts of the triple that windows connect, n_links how many others' windows the fact's own overlaps.

    Starts and ends of windows are put in order once, so rows don't grow with
    the pairs. Empty windows overlap nothing.
    """
    rows = facts.where(F.col("fact_status_id").isin(ACTIVE, INFERRED) & (F.col("valid_from").isNull() | F.col("valid_until").isNull() | (F.col("valid_from") < F.col("valid_until"))))
    since, until = F.coalesce(F.unix_micros("valid_from"), F.lit(-(2**62))), F.coalesce(F.unix_micros("valid_until"), F.lit(2**62))
    point = lambda at, start: F.struct(at.alias("at"), F.lit(start).alias("start"))
    points = rows.select("id", *_TRIPLE, F.explode(F.array(point(since, 1), point(until, 0))).alias("p")).select("id", *_TRIPLE, "p.*")
    order = W.partitionBy(*_TRIPLE).orderBy("at", "start", "id").rowsBetween(W.unboundedPreceding, 0)
    seen = points.withColumn("starts", F.sum("start").over(order)).withColumn("ends", F.sum(1 - F.col("start")).over(order))
    # A stretch of connected windows begins where nothing else is open.
    seen = seen.withColumn("stretch", F.sum(((F.col("start") == 1) & (F.col("starts") - F.col("ends") == 1)).cast("long")).over(order))
    each = seen.groupBy("id", *_TRIPLE).agg(F.min("stretch").alias("stretch"), F.max(F.when(F.col("start") == 1, F.col("starts") - F.col("ends") - 1)).alias("open"), (F.max(F.when(F.col("start") == 0, F.col("starts"))) - F.max(F.when(F.col("start") == 1, F.col("starts")))).alias("later"))
    linked = each.withColumn("n_links", F.col("open") + F.col("later")).where("n_links > 0")
    return linked.withColumn("class_id", F.min("id").over(W.partitionBy(*_TRIPLE, "stretch"))).select("id", "class_id", "n_links")


def sharing(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """key, member, class_id (the smallest member) and n of all members that share a key with another one; keys are counted before they meet their members."""
    pairs = rows.select(key.alias("key"), F.col(member).alias("member")).where("key is not null").distinct()
    classes = pairs.groupBy("key").agg(F.min("member").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    return pairs.join(classes, "key")


def contradicting(facts: DataFrame, contradicts: DataFrame) -> DataFrame:
    """Pairs of disputed facts (a, b) that Contradicts edges connect in either direction, each once, with the one that stays: the one that isn't inferred; null where both are or neither is, which is left to the user."""
    pairs = contradicts.select(F.least("parent_fact_id", "child_fact_id").alias("a"), F.greatest("parent_fact_id", "child_fact_id").alias("b")).where("a <> b").distinct()
    side = lambda n: facts.where(F.col("fact_status_id") == DISPUTED).select(F.col("id").alias(n), F.col("inferred").alias(f"i_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    kept = F.when(F.col("i_a") & ~F.col("i_b"), F.col("b")).when(F.col("i_b") & ~F.col("i_a"), F.col("a"))
    return both.select("a", "b", kept.alias("kept"))


def resolved_contradictions(pairs: DataFrame) -> DataFrame:
    """id and new state of the facts of decided pairs: the one that stays is active again, the other superseded. A fact that loses any of its pairs is superseded."""
    decided = pairs.where("kept is not null").select(F.explode(F.array("a", "b")).alias("id"), "kept")
    return decided.groupBy("id").agg(F.max(F.when(F.col("id") == F.col("kept"), ACTIVE).otherwise(SUPERSEDED)).alias("fact_status_id"))


def not_evaluated(pairs: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) that have not been looked at in either order."""
    seen = evaluated.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b")).distinct()
    return pairs.join(seen, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def names_within(entities: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of entities of one type of which one's name (at least so long) is a part of the other's, whatever their case: short, long; of equal names the smaller id is short.

    A name meets the equal parts of others, so not all pairs are tried. Parts
    as long as some shorter name of the type are made, and shuffled only if
    their bit in a table of all names is set; so the rows that are shuffled
    follow the pairs that are found. Equal names meet by themselves. The pairs
    of a name that many have are dealt over tasks, yet all of them are rows.
    """
    named = ["entity_type_id", "name"]
    rows = entities.select("id", "entity_type_id", F.lower("name").alias("name")).where(F.length("name") >= least)
    shared = rows.groupBy(*named).agg(F.count("*").alias("n")).where("n > 1")
    short, long = (rows.select(F.col("id").alias(side), *named) for side in ("short", "long"))
    equal = sieve.dealt(short.join(shared.drop("n"), named, "left_semi"), long.join(shared.drop("n"), named, "left_semi"), named, "short", shared).where("short < long")
    size = F.length("name")
    sizes = rows.select("entity_type_id", size.alias("n")).distinct()
    parts = F.transform(F.sequence(F.lit(1), size - F.col("n") + 1), lambda at: F.substring("name", at, F.col("n")))
    within = long.join(F.broadcast(sizes), "entity_type_id").where(F.col("n") < size).select("long", "entity_type_id", F.explode(F.array_distinct(parts)).alias("name"))
    proper = sieve.dealt(short, sieve.sieved(within, named, rows, named), named, "short", shared)
    return proper.select("short", "long").unionByName(equal.select("short", "long"))


def dormant_facts(facts: DataFrame, sources: DataFrame, before: Column) -> DataFrame:
    """Old disputed facts without a user's edit of which the subject has a disputed one with higher confidence."""
    rows = facts.where((F.col("fact_status_id") == DISPUTED) & (F.col("valid_from") < before))
    best = rows.withColumn("best", F.max("confidence").over(W.partitionBy("subject_id", "predicate")))
    edited = sources.where("source_type_id = 1").select(F.col("fact_id").alias("id"))
    return best.where("best > confidence").join(edited, "id", "left_anti").select("id", "subject_id", "confidence")


def names_shared(entities: DataFrame) -> DataFrame:
    """Names that several entities have, whatever their case, with the smallest id and the number."""
    return entities.groupBy(F.lower("name").alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")


def visited_places(facts: DataFrame) -> DataFrame:
    """Places that subjects visited by visiting something located in them (rule O02), with the two facts' ids.

    facts has depth. Windows are intersected; empty ones, loops and triples
    that some fact states already, whatever its state, are dropped.
    """
    rows = facts.where(F.col("fact_status_id").isin(ACTIVE, INFERRED) & F.col("object_id").isNotNull())
    side = lambda predicate, n: rows.where(F.col("predicate") == predicate).select("subject_id", "object_id", *[F.col(c).alias(f"{c}{n}") for c in ("id", "valid_from", "valid_until", "confidence", "depth")])
    visited, located = side("visited", 1).withColumnRenamed("object_id", "middle"), side("located_in", 2).withColumnRenamed("subject_id", "middle")
    depth = F.greatest("depth1", "depth2") + 1
    found = visited.join(located, "middle").where("subject_id <> object_id").select(
        "subject_id", "object_id", F.col("id1").alias("first"), F.col("id2").alias("second"),
        F.greatest("valid_from1", "valid_from2").alias("valid_from"), F.least("valid_until1", "valid_until2").alias("valid_until"),
        depth.alias("depth"), inferred_confidence(F.col("confidence1") + F.col("confidence2"), depth, F.lit(2)).alias("confidence"),
    )
    known = facts.where("predicate = 'visited' and object_id is not null and object_literal is null").select("subject_id", "object_id")
    return found.where("valid_from is null or valid_until is null or valid_from < valid_until").join(known, ["subject_id", "object_id"], "left_anti")


def contradictions(facts: DataFrame, predicate: str) -> DataFrame:
    """Objects that active facts with a predicate of one value give a subject: the best fact's and each other one."""
    rows = facts.where((F.col("predicate") == predicate) & (F.col("fact_status_id") == ACTIVE))
    best = rows.groupBy("subject_id").agg(F.min_by("object_id", F.struct(-F.col("confidence"), "id")).alias("kept"), F.count_distinct("object_id").alias("n")).where("n > 1")
    return rows.join(best, "subject_id").where("object_id <> kept").select("subject_id", "kept", F.col("object_id").alias("other"))


def future_without_overlay(facts: DataFrame, overlays: DataFrame, now: Column, least: float) -> DataFrame:
    """Visible facts of the future, confident enough, that no event overlay (fact_id) stands for."""
    rows = facts.where(visible() & (F.col("valid_from") > now) & (F.col("confidence") >= least))
    return rows.join(overlays.select(F.col("fact_id").alias("id")), "id", "left_anti")


def nearby(places: DataFrame, centres: DataFrame, km: float) -> DataFrame:
    """Places within a distance of centres (id, latitude, longitude), the nearest first in rank.

    Both sides are put into bands of latitude at least km high; a centre looks
    into its own band and the two beside it, so only near latitudes meet.
    """
    height = 1.000001 * km / (EARTH_KM * math.pi / 180)
    p = places.where("latitude is not null and longitude is not null").withColumn("band", F.floor(F.col("latitude") / height))
    band = F.floor(F.col("latitude") / height)
    c = centres.select(F.col("id").alias("centre"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    far = haversine(F.col("lat"), F.col("lon"), F.col("latitude"), F.col("longitude"))
    found = c.join(p, "band").withColumn("km", far).where(F.col("km") <= km)
    return found.withColumn("rank", F.row_number().over(W.partitionBy("centre").orderBy("km", "entity_id"))).select("centre", "entity_id", "km", "rank")


def touching(facts: DataFrame) -> DataFrame:
    """How many different facts each entity is an end of."""
    ends = facts.where(~F.col("fact_status_id").isin(SUPERSEDED, FORGOTTEN))
    both = ends.select(F.col("subject_id").alias("entity_id"), "id").unionByName(ends.where("object_id is not null and object_id <> subject_id").select(F.col("object_id").alias("entity_id"), "id"))
    return both.groupBy("entity_id").agg(F.count("*").alias("n"))
