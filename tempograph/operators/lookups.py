"""Lookups: entities, categories, sources, events, places, preferences, messages and jobs; for all keys at once, in the order in which one key's rows are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import ACTIVE, active_at
from tempograph.operators.reads import top_per
from tempograph.plans.lineage import cut


def paged(rows: DataFrame, key: str | list[str], order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of each key's rows, with their place as rank."""
    return top_per(rows, key, order, offset + limit).where(F.col("rank") > offset)


def by_ids(rows: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is among the wanted ones (column of the same name)."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def named(entities: DataFrame, names: DataFrame) -> DataFrame:
    """asked and id of the entities that have an asked name (column asked), whatever its case."""
    key = lambda c: F.lower(F.btrim(c))
    return names.select("asked", key("asked").alias("_k")).distinct().join(entities.select("id", F.lower("name").alias("_k")), "_k").select("asked", "id")


def active_in_order(facts: DataFrame, at: Column) -> DataFrame:
    """Active facts at a time of each subject and predicate, the earliest first (open starts before all), with their rank."""
    return top_per(facts.where((F.col("fact_status_id") == ACTIVE) & active_at(at)), ["subject_id", "predicate"], [F.col("valid_from").asc_nulls_first(), F.col("id")], None)


def sources_of(sources: DataFrame) -> DataFrame:
    """The sources of each fact in order, as a nested list."""
    return sources.groupBy("fact_id").agg(F.sort_array(F.collect_list(F.struct("source_type_id", "raw_reference"))).alias("sources"))


def level(categories: DataFrame) -> DataFrame:
    """Each category below its parent (null for roots), by id."""
    return categories.select("parent_id", "id", "name", F.row_number().over(W.partitionBy("parent_id").orderBy("id")).alias("place"))


def categories_of(fact_categories: DataFrame, categories: DataFrame) -> DataFrame:
    """fact_id, category_id and name of each fact's categories."""
    return fact_categories.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id").select("fact_id", "category_id", "name")


def resolved_aliases(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """asked and entity_id: names (column asked) looked up among the aliases after both are trimmed, lowered and have spaces as underscores; empty ones find nothing."""
    norm = lambda c: F.nullif(F.replace(F.lower(F.btrim(c)), F.lit(" "), F.lit("_")), F.lit(""))
    return asked.select("asked", norm("asked").alias("_k")).distinct().join(aliases.select("entity_id", norm("alias").alias("_k")).distinct(), "_k").select("asked", "entity_id")


def parents_of(hierarchy: DataFrame) -> DataFrame:
    """Each predicate with its parents in order, roots with none."""
    ends = hierarchy.select(F.explode(F.array(F.struct(F.col("child").alias("predicate"), F.col("parent").alias("p")), F.struct(F.col("parent").alias("predicate"), F.lit(None).cast("string").alias("p")))).alias("e")).select("e.*")
    return ends.groupBy("predicate").agg(F.array_join(F.array_sort(F.collect_set("p")), ",").alias("parents"))


def events_of(overlays: DataFrame) -> DataFrame:
    """The events of each entity, the earliest first, with their rank."""
    return top_per(overlays, "entity_id", [F.col("trigger_at"), F.col("id")], None).select("entity_id", "id", "fact_id", "rank")


def with_contexts(preferences: DataFrame, contexts: DataFrame) -> DataFrame:
    """Each preference with its contexts as key=value, in order of the keys."""
    listed = contexts.groupBy(F.col("preference_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "context_key", "context_value"))), ",").alias("contexts"))
    return preferences.join(listed, "id", "left").select("id", "entity_id", "key", F.coalesce("contexts", F.lit("")).alias("contexts"))


def trash_list(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """Trash rows, the newest first: fact_id, subject's name (entity:id if there is none), predicate and object, out of the payload."""
    names = entities.select("id", "name")
    f = rows.select("fact_id", "deleted_at", F.from_json("payload", "subject_id long, predicate string, object_id long, object_literal string").alias("p")).select("fact_id", "deleted_at", "p.*")
    f = f.join(names.select(F.col("id").alias("subject_id"), F.col("name").alias("_s")), "subject_id", "left").join(names.select(F.col("id").alias("object_id"), F.col("name").alias("_o")), "object_id", "left")
    shown = F.coalesce("_s", F.concat(F.lit("entity:"), F.col("subject_id").cast("string")))
    return f.select("fact_id", "deleted_at", shown.alias("subject"), "predicate", F.coalesce("_o", "object_literal").alias("object"))


def last_turns(sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """The highest turn of each session (column session_id), 0 without messages."""
    return sessions.join(messages.groupBy("session_id").agg(F.max("turn").alias("_t")), "session_id", "left").select("session_id", F.coalesce("_t", F.lit(0)).alias("last_turn"))


def last_runs(runs: DataFrame) -> DataFrame:
    """The last run of each job (key), whether it failed, and how many there were."""
    last = F.max_by(F.struct("id", "failed"), F.struct("ts", "id"))
    return runs.groupBy("key").agg(F.count("*").alias("n"), last.alias("r")).select("key", "n", F.col("r.id").alias("id"), F.col("r.failed").alias("failed"))


def in_box(places: DataFrame, south: float, north: float, west: float, east: float) -> DataFrame:
    """Places between two latitudes and longitudes, edges included; those without coordinates are not."""
    return places.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))


def optional(column: str, value: object) -> Column:
    """True if no value is asked for, or the column has it."""
    return F.lit(True) if value is None else F.col(column) == value


def would_cycle(ancestors: DataFrame, edges: DataFrame) -> DataFrame:
    """Wanted edges (child, parent) that would close a cycle: of a node with itself, or with one of which it is an ancestor; ancestors is a closure."""
    return edges.join(ancestors.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a")), (F.col("parent") == F.col("_n")) & (F.col("child") == F.col("_a")), "left_semi").unionByName(edges.where("child = parent")).distinct()


def bounded_reach(edges: DataFrame, roots: DataFrame, depth: int, most: int) -> DataFrame:
    """(root, node, distance) within a depth, of each root at most so many nodes: each level adds the most confident ones (column confidence), then those with the smallest id, as long as there is room."""
    found = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("distance"))
    front = found
    for level_ in range(1, depth + 1):
        step = front.join(edges, "node").groupBy("root", F.col("to").alias("node")).agg(F.max("confidence").alias("confidence"))
        new = step.join(found, ["root", "node"], "left_anti")
        room = found.groupBy("root").agg((F.lit(most) - F.count("*")).alias("room"))
        placed = new.withColumn("_r", F.row_number().over(W.partitionBy("root").orderBy(F.desc("confidence"), "node"))).join(room, "root").where("_r <= room")
        front = cut(placed.select("root", "node", F.lit(level_).alias("distance")))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
    return found
