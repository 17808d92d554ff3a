"""Filtered reads of facts, entities, categories and messages. Reads for a key take all keys at once, with a limit for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.functions.predicates import ACTIVE, FORGOTTEN, INFERRED, active_at, visible
from tempograph.operators.graph import closure
from tempograph.plans.lineage import cut


def top_per(rows: DataFrame, key: str | list[str], order: list[Column], limit: int | None) -> DataFrame:
    """The first rows of each key, or all without a limit, with their place as rank."""
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(*order)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def ranked_in_parts(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """All rows with their rank within a key, also where few keys hold most rows: rows are ranged by key and order, and a rank is a place in its range and what ranges before it hold of the key. order must leave no ties."""
    spark = rows.sparkSession
    ranged = cut(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col(key), *order).withColumn("_part", F.spark_partition_id()))
    # A row for each range and key that meet: at most as many as there are ranges and keys.
    n = ranged.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = n.withColumn("_before", F.sum("_n").over(W.partitionBy(key).orderBy("_part")) - F.col("_n")).drop("_n")
    here = F.row_number().over(W.partitionBy("_part", key).orderBy(*order))
    return ranged.withColumn("_here", here).join(before, [key, "_part"]).withColumn("rank", F.col("_here") + F.col("_before")).drop("_part", "_here", "_before")


def facts_by(facts: DataFrame, key: str, limit: int) -> DataFrame:
    """The first facts by id of each subject, predicate or object."""
    return top_per(facts.where(F.col(key).isNotNull()), key, [F.col("id")], limit).select(key, "id", "rank")


def existing_triples(facts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted (subject_id, predicate, object_id, object_literal) that some fact not forgotten states."""
    f, w = facts.where(F.col("fact_status_id") != FORGOTTEN).alias("f"), wanted.alias("w")
    same = (F.col("f.subject_id") == F.col("w.subject_id")) & (F.col("f.predicate") == F.col("w.predicate")) & F.col("f.object_id").eqNullSafe(F.col("w.object_id")) & F.col("f.object_literal").eqNullSafe(F.col("w.object_literal"))
    return w.join(f, same, "left_semi")


def active_facts_at(facts: DataFrame, at: Column) -> DataFrame:
    """Active facts that hold at a time."""
    return facts.where((F.col("fact_status_id") == ACTIVE) & active_at(at))


def filtered_facts(facts: DataFrame, entities: DataFrame, min_confidence: float, limit: int) -> DataFrame:
    """Visible facts of each subject by confidence, with the object's name or literal."""
    rows = facts.where(visible() & (F.col("confidence") >= min_confidence))
    order = [F.col("confidence").desc(), F.col("valid_from").desc_nulls_last(), F.col("id").desc()]
    top = top_per(rows, "subject_id", order, limit)
    names = entities.select(F.col("id").alias("object_id"), F.col("name"))
    return top.join(names, "object_id", "left").select("subject_id", "id", "predicate", F.coalesce("name", "object_literal").alias("object"), "confidence", "rank")


def fact_counts(facts: DataFrame, min_confidence: float) -> DataFrame:
    """How many visible facts each subject has."""
    return facts.where(visible() & (F.col("confidence") >= min_confidence)).groupBy("subject_id").agg(F.count("*").alias("n"))


def audit_entries(audit: DataFrame, change_types: list[str], start: Column, end: Column, limit: int) -> DataFrame:
    """The first entries of each changed fact in a half-open time range."""
    rows = audit.where(F.col("change_type").isin(change_types) & (F.col("changed_at") >= start) & (F.col("changed_at") < end))
    return top_per(rows, "fact_id", [F.col("changed_at"), F.col("id")], limit)


def sessions(messages: DataFrame, preview: int) -> DataFrame:
    """Sessions with their number of messages and the start of the last thing the user said."""
    last = F.max_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    return messages.groupBy("session_id").agg(F.count("*").alias("n"), F.max("turn").alias("last_turn"), F.substring(last, 1, preview).alias("preview"))


def nested_sources(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """How many sources each fact has, and their references in order."""
    lists = sources.groupBy("fact_id").agg(F.count("*").alias("n_sources"), F.array_join(F.sort_array(F.collect_list("raw_reference")), ",").alias("refs"))
    return facts.select(F.col("id").alias("fact_id")).join(lists, "fact_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)).cast("long"))


def pending(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts that wait for confirmation, with the names of both ends."""
    names = entities.select("id", "name")
    rows = facts.where("pending").join(names.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id")
    return rows.join(names.select(F.col("id").alias("object_id"), F.col("name").alias("_o")), "object_id", "left").select("id", "subject", "predicate", F.coalesce("_o", "object_literal").alias("object"))


def dependency_edges(dependencies: DataFrame) -> DataFrame:
    """How many dependency edges touch each fact, and how many of them lead to children."""
    ends = dependencies.select(F.explode(F.array(F.struct(F.col("parent_fact_id").alias("fact_id"), F.lit(1).alias("down")), F.struct(F.col("child_fact_id").alias("fact_id"), F.lit(0).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("fact_id").agg(F.count("*").alias("n"), F.sum("down").alias("children"))


def audit_log(audit: DataFrame, limit: int | None = None) -> DataFrame:
    """The audit entries of each fact, the newest first; all, or up to a limit."""
    return top_per(audit, "fact_id", [F.desc("changed_at"), F.desc("id")], limit)


def export_order(messages: DataFrame) -> DataFrame:
    """Messages of a session with their place: its first system message, then the others by turn."""
    first = F.min(F.when(F.col("role") == "system", F.col("turn"))).over(W.partitionBy("session_id"))
    rows = messages.withColumn("_first", first).withColumn("_late", (~F.col("turn").eqNullSafe(F.col("_first"))).cast("int"))
    return rows.withColumn("place", F.row_number().over(W.partitionBy("session_id").orderBy("_late", "turn"))).drop("_first", "_late")


def after_mark(messages: DataFrame, marks: DataFrame) -> DataFrame:
    """Messages from each session's compaction mark (session_id, mark) on; all of a session without one."""
    return messages.join(marks, "session_id", "left").where("mark is null or turn >= mark").drop("mark")


def fact_detail(facts: DataFrame, entities: DataFrame, sources: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Each fact with its ends' names and the number of its sources and parents."""
    names = entities.select("id", "name")
    rows = facts.join(names.select(F.col("id").alias("subject_id"), F.col("name").alias("subject")), "subject_id", "left").join(names.select(F.col("id").alias("object_id"), F.col("name").alias("_o")), "object_id", "left")
    rows = rows.join(sources.groupBy(F.col("fact_id").alias("id")).agg(F.count("*").alias("s")), "id", "left").join(dependencies.groupBy(F.col("child_fact_id").alias("id")).agg(F.count("*").alias("p")), "id", "left")
    shown = F.coalesce("_o", "object_literal", F.concat(F.lit("entity:"), F.col("object_id").cast("string")))
    return rows.select("id", "subject", shown.alias("object"), F.coalesce("s", F.lit(0)).alias("n_sources"), F.coalesce("p", F.lit(0)).alias("n_parents"))


def profile(facts: DataFrame, categories: DataFrame, fact_categories: DataFrame, limit: int) -> DataFrame:
    """How many visible facts each subject has in its largest categories; facts without one are uncategorized."""
    names = fact_categories.join(categories.select(F.col("id").alias("category_id"), "name"), "category_id").select(F.col("fact_id").alias("id"), "name")
    n = facts.where(visible()).join(names, "id", "left").groupBy("subject_id", F.coalesce("name", F.lit("Uncategorized")).alias("category")).agg(F.count("*").alias("n"))
    return top_per(n, "subject_id", [F.desc("n"), F.col("category")], limit).drop("rank")


def fact_weights(categories: DataFrame, fact_categories: DataFrame) -> DataFrame:
    """Each fact's categories, highest weight and lowest bucket."""
    rows = fact_categories.join(categories.select(F.col("id").alias("category_id"), "memory_weight", "memory_bucket_id"), "category_id")
    listed = F.array_join(F.array_sort(F.collect_list(F.col("category_id").cast("string"))), ",")
    return rows.groupBy("fact_id").agg(listed.alias("categories"), F.max("memory_weight").alias("weight"), F.min("memory_bucket_id").alias("bucket"))


def same_ends(facts: DataFrame, limit: int | None = None) -> DataFrame:
    """Subjects and objects that live facts connect by several predicates, with these; all, or the first up to a limit."""
    live = facts.where(F.col("fact_status_id").isin(ACTIVE, INFERRED) & F.col("object_id").isNotNull())
    found = live.groupBy("subject_id", "object_id").agg(F.array_sort(F.collect_set("predicate")).alias("p")).where(F.size("p") > 1)
    if limit is not None:
        found = found.orderBy("subject_id", "object_id").limit(limit)
    return found.select("subject_id", "object_id", F.array_join("p", ",").alias("predicates"))


def subtree_counts(categories: DataFrame, fact_categories: DataFrame) -> DataFrame:
    """How many facts each category has, its descendants' included; a fact counts once."""
    tree = closure(categories.where("parent_id is not null").select(F.col("id").alias("child"), F.col("parent_id").alias("parent")))
    lone = categories.select(F.col("id").alias("node"), F.col("id").alias("ancestor"))
    all_ = tree.unionByName(lone).distinct()
    return fact_categories.join(all_, F.col("category_id") == F.col("node")).groupBy(F.col("ancestor").alias("category_id")).agg(F.count_distinct("fact_id").alias("n"))


def children_counts(categories: DataFrame, fact_categories: DataFrame) -> DataFrame:
    """The children of each category with the number of their facts, in one join."""
    n = fact_categories.groupBy("category_id").agg(F.count("fact_id").alias("n"))
    rows = categories.where("parent_id is not null").select("parent_id", "id", "name")
    return rows.join(n, rows["id"] == n["category_id"], "left").select("parent_id", "id", "name", F.coalesce("n", F.lit(0)).alias("n"))
