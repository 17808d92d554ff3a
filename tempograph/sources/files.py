"""Folders and Markdown vaults: what changed since the last look, notes as facts, facts as notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, extensions: list[str]) -> DataFrame:
    """path, modified and size of the files below a folder; contents are not read, and empty files are not listed."""
    glob = "*.{" + ",".join(x for e in extensions for x in (e.lower(), e.upper())) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """Files that are new, changed or gone between two listings."""
    old = before.select("path", F.struct("modified", "size").alias("a"))
    both = old.join(now.select("path", F.struct("modified", "size").alias("b")), "path", "full")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").when(F.col("a") != F.col("b"), "changed")
    return both.select("path", change.alias("change")).where("change is not null")


def notes(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """A Markdown note for each entity: stem (free of special characters, with its id where stems clash), text with the facts in order of id."""
    names = entities.select("id", "name")
    rows = facts.join(names.select(F.col("id").alias("object_id"), F.col("name").alias("_o")), "object_id", "left")
    line = F.concat(F.lit("- "), "predicate", F.lit(": "), F.coalesce(F.concat(F.lit("[["), "_o", F.lit("]]")), "object_literal", F.lit("")))
    body = rows.groupBy(F.col("subject_id").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("id").alias("k"), line.alias("line")))), lambda x: x["line"]), "\n").alias("body"))
    stem = F.btrim(F.regexp_replace("name", r'[\\/:*?"<>|#\^\[\]\x00-\x1f]', "_"))
    named = names.withColumn("stem", stem)
    clash = named.groupBy(F.lower("stem").alias("_k")).agg(F.count("*").alias("_n"), F.min("id").alias("_first"))
    named = named.join(clash, F.lower("stem") == F.col("_k")).withColumn("stem", F.when((F.col("_n") > 1) & (F.col("id") != F.col("_first")), F.concat("stem", F.lit("-"), F.col("id").cast("string"))).otherwise(F.col("stem")))
    head = F.concat(F.lit("---\nid: "), F.col("id").cast("string"), F.lit("\n---\n# "), "name", F.lit("\n\n## Facts\n"))
    return named.join(body, "id", "left").select("id", "stem", F.concat(head, F.coalesce("body", F.lit("")), F.lit("\n")).alias("text"))


def facts_of_notes(texts: DataFrame, text: str = "text") -> DataFrame:
    """Facts in the section Facts of notes: subject_id (null without front matter), subject, predicate, object, is_link."""
    t = F.regexp_replace(F.col(text), "\r\n", "\n")
    parts = texts.select(F.try_to_number(F.nullif(F.regexp_extract(t, r"(?s)^---\n(?:.*?\n)?id:\s*(\d+)\s*\n.*?---\n", 1), F.lit("")), F.lit("999999999999999999")).cast("long").alias("subject_id"), F.regexp_extract(t, r"(?m)^# +(.+?)\s*$", 1).alias("subject"), F.regexp_extract(t, r"(?s)\n## Facts[ \t]*\n(.*?)(?=\n## |\z)", 1).alias("body"))
    lines = parts.select("subject_id", "subject", F.explode(F.split("body", "\n")).alias("l")).where(F.col("l").rlike(r"^- [^:]+:\s*\S"))
    value = F.btrim(F.regexp_extract("l", r"^- [^:]+:\s*(.*)$", 1))
    link = value.rlike(r"^\[\[.+\]\]$")
    return lines.select("subject_id", "subject", F.btrim(F.regexp_extract("l", r"^- ([^:]+):", 1)).alias("predicate"), F.when(link, F.regexp_extract(value, r"^\[\[(.+?)(?:\|.*)?\]\]$", 1)).otherwise(value).alias("object"), link.alias("is_link"))
