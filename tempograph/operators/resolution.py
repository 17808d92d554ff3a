"""Finding entities by name, for many names at once: equal names, equal aliases, and phrases ranked as in full-text search.

Names are indexed as tokens. A phrase that is asked for meets only the entities
that have its rarest token, which are then verified word by word; ranks follow
BM25 for one phrase (fixed values).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.plans.lineage import cut

#: Saturation and length parameters of the rank, and the weight of a phrase that most rows have (fixed values).
K1, B, COMMON = 1.2, 0.75, 1e-6
#: The rank from which a hit counts, hits of a phrase, what turns a rank into a score, the score from which a fuzzy hit is taken, and results (fixed values).
WORST, HITS, SCALE, TAKEN, RESULTS = -0.2, 10, 4.0, 0.9, 10
#: Scores of an equal name and an equal alias (fixed values).
NAME, ALIAS = 1.0, 1.1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(name: Column) -> Column:
    """A name whose case doesn't count, in ASCII letters only."""
    return F.translate(name, _UPPER, _LOWER)


def tokens(text: Column) -> Column:
    """Letters and digits in a row, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def index(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """id, entity_type_id, and the tokens of name and aliases of each entity."""
    named = aliases.groupBy(F.col("entity_id").alias("id")).agg(F.flatten(F.transform(F.array_sort(F.collect_list("alias")), tokens)).alias("alias_tokens"))
    rows = entities.select("id", "entity_type_id", tokens(F.col("name")).alias("name_tokens")).join(named, "id", "left")
    return rows.withColumn("alias_tokens", F.coalesce("alias_tokens", F.array().cast("array<string>")))


def _times(words: str, phrase: str) -> Column:
    """How often a phrase stands in a list of words."""
    places = F.sequence(F.lit(1), F.greatest(F.size(words) - F.size(phrase) + 1, F.lit(1)))
    return F.size(F.filter(places, lambda i: F.slice(words, i, F.size(phrase)) == F.col(phrase)))


def phrase_hits(indexed: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, id, entity_type_id and rank (the smaller the better) of all entities that have a phrase (column asked, each once) in name or aliases."""
    phrases = asked.select("asked", tokens(F.col("asked")).alias("phrase")).where("size(phrase) > 0")
    rows = indexed.withColumn("size", F.size("name_tokens") + F.size("alias_tokens"))
    posted = rows.select("id", F.explode(F.array_distinct(F.concat("name_tokens", "alias_tokens"))).alias("token"))
    often = posted.groupBy("token").agg(F.count("*").alias("df"))
    each = phrases.select("asked", "phrase", F.explode(F.array_distinct("phrase")).alias("token")).join(often, "token", "left")
    # A phrase with an unknown token has no hit.
    rarest = each.groupBy("asked", "phrase").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token")).alias("r")).where("r.df > 0").select("asked", "phrase", F.col("r.token").alias("token"))
    near = rarest.join(posted, "token").join(rows, "id")
    found = near.withColumn("f", _times("name_tokens", "phrase") + _times("alias_tokens", "phrase")).where("f > 0").select("asked", "id", "entity_type_id", "f", "size")
    found = cut(found)
    n = found.groupBy("asked").agg(F.count("*").alias("n"))
    whole = rows.agg(F.count("*").alias("all"), F.avg("size").alias("mean"))
    rated = found.join(n, "asked").crossJoin(F.broadcast(whole))  # one row
    weight = F.log((F.col("all") - F.col("n") + 0.5) / (F.col("n") + 0.5))
    rank = -F.when(weight <= 0, COMMON).otherwise(weight) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("size") / F.col("mean")))
    return rated.select("asked", "id", "entity_type_id", F.round(rank, 9).alias("rank"))


def _score(rank: Column) -> Column:
    return F.least(F.greatest(-rank * SCALE, F.lit(0.0)), F.lit(1.0))


def searched(indexed: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """asked, id, place and score of the best entities for each phrase."""
    best = W.partitionBy("asked").orderBy("rank", "id")
    hits = phrase_hits(indexed, asked.select("asked").distinct()).withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit)
    return hits.select("asked", "id", "entity_type_id", "place", _score(F.col("rank")).alias("score"))


def lookups(entities: DataFrame, aliases: DataFrame, asked: DataFrame, typed: bool = False) -> DataFrame:
    """The entities for each name (asked; with typed, of the type asked for only): kind (1 name, 2 alias, 3 fuzzy), score, and place, at most RESULTS.

    An entity comes once, by the first of name, alias and phrase that finds it.
    Order: score, then kind, then the smaller id, of fuzzy ones the rank first.
    Fuzzy hits are the best HITS of all types that rank well enough.
    """
    keys = ["asked", "wanted"] if typed else ["asked"]
    names = asked.select("asked", *([F.col("entity_type_id").alias("wanted")] if typed else [])).distinct()
    text = names.select("asked").distinct().withColumn("key", folded(F.col("asked")))
    by_name = text.join(entities.select("id", "entity_type_id", folded(F.col("name")).alias("key")), "key").select("asked", "id", "entity_type_id", F.lit(1).alias("kind"), F.lit(NAME).alias("score"), F.lit(0.0).alias("rank"))
    own = aliases.select(F.col("entity_id").alias("id"), folded(F.col("alias")).alias("key")).distinct().join(entities.select("id", "entity_type_id"), "id")
    by_alias = text.join(own, "key").select("asked", "id", "entity_type_id", F.lit(2).alias("kind"), F.lit(ALIAS).alias("score"), F.lit(0.0).alias("rank"))
    best = W.partitionBy("asked").orderBy("rank", "id")
    fuzzy = phrase_hits(index(entities, aliases), text.select("asked")).where(F.col("rank") <= WORST).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= HITS)
    fuzzy = fuzzy.select("asked", "id", "entity_type_id", F.lit(3).alias("kind"), _score(F.col("rank")).alias("score"), "rank")
    found = reduce(DataFrame.unionByName, [by_name, by_alias, fuzzy])
    once = found.groupBy("asked", "id", "entity_type_id").agg(F.min(F.struct("kind", "score", "rank")).alias("h")).select("asked", "id", "entity_type_id", "h.*")
    once = names.join(once, "asked")
    once = once.where("wanted = entity_type_id") if typed else once
    order = W.partitionBy(*keys).orderBy(F.desc("score"), "kind", "rank", "id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= RESULTS).select(*keys, "id", "kind", "score", "place")


def resolved(entities: DataFrame, aliases: DataFrame, asked: DataFrame) -> DataFrame:
    """asked, wanted (the type) and id of the entity each name stands for: the first result, unless it is fuzzy and scores too low; null where a new entity is to be made."""
    first = lookups(entities, aliases, asked, typed=True).where("place = 1").where((F.col("kind") < 3) | (F.col("score") >= TAKEN))
    names = asked.select("asked", F.col("entity_type_id").alias("wanted")).distinct()
    return names.join(first.select("asked", "wanted", "id", "kind"), ["asked", "wanted"], "left")


def with_top_facts(hits: DataFrame, facts: DataFrame, entities: DataFrame, most: int = 5) -> DataFrame:
    """Search hits with their entity's best facts, a list of predicate, object's name or literal, and confidence."""
    ids = hits.select(F.col("id").alias("subject_id")).distinct()
    best = W.partitionBy("subject_id").orderBy(F.desc("confidence"), "fact_id")
    rows = facts.where("not pending and fact_status_id not in (5, 6)").withColumnRenamed("id", "fact_id").join(ids, "subject_id", "left_semi")
    top = rows.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= most)
    named = top.join(entities.select(F.col("id").alias("object_id"), "name"), "object_id", "left")
    lists = named.groupBy(F.col("subject_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("nth", "fact_id", "predicate", F.coalesce("name", "object_literal").alias("object"), "confidence"))).alias("facts"))
    return hits.join(lists, "id", "left")
