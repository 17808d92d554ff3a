"""A retrieval plan for many tasks in one job: terms, entities, facts and messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from tempograph.functions.predicates import visible
from tempograph.functions.text import salient, without_possessives
from tempograph.operators.resolution import searched, tokens
from tempograph.operators.search import B, K1
from tempograph.plans.sieve import sieved

#: Bytes of a task that are planned for, searches by token, results of a search, entities that are followed up, facts of an entity, and messages (fixed values).
TASK_BYTES, SEARCHES, RESULTS, CANDIDATES, FACTS, MESSAGES = 2000, 16, 10, 12, 200, 20
#: Words of the messages that are indexed in one task, blocks that few messages are dealt to as long as each has so many words, and tasks whose messages are given at one time.
BLOCK, SPREAD, LEAST, TOGETHER = 1 << 22, 16, 1 << 16, 256


def _first_of_each(words: Column) -> Column:
    low = F.transform(words, lambda w: F.lower(w))
    return F.filter(words, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def planned(tasks: DataFrame) -> DataFrame:
    """task_id, searches (the first different tokens) and terms (the salient ones, or all if there are none) of each task that isn't blank."""
    whole = F.btrim("task", F.lit(" \t\r\n"))
    start = F.decode(F.substring(F.encode(whole, "utf-8"), 1, TASK_BYTES), "utf-8")
    # A character that the cut goes through is left out.
    text = F.when(F.octet_length(whole) > TASK_BYTES, F.rtrim(start, F.lit("�"))).otherwise(whole)
    rows = tasks.withColumn("task", text).where("task <> ''")
    plain = without_possessives(F.col("task"))
    words = F.filter(F.split(plain, r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = rows.select("task_id", "task", F.slice(_first_of_each(words), 1, SEARCHES).alias("searches"), salient(plain).alias("salient"))
    terms = F.array_distinct(F.when(F.size("salient") > 0, F.transform("salient", lambda w: F.lower(w))).otherwise(tokens(F.col("task"))))
    return rows.select("task_id", "searches", terms.alias("terms"))


def candidates(plans: DataFrame, indexed: DataFrame, entities: DataFrame) -> DataFrame:
    """task_id, place, id and name of the entities that the searches of a task find, each name once, in the order of searches and then of results. A token is searched for once, however many tasks have it."""
    asked = plans.select("task_id", F.posexplode("searches").alias("step", "asked"))
    hits = searched(indexed, asked.select("asked"), RESULTS).join(entities.select("id", "name"), "id").where(F.btrim("name") != "")
    found = asked.join(hits.select("asked", "id", "name", F.col("place").alias("result")), "asked")
    once = found.groupBy("task_id", F.lower(F.btrim("name")).alias("key")).agg(F.min(F.struct("step", "result", "id", "name")).alias("c"))
    order = W.partitionBy("task_id").orderBy("c.step", "c.result", "c.id")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CANDIDATES).select("task_id", "place", "c.id", "c.name")


#: What makes two facts of an entity the same evidence.
_IDENTITY = ["predicate", "object", "object_literal", "confidence", "valid_from", "valid_until", "fact_status_id", "inferred"]


def evidence(found: DataFrame, facts: DataFrame, entities: DataFrame, sources: DataFrame) -> DataFrame:
    """The facts of the candidates (task_id, id): task_id, entity_id, what a fact says, fact_ids and the sources of all facts that say it, each once.

    Facts are read for each entity once, the first FACTS of it by confidence,
    newest first; those that say the same are one, and their sources are put
    together.
    """
    ids = found.select(F.col("id").alias("subject_id")).distinct()
    best = W.partitionBy("subject_id").orderBy(F.desc("confidence"), F.col("valid_from").desc_nulls_last(), F.desc("id"))
    rows = facts.where(visible()).join(ids, "subject_id", "left_semi").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= FACTS)
    named = rows.join(entities.select(F.col("id").alias("object_id"), F.col("name").alias("object")), "object_id", "left")
    told = sources.groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_set(F.struct("source_type_id", "raw_reference"))).alias("sources"))
    folded = named.join(told, "id", "left").groupBy("subject_id", *_IDENTITY).agg(F.array_sort(F.collect_list("id")).alias("fact_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("sources", F.array().cast(told.schema["sources"].dataType)))))).alias("sources"))
    return found.select("task_id", F.col("id").alias("subject_id")).distinct().join(folded, "subject_id").select("task_id", F.col("subject_id").alias("entity_id"), *_IDENTITY, "fact_ids", "sources")


class _Messages:
    """Messages of a block by their terms: of each term those that have it, as numbers in the order of their keys."""

    def __init__(self, rows: pa.Table, keys: list[str], mean: float) -> None:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(k, "ascending") for k in keys], null_placement="at_start")).combine_chunks()
        new = np.arange(rows.num_rows) == 0
        for k in keys:
            code = pa.array(rows[k].to_pylist(), rows.schema.field(k).type).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        self.keys = rows.select(keys).filter(pa.array(new)).combine_chunks()
        sizes = rows["_length"].to_numpy()
        message, length = np.repeat(np.cumsum(new) - 1, sizes), np.repeat(sizes, sizes)
        words = pc.list_flatten(rows["_words"])
        words = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        term = words.indices.to_numpy()
        self.terms = {t: k for k, t in enumerate(words.dictionary.to_pylist())}
        order = np.lexsort((length, message, term))
        term, message, length = term[order], message[order], length[order]
        head = np.ones(len(order), bool)
        head[1:] = (term[1:] != term[:-1]) | (message[1:] != message[:-1]) | (length[1:] != length[:-1])
        heads = np.flatnonzero(head)
        self.message, self.tf = message[heads], np.diff(np.append(heads, len(order))).astype(float)
        self.by = self.tf + K1 * (1 - B + B * length[heads] / mean)
        self.starts = np.searchsorted(term[heads], np.arange(len(self.terms) + 1))

    def best(self, words: list[str], idf: list[float], most: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers and scores of the first messages by rounded score, then by keys."""
        some = [(slice(self.starts[k], self.starts[k + 1]), w) for k, w in ((self.terms.get(t), w) for t, w in zip(words, idf)) if k is not None]
        if not some:
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.concatenate([self.message[s] for s, _ in some])
        part = np.concatenate([w * self.tf[s] * (K1 + 1) / self.by[s] for s, w in some])
        if len(at) * 8 < self.keys.num_rows:
            met, which = np.unique(at, return_inverse=True)
            score = np.bincount(which, part)
        else:
            score = np.bincount(at, part)
            met = np.flatnonzero(score)
            score = score[met]
        if len(met) > most:
            rounded = np.floor(score * 1e6 + 0.5)
            last = np.partition(rounded, len(met) - most)[len(met) - most]
            sure = np.flatnonzero(rounded > last)
            chosen = np.concatenate((sure, np.flatnonzero(rounded == last)[: most - len(sure)]))
            met, score = met[chosen], score[chosen]
        return met, score


def _best_of_blocks(keys: list[str], mean: float, most: int):
    """Of each block, whose messages come before the tasks, the best messages for each task; holds one block's messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows, index = None, [], None
        for b in batches:
            kind = b["_block"].to_numpy() * 2 + b["_kind"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                some = b.slice(start, end - start)
                if kind[start] // 2 != block:
                    block, rows, index = kind[start] // 2, [], None
                if kind[start] % 2 == 0:
                    rows.append(some.select([*keys, "_length", "_words"]))
                    continue
                if rows:
                    index, rows = _Messages(pa.Table.from_batches(rows), keys, mean), []
                if index is None:
                    continue
                for at in range(0, some.num_rows, TOGETHER):
                    tasks = some.slice(at, TOGETHER)
                    found = [index.best(w, i, most) for w, i in zip(tasks["_words"].to_pylist(), tasks["_idf"].to_pylist())]
                    which = np.repeat(np.arange(len(found)), [len(m) for m, _ in found])
                    met = index.keys.take(pa.array(np.concatenate([m for m, _ in found]), pa.int64())).combine_chunks()
                    columns = [tasks["_task"].take(pa.array(which)), *[met[k].combine_chunks() for k in keys], pa.array(np.concatenate([x for _, x in found]))]
                    yield from pa.Table.from_arrays(columns, names=["task_id", *keys, "score"]).to_batches()

    return run


def matching_messages(plans: DataFrame, messages: DataFrame, keys: list[str], text: str, most: int = MESSAGES) -> DataFrame:
    """task_id, keys, place and score of the messages with any of a task's terms, ranked by the terms' weights.

    Common terms make nearly all pairs of tasks and messages match, so pairs are
    no rows: messages are dealt to blocks of about BLOCK words, each block is
    indexed in one task, all tasks pass by, and a block gives only its best
    messages for each task.
    """
    asked = plans.select("task_id", F.explode("terms").alias("term"))
    rows = messages.select(*keys, tokens(F.col(text)).alias("_words")).withColumn("_length", F.size("_words"))
    n_docs, mean, total = rows.agg(F.count("*"), F.avg("_length"), F.coalesce(F.sum("_length"), F.lit(0))).first()
    blocks = max(-(-total // BLOCK), min(SPREAD, 1 + total // LEAST))
    each = sieved(rows.repartition(*keys).select(*keys, "_length", F.explode("_words").alias("term")), ["term"], asked, ["term"])
    df = each.groupBy(*keys, "term", "_length").agg(F.lit(1)).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").select("task_id", F.struct("term", F.when(idf <= 0, 1e-6).otherwise(idf).alias("idf")).alias("t")).groupBy("task_id").agg(F.collect_list("t").alias("t"))
    kinds = {k: messages.schema[k].dataType for k in keys} | {"_length": IntegerType(), "_task": plans.schema["task_id"].dataType, "_idf": ArrayType(DoubleType())}
    none = lambda *names: [F.lit(None).cast(kinds[k]).alias(k) for k in names]
    said = rows.select(F.pmod(F.xxhash64(*keys), F.lit(blocks)).alias("_block"), F.lit(0).alias("_kind"), *keys, "_length", "_words", *none("_task", "_idf"))
    tasks = weighed.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("_block"), F.lit(1).alias("_kind"), *none(*keys, "_length"), F.col("t.term").alias("_words"), F.col("task_id").alias("_task"), F.col("t.idf").alias("_idf"))
    schema = StructType([StructField("task_id", kinds["_task"]), *[StructField(k, kinds[k]) for k in keys], StructField("score", DoubleType())])
    found = said.unionByName(tasks).repartition(blocks, "_block").sortWithinPartitions("_block", "_kind").mapInArrow(_best_of_blocks(keys, mean or 1.0, most), schema)
    order = W.partitionBy("task_id").orderBy(F.desc("score"), *keys)
    return found.withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("task_id", *keys, "score", "place")
