"""A corpus pipeline of five operators; each stage's result is written and read again as the next one's documents.

Each stage takes what its operator takes: documents with null or empty texts
pass all of them (the last one gives them no tokens), repeated rows are treated
alike and stay repeated, ties go to the smallest doc_id, a null doc_id stays
(near-duplicates of it with an id go before it), and an empty table stays empty.
Columns other than those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.llm import bpe, decontam, simhash, substr, toxicity
from tempograph.llm.common import discard_others, made, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The share of common shingles from which documents are near-duplicates.
SIMILARITY = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by five-word shingles, the document with the smallest id stays."""
    return simhash.keep_first(docs, similarity=SIMILARITY).select(COLUMNS)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated spans go; documents stay."""
    left = substr.deduplicate(docs, keep=["lang", "source", "n_chars"])
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark text go."""
    return decontam.remove_documents(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that are left."""
    return bpe.op2(docs)


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_duplicates), ("substrings", drop_repeated_spans), ("decontamination", drop_contaminated), ("bpe", encode)]

#: SQL has no compression by dictionaries; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of the last stage; what earlier stages have left in the shared folder goes once the next one's result is written."""
    docs, others = table(spark, sf_dir, "documents"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
            discard_others(spark, [*others, made()[-1]])
    return docs
