"""Full-text search by an inverted index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def inverted(rows: DataFrame, keys: list[str], text: str, wanted: list[str] | None = None) -> DataFrame:
    """(keys, term, tf, length) of each text; terms are lower-case runs of letters and digits, all or the wanted ones."""
    terms = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    listed = F.col("terms") if wanted is None else F.filter("terms", lambda t: t.isin(wanted))
    words = rows.select(*keys, terms.alias("terms")).select(*keys, F.size("terms").alias("length"), F.explode(listed).alias("term"))
    return words.groupBy(*keys, "term", "length").agg(F.count("*").alias("tf"))


def search(rows: DataFrame, keys: list[str], text: str, terms: list[str], all_terms: bool = True) -> DataFrame:
    """Texts with all (or any) of the terms, their number of matching terms and BM25 score."""
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    size = rows.select(F.size(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")).alias("length")).agg(F.count("*").alias("n_docs"), F.avg("length").alias("mean"))
    hits = inverted(rows, keys, text, wanted)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))  # a row for each term asked for
    scored = hits.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # one row
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    found = scored.groupBy(*keys).agg(F.count("*").alias("n_terms"), F.round(F.sum(part), 6).alias("score"))
    return found.where(F.col("n_terms") == len(wanted)) if all_terms else found
