"""Inference to a fixpoint: rules turn facts into facts, in semi-naive rounds.

A rule joins the facts of one round with those of all rounds before, so no pair
of facts meets twice. Triples that a fact states already, whatever its state,
are not inferred again; that ends cycles, and a second run adds nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.functions.predicates import ACTIVE, INFERRED
from tempograph.functions.scalars import inferred_confidence
from tempograph.plans.lineage import cut

TRIPLE = ["subject_id", "predicate", "object_id", "object_literal"]
_FACT = ["id", *TRIPLE, "valid_from", "valid_until", "confidence", "depth"]


class Rule(NamedTuple):
    """The predicate of what a rule infers, and what it infers from facts with a round in which at least one of the two parents is of the given round."""

    gives: str
    run: Callable[[DataFrame, int], DataFrame]


def transitive(over: str, through: str) -> Rule:
    """Who is over a thing that is through another is over that one too: the windows' intersection, unless it is empty, and never over oneself."""

    def run(facts: DataFrame, turn: int) -> DataFrame:
        def side(predicate: str, n: int, key: str) -> DataFrame:
            rows = facts.where((F.col("predicate") == predicate) & F.col("object_id").isNotNull())
            return rows.select(F.col(key).alias("middle"), F.col("object_id" if key == "subject_id" else "subject_id").alias("object_id" if key == "subject_id" else "subject_id"), *[F.col(c).alias(f"{c}{n}") for c in ("id", "valid_from", "valid_until", "confidence", "depth", "turn")])

        one, two = side(over, 1, "object_id"), side(through, 2, "subject_id")
        new, old = F.lit(turn), F.lit(turn - 1)
        met = one.where(F.col("turn1") == new).join(two, "middle").unionByName(one.where(F.col("turn1") <= old).join(two.where(F.col("turn2") == new), "middle"))
        depth = F.greatest("depth1", "depth2") + 1
        found = met.where("subject_id <> object_id").select(
            "subject_id", F.lit(over).alias("predicate"), "object_id", F.lit(None).cast("string").alias("object_literal"),
            F.greatest("valid_from1", "valid_from2").alias("valid_from"), F.least("valid_until1", "valid_until2").alias("valid_until"),
            inferred_confidence(F.col("confidence1") + F.col("confidence2"), depth, F.lit(2)).alias("confidence"), depth.alias("depth"), F.col("id1").alias("first"), F.col("id2").alias("second"),
        )
        return found.where("valid_from is null or valid_until is null or valid_from < valid_until")

    return Rule(over, run)


#: Places that are inside others are visited with them.
VISITED = transitive("visited", "located_in")


def infer(facts: DataFrame, rules: list[Rule] = [VISITED]) -> DataFrame:  # noqa: B006
    """What rules infer from active and inferred facts and from what they infer: the columns of a fact, its parents (first, second) and the turn it came in.

    facts has depth and the columns of a fact; ids are texts. Of several ways to
    one triple the one of the earliest turn counts, then that of the smallest
    parents. A new fact's id is made of its triple. The result goes into
    insert_batch, which settles it with what is there.
    """
    known = cut(facts.where(F.col("fact_status_id").isin(ACTIVE, INFERRED)).select(*_FACT, F.lit(0).alias("turn")))
    seen = cut(facts.where(F.col("predicate").isin([r.gives for r in rules])).select(*TRIPLE).distinct())
    columns = ["valid_from", "valid_until", "confidence", "depth", "first", "second"]
    order = [F.least("first", "second").alias("a"), F.greatest("first", "second").alias("b")]
    name = F.concat_ws("|", F.lit("i"), "subject_id", "predicate", F.coalesce(F.col("object_id").cast("string"), F.concat(F.lit("="), "object_literal")))
    out = []
    for turn in count():
        found = reduce(DataFrame.unionByName, [r.run(known, turn) for r in rules])
        fresh = found.join(seen.select(*[F.col(c).alias(f"_{c}") for c in TRIPLE]), reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in TRIPLE]), "left_anti")
        best = fresh.groupBy(*TRIPLE).agg(F.min(F.struct(*order, *columns)).alias("f"))
        new = cut(best.select(name.alias("id"), *TRIPLE, *[F.col("f")[c].alias(c) for c in columns], F.lit(turn + 1).alias("turn")))
        out.append(new)
        if new.isEmpty():
            break
        known = known.unionByName(new.select(*_FACT, "turn"))
        seen = seen.unionByName(new.select(*TRIPLE))
    return reduce(DataFrame.unionByName, out)


def edges(inferred: DataFrame) -> DataFrame:
    """The dependencies of inferred facts on their parents, as cascades read them."""
    return inferred.select(F.explode(F.array("first", "second")).alias("parent_fact_id"), F.col("id").alias("child_fact_id"), F.lit(True).alias("is_positive"))
