"""Conditions on facts and intervals, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fact states (fixed values).
ACTIVE, INFERRED, DISPUTED, CORRECTED, SUPERSEDED, FORGOTTEN = 1, 2, 3, 4, 5, 6
#: Predicates of which a subject can have several objects at one time (fixed values).
MULTI_VALUED = ("has_event", "prefers", "hobby", "dislikes", "skill", "has_pets", "has_child", "has_parent", "has_sibling", "has_partner")


def visible() -> Column:
    """Neither waiting for confirmation nor superseded nor forgotten."""
    return ~F.col("pending") & ~F.col("fact_status_id").isin(SUPERSEDED, FORGOTTEN)


def active_at(at: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Half-open point in time; null is unbounded."""
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) > at))


def overlaps(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Half-open overlap; null is unbounded, and an empty interval overlaps nothing."""
    filled = lambda f, u: f.isNull() | u.isNull() | (f < u)
    return (a_from.isNull() | b_until.isNull() | (a_from < b_until)) & (b_from.isNull() | a_until.isNull() | (b_from < a_until)) & filled(a_from, a_until) & filled(b_from, b_until)


def sensitive(text: Column, keywords: Sequence[str]) -> Column:
    """True if one of the words stands in the text by itself; letters and digits are ASCII."""
    return text.rlike("(?i)(?<![a-z0-9])(" + "|".join(keywords) + ")(?![a-z0-9])")


#: Categories whose facts are sensitive (fixed values).
SENSITIVE_CATEGORIES = (150, 180, 230, 300, 310, 320, 330, 340, 370, 390, 420, 670)
#: Words that make an object sensitive wherever they stand by themselves (fixed values).
SENSITIVE_WORDS = """allergic allergy diabetic diabetes medication prescription diagnosis diagnosed surgery surgical hospital therapy therapist
psychiatrist depression anxiety debt bankrupt bankruptcy salary mortgage loan investment divorce separated citizenship passport visa""".split()


def is_sensitive(flagged: Column, categories: Column, text: Column) -> Column:
    """Whether a flagged fact is sensitive: by one of its categories (array) or by a word of its object. Without the flag nothing is."""
    by_category = F.coalesce(F.arrays_overlap(categories, F.array(*[F.lit(c) for c in SENSITIVE_CATEGORIES]).cast("array<bigint>")), F.lit(False))
    return F.coalesce(flagged, F.lit(False)) & (by_category | F.coalesce(sensitive(text, SENSITIVE_WORDS), F.lit(False)))
