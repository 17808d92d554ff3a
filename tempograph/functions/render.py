"""Short scalar rules: confidence of sources, merging, truncation, rendering and parsing, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tempograph.functions.predicates import MULTI_VALUED
from tempograph.functions.scalars import haversine

#: Names of fact states by id (fixed values).
STATUS_NAMES = {1: "Active", 2: "Inferred", 3: "Disputed", 4: "Corrected", 5: "Superseded", 6: "Forgotten"}
#: Kilometres within which two places are the same (fixed value).
SAME_PLACE_KM = 0.1


def wire_name(number: Column, names: dict[int, str], other: str = "Unknown") -> Column:
    """The name of an enumeration's number."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, number.cast("int")), F.lit(other))


def int_list(text: Column) -> Column:
    """Numbers of a comma-separated text; parts that are none as they stand, spaces included, are left out, and no text gives an empty list."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x.rlike("^[+-]?[0-9]+$"))
    return F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda x: x.isNotNull())


def active_at_closed(at: Column, start: str = "valid_from", end: str = "valid_until") -> Column:
    """Point in time with the end included, as places are read; null is unbounded."""
    return (F.col(start).isNull() | (F.col(start) <= at)) & (F.col(end).isNull() | (F.col(end) >= at))


def overlaps_closed(a_from: Column, a_until: Column, b_from: Column, b_until: Column) -> Column:
    """Overlap with both ends included, as restored facts are tested; null is unbounded."""
    return (a_from.isNull() | b_until.isNull() | (a_from <= b_until)) & (b_from.isNull() | a_until.isNull() | (b_from <= a_until))


def merged_confidence(a: Column, b: Column) -> Column:
    """Confidence of a fact that another one is merged into."""
    return F.least(F.greatest(a, b) + 0.05, F.lit(0.95))


def same_place(address_a: Column, address_b: Column, lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Whether two places are one: what both have must agree, equal addresses or points within SAME_PLACE_KM, and they must have one of these in common."""
    equal, near = address_a == address_b, haversine(lat_a, lon_a, lat_b, lon_b) < SAME_PLACE_KM
    return F.coalesce(equal, F.lit(True)) & F.coalesce(near, F.lit(True)) & (equal.isNotNull() | near.isNotNull())


def split_objects(predicate: Column, text: Column) -> Column:
    """The objects that a text names: its comma-separated parts, trimmed and without empty ones, if the predicate can have several, else the text itself."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return F.when(predicate.isin(*MULTI_VALUED) & F.contains(text, F.lit(",")), parts).otherwise(F.array(text))


#: Confidence by kind of source, and of connectors by their kind (fixed values).
INITIAL = {1: 1.0, 2: 0.8, 3: 0.0, 4: 0.3, 5: 0.8, 6: 1.0}
CONNECTOR = {"email": 0.85, "calendar": 0.9, "photos": 0.8, "linkedin": 0.75}


def initial_confidence(source_type: Column, connector: Column, explicit: Column) -> Column:
    """What a fact of a source is worth: what is said explicitly, else by the kind of connector, else by the kind of source."""
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    return F.coalesce(explicit, F.when(source_type == 2, F.try_element_at(table(CONNECTOR), connector)), F.try_element_at(table(INITIAL), source_type.cast("int")))


def snapshot(fact_id: Column, confidence: Column, status: Column, valid_from: Column, valid_until: Column) -> Column:
    """What the audit keeps of a new fact, as JSON; an open side is null."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.to_json(F.struct(fact_id.alias("fact_id"), confidence.alias("confidence"), status.alias("fact_status_id"), iso(valid_from).alias("valid_from"), iso(valid_until).alias("valid_until")), {"ignoreNullFields": "false"})


def relative_day(days: Column) -> Column:
    """A number of days as today, in 1 day, or in so many days."""
    return F.when(days <= 0, "today").when(days == 1, "in 1 day").otherwise(F.concat(F.lit("in "), days.cast("string"), F.lit(" days")))


def bounds(start: Column, end: Column) -> Column:
    """A window's instants to the second: from → until, from → ..., → until, or nothing."""
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(start.isNotNull(), F.concat(iso(start), F.lit(" → "), F.coalesce(iso(end), F.lit("...")))).when(end.isNotNull(), F.concat(F.lit("→ "), iso(end))).otherwise("")


def transcript_line(role: Column, content: Column) -> Column:
    """A message as one line: trimmed, its line ends written as backslashes with r and n, so none can pass for a new message; null for an empty one."""
    text = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", "")
    return F.when(text != "", F.concat(role, F.lit(": "), F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))))


def phrase(text: Column) -> Column:
    """A text as one quoted search phrase: quotes doubled, stars turned into spaces (no prefix search can slip in), trimmed; null if it is blank."""
    t = F.nullif(F.regexp_replace(F.replace(F.replace(text, F.lit('"'), F.lit('""')), F.lit("*"), F.lit(" ")), r"^\s+|\s+$", ""), F.lit(""))
    return F.concat(F.lit('"'), t, F.lit('"'))


def snippet(text: Column, term: str, around: int = 30) -> Column:
    """So many words on either side of a term's first whole-word occurrence, the hit between <<< and >>>, three dots where text was left out; null without the term."""
    words = F.split(text, r"\s+")
    plain = F.transform(words, lambda w: F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    at = F.array_position(plain, term.lower()).cast("int")
    first = F.greatest(at - around, F.lit(1))
    marked = F.transform(words, lambda w, k: F.when(k + 1 == at, F.concat(F.lit("<<<"), w, F.lit(">>>"))).otherwise(w))
    body = F.array_join(F.slice(marked, first, (at + around - first + 1).cast("int")), " ")
    return F.when(at > 0, F.concat(F.when(first > 1, "... ").otherwise(""), body, F.when(F.size(words) > at + around, " ...").otherwise("")))
