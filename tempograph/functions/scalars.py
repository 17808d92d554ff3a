"""Scalar functions of the graph: geography, confidence, ranking, time and text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1 - a, F.lit(0.0))))


def breadth(n: Column) -> Column:
    """Weight of how many parents support an inference (fixed values)."""
    return F.when(n <= 0, 0.0).when(n == 1, 0.6).when(n == 2, 0.75).when(n == 3, 0.9).otherwise(1.0)


def inferred_confidence(total: Column, depth: Column, n: Column) -> Column:
    return F.least(F.greatest(total * F.pow(F.lit(0.8), depth) * breadth(n), F.lit(0.0)), F.lit(0.95))


def boosted(confidence: Column) -> Column:
    """Confidence after one more source; never lower than before."""
    return F.when(confidence < 0.95, F.least(confidence + 0.05, F.lit(0.95))).otherwise(confidence)


def temporal_boost(valid_from: Column, now: Column) -> Column:
    """Future facts count the more the nearer they are."""
    days = (F.unix_timestamp(valid_from) - F.unix_timestamp(now)) / 86400
    return F.when(valid_from > now, 10 / F.sqrt(F.greatest(days, F.lit(0.5)))).otherwise(1.0)


def html_text(html: Column) -> Column:
    """Tags and runs of white space as single spaces, six entities as characters."""
    text = F.regexp_replace(html, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.btrim(F.regexp_replace(text, r"[ \t\r\n]+", " "), F.lit(" "))


def truncated(text: Column, chars: int) -> Column:
    """At most so many characters, the last one an ellipsis if text was cut."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars - 1), F.lit("…"))).otherwise(text)


def alias_key(name: Column) -> Column:
    """Normalised alias; null for none."""
    key = F.replace(F.lower(F.btrim(name)), F.lit(" "), F.lit("_"))
    return F.when(key != "", key)
