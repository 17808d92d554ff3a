"""Dates as people write them, as columns; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")


def flexible_date(text: Column) -> Column:
    """The instant that a text names: a time with or without an offset (UTC then), a day, a month (2025-05, or May 2025 by the name's first three letters) or a year from 1000 on, each from its beginning; null for anything else."""
    t = F.btrim(text, F.lit(" \t\r\n"))
    ts = lambda pattern, value=None: F.when(t.rlike(pattern), (t if value is None else value).try_cast("timestamp"))
    name = F.regexp_extract(t, r"^(\S+) ([+]?\d{1,6})$", 1)
    month = F.array_position(F.array(*[F.lit(m) for m in _MONTHS]), F.lower(F.substring(name, 1, 3)))
    year = F.regexp_extract(t, r"^(\S+) ([+]?\d{1,6})$", 2).try_cast("int")
    named = F.when((month > 0) & year.between(1, 9999), F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01")).try_cast("timestamp"))
    return F.coalesce(
        ts(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$", F.upper(t)),
        ts(r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{1,2}:\d{1,2}$"),
        ts(r"^\d{4}-\d{1,2}-\d{1,2}$"),
        ts(r"^\d{4}-\d\d$", F.concat(t, F.lit("-01"))),
        ts(r"^[+]?[1-9]\d{3}$", F.concat(F.regexp_replace(t, "[+]", ""), F.lit("-01-01"))),
        named,
    )
