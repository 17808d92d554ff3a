"""Next occurrences of recurring dates, as columns; sessions run in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _time_of_day(at: Column) -> Column:
    return F.unix_micros(at) - F.unix_micros(F.date_trunc("day", at))


def _on(date: Column, base: Column) -> Column:
    """The date at the base's time of day."""
    return F.timestamp_micros(F.unix_micros(date.cast("timestamp")) + _time_of_day(base))


def _first_from(at: Column, step: Column, candidate) -> Column:
    """The candidate of the last whole step before a time, or the one after it if that is past."""
    early, late = candidate(step), candidate(step + 1)
    return F.when(early < at, late).otherwise(early)


def next_daily(base: Column, interval: Column, at: Column) -> Column:
    days = F.datediff(at, base)
    step = F.floor(days / interval)
    found = _first_from(at, step, lambda k: _on(F.date_add(F.to_date(base), (k * interval).cast("int")), base))
    return F.when(days < 0, base).otherwise(found)


def next_weekly(base: Column, interval: Column, at: Column) -> Column:
    """The same weekday, in every interval-th week from the base's."""
    ahead = F.pmod(F.weekday(base) - F.weekday(at), F.lit(7))
    ahead = F.when((ahead == 0) & (_time_of_day(base) < _time_of_day(at)), 7).otherwise(ahead)
    date = F.date_add(F.to_date(at), ahead)
    weeks = F.floor(F.datediff(date, base) / 7)
    off = F.pmod(weeks, interval)
    date = F.date_add(date, F.when(off > 0, (interval - off) * 7).otherwise(0).cast("int"))
    return F.when(F.datediff(at, base) < 0, base).otherwise(_on(date, base))


def next_weekday_of(base: Column, interval: Column, at: Column, weekdays: Column) -> Column:
    """The first of several weekdays (array of numbers, Monday is 0) in every interval-th week, weeks counted from the base's Monday."""
    monday = lambda t: F.date_sub(F.to_date(t), F.weekday(t))
    week = F.floor(F.datediff(monday(at), monday(base)) / 7)
    week = week + F.pmod(interval - F.pmod(week, interval), interval)
    start = F.date_add(monday(base), (week * 7).cast("int"))
    both = F.concat(weekdays, F.transform(weekdays, lambda d: (d + interval * 7).cast("int")))
    found = F.array_min(F.filter(F.transform(both, lambda d: _on(F.date_add(start, d), base)), lambda t: t >= at))
    return F.when(F.datediff(at, base) < 0, base).otherwise(found)


def next_monthly(base: Column, interval: Column, at: Column) -> Column:
    """The same day of the month, or the month's last one."""
    months = (F.year(at) - F.year(base)) * 12 + F.month(at) - F.month(base)
    step = F.floor(months / interval)
    found = _first_from(at, step, lambda k: _on(F.add_months(F.to_date(base), (k * interval).cast("int")), base))
    return F.when(months < 0, base).otherwise(found)


def next_yearly(base: Column, interval: Column, at: Column) -> Column:
    """The same day of the year; 29 February is 1 March in other years."""
    years = F.year(at) - F.year(base)

    def candidate(k: Column) -> Column:
        date = F.add_months(F.to_date(base), (k * interval * 12).cast("int"))
        leap_day = (F.month(base) == 2) & (F.dayofmonth(base) == 29) & (F.dayofmonth(date) == 28)
        return _on(F.when(leap_day, F.date_add(date, 1)).otherwise(date), base)

    return F.when(years < 0, base).otherwise(_first_from(at, F.floor(years / interval), candidate))


def next_occurrence(base: Column, kind: Column, interval: Column, at: Column, until: Column | None = None) -> Column:
    """The next time of a plain recurrence (none, daily, weekly, monthly or yearly) not before a time; null beyond its end."""
    every = F.greatest(interval, F.lit(1))
    found = base
    for name, f in (("daily", next_daily), ("weekly", next_weekly), ("monthly", next_monthly), ("yearly", next_yearly)):
        found = F.when(kind == name, f(base, every, at)).otherwise(found)
    return found if until is None else F.when(until.isNull() | (found <= until), found)


def nth_weekday(month: Column, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday is 0) of a date's month, from its end if n is negative; null if there is none."""
    name = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")[weekday]
    if n > 0:
        date = F.date_add(F.next_day(F.last_day(F.add_months(month, -1)), name), 7 * (n - 1))
    else:
        date = F.date_add(F.next_day(F.last_day(month), name), 7 * n)
    return F.when(F.trunc(date, "month") == F.trunc(month, "month"), date)


_DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")


def rule_days(rule: Column) -> Column:
    """The weekdays of a rule's BYDAY as numbers (Monday is 0), in its order; unknown ones are left out."""
    codes = F.split(F.coalesce(rule_parts(rule)["BYDAY"], F.lit("")), ",")
    known = F.array(*[F.lit(d) for d in _DAYS])
    return F.filter(F.transform(codes, lambda c: (F.array_position(known, F.btrim(c)) - 1).cast("int")), lambda d: d >= 0)


def rule_number(rule: Column, part: str) -> Column:
    """The first number of a rule's part (BYMONTHDAY, BYMONTH or BYSETPOS); null if it has none."""
    numbers = F.filter(F.transform(F.split(rule_parts(rule)[part], ","), lambda x: F.btrim(x).try_cast("int")), lambda x: x.isNotNull())
    return F.get(numbers, F.lit(0))


def day_by_position(first: Column, weekday: Column, position: Column) -> Column:
    """The day of the month (given by its first) that is the n-th weekday, from its end if n is negative; null if there is none."""
    size = F.dayofmonth(F.last_day(first))
    ahead = 1 + F.pmod(weekday - F.weekday(first), F.lit(7)) + (position - 1) * 7
    back = size - F.pmod(F.weekday(F.last_day(first)) - weekday, F.lit(7)) + (position + 1) * 7
    day = F.when(position > 0, ahead).when(position < 0, back)
    return F.when(day.between(1, size), day)


def _ruled_day(first: Column, base: Column, rule: Column, plain: Column) -> Column:
    """The day of a month that a rule picks: by weekday and position, by number (from the end if negative, and within the month), or else the plain one."""
    size, days, position, number = F.dayofmonth(F.last_day(first)), rule_days(rule), rule_number(rule, "BYSETPOS"), rule_number(rule, "BYMONTHDAY")
    by_number = F.least(F.greatest(F.when(number > 0, number).otherwise(size + number + 1), F.lit(1)), size)
    return F.when(position.isNotNull() & (F.size(days) > 0), day_by_position(first, F.get(days, F.lit(0)), position)).when(number.isNotNull(), by_number).otherwise(plain)


def next_by_rule(base: Column, kind: Column, interval: Column, at: Column, rule: Column, until: Column | None = None) -> Column:
    """The next time of a recurrence not before a time, with its rule's BYDAY, BYMONTHDAY, BYMONTH and BYSETPOS; null beyond its end, or where the month that comes up has no such day."""
    every = F.greatest(interval, F.lit(1))

    def monthly(k: Column) -> Column:
        first = F.trunc(F.add_months(F.trunc(F.to_date(base), "month"), (k * every).cast("int")), "month")
        day = _ruled_day(first, base, rule, F.least(F.dayofmonth(base), F.dayofmonth(F.last_day(first))))
        return _on(F.date_add(first, (day - 1).cast("int")), base)

    def yearly(k: Column) -> Column:
        year = F.add_months(F.trunc(F.to_date(base), "year"), (k * every * 12).cast("int"))
        month = F.coalesce(rule_number(rule, "BYMONTH"), F.month(base))
        first = F.add_months(year, (month - 1).cast("int"))
        day = _ruled_day(first, base, rule, F.dayofmonth(base))
        size = F.dayofmonth(F.last_day(first))
        leap = (month == 2) & (day == 29) & (size == 28)
        date = F.when(leap, F.date_add(first, 28)).when((day <= size) & month.between(1, 12), F.date_add(first, (day - 1).cast("int")))
        return _on(date, base)

    months = (F.year(at) - F.year(base)) * 12 + F.month(at) - F.month(base)
    years = F.year(at) - F.year(base)
    whole = lambda n, f: F.when(n < 0, base).otherwise(_first_from(at, F.floor(n / every), f))
    weekly = F.when(F.size(rule_days(rule)) > 0, next_weekday_of(base, every, at, rule_days(rule))).otherwise(next_weekly(base, every, at))
    found = F.when(kind == "daily", next_daily(base, every, at)).when(kind == "weekly", weekly).when(kind == "monthly", whole(months, monthly)).when(kind == "yearly", whole(years, yearly)).otherwise(base)
    return found if until is None else F.when(until.isNull() | (found <= until), found)


#: Names of a calendar service's recurrences (fixed values).
PATTERNS = {"daily": "DAILY", "weekly": "WEEKLY", "absolutemonthly": "MONTHLY", "relativemonthly": "MONTHLY", "absoluteyearly": "YEARLY", "relativeyearly": "YEARLY"}
POSITIONS = {"first": "1", "second": "2", "third": "3", "fourth": "4", "last": "-1"}


def rule_of_pattern(pattern: Column, range_: Column, zone: Column) -> Column:
    """A calendar service's recurrence as a rule: pattern is a struct of type, interval, month, dayOfMonth, daysOfWeek and index; range_ of type, endDate, numberOfOccurrences and recurrenceTimeZone. An end date includes that day in its zone, the event's, or UTC. Null for single events."""
    kind = F.lower(pattern["type"])
    named = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)
    part = lambda name, value, *kinds: F.when(kind.isin(*kinds) if kinds else F.lit(True), F.concat(F.lit(f"{name}="), value.cast("string")))
    days = F.array_compact(F.transform(pattern["daysOfWeek"], lambda d: named({n: c for n, c in zip(("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"), _DAYS)}, F.lower(F.btrim(d)))))
    where = F.coalesce(range_["recurrenceTimeZone"], zone, F.lit("UTC"))
    last = F.to_utc_timestamp(F.concat(range_["endDate"], F.lit(" 23:59:59")).try_cast("timestamp"), where)
    ends = F.lower(range_["type"])
    parts = F.array_compact(F.array(
        F.concat(F.lit("FREQ="), named(PATTERNS, kind)),
        F.when(pattern["interval"] > 1, part("INTERVAL", pattern["interval"])),
        F.when(F.size(days) > 0, part("BYDAY", F.array_join(days, ","), "weekly")),
        part("BYMONTH", pattern["month"], "absoluteyearly"),
        part("BYMONTHDAY", pattern["dayOfMonth"], "absolutemonthly", "absoluteyearly"),
        part("BYSETPOS", named(POSITIONS, F.lower(pattern["index"])), "relativemonthly", "relativeyearly"),
        F.when(F.size(days) > 0, part("BYDAY", F.array_join(days, ","), "relativemonthly", "relativeyearly")),
        part("BYMONTH", pattern["month"], "relativeyearly"),
        F.when((ends == "numbered") & (range_["numberOfOccurrences"] > 0), part("COUNT", range_["numberOfOccurrences"])),
        F.when(ends == "enddate", part("UNTIL", F.date_format(last, "yyyyMMdd'T'HHmmss'Z'"))),
    ))
    return F.when(kind.isin(*PATTERNS), F.array_join(parts, ";"))


def rule_parts(rule: Column) -> Column:
    """A recurrence rule's parts by name."""
    return F.str_to_map(F.upper(F.regexp_replace(rule, "^RRULE:", "")), F.lit(";"), F.lit("="))


def rule_end(start: Column, rule: Column) -> Column:
    """When a rule's last occurrence is: its UNTIL, else COUNT steps of INTERVAL from the start; null if it has neither."""
    parts = rule_parts(rule)
    until = F.coalesce(F.try_to_timestamp(parts["UNTIL"], F.lit("yyyyMMdd'T'HHmmss'Z'")), F.try_to_timestamp(parts["UNTIL"], F.lit("yyyyMMdd")))
    steps = ((parts["COUNT"].cast("int") - 1) * F.greatest(F.coalesce(parts["INTERVAL"].cast("int"), F.lit(1)), F.lit(1))).cast("int")
    day = F.to_date(start)
    last = F.when(parts["FREQ"] == "DAILY", F.date_add(day, steps)).when(parts["FREQ"] == "WEEKLY", F.date_add(day, steps * 7)).when(parts["FREQ"] == "MONTHLY", F.add_months(day, steps)).when(parts["FREQ"] == "YEARLY", F.add_months(day, steps * 12))
    return F.coalesce(until, _on(last, start))
