"""Calendar texts as events and facts; everything stays in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.functions.recurrence import rule_end, rule_parts


def _line(block: Column, name: str) -> Column:
    """A property's parameters and value; nulls if there is none."""
    pattern = rf"(?im)^{name}((?:;[^:\r\n]*)?):([^\r\n]*)"
    found = block.rlike(pattern)
    return F.struct(F.when(found, F.regexp_extract(block, pattern, 1)).alias("params"), F.when(found, F.regexp_extract(block, pattern, 2)).alias("value"))


def _plain(value: Column) -> Column:
    """A text value without its escapes."""
    value = F.regexp_replace(value, r"\\[nN]", "\n")
    return F.regexp_replace(value, r"\\([,;\\])", "$1")


def _time(line: Column, zones: list[str]) -> Column:
    """A time in UTC: as it stands with Z or as a date, else in its TZID's zone; one that is not known counts as UTC."""
    value, zone = F.btrim(line["value"]), F.regexp_extract(line["params"], r'(?i);TZID="?([^;:"]+)', 1)
    local = F.coalesce(F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmss")), F.try_to_timestamp(value, F.lit("yyyyMMdd")))
    utc = F.try_to_timestamp(value, F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return F.coalesce(utc, F.to_utc_timestamp(local, F.when(zone.isin(zones), zone).otherwise("UTC")))


def known_zones(texts: DataFrame) -> list[str]:
    """The names of the time zones that the session knows."""
    return sorted(texts.sparkSession._jvm.java.time.ZoneId.getAvailableZoneIds())


def events(texts: DataFrame, text: str = "text", reference: str = "reference", zones: list[str] | None = None) -> DataFrame:
    """Each VEVENT of the texts: reference, uid, summary, starts_at, ends_at, location, status, rule, attendees."""
    zones = known_zones(texts) if zones is None else zones
    unfolded = F.regexp_replace(F.col(text), r"\r?\n[ \t]", "")
    blocks = texts.select(F.col(reference).alias("reference"), F.explode(F.regexp_extract_all(unfolded, F.lit(r"(?is)BEGIN:VEVENT\s*\n(.*?)END:VEVENT"), F.lit(1))).alias("b"))
    b = F.col("b")
    people = F.regexp_extract_all(b, F.lit(r"(?im)^(ATTENDEE[^\r\n]*)"), F.lit(1))
    shown = F.transform(people, lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r'(?i);CN="?([^;:"]+)', 1), F.lit("")), F.nullif(F.regexp_extract(p, r"(?i)mailto:(\S+)", 1), F.lit(""))))
    named = lambda n: F.nullif(F.btrim(_plain(_line(b, n)["value"])), F.lit(""))
    return blocks.select("reference", named("UID").alias("uid"), named("SUMMARY").alias("summary"), _time(_line(b, "DTSTART"), zones).alias("starts_at"), _time(_line(b, "DTEND"), zones).alias("ends_at"), named("LOCATION").alias("location"), named("STATUS").alias("status"), F.btrim(_line(b, "RRULE")["value"]).alias("rule"), F.filter(shown, lambda p: p.isNotNull()).alias("attendees"))


def facts(rows: DataFrame, user: str | None) -> DataFrame:
    """Facts of events that have a start and a summary or uid: the user's event, its place, who attends.

    Returns reference, subject, predicate, object, valid_from, valid_until,
    recurrence, repeats_until; a recurring event has no end of its own.
    """
    kind = F.coalesce(F.lower(rule_parts(F.col("rule"))["FREQ"]), F.lit("none"))
    kind = F.when(kind.isin("daily", "weekly", "monthly", "yearly"), kind).otherwise("none")
    rows = rows.withColumn("name", F.coalesce("summary", "uid")).where("starts_at is not null and name is not null").withColumn("kind", kind)
    nothing = F.lit(None).cast("timestamp")

    def fact(subject: Column, predicate: str, obj: Column, main: bool = False) -> Column:
        since, until = (F.col("starts_at"), F.when(F.col("kind") == "none", F.col("ends_at"))) if main else (nothing, nothing)
        end = F.when(F.col("kind") != "none", rule_end(F.col("starts_at"), F.col("rule"))) if main else nothing
        return F.struct(subject.alias("subject"), F.lit(predicate).alias("predicate"), obj.alias("object"), since.alias("valid_from"), until.alias("valid_until"), (F.col("kind") if main else F.lit("none")).alias("recurrence"), end.alias("repeats_until"))

    own = F.array(fact(F.lit(user).cast("string"), "has_event", F.col("name"), True), fact(F.col("name"), "located_in", F.col("location")))
    there = F.transform("attendees", lambda p: fact(p, "attending", F.col("name")))
    return rows.select("reference", F.explode(F.concat(own, there)).alias("f")).select("reference", "f.*").where("subject is not null and object is not null")
