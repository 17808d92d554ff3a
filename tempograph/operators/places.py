"""Writing where entities are: restatements are merged in time and space, moves close what was open."""

from __future__ import annotations

from collections.abc import Iterator
from math import atan2, cos, radians, sin, sqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.functions.render import SAME_PLACE_KM
from tempograph.functions.scalars import EARTH_KM

_PLACE = "entity_id long, location_type_id int, id long, address string, latitude double, longitude double, timezone string, valid_from timestamp, valid_until timestamp, statements int"
_SCHEMA = pa.schema([("entity_id", pa.int64()), ("location_type_id", pa.int32()), ("id", pa.int64()), ("address", pa.string()), ("latitude", pa.float64()), ("longitude", pa.float64()), ("timezone", pa.string()), ("valid_from", pa.timestamp("us", "UTC")), ("valid_until", pa.timestamp("us", "UTC")), ("statements", pa.int32())])


def _km(a: dict, b: dict) -> float | None:
    if None in (a["latitude"], a["longitude"], b["latitude"], b["longitude"]):
        return None
    p, q = radians(a["latitude"]), radians(b["latitude"])
    h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b["longitude"] - a["longitude"]) / 2) ** 2
    return 2 * EARTH_KM * atan2(sqrt(h), sqrt(max(1 - h, 0.0)))


def same_place(a: dict, b: dict) -> bool:
    """What both have must agree, equal addresses or nearby points, and they must have something in common."""
    km = _km(a, b)
    agree = [x for x in (None if a["address"] is None or b["address"] is None else a["address"] == b["address"], None if km is None else km < SAME_PLACE_KM) if x is not None]
    return bool(agree) and all(agree)


def _meet(a: dict, b: dict) -> bool:
    before = lambda x, y: x["valid_from"] is None or y["valid_until"] is None or x["valid_from"] < y["valid_until"]
    return before(a, b) and before(b, a)


def _state(places: list[dict], said: dict) -> None:
    """Takes one statement into the places of an entity and kind."""
    for p in places:
        if same_place(p, said) and _meet(p, said):
            for c in ("address", "latitude", "longitude", "timezone"):
                p[c] = said[c] if p[c] is None else p[c]
            p["valid_from"] = None if None in (p["valid_from"], said["valid_from"]) else min(p["valid_from"], said["valid_from"])
            p["valid_until"] = None if None in (p["valid_until"], said["valid_until"]) else max(p["valid_until"], said["valid_until"])
            p["statements"] += 1
            return
    if said["valid_from"] is not None:
        for p in places:
            if p["valid_until"] is None and (p["valid_from"] is None or p["valid_from"] < said["valid_from"]):
                p["valid_until"] = said["valid_from"]
    places.append(said)


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, places = None, []

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(places, _SCHEMA)

    for b in batches:
        for r in b.to_pylist():
            k = r["entity_id"], r["location_type_id"]
            if k != key and places:
                yield made()
                places.clear()
            key = k
            _state(places, r | {"statements": 1})
    if places:
        yield made()


def located(there: DataFrame, statements: DataFrame) -> DataFrame:
    """The places of each entity and kind after statements, taken in order of arrival.

    Both have id, entity_id, location_type_id, address, latitude, longitude,
    timezone, valid_from, valid_until; statements have arrival, and what is
    there comes first, by id. A statement of a place that a row has already, at
    a time that the row's meets, widens the oldest such row's window (an open
    side stays open) and fills in what it lacks. Any other one closes the open
    rows that began before it, if it says since when, and is a row of its own.
    Rows of a key stand together and are read as a stream, so a task holds the
    different places of one entity and kind, not its statements.

    Returns the columns of a place and statements, how many each row stands for.
    """
    rows = there.withColumn("arrival", F.lit(None).cast("long")).unionByName(statements.withColumn("arrival", F.col("arrival").cast("long")).select(*there.columns, "arrival"))
    keys = ["entity_id", "location_type_id"]
    columns = [c.split()[0] for c in _PLACE.split(", ")][:-1]
    ordered = rows.withColumn("_later", F.coalesce("arrival", F.lit(-(2**62)))).repartition(*keys).sortWithinPartitions(*keys, "_later", "id")
    return ordered.select(*columns).mapInArrow(_fold, _PLACE)


def anchored(places: DataFrame, fixes: DataFrame) -> DataFrame:
    """One point for each place entity: the last of its fixes (entity_id, latitude, longitude, source_fact_id, arrival) replaces what it had."""
    columns = ["latitude", "longitude", "source_fact_id"]
    rows = places.select("entity_id", *columns, F.lit(-(2**62)).alias("arrival")).unionByName(fixes.select("entity_id", *columns, F.col("arrival").cast("long")))
    return rows.groupBy("entity_id").agg(F.max(F.struct("arrival", *columns)).alias("p")).select("entity_id", *[F.col("p")[c].alias(c) for c in columns])
