"""When and where pictures were taken: EXIF directories read in Arrow batches, and the facts that follow."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograph.functions.text import place_label

#: Bytes of a file that are looked at; metadata stands at the beginning.
HEAD = 1 << 20
#: Tags of the directories, times before offsets, in order of preference (fixed values).
EXIF, GPS = 0x8769, 0x8825
TIMES, OFFSETS = (0x9003, 0x9004, 0x0132), (0x9011, 0x9012, 0x9010)
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
#: Bytes of a value by its type: bytes, texts, short, long and rational numbers (fixed values).
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> bytes | None:
    """The TIFF part of a picture: itself, or what a JPEG's application segment holds."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return data[at + 10 : at + 2 + size]
        at += 2 + max(size, 2)
    return None


def _directory(t: bytes, order: str, at: int) -> dict[int, tuple[int, bytes]]:
    """Tags of a directory with their type and bytes; what lies outside the data is left out."""
    if at + 2 > len(t):
        return {}
    found = {}
    (n,) = struct.unpack_from(order + "H", t, at)
    for k in range(min(n, (len(t) - at - 2) // 12)):
        tag, kind, count = struct.unpack_from(order + "HHI", t, at + 2 + 12 * k)
        size = _SIZES.get(kind, 0) * count
        start = at + 10 + 12 * k
        if size > 4:
            (start,) = struct.unpack_from(order + "I", t, start)
        if 0 < size <= len(t) - start:
            found.setdefault(tag, (kind, t[start : start + size]))
    return found


def _text(entry: tuple[int, bytes] | None) -> str | None:
    return entry[1].split(b"\0")[0].decode("ascii", "replace") if entry and entry[0] == 2 else None


def _degrees(entry: tuple[int, bytes] | None, order: str, negative: bool, most: float) -> float | None:
    if not entry or entry[0] != 5 or len(entry[1]) != 24:
        return None
    n = struct.unpack(order + "6I", entry[1])
    if 0 in n[1::2]:
        return None
    value = n[0] / n[1] + n[2] / n[3] / 60 + n[4] / n[5] / 3600
    return (-value if negative else value) if value <= most else None


def fields(data: bytes) -> tuple[datetime | None, float | None, float | None]:
    """When a picture was taken (in UTC; a time without an offset counts as UTC), latitude and longitude."""
    t = _tiff(data)
    if t is None or len(t) < 8:
        return None, None, None
    order = "<" if t[:2] == b"II" else ">"
    first = _directory(t, order, struct.unpack_from(order + "I", t, 4)[0])
    below = {tag: _directory(t, order, struct.unpack(order + "I", first[tag][1])[0]) for tag in (EXIF, GPS) if tag in first and first[tag][0] == 4 and len(first[tag][1]) == 4}
    every, gps = first | below.get(EXIF, {}), below.get(GPS, {})
    taken = None
    raw = next((_text(every[x]) for x in TIMES if x in every), None)
    if raw:
        try:
            taken = datetime.strptime(raw, "%Y:%m:%d %H:%M:%S")
            offset = next((_text(every[x]) for x in OFFSETS if x in every), None)
            if offset and offset[0] in "+-" and ":" in offset:
                hours, minutes = map(int, offset[1:].split(":"))
                taken -= (-1 if offset[0] == "-" else 1) * timedelta(hours=hours, minutes=minutes)
        except ValueError:
            pass
    south, west = (_text(gps.get(x)) or "" for x in (LAT_REF, LON_REF))
    return taken, _degrees(gps.get(LAT), order, south[:1] == "S", 90), _degrees(gps.get(LON), order, west[:1] == "W", 180)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "modified", "taken_at", "latitude", "longitude"]
    for b in batches:
        for k in range(b.num_rows):
            row = b.slice(k, 1)
            taken, lat, lon = fields(row["content"][0].as_py() or b"")
            yield pa.RecordBatch.from_arrays([row["path"], row["modified"], pa.array([taken], pa.timestamp("us")).cast(pa.timestamp("us", "UTC")), pa.array([lat], pa.float64()), pa.array([lon], pa.float64())], names)


def metadata(files: DataFrame) -> DataFrame:
    """path, taken_at (the time of the file where the picture has none), latitude and longitude of files as binaryFile reads them."""
    head = files.select("path", F.col("modificationTime").alias("modified"), F.expr(f"substring(content, 1, {HEAD})").alias("content"))
    read = head.mapInArrow(_read, "path string, modified timestamp, taken_at timestamp, latitude double, longitude double")
    return read.select("path", F.coalesce("taken_at", "modified").alias("taken_at"), "latitude", "longitude")


def facts_of_pictures(pictures: DataFrame, owner: str, place: Column | None = None) -> DataFrame:
    """What pictures say of their owner: they took one at a place (where its name is known), visited a spot (where only its position is), or took a picture, which is then named by its path. valid_from is when."""
    name = F.lit(None).cast("string") if place is None else place
    spot = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), place_label(F.col("latitude"), F.col("longitude")))
    predicate = F.when(name.isNotNull(), "took_photo_at").when(spot.isNotNull(), "visited").otherwise("took_photo")
    return pictures.select(F.lit(owner).alias("subject"), predicate.alias("predicate"), F.coalesce(name, spot, F.col("path")).alias("object"), name.isNotNull().alias("object_is_entity"), F.col("taken_at").alias("valid_from"), F.col("path").alias("raw_reference"), "latitude", "longitude")
