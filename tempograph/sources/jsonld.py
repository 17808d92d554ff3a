"""Linked data in web pages and mails: script blocks, their nodes, and facts of reservations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""


def nodes(pages: DataFrame, html: str = "html", reference: str = "reference") -> DataFrame:
    """The nodes of all blocks, arrays and graphs taken apart: reference, types, node (JSON). Blocks that aren't JSON give none."""
    blocks = pages.select(F.col(reference).alias("reference"), F.explode(F.regexp_extract_all(F.col(html), F.lit(_SCRIPT), F.lit(1))).alias("block"))
    many = lambda c: F.when(F.btrim(c).startswith("["), F.from_json(c, "array<string>")).otherwise(F.array(c))
    top = blocks.select("reference", F.explode(many(F.col("block"))).alias("node")).where(F.get_json_object("node", "$").isNotNull())
    graph = F.get_json_object("node", "$['@graph']")
    flat = top.select("reference", F.explode(F.when(graph.isNotNull(), many(graph)).otherwise(F.array("node"))).alias("node"))
    kind = F.get_json_object("node", "$['@type']")
    types = F.when(F.btrim(kind).startswith("["), F.from_json(kind, "array<string>")).otherwise(F.array(kind))
    return flat.where(kind.isNotNull()).select("reference", types.alias("types"), "node")


#: For each type: where its name, place and times lie (fixed values of the public vocabulary).
LAYOUT = {
    "FlightReservation": ("$.reservationFor.flightNumber", "$.reservationFor.arrivalAirport.name", "$.reservationFor.departureTime", "$.reservationFor.arrivalTime"),
    "LodgingReservation": ("$.reservationFor.name", "$.reservationFor.address.addressLocality", "$.checkinTime", "$.checkoutTime"),
    "EventReservation": ("$.reservationFor.name", "$.reservationFor.location.name", "$.reservationFor.startDate", "$.reservationFor.endDate"),
    "Event": ("$.name", "$.location.name", "$.startDate", "$.endDate"),
    "ParcelDelivery": ("$.trackingNumber", "$.deliveryAddress.addressLocality", "$.expectedArrivalFrom", "$.expectedArrivalUntil"),
    "Order": ("$.orderNumber", "$.seller.name", "$.orderDate", "$.none"),
}


def reservations(rows: DataFrame) -> DataFrame:
    """reference, type, name, place, starts_at, ends_at, cancelled of the nodes of known types that have a name."""
    table = F.create_map(*[x for k, v in LAYOUT.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    known = rows.select("reference", "node", F.explode("types").alias("type")).withColumn("at", F.try_element_at(table, F.col("type"))).where("at is not null")
    status = F.get_json_object("node", "$.reservationStatus")
    read = lambda k: F.nullif(F.btrim(F.call_function("get_json_object", F.col("node"), F.col("at")[k])), F.lit(""))
    out = known.select("reference", "type", read(0).alias("name"), read(1).alias("place"), F.try_to_timestamp(read(2)).alias("starts_at"), F.try_to_timestamp(read(3)).alias("ends_at"), F.coalesce(status.contains("Cancel"), F.lit(False)).alias("cancelled"))
    return out.where("name is not null")
