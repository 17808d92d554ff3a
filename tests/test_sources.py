"""Calendar, linked data, folders, notes and text functions on small inputs."""

import datetime as dt

from pyspark.sql import functions as F

ICAL = "BEGIN:VCALENDAR\r\nBEGIN:VEVENT\r\nUID:1\r\nSUMMARY:Team\\, weekly\r\nDTSTART;TZID=Europe/Berlin:20240105T100000\r\nDTEND;TZID=Australia/Sydney:20240105T210000\r\nLOCATION:Room\r\n  4\r\nRRULE:FREQ=WEEKLY;COUNT=3\r\nATTENDEE;CN=Ann:mailto:ann@x.org\r\nATTENDEE:mailto:bo@x.org\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nUID:2\r\nDTSTART;VALUE=DATE:20240301\r\nEND:VEVENT\r\nBEGIN:VEVENT\r\nSUMMARY:no start\r\nDTSTART:soon\r\nEND:VEVENT\r\nEND:VCALENDAR"


def test_calendar(spark):
    from tempograph.sources import icalendar

    rows = icalendar.events(spark.createDataFrame([("c", ICAL), ("d", "none"), ("e", None)], "reference string, text string"))
    got = rows.collect()
    assert [(r.uid, r.summary, r.location, r.attendees) for r in got] == [("1", "Team, weekly", "Room 4", ["Ann", "bo@x.org"]), ("2", None, None, []), (None, "no start", None, [])]
    assert got[0].starts_at == dt.datetime(2024, 1, 5, 9) and got[0].ends_at == dt.datetime(2024, 1, 5, 10) and got[2].starts_at is None
    facts = {(r.subject, r.predicate, r.object, r.recurrence) for r in icalendar.facts(rows, "me").collect()}
    assert facts == {("me", "has_event", "Team, weekly", "weekly"), ("Team, weekly", "located_in", "Room 4", "none"), ("Ann", "attending", "Team, weekly", "none"), ("bo@x.org", "attending", "Team, weekly", "none"), ("me", "has_event", "2", "none")}
    assert icalendar.facts(rows, "me").where("repeats_until is not null").first().repeats_until == dt.datetime(2024, 1, 19, 9)


def test_linked_data(spark):
    from tempograph.sources import jsonld

    html = """<script type='application/ld+json'>[{"@type":"FlightReservation","reservationStatus":"http://schema.org/ReservationCancelled","reservationFor":{"flightNumber":"X1","departureTime":"2024-01-01T10:00:00Z"}}]</script>
<SCRIPT async type=application/ld+json>{"@graph":[{"@type":["Event","Thing"],"name":"Fair","location":{"name":"Hall"}},{"name":"no type"}]}</SCRIPT><script type="application/ld+json">{broken</script><script>{"@type":"Event","name":"other"}</script>"""
    rows = jsonld.nodes(spark.createDataFrame([("a", html), ("b", None), ("c", "")], "reference string, html string"))
    got = sorted((r.type, r.name, r.place, r.cancelled) for r in jsonld.reservations(rows).collect())
    assert got == [("Event", "Fair", "Hall", False), ("FlightReservation", "X1", None, True)]


def test_folder_changes(spark, tmp_path):
    from tempograph.sources.files import changes, listing

    for name in ("a.jpg", "b.JPG", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    before = spark.createDataFrame(listing(spark, str(tmp_path), ["jpg"]).collect(), "path string, modified timestamp, size long")
    (tmp_path / "a.jpg").write_bytes(b"xy")
    (tmp_path / "b.JPG").unlink()
    (tmp_path / "d.jpg").write_bytes(b"z")
    (tmp_path / "e.jpg").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: r.change for r in changes(before, listing(spark, str(tmp_path), ["jpg"])).collect()}
    assert got == {"a.jpg": "changed", "b.JPG": "gone", "d.jpg": "new"}


def test_notes_there_and_back(spark):
    from tempograph.sources.files import facts_of_notes, notes

    entities = spark.createDataFrame([(1, "A/B"), (2, "a_b"), (3, "C")], "id long, name string")
    facts = spark.createDataFrame([("x", 1, "knows", 3, None), ("y", 1, "age", None, "7")], "id string, subject_id long, predicate string, object_id long, object_literal string")
    made = notes(facts, entities)
    assert {r.id: r.stem for r in made.collect()} == {1: "A_B", 2: "a_b-2", 3: "C"}
    assert [tuple(r) for r in facts_of_notes(made).orderBy("predicate").collect()] == [(1, "A/B", "age", "7", False), (1, "A/B", "knows", "C", True)]


def test_text_functions(spark):
    from tempograph.functions import text

    row = spark.range(1).select(
        text.salient(text.without_possessives(F.lit("Where did Ann's ANN and Bob’s x dog go?"))).alias("a"),
        text.sender_domain(F.lit("X <me@Mc.Mailchimp.com>")).alias("b"), text.bulk_mail(F.lit("X <me@mc.mailchimp.com>"), F.lit(False)).alias("c"), text.bulk_mail(F.lit("a@notmailchimp.com"), F.lit(False)).alias("d"), text.bulk_mail(F.lit(None).cast("string"), F.lit(False)).alias("e"),
        text.place_label(F.lit(46.50004), F.lit(-0.0004)).alias("f"), text.box(F.lit(0.0), F.lit(179.9), 100)["min_lon"].alias("g"), text.backoff(F.lit(4), 2.0, 10.0).alias("h"),
    ).first()
    assert tuple(row) == (["Ann", "Bob", "dog", "go"], "mc.mailchimp.com", True, False, False, "46.500, 0.000", -180.0, 10.0)
