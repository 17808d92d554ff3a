"""Inference, resolution of names, preferences, places, trash, centrality, recurrence, retrieval and pictures by hand."""

import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

FACT = "id string, subject_id long, predicate string, object_id long, object_literal string, valid_from timestamp, valid_until timestamp, confidence double, fact_status_id int, pending boolean, inferred boolean, depth int"


def day(n):
    return n and dt.datetime(2020, 1, n)


def facts_of(spark, rows):
    """Rows of id, subject, predicate, object, from, until, confidence, state."""
    return spark.createDataFrame([(i, s, p, o, None, day(a), day(b), c, st, False, False, 0) for i, s, p, o, a, b, c, st in rows], FACT)


def test_inference_chain_cycle_and_second_run(spark):
    from tempograph.operators.inference import VISITED, edges, infer, transitive

    rows = [("v1", 1, "visited", 10, 2, 20, 0.9, 1), ("l1", 10, "located_in", 20, 5, None, 0.8, 1), ("l2", 20, "located_in", 30, None, 9, 0.5, 2), ("l3", 30, "located_in", 20, None, None, 0.5, 1), ("l4", 20, "located_in", 1, None, None, 0.5, 1)]
    rows += [("v2", 2, "visited", 10, 10, None, 0.9, 1), ("v3", 3, "visited", 20, None, None, 0.9, 1), ("v4", 3, "visited", 30, None, None, 0.1, 6), ("v5", 4, "visited", 20, None, None, 0.9, 3)]
    got = {(r.subject_id, r.object_id): (r.first, r.second, r.valid_from, r.valid_until, r.depth, r.turn) for r in infer(facts_of(spark, rows)).collect()}
    assert got == {  # 1 never visits itself; 2's stay ends before l2 begins to hold; 3 was at 30 already, and so not anew; 4 is disputed
        (1, 20): ("v1", "l1", day(5), day(20), 1, 1), (1, 30): ("i|1|visited|20", "l2", day(5), day(9), 2, 2),
        (2, 20): ("v2", "l1", day(10), None, 1, 1), (2, 1): ("i|2|visited|20", "l4", day(10), None, 2, 2), (3, 1): ("v3", "l4", None, None, 1, 1),
    }
    new = infer(facts_of(spark, rows))
    again = facts_of(spark, rows).unionByName(new.select("id", "subject_id", "predicate", "object_id", "object_literal", "valid_from", "valid_until", "confidence", F.lit(2).alias("fact_status_id"), F.lit(False).alias("pending"), F.lit(True).alias("inferred"), "depth"))
    assert infer(again).count() == 0
    assert edges(new).count() == 10
    ring = facts_of(spark, [(f"l{k}", k, "located_in", (k + 1) % 4, None, None, 1.0, 1) for k in range(4)])
    both = infer(ring, [VISITED, transitive("located_in", "located_in")])
    assert {(r.subject_id, r.object_id) for r in both.collect()} == {(a, b) for a in range(4) for b in range(4) if b not in (a, (a + 1) % 4)}
    assert infer(ring.limit(0)).count() == 0


def test_names_are_resolved_in_tiers(spark):
    from tempograph.operators.resolution import lookups, phrase_hits, index, resolved

    entities = spark.createDataFrame([(1, "Rome", 2), (2, "Anna Rome-Berg", 1), (3, "Eternal City", 2), (4, "Rome", 1), *[(10 + k, f"filler {k}", 3) for k in range(40)]], "id long, name string, entity_type_id int")
    aliases = spark.createDataFrame([(3, "ROME"), (1, "rome"), (2, "Berg")], "entity_id long, alias string")
    asked = spark.createDataFrame([("rOME", 2), ("rOME", 1), ("rome berg", 1), ("berg", 1), ("filler 7", 3), ("nowhere", 2), ("***", 2), ("berg", 2)], "asked string, entity_type_id int")
    got = {}
    for r in lookups(entities, aliases, asked).collect():
        got.setdefault(r.asked, []).append((r.place, r.id, r.kind))
    # an equal name counts before the same entity's alias; of the results the alias comes first
    assert [x[1:] for x in sorted(got["rOME"])] == [(3, 2), (1, 1), (4, 1), (2, 3)]
    assert [x[1:] for x in sorted(got["rome berg"])] == [(2, 3)] and got["filler 7"][0][1:] == (17, 1)
    assert "nowhere" not in got and "***" not in got
    best = {(r.asked, r.wanted): r.id for r in resolved(entities, aliases, asked).collect()}
    assert best == {("rOME", 2): 3, ("rOME", 1): 4, ("rome berg", 1): 2, ("berg", 1): 2, ("filler 7", 3): 17, ("nowhere", 2): None, ("***", 2): None, ("berg", 2): None}
    ranks = {r.id: r["rank"] for r in phrase_hits(index(entities, aliases), spark.createDataFrame([("rome",)], "asked string")).collect()}
    import math

    n, mean = 44, sum([1 + 1, 3 + 1, 2 + 1, 1, *[2] * 40]) / 44  # tokens of names and aliases
    want = lambda f, size: -math.log((n - 4 + 0.5) / 4.5) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))
    assert ranks == pytest.approx({1: want(2, 2), 2: want(1, 4), 3: want(1, 3), 4: want(1, 1)}, abs=1e-8)


def test_preference_rules(spark):
    from tempograph.operators.preferences import identified, preference_audit, preferences_after, upserted

    schema = "id long, entity_id long, key string, value string, confidence double, overridden_by_user boolean"
    contexts = spark.createDataFrame([(p, k, v) for p, k, v in [(1, "place", "home"), (1, "hour", "8"), (11, "hour", "8"), (11, "place", "home"), (11, "hour", "8"), (12, "hour", "8")]], "preference_id long, context_key string, context_value string")
    there = identified(spark.createDataFrame([(1, 7, "tea", "green", 0.5, False), (2, None, "tea", "black", 1.0, True)], schema), contexts)
    writes = [
        (11, 7, "tea", "white", 0.6, False), (12, 7, "tea", "hour only", 0.1, False), (13, 7, "tea", "no context", 0.3, False), (14, 7, "tea", "again", 0.3, False), (15, 7, "tea", "lower", 0.2, False),
        (16, 7, "tea", "mine", 1.0, True), (17, 7, "tea", "too late", 0.9, False), (18, 7, "tea", "mine too", 1.0, True), (19, 7, "tea", "unsure", 0.9, True), (20, 7, "tea", "odd", 1.5, False),
        (21, None, "tea", "all", 0.9, False), (22, None, "coffee", None, 0.2, False), (23, None, "coffee", "x", 0.3, False),
    ]
    new = identified(spark.createDataFrame(writes, schema), contexts).withColumn("arrival", F.col("id"))
    steps = upserted(there, new)
    got = {r.id: (r.action, r.preference_id, r.old_value, r.reason) for r in steps.collect()}
    higher, equal = "higher confidence inferred preference", "equal confidence inferred preference"
    assert got == {
        11: ("overwritten", 1, "green", higher), 12: ("created", 12, None, ""), 13: ("created", 13, None, ""), 14: ("kept", 13, "no context", equal), 15: ("kept", 13, "no context", None),
        16: ("overwritten", 13, "no context", "overridden by user"), 17: ("rejected", 13, "mine", None), 18: ("overwritten", 13, "mine", "updated by user"), 19: ("invalid", 13, "mine too", None), 20: ("invalid", 13, "mine too", None),
        21: ("rejected", 2, "black", None), 22: ("created", 22, None, ""), 23: ("overwritten", 22, None, higher),
    }
    audit = {(r.arrival, r.change, r.old_value, r.new_value, r.reason) for r in preference_audit(steps).collect()}
    assert (12, "created", None, "hour only", None) in audit and (18, "confidence_change", "mine", "mine too", "updated by user") in audit and not {a[0] for a in audit} & {15, 17, 19, 20, 21}
    after = {r.preference_id: (r.value, r.written_by) for r in preferences_after(there, steps).collect()}
    assert after == {1: ("white", 11), 2: ("black", None), 12: ("hour only", 12), 13: ("mine too", 18), 22: ("x", 23)}


PLACE = "id long, entity_id long, location_type_id int, address string, latitude double, longitude double, timezone string, valid_from timestamp, valid_until timestamp"


def test_places_are_restated_or_moved(spark):
    from tempograph.operators.places import anchored, located

    there = spark.createDataFrame([(1, 5, 1, "Old Street", None, None, None, day(1), None)], PLACE)
    said = [
        (2, 5, 1, "Old Street", 50.0, 8.0, "UTC", day(3), day(9)),  # the same place, which gets a point; it stays open
        (3, 5, 1, None, 50.0005, 8.0, None, None, day(2)),  # 56 m away: the same place, now without a beginning
        (4, 5, 1, "New Street", 50.0, 8.0, None, day(10), None),  # another address is a move, wherever it is
        (5, 5, 1, "Old Street", 51.0, 8.0, None, day(12), None),  # equal addresses 111 km apart are two places
        (6, 5, 2, None, 50.0, 8.0, None, None, None), (7, 5, 2, "Somewhere", None, None, None, day(4), day(5)), (8, 6, 1, None, None, None, None, day(4), None), (9, 6, 1, None, None, None, None, day(2), None),
    ]
    new = spark.createDataFrame(said, PLACE).withColumn("arrival", F.col("id"))
    got = {r.id: (r.address, r.latitude, r.timezone, r.valid_from, r.valid_until, r.statements) for r in located(there, new).collect()}
    naive = lambda v: tuple(x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x for x in v)
    assert {k: naive(v) for k, v in got.items()} == {
        1: ("Old Street", 50.0, "UTC", None, day(10), 3), 4: ("New Street", 50.0, None, day(10), day(12), 1), 5: ("Old Street", 51.0, None, day(12), None, 1),
        6: (None, 50.0, None, None, day(4), 1), 7: ("Somewhere", None, None, day(4), day(5), 1), 8: (None, None, None, day(4), None, 1), 9: (None, None, None, day(2), None, 1),
    }
    assert located(there.limit(0), new.limit(0)).count() == 0
    fixes = spark.createDataFrame([(1, 1.0, 2.0, "a", 1), (1, 3.0, 4.0, "b", 2)], "entity_id long, latitude double, longitude double, source_fact_id string, arrival long")
    old = spark.createDataFrame([(1, 0.0, 0.0, "x"), (2, 9.0, 9.0, "y")], "entity_id long, latitude double, longitude double, source_fact_id string")
    assert {tuple(r) for r in anchored(old, fixes).collect()} == {(1, 3.0, 4.0, "b"), (2, 9.0, 9.0, "y")}


def test_facts_come_back_from_the_trash(spark):
    from tempograph.operators.trashcan import restore_audit, restored_all, thrown_away

    rows = [("a", 1, "p", 2, 1, 5, 0.9, 6), ("b", 1, "p", 3, 5, 9, 0.8, 5), ("c", 1, "p", 3, 10, None, 0.7, 2), ("d", 1, "q", 3, 1, 2, 0.6, 6), ("e", 1, "q", 4, 2, 3, 0.5, 1), ("f", 9, "p", 3, None, None, 0.5, 6), ("g", 9, "r", 3, None, None, 0.5, 6)]
    facts = facts_of(spark, rows).withColumn("inferred", F.col("id").isin("d", "f")).withColumn("depth", F.col("inferred").cast("int"))
    sources = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("e", 2, "z")], "fact_id string, source_type_id int, raw_reference string")
    edges = spark.createDataFrame([("a", "d", True), ("b", "d", False), ("e", "d", True), ("e", "f", True)], "parent_fact_id string, child_fact_id string, is_positive boolean")
    chosen = spark.createDataFrame([(x,) for x in "abcdfga"], "id string")
    trash = thrown_away(facts, sources, edges, chosen, F.lit("2024-01-01").cast("timestamp"))
    assert trash.count() == 6
    back = restored_all(facts.where("id = 'e'"), trash)
    got = {r.old_id: (r.id, r.fact_status_id, [tuple(s) for s in r.sources], [tuple(p) for p in r.parents or []], round(r.confidence, 6)) for r in back.collect()}
    assert got == {
        "a": ("a~", 1, [(1, "y"), (2, "x")], [], 0.9), "b": ("b~", 3, [], [], 0.8),  # b meets a, ends included
        "c": ("c~", 2, [], [], 0.7), "d": ("d~", 3, [], [("a~", True), ("b~", False)], round((0.9 - 0.8) * 0.8 * 0.75, 6)),  # d meets e; e never went
        "f": ("f~", 1, [], [], 0.0), "g": ("g~", 1, [], [], 0.5),
    }
    assert restore_audit(back, F.lit("2024-01-01").cast("timestamp")).where("new_value = '{\"restored_fact_id\":\"a~\"}'").count() == 1


CHANGE = "subject_id long, object_id long, old_status int, new_status int"
CHANGES = [(1, 2, None, 1), (1, 3, None, 3), (1, None, None, 2), (2, 2, None, 1), (1, 2, 1, 5), (4, 1, None, 6), (1, 3, 3, 1), (2, 2, 1, None), (1, 2, 5, 1)]


def test_centrality_is_kept_up_in_any_order(spark):
    from tempograph.streaming.centrality import boost, brought_forward, deltas

    want = {1: 3, 2: 1, 3: 1}
    for rows in (CHANGES, CHANGES[::-1]):
        counts = spark.createDataFrame([], "entity_id long, n long")
        for part in (rows[:4], rows[4:]) if rows is CHANGES else (rows,):
            counts = brought_forward(counts, deltas(spark.createDataFrame(part, CHANGE)))
        assert {r.entity_id: r.n for r in counts.collect()} == want
    assert spark.range(1).select(boost(F.lit(80))).first()[0] == 2.0


def test_centrality_over_a_stream(spark, tmp_path):
    from tempograph.streaming.centrality import maintained

    last = {}

    def take(batch, _):
        last.update({r.entity_id: (r.n, r.centrality) for r in batch.collect()})

    for rows in (CHANGES[:4], CHANGES[4:]):
        spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = maintained(spark.readStream.schema(CHANGE).parquet(str(tmp_path / "in")))
        stream.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert {k: v for k, v in last.items() if v[0]} == {1: (3, 1.06), 2: (1, 1.02), 3: (1, 1.02)}


@pytest.mark.parametrize(
    "kind, base, step, now, rule, want",
    [
        ("monthly", "2024-01-09 09:00:00", 1, "2024-01-10 00:00:00", "BYDAY=TU;BYSETPOS=2", "2024-02-13 09:00:00"),
        ("monthly", "2024-01-31 09:00:00", 1, "2024-02-01 00:00:00", "RRULE:FREQ=MONTHLY;BYMONTHDAY=-1", "2024-02-29 09:00:00"),
        ("monthly", "2024-01-05 09:00:00", 2, "2024-02-01 00:00:00", "BYMONTHDAY=31", "2024-03-31 09:00:00"),
        ("monthly", "2024-01-31 09:00:00", 1, "2024-01-31 10:00:00", "BYDAY=SA;BYSETPOS=5", None),
        ("yearly", "2024-02-29 09:00:00", 1, "2024-03-01 00:00:00", None, "2025-03-01 09:00:00"),
        ("yearly", "2023-05-05 09:00:00", 1, "2024-01-01 00:00:00", "BYMONTH=11;BYDAY=FR;BYSETPOS=-1", "2024-11-29 09:00:00"),
        ("yearly", "2023-05-31 09:00:00", 1, "2024-01-01 00:00:00", "BYMONTH=6", None),
        ("yearly", "2023-05-31 09:00:00", 1, "2024-01-01 00:00:00", "BYMONTH=2;BYMONTHDAY=40", "2024-02-29 09:00:00"),
        ("weekly", "2024-01-03 09:00:00", 2, "2024-01-03 10:00:00", "BYDAY=WE,MO,XX", "2024-01-15 09:00:00"),
        ("daily", "2024-01-01 09:00:00", 3, "2024-01-04 10:00:00", "BYMONTHDAY=1", "2024-01-07 09:00:00"),
    ],
)
def test_next_by_rule(spark, kind, base, step, now, rule, want):
    from tempograph.functions.recurrence import next_by_rule

    t = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(next_by_rule(t(base), F.lit(kind), F.lit(step), t(now), F.lit(rule).cast("string")).cast("string").alias("a"), next_by_rule(t(base), F.lit(kind), F.lit(step), t(now), F.lit(rule).cast("string"), t("2024-01-02")).alias("b")).first()
    assert row.a == want and row.b is None


def test_patterns_become_rules(spark):
    from tempograph.functions.recurrence import rule_of_pattern

    schema = "p struct<type:string,interval:int,month:int,dayOfMonth:int,daysOfWeek:array<string>,index:string>, r struct<type:string,endDate:string,numberOfOccurrences:int,recurrenceTimeZone:string>, zone string"
    rows = [
        (("weekly", 2, None, None, ["Monday", " friday", "noday"], None), ("numbered", None, 5, None), None),
        (("relativeYearly", 1, 11, None, ["thursday"], "Fourth"), ("endDate", "2024-12-31", None, "America/New_York"), "UTC"),
        (("absoluteYearly", None, 2, 29, None, None), ("noEnd", None, None, None), None), (("absoluteMonthly", 1, None, 31, [], None), ("endDate", "2024-12-31", None, None), "Europe/Berlin"), (("single", 1, None, None, None, None), None, None),
    ]
    got = [r[0] for r in spark.createDataFrame(rows, schema).select(rule_of_pattern(F.col("p"), F.col("r"), F.col("zone"))).collect()]
    assert got == ["FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,FR;COUNT=5", "FREQ=YEARLY;BYSETPOS=4;BYDAY=TH;BYMONTH=11;UNTIL=20250101T045959Z", "FREQ=YEARLY;BYMONTH=2;BYMONTHDAY=29", "FREQ=MONTHLY;BYMONTHDAY=31;UNTIL=20241231T225959Z", None]


def test_trees_in_order(spark):
    from tempograph.operators.graph import in_tree_order

    rows = [(0, "root", None), (5, "a\n b", 0), (2, "b", 0), (7, "c", 5), (6, "d", 5), (1, "e", 7), (8, "x", 9), (9, "y", 8), (10, "lost", 99)]
    got = [r.line for r in in_tree_order(spark.createDataFrame(rows, "id int, name string, parent_id int")).orderBy("place").collect()]
    assert got == ["2 b", "5 a b", "  6 d", "  7 c", "    1 e"]


def test_traversal_has_room_for_nodes(spark):
    from tempograph.operators.graph import traversed

    rows = [(f"f{k:02}", 1, "p", 100 + k, None, None, 0.5 + k / 100, 1) for k in range(10)] + [("g1", 109, "q", 1, None, None, 0.9, 1), ("g2", 109, "q", 200, None, None, 0.8, 1), ("h", 200, "p", 300, None, None, 0.8, 1), ("x", 1, "p", 7, None, None, 0.99, 6)]
    facts = facts_of(spark, rows)
    edges, summary = traversed(facts, spark.createDataFrame([(1,), (300,)], "root long"), 3, 4)
    # three nodes are free: six facts are read, of which three give nodes; then there is no room left
    assert sorted((r.depth, r.fact_id) for r in edges.collect()) == [(0, f"f{k:02}") for k in range(4, 10)]
    assert {tuple(r) for r in summary.collect()} == {(1, 1, 4), (300, 0, 1)}
    edges, summary = traversed(facts, spark.createDataFrame([(1,)], "root long"), 3, 50)
    assert {tuple(r) for r in summary.collect()} == {(1, 3, 13)}
    assert {r.fact_id for r in traversed(facts, spark.createDataFrame([(109,)], "root long"), 5, 50, ["q"])[0].collect()} == {"g1", "g2"}


def test_retrieval_folds_what_says_the_same(spark):
    from tempograph.operators.resolution import index
    from tempograph.operators.retrieval import candidates, evidence, matching_messages, planned

    tasks = spark.createDataFrame([(1, "Where is Anna's cat, where?"), (2, "  "), (3, "the of"), (4, "é" * 1500)], "task_id long, task string")
    plans = {r.task_id: (r.searches, r.terms) for r in planned(tasks).collect()}
    assert plans[1] == (["Where", "is", "Anna", "cat"], ["anna", "cat"]) and plans[3] == (["the", "of"], ["the", "of"]) and 2 not in plans and plans[4] == (["é" * 1000], ["é" * 1000])
    entities = spark.createDataFrame([(1, "Anna", 1), (2, "ANNA", 1), (3, "Cat", 4), (4, "Home", 2)], "id long, name string, entity_type_id int")
    found = candidates(planned(tasks), index(entities, spark.createDataFrame([], "entity_id long, alias string")), entities)
    assert sorted((r.task_id, r.place, r.id) for r in found.collect()) == [(1, 1, 1), (1, 2, 3)]
    facts = facts_of(spark, [("a", 3, "lives_in", 4, None, None, 0.9, 1), ("b", 3, "lives_in", 4, None, None, 0.9, 1), ("c", 3, "lives_in", 4, None, None, 0.8, 1), ("d", 3, "lives_in", 4, None, None, 0.9, 6)])
    sources = spark.createDataFrame([("a", 2, "x"), ("b", 2, "x"), ("b", 1, "y")], "fact_id string, source_type_id int, raw_reference string")
    got = sorted((r.confidence, r.fact_ids, [tuple(s) for s in r.sources]) for r in evidence(found, facts, entities, sources).collect())
    assert got == [(0.8, ["c"], []), (0.9, ["a", "b"], [(1, "y"), (2, "x")])]
    messages = spark.createDataFrame([(1, "Anna has a cat"), (2, "no animals"), (3, "the cat"), (4, None)], "id long, text string")
    assert [r.id for r in matching_messages(planned(tasks).where("task_id = 1"), messages, ["id"], "text").orderBy("place").collect()] == [1, 3]


def tiff(order, entries, gps=()):
    """A TIFF block with a main and a GPS directory; entries are tag, type, count and bytes."""
    e = "<" if order == b"II" else ">"
    main = list(entries)
    size = 2 + 12 * (len(main) + bool(gps)) + 4
    gps_at = 8 + size
    data_at = gps_at + (2 + 12 * len(gps) + 4 if gps else 0)
    out, heap = b"", b""

    def directory(rows):
        nonlocal heap
        d = struct.pack(e + "H", len(rows))
        for tag, kind, count, raw in rows:
            if len(raw) <= 4:
                d += struct.pack(e + "HHI", tag, kind, count) + raw.ljust(4, b"\0")
            else:
                d += struct.pack(e + "HHII", tag, kind, count, data_at + len(heap))
                heap += raw
        return d + b"\0\0\0\0"

    if gps:
        main.append((0x8825, 4, 1, struct.pack(e + "I", gps_at)))
    out = directory(sorted(main)) + (directory(list(gps)) if gps else b"")
    return order + struct.pack(e + "HI", 42, 8) + out + heap


@pytest.mark.parametrize("order", [b"II", b"MM"])
def test_pictures(spark, tmp_path, order):
    from tempograph.sources.pictures import facts_of_pictures, fields, metadata

    e = "<" if order == b"II" else ">"
    degrees = lambda d, m, s: struct.pack(e + "6I", d, 1, m, 1, s * 100, 100)
    times = [(0x9003, 2, 20, b"2024:05:01 10:00:00\0"), (0x9011, 2, 7, b"+02:00\0"), (0x0132, 2, 20, b"2000:01:01 00:00:00\0")]
    gps = [(1, 2, 2, b"S\0"), (2, 5, 3, degrees(33, 30, 36)), (3, 2, 2, b"E\0"), (4, 5, 3, degrees(151, 0, 0))]
    whole = tiff(order, times, gps)
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + (len(whole) + 8).to_bytes(2, "big") + b"Exif\0\0" + whole + b"\xff\xda"
    assert fields(jpeg) == fields(whole) == (dt.datetime(2024, 5, 1, 8), pytest.approx(-33.51), 151.0)
    assert fields(tiff(order, times[2:], [(2, 5, 3, struct.pack(e + "6I", 1, 0, 1, 1, 1, 1))])) == (dt.datetime(2000, 1, 1), None, None)
    for k in range(len(jpeg)):  # a file that is cut off gives less, never an error
        fields(jpeg[:k])
    assert fields(b"") == fields(b"no picture") == (None, None, None)
    (tmp_path / "a.jpg").write_bytes(jpeg)
    (tmp_path / "b.jpg").write_bytes(b"\xff\xd8\xff\xda")
    read = metadata(spark.read.format("binaryFile").load(str(tmp_path)))
    got = {r.path.rsplit("/", 1)[1]: r for r in read.collect()}
    assert got["a.jpg"].taken_at == dt.datetime(2024, 5, 1, 8) and got["b.jpg"].latitude is None and got["b.jpg"].taken_at is not None
    said = {r.raw_reference.rsplit("/", 1)[1]: (r.predicate, r.object) for r in facts_of_pictures(read, "me").collect()}
    assert said["a.jpg"] == ("visited", "-33.510, 151.000") and said["b.jpg"][0] == "took_photo"
    named = facts_of_pictures(read, "me", F.when(F.col("latitude").isNotNull(), "Sydney"))
    assert {(r.predicate, r.object_is_entity) for r in named.collect()} == {("took_photo_at", True), ("took_photo", False)}


def test_rankings(spark):
    from tempograph.operators.ranking import at_k, changed, digests, rates

    ranked = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.8), ("q", "c", 3, 0.7), ("r", "a", 1, 0.5)], "question string, id string, rank int, score double")
    truth = spark.createDataFrame([("q", "b"), ("q", "z"), ("s", "a")], "question string, id string")
    got = {r.question: (r.hits, r.recall, r.precision) for r in at_k(ranked, truth, "question", 2).collect()}
    assert got == {"q": (1, 0.5, 0.5), "r": (0, 1.0, 0.0), "s": (0, 0.0, 0.0)}
    assert tuple(rates(ranked, good=F.col("score") > 0.6, first=F.col("rank") == 1).first()) == (0.75, 0.5)
    other = ranked.withColumn("rank", F.when(F.col("question") == "q", 4 - F.col("rank")).otherwise(F.col("rank"))).where("question <> 's'").unionByName(spark.createDataFrame([("t", "a", 1, 0.5)], ranked.schema))
    new = changed(digests(ranked, "question"), digests(other, "question"), "question")
    assert {r.question: r.digest is None for r in new.collect()} == {"q": False, "t": True}


def test_rules_of_rendering(spark):
    from tempograph.functions import render

    t = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(
        render.bounds(t("2024-01-02 03:04:05"), t(None)).alias("a"), render.bounds(t(None), t("2024-01-02")).alias("b"), render.bounds(t(None), t(None)).alias("c"),
        render.transcript_line(F.lit("user"), F.lit(" a\r\nb \n")).alias("d"), render.transcript_line(F.lit("user"), F.lit(" \n")).alias("e"),
        render.phrase(F.lit(' say "x"* ')).alias("f"), render.phrase(F.lit("**")).alias("g"), render.int_list(F.lit("1, 2,3,x,")).alias("h"),
        render.split_objects(F.lit("hobby"), F.lit("a, b,,c\n")).alias("i"), render.split_objects(F.lit("visited"), F.lit("a, b")).alias("j"),
        render.initial_confidence(F.lit(2), F.lit("calendar"), F.lit(None).cast("double")).alias("k"), render.initial_confidence(F.lit(4), F.lit(None).cast("string"), F.lit(None).cast("double")).alias("l"), render.initial_confidence(F.lit(1), F.lit(None).cast("string"), F.lit(0.2)).alias("m"), render.initial_confidence(F.lit(2), F.lit("fax"), F.lit(None).cast("double")).alias("n"),
        render.snippet(F.lit("a b c the d e f"), "the", 2).alias("o"),
    ).first()
    assert tuple(row) == ("2024-01-02T03:04:05Z → ...", "→ 2024-01-02T00:00:00Z", "", "user: a\\r\\nb", None, '"say ""x"""', None, [1, 3], ["a", "b", "c"], ["a, b"], 0.9, 0.3, 0.2, 0.8, "... b c <<<the>>> d e ...")


def test_sensitive_needs_the_flag(spark):
    from tempograph.functions.predicates import is_sensitive

    rows = [(True, [1, 150], None), (True, [1], "On VISA, now"), (True, None, "a visage"), (False, [150], "visa"), (None, [150], "visa"), (True, [], "éloan")]
    got = [r[0] for r in spark.createDataFrame(rows, "f boolean, c array<long>, t string").select(is_sensitive(F.col("f"), F.col("c"), F.col("t"))).collect()]
    assert got == [True, True, False, False, False, True]


def test_ranks_in_parts(spark):
    from tempograph.operators.reads import ranked_in_parts

    rows = spark.range(3000).selectExpr("if(id % 5 > 0, 'hot', concat('k', id % 3)) as k", "cast(id * 7 % 100 as int) as v", "id")
    got = {(r.k, r.id): r["rank"] for r in ranked_in_parts(rows, "k", [F.col("v").desc(), F.col("id")]).collect()}
    want, n = {}, {}
    for r in sorted(rows.collect(), key=lambda r: (-r.v, r.id)):
        n[r.k] = n.get(r.k, 0) + 1
        want[r.k, r.id] = n[r.k]
    assert got == want


def test_incoming_facts(spark):
    from tempograph.operators import ingest

    vocabulary = spark.createDataFrame([("knows", "Is Friends With", True, 7), ("owns", None, True, None), ("social", "people", False, 1)], "name string, alias string, emit_eligible boolean, default_category long")
    schema = "arrival long, predicate string, object string, categories array<long>, flagged boolean, confidence double, source_type_id int, connector string, connector_id int, raw_reference string, valid_from timestamp, valid_until timestamp, correction boolean, scope string"
    plain = dict(object="x", categories=None, flagged=False, confidence=None, source_type_id=1, connector=None, connector_id=None, raw_reference="r", valid_from=day(1), valid_until=None, correction=False, scope=None)
    rows = [
        {"predicate": " is friends WITH ", "categories": [9, 99]}, {"predicate": "knows", "categories": [99]}, {"predicate": "people"}, {"predicate": "likes"}, {"predicate": None},
        {"predicate": "owns", "connector_id": 3, "raw_reference": None}, {"predicate": "owns", "flagged": True, "object": "my Mortgage!"}, {"predicate": "owns", "object": "mortgage"}, {"predicate": "owns", "confidence": 7.0},
        {"predicate": "owns", "correction": True}, {"predicate": "owns", "correction": True, "scope": "2020-01-09 00:00:00"}, {"predicate": "owns", "correction": True, "scope": "one day"}, {"predicate": "owns", "correction": True, "scope": "always"},
    ]
    frame = spark.createDataFrame([tuple((plain | {"arrival": k} | r)[c.split()[0]] for c in schema.split(", ")) for k, r in enumerate(rows)], schema)
    now = F.lit("2020-01-20").cast("timestamp")
    got = {r.arrival: r for r in ingest.normalized(frame, vocabulary, spark.createDataFrame([(9,), (1,)], "id long"), now).collect()}
    assert [got[k].outcome for k in range(13)] == ["insert", "insert", "staged", "staged", "staged", "refused", "pending", "insert", "insert", "insert", "insert", "insert", "insert"]
    assert (got[0].predicate, got[0].categories, got[1].categories, got[7].categories) == ("knows", [9], [7], [])
    assert (got[6].fact_status_id, got[6].pending, got[8].confidence, got[7].confidence) == (3, True, 1.0, 1.0)
    assert [got[k].valid_from for k in (9, 10, 11, 12)] == [day(20), day(9), day(1), day(1)]
    unknown = spark.createDataFrame([(1, 4, "r", "likes", "p"), (2, 4, "r", "likes", "p"), (3, None, None, "likes", "p"), (4, None, None, "likes", "p"), (5, 4, "r", "likes", "q")], "arrival long, connector_id int, raw_reference string, predicate string, payload string")
    there = unknown.where("arrival = 3").selectExpr("cast(77 as long) as stage_id", "connector_id", "raw_reference", "predicate", "payload")
    stages = ingest.staged(unknown, there)
    assert sorted((r.arrival, r.stage_id, r.newly_staged) for r in stages.collect()) == [(1, 1, True), (2, 1, False), (3, 77, False), (4, 77, False), (5, 5, True)]
    first = stages.where("newly_staged").select("stage_id", F.when(F.col("stage_id") == 5, "mapped").otherwise("unmapped").alias("status"))
    decided = ingest.reviewed(first, spark.createDataFrame([(1, "knows"), (5, "knows"), (9, None)], "stage_id long, to string"), vocabulary)
    assert {r.stage_id: (r.status, r.to, r.error) for r in decided.collect()} == {1: ("mapped", "knows", None), 5: ("mapped", None, "not unmapped"), 9: (None, None, "not unmapped")}
    assert {(r.status, r.error) for r in ingest.reviewed(first.where("stage_id = 1"), spark.createDataFrame([(1, "social")], "stage_id long, to string"), vocabulary).collect()} == {("unmapped", "no predicate that may be stated")}


def test_corrections_and_confirmation(spark):
    from tempograph.operators import ingest

    facts = facts_of(spark, [("a", 1, "p", 2, 1, 5, 0.9, 1), ("b", 1, "p", 3, 5, 9, 0.8, 1), ("c", 1, "p", 3, None, None, 0.7, 1), ("d", 1, "p", 3, 5, 9, 0.7, 3), ("e", 1, "q", 3, 5, 9, 0.7, 1), ("f", 1, "p", 3, 9, None, 0.7, 1)])
    said = spark.createDataFrame([(1, "p", day(5), day(7)), (1, "p", day(6), day(9)), (2, "p", None, None)], "subject_id long, predicate string, valid_from timestamp, valid_until timestamp")
    assert sorted(r.id for r in ingest.corrected(facts, said).collect()) == ["b", "c"]
    waiting = facts.withColumn("pending", F.col("id").isin("a", "d"))
    ids = spark.createDataFrame([("a",), ("a",), ("b",), ("z",)], "id string")
    got = {r.id: (r.fact_status_id, r.confidence, r.error, r.new_value) for r in ingest.confirmed(waiting, ids).collect()}
    refused = "not awaiting confirmation"
    assert got == {"a": (1, 1.0, None, '{"fact_status_id":1,"confidence":1.0,"pending_confirmation":false}'), "b": (1, 0.8, refused, None), "z": (None, None, refused, None)}
    assert sorted(r.id for r in ingest.rejected(waiting, ids).collect()) == ["b", "c", "d", "e", "f"]


def test_memory_has_its_anchor(spark):
    from tempograph.operators.prose import refreshed

    old, new = "Now: 2024-02-29T08:00:00Z (Thursday 29 February 2024)", "Now: 2024-03-01T09:00:00Z (Friday 1 March 2024)"
    texts = ["", "Anna is in Rome.", f"{old}\n\nAnna.", old, "Now: 2024-02-29T08:00:00Z (Friday 29 February 2024)\nAnna.", "Now: soon (today)", "Now: then"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(refreshed(F.col("t"), F.lit("2024-03-01 09:00:00").cast("timestamp"))).collect()]
    assert got == [new, f"{new}\n\n{texts[1]}", f"{new}\n\nAnna.", new, *[f"{new}\n\n{t}" for t in texts[4:]]]


def test_dates_as_people_write_them(spark):
    from tempograph.functions.dates import flexible_date

    texts = {"2025-05-03": "2025-05-03 00:00:00", " 2025-5-3 ": "2025-05-03 00:00:00", "2025-02-30": None, "2025-05": "2025-05-01 00:00:00", "2025-13": None, "2025": "2025-01-01 00:00:00", "0999": None, "10000": None, "May 2025": "2025-05-01 00:00:00", "sEPTEMBER 2025": "2025-09-01 00:00:00", "éé 2025": None, "May": None, "2025-05-03T10:00:00+02:00": "2025-05-03 08:00:00", "2025-05-03 10:00:00": "2025-05-03 10:00:00", "": None}
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(flexible_date(F.col("t")).cast("string")).collect()]
    assert got == list(texts.values())
