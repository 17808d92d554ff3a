"""Writes, cascades, recurrence and timed rows against scenarios and plain versions."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

FACTS = "id string, subject_id long, predicate string, object_id long, object_literal string, valid_from timestamp, valid_until timestamp, confidence double, fact_status_id int, pending boolean, inferred boolean"
BATCH = FACTS + ", arrival long, source_type_id int, raw_reference string"
SOURCES = "fact_id string, source_type_id int, raw_reference string"


def day(n):
    return None if n is None else dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def fact(id, obj, since, until, predicate="lives_in", status=1, confidence=0.5, pending=False):
    return (id, 1, predicate, obj, None, day(since), day(until), confidence, status, pending, False)


def inserted(spark, facts, sources, batch):
    from tempograph.operators.writes import insert_batch

    out = insert_batch(spark.createDataFrame(facts, FACTS), spark.createDataFrame(sources, SOURCES), spark.createDataFrame(batch, BATCH)).collect()
    assert len({r.id for r in out}) == len(out)
    return {r.id: r for r in out}


def test_an_explicit_fact_supersedes_and_closes_the_sole_open_one(spark):
    got = inserted(spark, [fact("a", 10, 0, None)], [("a", 2, "x")], [fact("b", 11, 5, None) + (1, 1, "u")])
    assert (got["a"].fact_status_id, got["a"].valid_until, got["b"].fact_status_id) == (5, day(5), 1)


def test_other_facts_dispute_each_other(spark):
    got = inserted(spark, [fact("a", 10, 0, 9), fact("z", 10, 20, 30)], [("a", 2, "x")], [fact("b", 11, 5, None) + (1, 2, "y")])
    assert (got["a"].fact_status_id, got["z"].fact_status_id, got["b"].fact_status_id, sorted(got["b"].contradicts)) == (3, 3, 3, ["a", "z"])


def test_the_same_claim_corroborates_once_for_each_source(spark):
    batch = [fact("b", 10, 5, None) + (1, 2, "y"), fact("c", 10, 5, None) + (2, 2, "y"), fact("d", 10, 6, 7) + (3, 2, "x")]
    got = inserted(spark, [fact("a", 10, 0, 9)], [("a", 2, "x")], batch)
    assert set(got) == {"a"} and got["a"].added_sources == 1 and got["a"].confidence == pytest.approx(0.55)


def test_several_objects_and_empty_windows_do_not_conflict(spark):
    got = inserted(spark, [fact("a", 10, 0, 9, "hobby")], [], [fact("b", 11, 5, None, "hobby") + (1, 2, "y"), fact("c", 10, 3, 3, "hobby") + (2, 2, None)])
    assert {k: r.fact_status_id for k, r in got.items()} == {"a": 1, "b": 1, "c": 1}
    assert inserted(spark, [], [], [fact("b", 11, None, None) + (1, 2, None)])["b"].fact_status_id == 1
    assert inserted(spark, [fact("a", 1, 0, 1)], [], []) == {}


def test_stretches_change_nothing(spark):
    """Random facts inserted stretch by stretch and in one group give the same."""
    from tempograph.operators.writes import _settle

    r = random.Random(3)
    span = lambda: (s := r.choice([None, *range(60)]), None if r.random() < 0.1 else (s or 0) + r.randint(0, 6))
    old = [fact(f"o{k:02}", r.randint(1, 3), *span(), status=r.choice([1, 1, 2, 3, 5, 6])) for k in range(25)]
    old = [f for f in old if f[5] is not None and f[6] is not None]
    sources = [(f[0], r.choice([1, 2, 5]), r.choice("xy")) for f in old]
    new = [fact(f"n{k:02}", r.randint(1, 3), *span()) + (k, r.choice([1, 2, 2, 2, 5]), r.choice("xyz")) for k in range(25)]
    got = inserted(spark, old, sources, new)
    names = [c.split()[0] for c in FACTS.split(", ")]
    rows = [dict(zip(names, f)) | {"arrival": None, "provenance": [f"{t}:{x}" for i, t, x in sources if i == f[0]]} for f in old]
    rows += [dict(zip(names, f)) | {"arrival": f[11], "provenance": [f"{f[12]}:{f[13]}"]} for f in new]
    columns = ["id", "fact_status_id", "confidence", "valid_until", "added_sources", "contradicts"]
    want = [dict(zip(columns, (x[0], *x[2:]))) for x in _settle(rows)]
    before = {f[0]: (f[8], f[7], f[6]) for f in old}
    for w in want:
        if w["id"] in got:
            g = got[w["id"]]
            assert (g.fact_status_id, round(g.confidence, 9), g.valid_until, g.added_sources, sorted(g.contradicts)) == (w["fact_status_id"], round(w["confidence"], 9), w["valid_until"], w["added_sources"], sorted(w["contradicts"]))
        else:
            assert (w["fact_status_id"], w["confidence"], w["valid_until"]) == before[w["id"]]
    assert set(got) <= {w["id"] for w in want}


def test_cascade_goes_down_a_diamond_and_ends_on_a_cycle(spark):
    from tempograph.operators.cascade import cascade, forget

    facts = spark.createDataFrame([("a", 0.9, 0, False), ("b", 0.432, 1, True), ("c", 0.432, 1, True), ("d", 0.4, 2, True), ("e", 0.2, 1, True)], "id string, confidence double, depth int, inferred boolean")
    edges = spark.createDataFrame([("a", "b", True), ("a", "c", True), ("b", "d", True), ("c", "d", True), ("d", "e", True), ("e", "d", True)], "parent_fact_id string, child_fact_id string, is_positive boolean")
    got = {r.id: r.confidence for r in cascade(facts, edges.where("child_fact_id <> 'e' and parent_fact_id <> 'e'"), spark.createDataFrame([("a", 0.5)], "id string, confidence double")).collect()}
    one = 0.5 * 0.8 * 0.6
    assert got == pytest.approx({"a": 0.5, "b": one, "c": one, "d": 2 * one * 0.64 * 0.75})
    assert set(cascade(facts, edges, spark.createDataFrame([("a", 0.5)], "id string, confidence double")).toPandas()["id"]) == {"a", "b", "c", "d", "e"}
    gone = {r.id: r.change for r in forget(facts, edges.where("parent_fact_id <> 'e'"), spark.createDataFrame([("a",)], "id string")).collect()}
    assert gone == dict.fromkeys("abcde", "forgotten")
    part = {r.id: r.change for r in forget(facts, edges.where("parent_fact_id <> 'e'"), spark.createDataFrame([("b",)], "id string")).collect()}
    assert part == {"b": "forgotten", "d": "disputed"}


def test_quota_windows_open_at_the_first_use(spark):
    from tempograph.streaming.folds import quota

    r = random.Random(1)
    rows = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=r.randint(0, 500)), i) for i, k in enumerate(r.choices("abc", k=200))]
    got = {x.id: x.admitted for x in quota(spark.createDataFrame(rows, "key string, at timestamp, id long"), "key", "at", 2, 60).collect()}
    state, want = {}, {}
    for k, t, i in sorted(rows):
        start, n = state.get(k, (t, 0))
        if t >= start + dt.timedelta(seconds=60):
            start, n = t, 0
        want[i] = n < 2
        state[k] = (start, n + want[i])
    assert got == want and quota(spark.createDataFrame([], "key string, at timestamp, id long"), "key", "at", 2, 60).count() == 0


@pytest.mark.parametrize(
    "kind, base, step, now, want",
    [
        ("yearly", "2024-02-29 08:00:00", 1, "2024-03-01 00:00:00", "2025-03-01 08:00:00"),
        ("yearly", "2024-02-29 08:00:00", 4, "2024-03-01 00:00:00", "2028-02-29 08:00:00"),
        ("monthly", "2024-01-31 09:00:00", 1, "2024-02-01 00:00:00", "2024-02-29 09:00:00"),
        ("weekly", "2024-01-01 09:00:00", 2, "2024-01-08 08:00:00", "2024-01-15 09:00:00"),
        ("daily", "2024-01-01 09:00:00", 3, "2024-01-04 10:00:00", "2024-01-07 09:00:00"),
        ("daily", "2024-05-01 09:00:00", 3, "2024-01-04 10:00:00", "2024-05-01 09:00:00"),
        ("none", "2024-01-01 09:00:00", 1, "2025-01-01 00:00:00", "2024-01-01 09:00:00"),
    ],
)
def test_next_occurrence(spark, kind, base, step, now, want):
    from tempograph.functions.recurrence import next_occurrence

    t = lambda s: F.lit(s).cast("timestamp")
    row = spark.range(1).select(next_occurrence(t(base), F.lit(kind), F.lit(step), t(now)).cast("string").alias("a"), next_occurrence(t(base), F.lit(kind), F.lit(step), t(now), t("1990-01-01")).alias("b")).first()
    assert row.a == want and row.b is None


def test_weekdays_rules_and_nth_days(spark):
    from tempograph.functions.recurrence import next_weekday_of, nth_weekday, rule_end

    t = lambda s: F.lit(s).cast("timestamp")
    days = F.array(F.lit(0), F.lit(2))
    ask = lambda now: next_weekday_of(t("2024-01-03 09:00:00"), F.lit(2), t(now), days).cast("string")
    row = spark.range(1).select(
        ask("2024-01-03 10:00:00").alias("a"), ask("2024-01-03 08:00:00").alias("b"), ask("2024-01-16 00:00:00").alias("c"),
        nth_weekday(F.lit("2024-02-10").cast("date"), 3, 5).cast("string").alias("d"), nth_weekday(F.lit("2024-02-10").cast("date"), 0, 5).alias("e"), nth_weekday(F.lit("2024-02-10").cast("date"), 4, -1).cast("string").alias("f"),
        rule_end(t("2024-01-31 09:00:00"), F.lit("RRULE:FREQ=MONTHLY;COUNT=2")).cast("string").alias("g"), rule_end(t("2024-01-31 09:00:00"), F.lit("FREQ=DAILY;UNTIL=20240301T120000Z")).cast("string").alias("h"), rule_end(t("2024-01-31 09:00:00"), F.lit("FREQ=DAILY")).alias("i"),
    ).first()
    assert tuple(row) == ("2024-01-15 09:00:00", "2024-01-03 09:00:00", "2024-01-17 09:00:00", "2024-02-29", None, "2024-02-23", "2024-02-29 09:00:00", "2024-03-01 12:00:00", None)


def test_sync_applies_tombstones_and_absorbs_replays(spark, tmp_path):
    from tempograph.streaming.cycle import sync

    columns, source = "id string, value string, seq long", tmp_path / "in"
    schema = "id string, value string, seq long, deleted boolean"
    for k, rows in enumerate([[("a", "1", 1, False), ("b", "1", 2, False)], [("a", "2", 3, False), ("b", None, 4, True), ("a", "1", 1, False)], [("c", "1", 5, False), ("a", "1", 1, False)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        sync(stream, str(tmp_path / "out"), str(tmp_path / "state"), ["id"], columns).awaitTermination(120)
    got = spark.read.schema(columns).parquet(str(tmp_path / "out" / "v=2"))
    assert sorted(map(tuple, got.collect())) == [("a", "2", 3), ("c", "1", 5)]


def test_quota_over_a_stream(spark, tmp_path):
    from tempograph.streaming.cycle import quota_stream

    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    schema, names = "key string, at timestamp", []
    for rows in ([("a", at(0)), ("a", at(1)), ("b", at(5))], [("a", at(2)), ("a", at(70)), ("b", at(6))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = quota_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 2, 60)
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("key", "at").collect()
    assert [(r.key, r.admitted) for r in got] == [("a", True), ("a", True), ("a", False), ("a", True), ("b", True), ("b", True)]
