"""Queries of writes, cascades, recurrence, timed rows and further reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.catalogue import Query, at, on_views
from tempograph.functions import recurrence, text
from tempograph.operators import cascade, graph, reads, writes
from tempograph.plans import sieve
from tempograph.sources import files
from tempograph.streaming import folds

NOW = "1997-03-31 12:00:00"
_T = f"TIMESTAMP '{NOW}'"
_VISIBLE = "NOT pending AND fact_status_id NOT IN (5, 6)"


def _insert(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """The inferred facts of the suppliers come as a batch to the others."""
    supplied = facts.where("predicate = 'supplies'")
    inferred = supplied.where("inferred")
    told = sieve.sieved(sources.select(F.col("fact_id").alias("id"), "source_type_id", "raw_reference"), ["id"], inferred, ["id"])
    batch = inferred.join(told, "id").withColumn("arrival", F.abs(F.xxhash64("id")))
    return writes.insert_batch(supplied.where("not inferred"), sources, batch, ("supplies",)).withColumn("contradicts", F.array_join(F.array_sort("contradicts"), ","))


def _depths(facts: DataFrame) -> DataFrame:
    return facts.select("id", "confidence", "inferred", F.when(F.col("inferred"), 1).otherwise(0).alias("depth"))


def _changed(facts: DataFrame) -> DataFrame:
    return facts.where("predicate = 'located_in' and id like 'c%0'")


_PARENTS = "SELECT child_fact_id AS id, sum(CASE WHEN is_positive THEN c ELSE -c END) AS total, count(*) AS n FROM dependencies JOIN now ON now.id = parent_fact_id GROUP BY child_fact_id"
_DERIVED = "least(greatest(coalesce(total, 0) * CASE WHEN inferred THEN 0.8::DOUBLE ELSE 1 END * CASE coalesce(n, 0) WHEN 0 THEN 0 WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.75 WHEN 3 THEN 0.9 ELSE 1 END, 0), 0.95)"

_BASE = "CAST(trigger_at AS DATE)"
_STEP = {
    "daily": "(date_diff('day', trigger_at, {t}) // step + {k}) * step * INTERVAL 1 DAY",
    "monthly": "(((year({t}) - year(trigger_at)) * 12 + month({t}) - month(trigger_at)) // step + {k}) * step * INTERVAL 1 MONTH",
}


def _next_sql(kind: str) -> str:
    early, late = (f"trigger_at + {_STEP[kind].format(t=_T, k=k)}" for k in (0, 1))
    return f"CASE WHEN {early} < {_T} THEN {late} ELSE {early} END"

_QUOTA = """
WITH RECURSIVE n AS (SELECT key, ts, id, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS k FROM attempts),
f AS (
  SELECT key, ts, id, k, ts AS start, 1 AS used, true AS admitted FROM n WHERE k = 1
  UNION ALL
  SELECT n.key, n.ts, n.id, n.k, CASE WHEN n.ts >= f.start + INTERVAL 1 DAY THEN n.ts ELSE f.start END, CASE WHEN n.ts >= f.start + INTERVAL 1 DAY THEN 1 WHEN f.used < 3 THEN f.used + 1 ELSE f.used END, n.ts >= f.start + INTERVAL 1 DAY OR f.used < 3
  FROM f JOIN n ON n.key = f.key AND n.k = f.k + 1)
SELECT key, ts, id, admitted, start + INTERVAL 1 DAY AS resets_at FROM f"""

_SALIENT = r"""
WITH w AS (SELECT session_id, turn, list_filter(string_split_regex(regexp_replace(content, '[''’][sS]', ' ', 'g'), '[^\p{L}\p{N}]+'), lambda x: len(x) >= 2 AND lower(x) NOT IN ({stop})) AS w FROM messages)
SELECT session_id, turn, array_to_string(list_filter(w, lambda z, i: list_position(list_transform(w, lambda x: lower(x)), lower(z)) = i)[1 : 8], ' ') AS terms FROM w""".replace("{stop}", ", ".join(f"'{w}'" for w in text.STOP_WORDS))


QUERIES: dict[str, Query] = {
    "r10_pending": on_views(
        "facts entities",
        reads.pending,
        "SELECT f.id, s.name AS subject, predicate, coalesce(o.name, object_literal) AS object FROM facts f JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id WHERE pending",
    ),
    "r11_dependency_edges": on_views("dependencies", reads.dependency_edges, "SELECT id AS fact_id, count(*) AS n, count(*) FILTER (WHERE parent) AS children FROM (SELECT parent_fact_id AS id, true AS parent FROM dependencies UNION ALL SELECT child_fact_id, false FROM dependencies) GROUP BY id"),
    "r12_audit_all": on_views(
        "audit",
        lambda a: reads.audit_log(a).select("fact_id", "id", "rank"),
        "SELECT fact_id, id, row_number() OVER (PARTITION BY fact_id ORDER BY changed_at DESC, id DESC) AS rank FROM audit",
    ),
    "r12_audit_log": on_views(
        "audit",
        lambda a: reads.audit_log(a, 5).select("fact_id", "id", "rank"),
        "SELECT fact_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY changed_at DESC, id DESC) AS rank FROM audit) WHERE rank <= 5",
    ),
    "r24_active_events": on_views("overlays", lambda o: o.where((F.col("status") == "active") & F.col("trigger_at").between(at("1997-01-01"), at(NOW))).select("entity_id", "id", "trigger_at"), f"SELECT entity_id, id, trigger_at FROM overlays WHERE status = 'active' AND trigger_at BETWEEN TIMESTAMP '1997-01-01' AND {_T}"),
    "r25_overdue_events": on_views("overlays", lambda o: o.where((F.col("status") == "active") & (F.col("trigger_at") < at(NOW))).groupBy("entity_id").agg(F.count("*").alias("n"), F.min("trigger_at").alias("oldest")), f"SELECT entity_id, count(*) AS n, min(trigger_at) AS oldest FROM overlays WHERE status = 'active' AND trigger_at < {_T} GROUP BY entity_id"),
    "r39_export_order": on_views(
        "messages",
        lambda m: reads.export_order(m).select("session_id", "turn", "place"),
        "SELECT session_id, turn, row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN turn IS NOT DISTINCT FROM first THEN 0 ELSE 1 END, turn) AS place FROM (SELECT *, min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY session_id) AS first FROM messages)",
    ),
    "r40_after_mark": on_views(
        "messages",
        lambda m: reads.after_mark(m, m.where("role = 'system'").groupBy("session_id").agg(F.max("turn").alias("mark"))).select("session_id", "turn"),
        "SELECT session_id, turn FROM messages LEFT JOIN (SELECT session_id, max(turn) AS mark FROM messages WHERE role = 'system' GROUP BY 1) USING (session_id) WHERE mark IS NULL OR turn >= mark",
    ),
    "r44_fact_detail": on_views(
        "facts entities sources dependencies",
        reads.fact_detail,
        """SELECT f.id, s.name AS subject, coalesce(o.name, object_literal, concat('entity:', CAST(object_id AS STRING))) AS object, coalesce(n, 0) AS n_sources, coalesce(p, 0) AS n_parents FROM facts f LEFT JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id
  LEFT JOIN (SELECT fact_id, count(*) AS n FROM sources GROUP BY 1) x ON x.fact_id = f.id LEFT JOIN (SELECT child_fact_id, count(*) AS p FROM dependencies GROUP BY 1) d ON d.child_fact_id = f.id""".replace("AS STRING", "AS VARCHAR"),
    ),
    "n06_profile": on_views(
        "facts categories fact_categories",
        lambda f, c, fc: reads.profile(f, c, fc, 20),
        f"""SELECT subject_id, category, n FROM (SELECT subject_id, category, n, row_number() OVER (PARTITION BY subject_id ORDER BY n DESC, category) AS r FROM (SELECT subject_id, coalesce(name, 'Uncategorized') AS category, count(*) AS n
  FROM facts f LEFT JOIN fact_categories fc ON fc.fact_id = f.id LEFT JOIN categories c ON c.id = category_id WHERE {_VISIBLE} GROUP BY ALL)) WHERE r <= 20""",
    ),
    "a03_top_predicates": on_views("facts", lambda f: f.where("fact_status_id <> 6").groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(10), "SELECT predicate, count(*) AS n FROM facts WHERE fact_status_id <> 6 GROUP BY 1 ORDER BY n DESC, predicate LIMIT 10"),
    "a11_memory_raw": on_views(
        "categories fact_categories",
        reads.fact_weights,
        "SELECT fact_id, string_agg(CAST(category_id AS VARCHAR), ',' ORDER BY CAST(category_id AS VARCHAR)) AS categories, max(memory_weight) AS weight, min(memory_bucket_id) AS bucket FROM fact_categories JOIN categories c ON c.id = category_id GROUP BY fact_id",
    ),
    "a14_source_counts": on_views("sources", lambda s: s.groupBy("source_type_id").agg(F.count("*").alias("n"), F.count_distinct("fact_id").alias("facts")), "SELECT source_type_id, count(*) AS n, count(DISTINCT fact_id) AS facts FROM sources GROUP BY 1"),
    "j08_semantic_candidates": on_views(
        "facts",
        lambda f: reads.same_ends(f, 50),
        """SELECT subject_id, object_id, predicates FROM (SELECT subject_id, object_id, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates, count(DISTINCT predicate) AS n FROM facts WHERE fact_status_id IN (1, 2) AND object_id IS NOT NULL GROUP BY 1, 2)
  WHERE n > 1 ORDER BY subject_id, object_id LIMIT 50""",
    ),
    "j10_alias_overlap": on_views("aliases", lambda a: a.groupBy(F.lower("alias").alias("key")).agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("first")).where("n > 1"), "SELECT lower(alias) AS key, count(DISTINCT entity_id) AS n, min(entity_id) AS first FROM aliases GROUP BY 1 HAVING count(DISTINCT entity_id) > 1"),
    "j18_by_source": on_views("facts sources", lambda f, s: f.join(s.where("source_type_id = 5").select(F.col("fact_id").alias("id")), "id", "left_semi").select("id", "subject_id"), "SELECT id, subject_id FROM facts WHERE id IN (SELECT fact_id FROM sources WHERE source_type_id = 5)"),
    "g03_descendants": on_views("hierarchy", lambda h: graph.closure(h).where("node <> ancestor").groupBy("ancestor").agg(F.count("*").alias("n")), "WITH RECURSIVE up(node, ancestor) AS (SELECT child, parent FROM hierarchy UNION SELECT node, parent FROM up JOIN hierarchy ON child = ancestor) SELECT ancestor, count(*) AS n FROM up GROUP BY 1"),
    "g06_category_subtree": on_views(
        "categories fact_categories",
        reads.subtree_counts,
        "SELECT root AS category_id, count(DISTINCT fact_id) AS n FROM (SELECT id AS root, id FROM categories UNION SELECT parent_id, id FROM categories WHERE parent_id IS NOT NULL) t JOIN fact_categories ON category_id = t.id GROUP BY root",
    ),
    "g10_category_level": on_views("categories fact_categories", reads.children_counts, "SELECT p.id AS parent_id, c.id, c.name, count(fact_id) AS n FROM categories p JOIN categories c ON c.parent_id = p.id LEFT JOIN fact_categories ON category_id = c.id GROUP BY ALL"),
    "g07_confidence_cascade": on_views(
        "facts dependencies",
        lambda f, d: cascade.cascade(_depths(f), d, _changed(f).select("id", (F.col("confidence") / 2).alias("confidence"))).withColumn("confidence", F.round("confidence", 6)),
        f"""WITH moved AS (SELECT id, confidence / 2 AS c FROM facts WHERE predicate = 'located_in' AND id LIKE 'c%0'), now AS (SELECT f.id, coalesce(c, confidence) AS c FROM facts f LEFT JOIN moved m ON m.id = f.id), p AS ({_PARENTS}),
t AS (SELECT f.id, confidence, {_DERIVED} AS c FROM facts f JOIN p ON p.id = f.id WHERE f.id IN (SELECT child_fact_id FROM dependencies JOIN moved ON moved.id = parent_fact_id))
SELECT id, round(c, 6) AS confidence FROM moved UNION ALL SELECT id, round(c, 6) FROM t WHERE abs(c - confidence) > 0.001""",
    ),
    "g09_forget_cascade": on_views(
        "facts dependencies",
        lambda f, d: cascade.forget(_depths(f), d, _changed(f)).select("id", "change"),
        """WITH chosen AS (SELECT id FROM facts WHERE predicate = 'located_in' AND id LIKE 'c%0') SELECT id, 'forgotten' AS change FROM chosen
UNION ALL SELECT child_fact_id, CASE WHEN inferred THEN 'forgotten' ELSE 'disputed' END FROM dependencies JOIN chosen ON chosen.id = parent_fact_id JOIN facts f ON f.id = child_fact_id""",
    ),
    "i02_insert_batch": on_views("facts sources", _insert, None),
    "i07_patch_audit": on_views(
        "facts",
        lambda f: writes.audit_of_patch(f, f.where("predicate = 'has_order'").select("id", F.lit(1).alias("fact_status_id"), F.when(F.col("pending"), False).alias("pending")), ["fact_status_id", "pending"]),
        "SELECT id AS fact_id, 'fact_status_id' AS field, CAST(fact_status_id AS VARCHAR) AS old_value, '1' AS new_value FROM facts WHERE predicate = 'has_order' AND fact_status_id <> 1 UNION ALL SELECT id, 'pending', 'true', 'false' FROM facts WHERE predicate = 'has_order' AND pending",
    ),
    "i11_expired_pending": on_views("facts", lambda f: writes.expired_pending(f, at(NOW), 30).select("id"), f"SELECT id FROM facts WHERE pending AND valid_from < {_T} - INTERVAL 30 DAY"),
    "i13_preference_lookup": on_views(
        "preferences contexts",
        lambda p, c: writes.preferences_in(p, c, [("place", "2"), ("hour", "3")]).select("entity_id", "key", "id", "matches"),
        """SELECT entity_id, key, id, matches FROM (SELECT p.*, coalesce(m, 0) AS matches, row_number() OVER (PARTITION BY entity_id, key ORDER BY coalesce(m, 0) DESC, CASE WHEN coalesce(m, 0) = 0 THEN coalesce(s, 0) ELSE 0 END, confidence DESC, updated_at DESC, id) AS r FROM preferences p
  LEFT JOIN (SELECT preference_id, count(*) AS s, count(*) FILTER (WHERE (context_key = 'place' AND context_value = '2') OR (context_key = 'hour' AND context_value = '3')) AS m FROM contexts GROUP BY 1) c ON c.preference_id = p.id) WHERE r = 1""",
    ),
    "i17_event_scan": on_views(
        "overlays facts",
        lambda o, f: writes.event_changes(o, f, at(NOW)).select("id", "change"),
        f"""SELECT * FROM (SELECT o.id, CASE WHEN fact_status_id IN (5, 6) THEN 'retire' WHEN trigger_at < {_T} AND recurrence <> 'none' THEN 'advance' WHEN trigger_at < {_T} AND auto_complete THEN 'complete' END AS change
  FROM overlays o JOIN facts f ON f.id = o.fact_id WHERE status = 'active') WHERE change IS NOT NULL""",
    ),
    "i19_merge_entities": on_views(
        "facts entities",
        lambda f, e: writes.merged_entities(f, e.where("entity_type_id = 1 and id div 16 % 2 = 0").select(F.col("id").alias("first"), (F.col("id") + 16).alias("second"))).groupBy("subject_id", "predicate").agg(F.count("*").alias("n")),
        """WITH pairs AS (SELECT id AS a, id + 16 AS b FROM entities WHERE entity_type_id = 1 AND id // 16 % 2 = 0), k AS (SELECT subject_id AS e, count(*) AS n FROM facts GROUP BY 1),
m AS (SELECT CASE WHEN coalesce(x.n, 0) >= coalesce(y.n, 0) THEN b ELSE a END AS gone, CASE WHEN coalesce(x.n, 0) >= coalesce(y.n, 0) THEN a ELSE b END AS kept FROM pairs LEFT JOIN k x ON x.e = a LEFT JOIN k y ON y.e = b)
SELECT coalesce(kept, subject_id) AS subject_id, predicate, count(*) AS n FROM facts LEFT JOIN m ON gone = subject_id GROUP BY 1, 2""",
    ),
    "i22_trash_restore": on_views(
        "facts",
        lambda f: writes.restored(writes.trash(f, F.col("confidence") < 0.4, at(NOW))),
        "SELECT id, subject_id, predicate, object_id, object_literal, confidence, fact_status_id FROM facts WHERE confidence < 0.4::DOUBLE AND fact_status_id <> 6",
    ),
    "i23_forget_source": on_views("sources", lambda s: writes.without_sources(s, F.col("source_type_id") == 2), "SELECT fact_id, count(*) AS n FROM sources GROUP BY 1 HAVING count(*) = count(*) FILTER (WHERE source_type_id = 2)"),
    "d01_next_occurrence": on_views(
        "overlays",
        lambda o: o.select("id", recurrence.next_occurrence(F.col("trigger_at"), F.col("recurrence"), F.col("step"), at(NOW)).alias("next")),
        f"""SELECT id, CASE recurrence WHEN 'none' THEN trigger_at
  WHEN 'daily' THEN CASE WHEN {_BASE} > CAST({_T} AS DATE) THEN trigger_at ELSE {_next_sql('daily')} END
  WHEN 'monthly' THEN CASE WHEN (year({_T}) - year(trigger_at)) * 12 + month({_T}) - month(trigger_at) < 0 THEN trigger_at ELSE {_next_sql('monthly')} END
  WHEN 'weekly' THEN CASE WHEN {_BASE} > CAST({_T} AS DATE) THEN trigger_at ELSE (SELECT min(trigger_at + k * 7 * step * INTERVAL 1 DAY) FROM range(0, 1000) r(k) WHERE trigger_at + k * 7 * step * INTERVAL 1 DAY >= {_T}) END
  ELSE CASE WHEN year(trigger_at) > year({_T}) THEN trigger_at ELSE (SELECT min(c) FROM (SELECT trigger_at + k * step * INTERVAL 1 YEAR + CASE WHEN month(trigger_at) = 2 AND day(trigger_at) = 29 AND day(trigger_at + k * step * INTERVAL 1 YEAR) = 28 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS c FROM range(0, 30) r(k)) WHERE c >= {_T}) END END AS next FROM overlays""",
    ),
    "t05_breaker": on_views(
        "attempts",
        lambda a: folds.failures(a, "key", "ts", "id", F.col("failed"), 2.0, 60.0, 3).select("id", "in_a_row", "backoff_s", "open"),
        """SELECT id, CAST(n AS BIGINT) AS in_a_row, CASE WHEN n > 0 THEN least(2.0 * pow(2.0, n - 1), 60.0) ELSE 0 END::DOUBLE AS backoff_s, n >= 3 AS open FROM (
  SELECT id, sum(CAST(failed AS INT)) OVER (PARTITION BY key, run ORDER BY ts, id) AS n FROM (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ts, id) AS run FROM attempts))""",
    ),
    "t07_debounce": on_views("attempts", lambda a: folds.debounced(a, "key", "ts", "id", 3600).select("id"), "SELECT id FROM (SELECT id, ts - lag(ts) OVER (PARTITION BY key ORDER BY ts, id) AS gap FROM attempts) WHERE gap IS NULL OR gap >= INTERVAL 1 HOUR"),
    "t08_idle": on_views(
        "attempts",
        lambda a: folds.idle(a, "key", "ts", "id", F.col("active"), 7200).select("id"),
        "SELECT id FROM (SELECT *, max(CASE WHEN active THEN ts END) OVER (PARTITION BY key ORDER BY ts, id) AS last FROM attempts) WHERE NOT active AND (last IS NULL OR ts - last >= INTERVAL 2 HOUR)",
    ),
    "t10_quota": on_views("attempts", lambda a: folds.quota(a.select("key", "ts", "id"), "key", "ts", 3, 86400), _QUOTA),
    "t11_rate_limit": on_views(
        "attempts",
        lambda a: folds.rate_limited(a, "key", "ts", "id", 86400.0, 2).select("id", F.round("wait_s", 3).alias("wait_s")),
        """SELECT id, round(greatest(coalesce(lag(m) OVER (PARTITION BY key ORDER BY ts, id) + (n - 1) * 86400, t) - 86400 - t, 0), 3) AS wait_s FROM (
  SELECT *, max(t - (n - 1) * 86400) OVER (PARTITION BY key ORDER BY n) AS m FROM (SELECT id, key, ts, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n FROM attempts))""",
    ),
    "t15_ledger": on_views("attempts", lambda a: folds.newest(a.where("failed"), "key", "ts", "id", 3).select("key", "id"), "SELECT key, id FROM (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY ts DESC, id DESC) AS r FROM attempts WHERE failed) WHERE r <= 3"),
    "x04_place_label": on_views("locations", lambda p: p.select("entity_id", text.place_label(F.col("latitude"), F.col("longitude")).alias("label")), "SELECT entity_id, printf('%.3f, %.3f', round(latitude * 1000) / 1000, round(longitude * 1000) / 1000) AS label FROM locations"),
    "f10_salient": on_views("messages", lambda m: m.select("session_id", "turn", F.array_join(text.salient(text.without_possessives(F.col("content"))), " ").alias("terms")), _SALIENT),
    "c15_notes": on_views("facts entities", files.notes, None),
}
