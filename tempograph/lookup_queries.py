"""Queries of lookups, short rules, duplicate classes and traversal with a bound."""

from __future__ import annotations

from pyspark.sql import functions as F

from tempograph.catalogue import Query, at, on_views
from tempograph.functions import render
from tempograph.operators import graph, joins, lookups, memory, reads, writes

NOW = "1997-03-31 12:00:00"
_T = f"TIMESTAMP '{NOW}'"
_VISIBLE = "NOT pending AND fact_status_id NOT IN (5, 6)"
_TRIPLE = "subject_id, predicate, object_id, object_literal"
_SINCE, _UNTIL = "coalesce(valid_from, TIMESTAMP '0001-01-01')", "coalesce(valid_until, TIMESTAMP '9999-01-01')"

_SNIPPETS = r"""
WITH w AS (SELECT session_id, turn, string_split_regex(content, '\s+') AS w FROM messages),
p AS (SELECT *, list_position(list_transform(w, lambda x: regexp_replace(lower(x), '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')), 'the') AS k FROM w),
f AS (SELECT *, greatest(k - 3, 1) AS first FROM p WHERE k > 0)
SELECT session_id, turn, concat(CASE WHEN first > 1 THEN '... ' ELSE '' END, array_to_string(list_transform(w[first : k + 3], lambda x, i: CASE WHEN i = k - first + 1 THEN concat('<<<', x, '>>>') ELSE x END), ' '), CASE WHEN len(w) > k + 3 THEN ' ...' ELSE '' END) AS snippet FROM f"""


QUERIES: dict[str, Query] = {
    "r01_by_id": on_views("facts", lambda f: lookups.by_ids(f, f.where("predicate = 'located_in'").select("id")).select("id", "subject_id", "predicate", "object_id", "confidence"), "SELECT id, subject_id, predicate, object_id, confidence FROM facts WHERE id IN (SELECT id FROM facts WHERE predicate = 'located_in')"),
    "r05_subject_predicate": on_views("facts", lambda f: reads.top_per(f, ["subject_id", "predicate"], [F.col("id")], None).select("subject_id", "predicate", "id", "rank"), "SELECT subject_id, predicate, id, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY id) AS rank FROM facts"),
    "r07_active_in_order": on_views(
        "facts",
        lambda f: lookups.active_in_order(f, at("1995-06-15")).select("subject_id", "predicate", "id", "rank"),
        "SELECT subject_id, predicate, id, row_number() OVER (PARTITION BY subject_id, predicate ORDER BY valid_from NULLS FIRST, id) AS rank FROM facts WHERE fact_status_id = 1 AND (valid_from IS NULL OR valid_from <= TIMESTAMP '1995-06-15') AND (valid_until IS NULL OR valid_until > TIMESTAMP '1995-06-15')",
    ),
    "r08_page_of_predicate": on_views(
        "facts",
        lambda f: lookups.paged(f.where(f"{_VISIBLE} and confidence >= 0.5").where(lookups.optional("predicate", "has_order")), "subject_id", [F.col("confidence").desc(), F.col("valid_from").desc_nulls_last(), F.col("id").desc()], 2, 3).select("subject_id", "id", "rank"),
        f"SELECT subject_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, valid_from DESC NULLS LAST, id DESC) AS rank FROM facts WHERE {_VISIBLE} AND confidence >= 0.5 AND predicate = 'has_order') WHERE rank > 2 AND rank <= 5",
    ),
    "r09_count_of_predicate": on_views("facts", lambda f: reads.fact_counts(f.where(lookups.optional("predicate", "supplies")), 0.95), f"SELECT subject_id, count(*) AS n FROM facts WHERE {_VISIBLE} AND predicate = 'supplies' AND confidence >= 0.95::DOUBLE GROUP BY 1"),
    "r10_pending_oldest": on_views("facts", lambda f: reads.ranked_in_parts(f.where("pending").select("predicate", "id", "valid_from"), "predicate", [F.col("valid_from").asc_nulls_first(), F.col("id")]).select("predicate", "id", "rank"), "SELECT predicate, id, row_number() OVER (PARTITION BY predicate ORDER BY valid_from NULLS FIRST, id) AS rank FROM facts WHERE pending"),
    "r11_edges": on_views("dependencies", lambda d: d.select(F.explode(F.array("parent_fact_id", "child_fact_id")).alias("fact_id"), "parent_fact_id", "child_fact_id", "is_positive"), "SELECT parent_fact_id AS fact_id, * FROM dependencies UNION ALL SELECT child_fact_id, * FROM dependencies"),
    "r13_audit_page": on_views(
        "audit",
        lambda a: lookups.paged(a.where("change_type = 'error'"), "fact_id", [F.col("changed_at"), F.col("id")], 1, 2).select("fact_id", "id", "rank"),
        "SELECT fact_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY changed_at, id) AS rank FROM audit WHERE change_type = 'error') WHERE rank IN (2, 3)",
    ),
    "r14_sources": on_views(
        "sources",
        lambda s: lookups.sources_of(s).select("fact_id", F.explode("sources").alias("s")).select("fact_id", "s.*"),
        "SELECT fact_id, source_type_id, raw_reference FROM sources",
    ),
    "n01_sources_nested": on_views(
        "facts sources",
        lambda f, s: f.select(F.col("id").alias("fact_id")).join(lookups.sources_of(s), "fact_id", "left").select("fact_id", F.coalesce(F.size("sources"), F.lit(0)).alias("n"), F.array_join(F.transform("sources", lambda x: F.concat_ws(":", x["source_type_id"].cast("string"), x["raw_reference"])), ",").alias("listed")),
        "SELECT f.id AS fact_id, CAST(coalesce(n, 0) AS INT) AS n, listed FROM facts f LEFT JOIN (SELECT fact_id, count(*) AS n, string_agg(concat(source_type_id, ':', raw_reference), ',' ORDER BY source_type_id, raw_reference) AS listed FROM sources GROUP BY 1) s ON s.fact_id = f.id",
    ),
    "r15_by_name": on_views("entities", lambda e: lookups.named(e, e.where("entity_type_id = 2").select(F.upper("name").alias("asked"))), "SELECT DISTINCT upper(a.name) AS asked, b.id FROM entities a JOIN entities b ON lower(a.name) = lower(b.name) WHERE a.entity_type_id = 2"),
    "r16_names": on_views("facts entities", lambda f, e: lookups.by_ids(e, f.where("predicate = 'visited'").select(F.col("object_id").alias("id"))).select("id", "name"), "SELECT id, name FROM entities WHERE id IN (SELECT object_id FROM facts WHERE predicate = 'visited')"),
    "r17_category_levels": on_views("categories", lookups.level, "SELECT parent_id, id, name, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS place FROM categories"),
    "r18_categories_of_fact": on_views("fact_categories categories", lookups.categories_of, "SELECT fact_id, category_id, name FROM fact_categories JOIN categories ON categories.id = category_id"),
    "r19_alias_resolve": on_views("aliases", lambda a: lookups.resolved_aliases(a.select(F.concat(F.lit(" "), F.upper("alias")).alias("asked")), a), "SELECT DISTINCT concat(' ', upper(a.alias)) AS asked, b.entity_id FROM (SELECT DISTINCT alias FROM aliases) a JOIN (SELECT DISTINCT * FROM aliases) b ON replace(lower(trim(a.alias)), ' ', '_') = replace(lower(trim(b.alias)), ' ', '_')"),
    "r23_events_of_entity": on_views("overlays", lookups.events_of, "SELECT entity_id, id, fact_id, row_number() OVER (PARTITION BY entity_id ORDER BY trigger_at, id) AS rank FROM overlays"),
    "r28_locations": on_views("locations entities", lambda p, e: p.join(e.select(F.col("id").alias("entity_id"), "name"), "entity_id").select("entity_id", "name", "latitude", "longitude"), "SELECT entity_id, name, latitude, longitude FROM locations JOIN entities ON entities.id = entity_id"),
    "r29_preference_contexts": on_views("preferences contexts", lookups.with_contexts, "SELECT p.id, entity_id, key, coalesce(listed, '') AS contexts FROM preferences p LEFT JOIN (SELECT preference_id, string_agg(concat(context_key, '=', context_value), ',' ORDER BY concat(context_key, '=', context_value)) AS listed FROM contexts GROUP BY 1) c ON c.preference_id = p.id"),
    "r32_trash_list": on_views(
        "facts entities",
        lambda f, e: lookups.trash_list(writes.trash(f, F.col("confidence") < 0.4, at(NOW)), e).select("fact_id", "subject", "predicate", "object"),
        "SELECT f.id AS fact_id, coalesce(s.name, concat('entity:', subject_id)) AS subject, predicate, coalesce(o.name, object_literal) AS object FROM facts f LEFT JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id WHERE confidence < 0.4::DOUBLE AND fact_status_id <> 6",
    ),
    "r41_last_turn": on_views("messages", lambda m: lookups.last_turns(m.select("session_id").distinct(), m.where("role = 'system'")), "SELECT s.session_id, coalesce(max(m.turn), 0) AS last_turn FROM (SELECT DISTINCT session_id FROM messages) s LEFT JOIN messages m ON m.session_id = s.session_id AND m.role = 'system' GROUP BY 1"),
    "r42_last_runs": on_views("attempts", lookups.last_runs, "SELECT key, count(*) AS n, arg_max(id, (ts, id)) AS id, arg_max(failed, (ts, id)) AS failed FROM attempts GROUP BY key"),
    "r47_predicate_parents": on_views("hierarchy", lookups.parents_of, "SELECT n AS predicate, coalesce(string_agg(parent, ',' ORDER BY parent), '') AS parents FROM (SELECT child AS n FROM hierarchy UNION SELECT parent FROM hierarchy) x LEFT JOIN hierarchy ON child = n GROUP BY n"),
    "n04_status_names": on_views("facts", lambda f: f.select("id", render.wire_name(F.when(F.col("fact_status_id") == 3, 9).otherwise(F.col("fact_status_id")), render.STATUS_NAMES).alias("status")), "SELECT id, CASE fact_status_id WHEN 1 THEN 'Active' WHEN 2 THEN 'Inferred' WHEN 4 THEN 'Corrected' WHEN 5 THEN 'Superseded' WHEN 6 THEN 'Forgotten' ELSE 'Unknown' END AS status FROM facts"),
    "p03_closed": on_views("facts", lambda f: f.where(render.active_at_closed(at("1995-06-15"))).select("id"), "SELECT id FROM facts WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1995-06-15') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1995-06-15')"),
    "p06_closed_overlap": on_views("facts", lambda f: f.where(render.overlaps_closed(F.col("valid_from"), F.col("valid_until"), at("1995-06-15"), at("1995-06-20"))).select("id"), "SELECT id FROM facts WHERE (valid_from IS NULL OR valid_from <= TIMESTAMP '1995-06-20') AND (valid_until IS NULL OR valid_until >= TIMESTAMP '1995-06-15')"),
    "p11_like": on_views("facts", lambda f: f.where(F.col("predicate").like("reject_%")).groupBy("subject_id").agg(F.count("*").alias("n")), "SELECT subject_id, count(*) AS n FROM facts WHERE predicate LIKE 'reject_%' GROUP BY 1"),
    "p18_box": on_views("locations", lambda p: lookups.in_box(p, -10.0, 50.5, -20.0, 120.0).select("entity_id"), "SELECT entity_id FROM locations WHERE latitude BETWEEN -10 AND 50.5 AND longitude BETWEEN -20 AND 120"),
    "j05_not_evaluated": on_views(
        "facts",
        lambda f: joins.not_evaluated(f.where("predicate = 'visited'").select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).distinct(), f.where("predicate = 'visited' and inferred").select(F.col("object_id").alias("a"), F.col("subject_id").alias("b"))),
        "SELECT DISTINCT subject_id AS a, object_id AS b FROM facts f WHERE predicate = 'visited' AND NOT EXISTS (SELECT 1 FROM facts g WHERE g.predicate = 'visited' AND g.inferred AND g.subject_id = f.subject_id AND g.object_id = f.object_id)",
    ),
    "j07_dup_classes": on_views(
        "facts",
        joins.duplicate_classes,
        f"""WITH r AS (SELECT *, {_SINCE} AS s, {_UNTIL} AS e FROM facts WHERE fact_status_id IN (1, 2) AND {_SINCE} < {_UNTIL}),
i AS (SELECT *, max(e) OVER (PARTITION BY {_TRIPLE} ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY {_TRIPLE} ORDER BY s, id ROWS UNBOUNDED PRECEDING) AS island FROM i),
c AS (SELECT *, min(id) OVER (PARTITION BY {_TRIPLE}, island) AS class_id FROM g),
n AS (SELECT a.id, count(*) AS n FROM c a JOIN c b ON a.class_id = b.class_id AND a.id <> b.id AND a.s < b.e AND b.s < a.e GROUP BY a.id)
SELECT c.id, class_id, n AS n_links FROM c JOIN n ON n.id = c.id""",
    ),
    "j09_members": on_views("entities", lambda e: joins.sharing(e, F.lower("name"), "id"), "SELECT key, id AS member, class_id, n FROM (SELECT lower(name) AS key, id, min(id) OVER (PARTITION BY lower(name)) AS class_id, count(*) OVER (PARTITION BY lower(name)) AS n FROM entities) WHERE n > 1"),
    "j10_members": on_views("aliases", lambda a: joins.sharing(a, F.lower("alias"), "entity_id"), "SELECT key, entity_id AS member, class_id, n FROM (SELECT *, min(entity_id) OVER (PARTITION BY key) AS class_id, count(*) OVER (PARTITION BY key) AS n FROM (SELECT DISTINCT lower(alias) AS key, entity_id FROM aliases)) WHERE n > 1"),
    "j11_names_within": on_views("entities", joins.names_within, "SELECT a.id AS short, b.id AS long FROM entities a JOIN entities b ON a.entity_type_id = b.entity_type_id AND length(a.name) >= 3 AND length(a.name) <= length(b.name) AND contains(lower(b.name), lower(a.name)) AND CASE WHEN lower(a.name) = lower(b.name) THEN a.id < b.id ELSE a.id <> b.id END"),
    "j08_all_candidates": on_views(
        "facts",
        lambda f: reads.same_ends(f, None),
        "SELECT subject_id, object_id, string_agg(DISTINCT predicate, ',' ORDER BY predicate) AS predicates FROM facts WHERE fact_status_id IN (1, 2) AND object_id IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT predicate) > 1",
    ),
    "a24_facts_of_sources": on_views("sources", lambda s: s.where("source_type_id = 2").select("fact_id").distinct(), "SELECT DISTINCT fact_id FROM sources WHERE source_type_id = 2"),
    "a21_percentiles": on_views(
        "audit",
        lambda a: reads.ranked_in_parts(a.select("change_type", "id", "value"), "change_type", [F.col("value"), F.col("id")]).join(a.groupBy("change_type").agg(F.count("*").alias("n")), "change_type").where("rank = round((n - 1) * 0.95) + 1").select("change_type", F.col("value").alias("p95")),
        "SELECT change_type, value AS p95 FROM (SELECT *, row_number() OVER (PARTITION BY change_type ORDER BY value, id) AS r, count(*) OVER (PARTITION BY change_type) AS n FROM audit) WHERE r = round((n - 1) * 0.95) + 1",
    ),
    "a23_summary": on_views("facts sources", lambda f, s: f.agg(F.count("*").alias("facts"), F.count_distinct("subject_id").alias("entities")).crossJoin(s.agg(F.count("*").alias("sources"))), "SELECT count(*) AS facts, count(DISTINCT subject_id) AS entities, (SELECT count(*) FROM sources) AS sources FROM facts"),
    "x08_merge_boost": on_views("facts", lambda f: f.groupBy("subject_id", "predicate").agg(F.round(render.merged_confidence(F.min("confidence"), F.max("confidence")), 6).alias("merged")), "SELECT subject_id, predicate, round(least(greatest(min(confidence), max(confidence)) + 0.05, 0.95), 6) AS merged FROM facts GROUP BY 1, 2"),
    "d13_relative_days": on_views("facts entities", lambda f, e: memory.upcoming(f, e, at("1997-01-01"), at("1997-02-01")).select("id", render.relative_day(F.col("days")).alias("due")), f"SELECT f.id, CASE WHEN d <= 0 THEN 'today' WHEN d = 1 THEN 'in 1 day' ELSE concat('in ', d, ' days') END AS due FROM (SELECT *, date_diff('day', DATE '1997-01-01', CAST(valid_from AS DATE)) AS d FROM facts WHERE {_VISIBLE} AND valid_from > TIMESTAMP '1997-01-01' AND valid_from <= TIMESTAMP '1997-02-01') f JOIN entities e ON e.id = subject_id"),
    "f09_snippets": on_views("messages", lambda m: m.select("session_id", "turn", render.snippet(F.col("content"), "the", 3).alias("snippet")).where("snippet is not null"), _SNIPPETS),
    "g05_cycles": on_views(
        "hierarchy",
        lambda h: lookups.would_cycle(graph.closure(h), h.select(F.col("child").alias("parent"), F.col("parent").alias("child")).unionByName(h)),
        "WITH RECURSIVE up(node, a) AS (SELECT child, parent FROM hierarchy UNION SELECT node, parent FROM up JOIN hierarchy ON child = a) SELECT DISTINCT parent AS child, child AS parent FROM hierarchy JOIN up ON node = child AND a = parent",
    ),
    "t13_staged_once": on_views("attempts", lambda a: a.dropDuplicates(["key", "ts"]).groupBy("key").agg(F.count("*").alias("n")), "SELECT key, count(*) AS n FROM (SELECT DISTINCT key, ts FROM attempts) GROUP BY key"),
    "t14_two_queues": on_views("attempts", lambda a: reads.top_per(a, "key", [F.col("active").desc(), F.col("ts"), F.col("id")], None).select("key", "id", "rank"), "SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY active DESC, ts, id) AS rank FROM attempts"),
}
