"""Queries of the graph operators on a data folder, each beside ANSI SQL for the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph import derived_queries, lookup_queries, write_queries
from tempograph.catalogue import Query
from tempograph.catalogue import at as _at
from tempograph.catalogue import on_table as _table
from tempograph.catalogue import on_views as _q
from tempograph.functions import predicates, scalars
from tempograph.operators import aggregates, graph, joins, memory, reads, search


NOW = "2024-01-15 00:00:00"
PAST = "1995-06-15 00:00:00"
#: Words that make a text sensitive here, and words that are searched for.
SENSITIVE = ("the", "password", "salary")
TERMS = ("the", "and")

_VISIBLE = "NOT pending AND fact_status_id NOT IN (5, 6)"


_CENTRALITY = """SELECT id, n, 1 + least(n, 50) / CAST(50 AS DOUBLE) AS centrality FROM (
  SELECT id, count(*) AS n FROM (SELECT subject_id AS id FROM facts WHERE fact_status_id NOT IN (5, 6) UNION ALL SELECT object_id FROM facts WHERE fact_status_id NOT IN (5, 6) AND object_id IS NOT NULL) GROUP BY id)"""

_MEMORY = f"""WITH c AS ({_CENTRALITY}),
w AS (SELECT fact_id, max(memory_weight) AS weight, min(memory_bucket_id) AS bucket FROM fact_categories JOIN categories ON category_id = categories.id GROUP BY fact_id),
s AS (SELECT f.subject_id, f.id, f.object_id, f.object_literal, coalesce(bucket, 5) AS bucket, round(confidence * coalesce(weight, 0.5::DOUBLE)
  * CASE WHEN valid_from > TIMESTAMP '{NOW}' THEN 10 / sqrt(greatest((floor(epoch(valid_from)) - epoch(TIMESTAMP '{NOW}')) / 86400, 0.5)) ELSE 1 END * coalesce(centrality, 1), 9) AS score
  FROM facts f LEFT JOIN w ON f.id = w.fact_id LEFT JOIN c ON c.id = f.subject_id WHERE {_VISIBLE} AND confidence >= 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, id) AS rank FROM s)
SELECT subject_id, r.id, coalesce(name, object_literal) AS object, bucket, score, rank FROM r LEFT JOIN entities e ON e.id = r.object_id WHERE rank <= 5"""


def _memory(facts, entities, categories, fact_categories, limit: int | None = 5) -> DataFrame:
    return memory.ranked_memory(facts, entities, categories, fact_categories, _at(NOW), 0.5, limit)


def _top_facts(key: str) -> str:
    return f"SELECT {key}, id, rank FROM (SELECT {key}, id, row_number() OVER (PARTITION BY {key} ORDER BY id) AS rank FROM facts WHERE {key} IS NOT NULL) WHERE rank <= 10"


_OVERLAP = "(a.valid_from IS NULL OR b.valid_until IS NULL OR a.valid_from < b.valid_until) AND (b.valid_from IS NULL OR a.valid_until IS NULL OR b.valid_from < a.valid_until) AND (a.valid_from IS NULL OR a.valid_until IS NULL OR a.valid_from < a.valid_until) AND (b.valid_from IS NULL OR b.valid_until IS NULL OR b.valid_from < b.valid_until)"

_HTML = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'))".format(
    "replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&')"
)
_RANKED = r"""
WITH l AS (SELECT session_id, turn, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM messages),
t AS (SELECT session_id, turn, term, len(list_filter(w, lambda x: x = term)) AS tf, len(w) AS length FROM l, (SELECT unnest(['the', 'and']) AS term)),
d AS (SELECT term, count(*) AS df FROM t WHERE tf > 0 GROUP BY 1), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM l)
SELECT session_id, turn, count(*) AS n_terms, round(sum(ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score FROM t JOIN d USING (term), n WHERE tf > 0 GROUP BY 1, 2"""


QUERIES: dict[str, Query] = {
    "m02_memory_score": _q("facts entities categories fact_categories", _memory, _MEMORY),
    "m02_memory_all": _q("facts entities categories fact_categories", lambda *t: _memory(*t, limit=None), _MEMORY.removesuffix(" WHERE rank <= 5")),
    "r02_facts_by_subject": _q("facts", lambda f: reads.facts_by(f, "subject_id", 10), _top_facts("subject_id")),
    "r03_facts_by_predicate": _q("facts", lambda f: reads.facts_by(f, "predicate", 10), _top_facts("predicate")),
    "r04_facts_by_object": _q("facts", lambda f: reads.facts_by(f, "object_id", 10), _top_facts("object_id")),
    "r06_exists_triple": _q(
        "facts",
        lambda f: reads.existing_triples(f, f.where("fact_status_id in (5, 6)").select("subject_id", "predicate", "object_id", "object_literal")).groupBy("predicate").agg(F.count("*").alias("n")),
        """SELECT predicate, count(*) AS n FROM facts w WHERE fact_status_id IN (5, 6) AND EXISTS (SELECT 1 FROM facts f WHERE f.fact_status_id <> 6 AND f.subject_id = w.subject_id AND f.predicate = w.predicate
  AND f.object_id IS NOT DISTINCT FROM w.object_id AND f.object_literal IS NOT DISTINCT FROM w.object_literal) GROUP BY predicate""",
    ),
    "r07_active_at": _q(
        "facts",
        lambda f: reads.active_facts_at(f, _at(PAST)).select("id", "subject_id", "predicate", "confidence"),
        f"SELECT id, subject_id, predicate, confidence FROM facts WHERE fact_status_id = 1 AND (valid_from IS NULL OR valid_from <= TIMESTAMP '{PAST}') AND (valid_until IS NULL OR valid_until > TIMESTAMP '{PAST}')",
    ),
    "r08_filtered_facts": _q(
        "facts entities",
        lambda f, e: reads.filtered_facts(f, e, 0.5, 10),
        f"""SELECT subject_id, r.id, predicate, coalesce(name, object_literal) AS object, confidence, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, valid_from DESC NULLS LAST, id DESC) AS rank FROM facts WHERE {_VISIBLE} AND confidence >= 0.5) r
  LEFT JOIN entities e ON e.id = r.object_id WHERE rank <= 10""",
    ),
    "r09_fact_count": _q("facts", lambda f: reads.fact_counts(f, 0.5), f"SELECT subject_id, count(*) AS n FROM facts WHERE {_VISIBLE} AND confidence >= 0.5 GROUP BY subject_id"),
    "r13_audit_filter": _q(
        "audit",
        lambda a: reads.audit_entries(a, ["error", "purchase"], _at("2024-01-02"), _at("2024-01-20"), 5).select("fact_id", "id", "change_type", "rank"),
        """SELECT fact_id, id, change_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY changed_at, id) AS rank FROM audit
  WHERE change_type IN ('error', 'purchase') AND changed_at >= TIMESTAMP '2024-01-02' AND changed_at < TIMESTAMP '2024-01-20') WHERE rank <= 5""",
    ),
    "r37_session_preview": _q(
        "messages",
        lambda m: reads.sessions(m, 40),
        "SELECT session_id, count(*) AS n, max(turn) AS last_turn, substring(max_by(content, turn) FILTER (WHERE role = 'user'), 1, 40) AS preview FROM messages GROUP BY session_id",
    ),
    "n01_nested_sources": _q(
        "facts sources",
        reads.nested_sources,
        "SELECT f.id AS fact_id, coalesce(n, 0) AS n_sources, refs FROM facts f LEFT JOIN (SELECT fact_id, count(*) AS n, string_agg(raw_reference, ',' ORDER BY raw_reference) AS refs FROM sources GROUP BY fact_id) s ON s.fact_id = f.id",
    ),
    "a01_totals": _q(
        "facts entities",
        lambda f, e: aggregates.totals(f, e).withColumn("mean_confidence", F.round("mean_confidence", 6)),
        "SELECT count(*) AS n_facts, round(coalesce(avg(confidence), 0), 6) AS mean_confidence, (SELECT count(*) FROM entities) AS n_entities FROM facts WHERE fact_status_id <> 6",
    ),
    "a02_top_entities": _q("facts entities", lambda f, e: aggregates.top_entities(f, e, 10), "SELECT e.id, name, n FROM (SELECT subject_id, count(*) AS n FROM facts WHERE fact_status_id <> 6 GROUP BY 1) JOIN entities e ON e.id = subject_id ORDER BY n DESC, name, e.id LIMIT 10"),
    "a04_by_month": _q(
        "facts",
        lambda f: aggregates.by_month(f.withColumn("created_at", F.date_add(F.lit("1995-01-01").cast("date"), (F.col("subject_id") % 400).cast("int")).cast("timestamp"))),
        "SELECT strftime(coalesce(valid_from, TIMESTAMP '1995-01-01' + to_days(CAST(subject_id % 400 AS INT))), '%Y-%m') AS month, count(*) AS n FROM facts WHERE fact_status_id <> 6 GROUP BY 1",
    ),
    "a05_confidence_bands": _q(
        "facts",
        aggregates.confidence_bands,
        """SELECT band, count(c) AS n FROM (VALUES ('0.0-0.2'), ('0.2-0.4'), ('0.4-0.6'), ('0.6-0.8'), ('0.8-1.0')) b(band) LEFT JOIN (
  SELECT confidence AS c, CASE WHEN confidence < 0.2::DOUBLE THEN '0.0-0.2' WHEN confidence < 0.4::DOUBLE THEN '0.2-0.4' WHEN confidence < 0.6::DOUBLE THEN '0.4-0.6' WHEN confidence < 0.8::DOUBLE THEN '0.6-0.8' ELSE '0.8-1.0' END AS band
  FROM facts WHERE fact_status_id <> 6) USING (band) GROUP BY band""",
    ),
    "a06_centrality": _q("facts", aggregates.centrality, _CENTRALITY),
    "a08_category_counts": _q("categories fact_categories", aggregates.category_counts, "SELECT c.id, name, count(fact_id) AS n FROM categories c LEFT JOIN fact_categories ON category_id = c.id GROUP BY c.id, name"),
    "a09_match_all": _q(
        "fact_categories categories",
        lambda fc, c: aggregates.matching_all(fc, c.where("id = 101").select(F.explode(F.array("id", "parent_id")).alias("category_id"))),
        """WITH w AS (SELECT unnest([id, parent_id]) AS id FROM categories WHERE id = 101) SELECT fact_id FROM fact_categories JOIN w ON w.id = category_id GROUP BY fact_id HAVING count(DISTINCT category_id) = (SELECT count(*) FROM w)""",
    ),
    "a10_match_any": _q(
        "fact_categories categories",
        lambda fc, c: aggregates.matching_any(fc, c.where("parent_id = 2 or id = 2").select(F.col("id").alias("category_id"))),
        """SELECT fact_id, array_to_string(list_sort(list(DISTINCT category_id)), ',') AS categories FROM fact_categories WHERE fact_id IN (
  SELECT fact_id FROM fact_categories JOIN categories c ON c.id = category_id WHERE parent_id = 2 OR c.id = 2) GROUP BY fact_id""",
    ),
    "a16_threshold": _q("facts", lambda f: aggregates.repeated_rejections(f, 3), "SELECT subject_id, object_id, object_literal, count(*) AS n FROM facts WHERE predicate = 'rejected_action' AND fact_status_id = 1 GROUP BY ALL HAVING count(*) >= 3"),
    "a18_parent_confidence": _q(
        "facts dependencies",
        lambda f, d: aggregates.parent_confidence(f, d).withColumn("inferred", F.round(scalars.inferred_confidence(F.col("total"), F.lit(1), F.col("n")), 6)).withColumn("total", F.round("total", 6)),
        """SELECT child_fact_id, round(total, 6) AS total, n, round(least(greatest(total * 0.8 * CASE n WHEN 0 THEN 0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.75 WHEN 3 THEN 0.9 ELSE 1 END, 0), 0.95), 6) AS inferred FROM (
  SELECT child_fact_id, sum(CASE WHEN is_positive THEN confidence ELSE -confidence END) AS total, count(*) AS n FROM dependencies JOIN facts ON facts.id = parent_fact_id GROUP BY child_fact_id)""",
    ),
    "a19_session_tokens": _q("messages", aggregates.session_tokens, "SELECT session_id, CAST(sum(chars // 4) AS BIGINT) AS tokens, count(*) FILTER (WHERE role = 'user') AS user_turns FROM messages GROUP BY session_id"),
    "w02_token_trim": _q(
        "messages",
        lambda m: aggregates.trimmed(m, 400).select("session_id", "turn", "tokens"),
        "SELECT session_id, turn, CAST(tokens AS BIGINT) AS tokens FROM (SELECT *, sum(chars // 4) OVER (PARTITION BY session_id ORDER BY turn DESC) AS tokens FROM messages) WHERE tokens <= 400",
    ),
    "w03_turns": _q("messages", lambda m: aggregates.turns(m).select("session_id", "turn", "segment"), "SELECT session_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY turn) AS BIGINT) AS segment FROM messages"),
    "j04_future_without_overlay": _q(
        "facts dependencies",
        lambda f, d: joins.future_without_overlay(f, d.select(F.col("child_fact_id").alias("fact_id")), _at("1998-01-01"), 0.5).select("id", "subject_id"),
        f"SELECT id, subject_id FROM facts WHERE {_VISIBLE} AND valid_from > TIMESTAMP '1998-01-01' AND confidence >= 0.5 AND id NOT IN (SELECT child_fact_id FROM dependencies)",
    ),
    "j06_dormant": _q(
        "facts sources",
        lambda f, s: joins.dormant_facts(f, s, _at(NOW)),
        f"""SELECT a.id, a.subject_id, a.confidence FROM facts a WHERE fact_status_id = 3 AND valid_from < TIMESTAMP '{NOW}' AND NOT EXISTS (SELECT 1 FROM sources s WHERE s.fact_id = a.id AND source_type_id = 1)
  AND EXISTS (SELECT 1 FROM facts b WHERE b.fact_status_id = 3 AND b.valid_from < TIMESTAMP '{NOW}' AND b.subject_id = a.subject_id AND b.predicate = a.predicate AND b.confidence > a.confidence)""",
    ),
    "j07_dup_facts": _q(
        "facts",
        joins.duplicate_facts,
        f"SELECT a.id AS a, b.id AS b FROM facts a JOIN facts b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND a.object_id IS NOT DISTINCT FROM b.object_id AND a.object_literal IS NOT DISTINCT FROM b.object_literal AND a.id < b.id WHERE a.fact_status_id IN (1, 2) AND b.fact_status_id IN (1, 2) AND {_OVERLAP}",
    ),
    "j09_dup_names": _q("entities", joins.names_shared, "SELECT lower(name) AS key, count(*) AS n, min(id) AS first FROM entities GROUP BY 1 HAVING count(*) > 1"),
    "j12_contradictions": _q(
        "facts",
        lambda f: joins.contradictions(f, "has_order"),
        """WITH r AS (SELECT * FROM facts WHERE predicate = 'has_order' AND fact_status_id = 1), b AS (SELECT subject_id, first(object_id ORDER BY confidence DESC, id) AS kept, count(DISTINCT object_id) AS n FROM r GROUP BY 1)
SELECT r.subject_id, kept, object_id AS other FROM r JOIN b USING (subject_id) WHERE n > 1 AND object_id <> kept""",
    ),
    "j13_transitivity": _q(
        "facts",
        lambda f: joins.visited_places(f.withColumn("depth", F.col("inferred").cast("int"))),
        """WITH r AS (SELECT *, CASE WHEN inferred THEN 1 ELSE 0 END AS depth FROM facts WHERE fact_status_id IN (1, 2)),
p AS (SELECT a.subject_id, b.object_id, a.id AS first, b.id AS second, greatest(a.valid_from, b.valid_from) AS valid_from, least(a.valid_until, b.valid_until) AS valid_until, greatest(a.depth, b.depth) + 1 AS depth,
  least(greatest((a.confidence + b.confidence) * pow(0.8, greatest(a.depth, b.depth) + 1) * 0.75, 0), 0.95) AS confidence
  FROM r a JOIN r b ON a.object_id = b.subject_id WHERE a.predicate = 'visited' AND b.predicate = 'located_in' AND a.subject_id <> b.object_id)
SELECT * FROM p WHERE (valid_from IS NULL OR valid_until IS NULL OR valid_from < valid_until)
  AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.predicate = 'visited' AND f.subject_id = p.subject_id AND f.object_id = p.object_id AND f.object_literal IS NULL)""",
    ),
    "o02_visited_places": _q(
        "facts",
        lambda f: joins.visited_places(f.withColumn("depth", F.col("inferred").cast("int"))),
        """WITH r AS (SELECT *, CASE WHEN inferred THEN 1 ELSE 0 END AS depth FROM facts WHERE fact_status_id IN (1, 2)),
p AS (SELECT a.subject_id, b.object_id, a.id AS first, b.id AS second, greatest(a.valid_from, b.valid_from) AS valid_from, least(a.valid_until, b.valid_until) AS valid_until, greatest(a.depth, b.depth) + 1 AS depth,
  least(greatest((a.confidence + b.confidence) * pow(0.8, greatest(a.depth, b.depth) + 1) * 0.75, 0), 0.95) AS confidence
  FROM r a JOIN r b ON a.object_id = b.subject_id WHERE a.predicate = 'visited' AND b.predicate = 'located_in' AND a.subject_id <> b.object_id)
SELECT * FROM p WHERE (valid_from IS NULL OR valid_until IS NULL OR valid_from < valid_until)
  AND NOT EXISTS (SELECT 1 FROM facts f WHERE f.predicate = 'visited' AND f.subject_id = p.subject_id AND f.object_id = p.object_id AND f.object_literal IS NULL)""",
    ),
    "j17_nearby": _q(
        "locations",
        lambda p: joins.nearby(p, p.where("entity_id % 16 = 2").select(F.col("entity_id").alias("id"), "latitude", "longitude"), 500).withColumn("km", F.round("km", 6)),
        """SELECT centre, entity_id, round(km, 6) AS km, row_number() OVER (PARTITION BY centre ORDER BY km, entity_id) AS rank FROM (
  SELECT c.entity_id AS centre, p.entity_id, 2 * 6371.0088 * atan2(sqrt(h), sqrt(greatest(1 - h, 0))) AS km FROM (
    SELECT c.entity_id, p.entity_id AS pid, pow(sin(radians(p.latitude - c.latitude) / 2), 2) + cos(radians(c.latitude)) * cos(radians(p.latitude)) * pow(sin(radians(p.longitude - c.longitude) / 2), 2) AS h
    FROM locations c, locations p WHERE c.entity_id % 16 = 2) c JOIN locations p ON p.entity_id = pid) WHERE km <= 500""",
    ),
    "u02_touching_facts": _q(
        "facts",
        joins.touching,
        "SELECT e AS entity_id, count(*) AS n FROM (SELECT subject_id AS e, id FROM facts WHERE fact_status_id NOT IN (5, 6) UNION SELECT object_id, id FROM facts WHERE fact_status_id NOT IN (5, 6) AND object_id IS NOT NULL) GROUP BY e",
    ),
    "g02_predicate_subtree": _q(
        "facts hierarchy",
        graph.subtree_facts,
        f"""WITH RECURSIVE up(node, a) AS (SELECT child, child FROM hierarchy UNION SELECT parent, parent FROM hierarchy UNION SELECT node, parent FROM up JOIN hierarchy ON child = a)
SELECT a AS predicate, CAST(count(*) AS BIGINT) AS n FROM facts JOIN up ON node = predicate WHERE {_VISIBLE} GROUP BY a""",
    ),
    "g04_ancestors": _q("hierarchy", lambda h: graph.closure(h).where("node <> ancestor"), "WITH RECURSIVE up(node, ancestor) AS (SELECT child, parent FROM hierarchy UNION SELECT node, parent FROM up JOIN hierarchy ON child = ancestor) SELECT node, ancestor FROM up"),
    "g01_reach": _q(
        "facts entities",
        lambda f, e: graph.reach(f, e.where("entity_type_id = 1").select(F.col("id").alias("root")), 2),
        f"""WITH o AS (SELECT DISTINCT subject_id AS node, object_id AS o FROM facts WHERE {_VISIBLE} AND object_id IS NOT NULL), r AS (SELECT id AS root FROM entities WHERE entity_type_id = 1),
p AS (SELECT root, root AS node, 0 AS distance FROM r UNION SELECT root, o, 1 FROM r JOIN o ON o.node = root UNION SELECT root, b.o, 2 FROM r JOIN o a ON a.node = root JOIN o b ON b.node = a.o)
SELECT root, node, min(distance) AS distance FROM p GROUP BY root, node""",
    ),
    "m05_upcoming": _q(
        "facts entities",
        lambda f, e: memory.upcoming(f, e, _at("1997-01-01"), _at("1997-02-01")),
        f"SELECT name AS subject, f.id, CAST(date_diff('day', DATE '1997-01-01', CAST(valid_from AS DATE)) AS INT) AS days FROM facts f JOIN entities e ON e.id = subject_id WHERE {_VISIBLE} AND valid_from > TIMESTAMP '1997-01-01' AND valid_from <= TIMESTAMP '1997-02-01'",
    ),
    "m03_budget": _q("facts entities categories fact_categories", lambda *t: memory.budgeted(_memory(*t, limit=None), 40), None),
    "o05_merged_duplicates": _q("facts", lambda f: memory.merged_duplicates(joins.duplicate_facts(f), f), None),
    "f08_message_match": _q(
        "messages",
        lambda m: search.search(m, ["session_id", "turn"], "content", list(TERMS)).select("session_id", "turn", "n_terms"),
        r"""SELECT session_id, turn, 2 AS n_terms FROM (SELECT session_id, turn, string_split_regex(lower(content), '[^\p{L}\p{N}]+') AS t FROM messages) WHERE list_contains(t, 'the') AND list_contains(t, 'and')""",
    ),
    "f06_message_rank": _q("messages", lambda m: search.search(m, ["session_id", "turn"], "content", list(TERMS), all_terms=False), _RANKED),
    "p15_sensitive_docs": _table(
        "documents",
        lambda d: d.where(predicates.sensitive(F.col("text"), SENSITIVE)).select("doc_id"),
        "SELECT doc_id FROM documents WHERE regexp_matches(concat(' ', replace(text, chr(10), ' '), ' '), '(?i)[^a-z0-9](" + "|".join(SENSITIVE) + ")[^a-z0-9]')",
    ),
    "x14_html_text": _table("pages", lambda p: p.select("page_id", scalars.html_text(F.col("html")).alias("text")), f"SELECT page_id, {_HTML} AS text FROM pages"),
    "x07_boost": _q("facts", lambda f: f.select("id", F.round(scalars.boosted(F.col("confidence")), 6).alias("boosted")), "SELECT id, round(CASE WHEN confidence < 0.95::DOUBLE THEN least(confidence + 0.05::DOUBLE, 0.95::DOUBLE) ELSE confidence END, 6) AS boosted FROM facts"),
    "x12_truncate": _q("messages", lambda m: m.select("session_id", "turn", scalars.truncated(F.col("content"), 30).alias("cut")), "SELECT session_id, turn, CASE WHEN length(content) > 30 THEN concat(substring(content, 1, 29), '…') ELSE content END AS cut FROM messages"),
}


QUERIES |= write_queries.QUERIES | lookup_queries.QUERIES | derived_queries.QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.run for k, q in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in QUERIES.items() if q.sql}
