"""The knowledge-graph tables, projected from the tables of a data folder.

Each view is one statement that both Spark SQL and ANSI engines run; only the
few functions in ``SPARK`` and ``ANSI`` are spelt differently. Operators take
the views as DataFrames and know nothing of this projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"days": "{0} + make_dt_interval({1})", "values": "VALUES"}
ANSI = {"days": "{0} + to_days({1})"}

#: Ids of different tables stay apart by their last hexadecimal digit.
VIEWS = {
    "entities": """
SELECT CAST(r_regionkey AS BIGINT) * 16 + 1 AS id, r_name AS name, 2 AS entity_type_id FROM region
UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 16 + 2, n_name, 2 FROM nation
UNION ALL SELECT c_custkey * 16 + 3, c_name, 1 FROM customer
UNION ALL SELECT s_suppkey * 16 + 4, s_name, 6 FROM supplier
UNION ALL SELECT p_partkey * 16 + 5, p_name, 4 FROM part
UNION ALL SELECT o_orderkey * 16 + 6, concat('order ', CAST(o_orderkey AS STRING)), 3 FROM orders""",
    "facts": """
SELECT concat('n', CAST(n_nationkey AS STRING)) AS id, CAST(n_nationkey AS BIGINT) * 16 + 2 AS subject_id, 'located_in' AS predicate, CAST(n_regionkey AS BIGINT) * 16 + 1 AS object_id, CAST(NULL AS STRING) AS object_literal,
  CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_until, CAST(1 AS DOUBLE) AS confidence, 1 AS fact_status_id, false AS pending, false AS inferred FROM nation
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), c_custkey * 16 + 3, 'located_in', CAST(c_nationkey AS BIGINT) * 16 + 2, NULL, NULL, NULL, CAST(3 + c_custkey % 7 AS DOUBLE) / 10, CASE WHEN c_custkey % 23 = 0 THEN 6 ELSE 1 END, c_custkey % 17 = 0, c_custkey % 5 = 0 FROM customer
UNION ALL SELECT concat('s', CAST(s_suppkey AS STRING)), s_suppkey * 16 + 4, 'located_in', CAST(s_nationkey AS BIGINT) * 16 + 2, NULL, NULL, NULL, CAST(3 + s_suppkey % 7 AS DOUBLE) / 10, 1, false, false FROM supplier
UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), o_custkey * 16 + 3, 'has_order', o_orderkey * 16 + 6, NULL, CAST(o_orderdate AS TIMESTAMP), NULL, CAST(3 + o_orderkey % 7 AS DOUBLE) / 10, CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'P' THEN 3 ELSE 5 END, o_orderkey % 17 = 0, o_orderkey % 5 = 0 FROM orders
UNION ALL SELECT concat('l', {line}), l_suppkey * 16 + 4, 'supplies', l_partkey * 16 + 5, NULL, CAST(l_shipdate AS TIMESTAMP), {until}, 1 - l_discount, CASE l_linestatus WHEN 'O' THEN 1 ELSE 2 END, l_orderkey % 17 = 0, l_orderkey % 5 = 0 FROM lineitem
UNION ALL SELECT concat('e', CAST(event_id AS STRING)), user_id * 16 + 3, 'rejected_action', NULL, props, CAST(ts AS TIMESTAMP), NULL, CAST(5 AS DOUBLE) / 10, 1, false, false FROM events WHERE event_type = 'error'
UNION ALL SELECT concat('v', CAST(o_orderkey AS STRING)), o_custkey * 16 + 3, 'visited', (1 + o_orderkey % 10) * 16 + 4, NULL, CAST(o_orderdate AS TIMESTAMP), CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 30 DAY END, CAST(3 + o_orderkey % 7 AS DOUBLE) / 10, 1, false, o_orderkey % 5 = 0 FROM orders WHERE o_orderkey % 7 = 0""",
    "categories": """
SELECT CAST(r_regionkey AS BIGINT) + 1 AS id, r_name AS name, CAST(NULL AS BIGINT) AS parent_id, CAST(8 AS DOUBLE) / 10 AS memory_weight, 1 AS memory_bucket_id FROM region
UNION ALL SELECT CAST(n_nationkey AS BIGINT) + 100, n_name, CAST(n_regionkey AS BIGINT) + 1, CAST(5 + n_nationkey % 5 AS DOUBLE) / 10, 2 + n_nationkey % 4 FROM nation""",
    "fact_categories": """
SELECT concat('o', CAST(o_orderkey AS STRING)) AS fact_id, CAST(c_nationkey AS BIGINT) + 100 AS category_id FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), CAST(n_regionkey AS BIGINT) + 1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderkey % 3 = 0
UNION ALL SELECT concat('c', CAST(c_custkey AS STRING)), CAST(c_nationkey AS BIGINT) + 100 FROM customer""",
    "sources": """
SELECT concat('l', {line}) AS fact_id, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 5 END AS source_type_id, {line} AS raw_reference FROM lineitem
UNION ALL SELECT concat('o', CAST(o_orderkey AS STRING)), CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 2 END, CAST(o_orderkey AS STRING) FROM orders""",
    "dependencies": """
SELECT concat('o', CAST(o_orderkey AS STRING)) AS child_fact_id, concat('c', CAST(o_custkey AS STRING)) AS parent_fact_id, o_orderkey % 3 <> 0 AS is_positive FROM orders WHERE o_orderkey % 5 = 0""",
    "hierarchy": """
SELECT * FROM (VALUES ('located_in', 'location'), ('has_order', 'commerce'), ('supplies', 'commerce'), ('supplies', 'employment'), ('rejected_action', 'behaviour'), ('commerce', 'root'), ('employment', 'root'), ('location', 'root'), ('behaviour', 'root')) AS h(child, parent)
UNION SELECT r_name, 'location' FROM region UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT p_type, 'commerce' FROM part UNION SELECT p_brand, p_type FROM part UNION SELECT c_name, c_mktsegment FROM customer UNION SELECT c_mktsegment, 'commerce' FROM customer""",
    "messages": """
SELECT conv_id AS session_id, turn, role, text AS content, CAST(length(text) AS BIGINT) AS chars FROM conversations""",
    "locations": """
SELECT CAST(n_nationkey AS BIGINT) * 16 + 2 AS entity_id, CAST(n_nationkey * 73 % 1600 AS DOUBLE) / 10 - 80 AS latitude, CAST(n_nationkey * 297 % 3600 AS DOUBLE) / 10 - 180 AS longitude FROM nation
UNION ALL SELECT s_suppkey * 16 + 4, CAST(s_suppkey * 73 % 1600 AS DOUBLE) / 10 - 80, CAST(s_suppkey * 297 % 3600 AS DOUBLE) / 10 - 180 FROM supplier""",
    "overlays": """
SELECT o_orderkey AS id, concat('o', CAST(o_orderkey AS STRING)) AS fact_id, o_custkey * 16 + 3 AS entity_id, CAST(o_orderdate AS TIMESTAMP) AS trigger_at, CASE WHEN o_orderkey % 4 = 3 THEN 'dismissed' ELSE 'active' END AS status,
  CASE o_orderkey % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'monthly' ELSE 'yearly' END AS recurrence, CAST(1 + o_orderkey % 3 AS INT) AS step, o_orderkey % 2 = 0 AS auto_complete FROM orders""",
    "preferences": """
SELECT event_id AS id, user_id * 16 + 3 AS entity_id, event_type AS key, props AS value, CAST(event_id % 10 AS DOUBLE) / 10 AS confidence, CAST(ts AS TIMESTAMP) AS updated_at FROM events""",
    "contexts": """
SELECT event_id AS preference_id, 'place' AS context_key, CAST(event_id % 4 AS STRING) AS context_value FROM events WHERE event_id % 3 > 0
UNION ALL SELECT event_id, 'hour', CAST(event_id % 7 AS STRING) FROM events WHERE event_id % 3 = 1""",
    "aliases": """
SELECT p_partkey * 16 + 5 AS entity_id, p_brand AS alias FROM part
UNION ALL SELECT c_custkey * 16 + 3, c_mktsegment FROM customer""",
    "attempts": """
SELECT event_id AS id, user_id AS key, CAST(ts AS TIMESTAMP) AS ts, event_type = 'error' AS failed, event_type = 'click' AS active FROM events""",
    "rings": """
SELECT concat('r', CAST(r_regionkey AS STRING)) AS id, CAST(r_regionkey AS BIGINT) * 16 + 1 AS subject_id, 'located_in' AS predicate, CAST((r_regionkey + 1) % 5 AS BIGINT) * 16 + 1 AS object_id, CAST(NULL AS STRING) AS object_literal,
  CAST(NULL AS TIMESTAMP) AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_until, CAST(9 AS DOUBLE) / 10 AS confidence, 1 AS fact_status_id, false AS pending, false AS inferred FROM region""",
    "preference_writes": """
SELECT event_id AS id, CASE WHEN user_id % 50 > 0 THEN user_id * 16 + 3 END AS entity_id, event_type AS key, props AS value, CASE WHEN event_id % 77 = 0 THEN CAST(9 AS DOUBLE) / 10 WHEN event_id % 11 = 0 THEN CAST(1 AS DOUBLE) WHEN event_id % 97 = 0 THEN CAST(11 AS DOUBLE) / 10 ELSE CAST(event_id % 5 AS DOUBLE) / 10 END AS confidence,
  event_id % 11 = 0 AS overridden_by_user, event_id AS arrival FROM events""",
    "place_statements": """
SELECT o_orderkey AS id, o_custkey * 16 + 3 AS entity_id, CAST(1 + o_orderkey % 2 AS INT) AS location_type_id, CASE WHEN o_orderkey % 3 > 0 THEN concat('street ', CAST(floor(o_totalprice) AS BIGINT) % 3) END AS address,
  CASE WHEN o_orderkey % 5 > 0 THEN 10 + CAST(CAST(floor(o_totalprice) AS BIGINT) % 3 AS DOUBLE) / 2 + CAST(o_orderkey % 7 AS DOUBLE) / 5000 END AS latitude, CASE WHEN o_orderkey % 5 > 0 THEN CAST(20 AS DOUBLE) END AS longitude, CASE WHEN o_orderkey % 4 = 1 THEN 'UTC' END AS timezone,
  CASE WHEN o_orderkey % 6 > 0 THEN CAST(o_orderdate AS TIMESTAMP) END AS valid_from, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 400 DAY END AS valid_until, o_orderkey AS arrival, o_orderkey % 9 = 0 AS there FROM orders""",
    "mentions": """
SELECT DISTINCT p_name AS asked, 4 AS entity_type_id FROM part UNION SELECT upper(substring(p_name, 1, position(' ' IN p_name) - 1)), 4 FROM part
UNION SELECT p_brand, 4 FROM part UNION SELECT lower(c_mktsegment), 1 FROM customer UNION SELECT lower(r_name), 2 FROM region
UNION SELECT lower(replace(n_name, '_', ' ')), 2 FROM nation UNION SELECT upper(s_name), CASE WHEN s_suppkey % 2 = 0 THEN 6 ELSE 1 END FROM supplier
UNION SELECT lower(replace(c_name, '#', ' ')), 1 FROM customer WHERE c_custkey % 10 = 0 UNION SELECT concat(s_name, ' & co'), 6 FROM supplier UNION SELECT concat('order ', CAST(o_orderkey AS STRING)), 3 FROM orders WHERE o_orderkey % 100 = 0""",
    "contradictions": """
SELECT concat('o', CAST(o_orderkey AS STRING)) AS parent_fact_id, concat('o', CAST(o_orderkey + 1 AS STRING)) AS child_fact_id FROM orders WHERE o_orderkey % 2 = 0
UNION ALL SELECT concat('o', CAST(o_orderkey + 1 AS STRING)), concat('o', CAST(o_orderkey AS STRING)) FROM orders WHERE o_orderkey % 4 = 0""",
    "tasks": """
SELECT conv_id AS task_id, concat('Tell me about ', n_name, chr(39), 's place in region ', CAST(n_regionkey AS STRING), ' and Supplier ', CAST(conv_id % 7 AS STRING), ': ', substring(text, 1, 60)) AS task FROM conversations JOIN nation ON conv_id % 25 = n_nationkey WHERE turn = 0""",
    "vocabulary": """
SELECT * FROM (VALUES ('has_order', 'Ordered', true, 100), ('has_order', 'bought', true, 100), ('visited', 'went to', true, 101), ('located_in', 'is in', true, 102), ('supplies', 'delivers', true, CAST(NULL AS INT)), ('location', 'place', false, 103)) AS v(name, alias, emit_eligible, default_category)""",
    "incoming": """
SELECT o_orderkey AS arrival, CASE o_orderkey % 8 WHEN 0 THEN ' Has Order ' WHEN 1 THEN 'ordered' WHEN 2 THEN 'Went To' WHEN 3 THEN 'likes' WHEN 4 THEN 'IS IN' WHEN 5 THEN 'place' WHEN 6 THEN 'delivers' ELSE 'bought' END AS predicate, o_custkey * 16 + 3 AS subject_id,
  CASE o_orderkey % 9 WHEN 0 THEN 'a loan' WHEN 1 THEN 'loaned' ELSE o_orderpriority END AS object, CAST(o_orderkey % 40 AS BIGINT) + 90 AS category, o_orderkey % 3 > 0 AS flagged, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 13 AS DOUBLE) / 10 END AS confidence,
  CAST(1 + o_orderkey % 6 AS INT) AS source_type_id, CASE o_orderkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'calendar' END AS connector, CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderkey % 5 AS INT) END AS connector_id,
  CASE WHEN o_orderkey % 11 > 0 THEN concat('m', CAST(o_orderkey % 50 AS STRING)) END AS raw_reference, CAST(o_orderdate AS TIMESTAMP) AS valid_from, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL 90 DAY END AS valid_until,
  o_orderkey % 7 < 3 AS correction, CASE o_orderkey % 7 WHEN 1 THEN 'always' WHEN 2 THEN CASE WHEN o_orderkey % 14 = 2 THEN '1996-05-05 00:00:00' ELSE 'soon' END END AS scope FROM orders""",
    "dated": """
SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS day, o_orderkey % 8 AS form, CASE o_orderkey % 8 WHEN 0 THEN concat(' ', d) WHEN 1 THEN concat(d, 'T08:09:10Z') WHEN 2 THEN concat(d, ' 08:09:10') WHEN 3 THEN substring(d, 1, 7) WHEN 4 THEN substring(d, 1, 4)
  WHEN 5 THEN concat(substring('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3), 'xx ', substring(d, 1, 4)) WHEN 6 THEN concat('on ', d) ELSE concat(d, 'T08:09:10+02:00') END AS written FROM (SELECT *, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM orders) x""",
    "audit": """
SELECT event_id AS id, user_id AS fact_id, event_type AS change_type, CAST(ts AS TIMESTAMP) AS changed_at, value FROM events""",
}
_LINE = "concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(l_linenumber AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING))"
TABLES = "region nation customer supplier part orders lineitem events conversations".split()


def _text(name: str, dialect: dict[str, str]) -> str:
    return VIEWS[name].replace("{line}", _LINE).replace("{until}", dialect["days"].format("CAST(l_shipdate AS TIMESTAMP)", "CAST(l_quantity AS INT)"))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; Spark prunes the branches and columns that a query doesn't need."""
    text = _text(name, SPARK)
    used = [t for t in TABLES if f" {t}" in text]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used if f"{{{t}}}" in text}
    return spark.sql(text, **frames)


def ansi(query: str) -> str:
    """The query with the views that it names as common table expressions."""
    used = [n for n in VIEWS if f" {n}" in query.replace("\n", " ").replace("(", " ")]
    text = ", ".join(f"{n} AS ({_text(n, ANSI)})" for n in used)
    body = query.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {text}, {body[len('WITH RECURSIVE') :]}"
    return f"WITH {text}, {body[4:]}" if body.upper().startswith("WITH ") else f"WITH {text} {body}"
