"""Queries of inference, resolution of names, preferences, places, trash and kept-up centrality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tempograph.catalogue import Query, at, on_views
from tempograph.functions import dates, predicates, recurrence, render, text
from tempograph.operators import aggregates, cascade, graph, inference, ingest, joins, memory, places, preferences, prose, ranking, resolution, retrieval, trashcan
from tempograph.streaming import centrality

NOW = "1997-03-31 12:00:00"
_LIVE = "fact_status_id IN (1, 2)"


def _with_depth(facts: DataFrame) -> DataFrame:
    return facts.withColumn("depth", F.when(F.col("inferred"), 1).otherwise(0))


def _all_places(facts: DataFrame, rings: DataFrame) -> DataFrame:
    """The facts, and regions that lie within each other in a ring: five levels below the nations, and a cycle."""
    return _with_depth(facts.unionByName(rings))


# --- inference -------------------------------------------------------------

#: Levels of the data: a supplier's nation, its region, and the other four of the ring; one more shows that nothing follows.
_LEVELS = 7


def _inference_sql(select: str) -> str:
    """The rule unrolled level by level, each against all that is known by then."""
    text = f"""WITH every AS (SELECT *, CASE WHEN inferred THEN 1 ELSE 0 END AS depth FROM facts UNION ALL SELECT *, 0 FROM rings),
located AS (SELECT * FROM every WHERE predicate = 'located_in' AND object_id IS NOT NULL AND {_LIVE}),
known AS (SELECT DISTINCT subject_id, object_id FROM every WHERE predicate = 'visited' AND object_literal IS NULL),
level0 AS (SELECT id, subject_id, object_id, valid_from, valid_until, confidence, depth, '' AS first, '' AS second FROM every WHERE predicate = 'visited' AND object_id IS NOT NULL AND {_LIVE})"""
    for k in range(1, _LEVELS + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM level{j} s WHERE s.subject_id = v.subject_id AND s.object_id = l.object_id)" for j in range(1, k))
        text += f""",
level{k} AS (SELECT * EXCLUDE r FROM (
  SELECT concat('i|', v.subject_id, '|visited|', l.object_id) AS id, v.subject_id, l.object_id, greatest(v.valid_from, l.valid_from) AS valid_from, least(v.valid_until, l.valid_until) AS valid_until,
    least((v.confidence + l.confidence) * pow(0.8, greatest(v.depth, l.depth) + 1) * 0.75, 0.95) AS confidence, greatest(v.depth, l.depth) + 1 AS depth, v.id AS first, l.id AS second,
    row_number() OVER (PARTITION BY v.subject_id, l.object_id ORDER BY least(v.id, l.id), greatest(v.id, l.id)) AS r
  FROM level{k - 1} v JOIN located l ON l.subject_id = v.object_id
  WHERE v.subject_id <> l.object_id AND (greatest(v.valid_from, l.valid_from) IS NULL OR least(v.valid_until, l.valid_until) IS NULL OR greatest(v.valid_from, l.valid_from) < least(v.valid_until, l.valid_until))
    AND NOT EXISTS (SELECT 1 FROM known k WHERE k.subject_id = v.subject_id AND k.object_id = l.object_id) {seen}) WHERE r = 1)"""
    return text + ", found AS (" + " UNION ALL ".join(f"SELECT *, {k} AS turn FROM level{k}" for k in range(1, _LEVELS + 1)) + ") " + select


def _deep_cascade(facts: DataFrame, rings: DataFrame) -> DataFrame:
    """Every visit that a fact states loses half its confidence; what was inferred from it follows, level by level."""
    every = _all_places(facts, rings)
    inferred = inference.infer(every)
    rows = every.select("id", "confidence", "depth", "predicate").unionByName(inferred.select("id", "confidence", "depth", F.lit("inferred").alias("predicate")))
    changed = rows.where("predicate = 'visited'").select("id", (F.col("confidence") / 2).alias("confidence"))
    return cascade.cascade(rows.select("id", "confidence", "depth"), inference.edges(inferred), changed).where("id like 'i|%'")


def _deep_cascade_sql() -> str:
    """New values down the levels; a child whose change is small keeps its value, and so do those below."""
    text = _inference_sql("")
    text += ", now0 AS (SELECT id, confidence / 2 AS c, true AS moved FROM level0 UNION ALL SELECT id, confidence / 2, true FROM every WHERE predicate = 'visited' AND (object_id IS NULL OR NOT fact_status_id IN (1, 2)))"
    for k in range(1, _LEVELS + 1):
        text += f""",
new{k} AS (SELECT f.id, f.confidence AS old, least(greatest((coalesce(p.c, v.confidence) + l.confidence) * pow(0.8, f.depth) * 0.75, 0), 0.95) AS c, coalesce(p.moved, false) AS reached
  FROM level{k} f JOIN (SELECT id, confidence FROM level{k - 1}) v ON v.id = f.first JOIN located l ON l.id = f.second LEFT JOIN now{k - 1} p ON p.id = f.first),
now{k} AS (SELECT id, c, true AS moved FROM new{k} WHERE reached AND abs(c - old) > 0.001)"""
    return text + " SELECT id, round(c, 6) AS confidence FROM (" + " UNION ALL ".join(f"SELECT id, c FROM now{k}" for k in range(1, _LEVELS + 1)) + ")"


# --- preferences -----------------------------------------------------------


def _preferences(writes: DataFrame, contexts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is there (the first valid one of every second entity's preferences, and everyone's) and what is written."""
    rows = preferences.identified(writes, contexts)
    first = W.partitionBy("entity_id", "key", "context_set").orderBy(F.when(preferences.valid(F.col("confidence"), F.col("overridden_by_user")), 0).otherwise(1), "id")
    marked = rows.withColumn("_r", F.row_number().over(first)).withColumn("_there", (F.col("_r") == 1) & preferences.valid(F.col("confidence"), F.col("overridden_by_user")) & (F.coalesce(F.col("entity_id"), F.lit(0)) % 32 < 16))
    there = marked.where("_there").drop("_r", "_there", "arrival")
    return there, marked.where("not _there").drop("_r", "_there")


def _upserted(writes: DataFrame, contexts: DataFrame) -> DataFrame:
    return preferences.upserted(*_preferences(writes, contexts))


def _preferences_after(writes: DataFrame, contexts: DataFrame) -> DataFrame:
    there, new = _preferences(writes, contexts)
    return preferences.preferences_after(there, preferences.upserted(there, new)).select("preference_id", "entity_id", "key", "value", "confidence", "overridden_by_user", "written_by")


_VALID = "(CASE WHEN overridden_by_user THEN confidence = 1 ELSE confidence BETWEEN 0 AND 1 END)"
#: The rules one write after the other.
_PREFERENCE_STEPS = f"""
WITH RECURSIVE sets AS (SELECT preference_id, string_agg(DISTINCT context_key || '=' || context_value, ';' ORDER BY context_key || '=' || context_value) AS s FROM contexts GROUP BY 1),
named AS (SELECT w.*, coalesce(entity_id, -1) AS e, coalesce(s, '') AS s, {_VALID} AS ok FROM preference_writes w LEFT JOIN sets ON preference_id = id),
marked AS (SELECT *, ok AND coalesce(entity_id, 0) % 32 < 16 AND row_number() OVER (PARTITION BY e, key, s ORDER BY CASE WHEN ok THEN 0 ELSE 1 END, id) = 1 AS there FROM named),
lined AS (SELECT *, row_number() OVER (PARTITION BY e, key, s ORDER BY CASE WHEN there THEN 0 ELSE 1 END, arrival, id) AS n FROM marked),
steps AS (
  SELECT n, e, key, s, id, there, CASE WHEN there THEN 'there' WHEN ok THEN 'created' ELSE 'invalid' END AS action, CASE WHEN ok THEN id END AS pid, CASE WHEN ok THEN id END AS holder, CASE WHEN ok THEN value END AS held, CASE WHEN ok THEN confidence END AS c, CASE WHEN ok THEN overridden_by_user END AS x, CAST(NULL AS VARCHAR) AS old, value AS new, CASE WHEN ok AND NOT there THEN '' END AS reason FROM lined WHERE n = 1
  UNION ALL
  SELECT l.n, l.e, l.key, l.s, l.id, false, a.action,
    CASE WHEN a.action = 'created' THEN l.id ELSE p.pid END, CASE WHEN a.action IN ('created', 'overwritten') THEN l.id ELSE p.holder END, CASE WHEN a.action IN ('created', 'overwritten') THEN l.value ELSE p.held END,
    CASE WHEN a.action IN ('created', 'overwritten') THEN l.confidence ELSE p.c END, CASE WHEN a.action IN ('created', 'overwritten') THEN l.overridden_by_user ELSE p.x END, p.held, l.value,
    CASE a.action WHEN 'created' THEN '' WHEN 'overwritten' THEN CASE WHEN l.overridden_by_user AND p.x THEN 'updated by user' WHEN l.overridden_by_user THEN 'overridden by user' ELSE 'higher confidence inferred preference' END WHEN 'kept' THEN CASE WHEN l.confidence = p.c THEN 'equal confidence inferred preference' END END
  FROM steps p JOIN lined l ON l.e = p.e AND l.key = p.key AND l.s = p.s AND l.n = p.n + 1,
    LATERAL (SELECT CASE WHEN NOT l.ok THEN 'invalid' WHEN p.pid IS NULL THEN 'created' WHEN p.x AND NOT l.overridden_by_user THEN 'rejected' WHEN l.overridden_by_user THEN 'overwritten' WHEN l.confidence > p.c THEN 'overwritten' ELSE 'kept' END AS action) a)
"""

# --- places ----------------------------------------------------------------


def _located(statements: DataFrame) -> DataFrame:
    rows = statements.drop("there")
    there = statements.where("there").drop("there", "arrival")
    out = places.located(there, rows.join(statements.where("there").select("id"), "id", "left_anti"))
    return out.withColumn("latitude", F.round("latitude", 6))


_KM = "2 * 6371.0088 * atan2(sqrt(h), sqrt(greatest(1 - h, 0)))"
_H = "pow(sin(radians({q}.latitude - {p}.latitude) / 2), 2) + cos(radians({p}.latitude)) * cos(radians({q}.latitude)) * pow(sin(radians({q}.longitude - {p}.longitude) / 2), 2)".format(p="p", q="x")
_NEAR = f"({_KM.replace('h)', f'({_H}))').replace('1 - h', f'1 - ({_H})')} < 0.1)"
_SAME = f"(coalesce(p.address = x.address, true) AND coalesce({_NEAR}, true) AND (p.address = x.address IS NOT NULL OR {_NEAR} IS NOT NULL))".replace("p.address = x.address IS NOT NULL", "(p.address = x.address) IS NOT NULL")
_MEETS = "(p.valid_from IS NULL OR x.valid_until IS NULL OR p.valid_from < x.valid_until) AND (x.valid_from IS NULL OR p.valid_until IS NULL OR x.valid_from < p.valid_until)"
_FIELDS = "id, address, latitude, longitude, timezone, valid_from, valid_until"
_PLACES = f"""
WITH RECURSIVE lined AS (SELECT entity_id AS e, location_type_id AS k, row_number() OVER (PARTITION BY entity_id, location_type_id ORDER BY CASE WHEN there THEN 0 ELSE 1 END, id) AS n,
  {{{', '.join(f"'{c}': {c}" for c in _FIELDS.split(', '))}, 'statements': 1}} AS said FROM place_statements),
fold AS (
  SELECT e, k, n, [said] AS ps FROM lined WHERE n = 1
  UNION ALL
  SELECT f.e, f.k, l.n, CASE WHEN hit.i IS NOT NULL THEN
    list_transform(f.ps, lambda p, i: CASE WHEN i = hit.i THEN {{'id': p.id, 'address': coalesce(p.address, x.address), 'latitude': coalesce(p.latitude, x.latitude), 'longitude': coalesce(p.longitude, x.longitude), 'timezone': coalesce(p.timezone, x.timezone),
      'valid_from': CASE WHEN p.valid_from IS NOT NULL AND x.valid_from IS NOT NULL THEN least(p.valid_from, x.valid_from) END, 'valid_until': CASE WHEN p.valid_until IS NOT NULL AND x.valid_until IS NOT NULL THEN greatest(p.valid_until, x.valid_until) END, 'statements': p.statements + 1}} ELSE p END)
    ELSE list_append(list_transform(f.ps, lambda p: CASE WHEN x.valid_from IS NOT NULL AND p.valid_until IS NULL AND (p.valid_from IS NULL OR p.valid_from < x.valid_from)
      THEN {{'id': p.id, 'address': p.address, 'latitude': p.latitude, 'longitude': p.longitude, 'timezone': p.timezone, 'valid_from': p.valid_from, 'valid_until': x.valid_from, 'statements': p.statements}} ELSE p END), x) END
  FROM fold f JOIN lined l ON l.e = f.e AND l.k = f.k AND l.n = f.n + 1, LATERAL (SELECT l.said AS x) y,
    LATERAL (SELECT list_position(list_transform(f.ps, lambda p: {_SAME} AND {_MEETS}), true) AS i) h1, LATERAL (SELECT nullif(h1.i, 0) AS i) hit)
SELECT e AS entity_id, k AS location_type_id, p.id AS id, p.address AS address, round(p.latitude, 6) AS latitude, p.longitude AS longitude, p.timezone AS timezone, p.valid_from AS valid_from, p.valid_until AS valid_until, p.statements AS statements
FROM (SELECT e, k, unnest(ps) AS p FROM fold QUALIFY n = max(n) OVER (PARTITION BY e, k))
"""

# --- trash -----------------------------------------------------------------

_GONE = "fact_status_id IN (5, 6) OR (predicate IN ('located_in', 'has_order') AND confidence < 0.5)"


def _restored(facts: DataFrame, sources: DataFrame, dependencies: DataFrame) -> DataFrame:
    chosen = facts.where(_GONE).select("id")
    trash = trashcan.thrown_away(_with_depth(facts), sources, dependencies, chosen, at(NOW))
    back = trashcan.restored_all(facts.where(f"not ({_GONE})"), trash)
    parents = F.array_join(F.transform("parents", lambda p: F.concat(p["id"], F.when(p["is_positive"], "+").otherwise("-"))), ",")
    return back.select("id", "old_id", "fact_status_id", F.size("sources").cast("long").alias("n_sources"), parents.alias("parents"), F.round("confidence", 6).alias("confidence"))


_CLOSED = "(coalesce(a.valid_from, TIMESTAMP '0001-01-01') <= coalesce(b.valid_until, TIMESTAMP '9999-01-01') AND coalesce(b.valid_from, TIMESTAMP '0001-01-01') <= coalesce(a.valid_until, TIMESTAMP '9999-01-01'))"
_RESTORED = f"""
WITH gone AS (SELECT * FROM facts WHERE {_GONE}), left_ AS (SELECT * FROM facts WHERE NOT ({_GONE})),
met AS (SELECT DISTINCT a.id FROM gone a JOIN left_ b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND {_CLOSED} UNION SELECT a.id FROM gone a JOIN gone b ON a.subject_id = b.subject_id AND a.predicate = b.predicate AND b.id < a.id AND {_CLOSED}),
told AS (SELECT fact_id, count(*) AS n FROM sources GROUP BY 1),
up AS (SELECT child_fact_id AS id, string_agg(p.id || '~' || CASE WHEN is_positive THEN '+' ELSE '-' END, ',' ORDER BY p.id, is_positive) AS parents, sum(CASE WHEN is_positive THEN p.confidence ELSE -p.confidence END) AS total, count(*) AS n FROM dependencies JOIN gone p ON p.id = parent_fact_id GROUP BY 1)
SELECT g.id || '~' AS id, g.id AS old_id, CASE WHEN m.id IS NOT NULL THEN 3 WHEN fact_status_id IN (5, 6) THEN 1 ELSE fact_status_id END AS fact_status_id, coalesce(t.n, 0) AS n_sources, parents,
  round(CASE WHEN inferred THEN least(greatest(coalesce(total, 0) * 0.8 * CASE coalesce(u.n, 0) WHEN 0 THEN 0 WHEN 1 THEN 0.6 WHEN 2 THEN 0.75 WHEN 3 THEN 0.9 ELSE 1 END, 0), 0.95) ELSE confidence END, 6) AS confidence
FROM gone g LEFT JOIN met m ON m.id = g.id LEFT JOIN told t ON t.fact_id = g.id LEFT JOIN up u ON u.id = g.id
"""

# --- centrality ------------------------------------------------------------


def _kept_up(facts: DataFrame) -> DataFrame:
    """The located facts are counted; the others come as changes, and those that are superseded or forgotten change again."""
    first = facts.where("predicate = 'located_in'")
    there = centrality.brought_forward(first.sparkSession.createDataFrame([], "entity_id long, n long"), centrality.deltas(first.select("subject_id", "object_id", F.lit(None).cast("int").alias("old_status"), F.col("fact_status_id").alias("new_status"))))
    rest = facts.where("predicate <> 'located_in'")
    come = rest.select("subject_id", "object_id", F.lit(None).cast("int").alias("old_status"), F.lit(1).alias("new_status"))
    go = rest.select("subject_id", "object_id", F.lit(1).alias("old_status"), F.col("fact_status_id").alias("new_status"))
    counts = centrality.brought_forward(there, centrality.deltas(go.unionByName(come)))
    return counts.select("entity_id", "n", centrality.boost(F.col("n")).alias("centrality"))


# --- names -----------------------------------------------------------------

_TOKENS = r"list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_TIMES = "len(list_filter(range(1, len({w}) - len(p) + 2), lambda i: {w}[i : i + len(p) - 1] = p))"
_HITS = f"""
WITH names AS (SELECT DISTINCT asked, {_TOKENS.format('asked')} AS p FROM mentions),
tokens AS (SELECT e.id, entity_type_id, {_TOKENS.format('name')} AS a, coalesce(b, []) AS b FROM entities e LEFT JOIN (SELECT entity_id, flatten(list({_TOKENS.format('alias')} ORDER BY alias)) AS b FROM aliases GROUP BY 1) x ON x.entity_id = e.id),
texts AS (SELECT *, ' ' || array_to_string(a, ' ') || ' | ' || array_to_string(b, ' ') || ' ' AS t FROM tokens),
near AS (SELECT asked, p, id, entity_type_id, a, b FROM names JOIN texts ON len(p) > 0 AND contains(t, ' ' || array_to_string(p, ' ') || ' ')),
found AS (SELECT asked, id, entity_type_id, {_TIMES.format(w='a')} + {_TIMES.format(w='b')} AS f, len(a) + len(b) AS size FROM near),
n AS (SELECT asked, count(*) AS n FROM found WHERE f > 0 GROUP BY 1),
whole AS (SELECT count(*) AS total, avg(len(a) + len(b)) AS mean FROM tokens),
hits AS (SELECT asked, id, entity_type_id, round(-(CASE WHEN ln((total - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((total - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE)) END) * f * 2.2::DOUBLE / (f + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)), 9) AS rank
  FROM found JOIN n USING (asked), whole WHERE f > 0)"""
_SCORE = "least(greatest(-rank * 4, 0), 1)"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LOOKUPS = f"""{_HITS},
all_ AS (
  SELECT asked, e.id, e.entity_type_id, 1 AS kind, 1::DOUBLE AS score, 0::DOUBLE AS rank FROM names JOIN entities e ON {_FOLD.format('asked')} = {_FOLD.format('name')}
  UNION ALL SELECT asked, e.id, e.entity_type_id, 2, 1.1::DOUBLE, 0 FROM names JOIN aliases ON {_FOLD.format('asked')} = {_FOLD.format('alias')} JOIN entities e ON e.id = entity_id
  UNION ALL SELECT asked, id, entity_type_id, 3, {_SCORE}, rank FROM (SELECT * FROM hits WHERE rank <= -0.2 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY rank, id) <= 10)),
once AS (SELECT * FROM (SELECT * FROM all_ QUALIFY row_number() OVER (PARTITION BY asked, id ORDER BY kind) = 1))"""

# --- retrieval -------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_SPLIT = r"list_filter(string_split_regex({}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
_ONCE = "list_filter({0}, lambda z, i: list_position(list_transform({0}, lambda x: lower(x)), lower(z)) = i)"
_PLANS = f"""WITH plans AS (
  SELECT task_id, task, ({_ONCE.format("w")})[1 : 16] AS searches, ({_ONCE.format("s")})[1 : 8] AS salient
  FROM (SELECT task_id, task, w, list_filter(w, lambda x: len(x) >= 2 AND lower(x) NOT IN ({_STOP})) AS s FROM (SELECT task_id, task, {_SPLIT.format("regexp_replace(task, '[''’][sS]', ' ', 'g')")} AS w FROM tasks))),
asked_for AS (SELECT DISTINCT unnest(searches) AS asked FROM plans)"""
_FOUND = (
    _HITS.replace("FROM mentions", "FROM asked_for").replace("WITH names", _PLANS + ", names", 1)
    + """, best AS (SELECT asked, id, row_number() OVER (PARTITION BY asked ORDER BY rank, id) AS result FROM hits QUALIFY result <= 10),
met AS (SELECT task_id, step, result, e.id, name FROM (SELECT task_id, unnest(searches) AS asked, generate_subscripts(searches, 1) AS step FROM plans) JOIN best USING (asked) JOIN entities e ON e.id = best.id),
once AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY task_id, lower(name) ORDER BY step, result, id) = 1),
candidates AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY step, result, id) AS place, id, name FROM once QUALIFY place <= 12)"""
)
_EVIDENCE = (
    _FOUND
    + """, read AS (SELECT f.*, o.name AS object FROM facts f LEFT JOIN entities o ON o.id = f.object_id WHERE NOT pending AND fact_status_id NOT IN (5, 6) AND subject_id IN (SELECT id FROM candidates) QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, valid_from DESC NULLS LAST, f.id DESC) <= 200),
told AS (SELECT subject_id, predicate, object, object_literal, confidence, valid_from, valid_until, fact_status_id, inferred, count(DISTINCT r.id) AS n_facts, string_agg(DISTINCT source_type_id || ':' || raw_reference, ',' ORDER BY source_type_id || ':' || raw_reference) AS sources FROM read r LEFT JOIN sources s ON s.fact_id = r.id GROUP BY ALL)
SELECT task_id, subject_id AS entity_id, predicate, object, confidence, valid_from, n_facts, coalesce(sources, '') AS sources FROM (SELECT DISTINCT task_id, id FROM candidates) JOIN told ON subject_id = id"""
)
_MATCHES = (
    _PLANS
    + r""", asked AS (SELECT task_id, unnest(list_distinct(CASE WHEN len(salient) > 0 THEN list_transform(salient, lambda x: lower(x)) ELSE list_filter(string_split_regex(lower(task), '[^\p{L}\p{N}]+'), lambda w: w <> '') END)) AS term FROM plans),
lists AS (SELECT session_id, turn, list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM messages),
terms AS (SELECT session_id, turn, term, count(*) AS tf, any_value(len(w)) AS length FROM (SELECT *, unnest(w) AS term FROM lists) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY 1), whole AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM lists),
scored AS (SELECT task_id, session_id, turn, round(sum(CASE WHEN ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / mean))), 6) AS score
  FROM asked JOIN terms USING (term) JOIN df USING (term), whole GROUP BY 1, 2, 3)
SELECT task_id, session_id, turn, place, score FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, session_id, turn) AS place FROM scored) WHERE place <= 20"""
)


def _evidence(tasks: DataFrame, entities: DataFrame, aliases: DataFrame, facts: DataFrame, sources: DataFrame) -> DataFrame:
    found = retrieval.candidates(retrieval.planned(tasks), resolution.index(entities, aliases), entities)
    told = retrieval.evidence(found, facts, entities, sources)
    listed = F.array_join(F.array_sort(F.transform("sources", lambda s: F.concat(s["source_type_id"].cast("string"), F.lit(":"), s["raw_reference"]))), ",")
    return told.select("task_id", "entity_id", "predicate", "object", "confidence", "valid_from", F.size("fact_ids").cast("long").alias("n_facts"), listed.alias("sources"))


# --- recurrence ------------------------------------------------------------

_RULES = {0: "FREQ=MONTHLY;BYDAY=TU;BYSETPOS=2", 1: "BYMONTHDAY=-1", 2: "FREQ=MONTHLY;BYMONTHDAY=31", 3: "BYMONTH=2;BYMONTHDAY=29", 4: "BYDAY=FR;BYSETPOS=-1;BYMONTH=11", 5: "BYDAY=MO,TH", 6: "BYDAY=SA;BYSETPOS=5"}
_RULE = "CASE o_orderkey % 7 " + " ".join(f"WHEN {k} THEN '{r}'" for k, r in _RULES.items()) + " END"
_BASE, _AT = "CAST(trigger_at AS DATE)", f"TIMESTAMP '{NOW}'"
#: The day of a month m (its first) that rule r picks, from the list of the month's days.
_PICKED = """CASE r WHEN 0 THEN list_filter(days, lambda d: isodow(d) = 2)[2] WHEN 1 THEN days[-1] WHEN 2 THEN days[-1] WHEN 3 THEN days[least(29, len(days))] WHEN 4 THEN list_filter(days, lambda d: isodow(d) = 5)[-1] WHEN 6 THEN list_filter(days, lambda d: isodow(d) = 6)[5] ELSE {plain} END"""
_MONTH_DAYS = "list_transform(range(0, day(last_day({m}))), lambda k: CAST({m} + to_days(CAST(k AS INT)) AS DATE))"


def _candidate(month: str, plain: str) -> str:
    return f"(SELECT CAST({_PICKED.format(plain=plain)} AS TIMESTAMP) + (trigger_at - {_BASE}) FROM (SELECT {_MONTH_DAYS.format(m='m')} AS days, m FROM (SELECT CAST({month} AS DATE) AS m)))"


def _months(k: str) -> str:
    return _candidate(f"date_trunc('month', trigger_at) + to_months(CAST((months // step + {k}) * step AS INT))", f"days[least(day({_BASE}), len(days))]")


def _years(k: str) -> str:
    month = "CASE r WHEN 3 THEN 2 WHEN 4 THEN 11 ELSE month(trigger_at) END"
    return _candidate(f"date_trunc('year', trigger_at) + to_years(CAST((years // step + {k}) * step AS INT)) + to_months(CAST({month} - 1 AS INT))", f"CASE WHEN month(m) = 2 AND day({_BASE}) = 29 AND len(days) = 28 THEN days[-1] + 1 ELSE days[day({_BASE})] END")


_BY_RULE = f"""
WITH o AS (SELECT id, trigger_at, recurrence, step, id % 7 AS r, (year({_AT}) - year(trigger_at)) * 12 + month({_AT}) - month(trigger_at) AS months, year({_AT}) - year(trigger_at) AS years FROM overlays WHERE recurrence IN ('monthly', 'yearly')),
c AS (SELECT *, CASE WHEN recurrence = 'monthly' THEN {_months('0')} ELSE {_years('0')} END AS early, CASE WHEN recurrence = 'monthly' THEN {_months('1')} ELSE {_years('1')} END AS late FROM o)
SELECT id, CASE WHEN CASE WHEN recurrence = 'monthly' THEN months ELSE years END < 0 THEN trigger_at WHEN early < {_AT} THEN late ELSE early END AS next FROM c
"""


def _by_rule(overlays: DataFrame) -> DataFrame:
    rule = F.expr(_RULE.replace("o_orderkey", "id"))
    return overlays.where("recurrence in ('monthly', 'yearly')").select("id", recurrence.next_by_rule(F.col("trigger_at"), F.col("recurrence"), F.col("step"), at(NOW), rule).alias("next"))


# --- rankings and traversal ------------------------------------------------

_SCORED = f"SELECT subject_id, id, confidence AS score, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, id) AS rank FROM facts WHERE NOT pending AND fact_status_id NOT IN (5, 6)"


def _scored(facts: DataFrame) -> DataFrame:
    best = W.partitionBy("subject_id").orderBy(F.desc("confidence"), "id")
    return facts.where("not pending and fact_status_id not in (5, 6)").select("subject_id", "id", F.col("confidence").alias("score"), F.row_number().over(best).alias("rank"))


def _changed(facts: DataFrame) -> DataFrame:
    """Subjects whose first twenty facts differ from those without the inferred ones."""
    return ranking.changed(ranking.digests(_scored(facts), "subject_id"), ranking.digests(_scored(facts.where("not inferred")), "subject_id"), "subject_id")


_DIGEST = "SELECT subject_id, md5(string_agg(id || ':' || CAST(round(score * 1000000) AS BIGINT), ',' ORDER BY rank)) AS digest FROM ({}) WHERE rank <= 20 GROUP BY 1"


def _traversed(facts: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    return graph.traversed(facts, entities.select(F.col("id").alias("root")), 3, 6)


def _traversal_sql(select: str) -> str:
    sql = "WITH live AS (SELECT * FROM facts WHERE NOT pending AND fact_status_id NOT IN (5, 6)), seen0 AS (SELECT DISTINCT id AS root, id AS node FROM entities), front0 AS (SELECT * FROM seen0)"
    for k in range(3):
        sql += f""",
edges{k} AS (SELECT f.root, {k} AS depth, row_number() OVER (PARTITION BY f.root ORDER BY confidence DESC, l.id) AS nth, l.id AS fact_id, subject_id, predicate, object_id, object_literal, confidence, room FROM front{k} f JOIN (SELECT root, 6 - count(*) AS room FROM seen{k} GROUP BY 1) r ON r.root = f.root AND room > 0 JOIN live l ON l.subject_id = f.node QUALIFY nth <= 2 * room),
front{k + 1} AS (SELECT root, node FROM (SELECT e.root, object_id AS node, min(nth) AS first, any_value(room) AS room FROM edges{k} e WHERE object_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM seen{k} s WHERE s.root = e.root AND s.node = object_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY root ORDER BY first) <= room),
seen{k + 1} AS (SELECT * FROM seen{k} UNION ALL SELECT * FROM front{k + 1})"""
    return sql + ", edges AS (SELECT * EXCLUDE room FROM edges0 UNION ALL SELECT * EXCLUDE room FROM edges1 UNION ALL SELECT * EXCLUDE room FROM edges2) " + select


# --- ingest ----------------------------------------------------------------


def _incoming(rows: DataFrame) -> DataFrame:
    return rows.withColumn("categories", F.array("category"))


def _normalized(rows: DataFrame, vocabulary: DataFrame, categories: DataFrame) -> DataFrame:
    out = ingest.normalized(_incoming(rows), vocabulary, categories, at(NOW))
    return out.select("arrival", "outcome", "predicate", F.array_join("categories", ",").alias("categories"), F.round("confidence", 6).alias("confidence"), "fact_status_id", "pending", "valid_from")


_KEY = "replace(lower(trim({})), ' ', '_')"
_NORMAL = f"""WITH words AS (SELECT {_KEY.format('name')} AS k, name, default_category FROM vocabulary WHERE emit_eligible UNION SELECT {_KEY.format('alias')}, name, default_category FROM vocabulary WHERE emit_eligible),
met AS (SELECT i.*, w.name AS canonical, CASE WHEN category IN (SELECT id FROM categories) THEN category ELSE default_category END AS c FROM incoming i LEFT JOIN words w ON w.k = {_KEY.format('predicate')}),
judged AS (SELECT *, CASE WHEN canonical IS NULL THEN 'staged' WHEN connector_id IS NOT NULL AND raw_reference IS NULL THEN 'refused'
  WHEN flagged AND (c IN (150, 180, 230, 300, 310, 320, 330, 340, 370, 390, 420, 670) OR regexp_matches(lower(object), '(^|[^a-z0-9])loan($|[^a-z0-9])')) THEN 'pending' ELSE 'insert' END AS outcome FROM met)"""

# --- memory as text --------------------------------------------------------


def _memory_text(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """The five best facts of each subject, put into buckets by the length of their predicate."""
    names = entities.select(F.col("id").alias("subject_id"), F.col("name").alias("subject"))
    objects = entities.select(F.col("id").alias("object_id"), F.col("name").alias("object"))
    rows = _scored(facts).where("rank <= 5").select("id", "rank").join(facts, "id").join(names, "subject_id").join(objects, "object_id", "left")
    line = prose.fact_line(F.col("subject"), F.col("predicate"), F.coalesce("object", "object_literal"), F.col("valid_from"), F.col("valid_until"))
    return prose.rendered(rows.select("subject_id", (F.length("predicate") % 5 + 1).alias("bucket"), "rank", line.alias("line")))


_SPOKEN = "CASE predicate " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in prose.SAID.items()) + " ELSE replace(predicate, '_', ' ') END"
_WINDOW = "CASE WHEN {a} IS NOT NULL THEN concat({f}, ' → ', coalesce({u}, '...')) WHEN {b} IS NOT NULL THEN concat('→ ', {u}) ELSE '' END"


def _window_sql(a: str, b: str) -> str:
    return _WINDOW.format(a=a, b=b, f=f"strftime({a}, '%Y-%m-%dT%H:%M:%SZ')", u=f"strftime({b}, '%Y-%m-%dT%H:%M:%SZ')")


_UPCOMING = f"""
WITH n AS (SELECT TIMESTAMP '{NOW}' AS now, TIMESTAMP '{NOW}' + INTERVAL 60 DAY AS until),
said AS (SELECT f.*, s.name AS subject, coalesce(o.name, object_literal, '') AS object FROM facts f JOIN entities s ON s.id = subject_id LEFT JOIN entities o ON o.id = object_id),
once AS (SELECT subject_id AS whose, f.id, subject, predicate, object, valid_from AS t, valid_until, 0 AS kind FROM said f LEFT JOIN overlays e ON e.fact_id = f.id, n WHERE NOT pending AND fact_status_id NOT IN (5, 6) AND confidence >= 0.5 AND valid_from BETWEEN now AND until AND (e.id IS NULL OR (status IN ('pending', 'active', 'snoozed') AND recurrence = 'none'))),
again AS (SELECT e.entity_id AS whose, f.id, subject, predicate, object, trigger_at AS t, valid_until, 1 AS kind FROM overlays e JOIN said f ON f.id = e.fact_id, n WHERE status = 'active' AND recurrence <> 'none' AND trigger_at BETWEEN now AND until AND fact_status_id NOT IN (5, 6)),
both_ AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY whose ORDER BY t, id) <= 3 UNION ALL SELECT * FROM again QUALIFY row_number() OVER (PARTITION BY whose ORDER BY t, id) <= 3)
SELECT whose AS subject_id, id, place, concat('- ', subject, ' ', replace(predicate, '_', ' '), ' ', object, ' (', {_window_sql('t', 'valid_until')}, ', ', strftime(t, '%d %B'), ', ', CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'in 1 day' ELSE concat('in ', d, ' days') END, ')') AS line
FROM (SELECT *, row_number() OVER (PARTITION BY whose ORDER BY t, kind, id) AS place, date_diff('day', CAST(now AS DATE), CAST(t AS DATE)) AS d FROM both_, n) WHERE place <= 3"""

# --- rendering and parsing -------------------------------------------------

_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
#: A kind of connector, and an explicit confidence, by the length of a reference.
_KIND = "CASE length(raw_reference) % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'calendar' WHEN 2 THEN 'photos' WHEN 3 THEN 'linkedin' END"
_SAID = "CASE WHEN length(raw_reference) % 7 = 0 THEN 0.42 END"


QUERIES: dict[str, Query] = {
    "g08_inference": on_views(
        "facts rings",
        lambda f, r: inference.infer(_all_places(f, r)).select("subject_id", "object_id", "valid_from", "valid_until", F.round("confidence", 6).alias("confidence"), "depth", "first", "second", "turn"),
        _inference_sql("SELECT subject_id, object_id, valid_from, valid_until, round(confidence, 6) AS confidence, depth, first, second, turn FROM found"),
    ),
    "g07_deep_cascade": on_views("facts rings", lambda f, r: _deep_cascade(f, r).select("id", F.round("confidence", 6).alias("confidence")), _deep_cascade_sql()),
    "i12_preference_upsert": on_views("preference_writes contexts", lambda w, c: _upserted(w, c).select("id", "action", "preference_id", "old_value", "new_value", "reason"), _PREFERENCE_STEPS + "SELECT id, action, pid AS preference_id, old AS old_value, new AS new_value, reason FROM steps WHERE NOT there"),
    "i12_preference_audit": on_views(
        "preference_writes contexts",
        lambda w, c: preferences.preference_audit(_upserted(w, c)).drop("arrival"),
        _PREFERENCE_STEPS + "SELECT pid AS preference_id, CASE action WHEN 'created' THEN 'created' ELSE 'confidence_change' END AS change, CASE WHEN action <> 'created' THEN old END AS old_value, new AS new_value, nullif(reason, '') AS reason FROM steps WHERE reason IS NOT NULL",
    ),
    "i42_preferences_after": on_views(
        "preference_writes contexts",
        _preferences_after,
        _PREFERENCE_STEPS + "SELECT pid AS preference_id, nullif(e, -1) AS entity_id, key, held AS value, c AS confidence, x AS overridden_by_user, CASE WHEN holder IN (SELECT id FROM lined WHERE there) THEN NULL ELSE holder END AS written_by FROM (SELECT * FROM steps QUALIFY n = max(n) OVER (PARTITION BY e, key, s)) WHERE pid IS NOT NULL",
    ),
    "i14_location_upsert": on_views("place_statements", _located, _PLACES),
    "i15_place_anchor": on_views(
        "locations place_statements",
        lambda p, s: places.anchored(p.withColumn("source_fact_id", F.lit(None).cast("string")), s.where("latitude is not null").select("entity_id", "latitude", "longitude", F.concat(F.lit("o"), F.col("id").cast("string")).alias("source_fact_id"), "arrival")),
        "SELECT entity_id, latitude, longitude, NULL AS source_fact_id FROM locations WHERE entity_id NOT IN (SELECT entity_id FROM place_statements WHERE latitude IS NOT NULL) UNION ALL SELECT entity_id, latitude, longitude, 'o' || id FROM place_statements WHERE latitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY arrival DESC) = 1",
    ),
    "i25_restore_all": on_views("facts sources dependencies", _restored, _RESTORED),
    "a07_centrality_kept_up": on_views(
        "facts",
        _kept_up,
        "SELECT id AS entity_id, count(*) AS n, 1 + least(count(*), 50) / CAST(50 AS DOUBLE) AS centrality FROM (SELECT subject_id AS id FROM facts WHERE fact_status_id NOT IN (5, 6) UNION ALL SELECT object_id FROM facts WHERE fact_status_id NOT IN (5, 6) AND object_id IS NOT NULL) GROUP BY id",
    ),
    "f04_lookup": on_views(
        "entities aliases mentions",
        lambda e, a, m: resolution.lookups(e, a, m).withColumn("score", F.round("score", 6)),
        _LOOKUPS + " SELECT asked, id, kind, round(score, 6) AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY score DESC, kind, rank, id) AS place FROM once) WHERE place <= 10",
    ),
    "f05_typed_lookup": on_views(
        "entities aliases mentions",
        lambda e, a, m: resolution.lookups(e, a, m, typed=True).withColumn("score", F.round("score", 6)),
        _LOOKUPS + " SELECT asked, wanted, id, kind, round(score, 6) AS score, place FROM (SELECT o.*, m.entity_type_id AS wanted, row_number() OVER (PARTITION BY o.asked, m.entity_type_id ORDER BY score DESC, kind, rank, o.id) AS place FROM once o JOIN mentions m ON m.asked = o.asked AND m.entity_type_id = o.entity_type_id) WHERE place <= 10",
    ),
    "f06_entity_search": on_views(
        "entities aliases mentions",
        lambda e, a, m: resolution.searched(resolution.index(e, a), m, 20).select("asked", "id", "place", F.round("score", 6).alias("score")),
        _HITS + f" SELECT asked, id, place, round({_SCORE}, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY rank, id) AS place FROM hits) WHERE place <= 20",
    ),
    "f07_resolution": on_views(
        "entities aliases mentions",
        resolution.resolved,
        _LOOKUPS + " SELECT m.asked, m.entity_type_id AS wanted, id, kind FROM mentions m LEFT JOIN (SELECT o.* FROM once o JOIN mentions m ON m.asked = o.asked AND m.entity_type_id = o.entity_type_id QUALIFY row_number() OVER (PARTITION BY o.asked, o.entity_type_id ORDER BY score DESC, kind, rank, o.id) = 1) b ON b.asked = m.asked AND b.entity_type_id = m.entity_type_id AND (kind < 3 OR score >= 0.9)",
    ),
    "f03_entities_with_facts": on_views(
        "entities aliases mentions facts",
        lambda e, a, m, f: resolution.with_top_facts(resolution.searched(resolution.index(e, a), m, 10), f, e).select("asked", "id", "place", F.array_join(F.transform("facts", lambda x: F.concat(x["fact_id"], F.lit(" "), F.coalesce(x["object"], F.lit("")))), "; ").alias("facts")),
        _HITS + """, best AS (SELECT asked, id, place FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY rank, id) AS place FROM hits) WHERE place <= 10),
top AS (SELECT f.*, row_number() OVER (PARTITION BY subject_id ORDER BY confidence DESC, f.id) AS nth FROM facts f WHERE NOT pending AND fact_status_id NOT IN (5, 6) QUALIFY nth <= 5),
lists AS (SELECT subject_id, string_agg(t.id || ' ' || coalesce(name, object_literal, ''), '; ' ORDER BY nth) AS facts FROM top t LEFT JOIN entities o ON o.id = object_id GROUP BY 1)
SELECT asked, id, place, facts FROM best LEFT JOIN lists ON subject_id = id""",
    ),
    "f11_candidates": on_views(
        "tasks entities aliases",
        lambda t, e, a: retrieval.candidates(retrieval.planned(t), resolution.index(e, a), e),
        _FOUND + " SELECT task_id, place, id, name FROM candidates",
    ),
    "f11_messages": on_views("tasks messages", lambda t, m: retrieval.matching_messages(retrieval.planned(t), m, ["session_id", "turn"], "content"), _MATCHES),
    "u05_evidence": on_views("tasks entities aliases facts sources", _evidence, _EVIDENCE),
    "d02_next_by_rule": on_views("overlays", _by_rule, _BY_RULE),
    "n07_category_guide": on_views(
        "categories",
        lambda c: graph.in_tree_order(c).select("id", "depth", "line", F.array_join("place", "/").alias("place")),
        "SELECT id, 0 AS depth, concat(id, ' ', name) AS line, CAST(id AS VARCHAR) AS place FROM categories WHERE parent_id IS NULL UNION ALL SELECT c.id, 1, concat('  ', c.id, ' ', c.name), concat(parent_id, '/', c.id) FROM categories c WHERE parent_id IS NOT NULL",
    ),
    "m07_changed_rankings": on_views("facts", _changed, f"SELECT coalesce(n.subject_id, l.subject_id) AS subject_id, n.digest FROM ({_DIGEST.format(_SCORED)}) n FULL JOIN ({_DIGEST.format(_SCORED + ' AND NOT inferred')}) l ON l.subject_id = n.subject_id WHERE n.digest IS DISTINCT FROM l.digest"),
    "a22_ranking_quality": on_views(
        "facts entities categories fact_categories",
        lambda f, e, c, fc: ranking.at_k(memory.ranked_memory(f, e, c, fc, at(NOW), 0.5, 5), _scored(f).where("rank <= 3"), "subject_id").select("subject_id", "hits", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision")),
        f"""WITH t AS (SELECT subject_id, id FROM ({_SCORED}) WHERE rank <= 3), c AS (SELECT id, 1 + least(count(*), 50) / CAST(50 AS DOUBLE) AS centrality FROM (SELECT subject_id AS id FROM facts WHERE fact_status_id NOT IN (5, 6) UNION ALL SELECT object_id FROM facts WHERE fact_status_id NOT IN (5, 6) AND object_id IS NOT NULL) GROUP BY id),
w AS (SELECT fact_id, max(memory_weight) AS weight FROM fact_categories JOIN categories ON category_id = categories.id GROUP BY fact_id),
s AS (SELECT f.subject_id, f.id, round(confidence * coalesce(weight, 0.5::DOUBLE) * CASE WHEN valid_from > {_AT} THEN 10 / sqrt(greatest((floor(epoch(valid_from)) - epoch({_AT})) / 86400, 0.5)) ELSE 1 END * coalesce(centrality, 1), 9) AS score FROM facts f LEFT JOIN w ON f.id = w.fact_id LEFT JOIN c ON c.id = f.subject_id WHERE NOT pending AND fact_status_id NOT IN (5, 6) AND confidence >= 0.5),
r AS (SELECT subject_id, id FROM s QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY score DESC, id) <= 5),
b AS (SELECT coalesce(r.subject_id, t.subject_id) AS subject_id, r.id AS got, t.id AS want FROM r FULL JOIN t ON t.subject_id = r.subject_id AND t.id = r.id)
SELECT subject_id, count(*) FILTER (WHERE got = want) AS hits, round(CASE WHEN count(want) = 0 THEN 1 ELSE count(*) FILTER (WHERE got = want) / count(want)::DOUBLE END, 6) AS recall, round(count(*) FILTER (WHERE got = want) / greatest(count(got), 1)::DOUBLE, 6) AS precision FROM b GROUP BY 1""",
    ),
    "g01_traverse": on_views("facts entities", lambda f, e: _traversed(f, e)[0], _traversal_sql("SELECT * FROM edges")),
    "g01_summary": on_views("facts entities", lambda f, e: _traversed(f, e)[1], _traversal_sql("SELECT root, coalesce(d, 0) AS max_depth_reached, n AS nodes_found FROM (SELECT root, count(*) AS n FROM seen3 GROUP BY 1) LEFT JOIN (SELECT root, max(depth) + 1 AS d FROM edges GROUP BY 1) USING (root)")),
    "j12_contradicting": on_views(
        "facts contradictions",
        joins.contradicting,
        "SELECT DISTINCT a, b, CASE WHEN x.inferred AND NOT y.inferred THEN b WHEN y.inferred AND NOT x.inferred THEN a END AS kept FROM (SELECT least(parent_fact_id, child_fact_id) AS a, greatest(parent_fact_id, child_fact_id) AS b FROM contradictions) p JOIN facts x ON x.id = a AND x.fact_status_id = 3 JOIN facts y ON y.id = b AND y.fact_status_id = 3",
    ),
    "o03_resolved": on_views(
        "facts contradictions",
        lambda f, c: joins.resolved_contradictions(joins.contradicting(f, c)),
        """WITH p AS (SELECT DISTINCT x.id AS a, y.id AS b, x.inferred AS i, y.inferred AS j FROM contradictions JOIN facts x ON x.id = parent_fact_id AND x.fact_status_id = 3 JOIN facts y ON y.id = child_fact_id AND y.fact_status_id = 3 WHERE x.inferred <> y.inferred)
SELECT id, max(CASE WHEN inferred THEN 5 ELSE 1 END) AS fact_status_id FROM (SELECT a AS id, i AS inferred FROM p UNION ALL SELECT b, j FROM p) GROUP BY 1""",
    ),
    "r48_transcript": on_views("messages", lambda m: m.select("session_id", "turn", render.transcript_line(F.col("role"), F.col("content")).alias("line")).where("line is not null"), f"SELECT session_id, turn, concat(role, ': ', replace(replace(t, chr(13), '\\r'), chr(10), '\\n')) AS line FROM (SELECT *, {_TRIM.format('content')} AS t FROM messages) WHERE t <> ''"),
    "n05_category_numbers": on_views("categories fact_categories", lambda c, fc: fc.groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("category_id").cast("string"))), ",").alias("l")).select("fact_id", F.aggregate(render.int_list("l"), F.lit(0), lambda a, x: a + x).cast("long").alias("total")), "SELECT fact_id, CAST(sum(category_id) AS BIGINT) AS total FROM fact_categories GROUP BY 1"),
    "x06_initial_confidence": on_views(
        "sources",
        lambda s: s.select("fact_id", "raw_reference", render.initial_confidence(F.col("source_type_id"), F.expr(_KIND), F.expr(_SAID).cast("double")).alias("confidence")),
        f"SELECT fact_id, raw_reference, CAST(coalesce({_SAID}, CASE source_type_id WHEN 1 THEN 1 WHEN 6 THEN 1 WHEN 4 THEN 0.3 WHEN 5 THEN 0.8 WHEN 2 THEN CASE {_KIND} WHEN 'email' THEN 0.85 WHEN 'calendar' THEN 0.9 WHEN 'photos' THEN 0.8 WHEN 'linkedin' THEN 0.75 ELSE 0.8 END ELSE 0 END) AS DOUBLE) AS confidence FROM sources",
    ),
    "x18_split_objects": on_views(
        "messages",
        lambda m: m.select("session_id", "turn", F.posexplode(render.split_objects(F.expr("case when turn % 2 = 0 then 'hobby' else 'visited' end"), F.col("content"))).alias("place", "part")),
        f"SELECT session_id, turn, (row_number() OVER (PARTITION BY session_id, turn ORDER BY k) - 1)::INT AS place, part FROM (SELECT session_id, turn, k, {_TRIM.format('p')} AS part FROM (SELECT session_id, turn, unnest(string_split(content, ',')) AS p, generate_subscripts(string_split(content, ','), 1) AS k FROM messages WHERE turn % 2 = 0 AND contains(content, ','))) WHERE part <> '' UNION ALL SELECT session_id, turn, 0, content FROM messages WHERE turn % 2 <> 0 OR NOT contains(content, ',')",
    ),
    "x19_snapshot": on_views(
        "facts",
        lambda f: f.select("id", render.snapshot(F.col("id"), F.col("confidence"), F.col("fact_status_id"), F.col("valid_from"), F.col("valid_until")).alias("snapshot")),
        f"""SELECT id, concat('{{"fact_id":"', id, '","confidence":', confidence, ',"fact_status_id":', fact_status_id, ',"valid_from":', coalesce('"' || {_ISO.format('valid_from')} || '"', 'null'), ',"valid_until":', coalesce('"' || {_ISO.format('valid_until')} || '"', 'null'), '}}') AS snapshot FROM facts""",
    ),
    "d14_bounds": on_views(
        "facts",
        lambda f: f.select("id", render.bounds(F.col("valid_from"), F.col("valid_until")).alias("bounds")),
        f"SELECT id, CASE WHEN valid_from IS NOT NULL AND valid_until IS NOT NULL THEN concat({_ISO.format('valid_from')}, ' → ', {_ISO.format('valid_until')}) WHEN valid_from IS NOT NULL THEN concat({_ISO.format('valid_from')}, ' → ...') WHEN valid_until IS NOT NULL THEN concat('→ ', {_ISO.format('valid_until')}) ELSE '' END AS bounds FROM facts",
    ),
    "f01_phrases": on_views("messages", lambda m: m.select("session_id", "turn", render.phrase(F.col("content")).alias("phrase")).where("phrase is not null"), f"""SELECT session_id, turn, concat('"', t, '"') AS phrase FROM (SELECT session_id, turn, {_TRIM.format("replace(replace(content, chr(34), chr(34) || chr(34)), '*', ' ')")} AS t FROM messages) WHERE t <> ''"""),
    "f12_catalogue_all": on_views(
        "facts fact_categories categories",
        lambda f, fc, c: aggregates.catalogue(f, fc, c.where("parent_id is not null").select(F.col("id").alias("ask_id"), F.explode(F.array("id", "parent_id")).alias("category_id")), True, 80).withColumn("categories", F.array_join("categories", ",")),
        """WITH l AS (SELECT fact_id, list_sort(list(DISTINCT category_id)) AS c FROM fact_categories GROUP BY 1)
SELECT ask_id, rank, fact_id, array_to_string(c, ',') AS categories FROM (SELECT k.id AS ask_id, f.id AS fact_id, c, row_number() OVER (PARTITION BY k.id ORDER BY confidence DESC, f.id) AS rank FROM categories k JOIN l ON list_contains(c, k.id) AND list_contains(c, k.parent_id) JOIN facts f ON f.id = fact_id WHERE NOT pending AND fact_status_id NOT IN (5, 6)) WHERE rank <= 50""",
    ),
    "f12_catalogue_any": on_views(
        "facts fact_categories categories",
        lambda f, fc, c: aggregates.catalogue(f, fc, c.where("parent_id is not null").select(F.col("id").alias("ask_id"), F.explode(F.array("id", "parent_id")).alias("category_id")), False, 20).withColumn("categories", F.array_join("categories", ",")),
        """WITH l AS (SELECT fact_id, list_sort(list(DISTINCT category_id)) AS c FROM fact_categories GROUP BY 1)
SELECT ask_id, rank, fact_id, array_to_string(c, ',') AS categories FROM (SELECT k.id AS ask_id, f.id AS fact_id, c, row_number() OVER (PARTITION BY k.id ORDER BY confidence DESC, f.id) AS rank FROM categories k JOIN l ON (list_contains(c, k.id) OR list_contains(c, k.parent_id)) JOIN facts f ON f.id = fact_id WHERE k.parent_id IS NOT NULL AND NOT pending AND fact_status_id NOT IN (5, 6)) WHERE rank <= 20""",
    ),
    "p15_sensitive_facts": on_views(
        "facts fact_categories",
        lambda f, fc: f.join(fc.groupBy(F.col("fact_id").alias("id")).agg(F.collect_set(F.col("category_id") * 10 - 900).alias("numbers")), "id", "left").where(predicates.is_sensitive(F.col("confidence") < 0.6, F.col("numbers"), F.col("object_literal"))).select("id"),
        "SELECT id FROM facts WHERE confidence < 0.6::DOUBLE AND id IN (SELECT fact_id FROM fact_categories WHERE category_id * 10 - 900 IN (150, 180, 230, 300, 310, 320, 330, 340, 370, 390, 420, 670))",
    ),
    "i01_normalized": on_views(
        "incoming vocabulary categories",
        _normalized,
        _NORMAL + f""" SELECT arrival, outcome, coalesce(canonical, predicate) AS predicate, coalesce(CAST(c AS VARCHAR), '') AS categories,
  round(least(greatest(coalesce(confidence, CASE WHEN source_type_id = 2 THEN CASE connector WHEN 'email' THEN 0.85 WHEN 'calendar' THEN 0.9 ELSE 0.8 END ELSE CASE source_type_id WHEN 3 THEN 0 WHEN 4 THEN 0.3 WHEN 5 THEN 0.8 ELSE 1 END END), 0), 1), 6)::DOUBLE AS confidence,
  CASE outcome WHEN 'pending' THEN 3 WHEN 'insert' THEN 1 END AS fact_status_id, outcome = 'pending' AS pending,
  CASE WHEN correction AND scope IS NULL THEN {_AT} WHEN correction AND scope <> 'always' THEN coalesce(TRY_CAST(scope AS TIMESTAMP), valid_from) ELSE valid_from END AS valid_from FROM judged""",
    ),
    "i29_staged": on_views(
        "incoming vocabulary",
        lambda i, v: ingest.staged(ingest.known_predicates(i, v).where("canonical is null").withColumn("payload", F.col("object")), i.where("false").selectExpr("arrival as stage_id", "connector_id", "raw_reference", "predicate", "object as payload")).select("stage_id", "arrival", "newly_staged", "status"),
        _NORMAL + " SELECT min(arrival) OVER w AS stage_id, arrival, arrival = min(arrival) OVER w AS newly_staged, 'unmapped' AS status FROM met WHERE canonical IS NULL WINDOW w AS (PARTITION BY coalesce(connector_id, -1), coalesce(raw_reference, ''), predicate, object)",
    ),
    "i08_corrected": on_views(
        "facts incoming vocabulary categories",
        lambda f, i, v, c: ingest.corrected(f, ingest.normalized(_incoming(i), v, c, at(NOW)).where("correction and scope = 'always' and outcome = 'insert'")),
        _NORMAL + ", said AS (SELECT * FROM judged WHERE correction AND scope = 'always' AND outcome = 'insert') SELECT id FROM facts f WHERE fact_status_id = 1 AND EXISTS (SELECT 1 FROM said s WHERE s.subject_id = f.subject_id AND s.canonical = f.predicate AND (f.valid_from IS NULL OR s.valid_until IS NULL OR f.valid_from < s.valid_until) AND (s.valid_from IS NULL OR f.valid_until IS NULL OR s.valid_from < f.valid_until))",
    ),
    "i10_confirmed": on_views(
        "facts",
        lambda f: ingest.confirmed(f, f.where("predicate = 'located_in'").select("id")).select("id", "fact_status_id", "confidence", "error"),
        "SELECT id, CASE WHEN pending THEN 1 ELSE fact_status_id END AS fact_status_id, CASE WHEN pending THEN 1 ELSE confidence END AS confidence, CASE WHEN NOT pending THEN 'not awaiting confirmation' END AS error FROM facts WHERE predicate = 'located_in'",
    ),
    "m04_memory_text": on_views(
        "facts entities",
        _memory_text,
        f"""WITH best AS (SELECT id, rank FROM ({_SCORED}) WHERE rank <= 5),
lines AS (SELECT f.subject_id, length(predicate) % 5 + 1 AS bucket, rank, concat(s.name, ' ', {_SPOKEN}, ' ', coalesce(o.name, object_literal, ''), CASE WHEN valid_from IS NOT NULL OR valid_until IS NOT NULL THEN concat(' (', {_window_sql('valid_from', 'valid_until')}, ')') ELSE '' END, '.') AS line
  FROM best JOIN facts f USING (id) JOIN entities s ON s.id = f.subject_id LEFT JOIN entities o ON o.id = f.object_id),
texts AS (SELECT subject_id, bucket, concat(CASE bucket WHEN 2 THEN 'Relationships: ' WHEN 3 THEN 'Preferences: ' WHEN 4 THEN 'Upcoming: ' WHEN 5 THEN 'General: ' ELSE '' END, string_agg(line, ' ' ORDER BY rank)) AS t FROM lines GROUP BY 1, 2)
SELECT subject_id, string_agg(t, chr(10) ORDER BY bucket) AS memory FROM texts GROUP BY 1""",
    ),
    "u04_coming_up": on_views("facts entities overlays", lambda f, e, o: prose.coming_up(f, e, o, at(NOW), 60, 3), _UPCOMING),
    "d15_flexible_dates": on_views(
        "dated",
        lambda d: d.select("id", dates.flexible_date(F.col("written")).alias("read")),
        "SELECT id, CAST(CASE WHEN form = 0 THEN day WHEN form IN (1, 2) THEN day + to_seconds(29350) WHEN form IN (3, 5) THEN date_trunc('month', day) WHEN form = 4 THEN date_trunc('year', day) WHEN form = 7 THEN day + to_seconds(22150) END AS TIMESTAMP) AS read FROM dated",
    ),
}
