"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempograph.llm import bpe, decontam, idfile, phrases, prefixtrie, quality, shards, simhash, substr, tokcount, toxicity, tsmedia, warc
from tempograph.llm.common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": lambda s, d: decontam.op1(table(s, d, "documents"), table(s, d, "benchmark")),
        "op2_bpe": lambda s, d: bpe.op2(table(s, d, "documents")),
        "op3_simhash": lambda s, d: simhash.op3(table(s, d, "documents")),
        "op4_token_file": lambda s, d: idfile.op4(table(s, d, "documents")),
        "op5_toxicity": lambda s, d: toxicity.op5(table(s, d, "documents"), table(s, d, "labels")),
        "op6_substrings": lambda s, d: substr.op6(table(s, d, "documents")),
        "op7_token_counts": lambda s, d: tokcount.op7(table(s, d, "documents")),
        "op8_sharding": lambda s, d: shards.op8(table(s, d, "documents")),
        "op9_warc": lambda s, d: warc.op9(table(s, d, "pages")),
        "op10_media": lambda s, d: tsmedia.op10(table(s, d, "documents")),
        "op11_prefix_trie": lambda s, d: prefixtrie.op11(table(s, d, "conversations")),
        "op12_phrases": lambda s, d: phrases.op12(table(s, d, "documents")),
        "op13_quality": lambda s, d: quality.op13(table(s, d, "documents"), table(s, d, "labels")),
    }


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1 = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM documents),
items AS (SELECT item_id, {_WORDS.format(_LOWER.format("text"))} AS w FROM benchmark),
windows AS (
  SELECT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM items, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
hits AS (
  SELECT d.doc_id, d.i, d.n, x.item_id
  FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM docs, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)) d
  JOIN (SELECT DISTINCT item_id, n, g FROM windows) x USING (n, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP6 = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i : i + 49], ' ') AS g FROM docs, unnest(range(1, len(w) - 48)) AS t(i) WHERE len(w) >= 50),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
gone AS (SELECT DISTINCT doc_id, p FROM windows JOIN firsts USING (g), unnest(range(i, i + 50)) AS t(p) WHERE first < doc_id),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k
  FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs) x ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM docs LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, {5 * k + 1}, 5))::BIGINT >> {s}) & 31) + 1)::BIGINT, 1)" for k in range(8) for s in (15, 10, 5, 0))

_OP9 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
r AS (SELECT html, max(page_id) AS response FROM p GROUP BY html)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM p JOIN r USING (html)
"""

_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda r, b: list_reduce(list_prepend(xor(r, b), repeat([0::BIGINT], 8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"

_OP11 = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS s FROM turns GROUP BY conv_id),
hashed AS (SELECT conv_id, s, {_CRC} % 9 AS h FROM own),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(p.s, [])[1 : c.h], c.s[c.h + 1 :]) AS s FROM hashed c LEFT JOIN own p ON p.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, d AS depth, s[1 : d] AS prefix, len(s) = d AS ends FROM rebuilt, unnest(range(0, len(s) + 1)) AS t(d)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
    CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(prefix[-1].text) ELSE 0 END AS cost
  FROM prefixes GROUP BY prefix, depth),
tops AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1 : n.depth - 1]),
children AS (SELECT parent_conv_id, depth - 1 AS depth, count(*) AS n_children FROM tops WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT t.*, coalesce(n_children, 0) AS n_children FROM tops t LEFT JOIN children c ON c.parent_conv_id = t.conv_id AND c.depth = t.depth),
above AS (SELECT n_children, cost, d AS depth, prefix[1 : d] AS prefix FROM counted, unnest(range(0, depth + 1)) AS t(d)),
sums AS (SELECT prefix, depth, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(cost) AS saved FROM above GROUP BY prefix, depth)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, ends_sha256 FROM counted JOIN sums USING (prefix, depth)
"""

_OP12 = r"""
WITH texts AS (SELECT row_number() OVER () AS t, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
split AS (SELECT t, lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
pieces AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM split),
totals AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM pieces, unnest(range(1, 6)) AS s(m), unnest(range(1, len(w) - m + 2)) AS p(i)),
f AS (SELECT lang, m, phrase, count(*)::HUGEINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
longs AS (SELECT * FROM f WHERE m > 1),
held AS (
  SELECT c.lang, c.phrase FROM longs c JOIN longs l ON l.lang = c.lang AND l.m > c.m AND contains(' ' || l.phrase || ' ', ' ' || c.phrase || ' ') AND 100 * l.f >= 100 * c.f GROUP BY ALL),
cuts AS (
  SELECT s.lang, s.phrase, s.f AS a, k, array_to_string(string_split(s.phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(s.phrase, ' ')[k + 1 :], ' ') AS tail
  FROM longs s ANTI JOIN held USING (lang, phrase), unnest(range(1, s.m)) AS t(k)),
met AS (SELECT c.lang, c.phrase, a, k, x.f AS l, y.f AS r, n, (1000 * a * n) // (x.f * y.f) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = tail JOIN totals t ON t.lang = c.lang),
least AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM least) WHERE rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": _OP1, "op6_substrings": _OP6, "op9_warc": _OP9, "op11_prefix_trie": _OP11, "op12_phrases": _OP12}
