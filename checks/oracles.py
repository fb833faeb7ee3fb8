"""DuckDB SQL for the results of ``checks.queries``, written from how the inputs are built.

Where an input encodes known columns (CSV text, links, JSON, base64), the SQL reads those
columns and never parses the text, so the two sides share no formula.
"""

from __future__ import annotations

# Fixed values, spelled out here so that the tested side does not supply them.
ROUTE_IDS = (
    "00000000-0000-1000-8000-00000000656e, 00000000-0000-1000-8000-000000006672, "
    "00000000-0000-1000-8000-000000006465, 00000000-0000-1000-8000-000000006573"
)
_SPACE = "'" + "".join(
    map(chr, [*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF])
) + "'"

_PARTS = r"""
parts AS (
  SELECT page_id, url, regexp_extract(url, '^(\w+)://', 1) AS scheme,
         regexp_extract(url, '^\w+://([^/]+)', 1) AS host,
         regexp_extract(url, '^\w+://[^/]+(.*)$', 1) AS rest,
         split_part(url, '/', 4) AS lang
  FROM pages)"""

_ENDPOINTS = _PARTS + r""",
endpoints AS (
  SELECT page_id AS line_no,
         CASE page_id % 5 WHEN 2 THEN '[2001:db8::' || hex(page_id) || ']'
              WHEN 4 THEN '192.0.2.' || (page_id % 256) ELSE host END AS host,
         CASE WHEN page_id % 5 IN (0, 2) THEN (page_id % 50000 + 8000)::VARCHAR ELSE '443' END AS port,
         CASE page_id % 5
              WHEN 0 THEN 'page ' || page_id || ' ' || (page_id % 90) || '.5 MB/s'
              WHEN 1 THEN lang WHEN 2 THEN 'v6' WHEN 3 THEN host
              ELSE '192.0.2.' || (page_id % 256) END AS tag
  FROM parts)"""

_LINKS = r"""
built AS (
  SELECT page_id, scheme, host, lang,
         CASE WHEN page_id % 11 = 0 THEN 'ssr' ELSE scheme END || '://' ||
         CASE WHEN page_id % 2 = 0 THEN 'u' || page_id || '@' ELSE '' END || host ||
         CASE WHEN page_id % 3 < 2 THEN ':' || (page_id % 60000 + 1) ELSE '' END ||
         split_part(rest, '#', 1) ||
         CASE page_id % 4 WHEN 1 THEN '#caf%C3%A9%20+' || lang WHEN 2 THEN '#bad%zz'
              WHEN 3 THEN '#' ELSE '' END AS link
  FROM parts),
links AS (
  SELECT page_id AS line_no, scheme, host,
         CASE WHEN page_id % 3 < 2 THEN (page_id % 60000 + 1)::VARCHAR END AS port,
         CASE WHEN page_id % 4 = 1 THEN 'café +' || lang ELSE host END AS tag, link,
         CASE WHEN page_id % 11 = 0 THEN 'skipped scheme'
              WHEN page_id % 4 = 2 THEN 'bad escape' END AS reason
  FROM built)"""

_CSV = r"""
owned AS (
  SELECT *, CASE WHEN c_acctbal < 1000 THEN c_mktsegment END AS own FROM customer),
filled AS (
  SELECT *, c_nationkey AS source, c_custkey * 4 + 2 AS line_no,
         last_value(own IGNORE NULLS) OVER w AS kind,
         max(CASE WHEN own IS NOT NULL THEN c_custkey END) OVER w AS seg
  FROM owned WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
fitted AS (
  SELECT *, CASE WHEN kind IS NULL THEN 'no header'
                 WHEN kind = 'HOUSEHOLD' THEN 'cell count' END AS misfit,
         c_custkey % 5 <> 0 AS tls,
         CASE WHEN kind IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') AND c_acctbal >= 0
              THEN c_acctbal END AS number,
         CASE WHEN c_acctbal > 8000 THEN 'KB' WHEN c_acctbal > 6000 THEN 'MB' END AS said,
         CASE kind WHEN 'BUILDING' THEN 'KB' WHEN 'MACHINERY' THEN 'MB' END AS header_unit,
         CASE WHEN c_acctbal < 0 THEN 'n/a' WHEN c_acctbal > 8000 THEN c_acctbal || ' KB/s'
              WHEN c_acctbal > 6000 THEN c_acctbal || 'mb/s' ELSE c_acctbal::VARCHAR END AS cell4,
         CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_mktsegment END AS cell5
  FROM filled)"""


def _speeds(eligible: str) -> str:
    """Speeds in MB where ``eligible`` rows set the unit of a header without one."""
    return _CSV + rf""",
united AS (
  SELECT *, coalesce(header_unit, first_value(
              CASE WHEN {eligible} AND number IS NOT NULL AND said IS NOT NULL THEN said END
              IGNORE NULLS) OVER (PARTITION BY source, seg ORDER BY c_custkey
                                  ROWS UNBOUNDED PRECEDING)) AS unit
  FROM fitted),
speeds AS (
  SELECT *, CASE WHEN unit = 'KB' THEN floor(number / 10 + 0.5) / 100 ELSE number END AS speed
  FROM united)"""


_RECORDS = _speeds("misfit IS NULL AND tls") + r""",
csv AS (
  SELECT source, line_no, '192.0.2.' || c_custkey AS host,
         CASE WHEN c_custkey % 3 = 0 THEN '443' ELSE (c_custkey % 60000 + 1000)::VARCHAR END AS port,
         CASE WHEN kind = 'FURNITURE' THEN c_name || '-' || cell4
              WHEN cell5 = '' THEN c_name ELSE cell5 || '-' || c_name END AS tag
  FROM speeds WHERE misfit IS NULL AND tls AND (speed IS NULL OR speed >= 5))"""

_UNION = "WITH " + _ENDPOINTS + "," + _LINKS + "," + _RECORDS + r""",
records AS (
  SELECT line_no AS seq, 0 AS source_rank, 'vless' AS scheme, host, port, tag, NULL AS link
  FROM endpoints
  UNION ALL
  SELECT (1::BIGINT << 61) + (source::BIGINT << 40) + line_no, 1, 'vless', host, port, tag, NULL
  FROM csv
  UNION ALL
  SELECT (2::BIGINT << 61) + line_no, 2, scheme, host, port, tag, link
  FROM links WHERE reason IS NULL)"""

_EVENT_RECORDS = r"""
records AS (
  SELECT event_type AS scheme, user_id::VARCHAR AS host, event_id AS seq,
         CASE WHEN event_type = 'error' THEN 'user ' || user_id
              ELSE 'speed ' || floor(value)::BIGINT || ' MB/s' END AS tag,
         CASE WHEN event_type <> 'error' THEN floor(value) END AS measure
  FROM events)"""

_ACCEPTED = r"""
judged AS (
  SELECT *, count(*) OVER w AS earlier, max(measure) OVER w AS best
  FROM records
  WINDOW w AS (PARTITION BY scheme, host, port ORDER BY seq
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
accepted AS (
  SELECT *, row_number() OVER (PARTITION BY tag ORDER BY seq) AS tag_no
  FROM judged WHERE earlier = 0 OR (best IS NULL AND measure IS NOT NULL) OR measure > best)"""

_GAPS = r"""
keyed AS (
  SELECT event_type AS scheme, user_id, event_id AS seq, event_type = 'error' AS failed, floor(value) AS whole,
         CASE WHEN user_id % 4 = 0 THEN '' WHEN user_id % 4 > 1 THEN user_id::VARCHAR END AS host,
         CASE event_id % 3 WHEN 1 THEN '443' WHEN 2 THEN '' END AS port
  FROM events),
records AS (
  SELECT scheme, host, port, seq,
         CASE WHEN user_id % 5 > 0 THEN CASE WHEN failed THEN 'user ' || user_id
              ELSE 'speed ' || whole::BIGINT || ' MB/s' END END AS tag,
         CASE WHEN user_id % 5 > 0 AND NOT failed THEN whole END AS measure
  FROM keyed)"""

_GRAPH = r"""
calls(parent, place, child) AS (
  SELECT 'c' || o_custkey, o_orderkey + 1, 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'o' || l_orderkey, l_partkey + 1, 'p' || l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'p' || l_partkey, l_suppkey + 1, 's' || l_suppkey FROM lineitem
  UNION ALL SELECT 's' || s_suppkey, 1, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 1, 'r' || n_regionkey FROM nation
  UNION ALL SELECT 'r' || n_regionkey, n_nationkey + 1, 'n' || n_nationkey FROM nation),
literals(list_id, line) AS (
  SELECT 'c' || c_custkey, c_name FROM customer
  UNION ALL SELECT 'o' || o_orderkey, o_orderpriority FROM orders
  UNION ALL SELECT 'p' || p_partkey, p_name FROM part
  UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation
  UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
reached(root, list_id) AS (
  SELECT c_mktsegment, 'c' || c_custkey FROM customer
  UNION
  SELECT root, child FROM reached JOIN calls ON list_id = parent)"""

_TURNS = r"""
turns AS (
  SELECT conv_id, turn, role, 'turn://' || conv_id || '/' || turn || '#' || role AS link
  FROM conversations)"""

_PLACED = (
    _TURNS
    + """,
placed AS (
  SELECT *, coalesce(sum(strlen(link) + 1) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 64 AS part
  FROM turns)"""
)

_UUID = (
    "regexp_matches({0}, '^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[1-5][0-9a-f]{{3}}-"
    "[89ab][0-9a-f]{{3}}-[0-9a-f]{{12}}$', 'i')"
)


def _shaped(digest: str) -> str:
    cuts = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return "(" + " || '-' || ".join(f"substr({digest}, {a}, {n})" for a, n in cuts) + ")"


_RANKED = (
    r"""
records AS (
  SELECT *, nullif(regexp_extract(tag, '(\d+\.?\d*) ?[MK]B/s', 1, 'i'), '')::DOUBLE AS measure
  FROM unmeasured),"""
    + _ACCEPTED
    + r""",
ends AS (
  SELECT *, min(seq) OVER k AS first_seq, max(seq) OVER k AS last_seq
  FROM accepted WINDOW k AS (PARTITION BY scheme, host, port)),
ranked AS (
  SELECT first_seq, scheme, host, port, tag,
         coalesce(link, scheme || '://reader@' || host || ':' || port || '#' || replace(tag, ' ', '%20')) ||
         CASE WHEN tag_no > 1 THEN '%20' || tag_no ELSE '' END AS link
  FROM ends WHERE seq = last_seq)"""
)

ORACLES: dict[str, str] = {
    "line_scan": rf"""
WITH pieces AS (
  SELECT doc_id, string_split_regex(trim(text, {_SPACE}), '\n+') AS p FROM documents),
cut AS (
  SELECT doc_id, unnest(range(len(p))) AS line_no, trim(unnest(p), {_SPACE}) AS line FROM pieces)
SELECT * FROM cut WHERE line <> '' AND NOT starts_with(line, '#')""",
    "include_closure": f"""
WITH RECURSIVE {_GRAPH}
SELECT root, list_id, 0::BIGINT AS line_no, line FROM reached JOIN literals USING (list_id)
UNION ALL
SELECT DISTINCT c_mktsegment, NULL, 0, 'segment ' || c_mktsegment FROM customer""",
    "include_order": r"""
WITH c AS (
  SELECT c_mktsegment AS root, c_custkey AS k, [c_custkey + 1] AS path FROM customer),
o AS (
  SELECT root, o_orderkey AS k, list_append(path, o_orderkey + 1) AS path
  FROM c JOIN orders ON o_custkey = c.k),
p AS (
  SELECT root, l_partkey AS k, min(list_append(path, l_partkey + 1)) AS path
  FROM o JOIN lineitem ON l_orderkey = o.k GROUP BY ALL),
s AS (
  SELECT root, l_suppkey AS k, min(list_append(path, l_suppkey + 1)) AS path
  FROM p JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p.k
  GROUP BY ALL),
direct AS (
  SELECT root, s_nationkey AS k, min(list_append(path, 1)) AS path
  FROM s JOIN supplier ON s_suppkey = s.k GROUP BY ALL),
r AS (
  SELECT root, n_regionkey AS k, min(list_append(path, 1)) AS path
  FROM direct JOIN nation ON n_nationkey = direct.k GROUP BY ALL),
n AS (
  SELECT root, k, min(path) AS path FROM (
    SELECT * FROM direct UNION ALL
    SELECT root, n_nationkey, list_append(path, n_nationkey + 1)
    FROM r JOIN nation ON n_regionkey = r.k) GROUP BY ALL),
reached AS (
  SELECT root, 'c' || k AS list_id, path FROM c UNION ALL SELECT root, 'o' || k, path FROM o
  UNION ALL SELECT root, 'p' || k, path FROM p UNION ALL SELECT root, 's' || k, path FROM s
  UNION ALL SELECT root, 'n' || k, path FROM n UNION ALL SELECT root, 'r' || k, path FROM r)
SELECT root, list_id, array_to_string(path, '/') AS path FROM reached""",
    "include_one_level": r"""
SELECT 'o' || l_orderkey AS root, 'p' || l_partkey AS list_id, p_name AS line
FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL
SELECT 'o' || o_orderkey, NULL, o_orderpriority FROM orders""",
    "drifting_csv": f"""
WITH {_RECORDS}
SELECT * FROM csv
QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no) <= 8""",
    "drifting_csv_uncapped": f"WITH {_RECORDS} SELECT * FROM csv",
    "link_extract": f"""
WITH {_PARTS}, {_LINKS}
SELECT line_no, scheme, host, port, tag, link FROM links WHERE reason IS NULL""",
    "json_link_extract": r"""
SELECT c_custkey AS line_no, 'vmess' AS scheme, 'h' || c_custkey || '.example' AS host,
       (c_custkey % 60000 + 1)::VARCHAR AS port,
       CASE WHEN c_acctbal >= 0 THEN c_name ELSE 'h' || c_custkey || '.example' END AS tag
FROM customer WHERE c_custkey % 10 < 7""",
    "base64_sniff": r"""
SELECT token, regexp_full_match(token,
  '(?:[A-Za-z0-9+/_-]{4})*(?:[A-Za-z0-9+/_-]{2}={0,2}|[A-Za-z0-9+/_-]{3}=?)?')
  AND token <> '' AS is_base64
FROM (SELECT DISTINCT unnest(string_split_regex(text, '[ \n]+')) AS token FROM documents)""",
    "base64_decode": r"""
SELECT doc_id, md5(body) AS digest, length(body) AS chars
FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '# ' || text ELSE text END AS body
      FROM documents)""",
    "rejects": rf"""
WITH {_PARTS}, {_LINKS}, {_speeds("misfit IS NULL AND tls")},
lines AS (
  SELECT source, trim(unnest(string_split_regex(text, '\n+')), {_SPACE}) AS line FROM documents)
SELECT source, 'no endpoint' AS reason, count(*) AS n FROM lines
WHERE line <> '' AND NOT starts_with(line, '#') AND NOT regexp_matches(line,
  '^((?:[\w-]+\.)+[a-z-]+|\d{{1,3}}(?:\.\d{{1,3}}){{3}}|\[[a-f0-9:]+\])', 'i')
GROUP BY source
UNION ALL
SELECT 'links', reason, count(*) FROM links WHERE reason IS NOT NULL GROUP BY reason
UNION ALL
SELECT source::VARCHAR, reason, count(*) FROM (
  SELECT source, coalesce(misfit, CASE WHEN NOT tls THEN 'not tls' WHEN speed < 5 THEN 'slow' END)
         AS reason FROM speeds)
WHERE reason IS NOT NULL GROUP BY ALL""",
    "endpoint_parse": f"WITH {_ENDPOINTS} SELECT * FROM endpoints",
    "authority_parse": r"""
SELECT c_custkey,
       CASE WHEN c_acctbal >= 0 THEN 'u' || c_custkey END AS "user",
       CASE WHEN c_acctbal >= 0 THEN 'p' || c_mktsegment END AS password,
       'h' || c_custkey || '.example' AS host,
       (c_custkey % 60000 + 1)::INTEGER AS port,
       CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN '[2001:db8::' || hex(c_custkey) || ']'
            ELSE 'h' || c_custkey || '.example' END AS relay_host,
       CASE WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN '443'
            ELSE (c_custkey % 60000 + 1)::VARCHAR END AS relay_port
FROM customer""",
    "tag_compose": r"""
SELECT c_custkey,
       CASE WHEN c_acctbal < 0 THEN '192.0.2.' || c_custkey
            WHEN c_acctbal < 1000 THEN c_name
            WHEN c_acctbal < 3000 THEN n_name || '-' || c_name
            ELSE c_mktsegment || '-' || n_name || '-' || c_name END AS tag
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "port_default": r"""
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'O' THEN o_custkey::VARCHAR
            WHEN o_totalprice > 200000 THEN '443' ELSE '80' END AS port
FROM orders""",
    "unit_normalise": r"""
SELECT event_id, number, unit,
       CASE WHEN unit = 'KB' THEN floor(number / 10 + 0.5) / 100 ELSE number END AS mega
FROM (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS number,
             CASE event_type WHEN 'click' THEN 'KB' WHEN 'view' THEN 'MB' END AS unit
      FROM events)""",
    "measure_extract": r"""
WITH found AS (
  SELECT doc_id, regexp_extract(
    text || ' ' || n_chars || '.5 kb/s then 9 MB/s', '(\d+\.?\d*) ?([MK])B/s', ['n', 'u'], 'i') AS f
  FROM documents)
SELECT doc_id, f.n::DOUBLE AS measure,
       CASE WHEN upper(f.u) = 'K' THEN f.n::DOUBLE / 1000 ELSE f.n::DOUBLE END AS mega
FROM found""",
    "uri_build": r"""
SELECT c_custkey, 'vless://' ||
       CASE WHEN c_mktsegment <> 'BUILDING' THEN 'u%3A' || c_custkey || '@' ELSE '' END ||
       'h' || c_custkey || '.example' ||
       CASE WHEN c_acctbal >= 0 THEN ':' || (c_custkey % 60000 + 1) ELSE '' END ||
       '?type=' || lower(c_mktsegment) || '&path=%2F%3Fed%3D2+%C3%A9%7E&host=h' || c_custkey ||
       '.example#' || c_name || '%20%3C%C3%A9%3E%20%22q%22/%' AS uri
FROM customer""",
    "token_replace": r"""
SELECT doc_id, md5(replace(text, 'e.', '[$1]')) AS digest,
       length(replace(text, 'e.', '[$1]')) AS chars
FROM documents""",
    "route_class": f"""
WITH {_PARTS},
asked AS (
  SELECT page_id, lang, page_id % 10 = 9 AS at_root, contains(rest, '?') AS own,
         contains(rest, '#') AS below, lang IN ('en', 'fr', 'de', 'es') AS listed,
         '00000000-0000-1000-8000-00000000' || lower(hex(lang)) AS id
  FROM parts),
routed AS (
  SELECT *, CASE WHEN page_id % 7 = 0 THEN 'websocket' WHEN at_root THEN 'root'
                 WHEN own AND listed THEN 'feed' ELSE 'not found' END AS route
  FROM asked)
SELECT page_id, CASE WHEN NOT at_root AND (own OR below) AND listed THEN id END AS matched_id, route,
       CASE WHEN route = 'feed' THEN
         CASE WHEN page_id % 4 = 0 AND page_id % 3 = 0 THEN 'page'
              WHEN page_id % 4 IN (1, 2) THEN 'raw' ELSE 'base64' END END AS output
FROM routed""",
    "arity_filter": f"WITH {_CSV} SELECT source, line_no, misfit AS reason FROM fitted",
    "flag_filter": f"""
WITH {_CSV} SELECT source, line_no FROM fitted WHERE misfit IS NULL AND tls""",
    "threshold_filter": f"""
WITH {_speeds("misfit IS NULL")}
SELECT source, line_no, speed FROM speeds
WHERE misfit IS NULL AND (speed IS NULL OR speed >= 50)""",
    "id_list_validate": f"""
WITH listed AS (
  SELECT doc_id, lang, {_shaped("md5(text)")} AS a, {_shaped("md5(lang || doc_id)")} AS b
  FROM documents)
SELECT doc_id, CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 2 ELSE 1 END AS n_ids,
       CASE lang WHEN 'fr' THEN true WHEN 'de' THEN {_UUID.format("a")} AND {_UUID.format("b")}
            ELSE {_UUID.format("a")} END AS valid
FROM listed""",
    "first_contained": r"""
SELECT doc_id, min(item_id) AS item_id
FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> ''
GROUP BY doc_id""",
    "allowlist_semi": r"""
SELECT event_id, user_id,
       EXISTS (SELECT 1 FROM customer WHERE c_custkey = user_id AND c_acctbal >= 4000) AS kept
FROM events""",
    "keep_best": f"""
WITH {_EVENT_RECORDS}
SELECT scheme, host, tag, seq, min(seq) OVER (PARTITION BY scheme, host) AS first_seq
FROM records
QUALIFY row_number() OVER (PARTITION BY scheme, host ORDER BY measure DESC NULLS LAST, seq) = 1""",
    "tag_ordinals": f"""
WITH {_EVENT_RECORDS.replace("AS host,", "AS host, '443' AS port,")}, {_ACCEPTED}
SELECT seq, scheme, host, tag, tag_no FROM accepted""",
    "hot_tag_ordinals": f"""
WITH {_GAPS}, {_ACCEPTED}
SELECT seq, scheme, host, port, tag, tag_no FROM accepted""",
    "keep_best_survivors": f"""
WITH {_GAPS}, best AS (
  SELECT scheme, host, port, tag, seq, min(seq) OVER (PARTITION BY scheme, host, port) AS first_seq
  FROM records
  QUALIFY row_number() OVER (PARTITION BY scheme, host, port ORDER BY measure DESC NULLS LAST, seq) = 1)
SELECT way, best.* FROM best, (VALUES ('best'), ('last')) AS ways(way)""",
    "concat_links_parts": f"""
WITH {_PLACED}
SELECT conv_id, part, string_agg(link, chr(10) ORDER BY turn) AS text
FROM placed GROUP BY conv_id, part""",
    "sink_base64_parts": f"""
WITH {_TURNS}
SELECT nullif(conv_id, CASE WHEN conv_id % 10 = 0 THEN conv_id END) AS conv_id,
       base64(encode(string_agg(link, chr(10) ORDER BY turns.conv_id, turn))) AS text
FROM turns GROUP BY 1""",
    "hot_header_fill": f"""
WITH {_CSV}
SELECT nullif(source, 3) AS source, line_no, seg * 4 AS header_line FROM fitted""",
    "uuid_text": r"""
SELECT doc_id, regexp_replace(md5(text), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\1-\2-\3-\4-\5') AS uuid
FROM documents""",
    "first_contained_long": r"""
WITH words AS (
  SELECT item_id, unnest(string_split_regex(text, '[ \n]+')) AS word,
         unnest(range(len(string_split_regex(text, '[ \n]+')))) AS pos FROM benchmark),
listed AS (SELECT word, min(item_id * 100000 + pos) AS place FROM words WHERE length(word) >= 6 GROUP BY word)
SELECT doc_id, min(place) AS place FROM documents JOIN listed ON contains(text, word) GROUP BY doc_id""",
    "cap_per_source": r"""
SELECT event_type, event_id, value FROM events WHERE value >= 5
QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 8""",
    "concat_links": f"""
WITH {_TURNS}
SELECT conv_id, 0::BIGINT AS part, string_agg(link, chr(10) ORDER BY turn) AS text
FROM turns GROUP BY conv_id""",
    "header_fill": f"""
WITH {_CSV}
SELECT source, line_no, seg * 4 AS header_line,
       CASE WHEN kind = 'HOUSEHOLD' THEN 3 WHEN kind IS NOT NULL THEN 6 END AS cells
FROM fitted""",
    "sticky_unit": f"""
WITH {_speeds("misfit IS NULL AND tls")}
SELECT source, line_no, unit, speed FROM speeds WHERE misfit IS NULL AND tls""",
    "source_union": _UNION + " SELECT * FROM records",
    "setting_roots": r"""
WITH s AS (
  SELECT *, c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR c_acctbal > 9000 AS asked FROM customer)
SELECT 'text' AS kind, c_custkey AS root, 0::BIGINT AS line_no, 'api://' || c_name AS line
FROM s WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'text', c_custkey, 1, 'list ' || c_custkey FROM s WHERE c_mktsegment = 'BUILDING'
UNION ALL SELECT 'text', c_custkey, 0, 'first' FROM s WHERE NOT asked
UNION ALL SELECT 'text', c_custkey, 2, 'second, third' FROM s WHERE NOT asked
UNION ALL SELECT 'csv', c_custkey, 0, c_name FROM s WHERE NOT asked AND c_acctbal < 5000
UNION ALL SELECT 'links', c_custkey, 0, c_mktsegment FROM s WHERE c_acctbal > 9000
UNION ALL SELECT 'links', c_custkey, 0, 'provider' FROM s WHERE NOT asked""",
    "tls_flag": r"""
SELECT c_custkey, c_mktsegment <> 'BUILDING' AND c_acctbal >= 0 AS only_tls FROM customer""",
    "setting_precedence": r"""
WITH s AS (
  SELECT *, c_mktsegment = 'BUILDING' OR c_acctbal < 0 OR c_acctbal > 9000 AS asked FROM customer)
SELECT c_custkey,
       CASE WHEN NOT asked THEN 'stored text' WHEN c_mktsegment = 'BUILDING' THEN c_name END AS text_lists,
       CASE WHEN NOT asked AND c_acctbal < 5000 THEN 'stored csv'
            WHEN asked AND c_acctbal < 0 THEN '' END AS csv_lists,
       CASE WHEN NOT asked THEN 'stored links'
            WHEN c_acctbal > 9000 THEN c_mktsegment END AS link_lists,
       CASE WHEN c_acctbal > 8000 THEN '7:3' WHEN c_acctbal > 2000 THEN '6' ELSE '5' END AS speed_limit
FROM s""",
    "pool_pick": f"""
WITH {_PARTS},
pools AS (
  SELECT page_id, url, CASE WHEN lang <> 'es' THEN [host || ':1', host || ':3', lang || '.example'] END AS pool
  FROM parts)
SELECT page_id, pool[1 + ('0x' || substr(md5(url), 1, 8))::BIGINT % len(pool)] AS entry FROM pools""",
    "sink_raw": f"WITH {_TURNS} SELECT role, link FROM turns",
    "sink_base64": f"""
WITH {_TURNS}
SELECT conv_id, 0::BIGINT AS part,
       base64(encode(string_agg(link, chr(10) ORDER BY turn))) AS text
FROM turns GROUP BY conv_id""",
    "ranked_links": _UNION.replace("records AS (", "unmeasured AS (", 1)
    + ","
    + _RANKED
    + " SELECT * FROM ranked",
    "resolved_feed": "WITH "
    + _ENDPOINTS
    + ","
    + _LINKS
    + ","
    + _RECORDS
    + r""",
capped AS (
  SELECT * FROM csv QUALIFY row_number() OVER (PARTITION BY source ORDER BY line_no) <= 8),
placed AS (
  SELECT 0 AS rank, lang AS source, line_no, 'vless' AS scheme, e.host, port, tag, NULL AS link
  FROM endpoints e JOIN parts ON page_id = line_no
  UNION ALL
  SELECT 1, lpad(source::VARCHAR, 9, '0'), line_no, 'vless', host, port, tag, NULL FROM capped
  UNION ALL
  SELECT 2, '', line_no, scheme, host, port, tag,
         replace(link, 'u' || line_no || '@', 'reader@') FROM links WHERE reason IS NULL),
unmeasured AS (
  SELECT *, row_number() OVER (ORDER BY rank, source, line_no) AS seq FROM placed),"""
    + _RANKED
    + " SELECT scheme, host, port, tag, link FROM ranked",
}
