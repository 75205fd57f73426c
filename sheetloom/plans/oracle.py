"""The catalogue's queries in SQL over the driver tables.

Each text states the result directly on the flat driver tables, with plain range joins and
without grids, rounds or nested JSON, so that it checks the Spark jobs independently.
"""

from __future__ import annotations

from sheetloom.functions.names import DEVICE_CODES
from sheetloom.operators.tiles import CLASSES, STEP, TILE
from sheetloom.plans.views import CLASS_NAMES, TYPES

_CODES = "(" + "|".join(DEVICE_CODES) + ")"


def _pick(items: tuple[str, ...], number: str) -> str:
    return f"([{', '.join(repr(i) for i in items)}])[CAST({number} AS INT)]"


_ROW_ID = (
    "((l_orderkey * 8 + l_linenumber) * 4000000 + l_partkey % 2000 * 2000"
    " + CAST(round(l_extendedprice * 100) AS BIGINT) % 2000)"
)

_BOX = """CAST(o_orderkey % 100 * 50 AS DOUBLE) AS min_x, CAST(o_orderkey // 100 * 50 AS DOUBLE) AS min_y,
  CAST(o_orderkey % 100 * 50 + 20 AS DOUBLE) AS max_x, CAST(o_orderkey // 100 * 50 + 30 - o_orderkey % 3 * 4 AS DOUBLE) AS max_y"""

CONTOURS = f"""contours AS (
  SELECT o_orderkey % 50 AS doc_id, CAST(o_orderkey // 50 % 2 AS INT) AS page, o_orderkey AS contour_id, {_BOX},
    CASE o_orderpriority WHEN '5-LOW' THEN NULL WHEN '1-URGENT' THEN '=A+TANK' || (o_orderkey // 50 % 20)
      ELSE 'TANK' || (o_orderkey // 50 % 20) END AS name,
    CASE WHEN o_orderpriority <> '5-LOW' THEN 'TANK' || (o_orderkey // 50 % 20) END AS tech_object
  FROM orders)"""

_LABEL = f"{_pick(TYPES, 'l_linenumber')} || (l_partkey % 7)"

TEXTS = f"""texts AS (
  SELECT l_orderkey % 50 AS doc_id, CAST(l_orderkey // 50 % 2 AS INT) AS page, {_ROW_ID} AS text_id,
    CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN '=A+TANK' || (l_partkey % 40) || ':'
      WHEN l_returnflag = 'R' AND l_linenumber = 2 THEN '=A+M' || (l_partkey % 9) || '+' || l_suppkey
      ELSE {_LABEL} END AS text,
    CASE WHEN l_returnflag = 'R' AND l_linenumber <= 2 THEN NULL ELSE {_LABEL} END AS label0,
    l_orderkey % 100 * 50 + l_quantity AS cx, l_orderkey // 100 * 50 + round(l_discount * 400) AS cy, l_tax
  FROM lineitem)"""

# The plus texts up to ten characters are labels too: their letters and digits.
LABELS = r"""labels0 AS (
  SELECT *, CASE WHEN label0 IS NOT NULL THEN label0
    WHEN length(text) <= 10 THEN regexp_extract(text, '[A-Z]+[0-9]+') END AS label FROM texts),
labels_ AS (SELECT * FROM labels0 WHERE label IS NOT NULL)"""

_TYPE = _pick(TYPES, "p_size % 7 + 1")
DEVICES = f"""devices AS (
  SELECT p_partkey % 50 AS doc_id, p_partkey AS ord, 'TANK' || (p_partkey // 50 % 20) || {_TYPE} || (p_partkey % 7) AS name,
    'TANK' || (p_partkey // 50 % 20) AS tech_object, {_TYPE} || (p_partkey % 7) AS short_name,
    p_name AS descr, p_brand AS article, {_TYPE} AS type, p_type AS category, CAST(p_size AS VARCHAR) AS size,
    CAST(p_retailprice AS VARCHAR) AS price
  FROM part)"""

INSIDE = """inside AS (
  SELECT c.doc_id, c.page, c.contour_id, c.tech_object, t.text_id, t.label, t.cx, t.cy
  FROM contours c JOIN labels_ t ON t.doc_id = c.doc_id AND t.page = c.page
    AND t.cx BETWEEN c.min_x - 5 AND c.max_x + 5 AND t.cy BETWEEN c.min_y - 5 AND c.max_y + 5
  WHERE c.tech_object IS NOT NULL)"""

MATCHES = """matches AS (
  SELECT * FROM inside i WHERE EXISTS (SELECT 1 FROM devices d
    WHERE d.doc_id = i.doc_id AND d.tech_object = i.tech_object AND d.short_name = i.label))"""

_DRAWING = f"WITH {CONTOURS}, {TEXTS}, {LABELS}, {DEVICES}, {INSIDE}, {MATCHES}"
_KNOWN = "(SELECT DISTINCT doc_id, tech_object FROM devices)"

ORACLE: dict[str, str] = {}

ORACLE["device_match_counts"] = f"{_DRAWING} SELECT doc_id, tech_object, count(*) AS devices FROM matches GROUP BY ALL"

ORACLE["device_match_rows"] = f"""{_DRAWING}
SELECT doc_id, page, contour_id, text_id, tech_object || label AS lua_name, label AS pdf_name, tech_object,
  cx AS x, cy AS y, CAST(1.0 AS DOUBLE) AS confidence, regexp_extract(label, '^[A-Z]+') AS device_type FROM matches"""

ORACLE["unmatched_labels"] = f"""{_DRAWING}
SELECT doc_id, contour_id, text_id, label FROM inside i
WHERE EXISTS (SELECT 1 FROM devices d WHERE d.doc_id = i.doc_id AND d.tech_object = i.tech_object)
  AND NOT EXISTS (SELECT 1 FROM devices d
    WHERE d.doc_id = i.doc_id AND d.tech_object = i.tech_object AND d.short_name = i.label)"""

ORACLE["empty_contours"] = f"""{_DRAWING}
SELECT doc_id, contour_id, tech_object FROM contours c
WHERE EXISTS (SELECT 1 FROM devices d WHERE d.doc_id = c.doc_id AND d.tech_object = c.tech_object)
  AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.contour_id = c.contour_id)"""

ORACLE["expected_devices"] = f"""{_DRAWING}
SELECT c.doc_id, contour_id, c.tech_object, count(DISTINCT short_name) AS expected
FROM contours c JOIN devices d ON d.doc_id = c.doc_id AND d.tech_object = c.tech_object GROUP BY ALL"""

ORACLE["device_enrich"] = f"""{_DRAWING}
SELECT m.doc_id, contour_id, text_id, m.tech_object || m.label AS lua_name,
  l.d.descr AS descr, l.d.article AS article, l.d.type AS "type", l.d.category AS category, l.d.size AS size
FROM matches m LEFT JOIN (SELECT doc_id, upper(name) AS n, arg_max(devices, ord) AS d FROM devices GROUP BY ALL) l
  ON l.doc_id = m.doc_id AND l.n = m.tech_object || m.label"""

ORACLE["object_first_contour"] = f"""{_DRAWING},
pairs AS (SELECT o.doc_id, o.tech_object, first(c.contour_id ORDER BY c.page, c.contour_id) AS contour_id
  FROM {_KNOWN} o JOIN contours c ON c.doc_id = o.doc_id AND contains(upper(c.name), o.tech_object) GROUP BY ALL)
SELECT p.doc_id, p.tech_object, page, contour_id, name, min_x, min_y, max_x, max_y
FROM pairs p JOIN contours c USING (contour_id)"""

ORACLE["object_named_contour"] = f"""{_DRAWING},
pairs AS (SELECT o.doc_id, o.tech_object, first(c.contour_id ORDER BY c.page, c.contour_id) AS contour_id
  FROM {_KNOWN} o JOIN contours c ON c.doc_id = o.doc_id AND c.tech_object = o.tech_object GROUP BY ALL)
SELECT p.doc_id, p.tech_object, page, contour_id, name FROM pairs p JOIN contours c USING (contour_id)"""

ORACLE["device_name_parts"] = f"""WITH {DEVICES}
SELECT doc_id, ord, name, nullif(regexp_extract(upper(name), '{_CODES}([0-9]+)$', 1), '') AS device_type,
  nullif(regexp_extract(name, '^(.+?){_CODES}[0-9]+$', 1), '') AS tech_object,
  upper(substr(name, length(regexp_extract(name, '^(.+?){_CODES}[0-9]+$', 1)) + 1)) AS short_name,
  regexp_extract(name, '^([A-Za-z]+[0-9]*)', 1) AS prefix FROM devices"""

ORACLE["configured_devices"] = f"""WITH {DEVICES}
SELECT doc_id, tech_object, short_name, max(ord) AS ord, arg_max(name, ord) AS name, arg_max(article, ord) AS article
FROM devices GROUP BY ALL"""

ORACLE["label_parts"] = f"WITH {TEXTS}, {LABELS} SELECT doc_id, text_id, text, label, cx, cy FROM labels_"

# Segments of the boxes: corners p0..p3 and up to four points on the bottom edge.
SEGMENTS = f"""box AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, {_BOX}, o_orderkey % 5 + 4 AS n FROM orders),
sides AS (SELECT *, unnest(range(0, n)) AS k FROM box),
pts AS (SELECT *, CASE WHEN k < 2 THEN min_x WHEN k < 4 THEN max_x ELSE max_x - 4.0 * (k - 3) END AS x1,
    CASE WHEN k IN (1, 2) THEN max_y ELSE min_y END AS y1 FROM sides),
segments AS (
  SELECT a.o_orderkey % 50 AS doc_id, CAST(a.o_orderkey // 50 % 2 AS INT) AS page, a.o_orderkey AS d, a.o_orderkey * 10 + a.k AS seg_id, a.x1, a.y1,
    b.x1 + CASE WHEN a.k % 2 = 0 THEN 0.125 ELSE 0 END AS x2, b.y1 AS y2, a.o_orderstatus <> 'O' AS dashed
  FROM pts a JOIN pts b ON b.o_orderkey = a.o_orderkey AND b.k = (a.k + 1) % a.n
  WHERE a.o_orderstatus <> 'P' OR a.k > 0
  UNION ALL
  SELECT o_orderkey % 50, CAST(o_orderkey // 50 % 2 AS INT), o_orderkey, o_orderkey * 10 + 9, max_x, max_y, max_x + 5.0, max_y + 5.0, o_orderstatus <> 'O'
  FROM box WHERE o_orderpriority = '1-URGENT')"""

_ENDS = """ends AS (
  SELECT doc_id, page, d, seg_id, round_even(x1 / 0.5, 0) AS vx, round_even(y1 / 0.5, 0) AS vy FROM segments WHERE dashed
  UNION ALL
  SELECT doc_id, page, d, seg_id, round_even(x2 / 0.5, 0), round_even(y2 / 0.5, 0) FROM segments WHERE dashed),
degree AS (SELECT doc_id, page, vx, vy, count(*) AS degree FROM ends GROUP BY ALL)"""

# Components by walking shared vertices from every segment; loops have degree 2 throughout.
_LOOPS = f"""{SEGMENTS}, {_ENDS},
reach AS (
  SELECT DISTINCT doc_id, seg_id AS a, seg_id AS b FROM ends
  UNION
  SELECT r.doc_id, r.a, f.seg_id FROM reach r JOIN ends e ON e.seg_id = r.b
    JOIN ends f ON f.doc_id = e.doc_id AND f.page = e.page AND f.vx = e.vx AND f.vy = e.vy),
component AS (SELECT doc_id, a AS seg_id, min(b) AS loop FROM reach GROUP BY ALL),
sound AS (SELECT c.loop FROM component c JOIN ends e USING (seg_id) JOIN degree g ON g.doc_id = e.doc_id AND g.page = e.page AND g.vx = e.vx AND g.vy = e.vy
  GROUP BY c.loop HAVING max(degree) = 2 AND min(degree) = 2 AND count(DISTINCT c.seg_id) >= 3)"""

_NUMBERED = """numbered AS (SELECT doc_id, page, loop, row_number() OVER (PARTITION BY doc_id, page ORDER BY loop) - 1 AS contour_id
  FROM (SELECT DISTINCT doc_id, page, loop FROM loop_edges))"""

_BOUNDS = """SELECT e.doc_id, e.page, n.contour_id, min(least(x1, x2)) AS min_x, min(least(y1, y2)) AS min_y, max(greatest(x1, x2)) AS max_x,
  max(greatest(y1, y2)) AS max_y, count(*) AS n_edges, (min(least(x1, x2)) + max(greatest(x1, x2))) / 2 AS cx,
  (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS cy"""

_CLOSED = f"""WITH RECURSIVE {_LOOPS},
loop_edges AS (SELECT c.doc_id, s.page, c.loop, s.seg_id, s.x1, s.y1, s.x2, s.y2 FROM component c JOIN sound USING (loop) JOIN segments s ON s.seg_id = c.seg_id),
{_NUMBERED}, closed AS ({_BOUNDS} FROM loop_edges e JOIN numbered n ON n.loop = e.loop GROUP BY e.doc_id, e.page, n.contour_id)"""

ORACLE["contours_closed"] = f"{_CLOSED} SELECT * FROM closed"

ORACLE["contour_sizes"] = f"{_CLOSED} SELECT doc_id, page, contour_id, max_x - min_x AS width, max_y - min_y AS height FROM closed"

# Status F is closed; the spur of urgent orders is stripped and makes the loop ambiguous.
ORACLE["contours_stripped"] = f"""WITH {SEGMENTS},
loop_edges AS (SELECT s.*, s.d * 10 AS loop, o.o_orderpriority = '1-URGENT' AS ambiguous FROM segments s JOIN orders o ON o.o_orderkey = s.d
  WHERE o.o_orderstatus = 'F' AND s.seg_id % 10 < 9),
{_NUMBERED} {_BOUNDS}, bool_or(e.ambiguous) AS ambiguous FROM loop_edges e JOIN numbered n ON n.loop = e.loop GROUP BY e.doc_id, e.page, n.contour_id"""

ORACLE["contour_edges"] = f"""{_CLOSED}
SELECT e.doc_id, e.page, n.contour_id, e.seg_id, e.seg_id - e.loop AS pos, count(*) OVER (PARTITION BY e.loop) AS n_edges
FROM loop_edges e JOIN numbered n ON n.loop = e.loop"""

ORACLE["segment_flags"] = f"""WITH {SEGMENTS}
SELECT doc_id, seg_id, dashed, round(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2), 6) AS length FROM segments"""

ORACLE["vertex_degrees"] = f"WITH {SEGMENTS}, {_ENDS} SELECT doc_id, degree, count(*) AS vertices FROM degree GROUP BY ALL"

ORACLE["dash_patterns"] = f"""WITH {SEGMENTS}
SELECT CASE WHEN dashed THEN '[3 3] 0' ELSE '[] 0' END AS dashes, CAST(count_if(dashed) AS BIGINT) AS dashed, count(*) AS items FROM segments GROUP BY ALL"""

OBJECTS = """objects AS (
  SELECT c_custkey % 50 AS doc_id, c_custkey AS obj_ord,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'M' WHEN 'MACHINERY' THEN 'TANK' WHEN 'HOUSEHOLD' THEN NULL
      ELSE 'TANK' || (c_custkey // 50 % 40) END AS name_eplan,
    CASE c_mktsegment WHEN 'FURNITURE' THEN 'm' || (c_custkey % 9) ELSE 'BC' || c_custkey END AS name_BC
  FROM customer),
spoken AS (SELECT doc_id, obj_ord, 0 AS pos, upper(name_eplan) AS known, name_eplan FROM objects WHERE name_eplan IS NOT NULL
  UNION ALL SELECT doc_id, obj_ord, 1, upper(name_BC), name_eplan FROM objects),
dictionary AS (SELECT doc_id, known, name_eplan FROM spoken
  QUALIFY row_number() OVER (PARTITION BY doc_id, known ORDER BY obj_ord DESC, pos DESC) = 1)"""

CANDIDATES = """candidates AS (
  SELECT doc_id, page, text_id, cx, cy, CASE WHEN text LIKE '=A+TANK%' THEN trim(split_part(text, '+', 2), ':') ELSE split_part(text, '+', 2) END AS candidate
  FROM texts WHERE contains(text, '+')),
configured AS (
  SELECT c.*, e.known IS NOT NULL OR t.known IS NOT NULL OR m.known IS NOT NULL AS configured,
    CASE WHEN e.known IS NOT NULL THEN e.name_eplan WHEN t.known IS NOT NULL THEN 'TANK' || substr(candidate, 5)
      WHEN m.known IS NOT NULL THEN 'M' || substr(candidate, 2) ELSE candidate END AS final_name
  FROM candidates c LEFT JOIN dictionary e ON e.doc_id = c.doc_id AND e.known = c.candidate
    LEFT JOIN dictionary t ON t.doc_id = c.doc_id AND t.known = 'TANK' AND c.candidate LIKE 'TANK%'
    LEFT JOIN dictionary m ON m.doc_id = c.doc_id AND m.known = 'M' AND regexp_matches(c.candidate, '^M[0-9]+$'))"""

ORACLE["name_dictionary"] = f"WITH {OBJECTS} SELECT * FROM dictionary"

ORACLE["configured_names"] = f"""WITH {TEXTS}, {OBJECTS}, {CANDIDATES}
SELECT doc_id, text_id, candidate, configured, final_name FROM configured"""

_NAMING = f"""{_CLOSED}, {TEXTS}, {OBJECTS}, {CANDIDATES},
drawn AS (SELECT e.*, n.contour_id, x2 - x1 AS dx, y2 - y1 AS dy FROM loop_edges e JOIN numbered n ON n.loop = e.loop),
near AS (
  SELECT doc_id, page, contour_id, text_id, any_value(candidate) AS candidate, any_value(configured) AS configured,
    any_value(final_name) AS final_name, any_value(cx) AS cx, any_value(cy) AS cy,
    min(sqrt((cx - x1 - t * dx) ** 2 + (cy - y1 - t * dy) ** 2)) AS dist,
    count_if(((y1 <= cy AND cy < y2) OR (y2 <= cy AND cy < y1)) AND x1 + (cy - y1) * dx / nullif(dy, 0) > cx) % 2 = 1 AS inside
  FROM (SELECT e.*, c.text_id, c.candidate, c.configured, c.final_name, c.cx, c.cy,
      greatest(0, least(1, coalesce(((c.cx - x1) * dx + (c.cy - y1) * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t
    FROM drawn e JOIN configured c ON c.doc_id = e.doc_id AND c.page = e.page)
  GROUP BY doc_id, page, contour_id, text_id HAVING min(sqrt((cx - x1 - t * dx) ** 2 + (cy - y1 - t * dy) ** 2)) <= 200),
scored AS (SELECT *, dist * CASE WHEN configured AND inside THEN 0.1 WHEN configured THEN 0.3 WHEN inside THEN 0.8 ELSE 1 END AS score FROM near)"""

ORACLE["contour_text_candidates"] = f"""{_NAMING}
SELECT doc_id, page, contour_id, text_id, candidate, configured, inside, round(dist, 6) AS dist, round(score, 6) AS score FROM scored"""

# Contours of a document in turn: a list of used texts goes from step to step.
_TURNS = f"""{_NAMING},
lists AS (SELECT s.doc_id, s.page, s.contour_id, (c.max_x - c.min_x) * (c.max_y - c.min_y) AS area,
    list(text_id ORDER BY score, text_id) AS options
  FROM scored s JOIN closed c ON c.doc_id = s.doc_id AND c.page = s.page AND c.contour_id = s.contour_id GROUP BY ALL),
turns AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY area, contour_id) AS turn FROM lists),
walk AS (
  SELECT DISTINCT doc_id, page, CAST(0 AS BIGINT) AS turn, CAST(-1 AS BIGINT) AS contour_id, CAST(NULL AS BIGINT) AS text_id, CAST([] AS BIGINT[]) AS used FROM turns
  UNION ALL
  SELECT doc_id, page, turn, contour_id, pick, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END
  FROM (SELECT w.doc_id, w.page, t.turn, t.contour_id, w.used, list_filter(t.options, lambda o: NOT list_contains(w.used, o))[1] AS pick
    FROM walk w JOIN turns t ON t.doc_id = w.doc_id AND t.page = w.page AND t.turn = w.turn + 1)),
named AS (SELECT c.doc_id, c.page, c.contour_id, w.text_id, s.final_name AS name, s.candidate AS original_name, s.cx AS name_x, s.cy AS name_y
  FROM closed c LEFT JOIN walk w ON w.doc_id = c.doc_id AND w.page = c.page AND w.contour_id = c.contour_id
    LEFT JOIN scored s ON s.doc_id = c.doc_id AND s.page = c.page AND s.contour_id = c.contour_id AND s.text_id = w.text_id)"""

ORACLE["contour_names"] = f"{_TURNS} SELECT * FROM named"

ORACLE["contour_rows"] = f"""{_TURNS},
refs AS (SELECT doc_id, page, contour_id, string_agg(seg_id, ' ' ORDER BY seg_id) AS refs FROM drawn GROUP BY ALL)
SELECT n.doc_id, n.page, n.contour_id AS id, refs, printf('%.3f', c.min_x) AS min_x, printf('%.3f', c.min_y) AS min_y, printf('%.3f', c.max_x) AS max_x,
  printf('%.3f', c.max_y) AS max_y, printf('%.3f', c.cx) AS cx, printf('%.3f', c.cy) AS cy, name, printf('%.3f', name_x) AS name_x, printf('%.3f', name_y) AS name_y
FROM named n JOIN refs USING (doc_id, page, contour_id) JOIN closed c USING (doc_id, page, contour_id) WHERE coalesce(name, '') <> ''"""

# Configurations: objects, operations m, states s and steps k straight from the orders.
CONFIG = """objs AS (SELECT o_orderkey % 50 AS doc_id, o_orderkey AS d, CAST(o_orderkey AS VARCHAR) AS obj_id, 'Obj ' || o_custkey AS obj_name,
    o_custkey AS c, o_orderstatus, o_orderpriority, o_totalprice FROM orders),
ops AS (SELECT *, obj_id || '_' || m AS operation_id, CASE WHEN m <> 2 THEN 'Fill ' || m ELSE 'Операция ' || m END AS operation_name,
    CASE WHEN m = 1 THEN 'FILL' END AS base_operation FROM (SELECT *, unnest(range(1, 2 + d % 3)) AS m FROM objs)),
states AS (SELECT *, operation_id || '_' || s AS state_id, CASE WHEN s = 1 THEN 'state ' || m ELSE 'Состояние ' || s END AS state_name
  FROM (SELECT *, unnest(range(1, 2 + (d + m) % 2)) AS s FROM ops)),
steps AS (SELECT *, state_id || '_' || k AS step_id, CASE WHEN k % 2 = 1 THEN 'step ' || k ELSE 'Шаг ' || k END AS step_name,
    CASE WHEN k = 2 THEN 0 WHEN k = 1 THEN CASE WHEN (d + s) % 3 = 0 THEN 0 ELSE 1 END ELSE 2 END AS step_pos
  FROM (SELECT *, unnest(range(1, 2 + (d + s) % 3)) AS k FROM states))"""

ORACLE["config_objects"] = f"""WITH {CONFIG}
SELECT doc_id, obj_id AS id, d AS n, d % 5 AS tech_type, obj_name AS name, 'TANK' || (c % 30) AS name_eplan, o_orderpriority AS name_BC,
  o_orderstatus AS base_tech_object, CAST(NULL AS BIGINT) AS cooper_param_number, obj_id AS n_text, CAST(NULL AS VARCHAR) AS attached_objects,
  'p=' || o_orderstatus AS properties, 'lt=D' || (c % 100) || 'LT9,none=Нет,x=4' AS equipment FROM objs"""

ORACLE["config_parameters"] = f"""WITH {CONFIG}
SELECT doc_id, obj_id, obj_name, '1' AS id, 'Volume' AS name, o_totalprice AS value, 'l' AS meter, 'V_1' AS nameLua, '1,' || (d % 7) AS oper FROM objs
UNION ALL SELECT doc_id, obj_id, obj_name, '2', '', CAST(c AS DOUBLE), '', '', '' FROM objs"""

ORACLE["config_operations"] = f"""WITH {CONFIG}
SELECT doc_id, operation_id AS id, operation_name AS name, base_operation, obj_id, obj_name, o_orderpriority AS k FROM ops"""

_OPENED = """'D' || (c % 80) || 'V' || s || '|{{"a":"D' || (c % 70) || 'LS' || m || '","b":5}}'""".replace("{{", "{").replace("}}", "}")
_CHECKED = "'D' || (c % 60) || 'LT' || s || '|7'"
ORACLE["config_states"] = f"""WITH {CONFIG}
SELECT doc_id, state_id AS id, state_name AS name, operation_id, operation_name, obj_id, {_OPENED} AS opened, '' AS closed, {_CHECKED} AS checked FROM states"""

ORACLE["config_state_data"] = f"""WITH {CONFIG}
SELECT doc_id, state_id AS id, '[[["DI' || (c % 40) || '","DO' || m || '"],["S3"]],["S9"]]' AS signals, '[{{"devices":["D' || (c % 50) || 'TE' || m || '"]}}]' AS devices_data,
  '["D' || (c % 60) || 'LT' || s || '",7]' AS checked FROM states"""

_TIME = "CASE WHEN k = 2 THEN '2.0' ELSE CAST(k AS VARCHAR) END"
ORACLE["config_steps"] = f"""WITH {CONFIG}
SELECT doc_id, step_id AS id, step_name AS name, CAST(k AS BIGINT) AS step_number, step_pos, state_id, state_name, operation_name,
  CAST(k AS BIGINT) AS time_param_n, {_TIME} AS time_param_n_text, CAST(CASE WHEN k < 3 THEN -1 END AS BIGINT) AS next_step_n, CASE WHEN k = 3 THEN 'T5' END AS next_step_n_text, 'D' || (c % 100) || 'V' || k AS opened, 'D' || (c % 90) || 'M' || m AS closed FROM steps"""

# All device mentions with their place: object, operation, state, part, step, field, position.
MENTIONS = """mentions AS (
  SELECT doc_id, 'D' || (c % 100) || 'LT9' AS name, 'equipment' AS source, obj_name AS parent, obj_id, d, 0 AS m, 0 AS s, 0 AS part, 0 AS sp, 0 AS f FROM objs
  UNION ALL SELECT doc_id, 'D' || (c % 80) || 'V' || s, 'opened_devices', obj_name || '.' || operation_name, obj_id, d, m, s, 0, 0, 0 FROM states
  UNION ALL SELECT doc_id, 'D' || (c % 70) || 'LS' || m, 'opened_devices_nested', obj_name || '.' || operation_name, obj_id, d, m, s, 0, 0, 1 FROM states
  UNION ALL SELECT doc_id, 'D' || (c % 60) || 'LT' || s, 'checked_devices', obj_name || '.' || operation_name, obj_id, d, m, s, 0, 0, 2 FROM states
  UNION ALL SELECT doc_id, 'D' || (c % 50) || 'TE' || m, 'devices_data', obj_name || '.' || operation_name, obj_id, d, m, s, 1, 0, 0 FROM states
  UNION ALL SELECT doc_id, 'D' || (c % 100) || 'V' || k, 'step_opened_devices', obj_name || '.' || operation_name || '.' || k, obj_id, d, m, s, 2, step_pos, 0 FROM steps
  UNION ALL SELECT doc_id, 'D' || (c % 90) || 'M' || m, 'step_closed_devices', obj_name || '.' || operation_name || '.' || k, obj_id, d, m, s, 2, step_pos, 1 FROM steps),
first_seen AS (SELECT doc_id, name, source, parent, obj_id FROM mentions
  QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY d, m, s, part, sp, f) = 1)"""

ORACLE["config_devices_first_seen"] = f"WITH {CONFIG}, {MENTIONS} SELECT * FROM first_seen"

SIGNALS = """signals AS (SELECT doc_id, name, 'DI_DO' AS "type", parent FROM (
  SELECT doc_id, 'DI' || (c % 40) AS name, obj_name || '.' || operation_name AS parent, d, m, s FROM states
  UNION ALL SELECT doc_id, 'DO' || m, obj_name || '.' || operation_name, d, m, s FROM states)
  QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY d, m, s) = 1)"""

ORACLE["config_signals"] = f"WITH {CONFIG}, {SIGNALS} SELECT * FROM signals"

ORACLE["object_operations"] = f"""WITH {CONFIG}
SELECT doc_id, operation_id AS id, obj_id, 'TANK' || (c % 30) AS name_eplan, d % 5 AS tech_type FROM ops"""

ORACLE["indexed_states"] = f"WITH {CONFIG} SELECT doc_id, state_id AS id FROM states WHERE m = 1"
ORACLE["orphan_states"] = f"WITH {CONFIG} SELECT doc_id, state_id AS id FROM states WHERE m <> 1"
ORACLE["states_of_operations"] = f"WITH {CONFIG} SELECT doc_id, operation_id, state_id AS id FROM states WHERE m = 1"

# Flat files: states m of an order, whose third is an orphan; steps 10, 2 and x of the first two states.
_FLAT_FILES = """files AS (SELECT o_orderkey AS d, CAST(o_orderkey AS VARCHAR) AS obj_id, o_custkey AS c, o_orderpriority FROM orders),
flat_states AS (SELECT *, obj_id || '_' || m AS operation_id, obj_id || '_' || m || '_1' AS state_id,
    CASE WHEN m = 1 THEN 'Run' ELSE 'state_' || obj_id || '_' || m || '_1' END AS state_name
  FROM (SELECT *, unnest(range(1, 2 + d % 3)) AS m FROM files WHERE o_orderpriority <> '5-LOW'))"""

ORACLE["flat_steps"] = f"""WITH {_FLAT_FILES}
SELECT d AS doc_id, state_id || '_' || k AS id, CASE WHEN k = 'x' THEN 'step x' ELSE 'Шаг ' || k END AS name, CAST(n AS BIGINT) AS step_number, place,
  state_id, state_name, operation_id, obj_id, CAST(c % 7 AS BIGINT) AS time_param_n, CAST(-1 AS BIGINT) AS next_step_n, 'V' || (c % 90) AS opened, 0 AS n_closed
FROM flat_states, (VALUES ('x', 0, 1), ('2', 2, 2), ('10', 10, 3)) k(k, n, place) WHERE m < 3"""

ORACLE["flat_orphans"] = f"""WITH {_FLAT_FILES}
SELECT d AS doc_id, 2 AS ord, state_id AS id, state_name AS name, operation_id FROM flat_states WHERE m = 3"""

ORACLE["flat_parameters"] = f"""WITH {_FLAT_FILES}
SELECT d AS doc_id, obj_id, pos AS param_pos, pid AS id, pname AS name, CASE WHEN pos = 0 THEN c ELSE 0 END AS value, CASE WHEN pos = 0 THEN '2,' || (c % 5) ELSE '' END AS oper
FROM files, (VALUES (0, '1', ''), (1, '', 'p')) p(pos, pid, pname)"""

USAGE = """used AS (
  SELECT doc_id, 'state' AS level, state_id AS owner_id, 'opened' AS action, 0 AS pos, 'D' || (c % 80) || 'V' || s AS device FROM states
  UNION ALL SELECT doc_id, 'state', state_id, 'opened', 1, '{"a":"D' || (c % 70) || 'LS' || m || '","b":5}' FROM states
  UNION ALL SELECT doc_id, 'state', state_id, 'checked', 0, 'D' || (c % 60) || 'LT' || s FROM states
  UNION ALL SELECT doc_id, 'state', state_id, 'checked', 1, '7' FROM states
  UNION ALL SELECT doc_id, 'step', step_id, 'opened', 0, 'D' || (c % 100) || 'V' || k FROM steps
  UNION ALL SELECT doc_id, 'step', step_id, 'closed', 0, 'D' || (c % 90) || 'M' || m FROM steps)"""

ORACLE["device_usage"] = f"WITH {CONFIG}, {USAGE} SELECT * FROM used"

ORACLE["device_operation_use"] = f"""WITH {CONFIG}, {MENTIONS}, {USAGE},
counts AS (SELECT doc_id, device, count(*) AS uses, count(DISTINCT owner_id) AS owners FROM used GROUP BY ALL)
SELECT f.doc_id, f.name AS lua_name, uses, owners FROM first_seen f LEFT JOIN counts c ON c.doc_id = f.doc_id AND c.device = f.name"""

ORACLE["tree_first_states"] = f"""WITH {CONFIG}
SELECT doc_id, operation_id, state_id AS id, CAST(row_number() OVER (PARTITION BY operation_id ORDER BY s) AS INT) AS rank, greatest(count(*) OVER (PARTITION BY operation_id) - 2, 0) AS more
FROM states QUALIFY row_number() OVER (PARTITION BY operation_id ORDER BY s) <= 2"""

ORACLE["tree_first_steps"] = f"""WITH {CONFIG}
SELECT doc_id, state_id, step_id AS id, CAST(row_number() OVER (PARTITION BY state_id ORDER BY step_pos) AS INT) AS rank, greatest(count(*) OVER (PARTITION BY state_id) - 2, 0) AS more
FROM steps QUALIFY row_number() OVER (PARTITION BY state_id ORDER BY step_pos) <= 2"""

ORACLE["list_heads"] = f"""WITH {CONFIG}
SELECT doc_id, state_id AS id, {_OPENED} || '|D' || (c % 60) || 'LT' || s AS first_3, 1 AS more_3, {_OPENED} || '|' || {_CHECKED} AS first_10, 0 AS more_10 FROM states"""

ORACLE["tree_first_operations"] = f"""WITH {CONFIG}
SELECT doc_id, obj_id, operation_id AS id, CAST(m AS INT) AS rank, CAST(0 AS BIGINT) AS more FROM ops"""

ORACLE["steps_in_order"] = f"WITH {CONFIG} SELECT doc_id, state_id, step_id AS id, CAST(k AS INT) AS place FROM steps"

ORACLE["operations_by_name"] = f"""WITH {CONFIG}
SELECT doc_id, obj_id, operation_id AS id, operation_name AS name, CAST(row_number() OVER (PARTITION BY obj_id ORDER BY operation_name, m) AS INT) AS place FROM ops"""

ORACLE["devices_by_label"] = f"""{_DRAWING}
SELECT doc_id, tech_object, page, contour_id, text_id, label AS pdf_name,
  CAST(row_number() OVER (PARTITION BY doc_id, tech_object ORDER BY label, page, contour_id, text_id) AS INT) AS place FROM matches"""

ORACLE["hierarchy_counts"] = f"""WITH {CONFIG}
SELECT o.doc_id, o.obj_id, o.obj_name, o.operation_id, o.operation_name AS name, count(DISTINCT s.state_id) AS n_states,
  count(DISTINCT k.step_id) AS n_steps, any_value(1 + o.d % 3) AS n_operations
FROM ops o LEFT JOIN states s USING (operation_id) LEFT JOIN steps k USING (state_id) GROUP BY ALL"""

ORACLE["operation_totals"] = f"""WITH {CONFIG}
SELECT doc_id, count(DISTINCT obj_id) AS objects_with_operations, count(*) AS operations FROM ops GROUP BY ALL"""

ORACLE["entity_summary"] = f"""WITH {CONFIG}, {MENTIONS}, {SIGNALS}
SELECT 'tech_objects' AS entity, count(*) AS n, first(concat_ws(';', obj_id, d, d % 5, obj_name, 'TANK' || (c % 30), o_orderpriority, o_orderstatus, 'p=' || o_orderstatus) ORDER BY doc_id, d) AS sample FROM objs
UNION ALL SELECT 'devices', count(*), NULL FROM first_seen
UNION ALL SELECT 'operations', count(*), NULL FROM ops
UNION ALL SELECT 'states', count(*), first(concat_ws(';', state_id, state_name, operation_id, operation_name, obj_name, {_OPENED}, '', {_CHECKED}) ORDER BY doc_id, d, m, s) FROM states
UNION ALL SELECT 'steps', count(*), first(concat_ws(';', step_id, step_name, state_id, state_name, operation_name, {_TIME}, CASE WHEN k = 3 THEN 'T5' ELSE '-' END, 'D' || (c % 100) || 'V' || k, 'D' || (c % 90) || 'M' || m) ORDER BY doc_id, d, m, s, step_pos) FROM steps
UNION ALL SELECT 'signals', count(*), NULL FROM signals
UNION ALL SELECT 'parameters', 2 * count(*), NULL FROM objs"""

ORACLE["operation_details"] = f"""WITH {CONFIG}
SELECT doc_id, operation_id AS id, operation_name AS name, obj_id, d % 5 AS tech_type, 'TANK' || (c % 30) AS name_eplan, CAST(2 AS BIGINT) AS n_parameters FROM ops"""

ORACLE["operation_parameters"] = f"""WITH {CONFIG}
SELECT doc_id, operation_id, obj_id, p.id, p.name, p.meter FROM ops, (VALUES ('1', 'Volume', 'l'), ('2', '', '')) p(id, name, meter) WHERE m = 1"""

ORACLE["operation_filter"] = f"WITH {CONFIG} SELECT doc_id, obj_id, obj_name, count(*) AS visible FROM ops WHERE m = 1 GROUP BY ALL"
ORACLE["object_filter"] = f"WITH {CONFIG} SELECT DISTINCT doc_id, obj_name AS name FROM ops"
ORACLE["operation_names"] = f"WITH {CONFIG} SELECT doc_id, operation_name AS name FROM ops"

ORACLE["first_operation_by_name"] = f"""WITH {CONFIG}
SELECT doc_id, operation_name AS name, first(operation_id ORDER BY d, m) AS operation_id FROM ops GROUP BY ALL"""

ORACLE["objects_by_name"] = f"""WITH {CONTOURS}, {CONFIG},
wanted AS (SELECT DISTINCT doc_id, name AS wanted FROM contours WHERE name IS NOT NULL)
SELECT w.doc_id, wanted, first(obj_id ORDER BY d) AS id, first(obj_name ORDER BY d) AS name, first('TANK' || (c % 30) ORDER BY d) AS name_eplan
FROM wanted w JOIN objs o ON o.doc_id = w.doc_id AND (wanted = obj_name OR wanted = 'TANK' || (c % 30) OR wanted = o_orderpriority)
GROUP BY w.doc_id, wanted"""

_GOOD = "event_type NOT IN ('error', 'view')"
ORACLE["event_devices"] = f"""SELECT CAST(event_id AS VARCHAR) AS path, 0 AS ord, 'E' || (user_id % 9) || 'V1' AS name, CAST(NULL AS VARCHAR) AS descr,
  'user,k' AS keys, CAST(user_id AS VARCHAR) AS "user", json_extract_string(props, '$.k') AS k, 2 AS n_extra FROM events WHERE {_GOOD}"""
ORACLE["event_nodes"] = f"""SELECT CAST(event_id AS VARCHAR) AS path, ord, CAST(ord + 1 AS BIGINT) AS node
FROM events, (VALUES (0), (1)) n(ord) WHERE {_GOOD}"""
ORACLE["config_rejects"] = """SELECT CAST(event_id AS VARCHAR) AS path, CASE event_type WHEN 'error' THEN 'no nodes' ELSE 'not a JSON object' END AS reason
FROM events WHERE event_type IN ('error', 'view')"""
ORACLE["file_statistics"] = f"""SELECT CAST(count_if({_GOOD}) AS BIGINT) AS files_ok, count(*) AS files, CAST(2 * count_if({_GOOD}) AS BIGINT) AS nodes, CAST(count_if({_GOOD}) AS BIGINT) AS devices FROM events"""

# Characters of the bytes 80 to FF but 98, in ISO-8859-1 and in windows-1251.
_LATIN, _CYRILLIC = (bytes(b for b in range(0x80, 0x100) if b != 0x98).decode(e) for e in ("latin-1", "cp1251"))
ORACLE["encoding_census"] = """SELECT doc_id, CASE WHEN lang = 'de' THEN 'latin-1'
  WHEN lang = 'fr' AND regexp_matches(regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g'), '[^\\x00-\\x7f]') THEN 'cp1251' ELSE 'utf-8' END AS encoding,
  CAST(length(text) + CASE WHEN lang = 'de' THEN 1 ELSE 0 END AS INT) AS chars,
  md5(CASE lang WHEN 'de' THEN regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g') || chr(152)
    WHEN 'fr' THEN translate(regexp_replace(text, '[^\\x{0}-\\x{ff}]', '?', 'g'), '""" + _LATIN + """', '""" + _CYRILLIC + """') ELSE text END) AS text_md5 FROM documents"""

# Similarity of every pair of distinct names.
ORACLE["fuzzy_objects"] = """WITH a AS (SELECT DISTINCT p_partkey % 10 AS doc_id, substr(replace(p_name, ' ', ''), CAST(1 + p_partkey % 3 AS INT)) || (p_size % 30) AS a FROM part),
b AS (SELECT DISTINCT p_partkey % 10 AS doc_id, replace(p_name, ' ', '') || (p_size % 40) AS b FROM part),
pairs AS (SELECT a.doc_id, a, b, upper(a) AS ua, upper(b) AS ub, CAST(length(a) AS DOUBLE) AS la, CAST(length(b) AS DOUBLE) AS lb FROM a JOIN b ON a.doc_id = b.doc_id),
scores AS (SELECT doc_id, a, b, CASE WHEN ua = ub THEN 1.0 WHEN contains(ub, ua) THEN la / lb WHEN contains(ua, ub) THEN lb / la
  ELSE len(list_filter(range(1, CAST(least(la, lb) AS INT) + 1), lambda i: left(ua, i) = left(ub, i))) / greatest(la, lb) END AS score FROM pairs)
SELECT doc_id, a AS contour_name, first(b ORDER BY score DESC, b) AS prefix, round(max(score), 6) AS score FROM scores WHERE score > 0.6 GROUP BY ALL"""

ORACLE["device_prefixes"] = f"""WITH {DEVICES} SELECT doc_id, regexp_extract(name, '^([A-Za-z]+[0-9]*)', 1) AS prefix, count(*) AS devices FROM devices GROUP BY ALL"""

ORACLE["scene_extent"] = f"""WITH {CONTOURS}
SELECT doc_id, min(min_x) - 50 AS x, min(min_y) - 50 AS y, max(max_x) - min(min_x) + 100 AS width, max(max_y) - min(min_y) + 100 AS height FROM contours GROUP BY ALL"""

ORACLE["document_counts"] = f"""{_DRAWING}
SELECT c.doc_id, c.n AS contours, coalesce(m.n, 0) AS devices FROM (SELECT doc_id, count(*) AS n FROM contours GROUP BY ALL) c
LEFT JOIN (SELECT doc_id, count(*) AS n FROM matches GROUP BY ALL) m USING (doc_id)"""

ORACLE["matched_objects"] = f"{_DRAWING} SELECT DISTINCT doc_id, tech_object FROM matches"
ORACLE["object_matches"] = f"{_DRAWING} SELECT doc_id, contour_id, text_id, label AS pdf_name FROM matches WHERE tech_object = 'TANK7'"
ORACLE["nested_objects"] = f"""{_DRAWING} SELECT doc_id, tech_object, page, contour_id, text_id, label AS pdf_name, count(*) OVER (PARTITION BY doc_id, tech_object) AS total,
  row_number() OVER (PARTITION BY doc_id, tech_object ORDER BY page, contour_id, text_id) = 1 AS first FROM matches"""

ORACLE["matched_rows"] = f"""{_DRAWING},
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, tech_object ORDER BY page, contour_id, text_id) = 1 AS first FROM matches),
firsts AS (SELECT o.doc_id, o.tech_object, first(c ORDER BY c.page, c.contour_id) AS c
  FROM {_KNOWN} o JOIN contours c ON c.doc_id = o.doc_id AND contains(upper(c.name), o.tech_object) GROUP BY ALL),
latest AS (SELECT doc_id, upper(name) AS n, arg_max(devices, ord) AS d FROM devices GROUP BY ALL)
SELECT m.doc_id, m.tech_object,
  CASE WHEN m.first THEN concat_ws(',', f.c.min_x, f.c.min_y, f.c.max_x, f.c.max_y) END AS bounds,
  CASE WHEN m.first THEN concat_ws(',', (f.c.min_x + f.c.max_x) / 2, (f.c.min_y + f.c.max_y) / 2) END AS center,
  concat_ws(';', 'device_type=' || regexp_extract(label, '^[A-Z]+'), 'lua_name=' || m.tech_object || label, 'pdf_name=' || label, 'x=' || printf('%.3f', cx), 'y=' || printf('%.3f', cy),
    'confidence=1.00', 'descr=' || l.d.descr, 'article=' || l.d.article, 'type=' || l.d.type, 'category=' || l.d.category, 'price=' || l.d.price, 'size=' || l.d.size) AS attributes
FROM ordered m JOIN firsts f ON f.doc_id = m.doc_id AND f.tech_object = m.tech_object JOIN latest l ON l.doc_id = m.doc_id AND l.n = m.tech_object || m.label"""

# Third devices have a bad number; devices in comments and raw texts are none.
ORACLE["matched_devices_read"] = """SELECT o_orderkey AS doc_id, 'TANK' || (o_orderkey % 9) || CASE WHEN n = 2 THEN '&' ELSE '' END AS tech_object, k - 1 AS ord,
  'T' || o_custkey || 'V' || k AS lua_name, CAST(o_custkey AS DOUBLE) AS x, CASE WHEN k = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS confidence,
  CASE WHEN k = 1 THEN o_orderpriority || ' <a> & "b"' ELSE '' END AS descr, CASE WHEN k = 1 THEN '0' || (o_orderkey % 10) END AS size, CASE WHEN k = 1 THEN 'size' ELSE 'foo' END AS open
FROM orders, (VALUES (1), (2)) n(n), (VALUES (1), (2)) k(k)"""

ORACLE["visualisation_contours"] = f"""WITH {CONTOURS}
SELECT doc_id, name, tech_object, concat_ws(',', min_x, min_y, max_x, max_y) AS bounds, concat_ws(',', (min_x + max_x) / 2, (min_y + max_y) / 2) AS center,
  CAST(max_x - min_x AS VARCHAR) AS width, CAST(max_y - min_y AS VARCHAR) AS height FROM contours WHERE tech_object IS NOT NULL"""

ORACLE["visualisation_devices"] = f"""{_DRAWING},
latest AS (SELECT doc_id, upper(name) AS n, arg_max(devices, ord) AS d FROM devices GROUP BY ALL)
SELECT m.doc_id, m.tech_object || label AS lua_name, label AS pdf_name, m.tech_object, CAST(cx AS VARCHAR) AS x, CAST(cy AS VARCHAR) AS y, '1.0' AS confidence,
  l.d.descr AS descr, l.d.article AS article, regexp_extract(label, '^[A-Z]+') AS device_type, l.d.category AS category, l.d.size AS size
FROM matches m JOIN latest l ON l.doc_id = m.doc_id AND l.n = m.tech_object || m.label"""

ORACLE["device_captions"] = f"""WITH {TEXTS}, {LABELS}
SELECT doc_id, text_id, label || CASE WHEN 1.0 - l_tax * 10 < 1.0 THEN printf(' (%.1f)', 1.0 - l_tax * 10) ELSE '' END AS caption FROM labels_"""

ORACLE["text_rows"] = f"""WITH {TEXTS}
SELECT doc_id, text_id AS id, text AS content, printf('%.3f', cx) AS x, printf('%.3f', cy) AS y, printf('%.3f', cx - 4) AS x1, printf('%.3f', cy - 2) AS y1, printf('%.3f', cx + 4) AS x2, printf('%.3f', cy + 2) AS y2, page FROM texts"""

ORACLE["segment_rows"] = f"""WITH {SEGMENTS}
SELECT doc_id, page, seg_id AS id, printf('%.3f', x1) AS x1, printf('%.3f', y1) AS y1, printf('%.3f', x2) AS x2, printf('%.3f', y2) AS y2, CASE WHEN dashed THEN 'True' ELSE 'False' END AS dashed FROM segments"""

_SCALED = "printf('%.3f', {} * 1.25)".format
_D = "'M ' || l_quantity || ',' || l_extendedprice || ' L -' || l_discount || ' ' || l_tax || 'Z'"
_D2 = f"'M ' || {_SCALED('l_quantity')} || ',' || {_SCALED('l_extendedprice')} || ' L -' || {_SCALED('l_discount')} || ' ' || {_SCALED('l_tax')} || 'Z'"
_P = "l_quantity || ',' || l_discount || '  x,3 ' || l_tax || ',' || l_extendedprice"
_P2 = f"{_SCALED('l_quantity')} || ',' || {_SCALED('l_discount')} || ' x,3 ' || {_SCALED('l_tax')} || ',' || {_SCALED('l_extendedprice')}"
ORACLE["svg_rescale"] = f"""SELECT {_ROW_ID} AS elem_id, {_pick(('path', 'polygon', 'rect'), 'l_linenumber % 3 + 1')} AS tag,
  CASE WHEN l_linenumber % 3 = 0 THEN {_D2} ELSE {_D} END AS d, CASE WHEN l_linenumber % 3 = 1 THEN {_P2} ELSE {_P} END AS points,
  'rotate(5) translate(' || {_SCALED('l_quantity')} || ',' || {_SCALED('l_tax')} || ') translate(' || l_tax || ')' AS transform,
  CASE WHEN l_returnflag = 'R' THEN '100%' ELSE CAST(l_quantity * 1.25 AS VARCHAR) END AS width FROM lineitem"""

ORACLE["svg_rescale_grammar"] = f"""SELECT {_ROW_ID} AS elem_id, 'M' || {_SCALED('l_quantity * 10')} || ',' || {_SCALED('l_extendedprice')} || CASE WHEN strpos(CAST(l_extendedprice AS VARCHAR), '.') > 0
    THEN ' ' || {_SCALED('0.5')} ELSE '' END || '-' || {_SCALED('l_tax')}
  || ' a' || {_SCALED('l_quantity')} || ',' || {_SCALED('l_tax')} || ' ' || l_linenumber || '0 ' || l_linenumber % 2 || l_linenumber // 2 % 2 || {_SCALED('l_quantity')}
  || '-' || {_SCALED('l_extendedprice')} || ' ' || {_SCALED('l_tax')} || ' ' || {_SCALED('0.5')} || ' 3e1 0,1 ' || {_SCALED('l_quantity')} || ' ' || {_SCALED('7')} || ' A1 2 3Z' AS d
FROM lineitem"""

ORACLE["number_texts"] = f"SELECT {_ROW_ID} AS id, printf('%.3f', l_tax / 16) AS tax, printf('%.3f', -l_extendedprice / 64) AS price FROM lineitem"

IMAGES = """images AS (SELECT 'img' || o_orderkey AS image_id, CAST(1024 + o_custkey % 20 * 160 AS INT) AS width, CAST(1024 + o_custkey % 7 * 300 AS INT) AS height FROM orders)"""
BOXES = f"""boxes AS (SELECT 'img' || l_orderkey AS image_id, {_ROW_ID} AS box_id, {_pick(CLASS_NAMES, 'l_linenumber')} AS name,
  CAST(l_partkey % 4000 AS INT) AS xmin, CAST(l_suppkey * 13 % 2500 AS INT) AS ymin, CAST(l_partkey % 4000 + l_quantity * 40 AS INT) AS xmax,
  CAST(l_suppkey * 13 % 2500 + l_quantity * 30 AS INT) AS ymax FROM lineitem)"""
_CLASS = " ".join(f"WHEN '{n}' THEN {c}" for n, c in CLASSES.items())
KNOWN_BOXES = f"known AS (SELECT *, CASE name {_CLASS} END AS cls FROM boxes WHERE CASE name {_CLASS} END IS NOT NULL)"
GRID = f"""grid AS (SELECT image_id, tile_x, unnest(range(0, height - {TILE}, {STEP})) AS tile_y
  FROM (SELECT *, unnest(range(0, width - {TILE}, {STEP})) AS tile_x FROM images))"""
TILES = f"""cut AS (SELECT b.image_id, box_id, cls, tile_x, tile_y, greatest(xmin, tile_x) - tile_x AS a, least(xmax, tile_x + {TILE}) - tile_x AS b,
    greatest(ymin, tile_y) - tile_y AS c, least(ymax, tile_y + {TILE}) - tile_y AS d
  FROM known b JOIN grid g ON g.image_id = b.image_id AND greatest(xmin, tile_x) < least(xmax, tile_x + {TILE}) AND greatest(ymin, tile_y) < least(ymax, tile_y + {TILE})),
labels_ AS (SELECT image_id, box_id, cls, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y, (a + b) / 2 / {TILE} AS cx, (b - a) / {TILE} AS bw,
    (c + d) / 2 / {TILE} AS cy, (d - c) / {TILE} AS bh FROM cut),
ids AS (SELECT image_id, tile_x, tile_y, row_number() OVER (PARTITION BY image_id ORDER BY tile_y, tile_x) - 1 AS tile_id
  FROM (SELECT DISTINCT image_id, tile_x, tile_y FROM labels_))"""
_TILED = f"WITH {IMAGES}, {BOXES}, {KNOWN_BOXES}, {GRID}, {TILES}"

ORACLE["class_filter"] = f"WITH {BOXES}, {KNOWN_BOXES} SELECT image_id, box_id, cls FROM known"
ORACLE["tile_grid"] = f"WITH {IMAGES}, {GRID} SELECT image_id, CAST(tile_x AS INT) AS tile_x, CAST(tile_y AS INT) AS tile_y FROM grid"
ORACLE["tile_labels"] = f"{_TILED} SELECT image_id, box_id, cls, tile_x, tile_y, cx, bw, cy, bh FROM labels_"
ORACLE["tile_numbers"] = f"{_TILED} SELECT * FROM ids"


def _short(v: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.11f', {v}), '0+$', ''), '\\.$', '.0')"


ORACLE["label_lines"] = f"""{_TILED} SELECT image_id || '_' || tile_id AS tile_name, box_id,
  cls || ' ' || {_short('cx')} || ' ' || {_short('cy')} || ' ' || {_short('bw')} || ' ' || {_short('bh')} AS line FROM labels_ JOIN ids USING (image_id, tile_x, tile_y)"""

ORACLE["split_images"] = """SELECT image_id, CASE WHEN rank <= floor(n * 0.8) THEN 'train' ELSE 'val' END AS subset FROM (
  SELECT 'img' || o_orderkey AS image_id, row_number() OVER (ORDER BY left(md5('img' || o_orderkey || ':42'), 15), 'img' || o_orderkey) AS rank, count(*) OVER () AS n
  FROM (SELECT DISTINCT o_orderkey FROM orders))"""

ORACLE["split_counts"] = """SELECT 'train' AS subset, CAST(floor(count(*) * 0.8) AS BIGINT) AS images FROM orders
UNION ALL SELECT 'val', CAST(count(*) - floor(count(*) * 0.8) AS BIGINT) FROM orders"""

_LIST = ", ".join(f"('{c}')" for c in CLASSES)
ORACLE["label_vocabulary"] = f"""WITH {BOXES}, classes(label) AS (VALUES {_LIST})
SELECT label, 0 AS grp FROM classes UNION ALL SELECT DISTINCT name, 1 FROM boxes WHERE name NOT IN (SELECT label FROM classes)"""

ANNOTATED = f"""texts AS (SELECT {_ROW_ID} AS image_id, l_linenumber AS n, l_returnflag || ' & ' || l_linestatus AS name, l_returnflag = 'R' AS verified, CAST(l_orderkey AS INT) AS width,
  CAST(l_partkey % 4000 AS INT) AS xmin, CAST(l_suppkey * 13 % 2500 AS INT) AS ymin FROM lineitem)"""
ORACLE["annotation_text_boxes"] = f"""WITH {ANNOTATED} SELECT image_id, 0 AS box_id, name, xmin, ymin, xmin + 40 AS xmax, ymin + 30 AS ymax, n % 2 = 1 AS difficult
FROM texts WHERE n NOT IN (2, 3, 5, 6)"""
ORACLE["annotation_text_sizes"] = f"WITH {ANNOTATED} SELECT image_id, width, 20 AS height, verified FROM texts WHERE n NOT IN (3, 5, 6)"
ORACLE["annotation_text_rejects"] = f"""WITH {ANNOTATED} SELECT image_id, CAST(NULL AS INT) AS box_id, 'broken' AS reason FROM texts WHERE n IN (3, 5, 6)
UNION ALL SELECT image_id, 1, 'missing' FROM texts WHERE n NOT IN (3, 5, 6) UNION ALL SELECT image_id, 0, 'unreadable' FROM texts WHERE n = 2"""

ORACLE["annotation_precedence"] = """SELECT 'img' || l_orderkey AS stem, 'a/img' || l_orderkey || CASE WHEN bool_or(l_returnflag = 'R') THEN '.xml' ELSE '.txt' END AS path
FROM lineitem GROUP BY l_orderkey"""

ORACLE["clamped_shapes"] = f"""WITH {IMAGES}, {BOXES}
SELECT image_id, box_id, xmin > width OR xmax > width OR ymin > height OR ymax > height AS changed, CAST(least(xmin, width) AS DOUBLE) AS x0, CAST(least(ymin, height) AS DOUBLE) AS y0,
  CAST(least(xmax, width) AS DOUBLE) AS x1, CAST(least(ymax, height) AS DOUBLE) AS y1 FROM boxes JOIN images USING (image_id)"""

ORACLE["annotation_files"] = f"""WITH {IMAGES}, {BOXES},
lists AS (SELECT image_id, string_agg(concat_ws(':', name, xmin, ymin, xmax, ymax), '|' ORDER BY box_id) AS boxes FROM boxes GROUP BY ALL),
every AS (SELECT image_id, width, height FROM images
  UNION ALL SELECT 'bare' || c_custkey, CAST(640 + c_custkey % 9 * 200 AS INT), CAST(480 + c_nationkey * 10 AS INT) FROM customer)
SELECT image_id, CASE WHEN width > 2000 THEN 'yes' END AS _verified, width, height, coalesce(boxes, '') AS boxes FROM every LEFT JOIN lists USING (image_id)"""

_X, _Y = "(l_quantity * 15.5::DOUBLE + l_partkey % 50)", "(l_suppkey % 40 * 11.25::DOUBLE + l_quantity)"
DETECTED = f"""found AS (SELECT 'page' || (l_orderkey // 100) AS image_id, l_orderkey // 100 AS doc_id,
  (CAST(trunc({_X}) AS INT) + l_partkey % 4 * 768) * 0.25::DOUBLE AS x1, (CAST(trunc({_Y}) AS INT) + l_suppkey % 2 * 768) * 0.25::DOUBLE AS y1,
  (CAST(trunc({_X} + 40.5) AS INT) + l_partkey % 4 * 768) * 0.25::DOUBLE AS x2, (CAST(trunc({_Y} + 30.25) AS INT) + l_suppkey % 2 * 768) * 0.25::DOUBLE AS y2
  FROM lineitem WHERE l_discount * 10 >= 0.25)"""
ORACLE["detection_boxes"] = f"WITH {DETECTED} SELECT image_id, doc_id, x1, y1, x2, y2 FROM found"

_PX, _PY = "CAST(l_partkey % 1000 AS DOUBLE)", "CAST(l_suppkey * 7 % 500 AS DOUBLE)"
PRIMS = f"""prims AS (SELECT l_orderkey // 100 AS doc_id, {_ROW_ID} AS prim_id, {_pick(('l', 're', 'c', 'qu'), 'l_linenumber % 4 + 1')} AS kind,
  {_PX} AS x, {_PY} AS y, l_quantity AS q, l_linenumber AS n, CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE l_tax END AS stroke FROM lineitem),
probes AS (
  SELECT doc_id, prim_id, 3 AS tol, (x + x + q) / 2 AS px, (y + y + n) / 2 AS py FROM prims WHERE kind = 'l'
  UNION ALL SELECT doc_id, prim_id, 5, x + q / 2, y + CAST(n AS DOUBLE) / 2 FROM prims WHERE kind = 're'
  UNION ALL SELECT doc_id, prim_id, 5, x + (i + 0.5) * q, y + i FROM prims, range(0, 4) r(i) WHERE kind = 'c'),
spots AS (SELECT DISTINCT doc_id, x1, y1, x2, y2 FROM found),
hits AS (SELECT DISTINCT p.prim_id FROM probes p JOIN spots f ON f.doc_id = p.doc_id
  AND px BETWEEN x1 - tol AND x2 + tol AND py BETWEEN y1 - tol AND y2 + tol),
classified AS (SELECT p.*, CASE WHEN kind = 'qu' THEN 'other' WHEN h.prim_id IS NULL THEN 'pipe' ELSE 'device' END AS class
  FROM prims p LEFT JOIN hits h USING (prim_id))"""
ORACLE["primitive_classes"] = f"WITH {DETECTED}, {PRIMS} SELECT doc_id, prim_id, kind, class, stroke FROM classified"
ORACLE["class_counts"] = f"""WITH {DETECTED}, {PRIMS} SELECT doc_id, CAST(count_if(class = 'device') AS BIGINT) AS devices, CAST(count_if(class = 'pipe') AS BIGINT) AS pipes,
  CAST(count_if(class = 'other') AS BIGINT) AS others FROM classified GROUP BY ALL"""
ORACLE["text_classes"] = f"""WITH {DETECTED}, {PRIMS}
SELECT doc_id, prim_id AS text_id, CASE WHEN EXISTS (SELECT 1 FROM spots f WHERE f.doc_id = p.doc_id AND x BETWEEN x1 - 5 AND x2 + 5 AND y BETWEEN y1 - 5 AND y2 + 5)
  THEN 'device' ELSE 'pipe' END AS class FROM prims p"""
