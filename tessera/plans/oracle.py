"""The same queries in SQL, over the same tables, written from the rules and not from the plans."""

from __future__ import annotations

_READINGS = """
R0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos FROM lineitem),
R1 AS (SELECT l_orderkey AS item_id, pos, CAST(100000 + 7 * l_orderkey AS VARCHAR) AS base, CAST(100001 + 7 * l_orderkey AS VARCHAR) AS near, l_partkey AS p,
  least(CAST(1 AS DOUBLE), CAST(0.4 AS DOUBLE) + l_quantity / CAST(80 AS DOUBLE) + l_tax / CAST(2 AS DOUBLE)) AS confidence,
  CAST(40 AS DOUBLE) + CAST(4 AS DOUBLE) * l_quantity AS w, CAST(10 AS DOUBLE) + CAST(600 AS DOUBLE) * l_discount AS h,
  ['tag_crop_1_strict_white', 'tag_crop_1_strict_white_enhanced', 'fallback_full', 'fallback_full_recheck', 'fallback_lower'][l_linenumber % 5 + 1] AS crop,
  ['original', 'cw90', 'ccw90', 'rot180'][l_suppkey % 4 + 1] AS turn FROM R0),
R AS (SELECT item_id, pos, confidence, crop, CASE WHEN turn = 'original' AND crop = 'fallback_full' THEN 'auto_best' ELSE turn END AS rotation,
  CASE WHEN p % 5 = 0 AND item_id % 40 = 0 THEN ' ' WHEN p % 29 = 0 THEN '' WHEN p % 23 = 0 THEN 'N/A' WHEN p % 19 = 0 THEN reverse(base) WHEN p % 17 = 0 THEN near
    WHEN p % 13 = 0 THEN 'SKU' || CAST(p AS VARCHAR) || 'X' WHEN p % 11 = 0 THEN replace(base, '0', 'O') ELSE base END AS text,
  least(greatest((h / CAST(60 AS DOUBLE)) * CAST(0.65 AS DOUBLE) + (w / CAST(260 AS DOUBLE)) * CAST(0.35 AS DOUBLE), CAST(0.05 AS DOUBLE)), CAST(1 AS DOUBLE)) AS prominence FROM R1)"""
_CANDIDATES = _READINGS + """,
C0 AS (SELECT *, list_filter(regexp_extract_all(translate(trim(text), 'OoIl|SsB', '00111558'), '[A-Za-z0-9]+'), lambda t: regexp_matches(t, '^[0-9]{5,8}$')) AS vals FROM R),
C AS (SELECT item_id, pos, rotation, crop, confidence, unnest(vals) AS value, unnest(range(len(vals))) AS match_no,
  ((confidence * CAST(0.68 AS DOUBLE) + prominence * CAST(0.22 AS DOUBLE)) + CAST(0.1 AS DOUBLE)) + CAST(CASE WHEN crop = 'fallback_full' AND rotation = 'auto_best' THEN -0.06
    WHEN crop = 'fallback_full_recheck' THEN 0.015 ELSE 0 END AS DOUBLE) AS score, regexp_replace(crop, '_enhanced$', '') AS canon FROM C0 WHERE len(vals) > 0)"""
_VALUES = _CANDIDATES + """,
V0 AS (SELECT *, row_number() OVER (PARTITION BY item_id, value ORDER BY score DESC, pos, match_no) AS k FROM C),
V1 AS (SELECT item_id, value, count(DISTINCT (canon, rotation)) AS source_count, count(DISTINCT CASE WHEN confidence >= 0.6 THEN (canon, rotation) END) AS strong,
  min((pos, match_no)) AS seen FROM C GROUP BY ALL),
V AS (SELECT a.item_id, a.value, least(b.score + least(greatest(0, a.strong - 1) * CAST(0.025 AS DOUBLE), CAST(0.08 AS DOUBLE)), CAST(1 AS DOUBLE)) AS score, source_count, strong, seen,
  b.confidence AS best_confidence, b.rotation AS best_rotation, b.crop AS best_crop FROM V1 a JOIN V0 b ON a.item_id = b.item_id AND a.value = b.value AND b.k = 1),
P AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seen) AS place FROM V)"""
_REVERSE = _VALUES + """,
X0 AS (SELECT b.item_id, v.value, v.score, v.seen FROM P b JOIN V v ON b.item_id = v.item_id AND b.place = 1 AND v.value <> b.value
  WHERE (v.best_crop = b.best_crop AND list_sort([v.best_rotation, b.best_rotation]) IN (['ccw90', 'cw90'], ['original', 'rot180']))
    OR v.value = reverse(b.value) OR v.value = translate(reverse(b.value), '69', '96')),
X AS (SELECT item_id, value AS reverse_value, score AS reverse_score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, seen) AS k FROM X0) WHERE k = 1)"""
_TEXTS = """
T AS (SELECT item_id, coalesce(string_agg(text, ' | ' ORDER BY pos) FILTER (WHERE trim(text) <> ''), '') AS raw_text FROM R GROUP BY item_id)"""
_DECISION = _REVERSE + "," + _TEXTS + """,
D0 AS (SELECT t.item_id, raw_text, a.value, a.score, a.source_count, a.strong, a.best_confidence, a.best_rotation, a.best_crop, b.value AS r_value, b.score AS r_score,
  b.source_count AS r_sources, b.best_crop AS r_crop, b.best_rotation AS r_rotation, reverse_value, reverse_score,
  round(least(greatest(a.score, 0), 1), 4) AS confidence, CASE WHEN b.score IS NULL THEN 1 ELSE a.score - b.score END AS margin, a.score - reverse_score AS gap
  FROM T t LEFT JOIN P a ON t.item_id = a.item_id AND a.place = 1 LEFT JOIN P b ON t.item_id = b.item_id AND b.place = 2 LEFT JOIN X x ON t.item_id = x.item_id),
D1 AS (SELECT *, greatest(CAST(0.45 AS DOUBLE), CASE WHEN strong < 2 THEN 0.88 ELSE 0.72 END) AS needed, coalesce(gap >= 0.08 AND best_confidence >= 0.94, false) AS resolved,
  r_value IS NOT NULL AND r_value IS DISTINCT FROM reverse_value AND margin < 0.10 AND r_score >= 0.72
    AND NOT (strong >= 2 AND r_sources = 1 AND r_crop = 'fallback_full' AND r_rotation = 'auto_best' AND score > r_score) AS rival FROM D0),
D2 AS (SELECT *, CASE WHEN raw_text = '' THEN 'no_text' WHEN value IS NULL THEN 'no_number' WHEN gap < 0.08 THEN 'reverse_conflict' WHEN rival THEN 'competing'
  WHEN strong < 2 AND (confidence < needed OR NOT resolved) THEN 'single_source' WHEN confidence < needed THEN 'low_score'
  WHEN reverse_value IS NOT NULL THEN 'accepted_after_reverse' ELSE 'accepted' END AS branch FROM D1),
D AS (SELECT *, CASE WHEN branch = 'no_text' THEN 'OCR_FAILED' WHEN branch = 'no_number' THEN 'TAG_NOT_FOUND' WHEN branch LIKE 'accepted%' THEN 'OK' ELSE 'REVIEW_REQUIRED' END AS status FROM D2)"""

#: The decision at every checkpoint: readings up to it, under an id of item and checkpoint.
_REPLAY = _READINGS + """,
KP AS (SELECT DISTINCT item_id, CAST(floor((pos + 1) / 2) AS BIGINT) AS cp FROM R),
RX AS (SELECT r.* REPLACE (r.item_id * 64 + k.cp AS item_id) FROM R r JOIN KP k ON r.item_id = k.item_id AND floor((r.pos + 1) / 2) <= k.cp)""" + _DECISION[len(_READINGS) :].replace(
    "FROM R)", "FROM RX)").replace("FROM R GROUP", "FROM RX GROUP")

_PHOTOS = """
H0 AS (SELECT CAST(floor(o_orderkey / 20000) AS BIGINT) AS batch, o_orderkey AS item, o_orderkey AS k, 'IMG_' || CAST(o_custkey % 50 AS VARCHAR) || '_b' || ['', '_2', '_3', '_2_2', '_40', '', '', '', '', '', ''][o_orderkey % 11 + 1] AS stem0,
  CASE WHEN o_orderkey % 13 = 5 THEN 'REVIEW_REQUIRED' WHEN o_orderkey % 17 = 3 THEN 'OCR_FAILED' WHEN o_orderkey % 19 = 7 THEN 'TAG_NOT_FOUND' WHEN o_orderkey % 101 = 9 THEN 'ERROR' ELSE 'OK' END AS status
  FROM orders),
H AS (SELECT *, CASE WHEN status IN ('OCR_FAILED', 'TAG_NOT_FOUND', 'ERROR') THEN '' ELSE CAST(100000 + k % 997 AS VARCHAR) END AS tag,
  status = 'OK' AND k % 7 <> 2 AND k % 9 <> 4 AS removed, status = 'OK' AND k % 7 <> 2 AND k % 9 = 4 AS waits, status = 'OK' AND k % 7 = 2 AS plain FROM H0)"""


def _walk(rows: str, place: str, into: str) -> str:
    """Names given one by one: of rows (place, stem, ending, ord) each takes its stem, or the first stem_n that is not used yet. Only names that
    differ in trailing numbers alone can meet, so each such family is walked on its own."""
    same = " AND ".join(f"w.{c} IS NOT DISTINCT FROM s.{c}" for c in (*place.split(", "), "ending", "root"))
    at = ", ".join(f"s.{c}" for c in place.split(", "))
    free = "CASE WHEN NOT list_contains(w.used, s.stem) THEN 1 ELSE list_filter(range(2, len(w.used) + 3), lambda n: NOT list_contains(w.used, s.stem || '_' || CAST(n AS VARCHAR)))[1] END"
    return f"""
{into}_0 AS (SELECT *, regexp_replace(stem, '(_[0-9]+)+$', '') AS root FROM {rows}),
{into}_1 AS (SELECT *, row_number() OVER (PARTITION BY {place}, ending, root ORDER BY ord) AS turn FROM {into}_0),
{into}_2 AS (SELECT {at.replace("s.", "")}, ending, root, ord, turn, stem, CAST(1 AS BIGINT) AS n, [stem] AS used FROM {into}_1 WHERE turn = 1
  UNION ALL SELECT {at}, s.ending, s.root, s.ord, s.turn, s.stem, {free}, list_append(w.used, CASE WHEN {free} = 1 THEN s.stem ELSE s.stem || '_' || CAST({free} AS VARCHAR) END)
  FROM {into}_2 w JOIN {into}_1 s ON {same} AND s.turn = w.turn + 1),
{into} AS (SELECT {at.replace("s.", "")}, ending, ord, n, used[-1] || ending AS final FROM {into}_2)"""


#: A job is started by its first event and ended by its first purchase or error; what comes later changes nothing.
_JOBS = """
J0 AS (SELECT user_id * 100 + event_id % 37 AS job_id, event_type AS t, CAST(floor(value) AS BIGINT) AS done, props, row_number() OVER (PARTITION BY user_id * 100 + event_id % 37 ORDER BY ts, event_id) AS k,
  row_number() OVER (ORDER BY ts, event_id) AS turn FROM events),
J1 AS (SELECT *, min(k) FILTER (t IN ('purchase', 'error')) OVER (PARTITION BY job_id) AS over FROM J0),
JS AS (SELECT job_id, coalesce(CASE max(t) FILTER (k = over) WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' END, CASE WHEN count(*) FILTER (t IN ('view', 'click')) > 0 THEN 'RUNNING' ELSE 'QUEUED' END) AS state,
  CASE WHEN max(t) FILTER (k = over) = 'purchase' THEN 80 ELSE coalesce(least(greatest(arg_max(done, k) FILTER (t IN ('view', 'click') AND (over IS NULL OR k < over)), 0), 80), 0) END AS done,
  count(*) AS events, coalesce(max(props) FILTER (k = over AND t = 'error'), '') AS error, max(over) IS NULL AS running, min(turn) AS started FROM J1 GROUP BY job_id)"""


def _names(transparent_only: bool) -> str:
    white, clear = ("plain", "removed") if transparent_only else ("plain OR removed", "removed")
    file = "removed" if transparent_only else "false"
    return "WITH RECURSIVE" + _PHOTOS + f""",
N AS (SELECT *, sum(CAST(status = 'OK' AS INT)) OVER w AS nth_tag, sum(CAST({white} AS INT)) OVER w AS nth_white, sum(CAST({clear} AS INT)) OVER w AS nth_clear
  FROM H WINDOW w AS (PARTITION BY batch, tag ORDER BY item)),
M AS (SELECT *, CASE WHEN waits THEN 'background_review' WHEN status <> 'OK' THEN 'review_required' WHEN {file} THEN 'transparent_images' ELSE 'processed_images' END AS output_folder,
  CASE WHEN waits THEN 'BG_REVIEW_' WHEN status <> 'OK' THEN 'REVIEW_' END || stem0 AS review_stem FROM N),
V AS (SELECT batch, output_folder, review_stem AS stem, '.png' AS ending, item AS ord FROM M WHERE review_stem IS NOT NULL),{_walk("V", "batch, output_folder", "VN")},
L AS (SELECT M.*, CASE WHEN review_stem IS NULL THEN (CASE WHEN M.output_folder = 'transparent_images' THEN nth_clear ELSE nth_white END) ELSE VN.n END AS nth FROM M LEFT JOIN VN ON M.item = VN.ord)
SELECT item, CASE WHEN review_stem IS NULL THEN (CASE WHEN nth_tag > 1 OR nth > 1 THEN 'DUPLICATE_TAG' ELSE 'OK' END) WHEN waits THEN 'REVIEW_REQUIRED' ELSE status END AS status, output_folder,
  coalesce(review_stem, tag) || CASE WHEN nth > 1 THEN '_' || CAST(CAST(nth AS BIGINT) AS VARCHAR) ELSE '' END || '.png' AS final_filename,
  CASE WHEN removed THEN tag || CASE WHEN nth_clear > 1 THEN '_' || CAST(CAST(nth_clear AS BIGINT) AS VARCHAR) ELSE '' END || '.png' ELSE '' END AS transparent_filename FROM L"""


_REPORT = """
G0 AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS item_id, 'IMG_' || CAST(o_custkey AS VARCHAR) || '.jpg' AS original_filename, o_orderpriority,
  CASE WHEN o_orderkey % 13 = 5 THEN 'REVIEW_REQUIRED' WHEN o_orderkey % 17 = 3 THEN 'OCR_FAILED' WHEN o_orderkey % 19 = 7 THEN 'TAG_NOT_FOUND' WHEN o_orderkey % 23 = 1 THEN 'DUPLICATE_TAG'
    WHEN o_orderkey % 101 = 9 THEN 'ERROR' ELSE 'OK' END AS status FROM orders),
G AS (SELECT *, CASE WHEN status IN ('OCR_FAILED', 'TAG_NOT_FOUND', 'ERROR') THEN '' ELSE CAST(100000 + k % 9973 AS VARCHAR) END AS detected_tag_number,
  CASE WHEN k % 31 = 0 THEN 'ai_review' WHEN k % 29 = 0 THEN 'background_review' WHEN status = 'OK' THEN 'processed_images' ELSE 'review_required' END AS output_folder,
  CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN 'NA' ELSE o_orderpriority END AS notes FROM G0)"""
_MATCHES = _REPORT + """,
E AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey * 7 AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 'IMG_' || CAST(c_custkey AS VARCHAR) || '.jpg' WHEN c_custkey % 2 = 0 THEN ' ' ELSE 'nowhere' END AS selector FROM customer),
S AS (SELECT DISTINCT selector FROM E WHERE trim(selector) <> ''),
MI AS (SELECT selector, item_id, original_filename, 'item' AS "by" FROM S JOIN G ON selector = item_id),
MM AS (SELECT * FROM MI UNION ALL SELECT selector, item_id, original_filename, 'file' FROM S JOIN G ON selector = original_filename WHERE selector NOT IN (SELECT selector FROM MI))"""

_MEMBERS = """
A0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn, l_partkey AS p, l_suppkey AS s,
  'photo ' || CAST(l_partkey % 20 AS VARCHAR) || ['', '_2', '_3', '_2_2', '_40', '', '', '', '', '', '', ''][l_partkey % 12 + 1] || '.jpg' AS leaf FROM lineitem),
A AS (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_orderkey % 97 + 1 END AS archive, l_orderkey * 64 + rn AS pos, s % 61 = 0 AS enc, p, s, leaf,
  CASE WHEN p % 41 = 0 OR p % 43 = 0 OR p % 47 = 0 THEN 'bad' WHEN p % 37 = 0 THEN 'ok' WHEN p % 31 = 0 THEN 'ok' WHEN p % 29 = 0 OR p % 53 = 0 THEN 'skip' ELSE 'ok' END AS sort,
  CASE WHEN p % 37 = 0 THEN 'set/' || leaf WHEN p % 31 = 0 THEN leaf ELSE 'set' || CAST(s % 5 AS VARCHAR) || '/' || leaf END AS inside,
  CAST(floor(l_extendedprice * CASE WHEN p % 50 = 7 THEN 2500 ELSE 20 END) AS BIGINT) AS size FROM A0),
TOT AS (SELECT archive, count(*) AS members, CAST(sum(greatest(size, 0)) AS BIGINT) AS bytes FROM A GROUP BY archive),
AV AS (SELECT *, CASE WHEN members > 5000 THEN 'too many members' WHEN bytes > 4294967296 THEN 'too large' ELSE 'ok' END AS verdict FROM TOT),
AC AS (SELECT pos, a.archive, leaf, inside, CASE WHEN v.verdict <> 'ok' THEN v.verdict WHEN sort = 'skip' THEN 'skipped' WHEN sort = 'bad' THEN 'unsafe path' WHEN enc THEN 'encrypted'
  WHEN size > 157286400 THEN 'file too large' WHEN size >= 1048576 AND size / greatest(CAST(floor(size / (1 + p % 260)) AS BIGINT), 1) > 200 THEN 'suspicious ratio' ELSE 'taken' END AS verdict
  FROM A a JOIN AV v ON a.archive = v.archive)"""

_MANIFEST = """
F0 AS (SELECT p_partkey AS k, 'models/' || CAST(p_partkey AS VARCHAR) || '.bin' AS path, CAST(p_size * 1000 + p_partkey AS BIGINT) AS size, p_name FROM part),
F1 AS (SELECT CASE WHEN k % 19 = 0 THEN path || '.new' ELSE path END AS path, k % 13 = 0 AS cut, k % 17 = 0 AS other FROM F0 WHERE k % 11 <> 0)"""

_CROPS = """
K0 AS (SELECT l_orderkey AS item_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS pos,
  CASE WHEN l_linenumber = 1 THEN 'fallback_full' WHEN l_linenumber = 2 THEN 'fallback_lower' WHEN l_linenumber % 2 = 0 THEN 'tag_crop_1_strict_white' ELSE 'tag_crop_1_soft_tag' END AS label,
  l_partkey * 7 % 400 AS x, l_suppkey * 5 % 300 AS y, CAST(20 + l_quantity * 6 AS BIGINT) AS w, 20 + CAST(floor(l_discount * 1500 + 0.5) AS BIGINT) AS h,
  l_tax * 10 AS light, l_quantity / 60 AS sat, l_discount * 0.9 AS dark FROM lineitem),
K AS (SELECT *, CAST(w * h AS DOUBLE) * CAST(0.85 AS DOUBLE) AS area, CAST(1600 * 1200 AS DOUBLE) AS im FROM K0),
KS AS (SELECT *, round((light * 0.24 + (1 - least(sat, 1)) * 0.18 + least(area / greatest(w * h, 1), 1) * 0.16 + least(dark / 0.07, 1) * 0.24
    + (1 - least(abs(w * h - im * 0.018) / greatest(im * 0.05, 1), 1)) * 0.18) * CASE WHEN x <= 3 OR y <= 3 OR x + w >= 1597 OR y + h >= 1197 THEN 0.72 ELSE 1 END
    + CASE WHEN label LIKE '%strict_white' THEN 0.06 ELSE 0 END + CASE WHEN least(w, h) >= 55 AND greatest(w, h) >= 150 THEN 0.03 ELSE 0 END, 9) AS score,
  w * h BETWEEN im * 0.0012 AND im * 0.14 AND area BETWEEN im * 0.00035 AND im * 0.12 AND w >= 24 AND h >= 24 AND w / h BETWEEN 0.18 AND 7 AS fits FROM K)"""

_MASKS = """
B0 AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS rn FROM lineitem),
B1 AS (SELECT l_orderkey * 64 + rn AS mask_id, l_discount / 2 AS fg_loss, l_tax / 10 AS loss, l_discount / 20 AS holes, l_partkey % 30 AS lost, l_suppkey % 5 AS missing, l_tax / 40 AS residue,
  l_discount / 300 AS patch, l_partkey % 7 <> 0 AS good, l_quantity / 52 AS foreground, l_tax / 8 AS solid, l_discount * 9 AS soft, l_partkey % 170 AS parts, l_quantity / 100 AS coverage,
  l_discount * 150 AS g50, l_discount * 150 + l_tax * 300 AS g90 FROM B0),
B AS (SELECT *, list_filter([CASE WHEN fg_loss > 0.02 AND (loss > 0.0008 OR lost > 0) THEN 'cleanup_removed' END, CASE WHEN loss > 0.0008 THEN 'supported_loss' END,
    CASE WHEN lost > 0 THEN 'lost_parts' END, CASE WHEN holes > 0.0004 THEN 'holes' END, CASE WHEN missing > 0 THEN 'missing_parts' END,
    CASE WHEN residue > 0.0012 OR patch > 0.00025 THEN 'residue' END], lambda r: r IS NOT NULL) AS reasons,
  list_filter([CASE WHEN loss > 0.008 THEN 'supported_loss' END, CASE WHEN holes > 0.008 THEN 'holes' END, CASE WHEN lost >= 25 THEN 'lost_parts' END, CASE WHEN missing >= 3 THEN 'missing_parts' END],
    lambda r: r IS NOT NULL) AS great FROM B1)"""

_PICTURES = """
v AS (SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT image_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
z AS (SELECT image_id, CAST(floor(sqrt(len(e))) AS BIGINT) AS side, list_transform(e, lambda p: CAST(least(greatest(floor(p * 900 + 90), 0), 255) AS BIGINT)) AS alpha,
  list_transform(e, lambda p: CAST(least(greatest(floor(p * -500 + 128), 0), 255) AS BIGINT)) AS colour, list_transform(e, lambda p: CAST(p > -0.06 AS BIGINT)) AS support FROM w)"""


def _parts(name: str, rows: str) -> str:
    """The connected parts (image_id, y, x, root) of pixels (image_id, y, x)."""
    return f"""
{name}_r AS (SELECT image_id, y, x, y * 1000 + x AS root FROM {rows} UNION SELECT r.image_id, q.y, q.x, r.root FROM {name}_r r JOIN {rows} q ON q.image_id = r.image_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1),
{name}_p AS (SELECT image_id, y, x, min(root) AS root FROM {name}_r GROUP BY ALL),
{name} AS (SELECT *, count(*) OVER (PARTITION BY image_id, root) AS n FROM {name}_p)"""


ORACLE_SQL: dict[str, str] = {
    "tag_decision": "WITH" + _DECISION + """
SELECT item_id, coalesce(value, '') AS tag_number, coalesce(confidence, 0) AS confidence, raw_text, status, branch, CAST(coalesce(source_count, 0) AS INT) AS evidence_count,
  CAST(coalesce(strong, 0) AS INT) AS strong_evidence_count, coalesce(round(best_confidence, 4), 0) AS best_ocr_confidence,
  CASE WHEN value IS NULL THEN 0 ELSE round(greatest(margin, 0), 4) END AS score_margin, coalesce(best_rotation, '') AS best_source_rotation, coalesce(best_crop, '') AS best_source_crop FROM D""",
    "ocr_checkpoints": "WITH" + _REPLAY + """,
DS AS (SELECT item_id // 64 AS item, item_id % 64 AS cp, coalesce(value, '') AS tag, coalesce(confidence, 0) AS sure, status, status = 'OK' AND strong >= 2 AND confidence >= 0.78 AS safe FROM D),
DZ AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY coalesce(safe, false) DESC, CASE WHEN safe THEN cp ELSE -cp END) AS k FROM DS)
SELECT item AS item_id, cp AS checkpoint, coalesce(safe, false) AS safe, tag AS tag_number, sure AS confidence, status FROM DZ WHERE k = 1""",
    "mask_components": """
WITH RECURSIVE v AS (SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT image_id, e, CAST(floor(sqrt(len(e))) AS BIGINT) AS side FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT image_id, side, unnest(e[:side * side]) AS p, unnest(range(side * side)) AS spot FROM w),
px AS (SELECT image_id, side, spot // side AS y, spot % side AS x, p > 0.02 AS lit FROM i),
reach AS (SELECT image_id, y, x, y * side + x AS root FROM px WHERE lit UNION
  SELECT r.image_id, q.y, q.x, r.root FROM reach r JOIN px q ON q.image_id = r.image_id AND q.lit AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1),
part AS (SELECT image_id, y, x, min(root) AS root FROM reach GROUP BY ALL), sizes AS (SELECT image_id, root, count(*) AS n FROM part GROUP BY ALL),
parts AS (SELECT image_id, count(*) AS parts, max(n) AS largest FROM sizes GROUP BY 1),
air AS (SELECT image_id, y, x FROM px WHERE NOT lit AND (y = 0 OR x = 0 OR y = side - 1 OR x = side - 1) UNION
  SELECT q.image_id, q.y, q.x FROM air r JOIN px q ON q.image_id = r.image_id AND NOT q.lit AND abs(q.y - r.y) + abs(q.x - r.x) = 1),
gaps AS (SELECT image_id, count(*) AS n FROM px WHERE NOT lit GROUP BY 1), open AS (SELECT image_id, count(*) AS n FROM air GROUP BY 1)
SELECT w.image_id, coalesce(parts, 0) AS parts, coalesce(largest, 0) AS largest, coalesce(g.n, 0) - coalesce(o.n, 0) AS holes
FROM w LEFT JOIN parts p ON w.image_id = p.image_id LEFT JOIN gaps g ON w.image_id = g.image_id LEFT JOIN open o ON w.image_id = o.image_id""",
    "tile_parts": """
WITH RECURSIVE v AS (SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
w AS (SELECT image_id, e, CAST(floor(sqrt(len(e))) AS BIGINT) AS side FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
i AS (SELECT image_id, side, unnest(e[:side * side]) AS p, unnest(range(side * side)) AS spot FROM w),
px AS (SELECT image_id, side, spot // side AS y, spot % side AS x FROM i WHERE p > 0.02),
reach AS (SELECT image_id, side, y, x, y * side + x AS root FROM px UNION
  SELECT r.image_id, r.side, q.y, q.x, r.root FROM reach r JOIN px q ON q.image_id = r.image_id AND abs(q.y - r.y) <= 1 AND abs(q.x - r.x) <= 1),
part AS (SELECT image_id, side, y, x, min(root) AS root FROM reach GROUP BY ALL)
SELECT image_id, root // side AS y, root % side AS x, count(*) AS area, min(y) AS top, min(x) AS "left", max(y) AS bottom, max(x) AS "right" FROM part GROUP BY image_id, side, root""",
    "result_notes": "WITH" + _REPORT + """,
N AS (SELECT *, CASE WHEN k % 7 IN (0, 1) THEN '' ELSE 'Seen ' || CAST(k % 5 AS VARCHAR) || ' times.' END AS said, k % 101 = 9 AS bad, CASE WHEN status = 'ERROR' THEN 'OK' ELSE status END AS s,
  CASE k % 4 WHEN 0 THEN 'READY' WHEN 1 THEN 'REVIEW_REQUIRED' WHEN 2 THEN 'FAILED' ELSE '' END AS prepared FROM G)
SELECT item_id, original_filename, CASE WHEN NOT bad THEN detected_tag_number END AS detected_tag_number, CASE WHEN bad THEN 'ERROR' ELSE s END AS status,
  CASE WHEN NOT bad THEN output_folder END AS output_folder, CASE WHEN NOT bad THEN prepared END AS correction_cache_status,
  CASE WHEN bad THEN 'This photo could not be processed. Please check it manually. bad picture ' || CAST(k AS VARCHAR) WHEN output_folder = 'background_review' THEN said || ' Background removal needs review.'
    WHEN s = 'OK' THEN said WHEN s = 'DUPLICATE_TAG' THEN said || ' Duplicate tag saved safely with suffix.'
    ELSE CASE WHEN said = '' THEN 'Tag number is unclear. Please review this photo.' ELSE said END || CASE prepared WHEN 'READY' THEN ' Full-quality background output is prepared for fast correction.'
      WHEN 'REVIEW_REQUIRED' THEN ' The background candidate also needs visual review after tag correction.' WHEN 'FAILED' THEN ' Background preparation will retry after tag correction.' ELSE '' END END AS notes FROM N""",
    "digit_normalize": "WITH" + _READINGS + " SELECT item_id, pos, translate(text, 'OoIl|SsB', '00111558') AS digits FROM R",
    "prominence": "WITH" + _READINGS + " SELECT item_id, pos, prominence FROM R",
    "candidate_extract": "WITH" + _CANDIDATES + " SELECT item_id, pos, CAST(match_no AS BIGINT) AS match_no, value, score FROM C",
    "source_evidence": "WITH" + _CANDIDATES + " SELECT item_id, value, canon AS crop, rotation, max(confidence) AS confidence, count(*) AS n_readings FROM C GROUP BY item_id, value, canon, rotation",
    "consensus_rank": "WITH" + _VALUES + " SELECT item_id, value, score, source_count, strong AS strong_source_count, place FROM P",
    "reverse_conflicts": "WITH" + _REVERSE + " SELECT * FROM X",
    "raw_text_join": "WITH" + _READINGS + "," + _TEXTS + " SELECT item_id, raw_text FROM T",
    "status_summary": "WITH" + _DECISION + """
SELECT CAST(floor(item_id / 5000) AS BIGINT) AS batch, count(*) AS total, count(*) AS processed, count(*) FILTER (WHERE status = 'OK') AS ok,
  count(*) FILTER (WHERE status IN ('REVIEW_REQUIRED', 'OCR_FAILED', 'TAG_NOT_FOUND')) AS review_required, count(*) FILTER (WHERE status = 'DUPLICATE_TAG') AS duplicate_tags,
  count(*) FILTER (WHERE status = 'OCR_FAILED') AS ocr_failed, count(*) FILTER (WHERE status = 'TAG_NOT_FOUND') AS tag_not_found, count(*) FILTER (WHERE status = 'ERROR') AS errors FROM D GROUP BY 1""",
    "live_counters": "WITH" + _PHOTOS + """
SELECT batch, item, CAST(sum(CAST(status = 'OK' AS INT)) OVER w AS BIGINT) AS n_ok, CAST(sum(CAST(status = 'DUPLICATE_TAG' AS INT)) OVER w AS BIGINT) AS n_duplicates,
  CAST(sum(CAST(status = 'ERROR' AS INT)) OVER w AS BIGINT) AS n_errors, CAST(sum(CAST(status NOT IN ('OK', 'DUPLICATE_TAG', 'ERROR') AS INT)) OVER w AS BIGINT) AS n_review
FROM H WINDOW w AS (PARTITION BY batch ORDER BY item)""",
    "friendly_status": "WITH" + _REPORT + """
SELECT item_id, CASE status WHEN 'OK' THEN 'Ready' WHEN 'REVIEW_REQUIRED' THEN 'Needs review' WHEN 'DUPLICATE_TAG' THEN 'Duplicate saved' WHEN 'OCR_FAILED' THEN 'Could not read tag'
  WHEN 'TAG_NOT_FOUND' THEN 'Tag not found' ELSE 'Could not process' END AS status_label,
  CASE WHEN status = 'OK' THEN 'ok' WHEN status = 'DUPLICATE_TAG' THEN 'duplicate' WHEN status IN ('ERROR', 'OCR_FAILED') THEN 'error' ELSE 'review' END AS badge FROM G""",
    "review_queue": "WITH" + _REPORT + " SELECT item_id, status, output_folder FROM G WHERE status IN ('REVIEW_REQUIRED', 'OCR_FAILED', 'TAG_NOT_FOUND') AND output_folder <> 'ai_review'",
    "legacy_queue": "WITH" + _REPORT + " SELECT item_id, status FROM G WHERE output_folder = 'ai_review'",
    "report_search": "WITH" + _REPORT + """
SELECT item_id, original_filename, detected_tag_number FROM G WHERE status = 'OK'
  AND (regexp_matches(lower(original_filename), 'img_1[0-9]+|1004') OR regexp_matches(lower(detected_tag_number), 'img_1[0-9]+|1004'))""",
    "report_normalize": "WITH" + _REPORT + " SELECT item_id, original_filename, detected_tag_number, status, output_folder, CASE WHEN notes IS NULL OR notes = 'NA' THEN '' ELSE notes END AS notes, '' AS confidence_score FROM G",
    "row_selector": "WITH" + _MATCHES + " SELECT * FROM MM",
    "report_update": "WITH" + _MATCHES + """,
U0 AS (SELECT m.selector, m.item_id FROM MM m WHERE (SELECT count(*) FROM MM n WHERE n.selector = m.selector) = 1),
U AS (SELECT item_id, CAST(900000 + arg_max(c_custkey, e.selector) AS VARCHAR) AS tag FROM U0 JOIN E e ON e.selector = U0.selector GROUP BY item_id)
SELECT G.item_id, original_filename, coalesce(tag, detected_tag_number) AS detected_tag_number, CASE WHEN tag IS NOT NULL THEN 'OK' ELSE status END AS status, output_folder FROM G LEFT JOIN U ON G.item_id = U.item_id""",
    "qa_compare": "WITH" + _REPORT + """,
Q AS (SELECT CASE WHEN k % 9 = 4 THEN 'NEW_' || original_filename[5:] ELSE original_filename END AS original_filename, max(CASE WHEN k % 4 = 0 THEN '-' ELSE CAST(100000 + k % 9973 AS VARCHAR) END) AS expected FROM G GROUP BY 1),
L AS (SELECT original_filename, arg_max(detected_tag_number, item_id) AS detected, arg_max(status, item_id) AS status FROM G GROUP BY 1)
SELECT q.original_filename, expected, coalesce(detected, '') AS detected, coalesce(status, '') AS status, CASE WHEN status IS NULL THEN 'missing'
  WHEN expected = '-' AND status IN ('OK', 'DUPLICATE_TAG') THEN 'wrongly accepted' WHEN expected <> '-' AND detected <> expected THEN 'different tag' ELSE '' END AS failure
FROM Q q LEFT JOIN L l ON q.original_filename = l.original_filename""",
    "item_ids": """
WITH p AS (SELECT regexp_extract(coalesce(url, ''), '//([^/]+)/', 1) AS batch, coalesce(url, '') AS path, page_id FROM pages)
SELECT batch, path, page_id, printf('item_%06d', row_number() OVER (PARTITION BY batch ORDER BY string_split(path, '/'), page_id)) AS item_id FROM p""",
    "safe_stems": r"""
WITH u AS (SELECT page_id, coalesce(url, '') AS a, string_split(replace(coalesce(url, ''), '\', '/'), '/')[-1] AS b FROM pages),
v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(a, '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS x,
  regexp_replace(regexp_replace(regexp_replace(b, '(.)\.[^.]*$', '\1'), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') AS y FROM u)
SELECT page_id, CASE WHEN x = '' THEN 'image' ELSE x END AS stem, 'REVIEW_' || CASE WHEN y = '' THEN 'image' ELSE y END AS review_stem FROM v""",
    "format_filter": """
SELECT o_orderkey, ['jpg', 'jpeg', 'webp', 'heic', 'zip', 'txt', '', 'png'][o_orderkey % 8 + 1] AS format,
  ['image', 'image', 'image', 'image', 'archive', 'unsupported', 'unsupported', 'image'][o_orderkey % 8 + 1] AS verdict FROM orders""",
    "content_dedupe": "SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY text) END AS first_key, text IS NOT NULL AND doc_id <> min(doc_id) OVER (PARTITION BY text) AS duplicate FROM documents",
    "output_names": _names(False),
    "transparent_names": _names(True),
    "archive_totals": "WITH" + _MEMBERS + " SELECT archive, members, bytes, verdict FROM AV",
    "archive_cascade": "WITH" + _MEMBERS + " SELECT pos, archive, verdict, CASE WHEN verdict = 'taken' THEN inside END AS target FROM AC",
    "archive_renames": "WITH RECURSIVE" + _MEMBERS + """,
AR AS (SELECT archive, inside[:-5] AS stem, '.jpg' AS ending, pos AS ord FROM AC WHERE verdict = 'taken'),""" + _walk("AR", "archive", "AN") + " SELECT ord AS pos, archive, final, n > 1 AS renamed FROM AN",
    "saved_names": """
WITH RECURSIVE B AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 31 + 1 END AS destination, o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '.zip' END AS ending,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 < 2 THEN 'result' ELSE 'out.' || CAST(o_custkey % 40 AS VARCHAR) END || ['', '_2', '_3', '_2_2', '_40', '', '', '', '', '', '', '', ''][o_orderkey % 13 + 1] AS stem FROM orders),""" + _walk("B", "destination", "BN") + " SELECT ord AS item, final, n > 1 AS renamed FROM BN",
    "manifest_verify": "WITH" + _MANIFEST + """
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'unlisted' WHEN cut THEN 'size' WHEN other THEN 'hash' ELSE 'ok' END AS verdict
FROM F0 a FULL JOIN F1 b ON a.path = b.path""",
    "manifest_totals": "WITH" + _MANIFEST + " SELECT count(*) AS file_count, CAST(sum(size) AS BIGINT) AS total_bytes FROM F0",
    "output_diff": "WITH" + _MANIFEST + """
SELECT path AS name, 'missing' AS side FROM F0 WHERE path NOT IN (SELECT path FROM F1) UNION ALL SELECT path, 'unexpected' FROM F1 WHERE path NOT IN (SELECT path FROM F0)""",
    "latest_run": """
WITH m AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value < 20)
SELECT user_id % 10 AS root, arg_max(user_id, (ts, user_id)) AS run, max(ts) AS modified FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT user_id FROM m) GROUP BY 1""",
    "stale_archives": """
WITH t AS (SELECT user_id AS run, max(ts) FILTER (WHERE event_type = 'click') AS zip, max(floor(value)) FILTER (WHERE event_type = 'click') AS zs, max(ts) FILTER (WHERE event_type = 'view') AS src,
  count(*) FILTER (WHERE event_type = 'error' AND value < 10) AS marks FROM events GROUP BY 1)
SELECT run, marks > 0 OR zip IS NULL OR CASE WHEN src IS NULL THEN zs = 0 ELSE zip < src END AS stale FROM t""",
    "latest_job_state": "WITH" + _JOBS + " SELECT job_id, state, done, events, error, running FROM JS",
    "latest_running_job": "WITH" + _JOBS + " SELECT job_id, state FROM JS WHERE running ORDER BY started DESC LIMIT 1",
    "crop_score": "WITH" + _CROPS + " SELECT item_id, pos, fits, score FROM KS",
    "crop_nms": "WITH RECURSIVE" + _CROPS + """,
KP AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, pos) AS place FROM KS),
W(item_id, place, kept) AS (SELECT item_id, place, [{'pos': pos, 'x': x, 'y': y, 'w': w, 'h': h}] FROM KP WHERE place = 1
  UNION ALL SELECT W.item_id, p.place, CASE WHEN len(list_filter(W.kept, lambda k: greatest(least(k.x + k.w, p.x + p.w) - greatest(k.x, p.x), 0) * greatest(least(k.y + k.h, p.y + p.h) - greatest(k.y, p.y), 0)
      >= CAST(0.42 AS DOUBLE) * (k.w * k.h + p.w * p.h - greatest(least(k.x + k.w, p.x + p.w) - greatest(k.x, p.x), 0) * greatest(least(k.y + k.h, p.y + p.h) - greatest(k.y, p.y), 0)))) = 0
    THEN list_append(W.kept, {'pos': p.pos, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h}) ELSE W.kept END FROM W JOIN KP p ON p.item_id = W.item_id AND p.place = W.place + 1),
Z AS (SELECT item_id, arg_max(kept, place) AS kept FROM W GROUP BY 1)
SELECT item_id, CAST(i AS BIGINT) AS nth, kept[i + 1].pos AS pos FROM (SELECT item_id, kept, unnest(range(len(kept))) AS i FROM Z)""",
    "crop_shapes": "WITH" + _CROPS + """,
Y AS (SELECT *, row_number() OVER (PARTITION BY item_id, round_even(w / 20, 0), round_even(h / 20, 0), label ORDER BY pos) AS n FROM K WHERE w > 20 AND h > 20)
SELECT * FROM (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS place FROM Y WHERE n = 1) WHERE place <= 8""",
    "crop_priority": "WITH" + _CROPS + """,
Y AS (SELECT *, label LIKE 'fallback%' AS f, min(CASE WHEN label NOT LIKE 'fallback%' THEN pos END) OVER (PARTITION BY item_id) AS lead FROM K)
SELECT * FROM (SELECT item_id, pos, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN pos = lead THEN 0 WHEN label = 'fallback_full' THEN 1 WHEN NOT f THEN 2 ELSE 3 END, pos) AS place FROM Y) WHERE place <= 7""",
    "rotation_plan": "WITH" + _CROPS + " SELECT item_id, pos, CASE WHEN label NOT LIKE 'fallback%' AND h > w * 1.2 THEN 'ccw90,cw90,original,rot180' ELSE 'original,rot180,cw90,ccw90' END AS turns FROM K",
    "rotate_points": "WITH" + _CROPS + """
SELECT item_id, pos, CAST(least(greatest(CASE pos % 4 WHEN 3 THEN 379 - x WHEN 1 THEN y WHEN 2 THEN 379 - y ELSE x END, 0), 379) AS BIGINT) AS px,
  CAST(least(greatest(CASE pos % 4 WHEN 3 THEN 289 - y WHEN 1 THEN 289 - x WHEN 2 THEN x ELSE y END, 0), 289) AS BIGINT) AS py FROM K""",
    "anchor_in_crop": "WITH" + _CROPS + """,
Y AS (SELECT a.item_id, a.x + 30 AS ax, a.y + 20 AS ay, k.pos, k.w * k.h AS area, row_number() OVER (PARTITION BY a.item_id ORDER BY k.w * k.h, k.pos) AS n FROM K a JOIN K k ON a.item_id = k.item_id AND a.pos = 1
  WHERE k.label NOT LIKE 'fallback%' AND a.x + 30 BETWEEN k.x - greatest(4, floor(k.w * 0.08)) AND k.x + k.w + greatest(4, floor(k.w * 0.08))
    AND a.y + 20 BETWEEN k.y - greatest(4, floor(k.h * 0.08)) AND k.y + k.h + greatest(4, floor(k.h * 0.08)))
SELECT item_id, ax, ay, pos, area FROM Y WHERE n = 1""",
    "crop_padding": "WITH" + _CROPS + """,
Y AS (SELECT *, greatest(14, CAST(floor(least(w, h) * 0.25) AS BIGINT)) AS p FROM K)
SELECT item_id, pos, greatest(x - p, 0) AS px, greatest(y - p, 0) AS py, least(x + w + p, 420) - greatest(x - p, 0) AS pw, least(y + h + p, 320) - greatest(y - p, 0) AS ph FROM Y""",
    "catalogue_geometry": "WITH" + _CROPS + """,
Y AS (SELECT *, least(CAST(1008 AS DOUBLE) / w, CAST(1080 AS DOUBLE) / h, CAST(1.7 AS DOUBLE)) AS s FROM K),
Z AS (SELECT item_id, pos, greatest(1, CAST(floor(w * s) AS BIGINT)) AS cw, greatest(1, CAST(floor(h * s) AS BIGINT)) AS ch FROM Y)
SELECT item_id, pos, cw, ch, CAST(floor((1200 - cw) / 2) AS BIGINT) AS cx, greatest(97, least(810 - CAST(floor(ch / 2) AS BIGINT), 1403 - ch)) AS cy FROM Z""",
    "attempt_budget": "WITH" + _READINGS + """
SELECT * FROM (SELECT item_id, pos AS attempt_no, CAST(sum(CASE WHEN rotation = 'auto_best' THEN 4 WHEN crop LIKE 'fallback%' THEN 2 ELSE 3 END) OVER (PARTITION BY item_id ORDER BY pos) AS BIGINT) AS used FROM R) WHERE used <= 16""",
    "safety_reasons": "WITH" + _MASKS + " SELECT mask_id, array_to_string(reasons, ',') AS reasons, array_to_string(great, ',') AS catastrophic FROM B",
    "alpha_validate": "WITH" + _MASKS + """
SELECT mask_id, CASE WHEN foreground < 0.015 THEN 'too small' WHEN foreground > 0.92 THEN 'covers everything' WHEN solid < 0.006 THEN 'too few solid pixels' WHEN soft > 0.82 THEN 'too uncertain'
  WHEN parts > 160 THEN 'too fragmented' ELSE 'ok' END AS verdict FROM B""",
    "smart_route": "WITH" + _MASKS + """,
Y AS (SELECT *, list_filter([CASE WHEN NOT good THEN 'status' END, CASE WHEN loss > 0.0008 THEN 'supported_loss' END, CASE WHEN holes > 0.0004 THEN 'holes' END, CASE WHEN lost > 0 THEN 'lost_parts' END,
    CASE WHEN missing > 0 THEN 'missing_parts' END, CASE WHEN residue > 0.0008 THEN 'residue' END, CASE WHEN patch > 0.0002 THEN 'residue_patch' END, CASE WHEN coverage < 0.12 THEN 'little_background' END,
    CASE WHEN g50 > 12 OR g90 > 38 THEN 'textured' END], lambda r: r IS NOT NULL) AS why FROM B)
SELECT mask_id, array_to_string(why, ',') AS reasons, NOT good OR len(great) > 0 OR missing > 0 OR residue > 0.0008 OR patch > 0.0002 AS needs_refinement FROM Y""",
    "hybrid_route": "WITH" + _MASKS + """
SELECT mask_id, CASE WHEN mask_id % 5 = 0 THEN (CASE WHEN mask_id % 7 <> 0 AND good AND len(great) = 0 THEN 'keeping' ELSE 'review' END) WHEN mask_id % 7 = 0 THEN 'review'
  WHEN parts < 120 AND len(list_filter(reasons, lambda r: r <> 'missing_parts')) = 0 THEN 'fused' ELSE 'review' END AS route FROM B""",
    "mask_stats": """
WITH v AS (SELECT vec_id AS image_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), p AS (SELECT image_id, unnest(e) AS p FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT image_id, round(avg(CASE WHEN p > 0 THEN 1.0 ELSE 0 END), 9) AS foreground, round(quantile_cont(p, 0.5), 9) AS p50, round(quantile_cont(p, 0.9), 9) AS p90 FROM p GROUP BY 1""",
    "ladder_pick": """
WITH p AS (SELECT p_partkey AS image, 300 + p_partkey * 37 % 1500 AS w, p_size * 31 AS h FROM part), q AS (SELECT image, CAST(greatest(w, h) AS BIGINT) AS own FROM p),
l AS (SELECT DISTINCT image, least(e, own) AS long_edge FROM q, (SELECT unnest([1500, 1200, 1000, 800, 640, 512, 400, 320, 256, 192, 128, 96, 64, 1000000]) AS e)),
g AS (SELECT image, long_edge, quality FROM l, (SELECT unnest(range(10, 96)) AS quality) WHERE long_edge NOT IN (48, 32, 24, 16) UNION ALL SELECT image, e, 1 FROM q, (SELECT unnest([48, 32, 24, 16]) AS e)),
b AS (SELECT *, CAST(floor(long_edge * long_edge * (image % 23 + 1) * (quality + 5) / 4000) + image % 40 * 600 AS BIGINT) AS bytes FROM g),
f AS (SELECT * FROM b WHERE bytes <= 20000 AND bytes > 0),
n AS (SELECT image, long_edge, quality, row_number() OVER (PARTITION BY image ORDER BY quality DESC, long_edge DESC) AS k FROM f WHERE quality IN (60, 50, 40, 30, 20, 10)),
c AS (SELECT f.*, row_number() OVER (PARTITION BY f.image ORDER BY f.quality DESC) AS k FROM f JOIN n ON n.image = f.image AND n.k = 1 AND f.long_edge = n.long_edge AND f.quality >= n.quality),
z AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY long_edge DESC) AS k FROM f WHERE quality = 1)
SELECT q.image, CAST(coalesce(c.quality, z.quality, 0) AS INT) AS quality, CAST(coalesce(c.long_edge, z.long_edge, 0) AS INT) AS long_edge, coalesce(c.bytes, z.bytes, 0) AS bytes
FROM q LEFT JOIN c ON q.image = c.image AND c.k = 1 LEFT JOIN z ON q.image = z.image AND z.k = 1""",
    "export_state": """
SELECT o_orderkey AS name, CASE WHEN o_orderkey % 17 = 0 THEN 'orphan' WHEN o_orderkey % 13 <> 0 AND floor(o_totalprice) BETWEEN 1 AND 200000 AND o_orderkey % 11 <> 0 AND o_orderkey % 103 >= o_orderkey % 100 THEN 'reused'
  ELSE 'convert' END AS state FROM orders""",
    "size_labels": """
WITH n AS (SELECT p_partkey, p_size, floor(power(CAST(7 AS DOUBLE), p_size / CAST(5 AS DOUBLE))) AS n FROM part)
SELECT p_partkey, CASE WHEN n < 1024 THEN printf('%d B', CAST(n AS BIGINT)) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576)
  ELSE printf('%.1f GB', n / 1073741824) END AS size_label,
  CASE WHEN (p_size - 1) / CAST(8 AS DOUBLE) + 0.0312 < 1 THEN printf('%.2fs', CAST((p_size - 1) / CAST(8 AS DOUBLE) + 0.0312 AS DOUBLE)) ELSE printf('%.1fs', CAST((p_size - 1) / CAST(8 AS DOUBLE) + 0.0312 AS DOUBLE)) END AS elapsed_label FROM n""",
    "correction_transition": "WITH" + _REPORT + """,
Y AS (SELECT *, k % 6 <> 0 AS valid, 1 + CAST(k % 29 = 0 AS INT) - CAST(k % 31 = 0 AS INT) AS n, ['white_and_transparent', 'white_only', 'transparent_only', 'none', 'white_and_transparent', 'none'][k % 6 + 1] AS mode,
  k % 3 <> 0 AS w, k % 5 <> 0 AS t FROM G),
Z AS (SELECT *, CASE WHEN NOT valid THEN 'refused: tag' WHEN n = 0 THEN 'refused: not found' WHEN n > 1 THEN 'refused: ambiguous' WHEN k % 37 = 0 THEN 'refused: no file' WHEN mode = 'none' THEN 'moved'
  WHEN k % 4 = 1 THEN 'background review' WHEN k % 4 = 0 AND CASE mode WHEN 'white_only' THEN w WHEN 'transparent_only' THEN t ELSE w AND t END THEN 'from cache' WHEN k % 7 <> 0 THEN 'rerun'
  ELSE 'background review' END AS step FROM Y)
SELECT item_id, step, CASE WHEN step LIKE 'refused%' THEN status WHEN step = 'background review' THEN 'REVIEW_REQUIRED' WHEN k % 2 > 0 THEN 'DUPLICATE_TAG' ELSE 'OK' END AS new_status,
  CASE WHEN step LIKE 'refused%' THEN output_folder WHEN step = 'background review' THEN 'background_review' WHEN mode = 'transparent_only' THEN 'transparent_images' ELSE 'processed_images' END AS new_folder,
  CASE WHEN step LIKE 'refused%' THEN '0.5' ELSE 'manual' END AS new_confidence, step NOT LIKE 'refused%' AS stale FROM Z""",
    "background_transition": "WITH" + _REPORT + """,
Y AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'processed_images' ELSE 'background_review' END AS fold, CASE WHEN k % 10 = 0 THEN 'other' WHEN k % 2 = 0 THEN 'accept_preview' ELSE 'keep_original' END AS act,
  1 + CAST(k % 29 = 0 AS INT) - CAST(k % 31 = 0 AS INT) AS n, ['white_and_transparent', 'white_only', 'transparent_only'][k % 5 % 3 + 1] AS mode FROM G),
Z AS (SELECT *, CASE WHEN act = 'other' THEN 'refused: action' WHEN n = 0 THEN 'refused: not found' WHEN n > 1 THEN 'refused: ambiguous' WHEN fold <> 'background_review' THEN 'refused: not waiting'
  WHEN detected_tag_number = '' THEN 'refused: tag' WHEN act = 'keep_original' AND k % 7 = 0 THEN 'refused: no original'
  WHEN act = 'accept_preview' AND mode = 'transparent_only' AND k % 13 = 0 THEN 'refused: no transparent preview' WHEN act = 'accept_preview' AND mode <> 'transparent_only' AND k % 11 = 0 THEN 'refused: no white preview'
  ELSE act END AS step FROM Y)
SELECT item_id, step, CASE WHEN step LIKE 'refused%' THEN status WHEN k // 2 % 2 > 0 THEN 'DUPLICATE_TAG' ELSE 'OK' END AS new_status,
  CASE WHEN step LIKE 'refused%' THEN fold WHEN step = 'accept_preview' AND mode = 'transparent_only' THEN 'transparent_images' ELSE 'processed_images' END AS new_folder,
  CASE WHEN step LIKE 'refused%' THEN '' WHEN step = 'keep_original' THEN 'ORIGINAL_KEPT' ELSE 'MANUAL_ACCEPTED' END AS new_background,
  step = 'accept_preview' AND (mode = 'transparent_only' OR (mode = 'white_and_transparent' AND k % 13 <> 0)) AS clear_copy FROM Z""",
    "base_crops": "WITH" + _READINGS + """
SELECT regexp_replace(CASE WHEN pos % 3 = 0 THEN crop || '_verification' ELSE crop END, '(_enhanced|_verification)$', '') AS crop, count(*) AS n FROM R GROUP BY 1""",
    "cache_names": "WITH" + _REPORT + """
SELECT item_id, CASE WHEN k % 5 <> 0 THEN original_filename END AS cached, original_filename[:-5] || '_ai_transparent.png' AS preview FROM G""",
    "legacy_transition": "WITH" + _REPORT + """,
A AS (SELECT *, CASE WHEN k % 3 = 2 THEN 'refused: action' WHEN k % 29 = 0 THEN 'refused: not found' WHEN output_folder <> 'ai_review' THEN 'refused: not waiting' WHEN k % 3 = 0 THEN 'accept_ai' ELSE 'send_manual' END AS step FROM G)
SELECT item_id, step, CASE WHEN step LIKE 'refused%' THEN status WHEN step = 'send_manual' THEN 'REVIEW_REQUIRED' WHEN k // 2 % 2 > 0 THEN 'DUPLICATE_TAG' ELSE 'OK' END AS new_status,
  CASE WHEN step LIKE 'refused%' THEN output_folder WHEN step = 'send_manual' THEN 'background_review' ELSE 'processed_images' END AS new_folder FROM A""",
    "background_queue": "WITH" + _REPORT + " SELECT item_id, status FROM G WHERE output_folder = 'background_review'",
    "job_starts": """
WITH RECURSIVE s AS (SELECT user_id AS item_id, event_id AS seq, event_id * 10 AS job, CASE WHEN event_type = 'error' THEN 1e18 ELSE event_id + floor(value * 40) END AS over,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
w AS (SELECT item_id, seq, k, job AS given, over AS until FROM s WHERE k = 1
  UNION ALL SELECT s.item_id, s.seq, s.k, CASE WHEN w.until > s.seq THEN w.given ELSE s.job END, CASE WHEN w.until > s.seq THEN w.until ELSE s.over END FROM w JOIN s ON s.item_id = w.item_id AND s.k = w.k + 1)
SELECT item_id, seq, given, CASE WHEN given = seq * 10 THEN '.complete' ELSE '.processing' END AS mark FROM w""",
    "forget_jobs": "WITH" + _JOBS + """, Q AS (SELECT DISTINCT user_id * 200 + event_id % 37 AS job_id FROM events)
SELECT Q.job_id, CASE WHEN state IS NULL THEN 'unknown' WHEN running THEN 'refused: running' ELSE 'forgotten' END AS outcome FROM Q LEFT JOIN JS ON Q.job_id = JS.job_id""",
    "archive_sources": """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 1 THEN 'run/debug/' ELSE 'run/' END || CAST(o_orderkey AS VARCHAR) || '.png' AS path FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0""",
    "export_totals": """
SELECT count(*) FILTER (WHERE o_orderkey % 5 > 1) AS converted, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS reused, count(*) FILTER (WHERE o_orderkey % 5 = 1) AS skipped,
  count(*) FILTER (WHERE o_orderkey % 5 <> 1) AS ready, CAST(max(floor(o_totalprice)) AS BIGINT) AS largest FROM orders""",
    "export_whole": "SELECT count(*) > 0 AND count(*) FILTER (WHERE p_partkey % 100000 = 99999) = 0 AS current FROM part",
    "limited_archive": """
WITH x AS (SELECT CAST(o_orderkey AS VARCHAR) || CASE WHEN o_orderkey % 4 = 1 THEN '.JPG' ELSE '.jpg' END AS name, CAST(floor(o_totalprice / 8) AS BIGINT) AS bytes FROM orders WHERE o_orderkey % 4 <> 0)
SELECT * FROM x WHERE bytes BETWEEN 1 AND 20000""",
    "downloads": """
WITH k AS (SELECT c_custkey AS k FROM customer)
SELECT k AS run, a AS artifact, CASE a WHEN 'full' THEN k % 3 <> 0 AND k % 5 <> 0 WHEN 'processed' THEN k % 7 > 0 WHEN 'transparent' THEN k % 2 > 0 WHEN 'compressed' THEN k % 11 <> 0 AND k % 6 = 0
  WHEN 'report' THEN k % 5 <> 0 AND k % 4 > 0 ELSE k % 13 % 3 > 0 END AS available FROM k, (SELECT unnest(['full', 'processed', 'transparent', 'compressed', 'report', 'debug']) AS a)""",
    "alpha_measures": "WITH RECURSIVE" + _PICTURES + """,
px AS (SELECT image_id, side, unnest(alpha[:side * side]) AS a, unnest(support[:side * side]) AS s, unnest(range(side * side)) AS spot FROM z),
p AS (SELECT image_id, side * side AS area, spot, spot // side AS y, spot % side AS x, side, a, s > 0 AS s FROM px),
p18 AS (SELECT image_id, y, x FROM p WHERE a > 18), p24 AS (SELECT image_id, y, x FROM p WHERE a > 24), ps AS (SELECT image_id, y, x FROM p WHERE s), pb AS (SELECT image_id, y, x FROM p WHERE s AND a > 18),""" + ",".join(_parts(n, r) for n, r in (("f", "p18"), ("g", "p24"), ("h", "ps"), ("j", "pb"))) + """,
c0 AS (SELECT p.*, CASE WHEN f.n < 18 THEN 0 ELSE a END AS c FROM p LEFT JOIN f ON p.image_id = f.image_id AND p.y = f.y AND p.x = f.x),
near AS (SELECT a.image_id, a.spot, count(*) AS n FROM c0 a JOIN c0 b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.c > 0 AND b.c > 0 GROUP BY 1, 2),
c1 AS (SELECT c0.* EXCLUDE (c), CASE WHEN near.n <= 2 THEN 0 ELSE c END AS c FROM c0 LEFT JOIN near ON c0.image_id = near.image_id AND c0.spot = near.spot),
m AS (SELECT c1.image_id, string_agg(CAST(c AS VARCHAR), ',' ORDER BY spot) AS cleaned, count(*) FILTER (WHERE a > 18 AND c <= 18) / greatest(1, count(*) FILTER (WHERE a > 18)) AS removed_foreground,
  count(*) FILTER (WHERE a > 18 AND c <= 18 AND s) / any_value(area) AS removed_supported, count(*) FILTER (WHERE a > 18 AND c <= 18 AND s) / any_value(area) AS interior_holes,
  count(*) FILTER (WHERE a > 12) / any_value(area) AS foreground, count(*) FILTER (WHERE a > 220) / any_value(area) AS solid, count(*) FILTER (WHERE a > 12 AND a < 220) / any_value(area) AS soft FROM c1 GROUP BY 1),
lost AS (SELECT image_id, count(*) AS n FROM (SELECT j.image_id, j.root FROM j JOIN c1 ON j.image_id = c1.image_id AND j.y = c1.y AND j.x = c1.x GROUP BY ALL HAVING count(*) >= 18 AND count(*) FILTER (WHERE c > 18) < 0.6 * count(*)) GROUP BY 1),
counted AS (SELECT image_id, count(DISTINCT root) AS n FROM g WHERE n >= 12 GROUP BY 1)
SELECT m.image_id, cleaned, round(removed_foreground, 9) AS removed_foreground, round(removed_supported, 9) AS removed_supported, round(interior_holes, 9) AS interior_holes, round(foreground, 9) AS foreground,
  round(solid, 9) AS solid, round(soft, 9) AS soft, coalesce(lost.n, 0) AS lost_parts, CAST(0 AS BIGINT) AS missing_parts, coalesce(counted.n, 0) AS parts
FROM m LEFT JOIN lost ON m.image_id = lost.image_id LEFT JOIN counted ON m.image_id = counted.image_id""",
    "turned_rasters": "WITH" + _PICTURES + """,
t AS (SELECT image_id, side, alpha, unnest(range(side * side)) AS i FROM z),
u AS (SELECT image_id, i, alpha[CASE image_id % 4 WHEN 1 THEN (side - 1 - i % side) * side + i // side WHEN 2 THEN (i % side) * side + side - 1 - i // side WHEN 3 THEN side * side - 1 - i ELSE i END + 1] AS a FROM t)
SELECT image_id, string_agg(CAST(a AS VARCHAR), ',' ORDER BY i) AS pixels FROM u GROUP BY 1""",
    "on_white": "WITH" + _PICTURES + """,
t AS (SELECT image_id, unnest(colour) AS c, unnest(alpha) AS a, unnest(range(len(alpha))) AS i FROM z)
SELECT image_id, string_agg(CAST(CAST(floor(c * (a / CAST(255 AS DOUBLE)) + CAST(255 AS DOUBLE) * (1 - a / CAST(255 AS DOUBLE))) AS BIGINT) AS VARCHAR), ',' ORDER BY i) AS pixels FROM t GROUP BY 1""",
}

ORACLE_SQL["debug_crops"] = f"""
SELECT item_id, pos, CAST(item_id AS VARCHAR) || '_tag_crop' || CASE WHEN place > 1 THEN '_' || CAST(place AS VARCHAR) ELSE '' END || '.png' AS file FROM ({ORACLE_SQL["crop_priority"]}) WHERE place <= 2"""
ORACLE_SQL["upload_names"] = """
WITH RECURSIVE B AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 31 + 1 END AS destination, o_orderkey AS ord,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 < 2 THEN 'result' ELSE 'out.' || CAST(o_custkey % 40 AS VARCHAR) END || ['', '_2', '_3', '_2_2', '_40', '', '', '', '', '', '', '', ''][o_orderkey % 13 + 1]
    || CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '.zip' END AS name FROM orders),
E AS (SELECT destination, ord, regexp_extract(name, '[^/](\\.[^./]+)$', 1) AS ending, name FROM B), S AS (SELECT destination, ord, ending, name[:len(name) - len(ending)] AS stem FROM E),""" + _walk("S", "destination", "SN") + """
SELECT ord AS item, final, n > 1 AS renamed, CASE WHEN final LIKE '%.zip' THEN regexp_replace(regexp_replace(final[:-5], '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g') END AS unpacked_to FROM SN"""

ORACLE_SQL["live_checkpoints"] = ORACLE_SQL["ocr_checkpoints"]
ORACLE_SQL["report_versions"] = ORACLE_SQL["report_update"]


def _walk_names(rows: str, taken: str, into: str) -> str:
    """Names given one by one beside those that are there: of rows (place, family, ord, name, stem, ending) each takes its name, or the first stem_n that is not used yet. Only names of one family
    can meet; the names that are there (taken: place, family, name) come first."""
    return f"""
{into}_T AS (SELECT place, family, list(name) AS names FROM {taken} GROUP BY 1, 2),
{into}_S AS (SELECT *, row_number() OVER (PARTITION BY place, family ORDER BY ord) AS turn FROM {rows}),
{into}_W(place, family, turn, ord, name, final, used) AS (
  SELECT DISTINCT s.place, s.family, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', '', coalesce(names, []) FROM {into}_S s LEFT JOIN {into}_T t ON s.place = t.place AND s.family = t.family
  UNION ALL SELECT place, family, turn, ord, name, final, list_append(used, final) FROM (SELECT s.place, s.family, s.turn, s.ord, s.name, w.used, CASE WHEN NOT list_contains(w.used, s.name) THEN s.name
    ELSE s.stem || '_' || CAST(list_filter(range(2, len(w.used) + 3), lambda n: NOT list_contains(w.used, s.stem || '_' || CAST(n AS VARCHAR) || s.ending))[1] AS VARCHAR) || s.ending END AS final
    FROM {into}_W w JOIN {into}_S s ON w.place = s.place AND w.family = s.family AND s.turn = w.turn + 1)),
{into} AS (SELECT place, ord, name, final FROM {into}_W WHERE ord IS NOT NULL)"""


#: Files have the ending .zip, folders none; names that differ in trailing numbers and .zip alone are a family.
ORACLE_SQL["continued_names"] = r"""
WITH RECURSIVE B AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 31 + 1 END AS place, o_orderkey AS ord, o_orderkey % 7 = 0 AS folder,
  CASE WHEN o_orderkey % 3 <> 0 AND o_orderkey % 5 < 2 THEN 'result' ELSE 'out.' || CAST(o_custkey % 40 AS VARCHAR) END || ['', '_2', '_3', '_2_2', '_40', '', '', '', '', '', '', '', ''][o_orderkey % 13 + 1]
    || CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 2 <> 0 THEN '' ELSE '.zip' END AS name FROM orders),
T0 AS (SELECT DISTINCT c_custkey % 32 AS place, CASE WHEN c_custkey % 2 = 0 THEN 'result' ELSE 'out.' || CAST(c_custkey % 40 AS VARCHAR) END
  || CASE WHEN c_custkey % 3 > 0 THEN '_' || CAST(c_custkey % 7 + 2 AS VARCHAR) ELSE '' END || CASE WHEN c_custkey % 5 = 0 THEN '' ELSE '.zip' END AS name FROM customer),
T AS (SELECT place, regexp_replace(name, '(_[0-9]+|[.]zip)+$', '') AS family, name FROM T0),
E AS (SELECT *, regexp_replace(name, '(_[0-9]+|[.]zip)+$', '') AS family, CASE WHEN folder THEN '' ELSE regexp_extract(name, '[^/](\\.[^./]+)$', 1) END AS ending FROM B),
S AS (SELECT *, name[:len(name) - len(ending)] AS stem FROM E),""" .replace("\\\\", "\\") + _walk_names("S", "T", "N") + " SELECT ord AS item, final, final <> name AS renamed FROM N"

ORACLE_SQL["correction_files"] = (
    "WITH RECURSIVE C AS (SELECT item_id, step FROM (" + ORACLE_SQL["correction_transition"] + """)),
K AS (SELECT C.item_id, CAST(C.item_id AS BIGINT) AS k, step, CASE WHEN ['white_and_transparent', 'white_only', 'transparent_only', 'none', '', 'odd'][CAST(C.item_id AS BIGINT) % 6 + 1] = '' THEN 'white_and_transparent'
  ELSE ['white_and_transparent', 'white_only', 'transparent_only', 'none', '', 'odd'][CAST(C.item_id AS BIGINT) % 6 + 1] END AS mode FROM C WHERE step IN ('moved', 'from cache', 'background review')),
A AS (SELECT K.*, G.output_folder, CAST(100000 + k % 997 AS VARCHAR) AS tag, step = 'from cache' AND mode IN ('white_and_transparent', 'transparent_only') AS clear, step <> 'from cache' OR mode <> 'transparent_only' AS white,
  'REVIEW_' || CAST(k % 211 AS VARCHAR) || '.b.png' AS file, k % 3 <> 0 AS w, k % 5 <> 0 AS t FROM K JOIN (WITH""" + _REPORT + """ SELECT item_id, output_folder FROM G) G ON G.item_id = K.item_id),
T AS (SELECT DISTINCT 'processed_images' AS place, CAST(100000 + c_custkey % 997 AS VARCHAR) AS family, CAST(100000 + c_custkey % 997 AS VARCHAR) || '.png' AS name FROM customer
  UNION SELECT 'transparent_images', CAST(100000 + c_custkey % 499 AS VARCHAR), CAST(100000 + c_custkey % 499 AS VARCHAR) || '.png' FROM customer
  UNION SELECT 'background_review', 'BG_REVIEW_REVIEW', 'BG_REVIEW_REVIEW_' || CAST(c_custkey % 100 AS VARCHAR) || '.png' FROM customer),
M AS (SELECT 'processed_images' AS place, tag AS family, k AS ord, tag || '.png' AS name, tag AS stem, '.png' AS ending FROM A WHERE white AND step <> 'background review'
  UNION ALL SELECT 'background_review', 'BG_REVIEW_REVIEW', k, 'BG_REVIEW_REVIEW_' || CAST(k % 211 AS VARCHAR) || '.png', 'BG_REVIEW_REVIEW_' || CAST(k % 211 AS VARCHAR), '.png' FROM A WHERE step = 'background review'),"""
    + _walk_names("M", "T", "MN") + """,
L AS (SELECT 'transparent_images' AS place, tag AS family, k AS ord, coalesce(final, tag || '.png') AS name, regexp_replace(coalesce(final, tag || '.png'), '[.]png$', '') AS stem, '.png' AS ending FROM A LEFT JOIN MN ON ord = k WHERE clear),"""
    + _walk_names("L", "T", "LN") + """,
F AS (SELECT A.*, MN.final AS main, MN.place || '/' || MN.final AS target, LN.final AS extra, output_folder || '/' || file AS source, k % 4 = 1 AND step = 'background review' AS prepared,
  regexp_replace(MN.final, '[.]png$', '') AS review FROM A LEFT JOIN MN ON MN.ord = k LEFT JOIN LN ON LN.ord = k)
SELECT item_id AS action, 1 AS step, CASE WHEN step = 'moved' THEN 'move' ELSE 'copy' END AS kind, CASE WHEN step = 'from cache' THEN 'correction_cache/w.png' ELSE source END AS source, target FROM F WHERE white
UNION ALL SELECT item_id, 2, 'copy?', 'correction_cache/w.png', 'background_review/' || review || '_candidate_white.png' FROM F WHERE prepared AND w
UNION ALL SELECT item_id, 3, 'copy?', 'correction_cache/t.png', 'background_review/' || review || '_transparent.png' FROM F WHERE prepared AND t
UNION ALL SELECT item_id, 3, 'copy', 'correction_cache/t.png', 'transparent_images/' || extra FROM F WHERE clear
UNION ALL SELECT item_id, 4, 'delete', source, NULL FROM F WHERE step <> 'moved'
UNION ALL SELECT item_id, 5, 'delete', 'correction_cache/w.png', NULL FROM F WHERE step <> 'moved' AND w
UNION ALL SELECT item_id, 6, 'delete', 'correction_cache/t.png', NULL FROM F WHERE step <> 'moved' AND t"""
)

_KEPT_CROPS = ORACLE_SQL["crop_nms"][: ORACLE_SQL["crop_nms"].rindex("SELECT item_id, CAST(i AS BIGINT) AS nth")].rstrip()
ORACLE_SQL["crop_candidates"] = _KEPT_CROPS + """,
I AS (SELECT o_orderkey AS item_id, 1600 + o_orderkey % 7 AS iw, 1200 + o_orderkey % 11 AS ih FROM orders),
D AS (SELECT item_id, i + 1 AS place, kept[i + 1] AS c FROM (SELECT item_id, kept, unnest(range(least(len(kept), 4))) AS i FROM Z WHERE item_id % 3 > 0)),
R AS (SELECT * FROM (VALUES (1, 'fallback_full', 0.2::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), (2, 'fallback_lower', 0.18::DOUBLE, 0.0::DOUBLE, 0.45::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE),
  (3, 'fallback_center', 0.16::DOUBLE, 0.12::DOUBLE, 0.18::DOUBLE, 0.88::DOUBLE, 0.82::DOUBLE), (4, 'fallback_right', 0.14::DOUBLE, 0.48::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE)) AS r(nth, label, score, l, t, r, b))
SELECT D.item_id, CAST(place AS BIGINT) AS place, 'tag_crop_' || CAST(place AS VARCHAR) AS label, D.c.pos AS pos, KS.score AS score, D.c.x AS x, D.c.y AS y, D.c.w AS w, D.c.h AS h
FROM D JOIN KS ON KS.item_id = D.item_id AND KS.pos = D.c.pos
UNION ALL SELECT I.item_id, coalesce(n, 0) + nth, label, 0, score, CAST(floor(iw * l) AS BIGINT), CAST(floor(ih * t) AS BIGINT), CAST(floor(iw * r) - floor(iw * l) AS BIGINT), CAST(floor(ih * b) - floor(ih * t) AS BIGINT)
FROM I LEFT JOIN (SELECT item_id, count(*) AS n FROM D GROUP BY 1) USING (item_id), R"""
ORACLE_SQL["line_fit"] = "WITH" + _PICTURES + """,
u AS (SELECT image_id, side, CAST(ceil(len(alpha) / side) AS BIGINT) AS height, unnest(alpha) AS a, unnest(range(len(alpha))) AS i FROM z),
f AS (SELECT image_id, side, height, i // side AS y, i % side AS x, a FROM u WHERE a >= 18),
r AS (SELECT image_id, any_value(side) AS side, any_value(height) AS height, y, max(x) - min(x) + 1 AS extent, quantile_cont(CAST(x AS DOUBLE), 0.5) AS center FROM f GROUP BY image_id, y),
l AS (SELECT image_id, any_value(side) AS side, any_value(height) AS height, count(*) AS occupied, quantile_cont(CAST(extent AS DOUBLE), 0.9) AS width_p90, regr_slope(center, y) AS slope, regr_intercept(center, y) AS intercept
  FROM r GROUP BY image_id),
o AS (SELECT r.image_id, quantile_cont(abs(center - (slope * y + intercept)), 0.9) AS residual_p90 FROM r JOIN l USING (image_id) GROUP BY 1),
m AS (SELECT image_id, quantile_cont(CAST(a AS DOUBLE), 0.5) AS alpha_median, avg(CASE WHEN a > 225 THEN 1.0::DOUBLE ELSE 0 END) AS bright_share FROM f GROUP BY 1)
SELECT image_id, occupied, round(occupied / height, 9) AS coverage, round(width_p90, 9) AS width_p90, round(slope, 9) + 0.0::DOUBLE AS slope, round(intercept, 9) + 0.0::DOUBLE AS intercept, round(residual_p90, 9) AS residual_p90,
  round(alpha_median, 9) AS alpha_median, round(bright_share, 9) AS bright_share,
  coalesce(occupied / height >= 0.6 AND width_p90 <= 6 AND residual_p90 <= greatest(5, side * 0.008) AND alpha_median < 190 AND bright_share < 0.25, false) AS is_line
FROM l JOIN o USING (image_id) JOIN m USING (image_id)"""

#: Asking for few sizes must not change what is chosen.
ORACLE_SQL["ladder_search"] = ORACLE_SQL["ladder_pick"]
