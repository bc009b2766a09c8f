"""The derived inventory and each registered query in DuckDB SQL."""

from __future__ import annotations

B = "chr(92)"

FILES = f"""
files AS (
  SELECT drive_id, row_seq, path, size_bytes, modified, md5_hash, review, decision, text,
    string_split(path, {B})[-1] AS filename,
    lower(regexp_extract(string_split(path, {B})[-1], '^\\.*[^.].*?(\\.[^.]*)$', 1)) AS extension,
    false AS is_dir
  FROM (
    SELECT drive_id, doc_id AS row_seq,
      concat(drive_id, {B}, CASE WHEN lang = 'es' THEN 'users' ELSE 'Users' END, {B}, lang, {B},
        CASE WHEN source = 'src13' THEN concat('AppData', {B}) ELSE '' END, source,
        {B}, 'b', doc_id % 7, {B}, 'doc_', doc_id,
        ['.txt', '.md', '.pdf', '.docx', '.xlsx', '.JPG', '.exe', ''][doc_id % 8 + 1]) AS path,
      CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
      concat(CAST(CAST(DATE '2015-01-01' + CAST(n_chars AS INT) AS DATE) AS VARCHAR),
             'T00:00:00') AS modified,
      md5(text) AS md5_hash,
      CASE WHEN quality = 1 THEN 'True' WHEN quality = 0 THEN 'no' ELSE '' END AS review,
      CASE WHEN toxic = 1 THEN ' delete ' WHEN quality = 1 AND n_chars > 1500 THEN 'KEEP'
        WHEN quality = 0 THEN 'None' ELSE '' END AS decision,
      text
    FROM (
      SELECT d.*, l.quality, l.toxic,
        CASE WHEN CAST(substr(source, 4) AS INT) < 4 THEN 'C:'
             WHEN CAST(substr(source, 4) AS INT) >= 15 THEN 'E:' ELSE 'D:' END AS drive_id
      FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    UNION ALL
    SELECT 'F:', page_id,
      concat('F:', {B}, 'Cache', {B}, array_to_string(list_filter(
        string_split(regexp_replace(url, '^https?://', ''), '/'), lambda x: x <> ''), {B})),
      CAST(octet_length(encode(html)) AS BIGINT),
      concat(CAST(CAST(DATE '2015-01-01' + CAST(length(html) AS INT) AS DATE) AS VARCHAR),
             'T00:00:00'),
      md5(html), '', '', html
    FROM pages))"""

DIRS = f"""
dirs AS (
  SELECT drive_id, min(row_seq) AS row_seq, array_to_string(list_slice(p, 1, i), {B}) AS path
  FROM (SELECT drive_id, row_seq, string_split(path, {B}) AS p FROM files), unnest(range(2, len(p))) u(i)
  GROUP BY drive_id, array_to_string(list_slice(p, 1, i), {B}))"""

INV = f"""
inv AS (
  SELECT drive_id, row_seq, path, filename, nullif(extension, '') AS extension, is_dir,
    size_bytes, modified, md5_hash, nullif(review, '') AS review,
    CASE WHEN decision IN ('', 'None') THEN NULL ELSE decision END AS decision, text
  FROM (
    SELECT drive_id, row_seq, path, filename, extension, is_dir, size_bytes, modified, md5_hash,
      review, decision, text FROM files
    UNION ALL
    SELECT drive_id, row_seq, path, NULL, NULL, true, 0, NULL, NULL,
      CASE WHEN ends_with(path, concat({B}, 'en')) THEN 'True'
           WHEN ends_with(path, concat({B}, 'src7')) THEN '1'
           WHEN ends_with(path, concat({B}, 'src8')) THEN 'no'
           WHEN ends_with(path, '.example.com') THEN 'yes' ELSE '' END,
      CASE WHEN ends_with(path, concat({B}, 'Users', {B}, 'de'))
             OR ends_with(path, concat({B}, 'src2', {B}, 'b3'))
             OR ends_with(path, '.example.org') THEN 'DELETE'
           WHEN ends_with(path, concat({B}, 'src9')) THEN 'delete'
           WHEN ends_with(path, concat({B}, 'src1'))
             OR ends_with(path, concat('.example.net', {B}, 'en')) THEN 'KEEP'
           WHEN ends_with(path, concat({B}, 'src6')) THEN 'Archive' ELSE '' END,
      NULL
    FROM dirs))"""

# One row per row and directory above it, the root left out.
UP = f"""
up AS (
  SELECT drive_id, path, row_seq, n - i AS dist,
    array_to_string(list_slice(p, 1, i), {B}) AS anc,
    lower(array_to_string(list_slice(p, 1, i), {B})) AS anc_key
  FROM (SELECT drive_id, path, row_seq, string_split(path, {B}) AS p,
          len(string_split(path, {B})) AS n FROM inv),
    unnest(range(2, n)) u(i))"""


def stated(column: str) -> str:
    return f"""
st_{column} AS (
  SELECT drive_id, lower(path) AS key, arg_max({column}, row_seq) AS v
  FROM inv WHERE trim({column}, concat(' ', chr(9), chr(10), chr(13))) <> ''
  GROUP BY drive_id, lower(path))"""


def effective(column: str) -> str:
    """eff_<column>: every row with its effective value v and the distance d."""
    return f"""
inh_{column} AS (
  SELECT u.drive_id, u.path, arg_min(s.v, u.dist) AS v, min(u.dist) AS d,
    arg_min(u.anc, u.dist) AS anc
  FROM up u JOIN st_{column} s ON u.drive_id = s.drive_id AND u.anc_key = s.key
  GROUP BY u.drive_id, u.path),
eff_{column} AS (
  SELECT i.*, coalesce(s.v, h.v) AS v,
    CASE WHEN s.v IS NOT NULL THEN 0 ELSE h.d END AS d,
    CASE WHEN s.v IS NOT NULL THEN NULL ELSE h.anc END AS anc
  FROM inv i
  LEFT JOIN st_{column} s ON i.drive_id = s.drive_id AND lower(i.path) = s.key
  LEFT JOIN inh_{column} h ON i.drive_id = h.drive_id AND i.path = h.path)"""


def query(sql: str, *ctes: str) -> str:
    """A query over the given CTEs; a text that starts with a comma adds its own."""
    return "WITH " + ",".join(ctes) + "\n" + sql.strip()


BASE = (FILES, DIRS, INV)
DECIDED = (FILES, DIRS, INV, UP, stated("decision"), effective("decision"))
BOTH = (*DECIDED, stated("review"), effective("review"))


# Duplicates: C: is the baseline (not for itself), good E: documents the registry.
KINDS = f"""
base AS (SELECT md5_hash, arg_max(path, row_seq) AS bpath FROM files WHERE drive_id = 'C:' GROUP BY 1),
kept AS (SELECT md5_hash, arg_max(path, row_seq) AS kpath,
    concat('Recovered/', arg_max(filename, row_seq)) AS ktarget
  FROM files WHERE drive_id = 'E:' AND review = 'True' GROUP BY 1),
firsts AS (SELECT drive_id, md5_hash, arg_min(path, row_seq) AS fpath, count(*) AS n
  FROM files GROUP BY 1, 2),
kinds0 AS (
  SELECT i.*, b.bpath, k.kpath, k.ktarget, f.fpath,
    CASE WHEN b.bpath IS NOT NULL THEN 'baseline_scan' WHEN k.kpath IS NOT NULL THEN 'kept_hashes'
      WHEN f.fpath <> i.path THEN 'same_drive' ELSE '' END AS duplicate_kind
  FROM inv i
  LEFT JOIN base b ON i.md5_hash = b.md5_hash AND i.drive_id <> 'C:'
  LEFT JOIN kept k ON i.md5_hash = k.md5_hash
  LEFT JOIN firsts f ON i.md5_hash = f.md5_hash AND i.drive_id = f.drive_id),
kinds AS (
  SELECT *, CASE WHEN duplicate_kind = '' THEN 0 ELSE 1 END AS is_duplicate,
    CASE duplicate_kind WHEN 'baseline_scan' THEN bpath WHEN 'kept_hashes' THEN kpath
      WHEN 'same_drive' THEN fpath ELSE '' END AS duplicate_source_path,
    CASE duplicate_kind WHEN 'baseline_scan' THEN concat('Duplicate of baseline scan file ', bpath)
      WHEN 'kept_hashes' THEN concat('Already kept from ', kpath, ' → ', ktarget)
      WHEN 'same_drive' THEN concat('Duplicate of ', fpath, ' (same drive)') END AS comment
  FROM kinds0),
marked AS (
  SELECT * REPLACE (CASE WHEN duplicate_kind = 'baseline_scan' AND decision IS NULL
      THEN 'DELETE' ELSE decision END AS decision),
    CASE WHEN is_duplicate = 1 THEN 'SKIP' END AS recommendation,
    CASE WHEN is_duplicate = 1 THEN CAST(0.99 AS DOUBLE) END AS confidence
  FROM kinds)"""

DUPES = (*BASE, KINDS)

MANIFEST = """
manifest AS (
  SELECT *, CASE WHEN d = 0 THEN 'EXPLICIT' ELSE concat('INHERITED from ', anc) END AS decision_source
  FROM eff_decision WHERE upper(trim(v)) = 'DELETE')"""

TOTALS = """count(*) AS total_rows, count(*) FILTER (WHERE NOT is_dir) AS total_files,
  CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
  round(sum(size_bytes) / CAST(1073741824 AS DOUBLE), 2) AS total_gb,
  count(*) FILTER (WHERE decision_source = 'EXPLICIT') AS explicit_count,
  count(*) FILTER (WHERE decision_source <> 'EXPLICIT') AS inherited_count"""

# Subtree plan: b5 directories were not scanned, files above 5000 bytes are gone.
TREES = f"""
dinv AS (SELECT *, CASE WHEN is_dir AND ends_with(path, concat({B}, 'b5')) THEN 1 ELSE 0 END AS pruned,
    CASE WHEN size_bytes > 5000 THEN ' deleted' END AS delete_status FROM inv),
held AS (SELECT DISTINCT u.drive_id, u.anc_key FROM up u JOIN inv i
  ON u.drive_id = i.drive_id AND u.path = i.path WHERE upper(trim(i.decision)) <> 'DELETE'),
clean AS (
  SELECT m.drive_id, m.path, lower(m.path) AS key FROM manifest m
  WHERE m.is_dir AND NOT EXISTS (SELECT 1 FROM held h
    WHERE h.drive_id = m.drive_id AND h.anc_key = lower(m.path))),
trees AS (
  SELECT c.drive_id, c.path, c.key FROM clean c WHERE NOT EXISTS (
    SELECT 1 FROM up u JOIN clean t ON u.drive_id = t.drive_id AND u.anc_key = t.key
    WHERE u.drive_id = c.drive_id AND u.path = c.path)),
unseen AS (
  SELECT drive_id, lower(path) AS key FROM dinv WHERE pruned = 1
  UNION SELECT u.drive_id, u.anc_key FROM up u JOIN dinv i
    ON u.drive_id = i.drive_id AND u.path = i.path WHERE i.pruned = 1),
plan_trees AS (
  SELECT t.*, CASE WHEN EXISTS (SELECT 1 FROM unseen n
    WHERE n.drive_id = t.drive_id AND n.key = t.key) THEN 1 ELSE 0 END AS has_pruned_descendant
  FROM trees t),
cov AS (
  SELECT i.drive_id, i.path, max(t.has_pruned_descendant) AS failed
  FROM (SELECT drive_id, path, lower(path) AS key FROM inv
        UNION ALL SELECT drive_id, path, anc_key FROM up) i
  JOIN plan_trees t ON i.drive_id = t.drive_id AND i.key = t.key GROUP BY 1, 2),
single AS (
  SELECT d.* FROM dinv d JOIN manifest m ON d.drive_id = m.drive_id AND d.path = m.path
  LEFT JOIN cov c ON d.drive_id = c.drive_id AND d.path = c.path
  WHERE NOT d.is_dir AND coalesce(upper(trim(d.delete_status)), '') <> 'DELETED'
    AND c.path IS NULL)"""

DELETION = (*DECIDED, MANIFEST, TREES)

TRIAGE = f"""
todo0 AS (SELECT *, row_number() OVER (PARTITION BY drive_id
    ORDER BY row_seq, len(string_split(path, {B})), path) - 1 AS pos
  FROM marked WHERE recommendation IS NULL),
todo AS (SELECT *, pos // 50 AS batch_id, pos % 50 AS batch_pos FROM todo0)"""

# The items of a batch as one JSON text.
PAYLOADS = f"""
payloads AS (SELECT drive_id, batch_id, count(*) AS n_rows, concat('[', string_agg(concat(
    '{{"path":"', replace(path, {B}, concat({B}, {B})), '","filename":"', coalesce(filename, ''),
    '","extension":"', coalesce(extension, ''), '","is_dir":', CASE WHEN is_dir THEN 'true' ELSE 'false' END,
    ',"size_bytes":', size_bytes, ',"modified":', CASE WHEN modified IS NULL THEN 'null' ELSE concat('"', modified, '.000"') END, '}}'),
    ',' ORDER BY batch_pos), ']') AS items FROM todo GROUP BY drive_id, batch_id)"""

REPLIES = f"""
items AS (
  SELECT drive_id, batch_id, batch_pos, concat('{{"path": "',
    replace(path, {B}, concat({B}, {B})), '", "recommendation": "',
    CASE WHEN is_dir THEN 'REVIEW' ELSE 'INTERESTING' END, '", "confidence": ',
    CASE WHEN is_dir THEN '0.25' ELSE '0.75' END, ', "comment": ',
    CASE WHEN is_dir THEN 'null' ELSE '"looks personal"' END, '}}') AS item
  FROM todo WHERE coalesce(extension, '') <> '.md'),
bodies AS (SELECT drive_id, batch_id, string_agg(item, ', ' ORDER BY batch_pos) AS body
  FROM items GROUP BY 1, 2),
replies AS (
  SELECT drive_id, batch_id, CASE batch_id % 8
    WHEN 1 THEN concat('```json', chr(10), '[', body, ']', chr(10), '```')
    WHEN 2 THEN concat('[', body, '] that is all')
    WHEN 3 THEN 'not json at all'
    WHEN 4 THEN concat('  ```', chr(10), '[', body, ']```  ')
    WHEN 5 THEN '{{"path": "x", "recommendation": "SKIP", "confidence": 1, "comment": ""}}'
    WHEN 6 THEN concat('[', body, ', {{"path": "x", "recommendation": "SKIP", "confidence": 1}}]')
    ELSE concat('[', body, ']') END AS reply
  FROM bodies),
plain AS (
  SELECT drive_id, batch_id, trim(regexp_replace(regexp_replace(trim(reply),
    '^```(json)?\\s*', '', 'i'), '\\s*```$', '')) AS body FROM replies),
arrays AS (
  SELECT drive_id, batch_id, CASE WHEN json_valid(body) AND json_type(body) = 'ARRAY' THEN body END AS body
  FROM plain),
elements AS (
  SELECT drive_id, batch_id, unnest(range(0, CAST(json_array_length(body) AS BIGINT))) AS i, body
  FROM arrays WHERE body IS NOT NULL),
rated AS (
  SELECT drive_id, batch_id, i, json_extract(body, concat('$[', i, ']')) AS e FROM elements),
flags AS (
  SELECT drive_id, batch_id, count(*) AS n, bool_and(len(list_intersect(json_keys(e),
    ['path', 'recommendation', 'confidence', 'comment'])) = 4) AS ok
  FROM rated GROUP BY 1, 2)"""

TRIAGED = (*DUPES, TRIAGE)
REPLIED = (*TRIAGED, REPLIES)

PAGES = """
pdf_pages AS (
  SELECT path, i AS page_no, substr(text, i * (40 + row_seq % 300) + 1, 40 + row_seq % 300) AS text,
    CASE WHEN (row_seq + i) % 97 = 0 THEN 1 ELSE 0 END AS n_images
  FROM files, unnest(range(0, CAST(greatest(ceil(length(text) / CAST(40 + row_seq % 300 AS DOUBLE)), 1)
    AS BIGINT))) u(i)
  WHERE extension = '.pdf'),
pdf_facts AS (
  SELECT path, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS total_chars,
    max(n_images) AS has_images,
    CASE WHEN sum(length(text)) / CAST(count(*) AS DOUBLE) < 100 THEN 1 ELSE 0 END AS sparse
  FROM pdf_pages GROUP BY path)"""


def lines(extension: str) -> str:
    return f"""
lines AS (
  SELECT path, i - 1 AS line_no, l[i] AS line
  FROM (SELECT path, string_split(text, chr(10)) AS l FROM files WHERE extension = '{extension}'),
    unnest(range(1, len(l) + 1)) u(i))"""


SHEETS = """
cells AS (
  SELECT path, line_no % 2 AS sheet_no, concat('S', line_no % 2) AS sheet, line_no AS row_no,
    replace(line, ' ', chr(9)) AS line FROM lines),
preview AS (
  SELECT path, sheet_no, sheet, row_no, line,
    row_number() OVER (PARTITION BY path, sheet ORDER BY row_no) AS shown
  FROM cells WHERE trim(line, concat(' ', chr(9), chr(13))) <> ''
  QUALIFY shown <= 20)"""

SUMMARIES = """
organizable AS (
  SELECT *, concat('Summary of ', filename) AS summary FROM eff_decision
  WHERE NOT is_dir AND upper(trim(v)) IN ('KEEP', 'ARCHIVE')
    AND coalesce(extension, '') NOT IN ('.exe', '.jpg', ''))"""

TARGETS = """
targeted AS (
  SELECT *, CASE WHEN is_dir THEN NULL
    WHEN extension = '.txt' THEN concat('Text/', filename)
    WHEN extension = '.md' THEN NULL
    WHEN extension = '.pdf' THEN concat('/abs/', filename)
    WHEN extension = '.docx' THEN concat('Docs/../../', filename)
    WHEN extension = '.xlsx' THEN concat('Sheets/', substr(md5_hash, 1, 2), '.xlsx')
    WHEN extension = '.jpg' THEN ' NaN '
    WHEN extension = '.html' THEN concat('Pages', chr(92), filename)
    ELSE concat('Other/', drive_id, '/', filename) END AS organized_path,
    CASE WHEN review = 'no' THEN 'copied ' END AS copy_status0
  FROM eff_decision),
plan0 AS (
  SELECT *, CASE WHEN organized_path IS NULL OR extension = '.jpg' THEN 'SKIPPED'
      WHEN extension IN ('.pdf', '.docx') THEN 'FAILED' END AS status0,
    lower(replace(organized_path, '/', chr(92))) AS target_key
  FROM targeted WHERE NOT is_dir AND upper(trim(v)) IN ('KEEP', 'ARCHIVE') AND copy_status0 IS NULL),
plan1 AS (
  SELECT *, CASE WHEN status0 IS NOT NULL THEN status0
    WHEN count(*) FILTER (WHERE status0 IS NULL) OVER (PARTITION BY target_key) > 1 THEN 'FAILED'
    ELSE 'PLANNED' END AS plan_status FROM plan0),
planned AS (
  SELECT *, CASE WHEN plan_status = 'PLANNED'
    THEN concat('/recovered/', replace(organized_path, chr(92), '/')) END AS dest FROM plan1),
verified AS (
  SELECT *, CASE WHEN plan_status <> 'PLANNED' THEN plan_status
    WHEN drive_id <> 'C:' AND size_bytes <= 4000 AND extension IS DISTINCT FROM '.xlsx' THEN 'COPIED'
    ELSE 'FAILED' END AS copy_status FROM planned)"""

PLANNED = (*DECIDED, TARGETS)

RULES = f"""
ruled AS (
  SELECT *, CASE
    WHEN len(list_intersect(string_split(path, {B}), ['Windows', 'Program Files', 'AppData'])) > 0 THEN 1
    WHEN NOT is_dir AND extension IN ('.exe', '.msi', '.dll', '.sys') THEN 2
    WHEN NOT is_dir AND extension IN ('.docx', '.pdf', '.xlsx')
      AND len(list_intersect(string_split(lower(path), {B}), ['users', 'home'])) > 0 THEN 3
    WHEN NOT is_dir AND extension IN ('.jpg', '.png', '.psd', '.raw', '.tiff') THEN 4
    WHEN NOT is_dir AND size_bytes < 1024 THEN 5 ELSE 6 END AS rule FROM inv),
rule_rows AS (
  SELECT *, ['SKIP', 'SKIP', 'INTERESTING', 'REVIEW', 'SKIP', 'REVIEW'][rule] AS recommendation,
    CAST([0.99, 0.9, 0.8, 0.6, 0.7, 0.5][rule] AS DOUBLE) AS confidence,
    ['system directory', 'program file', 'document in a user directory', 'picture',
     'very small file', 'no rule applies'][rule] AS comment FROM ruled)"""

NO_DIR_STATED = """
dst AS (SELECT drive_id, lower(path) AS key, arg_max(decision, row_seq) AS v FROM inv
  WHERE is_dir AND trim(decision) <> '' GROUP BY 1, 2),
dman AS (
  SELECT i.drive_id, i.path FROM inv i
  LEFT JOIN dst s ON i.drive_id = s.drive_id AND lower(i.path) = s.key
  LEFT JOIN (SELECT u.drive_id, u.path, arg_min(s.v, u.dist) AS v FROM up u
      JOIN dst s ON u.drive_id = s.drive_id AND u.anc_key = s.key GROUP BY 1, 2) h
    ON i.drive_id = h.drive_id AND i.path = h.path
  WHERE upper(trim(coalesce(s.v, h.v))) = 'DELETE'),
both_sides AS (
  SELECT coalesce(c.drive_id, m.drive_id) AS drive_id, c.path AS cpath, m.path AS mpath
  FROM (SELECT DISTINCT drive_id, path FROM manifest) c
  FULL OUTER JOIN (SELECT DISTINCT drive_id, path FROM dman) m
    ON c.drive_id = m.drive_id AND c.path = m.path)"""

EXCLUDED = f"""
visited AS (
  SELECT *, CASE WHEN is_dir AND string_split(path, {B})[-1] = 'AppData' THEN 1 ELSE 0 END AS skip
  FROM inv
  WHERE (is_dir OR coalesce(extension, '') NOT IN ('.exe', '.msi', '.dll', '.sys', '.tmp', '.log',
      '.ini', '.lnk', '.url', '.db', '.cache'))
    AND path NOT LIKE concat('%', {B}, 'AppData', {B}, '%')),
seen AS (SELECT DISTINCT path FROM inv WHERE modified < '2021-01-01T00:00:00')"""


def _text_facts(source: str, position: str, text: str) -> str:
    return f"""
SELECT path, length(c) AS n_chars, md5(c) AS content_md5 FROM (
  SELECT path, string_agg({text}, chr(10) ORDER BY {position}) AS c FROM {source} GROUP BY path)"""


ORACLE = {
    "inventory_files": query(f"""
SELECT drive_id, row_seq, path, filename, extension, size_bytes, modified, md5_hash,
  lower(path) AS path_key,
  lower(array_to_string(string_split(path, {B})[:-2], {B})) AS parent_key,
  len(string_split(path, {B})) - 1 AS depth, drive_id AS drive_letter,
  concat(drive_id, {B}, filename) AS at_root FROM files""", FILES),
    "inventory_dirs": query("SELECT drive_id, row_seq, path FROM dirs", FILES, DIRS),
    "excluded_filtered": query("""
SELECT drive_id, path, CASE WHEN skip = 1 THEN 'SKIP' END AS recommendation,
  CASE WHEN skip = 1 THEN CAST(0.99 AS DOUBLE) END AS confidence,
  CASE WHEN skip = 1 THEN 'Excluded by config' END AS comment FROM visited""", *BASE, EXCLUDED),
    "resume_new_rows": query("""
SELECT drive_id, row_seq, path, CAST(is_dir AS BIGINT) AS is_dir FROM inv
WHERE path NOT IN (SELECT path FROM seen)""", *BASE, EXCLUDED),
    "remaining_work": query("""
SELECT drive_id, count(*) AS remaining_items,
  CAST(coalesce(sum(size_bytes) FILTER (WHERE NOT is_dir), 0) AS BIGINT) AS remaining_bytes
FROM visited WHERE (NOT is_dir OR skip = 1) AND path NOT IN (SELECT path FROM seen)
GROUP BY drive_id""", *BASE, EXCLUDED),
    "hash_winners": query("""
SELECT f.drive_id, f.md5_hash, f.fpath AS first_path, f.n, b.bpath AS baseline_path
FROM firsts f LEFT JOIN base b ON f.md5_hash = b.md5_hash""", *DUPES),
    "duplicate_kinds": query("""
SELECT drive_id, path, CAST(is_duplicate AS BIGINT) AS is_duplicate, duplicate_kind,
  duplicate_source_path, comment FROM kinds""", *DUPES),
    "mark_duplicates": query("""
SELECT drive_id, path, recommendation, confidence, decision, comment FROM marked""", *DUPES),
    "duplicate_summary": query("""
SELECT drive_id, count(*) FILTER (WHERE duplicate_kind = 'baseline_scan') AS baseline_count,
  count(*) FILTER (WHERE duplicate_kind = 'kept_hashes') AS kept_count,
  count(*) FILTER (WHERE duplicate_kind = 'same_drive') AS same_drive_count,
  count(*) FILTER (WHERE duplicate_kind = 'baseline_scan' AND upper(decision) = 'DELETE')
    AS auto_delete_count,
  count(*) FILTER (WHERE is_duplicate = 1) AS duplicate_count,
  count(*) FILTER (WHERE is_duplicate = 0) AS remaining_count
FROM marked GROUP BY drive_id""", *DUPES),
    "effective_decision": query("""
SELECT drive_id, row_seq, path, v AS effective_decision, d AS decision_distance,
  CASE WHEN d = 0 THEN 'explicit' WHEN d > 0 THEN concat('inherited from ', anc)
    ELSE 'unset' END AS decision_source FROM eff_decision""", *DECIDED),
    "effective_review_and_decision": query("""
SELECT d.drive_id, d.row_seq, d.path, r.v AS effective_review, d.v AS effective_decision,
  r.d AS review_distance, d.d AS decision_distance
FROM eff_decision d JOIN eff_review r ON d.drive_id = r.drive_id AND d.path = r.path AND d.row_seq = r.row_seq""", *BOTH),
    "resolve_path": query(f"""
, asked AS (SELECT i AS step, array_to_string(list_slice(p, 1, 6 - i), {B}) AS anc
    FROM (SELECT ['D:', 'Users', 'DE', 'src9', 'b1', 'new file.txt'] AS p), unnest(range(0, 5)) u(i)),
stated_all AS (SELECT 'review' AS column_name, * FROM st_review
    UNION ALL SELECT 'decision', * FROM st_decision),
hits AS (SELECT column_name, arg_min(s.v, a.step) AS value, min(a.step) AS step,
    arg_min(a.anc, a.step) AS anc
  FROM asked a JOIN stated_all s ON lower(a.anc) = s.key GROUP BY column_name)
SELECT 'D:/Users/DE//src9/b1/new file.txt' AS path, n.column_name, h.value,
  CASE WHEN h.step = 0 THEN 'explicit' WHEN h.step > 0 THEN concat('inherited from ', h.anc)
    ELSE 'unset' END AS source
FROM (SELECT unnest(['review', 'decision', 'owner']) AS column_name) n
LEFT JOIN hits h ON n.column_name = h.column_name""", *BASE, stated("review"), stated("decision")),
    "effective_delete_set": query("""
SELECT DISTINCT drive_id, path FROM manifest""", *DECIDED, MANIFEST),
    "delete_manifest": query("""
SELECT drive_id, path, coalesce(filename, '') AS filename, size_bytes, decision_source
FROM manifest""", *DECIDED, MANIFEST),
    "manifest_totals": query(f"SELECT {TOTALS} FROM manifest", *DECIDED, MANIFEST),
    "manifest_per_drive": query(f"""
SELECT concat('drive_', lower(substr(drive_id, 1, 1)), '_delete_manifest.csv') AS manifest, {TOTALS}
FROM manifest GROUP BY drive_id""", *DECIDED, MANIFEST),
    "manifest_guard": query("""
SELECT drive_id, count(*) FILTER (WHERE mpath IS NULL) AS missing_count,
  min(cpath) FILTER (WHERE mpath IS NULL) AS missing_example,
  count(*) FILTER (WHERE cpath IS NULL) AS stale_count,
  min(mpath) FILTER (WHERE cpath IS NULL) AS stale_example
FROM both_sides GROUP BY drive_id""", *DECIDED, MANIFEST, NO_DIR_STATED),
    "subtree_candidates": query(f"""
SELECT drive_id, path, len(string_split(path, {B})) - 1 AS separators,
  CAST(has_pruned_descendant AS BIGINT) AS has_pruned_descendant FROM plan_trees""", *DELETION),
    "covered_rows": query("""
SELECT i.drive_id, i.path, CAST(c.path IS NOT NULL AS BIGINT) AS covered FROM inv i
LEFT JOIN cov c ON i.drive_id = c.drive_id AND i.path = c.path""", *DELETION),
    "delete_files_plan": query("SELECT drive_id, path, size_bytes FROM single", *DELETION),
    "delete_outcomes": query("""
SELECT d.drive_id, d.path, CASE WHEN c.failed = 0 THEN 'DELETED' WHEN c.failed = 1 THEN 'FAILED'
  WHEN s.path IS NOT NULL AND s.extension = '.exe' THEN 'FAILED'
  WHEN s.path IS NOT NULL THEN 'DELETED' ELSE d.delete_status END AS delete_status
FROM dinv d LEFT JOIN cov c ON d.drive_id = c.drive_id AND d.path = c.path
LEFT JOIN single s ON d.drive_id = s.drive_id AND d.path = s.path""", *DELETION),
    "triage_batches": query("SELECT drive_id, path, batch_id, batch_pos FROM todo", *TRIAGED),
    "triage_payloads": query("""
SELECT drive_id, batch_id, n_rows, length(items) AS n_chars, md5(items) AS items_md5
FROM payloads""", *TRIAGED, PAYLOADS),
    "rule_triage": query("""
SELECT drive_id, path, recommendation, confidence, comment FROM rule_rows""", *BASE, RULES),
    "triage_parse": query("""
SELECT r.drive_id, r.batch_id, CASE WHEN any_value(f.ok) THEN any_value(f.n) ELSE -1 END AS n_items,
  CASE WHEN any_value(f.ok) THEN md5(string_agg(concat_ws('|',
    coalesce(json_extract_string(a.e, '$.path'), '-'), coalesce(json_extract_string(a.e, '$.recommendation'), '-'),
    coalesce(json_extract_string(a.e, '$.confidence'), '-'), coalesce(json_extract_string(a.e, '$.comment'), '-')),
    chr(10) ORDER BY a.i)) END AS items_md5
FROM replies r LEFT JOIN flags f ON r.drive_id = f.drive_id AND r.batch_id = f.batch_id
LEFT JOIN rated a ON r.drive_id = a.drive_id AND r.batch_id = a.batch_id
GROUP BY r.drive_id, r.batch_id""", *REPLIED),
    "triage_apply": query("""
, good AS (SELECT r.drive_id, r.batch_id, json_extract_string(r.e, '$.path') AS path,
    json_extract_string(r.e, '$.recommendation') AS recommendation,
    CAST(json_extract_string(r.e, '$.confidence') AS DOUBLE) AS confidence,
    json_extract_string(r.e, '$.comment') AS comment
  FROM rated r JOIN flags f ON r.drive_id = f.drive_id AND r.batch_id = f.batch_id WHERE f.ok
  QUALIFY row_number() OVER (PARTITION BY r.drive_id, r.batch_id,
    json_extract_string(r.e, '$.path') ORDER BY r.i DESC) = 1)
SELECT t.drive_id, t.path,
  CASE WHEN g.path IS NOT NULL THEN g.recommendation ELSE 'REVIEW' END AS recommendation,
  CASE WHEN g.path IS NOT NULL THEN g.confidence ELSE CAST(0.5 AS DOUBLE) END AS confidence,
  CASE WHEN g.path IS NOT NULL THEN g.comment
    WHEN f.ok THEN 'LLM did not return a result for this item'
    ELSE 'LLM parse error — manual review needed' END AS comment,
  CAST(1 AS BIGINT) AS recommendation_valid
FROM todo t LEFT JOIN flags f ON t.drive_id = f.drive_id AND t.batch_id = f.batch_id
LEFT JOIN good g ON t.drive_id = g.drive_id AND t.batch_id = g.batch_id AND t.path = g.path""", *REPLIED),
    "summarize_eligible": query("""
SELECT d.drive_id, d.path, r.v AS effective_review, d.v AS effective_decision
FROM eff_decision d JOIN eff_review r ON d.drive_id = r.drive_id AND d.path = r.path AND d.row_seq = r.row_seq
WHERE lower(trim(r.v)) IN ('true', '1', 'yes') AND coalesce(upper(trim(d.v)), '') <> 'DELETE'
  AND NOT d.is_dir AND coalesce(d.extension, '') <> '.md'""", *BOTH),
    "content_route": query("""
SELECT drive_id, path, CASE WHEN extension IN ('.docx', '.pdf', '.xlsx') THEN extension[2:]
  WHEN extension = '.jpg' THEN 'image' WHEN extension IN ('.txt', '.md', '.html') THEN 'text'
  ELSE 'text_attempt' END AS route FROM files""", FILES),
    "truncate_words": query(r"""
SELECT drive_id, row_seq, length(c) AS n_chars, md5(c) AS cut_md5 FROM (
  SELECT drive_id, row_seq, CASE WHEN len(w) <= 300 THEN text
    ELSE array_to_string(w[:300], ' ') END AS c
  FROM (SELECT drive_id, row_seq, text, string_split_regex(
      trim(text, concat(' ', chr(9), chr(10), chr(13))), '[ \t\n\r]+') AS w FROM files))""", FILES),
    "pdf_complexity": query("""
SELECT p.path, p.n_pages, p.total_chars, CAST(p.has_images AS BIGINT) AS has_images,
  CAST(p.sparse AS BIGINT) AS sparse,
  CAST(greatest(p.has_images, p.sparse) AS BIGINT) AS is_complex,
  CAST(greatest(CASE f.review WHEN 'True' THEN 0 WHEN 'no' THEN 1 ELSE p.has_images END, p.sparse)
    AS BIGINT) AS is_complex_cached
FROM pdf_facts p JOIN files f ON p.path = f.path""", FILES, PAGES),
    "pdf_complexity_fill": query("""
SELECT f.drive_id, f.path, CASE WHEN f.review = 'no' THEN 'complex'
  WHEN p.path IS NULL THEN '' WHEN greatest(p.has_images, p.sparse) = 1 THEN 'complex'
  ELSE 'simple' END AS pdf_complexity
FROM files f LEFT JOIN pdf_facts p ON f.path = p.path""", FILES, PAGES),
    "pdf_text": query(_text_facts("(SELECT * FROM pdf_pages WHERE text <> '')", "page_no", "text"),
                      FILES, PAGES),
    "sheet_preview": query("SELECT path, sheet, row_no, shown FROM preview",
                           FILES, lines(".xlsx"), SHEETS),
    "sheet_text": query(_text_facts("""(
    SELECT path, sheet_no * 21 + shown AS place, line FROM preview
    UNION ALL SELECT DISTINCT path, sheet_no * 21, concat('Sheet: ', sheet) FROM cells)""", "place", "line"),
                        FILES, lines(".xlsx"), SHEETS),
    "paragraph_join": query(_text_facts(
        "(SELECT * FROM lines WHERE trim(line, concat(' ', chr(9), chr(13))) <> '')", "line_no", "line"),
        FILES, lines(".docx")),
    "organize_eligible": query(
        "SELECT drive_id, path, filename, summary FROM organizable", *DECIDED, SUMMARIES),
    "organize_payloads": query("""
SELECT drive_id, pos // 25 AS batch_id, count(*) AS n_rows, md5(concat('[', string_agg(concat(
    '{"path":"', replace(path, chr(92), concat(chr(92), chr(92))), '","filename":"', filename,
    '","summary":"', summary, '"}'), ',' ORDER BY pos), ']')) AS items_md5
FROM (SELECT *, row_number() OVER (PARTITION BY drive_id ORDER BY row_seq, path) - 1 AS pos
      FROM organizable) GROUP BY drive_id, pos // 25""", *DECIDED, SUMMARIES),
    "apply_assignments": query("""
SELECT t.drive_id, t.path,
  CASE WHEN a.path IS NULL THEN t.organized_path
    WHEN t.size_bytes > 2000 THEN concat('Large/', t.filename)
    ELSE concat('Old/', t.filename) END AS organized_path,
  CAST(a.path IS NOT NULL AS BIGINT) AS assigned
FROM targeted t LEFT JOIN (SELECT path FROM organizable WHERE extension <> '.txt') a
  ON t.path = a.path""", *PLANNED, SUMMARIES),
    "rule_targets": query("""
SELECT drive_id, path, concat(CASE WHEN extension IN ('.docx', '.pdf', '.xlsx') THEN 'Documents'
  WHEN extension = '.jpg' THEN 'Pictures' WHEN extension IN ('.txt', '.md', '.html') THEN 'Text'
  ELSE 'Files' END, '/', substr(modified, 1, 4), '/', filename) AS organized_path FROM files""", FILES),
    "copy_plan": query("""
SELECT drive_id, path, organized_path, dest, plan_status FROM planned""", *PLANNED),
    "copy_verify": query("SELECT drive_id, path, copy_status FROM verified", *PLANNED),
    "copy_counts": query("""
SELECT drive_id, count(*) AS eligible_count,
  count(*) FILTER (WHERE copy_status = 'COPIED') AS copied_count,
  count(*) FILTER (WHERE copy_status = 'FAILED') AS failed_count,
  count(*) FILTER (WHERE copy_status = 'SKIPPED') AS skipped_count
FROM verified GROUP BY drive_id""", *PLANNED),
    "kept_registry_rows": query("""
SELECT md5_hash, path AS original_path, organized_path, drive_id AS drive,
  '2024-05-01T12:00:00' AS date_copied FROM verified WHERE copy_status = 'COPIED'""", *PLANNED),
    "status_fold": query("""
SELECT t.drive_id, t.path, coalesce(v.copy_status, t.copy_status0) AS copy_status
FROM targeted t LEFT JOIN verified v ON t.drive_id = v.drive_id AND t.path = v.path""", *PLANNED),
    "duplicates_report": query("""
SELECT concat('drive ', drive_id) AS source_csv, path, filename,
  CAST(size_bytes AS VARCHAR) AS size_bytes, md5_hash, duplicate_source_path, recommendation,
  coalesce(decision, '') AS decision, comment
FROM marked WHERE duplicate_kind = 'baseline_scan'""", *DUPES),
    "report_totals": query("""
SELECT concat('drive ', drive_id) AS source_csv, count(*) AS duplicate_files,
  CAST(sum(size_bytes) AS BIGINT) AS total_bytes,
  round(sum(size_bytes) / CAST(1073741824 AS DOUBLE), 2) AS total_gb
FROM marked WHERE duplicate_kind = 'baseline_scan' GROUP BY drive_id""", *DUPES),
    "review_shortlist": query("""
SELECT k.drive_id, k.path, CASE WHEN k.is_dir THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS sort_dir,
  r.recommendation
FROM kinds k JOIN rule_rows r ON k.drive_id = r.drive_id AND k.path = r.path AND k.row_seq = r.row_seq
WHERE k.is_duplicate = 0""", *DUPES, RULES),
    "blank_values": query("""
SELECT drive_id, count(*) FILTER (WHERE coalesce(decision, '') IN ('', 'None')) AS blank_decisions,
  count(*) FILTER (WHERE coalesce(decision, '') = '') AS unset_decisions,
  count(*) FILTER (WHERE upper(trim(decision)) = 'DELETE') AS deletes,
  CAST(sum(CASE WHEN regexp_full_match(string_split(path, chr(92))[-1], '[0-9]+')
    THEN CAST(string_split(path, chr(92))[-1] AS BIGINT) END) AS BIGINT) AS digit_names
FROM raw_inv GROUP BY drive_id""", *BASE, """
raw_inv AS (
  SELECT i.drive_id, i.path, CASE WHEN i.is_dir THEN i.decision ELSE f.decision END AS decision
  FROM inv i LEFT JOIN files f ON i.drive_id = f.drive_id AND i.path = f.path AND i.row_seq = f.row_seq)"""),
    "incremental_inventory": query("""
SELECT drive_id, path, CAST(is_duplicate AS BIGINT) AS is_duplicate, duplicate_kind,
  duplicate_source_path, comment FROM kinds""", *DUPES),
    "rate_fold": query("""
SELECT m.drive_id, m.path, CAST(2 * count(*) AS BIGINT) AS n_rows,
  min(coalesce(m.recommendation, r.recommendation)) AS recommendation, CAST(0 AS BIGINT) AS still_open
FROM marked m JOIN rule_rows r ON m.drive_id = r.drive_id AND m.path = r.path
GROUP BY m.drive_id, m.path""", *DUPES, RULES),
    "summary_fold": query("""
SELECT drive_id, path, CAST(2 * count(*) AS BIGINT) AS n_rows,
  CASE WHEN bool_or(NOT is_dir) THEN max(md5_hash) ELSE '' END AS least, 'kept' AS most
FROM inv GROUP BY drive_id, path""", *BASE),
    "unfenced_replies": query("""
SELECT drive_id, row_seq, md5(trim(text, concat(' ', chr(9), chr(10), chr(13)))) AS body_md5
FROM files""", FILES),
    "ledger_calls": query("""
SELECT drive_id, batch_id, unnest([0, 1]) AS copy, concat(CASE WHEN batch_id % 5 < 3 AND length(items) % 3 <> 0
    THEN 'one ' ELSE 'two ' END, right(items, 60)) AS reply, NULL::VARCHAR AS error,
  CASE WHEN batch_id % 5 < 3 AND length(items) % 3 = 0 THEN 2::BIGINT ELSE 1::BIGINT END AS n_attempts
FROM payloads""", *TRIAGED, PAYLOADS),
    "registry_appends": query("""
SELECT md5_hash, arg_max(path, (row_seq % 3, row_seq, path)) AS kept_path,
  concat('to/', arg_max(filename, (row_seq % 3, row_seq, path))) AS kept_target,
  count(*) AS n_rows, CAST(1 + max(row_seq % 3) AS INTEGER) AS last_append
FROM files GROUP BY md5_hash""", FILES),
    "summary_inputs": query(f"""
, sheet_lines AS (""" + lines(".xlsx").partition("lines AS (")[2] + """,
para_lines AS (""" + lines(".docx").partition("lines AS (")[2] + """,
lines AS (SELECT * FROM sheet_lines),""" + SHEETS + """,
texts AS (
  SELECT path, string_agg(text, chr(10) ORDER BY page_no) AS c FROM pdf_pages WHERE text <> '' GROUP BY path
  UNION ALL SELECT path, string_agg(line, chr(10) ORDER BY place) FROM (
    SELECT path, sheet_no * 21 + shown AS place, line FROM preview
    UNION ALL SELECT DISTINCT path, sheet_no * 21, concat('Sheet: ', sheet) FROM cells) GROUP BY path
  UNION ALL SELECT path, string_agg(line, chr(10) ORDER BY line_no) FROM para_lines
    WHERE trim(line, concat(' ', chr(9), chr(13))) <> '' GROUP BY path
  UNION ALL SELECT path, CASE extension WHEN '.exe' THEN 'no reader' WHEN '.jpg' THEN to_base64(encode(text))
    ELSE text END FROM files WHERE extension NOT IN ('.pdf', '.xlsx', '.docx')),
found AS (
  SELECT f.drive_id, f.path, coalesce(t.c, '') AS c, CASE WHEN extension = '.exe' THEN 'error'
    WHEN extension = '.jpg' THEN 'image_b64' WHEN extension = '.pdf' AND greatest(CASE f.review WHEN 'True' THEN 0 WHEN 'no' THEN 1
      ELSE p.has_images END, p.sparse) = 1 THEN 'complex_pdf' ELSE 'text' END AS kind
  FROM files f LEFT JOIN texts t ON f.path = t.path LEFT JOIN pdf_facts p ON f.path = p.path)
SELECT drive_id, path, kind, length(c) AS n_chars, md5(c) AS content_md5 FROM found""", FILES, PAGES),
    "csv_records": """
SELECT doc_id, lang, CASE WHEN doc_id % 2 = 1 THEN 'x' || chr(10) END AS more,
       CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half,
       length('"' || text || ',"' || chr(10)) AS n_chars, md5('"' || text || ',"' || chr(10)) AS comment_md5
FROM documents
""",
}
