"""DuckDB SQL for the queries that SQL can express."""

from treeline.llm.licenses import COPYRIGHT_LINES, KNOWN, SIGNS, SPELLINGS

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+')"



def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _canonical_lines(text: str) -> str:
    out = f"lower({text})"
    for pattern in (*COPYRIGHT_LINES,):
        out = f"regexp_replace({out}, {_quoted(pattern)}, '', 'g')"
    out = f"regexp_replace({out}, {_quoted(SIGNS)}, ' ', 'g')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return out


def _whole(lines: str) -> str:
    return f"trim(regexp_replace({lines}, '[ \\n]+', ' ', 'g'), ' ')"


_KNOWN = ", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, text in KNOWN)

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BIT = "(ascii(substr(bits, 5 * i + {k}, 1)) - 48)"
_FIVE = " + ".join(f"{2 ** (5 - k)} * {_BIT.format(k=k)}" for k in range(1, 6))

ORACLE = {
    "op3_near_dedup": rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^ \t-\r]+') AS ws FROM documents),
sh AS (SELECT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws
         ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END) AS s
       FROM w),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
item AS (SELECT sh.doc_id, hash(s) AS h, n FROM sh JOIN size ON sh.doc_id = size.doc_id),
link AS (SELECT a.doc_id AS a, b.doc_id AS b
         FROM item a JOIN item b ON a.h = b.h AND a.doc_id < b.doc_id
           AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
         GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a, b FROM both_ways UNION
          SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a)
SELECT w.doc_id, coalesce(max(size.n), 0)::BIGINT AS n_shingles,
       least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(min(reach.b), w.doc_id)) AS kept
FROM w LEFT JOIN size ON size.doc_id = w.doc_id LEFT JOIN reach ON reach.a = w.doc_id GROUP BY w.doc_id
""",
    "op4_warc": f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT *, unhex(sha1(payload))::BIT::VARCHAR AS bits, max(page_id) OVER (PARTITION BY payload) AS last
      FROM p)
SELECT page_id, octet_length(payload) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + {_FIVE})::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d
""",
    "op8_license_scan": f"""
WITH known AS (SELECT sha256({_whole(_canonical_lines('t'))}) AS digest, max(name) AS license
               FROM (VALUES {_KNOWN}) v(name, t) GROUP BY 1),
c AS (SELECT doc_id, {_canonical_lines("coalesce(text, '')")} AS t FROM documents),
line AS (SELECT doc_id, trim(unnest(string_split(t, chr(10))), ' ') AS x FROM c),
found AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices,
                 count(*) AS n_notices
          FROM line JOIN known ON digest = sha256(x) WHERE x <> '' GROUP BY doc_id)
SELECT c.doc_id, sha256({_whole('t')}) AS text_digest,
       CASE WHEN {_whole('t')} <> '' THEN license END AS license,
       coalesce(notices, '') AS notices, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM c LEFT JOIN known ON digest = sha256({_whole('t')}) LEFT JOIN found ON found.doc_id = c.doc_id
""",
    "op5_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
""",
    "op6_quality_rules": rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)),
                              lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM w WHERE len(ws) >= 8),
win AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(ws[p:p + 7], ' ')) AS n
        FROM spot),
rep AS (SELECT doc_id, count(DISTINCT q) AS n
        FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM win WHERE n > 1) GROUP BY doc_id),
c AS (SELECT w.doc_id, t, ws, len(ws)::BIGINT AS n_words, len(ls) AS n_lines,
             length(regexp_replace(t, '[ \t-\r]+', '', 'g')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words
            OR word_chars > 20 * n_words OR 100 * n_dup_lines > 60 * n_lines
            OR 2 * length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g'))
               > length(regexp_replace(t, '[^\p{{L}}]+', '', 'g'))
            OR 10 * len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) < 6 * n_words) AS kept
FROM b
""",
    "op7_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 49], ' ')) AS h FROM spot),
late AS (SELECT doc_id, p FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m FROM win)
         WHERE doc_id > m),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS p FROM late),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.p) AS t, count(*) AS n
         FROM word ANTI JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p
         GROUP BY word.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
""",
    "op11_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n
           FROM documents),
spot AS (SELECT doc_id, b, unnest(range(1, n - 98)) AS p FROM d WHERE n >= 100),
late AS (SELECT doc_id, p FROM (SELECT doc_id, p, sha256(b[p:p + 99]) AS h FROM spot)
         QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, p) > 1),
mark AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -100) + 100 AS head
         FROM late),
run AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z
        FROM (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM mark)
        GROUP BY doc_id, g),
edge AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS z FROM run
         UNION ALL SELECT run.doc_id, max(z), any_value(n) + 1 FROM run JOIN d ON d.doc_id = run.doc_id
         GROUP BY run.doc_id),
kept AS (SELECT edge.doc_id, unhex(coalesce(string_agg(hex(b[edge.a:edge.z - 1]), '' ORDER BY edge.a)
                                              FILTER (edge.z > edge.a), '')) AS k
         FROM edge JOIN d ON d.doc_id = edge.doc_id GROUP BY edge.doc_id),
gone AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM run GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN gone.doc_id IS NULL THEN b ELSE k END) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
""",
    "op12_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT doc, lang, source, unnest(ws) AS item FROM d),
kept AS (SELECT lang, item, count(*) AS c FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 30),
size AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY 1),
grp AS (SELECT DISTINCT lang, source FROM d),
cnt AS (SELECT lang, source, item, count(*) AS c FROM w SEMI JOIN kept USING (lang, item) GROUP BY ALL),
tot AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM grp g LEFT JOIN cnt USING (lang, source) GROUP BY 1, 2),
p AS (SELECT tot.lang, tot.source, kept.item, coalesce(cnt.c, 0) AS c,
             1 + (1000000000 * (coalesce(cnt.c, 0) + 5)::HUGEINT) // (tot.n + 5 * size.v) AS p,
             1 + (1000000000 * (kept.c + 5)::HUGEINT) // (size.n + 5 * size.v) AS q
      FROM tot JOIN size ON tot.lang = size.lang JOIN kept ON kept.lang = tot.lang
      LEFT JOIN cnt ON cnt.lang = tot.lang AND cnt.source = tot.source AND cnt.item = kept.item),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS t, sum(abs(x.p - y.p)) AS f
                    FROM p x JOIN p y ON x.lang = y.lang AND x.item = y.item GROUP BY 1, 2, 3) f
           ON f.lang = a.lang AND s = a.source AND t = b.source),
term AS (SELECT lang, source, item, p - q AS value FROM p WHERE c > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pair
          UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM every QUALIFY part = 'pair' OR rank <= 50
""",
    "op13_hard_negatives": """
WITH e AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor, a.label = b.label AS same, b.id,
             list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::BIGINT AS score
      FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT * FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
       (row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id))::INTEGER AS rank,
       s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same
  AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
QUALIFY rank <= 10
""",
}
