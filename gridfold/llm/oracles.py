"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from gridfold.llm import infill, licenses, mixing, urls

# words of [^\x20\x09-\x0D]+
_SIZE = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source, {_SIZE}::BIGINT AS size,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, {mixing.HASH_DIGITS}))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w,
             3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER before, 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
      FROM w WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
share AS (SELECT arg_min(level, cap / w) AS share FROM l WHERE cap > level * w),
t AS (SELECT source, source_size, round(coalesce(least(cap, share * w), cap), 6) AS target
      FROM l CROSS JOIN share),
b AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS times FROM t),
g AS (SELECT source, h, sum(size) AS size, count(*) AS rows FROM d WHERE size > 0 GROUP BY source, h),
r AS (SELECT g.*, b.target - b.times * b.source_size AS budget,
             sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS upto
      FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source),
k AS (SELECT *, greatest((budget - (upto - size)) / (size / rows), 0) AS fit FROM r),
-- how many of the rows with one hash are taken: all but in the last one
n AS (SELECT source, h, CASE WHEN budget <= 0 THEN 0 WHEN upto <= budget THEN rows
             ELSE least(floor(fit) + CASE WHEN fit - floor(fit) > 0.5 THEN 1 ELSE 0 END, rows) END AS most FROM k),
e AS (SELECT *, row_number() OVER (PARTITION BY source, h ORDER BY doc_id) AS nth FROM d)
SELECT e.doc_id, e.source, e.size, b.source_size, b.target,
       (e.size * least(b.times + CASE WHEN e.nth <= n.most THEN 1 ELSE 0 END, 3))::BIGINT AS taken
FROM e JOIN b ON e.source IS NOT DISTINCT FROM b.source
LEFT JOIN n ON e.source IS NOT DISTINCT FROM n.source AND e.h = n.h
"""


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op5() -> str:
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = licenses.WORD_RE
    rows = ", ".join(f"({i}, {_text(a)}, {_text(b)})" for i, (a, b) in enumerate(licenses.TEMPLATES))
    phrases = []
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        cond = " AND ".join(f"w[i + {k}] = {_text(x)}" for k, x in enumerate(p))
        phrases.append(f"SELECT rid, i - 1 AS place, {_text(label)} AS label FROM pos WHERE {cond}")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
                  regexp_extract_all({lower.format("coalesce(text, '')")}, '{word}') AS w FROM documents),
pos AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d),
base AS ({" UNION ALL ".join(phrases)}),
bagg AS (SELECT rid, count(*) AS n, min(place) AS lo, max(place) AS hi, list(DISTINCT label) AS labels FROM base GROUP BY rid),
tpl AS (SELECT tid, label, list_distinct(regexp_extract_all({lower.format("body")}, '{word}')) AS toks
        FROM (VALUES {rows}) AS v(tid, label, body)),
span AS (SELECT max(len(toks)) AS m FROM tpl),
blk AS (SELECT rid, list_distinct(w[b * m + 1 : b * m + 2 * m]) AS bw
        FROM (SELECT rid, w, m, unnest(range(0, greatest(ceil(len(w) / m)::BIGINT - 2, 0) + 1)) AS b
              FROM d CROSS JOIN span WHERE len(w) > 0)),
hit AS (SELECT rid, label, len(list_intersect(toks, bw)) / len(toks) AS c FROM blk CROSS JOIN tpl
        WHERE len(list_intersect(toks, bw)) >= ceil(len(toks) * {licenses.THRESHOLD} - 1e-9)),
hagg AS (SELECT rid, list(DISTINCT label) AS labels, max(c) AS score FROM hit GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base,
       lo::BIGINT AS first_word, hi::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(bagg.labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bagg.labels, []), coalesce(hagg.labels, [])))), ','), '') AS labels,
       round(coalesce(score, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS score
FROM d LEFT JOIN bagg USING (rid) LEFT JOIN hagg USING (rid)
"""


def _op7() -> str:
    rules = []
    for key, verdict in urls.RULES:
        host, path = key.split("/", 1)
        rules.append(f"({_text(host)}, {_text('/' + path)}, {_text(verdict)})")
    terms = "|".join(urls.BLOCKED_TERMS.split())
    return rf"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES {", ".join(rules)}) AS v(h, q, verdict)),
m AS (SELECT rid, arg_max(h || q, (len(h || q), len(h))) AS rule, arg_max(verdict, (len(h || q), len(h))) AS verdict
      FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY rid)
SELECT page_id, host, path, rule,
       CASE WHEN m.rid IS NOT NULL THEN m.verdict WHEN bad THEN 'block' ELSE 'allow' END AS verdict,
       (m.rid IS NULL AND bad) AS listed
FROM (SELECT *, starts_with(path, '/') AND regexp_matches(host, '(^|[.-])({terms})([.-]|$)') AS bad FROM p) p
LEFT JOIN m USING (rid)
"""


_P, _S, _M = (_text(x) for x in (infill.PREFIX, infill.SUFFIX, infill.MIDDLE))
_JOINED = "array_to_string(list_slice(w, {}, {}), '')"

OP11 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, w, len(w)::BIGINT AS n,
             [('0x' || substr(x, 8 * i + 1, 8))::BIGINT for i in [0, 1, 2, 3]] AS h FROM d),
k AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
             CASE WHEN t = '' OR contains(t, {_P}) OR contains(t, {_S}) OR contains(t, {_M}) OR h[3] % 100 >= {infill.PLAIN_FROM}
                  THEN 'plain' WHEN h[4] % 100 < {infill.SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT doc_id, t, n, form, {_JOINED.format("1", "lo")} AS a, {_JOINED.format("lo + 1", "hi")} AS b,
             {_JOINED.format("hi + 1", "n")} AS c FROM k)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(a)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(b)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {_P} || a || {_S} || c || {_M} || b
              ELSE {_S} || c || {_P} || a || {_M} || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""

OP12 = """
WITH r AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings
           WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
v AS (SELECT rid, vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS e FROM r),
s AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
      FROM v AS q JOIN v ON q.rid <> v.rid WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS place FROM s)
SELECT query_id, place::INTEGER AS rank, vec_id, score FROM t WHERE place <= 5
"""

SQL = {"op1_mix": OP1, "op5_licenses": _op5(), "op7_urls": _op7(), "op11_infill": OP11, "op12_topk": OP12}
