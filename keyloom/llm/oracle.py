"""SQL for the operators that SQL can express, over whole tables."""

from __future__ import annotations

from keyloom.llm import near_dup, sentence_spans, url_filter

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op1() -> str:
    after = "regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1)"
    fits = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}={said}'" for said, h, p in sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))
    )
    two = ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES)
    last = lambda n: f"list_aggregate(list_slice(string_split(name, '.'), -{n}, -1), 'string_agg', '.')"

    def strength(name: str, table: str, m: str) -> str:
        return (
            f"{name} AS (SELECT CASE WHEN coalesce(base, 0) = 0 OR coalesce(more, 0) = 0 THEN {url_filter.DEFAULT_STRENGTH} WHEN (seen - base) / more <= 1 / ({url_filter.MAX_STRENGTH} + 1) THEN {url_filter.MAX_STRENGTH} "
            f"ELSE greatest(1e-3, 1 / ((seen - base) / more) - 1) END AS s FROM (SELECT sum(n * (good / n - {m}) * (good / n - {m})) AS seen, sum({m} * (1 - {m})) AS base, sum({m} * (1 - {m}) * (n - 1)) AS more FROM {table} WHERE n > 0))"
        )

    return f"""WITH u AS (SELECT page_id, {LOWER.format(f"regexp_extract({after}, '^([^/?#]*)', 1)")} AS host, regexp_extract({after}, '(?s)^[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT page_id, host, path, CASE {fits} END AS fit, TRY_CAST(nullif(regexp_extract(path, '^/[^/]+/([0-9]{{1,18}})(?:/|\\.html)?$', 1), '') AS BIGINT) AS url_id FROM u),
o AS (SELECT doc_id, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS good, count(*) AS n FROM labels WHERE doc_id IS NOT NULL AND (quality = 1 AND toxic = 0) IS NOT NULL GROUP BY 1),
h AS (SELECT host, CAST(coalesce(sum(good), 0) AS DOUBLE) AS good, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n FROM r LEFT JOIN o ON r.url_id = o.doc_id GROUP BY 1),
hn AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '\\.+$', '') AS name FROM h),
hd AS (SELECT host, good, n, CASE WHEN regexp_matches(name, '{url_filter.NUMERIC}') THEN name WHEN {last(2)} IN ({two}) THEN {last(3)} ELSE {last(2)} END AS domain, CASE WHEN regexp_matches(name, '{url_filter.NUMERIC}') THEN name WHEN {last(2)} IN ({two}) THEN {last(2)} ELSE {last(1)} END AS suffix FROM hn),
d AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM hd GROUP BY 1, 2), s AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY 1),
root AS (SELECT (sum(good) + 1) / (sum(n) + 2) AS m0 FROM s), sr AS (SELECT s.*, m0 FROM s, root), {strength("s1", "sr", "m0")},
sm AS (SELECT suffix, (s * m0 + good) / (s + n) AS m1 FROM sr, s1), ds AS (SELECT d.*, m1 FROM d JOIN sm USING (suffix)), {strength("s2", "ds", "m1")},
dm AS (SELECT domain, (s * m1 + good) / (s + n) AS m2 FROM ds, s2), hs AS (SELECT hd.host, good, n, m2 FROM hd JOIN dm USING (domain)), {strength("s3", "hs", "m2")},
j AS (SELECT host, n, (s * m2 + good) / (s + n) AS m, s + n AS size FROM hs, s3)
SELECT page_id, r.host, path, split_part(fit, '=', 1) AS rule, coalesce(nullif(split_part(fit, '=', 2), ''), CASE WHEN m - {url_filter.Z} * sqrt(m * (1 - m) / (size + 1)) < {url_filter.LEAST_GOOD} THEN 'block' ELSE 'allow' END) AS verdict,
CAST(n AS BIGINT) AS host_outcomes FROM r JOIN j ON r.host = j.host"""


SPACE_WORD = "[^\\x20\\x09-\\x0D]+"

OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '{SPACE_WORD}') AS w FROM documents),
g AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {near_dup.SHINGLE} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {near_dup.SHINGLE - 2}), lambda k: array_to_string(list_slice(w, k, k + {near_dup.SHINGLE - 1}), ' ')) END) AS s FROM w),
x AS (SELECT doc_id, unnest(s) AS s FROM g), n AS (SELECT doc_id, len(s) AS n FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= {near_dup.LEAST} * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l), t AS (SELECT doc_id AS v, doc_id AS c FROM n UNION SELECT e.b, t.c FROM t JOIN e ON t.v = e.a WHERE t.c < e.b)
SELECT n.doc_id, n.n AS n_shingles, min(t.c) AS component_id, n.doc_id = min(t.c) AS kept FROM n JOIN t ON t.v = n.doc_id GROUP BY n.doc_id, n.n"""

ITEM_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

OP8 = f"""WITH iw AS (SELECT item_id, regexp_extract_all({LOWER.format("text")}, '{ITEM_WORD}') AS w FROM benchmark), i AS (SELECT item_id, w, least(8, len(w)) AS n FROM iw WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(list_slice(w, k, k + n - 1), ' '))) AS x FROM i),
d AS (SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '{ITEM_WORD}') AS w FROM documents), sizes AS (SELECT DISTINCT n FROM i),
dw AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: {{'k': k, 'x': array_to_string(list_slice(w, k, k + n - 1), ' ')}})) AS q FROM d, sizes WHERE len(w) >= n),
m AS (SELECT doc_id, dw.n, q.k AS k, item_id FROM dw JOIN v ON v.n = dw.n AND v.x = q.x),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM m)) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""

OP10 = f"""WITH p0 AS (SELECT doc_id, unnest(string_split(replace(regexp_replace(coalesce(text, ''), '([.!?]+)([\\x20\\x09-\\x0D])', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(10) || chr(1)), chr(1))) AS piece,
  generate_subscripts(string_split(replace(regexp_replace(coalesce(text, ''), '([.!?]+)([\\x20\\x09-\\x0D])', '\\1' || chr(1) || '\\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)), 1) AS i0 FROM documents),
p1 AS (SELECT doc_id, i0, string_split(CASE WHEN len(regexp_extract_all(piece, '{SPACE_WORD}')) > {sentence_spans.LONG} THEN regexp_replace(piece, '([^\\x20\\x09-\\x0D]{{{sentence_spans.LONG_WORD},}})([\\x20\\x09-\\x0D])', '\\1' || chr(1) || '\\2', 'g') ELSE piece END, chr(1)) AS parts FROM p0),
p2 AS (SELECT doc_id, i0, unnest(parts) AS piece, generate_subscripts(parts, 1) AS j0 FROM p1),
p3 AS (SELECT doc_id, i0, j0, string_split(CASE WHEN len(regexp_extract_all(piece, '{SPACE_WORD}')) > {sentence_spans.LONG} THEN regexp_replace(regexp_replace(piece, '((?:{SPACE_WORD}[\\x20\\x09-\\x0D]+){{{sentence_spans.WORDS - 1}}}{SPACE_WORD})([\\x20\\x09-\\x0D])', '\\1' || chr(1) || '\\2', 'g'), chr(1) || '([\\x20\\x09-\\x0D]*)$', '\\1') ELSE piece END, chr(1)) AS parts FROM p2),
p4 AS (SELECT doc_id, i0, j0, unnest(parts) AS piece, generate_subscripts(parts, 1) AS k0 FROM p3), p AS (SELECT doc_id, piece, row_number() OVER (PARTITION BY doc_id ORDER BY i0, j0, k0) AS i FROM p4),
q AS (SELECT doc_id, i, piece, regexp_extract_all({LOWER.format("piece")}, '{SPACE_WORD}') AS w FROM p),
s AS (SELECT doc_id, i, array_to_string(w, ' ') AS x, len(w) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM q WHERE len(w) > 0),
c AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY k) AS upto FROM s),
r AS (SELECT a.doc_id, a.k, min(b.k) AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k + {sentence_spans.SENTENCES - 1} AND a.k + {sentence_spans.WORDS - 1} AND b.upto - a.upto + a.n >= {sentence_spans.WORDS} GROUP BY 1, 2),
t AS (SELECT r.doc_id, r.k, r.j, string_agg(s.x, chr(1) ORDER BY s.k) AS x FROM r JOIN s ON s.doc_id = r.doc_id AND s.k BETWEEN r.k AND r.j GROUP BY 1, 2, 3),
o AS (SELECT doc_id, k, j, row_number() OVER (PARTITION BY x ORDER BY doc_id, k) AS nth FROM t),
gone AS (SELECT DISTINCT s.doc_id, s.i FROM o JOIN s ON s.doc_id = o.doc_id AND s.k BETWEEN o.k AND o.j WHERE nth > 1)
SELECT q.doc_id, count(*) FILTER (len(w) > 0) AS n_sentences, count(gone.i) AS n_removed, CASE WHEN any_value(d.text) IS NOT NULL THEN coalesce(string_agg(piece, '' ORDER BY q.i) FILTER (gone.i IS NULL), '') END AS text
FROM q JOIN documents d ON d.doc_id = q.doc_id LEFT JOIN gone ON gone.doc_id = q.doc_id AND gone.i = q.i GROUP BY q.doc_id"""

ORACLE = {"op1_url_reputation": _op1(), "op3_near_duplicates": OP3, "op8_decontaminate": OP8, "op10_sentence_spans": OP10}
