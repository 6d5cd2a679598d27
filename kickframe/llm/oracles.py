"""The numbered queries in DuckDB's SQL, as far as SQL can say them on whole tables."""

from __future__ import annotations

_SPACE = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEYS = "|".join([*map(_either, ("password", "passwd", "secret", "token")), _either("api") + "_?" + _either("key")])
_PATTERNS = (
    ("assign", f"({_KEYS})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
)


def _found(order: int, kind: str, pattern: str, group: int, least: int) -> str:
    """Rows of one kind: the k-th match begins after the first k gaps and the matches before it."""
    return f"""SELECT doc_id, {order} AS o, '{kind}' AS kind,
list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: length(x))), 0) AS a,
length(hits[k]) AS n, length(parts[k]) >= {least} AS ok
FROM (SELECT doc_id, gaps, hits, parts, unnest(range(1, len(hits) + 1)) AS k FROM (
SELECT doc_id, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}') AS hits, regexp_extract_all(t, '{pattern}', {group}) AS parts FROM d
WHERE regexp_matches(t, '{pattern}')))"""


OP1 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(_found(o, *p) for o, p in enumerate(_PATTERNS))}),
s AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
string_agg(kind || ':' || cast(a AS BIGINT) || ':' || cast(a + n AS BIGINT), ',' ORDER BY a, o) AS spans FROM f WHERE ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s USING (doc_id)"""

#: Links by common shingles; a component is found by handing the smallest id on over links until nothing changes.
OP3 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_SPACE}') AS w FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_n FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_n >= 80 * (p.n + q.n - both_n)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x AS id, y AS reach FROM e UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.reach),
m AS (SELECT id, min(reach) AS m FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.m, w.doc_id)) AS component_id, least(w.doc_id, coalesce(m.m, w.doc_id)) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.id = w.doc_id"""

OP6 = """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, h, strlen(h) AS n, CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(h) AS payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM q"""

OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
c AS (SELECT doc_id, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SPACE}')) AS lines, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS letters FROM d),
k AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM c)),
h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM k) WHERE times > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM h, range(8) x(j) GROUP BY doc_id),
a AS (SELECT doc_id, n_words, word_chars, n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, letters, coalesce(n_repeat, 0) AS n_repeat_words FROM c LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 40 * n_words OR 2 * n_dup_lines > n_lines OR 10 * letters < 6 * n_words) AS kept FROM b"""

_BENCH_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = f"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BENCH_WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_BENCH_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
t AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
p AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b))),
h AS (SELECT doc_id, item_id, i, m FROM p JOIN t USING (m, g)),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS j FROM h) GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN s USING (doc_id)"""

#: crc32 byte by byte over its table of 256 values; near words by joining cut words, all pairs made.
OP11 = rf"""WITH RECURSIVE bits AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER.format('text')}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) x WHERE length(run) >= 7 GROUP BY ALL),
sums AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || substr(hex(encode(s)), 2 * i - 1, 2))::BIGINT)),
 lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM runs) x, crc),
words AS (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS w, n FROM sums) x GROUP BY w HAVING length(w) >= 7 AND sum(n) >= 2),
cut AS (SELECT w, n, i, left(w, i - 1) AS a, substr(w, i + 1) AS b FROM (SELECT w, n, unnest(range(1, length(w) + 1)) AS i FROM words) x),
near AS (SELECT p.w, q.w AS v, q.n AS vn FROM cut p JOIN cut q ON p.a = q.a AND p.b = q.b AND p.i = q.i AND p.w <> q.w
 UNION SELECT p.w, q.w, q.n FROM cut p JOIN words q ON q.w = p.a || p.b UNION SELECT q.w, p.w, p.n FROM cut p JOIN words q ON q.w = p.a || p.b),
best AS (SELECT w, count(*) AS n_near, arg_min(v, (-vn, v)) AS v, max(vn) AS vn FROM near GROUP BY w),
forms AS (SELECT words.w, n, coalesce(n_near, 0) AS n_near, CASE WHEN vn >= 10 * n THEN v END AS form, CASE WHEN vn >= 10 * n THEN vn END AS form_n FROM words LEFT JOIN best USING (w)),
walk AS (SELECT w, w AS here, 0 AS k FROM forms UNION ALL SELECT walk.w, form, k + 1 FROM walk JOIN forms ON forms.w = walk.here WHERE form IS NOT NULL)
SELECT forms.w AS word, form, root, n, n_near, form_n FROM forms JOIN (SELECT w, arg_max(here, k) AS root FROM walk GROUP BY w) r USING (w)"""


def _assigned(k: int) -> str:
    return f"""a{k} AS (SELECT r, p, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d FROM (
SELECT r, x.p, e, sum((v - c) * (v - c))::BIGINT AS d FROM x JOIN b{k} b ON x.p = b.p AND x.i = b.i GROUP BY r, x.p, e) t GROUP BY r, p)"""


def _moved(k: int) -> str:
    return f"""b{k + 1} AS (SELECT b.p, b.e, b.i, coalesce(m, c) AS c FROM b{k} b LEFT JOIN (
SELECT x.p, e, i, floor(sum(v) / count(*))::BIGINT AS m FROM x JOIN a{k} a ON a.r = x.r AND a.p = x.p GROUP BY ALL) n ON n.p = b.p AND n.e = b.e AND n.i = b.i)"""


#: Every assignment is a full scan.
OP12 = f"""WITH ids AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS (SELECT r, (k - 1) // (n // 4) AS p, (k - 1) % (n // 4) AS i, floor(1024 * embedding[k]::DOUBLE)::BIGINT AS v FROM (SELECT r, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS k FROM ids) t),
b0 AS (SELECT p, r - 1 AS e, i, v AS c FROM x WHERE r <= 256),
{", ".join(f"{_assigned(k)}, {_moved(k)}" for k in range(4))}, {_assigned(4)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, sha AS codebooks_sha256 FROM
(SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a4 JOIN ids USING (r) GROUP BY r, vec_id, label) q,
(SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS sha FROM b4) s"""

def _level(t: int) -> str:
    """The level of the template tree that begins with t{t} and ends with t{t + 1}."""
    return f"""act{t} AS (SELECT *, segs[{t + 1}] AS seg FROM t{t} WHERE len(segs) > {t}),
nod{t} AS (SELECT host, node, sum(n) AS n, sum(k) AS k, sum(b) AS b, max(rate) AS rate FROM act{t} GROUP BY ALL),
lit{t} AS (SELECT c.* FROM (SELECT host, node, seg, sum(n) AS n, sum(k) AS k, sum(b) AS b FROM act{t} GROUP BY ALL) c JOIN nod{t} p USING (host, node) WHERE c.n >= 2 AND c.n * 20 >= p.n),
sib{t} AS (SELECT lit{t}.*, rate FROM lit{t} JOIN nod{t} USING (host, node)
 UNION ALL SELECT host, node, '*', p.n - coalesce(l.n, 0), p.k - coalesce(l.k, 0), p.b - coalesce(l.b, 0), rate FROM nod{t} p LEFT JOIN (SELECT host, node, sum(n) AS n, sum(k) AS k, sum(b) AS b FROM lit{t} GROUP BY ALL) l USING (host, node)),
lag{t} AS (SELECT *, k >= 5 AS judged, lag(b::DOUBLE) OVER w AS b1, lag(k::DOUBLE) OVER w AS k1 FROM sib{t} WINDOW w AS (PARTITION BY host, node, k >= 5 ORDER BY b / greatest(k, 1), seg)),
cut{t} AS (SELECT *, CASE WHEN NOT judged OR b1 IS NULL OR (b1 * k - b * k1) * (b1 * k - b * k1) * (k1 + k) > 3.84::DOUBLE * k1 * k * (b1 + b) * (k1 + k - b1 - b) THEN 1 ELSE 0 END AS differs FROM lag{t}),
grp{t} AS (SELECT *, sum(differs) OVER (PARTITION BY host, node, judged ORDER BY b / greatest(k, 1), seg) AS g FROM cut{t}),
lab{t} AS (SELECT host, node, judged, g, CASE WHEN count(*) = 1 THEN min(seg) ELSE '(' || string_agg(seg, '|' ORDER BY seg) || ')' END AS label, (sum(b) + 10::DOUBLE * min(rate)) / (sum(k) + 10::DOUBLE) AS rate FROM grp{t} GROUP BY ALL),
mem{t} AS (SELECT host, node, seg AS member, label, lab{t}.rate FROM grp{t} JOIN lab{t} USING (host, node, judged, g)),
t{t + 1} AS (SELECT a.host, path, n, k, b, segs, a.node || '/' || coalesce(l.label, w.label) AS node, coalesce(l.rate, w.rate) AS rate FROM act{t} a
 LEFT JOIN mem{t} l ON l.host = a.host AND l.node = a.node AND l.member = a.seg AND l.member <> '*' JOIN mem{t} w ON w.host = a.host AND w.node = a.node AND w.member = '*')"""


_ADDRESS = f"""{_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path"""
OP13 = f"""WITH u AS (SELECT page_id, {_ADDRESS} FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages) x),
lb AS (SELECT doc_id, max(greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1))) AS b FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
seen AS (SELECT host, path, b FROM (SELECT *, try_cast(regexp_extract(path, '/([0-9]+)(\\.html)?/?$', 1) AS BIGINT) AS doc_id FROM u) x JOIN lb USING (doc_id)),
p AS (SELECT host, path, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k, sum(b)::BIGINT AS b FROM (SELECT host, path, 1 AS n, 0 AS k, 0 AS b FROM u UNION ALL SELECT host, path, 0, 1, b FROM seen) x GROUP BY ALL),
prior AS (SELECT CASE WHEN sum(k) > 0 THEN sum(b) / sum(k) ELSE 0::DOUBLE END AS rate FROM p),
h AS (SELECT host, (sum(b) + 10::DOUBLE * min(prior.rate)) / (sum(k) + 10::DOUBLE) AS rate FROM p, prior GROUP BY host),
t0 AS (SELECT p.*, list_filter(string_split(replace(replace(replace(replace(path, '*', '%2A'), '|', '%7C'), '(', '%28'), ')', '%29'), '/'), lambda s: s <> '') AS segs, '' AS node, rate FROM p JOIN h USING (host)),
{", ".join(map(_level, range(4)))},
f AS ({" UNION ALL ".join(f"SELECT host, path, node AS template, rate FROM t{t} WHERE len(segs) = {t}" for t in range(5))} UNION ALL SELECT host, path, node || '/**', rate FROM t4 WHERE len(segs) > 4)
SELECT page_id, u.host, u.path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') OR rule IS NULL AND rate >= 0.5 THEN 'block' ELSE 'allow' END AS verdict, template FROM (SELECT *, CASE
WHEN ('.' || host) LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/' WHEN ('.' || host) LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
WHEN ('.' || host) LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/' WHEN ('.' || host) LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule FROM u) u JOIN f USING (host, path)"""

ORACLE_SQL = {"op1_secret_scan": OP1, "op3_minhash_dedup": OP3, "op6_warc": OP6, "op7_quality_rules": OP7, "op8_decontaminate": OP8, "op11_spelling_variants": OP11, "op12_vector_codes": OP12, "op13_url_filters": OP13}
