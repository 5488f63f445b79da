"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lower(column: str) -> str:
    return f"translate({column}, '{_UPPER}', '{_LOWER}')"


_BENCH_WORDS = "list_filter(regexp_split_to_array({}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP8 = f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS.format(_lower("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS.format(_lower("coalesce(text, '')"))} AS w FROM benchmark),
g AS (SELECT item_id, unnest([w[i:i + 12] FOR i IN range(1, greatest(1, len(w) - 12) + 1)]) AS gram FROM b WHERE len(w) > 0),
k AS (SELECT DISTINCT len(gram) AS k FROM g),
p AS (SELECT d.doc_id, k.k, unnest(range(1, len(w) - k.k + 2)) AS i FROM d, k WHERE len(w) >= k.k),
h AS (SELECT DISTINCT p.doc_id, p.i, p.k, g.item_id FROM p JOIN d USING (doc_id) JOIN g ON g.gram = d.w[p.i:p.i + p.k - 1]),
c AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS x FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_hit, coalesce(t.n, 0)::BIGINT AS n_items,
       sha256(coalesce(t.s, '')) AS items_sha256, coalesce(c.n, 0) > 0 AND 20 * coalesce(c.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""


_ESCAPED = r"regexp_replace(regexp_replace({}, '(<)(\\*)(<SYS>>|</SYS>>|\|endoftext\|>|\|im_start\|>|\|im_end\|>|/s>|s>)', '\1\\\2\3', 'g'), '(\[)(\\*)(INST\]|/INST\])', '\1\\\2\3', 'g')"
_ROLE = "replace(replace(" + _ESCAPED.format("role") + r", '\', '\\'), chr(10), '\n')"

OP1 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(9 + length({_ROLE}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN [w[i:i + 3] FOR i IN range(1, len(w) - 2)] WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM d JOIN m USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP3 = f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(rule, rule_host, rule_path, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
                                           ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN r
      ON (u.host = rule_host OR ends_with(u.host, '.' || rule_host)) AND starts_with(u.path, rule_path) GROUP BY page_id)
SELECT u.page_id, u.host, u.path, f.rule,
       CASE WHEN f.rule IS NOT NULL THEN f.verdict
            WHEN regexp_matches(lower(u.url), '(^|[^a-z0-9])(adult|betting|casino|escort|porn|sex|torrent|warez|xxx)([^a-z0-9]|$)') THEN 'block'
            WHEN regexp_matches(u.url, '[?&]utm_source=feed([&#]|$)') THEN 'block' ELSE 'allow' END AS verdict
FROM u LEFT JOIN f USING (page_id)
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

_LETTERS = "[A-Za-z\\u00C0-\\u00FF]+".encode().decode("unicode_escape")

OP11 = f"""
WITH RECURSIVE t(i, j, v) AS (SELECT i, 0, i::UINTEGER FROM range(0, 256) r(i) UNION ALL
  SELECT i, j + 1, (CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END)::UINTEGER FROM t WHERE j < 8),
crc AS (SELECT list(v ORDER BY i) AS c FROM t WHERE j = 8),
r AS (SELECT doc_id, {_lower("unnest(regexp_extract_all(text, '" + _LETTERS + "'))")} AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, w, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || w)) AS x FROM r WHERE length(w) >= 6 GROUP BY ALL),
k AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UINTEGER)),
  lambda h, b: xor(h >> 8, c[(xor(h, b) & 255) + 1])), 4294967295::UINTEGER) AS h FROM g, crc),
m AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM k),
v AS (SELECT word, sum(n)::BIGINT AS n FROM m WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS cut FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
e AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.cut = v.word),
f AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM e GROUP BY a),
o AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * v.n THEN form END AS form, CASE WHEN form_n >= 5 * v.n THEN form_n END AS form_n FROM v LEFT JOIN f USING (word)),
p AS (SELECT word, word AS root FROM o UNION ALL SELECT p.word, o.form FROM p JOIN o ON o.word = p.root WHERE o.form IS NOT NULL),
z AS (SELECT p.word, p.root FROM p JOIN o ON o.word = p.root WHERE o.form IS NULL)
SELECT o.word, o.form, z.root, o.n, o.n_near::BIGINT AS n_near, o.form_n FROM o JOIN z USING (word)
"""

_BARE = "regexp_replace(l, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"

OP13 = f"""
WITH s AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, r, unnest(ls) AS l, unnest(range(0, len(ls))) AS i FROM s),
k AS (SELECT doc_id, r, i, l, {_lower(_BARE)} AS k FROM e),
c AS (SELECT k, max(doc_id) AS last FROM k WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, r, i, l, c.last IS NOT NULL AND c.last <> k.doc_id AS gone FROM k LEFT JOIN c USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id, r
"""

ORACLES = {
    "op1_chat_formatting": OP1,
    "op2_minhash_neardup": OP2,
    "op3_url_filters": OP3,
    "op5_exact_topk": OP5,
    "op8_benchmark_decontamination": OP8,
    "op11_spelling_variants": OP11,
    "op13_line_dedup": OP13,
}
