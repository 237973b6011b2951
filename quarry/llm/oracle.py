"""DuckDB SQL of the contract queries that SQL can express on whole tables in reasonable time: 1, 2, 5, 8, 9, 11 and 12.

Models (3, 6, 10), digests (7) and encodings (4, 13) aren't; tests hold them against held-out labels, brute force and the library.
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SYMBOLS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BLANKS = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{SYMBOLS}'), []) AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({LOWER}, '{SYMBOLS}') AS ws FROM benchmark),
w AS (SELECT item, least(len(ws), 10) AS l, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') AS s FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS i FROM b WHERE len(ws) > 0)),
k AS (SELECT DISTINCT l FROM w),
p AS (SELECT doc_id, l, i, array_to_string(ws[i : i + l - 1], ' ') AS s FROM (SELECT doc_id, ws, l, unnest(generate_series(1, len(ws) - l + 1)) AS i FROM d, k WHERE len(ws) >= l)),
h AS (SELECT DISTINCT doc_id, i, p.l, item FROM p JOIN w ON p.l = w.l AND p.s = w.s),
n AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + l - 1)) AS place FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP2 = rf"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
p AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + 400)) AS h FROM (SELECT doc_id, b, unnest(generate_series(0, n - 400)) AS i FROM d WHERE n >= 400)),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM g GROUP BY doc_id, k),
e AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM s),
t AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(hex(array_slice(b, before + 1, a)), '' ORDER BY a) AS head, max(z) AS tail FROM e JOIN d USING (doc_id) GROUP BY doc_id),
o AS (SELECT doc_id, regexp_extract_all({LOWER}, '{BLANKS}') AS ws FROM documents),
q AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 50], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 50)) AS i FROM o WHERE len(ws) > 50)),
v AS (SELECT doc_id, i FROM q WHERE h IN (SELECT h FROM q GROUP BY h HAVING count(*) > 1)),
w AS (SELECT doc_id, sum(fresh) AS n_passage_words FROM (SELECT doc_id, least(51, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 51)) AS fresh FROM v) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(CASE WHEN tail IS NULL THEN b ELSE unhex(head || hex(array_slice(b, tail + 1, n))) END) AS kept_sha256, coalesce(n_passage_words, 0)::BIGINT AS n_passage_words FROM d LEFT JOIN t USING (doc_id) LEFT JOIN w USING (doc_id)"""

OP5 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{BLANKS}')), 0)::BIGINT AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')) AS rank FROM documents),
n AS (SELECT source, source_size, [1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1)),
c AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / w AS ratio FROM n),
l AS (SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level FROM c WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT level AS share FROM l WHERE ratio >= level ORDER BY ratio, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN ratio < share THEN cap ELSE w * share END AS target, (sum(source_size) OVER ())::DOUBLE AS total, count(*) OVER () AS m FROM l, h),
z AS (SELECT *, greatest(1, ceil(total / (16 * 65536)))::BIGINT AS block FROM t),
y AS (SELECT *, round(total / (block * 16))::BIGINT AS n, CASE WHEN total > 0 THEN target / total ELSE 0 END AS part FROM z),
x AS (SELECT *, CASE WHEN target > 0 THEN greatest(0, floor(part * (n - m::DOUBLE / 2) - 0.5))::BIGINT ELSE 0 END AS least, CASE WHEN target > 0 THEN ceil(part * (n + m::DOUBLE / 2) + 0.5)::BIGINT ELSE 0 END AS most FROM y),
v AS (SELECT source, target, n, sum(least) OVER () AS given, unnest(generate_series(least, most - 1)) AS k FROM x WHERE most > least),
o AS (SELECT n - sum(least) AS seats FROM x GROUP BY n),
u AS (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST, k) AS seat FROM v),
q AS (SELECT source, count(*) AS won FROM u, o WHERE seat <= seats GROUP BY 1),
f AS (SELECT x.source, source_size, target, block, least((least + coalesce(won, 0)) * block * 16, source_size * 3)::BIGINT AS take FROM x LEFT JOIN q ON x.source IS NOT DISTINCT FROM q.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS epochs FROM f),
r AS (SELECT d.*, source_size, target, block, epochs, take - epochs * source_size AS rest, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY rank, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
g AS (SELECT doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, rest - start)))::BIGINT AS taken, start::BIGINT AS first_token, (start // block)::BIGINT AS block FROM r)
SELECT doc_id, size, source_size, target, taken, first_token, CASE WHEN taken > 0 THEN block END AS first_block, CASE WHEN taken > 0 THEN ((block + ('0x' || substr(md5('mix-1/' || coalesce(source, 'null') || '/' || (block // 16)::VARCHAR), 1, 8))::BIGINT) % 16)::INT END AS first_shard FROM g"""

MARKS = r"\[/ROLE\]|<</SYS>>|<<SYS>>|\[/INST\]|\[INST\]|\[ROLE\]|</s>|<s>"
OP8 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
m AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\')) + 2 * len(regexp_extract_all(text, '{MARKS}')) + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15 ELSE 17 + length(role) END AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars FROM m GROUP BY conv_id"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({LOWER}, '{BLANKS}'), []) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 2, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM i JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS least FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(least, doc_id)) AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN k ON doc_id = a"""

TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_P = "(1 + 1000000000::HUGEINT * (coalesce({n}, 0) + 2) // ({all} + 2 * v))"
OP11 = rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '{TERMS}') AS ws FROM documents),
o AS MATERIALIZED (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS q FROM o GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
l AS (SELECT lang, count(*) AS v, sum(q) AS whole FROM k GROUP BY 1),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY 1, 2, 3),
g AS MATERIALIZED (SELECT lang, source, coalesce(any_value(total), 0) AS total, coalesce(any_value(v), 0) AS v, coalesce(any_value(whole), 0) AS whole FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY 1, 2) USING (lang, source) LEFT JOIN l USING (lang) GROUP BY 1, 2),
p AS MATERIALIZED (SELECT lang, source, term, n, {_P.format(n="n", all="total")} AS p, {_P.format(n="q", all="whole")} AS q FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
t AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM t UNION ALL SELECT * FROM u))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= 10"""

_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(octet_length(encode({0}))::VARCHAR || ':' || {0}, '-')"
OP12 = rf"""
WITH RECURSIVE k AS (SELECT i, 0 AS step, i AS c FROM range(256) x(i) UNION ALL SELECT i, step + 1, xor(c >> 1, (c & 1) * 3988292384) FROM k WHERE step < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM k WHERE step = 8),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS crc FROM documents, tab),
d AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_FIELDS} AS head, text, CASE WHEN crc % 3 = 0 THEN {LOWER} ELSE text END AS told FROM c),
e AS MATERIALIZED (SELECT g, doc_id, sha256(head || {_TEXT.format("text")}) AS leaf, sha256(head || {_TEXT.format("told")}) AS claimed FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY g) AS total FROM e),
n AS (SELECT g, 0 AS level, place, leaf AS h, total FROM p UNION ALL SELECT g, level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (total + 7) // 8 FROM n WHERE total > 1 GROUP BY g, level, place // 8, total),
s AS MATERIALIZED (SELECT g, level, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place, count(*) OVER () AS total FROM n WHERE total = 1),
u AS (SELECT 0 AS level, place, subroot AS h, total FROM s UNION ALL SELECT level + 1, place // 8, sha256(string_agg(h, '' ORDER BY place)), (total + 7) // 8 FROM u WHERE total > 1 GROUP BY level, place // 8, total),
a AS MATERIALIZED (SELECT g, level, place, h, total FROM n WHERE total > 1 UNION ALL SELECT s.g, s.level + u.level, u.place, u.h, u.total FROM s, u WHERE u.total > 1),
w AS MATERIALIZED (SELECT g, level, place // 8 AS run, list(h ORDER BY place) AS hs FROM a GROUP BY ALL),
f AS (SELECT p.g, p.place AS leaf_place, p.place, s.place AS top_place, s.level AS turn, 0 AS level, claimed AS h, '' AS proof FROM p JOIN s USING (g)
 UNION ALL SELECT f.g, leaf_place, f.at // 8, top_place, turn, f.level + 1, sha256(array_to_string(hs[1 : f.at % 8], '') || f.h || array_to_string(hs[f.at % 8 + 2 :], '')), proof || array_to_string(hs[1 : f.at % 8], '') || array_to_string(hs[f.at % 8 + 2 :], '')
 FROM (SELECT *, CASE WHEN level = turn THEN top_place ELSE place END AS at FROM f) f JOIN w ON w.g = f.g AND w.level = f.level AND w.run = f.at // 8),
t AS (SELECT g, leaf_place, arg_max(h, level) AS folded_root, sha256(arg_max(proof, level)) AS proof_sha256 FROM f GROUP BY 1, 2)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE total = 1) AS root, proof_sha256, folded_root, folded_root = (SELECT h FROM u WHERE total = 1) AS verified FROM p JOIN t ON p.g = t.g AND p.place = t.leaf_place JOIN s ON p.g = s.g"""

ORACLE: dict[str, str] = {"op1_decontamination": OP1, "op2_suffix_dedup": OP2, "op5_mixing": OP5, "op8_chat": OP8, "op9_near_dedup": OP9, "op11_divergence": OP11, "op12_merkle": OP12}
