"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .licences import TEMPLATES
from .rules import STOP_WORDS, SYMBOLS, THRESHOLDS

_STOPS = ", ".join(f"'{w}'" for w in sorted({w for x in STOP_WORDS.values() for w in x.split()}))
_BOUNDS = " AND ".join([f"{n} >= {a}" for n, a, _ in THRESHOLDS if a is not None] + [f"{n} <= {b}" for n, _, b in THRESHOLDS if b is not None])

OP8 = rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
k AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM k) WHERE n > 1),
p AS (SELECT r, count(DISTINCT q) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS q FROM d) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             len(ls) AS n_lines, len(list_filter(ws, lambda x: x IN ({_STOPS}))) AS stops
      FROM w LEFT JOIN p USING (r)),
v AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbols_per_word,
             coalesce(stops / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_BOUNDS} AS kept FROM v
"""

OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|NEXT\])', '\1\\\2\3', 'g')) AS n,
             length(regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|NEXT\])', '\1\\\2\3', 'g')) AS nr,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
             lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(n + CASE WHEN before = role THEN 6 ELSE 6 + 7 + 4 + nr END))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

#: Links come from all pairs of sets that share a shingle and whose sizes allow it.
OP6 = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.n + b.n - c)),
r AS (SELECT doc_id AS x, doc_id AS root FROM t UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, root AS component_id, t.doc_id = root AS kept
FROM t LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(root) AS root FROM r GROUP BY x) ON x = t.doc_id
"""

OP10 = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM t)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT q) AS qs FROM (SELECT doc_id, unnest(range(i, i + 20)) AS q FROM f) GROUP BY doc_id),
words AS (SELECT t.doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM t),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.q) AS text, count(*) AS n
         FROM words LEFT JOIN (SELECT doc_id, unnest(qs) AS q FROM gone) g ON g.doc_id = words.doc_id AND g.q = words.q WHERE g.q IS NULL GROUP BY words.doc_id)
SELECT t.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""


OP11 = r"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.id AS anchor_id, b.id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.r <> b.r WHERE a.id % 50 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.k ORDER BY s.score DESC, s.id) AS rank
      FROM p JOIN s USING (a) WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


#: CRC-32 by its table, which is made from the polynomial; near words by what is left when one code point goes.
OP12 = r"""
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c
               FROM (SELECT unnest(range(256)) AS i))),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{5,}')) AS run FROM documents),
d AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS h FROM r GROUP BY ALL),
b AS (SELECT run, n, list_transform(range(1, length(h) // 2 + 1), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i - 1]) - 1) + instr('0123456789ABCDEF', h[2 * i]) - 1) AS bytes FROM d),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS h FROM b, crc),
w AS (SELECT * FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY ALL)
      WHERE length(word) >= 5 AND n >= 3),
x AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word AS a, b.word AS b, b.n FROM x a JOIN x b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
      UNION SELECT w.word, x.word, x.n FROM w JOIN x ON x.cut = w.word UNION SELECT x.word, w.word, w.n FROM w JOIN x ON x.cut = w.word),
f AS (SELECT a AS word, count(*) AS n_near, max(n) AS most, arg_min(b, (-n, b)) AS best FROM p GROUP BY a),
o AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN most >= 2 * w.n THEN best END AS form, CASE WHEN most >= 2 * w.n THEN most END::BIGINT AS form_n FROM w LEFT JOIN f USING (word)),
c AS (SELECT word, word AS place, 0 AS k FROM o UNION ALL SELECT c.word, o.form, k + 1 FROM c JOIN o ON o.word = c.place WHERE o.form IS NOT NULL)
SELECT o.word, form, place AS root, n, n_near, form_n FROM o JOIN (SELECT word, arg_max(place, k) AS place FROM c GROUP BY word) USING (word)
"""


_PLACES = ", ".join(f"({k}, '{t.label}', {t.base}, {len(t.words)}, {len(t.must)}, {q}, '{w.decode()}', {q in t.must})" for k, t in enumerate(TEMPLATES) for q, w in enumerate(t.words))

#: Every template at every place of its words.
OP13 = rf"""
WITH p(t, label, base, size, all_must, q, word, must) AS (VALUES {_PLACES}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM d),
m AS (SELECT r, t, label, base, size, all_must, i - q AS start, count(*) AS n FROM w JOIN p USING (word) GROUP BY ALL
      HAVING 100 * count(*) >= 80 * size AND count(*) FILTER (must) = all_must),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, max(n / size) AS score,
             list_sort(list(DISTINCT label) FILTER (base)) AS base_labels, list_sort(list(DISTINCT label)) AS labels FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN g USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_minhash_neardup": OP6, "op7_chat_formatting": OP7, "op8_quality_rules": OP8, "op10_substring_dedup": OP10, "op11_hard_negatives": OP11, "op12_spelling_variants": OP12, "op13_license_scans": OP13}
