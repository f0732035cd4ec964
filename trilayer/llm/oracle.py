"""DuckDB SQL for the registered queries of this subpackage that SQL can express."""

from __future__ import annotations

from trilayer.llm.license_join import TEMPLATES

OP1 = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
g AS (
  SELECT DISTINCT r, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS i FROM g a JOIN g b USING (s) WHERE a.r <> b.r GROUP BY a.r, b.r),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 9 * i >= 4 * (x.n + y.n)),
reach AS (
  SELECT r AS a, r AS b FROM d
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS r, min(doc_id) AS class_id FROM reach JOIN d ON d.r = b GROUP BY a),
k AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, doc_id IS NOT DISTINCT FROM class_id AS kept
FROM d JOIN c USING (r) LEFT JOIN k USING (r)
"""

OP3 = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, 3.0::DOUBLE * source_size AS most,
         row_number() OVER (ORDER BY source NULLS LAST) AS turn,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM s),
l AS (
  SELECT *, most / w AS ratio,
         sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(w) OVER (ORDER BY most / w, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest
  FROM w),
f AS (SELECT ratio, turn, left_over, w_rest FROM l WHERE ratio > left_over / w_rest ORDER BY ratio, turn LIMIT 1),
t AS (
  SELECT l.source, l.source_size,
         CASE WHEN f.turn IS NOT NULL AND (l.ratio > f.ratio OR (l.ratio = f.ratio AND l.turn >= f.turn))
              THEN least(l.most, f.left_over * l.w / f.w_rest) ELSE l.most END AS target
  FROM l LEFT JOIN f ON true),
p AS (
  SELECT d.*, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
         CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM p
"""

OP4 = r"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT * FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.r AS a, b.r AS b FROM ok a JOIN ok b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT r AS a, r AS b FROM v
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a),
c AS (SELECT a AS r, min(vec_id) AS component_id FROM reach JOIN v ON v.r = b GROUP BY a),
k AS (SELECT a AS r, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN k USING (r)
"""

OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, least(len(w), 13) AS n, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
pos AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
occ AS (
  SELECT r, i, n.n, item
  FROM pos CROSS JOIN (SELECT DISTINCT n FROM win) n
  JOIN win ON win.n = n.n AND win.g = array_to_string(w[i : i + n.n - 1], ' ')
  WHERE i + n.n - 1 <= len(w)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM occ) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM occ) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""

OP8 = r"""
WITH t AS (
  SELECT conv_id, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
c AS (
  SELECT n, string_agg(md5(md5(coalesce('=' || role, '-')) || md5(coalesce('=' || text, '-'))), '' ORDER BY pos) AS whole,
         string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10), '' ORDER BY pos) AS rendered, conv_id
  FROM t GROUP BY conv_id, n),
u AS (SELECT n, whole, min(conv_id) AS conv_id, count(*) AS n_copies, min(rendered) AS rendered FROM c GROUP BY n, whole),
inner_ AS (SELECT DISTINCT i AS n, substr(whole, 1, 32 * i) AS whole FROM (SELECT unnest(range(1, n)) AS i, whole FROM u))
SELECT conv_id, n AS n_turns, n_copies, rendered FROM u ANTI JOIN inner_ USING (n, whole)
"""


OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents),
w AS (SELECT r, doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM d),
phrase(label, p) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
template(label, t) AS (VALUES %s),
ts AS (SELECT label, list_distinct(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM template),
place AS (
  SELECT r, label, i - 1 AS word
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM w) JOIN phrase ON w[i] = p[1] AND w[i : i + len(p) - 1] = p),
block AS (SELECT r, list_distinct(regexp_extract_all(b, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS b FROM (SELECT r, unnest(string_split(t, chr(10))) AS b FROM d)),
match AS (
  SELECT r, label, c FROM (SELECT r, label, CAST(len(list_intersect(b, t)) AS DOUBLE) / len(t) AS c FROM block CROSS JOIN ts)
  WHERE c >= 0.8),
bl AS (SELECT r, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM place GROUP BY r),
al AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM place UNION ALL SELECT r, label FROM match) GROUP BY r),
sc AS (SELECT r, max(c) AS c FROM match GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS score
FROM w LEFT JOIN bl USING (r) LEFT JOIN al USING (r) LEFT JOIN sc USING (r)
""" % ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES)


OP11 = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (
  SELECT doc_id, t, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER best AS place
  FROM d WINDOW best AS (PARTITION BY t ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(t) AS text_sha256 FROM g
"""


OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents),
i AS (
  SELECT row_number() OVER () AS q, item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM benchmark),
it AS (SELECT DISTINCT q, item_id, unnest(t) AS t FROM i),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS total FROM d WHERE len(t) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(t) AS t FROM d) WHERE t IN (SELECT t FROM it) GROUP BY r, t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), s),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * len(t) * n_docs) // total) AS m FROM d, s WHERE len(t) > 0),
x AS (SELECT q, item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM it JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY q, item_id, doc_id, r),
p AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM x WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM p WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1, "op3_source_mixing": OP3, "op4_embedding_near_dedup": OP4, "op6_benchmark_decontamination": OP6, "op8_chat_formatting": OP8, "op10_license_scan": OP10, "op11_exact_dedup": OP11, "op12_lexical_search": OP12}
