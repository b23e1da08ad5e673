"""DuckDB SQL for the registered queries that SQL can express."""

OP10 = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
    FROM documents
), keyed AS (
    SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM lines
), shared AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
    SELECT k.doc_id, k.pos, k.line, s.key IS NOT NULL AND k.doc_id <> s.keeper AS dropped
    FROM keyed k LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP8 = r"""
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 10
"""


#: crc32 is spelt out: the reflected polynomial 0xEDB88320, bit by bit.
OP11 = r"""
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos,
           coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
    SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM turns
), heads AS (
    SELECT conv_id, base, xor(list_reduce(
               list_concat([4294967295::BIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
               lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)
           ), 4294967295::BIGINT) % 4 AS h
    FROM ids
), rebuilt AS (
    SELECT h.conv_id, 0 AS part, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.base AND t.pos <= h.h
    UNION ALL
    SELECT h.conv_id, 1, t.pos, t.role, t.text FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.pos > h.h
), lists AS (
    SELECT i.conv_id, list({'r': role, 't': text} ORDER BY part, pos) FILTER (WHERE r.conv_id IS NOT NULL) AS path
    FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id
), rows AS (
    SELECT conv_id, d AS depth, coalesce(path[:d], []) AS path, coalesce(len(path), 0) AS size
    FROM lists, LATERAL unnest(range(coalesce(len(path), 0) + 1)) AS u(d)
), nodes AS (
    SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
           coalesce((count(*) - 1) * len(regexp_extract_all(path[depth].t, '[^\x20\x09-\x0D]+')), 0) AS saved,
           sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
    FROM rows GROUP BY path, depth
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, p.path AS parent_path
    FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]
), children AS (
    SELECT parent_path AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent_path
), above AS (
    SELECT n.path[:d] AS path, n.saved, c.path IS NULL AS leaf
    FROM nodes n LEFT JOIN children c ON c.path = n.path, LATERAL unnest(range(n.depth + 1)) AS u(d)
), totals AS (
    SELECT path, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY path
)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, coalesce(c.n_children, 0) AS n_children, t.n_leaves, t.saved_tokens, l.ends_sha256
FROM linked l JOIN totals t ON t.path = l.path LEFT JOIN children c ON c.path = l.path
"""

OP12 = r"""
WITH RECURSIVE tokens AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
               ELSE list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])) END)) AS s
    FROM tokens
), classed AS (
    SELECT doc_id, s, len(s) AS n, CASE WHEN len(s) > 0 THEN min(doc_id) OVER (PARTITION BY s) ELSE doc_id END AS cls FROM sets
), shingles AS (
    SELECT cls, n, unnest(s) AS shingle FROM classed WHERE doc_id = cls AND n > 0
), links AS (
    SELECT a.cls AS x, b.cls AS y FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.cls <> b.cls
    GROUP BY a.cls, b.cls HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))
), reached AS (
    SELECT cls AS x, cls AS y FROM classed WHERE doc_id = cls
    UNION
    SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y
), least AS (
    SELECT x, min(y) AS component_id FROM reached GROUP BY x
)
SELECT doc_id, n AS n_shingles, component_id FROM classed JOIN least ON x = cls
"""


def all_oracles() -> dict[str, str]:
    return {"op8_vector_search": OP8, "op10_line_dedup": OP10, "op11_prefix_trie": OP11, "op12_jaccard_join": OP12}
