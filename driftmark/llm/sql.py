"""DuckDB SQL for the corpus queries that SQL can express."""

OP1 = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(6 + length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) + 2
                + length(replace(replace(text, '\', '\b'), '<', '\l')) + 8) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

OP9 = r"""
WITH bw AS (
    SELECT item_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] AS w
    FROM benchmark
), wins AS (
    SELECT DISTINCT item_id, array_to_string(w[s : s + least(len(w), 13) - 1], ' ') AS win, least(len(w), 13) AS n
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS s FROM bw WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') if x <> ''] AS w
    FROM documents
), tok AS (
    SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM dw
), sizes AS (SELECT DISTINCT n FROM wins), grams AS (
    SELECT doc_id, p, n, string_agg(word, ' ') OVER (PARTITION BY doc_id, n ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g13, word
    FROM tok CROSS JOIN (SELECT n FROM sizes WHERE n = 13)
), shorter AS (
    SELECT d.doc_id, s.p, z.n, array_to_string(d.w[s.p : s.p + z.n - 1], ' ') AS g
    FROM dw d JOIN sizes z ON z.n < 13, LATERAL (SELECT unnest(range(1, greatest(len(d.w) - z.n, -1) + 2)) AS p) s
), hits AS (
    SELECT g.doc_id, g.p, w.item_id, w.n FROM grams g JOIN wins w ON w.n = 13 AND w.win = g.g13
    UNION ALL
    SELECT g.doc_id, g.p, w.item_id, w.n FROM shorter g JOIN wins w ON w.n = g.n AND w.win = g.g
), pos AS (
    SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), its AS (
    SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_chat_format": OP1, "op9_decontaminate": OP9}
