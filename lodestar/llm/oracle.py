"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from lodestar.llm.op08_urls import RULES
from lodestar.llm.url_words import LIMIT, SOFT, STRICT

OP9_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP9 = rf"""
WITH docs AS (SELECT doc_id, {OP9_WORDS} AS w FROM documents),
     starts AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS s FROM docs WHERE len(w) >= 20),
     wins AS (SELECT doc_id, s, sha256(array_to_string(w[s : s + 19], ' ')) AS h FROM starts JOIN docs USING (doc_id)),
     ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY h ORDER BY doc_id, s) AS rn FROM wins),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM ranked WHERE rn > 1),
     lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
     parts AS (SELECT doc_id, w, coalesce(ps, []::BIGINT[]) AS ps FROM docs LEFT JOIN lists USING (doc_id)),
     pos AS (SELECT doc_id, w, len(w) AS n, unnest(CASE WHEN len(w) = 0 THEN [NULL] ELSE range(1, len(w) + 1) END) AS p FROM docs),
     kept AS (SELECT pos.doc_id, pos.n, pos.p, pos.w[pos.p] AS word, gone.p IS NOT NULL AS cut
              FROM pos LEFT JOIN gone ON pos.doc_id = gone.doc_id AND pos.p = gone.p)
SELECT doc_id, max(n)::BIGINT AS n_words, count(*) FILTER (WHERE cut)::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY p) FILTER (WHERE NOT cut), '')) AS kept_sha256
FROM kept GROUP BY doc_id
"""


OP3 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(y, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(y, vec_id)) AS kept
FROM embeddings LEFT JOIN counts ON counts.x = vec_id LEFT JOIN least ON least.x = vec_id
"""


OP4 = r"""
WITH log AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, 24 + length(regexp_replace(role, '<[|\\]', '...', 'g')) + length(regexp_replace(text, '<[|\\]', '...', 'g')) AS chars FROM log)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

OP7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, html, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


def _op8() -> str:
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hit = r"regexp_matches(low, '(^|[^\pL\pN]){}($|[^\pL\pN])')"
    strict = " OR ".join(hit.format(t) for t in STRICT)
    soft = " + ".join(f"{w} * {hit.format(t)}::INT" for t, w in SOFT.items())
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
WITH rules(v, h, p) AS (VALUES {rules}),
a AS (SELECT page_id, {low} AS low,
             CASE WHEN url LIKE '%://%' THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
b AS (SELECT *, translate(regexp_extract(coalesce(rest, ''), '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM a),
c AS (SELECT *, substr(coalesce(rest, ''), length(host) + 1) AS path FROM b),
fits AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
         FROM c JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(v, CASE WHEN {strict} OR ({soft}) >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict
FROM c LEFT JOIN fits ON c.page_id = fits.page_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_near_dedup": OP3, "op4_chat_format": OP4, "op7_warc": OP7, "op8_url_filter": _op8(), "op9_substring_dedup": OP9}
