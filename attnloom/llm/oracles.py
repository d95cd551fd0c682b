"""SQL of the queries that have a form in it, for DuckDB over the same tables."""

_TURN = "sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))"
_CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], list_transform(range(8), lambda i: i::BIGINT)),
        lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295)"""

OP2 = """
WITH RECURSIVE given AS (SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
usable AS (
  SELECT vec_id, v FROM given
  WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least_of AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, r.component_id, e.vec_id = r.component_id AS kept
FROM embeddings e JOIN least_of r ON r.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""

OP11 = f"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, {_TURN}) AS place, {_TURN} AS digest, strlen(coalesce(text, '')) AS bytes
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 5 AS base, {_CRC32} % 9 AS skip FROM turns GROUP BY conv_id),
heads AS (SELECT c.*, least(c.skip, coalesce(b.own, 0)) AS head FROM convs c LEFT JOIN convs b ON b.conv_id = c.base),
rebuilt AS (
  SELECT h.conv_id, t.place AS depth, t.digest, t.bytes FROM heads h JOIN turns t ON t.conv_id = h.base AND t.place <= h.head
  UNION ALL
  SELECT h.conv_id, h.head + t.place - h.skip, t.digest, t.bytes FROM heads h JOIN turns t ON t.conv_id = h.conv_id AND t.place > h.skip
),
paths AS (
  SELECT conv_id, depth, bytes, string_agg(digest, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
),
steps AS (
  SELECT conv_id, depth, bytes, sha256(prefix) AS node, lag(sha256(prefix)) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM paths
),
nodes AS (
  SELECT node, max(parent) AS parent, max(depth) AS depth, max(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends) AS ended
  FROM steps GROUP BY node
),
children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
below AS (
  SELECT s.node, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
  FROM nodes n LEFT JOIN children c ON c.node = n.node JOIN steps s ON s.conv_id = n.conv_id AND s.depth <= n.depth
  GROUP BY s.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
       b.n_leaves::BIGINT AS n_leaves, b.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(n.ended, '')) AS ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children c ON c.node = n.node LEFT JOIN nodes p ON p.node = n.parent
"""

_HEX = "(instr('0123456789abcdef', substr(hex, {at}, 1)) - 1)"
_BASE32 = f"""list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (((({_HEX.format(at="(5 * i) // 4 + 1")} * 16 + {_HEX.format(at="(5 * i) // 4 + 2")}) >> (3 - (5 * i) % 4)) & 31)::INT), 1)), 'string_agg', '')"""

OP12 = f"""
WITH given AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
marked AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS last_id,
         row_number() OVER (PARTITION BY payload ORDER BY page_id DESC NULLS LAST) AS place
  FROM given
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN place > 1 THEN last_id END AS refers_to
FROM marked
"""

#: Other operators learn, pack or draw, or compare doubles that sum in another order; tests hold those to brute force.
ORACLES = {"op2_embedding_near_dedup": OP2, "op11_conversation_trie": OP11, "op12_warc": OP12}
