"""DuckDB SQL for those of the queries that SQL can express."""

from __future__ import annotations


def _crc_table() -> list[int]:
    out = []
    for x in range(256):
        for _ in range(8):
            x = (x >> 1) ^ (0xEDB88320 if x & 1 else 0)
        out.append(x)
    return out


def _crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text, by a table of 256 steps, for texts in groups of two hex digits."""
    bytes_ = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: CAST('0x' || x AS BIGINT))"
    step = "list_reduce({b}, lambda acc, b: xor(acc >> 8, crc_step[1 + (xor(acc, b) & 255)]), 4294967295::BIGINT)".format(b=bytes_)
    return f"xor({step}, 4294967295::BIGINT)"


SHARDING = f"""
WITH RECURSIVE j AS (
    SELECT DISTINCT doc_id, CAST(doc_id AS HUGEINT) AS key, CAST(0 AS BIGINT) AS pt FROM documents
    UNION ALL
    SELECT doc_id, k, CAST(floor((pt + 1) * (2147483648.0::DOUBLE / CAST((k >> 33) + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT doc_id, pt, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM j WHERE pt <= 16)
), s AS (SELECT doc_id, max(pt) FILTER (pt < 16) AS shard, max(pt) FILTER (pt < 17) AS grown FROM j GROUP BY 1),
t AS (SELECT {_crc_table()}::BIGINT[] AS crc_step),
d AS (SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc32("coalesce(text, '')")} AS text_crc32 FROM documents, t)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM d JOIN s USING (doc_id)
"""

MIXING = r"""
WITH d AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS g, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
        -ln((CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / CASE quality WHEN 1 THEN 1.0::DOUBLE WHEN 0 THEN 0.25::DOUBLE ELSE 0.5::DOUBLE END AS key
    FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) USING (doc_id)
), s AS (SELECT g, CAST(sum(size) AS BIGINT) AS source_size, 3 * CAST(sum(size) AS BIGINT) AS cap, 1 + (row_number() OVER (ORDER BY g) - 1) % 3 AS w FROM d GROUP BY g),
l AS (SELECT *, CAST((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM s WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, g)),
r AS (SELECT *, first(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY CAST(cap AS DOUBLE) / w, g ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rate FROM l),
t AS (SELECT g, source_size, CASE WHEN rate IS NULL THEN CAST(cap AS DOUBLE) ELSE rate * w END AS target FROM r),
p AS (SELECT d.doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY g ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS epochs FROM d JOIN t USING (g))
SELECT doc_id, size, source_size, target, CAST(size * (epochs + CASE WHEN epochs < 3 AND before + size / 2.0::DOUBLE < target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p
"""



def _escaped(x: str) -> str:
    """Length of a text with a backslash before each backslash, < and [."""
    return f"(length({x}) + " + " + ".join(rf"length({x}) - length(replace({x}, '{c}', ''))" for c in ("\\", "<", "[")) + ")"


CHAT_FORMAT = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(CASE WHEN role = 'assistant' THEN 13 + {_escaped("text")} ELSE 19 + {_escaped("role")} + length(role) - length(replace(role, chr(10), '')) + {_escaped("text")} END) AS chars FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

_VALID = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
TOP_K = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE {_VALID})
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(q.x, v.x) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)) WHERE rank <= 20
"""

_REACH = """r AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM r JOIN links l ON r.b = l.a)"""
NGRAM_JOIN = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 80 * (p.n + q.n - k)), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) m ON m.a = d.doc_id
"""

EMBEDDING_DEDUP = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE {_VALID}),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id <> q.vec_id AND len(p.x) = len(q.x) WHERE list_cosine_similarity(p.x, q.x) >= 0.95), {_REACH}
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(m, vec_id)) AS kept FROM embeddings
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY 1) k ON k.a = vec_id LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY 1) c ON c.a = vec_id
"""

SQL = {"op1_sharding": SHARDING, "op2_mixing": MIXING, "op3_chat_format": CHAT_FORMAT, "op4_topk": TOP_K, "op7_ngram_join": NGRAM_JOIN, "op10_embedding_dedup": EMBEDDING_DEDUP}
