"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others (sharding's binary search, alignment, training, byte-pair merging, sentence
spans) are held against brute-force versions in tests.
"""

_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5 = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
 g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+3], ' ') FOR i IN range(1, len(w) - 2)]) END AS g FROM w),
 s AS (SELECT doc_id, unnest(g) AS g FROM g),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM c JOIN g a ON a.doc_id = x JOIN g b ON b.doc_id = y WHERE 100 * c >= 85 * (len(a.g) + len(b.g) - c)),
 r(doc_id, m) AS (SELECT doc_id, doc_id FROM g UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.m = l.x)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM g JOIN (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id) USING (doc_id)"""

OP6 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
 d AS (SELECT page_id, strlen(h) AS payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(x, 1 + 5 * CAST(i // 4 AS INT), 5))::BIGINT >> (5 * (3 - CAST(i % 4 AS INT)))) & 31) AS INT), 1) FOR i IN range(32)], '') AS payload_digest FROM p),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""

_SAID = r"\### Assistant: </turn> ok"
OP7 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_SAID}' UNION ALL SELECT -7, 1, 'assistant', '{_SAID}'),
 e AS (SELECT *, length(text) - length(replace(text, '\', '')) + (length(text) - length(replace(text, '### ', ''))) // 4 + (length(text) - length(replace(text, '</turn>', ''))) // 7 AS escapes,
  contains(text, '</turn>') OR contains(text, '### ') OR contains(text, '\\') OR suffix(text, '\') AS conflict FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(14 + length(role) + length(text) + CASE WHEN conflict THEN escapes ELSE 0 END) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id"""

OP8 = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
 l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
 r(vec_id, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON r.m = l.x),
 c AS (SELECT vec_id, min(m) AS component_id FROM r GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE x = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""

OP10 = """
WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
 r AS (SELECT source, sqrt(n) * (SELECT sum(n) / sum(sqrt(n)) FROM s) / n AS rate FROM s),
 k AS (SELECT source, rate, unnest(range(CAST(rate + 12 * sqrt(rate) + 31 AS BIGINT))) AS k FROM r),
 f AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k),
 u AS (SELECT *, ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM documents),
 n AS (SELECT u.*, r.rate, (SELECT count(*) FROM f WHERE f.source = u.source AND f.cdf <= u.u) AS n FROM u JOIN r USING (source)),
 o AS (SELECT *, CAST(unnest(range(n)) AS INT) AS copy FROM n)
SELECT doc_id, text, lang, source, n_chars, round(rate, 9) AS rate, copy, md5('order:0:' || doc_id || ':' || copy) AS shuffle_key FROM o"""



def _round(k: int) -> str:
    """Entries after one more round: each part's nearest entry, ties to the first, then floored averages; unused ones stay."""
    return f"""
 n{k} AS MATERIALIZED (SELECT s.vec_id, s.part, arg_min(c.entry, [list_sum(list_transform(list_zip(s.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry]) AS entry FROM s JOIN c{k} c USING (part) GROUP BY ALL),
 c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, CASE WHEN m.x IS NULL THEN c.x ELSE m.x END AS x FROM c{k} c LEFT JOIN
  (SELECT part, entry, list(v ORDER BY d) AS x FROM (SELECT part, entry, d, CAST(floor(sum(x[d]) / count(*)) AS BIGINT) AS v FROM n{k} JOIN s USING (vec_id, part), range(1, len(x) + 1) r(d) GROUP BY ALL) GROUP BY ALL) m USING (part, entry)),"""


OP12 = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 s AS MATERIALIZED (SELECT vec_id, label, CAST(p AS INT) AS part, e[p * len(e) // 16 + 1:(p + 1) * len(e) // 16] AS x FROM v, range(16) r(p)),
 c0 AS (SELECT part, o AS entry, x FROM s JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS o FROM v ORDER BY vec_id LIMIT 64) USING (vec_id)),{_round(0)}{_round(1)}
 f AS (SELECT s.vec_id, s.label, s.part, min([list_sum(list_transform(list_zip(s.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c.entry]) AS best FROM s JOIN c2 c USING (part) GROUP BY ALL),
 o AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(best[2] AS INT)), '' ORDER BY part) AS code, CAST(sum(best[1]) AS BIGINT) AS error FROM f GROUP BY ALL)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c2) AS codebooks_sha256 FROM o"""

ORACLES: dict[str, str] = {
    "op5_ngram_jaccard_join": OP5,
    "op6_warc": OP6,
    "op7_chat_format": OP7,
    "op8_embedding_dedup": OP8,
    "op10_mix_sources": OP10,
    "op12_vector_codes": OP12,
}
