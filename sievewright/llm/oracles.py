"""SQL of the corpus operators that SQL can express, over whole tables."""

from __future__ import annotations

from .sharding import SEED, SHARDS


def _crc_table() -> list[int]:
    """Remainders of the bytes under the reflected polynomial of CRC-32."""
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
        out.append(byte)
    return out


#: Windows are cut from parts of a text of so many bytes, as a part is read anew for each.
PART = 1024


def byte_repeats(length: int = 100) -> str:
    return f"""
    WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    parts AS (
        SELECT doc_id, p * {PART} AS base, substr(h, 2 * p * {PART} + 1, 2 * {PART + length}) AS part
        FROM docs, unnest(range(0, (length(h) // 2 + {PART - 1}) // {PART})) AS u(p)
    ),
    bytes AS (
        SELECT doc_id, base + i AS pos, substr(part, 2 * i + 1, 2) AS b, substr(part, 2 * i + 1, {2 * length}) AS w
        FROM parts, unnest(range(0, least({PART}, length(part) // 2))) AS u(i)
    ),
    marked AS (
        SELECT doc_id, pos, b, length(w) = {2 * length} AND row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) > 1 AS again FROM bytes
    ),
    gone AS (
        SELECT doc_id, pos, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS g FROM marked
    ),
    edges AS (SELECT *, g AND NOT coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY pos), false) AS starts FROM gone),
    told AS (
        SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (g) AS n_removed, count(*) FILTER (starts) AS n_spans,
               coalesce(string_agg(b, '' ORDER BY pos) FILTER (NOT g), '') AS kept
        FROM edges GROUP BY doc_id
    )
    SELECT d.doc_id, coalesce(n_bytes, 0)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
           coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
    FROM docs d LEFT JOIN told t ON d.doc_id = t.doc_id"""


def word_windows(length: int = 50) -> str:
    return rf"""
    WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    words AS (SELECT doc_id, i AS pos, ws[i] AS w, CASE WHEN i + {length - 1} <= len(ws) THEN md5(array_to_string(ws[i:i + {length - 1}], ' ')) END AS s
              FROM docs, unnest(range(1, len(ws) + 1)) AS u(i)),
    marked AS (SELECT doc_id, pos, w, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM words),
    gone AS (
        SELECT doc_id, pos, w, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {length - 1} PRECEDING AND CURRENT ROW) AS g FROM marked
    ),
    told AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (g) AS n_removed, coalesce(string_agg(w, ' ' ORDER BY pos) FILTER (NOT g), '') AS kept
             FROM gone GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM docs d LEFT JOIN told t ON d.doc_id = t.doc_id"""


def near_texts(k: int = 5, threshold: float = 0.8) -> str:
    """Classes by the shared labelled shingles of all pairs, of which the longest run in the order of both texts counts:
    the tails of ascending runs, by patience sorting."""
    return rf"""
    WITH RECURSIVE docs AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    texts AS (SELECT t, any_value(ws) AS ws, min(doc_id) AS node FROM docs GROUP BY t),
    grams AS (SELECT node, i AS pos, md5(array_to_string(ws[i:i + {k - 1}], ' ')) AS g
              FROM texts, unnest(range(1, greatest(least(len(ws), 1), len(ws) - {k - 1}) + 1)) AS u(i) WHERE len(ws) > 0),
    labelled AS (SELECT node, pos, g, row_number() OVER (PARTITION BY node, g ORDER BY pos) AS nth FROM grams),
    sizes AS (SELECT node, count(*) AS n FROM labelled GROUP BY node),
    shared AS (
        SELECT a.node AS a, b.node AS b, a.pos AS p, b.pos AS q FROM labelled a JOIN labelled b USING (g, nth) WHERE a.node < b.node
    ),
    pairs AS (SELECT a, b, count(*) AS n, list([q] ORDER BY p) AS places FROM shared GROUP BY a, b),
    alike AS (SELECT a, b, places, x.n + y.n AS total FROM pairs JOIN sizes x ON x.node = a JOIN sizes y ON y.node = b WHERE pairs.n >= {threshold} * (total - pairs.n)),
    aligned AS (SELECT a, b, total, len(list_reduce(places, lambda tails, q: list_concat(
        list_append(list_filter(tails, lambda v: v < q[1]), q[1]), list_filter(tails, lambda v: v >= q[1])[2:]))) AS n FROM alike),
    near AS (SELECT a, b FROM aligned WHERE n >= {threshold} * (total - n)),
    links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
    reach AS (SELECT node AS a, node AS b FROM texts UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a)
    SELECT doc_id, class_id, doc_id = class_id AS kept FROM docs JOIN texts USING (t) JOIN least USING (node)"""


def near_vectors(threshold: float = 0.98) -> str:
    return f"""
    WITH RECURSIVE vecs AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    ),
    fine AS (
        SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM vecs
        WHERE label IS NOT NULL AND v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
    ),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
        WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= {threshold}
    ),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM vecs UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    counts AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
    SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
    FROM vecs JOIN least ON least.a = vec_id LEFT JOIN counts ON counts.a = vec_id"""


def interleaved(shards: int = SHARDS, seed: str = SEED) -> str:
    table = ", ".join(map(str, _crc_table()))
    return f"""
    WITH docs AS (
        SELECT doc_id, source, coalesce(text, '') AS t, md5('{seed}:' || coalesce(doc_id::VARCHAR, '')) AS k,
               coalesce('=' || source, '') AS stratum
        FROM documents
    ),
    crcs AS (
        SELECT t, xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda x: ('0x' || x)::BIGINT)),
            lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS crc
        FROM (SELECT DISTINCT t, hex(encode(t)) AS h FROM docs), (SELECT [{table}]::BIGINT[] AS steps)
    ),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY k, doc_id) AS r, count(*) OVER (PARTITION BY stratum) AS n FROM docs),
    placed AS (SELECT *, row_number() OVER (ORDER BY (2 * r - 1)::DOUBLE / (2 * n)::DOUBLE, k, doc_id) - 1 AS place, count(*) OVER () AS total FROM ranked),
    dealt AS (SELECT *, place * {shards} // total AS shard FROM placed)
    SELECT doc_id, (strlen(t) + 8)::BIGINT AS size, crc AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
           (place - (shard * total + {shards - 1}) // {shards})::BIGINT AS slot, NULL::INTEGER AS grown_shard, source
    FROM dealt JOIN crcs USING (t)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_suffix_merge": byte_repeats(),
        "op4_seed_extend": word_windows(),
        "op6_order_minhash": near_texts(),
        "op8_nn_descent": near_vectors(),
        "op9_interleave": interleaved(),
    }
