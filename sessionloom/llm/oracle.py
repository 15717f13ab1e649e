"""DuckDB SQL for the queries that SQL can express, and for the fixed part of op1."""

from __future__ import annotations


def _least_reachable(nodes: str, links: str) -> str:
    """(id, root) by the transitive closure of links (x, y), which hold both directions."""
    return f"""SELECT id, min(other) AS root FROM (WITH RECURSIVE reach AS (SELECT id, id AS other FROM {nodes}
UNION SELECT r.id, l.y FROM reach r JOIN {links} l ON r.other = l.x) SELECT * FROM reach) GROUP BY id"""


VECTORS = """SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL
AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0"""

OP3 = f"""WITH good AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM ({VECTORS})
WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
nodes AS (SELECT vec_id AS id FROM embeddings), roots AS ({_least_reachable('nodes', 'links')}),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, root AS component_id, id = root AS kept FROM roots LEFT JOIN counted ON id = x"""

OP4 = rf"""WITH words AS (SELECT doc_id, [x FOR x IN string_split_regex(text, '[\x00-\x20]+') IF x <> ''] AS w
FROM documents WHERE text IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS g FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared s JOIN sizes a ON x = a.doc_id JOIN sizes b ON y = b.doc_id WHERE s.n >= 0.8 * (a.n + b.n - s.n) - 1e-9),
nodes AS (SELECT doc_id AS id FROM documents), roots AS ({_least_reachable('nodes', 'links')}),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT id AS doc_id, root AS class_id, coalesce(n, 0) AS n_links, id = root AS kept FROM roots LEFT JOIN counted ON id = x"""

OP7 = f"""WITH cells AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) FOR x IN embedding] AS w FROM ({VECTORS})),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.w, b.w) AS BIGINT) AS score
FROM cells a JOIN cells b ON a.vec_id <> b.vec_id AND len(a.w) = len(b.w) WHERE a.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""

OP10 = """WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
windows AS (SELECT doc_id, pos, hash(t[pos + 1:pos + 200]) AS k
FROM (SELECT doc_id, t, unnest(range(0, octet_length(t) - 199)) AS pos FROM texts WHERE octet_length(t) >= 200)),
twice AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
found AS (SELECT doc_id, pos FROM windows WHERE k IN (SELECT k FROM twice)),
heads AS (SELECT doc_id, pos, coalesce(pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) > 200, true) AS head FROM found),
placed AS (SELECT doc_id, pos, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM heads),
spans AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 200 AS b FROM placed GROUP BY doc_id, run),
gaps AS (SELECT doc_id, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), 2000000000) AS b FROM spans
UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
rest AS (SELECT doc_id, unhex(string_agg(hex(t[a + 1:g.b]), '' ORDER BY a)) AS kept FROM gaps g JOIN texts USING (doc_id)
WHERE a < g.b AND a < octet_length(t) GROUP BY doc_id),
counted AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(t) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
sha256(CASE WHEN n_spans IS NULL THEN t ELSE coalesce(kept, ''::BLOB) END) AS kept_sha256
FROM texts LEFT JOIN rest USING (doc_id) LEFT JOIN counted USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op3_embedding_dedup": OP3, "op4_ngram_join": OP4, "op7_top_k_search": OP7, "op10_suffix_dedup": OP10}
