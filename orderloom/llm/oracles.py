"""The llm queries that SQL can express, in DuckDB's SQL.

The others learn from labels, merge by rank, tile or parse; their tests hold them against
brute force.
"""

from __future__ import annotations

ARCHIVED = """
WITH payloads AS (
    SELECT page_id, url, coalesce(html, '') AS payload FROM pages
),
records AS (
    SELECT page_id, coalesce(url, '') AS url, strlen(payload) AS payload_bytes,
           sha1(payload) AS payload_digest,
           CASE WHEN strlen(payload) >= 1000
                THEN max(page_id) OVER (PARTITION BY payload) END AS first_page
    FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first_page IS NULL OR first_page = page_id THEN 'response' ELSE 'revisit' END
           AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to,
       url
FROM records
"""

# Documents with equal sets are one node; links are found through shared shingles.
LINKED = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_sort(list_distinct(list_transform(
            range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')))) END AS s
    FROM words
),
nodes AS (
    SELECT row_number() OVER (ORDER BY min(doc_id)) AS node, min(doc_id) AS least, s, len(s) AS n
    FROM sets WHERE len(s) > 0 GROUP BY s
),
shingles AS (SELECT node, n, unnest(s) AS g FROM nodes),
pairs AS (
    SELECT a.node AS a, b.node AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.g = b.g AND a.node < b.node
        AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
    GROUP BY a.node, b.node
),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 90 * (na + nb - shared)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT a AS node, a AS other FROM both_ways
    UNION
    SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other
),
components AS (
    SELECT r.node, min(m.least) AS component_id
    FROM reach r JOIN nodes m ON m.node = r.other GROUP BY r.node
)
SELECT sets.doc_id, len(sets.s) AS n_shingles,
       coalesce(c.component_id, n.least, sets.doc_id) AS component_id
FROM sets LEFT JOIN nodes n ON n.s = sets.s LEFT JOIN components c ON c.node = n.node
"""

SHARDED = """
WITH crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
),
texts AS (
    SELECT doc_id, 's' || source AS source, strlen(coalesce(text, '')) + 1 AS size,
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                          lambda x: CAST('0x' || x AS bigint)) AS data
    FROM documents
),
docs AS (
    SELECT doc_id, coalesce(source, 'null') AS source, CAST(size AS bigint) AS size,
           xor(list_reduce(list_prepend(CAST(4294967295 AS bigint), data), lambda c, b:
               xor(c >> 8, t[xor(c & 255, b) + 1])), CAST(4294967295 AS bigint)) AS crc
    FROM texts, crc_table
),
drawn AS (
    SELECT *, (CAST(('0x' || substr(md5(concat_ws('|', '0', coalesce(CAST(doc_id AS varchar), 'null'),
        size, crc)), 1, 13)) AS bigint) + 0.5::double) / 4503599627370496::double AS draw,
        (CAST(('0x' || substr(md5('0|' || source), 1, 13)) AS bigint) + 0.5::double)
            / 4503599627370496::double AS shift
    FROM docs
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY draw, doc_id, size, crc) - 1 AS r,
           count(*) OVER (PARTITION BY source) AS n
    FROM drawn
),
placed AS (
    SELECT *, row_number() OVER (
        ORDER BY (CAST(r AS double) + shift) / CAST(n AS double), source, draw, doc_id, size, crc
        ) - 1 AS p, count(*) OVER () AS total
    FROM ranked
)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(p * 8 // total AS integer) AS shard,
       CAST(p - ((p * 8 // total) * total + 7) // 8 AS bigint) AS slot,
       CAST(NULL AS integer) AS grown_shard
FROM placed
"""

# levenshtein() counts edits of bytes, as the operator does.
DEDUPED_LINES = """
WITH RECURSIVE lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS n
    FROM documents WHERE text IS NOT NULL
),
distinct_lines AS (
    SELECT line, strlen(line) AS size, row_number() OVER (ORDER BY line) AS node
    FROM lines WHERE strlen(line) >= 20 GROUP BY line
),
links AS (
    SELECT a.node AS a, b.node AS b
    FROM distinct_lines a, range(3) d(shift), distinct_lines b
    WHERE b.size = a.size + d.shift AND (d.shift > 0 OR a.node < b.node)
      AND levenshtein(a.line, b.line) <= 2
),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
    SELECT a AS node, a AS other FROM both_ways
    UNION
    SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.other
),
classes AS (SELECT node, min(other) AS class FROM reach GROUP BY node),
placed AS (
    SELECT l.doc_id, l.n, l.line, coalesce(c.class, d.node) AS class
    FROM lines l LEFT JOIN distinct_lines d ON d.line = l.line LEFT JOIN classes c ON c.node = d.node
),
judged AS (
    SELECT *, class IS NULL OR row_number() OVER (PARTITION BY class ORDER BY doc_id, n) = 1 AS stays
    FROM placed
),
rebuilt AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
           coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (stays), '') AS text
    FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(r.n_lines, 0) AS n_lines, coalesce(r.n_dropped, 0) AS n_dropped, r.text
FROM documents d LEFT JOIN rebuilt r ON r.doc_id = d.doc_id
"""

COLLOCATED = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
f1 AS (SELECT lang, w[i] AS a1, count(*) AS f FROM words GROUP BY ALL),
f2 AS (
    SELECT lang, w[i] AS a1, w[i + 1] AS a2, count(*) AS f FROM words WHERE i < len(w) GROUP BY ALL
),
f3 AS (
    SELECT lang, w[i] AS a1, w[i + 1] AS a2, w[i + 2] AS a3, count(*) AS f
    FROM words WHERE i + 1 < len(w) GROUP BY ALL HAVING count(*) >= 10
),
over AS (
    SELECT lang, a1, a2, max(f) AS f FROM (
        SELECT lang, a1, a2, f FROM f3 UNION ALL SELECT lang, a2, a3, f FROM f3) GROUP BY ALL
),
two AS (
    SELECT p.lang, p.a1 || ' ' || p.a2 AS phrase, p.f AS a, x.f AS l, y.f AS r
    FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.a1 = p.a1 JOIN f1 y ON y.lang = p.lang AND y.a1 = p.a2
    LEFT JOIN over o ON o.lang = p.lang AND o.a1 = p.a1 AND o.a2 = p.a2
    WHERE p.f >= 10 AND (o.f IS NULL OR 100 * o.f < 50 * p.f)
),
cuts AS (
    SELECT lang, phrase, 1 AS k, a, l, r FROM two
    UNION ALL
    SELECT p.lang, p.a1 || ' ' || p.a2 || ' ' || p.a3, 1, p.f, x.f, y.f
    FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.a1 = p.a1
    JOIN f2 y ON y.lang = p.lang AND y.a1 = p.a2 AND y.a2 = p.a3
    UNION ALL
    SELECT p.lang, p.a1 || ' ' || p.a2 || ' ' || p.a3, 2, p.f, x.f, y.f
    FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.a1 = p.a1 AND x.a2 = p.a2
    JOIN f1 y ON y.lang = p.lang AND y.a1 = p.a3
),
scored AS (
    SELECT *, CAST((1000000 * CAST(a AS hugeint) * a) // (CAST(l AS hugeint) * r) AS bigint) AS score
    FROM cuts
),
chosen AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM chosen
),
totals AS (SELECT lang, CAST(sum(f) AS bigint) AS n FROM f1 GROUP BY lang)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, r.score
FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""

# Sources come as a key that sorts null before all others.
MANIFEST = """
WITH RECURSIVE crc_table AS (
    SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b:
        CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
    FROM range(256) r(i)
),
claims AS (
    SELECT row_number() OVER () AS r, *, CASE WHEN xor(list_reduce(list_prepend(
        CAST(4294967295 AS bigint), list_transform(string_split(CAST(doc_id AS varchar), ''),
        lambda d: CAST(ascii(d) AS bigint))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])),
        CAST(4294967295 AS bigint)) % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS claim
    FROM documents, crc_table
),
heads AS (
    SELECT *, coalesce(strlen(CAST(doc_id AS varchar)) || ':' || doc_id, '-')
        || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
        || coalesce(strlen(CAST(n_chars AS varchar)) || ':' || n_chars, '-') AS head
    FROM claims
),
leaves AS (
    SELECT r, doc_id, coalesce('s' || source, '') AS tree,
           sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(claim) || ':' || claim, '-')) AS claimed
    FROM heads
),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
           count(*) OVER (PARTITION BY tree) AS n
    FROM leaves
),
below AS (
    SELECT tree, 0 AS level, pos, leaf AS node, n FROM placed
    UNION ALL
    SELECT tree, level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3
    FROM below WHERE n > 1 GROUP BY tree, level, pos // 3, n
),
subroots AS (
    SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
    FROM below WHERE n = 1
),
above AS (
    SELECT 0 AS level, pos, node, n FROM subroots
    UNION ALL
    SELECT level + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3
    FROM above WHERE n > 1 GROUP BY level, pos // 3, n
),
below_runs AS (
    SELECT tree, level, pos // 3 AS run, string_agg(node, '' ORDER BY pos) AS nodes
    FROM below WHERE n > 1 GROUP BY ALL
),
above_runs AS (
    SELECT level, pos // 3 AS run, string_agg(node, '' ORDER BY pos) AS nodes
    FROM above WHERE n > 1 GROUP BY ALL
),
climbed AS (
    SELECT r, tree, 0 AS level, pos, claimed AS node, '' AS proof FROM placed
    UNION ALL
    SELECT c.r, c.tree, c.level + 1, c.pos // 3,
           sha256(substr(s.nodes, 1, 64 * (c.pos % 3)) || c.node || substr(s.nodes, 64 * (c.pos % 3) + 65)),
           c.proof || substr(s.nodes, 1, 64 * (c.pos % 3)) || substr(s.nodes, 64 * (c.pos % 3) + 65)
    FROM climbed c JOIN below_runs s ON s.tree = c.tree AND s.level = c.level AND s.run = c.pos // 3
),
at_subroot AS (
    SELECT c.r, c.node, c.proof, s.node AS subroot, s.pos
    FROM climbed c JOIN subroots s ON s.tree = c.tree
    WHERE c.level = (SELECT max(level) FROM below b WHERE b.tree = c.tree)
),
further AS (
    SELECT r, subroot, 0 AS level, pos, node, proof FROM at_subroot
    UNION ALL
    SELECT c.r, c.subroot, c.level + 1, c.pos // 3,
           sha256(substr(s.nodes, 1, 64 * (c.pos % 3)) || c.node || substr(s.nodes, 64 * (c.pos % 3) + 65)),
           c.proof || substr(s.nodes, 1, 64 * (c.pos % 3)) || substr(s.nodes, 64 * (c.pos % 3) + 65)
    FROM further c JOIN above_runs s ON s.level = c.level AND s.run = c.pos // 3
),
top AS (SELECT node AS root, level FROM above WHERE n = 1)
SELECT p.doc_id, p.leaf, f.subroot, top.root, sha256(f.proof) AS proof_sha256,
       f.node AS folded_root, f.node = top.root AS verified
FROM placed p JOIN further f ON f.r = p.r JOIN top ON top.level = f.level
"""

ORACLES: dict[str, str] = {
    "op1_ngram_join": LINKED,
    "op2_warc": ARCHIVED,
    "op5_line_dedup": DEDUPED_LINES,
    "op7_sharding": SHARDED,
    "op12_collocations": COLLOCATED,
    "op13_merkle": MANIFEST,
}
