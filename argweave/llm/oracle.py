"""The queries that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

ORACLE = {
    "op7_url_filter": r"""
        WITH parts AS (
            SELECT page_id, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages
        ), split AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM parts
        ), rules(rule, rule_host, rule_path, verdict) AS (
            VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                   ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
        ), fits AS (
            SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
            FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY page_id
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM split LEFT JOIN fits USING (page_id)
    """,
    "op4_exact_top_k": r"""
        WITH sound AS (
            SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 5
    """,
    "op11_merkle_manifest": r"""
        WITH RECURSIVE doc AS (
            SELECT doc_id, source, text, crc32_even, coalesce('+' || source, '') AS tree,
                   sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
                                 coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                                 coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
                                 coalesce(strlen(text) || ':' || text, '-'))) AS leaf,
                   sha256(concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
                                 coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'),
                                 coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'),
                                 coalesce(strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''), '-'))) AS other
            FROM (SELECT *, coalesce(xor(list_reduce(
                      list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
                      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), CAST(range(8) AS BIGINT[])),
                                                    lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 2 = 0, false) AS crc32_even
                  FROM documents)
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM doc
        ), levels AS (
            SELECT tree, 0 AS level, list(leaf ORDER BY idx) AS nodes FROM leaves GROUP BY tree
            UNION ALL
            SELECT tree, level + 1, [sha256(array_to_string(nodes[3 * k + 1 : 3 * k + 3], '')) FOR k IN range((len(nodes) + 2) // 3)]
            FROM levels WHERE len(nodes) > 1
        ), subroots AS (
            SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM levels WHERE len(nodes) = 1
        ), above AS (
            SELECT 0 AS level, list(subroot ORDER BY tree) AS nodes FROM subroots
            UNION ALL
            SELECT level + 1, [sha256(array_to_string(nodes[3 * k + 1 : 3 * k + 3], '')) FOR k IN range((len(nodes) + 2) // 3)]
            FROM above WHERE len(nodes) > 1
        ), steps AS (
            SELECT tree, idx, level, nodes, idx // CAST(pow(3, level) AS BIGINT) AS spot FROM leaves JOIN levels USING (tree) WHERE len(nodes) > 1
            UNION ALL
            SELECT tree, idx, 1000 + level, nodes, place // CAST(pow(3, level) AS BIGINT)
            FROM leaves JOIN subroots USING (tree) CROSS JOIN above WHERE len(nodes) > 1
        ), sides AS (
            SELECT tree, idx, level, array_to_string(nodes[spot - spot % 3 + 1 : spot], '') AS l, array_to_string(nodes[spot + 2 : spot - spot % 3 + 3], '') AS r
            FROM steps
        ), paths AS (
            SELECT tree, idx, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM sides GROUP BY tree, idx
        ), whole AS (
            SELECT leaves.*, subroot, (SELECT nodes[1] FROM above WHERE len(nodes) = 1) AS root,
                   coalesce(ls, []) AS ls, coalesce(rs, []) AS rs, CASE WHEN crc32_even THEN other ELSE leaf END AS presented
            FROM leaves JOIN subroots USING (tree) LEFT JOIN paths USING (tree, idx)
        ), folds AS (
            SELECT doc_id, leaf, subroot, root, ls, rs, presented AS node, 1 AS step FROM whole
            UNION ALL
            SELECT doc_id, leaf, subroot, root, ls, rs, sha256(ls[step] || node || rs[step]), step + 1 FROM folds WHERE step <= len(ls)
        )
        SELECT doc_id, leaf, subroot, root,
               sha256(array_to_string([ls[k] || rs[k] FOR k IN range(1, len(ls) + 1)], '')) AS proof_sha256,
               node AS folded_root, node = root AS verified
        FROM folds WHERE step = len(ls) + 1
    """,
    "op12_ranked_search": r"""
        WITH words AS (
            SELECT doc_id, row, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT *, row_number() OVER () AS row FROM documents)
        ), counts AS (
            SELECT row, any_value(doc_id) AS doc_id, term, count(*) AS tf FROM words GROUP BY row, term
        ), sizes AS (
            SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY row
        ), corpus AS (
            SELECT count(*) AS total, CAST(sum(n) AS BIGINT) AS words FROM sizes
        ), lengths AS (
            SELECT row, 100 - 25 + (25 * n * total) // words AS m FROM sizes CROSS JOIN corpus
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(total) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
            FROM counts CROSS JOIN corpus GROUP BY term
        ), impacts AS (
            SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * m)) AS impact
            FROM counts JOIN lengths USING (row) JOIN weights USING (term)
        ), asked AS (
            SELECT item, any_value(item_id) AS item_id, term, count(*) AS times
            FROM (SELECT item_id, item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                  FROM (SELECT *, row_number() OVER () AS item FROM benchmark))
            GROUP BY item, term
        ), scored AS (
            SELECT item, any_value(item_id) AS item_id, row, any_value(doc_id) AS doc_id, CAST(sum(times * impact) AS BIGINT) AS score
            FROM asked JOIN impacts USING (term) GROUP BY item, row
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
    "op13_minhash_dedup": r"""
        WITH RECURSIVE split AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), sets AS (
            SELECT doc_id, CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
                                ELSE list_distinct([array_to_string(words[k : k + 3], ' ') FOR k IN range(1, len(words) - 2)]) END AS shingles
            FROM split
        ), sized AS (
            SELECT doc_id, len(shingles) AS n, shingles FROM sets
        ), single AS (
            SELECT doc_id, n, unnest(shingles) AS shingle FROM sized
        ), pairs AS (
            SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS shared
            FROM single a JOIN single b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id
        ), links AS (
            SELECT a, b FROM pairs WHERE 100 * shared >= 80 * (na + nb - shared)
        ), reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), least AS (
            SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
    """,
}
