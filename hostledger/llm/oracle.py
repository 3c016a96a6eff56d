"""The same results as SQL over the test tables, where SQL can express them."""

from __future__ import annotations

# All pairs of equal label, then the smallest vec_id reachable.
OP9 = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
    SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
    WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach(vec_id, other) AS (
    SELECT a, b FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a
), first AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id
), degree AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(f.other, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(f.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN first f USING (vec_id) LEFT JOIN degree d USING (vec_id)
"""

# Rules, then the share of good pages shrunk from host to domain to suffix to all, normal upper bound.
OP5 = r"""
WITH split AS (
    SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
      coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages
), rules(target, rule_host, rule_path, verdict) AS (VALUES
    ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')
), ruled AS (
    SELECT s.*, r.target AS rule, r.verdict AS ruled FROM split s LEFT JOIN rules r
      ON (s.host = r.rule_host OR ends_with(s.host, '.' || r.rule_host)) AND starts_with(s.path, r.rule_path)
    QUALIFY row_number() OVER (PARTITION BY page_id, s.host, s.path ORDER BY length(r.target) DESC NULLS LAST) = 1
), hosts AS (
    SELECT host, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix,
      count(ruled) AS n, count(*) FILTER (ruled = 'allow') AS good FROM ruled GROUP BY ALL
), domains AS (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM hosts GROUP BY ALL
), suffixes AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS good FROM domains GROUP BY ALL
), moments AS (
    SELECT level, count(*) AS g, sum(n) AS a, sum(n * n) AS n2, sum(good) / sum(n) AS p, sum(good * good / n) AS q FROM (
      SELECT 'host' AS level, n, good FROM hosts UNION ALL SELECT 'domain', n, good FROM domains UNION ALL SELECT 'suffix', n, good FROM suffixes)
    WHERE n > 0 GROUP BY level
), strength AS (
    SELECT level, p, CASE WHEN p > 0 AND p < 1 AND g > 1 AND a - n2 / a - (g - 1) > 1e-9 THEN
      1 / least(0.999, greatest(0.001, ((q - a * p * p) / (p * (1 - p)) - (g - 1)) / (a - n2 / a - (g - 1)))) - 1 ELSE 10 END AS s
    FROM moments
), s AS (
    SELECT coalesce(max(p), 0.5) AS p, coalesce(max(s) FILTER (level = 'suffix'), 10) AS s1,
      coalesce(max(s) FILTER (level = 'domain'), 10) AS s2, coalesce(max(s) FILTER (level = 'host'), 10) AS s3 FROM strength
), m1 AS (SELECT suffix, (s1 * p + good) / (s1 + n) AS m FROM suffixes, s
), m2 AS (SELECT domain, suffix, (s2 * m + good) / (s2 + n) AS m FROM domains JOIN m1 USING (suffix), s
), m3 AS (SELECT host, n, s3, (s3 * m + good) / (s3 + n) AS m FROM hosts JOIN m2 USING (domain, suffix), s)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN m + 1.645 * sqrt(m * (1 - m) / (s3 + n + 1)) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled JOIN m3 USING (host)
"""

# Trees level by level, the siblings of every leaf, and the digests folded along them.
OP12 = """
WITH RECURSIVE d AS (
    SELECT doc_id, lang, n_chars, '|' || coalesce(strlen(text) || ':' || text, '-') AS shown,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') AS head,
      xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda crc, b:
        list_reduce(list_prepend(xor(crc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, i:
          xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 7 = 0 AS altered
    FROM documents
), claimed AS (
    SELECT *, n_chars::HUGEINT + CASE WHEN altered THEN 1 ELSE 0 END AS claim FROM d
), leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || shown[2:]) AS leaf,
      sha256(head || coalesce(strlen(claim::VARCHAR) || ':' || claim, '-') || shown[2:]) AS claimed_leaf
    FROM claimed
), ranked AS (
    SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS id,
      dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves
), nodes(tree, level, n, pos, h) AS (
    SELECT tree, 0, count(*) OVER (PARTITION BY tree), pos, leaf FROM ranked
    UNION ALL
    SELECT tree, level + 1, (n + 1) // 2, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1
    GROUP BY tree, level, n, pos // 2
), crown(level, n, pos, h) AS (
    SELECT 0, count(*) OVER (), tree, h FROM nodes WHERE n = 1
    UNION ALL
    SELECT level + 1, (n + 1) // 2, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM crown WHERE n > 1 GROUP BY level, n, pos // 2
), steps AS (
    SELECT r.id, l.level AS k, CASE WHEN s.pos < r.pos >> l.level THEN s.h ELSE '' END || '|' ||
      CASE WHEN s.pos > r.pos >> l.level THEN s.h ELSE '' END AS step
    FROM ranked r JOIN (SELECT DISTINCT tree, level FROM nodes WHERE n > 1) l USING (tree)
    LEFT JOIN nodes s ON s.tree = r.tree AND s.level = l.level AND s.pos = xor(r.pos >> l.level, 1)
    UNION ALL
    SELECT r.id, 1000 + l.level, CASE WHEN s.pos < r.tree >> l.level THEN s.h ELSE '' END || '|' ||
      CASE WHEN s.pos > r.tree >> l.level THEN s.h ELSE '' END
    FROM ranked r CROSS JOIN (SELECT DISTINCT level FROM crown WHERE n > 1) l
    LEFT JOIN crown s ON s.level = l.level AND s.pos = xor(r.tree >> l.level, 1)
), paths AS (
    SELECT id, list(coalesce(step, '|') ORDER BY k) AS path FROM steps GROUP BY id
), proved AS (
    SELECT r.doc_id, r.leaf, c.h AS subroot, (SELECT h FROM crown WHERE n = 1) AS root,
      sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
      list_reduce(list_prepend(r.claimed_leaf, coalesce(path, [])), lambda h, s:
        sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root
    FROM ranked r JOIN crown c ON c.level = 0 AND c.pos = r.tree LEFT JOIN paths p USING (id)
)
SELECT *, folded_root = root AS verified FROM proved
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": OP5, "op9_embedding_duplicates": OP9, "op12_merkle": OP12}
