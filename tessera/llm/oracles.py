"""DuckDB SQL for the dealt queries that SQL can express."""

from __future__ import annotations

_FOLD = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
placed AS (SELECT *, CAST('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size || ':mix'), 1, 15) AS BIGINT) AS ord FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, ([3, 1, 2])[(pos % 3) + 1]::BIGINT AS w FROM s),
r AS (SELECT *, source_size::DOUBLE * 2 / w AS ratio FROM w),
lv AS (SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5 - (coalesce(sum(source_size) OVER (ORDER BY ratio, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)::DOUBLE)
         / sum(w) OVER (ORDER BY ratio, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS lvl FROM r),
stop AS (SELECT ratio AS sr, pos AS sp, lvl AS sl FROM lv WHERE ratio >= lvl ORDER BY ratio, pos LIMIT 1),
t AS (SELECT source, source_size, pos, CASE WHEN sr IS NULL OR ratio < sr OR (ratio = sr AND pos < sp) THEN source_size::DOUBLE * 2 ELSE w * sl END AS target FROM lv LEFT JOIN stop ON true),
m AS (SELECT *, CAST(round(target * 1000000) AS BIGINT) AS micro FROM t),
g AS (SELECT *, CAST(sum(micro) OVER (ORDER BY pos) AS BIGINT) AS hi FROM m),
k AS (SELECT greatest(16, least(1024, sum(source_size)::BIGINT // 65536)) AS block, sum(micro)::BIGINT AS total FROM g),
n AS (SELECT block, total, CAST(round(total::DOUBLE / 1000000 / block) AS BIGINT) AS slots FROM k),
u AS (SELECT i AS id, total, CAST(((i + 1)::HUGEINT * 2850178704830799621) % 4611686018427387904 AS BIGINT)::DOUBLE AS x FROM n, range(slots) q(i)),
p AS (SELECT id, CAST(floor(x / 4611686018427387904::DOUBLE * total::DOUBLE) AS BIGINT) AS at FROM u),
c AS (SELECT g.pos, count(*) AS blocks FROM p JOIN g ON p.at >= g.hi - g.micro AND p.at < g.hi GROUP BY g.pos),
l AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.pos,
        CAST(sum(d.size) OVER (PARTITION BY g.pos ORDER BY d.ord, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM placed d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  CAST(greatest(0, least(start + size, coalesce(blocks, 0) * block) - start)
     + greatest(0, least(start + size, coalesce(blocks, 0) * block - source_size) - start) AS BIGINT) AS taken
FROM l LEFT JOIN c USING (pos), n
"""

OP4 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, coalesce(regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT dw.r, dw.i, dw.m, bw.item FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT r, i, m FROM hit)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""

OP7 = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents WHERE text IS NOT NULL),
n AS (SELECT doc_id, text, list(x ORDER BY i) AS xs, list(i ORDER BY i) AS ix, list(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) ORDER BY i) AS ws
      FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id, text),
w AS (SELECT doc_id, text, ix[s] AS start, ix[s : s + r - 1] AS lines, xs[s : s + r - 1] AS body
      FROM (SELECT *, unnest(range(1, len(xs) - r + 2)) AS s FROM n, range(1, 4) lengths(r) WHERE len(xs) >= r) WHERE r = 3 OR list_sum(ws[s : s + r - 1]) > 50),
f AS (SELECT body, min((doc_id, start)) AS first FROM w GROUP BY body),
g AS (SELECT DISTINCT doc_id, text, unnest(lines) AS i FROM w JOIN f USING (body) WHERE (doc_id, start) > first),
k AS (SELECT l.doc_id, l.text, string_agg(l.x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS kept, count(g.i) AS n_removed
      FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.text = g.text AND l.i = g.i GROUP BY l.doc_id, l.text)
SELECT d.doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON d.doc_id = k.doc_id AND d.text = k.text
"""

OP9 = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
best AS (SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM u, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN regexp_matches(host, '(^|[.-])(ad|adnxs|ads|adserver|adservice|adsystem|adtech|advert|adverts|affiliate|banner|banners|beacon|clickserve|clicktrack|doubleclick|googlesyndication|outbrain|pixel|popads|popunder|scorecardresearch|taboola|telemetry|tracker|trackers|tracking)[.-]') THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN best USING (page_id)
"""
