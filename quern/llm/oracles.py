"""DuckDB SQL for the results of the corpus queries that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_ALNUM = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2 = """
WITH RECURSIVE ids AS (SELECT DISTINCT coalesce(doc_id, 0) AS id FROM documents),
a AS (SELECT id, ((id::HUGEINT + 18446744073709551616 + 11400714819323198485) % 18446744073709551616)::UBIGINT AS x FROM ids),
b AS (SELECT id, ((xor(x, x >> 30)::UHUGEINT * 13787848793156543929) % 18446744073709551616)::UBIGINT AS x FROM a),
c AS (SELECT id, ((xor(x, x >> 27)::UHUGEINT * 10723151780598845931) % 18446744073709551616)::UBIGINT AS x FROM b),
k AS (SELECT id, xor(x, x >> 31) AS key FROM c),
j AS (
    SELECT id, n, key AS state, -1::BIGINT AS spot, 0::BIGINT AS ahead FROM k, (SELECT unnest([40, 41]) AS n)
    UNION ALL
    SELECT id, n, s AS state, ahead AS spot, floor((ahead + 1) * (2147483648.0::DOUBLE / ((s >> 33) + 1)::DOUBLE))::BIGINT AS ahead
    FROM (SELECT *, ((state::UHUGEINT * 2862933555777941757 + 1) % 18446744073709551616)::UBIGINT AS s FROM j WHERE ahead < n)
),
p AS (SELECT id, max(spot) FILTER (n = 40) AS shard, max(spot) FILTER (n = 41) AS grown FROM j GROUP BY id),
t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
h AS (SELECT DISTINCT text, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
l AS (SELECT text, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bytes FROM h),
crc AS (SELECT text, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) AS crc FROM l, t),
d AS (SELECT d.doc_id, (coalesce(strlen(d.text), 0) + 16)::BIGINT AS size, coalesce(crc.crc, 0)::BIGINT AS text_crc32, p.shard::INT AS shard, p.grown::INT AS grown_shard, k.key
    FROM documents d JOIN p ON p.id = coalesce(d.doc_id, 0) JOIN k ON k.id = p.id LEFT JOIN crc ON crc.text = d.text)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY key, text_crc32, size) - 1 AS slot, grown_shard FROM d
"""

OP4 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ') || ' '] ELSE [] END AS s FROM w),
class AS (SELECT min(doc_id) AS node, s, count(*) AS copies FROM sets WHERE len(s) > 0 GROUP BY s),
e AS (SELECT node, len(s) AS n, copies, unnest(s) AS g FROM class),
x AS (SELECT a.node AS a, b.node AS b, a.n AS na, b.n AS nb, any_value(a.copies) AS ca, any_value(b.copies) AS cb, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
link AS (SELECT a, b, ca, cb FROM x WHERE 100 * c >= 75 * (na + nb - c)),
edges AS (SELECT a, b, cb AS c FROM link UNION ALL SELECT b, a, ca FROM link),
reach AS (SELECT node AS a, node AS b FROM class UNION SELECT r.a, l.b FROM reach r JOIN edges l ON r.b = l.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
deg AS (SELECT a AS node, sum(c) AS d FROM edges GROUP BY 1)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(comp.component, s.doc_id) AS component_id, coalesce(deg.d, 0)::BIGINT + coalesce(class.copies - 1, 0) AS n_links
FROM sets s LEFT JOIN class ON class.s = s.s LEFT JOIN comp ON comp.node = class.node LEFT JOIN deg ON deg.node = class.node
"""

OP5 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
"""

OP6 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len({_WORDS.format('text')}), 0)::BIGINT AS size, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h FROM documents),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM g),
fill AS (  -- caps a source for good once the shares of what the capped ones leave reach its cap
    SELECT 0 AS step, list(struct_pack(source := source, weight := weight, most := most, capped := false)) AS rows, sum(source_size)::BIGINT AS total, -1::BIGINT AS before, 0::BIGINT AS now FROM r
    UNION ALL
    SELECT step + 1, list_transform(rows, lambda x: struct_pack(source := x.source, weight := x.weight, most := x.most, capped := x.capped OR (total - coalesce(list_sum(list_transform(rows, lambda y: CASE WHEN y.capped THEN y.most ELSE 0 END)), 0)) * x.weight
        >= x.most * coalesce(list_sum(list_transform(rows, lambda y: CASE WHEN y.capped THEN 0 ELSE y.weight END)), 0))), total, now, len(list_filter(rows, lambda x: x.capped))
    FROM fill WHERE step < 2 OR before <> now
),
f AS (SELECT unnest(rows) AS x, total - list_sum(list_transform(rows, lambda y: CASE WHEN y.capped THEN y.most ELSE 0 END))::BIGINT AS open, list_sum(list_transform(rows, lambda y: CASE WHEN y.capped THEN 0 ELSE y.weight END))::BIGINT AS weights FROM fill QUALIFY step = max(step) OVER ()),
t AS (SELECT x.source AS source, CASE WHEN x.capped THEN x.most::DOUBLE ELSE (open * x.weight)::DOUBLE / greatest(weights, 1)::DOUBLE END AS target FROM f),
p AS (SELECT g.source, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, floor(target - whole * source_size)::BIGINT AS budget FROM p),
c AS (SELECT d.*, b.source_size, b.target, b.whole, b.budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS upto, sum(d.size) OVER (PARTITION BY d.source, d.h) AS own FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
l AS (SELECT *, min(CASE WHEN upto > budget AND own > 0 THEN h END) OVER (PARTITION BY source) AS edge FROM c)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN budget > 0 AND (h < edge OR (h = edge AND own < 2 * (budget - upto + own))) THEN 1 ELSE 0 END))::BIGINT AS taken FROM l
"""

OP8 = f"""
WITH i AS (SELECT item_id, {_ALNUM.format(_LOWER)} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g FROM i, range(1, 100000) r(k) WHERE len(w) > 0 AND k <= len(w) - least(10, len(w)) + 1),
d AS (SELECT doc_id, {_ALNUM.format(_LOWER)} AS w FROM documents),
n AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda k: struct_pack(k := k, g := array_to_string(w[k : k + m - 1], ' ')))) AS x FROM d, n WHERE len(w) >= m),
hit AS (SELECT doc_id, pos.m, x.k AS k, item_id FROM pos JOIN win ON win.m = pos.m AND win.g = pos.x.g),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP9 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
p AS (SELECT r, unnest(list_transform(range(1, len(w) - 33), lambda k: struct_pack(k := k, g := md5(array_to_string(w[k : k + 34], ' '))))) AS x FROM d WHERE len(w) >= 35),
twice AS (SELECT x.g AS g FROM p GROUP BY 1 HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(x.k, x.k + 35)) AS k FROM p JOIN twice ON p.x.g = twice.g),
own AS (SELECT r, list(k) AS ks, count(*) AS n FROM gone GROUP BY 1),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY k) AS t FROM (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM d) ANTI JOIN gone USING (r, k) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN own USING (r) LEFT JOIN kept USING (r)
"""

OP10 = f"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM documents), c AS (SELECT -row_number() OVER () AS r, coalesce({_WORDS.format(_LOWER)}, []) AS w FROM conversations),
tok AS (SELECT r, generate_subscripts(w, 1) AS k, unnest(w) AS w FROM (SELECT r, w FROM b UNION ALL SELECT r, w FROM c)),
known AS (SELECT w FROM tok GROUP BY 1 HAVING count(*) >= 2),
m AS (SELECT r, k, known.w AS w FROM tok LEFT JOIN known USING (w)),
uni AS (SELECT w, count(*) FILTER (r > 0) AS b, count(*) FILTER (r < 0) AS t FROM m GROUP BY 1),
size AS (SELECT sum(b) AS b, sum(t) AS t, count(w) AS v FROM uni),
pair AS (SELECT a.r, z.k, a.w AS v, z.w AS w FROM m a JOIN m z ON a.r = z.r AND z.k = a.k + 1),
bi AS (SELECT v, w, count(*) FILTER (r > 0) AS b, count(*) FILTER (r < 0) AS t FROM pair GROUP BY ALL),
head AS (SELECT v, sum(b) AS b, sum(t) AS t FROM bi GROUP BY 1),
q AS (SELECT m.r, m.w, (uni.b + 1) / (size.b + size.v + 1) AS lb, (uni.t + 1) / (size.t + size.v + 1) AS lt, coalesce(head.b, 0) AS hb, coalesce(head.t, 0) AS ht, coalesce(bi.b, 0) AS bb, coalesce(bi.t, 0) AS bt
    FROM m JOIN uni ON m.w IS NOT DISTINCT FROM uni.w JOIN size ON true LEFT JOIN pair ON pair.r = m.r AND pair.k = m.k LEFT JOIN head ON pair.r IS NOT NULL AND head.v IS NOT DISTINCT FROM pair.v LEFT JOIN bi ON pair.r IS NOT NULL AND bi.v IS NOT DISTINCT FROM pair.v AND bi.w IS NOT DISTINCT FROM pair.w WHERE m.r > 0),
s AS (SELECT r, count(*) AS n, count(*) - count(w) AS u, avg(-ln(CASE WHEN ht > 0 THEN 0.7::DOUBLE * bt / ht + 0.3::DOUBLE * lt ELSE lt END)) AS t, avg(-ln(CASE WHEN hb > 0 THEN 0.7::DOUBLE * bb / hb + 0.3::DOUBLE * lb ELSE lb END)) AS b FROM q GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(u, 0) AS n_unknown, round(coalesce(t, 0), 6) AS loss_target, round(coalesce(s.b, 0), 6) AS loss_background, round(coalesce(t - s.b, 0), 6) AS score FROM b LEFT JOIN s USING (r)
"""

#: By the number of the query.
SQL = {2: OP2, 4: OP4, 5: OP5, 6: OP6, 8: OP8, 9: OP9, 10: OP10}
