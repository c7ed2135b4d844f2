"""DuckDB SQL for those of the queries whose rows it can say in full."""

from __future__ import annotations

OP3 = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS payload_digest FROM p),
w AS (SELECT payload_digest AS sha, max(page_id) AS winner FROM d WHERE payload_bytes >= 1000 AND page_id IS NOT NULL GROUP BY payload_digest),
r AS (SELECT d.*, CASE WHEN page_id <> winner OR row_number() OVER (PARTITION BY payload_digest, page_id) > 1 THEN winner END AS refers_to
  FROM d LEFT JOIN w ON payload_digest = sha AND payload_bytes >= 1000 AND page_id IS NOT NULL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r"""

OP4 = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + 4], ' ') for i in generate_series(1, len(w) - 4)]) END AS s FROM words),
flat AS (SELECT doc_id, len(s)::BIGINT AS n, unnest(s) AS shingle FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS c FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT x, y FROM pairs WHERE 100 * c >= 80 * (n + m - c)),
ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
lowest AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id FROM sets LEFT JOIN lowest ON doc_id = x"""

#: Seats go one by one to the highest quotients here; every seat that a party might win is a row.
OP6 = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  ('0x' || left(md5('17:' || coalesce(doc_id::VARCHAR, ':' || md5(coalesce(text, '')))), 15))::BIGINT AS mark FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [1, 2, 3][(place - 1) % 3 + 1] AS weight, 3.0 * source_size::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s),
v AS (SELECT *, (total - coalesce((SELECT sum(cap) FROM w b WHERE (b.cap / b.weight, b.place) < (w.cap / w.weight, w.place)), 0))
  / (SELECT sum(weight) FROM w b WHERE (b.cap / b.weight, b.place) >= (w.cap / w.weight, w.place)) AS level FROM w),
t AS (SELECT source, place, source_size, total, coalesce(least(cap, weight * (SELECT arg_min(level, (cap / weight, place)) FROM v WHERE level <= cap / weight)), 0.0) AS target,
  greatest(1, total // 1000000) AS block, greatest(1, ceil(source_size / 2000000.0))::BIGINT AS parts FROM v),
g AS (SELECT *, round(total / block) AS seats, sum(target) OVER () AS targets, count(*) OVER () AS n FROM t),
q AS (SELECT source, unnest(generate_series(1, (seats * target / targets + n + 2)::BIGINT)) AS seat, target, place, seats FROM g WHERE target > 0),
won AS (SELECT source, count(*) AS quota FROM (SELECT source, seats, row_number() OVER (ORDER BY target / (2 * seat - 1) DESC, place) AS r FROM q) WHERE r <= seats GROUP BY source),
h AS (SELECT t.source, mark % parts AS shard, coalesce(quota, 0) AS quota, block, sum(size) AS words FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN won ON won.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
k AS (SELECT *, sum(words) OVER (PARTITION BY source) AS of_source, count(*) OVER (PARTITION BY source) AS n FROM h),
z AS (SELECT source, shard, unnest(generate_series(1, (quota * words / of_source + n + 2)::BIGINT)) AS seat, words::DOUBLE AS words, quota FROM k WHERE words > 0),
got AS (SELECT source, shard, count(*) AS blocks FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY words / (2 * seat - 1) DESC, shard) AS r FROM z) WHERE r <= quota GROUP BY ALL),
take AS (SELECT h.source, h.shard, words, least(coalesce(blocks, 0) * block, 3 * words) AS take FROM h LEFT JOIN got ON got.source IS NOT DISTINCT FROM h.source AND got.shard = h.shard),
line AS (SELECT d.doc_id, d.size, t.source_size, t.target, take.words, take.take,
  coalesce(sum(d.size) OVER (PARTITION BY d.source, mark % parts ORDER BY mark, d.doc_id NULLS FIRST, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source JOIN take ON take.source IS NOT DISTINCT FROM d.source AND take.shard = mark % parts)
SELECT doc_id, size, source_size, target, (CASE WHEN words > 0 THEN take // words * size + greatest(0, least(size, take % words - before)) ELSE 0 END)::BIGINT AS taken FROM line"""

OP11 = r"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + 9], ' ') AS key FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM items WHERE len(w) > 0)),
met AS (SELECT doc_id, i, k, item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS key FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM words, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)) JOIN windows USING (k, key)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM met WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""


def _codes() -> str:
    """Four rounds of assignment and of means, a few common tables each."""
    near = """a{0} AS (SELECT vec_id, label, part, v, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (SELECT k.*, entry, list_sum(list_transform(generate_series(1, len(v)), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT AS d
  FROM cut k JOIN b{0} USING (part)) GROUP BY ALL)"""
    mean = """m{0} AS (SELECT part, entry, y, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS y FROM a{0}) GROUP BY ALL),
b{1} AS (SELECT part, entry, coalesce(n, c) AS c FROM b{0} LEFT JOIN (SELECT part, entry, list(x ORDER BY y) AS n FROM m{0} GROUP BY ALL) USING (part, entry))"""
    steps = [near.format(0)]
    for k in range(4):
        steps += [mean.format(k, k + 1), near.format(k + 1)]
    return ",\n".join(steps)


OP12 = f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
size AS (SELECT max(len(w)) // 4 AS s FROM kept), cut AS (SELECT vec_id, label, part, w[part * s + 1:part * s + s] AS v FROM kept, size, (SELECT unnest([0, 1, 2, 3]) AS part)),
b0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
{_codes()},
whole AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4),
coded AS (SELECT vec_id, label, string_agg(lpad(lower(hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded, whole"""

SQL = {"op3_warc": OP3, "op4_ngram_join": OP4, "op6_mixing": OP6, "op11_decontamination": OP11, "op12_vector_codes": OP12}
