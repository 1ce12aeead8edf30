"""DuckDB SQL for the operators that SQL expresses, written independently of their code."""

OP7 = """
WITH parted AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM parted),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first_doc FROM keyed WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.doc_id, k.line, k.pos, f.first_doc IS NOT NULL AND f.first_doc <> k.doc_id AS dropped
           FROM keyed k LEFT JOIN firsts f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP10 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(source, '') AS source_key, source IS NULL AS no_source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS order_key
  FROM documents),
sources AS (
  SELECT no_source, source_key, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY no_source, source_key) - 1) % 3 + 1]::DOUBLE AS weight,
         row_number() OVER (ORDER BY no_source, source_key) AS place
  FROM sized GROUP BY no_source, source_key),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0))
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM sources
  WINDOW before AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, least(3.0 * source_size,
                  weight * (SELECT arg_min(level, source_size / weight) FROM levels l WHERE l.level * l.weight <= 3.0 * l.source_size)) AS target,
         3 * ((source_size + 15) // 16) AS most
  FROM levels),
quotas AS (
  SELECT place, count(*) AS quota FROM (
    SELECT place FROM (SELECT place, target, unnest(range(most)) AS k FROM targets)
    ORDER BY target / (2 * k + 1) DESC, place
    LIMIT (SELECT CAST(floor(sum(source_size) / 16.0 + 0.5) AS BIGINT) FROM sources))
  GROUP BY place),
placed AS (
  SELECT s.*, t.place, t.source_size, t.target,
         CAST('0x' || substr(order_key, 1, 8) AS BIGINT)
           % CAST(least(greatest(1, ceil(t.source_size / 100000.0)), 4096) AS BIGINT) AS shard
  FROM sized s JOIN targets t USING (no_source, source_key)),
shards AS (
  SELECT place, source_key, shard, CAST(sum(size) AS BIGINT) AS shard_size, CAST((sum(size) + 15) // 16 AS BIGINT) AS blocks
  FROM placed GROUP BY ALL),
shard_quotas AS (
  SELECT place, shard, count(*) AS shard_quota FROM (
    SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY CAST(shard_size AS DOUBLE) / (2 * k + 1) DESC, shard) AS n
    FROM (SELECT place, shard, shard_size, unnest(range(3 * blocks)) AS k FROM shards)) r
  JOIN quotas USING (place) WHERE n <= quota GROUP BY place, shard),
ran AS (
  SELECT p.*, h.blocks, coalesce(q.shard_quota, 0) AS shard_quota,
         sum(p.size) OVER (PARTITION BY p.place, p.shard ORDER BY p.order_key, p.doc_id, p.size
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stop
  FROM placed p JOIN shards h ON p.place = h.place AND p.shard = h.shard
  LEFT JOIN shard_quotas q ON p.place = q.place AND p.shard = q.shard),
chosen AS (
  SELECT *, stop - size AS start, CASE WHEN blocks > 0 THEN shard_quota // blocks ELSE 0 END AS passes,
         CASE WHEN blocks > 0 THEN shard_quota % blocks ELSE 0 END AS rest,
         CASE WHEN blocks > 0 THEN CAST('0x' || substr(md5('mix:' || source_key || ':' || shard), 1, 8) AS BIGINT) % blocks ELSE 0 END AS first
  FROM ran)
SELECT doc_id, size, source_size, target,
       CAST(passes * size
            + greatest(0, least(stop, 16 * least(first + rest, blocks)) - greatest(start, 16 * first))
            + greatest(0, least(stop, 16 * (first + rest - blocks)) - start) AS BIGINT) AS taken
FROM chosen
"""

OP8 = r"""
WITH RECURSIVE tokens AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM tokens WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
                    GROUP BY x.doc_id, y.doc_id)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.other, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.other, d.doc_id)) AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""

OP5 = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other),
least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(c.n, 0) AS n_links, least(e.vec_id, coalesce(l.other, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(l.other, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN counts c USING (vec_id) LEFT JOIN least l USING (vec_id)
"""

OP6 = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
asked AS (SELECT vec_id, min(v) AS v FROM valid WHERE vec_id % 50 = 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
           FROM asked q JOIN valid c ON q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP4 = """
WITH hexed AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(1, (len(h) // 2) - 198)) AS i, h FROM hexed WHERE len(h) >= 400),
windows AS (SELECT doc_id, i, md5_number(substr(h, 2 * i - 1, 400)) AS w FROM starts),
again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM windows WHERE w IN (SELECT w FROM again)),
parts AS (SELECT doc_id, i, sum(CASE WHEN gap IS NULL OR gap > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM hits),
spans AS (SELECT doc_id, part, min(i) AS a, max(i) + 200 AS b FROM parts GROUP BY doc_id, part),
cuts AS (SELECT s.doc_id, a, b, lead(a) OVER (PARTITION BY s.doc_id ORDER BY a) AS next_a, h FROM spans s JOIN hexed USING (doc_id)),
kept AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         substr(any_value(h), 1, 2 * (min(a) - 1)) || string_agg(substr(h, 2 * b - 1, 2 * (coalesce(next_a, len(h) // 2 + 1) - b)), '' ORDER BY a) AS rest
  FROM cuts GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM hexed LEFT JOIN kept USING (doc_id)
"""


def _op11() -> str:
    """Lloyd rounds as unrolled tables: a(r) assigns every part by the entries e(r), e(r + 1) has the means."""
    apart = "list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = []
    for r in range(7):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT p.vec_id, p.part, arg_min(e.entry, {apart} * 16 + e.entry) AS entry, min({apart}) AS error
  FROM parts p JOIN e{r} e ON p.part = e.part GROUP BY p.vec_id, p.part)""")
        if r < 6:
            steps.append(f"""
m{r} AS MATERIALIZED (
  SELECT part, entry, list(mean ORDER BY k) AS v FROM (
    SELECT part, entry, k, CAST(sum(x) AS BIGINT) // count(*) - CASE WHEN sum(x) < 0 AND sum(x) % count(*) <> 0 THEN 1 ELSE 0 END AS mean
    FROM (SELECT a.part, a.entry, unnest(p.v) AS x, unnest(range(len(p.v))) AS k FROM a{r} a JOIN parts p ON a.vec_id = p.vec_id AND a.part = p.part)
    GROUP BY part, entry, k) GROUP BY part, entry),
e{r + 1} AS MATERIALIZED (SELECT e.part, e.entry, coalesce(m.v, e.v) AS v FROM e{r} e LEFT JOIN m{r} m ON e.part = m.part AND e.entry = m.entry)""")
    return f"""
WITH valid AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT vec_id, part, v[part * (len(v) // 8) + 1 : (part + 1) * (len(v) // 8)] AS v FROM (SELECT vec_id, v, unnest(range(8)) AS part FROM valid)),
first16 AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM valid),
e0 AS MATERIALIZED (SELECT part, entry, v FROM parts JOIN first16 USING (vec_id) WHERE entry < 16),
{",".join(steps)},
coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a6 GROUP BY vec_id),
book AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, k)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(v) AS x, unnest(range(len(v))) AS k FROM e6))
SELECT c.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded c JOIN valid v ON c.vec_id = v.vec_id CROSS JOIN book
"""


OP11 = _op11()

OP12 = r"""
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS first_id FROM words GROUP BY text),
flags AS (
  SELECT w.doc_id, part, {'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w), 'C': 100 * len(regexp_replace(w.text, '[^A-Z]', '', 'g')) > 3 * len(w.text),
          'D': regexp_matches(w.text, '[#$%&*|]'), 'E': coalesce(w.doc_id > first_id, false)} AS f
  FROM words w JOIN firsts USING (text)),
marked AS (
  SELECT part, [f.A, f.B, f.C, f.D, f.E] AS f, l.quality = 1 AS good, l.toxic = 1 AS toxic FROM flags LEFT JOIN labels l USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS letter, list_transform(range(1, step), lambda i: ascii(filter_order[i]) - 64) AS before
          FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM orders)),
counted AS (SELECT part, f, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM marked GROUP BY part, f),
judged AS (
  SELECT part, filter_order, step, letter, n, good, toxic, f[letter] AS fails, len(list_filter(before, lambda i: f[i])) > 0 AS gone, len(list_filter(f, lambda x: x)) AS many
  FROM counted, steps),
told AS (
  SELECT part, filter_order, CAST(step AS INT) AS step, letter,
         coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE fails AND many = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (WHERE fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM judged GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM told
"""

OP13 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
placed AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
found AS (SELECT doc_id, i, p.n, item_id FROM placed p JOIN windows w ON p.s = w.s AND p.n = w.n),
hits AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list_distinct(list(CAST(item_id AS VARCHAR)))) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
