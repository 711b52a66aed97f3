"""DuckDB SQL for the queries that SQL can express."""

NEAR_DUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (
  SELECT a AS doc_id, a AS r FROM both_ways
  UNION
  SELECT both_ways.b, reach.r FROM reach JOIN both_ways ON both_ways.a = reach.doc_id WHERE reach.r < both_ways.b),
comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(least(comp.component_id, d.doc_id), d.doc_id) AS component_id,
       coalesce(least(comp.component_id, d.doc_id), d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""

EXACT_DEDUP = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""

DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i+least(len(ws), 10)-1], ' ') AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM b WHERE len(ws) > 0)),
x AS (
  SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(ws) >= n)),
hit AS (SELECT x.doc_id, x.i, x.n, p.item_id FROM x JOIN p ON x.n = p.n AND x.w = p.w),
covered AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_NEAR = """SELECT vec_id, p, min(d * 64 + e) AS m FROM (
  SELECT x.vec_id, x.p, c.e, ((x.v[1] - c.v[1]) ** 2 + (x.v[2] - c.v[2]) ** 2 + (x.v[3] - c.v[3]) ** 2 + (x.v[4] - c.v[4]) ** 2)::HUGEINT AS d
  FROM x JOIN {book} c USING (p)) GROUP BY vec_id, p"""
_MOVED = """SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM {book} c LEFT JOIN (
  SELECT x.p, (m % 64)::BIGINT AS e, [floor(sum(v[1])::DOUBLE / count(*))::BIGINT, floor(sum(v[2])::DOUBLE / count(*))::BIGINT, floor(sum(v[3])::DOUBLE / count(*))::BIGINT, floor(sum(v[4])::DOUBLE / count(*))::BIGINT] AS v
  FROM x JOIN {near} USING (vec_id, p) GROUP BY 1, 2) m ON m.p = c.p AND m.e = c.e"""
#: For vectors of 64 components.
VECTOR_CODES = f"""
WITH kept AS (
  SELECT vec_id, label, [floor(256 * y::DOUBLE)::BIGINT FOR y IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
x AS (SELECT vec_id, p::BIGINT AS p, q[4 * p + 1:4 * p + 4] AS v FROM kept, range(16) t(p)),
c0 AS (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM x WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
n0 AS ({_NEAR.format(book="c0")}),
c1 AS ({_MOVED.format(book="c0", near="n0")}),
n1 AS ({_NEAR.format(book="c1")}),
c2 AS ({_MOVED.format(book="c1", near="n1")}),
n2 AS ({_NEAR.format(book="c2")}),
coded AS (SELECT vec_id, string_agg(printf('%02x', (m % 64)::BIGINT), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM n2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(concat_ws(',', v[1], v[2], v[3], v[4]), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), books
"""

COLLOCATIONS = r"""
WITH p AS (
  SELECT lang, regexp_extract_all(body, '[^\x20\x09]+') AS ws
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS body FROM documents)),
f AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS a
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM p, range(1, 4) t(k) WHERE len(ws) >= k) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10),
cuts AS (
  SELECT lang, phrase, j, array_to_string(ws[1:j], ' ') AS x, array_to_string(ws[j + 1:k], ' ') AS y
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
  SELECT lang, phrase, j, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts JOIN c USING (lang, phrase) JOIN f x ON x.lang = cuts.lang AND x.phrase = cuts.x JOIN f y ON y.lang = cuts.lang AND y.phrase = cuts.y),
least_cut AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_phrase AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, array_to_string(ws[i:i + 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, 3)) AS i FROM c WHERE k = 3)) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, c.a DESC, phrase) AS rank, phrase, c.a, l, r, n, score
FROM c JOIN least_cut USING (lang, phrase) JOIN n USING (lang) LEFT JOIN inner_phrase i USING (lang, phrase)
WHERE i.a IS NULL OR 100 * i.a < 50 * c.a
QUALIFY rank <= 2000
"""
