"""SQL for DuckDB of the operators that it can express, over whole tables."""

#: Operator 2. The rank order of a source is taken whole here; the constants are those of ``mix``.
MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('1|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')) AS y FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source
), w AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM s
), f AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER before, 0)::DOUBLE AS words_left,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS weight_left
  FROM w WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT *, words_left * weight / weight_left >= 2.0 * source_size AS stopped FROM f
), t AS (
  SELECT source, source_size, n_docs, CASE WHEN stopped THEN 2.0::DOUBLE * source_size ELSE
    (SELECT first(words_left / weight_left ORDER BY source_size / weight, source NULLS LAST) FROM g WHERE NOT stopped) * weight END AS target
  FROM g
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::BIGINT ELSE 0 END AS whole FROM t
), r AS (
  SELECT *, greatest(target - whole * source_size, 0.0) AS rest FROM u
), o AS (
  SELECT d.doc_id, d.source, d.size, d.y, r.source_size, r.target, r.whole, r.rest,
    least(greatest(r.rest / r.source_size, 1e-9::DOUBLE), 1 - 1e-9::DOUBLE) AS p,
    (('0x' || substr(md5('1|' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS x,
    r.source_size / r.n_docs AS mean
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
), q AS (
  SELECT *, x / (1 - x) / (p / (1 - p) * pow(greatest(size, 1)::DOUBLE / greatest(mean, 1.0::DOUBLE), 0.25)) AS odds FROM o
), n AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY odds, y) AS place FROM q
), k AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place)::DOUBLE AS upto FROM n
), c AS (
  SELECT *, max(CASE WHEN upto <= rest OR (upto - size < rest AND abs(upto - rest) <= abs(upto - size - rest)) THEN place END) OVER (PARTITION BY source) AS last_place FROM k
)
SELECT doc_id, size, source_size, target,
  (least(whole + CASE WHEN rest > 0 AND place <= last_place THEN 1 ELSE 0 END, 2) * size)::BIGINT AS taken
FROM c
"""

#: Operator 3. Windows are compared as text: words hold no blanks.
DECONTAMINATE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), wide AS (
  SELECT item_id, words, least(len(words), 10) AS n FROM b WHERE len(words) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(words[i : i + n - 1], ' ') AS gram FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM wide)
), lengths AS (
  SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, n, i, array_to_string(words[i : i + n - 1], ' ') AS gram FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, lengths WHERE len(words) >= n)
), found AS (
  SELECT doc_id, i, grams.n, item_id FROM grams JOIN windows USING (n, gram)
), hits AS (
  SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS word FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS name FROM found) GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

#: Operator 6. Strings of 50 bytes as hex digits, taken from blocks of 1,024 bytes with the 49 that follow.
REPEATS = """
WITH b AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT doc_id, off, substr(h, 2 * off + 1, 2 * (1024 + 49)) AS part FROM (SELECT *, unnest(range(0, len(h) // 2, 1024)) AS off FROM b)
), grams AS (
  SELECT doc_id, off + i AS p, substr(part, 2 * i + 1, 100) AS gram FROM (SELECT *, unnest(range(0, least(1024, len(part) // 2 - 49))) AS i FROM blocks)
), firsts AS (
  SELECT gram, min(doc_id) AS low FROM grams GROUP BY gram HAVING min(doc_id) < max(doc_id)
), marks AS (
  SELECT DISTINCT doc_id, p FROM grams JOIN firsts USING (gram) WHERE doc_id > low
), steps AS (
  SELECT *, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS step FROM marks
), numbered AS (
  SELECT *, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps
), runs AS (
  SELECT doc_id, run, min(p) AS a, max(p) + 50 AS z FROM numbered GROUP BY doc_id, run
), cut AS (
  SELECT doc_id, h, a, coalesce(a, len(h) // 2) AS upto, coalesce(z, len(h) // 2) AS z,
    coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since,
    lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS is_last
  FROM b LEFT JOIN runs USING (doc_id)
), kept AS (
  SELECT doc_id, any_value(len(h)) // 2 AS n_bytes, sum(CASE WHEN a IS NULL THEN 0 ELSE z - a END) AS n_removed, count(a) AS n_spans,
    string_agg(substr(h, 2 * since + 1, 2 * (upto - since)) || CASE WHEN is_last THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS rest
  FROM cut GROUP BY doc_id
)
SELECT doc_id, n_bytes::BIGINT AS n_bytes, n_removed::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""

#: Operator 10. All pairs of vectors of one width that have a cosine; what links reach, step by step.
EMBEDDINGS = """
WITH RECURSIVE raw AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), vectors AS (
  SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS norm FROM raw WHERE list_dot_product(v, v) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.95
), reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reached.vec_id, links.b FROM reached JOIN links ON reached.other = links.a
), component AS (
  SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), degree AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN degree USING (vec_id) LEFT JOIN component USING (vec_id)
"""


def _spans(kind: str, place: int, pattern: str, keep: str) -> str:
    """Matches of a pattern with their starts: the lengths of the gaps and matches before them."""
    return f"""SELECT doc_id, '{kind}' AS kind, {place} AS k, a, a + len(f) AS z FROM (
  SELECT doc_id, found[i] AS f, list_sum(list_transform(gaps[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: len(x))), 0) AS a FROM (
    SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps FROM d))) WHERE {keep}"""


ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: The base spans of operator 5.
SECRETS = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  {_spans("assign", 0, ASSIGN, f"len(regexp_extract(f, '{ASSIGN}', 1)) >= 12")}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "len(f) >= 18")}
  UNION ALL {_spans("hex", 2, "[0-9a-f]+", "len(f) >= 16")}
), g AS (
  SELECT doc_id, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex,
    string_agg(kind || ':' || a::BIGINT || ':' || z::BIGINT, ',' ORDER BY a, k) AS base_spans
  FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  coalesce(base_spans, '') AS base_spans, sha256(coalesce(base_spans, '')) AS base_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


def _centroids(k: int = 16, rounds: int = 3, width: int = 64, scale: int = 64) -> str:
    """Operator 13: squared distances of whole numbers are exact in doubles here."""
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)) AS v FROM embeddings WHERE len(embedding) = {width} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))))",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS k, v AS c FROM kept QUALIFY k < {k})",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT rn, vec_id, v, arg_min(k, (d, k)) AS k, min(d)::BIGINT AS distance FROM (SELECT rn, vec_id, v, k, list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS d FROM kept CROSS JOIN c{r}) GROUP BY ALL)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT k, i, sum(x::BIGINT)::BIGINT AS s, count(*)::BIGINT AS n FROM (SELECT k, unnest(v) AS x, unnest(range({width})) AS i FROM a{r}) GROUP BY ALL)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT k, coalesce(m, c) AS c FROM c{r} LEFT JOIN (SELECT k, list(((s - (((s % n) + n) % n)) // n)::DOUBLE ORDER BY i) AS m FROM s{r} GROUP BY k) USING (k))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a{rounds}.k::INT AS cluster, distance, sum(distance) OVER (PARTITION BY a{rounds}.k)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(list_transform(c, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (k)"""


CENTROIDS = _centroids()

# Operator 12: the crc32 by its table of 256 remainders; near words by equal strings after a deletion.
SPELLING = """
WITH RECURSIVE tbl AS MATERIALIZED (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i))),
runs AS (SELECT rn, id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT row_number() OVER () AS rn, coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents)),
dist AS MATERIALIZED (SELECT id, run, sum(1) AS n, hex(encode(id || ':' || run)) AS code FROM runs WHERE length(run) >= 7 GROUP BY id, run),
sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(code) // 2), lambda i: ('0x' || substr(code, (2 * i + 1)::BIGINT, 2))::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS h FROM dist CROSS JOIN tbl),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
cuts AS MATERIALIZED (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
less AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cuts c JOIN words w ON w.word = c.cut),
near AS MATERIALIZED (SELECT a, b FROM less UNION SELECT b, a FROM less UNION SELECT x.word, y.word FROM cuts x JOIN cuts y ON x.i = y.i AND x.cut = y.cut AND x.word <> y.word),
best AS (SELECT a AS word, count(*) AS n_near, arg_min({'b': b, 'n': n}, (-n, b)) AS f FROM near JOIN words ON word = b GROUP BY 1),
forms AS MATERIALIZED (SELECT w.word, CASE WHEN f.n >= 10 * w.n THEN f.b END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN f.n >= 10 * w.n THEN f.n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS here, 0 AS k FROM forms UNION ALL SELECT walk.word, forms.form, k + 1 FROM walk JOIN forms ON forms.word = walk.here WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(here, k) AS root FROM walk GROUP BY 1) USING (word)
"""
