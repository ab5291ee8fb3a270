"""DuckDB statements of the registered queries that SQL can express over whole tables."""

STATEMENTS: dict[str, str] = {}

STATEMENTS["op1_decontamination"] = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS t FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words),
runs AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t FROM places, sizes WHERE i + n - 1 <= len(w)),
hits AS (SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, t)),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

#: crc32 by its definition (reflected polynomial 0xEDB88320) over the bytes in hex; near words by what one deletion leaves.
STATEMENTS["op11_spelling_variants"] = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(range(0, 9), lambda c, s: CASE WHEN s = 0 THEN i WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c
    FROM (SELECT unnest(range(0, 256)) AS i))),
raw AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
runs AS (
  SELECT translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run,
    coalesce(CAST(doc_id AS VARCHAR), '') || ':' || translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS keyed
  FROM raw WHERE length(r) >= 6),
digits AS (SELECT run, keyed, hex(encode(keyed)) AS x, count(*) AS times FROM runs GROUP BY 1, 2),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(
    list_transform(range(0, length(x) // 2),
      lambda i: (instr('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1),
    lambda c, b: xor(c // 256, crc[xor(c % 256, b) + 1]), 4294967295)) AS h
  FROM digits, crc_table),
words AS (
  SELECT word, CAST(sum(times) AS BIGINT) AS n
  FROM (SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(times) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
longer AS (SELECT DISTINCT cut.word AS a, words.word AS b FROM cut JOIN words ON words.word = head || tail),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b USING (head, tail) WHERE a.word <> b.word
  UNION SELECT a, b FROM longer UNION SELECT b, a FROM longer),
near AS (
  SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS top, max(n) AS top_n FROM pairs JOIN words ON words.word = pairs.b GROUP BY 1),
forms AS (
  SELECT word, CASE WHEN top_n >= 5 * n THEN top END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 5 * n THEN top_n END AS form_n
  FROM words LEFT JOIN near USING (word)),
chains AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, steps) AS root FROM chains GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

#: Brute force. The search finds all neighbours where its least window covers the table, as at the sizes that are compared.
STATEMENTS["op13_nearest_neighbours"] = r"""
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(range(1, 65), lambda s, i: s + (q.v[i] - c.v[i]) * (q.v[i] - c.v[i]), CAST(0 AS DOUBLE))) AS score
  FROM vectors q, vectors c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INT) AS rank, vec_id, score FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score, vec_id) QUALIFY rank <= 10
"""

STATEMENTS["op3_substring_dedup"] = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM starts),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS turn FROM windows) WHERE turn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
places AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

#: Bytes as pairs of hex digits; runs of starts at most 200 apart make one removed span.
STATEMENTS["op4_suffix_array_dedup"] = r"""
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
starts AS (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199)) AS i FROM bytes WHERE length(x) >= 400),
windows AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 400)) AS t FROM starts),
shared AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY t) AS n FROM windows) WHERE n > 1),
marked AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS head FROM shared),
numbered AS (SELECT doc_id, i, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
runs AS (SELECT doc_id, run, min(i) AS s, max(i) + 200 AS e FROM numbered GROUP BY 1, 2),
edges AS (SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS free FROM runs),
spans AS (
  SELECT doc_id, count(*) AS n_spans, sum(e - s) AS n_removed, max(e) AS last,
    string_agg(substr(x, CAST(2 * free + 1 AS BIGINT), CAST(2 * (s - free) AS BIGINT)), '' ORDER BY s) AS before
  FROM edges JOIN bytes USING (doc_id) GROUP BY 1)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(before, '') || substr(x, CAST(2 * coalesce(last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM bytes LEFT JOIN spans USING (doc_id)
"""

#: All pairs. The operator's recall is audited; at the compared sizes it finds every link.
STATEMENTS["op10_embedding_near_dedup"] = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
sized AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM usable),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sized a JOIN sized b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (a.size * b.size) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
