"""DuckDB SQL of the operators that SQL can express."""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), " \
         r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
b AS (SELECT item_id, coalesce({_WORDS.format('text')}, []) AS w FROM benchmark),
bw AS (SELECT item_id, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p, w FROM b WHERE len(w) > 0),
bk AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS k FROM bw),
lens AS (SELECT DISTINCT n FROM bk),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS p, w FROM d, lens WHERE len(w) >= n),
dk AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS k FROM dw),
hit AS (SELECT DISTINCT doc_id, dk.n, p, item_id FROM dk JOIN bk ON dk.k = bk.k AND dk.n = bk.n),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::varchar, ',' ORDER BY item_id::varchar) AS l
          FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
       sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP8 = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_WORDS.format('text')}, []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 4], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 5 * c >= 4 * (nx.n + ny.n - c)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y)
SELECT doc_id, (SELECT min(y) FROM reach WHERE x = doc_id) AS class_id,
       (SELECT count(*) FROM l WHERE x = doc_id)::bigint AS n_links, doc_id = (SELECT min(y) FROM reach WHERE x = doc_id) AS kept
FROM documents
"""

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN l ON l.x = r.y),
c AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n.n, 0)::bigint AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""

OP9 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, md5_number(substr(h, 2 * p + 1, 800)) AS k
      FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399)) AS p FROM d WHERE length(h) >= 800)),
twice AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
r AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap FROM w WHERE k IN (SELECT k FROM twice)),
s AS (SELECT doc_id, p, sum(CASE WHEN gap <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM r),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM s GROUP BY doc_id, span),
cut AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS n FROM spans GROUP BY doc_id),
j AS (SELECT d.doc_id, h, coalesce(a, []) AS a, coalesce(b, []) AS b, coalesce(n, 0) AS n FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, (length(h) // 2)::bigint AS n_bytes, n::bigint AS n_removed, len(a)::bigint AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(0, len(a) + 1),
         lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE b[i] END) + 1,
                          2 * ((CASE WHEN i = len(a) THEN length(h) // 2 ELSE a[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE b[i] END)))), ''))) AS kept_sha256
FROM j
"""

OP11 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
    ELSE 2 + length(role) + 6 * len(regexp_extract_all(role, '[^A-Za-z0-9_.-]')) END
  + length('### : ') + length(text) + len(regexp_extract_all(text, '### |</turn>')) + length('</turn>') + 2 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::bigint AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::bigint AS formatted_chars
FROM t GROUP BY conv_id
"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::int AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
"""

OP13 = r"""
WITH t AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(x, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(p) AS x FROM t)),
g AS (SELECT lang, k, w[i:i + k - 1] AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, g, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a)::bigint AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= 30),
cut AS (SELECT c.lang, c.g, c.k, c.a, j, x.a AS l, y.a AS r, ((2000000 * c.a::hugeint) // (x.a::hugeint + y.a))::bigint AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1:j] JOIN f y ON y.lang = c.lang AND y.g = c.g[j + 1:c.k]),
low AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
sub AS (SELECT lang, g[i:i + m - 1] AS g, max(a) AS longer
  FROM (SELECT lang, g, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
s AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN sub USING (lang, g)
  WHERE longer IS NULL OR 100 * longer::hugeint < 80 * a::hugeint)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM s JOIN n USING (lang) QUALIFY rank <= 2000
"""

SQL: dict[str, str] = {"op1_embedding_near_dedup": OP1, "op8_ngram_jaccard_join": OP8, "op9_substring_dedup": OP9,
                       "op4_benchmark_decontamination": OP4, "op11_chat_format": OP11, "op12_hard_negatives": OP12,
                       "op13_collocations": OP13}
