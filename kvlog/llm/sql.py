"""DuckDB SQL for those corpus queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS (
  SELECT x, y, c = nx.n AND c = ny.n AS same FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
  WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-6
  UNION ALL
  SELECT a.doc_id, b.doc_id, true FROM d a JOIN d b ON len(a.w) = 0 AND len(b.w) = 0 AND a.doc_id <> b.doc_id
),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT d.doc_id, (SELECT min(y) FROM reach WHERE x = d.doc_id) AS class_id,
  least(d.doc_id, coalesce((SELECT min(y) FROM link WHERE x = d.doc_id AND same), d.doc_id)) AS set_id,
  (SELECT count(*) FROM link WHERE x = d.doc_id) AS n_links
FROM d
"""

OP10 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)
),
f AS (SELECT g, min(doc_id) AS m FROM p GROUP BY g),
gone AS (SELECT DISTINCT p.doc_id, unnest(range(i, i + 13)) AS j FROM p JOIN f USING (g) WHERE p.doc_id > m),
w AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM d),
k AS (
  SELECT doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY w.j) FILTER (gone.j IS NULL) AS kept
  FROM w LEFT JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

ORACLES = {
    "op1_ngram_jaccard": OP1,
    "op10_substring_dedup": OP10,
}
