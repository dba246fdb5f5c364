"""SQL for the text operators that SQL can express: plain joins over all windows, for tables of moderate size."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({low('text')}, '{WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i + 4] END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY 1),
links AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, COUNT(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, MIN(b) AS m FROM reach GROUP BY 1) USING (doc_id)
"""

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({low('text')}, '{ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({low('text')}, '{ALNUM}') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, CASE WHEN len(w) < 10 THEN w ELSE w[i:i + 9] END AS g FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT len(g) AS k FROM windows),
places AS (SELECT r, k, i, w[i:i + k - 1] AS g FROM (SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, lengths WHERE len(w) >= k)),
found AS (SELECT r, i, k, item_id FROM places JOIN windows USING (g)),
hits AS (SELECT r, COUNT(*) AS n FROM (SELECT DISTINCT r, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT r, i, k FROM found)) GROUP BY 1),
items AS (SELECT r, COUNT(*) AS n, string_agg(t, ',' ORDER BY t) AS t FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM found) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(items.t, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

DEBRUIJN = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w FROM documents),
windows AS (SELECT r, i, w[i:i + 34] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT r, i FROM (SELECT r, i, COUNT(*) OVER (PARTITION BY g) AS c FROM windows) WHERE c > 1),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM twice),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t, COUNT(*) AS n FROM words ANTI JOIN gone USING (r, p) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
