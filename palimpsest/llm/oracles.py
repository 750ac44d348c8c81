"""DuckDB SQL for the queries that SQL can express, on tables of unique ids.

The others are tested against brute force: op1, op3, op4 and op9 need a tokenizer
or a network, op7's added spans need its trained model, op10 is approximate.
"""

from __future__ import annotations

from . import line_dedup

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_RUN = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, {_WORD}), []) AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOW}, {_WORD}) AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM i WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, list_slice(w, s, s + 12) AS p FROM s),
n AS (SELECT DISTINCT len(p) AS n FROM p),
x AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM d, n WHERE len(w) >= n),
h AS (SELECT doc_id, s, n, item_id FROM (SELECT doc_id, s, n, list_slice(w, s, s + n - 1) AS p FROM x) JOIN p USING (p)),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM h) GROUP BY 1),
f AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN f USING (doc_id)
"""

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, {_RUN}), []) AS w FROM documents),
x AS (SELECT doc_id, s, hash(list_slice(w, s, s + 34)) AS h, md5(array_to_string(list_slice(w, s, s + 34), ' ')) AS m
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS s FROM d WHERE len(w) >= 35)),
r AS (SELECT doc_id, s FROM x QUALIFY count(*) OVER (PARTITION BY h, m) > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM r),
k AS (SELECT doc_id, pos, w[pos] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS pos FROM d) q ANTI JOIN g USING (doc_id, pos)),
t AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS kept FROM k GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""

NGRAM_JOIN = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOW}, {_RUN}), []) AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, s, s + 4), ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b, k, x.n AS na, y.n AS nb FROM b JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * k >= 8 * (x.n + y.n - k)),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS class_id FROM r GROUP BY 1),
l AS (SELECT a, count(*) AS links, count(*) FILTER (WHERE k = na AND k = nb) AS copies FROM e GROUP BY 1)
SELECT d.doc_id, class_id, coalesce(links, 0)::BIGINT AS n_links, (coalesce(copies, 0) + 1)::BIGINT AS n_copies, coalesce(n.n, 0)::BIGINT AS n_grams
FROM d JOIN c ON c.a = d.doc_id LEFT JOIN l ON l.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

SQL = {
    "op2_decontaminate": DECONTAMINATE,
    "op5_ngram_join": NGRAM_JOIN,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op8_line_dedup": line_dedup.SQL,
}
