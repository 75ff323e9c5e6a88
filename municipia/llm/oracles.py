"""DuckDB SQL for the operators that SQL can express, over the whole tables."""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, w[s:s + 12] AS words FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
runs AS (SELECT r, p, list(word) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS words FROM words),
sizes AS (SELECT DISTINCT len(words) AS n FROM windows),
found AS (SELECT r, p, n, item_id FROM (SELECT r, p, n, words[1:n] AS words FROM runs, sizes WHERE len(words) >= n) JOIN windows USING (words)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS p FROM found) GROUP BY r),
items AS (SELECT r, list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM found WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items, sha256(coalesce(list_aggregate(ids, 'string_agg', ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, w[s:s + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id AS origin, doc_id AS node FROM d UNION SELECT origin, b FROM reached JOIN edges ON a = node)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least_id AS component_id
FROM d LEFT JOIN sized USING (doc_id) JOIN (SELECT origin, min(node) AS least_id FROM reached GROUP BY origin) ON origin = d.doc_id
"""

_PLAIN = r"regexp_replace(lower(piece), '\b(?:19|20)[0-9][0-9]\b|[^\p{L}\p{N}]+', ' ', 'g')"


def license_scan(templates: dict[str, str]) -> str:
    values = ", ".join("('{}', '{}')".format(k, t.replace("'", "''")) for k, t in templates.items())
    grams = lambda source: f"SELECT *, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM (SELECT *, list_filter(string_split({_PLAIN}, ' '), lambda x: x <> '') AS w FROM {source})"
    return rf"""
WITH templates AS ({grams(f"(SELECT * FROM (VALUES {values}) AS v(template, piece))")}),
pieces AS (SELECT doc_id, unnest(string_split(text, chr(10)) || list_filter(regexp_split_to_array(text, '\n(?:[^\p{{L}}\p{{N}}\n]*\n)+'), lambda p: contains(p, chr(10)))) AS piece FROM documents WHERE text IS NOT NULL),
parts AS ({grams("pieces")}),
scored AS (SELECT doc_id, template, 2.0 * len(list_intersect(p.g, t.g)) / (len(p.g) + len(t.g)) AS dice FROM parts p JOIN templates t ON 6 * len(p.g) >= 4 * len(t.g) AND 4 * len(p.g) <= 6 * len(t.g))
SELECT doc_id, template, count(*) AS n_parts, max(dice)::DOUBLE AS best_dice FROM scored WHERE dice >= 0.8 GROUP BY ALL
"""
