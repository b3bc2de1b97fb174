"""DuckDB SQL for the queries that SQL can express; written from the contracts, not from the operators."""

_SPACE = r"[\x20\x09-\x0D]"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINES = rf"""
WITH lines AS (
  SELECT doc_id, coalesce(text, '') AS text, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line, {_FOLD.format(f"regexp_replace(line, '^{_SPACE}+|{_SPACE}+$', '', 'g')")} AS key FROM lines),
held AS (
  SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE owner IS NOT NULL AND owner <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE owner IS NULL OR owner = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN held USING (key) GROUP BY doc_id
"""

EXACT = rf"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '{_SPACE}', '', 'g') AS norm FROM documents),
best AS (
  SELECT norm, first(doc_id ORDER BY n_chars DESC, doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN best USING (norm)
"""

MIX = rf"""
WITH s AS (
  SELECT doc_id, source, text, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(list_extract([5, 2, 1], CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)) AS BIGINT) AS w
  FROM s GROUP BY source),
r AS (
  SELECT *, coalesce(sum(3 * source_size) OVER before, 0) AS capped, sum(w) OVER after AS share, (SELECT sum(source_size) FROM t) AS whole
  FROM t WINDOW before AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                after AS (ORDER BY 3.0 * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
cut AS (
  SELECT whole - capped AS rest, share FROM r WHERE w * (whole - capped) <= 3 * source_size * share ORDER BY 3.0 * source_size / w, source LIMIT 1),
g AS (
  SELECT source, source_size, CASE WHEN w * cut.rest > 3 * source_size * cut.share THEN CAST(3 * source_size AS DOUBLE)
         ELSE CAST(w AS DOUBLE) * CAST(cut.rest AS DOUBLE) / CAST(cut.share AS DOUBLE) END AS target FROM t, cut),
b AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM g),
p AS (
  SELECT s.doc_id, s.size, b.source_size, b.target, b.budget, b.epochs,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY sha256('mix:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null') || ':' || sha256(coalesce(s.text, ''))), s.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s JOIN b ON s.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(budget - epochs * source_size - before, size)) AS BIGINT) AS taken FROM p
"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) END AS s FROM w),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
link AS (SELECT x, y FROM pairs UNION ALL SELECT y, x FROM pairs),
reach AS (SELECT doc_id AS x, doc_id AS y FROM sets UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM sets JOIN low ON doc_id = x
"""

REPEATS = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, greatest(len(w) - 33, 1))) AS pos, w FROM d),
marked AS (SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 34), ' ')) AS m FROM windows),
again AS (SELECT m FROM marked GROUP BY m HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM marked SEMI JOIN again USING (m)),
gone AS (SELECT doc_id, list(pos) AS pos FROM hit GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, d.w, coalesce(len(g.pos), 0) AS n, g.pos AS pos FROM d LEFT JOIN gone g USING (doc_id)),
each AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
stay AS (
  SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.pos) AS t FROM each e ANTI JOIN hit USING (doc_id, pos) GROUP BY e.doc_id)
SELECT k.doc_id, CAST(len(k.w) AS BIGINT) AS n_words, CAST(k.n AS BIGINT) AS n_removed, sha256(coalesce(s.t, '')) AS kept_sha256
FROM kept k LEFT JOIN stay s USING (doc_id)
"""

ORACLES = {"op5_substring_dedup": REPEATS, "op1_line_dedup": LINES, "op4_exact_dedup": EXACT, "op9_mixing": MIX, "op10_ngram_jaccard": JACCARD}
