"""DuckDB SQL that gives the rows of the registered queries whose method SQL can express."""

from __future__ import annotations

#: A-Z to a-z only, as the contracts say.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

ORACLES = {
    "op10_benchmark_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all({_LOWER.format("text")}, '{_ALNUM}') AS w FROM benchmark
      WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, least(len(w), 8) AS m, array_to_string(w[i : i + least(len(w), 8) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g
       FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n_hit, 0)::BIGINT AS n_hit, coalesce(items.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(items.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_quality_rules": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM dup) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
f AS (SELECT d.doc_id, t, w, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l.l) - len(list_distinct(l.l)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN l USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 100 * n_symbols > 25 * n_words
            OR 100 * n_dup_lines > 50 * len(string_split(t, chr(10)))
            OR word_chars < 2.0 * n_words OR word_chars > 14.0 * n_words
            OR 100 * length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) > 60 * length(regexp_replace(t, '[^\p{L}]', '', 'g'))
            OR 100 * len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) < 60 * n_words) AS kept
FROM b""",
    "op6_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM g),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE first < doc_id)),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT x.doc_id, string_agg(x.w[x.p], ' ' ORDER BY x.p) AS t, count(*) AS n FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.p = gone.p GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_ngram_jaccard_join": r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
c AS (SELECT w, min(doc_id) AS class_id, count(*) AS n_copies FROM d GROUP BY w),
s AS (SELECT DISTINCT class_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT class_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM c WHERE len(w) > 0)),
n AS (SELECT class_id, count(*) AS n FROM s GROUP BY class_id),
both_ AS (SELECT a.class_id AS x, b.class_id AS y, count(*) AS m FROM s a JOIN s b ON a.s = b.s AND a.class_id <> b.class_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n a ON a.class_id = x JOIN n b ON b.class_id = y WHERE 5 * m >= 4 * (a.n + b.n - m)),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x),
reach(a, b) AS (SELECT class_id, class_id FROM c UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x),
groups AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a)
SELECT doc_id, c.class_id, c.n_copies::BIGINT AS n_copies, coalesce(degree.n, 0)::BIGINT AS n_links, group_id
FROM d JOIN c ON d.w = c.w JOIN groups ON groups.a = c.class_id LEFT JOIN degree ON degree.x = c.class_id""",
    "op9_suffix_array_dedup": r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
w AS (SELECT doc_id, i, substr(h, (2 * i + 1)::BIGINT, 200) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS i FROM d WHERE n >= 100)),
f AS (SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY g) AS first FROM w),
later AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM f WHERE first <> {'d': doc_id, 'i': i}),
runs AS (SELECT doc_id, i, sum((before IS NULL OR i > before + 100)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM later),
gone AS (SELECT doc_id, min(i) AS lo, max(i) + 100 AS hi FROM runs GROUP BY doc_id, run),
parts AS (SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS a, lo AS b FROM gone UNION ALL SELECT doc_id, max(hi), NULL FROM gone GROUP BY doc_id),
kept AS (SELECT parts.doc_id, string_agg(substr(h, (2 * a + 1)::BIGINT, (2 * (coalesce(b, n) - a))::BIGINT), '' ORDER BY a) AS k FROM parts JOIN d ON d.doc_id = parts.doc_id GROUP BY parts.doc_id),
sums AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM gone GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id""",
}
