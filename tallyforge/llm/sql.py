"""DuckDB SQL for the queries that SQL can express."""

OP1 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[]
                             WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                             ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END) AS s
  FROM words
), sizes AS MATERIALIZED (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * i >= 80 * (p.n + q.n - i)
), edges AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, edges.b FROM reach JOIN edges ON reach.other = edges.a
)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""

ORACLE = {
    "op1_jaccard_join": OP1,
}


def _quality_sql() -> str:
    """The rules and the estimation of operator 4, its rounds unrolled."""
    from .quality_rules import ITERATIONS, LEAST, MAX_REPEAT_PERCENT, MIN_WORDS, MOST, RULES, START_KEEP, START_REJECT

    rules = range(len(RULES))
    vote = [f"CAST({when} AS INTEGER) AS v{j}" for j, (_, _, when) in enumerate(RULES)]
    names = ", ".join(f"v{j}" for j in rules)

    def posterior() -> str:
        terms = (f"{'-' if keep else ''}v{j} * ln(a{j} / (1.0::DOUBLE - a{j}))" for j, (_, keep, _) in enumerate(RULES))
        return f"1.0::DOUBLE / (1.0::DOUBLE + exp({' + '.join(terms)}))"

    steps = [f"a0 AS MATERIALIZED (SELECT {', '.join(f'{START_KEEP if keep else START_REJECT}::DOUBLE AS a{j}' for j, (_, keep, _) in enumerate(RULES))})"]
    for t in range(ITERATIONS):
        new = []
        for j, (_, keep, _) in enumerate(RULES):
            right = "q" if keep else "(1.0::DOUBLE - q)"
            new.append(f"greatest({LEAST}::DOUBLE, least({MOST}::DOUBLE, (coalesce(sum(n * v{j} * {right}), 0) + 1.0::DOUBLE) / (coalesce(sum(n * v{j}), 0) + 2.0::DOUBLE))) AS a{j}")
        steps.append(f"a{t + 1} AS MATERIALIZED (SELECT {', '.join(new)} FROM (SELECT p.*, {posterior()} AS q FROM patterns p, a{t}))")
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), split AS MATERIALIZED (
  SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM texts
), threes AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM split WHERE len(w) >= 3
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM threes
), repeated AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM windows, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id
), counts AS MATERIALIZED (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(text, '[^\p{{L}}]+', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(text, '[^!]+', '', 'g')) AS BIGINT) AS n_bangs
  FROM split LEFT JOIN repeated USING (doc_id)
), voted AS MATERIALIZED (
  SELECT *, {', '.join(vote)} FROM counts
), patterns AS MATERIALIZED (
  SELECT {names}, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY ALL
), {', '.join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND posterior >= 0.5 AS kept
FROM (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed, {posterior()} AS posterior FROM voted, a{ITERATIONS})
"""


ORACLE["op4_quality_rules"] = _quality_sql()


ORACLE["op2_decontaminate"] = r"""
WITH doc_words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item_words AS MATERIALIZED (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0)
), runs AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS MATERIALIZED (
  SELECT doc_id, item_id, i, n FROM runs JOIN windows USING (n, s)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR)) FILTER (item_id IS NOT NULL)), ',') AS items FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""


ORACLE["op6_backoff_lm"] = r"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), words AS MATERIALIZED (
  SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM texts
), total AS (SELECT count(*) AS n FROM words
), grams AS MATERIALIZED (
  SELECT doc_id, i, w AS g1, lag(w) OVER p || ' ' || w AS g2, lag(w, 2) OVER p || ' ' || lag(w) OVER p || ' ' || w AS g3, lag(w) OVER p AS h2, lag(w, 2) OVER p || ' ' || lag(w) OVER p AS h3
  FROM words WINDOW p AS (PARTITION BY doc_id ORDER BY i)
), own AS MATERIALIZED (
  SELECT doc_id, g, count(*) AS m FROM (SELECT doc_id, unnest([g1, g2, g3]) AS g FROM grams) WHERE g IS NOT NULL GROUP BY doc_id, g
), every AS MATERIALIZED (SELECT g, sum(m) AS c FROM own GROUP BY g
), others AS MATERIALIZED (SELECT doc_id, g, c - m AS c FROM own JOIN every USING (g)
), found AS (
  SELECT x.doc_id, least(i, 3) AS longest, greatest(1, n - len(t.w)) AS rest, a1.c AS c1, a2.c AS c2, a3.c AS c3, b2.c AS d2, b3.c AS d3
  FROM grams x CROSS JOIN total JOIN texts t ON t.doc_id = x.doc_id JOIN others a1 ON a1.doc_id = x.doc_id AND a1.g = g1
  LEFT JOIN others a2 ON a2.doc_id = x.doc_id AND a2.g = g2 LEFT JOIN others a3 ON a3.doc_id = x.doc_id AND a3.g = g3
  LEFT JOIN others b2 ON b2.doc_id = x.doc_id AND b2.g = h2 LEFT JOIN others b3 ON b3.doc_id = x.doc_id AND b3.g = h3
), scored AS (
  SELECT doc_id, count(*) FILTER (CASE longest WHEN 3 THEN c3 = 0 WHEN 2 THEN c2 = 0 ELSE c1 = 0 END) AS n_backoff,
         sum(CASE WHEN c3 > 0 THEN log10(c3::DOUBLE / d3) WHEN c2 > 0 THEN (longest - 2) * log10(0.4) + log10(c2::DOUBLE / d2)
                  WHEN c1 > 0 THEN (longest - 1) * log10(0.4) + log10(c1::DOUBLE / rest) ELSE longest * log10(0.4) - log10(rest) END) AS s
  FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_backoff, 0) AS BIGINT) AS n_backoff, round(s / len(w), 6) AS score
FROM texts LEFT JOIN scored USING (doc_id)
"""

ORACLE["op7_url_filter"] = r"""
WITH parts AS MATERIALIZED (
  SELECT page_id, nullif(lower(regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '')), '') AS host,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)) AS path,
         TIMESTAMP '2024-01-01 12:00:00' + to_days(CAST((page_id * 7919) % 366 AS INTEGER)) AS fetched_at
  FROM pages
), hosts AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 7) AS BIGINT) AS c FROM (SELECT DISTINCT host FROM parts WHERE host IS NOT NULL)
), domains AS (
  SELECT domain, CAST('0x' || substr(md5(domain), 1, 7) AS BIGINT) AS c
  FROM (SELECT DISTINCT array_to_string(string_split(host, '.')[-3:], '.') AS domain FROM hosts)
), prefixes AS (
  SELECT prefix, CAST('0x' || substr(md5(prefix), 1, 7) AS BIGINT) AS c
  FROM (SELECT DISTINCT host || '/' || string_split(path, '/')[2] AS prefix FROM parts WHERE host IS NOT NULL)
  WHERE prefix IS NOT NULL AND prefix NOT LIKE '%/'
), entries AS (
  SELECT 'host' AS kind, host AS value, 'add' AS action, TIMESTAMP '2024-01-01' + to_days(CAST(c % 200 AS INTEGER)) AS moment FROM hosts WHERE c % 3 = 0
  UNION ALL SELECT 'host', host, 'remove', TIMESTAMP '2024-01-01' + to_days(CAST(c % 200 + 30 + c % 50 AS INTEGER)) FROM hosts WHERE c % 6 = 0
  UNION ALL SELECT 'host', host, 'add', TIMESTAMP '2024-01-01' + to_days(CAST(c % 200 + 120 AS INTEGER)) FROM hosts WHERE c % 12 = 0
  UNION ALL SELECT 'domain', domain, 'add', TIMESTAMP '2024-01-01' + to_days(CAST(c % 300 AS INTEGER)) FROM domains WHERE c % 5 = 0
  UNION ALL SELECT 'prefix', prefix, 'add', TIMESTAMP '2024-01-01' + to_days(CAST(c % 366 AS INTEGER)) FROM prefixes WHERE c % 7 = 0
), changed AS (
  SELECT * FROM (SELECT *, lag(action) OVER (PARTITION BY kind, value ORDER BY moment) AS before FROM entries) WHERE action IS DISTINCT FROM before
), spans AS (
  SELECT kind, value, moment AS valid_from, upto AS valid_to FROM (SELECT *, lead(moment) OVER (PARTITION BY kind, value ORDER BY moment) AS upto FROM changed) WHERE action = 'add'
), keys AS (
  SELECT page_id, fetched_at, 'host' AS kind, host AS value FROM parts WHERE host IS NOT NULL
  UNION ALL SELECT page_id, fetched_at, 'domain', array_to_string(string_split(host, '.')[i:], '.') FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM parts WHERE host IS NOT NULL)
  UNION ALL SELECT page_id, fetched_at, 'prefix', host || '/' || array_to_string(s[1:i], '/')
  FROM (SELECT *, unnest(range(1, len(s) + 1)) AS i FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS s FROM parts WHERE host IS NOT NULL))
), listed AS (
  SELECT page_id, count(*) AS n, min(valid_from) AS since FROM keys JOIN spans USING (kind, value)
  WHERE valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to) GROUP BY page_id
)
SELECT page_id AS capture_id, host, fetched_at, coalesce(n, 0) > 0 AS blocked, coalesce(n, 0) AS n_entries, since AS blocked_since
FROM parts LEFT JOIN listed USING (page_id)
"""

ORACLE["op11_line_dedup"] = r"""
WITH whole AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS MATERIALIZED (
  SELECT doc_id, unnest(range(0, len(l))) AS place, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM whole)
), keyed AS MATERIALIZED (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), first AS MATERIALIZED (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS MATERIALIZED (
  SELECT doc_id, place, line, first IS NOT NULL AND doc_id <> first AS dropped FROM keyed LEFT JOIN first USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLE["op13_fill_in_middle"] = r"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
units AS MATERIALIZED (
  SELECT doc_id, text, CASE WHEN text = '' THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') END AS u,
    CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2, CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM hashed
), cuts AS (
  SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS MATERIALIZED (
  SELECT doc_id, text, n, form, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
