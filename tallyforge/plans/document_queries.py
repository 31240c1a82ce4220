"""Queries over pages, documents, notes and search, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import constants as K
from tallyforge.functions.text import ACCENTED, PLAIN, fold
from tallyforge.operators import documents as docs
from tallyforge.operators import evidence, matching, search
from tallyforge.operators import notes as notes_of
from tallyforge.sources.shared import checkpointed
from tallyforge.sources.tables import CONTENTS, MARKER, NOTE_TITLES, OTHER_WORDS, REPORT, lines, note_pages, notes, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
TOPICS = K.TOPIC_RULES
#: Words that occur in the test prose, in place of the Spanish defaults.
KEYWORDS = ("that", "with", "une", "und", "los")
QUERY = '"of the" -with or "de la"'


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _fold_sql(c: str) -> str:
    return rf"lower(trim(regexp_replace(translate({c}, '{ACCENTED}', '{PLAIN}'), '[ \t\n\v\f\r]+', ' ', 'g')))"


def _key_sql(c: str) -> str:
    return f"trim(regexp_replace({_fold_sql(c)}, '[^a-z0-9]+', ' ', 'g'))"


_list = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_NOTES = f"""notes AS MATERIALIZED (SELECT doc_id, source || '-' || CAST(doc_id // 2000 AS VARCHAR) AS company, lang AS scope, CAST(2024 + doc_id // 20 % 2 AS INTEGER) AS fiscal_year,
    {_list(NOTE_TITLES)}[doc_id // 40 % {len(NOTE_TITLES)} + 1] || CASE WHEN doc_id // 20 % 10 = 1 THEN ' ' || {_list(OTHER_WORDS)}[doc_id // 40 % {len(OTHER_WORDS)} + 1] ELSE '' END AS title, text,
    CAST(row_number() OVER (PARTITION BY source, doc_id // 2000, lang, doc_id // 20 % 2 ORDER BY doc_id) AS INTEGER) AS note_number FROM documents)"""
_LINES = "lines AS MATERIALIZED (SELECT doc_id, unnest(range(0, len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


def _noted(s, d):
    found = notes(table(s, d, "documents")).withColumn("topic", docs.topic(F.col("title"), TOPICS))
    return found.withColumn("is_priority", F.col("topic") != "other")


def _topic_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f'''contains({_fold_sql(c)}, '{t}')''' for t in terms)} THEN '{name}'" for name, terms in TOPICS) + " ELSE 'other' END"


@_query(r"""WITH raw AS (SELECT page_id, url, unnest(range(0, len(h))) AS ord, unnest(h) AS href FROM (SELECT page_id, url, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)),
    l AS (SELECT page_id, ord, regexp_replace(CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href LIKE '//%' THEN regexp_extract(url, '^(https?:)', 1) || href
      WHEN href LIKE '/%' THEN regexp_extract(url, '^(https?://[^/?#]*)', 1) || href ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '([^/:])/[^/]*$', '\1') || '/' || href END, '#.*$', '') AS link FROM raw WHERE href <> '' AND href NOT LIKE '#%'),
    k AS (SELECT page_id, link, min(ord) AS ord FROM l WHERE regexp_extract(link, '^https?://([^/?#]*)', 1) <> '' AND NOT contains(regexp_extract(link, '^https?://([^/?#]*)', 1), '@') AND NOT contains(regexp_replace(regexp_extract(link, '^https?://([^/?#]*)', 1), ':443$', ''), ':') GROUP BY ALL)
    SELECT page_id, CAST(rank AS INTEGER) AS rank, link FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY contains(lower(link), 'the') DESC, link) AS rank FROM k) WHERE rank <= 12""")
def link_discovery(s, d):
    """OP-14 and OP-83; twelve links a page are the operator's own limit."""
    return docs.link_discovery(table(s, d, "pages"), words=("the",))


@_query(rf"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_replace({_fold_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, '[^a-z0-9]', '', 'g') AS title_key,
    CAST(len(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) AS INTEGER) AS entries, CAST(len(list_distinct(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1))) AS INTEGER) AS labels FROM pages""")
def form_extract(s, d):
    return docs.form_extract(table(s, d, "pages")).select("page_id", "title", "title_key", "entries", F.size("links").alias("labels"))


_plain_sql = lambda c: f"replace(replace(replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;', '&')"
_squash_sql = lambda c: f"regexp_replace({_fold_sql(c)}, '[^a-z0-9]', '', 'g')"


@_query(rf"""WITH a AS (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1) AS l FROM pages),
    o AS (SELECT page_id, i, h[i] AS code, trim({_plain_sql("l[i]")}) AS label FROM (SELECT page_id, h, l, unnest(range(1, len(l) + 1)) AS i FROM a)),
    m AS (SELECT w.page_id, count(*) AS n, min({_plain_sql("o.code")}) AS code FROM o w JOIN o ON o.page_id = w.page_id AND {_squash_sql("o.label")} = {_squash_sql("w.label")} WHERE w.i = 1 GROUP BY 1),
    x AS (SELECT page_id, count(*) AS n, min(label) FILTER (i = 1) AS name, least(12, count(DISTINCT CASE WHEN i % 3 <> 0 THEN trim({_plain_sql("code")}) END)) AS files FROM o GROUP BY 1)
    SELECT a.page_id, x.name, CAST(m.n AS INTEGER) AS matches, CASE WHEN m.n = 1 THEN m.code END AS code, CAST(x.n AS INTEGER) AS options, {_plain_sql("url")} AS address, CAST(x.files AS INTEGER) AS files
    FROM a JOIN x USING (page_id) JOIN m USING (page_id)""")
def form_match(s, d):
    """OP-15: each page's links stand as the options of its form; the page asks for its first label.  Every third attachment is XBRL; twelve files a page are the operator's own limit."""
    pages = table(s, d, "pages")
    found = lambda k: F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">([^<]*)</a>'), F.lit(k))
    both = F.zip_with(found(1), found(2), lambda h, t: F.struct(h.alias("h"), t.alias("t")))
    options = F.array_join(F.transform(both, lambda x: F.concat(F.lit('<option value="'), x["h"], F.lit('">'), x["t"], F.lit("</option>"))), "")
    title = lambda i: F.when(i % 3 == 2, "Xbrl").otherwise("Pdf")
    files = F.array_join(F.transform(both, lambda x, i: F.concat(F.lit('<a id="grid_files" title="'), title(i), F.lit('" href="'), x["h"], F.lit('">'))), "")
    form = F.concat(F.lit('<input type="hidden" name="address" value="old"><input type="text" name="free" value="x"><input type="hidden" name="address" value="'), F.col("url"), F.lit('"><select name="other"><option value="1">x</option></select><select name="company">'), options, F.lit("</select>"), files)
    forms = docs.form_fields(pages.select("page_id", form.alias("html")), "company", "grid").filter(F.size("options") > 0)
    asked = forms.select("page_id", F.col("options")[0]["label"].alias("name"))
    shown = forms.select("page_id", F.size("options").alias("options"), F.col("hidden")["address"].alias("address"), F.size("links").alias("files"))
    return docs.match_option(forms, asked).join(shown, "page_id")


#: Sentences that first lines of documents get by their id, with the unit that they state in soles ("": not a policy) and its exception.
POLICIES = (
    ("Bases de preparación. Los estados financieros se presentan en miles de soles.", "thousands", None),
    ("Moneda de presentación: estos estados financieros consolidados se expresan en millones de soles, excepto donde se indique de otro modo.", "millions", "excepto donde se indique de otro modo"),
    ("Bases de preparación. Los estados financieros se presentan en miles de soles, salvo los importes por acción.", None, None),
    ("Los estados financieros se presentan en miles de soles.", "", None),
    ("Bases de preparación. Los estados financieros se presentan en miles de dólares.", None, None),
    ("Bases de preparación. Los estados financieros separados se presentan en soles.", None, None),
    ("Bases de preparación. Los estados financieros individuales se expresan en miles de soles, salvo que se indique lo contrario.", "thousands", "salvo que se indique lo contrario"),
    ("Nada.", "", None),
)
SECOND_POLICY = "Moneda de presentación. Los estados financieros se presentan en millones de soles."
_of_id = lambda k: "[" + ", ".join("NULL" if p[k] is None else f"'{p[k]}'" for p in POLICIES) + f"][doc_id % {len(POLICIES)} + 1]"


@_query(f"""WITH p AS (SELECT doc_id, {_of_id(1)} AS one, {_of_id(2)} AS exception, doc_id % 5 = 0 AND contains(text, chr(10)) AS two FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN one = '' THEN 'millions' ELSE one END AS scale, CASE WHEN one = '' THEN 2 ELSE 1 END AS page, exception FROM p WHERE one IS NOT NULL AND (one <> '' OR two) AND NOT (two AND one = 'thousands')""")
def presentation_policy(s, d):
    """OP-90: lines as pages; the first states a unit, the second of every fifth document its own."""
    first = F.element_at(F.array(*(F.lit(p[0]) for p in POLICIES)), (F.pmod("doc_id", F.lit(len(POLICIES))) + 1).cast("int"))
    more = F.when(F.col("line_no") == 0, first).when((F.col("line_no") == 1) & (F.pmod("doc_id", F.lit(5)) == 0), SECOND_POLICY)
    rows = lines(table(s, d, "documents")).select("doc_id", (F.col("line_no") + 1).cast("int").alias("page"), F.concat_ws(" ", "line", more).alias("text"))
    return docs.presentation_policy(rows, "PEN").drop("declaration")


@_query(f"SELECT doc_id, {_fold_sql('text')} AS folded FROM documents")
def fold_text(s, d):
    return table(s, d, "documents").select("doc_id", fold("text").alias("folded"))


@_query(f"WITH {_NOTES} SELECT topic, topic <> 'other' AS is_priority, count(*) AS n FROM (SELECT {_topic_sql('title')} AS topic FROM notes) GROUP BY ALL")
def topic_classify(s, d):
    return _noted(s, d).groupBy("topic", "is_priority").agg(F.count("*").alias("n"))


@_query(f"WITH {_NOTES} SELECT doc_id, company, note_number, topic, left(regexp_replace(text, '\\n+', ' ', 'g'), 320) AS excerpt FROM (SELECT *, {_topic_sql('title')} AS topic FROM notes) WHERE fiscal_year = 2024 AND topic <> 'other'")
def note_list(s, d):
    """OP-25 and OP-81: the priority notes of a year with their excerpts, in order."""
    rows = _noted(s, d).filter("fiscal_year = 2024 and is_priority")
    return rows.select("doc_id", "company", "note_number", "topic", docs.excerpt("text").alias("excerpt")).orderBy("company", "note_number", "doc_id")


_PAGES = f"""n0 AS (SELECT doc_id, doc_id % 12 AS v, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
    n1 AS (SELECT doc_id, v, l[i + 1] AS line, i, CASE WHEN v = 5 AND i < 2 THEN 2 - i WHEN v = 10 AND i >= 5 THEN i + 2 ELSE i + 1 END AS number, {_list(NOTE_TITLES)}[(CASE WHEN v = 5 AND i < 2 THEN 1 - i ELSE i END + doc_id) % {len(NOTE_TITLES)} + 1] AS title FROM (SELECT *, unnest(range(0, len(l))) AS i FROM n0)),
    n2 AS (SELECT *, CASE WHEN v = 3 AND i = 1 THEN 'Título ilegible' ELSE number || CASE WHEN v IN (8, 10, 11) THEN '.' ELSE '' END || ' ' || CASE WHEN v = 6 THEN regexp_replace(title, '^([^ ]+) ', '\\1' || chr(10)) ELSE title END END AS heading FROM n1),
    pages AS MATERIALIZED (SELECT doc_id, CAST(i // 2 + CASE WHEN v < 8 THEN 1 ELSE 0 END AS INTEGER) AS page,
        CASE WHEN i // 2 > 0 AND v % 2 = 1 OR doc_id % 24 = 23 THEN '' WHEN v = 0 THEN 'Empresa S.A.' || chr(10) || '{MARKER}' || chr(10) || 'Expresado en miles' || chr(10) ELSE '{MARKER}' || chr(10) END
        || string_agg(CASE WHEN v = 11 AND i = 6 THEN '{REPORT}' || chr(10) ELSE '' END || heading || chr(10) || line || CASE WHEN v = 4 AND i = 1 THEN chr(10) || heading || chr(10) || 'Encabezado duplicado.' WHEN v = 7 THEN chr(10) || '2 1,500 3,000' || chr(10) || '2.1 Detalle' ELSE '' END, chr(10) ORDER BY i) AS text FROM n2 GROUP BY doc_id, v, i // 2
      UNION ALL SELECT doc_id, 0, '{CONTENTS}' || chr(10) || '{MARKER}' || chr(10) || coalesce(string_agg(number || ' ' || title || ' ..... ' || (i // 2 + 2), chr(10) ORDER BY i) FILTER (NOT (v = 2 AND i = 2)), '') || CASE WHEN v = 1 THEN chr(10) || '2 Otro título ..... 9' ELSE '' END FROM n1 WHERE v < 8 GROUP BY doc_id, v)"""
_HEAD = r"^[ \t]*([0-9]{1,2})(\.?)[ \t]+([^\n]{3,180})"
_APPENDIX = rf"(?i)^[ \t]*(?:{K.APPENDIX_BEGINNINGS})\b"
_clean_sql = lambda c: rf"regexp_replace(trim(regexp_replace({c}, '\s+', ' ', 'g')), '[ –:-]+$', '')"
_plain_text = lambda c: f"lower(translate({c}, '{ACCENTED}', '{PLAIN}'))"
_FOUND = rf"""{_PAGES}, ln AS MATERIALIZED (SELECT doc_id, page, k, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, page ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
      lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3 FROM (SELECT doc_id, page, unnest(range(0, len(x))) AS k, unnest(x) AS line FROM (SELECT doc_id, page, string_split(text, chr(10)) AS x FROM pages)) WINDOW w AS (PARTITION BY doc_id, page ORDER BY k)),
    c0 AS MATERIALIZED (SELECT *, regexp_extract(line, '{_HEAD}', 0) AS own, CAST(regexp_extract(line, '{_HEAD}', 1) AS INTEGER) AS number, regexp_extract(line, '{_HEAD}', 2) = '.' AS dotted, regexp_extract(line, '{_HEAD}', 3) AS raw, {_clean_sql(f"regexp_extract(line, '{_HEAD}', 3)")} AS title FROM ln WHERE regexp_matches(line, '{_HEAD}')),
    contents AS MATERIALIZED (SELECT doc_id, page FROM c0 GROUP BY ALL HAVING count(*) >= 3 AND bool_and(regexp_matches(raw, '\s[0-9]+\s*$'))),
    opens AS MATERIALIZED (SELECT doc_id, min(page) AS opens FROM pages WHERE contains({_plain_text('text')}, '{K.NOTES_MARKER}') AND regexp_matches(text, '(?m)^\s*1[.\s]') AND (doc_id, page) NOT IN (SELECT (doc_id, page) FROM contents) GROUP BY doc_id),
    closes AS MATERIALIZED (SELECT doc_id, min({{'page': page, 'start': start}}) AS closes FROM ln JOIN opens USING (doc_id) WHERE page >= opens AND regexp_matches(line, '{_APPENDIX}') AND (doc_id, page) NOT IN (SELECT (doc_id, page) FROM contents) GROUP BY doc_id),
    cand AS MATERIALIZED (SELECT c0.* EXCLUDE (raw, k), start + length(own) AS fin, (contents.doc_id IS NOT NULL) AS contents, contents.doc_id IS NULL AND coalesce(page >= opens, false) AND (closes IS NULL OR {{'page': page, 'start': start}} < closes) AS scope,
        length(title) BETWEEN 1 AND 120 AND regexp_replace(title, '[. ]+$', '') <> '' AND lower(regexp_extract(regexp_replace(title, '[. ]+$', ''), '([^ ]*)$', 1)) NOT IN ({', '.join(map(repr, K.TITLE_LAST_WORDS))})
        AND (dotted OR title = upper(title) OR starts_with({_plain_text('title')}, '{K.KNOWN_TITLE}') OR len(regexp_extract_all(title, '[A-Za-zÁÉÍÓÚÑáéíóúñ]+')) >= 2 AND regexp_matches(title, '^\p{{Lu}}') AND NOT regexp_matches(title, '^(De|Del|Al)\b') AND NOT regexp_matches(title, '(?i)\b(de|del)\s+[0-9]{{1,2}}\s+de\b')) AS plausible
      FROM c0 LEFT JOIN contents USING (doc_id, page) LEFT JOIN opens USING (doc_id) LEFT JOIN closes USING (doc_id)),
    entry AS MATERIALIZED (SELECT doc_id, number, min(key) AS key, count(DISTINCT key) AS titles FROM (SELECT doc_id, number, {_key_sql('t')} AS key FROM (SELECT *, trim(regexp_replace(title, '[.·… ]*\s[0-9]+\s*$', ''), ' .·…') AS t FROM cand WHERE contents) WHERE regexp_matches(t, '[A-Za-zÁÉÍÓÚÑáéíóúñ]')) GROUP BY ALL),
    ext AS (SELECT c.doc_id, c.number, c.page, c.start, c.fin, e.key, c.title AS t0, {_clean_sql("c.title || ' ' || ltrim(c.l1)")} AS t1, {_clean_sql("c.title || ' ' || ltrim(c.l1) || ' ' || ltrim(c.l2)")} AS t2, {_clean_sql("c.title || ' ' || ltrim(c.l1) || ' ' || ltrim(c.l2) || ' ' || ltrim(c.l3)")} AS t3,
        length(c.own) = length(c.line) AS ends, length(c.l1) AS n1, length(c.l2) AS n2, length(c.l3) AS n3 FROM cand c JOIN entry e ON e.doc_id = c.doc_id AND e.number = c.number WHERE NOT c.contents),
    keyed AS (SELECT *, {_key_sql('t0')} AS k0, {_key_sql('t1')} AS k1, {_key_sql('t2')} AS k2, {_key_sql('t3')} AS k3 FROM ext),
    step AS (SELECT *, ends AND n1 > 0 AND starts_with(key, k0 || ' ') AS s1, ends AND n1 > 0 AND n2 > 0 AND starts_with(key, k0 || ' ') AND starts_with(key, k1 || ' ') AS s2, ends AND n1 > 0 AND n2 > 0 AND n3 > 0 AND starts_with(key, k0 || ' ') AND starts_with(key, k1 || ' ') AND starts_with(key, k2 || ' ') AS s3 FROM keyed),
    hit AS MATERIALIZED (SELECT doc_id, number, page, start, CASE WHEN k0 = key THEN t0 WHEN s1 AND k1 = key THEN t1 WHEN s2 AND k2 = key THEN t2 ELSE t3 END AS title, fin + CASE WHEN k0 = key THEN 0 WHEN s1 AND k1 = key THEN 1 + n1 WHEN s2 AND k2 = key THEN 2 + n1 + n2 ELSE 3 + n1 + n2 + n3 END AS fin
      FROM step WHERE k0 = key OR s1 AND k1 = key OR s2 AND k2 = key OR s3 AND k3 = key),
    one AS (SELECT e.doc_id, e.number, e.titles, count(h.page) AS m, min({{'page': h.page, 'start': h.start}}) FILTER (h.page IS NOT NULL) AS spot FROM entry e LEFT JOIN hit h USING (doc_id, number) GROUP BY ALL),
    checked AS (SELECT *, coalesce(spot < lag(spot) OVER (PARTITION BY doc_id ORDER BY number), false) AS back FROM one),
    listed AS MATERIALIZED (SELECT doc_id, count(*) AS entries, CASE WHEN max(titles) > 1 THEN 'contradictory' WHEN min(number) <> 1 OR max(number) <> count(*) THEN 'incomplete' WHEN count(*) < 5 THEN 'short' WHEN count(*) FILTER (m = 0) > 0 THEN 'missing' WHEN count(*) FILTER (m > 1) > 0 THEN 'ambiguous' WHEN bool_or(back) THEN 'disordered' ELSE 'ok' END AS status FROM checked GROUP BY doc_id),
    q AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, start) AS ord FROM cand WHERE scope),
    p AS MATERIALIZED (SELECT * FROM q WHERE plausible), nxt AS MATERIALIZED (SELECT a.doc_id, a.ord, min(b.ord) AS nxt FROM p a JOIN p b ON b.doc_id = a.doc_id AND b.number = a.number + 1 AND b.ord > a.ord GROUP BY ALL),
    chain(doc_id, ord, n) AS (SELECT doc_id, min(ord), 1 FROM p WHERE number = 1 GROUP BY doc_id UNION ALL SELECT c.doc_id, x.nxt, c.n + 1 FROM chain c JOIN nxt x ON x.doc_id = c.doc_id AND x.ord = c.ord),
    seq AS MATERIALIZED (SELECT q.doc_id, CASE WHEN coalesce(k.n, 0) < 5 THEN 'too_few' WHEN max(q.number) FILTER (q.plausible) > k.n THEN 'incomplete' ELSE 'ok' END AS status, coalesce(k.n, 0) AS n FROM q LEFT JOIN (SELECT doc_id, max(n) AS n FROM chain GROUP BY doc_id) k USING (doc_id) GROUP BY q.doc_id, k.n),
    verdict AS MATERIALIZED (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'sequence' ELSE 'contents' END AS source, coalesce(l.status, s.status, 'no_start') AS status, CASE WHEN l.doc_id IS NULL THEN CASE s.status WHEN 'ok' THEN s.n WHEN 'incomplete' THEN s.n - 1 ELSE 0 END END AS kept
      FROM (SELECT DISTINCT doc_id FROM pages) d LEFT JOIN (SELECT * FROM listed WHERE status <> 'short') l USING (doc_id) LEFT JOIN seq s USING (doc_id)),
    heads AS MATERIALIZED (SELECT v.doc_id, number, title, page, start, fin FROM verdict v JOIN hit USING (doc_id) WHERE v.source = 'contents' AND v.status = 'ok' UNION ALL SELECT v.doc_id, q.number, q.title, q.page, q.start, q.fin FROM verdict v JOIN chain c ON c.doc_id = v.doc_id AND c.n <= v.kept JOIN q ON q.doc_id = c.doc_id AND q.ord = c.ord)"""


@_query(f"WITH RECURSIVE {_FOUND} SELECT v.doc_id, source, status, number, title, page, CAST(start AS INTEGER) AS start, CAST(fin AS INTEGER) AS fin FROM verdict v LEFT JOIN heads USING (doc_id)")
def note_headings(s, d):
    """OP-72 and OP-73: the headings of each document with their places; a document without any has one row."""
    found = notes_of.note_headings(note_pages(table(s, d, "documents")))
    return found.select("doc_id", "source", "status", F.explode_outer("headings").alias("h")).select("doc_id", "source", "status", "h.number", "h.title", "h.page", "h.start", F.col("h.end").alias("fin"))


@_query(f"WITH RECURSIVE {_FOUND} SELECT doc_id, status, entries FROM listed")
def index_reconcile(s, d):
    """OP-73: how the contents pages of each document agree with its headings."""
    found = notes_of.note_candidates(note_pages(table(s, d, "documents")))
    found = checkpointed(found)
    entries = notes_of.contents_entries(found)
    return notes_of.reconcile_contents(entries, notes_of.match_contents(entries, found)).drop("headings")


_SECTIONS = rf"""{_FOUND}, tops AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY k) AS r, trim(regexp_replace(line, '\s+', ' ', 'g')) AS line FROM ln WHERE trim(regexp_replace(line, '\s+', ' ', 'g')) <> ''),
    marks AS (SELECT doc_id, page, min(r) AS r FROM tops WHERE r <= 4 AND starts_with({_plain_text('line')}, '{K.NOTES_MARKER}') GROUP BY ALL),
    headers AS MATERIALIZED (SELECT doc_id, line FROM (SELECT DISTINCT t.doc_id, t.page, t.line FROM tops t JOIN marks m ON m.doc_id = t.doc_id AND m.page = t.page AND t.r <= m.r + 2) GROUP BY ALL HAVING count(*) >= 3),
    ends AS (SELECT doc_id, max(page) AS last, max(page) FILTER (contains({_plain_text('text')}, '{K.NOTES_MARKER}')) AS marked FROM pages GROUP BY doc_id),
    tail AS (SELECT v.doc_id, q.page, q.start FROM verdict v JOIN chain c ON c.doc_id = v.doc_id AND c.n = v.kept + 1 JOIN q ON q.doc_id = c.doc_id AND q.ord = c.ord WHERE v.status = 'incomplete' AND v.source = 'sequence'),
    bound AS (SELECT h.*, lead(h.page) OVER w AS next_page, lead(h.start) OVER w AS next_start FROM heads h WINDOW w AS (PARTITION BY h.doc_id ORDER BY h.number)),
    span AS (SELECT b.*, tail.page AS tail_page, tail.start AS tail_start, greatest(b.page, coalesce(next_page, least(CASE WHEN coalesce(marked < b.page, true) THEN last ELSE marked END, tail.page))) AS final FROM bound b JOIN ends USING (doc_id) LEFT JOIN tail USING (doc_id)),
    part AS (SELECT s.doc_id, s.number, s.title, l.page, l.k, l.start, l.line, CASE WHEN l.page = s.page THEN s.fin ELSE 0 END AS lo, CASE WHEN l.page = next_page THEN next_start WHEN next_page IS NULL AND l.page = tail_page THEN tail_start END AS hi, next_page IS NULL AS final_note
      FROM span s JOIN ln l ON l.doc_id = s.doc_id AND l.page BETWEEN s.page AND s.final),
    cuts AS (SELECT doc_id, number, min({{'page': page, 'start': start}}) AS cut FROM part WHERE final_note AND start >= lo AND regexp_matches(line, '{_APPENDIX}') GROUP BY ALL),
    cl AS (SELECT p.doc_id, p.number, p.title, p.page, p.k, trim(regexp_replace(substr(line, 1 + greatest(0, CAST(lo - start AS INTEGER))), '\s+', ' ', 'g')) AS line FROM part p LEFT JOIN cuts USING (doc_id, number) WHERE start + length(line) > lo AND (hi IS NULL OR start < hi) AND (cut IS NULL OR {{'page': p.page, 'start': p.start}} < cut)),
    kl AS (SELECT cl.*, h.line IS NULL AS own FROM cl LEFT JOIN headers h ON h.doc_id = cl.doc_id AND h.line = cl.line WHERE cl.line <> '' AND NOT starts_with({_plain_text('cl.line')}, '{K.NOTES_MARKER}') AND NOT regexp_matches({_plain_text('cl.line')}, '{K.PAGE_NUMBER_LINE}')),
    fl AS (SELECT *, min(k) FILTER (own) OVER (PARTITION BY doc_id, number, page) AS first FROM kl)"""


@_query(f"WITH RECURSIVE {_SECTIONS} SELECT doc_id, number, title, page, string_agg(line, chr(10) ORDER BY k) AS section FROM fl WHERE k >= first GROUP BY ALL")
def note_sections(s, d):
    """OP-40 and OP-74: what stands under each heading, page by page."""
    pages = note_pages(table(s, d, "documents"))
    return notes_of.note_sections(pages, checkpointed(notes_of.note_headings(pages))).drop("section_order")


@_query(f"""WITH RECURSIVE {_SECTIONS}, made AS (SELECT doc_id, number, page + 1 AS page, row_number() OVER (PARTITION BY doc_id, number ORDER BY page) - 1 AS fragment_order, title AS heading, section AS body FROM (SELECT doc_id, number, title, page, string_agg(line, chr(10) ORDER BY k) AS section FROM fl WHERE k >= first GROUP BY ALL)),
    known AS (SELECT doc_id, number, page, fragment_order, 'old' AS heading, 'old' AS body FROM made WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 1, 900, 0, 'kept', 'kept' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 4)
    SELECT source AS company_id, doc_id, number, page, fragment_order, heading, body FROM (SELECT * FROM made UNION ALL SELECT * FROM known WHERE NOT EXISTS (SELECT 1 FROM made m WHERE m.doc_id = known.doc_id AND m.number = known.number AND m.page = known.page AND m.fragment_order = known.fragment_order)) JOIN documents USING (doc_id) WHERE doc_id % 5 <> 4""")
def fragment_backfill(s, d):
    """OP-11: fragments of the sections of notes; every fifth document is not registered, and of every third there are fragments of an earlier run, and one more."""
    pages = note_pages(table(s, d, "documents"))
    sections = checkpointed(notes_of.note_sections(pages, checkpointed(notes_of.note_headings(pages))))
    registered = table(s, d, "documents").filter("doc_id % 5 <> 4").select("doc_id", F.col("source").alias("company_id"))
    old = F.lit("old")
    before = notes_of.note_fragments(registered, sections.filter("doc_id % 3 = 0")).withColumns({"heading": old, "body": old})
    more = registered.filter("doc_id % 3 = 0").select("company_id", "doc_id", F.lit(1).alias("number"), F.lit(900).alias("page"), F.lit(0).alias("fragment_order"), F.lit("kept").alias("heading"), F.lit("kept").alias("body"))
    return notes_of.note_fragments(registered, sections, before.unionByName(more))


@_query("""WITH h AS (SELECT conv_id, turn AS page, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations WHERE role = 'user')
    SELECT h.conv_id AS doc_id, h.page AS number, c.turn AS page, CASE WHEN c.turn = h.page THEN substr(c.text, 11) ELSE c.text END AS section FROM h JOIN conversations c ON c.conv_id = h.conv_id AND c.turn >= h.page AND (h.next IS NULL OR c.turn < h.next)
    WHERE trim(CASE WHEN c.turn = h.page THEN substr(c.text, 11) ELSE c.text END) <> ''""")
def range_slice(s, d):
    """OP-40: each user's turn opens a section behind its tenth character; the section goes on until the next."""
    c = table(s, d, "conversations")
    heads = c.filter("role = 'user'").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("number"), F.col("turn").alias("page"), F.lit(0).alias("start"), F.lit(10).alias("body"))
    return docs.slice_sections(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text"), heads)


@_query("SELECT o_custkey AS doc_id, account_code, line, line_no FROM (SELECT o_custkey, o_orderkey AS line_no, o_orderpriority AS account_code, 'Total de ' || o_orderpriority || ' activos ' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) || ' ' || CAST(CAST(o_orderkey AS DECIMAL(14,2)) AS VARCHAR) AS line FROM orders WHERE o_orderkey % 3 <> 0)")
def statement_evidence(s, d):
    """OP-41: orders as facts, and as lines of their customer's document; every third line has another amount."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), "o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(14,2)").alias("a"), F.col("o_orderkey").cast("decimal(14,2)").alias("b"))
    facts = o.select("doc_id", F.concat_ws("|", "o_orderpriority", "o_orderkey").alias("account_code"), F.concat(F.lit("activos de "), F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("label"), F.col("a").alias("current"), F.col("b").alias("comparative"))
    shown = F.concat(F.lit("Total de "), F.col("o_orderpriority"), F.lit(" activos "), (F.col("a") + F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0)).cast("decimal(14,2)").cast("string"), F.lit(" "), F.col("b").cast("string"))
    found = docs.evidence_lines(facts, o.select("doc_id", F.col("o_orderkey").alias("line_no"), shown.alias("line")))
    return found.select("doc_id", F.substring_index("account_code", "|", 1).alias("account_code"), "line", "line_no")


@_query("""WITH c AS (SELECT item_id AS citation_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS quote FROM benchmark), f AS (SELECT doc_id AS fragment_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM documents)
    SELECT citation_id, fragment_id FROM c JOIN f ON contains(f.text, c.quote) WHERE len(string_split(quote, ' ')) >= 3""")
def citation_check(s, d):
    """OP-42 (A5): benchmark texts as quotes, documents as fragments."""
    return docs.find_quotes(table(s, d, "benchmark").select(F.col("item_id").alias("citation_id"), F.col("text").alias("quote")), table(s, d, "documents").select(F.col("doc_id").alias("fragment_id"), "text"))


@_query(f"""WITH {_NOTES}, k AS (SELECT *, {_key_sql('title')} AS key FROM notes), r AS (SELECT *, row_number() OVER (PARTITION BY company, scope, fiscal_year, key ORDER BY note_number) AS n FROM k)
    SELECT a.company, a.scope, a.note_number AS current_number, b.note_number AS previous_number FROM r a JOIN r b USING (company, scope, key, n) WHERE a.fiscal_year = 2025 AND b.fiscal_year = 2024""")
def title_exact_match(s, d):
    n = _noted(s, d)
    return matching.match_exact(n.filter("fiscal_year = 2025"), n.filter("fiscal_year = 2024"))


_ALIAS = "CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.TITLE_ALIASES.items()) + " ELSE x END"
_PLAIN_TOKENS = f"list_distinct(list_transform(list_filter(string_split({_key_sql('title')}, ' '), lambda x: length(x) >= 3 AND x NOT IN ({', '.join(repr(w) for w in K.TITLE_STOP_WORDS)})), lambda x: {_ALIAS}))"
_TOKENS = f"CASE WHEN list_contains({_PLAIN_TOKENS}, 'ventas') THEN list_filter({_PLAIN_TOKENS}, lambda x: x <> 'actividad') ELSE {_PLAIN_TOKENS} END"


@_query(f"""WITH {_NOTES}, t AS MATERIALIZED (SELECT company, scope, fiscal_year, note_number, {_TOKENS} AS tokens FROM notes),
    p AS (SELECT a.company, a.scope, a.note_number AS current_number, b.note_number AS previous_number, len(list_intersect(a.tokens, b.tokens)) AS common, len(a.tokens) + len(b.tokens) AS total FROM t a JOIN t b USING (company, scope) WHERE a.fiscal_year = 2025 AND b.fiscal_year = 2024)
    SELECT company, scope, current_number, previous_number, round(common::DOUBLE / (total - common), 4) AS jaccard FROM p WHERE common > 0""")
def title_jaccard(s, d):
    """OP-89: word overlap of titles of two years; pairs meet on a shared word."""
    n = _noted(s, d).select("company", "scope", "fiscal_year", "note_number", matching.title_tokens("title").alias("tokens"))
    side = lambda y, p: n.filter(F.col("fiscal_year") == y).select("company", "scope", F.col("note_number").alias(p), F.size("tokens").alias(f"{p}_size"), F.explode("tokens").alias("token"))
    both = side(2025, "current_number").join(side(2024, "previous_number"), ["company", "scope", "token"])
    counted = both.groupBy("company", "scope", "current_number", "previous_number", "current_number_size", "previous_number_size").agg(F.count("*").alias("c"))
    return counted.select("company", "scope", "current_number", "previous_number", F.round(F.col("c") / (F.col("current_number_size") + F.col("previous_number_size") - F.col("c")), 4).alias("jaccard"))


def _years(s, d):
    n = _noted(s, d)
    return n.filter("fiscal_year = 2025"), n.filter("fiscal_year = 2024")


@_query()
def title_similarity(s, d):
    return matching.similar_pairs(*_years(s, d))


@_query()
def note_match(s, d):
    return matching.match_notes(*_years(s, d))


_EXACT = f"""WITH {_NOTES}, k AS (SELECT *, {_key_sql('title')} AS key, {_topic_sql('title')} AS topic FROM notes), r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY company, scope, fiscal_year, key ORDER BY note_number) AS n FROM k),
    a AS (SELECT * FROM r WHERE fiscal_year = 2025), b AS (SELECT * FROM r WHERE fiscal_year = 2024)"""


@_query(f"""{_EXACT}, x AS (SELECT coalesce(a.company, b.company) AS company, coalesce(a.scope, b.scope) AS scope, a.key IS NOT NULL AS is_current, b.key IS NOT NULL AS is_previous, a.doc_id % 9 <> 3 AND b.doc_id % 9 <> 4 AS observed
      FROM a FULL JOIN b ON a.company = b.company AND a.scope = b.scope AND a.key = b.key AND a.n = b.n),
    g AS (SELECT company, scope, count(*) FILTER (is_current AND is_previous) AS matched, count(*) FILTER (is_current AND NOT is_previous) AS current_only, count(*) FILTER (is_previous AND NOT is_current) AS previous_only, count(*) FILTER (is_current AND is_previous AND observed) AS with_evidence FROM x GROUP BY ALL),
    q AS (SELECT *, CASE WHEN matched + current_only = 0 THEN 0 ELSE matched::DOUBLE / (matched + current_only) END AS coverage, CASE WHEN matched = 0 THEN 0 ELSE with_evidence::DOUBLE / matched END AS evidence FROM g)
    SELECT company, scope, matched, current_only, previous_only, with_evidence, CASE WHEN coverage >= 0.9 AND evidence >= 0.75 THEN 'generated' WHEN coverage >= 0.65 AND evidence >= 0.5 OR matched > 0 THEN 'partial' ELSE 'insufficient_evidence' END AS status,
      CASE WHEN coverage >= 0.9 AND evidence >= 0.75 THEN 'high' WHEN coverage >= 0.65 AND evidence >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM q""")
def coverage_rollup(s, d):
    """OP-59 over exact matches; every ninth document of a year has no observed fact."""
    every = _noted(s, d).withColumn("observed", F.when(F.pmod("doc_id", F.lit(9)) == F.when(F.col("fiscal_year") == 2025, 3).otherwise(4), 0).otherwise(1))
    current, previous = every.filter("fiscal_year = 2025"), every.filter("fiscal_year = 2024")
    pairs = matching.match_exact(current, previous)
    both = pairs.withColumn("status", F.lit("matched"))
    only = lambda df, p: df.select("company", "scope", F.col("note_number").alias(f"{p}_number")).join(pairs, ["company", "scope", f"{p}_number"], "left_anti").withColumn("status", F.lit(f"{p}_only"))
    return matching.coverage_rollup(both.unionByName(only(current, "current"), allowMissingColumns=True).unionByName(only(previous, "previous"), allowMissingColumns=True), every)


@_query(f"""{_EXACT} SELECT a.company, a.scope, a.note_number AS current_number, b.note_number AS previous_number, a.title AS current_title, b.title AS previous_title
    FROM a JOIN b USING (company, scope, key, n) WHERE (a.topic = 'debt' OR b.topic = 'debt')""")
def comparison_view(s, d):
    current, previous = _years(s, d)
    found = matching.comparison_view(matching.match_exact(current, previous), current, previous, topic="debt")
    return found.select("company", "scope", "current_number", "previous_number", F.col("current.title").alias("current_title"), F.col("previous.title").alias("previous_title"))


#: Sentences that a document gets by its id, so that advice, openings, and figures with and without a verb occur.
ADDED = (
    " Los analistas recomiendan comprar de inmediato las acciones de la compañía porque su valor aumentará durante el ejercicio.",
    " A continuación presentamos el detalle de los saldos que la compañía mantiene con sus proveedores y clientes del exterior.",
    " La compañía registró pérdidas de 10, 20, 30, 40 y 50 mil soles en sus unidades y mantiene una deuda por US$ 1,500 con garantía.",
    " Los importes de 10, 20, 30, 40 y 50 mil soles por unidad figuran en el cuadro de la página siguiente de este informe.",
    " El saldo de la deuda y de los préstamos vigentes aumentó de manera significativa por el vencimiento pendiente de pago en 2025.",
)
_SENTENCES = rf"""s0 AS (SELECT doc_id, regexp_replace(text || {_list(ADDED)}[doc_id % {len(ADDED)} + 1], '^\s*[0-9]{{1,3}}\s+([A-ZÁÉÍÓÚÑ(\-])', '\1') AS t FROM documents),
    s1 AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(trim(regexp_replace(t, '[ \t\n\v\f\r]+', ' ', 'g')), '([.!?]) (-\s*[A-ZÁÉÍÓÚÑ0-9]|\([a-z]\)|[A-ZÁÉÍÓÚÑ0-9])', '\1' || chr(1) || '\2', 'g'), '([.!?]) (-\s*[A-ZÁÉÍÓÚÑ0-9]|\([a-z]\)|[A-ZÁÉÍÓÚÑ0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS l FROM s0),
    sent AS MATERIALIZED (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS ord, unnest(l) AS sentence FROM (SELECT doc_id, list_filter(list_transform(l, lambda x: regexp_replace(x, '^[ \-]+|[ \-]+$', '', 'g')), lambda x: x <> '') AS l FROM s1))"""


def _sentences(s, d, *more):
    added = F.element_at(F.array(*map(F.lit, ADDED)), (F.pmod("doc_id", F.lit(len(ADDED))) + 1).cast("int"))
    return docs.sentences(table(s, d, "documents").select("doc_id", *more, F.concat("text", added).alias("text")))


@_query(f"WITH {_SENTENCES} SELECT * FROM sent")
def sentences(s, d):
    return _sentences(s, d)


_PLAIN = f"lower(translate(sentence, '{ACCENTED}', '{PLAIN}'))"
_any = lambda c, terms: "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"
_count = lambda c, terms: "(" + " + ".join(f"CAST(contains({c}, '{t}') AS INTEGER)" for t in terms) + ")"
_IS = rf"""length(sentence) BETWEEN 70 AND 560 AND length(sentence) - length(replace(sentence, '_', '')) <= 3 AND len(regexp_extract_all(sentence, '\b[0-9][0-9.,]*')) <= 10
    AND (length(sentence) - length(regexp_replace(sentence, '\p{{L}}', '', 'g')))::DOUBLE / length(sentence) >= 0.48 AND (length(sentence) - length(regexp_replace(sentence, '\p{{Nd}}', '', 'g')))::DOUBLE / length(sentence) <= 0.18
    AND len(string_split(sentence, ' ')) >= 11 AND (len(regexp_extract_all(sentence, '\b[0-9][0-9.,]*')) < 4 OR {_any(_PLAIN, K.NARRATIVE_VERBS)})
    AND NOT regexp_matches({_PLAIN}, '{K.INVESTMENT_ADVICE}') AND NOT starts_with({_PLAIN}, '{K.BOILERPLATE_BEGINNINGS[0]}') AND NOT starts_with({_PLAIN}, '{K.BOILERPLATE_BEGINNINGS[1]}')"""


@_query(f"WITH {_SENTENCES} SELECT doc_id, ord FROM sent WHERE {_IS}")
def narrative_filter(s, d):
    return docs.narrative(_sentences(s, d)).select("doc_id", "ord")


def _scored(s, d):
    title = F.element_at(F.array(*map(F.lit, NOTE_TITLES)), (F.pmod(F.floor(F.col("doc_id") / 2), F.lit(len(NOTE_TITLES))) + 1).cast("int"))
    # the topic is found once a document, before its sentences are told apart
    rows = docs.narrative(_sentences(s, d, docs.topic(title).alias("topic")))
    score = docs.sentence_score(F.col("sentence"), F.col("plain"), F.lit(2024) + F.pmod("doc_id", F.lit(2)), docs.topic_terms(F.col("plain"), F.col("topic")))
    return rows.select("doc_id", "ord", "sentence", F.round(score.cast("double"), 6).alias("score"))


_TITLED = f"(SELECT *, {_list(NOTE_TITLES)}[doc_id // 2 % {len(NOTE_TITLES)} + 1] AS title FROM sent WHERE {_IS})"
_TERMS = "CASE topic " + " ".join(f"WHEN '{name}' THEN {_count('plain', terms)}" for name, terms in K.TOPIC_KEYWORDS.items()) + " ELSE 0 END"
_SCORED = rf"""{_SENTENCES}, scored AS MATERIALIZED (SELECT doc_id, ord, sentence, round(1.0::DOUBLE + least(3, {_TERMS}) * 1.6::DOUBLE + CASE WHEN regexp_matches(sentence, 'US\$|S/|%|\b[0-9]{{1,3}}([.,][0-9]{{3}})+') THEN 1.8::DOUBLE ELSE 0 END
    + CASE WHEN contains(sentence, CAST(2024 + doc_id % 2 AS VARCHAR)) THEN 0.8::DOUBLE ELSE 0 END + least(2, {_count('plain', K.MATERIAL_TERMS)}) + CASE WHEN length(sentence) BETWEEN 110 AND 380 THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN contains(plain, '{K.STANDARD_PHRASE}') THEN 1.5::DOUBLE ELSE 0 END, 6) AS score
    FROM (SELECT *, {_PLAIN} AS plain, {_topic_sql('title')} AS topic FROM {_TITLED}))"""


@_query(f"WITH {_SCORED} SELECT doc_id, ord, score FROM scored")
def sentence_score(s, d):
    return _scored(s, d).select("doc_id", "ord", "score")


def _chosen(s, d):
    page = F.floor(F.col("ord") / 10)
    return docs.select_evidence(_scored(s, d).select("doc_id", page.alias("fragment"), page.alias("page"), "ord", "sentence", "score"), ["doc_id"])


_FIRST = "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page, ord) = 1"
_apart = lambda w, t: f"{w}.ord <> {t}.ord AND NOT (len({w}.words) + len({t}.words) > 0 AND len(list_intersect({w}.words, {t}.words)) >= 0.62 * (len({w}.words) + len({t}.words) - len(list_intersect({w}.words, {t}.words))))"
_TAKEN = f"""{_SCORED}, w0 AS MATERIALIZED (SELECT doc_id, ord // 10 AS page, ord, sentence, score, list_distinct(regexp_extract_all(lower(sentence), '[a-záéíóúñ]{{4,}}')) AS words FROM scored),
    t1 AS MATERIALIZED (SELECT * FROM w0 {_FIRST}), w1 AS MATERIALIZED (SELECT w0.* FROM w0 JOIN t1 USING (doc_id) WHERE {_apart('w0', 't1')}), t2 AS MATERIALIZED (SELECT * FROM w1 {_FIRST}),
    w2 AS MATERIALIZED (SELECT w1.* FROM w1 JOIN t1 USING (doc_id) JOIN t2 USING (doc_id) WHERE {_apart('w1', 't2')} AND NOT (w1.page = t1.page AND w1.page = t2.page)), t3 AS (SELECT * FROM w2 {_FIRST}),
    taken AS MATERIALIZED (SELECT 1 AS rank, * FROM t1 UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 3, * FROM t3)"""


@_query(f"WITH {_TAKEN} SELECT doc_id, rank, page AS fragment, page, ord, sentence, score FROM taken")
def cited_sentences(s, d):
    return _chosen(s, d)


@_query(f"""WITH {_TAKEN}, n AS (SELECT doc_id, count(*) AS facts, count(DISTINCT page) AS pages FROM taken GROUP BY doc_id), g AS (SELECT doc_id, coalesce(bool_or(contains(text, '$$$')), false) AS tables FROM documents GROUP BY doc_id),
    j AS (SELECT doc_id, tables, coalesce(facts, 0) AS facts, coalesce(pages, 0) AS pages FROM g LEFT JOIN n USING (doc_id))
    SELECT *, CASE WHEN facts >= 2 THEN 'generated' WHEN facts = 1 THEN 'partial' ELSE 'insufficient_evidence' END AS status, CASE WHEN facts >= 3 AND pages >= 2 THEN 'high' WHEN facts >= 2 THEN 'medium' ELSE 'low' END AS confidence, facts < 2 AS limited FROM j""")
def summary_confidence(s, d):
    """OP-60: every document has a row; three dollar signs stand for the header of tables."""
    return docs.summary_confidence(_chosen(s, d), ["doc_id"], table(s, d, "documents").select("doc_id", "text"), "$$$")


@_query("""WITH c AS (SELECT c.conv_id, c.turn, c.text, lead(c.text) OVER (PARTITION BY conv_id ORDER BY turn) AS next FROM conversations c),
    k AS (SELECT conv_id, turn // 2 AS finding, trim(regexp_replace(CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN coalesce(next, '') ELSE substr(text, 1, 40) END, '\\s+', ' ', 'g')) AS quote, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS own FROM c),
    f AS (SELECT conv_id, finding, bool_and(coalesce(contains(own, quote) AND quote <> '', false)) AS ok FROM k GROUP BY ALL)
    SELECT conv_id, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS rejected, CASE WHEN count(*) FILTER (NOT ok) > 0 THEN 'partial' WHEN count(*) FILTER (ok) > 0 THEN 'generated' ELSE 'insufficient_evidence' END AS status FROM f GROUP BY conv_id""")
def report_status(s, d):
    """OP-42: conversations as reports that quote their turns; the first turn of every fifth one quotes the next turn instead."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(s, d, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("next"))
    ids = F.concat_ws("|", "conv_id", "turn")
    wrong = (F.pmod("conv_id", F.lit(5)) == 0) & (F.col("turn") == 0)
    quotes = c.select(ids.alias("citation_id"), ids.alias("fragment_id"), F.when(wrong, F.coalesce("next", F.lit(""))).otherwise(F.substring("text", 1, 40)).alias("quote"), "conv_id", F.floor(F.col("turn") / 2).alias("finding"))
    checked = docs.check_citations(quotes, c.select(ids.alias("fragment_id"), "text")).select("citation_id", "accepted")
    return docs.report_status(quotes.select("citation_id", "conv_id", "finding").join(checked, "citation_id"), ["conv_id"])


@_query("SELECT conv_id, role, list(text ORDER BY turn) AS items, count(*) AS n FROM conversations GROUP BY ALL")
def summary_payload(s, d):
    """OP-61: items in order, grouped by kind."""
    g = table(s, d, "conversations").groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("i"), F.count("*").alias("n"))
    return g.select("conv_id", "role", F.expr("transform(i, x -> x.text)").alias("items"), "n")


@_query(f"""WITH {_NOTES}, t AS (SELECT *, {_topic_sql('title')} AS topic FROM notes),
    v AS (SELECT *, CASE WHEN topic IN ('debt', 'contingencies', 'related_parties', 'impairment', 'provisions_closure', 'subsequent_events', 'estimates') THEN 5 ELSE 0 END
      - CASE WHEN {' OR '.join(f"contains(lower(translate(title, '{ACCENTED}', '{PLAIN}')), '{t}')" for t in K.GENERIC_TITLES)} THEN 12 ELSE 0 END
      + {' + '.join(f"3 * CAST(contains(lower(translate(title, '{ACCENTED}', '{PLAIN}')), '{t}') AS INTEGER) + CAST(contains(lower(translate(left(text, 2500), '{ACCENTED}', '{PLAIN}')), '{t}') AS INTEGER)" for t in KEYWORDS)} AS relevance FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY company, fiscal_year ORDER BY relevance DESC, note_number, scope) AS rank FROM v), k AS (SELECT *, count(*) OVER (PARTITION BY company) AS n FROM r WHERE rank <= CASE fiscal_year WHEN 2025 THEN 20 ELSE 12 END)
    SELECT company, fiscal_year, scope, note_number, CAST(relevance AS INTEGER) AS relevance, CAST(rank AS INTEGER) AS rank, left(text, CAST(least(2500, 75000 // n) AS INTEGER)) AS content FROM k""")
def priority_fragments(s, d):
    found = docs.priority_fragments(_noted(s, d), 2025, terms=KEYWORDS)
    return found.select("company", "fiscal_year", "scope", "note_number", "relevance", "rank", "content")


@_query(f"WITH {_LINES} SELECT doc_id, trim(line) AS line, count(DISTINCT line_no) AS pages FROM lines WHERE trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT line_no) >= 3")
def repeated_lines(s, d):
    return docs.repeated_lines(lines(table(s, d, "documents")).withColumnRenamed("line_no", "page"))


@_query(f"WITH {_LINES}, r AS (SELECT doc_id, trim(line) AS l FROM lines WHERE trim(line) <> '' GROUP BY ALL HAVING count(DISTINCT line_no) >= 3) SELECT doc_id, CAST(line_no AS INTEGER) AS page, line FROM lines WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_id = lines.doc_id AND r.l = trim(lines.line))")
def strip_repeated(s, d):
    return docs.strip_repeated(lines(table(s, d, "documents")).withColumnRenamed("line_no", "page"))


#: A line over 100 characters long, and how tables in a unit name it.
PROSE = "El saldo comprende depósitos que se mantienen en bancos locales y del exterior y que son de libre disponibilidad para la compañía."
UNITS = {"thousands": "S/(000) S/(000)", "millions": "millones de soles"}


def _policy_documents(s, d):
    """Adapter: documents with a policy on their first page and two notes with tables on their second.

    What is odd follows from doc_id modulo 12: 1 the columns in another order, 2 and 3 another unit or currency, 4 one year twice, 5 other years, 6 a second table in the note,
    7 and 8 a paragraph before the rows, 9 another amount in one filing, 10 a total without a rule, 11 a row whose label is the fact's own.
    """
    k, v, year = F.pmod("doc_id", F.lit(500)), F.pmod("doc_id", F.lit(12)), F.lit(2024) + F.pmod("doc_id", F.lit(2)).cast("int")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (F.pmod("doc_id", F.lit(len(POLICIES))) + 1).cast("int"))
    unit = pick([UNITS.get(p[1], UNITS["thousands"]) for p in POLICIES])
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    years = F.when(v == 1, text(year - 1, " ", year)).when(v == 4, text(year, "  ", year)).when(v == 5, text(year - 1, " ", year - 2)).otherwise(text(year, " ", year - 1))
    named = F.when(v == 2, "en unidades de S/").when(v == 3, "US$(000) US$(000)").otherwise(unit)
    lines_of = [
        F.lit("6. Efectivo y equivalentes del efectivo"), years, named, F.when(v == 6, "Otros 5 4"), F.when(v == 6, years), F.when(v == 6, unit), F.when(v == 7, "(a) Detalle del saldo").when(v == 8, PROSE),
        text("Caja ", k + 90, " ", k + 80, F.when(v == 10, "").otherwise(" _________")), text(k + 100, " ", k + 90), F.substring_index("text", "\n", 1), F.lit("7. Otra cuenta"), text(year, " ", year - 1, " ", year - 2), unit,
        text("Utilidad antes de impuesto a la renta ", k + 200, " ", k + 180, " 160"), text("Total impuesto a la renta (", F.pmod("doc_id", F.lit(7)) + 20, ") (", F.pmod("doc_id", F.lit(7)) + 18, ") (16)"),
        F.when(v == 11, text("Efectivo (nota 6) ", k + 100, " ", k + 90, " 1")), F.when(v == 11, text("Utilidad por acción ", k + 3, " ", k + 2, " 1")),
    ]
    docs_ = table(s, d, "documents").filter("doc_id is not null")
    pages = docs_.select("doc_id", F.posexplode(F.array(pick([p[0] for p in POLICIES]), F.array_join(F.array_compact(F.array(*lines_of)), "\n"))).alias("page", "text"))
    filing = lambda n: F.col("doc_id") * 10 + n
    filings = docs_.select("doc_id", F.explode(F.array(*(filing(n) for n in (1, 2, 3)))).alias("filing_id"), F.lit("PEN").alias("currency_code"), year.alias("fiscal_year"), F.lit("consolidated").alias("scope"), F.lit("A").alias("period_code"))
    fact = lambda n, code, label, concept, kind, current, before: F.struct(filing(n).alias("filing_id"), F.lit(code).alias("account_code"), F.lit(label).alias("label"), F.lit(concept).alias("concept"), F.lit(kind).alias("value_kind"), current.cast("decimal(20,6)").alias("current"), before.cast("decimal(20,6)").alias("comparative"))
    tax = F.pmod("doc_id", F.lit(7))
    facts = docs_.select("doc_id", F.inline(F.array(
        fact(1, "cash", "Efectivo", "cash_and_cash_equivalents", "monetary", k + 100, k + 90), fact(2, "profit", "Ganancia antes de impuestos", "profit_before_tax", "monetary", k + 200, k + 180), fact(2, "tax", "Impuesto", "income_tax_expense", "monetary", -tax - 20, -tax - 18),
        fact(3, "closing", "Saldo final", "closing_cash", "monetary", F.when(v == 9, 9999).otherwise(k + 100), k + 90), fact(3, "share", "Utilidad por acción", None, "per_share", k + 3, k + 2), fact(3, "none", "Nada", None, "monetary", k * 0, k),
    )))
    return pages, filings, facts


_unit_sql = "[" + ", ".join(f"'{UNITS.get(p[1], UNITS['thousands'])}'" for p in POLICIES) + f"][doc_id % {len(POLICIES)} + 1]"
_label_sql = lambda c: rf"array_to_string(regexp_extract_all(regexp_replace({_plain_text(c)}, '\([^)]*\)', '', 'g'), '[a-z]+'), ' ')"
_TABLES = rf"""t0 AS (SELECT doc_id, doc_id % 500 AS k, doc_id % 12 AS v, 2024 + doc_id % 2 AS y, text, {_unit_sql} AS unit, coalesce({_of_id(1)}, '') AS policy, doc_id % 7 AS tax FROM documents WHERE doc_id IS NOT NULL),
    t1 AS (SELECT *, CASE v WHEN 1 THEN (y - 1) || ' ' || y WHEN 4 THEN y || '  ' || y WHEN 5 THEN (y - 1) || ' ' || (y - 2) ELSE y || ' ' || (y - 1) END AS years FROM t0),
    t2 AS (SELECT doc_id, y, CASE WHEN policy = 'millions' THEN 'millions' ELSE 'thousands' END AS wanted, list_filter(['6. Efectivo y equivalentes del efectivo', years, CASE v WHEN 2 THEN 'en unidades de S/' WHEN 3 THEN 'US$(000) US$(000)' ELSE unit END, CASE WHEN v = 6 THEN 'Otros 5 4' END, CASE WHEN v = 6 THEN years END, CASE WHEN v = 6 THEN unit END,
        CASE v WHEN 7 THEN '(a) Detalle del saldo' WHEN 8 THEN '{PROSE}' END, 'Caja ' || (k + 90) || ' ' || (k + 80) || CASE WHEN v = 10 THEN '' ELSE ' _________' END, (k + 100) || ' ' || (k + 90), string_split(text, chr(10))[1], '7. Otra cuenta', y || ' ' || (y - 1) || ' ' || (y - 2), unit,
        'Utilidad antes de impuesto a la renta ' || (k + 200) || ' ' || (k + 180) || ' 160', 'Total impuesto a la renta (' || (tax + 20) || ') (' || (tax + 18) || ') (16)', CASE WHEN v = 11 THEN 'Efectivo (nota 6) ' || (k + 100) || ' ' || (k + 90) || ' 1' END, CASE WHEN v = 11 THEN 'Utilidad por acción ' || (k + 3) || ' ' || (k + 2) || ' 1' END], lambda x: x IS NOT NULL) AS l FROM t1),
    t3 AS (SELECT doc_id, y, wanted, unnest(range(0, len(l))) AS i, unnest(l) AS line, unnest(list_concat([''], l[1:len(l) - 1])) AS above FROM t2), t4 AS (SELECT *, {_plain_text('line')} AS plain FROM t3),
    t5 AS (SELECT *, regexp_matches(plain, '{K.SOLES}') AND NOT regexp_matches(plain, '{K.DOLLARS}') AS pen, [{', '.join(f"CASE WHEN regexp_matches(plain, '{p}') THEN '{n}' END" for n, p in K.SCALE_WORDS)}] AS named FROM t4),
    f AS MATERIALIZED (SELECT doc_id, y, wanted, i, line, CASE WHEN regexp_matches(line, '^\s*[0-9]{{1,2}}\.\s+.') THEN {_label_sql(r"regexp_extract(line, '^\s*[0-9]{1,2}\.\s+(.+)', 1)")} END AS title, CASE WHEN regexp_matches(line, '{K.YEARS_LINE}') THEN list_transform(regexp_extract_all(line, '20[0-9]{{2}}'), lambda x: CAST(x AS INTEGER)) END AS years,
        CASE WHEN pen AND len(list_filter(named, lambda x: x IS NOT NULL)) = 1 THEN list_filter(named, lambda x: x IS NOT NULL)[1] END AS scale, regexp_matches(plain, '{K.UNIT_WORDS}') AS unit, list_transform(regexp_extract_all(line, '(?:^|[^\p{{L}}\p{{N}}_.])(\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?)', 1), lambda x: CAST(replace(replace(replace(x, ',', ''), ')', ''), '(', '-') AS DOUBLE)) AS numbers,
        length(trim(line)) > 100 OR regexp_matches(line, '^\s*\([a-z]\)') AS ends, {_label_sql('line')} AS label, contains(above, '___') AS ruled FROM t5),
    st(doc_id, i, heading, years, scale, first, seen, fits, open) AS (SELECT doc_id, CAST(-1 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS INTEGER[]), CAST(NULL AS VARCHAR), false, false, false, CAST(NULL AS INTEGER[]) FROM t2
      UNION ALL SELECT doc_id, i, heading, CASE WHEN own IS NOT NULL THEN own WHEN other_unit OR usable AND NOT fit AND ends THEN NULL ELSE open END, CASE WHEN own IS NOT NULL OR other_unit OR begins THEN NULL WHEN open IS NOT NULL AND line_scale IS NOT NULL THEN line_scale ELSE scale END,
        CASE WHEN own IS NOT NULL THEN first AND NOT seen WHEN usable AND fit AND label = '' THEN false ELSE first END, seen OR own IS NOT NULL, usable AND fit, open
      FROM (SELECT *, len(numbers) = len(open) AS fit, coalesce(open IS NOT NULL AND len(list_distinct(open)) = len(open) AND scale = wanted AND own IS NULL AND line_scale IS NULL AND NOT other_unit AND list_contains(open, y) AND list_contains(open, y - 1), false) AS usable
        FROM (SELECT *, open IS NOT NULL AND line_scale IS NULL AND unit AS other_unit FROM (SELECT f.doc_id, f.i, f.y, f.wanted, f.years AS own, f.scale AS line_scale, f.unit, f.numbers, f.ends, f.label, f.title IS NOT NULL AS begins, coalesce(f.title, st.heading) AS heading, f.title IS NOT NULL OR st.first AS first, f.title IS NULL AND st.seen AS seen,
          CASE WHEN f.title IS NULL THEN st.years END AS open, st.scale FROM st JOIN f ON f.doc_id = st.doc_id AND f.i = st.i + 1)))),
    before AS (SELECT doc_id, i + 1 AS i, first AND f2.title IS NULL OR f2.title IS NOT NULL AS first FROM st JOIN (SELECT doc_id AS d2, i AS i2, title FROM f) f2 ON f2.d2 = st.doc_id AND f2.i2 = st.i + 1),
    found AS MATERIALIZED (SELECT s.doc_id, CAST(s.i AS INTEGER) AS line_no, f.line, f.label, CASE WHEN f.label = '' AND b.first AND f.ruled THEN s.heading END AS total, s.open AS years, f.numbers[list_position(s.open, f.y)] AS current, f.numbers[list_position(s.open, f.y - 1)] AS comparative
      FROM st s JOIN f ON f.doc_id = s.doc_id AND f.i = s.i JOIN before b ON b.doc_id = s.doc_id AND b.i = s.i WHERE s.fits)"""


@_query(f"WITH RECURSIVE {_TABLES} SELECT doc_id, line_no, line, coalesce(total, label) AS label, total IS NOT NULL AS total, years, current, comparative FROM found")
def table_context(s, d):
    """OP-71: rows of tables in the unit that the document's policy names (thousands where it has none)."""
    pages, filings, _ = _policy_documents(s, d)
    scale = F.element_at(F.array(*(F.lit(p[1] or "thousands") for p in POLICIES)), (F.pmod("doc_id", F.lit(len(POLICIES))) + 1).cast("int"))
    read = pages.withColumns({"currency": F.lit("PEN"), "fiscal_year": F.lit(2024) + F.pmod("doc_id", F.lit(2)).cast("int"), "scale": scale})
    found = evidence.table_rows(read).select("doc_id", "line_no", "line", F.col("keys")[0].alias("k"), "years", "current", "comparative")
    return found.select("doc_id", "line_no", "line", "k.label", "k.total", "years", F.col("current").cast("double"), F.col("comparative").cast("double"))


@_query(f"""WITH RECURSIVE {_TABLES}, facts AS (SELECT doc_id, doc_id * 10 + n AS filing_id, code, unnest(labels) AS label, current::DOUBLE AS current, comparative::DOUBLE AS comparative FROM (
      SELECT doc_id, 1 AS n, 'cash' AS code, ['efectivo', 'efectivo y equivalentes del efectivo'] AS labels, k + 100 AS current, k + 90 AS comparative FROM t0 UNION ALL SELECT doc_id, 2, 'profit', ['ganancia antes de impuestos', 'utilidad antes de impuesto a la renta'], k + 200, k + 180 FROM t0
      UNION ALL SELECT doc_id, 2, 'tax', ['impuesto', 'total impuesto a la renta'], -tax - 20, -tax - 18 FROM t0 UNION ALL SELECT doc_id, 3, 'closing', ['saldo final', 'efectivo y equivalentes del efectivo'], CASE WHEN v = 9 THEN 9999 ELSE k + 100 END, k + 90 FROM t0)),
    a AS MATERIALIZED (SELECT f.doc_id, f.filing_id, f.code, arg_max(f.label, r.line_no) AS label, any_value(f.current) AS current, any_value(f.comparative) AS comparative FROM facts f JOIN (SELECT doc_id, line_no, current, comparative, label FROM found UNION SELECT doc_id, line_no, current, comparative, total FROM found WHERE total IS NOT NULL) r ON r.doc_id = f.doc_id AND r.label = f.label AND r.current = f.current AND r.comparative = f.comparative GROUP BY ALL),
    w AS (SELECT doc_id, count(DISTINCT {{'l': label, 'c': current, 'p': comparative}}) AS amounts, count(DISTINCT filing_id) AS filings FROM a GROUP BY doc_id)
    SELECT a.doc_id, a.filing_id, p.policy AS scale, p.exception, count(*) AS anchors, w.amounts FROM a JOIN w USING (doc_id) JOIN (SELECT doc_id, {_of_id(1)} AS policy, {_of_id(2)} AS exception FROM documents) p USING (doc_id) WHERE w.amounts >= 3 AND w.filings >= 2 AND p.policy <> '' GROUP BY ALL""")
def evidence_thresholds(s, d):
    """OP-62: the filings whose unit is proved by a policy and enough anchors in tables, their own included."""
    found = evidence.verify_policy(*_policy_documents(s, d))
    return found.select("doc_id", "filing_id", "scale", "exception", F.size("anchors").cast("long").alias("anchors"), "amounts")


@_query(r"""WITH t AS (SELECT event_id, 'Activos ' || CASE event_id % 4 WHEN 0 THEN '(1,234)' WHEN 1 THEN '12,345.50 (7)' WHEN 2 THEN 'x9 3' ELSE '-5' END || ' ' || CAST(user_id AS VARCHAR) AS line FROM events)
    SELECT event_id, list_transform(regexp_extract_all(line, '(?:^|[^\p{L}\p{N}_.])(\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?)', 1), lambda x: CAST(replace(replace(replace(x, ',', ''), ')', ''), '(', '-') AS DOUBLE)) AS numbers FROM t""")
def number_tokens(s, d):
    line = F.concat(F.lit("Activos "), F.expr("case event_id % 4 when 0 then '(1,234)' when 1 then '12,345.50 (7)' when 2 then 'x9 3' else '-5' end"), F.lit(" "), F.col("user_id").cast("string"))
    return table(s, d, "events").select("event_id", docs.number_tokens(line).cast("array<double>").alias("numbers"))


_HEADERS = ("Expresado en miles de soles (S/)", "En millones de dólares (US$)", "Importes en miles y millones de soles", "Expresado en soles", "Sin unidad")


@_query("SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CASE WHEN pen THEN 'thousands' END WHEN 1 THEN CASE WHEN NOT pen THEN 'millions' END WHEN 3 THEN CASE WHEN pen THEN 'units' END END AS scale FROM (SELECT o_orderkey, o_custkey % 2 = 0 AS pen FROM orders)")
def explicit_scale(s, d):
    """OP-90: one of five headers for each order, in its customer's currency."""
    header = F.element_at(F.array(*map(F.lit, _HEADERS)), (F.pmod("o_orderkey", F.lit(5)) + 1).cast("int"))
    return table(s, d, "orders").select("o_orderkey", docs.explicit_scale(header, F.when(F.col("o_custkey") % 2 == 0, "PEN").otherwise("USD")).alias("scale"))


@_query("SELECT s_suppkey, s_suppkey % 3 <> 1 AND s_suppkey % 2 = 0 AS identified FROM supplier")
def doc_identity(s, d):
    """OP-90: covers made of each supplier's name; every third names another year, every odd one another scope."""
    year = F.expr("if(s_suppkey % 3 = 1, 2023, 2024)").cast("string")
    cover = F.concat(F.regexp_replace("s_name", "#", " # "), F.lit("\nEstados financieros "), F.expr("if(s_suppkey % 2 = 0, 'consolidados', 'separados')"), F.lit(" al 31 de diciembre de "), year)
    return table(s, d, "supplier").select("s_suppkey", docs.doc_identity(cover, F.col("s_name"), F.lit(2024), F.lit("consolidated")).alias("identified"))


def _fragments(s, d):
    return table(s, d, "documents").select(F.col("doc_id").alias("fragment_id"), F.substring_index("text", "\n", 1).alias("heading"), F.expr("substr(text, instr(text, '\n') + 1)").alias("body"))


@_query("SELECT doc_id AS fragment_id FROM documents WHERE contains(lower(text), 'thed th')")
def fragment_search_literal(s, d):
    return table(s, d, "documents").filter(F.contains(F.lower("text"), F.lit("thed th"))).select(F.col("doc_id").alias("fragment_id"))


@_query(f"""WITH f AS (SELECT doc_id, string_split(text, chr(10))[1] AS heading, substr(text, instr(text, chr(10)) + 1) AS body FROM documents),
    h AS (SELECT doc_id, ' ' || {_key_sql('heading')} || ' ' AS hk, ' ' || {_key_sql('body')} || ' ' AS bk, list_filter(string_split({_key_sql('heading')}, ' '), lambda x: x IN ('of', 'the', 'de', 'la')) AS hw, list_filter(string_split({_key_sql('body')}, ' '), lambda x: x IN ('of', 'the', 'de', 'la')) AS bw FROM f)
    SELECT doc_id AS fragment_id, 4.0 * len(hw) + len(bw) AS score FROM h WHERE ((contains(hk, ' of the ') OR contains(bk, ' of the ')) AND NOT contains(hk, ' with ') AND NOT contains(bk, ' with ')) OR contains(hk, ' de la ') OR contains(bk, ' de la ')""")
def fragment_search_terms(s, d):
    """OP-88: alternatives, phrases and exclusions over the posting table."""
    return search.search_terms(checkpointed(search.postings(_fragments(s, d), search.query_terms(QUERY))), QUERY)


_POSTINGS = f"""f AS (SELECT doc_id, string_split(text, chr(10))[1] AS heading, CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE text END AS body FROM documents),
    tokens AS (SELECT doc_id, unnest(list_filter(string_split({_key_sql('heading')}, ' '), lambda x: x <> '')) AS term, unnest(range(0, len(list_filter(string_split({_key_sql('heading')}, ' '), lambda x: x <> '')))) AS pos, 1.0::DOUBLE AS weight FROM f
      UNION ALL SELECT doc_id, unnest(list_filter(string_split({_key_sql('body')}, ' '), lambda x: x <> '')), unnest(range(0, len(list_filter(string_split({_key_sql('body')}, ' '), lambda x: x <> '')))) + {search.BODY}, 0.4::DOUBLE FROM f)"""
_RANKED = lambda terms: f"""{_POSTINGS}, p AS (SELECT *, {', '.join(f"max(pos) FILTER (term = '{t}') OVER w AS p{i}" for i, t in enumerate(terms))} FROM tokens WHERE term IN ({', '.join(map(repr, terms))}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, least({', '.join(f'p{i}' for i in range(len(terms)))}) AS start FROM p WHERE {' AND '.join(f'p{i} IS NOT NULL' for i in range(len(terms)))}), v AS (SELECT *, lag(start) OVER (PARTITION BY doc_id ORDER BY pos) AS prior FROM c),
    ranked AS MATERIALIZED (SELECT doc_id, round(sum(weight / greatest(1.0::DOUBLE, (pos - start + 1)::DOUBLE / {len(terms)})), 6) AS rank FROM v WHERE prior IS NULL OR start > prior GROUP BY doc_id)"""  # noqa: E731


@_query(f"WITH {_RANKED(['from', 'the', 'with'])} SELECT doc_id AS fragment_id, rank FROM ranked")
def fragment_search_ranked(s, d):
    words = "with from the"
    return search.search_ranked(checkpointed(search.postings(_fragments(s, d), search.query_terms(words))), words)


@_query(f"""WITH {_RANKED(['of', 'the'])}, {_NOTES}, n AS (SELECT doc_id, company AS name, fiscal_year, note_number, {_topic_sql('title')} AS topic FROM notes),
    hit AS MATERIALIZED (SELECT n.doc_id AS fragment_id, name, topic <> 'other' AS is_priority, note_number, coalesce(rank, 0) AS rank FROM n JOIN f USING (doc_id) LEFT JOIN ranked USING (doc_id) WHERE fiscal_year = 2025 AND (rank IS NOT NULL OR contains(lower(heading), 'of the') OR contains(lower(body), 'of the')))
    SELECT * FROM (SELECT * FROM hit ORDER BY rank DESC, is_priority DESC, name, note_number, fragment_id LIMIT 20 OFFSET 20), (SELECT count(*) AS total FROM hit)""")
def fragment_search_page(s, d):
    """OP-88: the second page of a search in the notes of one year, by words or literally."""
    named = _noted(s, d).select(F.col("doc_id").alias("fragment_id"), F.col("company").alias("name"), "is_priority", "note_number", "fiscal_year", "company", "topic")
    return search.search_page(_fragments(s, d).join(named, "fragment_id"), " of  the", 2, 20, fiscal_year=2025, company=None, topic=None)


@_query(f"""WITH t AS (SELECT doc_id, list_filter(string_split(regexp_replace(regexp_replace(CASE WHEN contains(text, chr(10)) THEN substr(text, instr(text, chr(10)) + 1) ELSE text END, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents),
    h AS (SELECT doc_id, w, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM t) WHERE regexp_replace({_fold_sql('x')}, '[^a-z0-9]', '', 'g') IN ('with', 'from')),
    a AS (SELECT doc_id, w, i FROM h WHERE n = 1), b AS (SELECT h.doc_id, min(h.i) AS i FROM h JOIN a ON a.doc_id = h.doc_id AND h.i >= a.i + 38 GROUP BY h.doc_id),
    s AS (SELECT doc_id, 1 AS k, i, w FROM a UNION ALL SELECT b.doc_id, 2, b.i, a.w FROM b JOIN a USING (doc_id)), o AS (SELECT doc_id, k, w[greatest(1, i - 2):greatest(1, i - 2) + 37] AS own FROM s),
    e AS (SELECT doc_id, k, own, coalesce(list_min(list_filter(range(12, len(own) + 1), lambda j: regexp_matches(own[j], '[.!?]$'))), 38) AS stop FROM o)
    SELECT doc_id AS fragment_id, string_agg(array_to_string(own[1:stop], ' '), ' … ' ORDER BY k) AS headline FROM e GROUP BY doc_id""")
def headline(s, d):
    return search.headline(_fragments(s, d), ["with", "from"])
