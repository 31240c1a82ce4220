"""Queries over landed records, versions, activity and jobs, with the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.functions import constants as K
from tallyforge.functions.text import collapse, contains_any, digest, fold
from tallyforge.operators import facts
from tallyforge.operators import records as ops
from tallyforge.plans import fact_queries
from tallyforge.sources import keyed
from tallyforge.sources.shared import checkpointed, new_path
from tallyforge.sources.tables import activity, jobs, table, versioned_events

AS_OF = "2001-12-31 00:00:00"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def _envelopes(s, d):
    """Adapter A9: properties and the value, as XML envelopes of lists; what is odd follows from event_id modulo 23.

    0 a bare object, 1 no result, 2 a word and 3 a fraction for the whole number, 4 CDATA, 5 numeric references, 6 an unknown reference, 7 a null, 8 a whole number as text,
    9 a name beyond ASCII as a reference, 10 an element that is empty, 11 a comment, 12 broken JSON, 13 a number in a list.
    """
    v = F.pmod("event_id", F.lit(23))
    k = F.get_json_object("props", "$.k")
    shown = F.when(v == 2, '"x"').when(v == 3, F.concat(k, F.lit(".5"))).when(v == 7, "null").when(v == 8, F.concat(F.lit('"'), k, F.lit('"'))).otherwise(k)
    name = F.when(v == 9, "ñ€").otherwise(F.col("event_type"))
    row = F.concat(F.lit('{"k":'), shown, F.lit(',"name":"'), name, F.lit(' & <co>","amount":'), F.concat(k, F.lit("."), F.col("event_id").cast("string")), F.lit("}"))
    body = F.when(v == 0, row).when(v == 12, F.concat(F.lit("["), row)).when(v == 13, F.concat(F.lit("["), row, F.lit(",5]"))).otherwise(F.concat(F.lit("["), row, F.lit("]")))
    plain = _escaped(body)
    swap = lambda *pairs: reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, plain)
    escaped = F.when(v == 4, F.concat(F.lit("<![CDATA["), body, F.lit("]]>"))).when(v == 5, swap(("&quot;", "&#x22;"), ("&lt;", "&#60;"))).when(v == 6, swap(("&quot;", "&quote;")))
    escaped = escaped.when(v == 9, swap(("ñ", "&#241;"), ("€", "&#x20AC;"))).when(v == 11, F.concat(F.lit("<!-- rows -->"), plain)).otherwise(plain)
    result = F.when(v == 1, F.lit("<m:Fault/>")).when(v == 10, F.lit("<m:ReadRowsResult/>")).otherwise(F.concat(F.lit('<m:ReadRowsResult xsi:type="string">'), escaped, F.lit("</m:ReadRowsResult>")))
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit("<soap:Envelope><soap:Body><ReadRowsResponse>"), result, F.lit("</ReadRowsResponse></soap:Body></soap:Envelope>")).alias("envelope"))


def _escaped(c):
    for plain, entity in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


@_query("""SELECT event_id AS id, CASE WHEN v <> 7 THEN k END AS k, CASE WHEN v = 9 THEN 'ñ€' ELSE event_type END || ' & <co>' AS name, CAST(k || '.' || event_id AS DECIMAL(20,8)) AS amount
    FROM (SELECT *, event_id % 23 AS v, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) WHERE v NOT IN (0, 1, 2, 3, 6, 10, 12, 13)""")
def payload_rows(s, d):
    return ops.payload_rows(ops.unwrap_envelope(_envelopes(s, d), "ReadRows"), "k long, name string, amount decimal(20,8)")[0]


@_query("SELECT event_id AS id, event_id % 23 IN (1, 6, 10) AS no_result FROM events WHERE event_id % 23 IN (0, 1, 2, 3, 6, 10, 12, 13)")
def payload_rejects(s, d):
    """OP-01: what is no list or has a value of another type, and envelopes without a result that can be read."""
    return ops.payload_rows(ops.unwrap_envelope(_envelopes(s, d), "ReadRows"), "k long, name string, amount decimal(20,8)")[1].select("id", F.col("payload").isNull().alias("no_result"))


@_query("SELECT source, sha256(text) AS sha, max(doc_id) AS retrieved_at, count(*) AS row_count FROM documents GROUP BY source, sha256(text)")
def raw_dedupe(s, d):
    return ops.raw_dedupe(table(s, d, "documents").select("source", F.col("text").alias("payload"), F.col("doc_id").alias("retrieved_at")), ["source"])


@_query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE trim(CAST(l_suppkey AS VARCHAR)) = '7'")
def key_filter(s, d):
    return ops.rows_of_key(table(s, d, "lineitem"), "l_suppkey", 7).select("l_orderkey", "l_linenumber", "l_quantity")


@_query("""SELECT c_custkey AS company_id, c_name AS name, o_orderstatus AS state, o_orderdate AS updated_at FROM customer LEFT JOIN
    (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) ON o_custkey = c_custkey AND n = 1""")
def dim_upsert(s, d):
    last = ops.first_per_key(table(s, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(s, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("updated_at"))


@_query("""SELECT company_id, fiscal_year, scope, filing, total FROM (SELECT o_custkey AS company_id, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, o_orderstatus AS scope, o_orderkey AS filing, o_totalprice AS total,
    row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def filing_upsert(s, d):
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderstatus").alias("scope"), F.col("o_orderkey").alias("filing"), F.col("o_totalprice").alias("total"), "o_orderdate")
    return ops.first_per_key(rows, ["company_id", "fiscal_year", "scope"], F.desc("o_orderdate"), F.desc("filing")).drop("o_orderdate")


@_query("""WITH k AS (SELECT o_custkey AS company_id, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, o_orderstatus AS scope, max(o_orderkey) AS filing FROM orders GROUP BY ALL)
    SELECT company_id, fiscal_year, scope, filing, count(l_orderkey) AS lines, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS quantity FROM k LEFT JOIN lineitem ON l_orderkey = filing GROUP BY ALL""")
def filing_replace(s, d):
    """OP-04, OP-05 and OP-16: filings with their lines, of which later batches replace whole keys.

    The first batch has each key's first filing, the second its last one, twice; a third is written but not committed, as if it had failed.
    """
    keys = ["company_id", "fiscal_year", "scope"]
    rows = table(s, d, "orders").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"), F.col("o_orderstatus").alias("scope"), F.col("o_orderkey").alias("filing"))
    items = table(s, d, "lineitem").select(F.col("l_orderkey").alias("filing"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("quantity"))

    def batch(filings):
        return {"filings": filings, "lines": filings.join(items, "filing")}

    root = new_path(s, "filings")
    # made once for all batches; a key whose last filing is its first one has nothing to replace
    ends = checkpointed(rows.groupBy(*keys).agg(F.min("filing").alias("first"), F.max("filing").alias("last")))
    first, later = ends.select(*keys, F.col("first").alias("filing")), ends.filter("first <> last").select(*keys, F.col("last").alias("filing"))
    keyed.replace_keys(root, batch(first), keys, "first")
    for _ in range(2):
        keyed.replace_keys(root, batch(later), keys, "second")
    keyed.stage(root, batch(first), keys, "third")
    lines = keyed.current(s, root, "lines", keys).groupBy(*keys).agg(F.count("*").alias("lines"), F.sum("quantity").cast("long").alias("quantity"))
    found = keyed.current(s, root, "filings", keys).join(lines, keys, "left")
    return found.select(*keys, "filing", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("quantity", F.lit(0)).alias("quantity"))


@_query(r"""WITH listing AS (SELECT s_nationkey AS nation, s_name AS name, 'individual' AS scope, 1 AS scope_rank, s_suppkey AS ord FROM supplier
    UNION ALL SELECT c_nationkey, c_name, 'consolidated', 0, c_custkey FROM customer WHERE c_acctbal > 5000)
    SELECT *, CASE WHEN contains(lower(name), '1') THEN 'full' WHEN contains(lower(name), 'supplier') THEN 'unsupported' ELSE 'basic' END AS support_level FROM (
    SELECT nation, regexp_replace(trim(arg_min(name, scope_rank * 1000000000 + ord)), '\s+', ' ', 'g') AS name, list_sort(list(DISTINCT scope)) AS available_scopes, CASE WHEN bool_or(scope = 'consolidated') THEN 'consolidated' ELSE 'individual' END AS preferred_scope FROM listing WHERE trim(name) <> '' AND nation IS NOT NULL GROUP BY nation)""")
def catalog_merge(s, d):
    """OP-06: per-scope listings to one row an issuer: attributes of the first row seen, scopes consolidated first, by folded name.

    The balance condition stands for the issuers that a listing holds; digits and a word stand for the support hints.
    """
    a = table(s, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"), F.lit("individual").alias("scope"), F.lit(1).alias("scope_rank"), F.col("s_suppkey").alias("ord"))
    b = table(s, d, "customer").filter("c_acctbal > 5000").select(F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"), F.lit("consolidated").alias("scope"), F.lit(0).alias("scope_rank"), F.col("c_custkey").alias("ord"))
    rows = a.unionByName(b).filter("trim(name) <> '' and nation is not null")
    scopes = F.array_sort(F.collect_set("scope"))  # "consolidated" sorts before "individual"
    one = rows.groupBy("nation").agg(collapse(F.min_by("name", F.struct("scope_rank", "ord"))).alias("name"), scopes.alias("available_scopes"), F.min("scope").alias("preferred_scope"))
    return one.withColumn("support_level", classify_support(["name"], finance=("supplier",), mining=("1",))).orderBy(fold("name"), "nation")


@_query("""WITH existing AS (SELECT c_custkey AS company_id, CASE WHEN c_custkey % 3 = 0 THEN 'completed' WHEN c_custkey % 3 = 1 THEN 'queued' END AS status, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'O' END AS scope FROM customer),
    arriving AS (SELECT o_custkey AS company_id, list(DISTINCT o_orderstatus) AS scopes, max(CAST(year(o_orderdate) AS INTEGER)) AS last_year FROM orders GROUP BY 1)
    SELECT company_id, CASE WHEN status IN ('completed', 'review_required') THEN status ELSE coalesce(CASE WHEN scopes IS NOT NULL THEN 'available' END, status, 'unknown') END AS status,
    CASE WHEN scopes IS NULL OR list_contains(scopes, scope) THEN scope ELSE list_sort(scopes)[1] END AS scope, coalesce(last_year, 0) AS fiscal_year
    FROM existing FULL OUTER JOIN arriving USING (company_id)""")
def coverage_merge(s, d):
    """OP-07: protected states stay, a preferred scope stays while it is available, a missing year is filled."""
    existing = table(s, d, "customer").selectExpr("c_custkey as company_id", "case when c_custkey % 3 = 0 then 'completed' when c_custkey % 3 = 1 then 'queued' end as status", "if(c_custkey % 2 = 0, 'F', 'O') as scope")
    arriving = table(s, d, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.array_sort(F.collect_set("o_orderstatus")).alias("scopes"), F.max(F.year("o_orderdate")).alias("last_year"))
    both = existing.join(arriving, "company_id", "full_outer")
    status = F.when(F.col("status").isin("completed", "review_required"), F.col("status")).otherwise(F.coalesce(F.when(F.col("scopes").isNotNull(), "available"), "status", F.lit("unknown")))
    scope = F.when(F.col("scopes").isNull() | F.array_contains("scopes", F.col("scope")), F.col("scope")).otherwise(F.element_at("scopes", 1))
    return both.select("company_id", status.alias("status"), scope.alias("scope"), F.coalesce("last_year", F.lit(0)).alias("fiscal_year"))


@_query("""WITH o AS (SELECT o_custkey, count(*) AS filings, max(CAST(year(o_orderdate) AS INTEGER)) AS last_year, list_sort(list(DISTINCT o_orderstatus)) AS scopes, arg_max(o_orderstatus, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS latest_scope FROM orders GROUP BY 1)
    SELECT c_custkey AS company_id, coalesce(filings, 0) AS filings, last_year, scopes, latest_scope, CASE WHEN filings IS NULL THEN 'none' WHEN filings >= 10 THEN 'complete' ELSE 'partial' END AS step FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def coverage_backfill(s, d):
    """OP-08: the children are aggregated once, then joined."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("filings"), F.max(F.year("o_orderdate")).alias("last_year"), F.array_sort(F.collect_set("o_orderstatus")).alias("scopes"), F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("latest_scope"))
    joined = table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    step = F.when(F.col("filings").isNull(), "none").when(F.col("filings") >= 10, "complete").otherwise("partial")
    return joined.select(F.col("c_custkey").alias("company_id"), F.coalesce("filings", F.lit(0)).alias("filings"), "last_year", "scopes", "latest_scope", step.alias("step"))


@_query(r"""WITH r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN replace(url, 'http://', 'https://') ELSE url END AS url, 1998 + page_id % 20 AS y, CASE page_id % 6 WHEN 0 THEN 'A' WHEN 5 THEN 'Q' ELSE CAST(page_id % 6 AS VARCHAR) END AS period, CASE page_id % 4 WHEN 3 THEN 'other' WHEN 2 THEN 'consolidated' ELSE 'individual' END AS scope, page_id % 3 AS tokens, page_id // 2 AS k, page_id % 13 <> 0 AS named FROM pages),
    c AS (SELECT page_id, regexp_matches(url, '^https://[^/?#]+') AS https, y >= 2000 AS year, period IN ('A', '1', '2', '3', '4') AS period, scope IN ('individual', 'consolidated') AS scope, tokens >= 2 AS identity, named AS document_name, count(*) OVER (PARTITION BY k) = 1 AS single FROM r)
    SELECT page_id, concat_ws(',', CASE WHEN NOT https THEN 'source_url' END, CASE WHEN NOT year THEN 'fiscal_year' END, CASE WHEN NOT period THEN 'period_code' END, CASE WHEN NOT scope THEN 'scope' END, CASE WHEN NOT identity THEN 'identity_tokens' END, CASE WHEN NOT document_name THEN 'document_name' END, CASE WHEN NOT single THEN 'source_key' END) AS errors FROM c""")
def source_catalog_validate(s, d):
    """OP-09: a JSON list of sources, made of the pages, with every rule that an entry breaks."""
    url = F.when(F.pmod("page_id", F.lit(5)) == 0, F.replace("url", F.lit("http://"), F.lit("https://"))).otherwise(F.col("url"))
    tokens = F.slice(F.array(F.lit("a"), F.lit("b")), F.lit(1), F.pmod("page_id", F.lit(3)).cast("int"))
    period = F.expr("case page_id % 6 when 0 then 'A' when 5 then 'Q' else string(page_id % 6) end")
    scope = F.expr("case page_id % 4 when 3 then 'other' when 2 then 'consolidated' else 'individual' end")
    name = F.when(F.pmod("page_id", F.lit(13)) == 0, F.lit("  ")).otherwise(F.lit("report.pdf"))
    entry = F.struct(F.floor(F.col("page_id") / 2).cast("string").alias("source_key"), F.lit("B1").alias("company_id"), (F.lit(1998) + F.pmod("page_id", F.lit(20))).cast("int").alias("fiscal_year"), period.alias("period_code"), scope.alias("scope"), name.alias("document_name"), url.alias("source_url"), tokens.alias("identity_tokens"))
    lists = table(s, d, "pages").select(F.col("page_id").alias("id"), F.to_json(F.array(entry)).alias("payload"))
    return ops.source_entries(lists)[0].select(F.col("id").alias("page_id"), "errors")


@_query("""SELECT source_key, s_suppkey, n_name, n_name IS NULL AS rejected FROM (SELECT s_name AS source_key, s_suppkey, CASE WHEN s_suppkey % 17 = 0 THEN -1 ELSE s_nationkey END AS nk FROM supplier) LEFT JOIN nation ON nk = n_nationkey""")
def source_register(s, d):
    """OP-10: sources with their company resolved; an unknown company is a reject."""
    rows = table(s, d, "supplier").selectExpr("s_name as source_key", "s_suppkey", "if(s_suppkey % 17 = 0, -1, s_nationkey) as nk")
    return rows.join(table(s, d, "nation"), F.col("nk") == F.col("n_nationkey"), "left").select("source_key", "s_suppkey", "n_name", F.col("n_name").isNull().alias("rejected"))


@_query("""SELECT 'status_known' AS rule, count(*) FILTER (o_orderstatus NOT IN ('F','O','P')) AS violations FROM orders UNION ALL SELECT 'price_positive', count(*) FILTER (NOT o_totalprice > 0) FROM orders
    UNION ALL SELECT 'priority_not_blank', count(*) FILTER (NOT trim(o_orderpriority) <> '') FROM orders UNION ALL SELECT 'before_2000', count(*) FILTER (NOT year(o_orderdate) < 2000) FROM orders
    UNION ALL SELECT 'urgent_open_has_price', count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus = 'O' AND NOT o_totalprice > 1000) FROM orders UNION ALL SELECT 'pair_status', count(*) FILTER ((o_orderstatus = 'F') <> (o_orderdate < TIMESTAMP '1996-01-01')) FROM orders
    UNION ALL SELECT 'one_current', (SELECT count(*) FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey HAVING count(*) > 1)) UNION ALL SELECT 'unique_line', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))""")
def constraint_audit(s, d):
    rules = {"status_known": "o_orderstatus in ('F','O','P')", "price_positive": "o_totalprice > 0", "priority_not_blank": "trim(o_orderpriority) <> ''", "before_2000": "year(o_orderdate) < 2000"}
    # a field that one state needs, a status that two fields must agree on, and one current row a key
    rules |= {"urgent_open_has_price": "not (o_orderpriority = '1-URGENT' and o_orderstatus = 'O') or o_totalprice > 1000", "pair_status": "(o_orderstatus = 'F') = (o_orderdate < timestamp_ntz'1996-01-01')"}
    current = ops.duplicate_keys(table(s, d, "orders").filter("o_orderstatus = 'P'"), ["o_custkey"]).agg(F.lit("one_current").alias("rule"), F.count("*").alias("violations"))
    unique = ops.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.lit("unique_line").alias("rule"), F.count("*").alias("violations"))
    return ops.constraint_audit(table(s, d, "orders"), rules).unionByName(unique).unionByName(current)


@_query(f"""SELECT *, companies >= 5 AND filings >= 100 AND facts >= 1000 AND computed_metrics > 0 AND failed_validations < 100000 AND events > 0 AND note_documents > 0 AND notes >= 100 AS complete FROM (SELECT count(*) AS companies FROM supplier), (SELECT count(*) AS filings FROM orders), (SELECT count(*) AS facts FROM lineitem),
    (SELECT CAST(sum(n) FILTER (status = 'computed') AS BIGINT) AS computed_metrics, CAST(coalesce(sum(n) FILTER (status <> 'computed'), 0) AS BIGINT) AS unavailable_metrics FROM ({fact_queries.ORACLE["metrics_status_counts"]})), (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS failed_validations FROM ({fact_queries.ORACLE["validations_failed"]}) WHERE status = 'failed'),
    (SELECT count(DISTINCT (event_type, user_id % 50)) AS events FROM events), (SELECT count(DISTINCT (source, lang, doc_id // 20 % 2)) AS note_documents, count(*) AS notes FROM documents)""")
def completeness_audit(s, d):
    """OP-13: one row of nine counts against expected minima; each side of the cross join is one row."""
    metrics = fact_queries.QUERIES["metrics_status_counts"](s, d)
    failed = fact_queries.QUERIES["validations_failed"](s, d).filter("status = 'failed'")
    whole = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    documents = table(s, d, "documents").select("source", "lang", F.pmod(F.floor(F.col("doc_id") / 20), F.lit(2)).alias("year"))
    parts = [
        table(s, d, "supplier").agg(F.count("*").alias("companies")), table(s, d, "orders").agg(F.count("*").alias("filings")), table(s, d, "lineitem").agg(F.count("*").alias("facts")),
        metrics.agg(whole(F.col("status") == "computed").alias("computed_metrics"), whole(F.col("status") != "computed").alias("unavailable_metrics")), failed.agg(whole(F.lit(True)).alias("failed_validations")),
        versioned_events(table(s, d, "events")).agg(F.countDistinct("provider", "external_id").alias("events")), documents.agg(F.countDistinct("source", "lang", "year").alias("note_documents"), F.count("*").alias("notes")),
    ]
    out = reduce(lambda a, b: a.crossJoin(b), parts)
    return out.withColumn("complete", F.expr("companies >= 5 and filings >= 100 and facts >= 1000 and computed_metrics > 0 and failed_validations < 100000 and events > 0 and note_documents > 0 and notes >= 100"))


@_query("SELECT c_custkey, c_mktsegment, n_name, CASE WHEN contains(lower(c_mktsegment), 'mach') THEN 'PEN' WHEN contains(lower(c_mktsegment), 'auto') THEN 'USD' END AS currency, CASE WHEN n_regionkey = 0 THEN 'individual' WHEN n_regionkey = 1 THEN 'consolidated' END AS scope FROM customer JOIN nation ON c_nationkey = n_nationkey")
def currency_map(s, d):
    """OP-20: substrings decide, in order; what is in neither is unknown."""
    rows = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "c_mktsegment", "n_name", map_currency(F.col("c_mktsegment"), "mach", "auto").alias("currency"), F.expr("case n_regionkey when 0 then 'individual' when 1 then 'consolidated' end").alias("scope"))


def map_currency(c, first: str = "sol", second: str = "lares"):
    low = F.lower(c)
    return F.when(low.contains(first), "PEN").when(low.contains(second), "USD")


def classify_support(texts, activity_code=None, known_id=None, known=(), finance=K.FINANCE_HINTS, mining=K.MINING_HINTS):
    """OP-21: how far a company is supported, by its id, activity code, and name, type and sector (texts); the order of the tests matters."""
    text = fold(F.concat_ws(" ", *texts))
    code = F.left(F.trim(activity_code), F.lit(2)) if activity_code is not None else F.lit("")
    is_known = F.coalesce(known_id.isin(*known), F.lit(False)) if known_id is not None and known else F.lit(False)
    return F.when(is_known | code.isin(*K.FULL_ACTIVITY) | contains_any(text, mining), "full").when(code.isin(*K.UNSUPPORTED_ACTIVITY) | contains_any(text, finance), "unsupported").otherwise("basic")


@_query("""SELECT p_partkey, p_name, CASE WHEN p_partkey IN (3, 5) OR left(lpad(CAST(p_size + 30 AS VARCHAR), 2, '0'), 2) IN ('07', '08') OR contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'steel') OR contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'promo') THEN 'full'
    WHEN left(CAST(p_size + 30 AS VARCHAR), 2) IN ('64', '65', '66') OR contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'blue') OR contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'brand#2') THEN 'unsupported' ELSE 'basic' END AS support FROM part""")
def support_classify(s, d):
    code = (F.col("p_size") + 30).cast("string")
    return table(s, d, "part").select("p_partkey", "p_name", classify_support(["p_name", "p_brand", "p_type"], code, F.col("p_partkey"), (3, 5), finance=("blue", "brand#2"), mining=("steel", "promo")).alias("support"))


@_query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('D W')) OR contains(lower(p_name), lower('r_ng')) OR contains(lower(p_name), '%') OR contains(lower(p_name), 'ring')")
def literal_search(s, d):
    p = table(s, d, "part").select("p_partkey", "p_name")
    return ops.literal_search(p, "p_name", "D W").union(ops.literal_search(p, "p_name", "r_ng")).union(ops.literal_search(p, "p_name", "%")).union(ops.literal_search(p, "p_name", "ring")).distinct()


@_query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(coalesce(c_name, '')), 'build') OR contains(lower(coalesce(c_mktsegment, '')), 'build')")
def directory_search(s, d):
    """OP-28: the text in any of several columns; nulls do not match."""
    return table(s, d, "customer").filter(F.exists(F.array("c_name", "c_mktsegment"), lambda c: F.coalesce(F.lower(c).contains("build"), F.lit(False)))).select("c_custkey", "c_name", "c_mktsegment")


_RAW_EVENTS = """raw AS (SELECT event_id, CASE WHEN event_id % 29 = 0 THEN '' ELSE ' B' || CAST(user_id AS VARCHAR) || ' ' END AS company_id, 'prov' AS source_provider, CAST(event_id AS VARCHAR) AS external_id, CASE event_type WHEN 'view' THEN ' debt ' WHEN 'click' THEN 'dividends' WHEN 'purchase' THEN 'operations' WHEN 'signup' THEN 'meetings' ELSE 'gossip' END AS category,
    '  Title ' || repeat('x', CAST(event_id % 260 AS INTEGER)) AS title, ' ' || repeat('s', CAST(event_id % 1300 + 1 AS INTEGER)) AS summary, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN '+00:00' WHEN 2 THEN '-05:00' ELSE 'Z' END AS published_at,
    CASE event_id % 5 WHEN 0 THEN '2024-02-30' WHEN 1 THEN '2024-02-29' WHEN 2 THEN '' ELSE NULL END AS effective_date, CASE event_id % 6 WHEN 0 THEN 'http://h.org/a' WHEN 1 THEN 'https:///a' ELSE ' https://h.org/a?b ' END AS source_url FROM events)"""


@_query(rf"""WITH {_RAW_EVENTS}, c AS (SELECT *, concat_ws(',', CASE WHEN company_id = '' THEN 'required' END, CASE WHEN trim(category) NOT IN ('dividends', 'management', 'meetings', 'debt', 'operations', 'litigation', 'production', 'other') THEN 'category' END,
      CASE WHEN NOT regexp_matches(trim(source_url), '^https://[^/?#]+') THEN 'source_url' END, CASE WHEN NOT regexp_matches(published_at, '(Z|[+-][0-9][0-9]:[0-9][0-9])$') THEN 'published_at' END, CASE WHEN effective_date = '2024-02-30' THEN 'effective_date' END,
      CASE WHEN length(trim(title)) > 240 THEN 'title' END, CASE WHEN length(trim(summary)) > 1200 THEN 'summary' END) AS errors FROM raw)
    SELECT event_id, errors, CASE WHEN errors = '' THEN trim(company_id) END AS company_id, CASE WHEN errors = '' THEN trim(category) END AS category, CASE WHEN errors = '' THEN trim(title) END AS title, CASE WHEN errors = '' THEN nullif(effective_date, '') END AS effective_date FROM c""")
def event_validate(s, d):
    """OP-29: every failing rule of a record is named; a record without any is valid and comes normalised."""
    raw = table(s, d, "events").selectExpr(
        "event_id", "if(event_id % 29 = 0, '', concat(' B', user_id, ' ')) as company_id", "'prov' as source_provider", "string(event_id) as external_id", "case event_type when 'view' then ' debt ' when 'click' then 'dividends' when 'purchase' then 'operations' when 'signup' then 'meetings' else 'gossip' end as category",
        "concat('  Title ', repeat('x', int(event_id % 260))) as title", "concat(' ', repeat('s', int(event_id % 1300 + 1))) as summary", "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), case event_id % 4 when 0 then '' when 1 then '+00:00' when 2 then '-05:00' else 'Z' end) as published_at",
        "case event_id % 5 when 0 then '2024-02-30' when 1 then '2024-02-29' when 2 then '' end as effective_date", "case event_id % 6 when 0 then 'http://h.org/a' when 1 then 'https:///a' else ' https://h.org/a?b ' end as source_url",
    )
    found = ops.validate_events(raw)
    return found.select("event_id", "errors", "company_id", "category", "title", "effective_date")


@_query("""SELECT event_id, sha256('{"event_type":"' || event_type || '","nested":{"list":[' || user_id || ',null,' || event_id || '],"map":{' || CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN '"a\\"":null,' ELSE '"a\\"":' || event_id || ',' END || '"é":' || user_id || '},"none":null},"props":' || to_json(props)::VARCHAR || ',"user_id":' || user_id || '}') AS hash FROM events""")
def canonical_hash(s, d):
    """OP-30: a digest of nested records; fields and keys come in another order than they are written in."""
    pairs = F.when(F.pmod("event_id", F.lit(3)) == 0, F.create_map(F.lit("é"), F.col("user_id"))).otherwise(F.create_map(F.lit("é"), F.col("user_id"), F.lit('a"'), F.when(F.pmod("event_id", F.lit(3)) == 2, F.col("event_id"))))
    rows = table(s, d, "events").withColumn("nested", F.struct(F.lit(None).cast("string").alias("none"), pairs.alias("map"), F.array("user_id", F.lit(None).cast("long"), "event_id").alias("list")))
    return rows.select("event_id", ops.canonical_digest(rows, ["user_id", "nested", "props", "event_type"]).alias("hash"))


@_query("SELECT o_orderkey AS job_id, o_orderstatus AS status, c_name AS requested_by FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def job_detail(s, d):
    """OP-32: the optional parent may be absent."""
    users = table(s, d, "customer").filter("c_acctbal > 0")
    return table(s, d, "orders").join(users, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("c_name").alias("requested_by"))


@_query("""SELECT c_custkey, job_id, status FROM customer LEFT JOIN (SELECT o_custkey, o_orderkey AS job_id, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'O' DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) ON o_custkey = c_custkey AND n = 1""")
def latest_job(s, d):
    """OP-33: active jobs first, then the newest."""
    last = ops.first_per_key(table(s, d, "orders"), ["o_custkey"], F.desc(F.col("o_orderstatus") == "O"), F.desc("o_orderdate"), F.desc("o_orderkey"))
    return table(s, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))


@_query("""SELECT c_custkey, count(DISTINCT o_orderkey) AS filings, count(l_linenumber) FILTER (l_returnflag = 'R') AS flagged FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND (c_custkey % 2 = 0 OR year(o_orderdate) = 1996 + c_custkey % 5)
    LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def catalog_stats(s, d):
    """OP-34 and OP-56: counts under a limit that only some parents set; children are counted before they join, so nothing fans out."""
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    lines = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("flagged"))
    kept = o.filter("o_custkey % 2 = 0 or y = 1996 + o_custkey % 5").join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    per = kept.groupBy("o_custkey").agg(F.count("*").alias("filings"), F.sum(F.coalesce("flagged", F.lit(0))).alias("flagged"))
    return c.join(per, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("filings", F.lit(0)).alias("filings"), F.coalesce("flagged", F.lit(0)).alias("flagged"))


@_query("SELECT a.o_custkey AS company_id, a.o_orderkey AS current_id, b.o_orderkey AS previous_id FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AND year(b.o_orderdate) = year(a.o_orderdate) - 1")
def period_pairs(s, d):
    """OP-35: documents of one company and kind in successive years; an equi-join on year - 1."""
    o = table(s, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", F.year("o_orderdate").alias("y"), "o_orderkey")
    prev = o.select("o_custkey", "o_orderstatus", "o_orderpriority", (F.col("y") + 1).alias("y"), F.col("o_orderkey").alias("previous_id"))
    return o.join(prev, ["o_custkey", "o_orderstatus", "o_orderpriority", "y"]).select(F.col("o_custkey").alias("company_id"), F.col("o_orderkey").alias("current_id"), "previous_id")


@_query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01')")
def active_users(s, d):
    return table(s, d, "customer").join(table(s, d, "orders").filter("o_orderdate >= timestamp_ntz'2000-01-01'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@_query("""SELECT DISTINCT o_custkey AS company_id, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year FROM orders o WHERE o_orderstatus = 'O' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'N')
    AND (EXISTS (SELECT 1 FROM customer WHERE c_custkey = o.o_custkey AND c_acctbal < 0) OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity >= 49))""")
def refresh_candidates(s, d):
    """OP-37b: semi-joins joined by OR become flags of one aggregate each."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "N").alias("has_metric"), F.bool_or(F.col("l_quantity") >= 49).alias("has_source"))
    low = table(s, d, "customer").filter("c_acctbal < 0").select("c_custkey", F.lit(True).alias("has_origin"))
    rows = table(s, d, "orders").filter("o_orderstatus = 'O'").join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(low, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.filter("has_metric and (coalesce(has_origin, false) or has_source)").select(F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year")).distinct()


@_query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND year(o_orderdate) = 1997)")
def unrecorded(s, d):
    """OP-38: customers without a pending order of one year."""
    return table(s, d, "customer").join(table(s, d, "orders").filter("o_orderstatus = 'P' and year(o_orderdate) = 1997"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@_query("SELECT o_orderkey AS job_id, step, CAST(ord AS INTEGER) AS ord FROM orders, (VALUES ('statements', 1), ('metrics', 2), ('documents', 3), ('summaries', 4)) t(step, ord) WHERE o_orderstatus <> 'F'")
def job_steps_expand(s, d):
    """OP-39: the fixed steps of each open job, exploded in place."""
    steps = F.array(*(F.struct(F.lit(x).alias("step"), F.lit(i).alias("ord")) for i, x in enumerate(K.JOB_STEPS, 1)))
    return table(s, d, "orders").filter("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("job_id"), F.inline(steps))


@_query("SELECT o_orderkey AS filing, count(l_linenumber) AS facts, count(l_linenumber) FILTER (l_returnflag <> 'N') AS mapped, count(l_linenumber) FILTER (l_tax > 0.07) AS failed FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def filing_stats(s, d):
    """OP-50b: three counts of a filing's children from one aggregate."""
    li = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("facts"), F.count_if(F.col("l_returnflag") != "N").alias("mapped"), F.count_if(F.col("l_tax") > 0.07).alias("failed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(s, d, "orders").join(li, F.col("l_orderkey") == F.col("o_orderkey"), "left").select(F.col("o_orderkey").alias("filing"), zero("facts"), zero("mapped"), zero("failed"))


@_query("SELECT event_id, event_type, CASE event_type WHEN 'view' THEN CAST(json_extract(props, '$.k') AS BIGINT) * 2 WHEN 'click' THEN CAST(json_extract(props, '$.k') AS BIGINT) + 1 ELSE -CAST(json_extract(props, '$.k') AS BIGINT) END AS recomputed FROM events WHERE value < 50")
def json_recompute(s, d):
    """OP-51: values recomputed from stored JSON inputs, for rows of one reason only."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(s, d, "events").filter("value < 50").select("event_id", "event_type", F.when(F.col("event_type") == "view", k * 2).when(F.col("event_type") == "click", k + 1).otherwise(-k).alias("recomputed"))


@_query("""WITH f AS (SELECT o_orderkey AS filing, o_custkey AS company_id, year(o_orderdate) AS fiscal_year, o_orderstatus AS status, CASE o_orderkey % 2 WHEN 0 THEN 'individual' ELSE 'consolidated' END AS scope,
    CASE o_orderkey % 3 WHEN 0 THEN 'thousands' WHEN 1 THEN 'millions' ELSE 'unknown' END AS scale, o_orderdate AS updated_at, CAST(left(o_orderpriority, 1) AS INTEGER) // 3 AS payload FROM orders),
    l AS (SELECT *, row_number() OVER (PARTITION BY company_id, fiscal_year, scope, payload ORDER BY updated_at DESC, scale DESC) AS k FROM f WHERE status = 'F' AND scale <> 'unknown')
    SELECT o.filing, coalesce(l.scale, 'unknown') AS reused FROM f o LEFT JOIN l ON l.k = 1 AND l.company_id = o.company_id AND l.fiscal_year = o.fiscal_year AND l.scope = o.scope AND l.payload = o.payload WHERE o.status = 'O'""")
def scale_reuse(s, d):
    """OP-53: orders as filings of one period and statement; finished ones hold verified scales, open ones ask for one."""
    scope = F.when(F.col("o_orderkey") % 2 == 0, "individual").otherwise("consolidated")
    scale = F.when(F.col("o_orderkey") % 3 == 0, "thousands").when(F.col("o_orderkey") % 3 == 1, "millions").otherwise("unknown")
    payload = digest(F.floor(F.left("o_orderpriority", F.lit(1)).cast("int") / 3))
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("filing"), F.col("o_custkey").alias("company_id"), F.year("o_orderdate").alias("fiscal_year"), F.lit("A").alias("period_code"), F.lit("balance_sheet").alias("statement"), F.col("o_orderstatus").alias("status"), scope.alias("scope"), scale.alias("scale"), F.col("o_orderdate").alias("updated_at"), payload.alias("payload"))
    keys = ["company_id", "fiscal_year", "period_code", "scope", "statement", "payload"]
    return facts.reuse_scale(o.filter("status = 'O'"), keys, o.filter("status = 'F'")).select("filing", "reused")


@_query("SELECT coalesce(status, 'all') AS status, n FROM (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus))")
def status_counts(s, d):
    return table(s, d, "orders").rollup("o_orderstatus").agg(F.count("*").alias("n")).select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), "n")


@_query("SELECT count(*) AS events, count(DISTINCT user_id) FILTER (event_type <> 'error') AS users, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'purchase') AS purchases, max(ts) AS last_at FROM events")
def activity_summary(s, d):
    """OP-55: filtered and distinct counts in one pass; only human users count."""
    a = activity(table(s, d, "events"))
    return a.agg(F.count("*").alias("events"), F.countDistinct(F.when(F.col("actor_type") == "human", F.col("user_id"))).alias("users"), F.count_if(F.col("action") == "view").alias("views"), F.count_if(F.col("action") == "purchase").alias("purchases"), F.max("created_at").alias("last_at"))


@_query("""SELECT c_custkey AS user_id, c_name, last_at, coalesce(requests, 0) AS requests FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_at, count(*) FILTER (o_orderdate >= TIMESTAMP '1999-01-01') AS requests FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def user_list(s, d):
    """OP-57 and OP-78: users by last activity, those without any at the end."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_at"), F.count_if(F.col("o_orderdate") >= F.lit("1999-01-01").cast("timestamp_ntz")).alias("requests"))
    return table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(F.col("c_custkey").alias("user_id"), "c_name", "last_at", F.coalesce("requests", F.lit(0)).alias("requests")).orderBy(F.desc_nulls_last("last_at"), "c_name")


@_query("""SELECT c_custkey AS company_id, c_name AS name, max(o_orderdate) AS last_completed_at FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING bool_or(o_orderstatus = 'F') AND NOT bool_or(o_orderstatus = 'O') ORDER BY last_completed_at DESC, name LIMIT 6""")
def panel_available(s, d):
    """OP-58: the six companies of the panel whose analysis was completed last, of those that are available and not active; six are the panel's own limit."""
    o = table(s, d, "orders").groupBy(F.col("o_custkey").alias("company_id")).agg(F.bool_or(F.col("o_orderstatus") == "O").alias("active"), F.bool_or(F.col("o_orderstatus") == "F").alias("done"), F.max("o_orderdate").alias("last_completed_at"))
    named = table(s, d, "customer").select(F.col("c_custkey").alias("company_id"), F.col("c_name").alias("name"))
    return named.join(o.filter("done and not active"), "company_id").select("company_id", "name", "last_completed_at").orderBy(F.desc_nulls_last("last_completed_at"), "name").limit(6)


@_query("""WITH j AS (SELECT c_custkey, c_acctbal, count(o_orderkey) FILTER (o_orderstatus = 'O') > 0 AS active, count(o_orderkey) FILTER (o_orderstatus = 'F') > 0 AS done FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)
    SELECT count(*) FILTER (active) AS active, count(*) FILTER (NOT active AND done) AS available, count(*) FILTER (NOT active AND NOT done AND c_acctbal >= 0) AS compatible, count(*) FILTER (NOT active AND NOT done AND c_acctbal < 0) AS attention FROM j""")
def panel_overview(s, d):
    """OP-58: each company counts once; active wins."""
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.bool_or(F.col("o_orderstatus") == "O").alias("active"), F.bool_or(F.col("o_orderstatus") == "F").alias("done"))
    j = table(s, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_acctbal", F.coalesce("active", F.lit(False)).alias("a"), F.coalesce("done", F.lit(False)).alias("dn"))
    return j.agg(F.count_if("a").alias("active"), F.count_if(F.expr("not a and dn")).alias("available"), F.count_if(F.expr("not a and not dn and c_acctbal >= 0")).alias("compatible"), F.count_if(F.expr("not a and not dn and c_acctbal < 0")).alias("attention"))


@_query("SELECT p_partkey, p_name, total FROM (SELECT * FROM part WHERE p_size > 10 ORDER BY p_name, p_partkey LIMIT 25 OFFSET 25), (SELECT count(*) AS total FROM part WHERE p_size > 10)")
def paged_with_total(s, d):
    return ops.page(table(s, d, "part").filter("p_size > 10"), [F.col("p_name"), F.col("p_partkey")], 2, 25).select("p_partkey", "p_name", "total")


_VERSIONS = """WITH a AS (SELECT event_type AS provider, user_id % 50 AS external_id, ts, event_id, sha256(props) AS digest FROM events),
    b AS (SELECT *, lag(digest) OVER w AS before FROM a WINDOW w AS (PARTITION BY provider, external_id ORDER BY ts, event_id)),
    c AS (SELECT *, row_number() OVER w AS version, lead(event_id) OVER w IS NULL AS is_current, row_number() OVER (PARTITION BY provider, external_id, digest ORDER BY ts, event_id) > 1 AS is_reversion FROM b WHERE digest IS DISTINCT FROM before WINDOW w AS (PARTITION BY provider, external_id ORDER BY ts, event_id))"""


@_query(_VERSIONS + " SELECT provider, external_id, event_id, CAST(version AS INTEGER) AS version, is_current, is_reversion FROM c")
def event_versions(s, d):
    # the keys of this adapter stay as few as they are, however many events there are
    found = ops.scd2_versions(versioned_events(table(s, d, "events")), ["provider", "external_id"], ["ts", "event_id"], chunked=True)
    return found.select("provider", "external_id", "event_id", "version", "is_current", "is_reversion")


@_query(_VERSIONS + " SELECT provider, count(*) AS imported, count(*) FILTER (version > 1) AS versioned, (SELECT count(*) FROM a WHERE a.provider = c.provider) - count(*) AS unchanged FROM c GROUP BY provider")
def event_version_stats(s, d):
    rows = versioned_events(table(s, d, "events"))
    found = ops.scd2_versions(rows, ["provider", "external_id"], ["ts", "event_id"]).groupBy("provider").agg(F.count("*").alias("imported"), F.count_if(F.col("version") > 1).alias("versioned"))
    return found.join(rows.groupBy("provider").agg(F.count("*").alias("n")), "provider").select("provider", "imported", "versioned", (F.col("n") - F.col("imported")).alias("unchanged"))


@_query("""SELECT source, doc_id, CAST(row_number() OVER w AS INTEGER) AS version, lead(doc_id) OVER w IS NULL AS is_current FROM (SELECT source, sha256(text) AS sha, doc_id % 2 AS extractor, min(doc_id) AS doc_id FROM documents GROUP BY ALL) WINDOW w AS (PARTITION BY source ORDER BY doc_id)""")
def doc_versions(s, d):
    rows = table(s, d, "documents").select("source", F.sha2("text", 256).alias("sha"), F.pmod("doc_id", F.lit(2)).alias("extractor"), "doc_id")
    return ops.first_seen_versions(rows, ["source"], ["sha", "extractor"], ["doc_id"]).select("source", "doc_id", "version", "is_current")


@_query("""SELECT user_id, event_id, CASE WHEN before IS NULL AND n = 1 THEN 'insert' ELSE 'update' END AS kind FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR event_type IS DISTINCT FROM before""")
def change_log(s, d):
    return ops.change_log(table(s, d, "events"), ["user_id"], ["ts", "event_id"], ["event_type"]).select("user_id", "event_id", "kind")


@_query("SELECT o_custkey, o_orderpriority, max(o_orderkey) AS latest FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderstatus DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1 GROUP BY ALL")
def latest_version(s, d):
    return ops.first_per_key(table(s, d, "orders"), ["o_custkey", "o_orderpriority"], F.desc("o_orderstatus"), F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("latest"))


@_query("""SELECT o_custkey, o_orderkey AS report, NOT exact AS stale FROM (SELECT *, o_orderpriority = '1-URGENT' AS exact, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def stale_match(s, d):
    """OP-68: an exact match first, else the newest, marked stale."""
    rows = table(s, d, "orders").withColumn("exact", F.col("o_orderpriority") == "1-URGENT")
    return ops.first_per_key(rows, ["o_custkey"], F.desc("exact"), F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("report"), (~F.col("exact")).alias("stale"))


@_query("SELECT event_id AS event_key, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS n, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) >= 2 AS over_limit FROM events")
def sliding_rate(s, d):
    return ops.sliding_rate(activity(table(s, d, "events")).select("event_key", "user_id", "created_at"), 86_400, 2).drop("created_at")


@_query(f"SELECT o_custkey AS company_id, count(*) FILTER (o_orderstatus <> 'F' OR o_orderdate > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) AS used, count(*) FILTER (o_orderstatus <> 'F') AS active, count(*) FILTER (o_orderstatus <> 'F' OR o_orderdate > TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY) >= 10 AS exceeded FROM orders GROUP BY 1")
def quota_usage(s, d):
    return ops.quota_usage(jobs(table(s, d, "orders")), AS_OF, 10)


@_query("SELECT event_id, event_type, ts FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id DESC LIMIT 100")
def event_list(s, d):
    """OP-75: filters that are given, newest first, top 100 (the listing's own limit)."""
    where = ops.all_of([F.col("event_type") == "purchase", None])
    return table(s, d, "events").filter(where).orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "event_type", "ts")


@_query("SELECT o_orderkey AS job_id, o_orderdate AS created_at, total FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50), (SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O')")
def job_list(s, d):
    rows = jobs(table(s, d, "orders")).filter("status = 'running'")
    return ops.page(rows, [F.desc("created_at"), F.desc("job_id")], 3, 25).select("job_id", "created_at", "total")


@_query("SELECT event_id AS event_key, action, created_at FROM (SELECT event_id, event_type AS action, ts AS created_at FROM events WHERE user_id % 10 = 3 ORDER BY ts DESC, event_id DESC LIMIT 25)")
def user_activity_page(s, d):
    rows = activity(table(s, d, "events")).filter("user_id % 10 = 3")
    return ops.page(rows, [F.desc("created_at"), F.desc("event_key")], 1, 25).select("event_key", "action", "created_at")


@_query("SELECT event_id, ts FROM events WHERE event_id < 900 ORDER BY event_id DESC LIMIT 100")
def keyset_page(s, d):
    return table(s, d, "events").filter("event_id < 900").orderBy(F.desc("event_id")).limit(100).select("event_id", "ts")


@_query("SELECT event_id, ts, total FROM (SELECT * FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05 05:00:00' AND ts < TIMESTAMP '2024-01-20 05:00:00' ORDER BY ts DESC, event_id DESC LIMIT 25), (SELECT count(*) AS total FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05 05:00:00' AND ts < TIMESTAMP '2024-01-20 05:00:00')")
def audit_page(s, d):
    """OP-81c: rows of a window of local days, newest first."""
    rows = table(s, d, "events").filter(F.col("event_type") == "error").filter(ops.local_window(F.col("ts").cast("timestamp"), "2024-01-05", "2024-01-19"))
    return ops.page(rows, [F.desc("ts"), F.desc("event_id")], 1, 25).select("event_id", "ts", "total")


_FEED = """SELECT 'event:' || event_id AS feed_id, user_id, event_type AS action, CASE event_type WHEN 'error' THEN 'system' ELSE 'human' END AS actor_type, 'recorded' AS source, ts AS created_at, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 'failed' ELSE 'success' END AS outcome FROM events
    UNION ALL SELECT 'registration:' || c_custkey, c_custkey, 'signup', 'human', 'historical', TIMESTAMP '1995-01-01', 'success' FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey AND event_type = 'signup')
    UNION ALL SELECT 'analysis:' || o_orderkey, o_custkey, 'analysis.request', 'human', 'historical', o_orderdate, 'created' FROM orders o WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = o.o_custkey AND event_type = 'view' AND event_id = o.o_orderkey)
    UNION ALL SELECT 'report:' || o_orderkey, o_custkey, 'report.request', 'human', 'historical', o_orderdate, 'created' FROM orders o WHERE o_orderpriority = '1-URGENT' AND NOT EXISTS (SELECT 1 FROM events WHERE user_id = o.o_custkey AND event_type = 'click' AND event_id = o.o_orderkey)
    UNION ALL SELECT 'job-state:' || o_orderkey, o_custkey, 'analysis.state', 'system', CASE o_orderstatus WHEN 'P' THEN 'baseline' ELSE 'recorded' END, o_orderdate, CASE WHEN o_orderkey % 5 > 0 THEN o_orderstatus END FROM orders
    UNION ALL SELECT 'report-state:' || o_orderkey, o_custkey, 'report.state', 'system', 'snapshot', o_orderdate, o_orderstatus FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
    UNION ALL SELECT 'audit:' || event_id, user_id, event_type, 'admin', 'audit', ts, 'success' FROM events WHERE event_type NOT IN ('view', 'click')"""


@_query(_FEED)
def activity_feed(s, d):
    """OP-82: seven branches in one feed; history is suppressed where an event was recorded."""
    e, o, c = table(s, d, "events"), table(s, d, "orders"), table(s, d, "customer")

    # a job's state is in the JSON snapshot of its event; some snapshots have none
    snapshot = F.when(F.pmod("o_orderkey", F.lit(5)) > 0, F.to_json(F.struct(F.col("o_orderstatus").alias("status")))).otherwise("{}")

    def branch(df, prefix, key, user, action, actor, source, at, outcome):
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select(F.concat(F.lit(prefix), F.col(key)).alias("feed_id"), F.col(user).cast("long").alias("user_id"), as_col(action).alias("action"), as_col(actor).alias("actor_type"), as_col(source).alias("source"), at.alias("created_at"), as_col(outcome).alias("outcome"))

    seen = lambda kind: e.filter(F.col("event_type") == kind).select(F.col("user_id").alias("o_custkey"), F.col("event_id").alias("o_orderkey"))
    urgent = o.filter("o_orderpriority = '1-URGENT'")
    signed = e.filter("event_type = 'signup'").select(F.col("user_id").alias("c_custkey"))
    branches = [
        branch(e, "event:", "event_id", "user_id", F.col("event_type"), F.when(F.col("event_type") == "error", "system").otherwise("human"), "recorded", F.col("ts"), F.when(F.get_json_object("props", "$.k").isNull(), "failed").otherwise("success")),
        branch(c.join(signed, "c_custkey", "left_anti"), "registration:", "c_custkey", "c_custkey", "signup", "human", "historical", F.lit("1995-01-01").cast("timestamp_ntz"), "success"),
        branch(o.join(seen("view"), ["o_custkey", "o_orderkey"], "left_anti"), "analysis:", "o_orderkey", "o_custkey", "analysis.request", "human", "historical", F.col("o_orderdate"), "created"),
        branch(urgent.join(seen("click"), ["o_custkey", "o_orderkey"], "left_anti"), "report:", "o_orderkey", "o_custkey", "report.request", "human", "historical", F.col("o_orderdate"), "created"),
        branch(o, "job-state:", "o_orderkey", "o_custkey", "analysis.state", "system", F.when(F.col("o_orderstatus") == "P", "baseline").otherwise("recorded"), F.col("o_orderdate"), F.get_json_object(snapshot, "$.status")),
        branch(urgent.filter("o_orderstatus = 'F'"), "report-state:", "o_orderkey", "o_custkey", "report.state", "system", "snapshot", F.col("o_orderdate"), F.col("o_orderstatus")),
        branch(e.filter(~F.col("event_type").isin("view", "click")), "audit:", "event_id", "user_id", F.col("event_type"), "admin", "audit", F.col("ts"), "success"),
    ]
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out


@_query("""SELECT user_id, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE event_type IN ('view', 'purchase')) e WHERE n = 1 AND event_type = 'view'
    AND NOT EXISTS (SELECT 1 FROM events x WHERE x.event_type = 'signup' AND x.event_id % 50 = 0 AND x.user_id = e.user_id)""")
def insert_if_absent(s, d):
    e = table(s, d, "events")
    return ops.insert_if_absent(e.filter("event_type = 'signup' and event_id % 50 = 0"), e.filter("event_type = 'view'"), ["user_id"], F.col("ts"), F.col("event_id")).select("user_id", "event_id")


@_query("SELECT o_orderkey, CAST(last_day(make_date(CAST(year(o_orderdate) AS INTEGER), CAST(CASE WHEN o_orderkey % 5 = 0 THEN 12 ELSE o_orderkey % 5 * 3 END AS INTEGER), 1)) AS DATE) AS cutoff FROM orders")
def information_cutoff(s, d):
    """OP-91: the last day of a quarter (1 to 4) or of the year (A)."""
    period = F.expr("if(o_orderkey % 5 = 0, 'A', string(o_orderkey % 5))")
    return table(s, d, "orders").select("o_orderkey", cutoff(F.year("o_orderdate"), period).alias("cutoff"))


def cutoff(year, period):
    month = F.when(period == "A", 12).otherwise(period.try_cast("int") * 3)
    return F.last_day(F.make_date(year, month, F.lit(1)))


@_query("SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%Y-%m') AS slot, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events")
def month_slot(s, d):
    """OP-92: the local month of an instant."""
    return table(s, d, "events").select("event_id", F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/Lima"), "yyyy-MM").alias("slot"), F.unix_timestamp("ts").alias("at"))


@_query(f"SELECT o_orderkey AS job_id, CAST(epoch(CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY ELSE TIMESTAMP '{AS_OF}' END) - epoch(o_orderdate) AS BIGINT) AS seconds, CAST(least(30, 2 ** (o_orderkey % 7)) AS INTEGER) AS retry_minutes FROM orders")
def job_durations(s, d):
    """OP-92: how long each job took, or has taken as of a given instant, and its wait before the next attempt."""
    rows = jobs(table(s, d, "orders"))
    end = F.when(F.col("status") == "completed", F.col("created_at") + F.expr("interval 3 days")).otherwise(F.lit(AS_OF).cast("timestamp_ntz"))
    attempt = (F.pmod("job_id", F.lit(7)) + 1).cast("int")
    return rows.select("job_id", (F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(F.col("created_at").cast("timestamp"))).alias("seconds"), ops.backoff_minutes(attempt).alias("retry_minutes"))


@_query(f"SELECT o_orderkey AS job_id FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{AS_OF}' - INTERVAL 1800 SECOND")
def stale_jobs(s, d):
    """OP-92: running, and not updated for half an hour as of a given instant."""
    return jobs(table(s, d, "orders")).filter("status = 'running'").filter(F.col("created_at") < F.expr(f"timestamp_ntz'{AS_OF}' - interval 1800 seconds")).select("job_id")
