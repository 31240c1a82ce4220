"""Queries over facts, metrics and rules, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.constants import CONCEPTS
from tallyforge.operators import facts as ops
from tallyforge.sources.shared import checkpointed
from tallyforge.sources.tables import AMOUNTS, account_rows, table

KEY = ops.KEY


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return ops.normalise_facts(account_rows(table(spark, d, "lineitem")))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    return ops.pivot_concepts(_facts(spark, d))[0]


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


METRIC_COLUMNS = [*KEY, "metric_code", "status", "value", "currency_code", "value_scale", "reason"]


def _values(found: DataFrame) -> DataFrame:
    return found.withColumn("value", F.round(F.col("value").cast("double"), 8)).select(*METRIC_COLUMNS)


def concept_map(s, d):
    found = ops.map_concepts(account_rows(table(s, d, "lineitem")))
    return _doubles(found.groupBy("statement", "account_code", "concept").agg(F.count("*").alias("n"), F.sum("current").alias("total")), "total")


def fact_normalise(s, d):
    return _doubles(_facts(s, d).select(*KEY, "account_code", "label", "current", "comparative", "value_kind", "scale", "status"), "current", "comparative")


def concept_pivot(s, d):
    return _doubles(_wide(s, d).select(*KEY, *(F.col(f"{c}.current").alias(c) for c in AMOUNTS)), *AMOUNTS)


def metrics_15(s, d):
    return _values(ops.metrics(_wide(s, d), False))


def metrics_status_counts(s, d):
    return ops.metrics(_wide(s, d), False).groupBy("metric_code", "status", "reason").agg(F.count("*").alias("n"))


def metrics_comparative(s, d):
    return _values(ops.comparative_metrics(_wide(s, d), False))


def annual_change(s, d):
    return _doubles(ops.annual_change(_wide(s, d)), "difference", "variation")


def statement_change(s, d):
    return _doubles(ops.statement_change(_facts(s, d)), "difference", "variation")


def validations(s, d):
    return _doubles(ops.validations(_wide(s, d)), "actual", "expected")


def validations_failed(s, d):
    return ops.validations(_wide(s, d)).groupBy("rule_code", "status").agg(F.count("*").alias("n"))


def metric_summary(s, d):
    """OP-31: metrics through supplier, nation and region."""
    found = ops.metrics(_wide(s, d), False).filter("status = 'computed'")
    supplier, nation, region = (table(s, d, x) for x in ("supplier", "nation", "region"))
    joined = found.join(supplier, found["company_id"] == supplier["s_suppkey"]).join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "metric_code").agg(F.count("*").alias("n"), F.round(F.sum("value").cast("double"), 3).alias("total"))


def statement_view(s, d):
    """OP-31 and OP-81: the mapped rows of one statement with the company's name, in account order."""
    supplier, nation = table(s, d, "supplier"), table(s, d, "nation")
    rows = _facts(s, d).filter("statement = 'balance_sheet' and status = 'mapped'")
    joined = rows.join(supplier, rows["company_id"] == supplier["s_suppkey"]).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return _doubles(joined.select("company_id", "s_name", "n_name", "fiscal_year", "account_code", "concept", "current", "comparative"), "current", "comparative").orderBy("company_id", "fiscal_year", "account_code")


def metric_format(s, d):
    return ops.format_metrics(ops.metrics(_wide(s, d), False))


def company_compare(s, d):
    return _doubles(ops.compare_companies(ops.metrics(_wide(s, d), False), 1, 2, 1998), "value_a", "value_b")


def company_compatible(s, d):
    """OP-45: each company beside the next one.  Every seventh reports a quarter, every third alone, every fourth has an older formula of roa."""
    facts = _facts(s, d)
    i = F.col("company_id")
    # read four times below: kept, so that the facts are made once
    known = checkpointed(facts.filter("statement = 'balance_sheet'").groupBy(*KEY).agg(F.min("currency_code").alias("currency_code"), F.min("scale").alias("scale")))
    filings = known.select(*KEY, F.when(i % 7 == 0, "Q").otherwise("A").alias("period_code"), F.when(i % 3 == 0, "individual").otherwise("consolidated").alias("scope"), "currency_code", "scale")
    version = F.when((i % 4 == 0) & (F.col("metric_code") == "roa"), "1.0").otherwise("1.1")
    formulas = known.select(*KEY, F.explode(F.lit(["roa", "roe", "net_margin"])).alias("metric_code")).withColumn("formula_version", version)
    pairs = known.select(i.alias("a"), (i + 1).alias("b"), "fiscal_year")
    return ops.compatible_pairs(pairs, filings, formulas)


def _applied(s, d):
    facts = _facts(s, d)
    seen = ops.facts_digest(facts).filter("company_id % 10 = 0 or company_id % 3 = 0")
    evidence = seen.select(*KEY, F.lit("thousands").alias("found"), F.concat_ws("/", F.lit("report"), "company_id", "fiscal_year").alias("source"), F.when(F.col("company_id") % 20 == 0, "other").otherwise(F.col("now")).alias("digest"))
    filings = facts.select(*KEY).distinct().withColumn("scale", F.when(F.col("company_id") % 5 == 0, "unknown").otherwise("thousands"))
    return ops.apply_scale(filings, facts, evidence)


def scale_apply(s, d):
    """OP-52: facts where every tenth company and every third has evidence of thousands; that of every twentieth was taken of other facts."""
    return _applied(s, d)[1].select(*KEY, "statement", "account_code", "scale")


def scale_filings(s, d):
    """OP-52: the filings of ``scale_apply``, with what proved their scale."""
    return _applied(s, d)[0].select(*KEY, "scale", "scale_source")


QUERIES = {f.__name__: f for f in (concept_map, fact_normalise, concept_pivot, metrics_15, metrics_status_counts, metrics_comparative, annual_change, statement_change, validations, validations_failed, metric_summary, statement_view, metric_format, company_compare, company_compatible, scale_apply, scale_filings)}


# ---- SQL

_CODE = {c: (s, code) for s, codes in CONCEPTS.items() for code, c in codes.items()}


def _duck(e: str) -> str:
    return e.replace("if(company_id % 7 = 0, 1, 0)", "CASE WHEN company_id % 7 = 0 THEN 1 ELSE 0 END").replace("if(company_id % 13 = 0, null, pr)", "CASE WHEN company_id % 13 = 0 THEN NULL ELSE pr END")


_A1 = f"""
WITH rows_ AS (
  SELECT l_suppkey AS company_id, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CAST(l_extendedprice AS DECIMAL(14,2)) AS p, CAST(l_discount AS DECIMAL(4,2)) AS d,
         CAST(l_tax AS DECIMAL(4,2)) AS x, CAST(l_quantity AS DECIMAL(10,2)) AS q, l_returnflag AS rf, l_linestatus AS ls FROM lineitem
), sums AS MATERIALIZED (
  SELECT company_id, fiscal_year, CAST(sum(p) AS DECIMAL(20,6)) AS p, CAST(sum(p * d) AS DECIMAL(20,6)) AS pd, CAST(sum(p * x) AS DECIMAL(20,6)) AS px,
         CAST(coalesce(sum(p * x) FILTER (rf = 'R'), 0) AS DECIMAL(20,6)) AS pxr, CAST(coalesce(sum(p) FILTER (ls = 'O'), 0) AS DECIMAL(20,6)) AS po,
         CAST(coalesce(sum(p) FILTER (ls = 'F'), 0) AS DECIMAL(20,6)) AS pf, CAST(coalesce(sum(p) FILTER (rf = 'R'), 0) AS DECIMAL(20,6)) AS pr,
         CAST(coalesce(sum(p) FILTER (rf = 'A'), 0) AS DECIMAL(20,6)) AS pa, CAST(sum(q) AS DECIMAL(20,6)) AS q,
         CAST(coalesce(sum(p) FILTER (q > 25), 0) AS DECIMAL(20,6)) AS pq, CAST(sum(x) AS DECIMAL(20,6)) AS x
  FROM rows_ GROUP BY ALL
), amounts AS MATERIALIZED (
  SELECT company_id, fiscal_year, {', '.join(f'CAST({_duck(e)} AS DECIMAL(20,6)) AS {c}' for c, e in AMOUNTS.items())}
  FROM (SELECT s.*, b.q AS q_before FROM sums s LEFT JOIN sums b ON b.company_id = s.company_id AND b.fiscal_year = s.fiscal_year - 1)
), w AS MATERIALIZED (
  SELECT a.*, {', '.join(f'b.{c} AS {c}_cmp' for c in AMOUNTS)}, CASE company_id % 3 WHEN 0 THEN 'PEN' ELSE 'USD' END AS cur,
         CASE company_id % 5 WHEN 0 THEN 'unknown' ELSE 'thousands' END AS scale
  FROM amounts a LEFT JOIN amounts b USING (company_id) WHERE b.fiscal_year = a.fiscal_year - 1
  UNION ALL BY NAME
  SELECT a.*, {', '.join(f'CAST(NULL AS DECIMAL(20,6)) AS {c}_cmp' for c in AMOUNTS)}, CASE company_id % 3 WHEN 0 THEN 'PEN' ELSE 'USD' END AS cur,
         CASE company_id % 5 WHEN 0 THEN 'unknown' ELSE 'thousands' END AS scale
  FROM amounts a WHERE NOT EXISTS (SELECT 1 FROM amounts b WHERE b.company_id = a.company_id AND b.fiscal_year = a.fiscal_year - 1)
), facts AS MATERIALIZED (
  {' UNION ALL '.join(f"SELECT company_id, fiscal_year, '{_CODE[c][0]}' AS statement, '{_CODE[c][1]}' AS account_code, '{c}' AS concept, '{c.replace('_', ' ')}' AS label, {c} AS current, {c}_cmp AS comparative, cur, "
                   + ("CASE WHEN company_id % 11 = 0 THEN 'millions' ELSE scale END" if c.startswith('purchases') else 'scale') + f" AS scale FROM w WHERE {c} IS NOT NULL" for c in AMOUNTS)}
)"""


def _metric_sql(part: str) -> str:
    """The fifteen metrics; ``part`` is '' for current amounts or '_cmp' for comparative ones."""
    n = lambda c: f"{c}{part}::DOUBLE"
    capex_odd = "company_id % 11 = 0"

    def row(code: str, kind: str, value: str, chain: list[tuple[str, str]]) -> str:
        bad = " ".join(f"WHEN {c} THEN '{r}'" for c, r in chain)
        reason = f"CASE {bad} END"
        unit = "cur" if kind == "monetary" else "NULL"
        scale = "nullif(scale, 'unknown')" if kind == "monetary" else "NULL"
        return f"""SELECT company_id, fiscal_year, '{code}' AS metric_code, '{kind}' AS kind, CASE WHEN {reason} IS NULL THEN 'computed' ELSE 'not_available' END AS status,
            CASE WHEN {reason} IS NULL THEN {value} END AS raw, CASE WHEN {reason} IS NULL THEN {unit} END AS currency_code,
            CASE WHEN {reason} IS NULL THEN {scale} END AS value_scale, {reason} AS reason FROM w"""

    def needs(names: list[str]) -> list[tuple[str, str]]:
        return [(" OR ".join(f"{x}{part} IS NULL" for x in names), "missing concepts")]

    def units(names: list[str]) -> list[tuple[str, str]]:
        return [(capex_odd, "incompatible units")] if any(x.startswith("purchases") for x in names) and len(names) > 1 else []

    rows = []
    two = [("true", "needs an earlier year")]
    if part:
        rows.append(row("revenue_growth", "percentage", "NULL::DOUBLE", two))
    else:
        rows.append(row("revenue_growth", "percentage", "revenue::DOUBLE / revenue_cmp::DOUBLE - 1", [("revenue IS NULL OR revenue_cmp IS NULL", "missing concepts"), ("revenue_cmp = 0", "comparative is zero")]))
    for code, kind, over, under in ops.RATIOS:
        names = [*over, under]
        rows.append(row(code, kind, f"({' + '.join(map(n, over))}) / {n(under)}", [*needs(names), (f"{under}{part} <= 0", "zero or negative denominator"), *units(names)]))
    for code, terms in ops.SUMS:
        names = [x for x, _ in terms]
        rows.append(row(code, "monetary", " + ".join(f"{sign} * {n(x)}" for x, sign in terms), [*needs(names), *units(names)]))
    for code, under in ops.RETURNS:
        if part:
            rows.append(row(code, "percentage", "NULL::DOUBLE", two))
        else:
            rows.append(row(code, "percentage", f"net_profit::DOUBLE / (({under}::DOUBLE + {under}_cmp::DOUBLE) / 2)", [*needs(["net_profit", under]), (f"{under}_cmp IS NULL", "missing average"), (f"{under} + {under}_cmp <= 0", "zero or negative denominator")]))
    return " UNION ALL ".join(rows)


_M = f"{_A1}, m AS MATERIALIZED ({_metric_sql('')}), c AS MATERIALIZED ({_metric_sql('_cmp')})"
_RULES = [("balance_sheet", "balance_equation", "total_assets", "total_liabilities + total_equity"), *((s, r, a, " + ".join(t)) for s, r, a, t in ops.VALIDATIONS)]
_V = _A1 + ", v AS (" + " UNION ALL ".join(f"SELECT company_id, fiscal_year, '{s}' AS statement, '{r}' AS rule_code, CASE WHEN {a} IS NULL OR {e} IS NULL THEN 'not_applicable' WHEN {a} = {e} THEN 'passed' ELSE 'failed' END AS status, round({a}::DOUBLE, 6) AS actual, round(({e})::DOUBLE, 6) AS expected FROM w" for s, r, a, e in _RULES) + ")"
_SHOWN = ["company_id, fiscal_year, metric_code, status, round(raw, 8) AS value, currency_code, value_scale, reason"]

#: A filing of unknown scale with evidence of its own facts.
_PROVED = "(company_id % 5 = 0 AND (company_id % 10 = 0 OR company_id % 3 = 0) AND company_id % 20 <> 0)"
ORACLE = {
    "concept_map": f"{_A1} SELECT statement, account_code, concept, count(*) AS n, round(sum(current)::DOUBLE, 6) AS total FROM facts GROUP BY ALL",
    "fact_normalise": f"{_A1} SELECT company_id, fiscal_year, account_code, label, round(current::DOUBLE, 6) AS current, round(comparative::DOUBLE, 6) AS comparative, 'monetary' AS value_kind, scale, 'mapped' AS status FROM facts",
    "concept_pivot": f"{_A1} SELECT company_id, fiscal_year, {', '.join(f'round({c}::DOUBLE, 6) AS {c}' for c in AMOUNTS)} FROM amounts",
    "metrics_15": f"{_M} SELECT {_SHOWN[0]} FROM m",
    "metrics_status_counts": f"{_M} SELECT metric_code, status, reason, count(*) AS n FROM m GROUP BY ALL",
    "metrics_comparative": f"{_M} SELECT {_SHOWN[0]} FROM c",
    "annual_change": f"""{_M}, j AS (SELECT m.*, c.raw AS before, m.status = 'computed' AND c.status = 'computed' AND m.currency_code IS NOT DISTINCT FROM c.currency_code AND m.value_scale IS NOT DISTINCT FROM c.value_scale AS ok
        FROM m JOIN c USING (company_id, fiscal_year, metric_code))
        SELECT company_id, fiscal_year, metric_code, CASE WHEN ok THEN round(raw - before, 6) END AS difference,
        CASE WHEN ok AND before > 0 AND kind <> 'percentage' THEN round(round(raw - before, 6) / round(before, 6), 6) END AS variation, CASE kind WHEN 'percentage' THEN 'pp' ELSE 'relative' END AS unit FROM j""",
    "statement_change": f"{_A1} SELECT company_id, fiscal_year, account_code, round((current - comparative)::DOUBLE, 6) AS difference, CASE WHEN comparative <> 0 THEN round((current - comparative)::DOUBLE / abs(comparative)::DOUBLE, 6) END AS variation FROM facts",
    "validations": f"{_V} SELECT * FROM v",
    "validations_failed": f"{_V} SELECT rule_code, status, count(*) AS n FROM v GROUP BY ALL",
    "metric_summary": f"{_M} SELECT r_name, metric_code, count(*) AS n, round(sum(raw), 3) AS total FROM m JOIN supplier ON company_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE status = 'computed' GROUP BY ALL",
    "statement_view": f"{_A1} SELECT company_id, s_name, n_name, fiscal_year, account_code, concept, round(current::DOUBLE, 6) AS current, round(comparative::DOUBLE, 6) AS comparative FROM facts JOIN supplier ON company_id = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE statement = 'balance_sheet'",
    "metric_format": f"""{_M} SELECT company_id, fiscal_year, metric_code, CASE WHEN status <> 'computed' THEN 'not available'
        WHEN kind = 'percentage' THEN regexp_replace(printf('%.1f', round(round(raw, 12) * 100, 1)), '\\.?0+$', '') || '%'
        WHEN kind = 'ratio' THEN regexp_replace(printf('%.2f', round(round(raw, 12), 2)), '\\.?0+$', '') || 'x'
        ELSE CASE currency_code WHEN 'PEN' THEN 'S/ ' WHEN 'USD' THEN 'US$ ' ELSE '' END || printf('%.1f', round(CAST(raw AS DECIMAL(20,6)) * CASE value_scale WHEN 'thousands' THEN 0.001 ELSE 1.000 END, 1)::DOUBLE) || CASE value_scale WHEN 'thousands' THEN ' M' ELSE '' END END AS shown,
        status = 'computed' AND kind = 'monetary' AND value_scale IS NULL AS unverified_scale FROM m""",
    "company_compare": f"""{_M} SELECT a.metric_code, a.status AS status_a, round(a.raw, 6) AS value_a, a.currency_code AS currency_a, a.value_scale AS scale_a, b.status AS status_b, round(b.raw, 6) AS value_b, b.currency_code AS currency_b, b.value_scale AS scale_b,
        a.status = 'computed' AND b.status = 'computed' AND (a.kind <> 'monetary' OR (a.currency_code IS NOT DISTINCT FROM b.currency_code AND a.value_scale IS NOT NULL AND a.value_scale IS NOT DISTINCT FROM b.value_scale)) AS comparable
        FROM m a JOIN m b USING (metric_code) WHERE a.company_id = 1 AND b.company_id = 2 AND a.fiscal_year = 1998 AND b.fiscal_year = 1998""",
    "company_compatible": f"""{_A1}, f AS (SELECT company_id AS i, fiscal_year, min(cur) AS c, min(scale) AS s FROM facts WHERE statement = 'balance_sheet' GROUP BY ALL)
        SELECT x.i AS a, x.i + 1 AS b, x.fiscal_year, coalesce(x.c = y.c AND x.s = y.s AND x.s <> 'unknown' AND (x.i % 7 = 0) = (y.i % 7 = 0) AND (x.i % 3 = 0) = (y.i % 3 = 0) AND (x.i % 4 = 0) = (y.i % 4 = 0), false) AS compatible
        FROM f x LEFT JOIN f y ON y.i = x.i + 1 AND y.fiscal_year = x.fiscal_year""",
    "scale_apply": f"""{_A1} SELECT company_id, fiscal_year, statement, account_code, CASE WHEN {_PROVED} THEN 'thousands' ELSE scale END AS scale FROM facts""",
    "scale_filings": f"""{_A1} SELECT DISTINCT company_id, fiscal_year, CASE WHEN {_PROVED} OR company_id % 5 <> 0 THEN 'thousands' ELSE 'unknown' END AS scale, CASE WHEN {_PROVED} THEN 'report/' || company_id || '/' || fiscal_year END AS scale_source FROM facts""",
}
