"""Facts, concepts, metrics and reconciliation rules: one lazy plan for all companies.

Facts are rows (company_id, fiscal_year, statement, account_code, label, current, comparative, currency_code,
scale).  Pivoted by (company_id, fiscal_year) each concept is a struct <current, comparative, currency_code,
scale>, and metrics and rules are columns over those structs, so after the pivot nothing is shuffled.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.constants import CONCEPTS
from tallyforge.sources.shared import checkpointed

ALL_CONCEPTS = [c for codes in CONCEPTS.values() for c in codes.values()]
AMOUNT = "decimal(20,6)"
KEY = ("company_id", "fiscal_year")


def concept_table(spark: SparkSession) -> DataFrame:
    rows = [(s, code, concept) for s, codes in CONCEPTS.items() for code, concept in codes.items()]
    return spark.createDataFrame(rows, "statement string, account_code string, concept string")


def map_concepts(facts: DataFrame) -> DataFrame:
    """OP-17: ``concept`` of each (statement, account_code); null where none is known.  41 rows are broadcast."""
    return facts.join(F.broadcast(concept_table(facts.sparkSession)), ["statement", "account_code"], "left")


def normalise_facts(rows: DataFrame) -> DataFrame:
    """OP-18: raw account rows to facts.  A missing current amount is 0, a missing comparative stays null."""
    code = F.trim("account_code")
    kind = F.when((F.col("statement") == "income_statement") & code.startswith("2D09"), "per_share").otherwise("monetary")
    out = rows.select(
        *KEY, "statement", code.alias("account_code"), F.coalesce(F.nullif(F.trim("label"), F.lit("")), code).alias("label"),
        F.coalesce(F.col("current").cast(AMOUNT), F.lit(0).cast(AMOUNT)).alias("current"), F.col("comparative").cast(AMOUNT).alias("comparative"),
        "currency_code", kind.alias("value_kind"), F.when(kind == "per_share", "units").otherwise(F.col("scale")).alias("scale"),
    )
    return map_concepts(out).withColumn("status", F.when(F.col("concept").isNull(), "unmapped").otherwise("mapped"))


def pivot_concepts(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OP-46: one struct column a concept for each company and year; and the keys with a concept twice, which are left out.

    One aggregation gathers a key's facts, as many as its chart of accounts has, in a map; columns are look-ups in it.
    """
    entry = F.struct("concept", F.struct("current", "comparative", "currency_code", "scale").alias("fact"))
    held = facts.filter(F.col("concept").isNotNull()).groupBy(*KEY).agg(F.collect_list(entry).alias("entries"))
    single = F.size(F.array_distinct(F.transform("entries", lambda x: x["concept"]))) == F.size("entries")
    maps = held.filter(single).select(*KEY, F.map_from_entries("entries").alias("m"))
    return maps.select(*KEY, *(F.try_element_at("m", F.lit(c)).alias(c) for c in ALL_CONCEPTS)), held.filter(~single).select(*KEY)


def _reason(chain: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, reason in reversed(chain):
        out = F.when(condition, reason).otherwise(out)
    return out


def _missing(names: list[str], part: str) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.col(f"{n}.{part}").isNull()
    return out


def _units_differ(names: list[str]) -> Column:
    """Currency or scale differs among inputs; two nulls, and two unknowns, agree."""
    out = F.lit(False)
    for n in names[1:]:
        for field in ("currency_code", "scale"):
            out = out | ~F.col(f"{n}.{field}").eqNullSafe(F.col(f"{names[0]}.{field}"))
    return out


def _divide(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast(AMOUNT), b.cast(AMOUNT))


def _metric(code: str, kind: str, value: Column, chain: list[tuple[Column, str]], inputs: list[str], before: str, with_inputs: bool) -> Column:
    unit = F.col(before + inputs[0])
    parts = [F.lit(code).alias("metric_code"), F.lit(kind).alias("kind"), F.bround(value, 12).cast("decimal(38,12)").alias("value"), unit["currency_code"].alias("currency_code"), unit["scale"].alias("scale"), _reason(chain).alias("reason")]
    if with_inputs:
        parts.append(F.map_filter(F.map_from_arrays(F.array(*map(F.lit, inputs)), F.array(*(F.col(before + i) for i in inputs))), lambda k, v: v.isNotNull()).alias("inputs"))
    return F.struct(*parts)


def _settled(m: str) -> list[Column]:
    """The columns of a metric struct ``m``: what is not available has a reason and nothing else."""
    done, monetary = F.col(f"{m}.reason").isNull(), F.col(f"{m}.kind") == "monetary"
    return [
        F.col(f"{m}.metric_code"), F.col(f"{m}.kind"), F.when(done, "computed").otherwise("not_available").alias("status"), F.when(done, F.col(f"{m}.value")).alias("value"),
        F.when(done & monetary, F.col(f"{m}.currency_code")).alias("currency_code"), F.when(done & monetary & (F.col(f"{m}.scale") != "unknown"), F.col(f"{m}.scale")).alias("value_scale"), F.col(f"{m}.reason"),
    ]


RATIOS = (
    ("gross_margin", "percentage", ["gross_profit"], "revenue"),
    ("operating_margin", "percentage", ["operating_profit"], "revenue"),
    ("net_margin", "percentage", ["net_profit"], "revenue"),
    ("current_ratio", "ratio", ["current_assets"], "current_liabilities"),
    ("debt_to_equity", "ratio", ["current_borrowings", "non_current_borrowings"], "total_equity"),
    ("liabilities_to_equity", "ratio", ["total_liabilities"], "total_equity"),
    ("operating_cash_flow_margin", "percentage", ["operating_cash_flow"], "revenue"),
    ("free_cash_flow_margin", "percentage", ["operating_cash_flow", "purchases_property_plant_equipment"], "revenue"),
)
SUMS = (
    ("working_capital", [("current_assets", 1), ("current_liabilities", -1)]),
    ("total_debt", [("current_borrowings", 1), ("non_current_borrowings", 1)]),
    ("net_debt", [("current_borrowings", 1), ("non_current_borrowings", 1), ("cash_and_cash_equivalents", -1)]),
    ("free_cash_flow", [("operating_cash_flow", 1), ("purchases_property_plant_equipment", 1)]),
)
RETURNS = (("return_on_assets", "total_assets"), ("return_on_equity", "total_equity"))


#: Metrics that need an earlier year's comparative amounts.
TWO_YEARS = ("revenue_growth", *(code for code, _ in RETURNS))


def _metrics(before: str, with_inputs: bool) -> list[Column]:
    """The fifteen metrics as structs over the concept columns whose names begin with ``before``."""
    cur = lambda n: F.col(f"{before}{n}.current")
    prefixed = lambda names: [before + n for n in names]
    add = lambda *args: found.append(_metric(*args, before, with_inputs))
    found: list[Column] = []
    prior = F.col(f"{before}revenue.comparative")
    add("revenue_growth", "percentage", _divide(cur("revenue"), prior) - 1, [(cur("revenue").isNull() | prior.isNull(), "missing concepts"), (prior == 0, "comparative is zero")], ["revenue"])
    for code, kind, over, under in RATIOS:
        names = [*over, under]
        top = sum((cur(n) for n in over[1:]), cur(over[0]))
        add(code, kind, _divide(top, cur(under)), [(_missing(prefixed(names), "current"), "missing concepts"), (cur(under) <= 0, "zero or negative denominator"), (_units_differ(prefixed(names)), "incompatible units")], names)
    for code, terms in SUMS:
        names = [n for n, _ in terms]
        value = sum((cur(n) * s for n, s in terms[1:]), cur(names[0]) * terms[0][1])
        add(code, "monetary", value, [(_missing(prefixed(names), "current"), "missing concepts"), (_units_differ(prefixed(names)), "incompatible units")], names)
    for code, under in RETURNS:
        names = ["net_profit", under]
        mean = (cur(under) + F.col(f"{before}{under}.comparative")) / 2
        chain = [(_missing(prefixed(names), "current"), "missing concepts"), (F.col(f"{before}{under}.comparative").isNull(), "missing average"), (mean <= 0, "zero or negative denominator"), (_units_differ(prefixed(names)), "incompatible units")]
        add(code, "percentage", _divide(cur("net_profit"), mean), chain, names)
    return found


def _shifted(wide: DataFrame, before: str) -> DataFrame:
    """``wide`` with columns that have comparative amounts as current ones."""
    columns = {}
    for c in ALL_CONCEPTS:
        earlier = F.struct(F.col(f"{c}.comparative").alias("current"), F.lit(None).cast(AMOUNT).alias("comparative"), F.col(f"{c}.currency_code"), F.col(f"{c}.scale"))
        columns[before + c] = F.when(F.col(f"{c}.comparative").isNotNull(), earlier)
    return wide.withColumns(columns)


def metrics(wide: DataFrame, with_inputs: bool = True) -> DataFrame:
    """OP-47: the fifteen metrics of each company and year, with status, reason and (if asked for) inputs."""
    rows = wide.select(*KEY, F.explode(F.array(*_metrics("", with_inputs))).alias("m"))
    return rows.select(*KEY, *_settled("m"), *(["m.inputs"] if with_inputs else []))


def comparative_metrics(wide: DataFrame, with_inputs: bool = True) -> DataFrame:
    """OP-48: the metrics with comparative amounts as current; what needs two years is not available."""
    found = metrics(_shifted(wide, "").select(*wide.columns), with_inputs)
    none = {"status": F.lit("not_available"), "value": F.lit(None), "currency_code": F.lit(None), "value_scale": F.lit(None), "reason": F.lit("needs an earlier year")}
    return found.withColumns({k: F.when(F.col("metric_code").isin(*TWO_YEARS), v).otherwise(F.col(k)) for k, v in none.items()})


def annual_change(wide: DataFrame) -> DataFrame:
    """OP-49: difference and variation of each metric against the comparative amounts, both made in one pass over ``wide``."""
    both = [F.struct(c.alias("c"), p.alias("p")) for c, p in zip(_metrics("", False), _metrics("earlier_", False), strict=True)]
    rows = _shifted(wide, "earlier_").select(*KEY, F.explode(F.array(*both)).alias("m")).select(*KEY, "m.c", "m.p")
    names = ("metric_code", "kind", "status", "value", "currency_code", "value_scale", "reason")
    rows = rows.select(*KEY, *(x.alias(f"c_{n}") for x, n in zip(_settled("c"), names, strict=True)), *(x.alias(f"p_{n}") for x, n in zip(_settled("p"), names, strict=True)))
    ok = (F.col("c_status") == "computed") & (F.col("p_status") == "computed") & ~F.col("c_metric_code").isin(*TWO_YEARS) & F.col("c_currency_code").eqNullSafe(F.col("p_currency_code")) & F.col("c_value_scale").eqNullSafe(F.col("p_value_scale"))
    difference = F.when(ok, F.col("c_value") - F.col("p_value"))
    points = F.col("c_kind") == "percentage"
    variation = F.when(ok & (F.col("p_value") > 0) & ~points, F.try_divide(difference.cast(AMOUNT), F.col("p_value").cast(AMOUNT)))
    return rows.select(*KEY, F.col("c_metric_code").alias("metric_code"), difference.alias("difference"), variation.alias("variation"), F.when(points, "pp").otherwise("relative").alias("unit"))


def statement_change(facts: DataFrame) -> DataFrame:
    """OP-49b: difference and variation of each account against its comparative; null-safe."""
    difference = F.col("current") - F.col("comparative")
    return facts.select(*KEY, "account_code", difference.alias("difference"), F.when(F.col("comparative") != 0, F.try_divide(difference.cast(AMOUNT), F.abs("comparative").cast(AMOUNT))).alias("variation"))


#: statement, rule, actual, terms of the expected amount
VALIDATIONS = (
    ("income_statement", "gross_profit_reconciliation", "gross_profit", ["revenue", "cost_of_sales"]),
    ("income_statement", "net_profit_reconciliation", "net_profit", ["profit_continuing_operations", "profit_discontinued_operations"]),
    ("cash_flow", "cash_flow_activity_reconciliation", "net_change_before_exchange_rate_effects", ["operating_cash_flow", "investing_cash_flow", "financing_cash_flow"]),
    ("cash_flow", "cash_flow_exchange_reconciliation", "net_change_in_cash", ["net_change_before_exchange_rate_effects", "exchange_rate_effect_on_cash"]),
    ("cash_flow", "cash_rollforward", "closing_cash", ["opening_cash", "net_change_in_cash"]),
    ("cash_flow", "cash_matches_balance", "closing_cash", ["cash_and_cash_equivalents"]),
)


def validations(wide: DataFrame) -> DataFrame:
    """OP-50a (and OP-36, the cash of two statements): seven rules with exact equality; passed, failed or not_applicable."""
    cur = lambda n: F.col(f"{n}.current")
    both = F.coalesce(cur("total_liabilities_and_equity"), cur("total_liabilities") + cur("total_equity"))
    rules = [("balance_sheet", "balance_equation", cur("total_assets"), both)]
    rules += [(s, rule, cur(actual), sum((cur(t) for t in terms[1:]), cur(terms[0]))) for s, rule, actual, terms in VALIDATIONS]
    found = [
        F.struct(
            F.lit(s).alias("statement"), F.lit(rule).alias("rule_code"),
            F.when(actual.isNull() | expected.isNull(), "not_applicable").when(actual == expected, "passed").otherwise("failed").alias("status"),
            actual.cast("decimal(30,6)").alias("actual"), expected.cast("decimal(30,6)").alias("expected"),
        )
        for s, rule, actual, expected in rules
    ]
    return wide.select(*KEY, F.explode(F.array(*found)).alias("v")).select(*KEY, "v.*")


def format_metrics(found: DataFrame) -> DataFrame:
    """OP-24 and OP-23: the text of each metric, and whether a money figure's scale is unverified."""
    v = F.col("value").cast("double")
    # a negative figure keeps its sign when it rounds to nought, which F.round takes from it
    signed = lambda c, places: F.when(c < 0, -F.round(-c, places)).otherwise(F.round(c, places))
    trim = lambda c, places: F.regexp_replace(F.format_string(f"%.{places}f", signed(c, places)), r"\.?0+$", "")
    prefix = F.when(F.col("currency_code") == "PEN", "S/ ").when(F.col("currency_code") == "USD", "US$ ").otherwise("")
    # in decimals, so that halves round the same way everywhere
    money = F.round(F.col("value").cast(AMOUNT) * F.when(F.col("value_scale") == "thousands", F.lit(Decimal("0.001"))).otherwise(F.lit(Decimal("1.000"))), 1).cast("double")
    text = F.when(F.col("status") != "computed", "not available").when(F.col("kind") == "percentage", F.concat(trim(v * 100, 1), F.lit("%"))).when(F.col("kind") == "ratio", F.concat(trim(v, 2), F.lit("x"))).otherwise(F.concat(prefix, F.format_string("%.1f", money), F.when(F.col("value_scale") == "thousands", " M").otherwise("")))
    unverified = (F.col("status") == "computed") & (F.col("kind") == "monetary") & F.col("value_scale").isNull()
    return found.select(*KEY, "metric_code", text.alias("shown"), unverified.alias("unverified_scale"))


def compare_companies(found: DataFrame, a: int, b: int, year: int) -> DataFrame:
    """OP-45: two companies' metrics side by side, and whether every one may be compared."""
    side = lambda i, x: found.filter((F.col("company_id") == i) & (F.col("fiscal_year") == year)).select("metric_code", F.col("status").alias(f"status_{x}"), F.col("value").alias(f"value_{x}"), F.col("currency_code").alias(f"currency_{x}"), F.col("value_scale").alias(f"scale_{x}"))
    both = side(a, "a").join(side(b, "b"), "metric_code")
    money = F.col("metric_code").isin("working_capital", "total_debt", "net_debt", "free_cash_flow")
    same = ~money | (F.col("currency_a").eqNullSafe(F.col("currency_b")) & F.col("scale_a").isNotNull() & F.col("scale_a").eqNullSafe(F.col("scale_b")))
    return both.withColumn("comparable", (F.col("status_a") == "computed") & (F.col("status_b") == "computed") & same)



def compatible_pairs(pairs: DataFrame, filings: DataFrame, formulas: DataFrame) -> DataFrame:
    """OP-45: pairs (a, b, fiscal_year) with ``compatible``: may the two companies be compared at all in that year.

    filings: company_id, fiscal_year, period_code, scope, currency_code, scale of the one filing that stands for a year; formulas:
    company_id, fiscal_year, metric_code, formula_version.  Period, scope and currency must be equal, the scale known and equal, and
    each metric of a must be one of b by the same formula.  A pair without both filings is not compatible.
    """
    year, named = ["fiscal_year"], ("period_code", "scope", "currency_code", "scale")
    side = lambda x: filings.select(F.col("company_id").alias(x), *year, F.struct(*named).alias(f"f{x}"))
    both = pairs.join(side("a"), ["a", *year], "left").join(side("b"), ["b", *year], "left")
    same = (F.col("fa") == F.col("fb")) & (F.col("fa.scale") != "unknown")
    # at most one row a metric and company, so no pair has more rows than there are metrics
    of_a = pairs.join(formulas.withColumnRenamed("company_id", "a"), ["a", *year])
    of_b = formulas.select(F.col("company_id").alias("b"), *year, "metric_code", F.col("formula_version").alias("other"))
    differs = ~F.col("formula_version").eqNullSafe(F.col("other"))
    changed = of_a.join(of_b, ["b", *year, "metric_code"], "left").filter(differs).select("a", "b", *year).distinct().withColumn("changed", F.lit(True))
    return both.join(changed, ["a", "b", *year], "left").select("a", "b", *year, F.coalesce(same & F.col("changed").isNull(), F.lit(False)).alias("compatible"))


def apply_scale(filings: DataFrame, facts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OP-52: (filings, facts) of which those with an unknown scale have the one that verified evidence names, if nothing has changed since.

    filings: company_id, fiscal_year, scale; evidence: company_id, fiscal_year, found (scale), source, digest (of the facts as they were, see
    ``facts_digest``).  A filing of known scale stays as it is, with its facts.  Of a filing that is verified, ``scale_source`` is given, and all
    monetary facts are rewritten; figures per share keep their units.
    """
    now = facts_digest(facts)
    unknown = filings.filter("scale = 'unknown'").select(*KEY)
    fits = checkpointed(evidence.join(now, list(KEY)).filter(F.col("digest") == F.col("now")).join(unknown, list(KEY), "left_semi").select(*KEY, "found", "source"))
    of = fits.select(*KEY, "found")
    rewritten = F.when((F.col("value_kind") == "monetary") & F.col("found").isNotNull(), F.col("found")).otherwise(F.col("scale"))
    return (
        filings.join(fits, list(KEY), "left").withColumn("scale", F.coalesce("found", "scale")).withColumnRenamed("source", "scale_source").drop("found"),
        facts.join(of, list(KEY), "left").withColumn("scale", rewritten).drop("found"),
    )


def facts_digest(facts: DataFrame) -> DataFrame:
    """company_id, fiscal_year and ``now``: a digest of all accounts and amounts, in account order."""
    one = F.concat_ws("|", "statement", "account_code", F.col("current").cast("string"), F.coalesce(F.col("comparative").cast("string"), F.lit("-")))
    return facts.groupBy(*KEY).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(one)), ";"), 256).alias("now"))


def reuse_scale(filings: DataFrame, keys: list[str], verified: DataFrame) -> DataFrame:
    """OP-53: filings with ``reused``, the scale verified last for an equal key, or unknown.

    ``keys`` name company, year, period, scope, statement and digest of the payload; verified: keys, scale and updated_at.
    An unknown scale is none.  One aggregate a key is joined, so a hot key moves once.
    """
    latest = verified.filter("scale <> 'unknown'").groupBy(*keys).agg(F.max_by("scale", F.struct("updated_at", "scale")).alias("reused"))
    return filings.join(latest, keys, "left").withColumn("reused", F.coalesce("reused", F.lit("unknown")))
