"""Metrics and rules on hand-made facts."""

from decimal import Decimal

from tallyforge.operators import facts as ops

CODES = {c: (s, code) for s, codes in ops.CONCEPTS.items() for code, c in codes.items()}
SCHEMA = "company_id long, fiscal_year int, statement string, account_code string, label string, current decimal(20,6), comparative decimal(20,6), currency_code string, scale string"


def rows(amounts, company=1, currency="USD", scale="thousands", **scales):
    return [(company, 2025, *CODES[c], f" {c} ", None if a is None else Decimal(a), None if b is None else Decimal(b), currency, scales.get(c, scale)) for c, (a, b) in amounts.items()]


def found(spark, data, run=ops.metrics):
    facts = ops.normalise_facts(spark.createDataFrame(data, SCHEMA))
    wide, twice = ops.pivot_concepts(facts)
    return {r["metric_code"] if "metric_code" in r else r["rule_code"]: r for r in run(wide).collect()}, twice.count()


BASE = {
    "revenue": (2000, 1000), "gross_profit": (900, 400), "operating_profit": (700, 300), "net_profit": (600, 200), "current_assets": (1500, 1200), "current_liabilities": (500, 400),
    "current_borrowings": (100, 90), "non_current_borrowings": (300, 310), "cash_and_cash_equivalents": (250, 200), "total_equity": (2000, 1000), "total_liabilities": (1000, 900),
    "total_assets": (3000, 1900), "operating_cash_flow": (800, 500), "purchases_property_plant_equipment": (-200, -100),
}


def test_fifteen_metrics(spark):
    m, _ = found(spark, rows(BASE))
    value = {k: (None if r["value"] is None else float(r["value"])) for k, r in m.items()}
    assert len(m) == 15 and all(r["status"] == "computed" for r in m.values())
    assert value["revenue_growth"] == 1.0 and value["gross_margin"] == 0.45 and value["current_ratio"] == 3.0
    assert value["working_capital"] == 1000 and value["total_debt"] == 400 and value["net_debt"] == 150
    assert value["debt_to_equity"] == 0.2 and value["return_on_equity"] == 0.4 and value["free_cash_flow"] == 600 and value["free_cash_flow_margin"] == 0.3
    assert m["working_capital"]["currency_code"] == "USD" and m["working_capital"]["value_scale"] == "thousands"
    assert set(m["debt_to_equity"]["inputs"]) == {"current_borrowings", "non_current_borrowings", "total_equity"}


def test_reasons_in_order(spark):
    bad = dict(BASE, revenue=(0, 0), total_equity=(-5, None), current_borrowings=(None, None))
    del bad["current_borrowings"]
    m, _ = found(spark, rows(bad))
    assert m["revenue_growth"]["reason"] == "comparative is zero"
    assert m["gross_margin"]["reason"] == "zero or negative denominator"
    assert m["total_debt"]["reason"] == "missing concepts"
    assert m["return_on_equity"]["reason"] == "missing average"
    assert m["gross_margin"]["status"] == "not_available" and m["gross_margin"]["value"] is None


def test_units(spark):
    m, _ = found(spark, rows(BASE, scale="unknown", purchases_property_plant_equipment="millions"))
    assert m["free_cash_flow"]["reason"] == "incompatible units"
    assert m["working_capital"]["status"] == "computed" and m["working_capital"]["value_scale"] is None
    assert m["current_ratio"]["status"] == "computed"  # two unknown scales agree


def test_missing_current_is_zero_and_duplicates_are_rejected(spark):
    data = rows({"revenue": (None, None)}) + rows({"net_profit": (1, 1)}, company=2) * 2
    facts = ops.normalise_facts(spark.createDataFrame(data, SCHEMA)).collect()
    assert facts[0]["current"] == 0 and facts[0]["comparative"] is None and facts[0]["label"] == "revenue"
    assert found(spark, data)[1] == 1


def test_comparative(spark):
    m, _ = found(spark, rows(BASE), ops.comparative_metrics)
    assert float(m["gross_margin"]["value"]) == 0.4 and m["revenue_growth"]["reason"] == "needs an earlier year" and float(m["working_capital"]["value"]) == 800


def test_rules(spark):
    amounts = {"total_assets": (10, 1), "total_liabilities": (4, 1), "total_equity": (6, 0), "gross_profit": (5, 1), "revenue": (9, 1), "cost_of_sales": (-3, 1), "closing_cash": (3, 1), "cash_and_cash_equivalents": (3, 1)}
    v, _ = found(spark, rows(amounts), ops.validations)
    assert v["balance_equation"]["status"] == "passed" and v["gross_profit_reconciliation"]["status"] == "failed"
    assert v["cash_matches_balance"]["status"] == "passed" and v["net_profit_reconciliation"]["status"] == "not_applicable" and len(v) == 7


def test_empty(spark):
    assert found(spark, []) == ({}, 0)


def test_compatible_pairs(spark):
    same = ("A", "individual", "PEN", "thousands")
    filings = {1: same, 2: same, 3: ("Q", *same[1:]), 4: ("A", "consolidated", *same[2:]), 5: (*same[:2], "USD", "thousands"), 6: (*same[:3], "unknown"), 7: (*same[:3], "unknown"), 8: same, 9: same, 10: (*same[:2], None, "thousands")}
    rows = spark.createDataFrame([(k, 2024, *v) for k, v in filings.items()], "company_id int, fiscal_year int, period_code string, scope string, currency_code string, scale string")
    versions = [(k, 2024, m, "2" if (k, m) == (8, "roe") else "1") for k in filings for m in ("roa", "roe") if (k, m) != (9, "roe")]
    formulas = spark.createDataFrame(versions, "company_id int, fiscal_year int, metric_code string, formula_version string")
    asked = [(1, k) for k in range(2, 12)] + [(6, 7), (9, 1)]
    pairs = spark.createDataFrame([(a, b, 2024) for a, b in asked], "a int, b int, fiscal_year int")
    got = ops.compatible_pairs(pairs, rows, formulas).collect()
    assert len(got) == len(asked) and {(r["a"], r["b"]) for r in got if r["compatible"]} == {(1, 2), (9, 1)}


def test_scale_evidence_rewrites_filings_and_facts(spark):
    schema = "company_id int, fiscal_year int, statement string, account_code string, current decimal(20,6), comparative decimal(20,6), value_kind string, scale string"
    facts = spark.createDataFrame([(c, 2025, "s", code, None, None, kind, scale) for c in (1, 2, 3) for code, kind, scale in (("a", "monetary", "unknown"), ("b", "monetary", "millions"), ("c", "per_share", "units"))], schema)
    filings = spark.createDataFrame([(1, 2025, "unknown"), (2, 2025, "thousands"), (3, 2025, "unknown"), (4, 2025, "unknown")], "company_id int, fiscal_year int, scale string")
    seen = {r["company_id"]: r["now"] for r in ops.facts_digest(facts).collect()}
    evidence = spark.createDataFrame([(1, 2025, "thousands", "x", seen[1]), (2, 2025, "units", "y", seen[2]), (3, 2025, "thousands", "z", "stale")], "company_id int, fiscal_year int, found string, source string, digest string")
    new, rows = ops.apply_scale(filings, facts, evidence)
    assert sorted((r["company_id"], r["scale"], r["scale_source"]) for r in new.collect()) == [(1, "thousands", "x"), (2, "thousands", None), (3, "unknown", None), (4, "unknown", None)]
    scales = {}
    for r in rows.collect():
        scales.setdefault(r["company_id"], []).append((r["account_code"], r["scale"]))
    before = [("a", "unknown"), ("b", "millions"), ("c", "units")]
    assert {c: sorted(x) for c, x in scales.items()} == {1: [("a", "thousands"), ("b", "thousands"), ("c", "units")], 2: before, 3: before}


def test_negative_figures_that_round_to_nought_keep_their_sign(spark):
    rows = [(k, "percentage", Decimal(v)) for k, v in enumerate(("-0.0004", "0.0004", "0", "-0.0006", "0.125"))]
    data = spark.createDataFrame(rows, "company_id long, kind string, value decimal(38,12)")
    data = data.selectExpr("company_id", "2025 as fiscal_year", "'m' as metric_code", "kind", "'computed' as status", "value", "'USD' as currency_code", "'thousands' as value_scale")
    assert [r["shown"] for r in ops.format_metrics(data).orderBy("company_id").collect()] == ["-0%", "0%", "0%", "-0.1%", "12.5%"]
