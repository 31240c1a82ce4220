"""Table state, anchors and proved units: by hand and against a plain reader of random tables."""

import random
import re
import unicodedata
from decimal import Decimal

import pytest

from tallyforge.operators import evidence

POLICY = "Bases de preparación\nLos estados financieros consolidados se presentan en soles y todos los valores se redondean a miles S/(000), excepto donde se indique de otro modo."
TABLES = (
    "6. Efectivo y equivalentes del efectivo\n2025 2024\nS/(000) S/(000)\nCaja 100 90 _________\n110 100\n7. Otra cuenta\n2025 2024 2023\nS/(000) S/(000) S/(000)\n"
    "Utilidad antes de impuesto a la renta 200 180 160\nTotal impuesto a la renta (20) (18) (16)\n"
)
FACTS = [(1, "cash", "Efectivo", "cash_and_cash_equivalents", 110, 100), (2, "profit", "Ganancia antes de impuestos", "profit_before_tax", 200, 180), (2, "tax", "Impuesto", "income_tax_expense", -20, -18), (3, "closing", "Efectivo al cierre", "closing_cash", 110, 100)]
CASES = {
    "good": (POLICY, TABLES, {1, 2, 3}), "years": (POLICY, TABLES.replace("2025 2024", "2024 2025"), set()), "unit": (POLICY, TABLES.replace("S/(000)", "millones de soles"), set()), "currency": (POLICY, TABLES.replace("S/(000)", "US$(000)"), set()),
    "magnitude": (POLICY, TABLES.replace("200 180 160", "0.2 0.18 0.16"), set()), "no policy": ("La tabla se presenta en miles de soles.", TABLES, set()), "exception": (POLICY.replace("donde se indique de otro modo", "el flujo"), TABLES, set()),
    "not its own": (POLICY, TABLES.replace("110 100\n", "110 101\n").replace("7. Otra", "Efectivo 110 100\n7. Otra"), {1, 2}), "two filings": (POLICY, TABLES, set()),
}


def frames(spark):
    pages = spark.createDataFrame([(d, i, t) for d, c in CASES.items() for i, t in enumerate(c[:2])], "doc_id string, page int, text string")
    scope = lambda d, i: "individual" if d == "two filings" and i == 2 else "consolidated"
    filings = spark.createDataFrame([(d, i, "PEN", 2025, scope(d, i), "A") for d in CASES for i in (1, 2, 3)], "doc_id string, filing_id int, currency_code string, fiscal_year int, scope string, period_code string")
    rows = [(d, f, code, label, concept, "monetary", Decimal(a), Decimal(b)) for d in CASES for f, code, label, concept, a, b in FACTS]
    return pages, filings, spark.createDataFrame([*rows, ("good", 3, "share", None, None, "per_share", Decimal(1), None), ("good", 3, "zero", None, None, None, Decimal(0), Decimal(1))], "doc_id string, filing_id int, account_code string, label string, concept string, value_kind string, current decimal(20,6), comparative decimal(20,6)")


def test_units_are_proved_by_own_anchors(spark):
    found = evidence.verify_policy(*frames(spark)).collect()
    assert {d: {r["filing_id"] for r in found if r["doc_id"] == d} for d in CASES} == {d: c[2] for d, c in CASES.items()}
    good = {r["filing_id"]: r for r in found if r["doc_id"] == "good"}
    assert all((r["scale"], r["page"], r["amounts"], r["exception"]) == ("thousands", 1, 3, "excepto donde se indique de otro modo") for r in good.values())
    assert [(a["account_code"], a["page"], a["line"], a["label"], a["years"]) for a in good[3]["anchors"]] == [("closing", 2, "110 100", "efectivo y equivalentes del efectivo", [2025, 2024])]
    assert [a["years"] for a in good[2]["anchors"]] == [[2025, 2024, 2023]] * 2


def bare(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


def plain_scale(line):
    t = bare(line)
    if not re.search(r"s/|soles", t) or re.search(r"us\s*\$|dolares", t):
        return None
    named = {n for n, p in (("thousands", r"\(\s*0{3}\s*\)|\bmiles\b"), ("millions", r"\bmillones\b"), ("units", r"\bunidades\b|expresad[oa]s? en (?:soles|dolares)")) if re.search(p, t)}
    return named.pop() if len(named) == 1 else None


def plain_rows(text, year, wanted):
    label_of = lambda t: " ".join(re.findall("[a-z]+", re.sub(r"\([^)]*\)", "", bare(t))))
    out, heading, years, scale, first, seen, above = [], None, None, None, False, False, ""
    for i, line in enumerate(text.split("\n")):
        ruled, above = "___" in above, line
        title = re.match(r"\s*[0-9]{1,2}\.\s+(.+)", line)
        if title:
            heading, first, seen, years, scale = label_of(title[1]), True, False, None, None
        if re.fullmatch(r"\s*20[0-9]{2}(\s+20[0-9]{2}){1,2}\s*", line):
            first, seen, years, scale = first and not seen, True, [int(y) for y in line.split()], None
        elif years and plain_scale(line):
            scale = plain_scale(line)
        elif years and re.search(r"s/|us\s*\$|miles|millones|unidades", bare(line)):
            years = scale = None
        elif years and len(set(years)) == len(years) and scale == wanted and {year, year - 1} <= set(years):
            numbers = [Decimal(re.sub("[,)]", "", t).replace("(", "-")) for t in re.findall(r"(?<![\w.])\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?", line)]
            if len(numbers) == len(years):
                label = label_of(line)
                total = not label and first and ruled and heading is not None
                out.append((i, ([heading] if total else []) + [label], numbers[years.index(year)], numbers[years.index(year - 1)]))
                first = first and bool(label)
            elif len(line.strip()) > 100 or re.match(r"\s*\([a-z]\)", line):
                years = None
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_against_a_plain_reader(spark, seed):
    rng = random.Random(seed)
    parts = ["2025 2024", "2025 2024", " 2025  2024 2023", "2024 2025", "2025 2025", "2023 2022", "S/(000)", "miles de soles", "S/(000) S/(000)", "US$(000)", "millones de soles", "unidades", "4. Deuda (neta)", "12.  Caja y bancos", "Caja 10 9 ____", "Caja 10 9", "1,100 (90)",
             "Año 5", "(a) Nota", "(b) 3 4", "x" * 101, "", "Ñandú 1.5 2 3", "7 8", "Total ____", "___", "S/ 5 4"]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(250)]
    texts = [t if rng.random() < 0.2 else "3. Saldo\n2025 2024\nS/(000)\n" + "\n".join(rng.choices(["Caja 10 9 ___", "10 9", "Año 5", "Total 3 (4)", "___", "2025 2024\nmiles S/"], k=rng.randint(0, 5))) + "\n" + t for t in texts]
    pages = spark.createDataFrame([(i, 0, t, "PEN", 2025, "thousands") for i, t in enumerate([*texts, None])], "doc_id int, page int, text string, currency string, fiscal_year int, scale string")
    got = {}
    for r in evidence.table_rows(pages).collect():
        got.setdefault(r["doc_id"], []).append((r["line_no"], [k["label"] for k in r["keys"]], r["current"], r["comparative"]))
    want = {i: rows for i, t in enumerate(texts) if (rows := plain_rows(t, 2025, "thousands"))}
    assert {i: (got.get(i), want.get(i), texts[i]) for i in set(got) | set(want) if sorted(got.get(i, [])) != want.get(i, [])} == {}
    assert sum(map(len, want.values())) > 150 and any(len(r[1]) == 2 for rows in want.values() for r in rows)


def test_tables_are_read_once(spark, capsys):
    pages = spark.createDataFrame([(1, 0, "x")], "doc_id int, page int, text string")
    filings = spark.createDataFrame([(1, 10, "PEN", 2025, "consolidated", "annual")], "doc_id int, filing_id int, currency_code string, fiscal_year int, scope string, period_code string")
    facts = spark.createDataFrame([(1, 10, "c", "Caja", "cash", "monetary", 10, 9)], "doc_id int, filing_id int, account_code string, label string, concept string, value_kind string, current int, comparative int")
    found = evidence.verify_policy(pages, filings, facts)
    found.explain()
    assert "Generate inline" not in capsys.readouterr().out  # anchors are kept; two steps need them
    assert found.count() == 0
