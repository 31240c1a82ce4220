"""Readers, and adapters that let the generic tables stand in for disclosures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.functions.constants import CONCEPTS
from tallyforge.operators.facts import ALL_CONCEPTS, AMOUNT, KEY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Concept and its amount, over the sums of one company and year.
AMOUNTS = {
    "revenue": "p",
    "cost_of_sales": "-pd",
    "gross_profit": "p - pd",
    "operating_profit": "p - pd - px",
    "profit_continuing_operations": "p - pd - px",
    "profit_discontinued_operations": "-pxr",
    "net_profit": "p - pd - px - pxr + if(company_id % 7 = 0, 1, 0)",
    "current_assets": "po",
    "current_liabilities": "pf",
    "current_borrowings": "if(company_id % 13 = 0, null, pr)",
    "non_current_borrowings": "pa",
    "cash_and_cash_equivalents": "q",
    "closing_cash": "q",
    "total_assets": "p + px",
    "total_liabilities": "pf + pr",
    "total_equity": "p + px - pf - pr",
    "operating_cash_flow": "pq",
    "purchases_property_plant_equipment": "-px",
    "investing_cash_flow": "-px",
    "financing_cash_flow": "-pd",
    "net_change_before_exchange_rate_effects": "pq - px - pd",
    "exchange_rate_effect_on_cash": "x",
    "net_change_in_cash": "pq - px - pd + x",
    "opening_cash": "q_before",
}


def company_sums(lineitem: DataFrame) -> DataFrame:
    """Sums of a company (supplier) and year that all amounts come from; decimals, so order does not matter."""
    rows = lineitem.selectExpr(
        "l_suppkey as company_id", "year(l_shipdate) as fiscal_year", "cast(l_extendedprice as decimal(14,2)) as p", "cast(l_discount as decimal(4,2)) as d",
        "cast(l_tax as decimal(4,2)) as x", "cast(l_quantity as decimal(10,2)) as q", "l_returnflag as rf", "l_linestatus as ls",
    )
    sums = {
        "p": "p", "pd": "p * d", "px": "p * x", "pxr": "if(rf = 'R', p * x, 0)", "po": "if(ls = 'O', p, 0)", "pf": "if(ls = 'F', p, 0)",
        "pr": "if(rf = 'R', p, 0)", "pa": "if(rf = 'A', p, 0)", "q": "q", "pq": "if(q > 25, p, 0)", "x": "x",
    }
    return rows.groupBy(*KEY).agg(*(F.sum(F.expr(e)).cast(AMOUNT).alias(k) for k, e in sums.items()))


def account_rows(lineitem: DataFrame) -> DataFrame:
    """Adapter A1: raw account rows (company_id, fiscal_year, statement, account_code, label, current, comparative, currency_code, scale)."""
    years = Window.partitionBy("company_id").orderBy("fiscal_year")
    sums = company_sums(lineitem).withColumn("follows", F.lag("fiscal_year").over(years) == F.col("fiscal_year") - 1)
    sums = sums.withColumn("q_before", F.when(F.col("follows"), F.lag("q").over(years)))
    wide = sums.select(*KEY, "follows", *(F.expr(e).cast(AMOUNT).alias(c) for c, e in AMOUNTS.items()))
    rows = []
    for statement, codes in CONCEPTS.items():
        for code, c in codes.items():
            if c in AMOUNTS:
                before = F.when(F.col("follows"), F.lag(c).over(years))
                scale = F.when(F.col("company_id") % 5 == 0, "unknown").otherwise("thousands")
                if c == "purchases_property_plant_equipment":
                    scale = F.when(F.col("company_id") % 11 == 0, "millions").otherwise(scale)
                rows.append(F.struct(F.lit(statement).alias("statement"), F.lit(code).alias("account_code"), F.lit(c.replace("_", " ")).alias("label"), F.col(c).alias("current"), before.alias("comparative"), scale.alias("scale")))
    long = wide.select(*KEY, F.array(*rows).alias("rows")).select(*KEY, F.explode("rows").alias("r")).select(*KEY, "r.*")
    return long.filter("current is not null").withColumn("currency_code", F.when(F.col("company_id") % 3 == 0, "PEN").otherwise("USD"))


#: Titles of notes that stand in for real ones, and words that a later year adds.
NOTE_TITLES = (
    "Información general", "Efectivo y equivalentes de efectivo", "Obligaciones financieras", "Hechos posteriores", "Información por segmentos", "Contingencias y compromisos",
    "Cuentas por cobrar a partes relacionadas", "Deterioro de activos", "Provisiones y cierre de minas", "Propiedad, planta y equipo", "Ingresos de actividades ordinarias", "Juicios y estimados contables",
    "Costo de ventas", "Gastos de administración", "Impuesto a las ganancias", "Patrimonio neto", "Inventarios", "Cuentas por pagar comerciales", "Deuda con entidades asociadas",
)
OTHER_WORDS = ("neto", "y otros saldos", "del período", "consolidadas de la compañía")


def notes(documents: DataFrame) -> DataFrame:
    """Adapter A3: documents as notes of two years: company, scope, fiscal_year, note_number, title, text.

    A company has the notes of a source in a stretch of 2,000 ids, so its size is bounded; titles come from a list by id,
    and every fifth note of the later year words its title in another way.
    """
    place = F.floor(F.col("doc_id") / 40)
    title = F.element_at(F.array(*map(F.lit, NOTE_TITLES)), (F.pmod(place, F.lit(len(NOTE_TITLES))) + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, OTHER_WORDS)), (F.pmod(place, F.lit(len(OTHER_WORDS))) + 1).cast("int"))
    title = F.when(F.pmod(F.floor(F.col("doc_id") / 20), F.lit(10)) == 1, F.concat(title, F.lit(" "), other)).otherwise(title)
    company = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / 2000).cast("string"))
    rows = documents.filter("doc_id is not null").select("doc_id", company.alias("company"), F.col("lang").alias("scope"), (F.lit(2024) + F.pmod(F.floor(F.col("doc_id") / 20), F.lit(2))).cast("int").alias("fiscal_year"), title.alias("title"), "text")
    return rows.withColumn("note_number", F.row_number().over(Window.partitionBy("company", "scope", "fiscal_year").orderBy("doc_id")))


#: Lines of note pages.
MARKER, CONTENTS, REPORT = "Notas a los estados financieros", "Contenido", "INFORME DE LOS AUDITORES INDEPENDIENTES"


def note_pages(documents: DataFrame) -> DataFrame:
    """Adapter A4: documents as pages with numbered notes: doc_id, page from 0, text.

    Each line is the body of a note, two notes a page, with titles from the list.  What is odd follows from doc_id modulo 12; the first eight kinds
    have a contents page: 0 whole, with repeated headers; 1 two titles for one number; 2 an entry left out; 3 a heading that cannot be read; 4 one that stands
    twice; 5 two in the wrong order; 6 titles that go on in the next line; 7 numbers at the beginning of lines.  Without contents: 8 dotted
    numbers; 9 numbers without a dot; 10 a number left out; 11 an appendix before the seventh note, and every other one without a marker.
    """
    v = F.col("v")
    swap = lambda i: (v == 5) & (i < 2)
    titles = F.array(*map(F.lit, NOTE_TITLES))
    title = lambda i: F.element_at(titles, (F.pmod(F.when(swap(i), 1 - i).otherwise(i) + F.col("doc_id"), F.lit(len(NOTE_TITLES))) + 1).cast("int"))
    number = lambda i: F.when(swap(i), 2 - i).when((v == 10) & (i >= 5), i + 2).otherwise(i + 1)

    def block(line: Column, i: Column) -> Column:
        shown = F.when(v == 6, F.regexp_replace(title(i), "^([^ ]+) ", "$1\n")).otherwise(title(i))
        heading = F.when((v == 3) & (i == 1), "Título ilegible").otherwise(F.concat(number(i).cast("string"), F.when(v.isin(8, 10, 11), ".").otherwise(""), F.lit(" "), shown))
        before = F.when((v == 11) & (i == 6), f"{REPORT}\n").otherwise("")
        behind = F.when((v == 4) & (i == 1), F.concat(F.lit("\n"), heading, F.lit("\nEncabezado duplicado."))).when(v == 7, "\n2 1,500 3,000\n2.1 Detalle").otherwise("")
        return F.concat(before, heading, F.lit("\n"), line, behind)

    top = F.when(v == 0, f"Empresa S.A.\n{MARKER}\nExpresado en miles\n").when(((v == 11) & (F.pmod("doc_id", F.lit(24)) == 23)), "").otherwise(f"{MARKER}\n")
    top = lambda p, every=top: F.when((p == 0) | (F.pmod(v, F.lit(2)) == 0), every).otherwise("")
    entry = lambda i: F.concat(number(i).cast("string"), F.lit(" "), title(i), F.lit(" ..... "), (F.floor(i / 2) + 2).cast("string"))
    entries = F.transform(F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda i: ~((v == 2) & (i == 2))), entry)
    contents = F.concat(F.lit(f"{CONTENTS}\n{MARKER}\n"), F.array_join(entries, "\n"), F.when(v == 1, "\n2 Otro título ..... 9").otherwise(""))
    rows = documents.select("doc_id", F.pmod("doc_id", F.lit(12)).alias("v"), F.split("text", "\n", -1).alias("l")).filter("doc_id is not null and l is not null")
    rows = rows.select("doc_id", "v", "l", F.transform("l", block).alias("b"))
    body = F.transform(F.sequence(F.lit(0), F.floor((F.size("l") - 1) / 2).cast("int")), lambda p: F.concat(top(p), F.array_join(F.slice("b", p * 2 + 1, 2), "\n")))
    return rows.select("doc_id", F.posexplode(F.when(v < 8, F.concat(F.array(contents), body)).otherwise(body)).alias("page", "text"))


def lines(documents: DataFrame) -> DataFrame:
    """Adapter A4: lines of documents (doc_id, line_no from 0, line)."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def versioned_events(events: DataFrame) -> DataFrame:
    """Adapter A6: provider, external_id, ts, event_id and digest of the properties."""
    return events.select(F.col("event_type").alias("provider"), F.pmod("user_id", F.lit(50)).alias("external_id"), "ts", "event_id", F.sha2("props", 256).alias("digest"))


def activity(events: DataFrame) -> DataFrame:
    """Adapter A7: user activity."""
    return events.select(F.col("event_id").alias("event_key"), "user_id", F.col("event_type").alias("action"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "error", "system").otherwise("human").alias("actor_type"), "value", "props")


def jobs(orders: DataFrame) -> DataFrame:
    """Adapter A8: jobs with state."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("queued")
    return orders.select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("company_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


__all__ = ["ALL_CONCEPTS", "account_rows", "activity", "company_sums", "jobs", "lines", "note_pages", "notes", "table", "versioned_events"]
