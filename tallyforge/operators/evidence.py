"""Evidence of a unit out of tables in notes: the state of each line, anchors of facts, and what a document's anchors prove."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import constants as K
from tallyforge.functions.text import let
from tallyforge.operators.documents import explicit_scale, number_tokens, presentation_policy
from tallyforge.operators.notes import LINE_END, plain
from tallyforge.sources.shared import checkpointed

AMOUNT = "decimal(30,6)"
#: What is known while reading down a page.
STATE = f"struct<heading: string, years: array<int>, scale: string, first: boolean, seen: boolean, rows: array<struct<line_no: int, line: string, keys: array<struct<label: string, total: boolean>>, years: array<int>, current: {AMOUNT}, comparative: {AMOUNT}>>>"


def clean_label(c: Column) -> Column:
    """Folded words of letters, without what stands in brackets."""
    return F.array_join(F.regexp_extract_all(F.regexp_replace(plain(c), r"\([^)]*\)", ""), F.lit("[a-z]+"), F.lit(0)), " ")


def _line(x: Column, before: Column, i: Column, currency: Column) -> Column:
    """What a line says by itself."""
    title = F.regexp_extract(x, r"^\s*[0-9]{1,2}\.\s+(.+)", 1)
    years = F.when(x.rlike(K.YEARS_LINE), F.transform(F.regexp_extract_all(x, F.lit("20[0-9]{2}"), F.lit(0)), lambda y: y.cast("int")))
    return F.struct(
        i.cast("int").alias("line_no"), F.btrim(x, F.lit(" \t")).alias("line"), F.when(title != "", clean_label(title)).alias("title"), years.alias("years"), explicit_scale(x, currency).alias("scale"),
        plain(x).rlike(K.UNIT_WORDS).alias("unit"), F.transform(number_tokens(x), lambda v: v.cast(AMOUNT)).alias("numbers"), ((F.length(F.btrim(x, F.lit(" \t"))) > 100) | x.rlike(r"^\s*\([a-z]\)")).alias("ends"),
        clean_label(x).alias("label"), F.coalesce(F.contains(before, F.lit("___")), F.lit(False)).alias("ruled"),
    )


def _step(s: Column, x: Column, year: Column, scale: Column) -> Column:
    """The state behind a line: a titled line begins a note, a line of years a table, and what does not fit ends it."""
    begins = x["title"].isNotNull()
    none = F.lit(None).cast("array<int>")
    heading = F.when(begins, x["title"]).otherwise(s["heading"])
    first, seen = begins | s["first"], ~begins & s["seen"]
    open_years = F.when(~begins, s["years"])
    header = x["years"].isNotNull()
    names_unit = open_years.isNotNull() & x["scale"].isNotNull()
    other_unit = open_years.isNotNull() & x["scale"].isNull() & x["unit"]
    usable = open_years.isNotNull() & (F.size(F.array_distinct(open_years)) == F.size(open_years)) & F.coalesce(s["scale"] == scale, F.lit(False)) & ~header & ~names_unit & ~other_unit
    usable = usable & F.array_contains(open_years, year) & F.array_contains(open_years, year - 1)
    fits = usable & (F.size(x["numbers"]) == F.size(open_years))
    ends = usable & ~fits & x["ends"]
    at = lambda y: F.get(x["numbers"], (F.array_position(open_years, y) - 1).cast("int"))
    total = (x["label"] == "") & first & x["ruled"] & heading.isNotNull()
    key = lambda label, is_total: F.struct(label.alias("label"), F.lit(is_total).alias("total"))
    keys = F.when(total, F.array(key(heading, True), key(x["label"], False))).otherwise(F.array(key(x["label"], False)))
    row = F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), keys.alias("keys"), open_years.alias("years"), at(year).alias("current"), at(year - 1).alias("comparative"))
    return F.struct(
        heading.alias("heading"), F.when(header, x["years"]).when(other_unit | ends, none).otherwise(open_years).alias("years"), F.when(header | other_unit | begins, F.lit(None).cast("string")).when(names_unit, x["scale"]).otherwise(s["scale"]).alias("scale"),
        F.when(header, first & ~seen).when(fits & (x["label"] == ""), F.lit(False)).otherwise(first).alias("first"), (seen | header).alias("seen"), F.when(fits, F.concat(s["rows"], F.array(row))).otherwise(s["rows"]).alias("rows"),
    ).cast(STATE)


def table_rows(pages: DataFrame) -> DataFrame:
    """OP-71: rows of dated tables in the wanted unit: doc_id, page (from 1), line_no, line, keys, years, current, comparative.

    pages: doc_id, page (from 0), text, currency, fiscal_year, scale.  One fold goes down the lines of each page and carries the note's heading, the years
    over the columns, their unit, and whether the first table is not over yet; nothing carries over to the next page.  A row has one number a year; current
    and comparative are those of the wanted year and the one before it.  keys: the label of the row, and for a ruled total without label in a note's
    first table the heading too.  The fold is in the row of the page, so nothing is shuffled.
    """
    lines = F.split(F.coalesce("text", F.lit("")), LINE_END, -1)
    said = let(lines, lambda all_lines: F.transform(all_lines, lambda x, i: _line(x, F.get(all_lines, i - 1), i, F.col("currency"))))
    start = F.expr(f"from_json('{{\"first\": false, \"seen\": false, \"rows\": []}}', '{STATE}')")
    end = F.aggregate(said, start, lambda s, x: _step(s, x, F.col("fiscal_year"), F.col("scale")))
    return pages.select("doc_id", (F.col("page") + 1).cast("int").alias("page"), end["rows"].alias("rows")).select("doc_id", "page", F.inline("rows"))


def fact_anchors(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """OP-71: the last row that each fact stands in: doc_id, filing_id, account_code, page, line_no, line, label, years, current, comparative.

    facts: doc_id, filing_id, account_code, label, concept, value_kind, current, comparative.  Monetary facts with an amount other than nought and a comparative
    amount count.  A row is a fact's if both amounts are equal and its label is the fact's, or one that stands for its concept.
    """
    aliases = F.array_compact(F.array(*(F.when(F.col("concept") == concept, label) for concept, label in K.ANCHOR_ALIASES)))
    wanted = facts.filter("coalesce(value_kind, 'monetary') = 'monetary' and current <> 0 and comparative is not null")
    wanted = wanted.select("doc_id", "filing_id", "account_code", F.explode(F.array_distinct(F.concat(F.array(clean_label(F.coalesce("label", F.lit("")))), aliases))).alias("label"), F.col("current").cast(AMOUNT), F.col("comparative").cast(AMOUNT))
    shown = rows.select("doc_id", "page", "line_no", "line", "years", "current", "comparative", F.explode("keys").alias("k")).select("*", "k.label", "k.total").drop("k")
    met = wanted.join(shown, ["doc_id", "label", "current", "comparative"])
    last = F.max_by(F.struct("page", "line_no", "line", "label", "years", "current", "comparative"), F.struct("page", "line_no", "total"))
    return met.groupBy("doc_id", "filing_id", "account_code").agg(last.alias("a")).select("doc_id", "filing_id", "account_code", "a.*")


def verify_policy(pages: DataFrame, filings: DataFrame, facts: DataFrame, least_amounts: int = 3, least_filings: int = 2) -> DataFrame:
    """OP-62: doc_id, filing_id, scale, page, declaration, exception, anchors, amounts of the filings whose unit a document proves.

    pages: doc_id, page (from 0), text; filings: doc_id, filing_id, currency_code, fiscal_year, scope, period_code.  A document proves units if its filings agree in these four,
    it states one presentation policy, and its tables hold at least ``least_amounts`` different (label, current, comparative) over at least ``least_filings`` filings.
    A filing must have an anchor of its own; none takes the unit of another.
    """
    of = ["currency_code", "fiscal_year", "scope", "period_code"]
    each = filings.groupBy("doc_id").agg(F.countDistinct(F.struct(*of)).alias("n"), F.first("currency_code").alias("currency"), F.first("fiscal_year").alias("fiscal_year")).filter("n = 1 and currency is not null").drop("n")
    # only documents with a policy have their tables read
    policy = presentation_policy(pages.join(each, "doc_id").select("doc_id", (F.col("page") + 1).alias("page"), "text", "currency"), F.col("currency"))
    read = pages.select("doc_id", "page", "text").join(each.join(policy.select("doc_id", "scale"), "doc_id"), "doc_id")
    anchors = checkpointed(fact_anchors(table_rows(read), facts))  # tables are read once, though two steps need the anchors
    whole = anchors.groupBy("doc_id").agg(F.countDistinct("label", "current", "comparative").alias("amounts"), F.countDistinct("filing_id").alias("filings")).filter((F.col("amounts") >= least_amounts) & (F.col("filings") >= least_filings))
    own = anchors.groupBy("doc_id", "filing_id").agg(F.array_sort(F.collect_list(F.struct("account_code", "page", "line_no", "line", "label", "years", "current", "comparative"))).alias("anchors"))
    return own.join(whole.select("doc_id", "amounts"), "doc_id").join(policy, "doc_id").select("doc_id", "filing_id", "scale", "page", "declaration", "exception", "anchors", "amounts")
