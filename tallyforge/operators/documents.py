"""Document operators: links and forms in pages, headings, sections, evidence sentences and their choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import constants as K
from tallyforge.functions.text import collapse, contains_any, count_terms, fold, let, squash, unaccent, words_key

# ---- pages


def link_discovery(pages: DataFrame, hosts: list[str] | None = None, suffix: str = "", words: tuple[str, ...] = (), year: str = "", limit: int = 12) -> DataFrame:
    """OP-14: page_id, rank, link: hrefs resolved against the page, first seen only, best ``limit`` of a page.

    Links with one of ``words`` come first, then those with ``year``, then by address.  A link must be http(s), its
    host (without user or port other than 443) among ``hosts`` if given, and its path end in ``suffix``.  A page whose own address
    is such a file is its only link.
    """
    base = F.regexp_extract("url", r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    found = pages.select("page_id", base.alias("base"), folder.alias("folder"), F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).alias("ord", "href"))
    link = F.when(F.col("href").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(F.regexp_extract("base", "^(https?:)", 1), F.col("href"))).when(F.col("href").startswith("/"), F.concat("base", "href")).otherwise(F.concat("folder", F.lit("/"), "href"))
    found = found.filter("href <> '' and not startswith(href, '#')").select("page_id", "ord", F.regexp_replace(link, "#.*$", "").alias("link"))
    host = F.regexp_extract("link", r"^https?://([^/?#]*)", 1)
    fits = (host != "") & ~host.contains("@") & ~F.regexp_replace(host, ":443$", "").contains(":")
    if hosts:
        fits = fits & F.lower(F.regexp_replace(host, ":443$", "")).isin(*hosts)
    if suffix:
        fits = fits & F.lower(F.regexp_replace("link", r"\?.*$", "")).endswith(suffix)
        own = pages.select("page_id", F.lit(-1).alias("ord"), F.regexp_replace("url", "#.*$", "").alias("link")).filter(fits)
        found = found.join(own.select("page_id"), "page_id", "left_anti").unionByName(own)
    kept = found.filter(fits)
    first = kept.groupBy("page_id", "link").agg(F.min("ord").alias("ord"))
    low = F.lower("link")
    w = Window.partitionBy("page_id").orderBy(~contains_any(low, words), ~low.contains(year) if year else F.lit(True), "link")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).select("page_id", "rank", "link")


def form_extract(pages: DataFrame) -> DataFrame:
    """OP-15: page_id, title, squashed title key, number of list entries, anchors (text -> href) as a map."""
    entry = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)">[^<]*</a>'), F.lit(1))
    label = F.regexp_extract_all("html", F.lit(r'<a href="[^"]*">([^<]*)</a>'), F.lit(1))
    pairs = F.zip_with(label, entry, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    # the first entry of a label wins
    first = F.filter(F.transform(pairs, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), i.alias("i"))), lambda p: F.array_position(label, p["k"]) == p["i"] + 1)
    title = F.regexp_extract("html", r"<title>([^<]*)</title>", 1)
    return pages.select("page_id", title.alias("title"), squash(title).alias("title_key"), F.size(entry).alias("entries"), F.map_from_entries(F.transform(first, lambda p: F.struct(p["k"], p["v"]))).alias("links"))


def _entities(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, with the predefined entities read; empty if it has none."""
    return _entities(F.regexp_extract(tag, rf'(?is)\s{name}\s*=\s*"([^"]*)"', 1))


def form_fields(pages: DataFrame, select: str, link_id: str, not_titled: str = "XBRL", limit: int = 12) -> DataFrame:
    """OP-15: page_id, hidden (name -> value), options (code, label) of the list named ``select``, links.

    Of hidden fields with one name the last counts.  An option without a value is none.  Links are those whose id has
    ``link_id`` in it and whose title does not have ``not_titled``, in any case, in the page's order, each once and ``limit`` at most.
    A page without html has empty fields.
    """
    html = F.coalesce("html", F.lit(""))
    tags = lambda pattern: F.regexp_extract_all(html, F.lit(pattern), F.lit(0))
    inputs = F.filter(tags(r"(?is)<input\s[^>]*>"), lambda t: (F.lower(_attribute(t, "type")) == "hidden") & (_attribute(t, "name") != ""))
    fields = F.transform(inputs, lambda t: F.struct(_attribute(t, "name").alias("k"), _attribute(t, "value").alias("v")))
    # folded from the end, so that of equal names the last stays
    last = F.aggregate(F.reverse(fields), F.slice(fields, 1, 0), lambda found, f: F.when(F.exists(found, lambda x: x["k"] == f["k"]), found).otherwise(F.concat(found, F.array(f))))
    body = F.regexp_extract(html, rf'(?is)<select\s(?:[^>]*\s)?name\s*=\s*"{select}"[^>]*>(.*?)</select>', 1)
    each = F.filter(F.regexp_extract_all(body, F.lit(r"(?is)<option\s[^>]*>[^<]*"), F.lit(0)), lambda o: o.rlike(r'(?is)^<option\s(?:[^>]*\s)?value\s*=\s*"'))
    options = F.transform(each, lambda o: F.struct(_attribute(o, "value").alias("code"), F.trim(_entities(F.regexp_replace(o, r"(?s)^[^>]*>", ""))).alias("label")))
    anchors = F.filter(tags(r"(?is)<a\s[^>]*>"), lambda t: F.contains(_attribute(t, "id"), F.lit(link_id)) & ~F.contains(F.upper(_attribute(t, "title")), F.lit(not_titled.upper())))
    return pages.select("page_id", F.map_from_entries(last).alias("hidden"), options.alias("options"), F.slice(F.array_distinct(F.transform(anchors, lambda t: F.trim(_attribute(t, "href")))), 1, limit).alias("links"))


def match_option(forms: DataFrame, wanted: DataFrame) -> DataFrame:
    """OP-15: page_id, name, matches and code of each name (page_id, name): the code of the one option of that name.

    Labels and names are equal if their folded letters and digits are; with none or several equal labels the code is null.
    """
    fits = F.filter("options", lambda o: squash(o["label"]) == F.col("_key"))
    found = wanted.withColumn("_key", squash("name")).join(forms.select("page_id", "options"), "page_id", "left").withColumn("_fits", fits)
    n = F.coalesce(F.array_size("_fits"), F.lit(0))
    return found.select("page_id", "name", n.alias("matches"), F.when(n == 1, F.try_element_at("_fits", F.lit(1))["code"]).alias("code"))


# ---- titles, headers, numbers


def topic(title: Column, rules=K.TOPIC_RULES) -> Column:
    """OP-22: the first rule with a word in the folded title, else other."""

    def first(text: Column) -> Column:
        out = F.lit("other")
        for name, terms in reversed(rules):
            out = F.when(contains_any(text, terms), name).otherwise(out)
        return out

    return let(fold(title), first)


def excerpt(c: Column | str, n: int = 320) -> Column:
    """OP-25: line breaks become spaces; the first n characters."""
    return F.left(F.regexp_replace(c, r"\n+", " "), F.lit(n))


def explicit_scale(header: Column, currency: Column) -> Column:
    """OP-90: the one scale that a header names in the wanted currency and no other; else null."""

    def named(text: Column) -> Column:
        dollars, soles = text.rlike(K.DOLLARS), text.rlike(K.SOLES)
        fits = F.when(currency == "USD", dollars & ~soles).when(currency == "PEN", soles & ~dollars).otherwise(F.lit(False))
        units = F.array_compact(F.array(*(F.when(text.rlike(pattern), name) for name, pattern in K.SCALE_WORDS)))
        return F.when(fits & (F.size(units) == 1), units[0])

    return let(fold(header), named)


def presentation_policy(pages: DataFrame, currency: str | Column) -> DataFrame:
    """OP-90: doc_id, scale, page, declaration, exception of each document that states one unit for all its figures.

    pages: doc_id, page, text; currency: one for all, or a column of pages.  Statements on pages about the bases of presentation count.  A document has no policy if one of them
    names no unit of ``currency`` or makes another exception than the general ones, or if two name different units.  The
    first statement is given; ``exception`` is null where it makes none.
    """
    currency = F.lit(currency) if isinstance(currency, str) else currency
    folded = pages.select("doc_id", "page", currency.alias("currency"), fold("text").alias("text")).filter(F.col("text").rlike(K.POLICY_PAGE))
    said = folded.select("doc_id", "page", "currency", F.posexplode(F.regexp_extract_all("text", F.lit(K.POLICY_STATEMENT), F.lit(0))).alias("ord", "declaration"))
    but = F.regexp_extract("declaration", K.POLICY_EXCEPTION, 0)
    said = said.select("doc_id", "page", "ord", "declaration", explicit_scale(F.col("declaration"), F.col("currency")).alias("scale"), F.when(but != "", but).alias("exception"))
    unsure = F.col("scale").isNull() | F.coalesce(~F.col("exception").isin(*K.POLICY_ALLOWED), F.lit(False))
    first = F.min_by(F.struct("scale", "page", "declaration", "exception"), F.struct("page", "ord"))
    whole = said.groupBy("doc_id").agg(F.bool_or(unsure).alias("unsure"), F.countDistinct("scale").alias("scales"), first.alias("p"))
    return whole.filter("not unsure and scales = 1").select("doc_id", "p.*")


def number_tokens(line: Column | str) -> Column:
    """OP-90: accounting numbers of a line; (1,234) is -1234."""
    found = F.regexp_extract_all(line, F.lit(r"(?:^|[^\p{L}\p{N}_.])(\(?-?[0-9][0-9,]*(?:\.[0-9]+)?\)?)"), F.lit(1))
    return F.transform(found, lambda t: F.regexp_replace(F.regexp_replace(t, r"[,)]", ""), r"\(", "-").try_cast("decimal(30,6)"))


def doc_identity(text: Column, name: Column, year: Column, scope: Column) -> Column:
    """OP-90: does a cover name the company, the year and the scope."""
    found = F.regexp_extract(fold(text), K.COVER_PERIOD, 1)
    same = squash(text).contains(squash(name)) & (F.right(found, F.lit(4)).try_cast("int") == year)
    return F.coalesce((found != "") & same & (found.contains("consolidad") == (scope == "consolidated")), F.lit(False))


# ---- headings and sections


def accept_sequence(candidates: DataFrame, least: int = 5) -> DataFrame:
    """OP-72: per document, headings accepted in order: the next expected number, and a plausible title.

    candidates: doc_id, page, start, number, title, plausible; further columns go along.  The fold runs in one expression over the
    document's sorted candidates.  Gives doc_id, headings, status: ok, or too_few (fewer than ``least``), or
    incomplete (a larger plausible number follows the last accepted one, which is then left out too and given as tail); of candidates
    with a column ``numbered`` only those count there that have it true.
    """
    row = F.struct("page", "start", "number", "title", "plausible", *(c for c in candidates.columns if c not in ("doc_id", "page", "start", "number", "title", "plausible")))
    docs = candidates.groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("c"))
    empty = F.slice("c", 1, 0)
    kept = F.aggregate("c", empty, lambda acc, x: F.when(x["plausible"] & (x["number"] == F.size(acc) + 1), F.concat(acc, F.array(x))).otherwise(acc))
    docs = docs.withColumn("kept", kept)
    counts = (lambda x: x["numbered"]) if "numbered" in candidates.columns else (lambda x: F.lit(True))
    later = F.exists("c", lambda x: x["plausible"] & counts(x) & (x["number"] > F.size("kept")))
    status = F.when(F.size("kept") < least, "too_few").when(later, "incomplete").otherwise("ok")
    docs = docs.withColumn("status", status)
    heads = F.when(F.col("status") == "ok", F.col("kept")).when(F.col("status") == "incomplete", F.slice("kept", F.lit(1), F.size("kept") - 1)).otherwise(empty)
    return docs.select("doc_id", heads.alias("headings"), "status", F.when(F.col("status") == "incomplete", F.element_at("kept", -1)).alias("tail"))


def reconcile_index(index: DataFrame, body: DataFrame, least: int = 5) -> DataFrame:
    """OP-73: contents entries (doc_id, number, title) against body headings (doc_id, page, start, number, title).

    status of each document: contradictory (one number, two titles), incomplete (not 1..n), short (fewer than
    ``least``: not used), missing or ambiguous (an entry without exactly one heading), disordered, or ok.
    """
    key = words_key("title")
    entries = index.groupBy("doc_id", "number").agg(F.min(key).alias("key"), F.countDistinct(key).alias("titles"))
    whole = entries.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"), F.max("titles").alias("titles"))
    found = body.select("doc_id", "page", "start", "number", key.alias("key"))
    matched = entries.join(found, ["doc_id", "number", "key"], "left").groupBy("doc_id", "number").agg(F.count("page").alias("m"), F.min(F.struct("page", "start")).alias("at"))
    order = Window.partitionBy("doc_id").orderBy("number")
    checked = matched.withColumn("back", F.coalesce(F.col("at") < F.lag("at").over(order), F.lit(False)))
    facts = checked.groupBy("doc_id").agg(F.count_if(F.col("m") == 0).alias("missing"), F.count_if(F.col("m") > 1).alias("ambiguous"), F.bool_or("back").alias("back"))
    status = F.when(F.col("titles") > 1, "contradictory").when((F.col("lo") != 1) | (F.col("hi") != F.col("n")), "incomplete").when(F.col("n") < least, "short").when(F.col("missing") > 0, "missing").when(F.col("ambiguous") > 0, "ambiguous").when(F.col("back"), "disordered").otherwise("ok")
    return whole.join(facts, "doc_id").select("doc_id", status.alias("status"), F.col("n").alias("entries"))


def slice_sections(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """OP-40: page text between a heading and the next: doc_id, number, page, section.

    pages: doc_id, page, text; headings: doc_id, number, page, start, body (offset behind the heading), from 0.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "start")
    bounds = headings.withColumn("end_page", F.lead("page").over(w)).withColumn("end_start", F.lead("start").over(w))
    p, h = pages.alias("p"), bounds.alias("h")
    joined = p.join(h, (F.col("p.doc_id") == F.col("h.doc_id")) & (F.col("p.page") >= F.col("h.page")) & (F.col("h.end_page").isNull() | (F.col("p.page") <= F.col("h.end_page"))))
    begin = F.when(F.col("p.page") == F.col("h.page"), F.col("h.body")).otherwise(F.lit(0))
    end = F.when(F.col("p.page") == F.col("h.end_page"), F.col("h.end_start")).otherwise(F.length("p.text"))
    section = F.substr("p.text", (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
    return joined.select("p.doc_id", "h.number", "p.page", section.alias("section")).filter(F.trim("section") != "")


def repeated_lines(lines: DataFrame, least: int = 3) -> DataFrame:
    """OP-74: lines that stand on at least ``least`` pages of a document: doc_id, line, pages."""
    return lines.filter(F.trim("line") != "").groupBy("doc_id", F.trim("line").alias("line")).agg(F.countDistinct("page").alias("pages")).filter(F.col("pages") >= least)


def evidence_lines(facts: DataFrame, lines: DataFrame) -> DataFrame:
    """OP-41: facts (doc_id, account_code, label, current, comparative) on lines (doc_id, line_no, line) of their document.

    A line proves a fact if it has all words of the label and its last two numbers are the amounts.  The pair
    is joined on document and last number, so only plausible lines meet.
    """
    words = lambda c: F.array_except(F.transform(F.regexp_extract_all(fold(c), F.lit("[a-z]+"), F.lit(0)), lambda x: F.when(x == K.LABEL_ALIAS[0], K.LABEL_ALIAS[1]).otherwise(x)), F.lit(list(K.LABEL_STOP_WORDS)))
    f = facts.filter("current <> 0 and comparative is not null").select("doc_id", "account_code", words("label").alias("lw"), F.col("current").cast("decimal(30,6)").alias("a"), F.col("comparative").cast("decimal(30,6)").alias("b")).filter(F.size("lw") > 0)
    x = lines.select("doc_id", "line_no", "line", words("line").alias("w"), number_tokens("line").alias("v")).filter(F.size("v") >= 2)
    x = x.select("doc_id", "line_no", "line", "w", F.element_at("v", -2).alias("a"), F.element_at("v", -1).alias("b"))
    return f.join(x, ["doc_id", "a", "b"]).filter(F.size(F.array_except("lw", "w")) == 0).groupBy("doc_id", "account_code").agg(F.min_by(F.trim("line"), "line_no").alias("line"), F.min("line_no").alias("line_no"))


# ---- sentences


def sentences(fragments: DataFrame) -> DataFrame:
    """OP-85: fragment columns with ord and sentence."""
    clean = F.regexp_replace("text", K.LEADING_PAGE_NUMBER, "")
    split = F.split(collapse(clean), K.COLLAPSED_BOUNDARY, -1)
    ends = lambda x: F.startswith(x, F.lit("-")) | F.startswith(x, F.lit(" ")) | F.endswith(x, F.lit("-")) | F.endswith(x, F.lit(" "))
    strip = lambda x: F.when(ends(x), F.btrim(x, F.lit(" -"))).otherwise(x)
    return fragments.select(*[c for c in fragments.columns if c != "text"], F.posexplode(F.filter(F.transform(split, strip), lambda x: x != "")).alias("ord", "sentence"))


#: Eleven pieces or more between white space: ten runs of it.
ELEVEN_WORDS = r"^(?:\S*+\s++){10}"
#: No digits, and never more other characters in a row than letters before them.
PLAIN_PROSE = r"^(?:\p{L}{2,}+[^\p{L}\p{Nd}]{1,2}+|\p{L}[^\p{L}\p{Nd}])++\p{L}*+\z"


def narrative(rows: DataFrame, verbs=K.NARRATIVE_VERBS) -> DataFrame:
    """OP-86: the rows whose sentence is prose that may serve as evidence, with ``plain``, its lower-cased text without accents.

    What counts characters comes first; the folded text is made once, of what is left (an explode binds it, so that no later
    test folds it again).  Nothing is counted in a sentence without digits whose letters are half of it by its form alone.
    """
    c = F.col("sentence")
    n = F.length(c)
    letters = F.length(F.regexp_replace(c, r"\P{L}+", ""))  # one match a run of other characters, not one a letter
    digits = n - F.length(F.regexp_replace(c, r"\p{Nd}+", ""))
    numbers = F.size(F.regexp_extract_all(c, F.lit(r"\b[0-9][0-9.,]*"), F.lit(0)))
    counted = F.when(c.rlike(PLAIN_PROSE), True).otherwise((letters / n >= 0.48) & (digits / n <= 0.18) & (numbers <= 10))
    few_blanks = ~c.contains("_") | (n - F.length(F.replace(c, F.lit("_"), F.lit(""))) <= 3)
    prose = n.between(70, 560) & c.rlike(ELEVEN_WORDS) & counted & few_blanks
    folded = F.lower(unaccent(c))
    kept = rows.filter(prose).select("*", F.explode(F.array(F.struct(folded.alias("plain"), F.when(c.rlike("[0-9]"), numbers).otherwise(0).alias("numbers")))).alias("_x"))
    text = F.col("_x.plain")
    said = ((F.col("_x.numbers") < 4) | contains_any(text, verbs)) & ~(contains_any(text, K.ADVICE_VERBS) & text.rlike(K.INVESTMENT_ADVICE)) & ~(text.startswith(K.BOILERPLATE_BEGINNINGS[0]) | text.startswith(K.BOILERPLATE_BEGINNINGS[1]))
    return kept.filter(said).withColumn("plain", text).drop("_x")


def topic_terms(text: Column, topic: Column, keywords: dict[str, tuple[str, ...]] = K.TOPIC_KEYWORDS) -> Column:
    """OP-87: how many keywords of its topic a folded text has."""
    out = F.lit(0)
    for name, terms in keywords.items():
        out = F.when(topic == name, count_terms(text, terms)).otherwise(out)
    return out


def sentence_score(c: Column, text: Column, fiscal_year: Column, found: Column, material=K.MATERIAL_TERMS) -> Column:
    """OP-87: how much a sentence c (folded: text) says about its topic; found: how many of the topic's keywords it has."""
    return (
        F.lit(1.0) + F.least(found, F.lit(3)) * 1.6
        + F.when(c.rlike(K.MONEY_OR_PERCENT), 1.8).otherwise(0.0)
        + F.when(c.contains(fiscal_year.cast("string")), 0.8).otherwise(0.0)
        + F.least(count_terms(text, material), F.lit(2)) * 1.0
        + F.when(F.length(c).between(110, 380), 0.5).otherwise(0.0)
        - F.when(text.contains(K.STANDARD_PHRASE), 1.5).otherwise(0.0)
    )


def select_evidence(scored: DataFrame, keys: list[str], items: int = 3, per_fragment: int = 2, similar: float = 0.62) -> DataFrame:
    """OP-79: the best sentences of each group that are not too similar to better ones already taken.

    scored: keys, fragment, page, ord, sentence, score.  A group is one document's sentences; they are sorted once and one
    fold takes them.  Words are made in the fold, once a sentence that there is still room for, and do not move.
    """
    words = lambda x: F.array_distinct(F.regexp_extract_all(F.lower(x["sentence"]), F.lit("[a-záéíóúñ]{4,}"), F.lit(0)))
    row = F.struct((-F.col("score")).alias("s"), "page", "ord", "fragment", "sentence", "score")
    groups = scored.select(*keys, row.alias("x")).groupBy(*keys).agg(F.array_sort(F.collect_list("x")).alias("rows"))

    def near(x: Column, t: Column) -> Column:
        common = F.size(F.array_intersect(x["words"], t["words"]))
        union = F.size(x["words"]) + F.size(t["words"]) - common
        return (union > 0) & (common >= similar * union)

    read = lambda x: F.struct(*(x[k].alias(k) for k in ("fragment", "page", "ord", "sentence", "score")), words(x).alias("words"))

    def step(taken: Column, x: Column) -> Column:
        room = (F.size(taken) < items) & (F.size(F.filter(taken, lambda t: t["fragment"] == x["fragment"])) < per_fragment)
        return F.when(room, let(read(x), lambda y: F.when(F.exists(taken, lambda t: near(y, t)), taken).otherwise(F.concat(taken, F.array(y))))).otherwise(taken)

    taken = groups.select(*keys, F.aggregate("rows", F.transform(F.slice("rows", 1, 0), read), step).alias("taken"))
    found = taken.select(*keys, F.posexplode("taken").alias("rank", "x"))
    return found.select(*keys, (F.col("rank") + 1).alias("rank"), "x.fragment", "x.page", "x.ord", "x.sentence", "x.score")


def summary_confidence(chosen: DataFrame, keys: list[str], groups: DataFrame | None = None, mark: str = "US$(000)") -> DataFrame:
    """OP-60: status, confidence and missing data of each group by its facts and pages.

    groups: keys and text of all groups; those without a chosen sentence abstain, and those with ``mark`` in their text have
    tables that were not rebuilt.
    """
    counted = chosen.groupBy(*keys).agg(F.count("*").alias("facts"), F.countDistinct("page").alias("pages"))
    if groups is not None:
        every = groups.groupBy(*keys).agg(F.coalesce(F.bool_or(F.contains("text", F.lit(mark))), F.lit(False)).alias("tables"))
        counted = every.join(counted, keys, "left").withColumns({"facts": F.coalesce("facts", F.lit(0)), "pages": F.coalesce("pages", F.lit(0))})
    else:
        counted = counted.withColumn("tables", F.lit(False))
    status = F.when(F.col("facts") >= 2, "generated").when(F.col("facts") == 1, "partial").otherwise("insufficient_evidence")
    confidence = F.when((F.col("facts") >= 3) & (F.col("pages") >= 2), "high").when(F.col("facts") >= 2, "medium").otherwise("low")
    return counted.withColumn("status", status).withColumn("confidence", confidence).withColumn("limited", F.col("facts") < 2)


def priority_fragments(notes: DataFrame, current: int, per_year: tuple[int, int] = (20, 12), each: int = 2500, total: int = 75_000, terms=K.RISK_TERMS) -> DataFrame:
    """OP-80: the most relevant notes of two years of each company, cut to a common budget.

    notes: company, fiscal_year, note_number, title, topic, text (one fragment a note).
    """
    title, body = F.lower(unaccent("title")), F.lower(unaccent(F.left("text", F.lit(2500))))
    folded = [t.replace("é", "e") for t in terms]
    generic, exceptional = contains_any(title, K.GENERIC_TITLES), contains_any(body, K.EXCEPTIONAL_TEXT)
    relevance = F.when(F.col("topic").isin(*K.PRIORITY_TOPICS), 5).otherwise(0) + count_terms(title, folded) * 3 + count_terms(body, folded) - F.when(generic & ~exceptional, 12).otherwise(0) + F.when(exceptional, 15).otherwise(0)
    ranked = notes.withColumn("relevance", relevance).withColumn("rank", F.row_number().over(Window.partitionBy("company", "fiscal_year").orderBy(F.desc("relevance"), "note_number", "scope")))
    kept = ranked.filter(F.col("rank") <= F.when(F.col("fiscal_year") == current, per_year[0]).otherwise(per_year[1]))
    n = F.count("*").over(Window.partitionBy("company"))
    return kept.withColumn("content", F.left("text", F.least(F.lit(each), F.floor(F.lit(total) / n)).cast("int"))).drop("text")


def report_status(checked: DataFrame, keys: list[str]) -> DataFrame:
    """OP-42: findings accepted and rejected, and the status, of each report (keys, finding, accepted, one row a citation).

    A finding stands if all its citations do; a report with a rejected finding is partial, one without any finding has
    insufficient evidence.
    """
    findings = checked.groupBy(*keys, "finding").agg(F.bool_and("accepted").alias("ok"))
    n = findings.groupBy(*keys).agg(F.count_if(F.col("ok")).alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))
    return n.withColumn("status", F.when(F.col("rejected") > 0, "partial").when(F.col("accepted") > 0, "generated").otherwise("insufficient_evidence"))


def strip_repeated(lines: DataFrame, least: int = 3) -> DataFrame:
    """OP-74: lines (doc_id, page, line, ...) without those that stand on at least ``least`` pages of their document."""
    known = repeated_lines(lines, least).select("doc_id", F.col("line").alias("_line"))
    return lines.withColumn("_line", F.trim("line")).join(known, ["doc_id", "_line"], "left_anti").drop("_line")


def check_citations(citations: DataFrame, fragments: DataFrame) -> DataFrame:
    """OP-42: cited quotes (citation_id, fragment_id, quote) that stand, white space collapsed, in their fragment."""
    joined = citations.join(fragments.select("fragment_id", "text"), "fragment_id", "left")
    return joined.select("citation_id", "fragment_id", F.coalesce(F.contains(collapse("text"), collapse("quote")) & (collapse("quote") != ""), F.lit(False)).alias("accepted"))


def find_quotes(quotes: DataFrame, fragments: DataFrame, n: int = 6) -> DataFrame:
    """OP-42 in discovery mode: which fragments hold which quotes (of three words or more) literally.

    The words between a quote's first and last are whole words of any fragment that holds it, so the two
    sides join on a run of at most ``n`` of them; only pairs that share that run are compared.
    """
    q = quotes.select("citation_id", collapse("quote").alias("quote")).withColumn("w", F.split("quote", " ")).filter(F.size("w") >= 3)
    q = q.withColumn("m", F.least(F.lit(n), F.size("w") - 2))
    lengths = sorted(r["m"] for r in q.select("m").distinct().collect())  # n at most
    f = fragments.select("fragment_id", collapse("text").alias("text"))
    if not lengths:
        return q.select("citation_id", F.lit(None).cast(f.schema["fragment_id"].dataType).alias("fragment_id"))
    # runs meet as numbers; a quote has one run, of its own length
    hashed = lambda column, m, first: F.xxhash64(*(F.get(column, k + first) for k in range(m)))
    asked = None
    for m in lengths:
        own = q.filter(F.col("m") == m).select("citation_id", "quote", hashed("w", m, 1).alias("run"))
        asked = own if asked is None else asked.union(own)
    # the shifted copies of the word array, zipped: no look-up inside a loop; shorter runs begin the longest
    longest = lengths[-1]
    parts = F.arrays_zip(*(F.slice("w", k + 1, F.size("w")).alias(f"x{k}") for k in range(longest)))
    words = f.select("fragment_id", F.split("text", " ").alias("w")).select("fragment_id", F.inline(parts))
    runs = words.select("fragment_id", F.explode(F.array(*(F.when(F.col(f"x{m - 1}").isNotNull(), F.xxhash64(*(f"x{k}" for k in range(m)))) for m in lengths))).alias("run")) if len(lengths) > 1 else words.filter(F.col(f"x{longest - 1}").isNotNull()).select("fragment_id", F.xxhash64(*(f"x{k}" for k in range(longest))).alias("run"))
    pairs = asked.join(runs.filter("run is not null"), "run").select("citation_id", "quote", "fragment_id").distinct()
    return pairs.join(f, "fragment_id").filter(F.contains("text", "quote")).select("citation_id", "fragment_id")
