"""Numbered notes out of page text: candidates with their places, contents pages, accepted headings, sections.

pages are (doc_id, page from 0, text).  Places are code points from the beginning of a page.  Texts are cut where they are read;
only candidates travel, once, to their document.  A null text is an empty page; a document without pages has no row.
"""

from __future__ import annotations

from string import ascii_letters, digits

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import constants as K
from tallyforge.functions.text import folded_like, let, may_begin, unaccent, words_key
from tallyforge.operators.documents import accept_sequence, topic
from tallyforge.sources.shared import checkpointed

#: White space of any script, and what ends a line besides the line feed.
# The range before && tells most characters at once.
_BLANKS = r"\s\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BLANK = rf"[\x00-\x20\x{{80}}-\x{{3000}}&&[{_BLANKS}]]"
#: Runs of it other than one plain space, which stands already as it should.
BLANKS = rf"{BLANK}(?:(?<! ){BLANK}*+|{BLANK}++)"
_END = r"[\n-\x1E\x{85}-\x{2029}&&[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]]"
LINE_END = rf"\r\n|{_END}"
# Patterns over a page: ^ stands behind line feeds only (d), in every line (m).
NUMBERED = r"[ \t]*([0-9]{1,2})(\.?)[ \t]+([^\n]{3,180})"
UNNUMBERED = rf"[ \t]*\.[ \t]+((?iu:{K.UNNUMBERED_HEADING[1]}))[ \t]*$"
CANDIDATE = rf"(?dm)^(?=[ \t]*[0-9]{{1,2}}\.?[ \t]+[^\n]{{3}}|{UNNUMBERED})"
APPENDIX = rf"(?idmu)^[ \t]*(?:{K.APPENDIX_BEGINNINGS})\b"
MARK = "\x01"
LETTERS = "[A-Za-zÁÉÍÓÚÑáéíóúñ]"


def _met(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of tables that grow with the documents, none of which goes through the driver.

    Spark guesses a table by its file, which is many times smaller than its rows where titles are alike, and would broadcast it.
    """
    return left.hint("merge").join(right, on, how)


def plain(c: Column) -> Column:
    """Folded, but with its white space."""
    return F.lower(unaccent(c))


def clean_title(c: Column) -> Column:
    return F.regexp_replace(F.btrim(F.regexp_replace(c, f"{BLANK}+", " ")), "[ –:-]+$", "")


def plausible(title: Column, dotted: Column) -> Column:
    """OP-72: may this be the title of a note?

    Without a dot behind the number it must be in capitals, or begin with a capital and have two words that are not of a date.  It has at most 120
    characters and does not break off at an article, preposition or conjunction.
    """
    dated = title.rlike(r"^(?:De|Del|Al)(?![\p{L}\p{N}_])") | title.rlike(r"(?iu)(?<![\p{L}\p{N}_])(?:de|del)\s+[0-9]{1,2}\s+de(?![\p{L}\p{N}_])")
    named = (F.size(F.regexp_extract_all(title, F.lit(f"{LETTERS}+"), F.lit(0))) >= 2) & title.rlike(r"^\p{Lu}") & ~dated
    spoken = F.regexp_replace(title, "[. ]+$", "")
    last = F.lower(F.element_at(F.split(spoken, " "), -1))
    fits = F.length(title).between(1, 120) & (spoken != "")
    return fits & (dotted | (title == F.upper(title)) | F.startswith(plain(title), F.lit(K.KNOWN_TITLE)) | named) & ~last.isin(*K.TITLE_LAST_WORDS)


def is_contents(text: Column) -> Column:
    """OP-73: a page whose numbered lines, three or more, all end in a page reference."""
    entries = F.regexp_extract_all(text, F.lit(rf"(?dm)^{NUMBERED}"), F.lit(3))
    return let(entries, lambda e: (F.size(e) >= 3) & F.forall(e, lambda x: x.rlike(rf"{BLANK}[0-9]+{BLANK}*$")))


#: Letters and digits that a title in the contents can have when it is folded: 180 characters, of which each stands for 18 at most, and nearly always for one.
LONGEST_KEY, USUAL_KEY = 180 * 18, 180


def _plain_letters(c: Column) -> Column:
    """The number of letters and digits that folding surely leaves."""
    return F.length(F.regexp_replace(c, f"[^{ascii_letters}{digits}]+", ""))


def _parts(pages: DataFrame, longest: int = LONGEST_KEY) -> DataFrame:
    """The candidates of ``note_candidates``, and one row without a number for the beginning of each page; tails end before a line with more than ``longest`` letters and digits."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit(MARK), F.lit(" "))
    marked = F.split(F.regexp_replace("text", CANDIDATE, MARK), MARK, -1)
    cut = pages.select("doc_id", F.col("page").cast("int"), text.alias("text"))
    begun = F.col("text").rlike(r"(?dm)^\s*1[.\s]") & folded_like(F.col("text"), K.NOTES_MARKER)
    facts = cut.select(
        "doc_id", "page", marked.alias("parts"), is_contents(F.col("text")).alias("contents"), begun.alias("begun"),
        F.when(F.col("text").rlike(APPENDIX), F.length(F.split("text", APPENDIX, 2)[0])).alias("appendix"),
    )
    # four parts hold at least the three lines behind the first one's own
    behind = lambda k: F.regexp_extract(F.array_join(F.slice("parts", k + 1, 4), ""), r"(?d)^[^\n]*(?:\n[^\n]+){0,3}", 0)
    part = F.transform("parts", lambda x, k: F.struct(F.length(x).alias("n"), F.when(k > 0, behind(k)).alias("lines")))
    rows = facts.select("doc_id", "page", "contents", "begun", "appendix", F.posexplode(part).alias("k", "x")).select("doc_id", "page", "contents", "begun", "appendix", "k", "x.*")
    # patterns see the line of the candidate only, as long lines behind it would be read by each
    rows = rows.withColumn("line", F.substring_index("lines", "\n", 1))
    line = F.col("line")
    group = lambda k: F.regexp_extract(line, rf"(?d)^{NUMBERED}", k)
    lost = rf"(?dm)^{UNNUMBERED}"
    numbered = F.col("numbered")
    rows = rows.withColumn("numbered", group(1) != "")
    rows = rows.withColumns({
        "own": F.when(numbered, group(0)).otherwise(F.regexp_extract(line, lost, 0)), "dotted": ~numbered | (group(2) != ""),
        "number": F.when(numbered, group(1).cast("int")).when(~numbered, K.UNNUMBERED_HEADING[0]), "title": clean_title(F.when(numbered, group(3)).otherwise(F.regexp_extract(line, lost, 1))),
    })
    # one title goes on in a line of its own
    rows = rows.withColumn("tail", F.substr("lines", F.length("own") + 1)).drop("lines", "line")
    wrapped = F.regexp_extract("tail", rf"(?d)^\r?\n[ \t]*({K.WRAPPED_TITLE[1]})[ \t]*(?:\r?\n|$)", 0)
    rows = rows.withColumn("wrapped", F.when(F.endswith(plain(F.col("title")), F.lit(K.WRAPPED_TITLE[0])), F.length(wrapped)).otherwise(0))
    rows = rows.withColumn("goes_on", F.col("wrapped") > 0)
    rows = rows.withColumn("plausible", plausible(F.when(F.col("goes_on"), F.concat_ws(" ", "title", F.lit(K.WRAPPED_TITLE[1]))).otherwise(F.col("title")), F.col("dotted")))
    # what no title of the contents is long enough for stays behind, and so does what is no line of its own, or stands in the contents
    over = lambda x: (F.length(x) > longest) & ((_plain_letters(F.left(x, F.lit(2 * longest))) > longest) | ((F.length(x) > 2 * longest) & (_plain_letters(x) > longest)))
    first = lambda x, n: F.array_join(F.slice(x, 1, n), "\n")
    upto = lambda x: F.when(over(x[1]), "").when(over(F.get(x, F.lit(2))), first(x, 2)).when(over(F.get(x, F.lit(3))), first(x, 3)).otherwise(F.col("tail"))
    # most tails begin with a line that its first letters tell to be too long
    begins = F.regexp_extract(F.left("tail", F.lit(2 * longest)), r"(?d)^\r?\n[^\n]*", 0)
    short = F.when(F.length("tail") <= longest, F.col("tail")).when(_plain_letters(begins) > longest, "").otherwise(let(F.split("tail", "\n", -1), upto))
    own_line = F.startswith("tail", F.lit("\n")) | F.startswith("tail", F.lit("\r\n"))
    rows = rows.withColumn("tail", F.when(~F.col("contents") & own_line, short).otherwise(F.when(F.col("k") > 0, "")))
    # one shuffle, by document; all windows and joins that follow stand on it
    by_doc = rows.repartition("doc_id")
    before = F.sum("n").over(Window.partitionBy("doc_id", "page").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
    whole = Window.partitionBy("doc_id")
    opens = F.min(F.when(F.col("begun") & ~F.col("contents"), F.col("page"))).over(whole)
    placed = by_doc.withColumn("start", F.coalesce(before, F.lit(0)).cast("int")).withColumn("opens", opens)
    closes = F.min(F.when((F.col("page") >= F.col("opens")) & ~F.col("contents") & F.col("appendix").isNotNull(), F.struct("page", "appendix"))).over(whole)
    placed = placed.withColumn("closes", closes)
    end = (F.col("start") + F.length("own")).cast("int")
    after = (F.col("page") > F.col("closes.page")) | ((F.col("page") == F.col("closes.page")) & (F.col("start") >= F.col("closes.appendix")))
    inside = ~F.col("contents") & (F.col("page") >= F.col("opens")) & ~F.coalesce(after, F.lit(False))
    return placed.select(
        "doc_id", "page", "start", end.alias("end"), "number", "dotted", "numbered", "title", "tail", "contents", "goes_on", (end + F.col("wrapped")).alias("wrapped_end"),
        "plausible", F.coalesce(inside, F.lit(False)).alias("scope"),
    )


def note_candidates(pages: DataFrame) -> DataFrame:
    """OP-72: doc_id, page, start, end, number, dotted, numbered, title, plausible, tail, contents, scope of each heading candidate.

    start and end are places in the page, tail the (up to three) lines behind the candidate, contents whether its page is a contents page (which leaves
    tails out); a tail ends before a line with more than a contents title can have.  scope: it stands between the page on which the notes begin and the first appendix.
    goes_on: the title ends in the next line, with its end at wrapped_end.
    """
    return _parts(pages).filter("number is not null")


def contents_entries(candidates: DataFrame) -> DataFrame:
    """OP-73: doc_id, number, key and titles (different keys) of the entries of contents pages; what has no letter is none."""
    title = F.regexp_replace(F.regexp_replace("title", rf"[.·… ]*{BLANK}[0-9]+{BLANK}*$", ""), "^[ .·…]+|[ .·…]+$", "")
    rows = candidates.filter("contents and numbered").withColumn("entry", title).filter(F.col("entry").rlike(LETTERS))
    key = words_key("entry")
    return rows.select("doc_id", "number", key.alias("key")).groupBy("doc_id", "number").agg(F.min("key").alias("key"), F.countDistinct("key").alias("titles"))


def match_contents(entries: DataFrame, candidates: DataFrame, more: int = 3) -> DataFrame:
    """OP-73: headings (doc_id, number, title, page, start, end) outside contents pages that stand in the contents of their document.

    A title may go on over up to ``more`` lines, as long as what is read so far begins the entry.
    """
    body = _met(candidates.filter("numbered and not contents"), entries.select("doc_id", "number", "key"), ["doc_id", "number"])
    # one column a step, so that each title is folded once: what is read, its key, the rest, and whether reading may go on
    rows = body.select("doc_id", "number", "key", "page", "start", F.col("end").alias("e0"), F.col("title").alias("t0"), F.col("tail").alias("r0"), F.lit(True).alias("on0"))
    for k in range(more + 1):
        rows = rows.withColumn(f"k{k}", words_key(f"t{k}"))
        if k < more:
            prefix = F.col(f"on{k}") & F.startswith("key", F.concat(f"k{k}", F.lit(" ")))
            rows = rows.withColumn("line", F.when(prefix, F.regexp_extract(f"r{k}", r"(?d)^\r?\n[ \t]*([^\n]+)", 0)).otherwise(""))
            # a line with more letters than the entry does not end it
            goes_on = (F.col("line") != "") & (_plain_letters(F.col("line")) <= F.length("key"))
            rows = rows.withColumn(f"on{k + 1}", goes_on)
            on = lambda c, k=k: F.when(F.col(f"on{k + 1}"), c)
            rows = rows.withColumns({
                f"t{k + 1}": on(clean_title(F.concat_ws(" ", f"t{k}", F.regexp_replace("line", r"(?d)^\r?\n[ \t]*", "")))),
                f"r{k + 1}": on(F.substr(f"r{k}", F.length("line") + 1)), f"e{k + 1}": on((F.col(f"e{k}") + F.length("line")).cast("int")),
            })
    hits = [F.when(F.col(f"on{k}") & (F.col(f"k{k}") == F.col("key")), F.struct(F.col(f"t{k}").alias("title"), F.col(f"e{k}").alias("end"))) for k in range(more + 1)]
    # rows without a hit go by ``inline``: a filter would be moved down and make every step again
    return rows.select("doc_id", "number", "page", "start", F.inline(F.array_compact(F.array(F.coalesce(*hits))))).select("doc_id", "number", "title", "page", "start", "end")


def reconcile_contents(entries: DataFrame, matched: DataFrame, least: int = 5) -> DataFrame:
    """OP-73: doc_id, status, entries and headings of each document with a contents page.

    status: contradictory (one number, two titles), incomplete (not 1..n), short (fewer than ``least`` entries: not used), missing or ambiguous (an
    entry without exactly one heading), disordered, or ok; only ok has headings.
    """
    each = _met(entries, matched.groupBy("doc_id", "number").agg(F.count("*").alias("m"), F.min(F.struct("page", "start", "end", "title")).alias("at")), ["doc_id", "number"], "left")
    back = F.coalesce(F.struct("at.page", "at.start") < F.lag(F.struct("at.page", "at.start")).over(Window.partitionBy("doc_id").orderBy("number")), F.lit(False))
    each = each.withColumn("back", back)
    row = F.struct("number", "at.title", "at.page", "at.start", "at.end")
    whole = each.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"), F.max("titles").alias("titles"),
        F.count_if(F.col("m").isNull()).alias("missing"), F.count_if(F.col("m") > 1).alias("ambiguous"), F.bool_or("back").alias("back"), F.array_sort(F.collect_list(row)).alias("headings"),
    )
    status = F.when(F.col("titles") > 1, "contradictory").when((F.col("lo") != 1) | (F.col("hi") != F.col("n")), "incomplete").when(F.col("n") < least, "short")
    status = status.when(F.col("missing") > 0, "missing").when(F.col("ambiguous") > 0, "ambiguous").when(F.col("back"), "disordered").otherwise("ok")
    return whole.withColumn("status", status).select("doc_id", "status", F.col("n").alias("entries"), F.when(F.col("status") == "ok", F.col("headings")).otherwise(F.slice("headings", 1, 0)).alias("headings"))


def note_headings(pages: DataFrame, least: int = 5) -> DataFrame:
    """OP-72 and OP-73: doc_id, source, status, headings (number, title, page, start, end) and tail (page, start) of each document.

    Where the contents can be used (source contents), they say which headings there are; else headings are accepted in sequence (source sequence) from the
    page on which the notes begin.  status is that of ``reconcile_contents`` or ``accept_sequence``, or no_start.  tail is where a last heading was
    left out because a later number follows it: the note before it ends there.
    """
    every = checkpointed(_parts(pages, USUAL_KEY))
    entries = checkpointed(contents_entries(every.filter("number is not null")))
    longest = entries.agg(F.max(F.length("key"))).first()[0]
    if longest is not None and longest > USUAL_KEY:
        # an entry in forms that fold to several characters: lines behind candidates may be as long
        every = checkpointed(_parts(pages, longest))
    found = every.filter("number is not null")
    listed = reconcile_contents(entries, match_contents(entries, found), least).filter("status != 'short'")
    goes_on = F.col("goes_on")
    title = F.when(goes_on, F.concat_ws(" ", "title", F.lit(K.WRAPPED_TITLE[1]))).otherwise(F.col("title"))
    scope = found.filter("scope").withColumn("title", title).withColumn("end", F.when(goes_on, F.col("wrapped_end")).otherwise(F.col("end")))
    accepted = accept_sequence(scope.select("doc_id", "page", "start", "number", "title", "plausible", "end", "numbered"), least)
    place = F.struct(F.col("tail.page").alias("page"), F.col("tail.start").alias("start"))
    sequence = accepted.select("doc_id", F.struct(F.lit("sequence").alias("source"), "status", F.transform("headings", _heading).alias("headings"), F.when(F.col("tail").isNotNull(), place).alias("tail")).alias("s"))
    by_contents = listed.select("doc_id", F.struct(F.lit("contents").alias("source"), "status", F.transform("headings", _heading).alias("headings")).alias("c"))
    both = _met(_met(every.select("doc_id").distinct(), by_contents, "doc_id", "left"), sequence, "doc_id", "left")
    either = lambda field: F.coalesce(F.col(f"c.{field}"), F.when(F.col("c").isNull(), F.col(f"s.{field}")))
    none = F.expr("cast(array() as array<struct<number: int, title: string, page: int, start: int, end: int>>)")
    return both.select(
        "doc_id", F.coalesce(either("source"), F.lit("sequence")).alias("source"), F.coalesce(either("status"), F.lit("no_start")).alias("status"),
        F.coalesce(either("headings"), none).alias("headings"), F.when(F.col("c").isNull(), F.col("s.tail")).alias("tail"),
    )


def _heading(h: Column) -> Column:
    return F.struct(h["number"].alias("number"), h["title"].alias("title"), h["page"].alias("page"), h["start"].alias("start"), h["end"].alias("end"))


# ---- sections


def _spaced(line: Column) -> Column:
    """White space collapsed."""
    return F.btrim(F.regexp_replace(line, BLANKS, " "))


def _lines(text: Column) -> Column:
    """Lines that are not blank, their white space collapsed."""
    return F.filter(F.transform(F.split(text, LINE_END, -1), _spaced), lambda x: x != "")


def repeated_headers(pages: DataFrame, least: int = 3) -> DataFrame:
    """OP-74: doc_id and line of the lines around the marker that ``least`` pages of a document begin with.

    Of a page whose first four lines hold the marker, the lines up to two behind it count.
    """
    return _repeated(pages.select("doc_id", _heads(F.coalesce("text", F.lit(""))).alias("heads")), least)


def _heads(text: Column) -> Column:
    """The lines that a page begins with, to two behind the marker; none without a marker in the first four."""
    # six lines and the rest: blanks go with the line end before them, so that a line begins with what it shows
    shown = F.filter(F.slice(F.split(F.concat(F.lit("\n"), text), f"{_END}{BLANK}*+", 8), 2, 6), lambda x: x != "")
    marks = lambda x: F.when(may_begin(x, K.NOTES_MARKER[0]), folded_like(_spaced(x), K.NOTES_MARKER, begins=True)).otherwise(F.lit(False))
    place = lambda top: F.array_position(F.transform(F.slice(top, 1, 4), marks), True).cast("int")
    return let(shown, lambda top: let(place(top), lambda k: F.array_distinct(F.transform(F.slice(top, F.lit(1), F.when(k > 0, k + 2).otherwise(0)), _spaced))))


def _repeated(pages: DataFrame, least: int = 3) -> DataFrame:
    heads = pages.select("doc_id", F.explode("heads").alias("line"))
    return heads.groupBy("doc_id", "line").agg(F.count("*").alias("pages")).filter(F.col("pages") >= least).select("doc_id", "line")


def _body(text: Column, headers: Column) -> Column:
    """A section's lines without markers and page numbers, and without the repeated headers that it begins with."""
    numbered = lambda x: F.when(may_begin(x, "p"), plain(x).rlike(K.PAGE_NUMBER_LINE)).otherwise(F.lit(False))
    kept = F.filter(_lines(text), lambda x: ~folded_like(x, K.NOTES_MARKER, begins=True) & ~numbered(x))

    def from_first(lines: Column) -> Column:
        first = F.array_position(F.transform(lines, lambda x: F.array_contains(headers, x)), False)
        return F.when(first > 0, F.array_join(F.slice(lines, first.cast("int"), F.size(lines)), "\n")).otherwise("")

    return let(kept, from_first)


def note_sections(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """OP-40 and OP-74: doc_id, number, title, page, section_order, section: what stands under each heading, page by page.

    headings: as of ``note_headings``.  A section ends where the next begins.  The last one ends on the last page with the marker, or of the document if
    headings come after that; at an appendix; and at the tail, whichever is first.  Sections without text have no row.
    """
    texts = pages.select("doc_id", F.col("page").cast("int"), F.coalesce("text", F.lit("")).alias("text"))
    # texts are read twice: for what each page says of its document, which is kept, and for the sections
    facts = checkpointed(texts.select("doc_id", "page", folded_like(F.col("text"), K.NOTES_MARKER).alias("marked"), _heads(F.col("text")).alias("heads")))
    ends = facts.groupBy("doc_id").agg(F.max("page").alias("last"), F.max(F.when(F.col("marked"), F.col("page"))).alias("marked"))
    headers = _repeated(facts).groupBy("doc_id").agg(F.collect_set("line").alias("headers"))
    known = _met(_met(headings.select("doc_id", "headings", "tail"), ends, "doc_id"), headers, "doc_id", "left")

    def span(h: Column, k: Column) -> Column:
        follows = F.try_element_at("headings", k + 2)
        final = F.when(F.coalesce(F.col("marked") < h["page"], F.lit(True)), F.col("last")).otherwise(F.col("marked"))
        final = F.coalesce(follows["page"], F.least(final, "tail.page"))
        return F.struct(h["number"].alias("number"), h["title"].alias("title"), h["page"].alias("page"), h["end"].alias("end"), follows.alias("next"), F.greatest(final, h["page"]).alias("final"))

    spans = known.select("doc_id", "tail", "headers", F.transform("headings", span).alias("spans"))
    # texts move once, by document: each page takes the notes that stand on it, and windows over notes stand on the same shuffle
    here = F.filter("spans", lambda x: F.col("on").between(x["page"], x["final"]))
    rows = _met(texts.withColumnRenamed("page", "on"), spans, "doc_id").select("doc_id", "on", "text", "tail", "headers", F.inline(here))
    begin = F.when(F.col("on") == F.col("page"), F.col("end")).otherwise(F.lit(0))
    stop = F.when(F.col("on") == F.col("next.page"), F.col("next.start")).when(F.col("next").isNull() & (F.col("on") == F.col("tail.page")), F.col("tail.start")).otherwise(F.length("text"))
    # the character before tells whether a line begins here
    chunk = F.substr("text", F.greatest(F.col("begin"), F.lit(1)))
    appendix = F.greatest(F.col("begin") - 1, F.lit(0)) + F.length(F.split(F.col("chunk"), APPENDIX, 2)[0])
    last = F.col("next").isNull()
    rows = rows.withColumn("begin", begin).withColumn("stop", stop).withColumn("chunk", F.when(last, chunk)).withColumn("cut", F.when(last & F.col("chunk").rlike(APPENDIX), appendix))
    section = F.substr("text", F.col("begin") + 1, F.greatest(F.least("stop", "cut") - F.col("begin"), F.lit(0)))
    rows = rows.select("doc_id", "number", "title", F.col("on").alias("page"), "cut", section.alias("section"), F.coalesce("headers", F.array().cast("array<string>")).alias("headers"))
    # a last section does not go on behind the page with the appendix
    over = F.min(F.when(F.col("cut").isNotNull(), F.col("page"))).over(Window.partitionBy("doc_id", "number"))
    rows = rows.withColumn("over", over).filter("over is null or page <= over")
    # not by a filter, which would be moved down and make each body twice
    rows = rows.select("doc_id", "number", "title", "page", F.explode(F.filter(F.array(_body(F.col("section"), F.col("headers"))), lambda x: x != "")).alias("section"))
    order = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("page")) - 1
    return rows.select("doc_id", "number", "title", "page", order.alias("section_order"), "section")


def extracted_notes(sections: DataFrame) -> DataFrame:
    """OP-40: doc_id, number, title, topic, is_priority, start_page, end_page (from 1) and content of each note."""
    pages = F.array_sort(F.collect_list(F.struct("section_order", "section")))
    found = sections.groupBy("doc_id", "number", "title").agg((F.min("page") + 1).alias("start_page"), (F.max("page") + 1).alias("end_page"), F.array_join(F.transform(pages, lambda x: x["section"]), "\n\n").alias("content"))
    return found.withColumn("topic", topic(F.col("title"))).withColumn("is_priority", F.col("topic") != "other").select("doc_id", "number", "title", "topic", "is_priority", "start_page", "end_page", "content")


def note_fragments(documents: DataFrame, sections: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """OP-11: searchable fragments of notes: company_id, doc_id, number, page (from 1), fragment_order, heading, body.

    documents: doc_id, company_id; sections: as of ``note_sections``.  Sections of unknown documents give none.  ``known`` are fragments that exist: a fragment of
    the same document, note, page and order takes its heading and body from the sections, all others stay.
    """
    key = ["doc_id", "number", "page", "fragment_order"]
    made = sections.join(documents.select("doc_id", "company_id"), "doc_id").select("company_id", "doc_id", "number", (F.col("page") + 1).cast("int").alias("page"), F.col("section_order").alias("fragment_order"), F.col("title").alias("heading"), F.col("section").alias("body"))
    if known is None:
        return made
    return made.unionByName(known.select(made.columns).join(made.select(*key), key, "left_anti"))
