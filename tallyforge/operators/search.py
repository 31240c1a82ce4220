"""Full-text search over fragments by a posting table (term, fragment, position, weight class).

The posting table is what a search reads: a query joins its few terms, so only their postings move.  Write
it partitioned or bucketed by term to keep it that way.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.text import fold, may_squash_to, squash
from tallyforge.operators.records import page
from tallyforge.sources.shared import checkpointed


#: Positions of body words begin here, so no phrase runs from a heading into a body.
BODY = 1 << 24


def postings(fragments: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """OP-11, OP-88 and ST-4: term, fragment_id, pos, part (A heading, B body) of (fragment_id, heading, body).

    With ``terms`` only their postings are made, before anything is exploded: for a search without a stored table.
    """
    words = lambda c: F.filter(F.split(F.regexp_replace(fold(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    placed = lambda c: F.transform(words(c), lambda w, i: F.struct(i.alias("pos"), w.alias("term")))
    wanted = (lambda c: placed(c)) if terms is None else (lambda c: F.filter(placed(c), lambda x: x["term"].isin(*terms)))
    part = lambda c, name, offset: fragments.select("fragment_id", F.explode(wanted(c)).alias("x")).select("x.term", "fragment_id", (F.col("x.pos") + offset).alias("pos"), F.lit(name).alias("part"))
    return part("heading", "A", 0).unionByName(part("body", "B", BODY))


def parse_query(text: str) -> list[dict]:
    """Web-style query: alternatives (or) of required words and phrases, and excluded ones (-word)."""
    plain = lambda t: re.findall(r"[a-z0-9]+", t)
    groups: list[dict] = [{"must": [], "not": []}]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text.lower()):
        if not minus and word == "or":
            groups.append({"must": [], "not": []})
            continue
        terms = plain(phrase or word)
        if terms:
            groups[-1]["not" if minus else "must"].append(terms)
    return [g for g in groups if g["must"]]


def query_terms(text: str) -> list[str]:
    """All words that a query names."""
    return sorted({t for g in parse_query(text) for kind in ("must", "not") for terms in g[kind] for t in terms})


def _holders(table: DataFrame, terms: list[str]) -> DataFrame:
    """Fragments that hold a word, or a phrase at successive positions."""
    found = table.filter(F.col("term") == terms[0]).select("fragment_id", F.col("pos").alias("at"))
    for k, term in enumerate(terms[1:], 1):
        found = found.join(table.filter(F.col("term") == term).select("fragment_id", (F.col("pos") - k).alias("at")), ["fragment_id", "at"], "left_semi")
    return found.select("fragment_id").distinct()


def search_terms(table: DataFrame, query: str) -> DataFrame:
    """fragment_id and tf-weighted score (heading words count four times) of fragments that match."""
    groups = parse_query(query)
    if not groups:
        return table.select("fragment_id", F.lit(0.0).alias("score")).limit(0)
    matched = None
    for g in groups:
        own = _holders(table, g["must"][0])
        for terms in g["must"][1:]:
            own = own.join(_holders(table, terms), "fragment_id", "left_semi")
        for terms in g["not"]:
            own = own.join(_holders(table, terms), "fragment_id", "left_anti")
        matched = own if matched is None else matched.union(own)
    words = sorted({t for g in groups for terms in g["must"] for t in terms})
    weight = F.when(F.col("part") == "A", 4.0).otherwise(1.0)
    scored = table.filter(F.col("term").isin(words)).join(matched.distinct(), "fragment_id", "left_semi")
    return scored.groupBy("fragment_id").agg(F.sum(weight).alias("score"))


def search_ranked(table: DataFrame, query: str) -> DataFrame:
    """Cover-density rank (Clarke, Cormack and Tudhope) of fragments that match: fragment_id, rank.

    A cover is a shortest stretch that holds every required word.  For each posting, the last place of every
    word so far gives the stretch that ends there; it is a cover if it starts later than the one before.  A
    cover of length l adds 1 / max(1, l / words) * its mean weight.
    """
    groups = parse_query(query)
    words = sorted({t for g in groups for terms in g["must"] for t in terms})
    if not words:
        return table.select("fragment_id", F.lit(0.0).alias("rank")).limit(0)
    matched = search_terms(table, query).select("fragment_id")
    rows = table.filter(F.col("term").isin(words)).join(matched, "fragment_id", "left_semi")
    w = Window.partitionBy("fragment_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select("fragment_id", "pos", "part", *(F.max(F.when(F.col("term") == t, F.col("pos"))).over(w).alias(f"p{i}") for i, t in enumerate(words)))
    present = [F.col(f"p{i}") for i in range(len(words))]
    # of alternatives, the words that have occurred count; least() skips nulls
    start = F.least(*present) if len(words) > 1 else present[0]
    complete = F.lit(True)
    if len(groups) == 1:
        for p in present:
            complete = complete & p.isNotNull()
    covers = rows.filter(complete).withColumn("from", start).withColumn("prior", F.lag("from").over(Window.partitionBy("fragment_id").orderBy("pos"))).filter("prior is null or `from` > prior")
    size = (F.col("pos") - F.col("from") + 1) / len(words)
    value = F.when(F.col("part") == "A", 1.0).otherwise(0.4) / F.greatest(F.lit(1.0), size)
    return covers.groupBy("fragment_id").agg(F.round(F.sum(value), 6).alias("rank"))


def search_page(fragments: DataFrame, query: str, number: int = 1, size: int = 20, **filters: object) -> DataFrame:
    """OP-88: one page of the fragments that match the words of a query or hold it literally, with the total.

    fragments: fragment_id, heading, body, name, is_priority, note_number, and the columns that ``filters`` name (company,
    topic, fiscal_year; None: any).  Order: rank, priority, name, note, fragment.  Filters come first, so only what is left
    is searched; a fragment that only holds the text literally has rank 0.
    """
    kept = fragments
    for column, value in filters.items():
        if value is not None:
            kept = kept.filter(F.col(column) == F.lit(value))
    text = " ".join(query.split())
    table = checkpointed(postings(kept.select("fragment_id", "heading", "body"), query_terms(text) or [""]))
    literal = F.contains(F.lower("heading"), F.lit(text.lower())) | F.contains(F.lower("body"), F.lit(text.lower()))
    found = kept.join(search_ranked(table, text), "fragment_id", "left").filter(F.col("rank").isNotNull() | F.coalesce(literal, F.lit(False)))
    found = found.withColumn("rank", F.coalesce("rank", F.lit(0.0))).select("fragment_id", "name", "is_priority", "note_number", "rank")
    order = [F.desc("rank"), F.desc("is_priority"), F.col("name"), F.col("note_number"), F.col("fragment_id")]
    return page(found, order, number, size)


def headline(fragments: DataFrame, words: list[str], least: int = 12, most: int = 38, pieces: int = 2) -> DataFrame:
    """OP-88b: up to ``pieces`` extracts around hits, joined by an ellipsis: fragment_id, headline.

    An extract has ``most`` words at most, and ends at the first end of a sentence behind ``least`` words.
    """
    tokens = F.filter(F.split(F.regexp_replace(F.regexp_replace("body", "<[^>]*>", " "), r"\s+", " "), " "), lambda x: x != "")
    # bound by explodes: a filter would be moved down and make both again
    rows = fragments.select("fragment_id", F.explode(F.array(tokens)).alias("w"))
    wanted = lambda x: F.when(may_squash_to(x, words), squash(x).isin(*words)).otherwise(F.lit(False))
    hits = F.filter(F.transform("w", lambda x, i: F.when(wanted(x), i)), lambda i: i.isNotNull())
    rows = rows.select("fragment_id", "w", F.explode(F.filter(F.array(hits), lambda h: F.size(h) > 0)).alias("hits"))
    # a hit that the extract before cannot reach begins the next one
    spots = F.aggregate("hits", F.slice("hits", 1, 0), lambda acc, i: F.when((F.size(acc) < pieces) & ((F.size(acc) == 0) | (i >= F.element_at(acc, F.greatest(F.size(acc), F.lit(1))) + most)), F.concat(acc, F.array(i))).otherwise(acc))
    rows = rows.withColumn("spots", spots)

    def cut(i: Column) -> Column:
        own = F.slice("w", F.greatest(F.lit(1), i + 1 - least // 4), most)
        ends = F.filter(F.transform(own, lambda x, k: F.when((k + 1 >= least) & x.rlike(r"[.!?]$"), k + 1)), lambda k: k.isNotNull())
        return F.array_join(F.slice(own, F.lit(1), F.coalesce(F.get(ends, F.lit(0)), F.lit(most))), " ")

    return rows.select("fragment_id", F.array_join(F.transform("spots", cut), " … ").alias("headline"))
