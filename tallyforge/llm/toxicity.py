"""Operator 10: toxicity by a Levenshtein automaton over a lexicon trie, with context windows.

The lexicon is learned from labelled documents: words that occur in toxic ones, in several different
surroundings (copies of one document share them), and hardly in others.  The best supported words are taken first;
each further round looks only at toxic documents that no taken word explains, so words that merely stand beside an insult
stay out.  A word's beginning (a stem) is a term only if no single word or longer stem accounts for most of its support, as
where many words share it; it is matched as it is.

The lexicon is a trie; the automaton accepts every word within an edit budget of a term (none under 5
letters, else 1; two letters that changed places are one edit) and is run over both at once, so a misspelled term is
found without listing spellings.  The same trie takes endings of up to 3 letters behind an exact term of 5 letters or
more, and counts such a word as misspelled.  The product automaton's states are built when first reached and
remembered.  Words near a term that clean training documents use are learned as innocent.

Each hit has a context window of ``WINDOW`` characters to either side: a hit inside quotation marks, or right
after words that speak of a word, counts as quoted, any other as abuse.  A document's numbers of exact,
misspelled and quoted hits fall into one of at most 48 cells; the score is the cell's smoothed share of toxic
documents in the training sample.

The labelled rows used for fitting are a sample of at most about ``train_rows`` (by hash of doc_id); scores
cover all documents, whole texts.

Defined results: null, empty and wordless texts have no hits and get the score of the empty cell; rows with a
null label or a null doc_id teach nothing; a doc_id labelled both ways counts once each way; without usable
labels every score is 0; each input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable
from .language_id import in_fold

WORD = re.compile(r"[^\W_]+")
WINDOW = 60
MIN_FUZZY = 5
#: Letters that may stand behind an exact term, and lengths of word beginnings that may be terms (stems).
ENDINGS, STEMS = 3, (4, 5, 6)
#: A word or stem that has this share of a shorter stem's support takes its place.
SPECIFIC = 0.8
#: Terms and innocent spellings that a model may hold; they are broadcast, and more are refused.
MAX_TERMS = 20_000
#: Words of a worker's memory; a full one starts anew.
MEMORY = 1_000_000
_OPEN, _CLOSE = "\"“«„‘‹", "\"”»“’›"
_REPORTED = re.compile(r"\b(the (word|term|slur|insult)|so-called)\W*$")


class FuzzyLexicon:
    """The product of a trie of terms and a Levenshtein automaton, determinised as it is walked.

    An entry that ends in a star matches every word that begins with it, and has no edit budget.  With ``swaps`` two
    neighbouring letters that changed places are one edit; up to ``endings`` letters may follow an exact term.
    """

    def __init__(self, terms: list[str], innocent: list[str] = (), swaps: bool = False, endings: int = 0) -> None:
        self.swaps, self.endings = swaps, endings
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.budget: list[int] = [0]  # the largest of the terms below a node
        self.stem: list[bool] = [False]
        for entry in terms:
            term, stem = entry.rstrip("*"), entry.endswith("*")
            # a stem stands for many words already and is matched as it is
            node, most = 0, int(len(term) >= MIN_FUZZY and not stem)
            self.budget[0] = max(self.budget[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.budget.append(0)
                    self.stem.append(False)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], most)
            self.term[node] = term
            self.stem[node] = stem
        self.innocent = set(innocent)
        self.states: dict[tuple[frozenset, frozenset], int] = {}
        self.items: list[tuple[frozenset, frozenset]] = []
        self.next: list[dict[str, int]] = []
        self.accepted: list[int] = []
        self.stemmed: list[bool] = []
        self.start = self._state({(0, 0)}, set())
        self.memory: dict[str, int] = {}

    def _state(self, items: set[tuple[int, int]], pending: set[tuple]) -> int:
        """The state of trie nodes with errors so far, skipped letters of terms included; -1 if none is left.

        pending: (node, errors, letter), half of a swap, which needs that letter next; and (letters,) behind an exact term.
        """
        reach, todo = dict[int, int](), list(items)
        while todo:
            node, errors = todo.pop()
            if errors <= self.budget[node] and errors < reach.get(node, 9):
                reach[node] = errors
                todo += [(child, errors + 1) for child in self.children[node].values()]
        if not reach and not pending:
            return -1
        key = (frozenset(reach.items()), frozenset(pending))
        if key not in self.states:
            self.states[key] = len(self.items)
            self.items.append(key)
            self.next.append({})
            ends = [e for n, e in reach.items() if self.term[n] is not None and e <= self._most(n)]
            self.stemmed.append(any(self.stem[n] and e == 0 for n, e in reach.items()))
            self.accepted.append(min(ends) + 1 if ends else 2 if any(len(p) == 1 for p in pending) else 0)
        return self.states[key]

    def _most(self, node: int) -> int:
        """Edits of the term that ends at a node."""
        return int(len(self.term[node]) >= MIN_FUZZY and not self.stem[node])

    def _step(self, state: int, c: str) -> int:
        items, later = set(), set()
        for node, errors in self.items[state][0]:
            for letter, child in self.children[node].items():
                items.add((child, errors + (letter != c)))
                after = self.children[child].get(c) if self.swaps and letter != c else None
                if after is not None and errors < self.budget[after]:
                    later.add((after, errors + 1, letter))
            items.add((node, errors + 1))
            if self.endings and errors == 0 and self.term[node] is not None and self._most(node):
                later.add((1,))
        for p in self.items[state][1]:
            if len(p) == 1:
                if p[0] < self.endings:
                    later.add((p[0] + 1,))
            elif p[2] == c:
                items.add(p[:2])
        self.next[state][c] = found = self._state(items, later)
        return found

    def match(self, word: str) -> int:
        """0: no term; 1: a term; 2: within the edit budget of one."""
        found = self.memory.get(word)
        if found is None:
            state, following = self.start, self.next
            for c in word:
                step = following[state].get(c)
                state = self._step(state, c) if step is None else step
                if state < 0 or self.stemmed[state]:
                    break
            found = self.accepted[state] if state >= 0 else 0
            if found == 2 and word in self.innocent:
                found = 0
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[word] = found
        return found


def _quoted(text: str, a: int, b: int) -> bool:
    """Is text[a:b] (of lower-cased text) inside quotation marks, or spoken of as a word, judging by its context window?"""
    before, after = text[max(0, a - WINDOW) : a].rsplit("\n", 1)[-1], text[b : b + WINDOW].split("\n", 1)[0]
    if _REPORTED.search(before):
        return True
    for o, c in zip(_OPEN, _CLOSE, strict=True):
        left = before.count(o) % 2 == 1 if o == c else before.rfind(o) > before.rfind(c)
        if left and c in after:
            return True
    return False


def hits(text: str | None, lexicon: FuzzyLexicon) -> tuple[int, int, int, list[str]]:
    """Exact, misspelled and quoted hits of a whole text, and the misspelled words."""
    exact = fuzzy = quoted = 0
    near: list[str] = []
    if not text:
        return 0, 0, 0, near
    low = text.lower()
    match = lexicon.match
    found = {w: m for w in set(WORD.findall(low)) if (m := match(w))}
    if found:
        for m in WORD.finditer(low):
            kind = found.get(m.group())
            if kind:
                if kind == 2:
                    near.append(m.group())
                # lower-casing may change lengths, so the window is taken from the lower-cased text
                if _quoted(low, *m.span()):
                    quoted += 1
                elif kind == 1:
                    exact += 1
                else:
                    fuzzy += 1
    return exact, fuzzy, quoted, near


def _cell(exact: int, fuzzy: int, quoted: int) -> int:
    return min(exact, 3) * 12 + min(fuzzy, 3) * 3 + min(quoted, 2)


def _sample(docs: DataFrame, labels: DataFrame, train_rows: int) -> DataFrame:
    """text and toxic of the labelled training rows, about ``train_rows`` of them at most."""
    known = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long"), (F.col("toxic") > 0).alias("toxic")).distinct()
    known = known.filter(~in_fold(F.col("doc_id")))
    share = min(1.0, train_rows / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    # the sample is bounded by train_rows, so it may be broadcast
    return docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def _forms(words: set[str]) -> set[str]:
    """The words, and their stems, marked by a star."""
    return words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k}


def _specific(support: dict[str, int]) -> dict[str, int]:
    """Without the stems that one longer stem or word stands for."""
    best: dict[str, int] = {}
    for w, n in support.items():
        for k in STEMS:
            if len(w.rstrip("*")) > k:
                best[w[:k] + "*"] = max(best.get(w[:k] + "*", 0), n)
    return {w: n for w, n in support.items() if best.get(w, 0) < SPECIFIC * n}


def _word_counts(sample: DataFrame) -> tuple[DataFrame, DataFrame]:
    """word, clean (documents); and word, doc, before, after for toxic documents, one row for each surrounding."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(_forms(set(WORD.findall((text or "").lower()))))
            if len(total) > MEMORY:
                yield pa.RecordBatch.from_pydict({"word": list(total), "clean": list(total.values())})
                total.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(total), pa.string()), "clean": pa.array(list(total.values()), pa.int64())})

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                low = (text or "").lower()
                words = ["", *WORD.findall(low), ""]
                doc = int.from_bytes(hashlib.blake2b(low.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
                near = [zlib.crc32(w.encode("utf-8", "replace")) for w in words]
                rows = list({(form, near[i - 1], near[i + 1]) for i in range(1, len(words) - 1) for form in _forms({words[i]})})
                columns = [pa.array([r[k] for r in rows], t) for k, t in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))]
                yield pa.RecordBatch.from_arrays([columns[0], pa.array([doc] * len(rows), pa.int64()), *columns[1:]], ["word", "doc", "before", "after"])

    toxic = sample.filter("toxic").select("text").mapInArrow(around, "word string, doc long, before long, after long").distinct()
    counted = sample.filter("not toxic").select("text").mapInArrow(clean, "word string, clean long").groupBy("word").agg(F.sum("clean").alias("clean"))
    return counted, toxic


def _bounded(words: DataFrame) -> list:
    found = words.limit(MAX_TERMS + 1).collect()
    if len(found) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} words in a model")
    return found


def learn_lexicon(sample: DataFrame, precision: float = 0.95, chance: float = 0.1) -> list[str]:
    """Terms, and stems ending in a star, from a training sample (text, toxic).

    A term needs so many different words before it, and after it, in toxic documents that fewer than ``chance`` words of the
    vocabulary would have them by accident, given the share of toxic documents.  A round takes the terms with at least half
    the support of the best one, and leaves out the documents that hold one of them.
    """
    rows = sample.count()
    clean, rest = (durable(x, "toxicity-words") for x in _word_counts(sample))
    vocabulary = max(2, rest.agg(F.approx_count_distinct("word")).first()[0])
    found: set[str] = set()
    while documents := rest.select("doc").distinct().count():
        share = min(0.9, documents / rows)
        least = max(5, math.ceil(math.log(vocabulary / chance) / -math.log(share)))
        support = rest.groupBy("word").agg(F.least(F.countDistinct("before"), F.countDistinct("after")).alias("n"), F.countDistinct("doc").alias("d")).filter((F.col("n") >= least) & (F.col("d") >= least))
        rated = support.join(clean, "word", "left").withColumn("clean", F.coalesce("clean", F.lit(0)))
        good = _bounded(rated.filter((F.col("n") >= F.lit(precision) * (F.col("n") + F.col("clean"))) & (F.length("word") >= 3)).select("word", "n"))
        if not good:
            break
        good = _specific({r["word"]: r["n"] for r in good})
        taken = [w for w, n in good.items() if 2 * n >= max(good.values())]
        found.update(taken)
        known = sample.sparkSession.createDataFrame([(w,) for w in taken], "word string")  # MAX_TERMS rows at most
        explained = rest.join(F.broadcast(known), "word", "left_semi").select("doc").distinct()
        rest = durable(rest.join(explained, "doc", "left_anti"), "toxicity-rest")
    if len(found) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} words in a model")
    return sorted(found)


def _lexicon(terms: list[str], innocent: list[str] = ()) -> FuzzyLexicon:
    return FuzzyLexicon(terms, innocent, swaps=True, endings=ENDINGS)


def toxicity_scores(docs: DataFrame, labels: DataFrame, train_rows: int = 30_000, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text, ...)."""
    spark = docs.sparkSession
    sample = durable(_sample(docs, labels, train_rows), "toxicity-sample")
    terms = spark.sparkContext.broadcast(learn_lexicon(sample))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(terms.value)
        for batch in batches:
            found = [hits(x, lexicon) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array([f[i] for f in found], pa.int32()) for i in range(3)), pa.array([f[3] for f in found], pa.list_(pa.string()))], ["toxic", "exact", "fuzzy", "quoted", "near"])

    measured = durable(sample.mapInArrow(measure, "toxic boolean, exact int, fuzzy int, quoted int, near array<string>"), "toxicity-measured")
    spelled = measured.select("toxic", F.explode(F.array_distinct("near")).alias("word")).groupBy("word").agg(F.count_if("toxic").alias("t"), F.count_if(~F.col("toxic")).alias("c"))
    innocent = sorted(r["word"] for r in _bounded(spelled.filter("c > t").select("word")))
    kept = measured.withColumn("fuzzy", F.least("fuzzy", F.size(F.array_except("near", F.lit(innocent) if innocent else F.array().cast("array<string>")))))
    cell = F.least("exact", F.lit(3)) * 12 + F.least("fuzzy", F.lit(3)) * 3 + F.least("quoted", F.lit(2))
    cells = {r["cell"]: (r["t"], r["n"]) for r in kept.groupBy(cell.alias("cell")).agg(F.count_if("toxic").alias("t"), F.count("*").alias("n")).collect()}
    rows, positive = sum(n for _, n in cells.values()), sum(t for t, _ in cells.values())

    def expected(c: int) -> float:
        """Before any count of a cell: abuse is likely toxic, misspelled abuse rather so, quotation is not."""
        exact, fuzzy, quoted = c // 12, c // 3 % 4, c % 3
        base = positive / rows if rows else 0.0
        return 0.9 if exact else 0.5 + 0.1 * fuzzy if fuzzy else max(base, 0.2) if quoted else base

    scores = [0.0 if not positive else (cells.get(c, (0, 0))[0] + 2 * expected(c)) / (cells.get(c, (0, 0))[1] + 2) for c in range(48)]
    model = spark.sparkContext.broadcast((terms.value, innocent, scores))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_terms, own_innocent, own_scores = model.value
        lexicon = _lexicon(own_terms, own_innocent)
        for batch in batches:
            found = [own_scores[_cell(*hits(x.as_py(), lexicon)[:3])] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    rated = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(rate, "doc_id long, score double")
    return rated.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
