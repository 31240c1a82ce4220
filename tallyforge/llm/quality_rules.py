"""Operator 4: quality rules by weak supervision, in DataFrame functions only.

Each rule votes to keep or to reject a document, or abstains.  Rules are noisy voters on one hidden
class; expectation-maximisation over the counts of all vote patterns of the corpus estimates how often
each rule's votes are right, and the posterior probability of "good" replaces the rule that a document
must pass every filter.  A document on which no rule votes stays at one half, and is kept.

The only thing gathered is the histogram of vote patterns: 2^rules rows at most, whatever the input.
The estimation is a fold over that one row, in SQL expressions, and the fitted table joins back by
pattern.

Base counts (words are ``[^\\x20\\x09-\\x0D]+``): n_words; word_chars, code points inside words;
n_symbols, characters of ``[#*$%&|<>]``; n_dup_lines, lines (split at \\n) that hold a word and equal an
earlier line; n_repeat_words, words inside 3-word windows that the text has twice or more, the first
included.  ``base_failed``: under 50 words, or more than half of them repeated.

Defined results: a null text has no words and fails the base; an empty table gives an empty result;
each input row gives one output row, repeated rows included; a null doc_id stays null; other columns
of the input are ignored.  Equal windows are found by 64-bit hash inside one text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import durable

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
ITERATIONS = 15
#: How the estimation starts: the chance that a vote to reject, or to keep, is right.
START_REJECT, START_KEEP = 0.9, 0.6
#: No rule is believed less or more than this.
LEAST, MOST = 0.55, 0.95

_SPACE = r"[\x20\x09-\x0D]+"

#: name, vote (0 reject, 1 keep) and when the rule votes; else it abstains.  SQL over the base counts, in whole-number arithmetic.
RULES = (
    ("repetition", 0, "10 * n_repeat_words > 3 * n_words"),
    ("symbols", 0, "10 * n_symbols > 2 * n_words"),
    ("duplicate_lines", 0, "2 * n_dup_lines > n_lines"),
    ("word_length", 0, "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    ("capitals", 0, "2 * n_upper > n_letters"),
    ("exclamation", 0, "10 * n_bangs > 3 * n_words"),
    ("plain", 1, "50 * n_symbols <= n_words and 50 * n_bangs <= n_words and 5 * n_upper <= n_letters and n_dup_lines = 0"),
    ("varied", 1, "n_words >= 50 and 10 * n_repeat_words <= n_words and 20 * n_symbols <= n_words and 20 * n_bangs <= n_words"),
)


def base_counts(docs: DataFrame) -> DataFrame:
    """The counts that rules look at, one row for each input row; no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, _SPACE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # lambda variables bind each array once: an outer expression would be evaluated anew for each element
    first = docs.select(F.col("doc_id").cast("long"), F.struct(text.alias("text"), words.alias("w"), lines.alias("l")).alias("s"))
    first = first.select("doc_id", F.explode(F.array("s")).alias("s")).select("doc_id", "s.*")
    n = F.size("w")
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    threes = F.zip_with(pairs, F.slice("w", F.lit(3), F.greatest(n - 2, F.lit(0))), lambda h, c: F.xxhash64(h, c))
    threes = F.transform(F.slice(threes, F.lit(1), F.greatest(n - 2, F.lit(0))), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    ordered = F.array_sort(threes)
    again = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.greatest(n - 3, F.lit(0))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = F.array_sort(F.array_distinct(F.flatten(F.filter(again, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        at,
        F.struct(F.lit(0).alias("n"), F.lit(-9).alias("last")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        lambda s: s["n"],
    )
    long = lambda c: c.cast("long")
    return first.select(
        "doc_id",
        long(n).alias("n_words"),
        long(F.length(F.regexp_replace("text", _SPACE, ""))).alias("word_chars"),
        long(F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", ""))).alias("n_symbols"),
        long(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        long(covered).alias("n_repeat_words"),
        long(F.size("l")).alias("n_lines"),
        long(F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))).alias("n_upper"),
        long(F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))).alias("n_letters"),
        long(F.length(F.regexp_replace("text", r"[^!]+", ""))).alias("n_bangs"),
    )


def votes(counts: DataFrame) -> DataFrame:
    """``pattern``: one digit a rule, 1 if it votes."""
    return counts.withColumn("pattern", F.expr("concat(" + ", ".join(f"if({when}, '1', '0')" for _, _, when in RULES) + ")"))


def fit(patterns: DataFrame) -> DataFrame:
    """``pattern`` and ``posterior`` (of a good document), from patterns (pattern, n) of the whole corpus.

    ``patterns`` has 2^rules rows at most; they meet in one row, in which the estimation is a fold: each
    round gives every pattern the posterior under the accuracies so far (both classes equally likely
    before any vote), and each rule the share of its votes that agree with the posterior.
    """
    start = "array(" + ", ".join(f"{START_KEEP if vote else START_REJECT}D" for _, vote, _ in RULES) + ")"

    def posterior(accuracy: str) -> str:
        terms = (f"{'-' if vote else ''}x.v[{j}] * ln({accuracy}[{j}] / (1D - {accuracy}[{j}]))" for j, (_, vote, _) in enumerate(RULES))
        return f"1D / (1D + exp({' + '.join(terms)}))"

    def agreed(j: int, vote: int) -> str:
        right = "x.q" if vote else "(1D - x.q)"
        share = f"(aggregate(e, 0D, (s, x) -> s + x.n * x.v[{j}] * {right}) + 1D) / (aggregate(e, 0D, (s, x) -> s + x.n * x.v[{j}]) + 2D)"
        return f"greatest({LEAST}D, least({MOST}D, {share}))"

    voted = "array(" + ", ".join(f"int(substr(pattern, {j + 1}, 1))" for j in range(len(RULES))) + ")"
    rows = patterns.groupBy().agg(F.expr(f"array_sort(collect_list(named_struct('pattern', pattern, 'n', double(n), 'v', {voted})))").alias("d"))
    # the inner aggregate over one element binds the weighed patterns once for all rules
    weighed = f"transform(d, x -> named_struct('n', x.n, 'v', x.v, 'q', {posterior('a')}))"
    step = f"aggregate(array({weighed}), a, (o, e) -> array({', '.join(agreed(j, vote) for j, (_, vote, _) in enumerate(RULES))}))"
    model = rows.filter("size(d) > 0").select("d", F.expr(f"aggregate(sequence(1, {ITERATIONS}), {start}, (a, t) -> {step})").alias("a"))
    return model.select(F.explode("d").alias("x"), "a").select("x.pattern", F.expr(posterior("a")).alias("posterior"))


def quality_scores(docs: DataFrame, at_least: float = 0.5) -> DataFrame:
    """Base counts, ``base_failed``, ``posterior`` and ``kept`` of each row of ``docs`` (doc_id, text, ...)."""
    voted = durable(votes(base_counts(docs)), "quality-votes")
    fitted = durable(fit(voted.groupBy("pattern").agg(F.count("*").alias("n"))), "quality-model")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    # 2^rules rows at most
    scored = voted.join(F.broadcast(fitted), "pattern").withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= at_least))
