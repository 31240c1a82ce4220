"""Matching of notes between two years: exact titles, similar titles, one-to-one choice, roll-ups."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tallyforge.functions.constants import TITLE_ALIASES, TITLE_STOP_WORDS
from tallyforge.functions.text import words_key
from tallyforge.sources.shared import checkpointed

GROUP = ["company", "scope"]


def title_tokens(title: Column | str) -> Column:
    """Distinct meaningful words of a folded title, with aliases resolved."""
    words = F.filter(F.split(words_key(title), " "), lambda w: (F.length(w) >= 3) & ~w.isin(*TITLE_STOP_WORDS))
    aliases = F.create_map(*[F.lit(x) for pair in TITLE_ALIASES.items() for x in pair])
    tokens = F.array_distinct(F.transform(words, lambda w: F.coalesce(F.try_element_at(aliases, w), w)))
    return F.when(F.array_contains(tokens, "ventas"), F.array_remove(tokens, "actividad")).otherwise(tokens)


def match_exact(current: DataFrame, previous: DataFrame) -> DataFrame:
    """OP-43: the k-th note of a title pairs with the k-th of the other year (company, scope, note_number, title)."""
    key = words_key("title")
    number = lambda df, n: df.select(*GROUP, key.alias("key"), F.col("note_number").alias(n), F.row_number().over(Window.partitionBy(*GROUP, key).orderBy("note_number")).alias("k"))
    return number(current, "current_number").join(number(previous, "previous_number"), [*GROUP, "key", "k"]).select(*GROUP, "current_number", "previous_number")


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of two folded titles: the one part that no column expression gives."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_pairs(current: DataFrame, previous: DataFrame, least: float = 0.48) -> DataFrame:
    """OP-89: scored pairs of one company and scope: company, scope, current_number, previous_number, score.

    A score of ``least`` needs some common word, so pairs meet on (company, scope, word), not all with all; the
    sequence term is computed for pairs whose word overlap leaves them a chance.  Notes without any meaningful
    word can only reach ``least`` by an equal title, which is matched before.
    """
    side = lambda df, p: df.select(*GROUP, F.col("note_number").alias(f"{p}_number"), words_key("title").alias(f"{p}_key"), title_tokens("title").alias(f"{p}_tokens"), F.col("topic").alias(f"{p}_topic"))
    c, p = side(current, "current"), side(previous, "previous")
    shared = c.select(*GROUP, "current_number", F.explode("current_tokens").alias("token")).join(p.select(*GROUP, "previous_number", F.explode("previous_tokens").alias("token")), [*GROUP, "token"]).groupBy(*GROUP, "current_number", "previous_number").agg(F.count("*").alias("common"), F.bool_or(F.col("token") == "posterior").alias("posterior"))
    pairs = shared.join(c, [*GROUP, "current_number"]).join(p, [*GROUP, "previous_number"])
    jaccard = F.col("common") / (F.size("current_tokens") + F.size("previous_tokens") - F.col("common"))
    pairs = pairs.withColumn("jaccard", jaccard).filter((F.col("jaccard") >= (least - 0.2 - 0.08) / 0.8) | F.col("posterior"))
    base = F.when(F.col("current_key") == F.col("previous_key"), F.lit(1.0)).otherwise(F.col("jaccard") * 0.8 + _sequence_ratio("current_key", "previous_key") * 0.2)
    base = F.bround(F.least(F.lit(1.0), F.when(F.col("posterior"), F.greatest(base, F.lit(0.85))).otherwise(base)), 4)
    boost = F.when(F.col("current_number") == F.col("previous_number"), 0.05).otherwise(0.0) + F.when(F.col("current_topic") == F.col("previous_topic"), 0.03).otherwise(0.0)
    scored = pairs.withColumn("score", F.least(F.lit(1.0), base + boost)).filter(F.col("score") >= least)
    return scored.select(*GROUP, "current_number", "previous_number", F.bround("score", 4).alias("score"))


def _tied_blocks(top: DataFrame) -> DataFrame:
    """Pairs inside blocks of ``top`` where every current note ties with every previous one, and none has a best pair outside.

    Notes with the same ties (a hash of their set) are twins.  A note whose ties are all twins of each other, and as many as its
    ties' own twins, is in such a block; there one-by-one choice takes the k-th of one side with the k-th of the other.
    """

    def twins(own: str, other: str, p: str) -> DataFrame:
        sides = top.groupBy(*GROUP, own, "score").agg(F.count("*").alias(f"ties_{p}"), F.first(f"best_{p}").alias(f"best_{p}"), F.bit_xor(F.xxhash64(other)).alias("ties"))
        same = Window.partitionBy(*GROUP, "score", "ties", f"ties_{p}")
        numbered = sides.withColumn(f"twins_{p}", F.count("*").over(same)).withColumn(f"k_{p}", F.row_number().over(same.orderBy(own)))
        return numbered.filter(F.col(f"ties_{p}") == F.col(f"best_{p}")).select(*GROUP, own, f"ties_{p}", f"twins_{p}", f"k_{p}")

    pairs = top.select(*GROUP, "current_number", "previous_number", "score")
    both = pairs.join(twins("current_number", "previous_number", "c"), [*GROUP, "current_number"]).join(twins("previous_number", "current_number", "p"), [*GROUP, "previous_number"])
    return both.filter("twins_c = ties_p and twins_p = ties_c and k_c = k_p").select(*pairs.columns)


PAIR = [*GROUP, "current_number", "previous_number", "score"]
#: Pairs of a group, or of one of its components, that one task chooses from.
IN_TASK = 200_000


def _one_by_one(pairs: DataFrame, *within: str) -> DataFrame:
    """The choice inside each group or component (``within``): pairs by falling score, then lower numbers, each if both its ends are free.

    Groups lie one behind the other in sorted partitions and are read in one go, as most of them have a few pairs only.
    """

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, current, previous = None, set(), set()
        for rows in batches:
            kept = []
            for i, (of, c, p) in enumerate(zip(zip(*(rows[k] for k in within), strict=True), rows["current_number"], rows["previous_number"], strict=True)):
                if of != now:
                    now, current, previous = of, set(), set()
                if c not in current and p not in previous:
                    current.add(c)
                    previous.add(p)
                    kept.append(i)
            yield rows.iloc[kept][PAIR]

    ordered = pairs.select(*PAIR, *(k for k in within if k not in PAIR)).repartition(*within).sortWithinPartitions(*within, F.desc("score"), "current_number", "previous_number")
    return ordered.mapInPandas(choose, pairs.select(*PAIR).schema)


def _components(pairs: DataFrame) -> DataFrame:
    """pairs with ``component``: the smallest current number that is connected with a pair, in its group.

    Labels go over from one side to the other, and each label's own label is taken, until nothing changes.
    """
    ends = pairs.select(*GROUP, "current_number", "previous_number")
    labels = checkpointed(ends.groupBy(*GROUP, "current_number").agg(F.min("current_number").alias("component")))
    while True:
        over = ends.join(labels, [*GROUP, "current_number"]).groupBy(*GROUP, "previous_number").agg(F.min("component").alias("component"))
        back = ends.join(over, [*GROUP, "previous_number"]).groupBy(*GROUP, "current_number").agg(F.min("component").alias("component"))
        of_label = back.select(*GROUP, F.col("current_number").alias("component"), F.col("component").alias("further"))
        found = checkpointed(back.join(of_label, [*GROUP, "component"]).select(*GROUP, "current_number", F.least("component", "further").alias("component")))
        if found.join(labels, [*GROUP, "current_number", "component"], "left_anti").isEmpty():
            return pairs.join(found, [*GROUP, "current_number"])
        labels = found


def _in_rounds(scored: DataFrame) -> DataFrame | None:
    """Each round takes every pair that is the best of both its ends, and whole blocks of tied pairs, and drops what those ends touched, until no pair is left."""
    c, p = Window.partitionBy(*GROUP, "current_number"), Window.partitionBy(*GROUP, "previous_number")
    best = lambda w, other, s: lambda df: df.withColumn(f"most_{s}", F.max("score").over(w)).withColumn(f"best_{s}", F.count_if(F.col("score") == F.col(f"most_{s}")).over(w)).withColumn(f"first_{s}", F.min(F.when(F.col("score") == F.col(f"most_{s}"), F.col(other))).over(w))
    left, taken = scored, None
    while True:
        top = checkpointed(left.transform(best(c, "previous_number", "c")).transform(best(p, "current_number", "p")).filter("score = most_c and score = most_p"))
        if top.isEmpty():
            break
        mutual = top.filter("first_c = previous_number and first_p = current_number").select(*PAIR)
        now = checkpointed(mutual.union(_tied_blocks(top).select(mutual.columns)).distinct())
        taken = now if taken is None else taken.unionByName(now)
        left = left.join(now.select(*GROUP, "current_number"), [*GROUP, "current_number"], "left_anti")
        left = checkpointed(left.join(now.select(*GROUP, "previous_number"), [*GROUP, "previous_number"], "left_anti"))
    return taken


def greedy_pairs(scored: DataFrame, in_task: int = IN_TASK) -> DataFrame:
    """OP-44: one-to-one pairs by falling score (ties: lower numbers first).

    A pair only bears on pairs it is connected with, so each group, and where a group has more than ``in_task`` pairs each of its connected
    components, is chosen from pair by pair in one task; what is larger still is chosen in rounds.  The order is total, so
    all three give what taking pairs one by one gives.  Rows with a null are ignored.
    """
    pairs = checkpointed(scored.select(*PAIR).dropna())
    counted = pairs.withColumn("n", F.count("*").over(Window.partitionBy(*GROUP)))
    taken = _one_by_one(counted.filter(F.col("n") <= in_task), *GROUP)
    large = counted.filter(F.col("n") > in_task).select(*PAIR)
    if large.isEmpty():
        return taken
    parts = checkpointed(_components(checkpointed(large)).withColumn("n", F.count("*").over(Window.partitionBy(*GROUP, "component"))))
    taken = taken.unionByName(_one_by_one(parts.filter(F.col("n") <= in_task), *GROUP, "component"))
    rest = _in_rounds(parts.filter(F.col("n") > in_task).select(*PAIR))
    return taken if rest is None else taken.unionByName(rest)


def match_notes(current: DataFrame, previous: DataFrame) -> DataFrame:
    """OP-43 and OP-44 together: every note of both years once, matched, current_only or previous_only."""
    current, previous = (checkpointed(notes.select(*GROUP, "note_number", "title", "topic")) for notes in (current, previous))
    exact = checkpointed(match_exact(current, previous)).withColumn("score", F.lit(1.0)).withColumn("method", F.lit("normalized_title"))
    rest_c = current.join(exact.select(*GROUP, F.col("current_number").alias("note_number")), [*GROUP, "note_number"], "left_anti")
    rest_p = previous.join(exact.select(*GROUP, F.col("previous_number").alias("note_number")), [*GROUP, "note_number"], "left_anti")
    near = greedy_pairs(similar_pairs(rest_c, rest_p)).withColumn("method", F.lit("similar_title"))
    pairs = checkpointed(exact.unionByName(near))  # three steps below read them
    only_c = current.select(*GROUP, F.col("note_number").alias("current_number")).join(pairs, [*GROUP, "current_number"], "left_anti")
    only_p = previous.select(*GROUP, F.col("note_number").alias("previous_number")).join(pairs, [*GROUP, "previous_number"], "left_anti")
    out = pairs.withColumn("status", F.lit("matched")).unionByName(only_c.withColumn("status", F.lit("current_only")), allowMissingColumns=True).unionByName(only_p.withColumn("status", F.lit("previous_only")), allowMissingColumns=True)
    band = F.when(F.col("status") != "matched", "low").when((F.col("method") == "normalized_title") | (F.col("score") >= 0.82), "high").when(F.col("score") >= 0.62, "medium").otherwise("low")
    return out.withColumn("confidence", band)


def coverage_rollup(pairs: DataFrame, notes: DataFrame) -> DataFrame:
    """OP-59: counts, status and confidence of each comparison.

    pairs: company, scope, current_number, previous_number, status; notes: company, scope, fiscal_year, note_number,
    observed (facts seen in it).  Coverage is the share of the current notes that are matched; evidence, the share of the
    matched ones with observed facts on both sides.
    """
    seen = lambda p: notes.select(*GROUP, F.col("note_number").alias(f"{p}_number"), F.col("fiscal_year").alias(f"{p}_year"), (F.col("observed") > 0).alias(f"{p}_seen"))
    matched = pairs.filter("status = 'matched'").select(*GROUP, "current_number", "previous_number")
    sure = matched.join(seen("current").filter("current_year = 2025"), [*GROUP, "current_number"]).join(seen("previous").filter("previous_year = 2024"), [*GROUP, "previous_number"]).filter("current_seen and previous_seen").groupBy(*GROUP).agg(F.count("*").alias("with_evidence"))
    n = pairs.groupBy(*GROUP).agg(F.count_if(F.col("status") == "matched").alias("matched"), F.count_if(F.col("status") == "current_only").alias("current_only"), F.count_if(F.col("status") == "previous_only").alias("previous_only"))
    n = n.join(sure, GROUP, "left").withColumn("with_evidence", F.coalesce("with_evidence", F.lit(0)))
    coverage = F.coalesce(F.col("matched") / F.nullif(F.col("matched") + F.col("current_only"), F.lit(0)), F.lit(0.0))
    evidence = F.coalesce(F.col("with_evidence") / F.nullif(F.col("matched"), F.lit(0)), F.lit(0.0))
    high, medium, some = (coverage >= 0.9) & (evidence >= 0.75), (coverage >= 0.65) & (evidence >= 0.5), F.col("matched") > 0
    status = F.when(high, "generated").when(medium | some, "partial").otherwise("insufficient_evidence")
    return n.withColumn("status", status).withColumn("confidence", F.when(high, "high").when(medium, "medium").otherwise("low"))


def comparison_view(pairs: DataFrame, current: DataFrame, previous: DataFrame, topic: str | None = None, priority_only: bool = False) -> DataFrame:
    """OP-81b: pairs with both notes as structs; a pair stays if either side has the topic, or priority."""
    side = lambda df, p: df.select(*GROUP, F.col("note_number").alias(f"{p}_number"), F.struct("title", "topic", "is_priority").alias(p))
    out = pairs.join(side(current, "current"), [*GROUP, "current_number"], "left").join(side(previous, "previous"), [*GROUP, "previous_number"], "left")
    either = lambda test: F.coalesce(test("current"), F.lit(False)) | F.coalesce(test("previous"), F.lit(False))
    if topic is not None:
        out = out.filter(either(lambda p: F.col(f"{p}.topic") == topic))
    return out.filter(either(lambda p: F.col(f"{p}.is_priority"))) if priority_only else out
