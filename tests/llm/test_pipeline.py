"""The pipeline against plain versions of its stages' rules on a small table, and each stage alone on odd input."""

import re

import pytest

import corpus_pipeline
from tallyforge.llm.jaccard_join import jaccard_components
from tallyforge.llm.language_id import identify_languages
from tallyforge.llm.quality_rules import quality_scores

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def windows(text, n=10):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs
    items = [windows(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, stage(spark, docs, SMALL)
        if k < 4:
            assert docs.columns == first.columns
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality_rules":
            assert kept == {r["doc_id"] for r in quality_scores(before).filter("kept").collect()} and 0 < len(kept) < first.count()
        if name == "language_id":
            rows = identify_languages(before).collect()
            taught = {x: sorted(r["score"] for r in rows if r["lang_pred"] == x and not r["held_out"]) for x in {r["lang_pred"] for r in rows} - {"und"}}
            assert kept == {r["doc_id"] for r in rows if r["lang_pred"] in taught and r["score"] >= taught[r["lang_pred"]][(len(taught[r["lang_pred"]]) - 1) // 2] * 0.1} and taught
        if name == "jaccard_join":
            groups = jaccard_components(before).collect()
            assert kept == {r["component_id"] for r in groups} and docs.count() == len(kept)
        if name == "decontaminate":
            clean = set()
            for r in before.collect():
                own = {n: windows(r["text"], n) for n in {len(next(iter(x))) for x in items if x}}
                if not any(x & own[len(next(iter(x)))] for x in items if x):
                    clean.add(r["doc_id"])
            assert kept == clean and len(kept) < before.count()
        if name == "packing":
            assert kept == {r["doc_id"] for r in before.select("doc_id").collect()}


def test_language_stage_drops_what_is_like_none(spark):
    small = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10_000_002, "\u4e00\u4e8c\u4e09 " * 80, None, "s", 1), (10_000_003, "12 34 " * 80, None, "s", 1)], SCHEMA)
    kept = {r["doc_id"] for r in corpus_pipeline.language_stage(spark, small.unionByName(odd.select(*small.columns)), SMALL).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in small.collect() if re.search(r"[^\W\d_]", r["text"] or "")}


def odd_rows(spark):
    long = " ".join(f"word{i % 977}" for i in range(40_000))
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "word " * 60 + "end", "en", "s", 1), (2, "word " * 60 + "end", "en", "s", 1), (3, "", None, None, 0), (4, " \n\t ", "en", "s", 1), (5, long, "en", "s", 2), (None, "a text without an id", "de", "s", 3), (6, "one", "de", None, None), (2, "other text of the same id", "de", "s", 4), (7, "!!! ...", "en", "s", 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("k", range(5))
def test_each_stage_on_odd_input(spark, k):
    """Every stage meets nulls, empty, wordless and long texts, repeated rows and ids, and an empty table, not only what others leave."""
    name, stage = corpus_pipeline.STAGES[k]
    docs = odd_rows(spark)
    out = stage(spark, docs, SMALL)
    kept = sorted(r["doc_id"] or 0 for r in out.select("doc_id").collect())
    if k < 4:
        assert out.columns == docs.columns
    if name == "quality_rules":
        assert kept in ([], [5])  # all others have under fifty words or repeat them
    if name == "language_id":
        assert kept == [2, 2, 2, 5, 6]
    if name == "jaccard_join":
        assert kept == [1, 2, 3, 4, 5, 6, 7]
    if name == "decontaminate":
        assert kept == [1, 2, 2, 2, 3, 4, 5, 6, 7]
    if name == "packing":
        assert sorted(set(kept)) == [0, 1, 2, 3, 4, 5, 6, 7] and kept.count(2) == 3
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_odd_input_through_all_stages(spark):
    data = odd_rows(spark)
    for _, stage in corpus_pipeline.STAGES:
        data = stage(spark, data, SMALL)
    assert data.columns[0] == "doc_id"
