"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Quality rules drop what they reject; language identification drops documents without letters and those that are less
alike to every learned language than its own documents are, by far (see ``language_bounds``); the
n-gram Jaccard join keeps one document of each group (the smallest doc_id); decontamination drops documents
that hold a benchmark window; packing lays out what is left.  All stages but the last return the columns of
``documents``.  Each stage judges its own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm._spark import broadcast_if_small, durable
from tallyforge.llm.decontaminate import decontaminate
from tallyforge.llm.jaccard_join import jaccard_components
from tallyforge.llm.language_id import identify_languages, language_bounds
from tallyforge.llm.packing import pack
from tallyforge.llm.quality_rules import quality_scores


def _chosen(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``keep``; rows without an id cannot be named and go.

    The ids are broadcast only if they were counted to be few; else Spark shuffles both sides.
    """
    ids = durable(keep.select("doc_id").distinct(), "pipeline-kept")
    return docs.join(broadcast_if_small(ids), "doc_id", "left_semi").select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _chosen(docs, quality_scores(docs).filter("kept"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, or with a score below the bound of the language that they are most alike to."""
    found = durable(identify_languages(docs), "pipeline-languages")
    # one row a language; languages are bounded by the operator
    return _chosen(docs, found.join(F.broadcast(language_bounds(found)), "lang_pred").filter("score >= bound"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = _chosen(docs, jaccard_components(docs).filter("doc_id = component_id"))
    # a row that repeats another's doc_id is a copy as well; texts move only if there is one
    repeated = durable(kept.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "pipeline-repeated")
    if repeated.isEmpty():
        return kept
    few = broadcast_if_small(repeated)
    return kept.join(few, "doc_id", "left_anti").unionByName(kept.join(few, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _chosen(docs, decontaminate(docs, benchmark).filter("not contaminated"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("language_id", language_stage),
    ("jaccard_join", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("packing", packing_stage),
]

#: Stages 1 (a fitted model), 2 and 5 have no SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
