"""Tables of parents and children on plain Parquet, in which whole keys are replaced by a commit in two steps.

A batch has a version.  First its tables are written, each under its version, and the list of its keys (the manifest); nothing reads them yet.
Then one row is written that names the version and its place in the order of commits.  A reader takes for each key the last committed version
that lists it, and of every table the rows of that version.  So parents and children of a key change together, a batch that is run again
writes the same files and keeps its place, and what a failed batch left behind is not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

COMMITS = "version string, place long"


def _commits(spark: SparkSession, root: str) -> DataFrame:
    try:
        return spark.read.schema(COMMITS).parquet(f"{root}/commits")
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], COMMITS)


def stage(root: str, tables: dict[str, DataFrame], keys: list[str], version: str, parts: dict[str, str] | None = None) -> None:
    """First step: the batch's tables and, from the first of them (the parents), the keys that it replaces.

    ``parts`` names a column for tables whose files are to be apart by it.
    """
    for name, rows in tables.items():
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(parts[name]) if parts and name in parts else writer).parquet(f"{root}/{name}/version=v-{version}")
    parents = next(iter(tables.values()))
    parents.sparkSession.read.parquet(f"{root}/{next(iter(tables))}/version=v-{version}").select(*keys).distinct().write.mode("overwrite").parquet(f"{root}/manifest/version=v-{version}")


def commit(spark: SparkSession, root: str, version: str) -> None:
    """Second step: one row, in a file of its own; a version that has its place keeps it."""
    known = _commits(spark, root)
    place = known.agg(F.coalesce(F.max(F.when(F.col("version") == f"v-{version}", F.col("place"))), F.max("place") + 1, F.lit(0)).alias("place")).first()["place"]
    spark.createDataFrame([(f"v-{version}", place)], COMMITS).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/of=v-{version}")


def replace_keys(root: str, tables: dict[str, DataFrame], keys: list[str], version: str, parts: dict[str, str] | None = None) -> None:
    """OP-05: replace the keys of the first table, with all that hangs on them in the others."""
    stage(root, tables, keys, version, parts)
    commit(next(iter(tables.values())).sparkSession, root, version)


def current(spark: SparkSession, root: str, name: str, keys: list[str], only: Column | None = None) -> DataFrame:
    """The rows of a table that are in force, of those that ``only`` holds for; versions that are not committed are not read."""
    listed = spark.read.parquet(f"{root}/manifest").join(_commits(spark, root), "version")
    last = listed.groupBy(*keys).agg(F.max_by("version", "place").alias("version"))
    rows = spark.read.parquet(f"{root}/{name}")
    return (rows if only is None else rows.filter(only)).join(last, [*keys, "version"]).drop("version")
