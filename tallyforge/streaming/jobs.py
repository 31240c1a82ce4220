"""Stream jobs: the same results as their batch twins, on unbounded input with bounded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from tallyforge.functions.text import digest
from tallyforge.operators.search import postings
from tallyforge.sources.keyed import current, replace_keys


def ingest_activity(events: DataFrame, late: str = "1 day") -> DataFrame:
    """ST-1: each event_key once; keys are forgotten ``late`` after their time."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return timed.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["event_key"])


def minute_rate(events: DataFrame, window: str = "1 minute", slide: str = "10 seconds", late: str = "5 minutes") -> DataFrame:
    """ST-2: events per user in sliding windows; a window is given out once, when the watermark passes its end."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    counted = timed.groupBy(F.window("created_at", window, slide), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("window.start").alias("from"), F.col("window.end").alias("to"), "n")


#: The column of a row's digest; names that begin with an underscore do not reach the processor.
DIGEST = "digest_of_the_row"


class _Changes(StatefulProcessor):
    """Of the rows of a key, in order of arrival and then of ``order``, those whose digest differs from the one before; state is one digest and number a key."""

    def __init__(self, keys: list[str], order: list[str], columns: list[str]) -> None:
        self.keys, self.order, self.columns = keys, order, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "digest string, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        arrived = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        known = self.last.get() if self.last.exists() else None
        digest, version = (known[0], known[1]) if known else (None, 0)
        kept, versions = [], []
        for i, d in enumerate(arrived[DIGEST]):
            d = None if pd.isna(d) else d
            if not version or d != digest:
                digest, version = d, version + 1
                kept.append(i)
                versions.append(version)
        if kept:
            self.last.update((digest, version))
            out = arrived.iloc[kept]
            yield out[self.columns].assign(version=versions)

    def close(self) -> None:
        pass


#: State in RocksDB: a micro-batch reads and writes the keys that it has, whatever number there are in all.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _changes(rows: DataFrame, keys: list[str], order: list[str], digest_of: Column) -> DataFrame:
    """Rows of a stream that change their key's digest, with ``version`` counted up for each key."""
    columns = rows.columns
    schema = StructType([*rows.schema.fields, StructField("version", LongType())])
    return rows.withColumn(DIGEST, digest_of).groupBy(*keys).transformWithStateInPandas(statefulProcessor=_Changes(keys, order, columns), outputStructType=schema, outputMode="Append", timeMode="None")


def _append(rows: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append to Parquet files; the sink's log in ``target`` and ``checkpoint`` make a batch that runs again replace itself."""
    conf = rows.sparkSession.conf
    before = conf.get(ROCKSDB[0])
    conf.set(*ROCKSDB)
    try:
        return rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        conf.set(ROCKSDB[0], before)


def version_events(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """ST-3: versions of each (provider, external_id), appended to ``target`` (Parquet); the stream of OP-64.

    A row equal to the one before it gives no version.  Rows count in order of their micro-batch, inside one by (ts, event_id).
    The state of a key is its last digest and version, so a micro-batch costs what its own keys cost.  ``target`` and ``checkpoint`` belong together.
    """
    rows = events.select("provider", "external_id", "ts", "event_id", "digest")
    return _append(_changes(rows, ["provider", "external_id"], ["ts", "event_id"], F.col("digest")), target, checkpoint)


def change_log_stream(rows: DataFrame, keys: list[str], order: list[str], compared: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """ST-3: the stream of OP-66: each key's first row (insert) and each row that differs from the one before (update), null-safe, appended to ``target``."""
    found = _changes(rows, keys, order, digest(*compared))
    return _append(found.withColumn("kind", F.when(F.col("version") == 1, "insert").otherwise("update")), target, checkpoint)


#: Parts of a stored posting table; a search reads those of its terms.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def index_fragments(fragments: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """ST-4: the posting table of a stream of fragments (fragment_id, heading, body), kept in ``target``.

    A fragment that comes again replaces its postings, also by none; fragments and postings of a batch are committed together, and a batch that
    runs again changes nothing.  Where a batch has a fragment twice, the larger (heading, body) counts.  Files are apart by hashed term.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        one = batch.groupBy("fragment_id").agg(F.max(F.struct("heading", "body")).alias("f")).select("fragment_id", "f.*")
        rows = postings(one).withColumn("bucket", _bucket(F.col("term")))
        replace_keys(target, {"fragments": one.select("fragment_id"), "postings": rows.repartition("bucket")}, ["fragment_id"], f"{batch_id:012d}", {"postings": "bucket"})

    return fragments.writeStream.foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_postings(spark: SparkSession, target: str, terms: list[str]) -> DataFrame:
    """OP-88 over ST-4: the postings in force of some terms, from the files of their parts only; what ``search_terms`` and ``search_ranked`` take."""
    parts = sorted(r[0] for r in spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term"))).distinct().collect())
    return current(spark, target, "postings", ["fragment_id"], F.col("bucket").isin(parts)).filter(F.col("term").isin(terms)).drop("bucket")
