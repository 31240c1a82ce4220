"""Streams against their batch twins."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyforge.operators.records import change_log, scd2_versions
from tallyforge.operators import search
from tallyforge.operators.search import postings
from tallyforge.sources import keyed
from tallyforge.sources.tables import activity, table, versioned_events
from tallyforge.streaming import jobs

D = "/root/testdata/sf0.001"


def _stream(spark, tmp_path, df, files=3):
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _in_parts(spark, tmp_path, rows, parts, order):
    """A source of files by order of arrival, one a micro-batch; and a function that lets the next ones arrive."""
    whole = rows.withColumn("b", F.ntile(parts).over(Window.orderBy(*order))).cache()
    path = str(tmp_path / "ordered")
    arrive = lambda k: whole.filter(f"b = {k}").drop("b").coalesce(1).write.mode("append").parquet(path)
    arrive(1)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), arrive


def _rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


def test_versions_and_restart(spark, tmp_path):
    rows = versioned_events(table(spark, D, "events"))
    source, arrive = _in_parts(spark, tmp_path, rows, 4, ["ts", "event_id"])
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    arrive(2)
    jobs.version_events(source, target, check).awaitTermination(240)
    # the query ends and begins again with what has come meanwhile
    arrive(3)
    arrive(4)
    jobs.version_events(source, target, check).awaitTermination(240)
    names = ["provider", "external_id", "event_id", "version"]
    want = _rows(scd2_versions(rows, ["provider", "external_id"], ["ts", "event_id"]), *names)
    assert _rows(spark.read.parquet(target), *names) == want
    jobs.version_events(source, target, check).awaitTermination(240)
    assert _rows(spark.read.parquet(target), *names) == want
    assert "RocksDB" not in spark.conf.get(jobs.ROCKSDB[0])


def test_change_log(spark, tmp_path):
    rows = table(spark, D, "events").select("user_id", "ts", "event_id", F.when(F.col("event_id") % 7 > 0, F.col("event_type")).alias("event_type"), F.pmod("event_id", F.lit(2)).alias("odd"))
    source, arrive = _in_parts(spark, tmp_path, rows, 3, ["ts", "event_id"])
    arrive(2)
    arrive(3)
    target = str(tmp_path / "out")
    jobs.change_log_stream(source, ["user_id"], ["ts", "event_id"], ["event_type", "odd"], target, str(tmp_path / "check")).awaitTermination(240)
    names = ["user_id", "event_id", "event_type", "odd", "kind"]
    assert _rows(spark.read.parquet(target), *names) == _rows(change_log(rows, ["user_id"], ["ts", "event_id"], ["event_type", "odd"]), *names)


def test_stored_postings(spark, tmp_path):
    """Fragments that change leave no stale postings; a search reads the parts of its terms only."""
    f = table(spark, D, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("fragment_id"), F.col("role").alias("heading"), F.col("text").alias("body"))
    target, check, path = str(tmp_path / "out"), str(tmp_path / "check"), str(tmp_path / "in")
    f.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).parquet(path)
    jobs.index_fragments(source, target, check).awaitTermination(240)
    changed = f.filter("fragment_id % 3 = 0").withColumn("body", F.when(F.col("fragment_id") % 2 == 0, F.concat(F.lit("the new "), "body")))
    changed.coalesce(1).write.mode("append").parquet(path)
    jobs.index_fragments(source, target, check).awaitTermination(240)
    want = postings(f.join(changed.select("fragment_id"), "fragment_id", "left_anti").unionByName(changed))
    every = keyed.current(spark, target, "postings", ["fragment_id"])
    names = ["term", "fragment_id", "pos", "part"]
    assert _rows(every, *names) == _rows(want, *names)
    found = jobs.stored_postings(spark, target, ["the", "new"])
    assert _rows(found, *names) == _rows(want.filter("term in ('the', 'new')"), *names)
    assert "bucket" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [", 1)[1].split("]")[0]
    assert _rows(search.search_terms(found, "the new"), "fragment_id", "score") == _rows(search.search_terms(want, "the new"), "fragment_id", "score")


def test_dedupe_and_rate(spark, tmp_path):
    a = activity(table(spark, D, "events")).select("event_key", "user_id", "created_at")
    source = _stream(spark, tmp_path, a.unionByName(a), 1)
    q = jobs.ingest_activity(source).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == a.count()
    late = a.select("event_key", "user_id", F.expr("timestamp'2030-01-01'").alias("created_at")).limit(1)
    timed = a.withColumn("created_at", F.col("created_at").cast("timestamp"))
    timed.unionByName(late).coalesce(1).write.parquet(str(tmp_path / "rate"))
    source = spark.readStream.schema(timed.schema).parquet(str(tmp_path / "rate"))
    q = jobs.minute_rate(source, "6 hours", "2 hours").writeStream.format("memory").queryName("rate").trigger(availableNow=True).start()
    q.awaitTermination(120)
    # the last event, years later, closes every other window
    want = timed.groupBy(F.window("created_at", "6 hours", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", "w.start", "w.end", "n")
    assert _rows(spark.table("rate"), "user_id", "from", "to", "n") == _rows(want, "user_id", "start", "end", "n")
