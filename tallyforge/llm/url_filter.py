"""Operator 7: URL filters by a temporal list join.

List entries are dated: (kind, value, action, at), where kind is ``host`` (that host), ``domain`` (it and all
below it) or ``prefix`` (host and path beginning), and action ``add`` or ``remove``.  Each value's entries
become validity intervals [added, removed); an added value that is added again stays in its interval, and of
entries at the same instant the removal counts last.  Every capture (id, url, fetched_at) is evaluated as of
its fetch: its host, its host's parent domains and its path prefixes are looked up among the intervals, and those
that hold at that time decide.

A capture asks for a handful of keys (its labels, and its path at the depths that prefix entries have), so the join is an equi-join on key with a time
condition; a hot host makes its keys hot on the capture side only, where Spark splits skewed partitions.

Defined results: a null or unparsable url has a null host and is never listed; a null fetched_at is never
listed; entries with a null field or an unknown kind or action are ignored; each capture row gives one row,
repeated rows included; extra columns are ignored; an empty list lists nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validity_intervals(entries: DataFrame) -> DataFrame:
    """kind, value, valid_from and valid_to (null: still listed) of dated entries."""
    known = entries.select("kind", F.lower("value").alias("value"), "action", "at").filter("kind in ('host', 'domain', 'prefix') and action in ('add', 'remove') and value is not null and at is not null")
    # the last action of an instant counts, and removal sorts after addition
    last = known.groupBy("kind", "value", "at").agg(F.max("action").alias("action"))
    history = Window.partitionBy("kind", "value").orderBy("at")
    changed = last.withColumn("before", F.lag("action").over(history)).filter("not (action <=> before)")
    spans = changed.withColumn("valid_to", F.lead("at").over(history)).filter("action = 'add'")
    return spans.select("kind", "value", F.col("at").alias("valid_from"), "valid_to")


def url_parts(url: str = "url") -> tuple:
    """Columns host and path of a url column; null where there is no host."""
    authority = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r"^.*@", ""), r":[0-9]*$", ""))
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.when(host != "", host), F.lower(path)


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """capture_id, host, fetched_at, blocked, n_entries and blocked_since for captures (capture_id, url, fetched_at)."""
    host, path = url_parts()
    numbered = captures.select("capture_id", "url", "fetched_at", host.alias("host"), path.alias("path"))
    asked = numbered.filter("host is not null and fetched_at is not null").select("url", "fetched_at", "host", "path").distinct()
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")))
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    spans = validity_intervals(entries)
    # the path is looked up at every depth that some prefix entry has, however deep
    known = spans.filter("kind = 'prefix'").select((F.size(F.split("value", "/")) - 1).alias("depth")).filter("depth > 0").distinct()
    depths = F.lit(sorted(r["depth"] for r in known.collect())).cast("array<int>")
    prefixes = F.transform(F.filter(depths, lambda i: i <= F.size(segments)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")).alias("value")))
    keys = F.array_compact(F.concat(F.array(F.struct(F.lit("host").alias("kind"), F.col("host").alias("value"))), domains, F.coalesce(prefixes, F.array())))
    lookups = asked.select("url", "fetched_at", F.explode(keys).alias("k")).select("url", "fetched_at", "k.*")
    active = lookups.join(spans, ["kind", "value"]).filter("valid_from <= fetched_at and (valid_to is null or fetched_at < valid_to)")
    listed = active.groupBy("url", "fetched_at").agg(F.count("*").alias("n"), F.min("valid_from").alias("since"))
    out = numbered.join(listed, ["url", "fetched_at"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return out.select("capture_id", "host", "fetched_at", (n > 0).alias("blocked"), n.alias("n_entries"), F.col("since").alias("blocked_since"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The pages as captures: fetched at noon of a day of 2024 that goes by page_id."""
    day = F.pmod(F.col("page_id") * 7919, F.lit(366)).cast("int")
    return pages.select(F.col("page_id").alias("capture_id"), "url", F.expr("timestamp'2024-01-01 12:00:00'").alias("t0"), day.alias("d")).select("capture_id", "url", F.expr("t0 + make_interval(0, 0, 0, d)").alias("fetched_at"))


def list_of(pages: DataFrame) -> DataFrame:
    """A dated block list over the pages' own hosts and paths, derived from their checksums.

    Every third host is listed for good or for a while, some twice; every fifth registered domain, and every
    seventh first path segment of a host, is listed from some day on.
    """
    checksum = lambda c: F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")
    host, path = url_parts()
    seen = pages.select(host.alias("host"), path.alias("path")).filter("host is not null").distinct()
    hosts = seen.select("host").distinct().withColumn("c", checksum("host"))
    day = lambda c: F.expr(f"timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, int({c}))")
    first = hosts.filter("c % 3 = 0")
    parts = [
        first.select(F.lit("host").alias("kind"), F.col("host").alias("value"), F.lit("add").alias("action"), day("c % 200").alias("at")),
        first.filter("c % 2 = 0").select(F.lit("host"), "host", F.lit("remove"), day("c % 200 + 30 + c % 50")),
        first.filter("c % 4 = 0").select(F.lit("host"), "host", F.lit("add"), day("c % 200 + 120")),
    ]
    domains = hosts.select(F.substring_index("host", ".", -3).alias("domain")).distinct().withColumn("c", checksum("domain")).filter("c % 5 = 0")
    parts.append(domains.select(F.lit("domain"), "domain", F.lit("add"), day("c % 300")))
    prefixes = seen.select(F.concat("host", F.lit("/"), F.element_at(F.split("path", "/"), 2)).alias("prefix")).filter("prefix is not null and not prefix like '%/'").distinct().withColumn("c", checksum("prefix")).filter("c % 7 = 0")
    parts.append(prefixes.select(F.lit("prefix"), "prefix", F.lit("add"), day("c % 366")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
