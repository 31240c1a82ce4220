"""Landing, versions, activity and job operators over plain records."""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DecimalType, IntegralType, MapType, StringType, StructField, StructType

from tallyforge.functions.constants import EVENT_CATEGORIES
from tallyforge.functions.text import digest, let
from tallyforge.sources.shared import checkpointed


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key: the first in an order (OP-04, OP-33, OP-53, OP-67, OP-68)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def payload_rows(payloads: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """OP-01: (rows, rejects) of payloads (id, payload) that hold a JSON list; what does not parse, is no list, or has a value of another type, is rejected.

    Values are read as their text and then made what ``schema`` says, so decimals keep their digits.  A value that is there but cannot be made that
    (a word or a fraction for a whole number) rejects its payload; a null or missing one is null.
    """
    wanted = StructType.fromDDL(schema)
    texts, exact = (StructType([StructField(f.name, t(f)) for f in wanted if t(f)]) for t in (lambda f: StringType(), lambda f: f.dataType if isinstance(f.dataType, DecimalType) else None))
    read_as = lambda kind: F.when(F.trim("payload").startswith("["), F.from_json("payload", ArrayType(kind), {"mode": "PERMISSIVE"}))
    parsed = payloads.select("id", "payload", read_as(texts).alias("rows"), (read_as(exact) if exact.fields else F.array().cast("array<string>")).alias("exact"))

    def made(row: Column, digits: Column, field: StructField) -> Column:
        text, kind = row[field.name], field.dataType
        if isinstance(kind, StringType):
            return text
        if isinstance(kind, DecimalType):
            # the text of a number has the digits of a double; read as a decimal it has its own
            return F.when(text.rlike(r"^\s*[-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?\s*$"), digits[field.name])
        if isinstance(kind, IntegralType):
            return F.when(text.rlike(r"^\s*-?[0-9]+(?:\.0+)?\s*$"), F.regexp_replace(text, r"\.0+\s*$", "").try_cast(kind))
        if isinstance(kind, (ArrayType, MapType, StructType)):
            return F.from_json(text, kind, {"mode": "PERMISSIVE"})
        return text.try_cast(kind)

    typed = F.transform("rows", lambda r, i: F.struct(r.alias("text"), F.struct(*(made(r, F.get("exact", i), f).alias(f.name) for f in wanted)).alias("value")))
    broken = lambda x: x["text"].isNull() | reduce(Column.__or__, [x["text"][f.name].isNotNull() & x["value"][f.name].isNull() for f in wanted], F.lit(False))
    # an explode binds what was read, so that no filter reads it again
    read = parsed.select("id", F.explode(F.array(F.struct("payload", typed.alias("rows")))).alias("x")).select("id", "x.*")
    bad = F.coalesce(F.exists("rows", broken), F.lit(True))
    return read.filter(~bad).select("id", F.inline(F.transform("rows", lambda x: x["value"]))), read.filter(bad).select("id", "payload")


def _code_point(token: Column) -> Column:
    """The character of a numeric reference (#34 or #x22)."""
    code = F.when(F.startswith(token, F.lit("#x")), F.conv(F.substring(token, 3, 8), 16, 10)).otherwise(F.substring(token, 2, 8)).try_cast("int")
    unit = lambda c: F.concat(F.lit("\\u"), F.lpad(F.hex(c), 4, "0"))
    # JSON spells any character; those over U+FFFF are pairs
    spelled = F.when(code < 0x10000, unit(code)).otherwise(F.concat(unit(F.lit(0xD800) + F.floor((code - 0x10000) / 1024)), unit(F.lit(0xDC00) + F.pmod(code - 0x10000, F.lit(1024)))))
    return F.when((code > 0) & (code < 0x110000), F.from_json(F.concat(F.lit('{"c": "'), spelled, F.lit('"}')), "c string")["c"])


def _text(chunk: Column) -> Column:
    """XML character data, its references read; null if one is unknown or an ampersand stands alone."""
    reference = r"&(#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z][A-Za-z0-9]*);"
    named = lambda t: F.when(t == "lt", "<").when(t == "gt", ">").when(t == "quot", '"').when(t == "apos", "'").when(t == "amp", "&").when(F.startswith(t, F.lit("#")), _code_point(t))

    def joined(between: Column) -> Column:
        tokens = F.transform(F.regexp_extract_all(chunk, F.lit(reference), F.lit(1)), named)
        fine = ~F.exists(between, lambda x: F.contains(x, F.lit("&")))
        return F.when(fine, let(tokens, lambda ts: F.when(~F.exists(ts, lambda t: t.isNull()), F.array_join(F.zip_with(between, ts, lambda x, t: F.concat(x, F.coalesce(t, F.lit("")))), ""))))

    return F.when(~F.contains(chunk, F.lit("&")), chunk).otherwise(let(F.split(chunk, reference, -1), joined))


def unwrap_envelope(envelopes: DataFrame, operation: str) -> DataFrame:
    """OP-01: id and payload, the text of the first element whose name ends in ``<operation>Result`` of XML envelopes (id, envelope); null where there is none.

    Its text is what stands before a child element: character data with named and numeric references, and CDATA as it is; comments are passed over.
    """
    tag = rf"(?s)^.*?<(?:[\w.-]+:)?[\w.-]*{operation}Result(?:\s[^>]*)?(?<!/)>"
    rest = F.when(F.col("envelope").rlike(tag), F.regexp_replace("envelope", tag, ""))
    read = lambda c: F.when(F.startswith(c, F.lit("<![CDATA[")), F.regexp_replace(c, r"(?s)^<!\[CDATA\[|\]\]>$", "")).when(F.startswith(c, F.lit("<!--")), "").otherwise(_text(c))

    def before_tag(chunks: Column) -> Column:
        # without a tag behind it, or with a reference that cannot be read, there is no text
        own = F.transform(F.slice(chunks, F.lit(1), F.array_position(chunks, "<").cast("int") - 1), read)
        return F.when(F.array_contains(chunks, "<"), let(own, lambda texts: F.when(~F.exists(texts, lambda t: t.isNull()), F.array_join(texts, ""))))

    text = let(F.regexp_extract_all(rest, F.lit(r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|[^<]+|<"), F.lit(0)), before_tag)
    bound = envelopes.select("id", F.explode(F.array(text)).alias("text"))
    return bound.select("id", F.nullif(F.trim("text"), F.lit("")).alias("payload"))


def failing(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold, joined by commas; a null check does not hold."""
    return F.concat_ws(",", *(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items()))


#: Fields of a source entry, as JSON.
SOURCE = "source_key string, company_id string, fiscal_year int, period_code string, scope string, language_code string, document_name string, source_url string, identity_tokens array<string>"


def source_entries(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """OP-09: (entries with errors, rejects) of JSON lists of sources (id, payload); an empty list is rejected.

    errors names what is wrong with an entry: a blank text field, a url that is not https with a host, a year before 2000, an
    unknown period or scope, fewer than two identity tokens or a blank one, or a key that is not unique.
    """
    rows, bad = payload_rows(lists, SOURCE)
    none = lists.join(rows.select("id").unionByName(bad.select("id")).distinct(), "id", "left_anti").select("id", "payload")
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    rows = rows.withColumns({"period_code": F.coalesce("period_code", F.lit("A")), "language_code": F.coalesce("language_code", F.lit("es"))})
    checks = {
        "source_url": F.coalesce(~F.trim("source_url").rlike("^https://[^/?#]+"), F.lit(True)), "fiscal_year": F.coalesce(F.col("fiscal_year") < 2000, F.lit(True)),
        "period_code": ~F.trim("period_code").isin("A", "1", "2", "3", "4"), "scope": F.coalesce(~F.trim("scope").isin("individual", "consolidated"), F.lit(True)),
        "identity_tokens": F.coalesce(F.size("identity_tokens") < 2, F.lit(True)) | F.exists("identity_tokens", blank), "company_id": blank("company_id"), "language_code": blank("language_code"), "document_name": blank("document_name"),
        "source_key": blank("source_key") | (F.count("*").over(Window.partitionBy("source_key")) > 1),
    }
    return rows.withColumns({f"_{n}": c for n, c in checks.items()}).withColumn("errors", failing({n: F.col(f"_{n}") for n in checks})).drop(*(f"_{n}" for n in checks)), bad.unionByName(none)


def validate_events(raw: DataFrame) -> DataFrame:
    """OP-29: raw records with ``errors``, and their fields normalised, or null where there is an error.

    Fields: company_id, source_provider, external_id, category, title, summary, published_at, source_url (required),
    effective_date; all text.  Times need a zone, dates and times are ISO, urls https with a host.
    """
    required = ("company_id", "source_provider", "external_id", "category", "title", "summary", "published_at", "source_url")
    empty = F.lit(False)
    for c in required:
        empty = empty | F.coalesce(F.col(c) == "", F.lit(True))
    dated = F.col("effective_date").isNotNull() & (F.col("effective_date") != "")
    checks = {
        "required": empty, "category": ~F.trim("category").isin(*EVENT_CATEGORIES), "source_url": ~F.trim("source_url").rlike("^https://[^/?#]+"),
        "published_at": ~F.col("published_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}.*(Z|[+-][0-9]{2}:[0-9]{2})$") | F.try_to_timestamp("published_at").isNull(),
        "effective_date": dated & (~F.col("effective_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") | F.col("effective_date").try_cast("date").isNull()),
        "title": F.length(F.trim("title")) > 240, "summary": F.length(F.trim("summary")) > 1200,
    }
    out = raw.withColumn("errors", failing(checks))
    fine = {c: F.when(F.col("errors") == "", F.trim(c)) for c in required}
    return out.withColumns(fine | {"effective_date": F.when((F.col("errors") == "") & dated, F.col("effective_date"))})


def canonical(value: Column, kind: DataType) -> Column:
    """OP-30: the canonical JSON of a value of any depth: keys in order, no spaces, arrays in their order.

    Keys of maps and fields of structs are sorted by code point, so the order in which they came does not matter.  A null is written as null; a key that
    a map does not have is not written, so it differs from null.  Strings are escaped as JSON; whole numbers, decimals and booleans are
    written as they are, other scalars as strings.
    """
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(f"{json.dumps(f.name, ensure_ascii=False)}:"), canonical(value[f.name], f.dataType)) for f in fields]
        body = F.concat(F.lit("{"), F.array_join(F.array(*parts), ","), F.lit("}"))
    elif isinstance(kind, MapType):
        entry = lambda e: F.concat(canonical(e["key"], StringType()), F.lit(":"), canonical(e["value"], kind.valueType))
        entries = F.transform(F.map_entries(value), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")))
        ordered = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))
        body = F.concat(F.lit("{"), F.array_join(F.transform(ordered, entry), ","), F.lit("}"))
    elif isinstance(kind, ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, (BooleanType, DecimalType, IntegralType)):
        body = value.cast("string")
    else:
        quoted = F.to_json(F.struct(value.cast("string").alias("v")))  # {"v":"..."}
        body = F.substr(quoted, F.lit(6), F.length(quoted) - 6)
    return F.when(value.isNull(), "null").otherwise(body)


def canonical_digest(df: DataFrame, columns: list[str]) -> Column:
    """OP-30: sha-256 of the canonical JSON of an object of these columns."""
    fields = [f for f in df.schema.fields if f.name in columns]
    return F.sha2(canonical(F.struct(*(F.col(f.name) for f in fields)), StructType(fields)), 256)


def rows_of_key(df: DataFrame, column: str, key: object) -> DataFrame:
    """OP-03: the rows of one key, compared as trimmed text; none at all is an error."""
    found = df.filter(F.trim(F.col(column).cast("string")) == str(key).strip())
    if found.isEmpty():
        raise LookupError(f"no row has {column} {key}")
    return found


def raw_dedupe(payloads: DataFrame, keys: list[str]) -> DataFrame:
    """OP-02: one row for each (keys, sha-256 of payload), with the newest retrieval and the number of rows."""
    return payloads.withColumn("sha", F.sha2("payload", 256)).groupBy(*keys, "sha").agg(F.max("retrieved_at").alias("retrieved_at"), F.count("*").alias("row_count"))


def in_chunks(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with ``chunk``: numbers that rise with (keys, order) and cut large keys.

    The rows are range-partitioned by keys and order together, so a key with most of all rows fills several ranges, and each range is a
    chunk.  Equal rows stay together.  The result is a checkpoint, so that a range that is made again cannot cut elsewhere.
    """
    return checkpointed(rows.repartitionByRange(*keys, *order).withColumn("chunk", F.spark_partition_id()))


def _same(columns: list[str]) -> Column:
    """Equal, null included, to the columns that are named with _at_ before."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_at_{c}")) for c in columns])


def changed_rows(rows: DataFrame, keys: list[str], order: list[str], digest_col: str, chunked: bool = False) -> DataFrame:
    """The rows of each key whose digest differs from the one before (null-safe; before the first stands a null), with ``version`` and ``is_current``.

    With ``chunked``, keys are cut (see ``in_chunks``): windows run inside chunks; one row a chunk then tells its first and last digest and its number of
    changes, and a small pass over those rows gives each chunk what came before it.
    """
    key = F.col(digest_col)
    if not chunked:
        w = Window.partitionBy(*keys).orderBy(*order)
        changed = rows.withColumn("_before", F.lag(digest_col).over(w)).filter(~key.eqNullSafe(F.col("_before"))).drop("_before")
        return changed.withColumn("version", F.row_number().over(w)).withColumn("is_current", F.lead("version").over(w).isNull())
    part = [*keys, "chunk"]
    w = Window.partitionBy(*part).orderBy(*order)
    inside = in_chunks(rows, keys, order).withColumn("_row", F.row_number().over(w)).withColumn("_before", F.lag(digest_col).over(w))
    inside = inside.withColumn("_changed", (F.col("_row") > 1) & ~key.eqNullSafe(F.col("_before")))
    ends = inside.groupBy(*part).agg(F.min_by(F.struct(key.alias("d")), "_row").alias("first"), F.max_by(F.struct(key.alias("d")), "_row").alias("last"), F.count_if("_changed").alias("n"))
    chunks = Window.partitionBy(*keys).orderBy("chunk")
    ends = ends.withColumn("_opens", ~F.col("first.d").eqNullSafe(F.lag("last.d").over(chunks))).withColumn("n", F.col("n") + F.col("_opens").cast("int"))
    ends = ends.select(*(F.col(k).alias(f"_at_{k}") for k in part), "_opens", (F.sum("n").over(chunks) - F.col("n")).alias("_base"), F.sum("n").over(Window.partitionBy(*keys)).alias("_all"))
    found = inside.join(ends, _same(part)).filter(F.col("_changed") | ((F.col("_row") == 1) & F.col("_opens")))
    version = (F.col("_base") + F.row_number().over(w)).cast("int")
    return found.withColumn("version", version).withColumn("is_current", F.col("version") == F.col("_all")).drop("chunk", "_row", "_before", "_changed", "_opens", "_base", "_all", *(f"_at_{k}" for k in part))


def scd2_versions(events: DataFrame, keys: list[str], order: list[str], digest_col: str = "digest", chunked: bool = False) -> DataFrame:
    """OP-64: versions of each key in order of arrival.

    A row equal to the one before it is unchanged and gives no version; every other row is one more
    version.  A digest that an earlier, no longer current version had is marked as a reversion.  ``chunked`` is for keys with very many rows.
    """
    versions = changed_rows(events, keys, order, digest_col, chunked)
    if not chunked:
        seen = Window.partitionBy(*keys, digest_col).orderBy(*order)
        return versions.withColumn("is_reversion", F.row_number().over(seen) > 1)
    # the first version of a digest is an aggregate, which large keys combine before they move
    part = [*keys, digest_col]
    first = versions.groupBy(*part).agg(F.min("version").alias("_first")).select(*(F.col(k).alias(f"_at_{k}") for k in part), "_first")
    return versions.join(first, _same(part)).select(*versions.columns, (F.col("version") > F.col("_first")).alias("is_reversion"))


def first_seen_versions(rows: DataFrame, keys: list[str], identity: list[str], order: list[str]) -> DataFrame:
    """OP-65: any earlier row of the same identity makes a row unchanged; the rest are versions 1, 2, ...

    The first row of an identity is an aggregate, so only one row of each moves to its key.
    """
    others = [c for c in rows.columns if c not in (*keys, *identity)]
    first = F.min_by(F.struct(*others), F.struct(*order))
    kept = rows.groupBy(*keys, *identity).agg(first.alias("_r")).select(*keys, *identity, "_r.*").select(*rows.columns)
    w = Window.partitionBy(*keys).orderBy(*order)
    return kept.withColumn("version", F.row_number().over(w)).withColumn("is_current", F.lead(order[0]).over(w).isNull())


def change_log(rows: DataFrame, keys: list[str], order: list[str], compared: list[str], chunked: bool = False) -> DataFrame:
    """OP-66: snapshots of each key's first row and of each row that differs from the one before (null-safe)."""
    marked = changed_rows(rows.withColumn("_d", digest(*compared)), keys, order, "_d", chunked)
    return marked.withColumn("kind", F.when(F.col("version") == 1, "insert").otherwise("update")).drop("_d", "version", "is_current")


def sliding_rate(activity: DataFrame, seconds: int, limit: int) -> DataFrame:
    """OP-69: earlier events of the same user within the trailing seconds (both ends open), and whether the limit is reached.

    Time is cut into stretches of that many seconds; a row counts in its own stretch and, for the rows after it, in the next.  So windows are those
    of a user and a stretch, and a busy user is spread over as many tasks as there are stretches.
    """
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    stretch = F.floor(F.col("micros") / (seconds * 1_000_000))
    timed = activity.withColumn("micros", micros).withColumn("_own", stretch)
    # rows without a time are after no others, once
    both = timed.withColumn("_in", F.explode(F.when(F.col("micros").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(F.col("_own"), F.col("_own") + 1))))
    w = Window.partitionBy("user_id", "_in").orderBy("micros").rangeBetween(-(seconds * 1_000_000 - 1), -1)
    counted = both.withColumn("n", F.count("micros").over(w)).filter("_in <=> _own").drop("_own", "_in")
    return counted.withColumn("over_limit", F.col("n") >= limit).drop("micros")


def quota_usage(jobs: DataFrame, as_of: str, limit: int, active: Iterable[str] = ("queued", "running", "retrying")) -> DataFrame:
    """OP-70: requests per user that are active or of the last day, against a limit."""
    now = F.lit(as_of).cast("timestamp_ntz")
    is_active = F.col("status").isin(*active)
    recent = is_active | (F.col("created_at") > now - F.expr("interval 1 day"))
    used = jobs.groupBy("company_id").agg(F.count_if(recent).alias("used"), F.count_if(is_active).alias("active"))
    return used.withColumn("exceeded", F.col("used") >= limit)


def insert_if_absent(existing: DataFrame, arriving: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """OP-84: rows to insert: the first arrival of each key that does not exist yet."""
    return first_per_key(arriving, keys, *order).join(existing.select(*keys).distinct(), keys, "left_anti")


def constraint_audit(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """OP-12: violations of each rule (SQL that must not be false), all counted in one pass."""
    one = df.agg(*(F.count_if(F.expr(f"not ({e})")).alias(name) for name, e in rules.items()))
    pairs = ", ".join(f"'{n}', {n}" for n in rules)
    return one.select(F.expr(f"stack({len(rules)}, {pairs}) as (rule, violations)"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """OP-12: keys that are not unique."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def literal_search(df: DataFrame, column: str, text: str) -> DataFrame:
    """OP-26: rows whose column holds the text, in any case; nothing in it is a wildcard."""
    return df.filter(F.contains(F.lower(column), F.lower(F.lit(text))))


def all_of(predicates: Iterable[Column | None]) -> Column:
    """OP-27: the conjunction of those predicates that are given."""
    out = F.lit(True)
    for p in predicates:
        out = out if p is None else out & p
    return out


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """OP-63 and OP-76: one page in an order, with the total; the total is an aggregate of its own, not a window over all rows."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((number - 1) * size).limit(size).crossJoin(F.broadcast(total))


def local_window(column: Column, first: str, last: str, zone: str = "America/Lima") -> Column:
    """OP-92: is an instant (UTC) within local days first to last, both included; at most 367 days."""
    lo, hi = F.to_utc_timestamp(F.lit(first), zone), F.to_utc_timestamp(F.date_add(F.lit(last).cast("date"), 1).cast("timestamp"), zone)
    fits = F.datediff(F.lit(last).cast("date"), F.lit(first).cast("date")).between(0, 366)
    return fits & (column >= lo) & (column < hi)


def backoff_minutes(attempt: Column, base: int = 1, most: int = 30) -> Column:
    """OP-92: base * 2^(attempt - 1) minutes, at most ``most``."""
    return F.least(F.lit(most), (F.lit(base) * F.pow(F.lit(2), F.least(attempt, F.lit(20)) - 1)).cast("int"))
