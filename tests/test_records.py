"""Record operators: hot keys in chunks, payloads, envelopes, canonical digests."""

import hashlib
import json
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import records
from tallyforge.sources import keyed


def _hot(spark, parts):
    """One key with nine tenths of all rows, few digests, null digests and ties of time."""
    rng = random.Random(parts)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.randint(0, 400), i, rng.choice(["x", "y", "y", "z", None])) for i in range(1500)]
    rows += [("single", 1, 9000, None), ("twice", 1, 9001, "x"), ("twice", 2, 9002, "x")]
    return spark.createDataFrame(rows, "k string, ts int, id int, digest string").repartition(3)


@pytest.fixture(params=[2, 13])
def ranges(spark, request):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_hot_key_in_chunks_equals_the_window(spark, ranges):
    rows = _hot(spark, ranges)
    spread = records.in_chunks(rows, ["k"], ["ts", "id"]).filter("k = 'hot'").groupBy("chunk").count().collect()
    assert len(spread) >= ranges // 2 and max(r["count"] for r in spread) < 1500 * (0.9 if ranges == 2 else 0.3)
    whole = lambda df: sorted(map(repr, map(tuple, df.select(sorted(df.columns)).collect())))
    for make in (lambda c: records.scd2_versions(rows, ["k"], ["ts", "id"], chunked=c), lambda c: records.change_log(rows, ["k"], ["ts", "id"], ["digest"], chunked=c)):
        assert whole(make(True)) == whole(make(False))


def test_sliding_rate_in_stretches(spark):
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.9 else "x", rng.randint(0, 900)) for i in range(700)] + [(800, None, 5), (801, None, 6), (802, "hot", None)]
    made = spark.createDataFrame(rows, "event_key int, user_id string, at int").withColumn("created_at", F.timestamp_seconds("at")).drop("at")
    got = {r["event_key"]: (r["n"], r["over_limit"]) for r in records.sliding_rate(made, 60, 4).collect()}
    for i, user, at in rows:
        n = 0 if at is None else sum(u == user and t is not None and at - 60 < t < at for _, u, t in rows)
        assert got[i] == (n, n >= 4)
    assert len(got) == len(rows)


def test_first_seen(spark):
    rows = [("s", "d1", 1, 5), ("s", "d1", 1, 2), ("s", "d1", 2, 3), ("s", "d2", 1, 4), ("s", None, 1, 9), ("s", None, 1, 8), ("t", "d1", 1, 1)]
    got = records.first_seen_versions(spark.createDataFrame(rows, "source string, sha string, extractor int, id int"), ["source"], ["sha", "extractor"], ["id"])
    assert sorted((r["source"], r["id"], r["version"], r["is_current"]) for r in got.collect()) == [("s", 2, 1, False), ("s", 3, 2, False), ("s", 4, 3, False), ("s", 8, 4, True), ("t", 1, 1, True)]


def test_payloads(spark):
    good = ['[{"k":1,"a":"1.10","d":0.12345678901234567890}]', '[{"k":null}]', '[{"a":"x"}]', "[]", ' [{"k":"7","d":5},{"k":2.0,"b":true,"l":[1,2]}]', '[{"k":1,"k":2}]']
    bad = ['[{"k":"x"}]', '[{"k":3.5}]', '[{"d":"1,5"}]', '[{"b":"maybe"}]', '{"k":1}', "[1]", '[{"k":1}', None, "", '[{"k":1},null]', '[{"k":99999999999999999999}]', '[{"l":5}]']
    data = spark.createDataFrame(list(enumerate([*good, *bad])), "id int, payload string")
    rows, rejects = records.payload_rows(data, "k bigint, a string, d decimal(30,20), b boolean, l array<int>")
    got = sorted(map(tuple, rows.collect()), key=repr)
    assert got == sorted([(0, 1, "1.10", Decimal("0.12345678901234567890"), None, None), (1, None, None, None, None, None), (2, None, "x", None, None, None), (4, 7, None, Decimal(5), None, None), (4, 2, None, None, True, [1, 2]), (5, 2, None, None, None, None)], key=repr)
    assert sorted(r["id"] for r in rejects.collect()) == list(range(len(good), len(good) + len(bad)))


def test_envelopes(spark):
    wrap = lambda x: f"<s:Envelope><s:Body><Resp>{x}</Resp></s:Body></s:Envelope>"
    cases = {
        '<m:GetResult a="b">[{&quot;k&quot;:1}]</m:GetResult>': '[{"k":1}]', "<GetResult>&#91;&#x31;&#93;</GetResult>": "[1]", "<x.GetResult><![CDATA[[\"<&amp;>\"]]]></x.GetResult>": '["<&amp;>"]', "<preGetResult> a<!-- no -->b </preGetResult>": "ab",
        "<GetResult>&#241;&#x20AC;&#128512;&amp;lt;</GetResult>": "ñ€😀&lt;", "<GetResult>before<b>in</b>after</GetResult>": "before", "<GetResult/>": None, "<GetResult></GetResult>": None, "<Get>1</Get>": None, "<GetResult>a & b</GetResult>": None, "<GetResult>&nope;</GetResult>": None,
        "<GetResult>&#0;</GetResult>": None, "<GetResult>one</GetResult><GetResult>two</GetResult>": "one", "<GetResult\n>line\nline</GetResult>": "line\nline",
    }
    data = spark.createDataFrame([(i, wrap(x)) for i, x in enumerate(cases)] + [(90, None), (91, "<GetResult>open")], "id int, envelope string")
    got = {r["id"]: r["payload"] for r in records.unwrap_envelope(data, "Get").collect()}
    assert got == dict(enumerate(cases.values())) | {90: None, 91: None}


def test_canonical_digest(spark):
    rows = [(1, "é\"\n/", {"b": 1, "a": None}, [1, None], (Decimal("1.50"), True)), (2, None, {}, None, None)]
    schema = "id long, text string, map map<string,int>, list array<int>, deep struct<z: decimal(5,2), a: boolean>"
    df = spark.createDataFrame(rows, schema)
    got = {r["id"]: r["h"] for r in df.select("id", records.canonical_digest(df, ["id", "text", "map", "list", "deep"]).alias("h")).collect()}
    want = ['{"deep":{"a":true,"z":1.50},"id":1,"list":[1,null],"map":{"a":null,"b":1},"text":' + json.dumps('é"\n/', ensure_ascii=False) + "}", '{"deep":null,"id":2,"list":null,"map":{},"text":null}']
    assert got == {i: hashlib.sha256(w.encode()).hexdigest() for i, w in enumerate(want, 1)}
    # another order of columns, fields and keys; a key that is missing
    other = spark.createDataFrame([({"a": None, "b": 1}, 1, (True, Decimal("1.50")), [1, None], "é\"\n/")], "map map<string,int>, id long, deep struct<a: boolean, z: decimal(5,2)>, list array<int>, text string")
    assert other.select(records.canonical_digest(other, other.columns)).first()[0] == got[1]
    fewer = other.withColumn("map", F.expr("map('b', 1)"))
    assert fewer.select(records.canonical_digest(fewer, other.columns)).first()[0] != got[1]


def test_counter_of_rejects_is_whole(spark):
    data = spark.createDataFrame([(i, "[5]" if i % 3 else '[{"k":1}]') for i in range(30)], "id int, payload string")
    rows, rejects = records.payload_rows(data, "k int")
    assert Counter(r["id"] for r in rows.collect()) + Counter(r["id"] for r in rejects.collect()) == Counter(range(30))


def test_keys_are_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    parents = lambda *rows: spark.createDataFrame(rows, "k int, title string")
    children = lambda *rows: spark.createDataFrame(rows, "k int, line int")

    def now():
        return tuple(sorted(map(tuple, keyed.current(spark, root, name, ["k"]).collect())) for name in ("parents", "children"))

    def batch(version, p, c, step=keyed.replace_keys):
        step(root, {"parents": parents(*p), "children": children(*c)}, ["k"], version)

    batch("1", [(1, "a"), (2, "b")], [(1, 1), (1, 2), (2, 1)])
    old = now()
    assert old == ([(1, "a"), (2, "b")], [(1, 1), (1, 2), (2, 1)])
    # a failure between the steps leaves the old state
    batch("2", [(1, "a2"), (3, "c")], [(3, 9)], keyed.stage)
    assert now() == old
    keyed.commit(spark, root, "2")
    new = ([(1, "a2"), (2, "b"), (3, "c")], [(2, 1), (3, 9)])
    assert now() == new
    # batches that are run again change nothing and keep their place
    batch("2", [(1, "a2"), (3, "c")], [(3, 9)])
    batch("1", [(1, "a"), (2, "b")], [(1, 1), (1, 2), (2, 1)])
    assert now() == new


def test_no_rows_of_a_key_is_an_error(spark):
    df = spark.createDataFrame([(" 7 ", 1), ("8", 2)], "k string, v int")
    assert [r["v"] for r in records.rows_of_key(df, "k", 7).collect()] == [1]
    with pytest.raises(LookupError):
        records.rows_of_key(df, "k", "9")
