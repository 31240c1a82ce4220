"""Line dedup, whitening and fill-in-the-middle against plain versions, and their odd input."""

import hashlib
import random
import re
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tallyforge.llm import queries, sql
from tallyforge.llm.fill_in_middle import UnitIndex, fill_in_middle, middle_digests, restored
from tallyforge.llm.line_dedup import SPACES, dedupe_lines, keep_bitmaps, unpack_bitmap
from tallyforge.llm.whitening import fit_whitening, fixed_point, shifted_cholesky, solve_rows, whiten

SCHEMA = "doc_id long, text string, place int, key string, h1 long, said string, n_lines int"
UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)
SMALL = Path("/root/testdata/sf0.001")


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 2, "x", 7) for i, t in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(8)
    long = "\n".join(rng.choice(["one shared line of text", "another shared line", f"its own {i}", ""]) for i in range(20_000))
    return [(1, None), (2, ""), (3, " \n\t \n"), (5, "One TWO three four"), (5, "One TWO three four"), (5, "other text\none two three four"), (6, long), (None, "one shared line of text\nno id"), (None, "one two three four"),
            (7, "ÄÖ äö ñ   ١٢ 漢字 😀\n  ÄÖ äö ñ   ١٢ 漢字 😀\t"), (8, "äö äö ñ   ١٢ 漢字 😀\nÄÖ äö ñ   ١٢ 漢字 😀"), (4, "!!! ...<M>"), (9, "\r\none two THREE four\r\n\n"), (10, "a one two three four\u0085\nshort\nshort"), (11, "short")]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for p in SMALL.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return connection


@pytest.mark.parametrize("name", ["op11_line_dedup", "op13_fill_in_middle"])
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, str(SMALL))
    columns = sorted(found.columns)
    result = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql.ORACLE[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, result))


# ---- line dedup


def plain_dedupe(rows, least=10):
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACES))
    order = lambda i: (i is None, i or 0)
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(order(i))
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == order(i)]
        out.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept)), "\n".join(kept)))
    return sorted(map(repr, out))


def test_line_dedup_odd(spark, odd):
    got = dedupe_lines(table(spark, odd))
    assert sorted(map(repr, map(tuple, got.collect()))) == plain_dedupe(odd)
    assert dedupe_lines(table(spark, [])).collect() == [] and dedupe_lines(table(spark, []), with_text=False).columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]


@pytest.mark.parametrize("parts", [1, 3, 29])
def test_line_dedup_over_ranges(spark, parts):
    """One line in two thirds of the documents, so that its rows fill several ranges; and many small groups."""
    rng = random.Random(parts)
    rows = []
    for i in rng.sample(range(10_000), 600):
        lines = ["a line that most of them hold"] * rng.choice([0, 1, 1, 3]) + [f"shared line number {rng.randint(0, 80)}" for _ in range(rng.randint(0, 6))] + [f"mine {i} {k} only" for k in range(rng.randint(0, 3))]
        rng.shuffle(lines)
        rows.append((i, "\n".join(x.upper() if rng.random() < 0.3 else f"  {x}" for x in lines)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        assert sorted(map(repr, map(tuple, dedupe_lines(table(spark, rows).repartition(5)).collect()))) == plain_dedupe(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_bitmaps(spark):
    rows = [(1, "a shared line\nx"), (2, "y\nA SHARED LINE\nz\na shared line "), (3, "nothing shared here")]
    got = keep_bitmaps(table(spark, rows)).collect()
    assert [(r["doc"], r["n_lines"], r["n_dropped"], unpack_bitmap(r["keep"], 4).tolist()) for r in got] == [(2, 4, 2, [True, False, True, False])]


# ---- fill in the middle


def plain_middle(i, text, seed=1):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return i, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    return (i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else (i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_middle(spark, odd, block):
    rng = random.Random(block)
    rows = [*odd, (12, "<P"), (13, "<"), (14, "<<S"), *((100 + k, "".join(rng.choices("aBc <>PSM\nñ漢😀.", k=rng.randint(1, 60)))) for k in range(300))]
    docs = table(spark, [r for r in rows if block > 1 or len(r[1] or "") < 5000])
    found = fill_in_middle(docs, block=block)
    want = sorted(repr(plain_middle(r["doc_id"], r["text"])) for r in docs.collect())
    assert sorted(map(repr, map(tuple, found.collect()))) == want
    forms = {r["form"] for r in found.collect()}
    assert forms == {"plain", "psm", "spm"}
    back = found.withColumn("t", restored(found["output"], found["form"]))
    assert sorted((str(r["doc_id"]), r["t"]) for r in back.collect()) == sorted((str(r["doc_id"]), r["text"] or "") for r in docs.collect())


def test_middle_digests(spark, odd):
    got = middle_digests(table(spark, odd)).collect()
    want = sorted((repr(plain_middle(i, t)[:5]), sha(plain_middle(i, t)[5]), sha(t or "")) for i, t in odd)
    assert sorted((repr(tuple(r)[:5]), r["output_sha256"], r["restored_sha256"]) for r in got) == want
    assert middle_digests(table(spark, [])).collect() == []


def test_unit_index_cuts_and_edits():
    rng = random.Random(4)
    for _ in range(120):
        text = "".join(rng.choices("abXY ,\n9ñ漢😀", k=rng.randint(0, 90)))
        block = rng.choice([1, 2, 4, 7, 16])
        index = UnitIndex(np.frombuffer(text.encode(), np.uint8), block)
        for _ in range(3):
            units = UNIT.findall(text)
            assert (index.units, index.points) == (len(units), len(text))
            for k in range(len(units) + 1):
                head = "".join(units[:k])
                assert index.cut(k) == (len(head.encode()), len(head))
            more = "".join(rng.choices("ab ñ", k=rng.randint(0, 20)))
            index.append(more.encode())
            text += more
        plain = "".join(rng.choices("ab .", k=40))
        index = UnitIndex(np.frombuffer(plain.encode(), np.uint8), 8)
        k = rng.randrange(5)
        new = "".join(rng.choices("cd ,", k=8))
        index.replace_block(k, new.encode())
        plain = plain[: 8 * k] + new + plain[8 * k + 8 :]
        units = UNIT.findall(plain)
        assert [index.cut(j)[0] for j in range(len(units) + 1)] == [len("".join(units[:j])) for j in range(len(units) + 1)]


# ---- whitening


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, component string, n double")


def plain_whitening(rows):
    """n, deviations and components of a dense eigendecomposition, over long integers."""
    x = np.array([[int(np.floor(np.float64(np.float32(c)) * 256)) for c in v] for _, v in rows])
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    a = fit - s / n
    values, at = np.linalg.eigh(a.T @ a / n)
    return x, fit, n, s, values[::-1], at[:, ::-1].T


def check_whitening(spark, rows, rank=None):
    x, fit, n, s, values, components = plain_whitening(rows)
    got = defaultdict(dict)
    for r in whiten(vectors(spark, rows)).collect():
        got[r["vec_id"]][r["component"]] = r
    k = min(4, x.shape[1])
    rank = k if rank is None else rank
    assert len(got) == len(rows) and all(sorted(g) == list(range(1, k + 1)) for g in got.values())
    signs = {}
    for (i, _), row in zip(rows, x):
        for c in range(k):
            r = got[i][c + 1]
            assert r["n"] == n and r["deviation"] == sum((n * int(e) - int(t)) ** 2 for e, t in zip(row, s))
            if c >= rank:
                assert r["whitened"] is None
                continue
            assert r["identity_error"] < 1e-9 and abs(r["explained"] - values[c] / values.sum()) < 1e-9
            want = (row - s / n) @ components[c] / np.sqrt(values[c])
            sign = signs.setdefault(c, 1 if want * r["whitened"] >= 0 else -1) if abs(want) > 1e-3 else signs.get(c, 1)
            assert abs(want * sign - r["whitened"]) < 1e-7
    return got


def test_whitening_random(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * np.linspace(1, 0.05, 12)).astype(float).tolist()) for i in range(300)]
    check_whitening(spark, rows + [(1000 + i, rows[7][1]) for i in range(200)])


def test_whitening_dependent_and_few(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-200, 200, size=(80, 3)) / 256
    # two dimensions repeat others and one never varies: rank 3
    check_whitening(spark, [(i, [*b, b[0], 2 * b[1], 0.5]) for i, b in enumerate(base.tolist())], rank=3)
    check_whitening(spark, [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0, 2.5, 3.0, 4.0, 7.0]), (3, [0.0, 0.0, 1.0, 0.0, 0.0])], rank=2)
    one = whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(one)] == [(i, c, 1, 0, None, 0.0, None) for i in (1, 2) for c in (1, 2)]
    assert {r["component"] for r in whiten(vectors(spark, [(1, [1.0]), (2, [3.0])])).collect()} == {1}


def test_whitening_ill_conditioned(spark):
    """Singular values over eight orders of magnitude: a plain Gram matrix would lose the small ones."""
    rng = np.random.default_rng(6)
    rows = rng.normal(size=(400, 6)) * [1e7, 1e7, 1e3, 1e3, 1.0, 1.0]
    rows[:, 1] += rows[:, 0]
    fit = vectors(spark, [(i, r.tolist()) for i, r in enumerate(rows)]).transform(fixed_point).select("x").distinct()
    found = fit_whitening(fit)
    x = np.array([r["x"] for r in fit.collect()], float)
    want = np.linalg.svd(x - x.mean(axis=0), compute_uv=False) ** 2 / len(x)
    assert np.abs(found.values / want - 1).max() < 1e-6 and found.varies.all()


def test_whitening_odd(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), i / 7, 0.25 * i * i]) for i in range(20)]
    bad = [(50, None), (51, []), (52, [1.0, None, 2.0]), (53, [nan, 1.0, 2.0]), (54, [inf, 1.0, 2.0]), (55, [1e30, 1.0, 2.0]), (56, [1.0, 2.0])]
    got = whiten(vectors(spark, [*good, *bad, (None, good[3][1]), (4, good[4][1])]))
    ids = [r["vec_id"] for r in got.collect()]
    assert len(ids) == 22 * 3 and {i for i in ids if i is not None} == set(range(20)) and ids.count(None) == 3 and ids.count(4) == 6
    assert whiten(vectors(spark, [])).collect() == [] and whiten(vectors(spark, bad[:3])).collect() == []
    far = whiten(vectors(spark, [(i, [1e9 * i, 1.0]) for i in range(3000)]))
    assert far.filter("deviation is null").count() > 0 and far.filter("identity_error > 1e-6").count() == 0


def test_cholesky_and_substitution():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(30, 5))
    r = shifted_cholesky(a.T @ a, 0.0)
    assert np.allclose(r.T @ r, a.T @ a) and np.allclose(solve_rows(a, r) @ r, a) and np.allclose(np.tril(r, -1), 0)
    assert np.isfinite(shifted_cholesky(np.ones((3, 3)), 0.0)).all() and np.isfinite(shifted_cholesky(np.zeros((3, 3)), 0.0)).all()
