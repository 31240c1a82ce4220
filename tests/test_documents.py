"""Document, matching, search and record operators against plain versions."""

import itertools
import random
import re
import unicodedata
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tallyforge.functions import constants as K
from tallyforge.functions.text import digest, fold, squash
from tallyforge.operators import documents as docs
from tallyforge.operators import matching, records, search
from tallyforge.sources.shared import write_partitions


def test_fold(spark):
    row = spark.createDataFrame([("  Énergía\t Ñandú\n",)], "t string").select(fold("t"), squash("t"), digest("t", F.lit(None)) == digest("t", F.lit(""))).first()
    assert tuple(row) == ("energia nandu", "energianandu", False)


def test_accept_sequence(spark):
    heads = [("a", p, 0, n, f"T {n}", True) for p, n in enumerate([1, 2, 7, 3, 4, 5])]
    full = [("b", p, 0, n, f"T {n}", True) for p, n in enumerate(range(1, 7))]
    rows = spark.createDataFrame([*heads, *full, ("c", 0, 0, 1, "x", True), ("d", 0, 0, 1, "x", False)], "doc_id string, page int, start int, number int, title string, plausible boolean")
    got = {r["doc_id"]: (r["status"], len(r["headings"])) for r in docs.accept_sequence(rows).collect()}
    assert got == {"a": ("incomplete", 4), "b": ("ok", 6), "c": ("too_few", 0), "d": ("too_few", 0)}


def test_reconcile_index(spark):
    index = [(d, n, f"Título {n}") for d in "abcde" for n in range(1, 6)]
    index.append(("b", 2, "otro"))
    index = [r for r in index if not (r[0] == "c" and r[1] == 3)]
    body = [(d, n, 0, n, f"titulo {n}") for d in "abce" for n in range(1, 6)] + [("d", 9 - n, 0, n, f"titulo {n}") for n in range(1, 6)] + [("e", 20, 0, 2, "titulo 2")]
    got = docs.reconcile_index(spark.createDataFrame(index, "doc_id string, number int, title string"), spark.createDataFrame(body, "doc_id string, page int, start int, number int, title string"))
    assert {r["doc_id"]: r["status"] for r in got.collect()} == {"a": "ok", "b": "contradictory", "c": "incomplete", "d": "disordered", "e": "ambiguous"}


def test_sections(spark):
    pages = spark.createDataFrame([(1, 0, "1. A one"), (1, 1, "more 2. B two")], "doc_id int, page int, text string")
    heads = spark.createDataFrame([(1, 1, 0, 0, 4), (1, 2, 1, 5, 9)], "doc_id int, number int, page int, start int, body int")
    got = sorted((r["number"], r["page"], r["section"]) for r in docs.slice_sections(pages, heads).collect())
    assert got == [(1, 0, " one"), (1, 1, "more "), (2, 1, "two")] or got == [(1, 0, " one"), (1, 1, "more "), (2, 1, " two")]


def _greedy_evidence(rows):
    taken, used = [], {}
    for score, page, order, fragment, words in sorted(rows, key=lambda r: (-r[0], *r[1:4])):
        if used.get(fragment, 0) >= 2 or any(len(words & w) / len(words | w) >= 0.62 for _, w in taken):
            continue
        taken.append((order, words))
        used[fragment] = used.get(fragment, 0) + 1
        if len(taken) == 3:
            break
    return [o for o, _ in taken]


def test_select_evidence_is_the_greedy_choice(spark):
    rng = random.Random(7)
    vocabulary = ["alfa", "beta", "gama", "delta", "omega", "sigma", "lambda"]
    data, expected = [], {}
    for g in range(40):
        rows = []
        for o in range(rng.randint(1, 12)):
            words = sorted(set(rng.choices(vocabulary, k=rng.randint(1, 6))))
            rows.append((float(rng.randint(1, 3)), o // 4, o, o // 4, frozenset(words)))
            data.append((g, o // 4, o // 4, o, " ".join(words), rows[-1][0]))
        expected[g] = _greedy_evidence(rows)
    df = spark.createDataFrame(data, "g int, fragment int, page int, ord int, sentence string, score double")
    got = {}
    for r in sorted(docs.select_evidence(df, ["g"]).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["g"], []).append(r["ord"])
    assert got == expected


def test_evidence_words_do_not_move(spark):
    df = spark.createDataFrame([(1, 0, 0, 0, "alfa beta", 1.0)], "g int, fragment int, page int, ord int, sentence string, score double")
    plan = docs.select_evidence(df, ["g"])._jdf.queryExecution().optimizedPlan().toString()
    # they were made of every sentence before its group was known
    assert "regexp_extract_all" in plan.split("Aggregate [", 1)[0] and "regexp_extract_all" not in plan.split("Aggregate [", 1)[1]


def test_sentences_by_plain_patterns(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices([" ", " ", "\t", "\n", "\x85", " ", "\x1c", " ", "a", "é", "-", ".", "!", "B", "(", ")", "1"], k=rng.randint(0, 40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    white = F.trim(F.regexp_replace(F.regexp_replace("text", K.LEADING_PAGE_NUMBER, ""), "[\\x00-\\x20\\x{85}-\\x{2029}&&[\\s\\x1C-\\x1F\\x{85}\\x{1680}\\x{2028}\\x{2029}]]+", " "))
    parts = F.transform(F.split(white, K.SENTENCE_BOUNDARY, -1), lambda x: F.regexp_replace(x, r"^[ \-]+|[ \-]+$", ""))
    want = df.select("id", F.posexplode(F.filter(parts, lambda x: x != "")).alias("ord", "sentence"))
    assert sorted(map(tuple, docs.sentences(df).collect())) == sorted(map(tuple, want.collect()))


def test_narrative_counts_as_told(spark):
    def prose(c):
        n, numbers = len(c), len(re.findall(r"\b[0-9][0-9.,]*", c, re.ASCII))
        letters, digits = sum(unicodedata.category(x)[0] == "L" for x in c), sum(unicodedata.category(x) == "Nd" for x in c)
        return 70 <= n <= 560 and letters >= 0.48 * n and digits <= 0.18 * n and numbers < 4 and c.count("_") <= 3 and len(re.split(r"\s+", c, flags=re.ASCII)) >= 11

    rng = random.Random(12)
    pieces = ["casa", "y", "añil", "ab", ".", "- -", "(x)", "...", "12", "_", "٣٣", "𝒳𝒴", "1,5"]
    texts = [" ".join(rng.choices(pieces, weights=[rng.choice((5, 9) if k < 4 else (0.01, 0.01, 1)) for k in range(len(pieces))], k=rng.randint(8, 60))) for _ in range(800)]
    texts += [" ".join(["letra"] * k) for k in (10, 11, 12)] + ["_ a_ b_ " + " ".join(["palabra"] * 12) + x for x in ("", " _", " ____")]
    got = {r["id"] for r in docs.narrative(spark.createDataFrame(list(enumerate(texts)), "id int, sentence string")).collect()}
    want = {i for i, c in enumerate(texts) if prose(c)}
    assert got == want and 50 < len(want) < 750


def test_greedy_pairs_is_one_by_one(spark):
    rng = random.Random(3)
    data, expected = [], set()
    for g in range(25):
        pairs = [(rng.choice([0.5, 0.6, 0.7]), c, p) for c, p in itertools.product(range(5), range(5)) if rng.random() < 0.6]
        seen_c, seen_p = set(), set()
        for s, c, p in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
            if c not in seen_c and p not in seen_p:
                seen_c.add(c)
                seen_p.add(p)
                expected.add((str(g), c, p))
        data += [(str(g), "x", c, p, s) for s, c, p in pairs]
    got = matching.greedy_pairs(spark.createDataFrame(data, "company string, scope string, current_number int, previous_number int, score double"))
    assert {(r["company"], r["current_number"], r["previous_number"]) for r in got.collect()} == expected


def test_components_and_rounds_are_one_by_one(spark, monkeypatch):
    """Groups too large for one task: several components, and some too large as well."""
    rng = random.Random(9)
    data, expected = [], set()
    for g in range(6):
        # blocks of numbers that are connected inside only, and one large block
        pairs = [(rng.choice([0.5, 0.6, 0.7]), b * 10 + c, b * 10 + p) for b in range(5) for c, p in itertools.product(range(4 if b else 9), repeat=2) if rng.random() < 0.5]
        seen_c, seen_p = set(), set()
        for s, c, p in sorted(pairs, key=lambda x: (-x[0], x[1], x[2])):
            if c not in seen_c and p not in seen_p:
                seen_c.add(c)
                seen_p.add(p)
                expected.add((str(g), c, p))
        data += [(str(g), "x", c, p, s) for s, c, p in pairs]
    pairs = spark.createDataFrame(data, "company string, scope string, current_number int, previous_number int, score double")
    for most in (1000, 20, 0):
        got = {(r["company"], r["current_number"], r["previous_number"]) for r in matching.greedy_pairs(pairs, most).collect()}
        assert got == expected


def test_a_falling_chain_needs_no_more_tables(spark, monkeypatch):
    """Each pair of the chain scores less than the one before, so each choice waits for another."""
    written = []
    monkeypatch.setattr(matching, "checkpointed", lambda df: written.append(1) or df.checkpoint())
    used = []
    for n in (10, 20):
        chain = [("c", "x", (k + 1) // 2, k // 2, 0.9 - k / 100) for k in range(2 * n)]
        written.clear()
        got = matching.greedy_pairs(spark.createDataFrame(chain, "company string, scope string, current_number int, previous_number int, score double"))
        assert {(r["current_number"], r["previous_number"]) for r in got.collect()} == {(k, k) for k in range(n)}
        used.append(len(written))
    assert used == [1, 1]


def test_quotes_are_found_by_their_runs(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["a", "bb", "c.", "dd", "é"], k=rng.randint(0, 40))) for _ in range(60)] + [None, ""]
    quotes = []
    for t in texts[:40]:
        words = t.split()
        if len(words) > 3:
            k = rng.randrange(len(words) - 2)
            quotes.append(("  ".join(words[k : k + rng.randint(1, 12)]))[rng.randint(0, 1) :])
    q = spark.createDataFrame([(i, x) for i, x in enumerate([*quotes, None, "zz yy xx"])], "citation_id int, quote string")
    f = spark.createDataFrame(list(enumerate(texts)), "fragment_id int, text string")
    want = {(i, j) for i, x in enumerate(quotes) for j, t in enumerate(texts) if len(x.split()) >= 3 and " ".join(x.split()) in " ".join((t or "").split())}
    assert {tuple(r) for r in docs.find_quotes(q, f).collect()} == want and len(want) > 30
    assert docs.find_quotes(q.limit(0), f).collect() == []


def test_small_groups_share_tasks_and_are_matched_once(spark, capsys):
    rng = random.Random(12)
    data = [(f"c{g}", "s", c, p, rng.choice([0.5, 0.7, 0.9])) for g in range(300) for c in range(3) for p in range(3)]
    taken, free = set(), set()
    for company, _, c, p, _ in sorted(data, key=lambda r: (-r[4], r[2], r[3])):
        if (company, "c", c) not in free and (company, "p", p) not in free:
            free |= {(company, "c", c), (company, "p", p)}
            taken.add((company, c, p))
    got = matching.greedy_pairs(spark.createDataFrame(data, "company string, scope string, current_number int, previous_number int, score double"))
    assert {(r["company"], r["current_number"], r["previous_number"]) for r in got.collect()} == taken
    got.explain()
    assert "FlatMapGroups" not in capsys.readouterr().out  # one call of Python a group took most of the time
    notes = spark.createDataFrame([("c", "s", 1, "Deuda financiera", "debt")], "company string, scope string, note_number int, title string, topic string")
    matching.match_notes(notes, notes).explain()
    assert "InPandas" not in capsys.readouterr().out  # the choice is kept, not made again for each side


def test_tied_notes_are_all_matched(spark):
    schema = "company string, scope string, note_number int, title string, topic string"
    cur = spark.createDataFrame([("c", "s", i, "Deuda financiera corriente", "debt") for i in range(150)], schema)
    prev = spark.createDataFrame([("c", "s", 1000 + i, "Deuda financiera corriente neta", "debt") for i in range(150)], schema)
    got = matching.match_notes(cur, prev).collect()
    assert {(r["current_number"], r["previous_number"], r["status"]) for r in got} == {(i, 1000 + i, "matched") for i in range(150)} and len(got) == 150


def test_similarity_and_match(spark):
    schema = "company string, scope string, note_number int, title string, topic string"
    cur = spark.createDataFrame([("c", "s", 1, "Deuda financiera y préstamos", "debt"), ("c", "s", 2, "Hechos posteriores", "x"), ("c", "s", 3, "Inventarios", "other")], schema)
    prev = spark.createDataFrame([("c", "s", 1, "Deuda financiera prestamos corrientes", "debt"), ("c", "s", 5, "Eventos subsecuentes al cierre", "x"), ("c", "s", 6, "Patrimonio", "other")], schema)
    scored = {(r["current_number"], r["previous_number"]): r["score"] for r in matching.similar_pairs(cur, prev).collect()}
    ratio = SequenceMatcher(None, "deuda financiera y prestamos", "deuda financiera prestamos corrientes").ratio()
    assert scored[(1, 1)] == round(round(0.75 * 0.8 + ratio * 0.2, 4) + 0.08, 4)
    assert scored[(2, 5)] == 0.88
    status = {(r["current_number"], r["previous_number"]): r["status"] for r in matching.match_notes(cur, prev).collect()}
    assert status == {(1, 1): "matched", (2, 5): "matched", (3, None): "current_only", (None, 6): "previous_only"}


def test_search(spark):
    f = spark.createDataFrame([(1, "Deuda", "la deuda financiera crece"), (2, "Otra", "financiera sin deuda"), (3, None, "nada")], "fragment_id int, heading string, body string")
    table = search.postings(f)
    ids = lambda q: {r["fragment_id"] for r in search.search_terms(table, q).collect()}
    assert ids('"deuda financiera"') == {1} and ids("deuda financiera") == {1, 2} and ids("deuda -crece") == {2} and ids("nada or crece") == {1, 3} and ids("  ") == set()
    rank = {r["fragment_id"]: r["rank"] for r in search.search_ranked(table, "deuda financiera").collect()}
    assert rank[1] > 0 and rank[2] > 0
    assert search.headline(f, ["crece"]).collect()[0]["headline"].endswith("crece")


def test_citations(spark):
    f = spark.createDataFrame([(1, "uno dos  tres\ncuatro."), (2, None)], "fragment_id int, text string")
    c = spark.createDataFrame([(1, 1, "dos tres cuatro"), (2, 2, "dos"), (3, 9, "x"), (4, 1, " ")], "citation_id int, fragment_id int, quote string")
    assert {r["citation_id"]: r["accepted"] for r in docs.check_citations(c, f).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert [tuple(r) for r in docs.find_quotes(c.select("citation_id", "quote"), f).collect()] == [(1, 1)]


def test_header_scales(spark):
    cases = [("En miles de soles", "PEN", "thousands"), ("En miles de dólares", "PEN", None), ("En miles y millones de soles", "PEN", None), ("Expresado en dolares", "USD", "units"), ("En miles de soles", None, None)]
    rows = spark.createDataFrame(cases, "h string, c string, want string").select("want", docs.explicit_scale(F.col("h"), F.col("c")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in rows)


def test_scd2_and_change_log(spark):
    rows = spark.createDataFrame([("k", i, x) for i, x in enumerate(["a", "a", "b", "a", None, None])], "k string, t int, digest string")
    got = [(r["t"], r["version"], r["is_current"], r["is_reversion"]) for r in records.scd2_versions(rows, ["k"], ["t"]).orderBy("t").collect()]
    assert got == [(0, 1, False, False), (2, 2, False, False), (3, 3, False, True), (4, 4, True, False)]
    assert [r["kind"] for r in records.change_log(rows, ["k"], ["t"], ["digest"]).orderBy("t").collect()] == ["insert", "update", "update", "update"]


def test_rerun_changes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, p string")
    for _ in range(2):
        write_partitions(df, str(tmp_path / "t"), "p")
    write_partitions(df.filter("p = 'x'"), str(tmp_path / "t"), "p")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_payload_rejects(spark):
    rows, bad = records.payload_rows(spark.createDataFrame([(1, '[{"k": 1.5}, {"k": null}]'), (2, "{oops")], "id int, payload string"), "k decimal(30,6)")
    assert rows.count() == 2 and [r["id"] for r in bad.collect()] == [2]


def test_form_fields(spark):
    html = (
        '<INPUT type="hidden" name="state" value="a&amp;b"><input name="state" type="hidden" value="c"><input type="text" name="free" value="x"><input type="hidden" value="y">'
        '<select name="other"><option value="9">Alpha</option></select><select id="s" name="company"><option>none</option><option value="1">Álpha S.A.</option><option selected value="2"> Beta &amp; Co </option><option value="3">beta co.</option></select>'
        '<a id="grid_1" title="pdf" href=" one.pdf "><a id="grid_2" title="file Xbrl" href="two"><a id="menu" href="three"><a href="four" id="x_grid_3">'
    )
    forms = docs.form_fields(spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id int, html string"), "company", "grid")
    got = {r["page_id"]: r for r in forms.collect()}
    assert got[1]["hidden"] == {"state": "c"} and got[1]["links"] == ["one.pdf", "four"]
    assert [tuple(o) for o in got[1]["options"]] == [("1", "Álpha S.A."), ("2", "Beta & Co"), ("3", "beta co.")]
    assert all(got[k]["hidden"] == {} and got[k]["options"] == [] and got[k]["links"] == [] for k in (2, 3))
    wanted = spark.createDataFrame([(1, "ALPHA SA"), (1, "Beta Co"), (1, "Gamma"), (2, "Alpha"), (9, "Alpha"), (1, None)], "page_id int, name string")
    found = {(r["page_id"], r["name"]): (r["matches"], r["code"]) for r in docs.match_option(forms, wanted).collect()}
    assert found == {(1, "ALPHA SA"): (1, "1"), (1, "Beta Co"): (2, None), (1, "Gamma"): (0, None), (2, "Alpha"): (0, None), (9, "Alpha"): (0, None), (1, None): (0, None)}


def test_presentation_policy(spark):
    say = "Los estados financieros se presentan en miles de soles"
    base = "Bases de preparación."
    pages = [
        (1, 2, f"{base} {say}, excepto donde se indique de otro modo."),
        (1, 3, f"{base} {say}."),
        (2, 1, f"{base} {say}, excepto los importes por acción."),
        (3, 1, f"{say}."),
        (4, 1, f"{base} {say}."),
        (4, 2, "Moneda de presentación. Estos estados financieros se expresan en millones de soles."),
        (5, 1, f"{base} {say} y miles de dólares."),
        (6, 1, None),
        (7, 1, f"{base} {say}. Los estados financieros se presentan sin unidad."),
    ]
    rows = docs.presentation_policy(spark.createDataFrame(pages, "doc_id int, page int, text string"), "PEN").collect()
    assert [(r["doc_id"], r["scale"], r["page"], r["exception"]) for r in rows] == [(1, "thousands", 2, "excepto donde se indique de otro modo")]


def test_links_by_host_and_suffix(spark):
    html = '<a href="/b.pdf"><a href="https://other.org/c.pdf"><a href="d.PDF?x=1"><a href="e.html"><a href="https://u@site.org/f.pdf"><a href="https://site.org:443/g.pdf">'
    rows = [(1, "https://site.org/x/page.html", html), (2, "https://site.org/own.pdf#p", html), (3, "https://away.org/own.pdf", html)]
    got = {}
    for r in docs.link_discovery(spark.createDataFrame(rows, "page_id int, url string, html string"), hosts=["site.org"], suffix=".pdf").orderBy("page_id", "rank").collect():
        got.setdefault(r["page_id"], []).append(r["link"])
    # a page that is the file itself is its only link, if its host may be read
    assert got == {1: ["https://site.org/b.pdf", "https://site.org/x/d.PDF?x=1", "https://site.org:443/g.pdf"], 2: ["https://site.org/own.pdf"], 3: ["https://site.org:443/g.pdf"]}


def test_tokens_that_cannot_fold_to_a_word_are_passed_over(spark):
    from tallyforge.functions.text import may_squash_to, squash

    tokens = ["With", "«wíth»,", "w-i-t-h", "ｗith", "within", "swith", "", "--", "ŵith", "fr0m", "FROM.", "日本", "ẃith"]
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", may_squash_to(c, ["with", "from"]).alias("may"), squash(c).isin("with", "from").alias("is"))
    found = rows.collect()
    assert all(r["may"] for r in found if r["is"]) and {r["t"] for r in found if r["is"]} == {"With", "«wíth»,", "w-i-t-h", "ｗith", "ŵith", "FROM.", "ẃith"}
    assert not any(r["may"] for r in found if r["t"] in ("within", "swith", "fr0m", "", "--"))
    one = spark.createDataFrame([(1, "no hit here"), (2, "a b <i>With</i> c d")], "fragment_id long, body string")
    assert [tuple(r) for r in search.headline(one, ["with"]).collect()] == [(2, "a b With c d")]
