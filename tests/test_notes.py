"""Notes out of page text: against a plain version line by line, and on pages made by hand."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tallyforge.functions import constants as K
from tallyforge.functions.text import fold, unaccent
from tallyforge.operators import notes

SCHEMA = "doc_id string, page int, text string"
TITLES = ["Información general", "Bases de preparación", "Efectivo", "Inventarios", "Patrimonio", "Eventos posteriores"]
MARKER = "Notas a los estados financieros"


def bare(text):
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def test_fold_is_the_decomposition_of_every_character(spark):
    rows = [(c, f"a{chr(c)}b") for c in (*range(1, 0xD800), *range(0xE000, 0x30000))]
    got = spark.createDataFrame(rows, "c int, t string").repartition(8).select("c", "t", unaccent("t").alias("u"), fold("t", lower=False).alias("f"))
    wrong = [r["c"] for r in got.collect() if r["u"] != bare(r["t"]) or r["f"] != " ".join(bare(r["t"]).split())]
    assert not wrong
    row = spark.createDataFrame([("ﬁn ẠB ª ① ²  é 한글  Ǆ",)], "t string").select(fold("t")).first()
    assert row[0] == bare("fin ab a 1 2 e 한글 dž")


def contents(titles):
    return f"Contenido\n{MARKER}\n" + "\n".join(f"{i} {t} ........ {i + 1}" for i, t in enumerate(titles, 1))


def book(titles=TITLES):
    return [contents(titles), *(f"{MARKER}\n{i} {t}\n\nContenido exclusivo de la nota {i}.\n" for i, t in enumerate(titles, 1))]


def changed(page, old, new):
    pages = book()
    pages[page] = pages[page].replace(old, new)
    return pages


def by_hand():
    swapped = book()
    swapped[3], swapped[4] = swapped[4], swapped[3]
    joined = book()
    joined[3] += joined.pop(4)
    headed = [book()[0], *("Empresa S.A.\n" + p.replace(MARKER, f"{MARKER}\nAl 31 de diciembre de 2025\nExpresado en miles\nPágina {i} de 6") for i, p in enumerate(book()[1:], 1))]
    dotted = lambda n: MARKER + "\n" + "\n".join(f"{i}. Cuenta contable\nContenido {i}." for i in range(1, n + 1))
    return {
        "plain": book(), "wrapped": changed(2, "2 Bases de prep", "2 Bases de\nprep"), "missing": changed(4, "4 Inventarios", "Título ilegible"), "twice": changed(4, "la nota 4.", "la nota 4.\n4 Inventarios\nOtra vez."),
        "swapped": swapped, "short of one": book()[:-1], "cells": changed(1, "la nota 1.", "la nota 1.\n2 De enero de 2025\n2 1,500 3,000\n2.1 Detalle"), "joined": joined, "headed": headed,
        "auditor": [*book(), "INFORME DE LOS AUDITORES INDEPENDIENTES\nOpinión sobre las notas a los estados financieros.\nMás."],
        "two titles": [contents(TITLES) + "\n2 Otro ... 9", *book()[1:]], "gap in contents": [contents(TITLES).replace("\n3 Efectivo", "\n9 Efectivo"), *book()[1:]],
        "gap": [dotted(5) + "\n6 X\nilegible\n7. Hechos posteriores\nContenido siete."], "appendix": [dotted(6) + "\nInforme de los auditores independientes\n7. Otra\nDictamen."],
        "lost number": [f"{MARKER}\n1. Uno dos\na\n2. Tres cuatro\nb\n . Juicios, estimados y supuestos contables significativos\nc\n4. Cinco seis\nd\n5. Siete ocho\ne"],
        "two lines": [f"{MARKER}\n1 ESTADO CONSOLIDADO DE SITUACIÓN\nFINANCIERA\nuno\n2 DOS TRES\ndos\n3 CUATRO\ntres\n4 CINCO\ncuatro\n5 SEIS\ncinco", f"{MARKER}\nmás\nInformación suplementaria\nno", "nunca"],
        "no start": ["nada", "1. Uno"], "empty": ["", ""], "few": [dotted(4)],
    }


def test_by_hand(spark):
    data = spark.createDataFrame([(d, i, t) for d, pages in by_hand().items() for i, t in enumerate(pages)], SCHEMA)
    heads = notes.note_headings(data).cache()
    status = {r["doc_id"]: (r["source"], r["status"], len(r["headings"])) for r in heads.collect()}
    good = ("contents", "ok", 6)
    assert status == {
        "plain": good, "wrapped": good, "cells": good, "joined": good, "headed": good, "auditor": good, "missing": ("contents", "missing", 0), "short of one": ("contents", "missing", 0), "twice": ("contents", "ambiguous", 0),
        "swapped": ("contents", "disordered", 0), "two titles": ("contents", "contradictory", 0), "gap in contents": ("contents", "incomplete", 0), "gap": ("sequence", "incomplete", 4), "appendix": ("sequence", "ok", 6),
        "lost number": ("sequence", "ok", 5), "two lines": ("sequence", "ok", 5), "no start": ("sequence", "no_start", 0), "empty": ("sequence", "no_start", 0), "few": ("sequence", "too_few", 0),
    }
    found = {}
    for r in notes.extracted_notes(notes.note_sections(data, heads)).collect():
        found.setdefault(r["doc_id"], {})[r["number"]] = (r["title"], r["start_page"], r["end_page"], r["content"])
    own = {i: (t, i + 1, i + 1, f"Contenido exclusivo de la nota {i}.") for i, t in enumerate(TITLES, 1)}
    assert found["plain"] == found["wrapped"] == found["headed"] == found["auditor"] == own
    assert found["cells"][1][3].endswith("2.1 Detalle") and found["cells"][2] == own[2]
    assert found["joined"][3] == own[3] and found["joined"][4] == ("Inventarios", 4, 4, "Contenido exclusivo de la nota 4.")
    assert found["gap"] == {i: ("Cuenta contable", 1, 1, f"Contenido {i}.") for i in range(1, 5)} and found["appendix"][6][3] == "Contenido 6."
    assert found["lost number"][3] == ("Juicios, estimados y supuestos contables significativos", 1, 1, "c")
    assert found["two lines"][1] == ("ESTADO CONSOLIDADO DE SITUACIÓN FINANCIERA", 1, 1, "uno") and found["two lines"][5] == ("SEIS", 1, 2, "cinco\n\nmás")
    assert notes.note_headings(data.limit(0)).collect() == []


NUMBERED = re.compile(r"[ \t]*([0-9]{1,2})(\.?)[ \t]+([^\n]{3,180})")
KEY = lambda t: " ".join(re.findall("[a-z0-9]+", bare(t).lower()))
CLEAN = lambda t: re.sub("[ –:-]+$", "", " ".join(t.split()))


def plain_lines(text):
    """Candidates of a page: place, end, number, dotted, title and index of the line."""
    out, at, rows = [], 0, text.split("\n")
    for k, line in enumerate(rows):
        m = NUMBERED.match(line)
        if m:
            out.append((at, at + m.end(), int(m[1]), bool(m[2]), m[3], k))
        at += len(line) + 1
    return rows, out


def plain_plausible(title, dotted):
    words = title.rstrip(". ").split()
    if not words or len(title) > 120 or words[-1].lower() in K.TITLE_LAST_WORDS:
        return False
    dated = re.match(r"(De|Del|Al)\b", title) or re.search(r"\b(de|del)\s+[0-9]{1,2}\s+de\b", title, re.IGNORECASE)
    named = len(re.findall("[A-Za-zÁÉÍÓÚÑáéíóúñ]+", title)) >= 2 and title[0].isupper() and not dated
    return dotted or title == title.upper() or bool(named)


def plain_headings(pages):
    """source, status and (number, title, page, start, end) of each heading."""
    parsed = [plain_lines(t) for t in pages]
    listed = [len(c) >= 3 and all(re.search(r"\s[0-9]+\s*$", x[4]) for x in c) for _, c in parsed]
    entries = {}
    for is_list, (_, found) in zip(listed, parsed):
        for x in found if is_list else []:
            title = re.sub(r"[.·… ]*\s[0-9]+\s*$", "", x[4])
            if re.search("[A-Za-zÁÉÍÓÚÑáéíóúñ]", title):
                entries.setdefault(x[2], set()).add(KEY(title))
    if any(len(keys) > 1 for keys in entries.values()):
        return "contents", "contradictory", []
    if entries and set(entries) != set(range(1, len(entries) + 1)):
        return "contents", "incomplete", []
    if len(entries) >= 5:
        hits = {n: [] for n in entries}
        for p, (rows, found) in enumerate(parsed):
            for start, end, number, _, raw, k in [] if listed[p] else found:
                if number not in entries:
                    continue
                wanted, title = min(entries[number]), CLEAN(raw)
                whole = len(NUMBERED.match(rows[k])[0]) == len(rows[k])
                for more in range(4):
                    if KEY(title) == wanted:
                        hits[number].append((p, start, end, title))
                        break
                    nxt = rows[k + more + 1] if k + more + 1 < len(rows) else ""
                    if not wanted.startswith(KEY(title) + " ") or not nxt or not whole:
                        break
                    title, end = CLEAN(f"{title} {nxt}"), end + 1 + len(nxt)
        if not all(hits.values()):
            return "contents", "missing", []
        if any(len(h) > 1 for h in hits.values()):
            return "contents", "ambiguous", []
        order = [hits[n][0] for n in sorted(hits)]
        if order != sorted(order, key=lambda h: h[:2]):
            return "contents", "disordered", []
        return "contents", "ok", [(n, hits[n][0][3], *hits[n][0][:3]) for n in sorted(hits)]
    opens = next((p for p, t in enumerate(pages) if not listed[p] and MARKER.lower() in bare(t).lower() and re.search(r"(?m)^\s*1[.\s]", t)), None)
    if opens is None:
        return "sequence", "no_start", []
    rows = []
    for p in range(opens, len(pages)):
        if listed[p]:
            continue
        end = re.search(rf"(?im)^[ \t]*(?:{K.APPENDIX_BEGINNINGS})\b", pages[p])
        rows += [(p, *x) for x in parsed[p][1] if not end or x[0] < end.start()]
        if end:
            break
    kept = []
    for p, start, stop, number, dotted, raw, _ in rows:
        if number == len(kept) + 1 and plain_plausible(CLEAN(raw), dotted):
            kept.append((number, CLEAN(raw), p, start, stop))
    if not rows:
        return "sequence", "no_start", []
    if len(kept) < 5:
        return "sequence", "too_few", []
    if any(x[3] > len(kept) and plain_plausible(CLEAN(x[5]), x[4]) for x in rows):
        return "sequence", "incomplete", kept[:-1]
    return "sequence", "ok", kept


def test_headings_against_a_plain_version(spark):
    rng = random.Random(11)
    docs = {}
    for d in range(260):
        titles = [rng.choice([*TITLES, "Deuda y otros", "PROPIEDAD", "Partes relacionadas al cierre", "Saldos de"]) for _ in range(rng.randint(3, 9))]
        dot = rng.choice(["", ".", "."])
        pages = [contents(titles)] if rng.random() < 0.5 else []
        if rng.random() < 0.2 and pages:
            pages[0] += f"\n{rng.randint(1, 9)} {rng.choice(titles)} .. 3"
        text = ""
        for n, t in enumerate(titles, 1):
            n = n + 1 if rng.random() < 0.03 else n
            shown = t.replace(" ", "\n", rng.choice([0, 0, 0, 1, 2]))
            if rng.random() < 0.02:
                text += f"{n}{dot} {t}\notra vez\n"
            text += f"{rng.choice(['', ' ', chr(9)])}{n}{dot} {shown}{rng.choice(['', ' -', ' '])}\n" + rng.choice(["cuerpo\n", "\n", "12 de enero de 2025\n", f"{n + 1} De 3 de mayo\n", "31 diciembre y\n", f"{rng.randint(1, 9)}. Otra cosa\n", "  \n"])
            if rng.random() < 0.03:
                text += "Recursos minerales y reservas probadas y probables: ver\n"
            if rng.random() < 0.4:
                pages.append(text)
                text = ""
        pages.append(text)
        marked = [k for k in range(len(pages)) if rng.random() < 0.4] or [0]
        docs[str(d)] = [f"{rng.choice([MARKER, MARKER.upper()])}\n{t}" if k in marked else t for k, t in enumerate(pages)]
    data = spark.createDataFrame([(d, i, t) for d, pages in docs.items() for i, t in enumerate(pages)], SCHEMA)
    found = notes.note_headings(data).select("doc_id", "source", "status", F.expr("transform(headings, h -> struct(h.number, h.title, h.page, h.start, h.end))").alias("h"))
    got = {r["doc_id"]: (r["source"], r["status"], [tuple(h) for h in r["h"]]) for r in found.collect()}
    want = {d: plain_headings(pages) for d, pages in docs.items()}
    assert {d: (got[d], want[d], docs[d]) for d in docs if got[d] != want[d]} == {}
    assert {w[:2] for w in want.values()} >= {("contents", s) for s in ("ok", "missing", "ambiguous", "contradictory", "incomplete")} | {("sequence", s) for s in ("ok", "too_few", "incomplete")}


def test_fragments_replace_those_of_the_same_place(spark):
    docs = spark.createDataFrame([("a", 7)], "doc_id string, company_id int")
    sections = spark.createDataFrame([("a", 1, "T", 0, 0, "uno"), ("a", 1, "T", 1, 1, "dos"), ("b", 1, "U", 0, 0, "no")], "doc_id string, number int, title string, page int, section_order int, section string")
    known = spark.createDataFrame([(7, "a", 1, 2, 1, "old", "old"), (7, "a", 9, 1, 0, "kept", "kept"), (8, "c", 1, 1, 0, "kept", "kept")], "company_id int, doc_id string, number int, page int, fragment_order int, heading string, body string")
    got = sorted(map(tuple, notes.note_fragments(docs, sections, known).collect()))
    assert got == [(7, "a", 1, 1, 0, "T", "uno"), (7, "a", 1, 2, 1, "T", "dos"), (7, "a", 9, 1, 0, "kept", "kept"), (8, "c", 1, 1, 0, "kept", "kept")]
    assert notes.note_fragments(docs, sections).count() == 2


def test_steps_of_contents_are_made_once(spark):
    """A filter on the hit would be moved down to the join and hold every step over, so that titles are folded many times."""
    schema = "doc_id long, page int, start int, end int, number int, numbered boolean, contents boolean, title string, tail string"
    rows = spark.createDataFrame([(1, 1, 0, 9, 1, True, False, "Cuentas", "\npor cobrar\na terceros\ntexto"), (1, 2, 0, 9, 2, True, False, "Caja", "\n" + "x" * 4000), (1, 3, 0, 9, 3, True, False, "Otros", "\npasivos")], schema)
    entries = spark.createDataFrame([(1, 1, "cuentas por cobrar a terceros"), (1, 2, "caja"), (1, 3, "otros activos")], "doc_id long, number int, key string")
    matched = notes.match_contents(entries, rows)
    assert {(r["number"], r["title"], r["end"]) for r in matched.collect()} == {(1, "Cuentas por cobrar a terceros", 9 + 11 + 11), (2, "Caja", 9)}
    plan = matched._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") < 14


def test_phrases_in_texts_as_they_stand(spark):
    from tallyforge.functions.text import folded_like, may_begin

    texts = ["NOTAS a los Estados", "ñótàs á lös èstados", "ｎotas a los estados", "notas a los", "xx notas a los estados", "ñotas a los estados", ""]
    c = F.col("t")
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", folded_like(c, "notas a los estados").alias("holds"), folded_like(c, "notas a los estados", begins=True).alias("begins"), may_begin(c, "n").alias("may"), notes.plain(c).alias("plain"))
    for r in found.collect():
        assert (r["holds"], r["begins"]) == ("notas a los estados" in r["plain"], r["plain"].startswith("notas a los estados")), r
        assert r["may"] or not r["plain"].startswith("n")


def test_no_table_of_documents_goes_through_the_driver(spark, tmp_path):
    """The file of kept headings is small, as titles are alike; its rows are not, so its size must choose no broadcast."""
    data = spark.createDataFrame([(str(d), i, t) for d in range(40) for i, t in enumerate(book())], SCHEMA)
    data.write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    heads = notes.note_headings(pages)
    heads.write.parquet(str(tmp_path / "heads"))
    sections = notes.note_sections(pages, spark.read.parquet(str(tmp_path / "heads")))
    plans = [str(x._jdf.queryExecution().executedPlan()) for x in (heads, sections)]
    assert [p.count("Broadcast") for p in plans] == [0, 0] and all("SortMergeJoin" in p for p in plans)
    assert sections.count() == 240


def plain_heads(text):
    top = [x for x in (" ".join(x.split()) for x in text.splitlines()) if x][:6]
    at = next((k for k, x in enumerate(top[:4]) if bare(x).lower().startswith(MARKER.lower())), None)
    return set() if at is None else set(top[: at + 3])


def test_lines_around_the_marker_against_a_plain_version(spark):
    rng = random.Random(5)
    piece = lambda: rng.choice([MARKER, MARKER.upper(), "Nótas  a\tlos estados financieros", "notas", "Empresa S.A.", "  x  y", "\u3000", " ", "", "ｎotas a los estados financieros", "\xa0" + MARKER])
    texts = ["".join(piece() + rng.choice(["\n", "\r\n", "\r", "\x0b", "\x85", "\u2028", "\n \n"]) for _ in range(rng.randint(0, 11))) + piece() for _ in range(400)]
    found = notes.repeated_headers(spark.createDataFrame([(str(k), 0, t) for k, t in enumerate(texts)], SCHEMA), 1)
    got = {}
    for r in found.collect():
        got.setdefault(r["doc_id"], set()).add(r["line"])
    assert {k: (got.get(str(k), set()), plain_heads(t), t) for k, t in enumerate(texts) if got.get(str(k), set()) != plain_heads(t)} == {}


def test_tails_end_before_a_line_that_no_title_has(spark):
    """An entry in forms that fold to several characters lets titles go on in longer lines; else what is kept stays short."""
    wide = "㎉" * 60
    one = [p.replace("Bases de preparación", f"Bases {wide}") if k == 0 else p.replace("Bases de preparación", "Bases\n" + "kcal" * 60) for k, p in enumerate(book())]
    long = [p.replace("\n\nContenido", "\ndos\n" + "largo " * 50 + "\nContenido") for p in book()]
    data = spark.createDataFrame([(d, k, t) for d, pages in (("wide", one), ("long", long)) for k, t in enumerate(pages)], SCHEMA)
    tails = {r["tail"] for r in notes._parts(data.filter("doc_id = 'long'"), notes.USUAL_KEY).collect() if r["number"] is not None}
    assert tails == {"", "\ndos"}
    assert {(r["tail"] or "").count("\n") for r in notes.note_candidates(data.filter("doc_id = 'long'")).collect()} == {0, 3}
    found = {r["doc_id"]: (r["status"], [h["title"] for h in r["headings"]]) for r in notes.note_headings(data).collect()}
    assert found == {"wide": ("ok", [TITLES[0], "Bases " + "kcal" * 60, *TITLES[2:]]), "long": ("ok", TITLES)}


def test_texts_of_sections_move_once(spark):
    data = spark.createDataFrame([(str(d), i, t) for d in range(3) for i, t in enumerate(book())], SCHEMA)
    sections = notes.note_sections(data, notes.checkpointed(notes.note_headings(data)))
    plan = str(sections._jdf.queryExecution().executedPlan())
    keys = {re.sub(r"#\d+L?", "", x) for x in re.findall(r"hashpartitioning\((.*?), \d+\)", plan)}
    assert keys == {"doc_id", "doc_id, line"}
    assert sections.count() == 18
