"""Rules that SQL can't state, against plain readings of them."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from dossier.functions import chunks, fuzzy
from dossier.operators import compare, extracts, fields, retrieval
from dossier.plans import comparison, extraction
from dossier.plans import retrieval as asked


def prose(rng, n):
    """Sentences, blank lines, headings and stray marks."""
    parts = []
    for _ in range(n):
        s = " ".join(rng.choice(("word", "Other", "x", "longerword")) for _ in range(rng.randrange(1, 30)))
        parts.append(s.capitalize() + rng.choice((". ", "! ", "? ", ".\n", "\n\n", " \n \n", "", ": ")))
    return "".join(parts)


def plain_characters(text, size, overlap, least):
    """Every window, by stepping through the text."""
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            marks = [m for m in ("\n\n", ". ", "! ", "? ", ".\n", "!\n", "?\n") if m in text[end - overlap : end + 100]]
            if marks:
                end = end - overlap + text[end - overlap : end + 100].index(marks[0]) + len(marks[0])
        if len(text[start:end].strip()) >= least:
            out.append(text[start:end].strip())
        start = max(start + 1, end - overlap)
    return out


def plain_sentences(text, size, overlap, least):
    todo = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if s.strip()]
    out, chunk = [], []
    while todo:
        if chunk and sum(map(len, chunk)) + len(todo[0]) > size:
            out.append(" ".join(chunk))
            tails = [chunk[i:] for i in range(len(chunk) + 1)]
            chunk = next(t for t in tails if sum(map(len, t)) <= overlap)
            chunk.append(todo.pop(0))
        else:
            chunk.append(todo.pop(0))
    out += [" ".join(chunk)] if chunk else []
    return [x for x in out if len(x) >= least]


def plain_paragraphs(text, most, least, size):
    marks = {m.start() for m in re.finditer(r"\n\s*\n", text)} | {m.start() + 1 for m in re.finditer(r"\.(?=\s+[A-Z])", text)}
    if not marks:
        return [text] if len(text) >= least else []
    bounds, out = sorted(marks), []
    parts = [text[:bounds[0]]] + [text[a + 1 : b] for a, b in itertools.pairwise(bounds)]
    for p in map(str.strip, parts):
        if len(p) >= least:
            out.append(p)
        elif p and out and len(out[-1]) + len(p) <= size:
            out[-1] = out[-1] + " " + p
    last = text[bounds[-1] + 1 :].strip()
    if len(last) >= least:
        out.append(last)
    elif last and out:
        out[-1] = out[-1] + " " + last
    if len(out) <= most:
        return out
    packs = [[out[0]]]
    for p in out[1:]:
        packs.append([p]) if sum(map(len, packs[-1])) + len(p) > size else packs[-1].append(p)
    return [" ".join(p) for p in packs]


def test_chunkers_against_plain_readings():
    rng = random.Random(1)
    for _ in range(150):
        text = prose(rng, rng.randrange(0, 60))
        size, overlap, least = rng.choice(((1000, 200, 200), (120, 40, 30), (60, 50, 1)))
        assert chunks.by_characters(text, size, overlap, least) == plain_characters(text, size, overlap, least)
        assert chunks.by_sentences(text, size, overlap, least) == plain_sentences(text, size, overlap, least)
        assert chunks.by_paragraphs(text, 5, least, size) == plain_paragraphs(text, 5, least, size)


def test_sections_and_plans():
    body = "Word by word. " * 40
    text = f"Start\n# First part\n{body}\nSECOND PART\n{body}\n3. Third\n{body}"
    parts = chunks.by_sections(text)
    assert [p[:9] for p in parts] == ["Start\n# F", "SECOND PA", "3. Third\n"] and " ".join(parts).split() == text.split()
    even = chunks.by_sections("A sentence here. " * 700)
    assert len(even) == 3 and all(p.endswith(".") for p in even) and chunks.by_sections("short") == ["short"]
    assert chunks.plan(499, "fir") == (500, 0, "whole") and chunks.plan(10_001, "court_order") == (1800, 325, "section") and chunks.plan(600, "odd") == (800, 160, "paragraph")
    order = "ORDER\n" + body + "\nSection 2 of it\n" + body * 6
    kinds = chunks.adaptive(order, "court_order")
    assert {k for k, _ in kinds} == {"section"} and kinds[0][1].startswith("ORDER") and len(kinds) >= 3
    packed = chunks.adaptive("\n\n".join(f"Paragraph {i} " + "w " * 100 for i in range(9)), "passport")
    assert all(k == "paragraph" for k, _ in packed) and all(b[1].startswith(a[1][-100:].lstrip()) for a, b in itertools.pairwise(packed))
    assert chunks.section_titles("# Title one\ntext\nLOUD TITLE\nmore text\n2. Numbered\nx") == [("Title one", 4, 0), ("LOUD TITLE", 9, 1), ("Numbered", 1, 2)]
    assert chunks.section_titles("nothing") == [] and chunks.forced(" ab ", 1) == ["a", "b"]


def test_named_and_profiles():
    text = "In the High Court of Vale: the Petitioner: Mira Sen, aged 40. Heard by Justice Otto Lind. Place: Ulmstead; Pin code 400012. Rohan Pal S/o Vikas Pal, Inspector: Hari Lal, was there."
    found = {(c, v, s) for c, v, s, _, _ in extracts.named(text)}
    assert {("person", "Mira Sen", 0.8), ("person", "Hari Lal", 0.8), ("person", "Vikas Pal", 0.75), ("organization", "High Court of Vale", 0.9), ("location", "Ulmstead", 0.75), ("location", "PIN 400012", 0.7)} <= found
    kinds = {(t, n, r) for t, n, r, *_ in extracts.profiles(text)}
    assert {("citizen", "Mira Sen", "Petitioner"), ("officer", "Hari Lal", "Inspector"), ("court", "High Court of Vale", "court"), ("officer", "Justice Otto Lind. Place", "Judge")} <= kinds
    assert extracts.named("") == [] and extracts.profiles("plain words") == []
    for _, value, _, _, at in extracts.named(text):
        assert value.removeprefix("PIN ") in text[at : at + 120]
    # a titled name runs on over points and spaces
    assert extracts.profiles("by Dr. Ada Fox, who")[-1][:3] == ("officer", "Dr. Ada Fox", "Doctor/Official")


def test_timeline(spark):
    text = "The claim was filed at the office on 05/07/2023 by post. It is due by 2024-01-02. " + "x " * 90 + "Signed on 3 April 1990 in Ulm. Nothing happened here, dated 1.2.24 it was."
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = [(r.date, r.date_iso, r.event_type, r.confidence) for r in extracts.document_timeline(rows).orderBy("place").collect()]
    # a date that doesn't parse is sorted by its text
    assert got == [("1.2.24", None, "occurrence", 0.7), ("3 April 1990", "1990-04-03", "occurrence", 0.95), ("05/07/2023", "2023-07-05", "filing", 0.9), ("2024-01-02", "2024-01-02", "filing", 1.0)]


def test_titles_and_fields(spark):
    texts = ["MARRIAGE CERTIFICATE\nName: x", "a line of text\nBirth Certificate\nmore", "name: value\nall small letters\n12345", "one\nTwo\nThree Words Here", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.t for r in rows.select("doc_id", fields.title(F.col("text")).alias("t")).collect()}
    assert got == {0: "MARRIAGE CERTIFICATE", 1: "Birth Certificate", 2: None, 3: "Three Words Here", 4: None}
    held = spark.createDataFrame([(1, "x", "Address: 12 Oak Lane, Ulmstead Gender: Female\nName: Asha Rao ID 7")], "doc_id long, document_type string, text string")
    rules = spark.createDataFrame([("x", f, "string", True) for f in ("address", "gender", "full_name", "purpose")], "document_type string, field string, type string, required boolean")
    found = {r.field: (r.value, r.confidence) for r in fields.schema_fields(held, rules).collect()}
    assert found == {"address": ("12 Oak Lane, Ulmstead", 0.9), "gender": ("Female", 0.9), "full_name": ("Asha Rao ID", 0.9), "purpose": (None, 0.0)}


def test_comparisons(spark):
    rows = [r.asDict() for r in spark.sql(comparison.FIELDS).collect()]

    def canonical(f):
        low = f.lower().replace("_", " ").strip()
        for name, words in (("dob", ("dob",)), ("address", ("address",)), ("phone", ("phone", "mobile", "telephone")), ("email", ("email",))):
            if any(w in low for w in words):
                return name
        return f if f in compare.COMPARABLE else None

    want = {}
    for a, b in itertools.combinations([r for r in rows if (r["value"] or "").strip()], 2):
        f = canonical(a["field"])
        x, y = sorted((a["value"].strip().lower(), b["value"].strip().lower()))
        s = fuzzy.ratio(x, y)
        if f and f == canonical(b["field"]) and a["case_id"] == b["case_id"] and s < 100:
            want[a["case_id"], f, x, y] = "MINOR" if s >= 90 else "MODERATE" if s >= 75 else "MAJOR"
    got = {(r.case_id, r.field, r.a, r.b): r.severity for r in compare.inconsistencies(spark.sql(comparison.FIELDS)).collect()}
    assert got == want and set(want.values()) >= {"MINOR", "MAJOR"}
    stakes = {(r.field, r.a, r.b): (r.severity, r.high_stakes) for r in compare.contradictions(spark.sql(comparison.FIELDS)).collect()}
    assert stakes["full_name", "asha rao", "bo chan"] == ("MAJOR", True) and stakes["colour", "blue", "red"] == ("MAJOR", False)
    diff = {(r.pair_id, r.field): (r.status, r.similarity) for r in compare.graded_diff(spark.sql(comparison.OLD), spark.sql(comparison.NEW)).collect()}
    assert diff == {(1, "full_name"): ("NEAR_MATCH", 0.941), (1, "city"): ("ONLY_IN_A", 0.0), (1, "fee"): ("MATCH", 1.0), (1, "zip"): ("ONLY_IN_B", 0.0), (2, "a"): ("MATCH", 1.0), (2, "b"): ("MATCH", 1.0)}


@pytest.mark.parametrize("threshold", [74.9, 80.0, 95.0])
def test_entity_links(spark, threshold):
    people = [(r.document_id, r.name) for r in spark.sql(comparison.PEOPLE).collect() if r.name]
    want = {(a, b, x.lower(), y.lower()) for (a, x), (b, y) in itertools.permutations(people, 2) if a < b and fuzzy.ratio(x.lower(), y.lower()) >= threshold}
    got = {(r.doc_a, r.doc_b, r.name_a, r.name_b) for r in compare.entity_links(spark.sql(comparison.PEOPLE).withColumn("type", F.lit("person")), threshold).collect()}
    assert got == want
    if threshold == 80:
        assert {(r.doc_a, r.doc_b, r.relation) for r in compare.related_documents(spark.sql(comparison.PEOPLE), spark.sql(comparison.NUMBERS)).collect()} == {("d4", "d5", "same_case"), ("d1", "d2", "shared_party")}
        found = {(r.name_a, r.name_b, r.match): r.documents for r in compare.duplicate_identities(spark.sql(comparison.PEOPLE)).collect()}
        assert found == {("mira sen", "mira sen", "exact"): 2, ("hari lal", "hari lal", "exact"): 2, ("otto lind", "otto lindt", "fuzzy"): 2, ("mira sen", "mira senn", "fuzzy"): 3}


def test_rule_answers(spark):
    notes = spark.sql(extraction.NOTES)
    documents = notes.select("doc_id", "text", F.when(F.col("doc_id") == -12, "Rural Works").alias("department"), F.when(F.col("doc_id") == -14, "verified").alias("status"))
    got = {r.question_id: (r.intent, r.answer, r.confidence) for r in retrieval.rule_answers(spark.sql(asked.QUESTIONS), extracts.everything(notes), documents).collect()}
    # a heading's "by" before a date makes it a deadline too
    assert got[3] == ("deadline", "The deadline is: 12/03/2024.", 0.95)
    assert got[4] == ("department", "This document was issued by: Rural Works.", 0.9)
    assert got[7] == ("amount", "No monetary amounts were found in this document.", 0.5)
    assert got[8] == ("verified", "Yes, this document is verified.", 0.95)
    assert got[10] == ("general", "I could not find specific information to answer this question from the document.", 0.2)
    assert got[11][1].startswith("Amounts found: 2500") and got[2][0] == "ongoing_case" and "hearing" in got[2][1] and got[5][0] == "location"


def test_context_stops_before_the_limit(spark):
    rows = [(1, 1, "a" * 1000, "s", "1"), (1, 2, "b" * 2500, None, None), (1, 3, "c", "s", "2")]
    got = retrieval.numbered_context(spark.createDataFrame(rows, "query_id int, rank int, text string, source string, page string")).first()
    assert got.used == 1 and got.context == "[Document 1 - Source: s, Page: 1]\n" + "a" * 1000 + "\n"


def test_keyed_digest(spark):
    import hashlib
    import hmac

    from dossier.functions import text

    rows = spark.createDataFrame([("",), ("é words",)], "t string")
    for key in (b"k", b"long" * 40):
        got = {r.t: r.h for r in rows.select("t", text.hmac(F.col("t"), key).alias("h")).collect()}
        assert got == {t: hmac.new(key, t.encode(), hashlib.sha256).hexdigest() for t in got}


def test_mentions_by_automaton_and_expression(spark):
    from dossier.operators import joins

    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(("Alpha", "beta", "gam", "ma")) for _ in range(5)) if i else None) for i in range(20)]
    names = ["alpha b", "GAMMA", "ma", "beta", "zz", "Beta"]
    want = {(i, n) for i, t in docs if t for n in names if n.lower() in t.lower()}
    d, n = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in names], "name string")
    assert {tuple(r) for r in joins.mentions(d, n).collect()} == {tuple(r) for r in joins.mentions(d, n, 2, 3).collect()} == want
    held = spark.createDataFrame([(k, x) for k, x in enumerate(names)], "id long, name string")
    asked = d.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    assert {(r.query_id, names[r.id]) for r in joins.named_in(asked, held).collect()} == want


def test_index_recall(spark):
    """The approximate index against brute force, on random and on clustered vectors."""
    import numpy as np

    from dossier.operators import search

    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(1500, 16)), rng.normal(size=(30, 16))[rng.integers(0, 30, 1500)] + rng.normal(scale=0.3, size=(1500, 16))):
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        got = {}
        for r in search.ivf_top_k(table, k=5, every=50, cells=40, sample=500).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        hits = sum(len(got[q] & {i for i in np.argsort(-(u @ u[q])) if i != q and True} & set([i for i in np.argsort(-(u @ u[q])) if i != q][:5])) for q in range(0, 1500, 50))
        assert hits / (5 * 30) >= 0.9
