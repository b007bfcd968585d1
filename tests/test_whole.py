"""Operators do the whole of their job, where other tests are unlikely to look."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from dossier import queries as _  # noqa: F401
from dossier.functions import chunks, needs
from dossier.operators import checks, extracts, fields, graph, joins, search
from dossier.plans import verification
from dossier.registry import QUERIES


def test_hamming_bit_in_each_byte(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) - 2**63 for _ in range(5)]
    signed = lambda x: (x + 2**63) % 2**64 - 2**63
    hashes = base + [signed(h ^ 0x0101010101010101) for h in base]
    table = spark.createDataFrame(list(enumerate(hashes)), "id long, hash long")
    for most in (8, 0, 20, 63):
        got = {(r.a, r.b): r.distance for r in joins.hamming_pairs(table, most).collect()}
        want = {(i, j): ((hashes[i] ^ hashes[j]) % 2**64).bit_count() for i in range(10) for j in range(i + 1, 10)}
        assert got == {k: n for k, n in want.items() if n <= most}


def test_graph_of_all_lineitems(spark, tmp_path):
    rng = random.Random(4)
    items = [(rng.randrange(25), rng.randrange(40), float(q % 50 + 1), q % 11 / 100) for q in range(40)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long, l_quantity double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = {(f"s{s}", f"p{p}") for s, p, *_ in items}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)

    def within(node, steps):
        seen = {node: 0}
        for h in range(1, steps + 1):
            for x in [x for n, at in seen.items() if at == h - 1 for x in near[n]]:
                seen.setdefault(x, h)
        return seen

    run = lambda name: sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    smallest = {n: min(within(n, len(near))) for n in near}
    assert run("connected_components_all") == sorted(smallest.items())
    groups = {c: [n for n in near if smallest[n] == c] for c in set(smallest.values())}
    assert len(groups) > 2
    counts = [(c, len(g), sum(smallest[a] == c for a, _ in edges)) for c, g in groups.items() if len(g) >= 3]
    assert run("clusters_all") == sorted((c, n, e, round(e / (n * (n - 1)), 6)) for c, n, e in counts)
    assert run("subgraph_2hop_all") == sorted((a, n, h) for a in {a for a, _ in edges} for n, h in within(a, 2).items())
    assert run("degree_centrality_all") == sorted((n, len(x), round(len(x) / (len(near) - 1), 6)) for n, x in near.items())


def test_key_sentence_places_and_honorifics(spark):
    middle = "Nothing of any weight stands here."
    parts = ["It was sent on 01/02/2024 to all of us.", "It was read on 02/02/2024 by nobody.", "It was lost on 03/02/2024 once more.", "It was found on 04/02/2024 in a box.", middle, "The word key was told to Shri No there.", "The word key was told to no one there.", middle, "It was sold on 05/02/2024 for little.", "It was over on 06/02/2024 at last."]
    rows = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
    got = [(r.sentence, r.score) for r in search.key_sentences(rows, ["key"]).orderBy("rank").collect()]
    assert got == [(parts[i], s) for i, s in [(0, 0.2), (1, 0.2), (2, 0.2), (5, 0.2), (8, 0.2), (9, 0.2), (6, 0.15)]]


def test_extracted_items(spark):
    from dossier.operators import extracts

    text = "Read on 1.2.2024 and 3/4/24. " + "x " * 50 + "Pay before May 5, 2025, or 6 June 2025; not after 2025-07-08. Fee: ₹2,500 or 300 rupees. FIR No. 12/2024, Case No: AB/77, Ref Number ZZ-1234, Civil Suit No. 9/2020."
    got = {(r.category, r.value, r.confidence) for r in extracts.extracted(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    assert got == {("date", "1.2.2024", 0.9), ("date", "3/4/24", 0.7), ("deadline", "May 5, 2025", 1.0), ("deadline", "6 June 2025", 1.0), ("deadline", "2025-07-08", 1.0), ("amount", "2500", 0.9), ("amount", "300", 0.85), ("fir_number", "12/2024", 0.95), ("case_number", "AB/77", 0.85), ("reference_number", "ZZ-1234", 0.8), ("case_number", "Civil Suit No. 9/2020", 0.9)}


def test_fuzzy_prefixes_hold_rare_characters(spark, monkeypatch):
    from dossier.functions import fuzzy

    rng = random.Random(5)
    names = sorted({" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 7))) for _ in range(3)) for _ in range(150)})
    names += [n.replace("a", "e", 1) + "x" for n in names[:20]]
    table = spark.createDataFrame([(n,) for n in names], "name string")
    want = {(a, b) for a in set(names) for b in set(names) if a < b and fuzzy.ratio(a, b) >= 80}
    assert {(r.a, r.b) for r in joins.fuzzy_pairs(table).collect()} == want != set()
    # the space, which all names hold, makes no candidates: nearly all pairs would meet
    monkeypatch.setattr(fuzzy, "indel_ratio", lambda a, b: F.lit(100.0))
    assert joins.fuzzy_pairs(table).count() < len(names) * (len(names) - 1) / 2 * 0.8


@pytest.mark.parametrize("pattern", [fields.PATTERNS["issuing_authority"][3], fields.UNIVERSAL["organization"], fields.UNIVERSAL["court"], fields.UNIVERSAL["email"], fields.PATTERNS["email"][1], fields.PATTERNS["applicant_address"][1]])
def test_runs_give_the_plain_hit(pattern):
    """What is searched in runs alone is what a plain search finds, and a megabyte without a hit takes little time."""
    rng = random.Random(7)
    pieces = ["Ab", "in the", "Court", "court", "Board", "Ltd", "Ltd.", "Pvt", "x@y.org", "a.b@c", "@", "12 Oak", "street", ", Ulm 400001", ",", ".", "\n", " ", "Ltdx", "7", "Institute", "&"]
    plain, found = re.compile(pattern, re.I | re.M | re.A), fields.finder(pattern)
    for _ in range(2500):
        text = "".join(rng.choice(pieces) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randrange(1, 14)))
        assert found(text) == ((plain.search(text) or [None, ""])[1] or ""), text
    start = time.process_time()
    for text in ("Abc def " * 125_000, "a.b." * 250_000, "1" * 300_000, "Court" * 200_000, "12 road " * 125_000):
        found(text)
    assert time.process_time() - start < 10


def test_fields_of_whole_texts(spark):
    """Hits behind the first thousands of characters count, and a document's rows stay its own."""
    far = "x. " * 40_000 + "\nFull Name: Asha Rao Age 40\nGenre: Tale\nmail a@b.org\n"
    docs = spark.createDataFrame([("k", "T", far), ("k", "T", "HEAD OF ALL\nGenre: Ode\n"), (None, "U", None)], "doc_id string, document_type string, text string")
    rules = spark.createDataFrame([("T", "full_name", "string", True), ("T", "gender", "string", False)], "document_type string, field string, type string, required boolean")
    got = [(r.doc_id, r.field, r.value, r.confidence, r.type) for r in fields.extracted_fields(docs, rules).collect()]
    want = [("k", "document_title", "HEAD OF ALL", 0.85, "string"), ("k", "email", "a@b.org", 0.85, "email"), ("k", "full_name", "Asha Rao Age", 0.9, "string"), ("k", "full_name", None, 0.0, "string"), ("k", "gender", None, 0.0, "string"), ("k", "gender", None, 0.0, "string"), ("k", "genre", "Ode", 0.85, "string"), ("k", "genre", "Tale", 0.85, "string")]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    plan = fields.extracted_fields(docs, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    short = {r.field for r in fields.extracted_fields(docs.where("text like 'x%'"), rules, most=4000).where("value is not null").collect()}
    assert short == set()


def test_forms_are_the_plain_hits():
    rng = random.Random(5)
    pieces = ["/", "/a", "/b.c", ".", ".x1", "//", " ", "x@y.org", "a.b@c", "@", "http://q", "v1.2", "é", "\n", "z@y.o|rg", "@k.com"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 10)))
        want = {(m, kind, 0.8) for kind, p in extracts.FORMS for m in re.findall(p, text)}
        assert {x for x in extracts.formal(text) if x[2] == 0.8} == want, text


def test_stated_is_what_the_patterns_say():
    rng = random.Random(6)
    pieces = ["Abc", "ABc", "aBc", "abc", "Uses", "uses", "is", "a", "an", "are", "part of", "has", "1", ".", "\n", "belongs to", "creates"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) + rng.choice([" ", " ", "  ", ""]) for _ in range(rng.randrange(2, 12)))
        want = {}
        for run in re.findall(r"[A-Za-z\s]+", text):
            for kind, p in extracts.STATED:
                for m in re.finditer(p, run):
                    key = (m[1].lower(), kind, m[2].lower())
                    want[key] = min(want.get(key, (m[1], kind, m[2])), (m[1], kind, m[2]))
        assert {x[:3] for x in extracts.stated(text)} == set(want.values()), text


def test_megabytes_take_linear_time():
    start = time.process_time()
    for text in ("/a" * 500_000, "/a." * 300_000, "a.b." * 250_000 + "@", "@a" * 500_000, "/" * 1_000_000):
        extracts.formal(text)
    for text in ("Abc " * 250_000 + "uses 1", "Abc is a " * 110_000, "uses " * 200_000):
        extracts.stated(text)
    assert time.process_time() - start < 15
    start = time.process_time()
    assert len(chunks.by_characters("word " * 200_000)) > 1000
    assert time.process_time() - start < 2


def test_verification_in_one_row(spark, sf):
    docs = verification._requests(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"), spark)
    rows = lambda df: sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes]).collect())
    assert rows(checks.verification_results(docs)) == rows(checks.verified(checks.verification_steps(docs)))
    assert "Exchange" not in checks.verification_results(docs)._jdf.queryExecution().executedPlan().toString()


def test_mentions_of_any_dictionary(spark):
    """The same rows from a dictionary that is an expression and from one that is an automaton, for ids of any type."""
    texts = [("a-1", "Name 7 met name 12 and name 1003"), ("b", None), (None, "name 7"), ("c", "nothing")]
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    numbers = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id int, text string")
    for most in (1000, 1001):
        names = spark.createDataFrame([(f"name {i}",) for i in range(most)], "name string")
        want = {("a-1", n) for n in ("name 1", "name 10", "name 100", "name 12", "name 7")} | {(None, "name 7")}
        assert {tuple(r) for r in joins.mentions(docs, names).collect()} == want
        assert {(r.doc_id, r.name) for r in joins.mentions(numbers, names).collect()} == {(0 if i else 2, n) for i, n in want}
        vertices = names.select(F.concat(F.lit("v"), "name").alias("id"), "name")
        asked = spark.createDataFrame([(f"AME {i}",) for i in range(most)], "asked string")
        found = {r.asked: r.id for r in graph.lookup(vertices, asked).collect()}
        assert len(found) == most and found["AME 12"] == "vname 12"
    assert extracts.entity_relevance(docs, spark.createDataFrame([(f"name {i}",) for i in range(1100)], "name string")).where("doc_id = 'a-1'").count() == 6


def test_patterns_need_what_is_said():
    """A text in which a pattern hits holds what the pattern needs."""
    rng = random.Random(9)
    every = [p for ps in fields.PATTERNS.values() for p in ps] + list(fields.UNIVERSAL.values()) + [r.pattern for rules in checks.REGISTRIES.values() for r in rules if r.pattern]
    assert sum(bool(needs.needs(p)[0]) or needs.needs(p)[1] for p in every) > 0.9 * len(every)
    pieces = ["Full Name: Asha Rao 4", "DOB: 1/2/1990", "ref no: AB/1234", "serial no: MH001234", "a@b.org", "+91 9876543210", "Rs. 5", "₹7", "HIGH Court", "Oak Ltd", "roll 12345", "date 01-02-2020", "Survey no 12/3", "OWNER: Bo Li", "file no: AB-12345", "s/o Vi Pal", "dept: Roads A", "ABCDE1234F"]
    for _ in range(600):
        text = " ".join(rng.choice(pieces) for _ in range(3))
        text = text.upper() if rng.random() < 0.2 else text
        page = needs.Page(text)
        for p in every:
            if re.search(p, text, re.I | re.M | re.A):
                assert page.may_hit(p), (p, text)


def test_stated_relations_pass_over_runs_without_verbs():
    """Relations are those of a plain reading of each run; megabytes of short runs without a verb take little time."""
    text = "The Engine has parts and is a compute engine. Ann uses Arrow\nBob Lee uses Rust, it is fast; The House is part of Ulm and belongs to Ann."
    assert sorted(extracts.stated(text)) == sorted([("The Engine", "has_property", "parts and is a compute engine", 0.7), ("The Engine has parts and", "is_a", "compute engine", 0.7), ("Ann uses Arrow\nBob Lee", "uses", "Rust", 0.7), ("The House", "part_of", "Ulm and belongs to Ann", 0.7), ("The House is part of Ulm and", "part_of", "Ann", 0.7)])
    start = time.process_time()
    assert extracts.stated("Some Words stand in a short run of letters, more of them follow here. " * 60_000) == []
    assert time.process_time() - start < 2


def test_told_days_are_looked_for_near_their_words():
    """The phrases are those of a plain search for both patterns; megabytes with few days take little time."""
    rng = random.Random(9)
    pieces = ["on ", "ON\n", " dated ", " on", "1.2.2024", " 1.2.24", "01/02/2024 ", " ", "\n", " " * 12, "abcdefghij", "filed", ", ", ";", ". ", "words of it"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 22)))
        plain = [(m["day"], m["what"], m.start()) for p in extracts.TOLD for m in re.finditer(p, text, re.IGNORECASE)]
        assert [(m["day"], m["what"], m.start()) for m in extracts._told(text)] == plain, text
    far = "It was signed in the office on 5/7/23, as told. " + "Words that tell nothing at all go on and on. " * 60_000
    start = time.process_time()
    assert [m["what"] for m in extracts._told(far)] == ["as told. Words that tell nothing at all go on and on. Words that tell nothing at", "It was signed in the office"]
    assert not list(extracts._told("dated 5/7/23" + "\n" * 1_000_000))
    assert time.process_time() - start < 3
    assert [x[:2] for x in extracts.timeline(far)] == [("5/7/23", "other")]


@pytest.mark.parametrize("most, roots", [(1_000_000, 200_000), (5, 0)])
def test_components_from_forests(spark, monkeypatch, most, roots):
    """However small the parts are from which forests are made; repeated edges, loops and null ends don't matter. Rounds are for roots alone."""
    rng = random.Random(11)
    pairs = [(f"n{rng.randrange(400)}", f"n{rng.randrange(400)}") for _ in range(260)] + [(f"w{i}", f"w{i + 1}") for i in range(60)] + [("hub", f"h{i}") for i in range(200)]
    pairs += pairs[:50] + [("x", "x"), (None, "n1"), ("n2", None)]
    rng.shuffle(pairs)
    up = {}
    for a, b in pairs:
        if a and b and a != b:
            joined = up.setdefault(a, {a}) | up.setdefault(b, {b})
            up.update(dict.fromkeys(joined, joined))
    monkeypatch.setattr(graph, "_forest", lambda batches, f=graph._forest: f(batches, most))
    monkeypatch.setattr(graph, "MOST_ROOTS", roots)
    seen, plain = [], graph._labels
    monkeypatch.setattr(graph, "_labels", lambda df: seen.append(df.count()) or plain(df))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        edges = spark.createDataFrame(pairs, "src string, dst string").repartition(4)
        got = {r.node: r.component for r in graph.components(edges).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {n: min(group) for n, group in up.items()}
    assert seen[0] < len(pairs) / (2 if roots else 1)
    numbers = spark.createDataFrame([(3, 20), (20, 100), (7, 8)], "src int, dst long")
    assert sorted(map(tuple, graph.components(numbers).collect())) == [(3, 3), (7, 7), (8, 7), (20, 3), (100, 3)]


def test_clusters_get_links_unshuffled(spark, tmp_path, monkeypatch):
    """Links go to the forests as they lie; the edges are counted once each, however often they occur."""
    items = [(s, p) for s, p in [(1, 1), (1, 2), (2, 2), (5, 9)] for _ in range(3)]
    spark.createDataFrame(items, "l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    given, plain = [], graph.components
    monkeypatch.setattr(graph, "components", lambda df: given.append(df) or plain(df))
    assert [tuple(r) for r in QUERIES["clusters_all"](spark, str(tmp_path)).collect()] == [("p1", 4, 3, 0.25)]
    assert "Exchange" not in given[0]._jdf.queryExecution().executedPlan().toString()
