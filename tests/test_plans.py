"""Questions as plans, workflows as rows, continued numbers, and operators whose hot keys are split, against plain Python."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from dossier.operators import graph, questions, windows, workflows
from dossier.sources.store import Numbers

VERTICES = [("1", "Ada"), ("2", "Bo Chan"), ("3", "Ulm"), ("4", "ada"), ("5", None), ("6", "Jena")]
EDGES = [("1", "3", "lives_in"), ("2", "3", "born_in"), ("3", "6", "near"), ("1", "2", "knows"), ("1", "6", "lives_in"), ("6", "1", "knows")]


def test_questions(spark):
    vertices = spark.createDataFrame(VERTICES, "id string, name string")
    edges = spark.createDataFrame(EDGES, "src string, dst string, type string")
    asked = {
        "a": "What is the lives of ADA?", "b": "Who is Bo Chan?", "c": "tell me about ulm", "d": "How are Ada and Jena connected?", "e": "what is the relationship between Bo Chan and Jena?",
        "f": "Hello", "g": None, "h": "what is a knows for nobody?", "i": "Which near has Ulm? and who is Ada?", "j": "compare this", "k": "Why is lives related to Ada?", "l": "describe Jena. Please",
    }
    table = spark.createDataFrame(list(asked.items()), "query_id string, question string")
    plans = questions.plans(table, vertices)
    got = {r.query_id: (r.kind, r.intent, r.relation, r.source, r.target) for r in plans.collect()}
    assert got == {
        "a": ("relation", "list", "lives", "1", None), "b": ("entity", "general", None, "2", None), "c": ("entity", "general", None, "3", None), "d": ("path", "general", None, "1", "6"),
        "e": ("path", "list", None, "2", "6"), "f": ("general", "general", None, None, None), "g": ("general", "general", None, None, None), "h": ("general", "list", None, None, None),
        "i": ("relation", "general", "near", "3", None), "j": ("general", "comparison", None, None, None), "k": ("relation", "explanation", "lives", "1", None), "l": ("entity", "general", None, "6", None),
    }
    rows = defaultdict(set)
    for r in questions.answers(plans, vertices, edges).collect():
        rows[r.query_id].add((r.kind, r.name, r.relation, r.path))
    assert rows == {
        "a": {("relation", "Ulm", "lives_in", None), ("relation", "Jena", "lives_in", None)}, "b": {("entity", "Ulm", "born_in", None)}, "c": {("entity", "Jena", "near", None)},
        "d": {("path", "Jena", None, p) for p in ("1>6", "1>3>6", "1>2>3>6")}, "e": {("path", "Jena", None, "2>3>6")}, "i": {("relation", "Jena", "near", None)},
        "k": {("relation", "Ulm", "lives_in", None), ("relation", "Jena", "lives_in", None)}, "l": {("entity", "Ada", "knows", None)},
    }


@pytest.mark.parametrize("hops", [1, 2, 3])
def test_simple_paths_of_pairs(spark, hops):
    rng = random.Random(hops)
    nodes = [f"n{i}" for i in range(9)]
    edges = spark.createDataFrame([(rng.choice(nodes), rng.choice(nodes)) for _ in range(30)], "src string, dst string")
    pairs = spark.createDataFrame([(rng.choice(nodes), rng.choice(nodes)) for _ in range(12)] + [("x", "n1")], "start string, end string")
    starts = pairs.select(F.col("start").alias("id")).distinct()
    every = graph.simple_paths(edges, starts, hops).join(pairs.distinct(), ["start", "end"], "left_semi")
    got = graph.simple_paths(edges, starts, hops, pairs.distinct())
    key = lambda df: sorted((r.start, r.end, r.path, r.hops) for r in df.collect())
    assert key(got) == key(every)


def test_two_steps_of_hubs(spark):
    """Every way over a hub once, and no key with more than the ways of two groups."""
    rng = random.Random(1)
    first = [(f"a{i}", "hub" if i < 40 else f"b{rng.randrange(5)}", i) for i in range(90)] + [("z0", "b1", 1), ("z0", "b1", 2)]
    second = [("hub" if i < 30 else f"b{rng.randrange(5)}", f"z{i}", i) for i in range(60)] + [("hub", "a3", 7)]
    table = lambda rows: spark.createDataFrame(rows, "src string, dst string, n int")
    got = Counter((r.x.src, r.x.n, r.y.dst, r.y.n) for r in graph.two_steps(table(first), table(second), split=7).collect())
    assert got == Counter((a, n, d, m) for a, b, n in first for c, d, m in second if b == c and a != d)
    plan = graph.two_steps(table(first), table(second), split=7)._jdf.queryExecution().optimizedPlan().toString()
    assert "i#" in plan and "j#" in plan


def test_busy_users_are_sliced(spark):
    """A user with half of all events is dealt to many slices, and counts are those of plain Python."""
    rng = random.Random(3)
    rows = [(i, "u" if i % 2 else f"v{i % 5}", rng.choice(["bad", "bad", "good"]), rng.randrange(4000) + (0.0 if i % 3 else 0.5)) for i in range(700)]
    rows += [(900 + i, "u", "bad", 640.0) for i in range(5)] + [(950, "w", "bad", 960.0), (951, "w", "bad", 950.000001), (952, "w", "bad", 950.0)]
    events = spark.createDataFrame(rows, "event_id long, user_id string, event_type string, s double").withColumn("ts", F.timestamp_micros((F.round(F.col("s") * 1_000_000)).cast("long")))
    us = {i: round(s * 1_000_000) for i, _, _, s in rows}
    parts = windows.sliced(events, 10).where("user_id = 'u'").groupBy("slice").count().collect()
    assert len(parts) > 20 and max(r["count"] for r in parts) < 60
    assert windows.sliced(events, 10).where("own").count() == len(rows)
    order = sorted((u, us[i], i, k) for i, u, k, _ in rows)
    want, recent, held, seen = {}, {}, defaultdict(list), defaultdict(list)
    for u, t, i, k in order:
        seen[u] = [x for x in seen[u] if t - x < 10_000_000] + [t]
        recent[i] = len(seen[u])
        if k == "good":
            held[u] = []
        else:
            held[u] = [x for x in held[u] if t - x < 10_000_000] + [t]
            if len(held[u]) >= 2:
                want[i] = len(held[u])
    assert {r.event_id: r.failures for r in windows.failures_in_window(events, "bad", "good", 10, 2).collect()} == want
    assert {r.event_id: r.recent for r in windows.access_rate(events, 10, 3).collect()} == recent


def test_workflows(spark, tmp_path):
    held = workflows.with_workflow(workflows.rules(spark), workflows.rules(spark, {"COURT_CASE": ("Court", ("Affidavit",), ()), "EMPTY": ("None", (), ("Map",))}))
    workflows.save(held, f"{tmp_path}/rules")
    held = workflows.load(spark, f"{tmp_path}/rules")
    assert {r.workflow: (r.required_count, r.optional_count) for r in workflows.listed(held).collect()} == {"GOVERNMENT_APPLICATION": (3, 2), "COURT_CASE": (1, 0), "NOTARY_VERIFICATION": (3, 1), "CONTRACT_EXECUTION": (2, 2), "FINANCIAL_TRANSACTION": (3, 2), "EMPTY": (0, 1)}
    cases = [(1, "GOVERNMENT_APPLICATION", " identity proof"), (1, "GOVERNMENT_APPLICATION", "APPLICATION"), (1, "GOVERNMENT_APPLICATION", "affidavit"), (1, "GOVERNMENT_APPLICATION", "x"), (2, "COURT_CASE", "Affidavit"), (3, "NOPE", "Map"), (4, "CONTRACT_EXECUTION", None), (5, "EMPTY", "map"), *[(6, "COURT_CASE", f"k{i}") for i in range(50)]]
    got = {r.case_id: r for r in workflows.checked(spark.createDataFrame(cases, "case_id int, workflow string, kind string"), held).collect()}
    assert {k: (r.status, r.completeness, r.total_required, r.present_required, r.missing) for k, r in got.items()} == {1: ("INCOMPLETE", 66.7, 3, 2, "Address Proof"), 2: ("COMPLETE", 100.0, 1, 1, ""), 3: ("ERROR", 0.0, 0, 0, ""), 4: ("INCOMPLETE", 0.0, 2, 0, "Contract, Identity Proof"), 5: ("COMPLETE", 0.0, 0, 0, ""), 6: ("INCOMPLETE", 0.0, 1, 0, "Affidavit")}
    assert got[1].message == "APPLICATION INCOMPLETE — Missing: Address Proof" and got[3].message == "Unknown workflow: NOPE"
    assert got[1].checklist.split("\n") == ["DOCUMENT CHECKLIST", "=" * 50, "", "Required Documents:", "  ✓ Application", "  ✓ Identity Proof", "  ✗ Address Proof", "", "Optional Documents:", "  ○ Certificate", "  ✓ Affidavit"]


def test_continued_numbers(spark, tmp_path):
    store = Numbers(spark, f"{tmp_path}/n")
    batches = [[(1, "a"), (2, "a"), (3, "b")], [(4, "a"), (5, None), (6, "c")], [(0, "a"), (7, "b"), (8, None)]]
    table = lambda b: spark.createDataFrame(b, "id int, kind string")
    got = [{r.id: r.number for r in store.assign(table(b), "kind", "id", i).collect()} for i, b in enumerate(batches)]
    assert got == [{1: 1, 2: 2, 3: 1}, {4: 3, 5: 1, 6: 1}, {0: 4, 7: 2, 8: 2}]
    again = {r.id: r.number for r in Numbers(spark, f"{tmp_path}/n").assign(table(batches[1]), "kind", "id", 1).collect()}
    assert again == got[1] and store.manifest.version() == 3
