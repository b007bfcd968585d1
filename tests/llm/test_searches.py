"""Exact dedup, lexical search and hard negatives against brute force, with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import exact, lexical, negatives

DOCS = "doc_id long, text string, digest string, salt string, n long, keep_id string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", 7, "x") for i, t in rows], DOCS)


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


COPIES = [(1, "a b"), (2, "a b "), (3, "a b"), (4, None), (5, ""), (None, "a b"), (None, "only nameless"), (None, "only nameless"), (6, "ü" * 70_000), (7, "ü" * 70_000), (8, "u" * 70_000), (9, "A b"), (9, "A b"), (9, "another"), (10, "a\u0000b"), (11, "a\u0000b")] + [(100 + i, "hot") for i in range(200)] + [(400 + i, f"t{i % 60}") for i in range(100)]


@pytest.mark.parametrize("weak", [None, lambda t: F.substring(t, 1, 1).cast("binary"), lambda t: F.lit(b"one")])
def test_exact(spark, weak):
    docs = docs_of(spark, COPIES).repartition(7)
    got = exact.exact_duplicates(docs, weak) if weak else exact.exact_duplicates(docs)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_copies(COPIES)


def test_exact_empty(spark):
    assert exact.exact_duplicates(docs_of(spark, [])).collect() == []


WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_ranks(docs, items, k):
    texts = [(i, Counter(WORD.findall((t or "").translate(LOWER)))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    asked = defaultdict(Counter)
    for i, t in items:
        if i is not None and t is not None:
            asked[i].update(WORD.findall(t.translate(LOWER)))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in texts:
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 12 * m)) for w, times in terms.items() if w in c)
            if score > 0 and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def random_docs(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(5 * n) if rng.random() > 0.05 else None, " ".join(rng.choice(["Äpfel", "b c", "x1", "THE", "the", "w%d" % rng.randrange(30), "w%d" % rng.randrange(300)]) + rng.choice(["", ".", ";"]) for _ in range(rng.randrange(40)))) for _ in range(n)]


@pytest.mark.parametrize("documents,size", [(16, 1 << 25), (16_384, 60)])
def test_lexical(spark, documents, size):
    docs = random_docs(3, 300) + [(5000, None), (5001, ""), (5002, "..."), (5003, "w1 " * 50_000), (5004, "w1 w2"), (5004, "w1 w2"), (5004, "w2")]
    items = [(i, t) for i, t in random_docs(4, 25)] + [(None, "w1"), (900, None), (901, "zzz"), (902, "w1 w1 the"), (902, "w2"), (903, "w2")]
    table = spark.createDataFrame([(i, t, "x", 1, "x") for i, t in docs], "doc_id long, text string, ids string, n long, terms string").repartition(5)
    asked = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id long, text string, times long, term string")
    got = lexical.ranked(table, asked, k=7, documents=documents, round_bytes=size)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_ranks(docs, items, 7)


def test_lexical_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    item = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.ranked(none, item).collect() == []
    assert lexical.ranked(none.unionAll(spark.createDataFrame([(1, None)], none.schema)), item).collect() == []
    assert lexical.ranked(spark.createDataFrame([(1, "a")], none.schema), item.where("false")).collect() == []


def test_words_in_slices(monkeypatch):
    monkeypatch.setattr(lexical, "SLICE", 5)
    text = "Ab cdefghijklmnop, q-r  stu " * 9 + "ÄÖ"
    assert lexical.counted(text.encode()) == (46, Counter({w.encode(): n for w, n in Counter(WORD.findall(text.translate(LOWER))).items()}))


def test_harvest_passes_over_windows():
    """A window that can't beat the heap leaves it as it is, and buckets and bits are empty after each traversal."""
    made = lambda ids, tf: {"ids": np.array(ids), "lengths": np.array(tf, np.int64), "terms": np.array([0], np.int32), "ends": np.array([0, len(ids)]), "places": np.arange(len(ids), dtype=np.int32), "times": np.array(tf, np.int32)}
    windows = [lexical._Postings({k: v.tobytes() for k, v in made(*w).items()}, np.array([500]), 10, 100) for w in (([3, 9, 11], [5, 9, 9]), ([20, 21], [1, 1]), ([30], [50]))]
    harvest, one = lexical._Harvest(1, 2), (np.array([0], np.int32), np.array([1]))
    harvest.traverse(windows[0], 0, *one)
    before = list(harvest.heaps[0])
    harvest.traverse(windows[1], 0, *one)
    assert harvest.heaps[0] == before and sorted(-d for _, d in before) == [9, 11]
    harvest.traverse(windows[2], 0, *one)
    assert -max(harvest.heaps[0])[1] == 30 and not harvest.buckets.any() and not harvest.occupied.any()


VECTORS = "vec_id long, embedding array<double>, label int, v string, ids string, near int"


def brute_negatives(rows, k, m, every, scale, percent):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = (label, [math.floor(scale * y) for y in v])
            good[i] = min(good.get(i, x), x)
    out = []
    for a in [i for i in good if i % every == 0]:
        label, q = good[a]
        scores = [(-sum(x * y for x, y in zip(q, v, strict=False)), i, other) for i, (other, v) in good.items() if i != a]
        for s, i, _ in sorted(x for x in scores if x[2] == label)[:k]:
            p = -s
            hits = sorted(x for x in scores if x[2] != label and percent * p <= 100 * -x[0] <= 100 * p)[:m]
            out += [(a, i, r + 1, j, p, -n) for r, (n, j, _) in enumerate(hits)]
    return sorted(out)


@pytest.mark.parametrize("scale", [256, 2**24, 10**9])
def test_negatives(spark, scale, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 64)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    rng = random.Random(2)
    centres = [[rng.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.08) for x in centres[i % 5]], rng.randrange(3)) for i in range(600)]
    rows += [(600, None, 1), (610, [1.0, None], 1), (620, [float("nan")] * 6, 0), (630, [float("inf")] * 6, 0), (None, [0.1] * 6, 1), (640, [0.2] * 6, None), (650, [], 1), (660, [0.3, 0.3], 2), (670, [0.0] * 6, 0)]
    rows += [(30, [0.01] * 6, 2), (30, [0.02] * 6, 0), *[(700 + i, rows[7][1], i % 2) for i in range(40)]]
    table = spark.createDataFrame([(i, v, label, "x", "x", 1) for i, v, label in rows], VECTORS).repartition(5)
    got = negatives.mined(table, positives=4, negatives=3, every=10, scale=scale)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, 4, 3, 10, scale, 80)


def test_negatives_empty(spark):
    none = spark.createDataFrame([], VECTORS)
    assert negatives.mined(none).collect() == []
    one = spark.createDataFrame([(100, [0.5], 1, "x", "x", 1)], VECTORS)
    assert negatives.mined(one).collect() == [] and negatives.mined(one.withColumn("embedding", F.expr("array(cast(0.0 as double))"))).collect() == []


def test_pivots_bracket_scores():
    rng = np.random.default_rng(5)
    v = rng.integers(-200, 200, (8, 8))[np.arange(400) % 8] + rng.integers(-20, 20, (400, 8))
    pivots = negatives.Pivots(v[:100].astype(float), float((v * v).sum(axis=1).max()))
    q = v[:50]
    a, b = pivots.asked(q)[:, None], pivots.table(v)[None]
    share = (q * q).sum(axis=1)[:, None] / 2
    score = q @ v.T
    assert (share + pivots.nearest(np.abs(a - b).max(axis=2)) >= score).all() and (share + pivots.furthest((a + b).min(axis=2)) <= score).all()
    near = np.abs(a - b).max(axis=2)
    assert (share + pivots.nearest(near) < 0.8 * score.max(axis=1)[:, None]).mean() > 0.5
