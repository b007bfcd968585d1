"""What only shows over large or skewed tables."""

import random
import time

import duckdb
import numpy as np
import pytest
from oracle import rows as plain_rows
from pyspark.sql import functions as F

from dossier import queries as _  # noqa: F401
from dossier.registry import ORACLE_SQL, QUERIES


def test_document_numbers_over_six_digits(spark, tmp_path):
    spark.range(1, 1_000_003).select(F.col("id").alias("o_orderkey"), F.lit("1-URGENT").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["document_numbers"](spark, str(tmp_path)).where("request_id > 999997")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    cur = con.execute(f"SELECT * FROM ({ORACLE_SQL['document_numbers']}) WHERE request_id > 999997")
    want = plain_rows([d[0] for d in cur.description], cur.fetchall())
    assert plain_rows(got.columns, got.collect()) == want and len(want) == 6


def _no_broadcast(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_blocks_are_not_broadcast(spark, sf):
    """Blocks of vectors are many times larger in memory than compressed: none goes through the driver, small as its files may be."""
    from dossier.functions import grid
    from dossier.llm import negatives, topk

    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    _no_broadcast(topk.exact_top_k(vectors))
    _no_broadcast(negatives.mined(vectors))
    blocks = spark.range(4).select((F.col("id") % 2).cast("int").alias("group"), (F.col("id") % 2).cast("int").alias("part"), F.lit(b"x").alias("matrix"))
    _no_broadcast(grid.met(blocks.drop("part"), blocks.select("part", F.col("matrix").alias("other")), 2, 2))


def test_shortest_paths_over_a_hub(spark):
    """Ways over a hub aren't tried for every pair with every end: 10,000 pairs over one node."""
    from dossier.operators import paths

    n = 10_000
    i = spark.range(n).select(F.col("id").cast("string").alias("i"))
    edges = i.select(F.concat(F.lit("a"), "i").alias("src"), F.lit("h").alias("dst")).unionAll(i.select(F.lit("h"), F.concat(F.lit("b"), "i")))
    began = time.time()
    got = paths.all_shortest_paths(edges, i.select(F.concat(F.lit("a"), "i").alias("src"), F.concat(F.lit("b"), "i").alias("dst")))
    assert got.where("hops = 2 and nth = 1 and path = concat(start, '>h>', end) and substr(start, 2) = substr(end, 2)").count() == got.count() == n
    assert time.time() - began < 90


def test_key_relations(spark):
    """Against plain Python where batches of first edges go on, and over a hub with 400 million ways."""
    import random

    from dossier.operators import graph

    rng = random.Random(5)
    edges = list({(f"v{rng.randrange(150)}", f"v{rng.randrange(150)}", rng.choice("xy"), rng.choice((0.5, 0.9, None))) for _ in range(260)})
    for least in (0, 120):
        # falling ranks of starts leave few pairs, so many batches are looked through
        rank = {f"v{i}": (500 - i if i < least else i) for i in range(150)}
        sure = lambda c: float("inf") if c is None else -c
        best = {}
        ways = [(a, b, 1, sure(c), t) for a, b, t, c in edges] + [(a, b, 2, sure(c), t) for a, m, t, c in edges for k, b, _, _ in edges if m == k and a != b]
        for a, b, hops, c, t in ways:
            if rank[a] < rank[b]:
                best[a, b] = min(best.get((a, b), (9,)), (hops, c, t))
        want = sorted((c, hops, a, b, t) for (a, b), (hops, c, t) in best.items())
        for n in (15, 2000):
            got = graph.key_relations(spark.createDataFrame(list(rank.items()), "id string, rank long"), spark.createDataFrame(edges, "src string, dst string, type string, confidence double"), n).collect()
            assert [(sure(r.confidence), r.hops, r.a, r.b, r.type) for r in got] == want[:n]
    i = spark.range(20_000).select("id", F.lpad(F.col("id").cast("string"), 6, "0").alias("i"))
    hub = i.select(F.concat(F.lit("a"), "i").alias("src"), F.lit("h").alias("dst")).unionAll(i.select(F.lit("h"), F.concat(F.lit("b"), "i")))
    ranks = i.select(F.concat(F.lit("a"), "i").alias("id"), F.col("id").alias("rank")).unionAll(i.select(F.concat(F.lit("b"), "i"), F.col("id") + 20_000))
    began = time.time()
    got = graph.key_relations(ranks, hub.select("src", "dst", F.lit("t").alias("type"), F.lit(0.5).alias("confidence")))
    assert [(r.a, r.b) for r in got.collect()] == [("a000000", f"b{k:06}") for k in range(15)]
    assert time.time() - began < 60


def test_neighbourhood(spark, monkeypatch):
    """Against plain Python with leaves, a node of its own and lists in parts; and the 36 million pairs of a star's leaves."""
    import random

    from dossier.operators import graph

    rng = random.Random(6)
    edges = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(70)] + [("hub", f"l{i}") for i in range(20)] + [("hub", "v1"), ("v2", None)]
    near: dict[str, set] = {}
    for a, b in edges:
        if b and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    centres = [f"v{i}" for i in range(60)] + ["l1", "l1", "hub", "alone"]
    for split, depth in ((1000, 1), (1000, 2), (4, 2), (4, 3)):
        monkeypatch.setattr(graph, "SPLIT", split)
        want = set()
        for c in centres:
            seen, level = {c: 0}, {c}
            for h in range(1, depth + 1):
                level = {y for x in level for y in near.get(x, ())} - set(seen)
                seen |= dict.fromkeys(level, h)
            want |= {(c, x, h) for x, h in seen.items()}
        got = graph.neighbourhood(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([(c,) for c in centres], "id string"), depth).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    monkeypatch.undo()
    i = spark.range(6_000).select(F.concat(F.lit("s"), "id").alias("id"))
    found = graph.neighbourhood(i.select(F.col("id").alias("src"), F.lit("n").alias("dst")), i, 2)
    # no shuffle over the outcome
    assert found.count() == 6_000 * 6_001
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()


def test_neighbourhood_of_leaves_broadcasts_nothing(spark):
    """A star's leaves, copied for every task, were small by their file's size and large by their rows: a broadcast of them filled the driver."""
    from dossier.operators import graph

    i = spark.range(2_500).select(F.concat(F.lit("s"), "id").alias("id"))
    found = graph.neighbourhood(i.select(F.col("id").alias("src"), F.lit("n").alias("dst")), i.where("id <> 's7'"), 2)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.groupBy("centre").agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"), F.sum("hops").alias("hops")).collect()
    assert len(rows) == 2_499 and {(r.n, r.nodes, r.hops) for r in rows} == {(2_501, 2_501, 1 + 2 * 2_499)}


def shuffled_bytes(spark):
    context = spark.sparkContext
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, context._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_neighbourhood_sends_lists_to_groups(spark):
    """A list that went to each of its 30 centres was shuffled 30 times; now it is once for each group of centres."""
    from dossier.operators import graph

    rng = random.Random(9)
    edges = sorted({(f"s{rng.randrange(600)}", f"p{rng.randrange(2000)}") for _ in range(60_000)})
    rng.shuffle(edges)
    table = spark.createDataFrame(edges, "src string, dst string").coalesce(4)
    began = shuffled_bytes(spark)
    found = graph.neighbourhood(table, table.select(F.col("src").alias("id")).distinct(), 2).groupBy("hops").count().collect()
    sent = shuffled_bytes(spark) - began
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b), near.setdefault(b, set()).add(a)
    ends = {a for a, _ in edges}
    second = sum(len(set().union(*(near[b] for b in near[a])) - {a}) for a in ends)
    assert {r.hops: r["count"] for r in found} == {0: len(ends), 1: len(edges), 2: second}
    assert sent < 100 * len(edges), sent


def test_neighbourhood_in_pieces():
    """Cells that lie in several batches, and centres whose ways are looked through in several pieces."""
    import json

    import pyarrow as pa

    from dossier.operators import graph

    rng = random.Random(10)
    rows = [(g, key, rng.choice((1, 2, 3)), rng.sample("abcdef", rng.randrange(4)), rng.sample("abcdefghij", rng.randrange(5))) for g in range(3) for key in range(2) for _ in range(12)]
    want = {}
    for g, key, hops, centres, nodes in rows:
        for c in centres:
            for n in nodes:
                if n != c:
                    want[g, key, c, n] = min(hops, want.get((g, key, c, n), 9))
    names = ["g", "key", "hops", "centres", "nodes"]
    for most in (1, 7, 1000):
        parts = [rows[i : i + 5] for i in range(0, len(rows), 5)]
        batches = [pa.RecordBatch.from_pydict({n: pa.array([json.dumps(r[i]) if i > 2 else r[i] for r in part], pa.string() if i > 2 else pa.int32()) for i, n in enumerate(names)}) for part in [*parts[:3], [], *parts[3:]]]
        got = [tuple(r.values()) for b in graph._nearest(iter(batches), most) for r in b.to_pylist()]
        assert sorted(got) == sorted((*k, h) for k, h in want.items())


def test_blocks_go_where_they_meet_something(spark):
    """Blocks of rows were copied for every 16 blocks of queries, most of them of other values: with the cells of an index for every query more."""
    from dossier.functions import blocks

    values, n, dim = 200, 8_000, 32
    x = np.random.default_rng(11).normal(size=(n, dim))
    table = spark.createDataFrame([(i, v.tolist(), i % values) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    began = shuffled_bytes(spark)
    found = blocks.best(table.where("vec_id % 4 = 0"), table, blocks.cosines, 3, "label").select("query_id", "vec_id").collect()
    sent = shuffled_bytes(spark) - began
    assert sent < 4 * 8 * n * dim, sent
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, n, 400):
        others = [i for i in range(q % values, n, values) if i != q]
        want = sorted(others, key=lambda i: -(u[i] @ u[q]))[:3]
        assert set(want) <= {r.vec_id for r in found if r.query_id == q} <= set(others)


@pytest.mark.parametrize("by", [None, "label"])
def test_best_over_blocks_with_ties(spark, monkeypatch, by):
    """What a block leaves bounds the next ones: against brute force with equal scores, short groups, zero vectors and two lengths."""
    from dossier.functions import blocks
    from dossier.operators import search

    monkeypatch.setattr(blocks, "ROWS", 16), monkeypatch.setattr(blocks, "QUERIES", 8)
    rng = random.Random(12)
    rows = [(i, [float(rng.randrange(3)) for _ in range(3 if i % 9 else 2)], None if i % 31 == 0 else min(rng.randrange(6), 3)) for i in range(400)] + [(1000, [1.0, 1.0, 0.0], 7), (1002, None, 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = blocks.best(table.where("vec_id % 2 = 0"), table, blocks.cosines, 5, by)
    got = {}
    for r in search.top(found.select("query_id", "vec_id", F.round("score", 6).alias("score")), "query_id", [F.desc("score"), F.col("vec_id")], 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    for q, v, label in rows:
        if q % 2 == 0:
            like = [(i, w) for i, w, other in rows if i != q and v and w and len(w) == len(v) and (by is None or (label is not None and other == label))]
            scores = {i: round(float(np.dot(v, w) / ((np.linalg.norm(v) * np.linalg.norm(w)) or 1)), 6) for i, w in like}
            want = sorted(scores, key=lambda i: (-scores[i], i))[:5]
            assert [got.get(q, {})[k] for k in sorted(got.get(q, {}))] == want


def test_shared_priorities_meet_as_values(spark, sf):
    """A join of the rows before they are distinct would gather each value's rows in one task."""
    plan = QUERIES["shared_priorities"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "Join" not in plan


def test_batches_and_blocks_are_small(spark, sf):
    """Functions over whole texts and packed blocks get 2 MB at a time; vectors of single precision travel as such, others whole."""
    from dossier.functions import blocks

    for name in ("character_chunks", "sentence_chunks", "bm25_topk", "vector_cosine_topk"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        QUERIES[name](spark, sf)
        assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) == 2 << 20
    for x, size in ((0.5, 4), (0.1, 8)):
        rows = spark.createDataFrame([(i, [x, float(i), -1.0]) for i in range(3)], "vec_id long, embedding array<double>")
        r = blocks.packed(blocks.usable(rows), 1).first()
        assert len(r.matrix) == 9 * size and blocks._read(r.ids, r.matrix, r.dim)[1].tolist() == [[x, float(i), -1.0] for i in blocks._read(r.ids, r.matrix, r.dim)[0]]


def test_keyword_search_sends_nothing_to_the_driver(spark, monkeypatch):
    """Against plain Python, over cells of a grid with more than one group of queries: what reaches the driver doesn't grow with queries or documents."""
    import math
    import random
    from collections import Counter

    from pyspark.sql.classic.dataframe import DataFrame

    from dossier.operators import retrieval, search

    rng = random.Random(9)
    some = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(rng.choice(some[: rng.choice((5, 60))]) for _ in range(n))
    docs = [(i, draw(rng.randrange(60))) for i in range(400)] + [(400, None), (401, "all W1 only"), (402, "all w1 only"), (None, "w1 w1 rare")]
    asked = [(i, draw(rng.randrange(1, 30))) for i in range(150)] + [(150, "RARE of all"), (151, None), (152, "nowhere"), (-3, "w1 w1\tw2"), (None, "w3 only")]
    words = [(d, (t or "").lower().split()) for d, t in docs]
    df = Counter(w for _, x in words for w in set(x))
    raw = {w: math.log(len(docs) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    mean, length = sum(raw.values()) / len(raw), sum(len(x) for _, x in words) / len(docs)
    idf = {w: 0.25 * mean if x < 0 else x for w, x in raw.items()}
    want = set()
    for q, t in asked:
        times, found = Counter((t or "").lower().split()), []
        for d, x in words:
            tf = Counter(x)
            score = round(sum(n * idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(x) / length)) for w, n in times.items() if w in tf), 6)
            if score > 0 and d is not None:
                found.append((-score, d))
        want |= {(q, d, round(-s, 5), r) for r, (s, d) in enumerate(sorted(found)[:7], 1)}
    table, queries = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(asked, "query_id long, query string")
    met, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: met.append(collect(self)) or met[-1])
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    for most in (300, search.WEIGHTS):
        hits = search.bm25(table, queries, 7, most)
        assert len(met) <= 4 and all(len(x) <= 1 and "own" not in x[0] for x in met)
        assert {(r.query_id, r.doc_id, round(r.score, 5), r.rank) for r in hits.collect()} == want
        met.clear()
    semantic = spark.range(100).select(F.col("id").alias("query_id"), (F.col("id") + 1).alias("doc_id"), F.lit(0.5).alias("score"))
    _no_broadcast(retrieval.hybrid(table.withColumn("metadata", F.create_map(F.lit("lang"), F.lit("en"))), queries, semantic, wanted={"lang": "en"}))
