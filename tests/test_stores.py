"""Vector blocks, proximity graphs, stored tables and shortest paths against plain Python."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.functions import blocks
from dossier.operators import compare, paths, proximity, search
from dossier.sources.store import Buckets, GraphStore, Manifest, VectorStore


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def clustered(seed, n, dim, centres, noise):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    return [(i, [float(x) for x in c[i % centres] + noise * rng.normal(size=dim)], i % 3) for i in range(n)]


@pytest.mark.parametrize("by", [None, "label"])
def test_alike(spark, monkeypatch, by):
    monkeypatch.setattr(blocks, "ROWS", 32)
    monkeypatch.setattr(blocks, "STRIP", 8)
    rows = clustered(1, 300, 24, 9, 0.5) + [(400, None, 0), (401, [0.0] * 24, 0), (402, [1.0] * 3, 1), (403, [2.0] * 3, 1), (404, [1.0, None], 1), (405, [], 0), (None, [1.0] * 24, 0)]
    rows += [(500 + i, rows[5][1], i % 2) for i in range(40)] + [(600, rows[7][1], None)]
    cosine = lambda u, v: float(np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v))) if np.any(u) and np.any(v) else 0.0
    good = [r for r in rows if r[0] is not None and r[1] is not None and None not in r[1] and (by is None or r[2] is not None)]
    want = {(a, b): cosine(u, v) for a, u, x in good for b, v, y in good if a < b and len(u) == len(v) and (by is None or x == y) and cosine(u, v) >= 0.8}
    got = {(r.a, r.b): r.similarity for r in blocks.alike(vectors_of(spark, rows), 0.8, by).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    links = defaultdict(set)
    for a, b in want:
        links[a].add(b), links[b].add(a)
    for r in compare.similar_classes(vectors_of(spark, [x for x in rows if x[0] is not None]), 0.8, by).collect():
        seen, work = {r.vec_id}, [r.vec_id]
        while work:
            for j in links[work.pop()] - seen:
                seen.add(j), work.append(j)
        assert (r.n_links, r["class"]) == (len(links[r.vec_id]), min(seen))


def test_survivors_are_all_links():
    rng = np.random.default_rng(3)
    x, y = (blocks._unit(rng.normal(size=(90, 40))) for _ in range(2))
    y[:20] = blocks._unit(x[:20] + 0.2 * rng.normal(size=(20, 40)))
    r, c = blocks.survivors(x, y, 0.7)
    assert set(zip(*np.nonzero(x @ y.T >= 0.7), strict=True)) <= set(zip(r, c, strict=True)) and len(r) < 40


def test_block_pairs_are_spread(spark):
    """100,000 vectors: each pair of blocks once, no task with over 2 / tasks of them."""
    n = 100_000 // blocks.ROWS + 1
    table = spark.range(n).select(F.lit(4).alias("dim"), F.lit("").alias("g"), F.col("id").alias("block"))
    for tasks in (8, 40):
        met = blocks.block_pairs(table, tasks).select("x_block", "y_block", F.spark_partition_id().alias("task")).collect()
        assert sorted(tuple(sorted((r.x_block, r.y_block))) for r in met) == [(a, b) for a in range(n) for b in range(a, n)]
        loads = np.bincount([r.task for r in met], minlength=tasks)
        assert len(loads) == tasks and loads.max() <= 2 * len(met) / tasks


def test_no_single_task_in_vector_searches(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    for df in (search.cosine_top_k(vectors), search.l2_top_k(vectors, same_label=False), search.ivf_top_k(vectors)):
        assert "SinglePartition" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [clustered(5, 3000, 16, 40, 0.4), clustered(6, 2500, 24, 2500, 0.0)], ids=["clusters", "random"])
def test_proximity_recall(spark, rows):
    vectors = vectors_of(spark, rows + [(9000, None, 0), (9001, [0.0] * len(rows[0][1]), 0), (9002, [1.0, 2.0], 0), (9003, [2.0, 1.0], 0)])
    index = proximity.proximity_index(vectors, 700)
    held = [i for r in index.collect() for i in np.frombuffer(r.ids, np.int64).tolist()]
    assert sorted(held) == sorted([r[0] for r in rows] + [9001, 9002, 9003])
    got = defaultdict(set)
    for r in proximity.proximity_top_k(index, vectors.where("vec_id % 25 = 0"), 5).collect():
        assert r.query_id != r.vec_id
        got[r.query_id].add(r.vec_id)
    x = np.array([r[1] for r in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, len(rows), 25):
        s = x @ x[q]
        s[q] = -9
        hits += len(got[q] & set(np.argsort(-s)[:5].tolist()))
    assert hits >= 0.9 * 5 * len(range(0, len(rows), 25))


def test_proximity_index_is_kept(spark, sf, tmp_path):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    proximity.proximity_index(vectors).write.parquet(f"{tmp_path}/index")
    got = {(r.query_id, r.vec_id) for r in proximity.proximity_top_k(spark.read.parquet(f"{tmp_path}/index"), vectors.where("vec_id % 100 = 0")).collect()}
    want = {(r.query_id, r.vec_id) for r in search.cosine_top_k(vectors).collect()}
    assert len(got & want) >= 0.9 * len(want)


def nearest(held, queries, k):
    out = {}
    for q, v in queries:
        s = sorted((-round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, w in held.items() if i != q)
        out[q] = [i for _, i in s[:k]]
    return out


def test_vector_store(spark, tmp_path):
    rows = clustered(8, 240, 8, 6, 0.6)
    data = {i: v for i, v, _ in rows}
    store, held = VectorStore.create(vectors_of(spark, rows), f"{tmp_path}/store", 6), {}
    table = lambda ids: vectors_of(spark, [(i, data[i], i % 3) for i in ids])
    ids_of = lambda ids: spark.createDataFrame([(i,) for i in ids], "vec_id long")

    def same():
        assert store.count() == len(held) and {r.vec_id: list(r.embedding) for r in store.load().collect()} == held
        got = defaultdict(list)
        for r in store.search(table(range(0, 240, 30)), 4).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        assert got == nearest(held, [(q, data[q]) for q in range(0, 240, 30)], 4)

    store.add(table(range(200)))
    held.update({i: data[i] for i in range(200)})
    same()
    store.delete(ids_of([*range(0, 60, 2), 999]))
    held = {i: v for i, v in held.items() if not (i < 60 and i % 2 == 0)}
    same()
    data[101] = [9.0] * 8
    store.add(table([10, 101, *range(200, 240)]))
    held.update({i: data[i] for i in [10, 101, *range(200, 240)]})
    same()
    assert [r.vec_id for r in store.get(ids_of([10, 12, 13])).orderBy("vec_id").collect()] == [10, 13]
    copy = store.save(f"{tmp_path}/copy")
    assert store.compact() and store.compact() == []
    same()
    # of an addition to one cell and a deletion in another only these are rewritten
    before = {e["cell"]: e["folder"] for e in store.manifest.read()["entries"]}
    cells = {r.vec_id: r.cell for r in store._segments(store.manifest.read()).collect()}
    gone = next(i for i in held if cells[i] != cells[101])
    store.delete(ids_of([gone]))
    held.pop(gone)
    assert store.compact() == [cells[gone]]
    after = {e["cell"]: e["folder"] for e in store.manifest.read()["entries"]}
    assert {c for c in before if before[c] != after.get(c)} == {cells[gone]}
    store.manifest.vacuum()
    store = VectorStore(spark, f"{tmp_path}/store")
    same()
    near = {(r.query_id, r.vec_id) for r in store.search(table(range(0, 240, 10)), 4, probes=6).collect()}
    assert near == {(r.query_id, r.vec_id) for r in store.search(table(range(0, 240, 10)), 4).collect()}
    store.clear()
    assert store.count() == 0 and copy.count() == len(held) + 1 and VectorStore(spark, f"{tmp_path}/copy").count() == len(held) + 1
    with pytest.raises(ValueError, match="no store"):
        VectorStore(spark, f"{tmp_path}/none").count()


def test_manifest_has_one_writer(spark, tmp_path):
    one, two = Manifest(spark, f"{tmp_path}/m"), Manifest(spark, f"{tmp_path}/m")
    assert one.read() == {"entries": [], "applied": [], "above": 0}
    seen = two.version()
    one.commit({"entries": [], "applied": [], "above": 0}, one.version())
    with pytest.raises(ValueError, match="by another"):
        two.commit({"entries": [1], "applied": [], "above": 0}, seen)
    assert two.version() == 1 and two.read()["entries"] == []


def test_graph_store(spark, tmp_path):
    events = [("A", "x", 0.5, "m1", 5), ("a", "x", 0.9, "m0", 1), ("b", "y", 0.1, None, 3), ("c", "x", 0.2, "late", 9), ("A", "y", 0.3, "n", 2), ("b", "y", 0.7, "w", 3), (None, "x", 1.0, "z", 1)]
    table = spark.createDataFrame(events, "name string, type string, confidence double, metadata string, second int").withColumn("at", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, second)")).drop("second")
    store = GraphStore(spark, f"{tmp_path}/g", 8)
    links = lambda *rows: spark.createDataFrame(rows, "src string, dst string, type string, confidence double")
    assert store.merge(3, table.where("metadata = 'late' or name = 'b'"), links(("a", "b", "r", 0.5), ("a", "b", "r", 0.7), (None, "b", "r", 1.0)))
    folders = {e["bucket"]: e["folder"] for e in store.entities.manifest.read()["entries"]}
    assert store.merge(1, table.where("metadata = 'm1'"), links(("a", "b", "r", 0.6)))
    after = {e["bucket"]: e["folder"] for e in store.entities.manifest.read()["entries"]}
    assert sum(after[b] != folders.get(b) for b in after) == 1 and all(b in after for b in folders)
    assert not store.merge(3, table, links(("q", "q", "q", 1.0)))
    assert store.merge(2, table.where("metadata in ('m0', 'n', 'z')"), links(("c", "a", "s", 0.1)))
    assert not store.merge(1, table) and store.entities.manifest.read()["above"] == 3
    entities, relations = GraphStore(spark, f"{tmp_path}/g", 8).load()
    assert sorted(map(tuple, entities.collect())) == [("a", "x", 2, 0.9, "m1"), ("a", "y", 1, 0.3, "n"), ("b", "y", 2, 0.7, "w"), ("c", "x", 1, 0.2, "late")]
    assert sorted(map(tuple, relations.collect())) == [("a", "b", "r", 0.7, 3), ("c", "a", "s", 0.1, 1)]


def test_buckets_versions(spark, tmp_path):
    table = Buckets(spark, f"{tmp_path}/b", ["k"], "k long, n long", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), 4)
    assert table.load().collect() == []
    for i in (1, 2):
        table.merge(spark.range(10).select(F.col("id").alias("k"), F.lit(i).cast("long").alias("n")), i)
    assert {r.n for r in table.load().collect()} == {3} and {r.n for r in table.load(1).collect()} == {1}


def brute_paths(edges, pairs, hops, most):
    step, out = defaultdict(set), []
    for a, b in edges:
        if a != b:
            step[a].add(b)
    for a, b in sorted({p for p in pairs if p[0] != p[1]}):
        level = [(a,)]
        for n in range(1, hops + 1):
            level = [(*p, x) for p in level for x in step[p[-1]]]
            hit = sorted(p for p in level if p[-1] == b)
            if hit:
                out += [(a, b, n, i + 1, ">".join(p)) for i, p in enumerate(hit[:most])]
                break
    return sorted(out)


@pytest.mark.parametrize("hops", [1, 2, 3, 4])
def test_shortest_paths(spark, hops):
    rng = random.Random(hops)
    nodes = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)] + [("h", n) for n in nodes] + [(n, "z") for n in nodes]
    pairs = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(25)] + [("h", "z"), ("z", "h"), ("h", "h"), ("none", "z")]
    got = paths.all_shortest_paths(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame(pairs, "src string, dst string"), hops, 5)
    assert sorted(map(tuple, got.collect())) == brute_paths(edges, pairs, hops, 5)
