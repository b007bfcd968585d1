"""The operators of the llm subpackage against brute force, with nulls, empties, ties, repeats and clashing columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from urllib.parse import quote

import pytest
from oracle import compare, connect

from dossier.llm import metric, minhash, mixing, packing, quality, secrets, suffix, topk, toxicity, warc
from dossier.llm.queries import ORACLE_SQL, QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, kept string, bands string, row string, n string"
FILL = ["x"] * 5


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, *FILL) for i, t, s in rows], DOCS)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    got, want = compare(QUERIES[name](spark, sf), connect(sf), ORACLE_SQL[name])
    assert got == want and len(got) > 1


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, v string, component string, copies long")


def test_top_k_edges(spark):
    rows = [(i, [float(i % 7), float(-i % 5), 0.5], 0) for i in range(60)] + [(60, None, 0), (61, [1.0, None, 2.0], 0), (80, [1.0, float("nan"), 0.0], 0), (100, [float("inf"), 0.0, 0.0], 0), (None, [1.0, 1.0, 1.0], 0), (120, [], 0)]
    got = [tuple(r) for r in topk.exact_top_k(vectors_of(spark, rows), k=20, every=20).select("query_id", "rank", "vec_id", "score").collect()]
    good = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in [i for i in good if i % 20 == 0]:
        ranked = sorted((-sum(a * b for a, b in zip(good[q], good[c])), c) for c in good if c != q)[:20]
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(ranked)]
    assert sorted(got) == sorted(want)
    assert topk.exact_top_k(vectors_of(spark, [])).count() == 0


def test_near_vectors_edges(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(6)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in centres[i % 6]], i % 2 if i % 11 else None) for i in range(300)]
    rows += [(300, None, 0), (301, [0.0] * 8, 0), (302, [float("nan")] * 8, 0), (303, [], 0), (304, rows[0][1], rows[2][2]), (305, rows[2][1], rows[2][2]), (306, [1.0, 2.0], 1), (307, [2.0, 4.0], 1)]
    table = vectors_of(spark, rows)
    stored = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    links = {i: set() for i, *_ in rows}
    for a, u, x in stored:
        for b, v, y in stored:
            if a != b and x is not None and x == y and u and v and len(u) == len(v):
                nu, nv = math.sqrt(sum(p * p for p in u)), math.sqrt(sum(p * p for p in v))
                if nu and nv and sum(p * q for p, q in zip(u, v)) / nu / nv >= 0.93:
                    links[a].add(b)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in metric.near_vectors(table).collect()}
    for i in links:
        seen, work = {i}, [i]
        while work:
            for j in links[work.pop()] - seen:
                seen.add(j), work.append(j)
        assert got[i] == (len(links[i]), min(seen), min(seen) == i)
    assert metric.near_vectors(vectors_of(spark, [])).count() == 0


def test_packing(spark):
    rows = [(i, prose(i, random.Random(i).choice([1, 30, 500, 700, 1500, 4096, 9000])), "a") for i in range(120)] + [(None, "one two", "a"), (1, "again", "a"), (1, "again", "a"), (500, None, "a"), (501, " \n", "a")]
    got = packing.pack(docs_of(spark, rows)).collect()
    bins, words = {}, Counter()
    for r in got:
        bins.setdefault(r.bin_id, []).append(r)
        words[r.doc_id] += r.n_words
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").split())
    assert words == +want
    for held in bins.values():
        used, (capacity,) = sum(r.n_words for r in held), {r.capacity for r in held}
        assert capacity == min(c for c in packing.LENGTHS if c >= used)
        at = 0
        for r in sorted(held, key=lambda r: r.position):
            assert r.position == at
            at += r.n_words
    assert packing.pack(docs_of(spark, [])).count() == 0
    best, final, cost = packing.best_fit([4, 3, 3, 2], [4, 8], 8, 1)
    assert best == [0, 0, 1, 1] and final == [8, 8] and cost == 18


BASE = {"assign": r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}


def plain_base(text):
    out = []
    for k, p in BASE.items():
        for m in re.finditer(p, text or ""):
            if (len(m[2]) >= 6) if k == "assign" else len(m[0]) >= (20 if k == "access" else 24):
                out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], list(BASE).index(s[0])))


def test_secrets(spark):
    key = "AKIA" + "Q" * 16
    b64 = lambda x: base64.b64encode(x if isinstance(x, bytes) else x.encode()).decode()
    layers = {"url": quote(f"password={key}", safe=""), "twice": quote(quote(f"token: {key}", safe=""), safe=""), "b64": b64(f"my secret='{key}' end"), "nested": b64(quote(b64(f"api_key={key}"))), "gzip": b64(gzip.compress(f"passwd={key}".encode(), mtime=0)), "zlib": b64(zlib.compress(zlib.compress(f"passwd={key}".encode()))), "unicode": "".join(f"\\u{ord(c):04x}" for c in f"token={key}")}
    rows = [(i, f"é start {t} end", "a") for i, t in enumerate(layers.values())]
    rows += [(20, f'Password"  = "abcdef" and SECRET:abc AKIAAKIA{"0" * 14} {"ab" * 15}', "a"), (21, None, "a"), (22, "", "a"), (22, "", "a"), (None, "token=abcdefg", "a"), (23, "x%25" * 3000, "a"), (24, "ſecret=abcdefgh toKen=abcdefgh", "a")]
    got = secrets.scan(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id): r for r in got}
    for i, t, _ in rows:
        base = plain_base(t)
        assert by[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert (by[i].n_assign, by[i].n_access, by[i].n_hex) == tuple(sum(s[0] == k for s in base) for k in BASE)
    for i, t in enumerate(layers.values()):
        found = [s.split(":") for s in by[i].spans.split(",")]
        assert any(k == "access" for k, *_ in found) and any(k == "assign" for k, *_ in found), list(layers)[i]
        assert all(8 <= int(a) < int(b) <= 8 + len(t) for _, a, b in found)
        assert key not in secrets.mask(rows[i][1])
    assert secrets.scan(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize(("name", "label"), [("op5_quality", "quality"), ("op6_toxicity", "toxic")])
def test_classifiers(spark, name, label):
    at = "/root/testdata/sf0.01"
    scored = QUERIES[name](spark, at).collect()
    assert len(scored) == 1000
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    for r in scored:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [(r.score, truth[r.doc_id]) for r in scored if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    print(name, "held out:", len(held), "AUC", round(auc, 3))
    assert auc > 0.8


@pytest.mark.parametrize(("module", "label"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifier_edges(spark, module, label):
    rows = [(i, prose(i, 30), "a") for i in range(8)] + [(None, None, None), (3, "", "a"), (9, "x" * 300_000, "b")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(8)] + [(None, 1), (1, None), (2, 7)], f"doc_id long, {label} int")
    got = module(docs_of(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = module(docs_of(spark, rows), labels.limit(0)).collect()
    assert all(abs(r.score - 0.5) < 1e-6 for r in empty)
    assert module(docs_of(spark, []), labels).count() == 0


def test_isotonic():
    import numpy as np

    x, y = toxicity.isotonic(np.array([0.0, 1, 2, 3]), np.array([0, 1, 0, 1]))
    assert (np.diff(y) >= 0).all() and y[0] < y[-1] and len(x) == len(y)


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, prose(i, max(1, int(rng.lognormvariate(4, 1)))), f"s{i * i % 7}" if i % 9 else None) for i in range(2000)] + [(5000, None, "tiny"), (5001, " ", "tiny"), (5002, "one", "solo"), (None, "a b", "s1"), (6000, "a b", "s1"), (6000, "a b", "s1")]
    table = docs_of(spark, rows)
    got = mixing.mix(table).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else left * weight[s] / total
        if not over:
            break
        open_ -= over
        left -= sum(target[s] for s in over)
    taken = Counter()
    source = {}
    for i, _, s in rows:
        source[i] = s
    for r in got:
        assert r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]]
        taken[source[r.doc_id]] += r.taken
    for s in order:
        if len([1 for x in rows if x[2] == s]) > 50:
            assert abs(taken[s] - target[s]) <= 0.02 * target[s]
    again = mixing.mix(table).collect()
    key = lambda x: sorted(((r.doc_id or -1, r.size, r.taken) for r in x))
    assert key(got) == key(again)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert mixing.mixed(table).count() == sum(r.copies for r in got)


def test_flight_keeps_the_sums():
    import numpy as np

    rng = np.random.default_rng(0)
    p, size = rng.uniform(0.1, 0.9, 500), rng.integers(1, 900, 500)
    out = mixing.flight(p.copy(), size, rng.uniform(size=500))
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert out.sum() == pytest.approx(p.sum(), abs=1e-5) and out @ size == pytest.approx(p @ size, abs=1e-2)


def test_warc_round_trip(spark, tmp_path):
    long = "<p>é" + "y" * 200
    rows = [(3, "u3", long), (1, "u1", long), (2, "u2", None), (4, "u4", "short"), (5, "u\r\n5", "short"), (6, None, "q" * 100), (6, "again", "q" * 100), (None, "u", long), (7, "u7", "q" * 99), (8, "u8", "q" * 99)]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, payload string, first string")
    warc.write_archive(pages, f"{tmp_path}/a")
    back = warc.read_archive(spark, f"{tmp_path}/a")
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, bytes(r.payload).decode()) for r in back.collect())
    assert got == sorted([(1, "response", 0, long), (3, "revisit", 1, long), (0, "revisit", 1, long), (2, "response", 0, ""), (4, "response", 0, "short"), (5, "response", 0, "short"), (6, "response", 0, "q" * 100), (6, "response", 0, "q" * 100), (7, "response", 0, "q" * 99), (8, "response", 0, "q" * 99)])
    assert spark.read.parquet(f"{tmp_path}/a/payloads").count() == 5
    warc.write_warc(back, f"{tmp_path}/w")
    read = warc.read_warc(spark, f"{tmp_path}/w").collect()
    assert len(read) == len(rows)
    for r in read:
        if r.record_type == "response":
            assert hashlib.sha256(bytes(r.payload)).hexdigest() == r.payload_digest
    assert warc.rebuilt(spark, warc.archived(pages.limit(0))).count() == 0


def test_minhash_edges(spark):
    text = prose(1, 120)
    near = text.replace("w1 ", "zz ", 1)
    rows = [(5, text, "a"), (3, text.upper(), "a"), (9, near, "a"), (1, prose(2, 120), "a"), (2, None, "a"), (4, "", "a"), (6, " \t", "a"), (7, "one two", "a"), (8, "ONE  two", "a"), (10, "one", "a"), (11, "two one", "a"), (None, text, "a"), (12, prose(3, 30_000), "a"), (5, text, "a")]
    rows += [(100 + i, " ".join([*prose(50, 60).split()[: 60 - i % 3], f"tail{i % 5}"]), "b") for i in range(60)]
    got = minhash.near_duplicates(docs_of(spark, rows), k=3, percent=85).collect()
    assert len(got) == len(rows)

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    linked = {i: {j for j in sets if j != i and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])} for i in sets}
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept is None
            continue
        seen, work = {r.doc_id}, [r.doc_id]
        while work:
            for j in linked[work.pop()] - seen:
                seen.add(j), work.append(j)
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), min(seen), min(seen) == r.doc_id)
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0


def removed(rows, length):
    where = Counter()
    texts = {i: (t or "").encode() for i, t, _ in rows}
    for b in texts.values():
        where.update(b[a : a + length] for a in range(len(b) - length + 1))
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for a in range(len(b) - length + 1):
            if where[b[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("options", [{"length": 40, "gram": 8, "span": 16}, {"length": 400, "gram": 48, "span": 64}])
def test_suffix(spark, options):
    n = options["length"]
    shared, loop = prose(9, n // 2), "ab" * n
    rows = [(i, prose(100 + i, 200) + ("é" + shared[: n + i] if i % 3 == 0 else ""), "a") for i in range(24)]
    rows += [(50, shared + prose(60, 40) + shared, "a"), (51, loop, "a"), (52, None, "a"), (53, "", "a"), (54, "x" * (n - 1), "a"), (55, "y" * n, "a"), (56, "y" * n, "a"), (57, "z" * (n + 1), "a"), (58, shared[:n], "a"), (59, shared[1 : n + 1], "a")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs_of(spark, rows), **options).collect()}
    assert got == removed(rows, n)
    assert suffix.remove_repeats(docs_of(spark, [])).count() == 0


def test_suffix_family():
    rng = random.Random(2)
    family, strings = suffix.SuffixFamily(6), []
    for _ in range(9):
        batch = [bytes(rng.choice(b"ab") for _ in range(14)) for _ in range(8)]
        strings += batch
        family.add(batch, [0] * 8, [9] * 8, [1] * 8)
        assert all(2 * len(b[0]) <= len(a[0]) for a, b in zip(family.levels, family.levels[1:]))
    where = Counter(s[t : t + 6] for s in strings for t in range(9))
    assert family.seen == [sum(1 << t for t in range(9) if where[s[t : t + 6]] > 1) for s in strings]


def test_suffix_parts_the_rows_of_a_frequent_core(spark, monkeypatch):
    plans, write = {}, suffix.cut

    def cut(df, name):
        if name == "hits":
            df.collect()
            plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(df, name)

    monkeypatch.setattr(suffix, "cut", cut)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512b", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512b", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    rows = [(i, "y" * 3000 + prose(200 + i, 9), "a") for i in range(16)]
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs_of(spark, rows).repartition(4)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert got == removed(rows, 400)
    assert "skew=true" in plans["hits"]


@pytest.mark.parametrize("options", [{"length": 40, "gram": 8, "span": 15}, {"length": 400, "gram": 48, "span": 64}])
def test_suffix_parts_a_crowded_core(spark, monkeypatch, options):
    n, span, written, write = options["length"], options["span"], {}, suffix.cut
    shared = prose(9, n)

    def cut(df, name):
        written[name] = write(df, name)
        return written[name]

    monkeypatch.setattr(suffix, "cut", cut)
    monkeypatch.setattr(suffix, "CROWD", 8)
    rows = [(i, prose(300 + i, 60) + shared[i % 3 : n + 20 + i % 5] + prose(400 + i, 60), "a") for i in range(40)]
    rows += [(i, prose(300 + i, 60) + shared[:n] + prose(400 + i % 3, 60), "a") for i in range(40, 60)] + [(60, shared[:n], "a"), (61, rows[0][1], "a")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs_of(spark, rows), **options).collect()}
    assert got == removed(rows, n)
    keys = Counter(bytes(r.block[span - 1 : span + 15]) if len(r.block) == 2 * span + 14 else bytes(r.block[1 : span + 15]) for r in written["masks"].collect())
    assert any(len(k) > 16 for k in keys) and max(m for k, m in keys.items() if len(k) == 16) <= 8
