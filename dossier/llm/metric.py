"""Embedding near-dedup: an exact metric range join over the angle between vectors, which is a metric.

The vectors of a label are partitioned by pivots into cells, each vector into that of its nearest pivot. A linked pair
either shares a cell or lies on both sides of a border, and then the triangle inequality bounds how far from it: such a
vector is copied into the lower cell as a guest, so cells are joined independently. Within a cell the same inequality,
on the angles to the cell's pivot, cuts rings; only blocks of the same or of neighbouring rings meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import ceil_div, components, cut, partitions

#: Vectors of a packed block, and rows of it that are multiplied at once.
ROWS, STRIP = 2048, 512
#: Labels with more rows than this get pivots, the LABELS largest of them; a label's pivots are chosen on SAMPLE of its vectors.
LEAST, LABELS, SAMPLE, MOST_PIVOTS = 1024, 64, 512, 256
#: Comparisons of vectors that cost as much as moving one row.
ROW_COST = 5000
#: Cosines this close to the threshold are computed again, plainly.
NARROW = 1e-9
#: What rounding may add to an angle.
SLACK = 1e-6


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled first, so that squares neither overflow nor vanish."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _coded(batches: Iterator, wide: bool):
    """vec_id, label, and of vectors that can have links dim, a digest of the components, and the components' bytes."""
    import pyarrow as pa

    kind = np.float64 if wide else np.float32
    for batch in batches:
        lists, ids, labels = batch.column("v"), batch.column("vec_id"), batch.column("label")
        sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(sizes)]
        inner = lists.flatten()
        # a null component counts as one that isn't finite; adding 0 makes -0.0 and 0.0 the same bytes
        values = inner.cast(pa.float64() if wide else pa.float32()).fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(kind) + kind(0)
        broken = np.r_[0, np.cumsum(~np.isfinite(values))]
        filled = np.r_[0, np.cumsum(values != 0)]
        good = (sizes > 0) & (broken[ends[1:]] == broken[ends[:-1]]) & (filled[ends[1:]] > filled[ends[:-1]])
        good &= ids.is_valid().to_numpy(zero_copy_only=False) & labels.is_valid().to_numpy(zero_copy_only=False)
        data = [values[ends[i] : ends[i + 1]].tobytes() if good[i] else None for i in range(len(good))]
        digest = [None if d is None else hashlib.blake2b(d, digest_size=16).digest() for d in data]
        yield pa.RecordBatch.from_arrays([ids, labels, pa.array(sizes.astype(np.int32)), pa.array(digest, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "label", "dim", "digest", "v"])


def choose_pivots(sample: np.ndarray, n: int, angle: float) -> np.ndarray:
    """Of the first 2, 4, 8, ... vectors of a sample of unit vectors, as pivots, those under which n such vectors cost least:
    pairs that are compared, and rows that are moved, by the replication that the sample shows."""
    best, cost, count = sample[:2], math.inf, 2
    while count <= min(MOST_PIVOTS, len(sample)):
        home, near = near_cells(sample, sample[:count], angle)
        at = np.bincount(home, minlength=count) / len(sample)
        guests = near.sum(axis=0) / len(sample)
        now = n * n * float((at * at / 2 + at * guests).sum()) + n * ROW_COST * float(1 + guests.sum())
        if now < cost:
            best, cost = sample[:count], now
        count *= 2
    return best


def near_cells(x: np.ndarray, pivots: np.ndarray, angle: float) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each unit vector, and which lower cells hold vectors within angle of it at most.

    The angle to the other pivot is at most that to its own plus twice the threshold angle (triangle inequality); and
    as a link crosses the hyperplane between two pivots, the angle to that is at most the threshold angle.
    """
    dots = x @ pivots.T
    theta = np.arccos(np.clip(dots, -1, 1))
    home = theta.argmin(axis=1)
    mine = np.arange(len(x))
    near = (np.arange(len(pivots)) < home[:, None]) & (theta <= theta[mine, home][:, None] + 2 * angle + SLACK)
    if angle < math.pi / 2:
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.clip(pivots @ pivots.T, -1, 1)))[home]
        near &= dots[mine, home][:, None] - dots <= apart * math.sin(angle) + SLACK
    return home, near


def _placed(batches: Iterator, pivots: dict, slots: dict, angle: float, wide: bool):
    """A row for each vector's home cell (guest 0) and for each lower cell it may have links in (guest 1)."""
    import pyarrow as pa

    kind, width = np.float64 if wide else np.float32, angle + 1e-4
    for batch in batches:
        frame = pd.DataFrame({"label": batch.column("label").to_pandas(), "dim": batch.column("dim").to_numpy()})
        take, cells, guest, ring, slot = ([] for _ in range(5))
        for (label, dim), rows in frame.groupby(["label", "dim"], sort=False).indices.items():
            p = pivots.get((label, dim))
            slot_of = slots.get((label, dim), 1)
            if p is None:
                parts = [(rows, np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64))]
            else:
                data = batch.column("v").take(pa.array(rows)).to_pylist()
                x = unit(np.frombuffer(b"".join(data), kind).reshape(len(rows), dim))
                theta = np.arccos(np.clip(x @ p.T, -1, 1))
                home, near = near_cells(x, p, angle)
                i, c = np.nonzero(near)
                rings = np.floor(theta / width).astype(np.int64)
                own = np.arange(len(rows))
                parts = [(rows, home, np.zeros(len(rows), np.int64), rings[own, home]), (rows[i], c, np.ones(len(i), np.int64), rings[i, c])]
            for r, c, g, k in parts:
                take.append(r), cells.append(c), guest.append(g), ring.append(k), slot.append(np.full(len(r), slot_of))
        if take:
            at = pa.array(np.concatenate(take))
            columns = [batch.column(c).take(at) for c in ("label", "dim", "vec_id", "copies", "v")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.concatenate(x).astype(np.int32)) for x in (cells, guest, ring, slot))], names=["label", "dim", "vec_id", "copies", "v", "cell", "guest", "ring", "slots"])


def _pack(batches: Iterator, rows: int):
    """Blocks of at most rows vectors; the partition is sorted by label, dim, cell, guest and ring."""
    import pyarrow as pa

    names, held, last = ["label", "dim", "cell", "guest", "ring"], [], None

    def out():
        ids, copies, data = zip(*held, strict=True)
        columns = [pa.array([x], t) for x, t in zip(last, (pa.string(), *[pa.int32()] * 4), strict=True)]
        columns += [pa.array([x], pa.binary()) for x in (np.asarray(ids, np.int64).tobytes(), np.asarray(copies, np.int64).tobytes(), b"".join(data))]
        return pa.RecordBatch.from_arrays(columns, names=[*names, "ids", "copies", "matrix"])

    for batch in batches:
        for *key, i, n, v in zip(*(batch.column(c).to_pylist() for c in (*names, "vec_id", "copies", "v")), strict=True):
            if held and (key != last or len(held) == rows):
                yield out()
                held = []
            last = key
            held.append((i, n, v))
    if held:
        yield out()


def cosine_links(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y have a cosine in double precision of at least threshold.

    A product in single precision decides all but what lies within its rounding of the threshold; that is computed in
    double precision, and what is still within NARROW with exact sums.
    """
    ux, uy = unit(x), unit(y)
    sx, sy = ux.astype(np.float32), uy.astype(np.float32).T
    margin = np.float32(1e-6 + 2e-7 * x.shape[1])
    link = np.zeros((len(x), len(y)), bool)
    for at in range(0, len(x), STRIP):
        c = sx[at : at + STRIP] @ sy
        low = c >= np.float32(threshold) - margin
        if not low.any():
            continue
        strip = c > np.float32(threshold) + margin
        r, s = np.nonzero(low & ~strip)
        for k in range(0, len(r), 1 << 14):
            p, q = r[k : k + (1 << 14)] + at, s[k : k + (1 << 14)]
            exact = np.einsum("ij,ij->i", ux[p], uy[q])
            yes = exact >= threshold
            for j in np.flatnonzero(np.abs(exact - threshold) < NARROW):
                a, b = (m[i].astype(np.float64) / np.abs(m[i]).max() for m, i in ((x, p[j]), (y, q[j])))
                yes[j] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b)) >= threshold
            strip[p - at, q] = yes
        link[at : at + STRIP] = strip
    return link


def _joined(batches: Iterator, threshold: float):
    """Links within pairs of blocks: how many each vector has there, and the edges of a spanning forest."""
    import pyarrow as pa

    def out(ids, links, to):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), to], names=["vec_id", "links", "to"])

    for batch in batches:
        for dim, x_ids, x_copies, x, y_ids, y_copies, y, same in zip(*(batch.column(c).to_pylist() for c in ("dim", "x_ids", "x_copies", "x", "y_ids", "y_copies", "y", "same")), strict=True):
            xi, xn, yi, yn = (np.frombuffer(b, np.int64) for b in (x_ids, x_copies, y_ids, y_copies))
            kind = np.float32 if len(x) == 4 * dim * len(xi) else np.float64
            link = cosine_links(np.frombuffer(x, kind).reshape(-1, dim), np.frombuffer(y, kind).reshape(-1, dim), threshold)
            if same:
                np.fill_diagonal(link, False)
            rows, columns = np.flatnonzero(link.any(axis=1)), np.flatnonzero(link.any(axis=0))
            if not len(rows):
                continue
            few = link[np.ix_(rows, columns)]
            weight = few.astype(np.float64)
            yield out(xi[rows], (weight @ yn[columns]).astype(np.int64), pa.nulls(len(rows), pa.int64()))
            if not same:
                yield out(yi[columns], (weight.T @ xn[rows]).astype(np.int64), pa.nulls(len(columns), pa.int64()))
            a, b = spanning_edges(few, xi[rows], yi[columns])
            yield out(a, np.zeros(len(a), np.int64), pa.array(b, pa.int64()))


def spanning_edges(link: np.ndarray, xi: np.ndarray, yi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars from the smallest id of each component of a link matrix: fewer edges than there are vectors."""
    waiting = link.any(axis=1)
    a, b = [], []
    while waiting.any():
        columns = np.flatnonzero(link[waiting.argmax()])
        while True:
            rows = np.flatnonzero(link[:, columns].any(axis=1))
            wider = np.flatnonzero(link[rows].any(axis=0))
            if len(wider) == len(columns):
                break
            columns = wider
        waiting[rows] = False
        ids = np.unique(np.r_[xi[rows], yi[columns]])
        a.append(np.full(len(ids) - 1, ids[0])), b.append(ids[1:])
    return np.concatenate(a), np.concatenate(b)


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """One row per row of vectors(vec_id, embedding, label, ...): vec_id, n_links, component_id, kept.

    Vectors of equal, non-null labels and of equal length are linked if their cosine in double precision is at
    least threshold; n_links counts the other vectors linked directly, component_id is the smallest vec_id
    reachable, kept says that it is the row's own. Vectors that are null, empty or zero, or hold null or
    non-finite components, link with nothing: n_links 0, component_id their own. vec_id is a key: rows that repeat
    one with other vectors share a component and the sum of their links; a row without one links with nothing and has a null
    component. An empty table gives
    no rows. Other columns are ignored.

    Equal vectors of a label collapse to one with a count, by a digest of their bytes. Links are counted where blocks meet
    and leave a block pair only as counts and star edges, so a group of g near copies sends O(g) rows, not g * g. A cell of
    any size is joined block by block.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType
    wide = not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType))
    slim = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>" if wide else "array<float>").alias("v"))
    coded = slim.mapInArrow(lambda b: _coded(b, wide), "vec_id long, label string, dim int, digest binary, v binary")
    classes = cut(coded.where("digest is not null").groupBy("label", "digest").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"), F.first("dim").alias("dim"), F.first("v").alias("v")), "classes")
    n = classes.count()
    angle = math.acos(max(-1.0, min(1.0, threshold)))
    # a bounded look at the largest labels: their sizes, and some vectors of each by a hash of the id
    large = {(r.label, r.dim): r["count"] for r in classes.groupBy("label", "dim").count().where(F.col("count") > LEAST).orderBy(F.desc("count"), "label", "dim").limit(LABELS).collect()}
    pivots, slots = {}, {}
    if large:
        share = F.coalesce(*[F.when((F.col("label") == label) & (F.col("dim") == dim), F.lit(2 * SAMPLE / count)) for (label, dim), count in large.items()])
        drawn = classes.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < share * (1 << 20)).select("label", "dim", "v", "vec_id").limit(4 * SAMPLE * len(large)).collect()
        for (label, dim), count in large.items():
            mine = sorted((r for r in drawn if (r.label, r.dim) == (label, dim)), key=lambda r: hashlib.blake2b(bytes(r.v)).digest())[:SAMPLE]
            if len(mine) >= 2:
                pivots[label, dim] = choose_pivots(unit(np.frombuffer(b"".join(bytes(r.v) for r in mine), np.float64 if wide else np.float32).reshape(-1, dim)), count, angle)
            slots[label, dim] = ceil_div(count, 2 * ROWS * len(pivots.get((label, dim), [0])))
    columns = "label string, dim int, vec_id long, copies long, v binary, cell int, guest int, ring int, slots int"
    placed = classes.repartition(max(partitions(spark), ceil_div(n, 1 << 16)), "vec_id").select("label", "dim", "vec_id", "copies", "v").mapInArrow(lambda b: _placed(b, pivots, slots, angle, wide), columns)
    slot = F.pmod(F.xxhash64("vec_id"), F.col("slots"))
    dealt = placed.repartition(max(partitions(spark), ceil_div(n, 4 * ROWS)), "label", "dim", "cell", "guest", "ring", slot).sortWithinPartitions("label", "dim", "cell", "guest", "ring", "vec_id")
    packed = dealt.mapInArrow(lambda b: _pack(b, ROWS), "label string, dim int, cell int, guest int, ring int, ids binary, copies binary, matrix binary")
    blocks = cut(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    side = lambda s: blocks.select("label", "dim", "cell", F.col("guest").alias(f"{s}_guest"), F.col("ring").alias(f"{s}_ring"), F.col("block").alias(f"{s}_block"), F.col("ids").alias(f"{s}_ids"), F.col("copies").alias(f"{s}_copies"), F.col("matrix").alias(s))
    # two guests of a cell meet in a home cell of one of them
    pairs = side("x").where("x_guest = 0").join(side("y"), ["label", "dim", "cell"]).where("(y_guest = 1 or x_block <= y_block) and abs(x_ring - y_ring) <= 1")
    pairs = pairs.withColumn("same", F.expr("y_guest = 0 and x_block = y_block")).select("dim", "x_ids", "x_copies", "x", "y_ids", "y_copies", "y", "same")
    found = cut(pairs.mapInArrow(lambda b: _joined(b, threshold), "vec_id long, links long, to long"), "found")
    links = found.where("to is null").groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.where("to is not null").select("vec_id", "to"), "vec_id", "to").select(F.col("node").alias("vec_id"), "component")
    # cosines of copies are 1 and link if the threshold is at most that
    own = F.col("copies") - 1 if threshold <= 1 else F.lit(0)
    groups = classes.select("label", "digest", "vec_id", "copies").join(links, "vec_id", "left").join(parts, "vec_id", "left")
    groups = groups.select("label", "digest", (F.coalesce("links", F.lit(0)) + own).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    rows = coded.select("vec_id", "label", "digest")
    linked = rows.where("digest is not null").join(groups, ["label", "digest"], "left").select("vec_id", "n_links", "component_id")
    alone = rows.where("digest is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
