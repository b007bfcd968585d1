"""Vectors in packed blocks: scores of whole blocks by matrix products inside Arrow batches, where pairs of rows would be too many."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grid
from .tables import written

#: Rows of a block of vectors, of a block of queries, and rows that are compared at once.
ROWS, QUERIES, STRIP = 2048, 512, 256
#: Vectors of the sample that pivots are chosen from, and pivots; dimensions of a slice.
SAMPLE, PIVOTS, SLICE = 1024, 64, 16
#: Cells of the triangular grid for each task, so that hashing them evens out.
CELLS = 8
PACKED = "dim int, g string, ids binary, matrix binary, centre binary, radius double"


def usable(rows: DataFrame, by: str | None = None) -> DataFrame:
    """vec_id, v, g, dim of rows(vec_id, embedding); null ids, vectors and values of by, and vectors with a null component are left out."""
    slim = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), (F.col(by).cast("string") if by else F.lit("")).alias("g"))
    return slim.where("vec_id is not null and v is not null and g is not null").where(F.forall("v", lambda x: x.isNotNull())).withColumn("dim", F.size("v"))


def packed(slim: DataFrame, tasks: int, most: int = ROWS, near: np.ndarray | None = None, apart: bool = False) -> DataFrame:
    """PACKED: blocks of at most most vectors of one length and group, dealt to tasks by a hash of the id; with near, unit pivots,
    by the pivot that is nearest, so that the vectors of a block are near each other: all within radius (an angle) of its centre. With apart, groups are
    dealt by ranges, so that there are few blocks that aren't full: one for each group and task at most, not for each of both."""
    if near is None and apart:
        dealt = slim.withColumns({"cell": F.lit(0), "far": F.lit(0.0)}).repartitionByRange(tasks, "g", "dim", F.xxhash64("vec_id"))
    elif near is None:
        dealt = slim.withColumns({"cell": F.lit(0), "far": F.lit(0.0)}).repartition(tasks, F.pmod(F.xxhash64("vec_id"), F.lit(64 * tasks)))
    else:
        dealt = slim.mapInPandas(lambda b: _celled(b, near), slim.select("vec_id", "v", "g", "dim").schema.simpleString()[7:-1].replace(":", " ") + ", cell int, far double").repartitionByRange(tasks, "g", "dim", "cell", "far", "vec_id")
    dealt = dealt.sortWithinPartitions("g", "dim", "cell", "far", "vec_id").select("vec_id", "v", "g", "dim")

    def block(g: str, dim: int, part: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate(part["v"].to_numpy()).reshape(len(part), dim) if dim else np.zeros((len(part), 0))
        centre, radius = _ball(_unit(x))
        # single precision where nothing is lost: half of what travels
        slim = x.astype(np.float32)
        slim = slim if (slim == x).all() else x
        return pd.DataFrame({"dim": [dim], "g": [g], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()], "matrix": [slim.tobytes()], "centre": [centre.tobytes()], "radius": [radius]})

    def blocks(batches: Iterator[pd.DataFrame]):
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch])
            rest = None
            groups = list(batch.groupby(["g", "dim"], sort=False))
            for i, ((g, dim), part) in enumerate(groups):
                whole = len(part) if i < len(groups) - 1 else len(part) // most * most
                for at in range(0, whole, most):
                    yield block(g, dim, part.iloc[at : min(whole, at + most)])
                if whole < len(part):
                    rest = part.iloc[whole:]
        if rest is not None:
            yield block(rest["g"].iloc[0], rest["dim"].iloc[0], rest)

    return dealt.mapInPandas(blocks, PACKED)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; zero rows stay zero."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _ball(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit centre of unit rows and the largest angle to it; pi, if there is no such centre. Zero rows link with nothing."""
    some = x[(x * x).sum(axis=1) > 0]
    centre = some.sum(axis=0)
    length = np.linalg.norm(centre)
    if not len(some) or length < 1e-9:
        return np.zeros(x.shape[1]), float(np.pi)
    return centre / length, float(np.arccos(np.clip((some @ (centre / length)).min(), -1, 1)))


def pivots(slim: DataFrame, count: int = PIVOTS, sample: int = SAMPLE) -> np.ndarray | None:
    """Unit vectors far from each other among sample vectors by a hash of the id, of the length that is most common there."""
    drawn = slim.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()
    if not drawn:
        return None
    dim = Counter(len(r.v) for r in drawn).most_common(1)[0][0]
    x = _unit(np.array([r.v for r in drawn if len(r.v) == dim]).reshape(-1, dim))
    chosen, near = [0], np.full(len(x), -np.inf)
    while len(chosen) < min(count, len(x)):
        near = np.maximum(near, x @ x[chosen[-1]])
        if near.min() > 1 - 1e-9:
            break
        chosen.append(int(near.argmin()))
    return x[chosen]


def _celled(batches: Iterator[pd.DataFrame], near: np.ndarray):
    for batch in batches:
        fits = (batch["dim"] == near.shape[1]).to_numpy()
        cell, far = np.full(len(batch), -1, np.int32), np.zeros(len(batch))
        if fits.any():
            score = _unit(np.stack(batch["v"][fits].to_numpy())) @ near.T
            cell[fits], far[fits] = score.argmax(axis=1), -score.max(axis=1)
        yield batch.assign(cell=cell, far=far)


def _read(ids: bytes, matrix: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(matrix) == 4 * len(i) * dim else np.float64
    return i, np.frombuffer(matrix, kind).reshape(len(i), dim).astype(np.float64)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """0 where a vector is zero."""
    n, m = np.linalg.norm(x, axis=1)[:, None], np.linalg.norm(y, axis=1)[None, :]
    return np.divide(x @ y.T, n * m, out=np.zeros((len(x), len(y))), where=(n * m) > 0)


def closeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """1 / (1 + squared distance)."""
    return 1 / (1 + np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def best(queries: DataFrame, rows: DataFrame, score: Callable, k: int, by: str | None = None) -> DataFrame:
    """query_id, vec_id, score: for each query the k best of the rows (and some more, all that lie within a millionth of them among these), its own row
    left out; with by, of equal values alone. Queries and rows are dealt to blocks of one value, and those of a value meet in the cells of a
    grid, so neither side is in one task as a whole, and no block goes where it meets nothing."""
    tasks = _tasks(rows)
    asked, held = written(usable(queries, by), "asked"), written(usable(rows, by), "vectors")
    few = lambda slim, most: max(1, min(tasks, -(-slim.count() // most)))
    held = grid.placed(packed(held, few(held, ROWS), apart=by is not None).select("dim", "g", "ids", "matrix"), "blocks")
    asked = packed(asked, few(asked, QUERIES), QUERIES, apart=by is not None)
    asked = grid.placed(asked.select("dim", "g", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix")), "queries")

    def scored(batches: Iterator[pd.DataFrame]):
        same, least = None, None
        for batch in batches:
            for dim, a, p, b, q in zip(*(batch[c] for c in ("dim", "q_ids", "q_matrix", "ids", "matrix")), strict=True):
                (qi, x), (vi, y) = _read(a, p, dim), _read(b, q, dim)
                if same != (a, p):
                    # the blocks that a block of queries meets follow each other: what one of them leaves, the next ones must reach
                    same, least = (a, p), np.full(len(qi), -np.inf)
                s = score(x, y)
                s[qi[:, None] == vi[None, :]] = -np.inf
                if s.shape[1] >= k:
                    least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                r, c = np.nonzero((s >= least[:, None] - 1e-6) & (s > -np.inf))
                yield pd.DataFrame({"query_id": qi[r], "vec_id": vi[c], "score": s[r, c]})

    pairs = grid.met_alike(asked, held, ["dim", "g"], tasks).select("dim", "q_ids", "q_matrix", "ids", "matrix")
    return pairs.mapInPandas(scored, "query_id long, vec_id long, score double")


def block_pairs(blocks: DataFrame, tasks: int) -> DataFrame:
    """Every pair of blocks(block, ...) of one length and group once, a block with itself too, as columns x_... and y_...: blocks are dealt to groups,
    and each pair of groups is a cell of a triangular grid. A block is copied once for each group; a task holds some cells, about
    1 / tasks of all pairs."""
    count = blocks.count()
    groups = max(1, min(count, int(np.ceil((2 * CELLS * tasks) ** 0.5))))
    dealt = blocks.withColumn("group", F.pmod("block", F.lit(groups)))

    def side(s: str, cells) -> DataFrame:
        other = [F.col(c).alias(f"{s}_{c}") for c in blocks.columns if c not in ("dim", "g")]
        return dealt.withColumn("cell", F.explode(cells)).select("dim", "g", "group", "cell", *other)

    left = side("x", F.sequence("group", F.lit(groups - 1).cast("long"))).toDF("dim", "g", "lo", "hi", *[f"x_{c}" for c in blocks.columns if c not in ("dim", "g")])
    right = side("y", F.sequence(F.lit(0).cast("long"), "group")).toDF("dim", "g", "hi", "lo", *[f"y_{c}" for c in blocks.columns if c not in ("dim", "g")])
    # one key: Spark takes columns with a single known value out of a join, and would shuffle once more by the others, into fewer tasks
    cell = F.concat_ws(",", "lo", "hi", "dim", "g").alias("cell")
    met = grid.shuffled(left.select("*", cell), right.select(cell, *[c for c in right.columns if c.startswith("y_")]), ["cell"], tasks)
    return met.where("lo < hi or x_block <= y_block").drop("cell", "lo", "hi")


def survivors(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the pairs of unit rows that may have a product of threshold or more. The product grows slice by slice; after each,
    the lengths of what is left bound the rest, and rows and columns without a live pair are given up."""
    dim = x.shape[1]
    rows, cols, done = np.arange(len(x)), np.arange(len(y)), np.zeros((len(x), len(y)))
    rest = lambda v: np.sqrt(np.maximum(0, np.cumsum((v * v)[:, ::-1], axis=1)[:, ::-1]))
    rx, ry = (np.c_[rest(v), np.zeros(len(v))] for v in (x, y))
    live = np.full(done.shape, threshold <= 0)
    for at in range(0, dim, SLICE):
        end = min(dim, at + SLICE)
        done = done + x[rows, at:end] @ y[cols, at:end].T
        live = done + rx[rows, end][:, None] * ry[cols, end][None] >= threshold - 1e-9
        keep, hold = live.any(axis=1), live.any(axis=0)
        if not keep.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if keep.mean() < 0.75 or hold.mean() < 0.75:
            rows, cols, done, live = rows[keep], cols[hold], done[np.ix_(keep, hold)], live[np.ix_(keep, hold)]
    r, c = np.nonzero(live)
    return rows[r], cols[c]


def _linked(batches: Iterator[pd.DataFrame], threshold: float):
    """(ids of x, ids of y, cosines) of the linked rows of each pair of blocks, each pair of rows once."""
    reach = np.arccos(min(1.0, max(-1.0, threshold))) + 1e-6
    for batch in batches:
        for dim, m, a, p, u, ra, n, b, q, v, rb in zip(*(batch[c] for c in ("dim", "x_block", "x_ids", "x_matrix", "x_centre", "x_radius", "y_block", "y_ids", "y_matrix", "y_centre", "y_radius")), strict=True):
            apart = np.arccos(np.clip(np.frombuffer(u) @ np.frombuffer(v), -1, 1)) if dim and max(ra, rb) < np.pi else 0
            if m != n and apart > ra + rb + reach:
                continue
            (xi, x), (yi, y) = _read(a, p, dim), _read(b, q, dim)
            ux, uy, found = _unit(x), _unit(y), []
            for at in range(0, len(x), STRIP):
                r, c = survivors(ux[at : at + STRIP], uy, threshold) if threshold > 0 else np.nonzero(np.ones((len(ux[at : at + STRIP]), len(uy)), bool))
                found.append((r + at, c))
            r, c = (np.concatenate(z) for z in zip(*found, strict=True))
            length = np.linalg.norm(x, axis=1)[r] * np.linalg.norm(y, axis=1)[c]
            s = np.divide(np.einsum("ij,ij->i", x[r], y[c]), length, out=np.zeros(len(r)), where=length > 0)
            keep = (s >= threshold) & ((xi[r] < yi[c]) if m == n else (xi[r] != yi[c]))
            yield xi[r[keep]], yi[c[keep]], s[keep]


def _pairs(rows: DataFrame, by: str | None) -> DataFrame:
    tasks = _tasks(rows)
    slim = written(usable(rows, by), "vectors")
    count = max(1, min(tasks, -(-slim.count() // ROWS)))
    blocks = packed(slim, count, ROWS, pivots(slim)).withColumn("block", F.monotonically_increasing_id())
    place = F.shiftright("block", 33) + F.col("block").bitwiseAND(F.lit((1 << 33) - 1)) * count
    return block_pairs(written(blocks.withColumn("block", place), "blocks"), tasks)


def alike(rows: DataFrame, threshold: float, by: str | None = None) -> DataFrame:
    """a, b, similarity: pairs a < b with a cosine of threshold or more; with by, of equal values alone. Blocks that lie too far apart are passed
    over, and within a pair of blocks what can't reach the threshold is given up early. Large groups of copies leave all their pairs: see
    alike_links for a bounded outcome."""

    def found(batches: Iterator[pd.DataFrame]):
        for i, j, s in _linked(batches, threshold):
            yield pd.DataFrame({"a": np.minimum(i, j), "b": np.maximum(i, j), "similarity": s})

    return _pairs(rows, by).mapInPandas(found, "a long, b long, similarity double")


def stars(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, roots) of links: the smallest node that each node reaches."""
    nodes, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    p, q, label = at[: len(i)], at[len(i) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[p], label[q])
        new = label.copy()
        np.minimum.at(new, p, low)
        np.minimum.at(new, q, low)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def alike_links(rows: DataFrame, threshold: float, by: str | None = None) -> DataFrame:
    """vec_id, root, n: for each pair of blocks, each vector with links there, how many, and the smallest vector that it reaches by them. Sums of n
    are the links of a vector, and the edges (vec_id, root) have the components of all links, so groups of copies need no pairs."""

    def found(batches: Iterator[pd.DataFrame]):
        for i, j, _ in _linked(batches, threshold):
            if len(i):
                nodes, roots = stars(i, j)
                ends, n = np.unique(np.concatenate([i, j]), return_counts=True)
                yield pd.DataFrame({"vec_id": nodes, "root": roots, "n": n[np.searchsorted(ends, nodes)]})

    return _pairs(rows, by).mapInPandas(found, "vec_id long, root long, n long")
