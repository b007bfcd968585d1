"""Hard-negative mining with a pivot table.

Every vector v gets one more component, sqrt(M^2 - |v|^2), and every anchor q a zero, where M is the largest length: then
|q' - v'|^2 = |q|^2 + M^2 - 2 q.v, so a higher inner product is a smaller Euclidean distance. The table stores each vector's distances to
a few pivots. By the triangle inequality they bracket the distance to an anchor, and so the score: blocks, and then rows, whose bracket
misses what the anchor still looks for are passed over; the scores of those that are left are checked exactly, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import met, numbered, shape
from .common import ceil_div, cut, lean, partitions

#: Pivots, the vectors of the sample that they are chosen from, vectors of a block, anchors of a block.
PIVOTS, SAMPLE, ROWS, ANCHORS = 16, 1024, 1024, 256
#: Found rows that a task holds before it keeps the best of them.
PENDING = 1 << 20
#: What rounding may add to a distance, as a share of the largest.
SLACK = 1e-5
LEAST = np.iinfo(np.int64).min


def best(key: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k rows of each key with the highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, key))
    key, ids, score = key[order], ids[order], score[order]
    nth = np.arange(len(key)) - np.searchsorted(key, key, "left")
    return key[nth < k], ids[nth < k], score[nth < k]


class Pivots:
    """The augmented space: pivots, the largest squared length, and distances to the pivots."""

    def __init__(self, sample: np.ndarray, largest: float, count: int = PIVOTS):
        self.largest = largest
        x = self.augmented(sample.astype(np.float64))
        # each pivot is the vector of the sample that is furthest from those before it
        chosen, gap = [int(np.argmin(x[:, -1]))], np.full(len(x), np.inf)
        while len(chosen) < min(count, len(x)):
            gap = np.minimum(gap, self._apart(x, x[chosen[-1:]])[:, 0])
            if gap.max() <= 0:
                break
            chosen.append(int(gap.argmax()))
        self.x = x[chosen]
        #: No distance is over twice the radius of the sphere that holds all vectors.
        self.slack = SLACK * 2 * max(1.0, largest) ** 0.5

    def augmented(self, v: np.ndarray) -> np.ndarray:
        return np.c_[v, np.sqrt(np.maximum(0, self.largest - (v * v).sum(axis=1)))]

    @staticmethod
    def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T))

    def table(self, v: np.ndarray) -> np.ndarray:
        """Distances of vectors to the pivots."""
        return self._apart(self.augmented(v.astype(np.float64)), self.x).astype(np.float32)

    def asked(self, q: np.ndarray) -> np.ndarray:
        """Distances of anchors to the pivots."""
        return self._apart(np.c_[q.astype(np.float64), np.zeros(len(q))], self.x).astype(np.float32)

    def nearest(self, distance: np.ndarray) -> np.ndarray:
        """A distance that the score reaches, at most, as a score less the anchor's share: (M^2 - d^2) / 2."""
        return (self.largest - np.square(np.maximum(0, distance - self.slack), dtype=np.float64)) / 2

    def furthest(self, distance: np.ndarray) -> np.ndarray:
        return (self.largest - np.square(distance + self.slack, dtype=np.float64)) / 2


def _matrix(blob: bytes, width: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(-1, width)


def _padded(column, width: int) -> np.ndarray:
    """An Arrow list column of integers as a matrix, short rows filled with zeros."""
    out = np.zeros((len(column), width), np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _tabled(batches: Iterator, width: int, pivots: Pivots):
    """Rows with their distances to the pivots, the nearest pivot and how far it is."""
    import pyarrow as pa

    for batch in batches:
        if batch.num_rows:
            d = pivots.table(_padded(batch.column("v"), width))
            near = d.argmin(axis=1)
            cells = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array([r.tobytes() for r in d], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "label", "v")] + cells, names=["vec_id", "label", "v", "near", "far", "distances"])


def _packed(batches: Iterator, width: int, rows: int, kind: np.dtype, extra: tuple[str, ...] = ()):
    """Blocks of rows in their order: ids, labels, matrix, and extra columns of bytes or lists of integers, each joined."""
    import pyarrow as pa

    held, names = [], ["vec_id", "label", "v", *extra]

    def out(n):
        table = pa.Table.from_batches(held)
        now = table.slice(0, n).combine_chunks().to_batches()[0]
        held[:] = table.slice(n).combine_chunks().to_batches() if table.num_rows > n else []
        blobs = [now.column(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for c in ("vec_id", "label")]
        blobs.append(_padded(now.column("v"), width).astype(kind).tobytes())
        for c in map(now.column, extra):
            blobs.append(b"".join(c.to_pylist()) if pa.types.is_binary(c.type) else c.flatten().to_numpy(zero_copy_only=False).astype(np.int64).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([b], pa.binary()) for b in blobs], names=["ids", "labels", "matrix", *extra])

    for batch in batches:
        if batch.num_rows:
            held.append(batch.select(names))
        while sum(b.num_rows for b in held) >= rows:
            yield out(rows)
    if held:
        yield out(rows)


class _Search:
    """The best rows of each key of a block of anchors; keys of an anchor are its windows of scores."""

    def __init__(self, anchors: int, low: np.ndarray, high: np.ndarray, k: int):
        #: anchors x windows: scores that count lie between them; floors rise as rows are found.
        self.low, self.high, self.k, self.windows = low, high, k, low.shape[1]
        self.floor = low.copy()
        self.held, self.pending = (np.zeros(0, np.int64),) * 3, []

    def add(self, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        for w in range(self.windows):
            fits = (score >= self.floor[row, w]) & (score <= self.high[row, w])
            if fits.any():
                self.pending.append((row[fits] * self.windows + w, ids[fits], score[fits]))
        if self.pending:
            self.settle()

    def settle(self) -> None:
        key, ids, score = best(*(np.concatenate(x) for x in zip(self.held, *self.pending, strict=True)), self.k)
        self.held, self.pending = (key, ids, score), []
        full, count = np.unique(key, return_counts=True)
        last = np.cumsum(count) - 1
        self.floor.ravel()[full[count == self.k]] = score[last[count == self.k]]


def _searched(batches: Iterator, width: int, kind: np.dtype, pivots: Pivots, k: int, same: bool, windows: int):
    """For each block of anchors the best rows of the blocks that it meets in this task, with an equal label or with another."""
    import pyarrow as pa

    held: dict[bytes, _Search] = {}
    for batch in batches:
        for at in range(batch.num_rows):
            x = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            qi, ql = np.frombuffer(x["q_ids"], np.int64), np.frombuffer(x["q_labels"], np.int64)
            vi, vl = np.frombuffer(x["ids"], np.int64), np.frombuffer(x["labels"], np.int64)
            if x["q_ids"] not in held:
                low, high = (np.frombuffer(x[c], np.int64).reshape(len(qi), windows) for c in ("low", "high"))
                held[x["q_ids"]] = _Search(len(qi), low, high, k)
            search = held[x["q_ids"]]
            Q, V = _matrix(x["q_matrix"], width, kind), _matrix(x["matrix"], width, kind)
            d = np.frombuffer(x["distances"], np.float32).reshape(len(vi), -1)
            dq = pivots.asked(Q)
            share = np.square(Q.astype(np.float64)).sum(axis=1) / 2
            # the bracket of the whole block
            gap = np.maximum(np.maximum(dq - d.max(axis=0), d.min(axis=0) - dq), 0).max(axis=1)
            wide = (dq + d.max(axis=0)).min(axis=1)
            want, most = search.floor.min(axis=1), search.high.max(axis=1)
            some = (share + pivots.nearest(gap) >= want) & (share + pivots.furthest(wide) <= most) & (want <= most)
            some &= np.isin(ql, vl) if same else (len(np.unique(vl)) > 1) | (ql != vl[0])
            act = np.flatnonzero(some)
            if not len(act):
                continue
            # the brackets of its rows
            near, far = np.zeros((len(act), len(vi)), np.float32), np.full((len(act), len(vi)), np.inf, np.float32)
            for p in range(d.shape[1]):
                a, b = dq[act, p][:, None], d[:, p][None]
                np.maximum(near, np.abs(a - b), out=near)
                np.minimum(far, a + b, out=far)
            open_ = (share[act, None] + pivots.nearest(near) >= want[act, None]) & (share[act, None] + pivots.furthest(far) <= most[act, None])
            open_ &= (qi[act, None] != vi[None]) & ((ql[act, None] == vl[None]) == same)
            row, col = np.nonzero(open_)
            if not len(row):
                continue
            # the exact check: pair by pair, or as a product where most pairs are left
            if len(row) * 8 < open_.size:
                step = max(1, PENDING // width)
                score = np.concatenate([np.einsum("ij,ij->i", Q[act[row[i : i + step]]], V[col[i : i + step]]) for i in range(0, len(row), step)])
            else:
                score = (Q[act] @ V.T)[row, col]
            search.add(act[row], vi[col], score.astype(np.int64))
    for q_ids, search in held.items():
        key, ids, score = search.held
        of = np.frombuffer(q_ids, np.int64)[key // windows]
        yield pa.RecordBatch.from_arrays([pa.array(of), pa.array((key % windows).astype(np.int32)), pa.array(ids), pa.array(score)], names=["anchor_id", "window", "vec_id", "score"])


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(vectors: DataFrame, positives: int = 5, negatives: int = 5, every: int = 100, scale: int = 256, percent: int = 80) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of vectors(vec_id, embedding, label, ...).

    Components become floor(scale * x) in double precision; a score is an integer inner product, which must fit into 64 bits. Anchors
    are the rows whose vec_id is divisible by every; an anchor's positives are its first other rows of the same label, by falling score,
    ties by smaller vec_id; a positive's negatives are the first rows of another label whose score is between percent hundredths of the
    positive's score and that score. Fewer than asked for: all; a positive without any gives no row. Rows with a null id, label or vector,
    or with null or non-finite components take no part. vec_id is a key: of rows that repeat one, the smallest (label, vector) counts.
    Shorter vectors are padded with zeros; empty ones score 0. Other columns are ignored. An empty table gives no rows.
    """
    spark = lean(vectors.sparkSession)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where("vec_id is not null and label is not null and embedding is not null").where(fine)
    good = good.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), whole.alias("v")).alias("row"))
    good = cut(good.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v"), "vectors")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    n, width, largest, reach = good.agg(F.count("*"), F.max(F.size("v")), F.max(total), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    if not n:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    width, bound = max(1, width), max(1, width) * float(reach or 0) ** 2
    kind = np.dtype(np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64)
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    sample = np.zeros((len(drawn), width))
    for i, r in enumerate(drawn):
        sample[i, : len(r.v)] = r.v
    pivots = Pivots(sample, float(largest))

    tabled = cut(good.mapInArrow(lambda b: _tabled(b, width, pivots), "vec_id long, label long, v array<long>, near int, far float, distances binary"), "pivots")
    tasks, blocks = partitions(spark), ceil_div(n, ROWS)
    packed = "ids binary, labels binary, matrix binary"
    dealt = tabled.repartitionByRange(max(1, min(tasks, blocks)), "near", "far", "vec_id").sortWithinPartitions("near", "far", "vec_id")
    rows = dealt.mapInArrow(lambda b: _packed(b, width, ROWS, kind, ("distances",)), packed + ", distances binary")
    groups, parts = shape(ceil_div(ceil_div(n, every), ANCHORS), blocks, tasks)
    rows = cut(numbered(rows, "part", parts), "blocks")
    anchors = good.where(F.col("vec_id") % every == 0)

    def looked_for(bounds: DataFrame, k: int, same: bool, windows: int) -> DataFrame:
        """For bounds(vec_id, label, v, low, high) with arrays of windows: the k best rows of each window."""
        dealt = bounds.repartition(ceil_div(ceil_div(n, every), ANCHORS), "vec_id").sortWithinPartitions("label", "vec_id")
        asked = dealt.mapInArrow(lambda b: _packed(b, width, ANCHORS, kind, ("low", "high")), packed + ", low binary, high binary").toDF("q_ids", "q_labels", "q_matrix", "low", "high")
        pairs = met(cut(numbered(asked, "group", groups), "anchors"), rows, groups, parts)
        found = pairs.mapInArrow(lambda b: _searched(b, width, kind, pivots, k, same, windows), "anchor_id long, window int, vec_id long, score long")
        return _first(found, k)

    everything = anchors.withColumn("low", F.array(F.lit(LEAST + 1))).withColumn("high", F.array(F.lit(-(LEAST + 1))))
    first = cut(looked_for(everything, positives, True, 1).select("anchor_id", F.col("rank").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # below zero, percent hundredths of a score are above it: nothing fits
    low = F.ceil(F.col("positive_score").cast("decimal(38,0)") * percent / 100).cast("long")
    bound_of = first.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.map_from_entries(F.collect_list(F.struct("nth", F.struct(low.alias("low"), F.col("positive_score").alias("high"))))).alias("of"))
    places = F.sequence(F.lit(1), F.lit(positives))
    sought = anchors.hint("merge").join(bound_of, "vec_id")
    sought = sought.withColumn("low", F.transform(places, lambda i: F.coalesce(F.try_element_at("of", i)["low"], F.lit(-(LEAST + 1)))))
    sought = sought.withColumn("high", F.transform(places, lambda i: F.coalesce(F.try_element_at("of", i)["high"], F.lit(-1).cast("long")))).drop("of")
    last = looked_for(sought, negatives, False, positives)
    last = last.select("anchor_id", (F.col("window") + 1).alias("nth"), F.col("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return last.hint("merge").join(first, ["anchor_id", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

