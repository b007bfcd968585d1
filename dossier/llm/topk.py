"""Exact top-k inner-product search by a three-phase uniform threshold over slices of the dimensions.

The nodes of the threshold algorithm are SLICES groups of dimensions; a node's list holds a vector's inner
product within its slice. Phase 1 gathers the k best of each node's local list and their totals, over the heads
alone: the HEAD longest vectors of every part of the table; the k-th best total t is a safe bound, as any k totals
give one. Phase 2 broadcasts the cutoff t / SLICES to the nodes: a vector whose total reaches t has a slice
score of at least that, so the entries over the cutoff suffice. Phase 3 resolves what is left exactly, for these
entries alone. Vectors travel in packed blocks, and each block of queries meets each block of vectors once in phase 2.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import shuffled
from .common import ceil_div, cut, lean, partitions

#: Nodes (slices of the dimensions); rows of a packed vector block, of the first block of a part, and of a packed query block.
SLICES, ROWS, HEAD, QUERIES = 4, 4096, 512, 512
#: Query rows that are scored at a time within a pair of blocks.
STEP = 128


def _packed(batches: Iterator[pd.DataFrame], width: int, rows: int, head: int | None = None):
    """Blocks of a partition's vectors in their order: the first of head rows, the others of rows."""
    held_ids, held, first = [], [], head is not None

    def out():
        return pd.DataFrame({"ids": [np.asarray(held_ids, np.int64).tobytes()], "matrix": [np.stack(held).tobytes()], "head": [first]})

    for batch in batches:
        for i, v in zip(batch["vec_id"], batch["v"], strict=True):
            row = np.zeros(width, np.int64)
            row[: len(v)] = v
            held_ids.append(i), held.append(row)
            if len(held) == (head if first else rows):
                yield out()
                held_ids, held, first = [], [], False
    if held:
        yield out()


def _matrix(blob: bytes, width: int, exact32: bool, exact64: bool) -> np.ndarray:
    m = np.frombuffer(blob, np.int64).reshape(-1, width)
    return m.astype(np.float32) if exact32 else m.astype(np.float64) if exact64 else m


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by score, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def _slices(width: int) -> list[slice]:
    ends = np.linspace(0, width, min(SLICES, width) + 1).astype(int)
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _floors(batches: Iterator[pd.DataFrame], width: int, k: int, exact: tuple[bool, bool]):
    """Phase 1: for each query block the k best totals among the vectors of the heads that lead some node's list."""
    best: dict[bytes, np.ndarray] = {}
    for batch in batches:
        for q_ids, q, v_ids, v in zip(batch["q_ids"], batch["q_matrix"], batch["ids"], batch["matrix"], strict=True):
            qi, vi = np.frombuffer(q_ids, np.int64), np.frombuffer(v_ids, np.int64)
            Q, V = _matrix(q, width, *exact), _matrix(v, width, *exact)
            held = best.setdefault(q_ids, np.full((len(qi), k), np.iinfo(np.int64).min))
            for at in range(0, len(qi), STEP):
                local = [Q[at : at + STEP, s] @ V[:, s].T for s in _slices(width)]
                total = sum(local[1:], local[0].copy())
                own = qi[at : at + STEP, None] == vi[None, :]
                lead = np.zeros_like(own)
                for x in local:
                    top = np.argpartition(x, max(0, len(vi) - k), axis=1)[:, max(0, len(vi) - k) :]
                    np.put_along_axis(lead, top, True, axis=1)
                lead &= ~own
                for r in range(len(lead)):
                    got = np.concatenate([held[at + r], total[r, lead[r]].astype(np.int64)])
                    held[at + r] = np.sort(got)[-k:]
    for q_ids, x in best.items():
        yield pd.DataFrame({"q_ids": [q_ids], "totals": [x.tobytes()]})


def _cutoffs(key, group: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k-th best total of each query of a block, over all tasks."""
    n = len(key[0]) // 8
    x = np.concatenate([np.frombuffer(t, np.int64).reshape(n, k) for t in group["totals"]], axis=1)
    return pd.DataFrame({"q_ids": [key[0]], "floor": [np.sort(x, axis=1)[:, -k].copy().tobytes()]})


def _resolved(batches: Iterator[pd.DataFrame], width: int, k: int, exact: tuple[bool, bool]):
    """Phases 2 and 3: entries over the cutoff, bounded, and the rest of their scores."""
    for batch in batches:
        for q_ids, q, floor, v_ids, v in zip(batch["q_ids"], batch["q_matrix"], batch["floor"], batch["ids"], batch["matrix"], strict=True):
            qi, vi, low = (np.frombuffer(x, np.int64) for x in (q_ids, v_ids, floor))
            Q, V = _matrix(q, width, *exact), _matrix(v, width, *exact)
            ids, to, scores = [], [], []
            for at in range(0, len(qi), STEP):
                t = low[at : at + STEP]
                # with fewer than k totals there is no bound: everything is an entry
                # scores are integers, so the cutoff is rounded up
                cutoff = np.where(t == np.iinfo(np.int64).min, -np.inf, -(-t // min(SLICES, width)))
                local = [Q[at : at + STEP, s] @ V[:, s].T for s in _slices(width)]
                over = np.zeros(local[0].shape, bool)
                for x in local:
                    over |= x >= cutoff.astype(x.dtype if x.dtype.kind == "f" else np.float64)[:, None]
                over &= qi[at : at + STEP, None] != vi[None, :]
                row, col = np.nonzero(over)
                total = sum((x[row, col] for x in local[1:]), local[0][row, col]).astype(np.int64)
                enough = total >= t[row]
                row, col, total = row[enough], col[enough], total[enough]
                ends = np.searchsorted(row, np.arange(len(t) + 1))
                for r in range(len(t)):
                    c = slice(ends[r], ends[r + 1])
                    i, s = _best(vi[col[c]], total[c], k)
                    ids.append(np.full(len(i), qi[at + r])), to.append(i), scores.append(s)
            yield pd.DataFrame({"query_id": np.concatenate(ids), "vec_id": np.concatenate(to), "score": np.concatenate(scores)})


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query, ties to the smaller vec_id.

    vectors has vec_id and embedding (array of numbers; other columns are ignored). Components become
    floor(scale * x) in double precision. Queries are the rows whose vec_id is divisible by every; candidates are all
    rows but the query's own. Rows with a null id, a null vector, or null or non-finite components take no part.
    vec_id is a key: of rows that repeat one, the smallest vector counts. Shorter vectors are padded with zeros; empty
    vectors score 0 with all. Scores must fit into 64-bit integers. Fewer than k candidates: all of them. An
    empty table gives no rows.
    """
    spark = lean(vectors.sparkSession)
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    good = vectors.where(fine).select(F.col("vec_id").cast("long").alias("vec_id"), whole.cast("array<long>").alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    good = cut(good, "vectors")
    n, width, largest = good.agg(F.count("*"), F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double")))))).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], out)
    width = max(1, width)
    bound = width * float(largest) ** 2
    exact = (bound < 2**24, bound < 2**53)
    tasks = min(partitions(spark), ceil_div(n, ROWS))
    packed = "ids binary, matrix binary, head boolean"
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    blocks = good.repartition(ceil_div(n, ROWS + HEAD), "vec_id").sortWithinPartitions(length.desc(), "vec_id").mapInPandas(lambda b: _packed(b, width, ROWS, HEAD), packed)
    blocks = cut(blocks.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(tasks))), "blocks")
    queries = good.where(F.col("vec_id") % every == 0).repartition(ceil_div(ceil_div(n, every), QUERIES), "vec_id").mapInPandas(lambda b: _packed(b, width, QUERIES), packed)
    queries = cut(queries.drop("head").toDF("q_ids", "q_matrix").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))), "queries")
    pairs = shuffled(queries, blocks.where("head"), ["part"], tasks)
    floors = pairs.select("q_ids", "q_matrix", "ids", "matrix").mapInPandas(lambda b: _floors(b, width, k, exact), "q_ids binary, totals binary")
    floors = cut(floors.groupBy("q_ids").applyInPandas(lambda key, g: _cutoffs(key, g, k), "q_ids binary, floor binary"), "floors")
    found = shuffled(queries.hint("merge").join(floors, "q_ids"), blocks, ["part"], tasks).select("q_ids", "q_matrix", "floor", "ids", "matrix").mapInPandas(lambda b: _resolved(b, width, k, exact), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
