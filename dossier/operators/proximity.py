"""A navigable proximity graph over vectors: layered neighbour graphs, one for each shard, and a merged search over the shards.

A vector stands in layer 0 and, with a chance that falls by 1 / LINKS for each, in the layers above. In a layer it is linked with near
vectors that lie in different directions. A search goes greedily down the upper layers and then keeps the best of a beam in layer 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, grid
from ..functions.tables import written
from . import search

#: Links of a vector in the upper layers (twice as many in layer 0), beams of building and of searching, vectors of a shard.
LINKS, BUILD, BEAM, SHARD = 12, 64, 96, 4096
INDEX = "shard int, dim int, ids binary, matrix binary, entry int, nodes array<binary>, ends array<binary>, links array<binary>"


class Layers:
    """The layers over unit vectors x; layers[l] gives a node's neighbours."""

    def __init__(self, x: np.ndarray, layers: list[dict[int, np.ndarray]] | None = None, entry: int = -1):
        self.x, self.layers, self.entry = x, layers or [], entry
        self.stamp, self.seen = 0, np.zeros(len(x), np.int64)

    def beam(self, q: np.ndarray, starts: list[tuple[float, int]], width: int, layer: int) -> list[tuple[float, int]]:
        """The width best nodes that a search of a layer from starts finds, as (similarity, node)."""
        self.stamp += 1
        links = self.layers[layer]
        for _, i in starts:
            self.seen[i] = self.stamp
        open_, best = [(-s, i) for s, i in starts], list(starts)
        heapq.heapify(open_), heapq.heapify(best)
        while open_:
            s, i = heapq.heappop(open_)
            if len(best) >= width and -s < best[0][0]:
                break
            near = links[i]
            near = near[self.seen[near] != self.stamp]
            if not len(near):
                continue
            self.seen[near] = self.stamp
            for t, j in zip((self.x[near] @ q).tolist(), near.tolist(), strict=True):
                if len(best) < width:
                    heapq.heappush(best, (t, j))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, j))
                else:
                    continue
                heapq.heappush(open_, (-t, j))
        return best

    def spread(self, found: list[tuple[float, int]], most: int) -> np.ndarray:
        """Of found nodes the nearest ones that are nearer to the vector than to each other; the rest fills up."""
        found = sorted(found, key=lambda f: (-f[0], f[1]))
        at = np.array([i for _, i in found])
        near, kept, rest = self.x[at] @ self.x[at].T, [], []
        for n, (s, _) in enumerate(found):
            (kept if all(near[n, m] <= s for m in kept) else rest).append(n)
            if len(kept) == most:
                break
        return at[(kept + rest)[:most]]

    def add(self, i: int, level: int) -> None:
        q = self.x[i]
        while len(self.layers) <= level:
            self.layers.append({})
        starts = [(float(self.x[self.entry] @ q), self.entry)] if self.entry >= 0 else []
        top = max((n for n, links in enumerate(self.layers) if self.entry in links), default=-1)
        for layer in range(top, level, -1):
            starts = [max(self.beam(q, starts, 1, layer))]
        for layer in range(level, -1, -1):
            links, most = self.layers[layer], LINKS * (2 if layer == 0 else 1)
            if layer > top:
                links[i] = np.zeros(0, np.int64)
                continue
            starts = self.beam(q, starts, BUILD, layer)
            links[i] = self.spread(starts, LINKS)
            for j in links[i].tolist():
                links[j] = np.append(links[j], i)
                if len(links[j]) > most:
                    links[j] = self.spread(list(zip((self.x[links[j]] @ self.x[j]).tolist(), links[j].tolist(), strict=True)), most)
        if level > top:
            self.entry = i

    def search(self, q: np.ndarray, k: int, beam: int) -> list[tuple[float, int]]:
        starts = [(float(self.x[self.entry] @ q), self.entry)]
        for layer in range(len(self.layers) - 1, 0, -1):
            starts = [max(self.beam(q, starts, 1, layer))]
        return sorted(self.beam(q, starts, max(k, beam), 0), reverse=True)[:k]


def levels(ids: np.ndarray) -> np.ndarray:
    """The highest layer of each vector, from a hash of its id."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    share = ((h >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
    return np.minimum(8, np.floor(-np.log(share) / np.log(LINKS))).astype(int)


def _built(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    ids, dim = rows["vec_id"].to_numpy(np.int64), int(key[1])
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], blocks._unit(np.stack(rows["v"].to_numpy())[order].reshape(len(ids), dim))
    layers = Layers(x)
    for i, level in enumerate(levels(ids)):
        layers.add(i, level)
    nodes = [np.array(list(links), np.int32).tobytes() for links in layers.layers]
    ends = [np.cumsum([len(n) for n in links.values()]).astype(np.int64).tobytes() for links in layers.layers]
    flat = [np.concatenate(list(links.values())).astype(np.int32).tobytes() for links in layers.layers]
    return pd.DataFrame({"shard": [int(key[0])], "dim": [dim], "ids": [ids.tobytes()], "matrix": [x.tobytes()], "entry": [layers.entry], "nodes": [nodes], "ends": [ends], "links": [flat]})


def proximity_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """INDEX, a row for each shard of about shard vectors of vectors(vec_id, embedding) (and one length), dealt by a hash of the id: write it as
    Parquet to keep it. Every vector is indexed; null ids and vectors and such with a null component are left out. Zero vectors are near
    nothing."""
    slim = written(blocks.usable(vectors), "vectors")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = slim.count()
    shards = max(1, -(-n // shard), min(tasks, -(-n // 512)))
    dealt = slim.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard", "dim").applyInPandas(_built, INDEX)


def _found(batches: Iterator[pd.DataFrame], k: int, beam: int):
    """The best rows of each shard for the queries of a block, but for their own."""
    for batch in batches:
        for a, p, dim, ids, matrix, entry, nodes, ends, links in zip(*(batch[c] for c in ("q_ids", "q_matrix", "dim", "ids", "matrix", "entry", "nodes", "ends", "links")), strict=True):
            (qi, q), (vi, x) = blocks._read(a, p, dim), blocks._read(ids, matrix, dim)
            layers = []
            for n, e, flat in zip(nodes, ends, links, strict=True):
                held = np.split(np.frombuffer(flat, np.int32), np.frombuffer(e, np.int64)[:-1])
                layers.append(dict(zip(np.frombuffer(n, np.int32).tolist(), held, strict=True)))
            shard, rows = Layers(x, layers, entry), []
            for i, v in zip(qi.tolist(), blocks._unit(q), strict=True):
                rows += [(i, int(vi[j]), s) for s, j in shard.search(v, k + 1, beam) if vi[j] != i]
            yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])


def proximity_top_k(index: DataFrame, queries: DataFrame, k: int = 5, beam: int = BEAM) -> DataFrame:
    """query_id, vec_id, score, rank by cosine, approximately: every block of queries(vec_id, embedding) meets every shard in the cells of a grid, and
    the shards' best are merged. A wider beam finds more of the true neighbours."""
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = written(index, "index")
    asked = blocks.usable(queries)
    asked = blocks.packed(asked, max(1, min(tasks, -(-asked.count() // blocks.QUERIES))), blocks.QUERIES).select("dim", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    groups, parts = grid.shape(max(1, queries.count() // blocks.QUERIES), index.count(), tasks)
    held = index.withColumn("part", F.pmod("shard", F.lit(parts)))
    pairs = grid.met(written(grid.numbered(asked, "group", groups), "queries"), held, groups, parts, ["dim"])
    found = pairs.select("q_ids", "q_matrix", "dim", "ids", "matrix", "entry", "nodes", "ends", "links").mapInPandas(lambda b: _found(b, k, beam), "query_id long, vec_id long, score double")
    return search.top(found.select("query_id", "vec_id", F.round("score", 6).alias("score")).distinct(), "query_id", [F.desc("score"), F.col("vec_id")], k)
