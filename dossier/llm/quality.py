"""Quality: a byte-level convolutional network in numpy, max-pooled over overlapping chunks of the whole document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean
from .sample import BYTES, DOCUMENTS, labelled

#: Filters and their width in bytes; half of a chunk (chunks overlap by half).
FILTERS, WIDTH, HALF = 16, 4, 128
EPOCHS, BATCH, RATE, DECAY = 10, 32, 0.01, 1e-4
#: Positions that are convolved at a time.
STEP = 1 << 15


@dataclass
class ConvNet:
    """table[j, b] holds the filters' weights for byte b at place j; weight and bias combine the pooled responses."""

    table: np.ndarray
    bias: np.ndarray
    weight: np.ndarray
    offset: float

    def pairs(self) -> list[np.ndarray]:
        """Tables of two bytes each, so that a response is WIDTH / 2 lookups."""
        return [(self.table[j][:, None] + self.table[j + 1][None, :]).reshape(65536, -1).astype(np.float32) for j in range(0, WIDTH, 2)]

    def score(self, text: bytes, pairs: list[np.ndarray]) -> float:
        top, mean = pooled(text, pairs, self.bias)[:2]
        return float(1 / (1 + np.exp(-np.clip(np.r_[top, mean] @ self.weight + self.offset, -30, 30))))


def _codes(text: bytes) -> np.ndarray:
    """Byte pairs of a text; short texts are padded with zero bytes to one chunk."""
    data = np.frombuffer(text + bytes(max(WIDTH, HALF + WIDTH - len(text))), np.uint8).astype(np.int32)
    return data[:-1] * 256 + data[1:]


def pooled(text: bytes, pairs: list[np.ndarray], bias: np.ndarray, places: bool = False):
    """Maxima over all chunks, the mean of the chunks' maxima, and with places each chunk's maxima and where they are."""
    codes = _codes(text)
    n = max(HALF, len(text))
    halves, where = [], []
    for at in range(0, n, STEP):
        m = min(STEP, n - at)
        r = pairs[0][codes[at : at + m]]
        for j in range(1, len(pairs)):
            r += pairs[j][codes[at + 2 * j : at + 2 * j + m]]
        if m % HALF:
            r = np.concatenate([r, np.full((HALF - m % HALF, r.shape[1]), -1e9, np.float32)])
        r = r.reshape(-1, HALF, r.shape[1])
        if places:
            i = r.argmax(axis=1)
            where.append(i + at + HALF * np.arange(len(r))[:, None])
            halves.append(np.take_along_axis(r, i[:, None], 1)[:, 0])
        else:
            halves.append(r.max(axis=1))
    h = np.concatenate(halves)
    chunk = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
    act = np.maximum(chunk + bias, 0)
    top, mean = act.max(axis=0), act.mean(axis=0)
    if not places:
        return top, mean
    w = np.concatenate(where)
    at = np.where(h[:-1] >= h[1:], w[:-1], w[1:]) if len(h) > 1 else w
    return top, mean, act, at


def fit(rows: list[tuple[bytes, int]], seed: int = 3) -> ConvNet:
    """Adam on the logistic loss; the gradient of a maximum goes to the bytes under it. No rows: a score of 0.5 for all."""
    rng = np.random.default_rng(seed)
    net = ConvNet(rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 2 * FILTERS), 0.0)
    if not rows:
        net.weight[:] = 0
        return net
    share = float(np.clip(np.mean([y for _, y in rows]), 0.01, 0.99))
    net.offset = float(np.log(share / (1 - share)))
    if len({y for _, y in rows}) < 2:
        net.weight[:] = 0
        return net
    params = [net.table, net.bias, net.weight, np.array([net.offset])]
    first, second, step = [np.zeros_like(p, dtype=np.float64) for p in params], [np.zeros_like(p, dtype=np.float64) for p in params], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(rows))
        rate = RATE * (1 - epoch / EPOCHS) + 1e-4
        for at in range(0, len(order), BATCH):
            batch, grads = order[at : at + BATCH], [np.zeros_like(p, dtype=np.float64) for p in params]
            pairs = net.pairs()
            for i in batch:
                text, y = rows[i]
                top, mean, act, place = pooled(text, pairs, net.bias, places=True)
                x = np.r_[top, mean]
                p = 1 / (1 + np.exp(-np.clip(x @ net.weight + params[3][0], -30, 30)))
                d = (p - y) / len(batch)
                grads[2] += d * x
                grads[3] += d
                g = np.tile(d * net.weight[FILTERS:] / len(act), (len(act), 1))
                g[act.argmax(axis=0), np.arange(FILTERS)] += d * net.weight[:FILTERS]
                g *= act > 0
                grads[1] += g.sum(axis=0)
                c, f = np.nonzero(g)
                data = np.frombuffer(text + bytes(HALF + WIDTH), np.uint8)
                for j in range(WIDTH):
                    np.add.at(grads[0][j], (data[np.minimum(place[c, f] + j, len(data) - 1)], f), g[c, f])
            step += 1
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g += DECAY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(p.dtype)
    net.offset = float(params[3][0])
    return net


def score_texts(docs: DataFrame, net: ConvNet, threshold: float) -> DataFrame:
    def scored(batches: Iterator):
        import pyarrow as pa

        from .common import pieces, utf8

        pairs = net.pairs()
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([net.score(t, pairs) for t in utf8(part.column("text"))], pa.float64())], names=["doc_id", "held_out", "score"])

    lean(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, documents: int = DOCUMENTS, bytes_: int = BYTES) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, held_out, score, predicted.

    score is the probability of labels(doc_id, quality) = 1, from the text's bytes alone; the whole text is read. The
    network is fitted to at most documents labelled rows (a documented bound) whose crc32 remainder isn't the held-out
    one. Null and empty texts are scored like a chunk of zero bytes; null ids are not held out. Repeated rows keep one
    row each; other columns are ignored. Without labels every score is 0.5.
    """
    return score_texts(docs, fit(labelled(docs, labels, "quality", documents, bytes_)), threshold)
