"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, lean
from .sample import DOCUMENTS, labelled

#: Common insults in the corpus's languages; words that the labelled sample shows to be toxic are added.
INSULTS = frozenset(
    "idiot idiots stupid moron morons loser losers scum trash garbage worthless pathetic disgusting clown dumb fool imbecile jerk bastard "
    "dummkopf trottel arschloch abschaum versager blödmann depp idiota idiotas estúpido estúpida imbécil basura imbécile crétin connard ordure abruti".split()
)
SECOND = frozenset("you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta vous votre vos tú ti usted ustedes vosotros".split())
_WORD = re.compile(r"[^\W\d_]+")
#: A letter run broken by digits or signs that stand for letters.
_MASKED = re.compile(r"(?<!\w)[^\W\d_]+(?:[0-9@$*!.\-_]{1,2}[^\W\d_]+)+(?!\w)")
_PLAIN = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
_LONG = re.compile(r"(\w)\1{2,}")
#: Words around an insult in which the second person counts.
NEAR = 6
#: Documents that must hold a word, and how many times likelier it is in toxic ones, for it to join the lexicon.
SUPPORT, RATIO = 8, 20.0
TREES, DEPTH, RATE, LEAF, BINS = 60, 3, 0.15, 8, 32


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def learned_words(texts: list[str], y: list[int], support: int = SUPPORT, ratio: float = RATIO) -> frozenset[str]:
    """Words that are ratio times likelier in toxic documents, by smoothed document counts."""
    held = (Counter(), Counter())
    for t, label in zip(texts, y, strict=True):
        held[label].update(set(words_of(t)))
    bad, good = max(1, sum(y)), max(1, len(y) - sum(y))
    return frozenset(w for w, n in held[1].items() if n >= support and n / bad >= ratio * (held[0][w] + 0.5) / good)


def features(text: str, lexicon: frozenset[str], learned: frozenset[str]) -> list[float]:
    """Dense features of a whole text; all rates are finite for empty texts."""
    words = words_of(text)
    n = max(1, len(words))
    hits = [i for i, w in enumerate(words) if w in lexicon]
    taught = sum(w in learned for w in words)
    close = sum(1 for i in hits if not SECOND.isdisjoint(words[max(0, i - NEAR) : i + NEAR + 1]))
    densest = 0
    for a, i in enumerate(hits):
        b = a
        while b + 1 < len(hits) and hits[b + 1] < i + 50:
            b += 1
        densest = max(densest, b - a + 1)
    masked = [m[0] for m in _MASKED.finditer(text)]
    unmasked = sum(m.lower().translate(_PLAIN) in lexicon for m in masked)
    size = max(1, len(text))
    return [
        len(hits), len(hits) / n, densest, close, close / n, len({words[i] for i in hits}), taught, taught / n,
        sum(map(str.isupper, text)) / size, text.count("!") / size, text.count("?") / size, len(masked) / n, unmasked, len(_LONG.findall(text)) / n, math.log1p(len(words)),
    ]


@dataclass
class Boosted:
    """Regression trees as nested tuples (feature, split, left, right) or leaf values, and the calibration's steps."""

    lexicon: frozenset[str] = INSULTS
    learned: frozenset[str] = frozenset()
    start: float = 0.0
    trees: list = field(default_factory=list)
    steps: tuple = ((), ())

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += _apply(t, x)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        if not len(self.steps[0]):
            return 1 / (1 + np.exp(-raw))
        return np.interp(raw, self.steps[0], self.steps[1])


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, split, left, right = tree
    low = x[:, f] <= split
    out = np.empty(len(x))
    out[low], out[~low] = _apply(left, x[low]), _apply(right, x[~low])
    return out


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int):
    leaf = float(-g.sum() / (h.sum() + 1.0) * RATE)
    if depth == 0 or len(g) < 2 * LEAF:
        return leaf
    best = (1e-6, None, None)
    whole = g.sum() ** 2 / (h.sum() + 1.0)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        bin_ = np.searchsorted(c, x[:, f], "left")
        n = np.cumsum(np.bincount(bin_, minlength=len(c) + 1))[:-1]
        gs, hs = np.cumsum(np.bincount(bin_, g, len(c) + 1))[:-1], np.cumsum(np.bincount(bin_, h, len(c) + 1))[:-1]
        gain = gs**2 / (hs + 1.0) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1.0) - whole
        gain[(n < LEAF) | (len(g) - n < LEAF)] = 0
        if gain.max() > best[0]:
            best = (gain.max(), f, c[gain.argmax()])
    if best[1] is None:
        return leaf
    low = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), _grow(x[low], g[low], h[low], cuts, depth - 1), _grow(x[~low], g[~low], h[~low], cuts, depth - 1))


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the steps of the best non-decreasing fit of y on x, each over two raw values."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b in zip(x[order], y[order].astype(float), strict=True):
        if pools and pools[-1][3] == a:
            pools[-1][0] += b
            pools[-1][1] += 1
        else:
            pools.append([b, 1.0, a, a])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            s, n, _, hi = pools.pop()
            pools[-1][0] += s
            pools[-1][1] += n
            pools[-1][3] = hi
    # smoothed a little, so that a pure step isn't a certainty
    mean = [(s + 0.02) / (n + 0.04 if n > 1 else n + 1) for s, n, *_ in pools]
    at = [v for p in pools for v in (p[2], p[3])]
    return np.asarray(at), np.maximum.accumulate(np.repeat(mean, 2)).clip(0, 1)


def fit(rows: list[tuple[bytes, int]]) -> Boosted:
    """Three rows in four grow the trees, the fourth calibrates them. One class or no rows: its share (0.5) for all."""
    texts, y = [t.decode() for t, _ in rows], [label for _, label in rows]
    grow = [i for i in range(len(rows)) if i % 4]
    rest = [i for i in range(len(rows)) if not i % 4]
    model = Boosted()
    if len({y[i] for i in grow}) < 2:
        share = np.clip(np.mean(y), 0.01, 0.99) if y else 0.5
        model.start = float(np.log(share / (1 - share)))
        return model
    learned = learned_words([texts[i] for i in grow], [y[i] for i in grow])
    model.learned, model.lexicon = learned, INSULTS | learned
    x, y = np.array([features(t, model.lexicon, learned) for t in texts]), np.array(y, float)
    xg, yg = x[grow], y[grow]
    cuts = [np.unique(np.quantile(v, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for v in xg.T]
    # rare values lie above every quantile, so their smallest steps are split points too
    cuts = [np.unique(np.r_[c, np.unique(v)[:8]]) for c, v in zip(cuts, xg.T, strict=True)]
    model.start = float(np.log(yg.mean() / (1 - yg.mean())))
    raw = np.full(len(yg), model.start)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = _grow(xg, p - yg, p * (1 - p), cuts, DEPTH)
        model.trees.append(tree)
        raw += _apply(tree, xg)
    if len(set(y[rest])) == 2:
        model.steps = isotonic(model.raw(x[rest]), y[rest])
    return model


def score_texts(docs: DataFrame, model: Boosted, threshold: float) -> DataFrame:
    def scored(batches: Iterator):
        import pyarrow as pa

        from .common import pieces

        for batch in batches:
            for part in pieces(batch):
                x = np.array([features(t.as_py() or "", model.lexicon, model.learned) for t in part.column("text")])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(model.score(x), pa.float64())], names=["doc_id", "held_out", "score"])

    lean(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scored, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, documents: int = DOCUMENTS) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, held_out, score, predicted.

    score is the probability of labels(doc_id, toxic) = 1, from the whole text alone. The model is fitted to at most
    documents labelled rows (a documented bound) whose crc32 remainder isn't the held-out one. Null texts count as
    empty and get the score of a text without words; null ids are not held out. Repeated rows keep one row each; other
    columns are ignored. Without labels every score is 0.5.
    """
    return score_texts(docs, fit(labelled(docs, labels, "toxic", documents)), threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, documents: int = DOCUMENTS) -> DataFrame:
    """The rows of docs that aren't predicted to be toxic, as they are."""
    model = fit(labelled(docs, labels, "toxic", documents))
    schema = docs.schema

    def kept(batches: Iterator):
        import pyarrow as pa

        from .common import pieces

        for batch in batches:
            for part in pieces(batch):
                x = np.array([features(t.as_py() or "", model.lexicon, model.learned) for t in part.column("text")])
                yield part.filter(pa.array(model.score(x) < threshold))

    lean(docs.sparkSession)
    return docs.mapInArrow(kept, schema)
