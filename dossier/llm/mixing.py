"""Mixing sources to target weights by balanced sampling with the cube method.

A document's expected number of copies is its source's target over its size. The whole part is taken; the
fraction is an inclusion probability. The flight phase moves the probabilities of three documents at a time along the
null space of two constraints, the numbers of tokens and of documents, until one of the three is 0 or 1; so each block
leaves two documents open at most. The open ones of all blocks fly again together, until the landing problem of a source
fits into one small block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ceil_div, cut, lean, partitions

#: Weights of the sources in code point order, repeated; the share of all words that is taken; the most times a document is taken.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Documents that fly together in a block, and those of a source that wait for the landing.
BLOCK, LANDING = 4096, 12
#: What a document's size is: runs of anything but these characters.
WORD = r"[^\x20\x09-\x0D]+"
EPS = 1e-12


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """(source, n, source_size, place): places from 0 by code point, null last. The table has a row for each source."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    n = partitions(sizes.sparkSession)
    # UTF-8 order is code point order; a range partitioning, sorted, ranks any number of sources
    ranged = per.repartitionByRange(n, F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last())
    ranged = cut(ranged.withColumn("id", F.monotonically_increasing_id()), "sources").withColumn("part", F.shiftright("id", 33))
    counts = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect())
    before, starts = 0, {}
    for part, count in counts:
        starts[part] = before
        before += count
    start = F.coalesce(*[F.when(F.col("part") == p, F.lit(s)) for p, s in starts.items()]) if starts else F.lit(0)
    return ranged.select("source", "n", "source_size", (start + F.col("id").bitwiseAND((1 << 33) - 1)).cast("long").alias("place"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, n, source_size, target): share of all words dealt by weight, no source above most times its size; what is
    above is dealt again by weight among the others until no source is above."""
    ranked = ranked_sources(sizes)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "weights")
    total = share * float(ranked.agg(F.sum("source_size")).first()[0] or 0)
    rate, capped = None, -1
    while True:
        # a source once above stays capped, as the rate only rises: the same number is the same sources
        full = F.lit(False) if rate is None else F.col("weight") * rate > F.col("cap")
        spent, left, above = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if above == capped or not left or not total:
            break
        rate, capped = (total - (spent or 0.0)) / left, above
    target = F.least(F.col("weight") * (rate or 0.0), F.col("cap")) if total else F.lit(0.0)
    return ranked.select("source", "n", "source_size", target.cast("double").alias("target"))


def flight(p: np.ndarray, size: np.ndarray, chance: np.ndarray) -> np.ndarray:
    """Probabilities after the flight phase; two of them at most stay between 0 and 1.

    chance holds a uniform number for each step. Documents fly in the given order (the largest first, so that small
    ones are left). The move keeps the sums of p and p * size, and its two ends are chosen so that the expectation of p
    stays.
    """
    p = p.tolist()
    size = size.tolist()
    open_ = []
    for i in range(len(p)):
        if not EPS < p[i] < 1 - EPS:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        # u with u_a + u_b + u_c = 0 and the same of u * size
        if size[a] == size[b] == size[c]:
            u = (1.0, -1.0, 0.0)
        else:
            u = (float(size[b] - size[c]), float(size[c] - size[a]), float(size[a] - size[b]))
        up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip(open_, u, strict=True) if x)
        down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip(open_, u, strict=True) if x)
        step = up if chance[i] < down / (up + down) else -down
        for k, x in zip(open_, u, strict=True):
            p[k] += step * x
            if p[k] < 1e-9:
                p[k] = 0.0
            elif p[k] > 1 - 1e-9:
                p[k] = 1.0
        open_ = [k for k in open_ if 0.0 < p[k] < 1.0]
    return np.asarray(p)


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The last open documents of a source, LANDING + 2 at most: of all choices the one nearest to the expected words and
    number of documents, a document counting as the mean size."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    out = p.copy()
    if len(open_):
        take = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        far = np.abs(take @ size[open_] - p[open_] @ size[open_]) + 0.1 * max(1.0, size[open_].mean()) * np.abs(take.sum(axis=1) - p[open_].sum())
        out[open_] = take[far.argmin()]
    return out


def _flown(group: pd.DataFrame) -> pd.DataFrame:
    """A block in flight; where it is all of its source that is open, some documents of all sizes wait for the landing."""
    group = group.sort_values(["size", "draw", "row"], ascending=[False, True, True], kind="stable")
    p, size = group["p"].to_numpy(float), group["size"].to_numpy(np.int64)
    last = group["blocks"].iloc[0] <= 1
    wait = np.zeros(len(p), bool)
    if last:
        wait[np.linspace(0, len(p) - 1, min(LANDING, len(p))).astype(int)] = True
        wait &= (p > EPS) & (p < 1 - EPS)
    p[~wait] = flight(p[~wait], size[~wait], group["draw"].to_numpy(float)[~wait])
    if last:
        p = landing(p, size.astype(float))
    return group.assign(p=p)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 7) -> DataFrame:
    """One row per row of docs(doc_id, source, text, ...): doc_id, size, source_size, target, taken, copies, row, key (both internal).

    size counts words (null text: 0). taken = copies * size. Documents of a source have the same expected
    copies, target / source_size, so copies is its floor or that plus one, never above most. A source without words has
    target 0 and takes nothing. Null is a source, the last one. Repeated rows are sampled each by itself; rows with a
    null id too. Reruns over the same files and split sizes agree: draws hang on ids and sizes, blocks on the row's place in its
    file too. An empty table gives no rows.
    """
    lean(docs.sparkSession)
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), _key(docs).alias("key"))
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    per = cut(targets(sized, weights, share, most), "targets")
    few = per.count() <= 100_000
    goal = (F.broadcast(per) if few else per).withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    base = sized.join(goal, sized.source.eqNullSafe(goal["of"])).drop("of").withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + EPS))
    # the copies of an id differ by their number, so equal rows draw different numbers
    key = F.xxhash64(F.coalesce(F.col("doc_id"), F.lit(-1)), "size", F.lit(seed))
    base = cut(base.withColumn("p", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0))).withColumn("draw", F.pmod(key, F.lit(1 << 40)) / float(1 << 40)), "rates")
    done, level = [], 0
    work = base.select("row", "source", "size", "p", "draw", F.col("n").alias("open"))
    while True:
        # every block leaves two documents open at most, so the blocks of the next level are known
        work = work.withColumn("blocks", F.ceil(F.col("open") / BLOCK).cast("long"))
        block = F.pmod(F.xxhash64("draw", "row", F.lit(level)), F.col("blocks"))
        flown = work.withColumn("block", block).groupBy("source", "block").applyInPandas(lambda g: _flown(g.drop(columns="block")), work.schema)
        flown = cut(flown, "flown")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(flown.where(~open_))
        work, level = flown.where(open_).withColumn("open", 2 * F.col("blocks")).drop("blocks"), level + 1
        if work.isEmpty():
            break
    taken = done[0].select("row", "p")
    for more in done[1:]:
        taken = taken.unionAll(more.select("row", "p"))
    out = base.join(taken.withColumnRenamed("p", "more"), "row")
    copies = (F.col("whole") + F.round("more")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "row", "key")


def _key(docs: DataFrame) -> F.Column:
    """A hash of a row's id, source and text: equal for rows that are interchangeable in the plan."""
    return F.xxhash64(docs["doc_id"].cast("long"), docs["source"].cast("string"), docs["text"].cast("string"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, with the columns of docs.

    Rows meet the plan by a hash of id, source and text, and copies of a row by a number among them, so other columns keep their values
    whatever their names are.
    """
    nth = lambda order: F.row_number().over(Window.partitionBy("key").orderBy(order))
    plan = mix(docs, **options).select("key", "copies").withColumn("nth", nth("copies"))
    whole = F.struct(*[docs[c].alias(c) for c in docs.columns]).alias("doc")
    rows = docs.select(whole, _key(docs).alias("key")).withColumn("nth", nth("key"))
    both = rows.join(plan.where("copies > 0"), ["key", "nth"])
    return both.select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("doc.*")
