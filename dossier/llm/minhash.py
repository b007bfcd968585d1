"""MinHash near-dedup with circulant permutations, banding and exact Jaccard verification.

Signatures follow C-MinHash: one permutation sigma places the shingles in a universe of 2**32 slots, a second
one, pi, is shifted circularly by k for the k-th coordinate: h_k = min pi(sigma(x) - k). Both are bijective
integer mixers, so no permutation table is stored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, components, cut, fmix32, fmix64, lean

#: Signature length, and rows in a band. At a Jaccard of 0.85 a pair misses all 32 bands with probability 6e-11, at 0.8 with 5e-8.
COORDINATES, ROWS = 128, 4
#: Odd multipliers of the word and shingle hashes.
WORD_MULTIPLIER = 0x9E3779B97F4A7C15


class _Words(dict):
    """Remembers the hashes of words that were seen."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's k-word shingles.

    A-Z are lower-cased and words split at space and \\x09-\\x0D, which is what bytes.lower() and
    bytes.split() do. Fewer than k words: the whole sequence is one shingle. No words: an empty set.
    """
    known = _Words()
    for text in texts:
        words = text.lower().split()
        if not words:
            yield np.zeros(0, np.uint64)
            continue
        if len(known) > 50_000:
            known.clear()
        ids = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - k + 1)
        width = min(k, len(words))
        h = np.full(n, width, np.uint64)
        for j in range(width):
            h = fmix64(h * np.uint64(WORD_MULTIPLIER) + ids[j : j + n])
        yield np.unique(h)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The COORDINATES minima of the circulant permutations over a non-empty set."""
    placed = fmix32((shingles >> np.uint64(32)).astype(np.uint32) ^ np.uint32(0x5BD1E995))
    out = np.full(COORDINATES, np.uint32(0xFFFFFFFF))
    shifts = np.arange(COORDINATES, dtype=np.uint32)[:, None]
    for at in range(0, len(placed), 1024):
        out = np.minimum(out, fmix32(placed[None, at : at + 1024] - shifts).min(axis=1))
    return out


def _signed(batches: Iterator, k: int):
    import pyarrow as pa

    from .common import pieces, utf8

    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    for batch in batches:
        for part in pieces(batch):
            n, digest, bands, sketch = [], [], [], []
            for s in shingle_sets(utf8(part.column("text")), k):
                n.append(len(s))
                if not len(s):
                    digest.append(None), bands.append(None), sketch.append((0, 0))
                    continue
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                g = signature(s)
                b = np.zeros(COORDINATES // ROWS, np.uint64)
                for r in range(ROWS):
                    b = fmix64(b * np.uint64(WORD_MULTIPLIER) + g[r::ROWS])
                bands.append(b.view(np.int64))
                low = ((g >> np.uint32(7)) & np.uint32(1)).astype(np.uint64)
                sketch.append(((low[:64] * bit).sum().view(np.int64), (low[64:] * bit).sum().view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array([int(x) for x, _ in sketch], pa.int64()), pa.array([int(x) for _, x in sketch], pa.int64())],
                names=["doc_id", "n_shingles", "digest", "bands", "sketch0", "sketch1"],
            )


def _sets(batches: Iterator, k: int):
    import pyarrow as pa

    from .common import pieces, utf8

    for batch in batches:
        for part in pieces(batch):
            sets = [s.view(np.int64) for s in shingle_sets(utf8(part.column("text")), k)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept.

    Two documents are linked when 100 * intersection >= percent * union of their distinct k-word shingle sets;
    component_id is the smallest doc_id reachable over links, kept says that it is the row's own. Documents
    without words (null, empty, blank) have n_shingles 0 and stand alone. doc_id is a key:
    rows that repeat it repeat the text too, and keep one row each. A
    null doc_id gets a null component_id and is never linked, nor kept is null. Other columns are ignored.

    Copies collapse to one representative per distinct set (a partial aggregation), so a group of thousands
    of copies costs one member. Representatives that share a band are compared in two rounds. First each with its
    bucket's centre, the member whose bands are the most shared: linear in the bucket, and exact. Then only pairs whose
    components still differ: of such a pair one isn't in the centre's component, so those few meet the bucket, after two
    tests inside the join: 128-bit sketches, and a bound on the intersection from the exact comparison of both with their
    centre. Every link is verified on the full sets.
    """
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_shingles long, digest binary, bands array<long>, sketch0 long, sketch1 long"
    signed = cut(docs.mapInArrow(lambda b: _signed(b, k), schema), "signed")
    reps = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "n_shingles", "sketch0", "sketch1", "bands")).alias("r")).select("digest", "r.*")
    reps = cut(reps, "reps")
    member = reps.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("bn"), F.col("sketch0").alias("b0"), F.col("sketch1").alias("b1"), F.posexplode("bands").alias("band", "value"))
    shared = member.groupBy("band", "value").agg(F.count("*").alias("n")).where("n > 1")
    # members of buckets with company; everything below works on these alone
    member = cut(member.join(shared, ["band", "value"]), "members")
    member = member.join(member.groupBy("b").agg(F.sum("n").alias("known")), "b")
    centre = member.groupBy("band", "value").agg(F.max(F.struct("known", (-F.col("b")).alias("id"), "bn", "b0", "b1")).alias("c"))
    centre = centre.select("band", "value", (-F.col("c.id")).alias("a"), F.col("c.bn").alias("an"), F.col("c.b0").alias("a0"), F.col("c.b1").alias("a1"))
    member = cut(member.drop("n", "known").join(centre, ["band", "value"]), "centred")
    apart = _bits_apart(percent)
    near = F.expr(f"100 * least(an, bn) >= {percent} * greatest(an, bn) and bit_count(a0 ^ b0) + bit_count(a1 ^ b1) < {apart}")
    star = _compared(docs, member.where("a <> b").where(near).select("a", "b").distinct(), k)
    linked = star.where(_enough("common", "an", "bn", percent)).select("a", "b")
    parts = components(linked, "a", "b")

    # second round: buckets that still hold several components
    placed = member.select("band", "value", "a", "b", "bn", "b0", "b1").join(parts, member.b == parts.node, "left").withColumn("bc", F.coalesce("component", "b")).drop("node", "component")
    placed = placed.join(parts.toDF("centre_", "ac"), F.col("a") == F.col("centre_"), "left").withColumn("apart", F.coalesce("ac", "a") != F.col("bc")).drop("centre_", "ac")
    placed = cut(placed, "placed")
    mixed = placed.groupBy("band", "value").agg(F.min("bc").alias("lo"), F.max("bc").alias("hi")).where("lo < hi").select("band", "value")
    placed = placed.join(mixed, ["band", "value"], "left_semi").join(star.select("a", "b", "bits", "more", (F.col("bn") - F.col("common")).alias("rest")), ["a", "b"], "left")
    placed = cut(placed, "mixed")
    side = lambda s: placed.select("band", "value", *[F.col(f"b{c}").alias(f"{s}{c}") for c in ("", "n", "0", "1", "c")], F.col("bits").alias(f"{s}bits"), F.col("more").alias(f"{s}more"), F.col("rest").alias(f"{s}rest"), (F.col("a") == F.col("b")).alias(f"{s}centre"), F.col("apart").alias(f"{s}apart"))
    # within the centre's set the intersection is counted; outside it, each bit that one side alone has is a shingle the other lacks
    lacks = lambda p, q: f"aggregate(zip_with({p}more, {q}more, (p, q) -> bit_count(p & ~q)), 0, (t, n) -> t + n)"
    inside = F.expr(f"aggregate(zip_with(abits, bbits, (p, q) -> bit_count(p & q)), 0, (t, n) -> t + n) + least(arest - {lacks('a', 'b')}, brest - {lacks('b', 'a')})")
    bound = F.when(F.col("acentre") | F.col("bcentre"), F.coalesce("abits", "bbits").isNull()).when(F.col("abits").isNull() | F.col("bbits").isNull(), True).otherwise(_enough(inside, "an", "bn", percent))
    # pairs of two members that are both apart from the centre's component come once, by their ids
    x, y = side("a").where("aapart"), side("b")
    cross = x.join(y, (x.band == y.band) & (x.value == y.value) & (~y.bapart | (x.a < y.b)) & (x.ac != y.bc) & near & bound)
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    found = _compared(docs, cross, k)
    linked = linked.unionAll(found.where(_enough("common", "an", "bn", percent)).select("a", "b"))
    parts = components(linked, "a", "b")

    group = reps.select("digest", F.col("doc_id").alias("rep"))
    group = group.join(parts, group.rep == parts.node, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "digest").join(group, "digest", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _bits_apart(percent: int) -> int:
    """One bit of each coordinate makes a sketch; bits differ with probability (1 - J) / 2. Pairs of this many different
    bits or more lie over six standard deviations from the threshold."""
    p = (1 - percent / 100) / 2
    return int(COORDINATES * p + 6 * (COORDINATES * p * (1 - p)) ** 0.5) + 1


def _enough(common, n, m, percent: int) -> F.Column:
    """100 * intersection >= percent * union."""
    col = lambda x: F.col(x) if isinstance(x, str) else x
    return (100 + percent) * col(common) >= percent * (col(n) + col(m))


def _against(batches: Iterator):
    """Intersections of the sets y with x, which of x's shingles they are as a bit map in words, and a hashed bit map of y's rest."""
    import pyarrow as pa

    for batch in batches:
        xs, ys = batch.column("x"), batch.column("y")
        x, y = (c.flatten().to_numpy().view(np.uint64) for c in (xs, ys))
        xe, ye = (np.r_[0, np.cumsum(c.value_lengths().to_numpy())] for c in (xs, ys))
        common, bits, more = [], [], []
        for i in range(batch.num_rows):
            p, q = x[xe[i] : xe[i + 1]], y[ye[i] : ye[i + 1]]
            at = np.minimum(np.searchsorted(q, p), len(q) - 1)
            same = q[at] == p
            common.append(int(same.sum()))
            bits.append(np.packbits(np.r_[same, np.zeros(-len(same) % 64, bool)]).view(np.int64))
            other = np.ones(len(q), bool)
            other[at[same]] = False
            flags = np.zeros(len(bits[-1]) * 128, bool)
            flags[(fmix64(q[other]) % np.uint64(len(flags))).astype(np.int64)] = True
            more.append(np.packbits(flags).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(np.diff(xe), pa.int64()), pa.array(np.diff(ye), pa.int64()), pa.array(common, pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))], names=["a", "b", "an", "bn", "common", "bits", "more"])


def _compared(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) with an, bn, common (exact sizes of the full shingle sets and of their intersection), bits and more."""
    pairs = cut(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select(F.col("b").alias("doc_id"))).distinct()
    sets = among(docs, ids, "doc_id").dropDuplicates(["doc_id"]).mapInArrow(lambda b: _sets(b, k), "doc_id long, shingles array<long>")
    sets = cut(sets, "sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return cut(both.mapInArrow(_against, "a long, b long, an long, bn long, common long, bits array<long>, more array<long>"), "compared")
