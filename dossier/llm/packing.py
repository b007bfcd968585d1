"""Variable-capacity best-fit packing of documents into sequences of several permitted lengths.

Pieces of documents are dealt to bounded shards by hash, and each shard is packed by best-fit decreasing: a piece
goes to the open bin that it leaves fullest; where none has room, the least-cost bin size is opened: of all
permitted lengths that whose cost per word is the least once the pieces that are left have filled it. In the end
every bin is downsized to the smallest length that holds its contents. Packings that open bins of one length are
tried too, and the cheapest whole packing of the shard is kept.
"""

from __future__ import annotations

import bisect
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ceil_div, cut, lean, partitions

#: Permitted sequence lengths in words; cost of a bin beside its length; pieces in a shard.
LENGTHS, OVERHEAD, SHARD = (512, 1024, 2048, 4096), 16, 8192
WORD = r"[^\x20\x09-\x0D]+"


class _Left:
    """The sizes that are still to be packed, as counts and as a bit mask of those that occur."""

    def __init__(self, sizes: list[int]):
        self.counts = Counter(sizes)
        self.mask = sum(1 << n for n in self.counts)

    def take(self, n: int) -> None:
        self.counts[n] -= 1
        if not self.counts[n]:
            self.mask &= ~(1 << n)

    def fill(self, room: int) -> int:
        """How much of a room the sizes that are left fill, the largest that fits first."""
        mask, left = self.mask, room
        while fits := mask & ((1 << (left + 1)) - 1):
            n = fits.bit_length() - 1
            left -= n * min(self.counts[n], left // n)
            mask &= ~(1 << n)
        return room - left


def _open_size(n: int, lengths: list[int], limit: int | None, overhead: int, left: _Left) -> int:
    """The permitted length of a new bin for n. Under a limit, the largest up to it (or the smallest that holds n). Without one, of all
    lengths that with the least cost per word it will hold, after what is left has filled it and it is downsized."""
    smallest = bisect.bisect_left(lengths, n)
    if limit is not None:
        return max(c for c in lengths[smallest:] if c <= max(limit, lengths[smallest]))

    def rate(c: int) -> float:
        used = n + left.fill(c - n)
        return (lengths[bisect.bisect_left(lengths, used)] + overhead) / used

    return min(lengths[smallest:], key=lambda c: (rate(c), -c))


def best_fit(sizes: list[int], lengths: list[int], limit: int | None, overhead: int) -> tuple[list[int], list[int], int]:
    """Bin of each size, final capacity of each bin, and the total cost. sizes come in decreasing order."""
    rooms: dict[int, list[int]] = {}
    free = 0  # bit r is set if a bin with r words of room is open
    bins, used, rest = [], [], _Left(sizes if limit is None else [])
    for n in sizes:
        if limit is None:
            rest.take(n)
        above = free >> n
        if above:
            r = n + ((above & -above).bit_length() - 1)
            b = rooms[r].pop()
            if not rooms[r]:
                free &= ~(1 << r)
        else:
            b, r = len(used), _open_size(n, lengths, limit, overhead, rest)
            used.append(0)
        used[b] += n
        bins.append(b)
        if left := r - n:
            rooms.setdefault(left, []).append(b)
            free |= 1 << left
    final = [lengths[bisect.bisect_left(lengths, u)] for u in used]
    return bins, final, sum(final) + overhead * len(final)


def cheapest(sizes: list[int], lengths: list[int], overhead: int) -> tuple[list[int], list[int], int]:
    """The cheapest of the packings that choose each bin's length among all and of those that open one length only."""
    return min((best_fit(sizes, lengths, limit, overhead) for limit in (None, *lengths)), key=lambda x: x[2])


def _packed(group: pd.DataFrame, lengths: list[int], overhead: int) -> pd.DataFrame:
    group = group.sort_values(["n_words", "doc_id", "start", "row"], ascending=[False, True, True, True], kind="stable", na_position="last")
    sizes = group["n_words"].tolist()
    bins, final, _ = cheapest(sizes, lengths, overhead)
    bins = np.asarray(bins)
    first = group.groupby(bins)["n_words"]
    return group.assign(bin=bins, capacity=np.asarray(final)[bins], position=first.cumsum().to_numpy() - np.asarray(sizes))


def pack(docs: DataFrame, lengths=LENGTHS, overhead: int = OVERHEAD, shard: int = SHARD) -> DataFrame:
    """One row per piece of docs(doc_id, text, ...): doc_id, piece, start, n_words, bin_id, capacity, position.

    A document of more words than the largest length is cut into pieces of that length and a rest; start is the piece's first
    word. bin_id names a sequence, capacity is its permitted length, position the word of the sequence at which the
    piece starts. Every word of every row is in one bin, no bin is over its capacity, and no smaller permitted
    length would hold it. Rows without words (null, empty, blank) have nothing to pack and give no row. Repeated
    rows are packed once each; null ids stay null. Other columns are ignored. Reruns over the same files and split sizes agree;
    bin_id and shards hang on a row's place in its file too. An empty table gives no rows.
    """
    lean(docs.sparkSession)
    lengths = sorted(set(lengths))
    most = lengths[-1]
    words = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words.alias("words")).where("words > 0")
    sized = cut(sized.withColumn("row", F.monotonically_increasing_id()), "sizes")
    rows = sized.select("doc_id", "row", "words", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(words - 1) div {most}"))).alias("piece"))
    rows = rows.select("doc_id", "row", "piece", (F.col("piece") * most).alias("start"), F.least(F.lit(most), F.col("words") - F.col("piece") * most).alias("n_words"))
    # full pieces need no search: each is a bin
    full = rows.where(F.col("n_words") == most).select("doc_id", "piece", "start", "n_words", F.concat_ws(":", F.lit("full"), "row", "piece").alias("bin_id"), F.lit(most).cast("long").alias("capacity"), F.lit(0).cast("long").alias("position"))
    rest = rows.where(F.col("n_words") < most)
    shards = ceil_div(sized.count(), shard // 2)
    rest = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))
    schema = "doc_id long, row long, piece long, start long, n_words long, shard long, bin long, capacity long, position long"
    tight = rest.repartition(min(shards, partitions(docs.sparkSession)), "shard").groupBy("shard").applyInPandas(lambda g: _packed(g, lengths, overhead), schema)
    tight = tight.select("doc_id", "piece", "start", "n_words", F.concat_ws(":", "shard", "bin").alias("bin_id"), "capacity", "position")
    return full.unionByName(tight)
