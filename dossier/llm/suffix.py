"""Removal of long repeated passages with a logarithmic family of suffix arrays.

Every string of LENGTH bytes (a window) is dealt to a place that its content alone names, so equal windows
meet wherever they occur; there, batches of suffixes are sorted into suffix arrays, merge-scanned against
the levels that exist, and levels of equal size merge.

How a window is named: its anchor is the leftmost smallest-hash GRAM in it, so equal windows have their
anchor at the same offset. Windows with one anchor and offsets within one aligned range of SPAN share the
bytes that all of them contain, the core (LENGTH - SPAN + 1 bytes). A block is such a run of windows: it is
SPAN - 1 bytes before the core, the core, and SPAN - 1 bytes after it. Only blocks whose core occurs more
than once can hold repeated windows; the core itself then acts as one symbol of the suffixes (a 128-bit
digest), which keeps each block at 2 * (SPAN - 1) + 16 bytes.

A core with many blocks (the edge of a passage that many documents hold amid other text) would meet in one task.
Its blocks are parted into pieces of STEP windows, dealt by the bytes that all windows of a piece contain; so
pieces that meet differ in STEP - 1 bytes at either end at most, which bounds how many there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, INVERSE, among, ceil_div, cut, fmix64, lean, powers

#: Bytes of the strings that count, of an anchor, and of windows in a block.
LENGTH, GRAM, SPAN = 400, 48, 64
#: Windows of a document are worked on in slices of this many bytes, to bound the temporary arrays.
SLICE = 1 << 18
#: Blocks in a batch of the index, and blocks that one task's family is planned for.
BATCH, FAMILY = 256, 4096
#: Blocks of one core that stay together, and windows of a piece into which the blocks of a core with more are parted.
CROWD, STEP = 1024, 2
#: What names a row: its id (or a hash of its text) and another hash of its text. Rows that share both are copies, and have the same places.
ROW = ["row_id", "row_text"]
ROW_TYPES = "row_id long, row_text long"


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each window start i of text the start of its anchor; empty if the text is shorter than a window."""
    n = len(text) - length + 1
    if n < 1:
        return np.zeros(0, np.int64)
    out, wide = [], length - gram + 1
    up, down = powers(BASE, SLICE + length), powers(INVERSE, SLICE + length)
    data = np.frombuffer(text, np.uint8)
    for at in range(0, n, SLICE):
        part = data[at : min(len(data), at + SLICE + length - 1)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        grams = fmix64((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        # the hash above, the place below: the least is the leftmost of the smallest hash
        keyed = (grams & ~np.uint64((1 << 20) - 1)) | np.arange(len(grams), dtype=np.uint64)
        m = len(grams)
        padded = np.full(ceil_div(m, wide) * wide, np.uint64(2**64 - 1))
        padded[:m] = keyed
        rows = padded.reshape(-1, wide)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        count = m - wide + 1
        least = np.minimum(after[:count], before[wide - 1 : wide - 1 + count])
        out.append((least & np.uint64((1 << 20) - 1)).astype(np.int64) + at)
    return np.concatenate(out)


def blocks(text: bytes, length: int = LENGTH, gram: int = GRAM, span: int = SPAN) -> tuple[np.ndarray, ...]:
    """Blocks of a text: first window, number of windows, core start, and a 64-bit hash of the core."""
    a = anchors(text, length, gram)
    if not len(a):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    offset = a - np.arange(len(a))
    part = a * ceil_div(length, span) + offset // span
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    count = np.diff(np.r_[first, len(a)])
    core = a[first] - (offset[first] // span) * span
    size = length - span + 1
    data, hashes = np.frombuffer(text, np.uint8), []
    for at in range(0, len(first), 2048):
        c = core[at : at + 2048]
        lo, hi = int(c.min()), int(c.max()) + size
        up, down = powers(BASE, hi - lo), powers(INVERSE, hi - lo)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
        hashes.append(fmix64((sums[c - lo + size] - sums[c - lo]) * down[c - lo] + np.uint64(size)))
    return first, count, core, np.concatenate(hashes)


def _listed(batches: Iterator, length: int, gram: int, span: int):
    import pyarrow as pa

    from .common import pieces, utf8

    for batch in batches:
        for part in pieces(batch, 1 << 21):
            ids, rows = [part.column(c) for c in ROW], []
            for i, text in enumerate(utf8(part.column("text"))):
                first, count, core, h = blocks(text, length, gram, span)
                rows.append((np.full(len(first), i), first, count, core, h))
            if rows:
                i, first, count, core, h = (np.concatenate(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([c.take(pa.array(i, pa.int64())) for c in ids] + [pa.array(first.astype(np.int64)), pa.array(count.astype(np.int32)), pa.array(core.astype(np.int64)), pa.array(h.view(np.int64))], names=[*ROW, "first", "count", "core", "hash"])


def _lists(column) -> tuple[np.ndarray, object]:
    """Offsets and the struct array below a list column of an Arrow batch, null as an empty list."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(sizes)], column.flatten()


def _cut_out(batches: Iterator, length: int, span: int):
    """The strings of the blocks in at (an array of structs): before and after the core, and the core's digest."""
    import pyarrow as pa

    from .common import utf8

    size, side = length - span + 1, span - 1
    for batch in batches:
        ends, at = _lists(batch.column("at"))
        first, count, core = (at.field(c).to_numpy() for c in ("first", "count", "core"))
        strings, texts = [], utf8(batch.column("text"))
        for i, text in enumerate(texts):
            padded = bytes(side) + text + bytes(side)
            for c in core[ends[i] : ends[i + 1]].tolist():
                strings.append(padded[c : c + side] + hashlib.blake2b(text[c : c + size], digest_size=16).digest() + padded[c + side + size : c + 2 * side + size])
        lo = (first - (core - side)).astype(np.int32)
        of = pa.array(np.repeat(np.arange(len(texts)), np.diff(ends)))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(of) for c in ROW] + [pa.array(first), pa.array(strings, pa.binary()), pa.array(lo), pa.array(lo + count.astype(np.int32))], names=[*ROW, "first", "block", "lo", "hi"])


class SuffixFamily:
    """Suffix arrays in levels of doubling size over blocks' strings; add() marks suffixes that occur more than once.

    A suffix is a position lo <= t < hi in a block's string, compared over width bytes. Blocks have numbers
    from 0 in the order of arrival; seen[b] is the bit mask of the marked suffixes of block b.
    """

    def __init__(self, width: int):
        self.width, self.levels, self.seen = width, [], []

    def _sorted(self, strings: np.ndarray, block: np.ndarray, t: np.ndarray) -> tuple:
        keys = np.lib.stride_tricks.sliding_window_view(strings, self.width, axis=1)[block, t].copy().view(f"V{self.width}").ravel()
        order = np.argsort(self._words(keys), kind="stable")
        return keys[order], block[order], t[order]

    def _words(self, keys: np.ndarray) -> np.ndarray:
        """A view that numpy sorts in byte order: the width is padded with an end byte, as S types drop final zeros."""
        wide = np.full((len(keys), self.width + 1), 1, np.uint8)
        wide[:, :-1] = keys.view(np.uint8).reshape(len(keys), self.width)
        return wide.view(f"S{self.width + 1}").ravel()

    def _mark(self, keys, block, t, base) -> None:
        same = keys[1:] == keys[:-1]
        for at in np.flatnonzero(np.r_[same, False] | np.r_[False, same]):
            self.seen[base[block[at]] if base is not None else block[at]] |= 1 << int(t[at])

    def add(self, strings: list[bytes], lo: list[int], hi: list[int], weight: list[int]) -> None:
        """A new batch: its suffix array is built, scanned by itself and against each level, and then becomes a level."""
        start = len(self.seen)
        self.seen += [((1 << h) - (1 << x)) if w > 1 else 0 for x, h, w in zip(lo, hi, weight, strict=True)]
        data = np.frombuffer(b"".join(strings), np.uint8).reshape(len(strings), -1)
        count = np.subtract(hi, lo)
        block = np.repeat(np.arange(len(strings)), count)
        t = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(np.asarray(lo), count)
        keys, block, t = self._sorted(data, block, t)
        block = block + start
        self._mark(keys, block, t, None)
        for level in self.levels:
            self._scan(level, (keys, block, t))
        self.levels.append((keys, block, t))
        while len(self.levels) > 1 and len(self.levels[-1][0]) * 2 > len(self.levels[-2][0]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(self._merged(a, b))

    def _merged(self, a: tuple, b: tuple) -> tuple:
        """Two suffix arrays as one; a stable sort of two sorted runs is a merge."""
        keys = np.concatenate([a[0], b[0]])
        order = np.argsort(self._words(keys), kind="stable")
        return keys[order], np.concatenate([a[1], b[1]])[order], np.concatenate([a[2], b[2]])[order]

    def _scan(self, level: tuple, new: tuple) -> None:
        """Mark what matches between a level and a sorted batch: the batch's range in the level, found in order."""
        mine, theirs = self._words(level[0]), self._words(new[0])
        left, right = np.searchsorted(mine, theirs, "left"), np.searchsorted(mine, theirs, "right")
        for i in np.flatnonzero(right > left):
            self.seen[new[1][i]] |= 1 << int(new[2][i])
            at = left[i]
            # once marked, equal suffixes of a level have all been marked
            if not self.seen[level[1][at]] >> int(level[2][at]) & 1:
                for j in range(at, right[i]):
                    self.seen[level[1][j]] |= 1 << int(level[2][j])


def _families(batches: Iterator, length: int, span: int):
    """A task's family over its blocks and pieces (all of a key come to one task, next to each other)."""
    import pyarrow as pa

    family, width, rows, held = SuffixFamily(span + 15), span + 15, [], []

    def flush():
        if held:
            family.add([x[0] for x in held], [x[1] for x in held], [x[2] for x in held], [x[3] for x in held])
            rows.extend(x[:3] for x in held)
            held.clear()

    def out():
        masks = [m - (1 << 64) if m >> 63 else m for m in family.seen]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32()), pa.array(masks, pa.int64())], names=["block", "lo", "hi", "mask"])

    last = None
    for batch in batches:
        for x in zip(*(batch.column(c).to_pylist() for c in ("block", "lo", "hi", "weight", "key")), strict=True):
            if held and len(x[0]) != len(held[0][0]):
                flush()
            if x[4] != last and len(family.seen) + len(held) >= FAMILY:
                # what has another key doesn't match, so a family may end between two of them
                flush()
                yield out()
                family, rows[:] = SuffixFamily(width), []
            last = x[4]
            held.append(x)
            if len(held) >= BATCH:
                flush()
    flush()
    if rows:
        yield out()


def _stripped(batches: Iterator, length: int, keep: bool):
    import pyarrow as pa

    from .common import pieces, utf8

    for whole in batches:
        for batch in pieces(whole):
            texts, (ends, runs) = utf8(batch.column("text")), _lists(batch.column("runs"))
            from_, mask = (runs.field("first").to_numpy() - runs.field("lo").to_numpy(), runs.field("mask").to_numpy())
            n, removed, spans, digest, kept = [], [], [], [], []
            for i, text in enumerate(texts):
                rest, gone = text, np.zeros(0, bool)
                if ends[i] < ends[i + 1]:
                    bits = np.unpackbits(np.ascontiguousarray(mask[ends[i] : ends[i + 1]]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    block, t = np.nonzero(bits)
                    at = from_[ends[i] : ends[i + 1]][block] + t
                    depth = np.bincount(at, minlength=len(text) + 1) - np.bincount(at + length, minlength=len(text) + 1)
                    gone = np.cumsum(depth[: len(text)]) > 0
                    rest = np.frombuffer(text, np.uint8)[~gone].tobytes()
                n.append(len(text)), removed.append(int(gone.sum())), kept.append(rest if keep else None)
                spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0)
                digest.append(hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _parted(found: DataFrame, span: int, step: int) -> DataFrame:
    """The rows of found by pieces of step windows, each window in one piece; the last piece may start earlier, for its length."""
    at = F.explode(F.sequence(F.floor(F.col("lo") / step), F.floor((F.col("hi") - 1) / step))).alias("k")
    found = found.select("*", at).withColumn("t", F.least(F.col("k") * step, F.lit(span - step)).cast("int"))
    lo, hi = (F.greatest("lo", F.col("k") * step) - F.col("t")).cast("int"), (F.least("hi", F.col("k") * step + step) - F.col("t")).cast("int")
    first = F.col("first") - F.col("lo") + F.col("t") + lo
    return found.select(*ROW, first.alias("first"), F.substring("block", F.col("t") + 1, F.lit(span + 14 + step)).alias("block"), lo.alias("lo"), hi.alias("hi"))


def repeated_blocks(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, span: int = SPAN) -> DataFrame:
    """ROW, first, lo, mask for docs(ROW, text): bit t of mask says that the window at first - lo + t of the row's text occurs more than once."""
    spark = docs.sparkSession
    listed = cut(docs.mapInArrow(lambda b: _listed(b, length, gram, span), ROW_TYPES + ", first long, count int, core long, hash long"), "blocks")
    # written, so that both sides of the join are plain exchanges: Spark splits the rows of a very frequent core over tasks then
    often = cut(listed.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "often")
    # of rows that are copies of each other, each block is listed once
    hits = listed.join(often, "hash", "left_semi").groupBy(ROW).agg(F.collect_set(F.struct("first", "count", "core")).alias("at"))
    hits = cut(hits, "hits")
    some = among(docs, hits.select(ROW), ROW).join(hits, ROW)
    found = some.mapInArrow(lambda b: _cut_out(b, length, span), ROW_TYPES + ", first long, block binary, lo int, hi int")
    found = cut(found, "found")
    weighed = lambda df: df.groupBy("block", "lo", "hi").agg(F.count("*").alias("weight"))
    distinct, core, step = cut(weighed(found), "distinct"), F.substring("block", span, 16), min(STEP, span)
    crowded = cut(distinct.groupBy(core.alias("core")).agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("core"), "crowded")
    if crowded.count():
        of = lambda df, how: among(df.withColumn("core", core), crowded, "core", how).drop("core")
        pieces = cut(_parted(of(found, "left_semi"), span, step), "pieces")
        found = of(found, "left_anti").unionByName(pieces)
        distinct = cut(of(distinct, "left_anti").unionByName(weighed(pieces)), "distinct")
    key = F.when(F.length("block") == 2 * span + 14, core).otherwise(F.substring("block", step, span + 16 - step))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil_div(distinct.count(), FAMILY))
    # pieces and blocks have different lengths, and a batch of a family one
    dealt = distinct.withColumn("key", key).repartition(tasks, "key").sortWithinPartitions(F.length("block"), "key")
    masks = cut(dealt.mapInArrow(lambda b: _families(b, length, span), "block binary, lo int, hi int, mask long"), "masks")
    return found.join(masks, ["block", "lo", "hi"]).where("mask <> 0").select(*ROW, "first", "lo", "mask")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, span: int = SPAN, keep: bool = True) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes;
    null if keep is false).

    A byte goes if it lies in a string of length bytes that starts at another place too, in the same document or
    any other; strings are judged on the input and never cross documents. Null texts count as empty; texts
    shorter than length lose nothing. Every row is a document of its own and counts: rows that repeat an id, with the same
    text or another, and rows without an id too. Other columns are ignored.
    """
    if not gram <= length - span + 1 or span > 64:
        raise ValueError("gram must fit into the core, and span into 64 bits")
    lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", "text", F.coalesce("doc_id", F.xxhash64(F.lit(1), "text")).alias("row_id"), F.xxhash64("text").alias("row_text"))
    runs = repeated_blocks(docs.select(*ROW, "text"), length, gram, span)
    runs = cut(runs.groupBy(ROW).agg(F.collect_set(F.struct("first", "lo", "mask")).alias("runs")), "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    with_runs = among(docs, runs.select(ROW), ROW).join(runs, ROW)
    rest = among(docs, runs.select(ROW), ROW, "left_anti").withColumn("runs", F.lit(None).cast(runs.schema["runs"].dataType))
    return with_runs.unionByName(rest).mapInArrow(lambda b: _stripped(b, length, keep), schema)
