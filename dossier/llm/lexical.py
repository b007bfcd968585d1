"""Ranked lexical search by windowed bucket scoring.

Postings lie in windows of documents that follow each other by doc_id. A query's terms are traversed within a window: each posting
adds its integer weight to its document's bucket of an array that fits into a cache, and marks a bit of an occupancy bitset; marked
buckets are then harvested into a heap of the best documents, and only they are reset. Windows that can't beat the heap are passed over.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import met, numbered, shape
from .common import ceil_div, cut, lean, partitions, pieces, utf8

#: Documents of a window (its buckets take 128 KB), and postings after which a window ends early.
DOCUMENTS, POSTINGS = 16_384, 2_000_000
#: Items of a block of queries; bytes of items' texts that are searched for at a time, which bounds the words that tasks look for.
ITEMS, ROUND_BYTES = 256, 32 << 20
#: Bytes of a text whose words are counted at a time.
SLICE = 1 << 20
#: BM25 in whole numbers: k1 is 1.2 and b is 0.25, both times 100 and more; see weights().
SCALE, LOW, B = 1_000_000_000, 100, 25

#: ASCII letters in lower case; all other ASCII characters but digits become spaces. Bytes over 0x7F belong to words.
_FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in UTF-8, a slice of it at a time."""
    text, at = text.translate(_FOLDED), 0
    while at < len(text):
        end = text.find(b" ", min(len(text), at + SLICE))
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def counted(text: bytes) -> tuple[int, Counter]:
    n, counts = 0, Counter()
    for part in words(text):
        n += len(part)
        counts.update(part)
    return n, counts


def _asked(batches: Iterator):
    """(item_id, term, times) of items' texts."""
    import pyarrow as pa

    for batch in batches:
        for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True):
            counts = counted(text)[1]
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["item_id", "term", "times"])


def _indexed(batches: Iterator, codes: dict[bytes, int]):
    """(doc_id, n, codes, times) of documents: the number of their words, and the codes and counts of the words asked for."""
    import pyarrow as pa

    for whole in batches:
        for batch in pieces(whole):
            rows = []
            for text in utf8(batch.column("text")):
                n, counts = counted(text)
                found = sorted((codes[w], counts[w]) for w in (counts if len(counts) < len(codes) else codes) if w in counts and w in codes)
                rows.append((n, np.array([c for c, _ in found], np.int32).tobytes(), np.array([t for _, t in found], np.int32).tobytes()))
            n, c, t = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(c, pa.binary()), pa.array(t, pa.binary())], names=["doc_id", "n", "codes", "times"])


def _frequencies(batches: Iterator, terms: int):
    """(code, df) over a task's documents."""
    import pyarrow as pa

    df = np.zeros(terms, np.int64)
    for batch in batches:
        df += np.bincount(np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.int32), minlength=terms)
    code = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int32)), pa.array(df[code])], names=["code", "df"])


def _windows(batches: Iterator, documents: int, postings: int):
    """Windows of documents that follow each other: ids and lengths of documents, and by term the places and counts of its postings."""
    import pyarrow as pa

    rows, size, names = [], 0, ["ids", "lengths", "terms", "ends", "places", "times"]

    def out():
        counts = [len(c) // 4 for _, _, c, _ in rows]
        code, times = (np.frombuffer(b"".join(r[i] for r in rows), np.int32) for i in (2, 3))
        place = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
        order = np.argsort(code, kind="stable")
        terms, first = np.unique(code[order], return_index=True)
        blobs = [np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), terms, np.r_[first, len(code)].astype(np.int64), place[order], times[order]]
        return pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in blobs], names=names)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "codes", "times")), strict=True):
            rows.append(row)
            size += len(row[2]) // 4
            if len(rows) >= documents or size >= postings:
                yield out()
                rows, size = [], 0
    if rows:
        yield out()


def _queries(batches: Iterator, items: int):
    """Blocks of items: their ids, where each one's terms end, and the terms' codes and counts. An item's rows follow each other."""
    import pyarrow as pa

    ids, ends, code, times = [], [], [], []

    def out():
        blobs = (np.array(ids, np.int64), np.array([*ends[1:], len(code)], np.int64), np.array(code, np.int32), np.array(times, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([b.tobytes()], pa.binary()) for b in blobs], names=["q_ids", "q_ends", "q_terms", "q_times"])

    for batch in batches:
        for item, c, n in zip(*(batch.column(x).to_pylist() for x in ("item_id", "code", "times")), strict=True):
            if not ids or item != ids[-1]:
                if len(ids) == items:
                    yield out()
                    ids, ends, code, times = [], [], [], []
                ids.append(item), ends.append(len(code))
            code.append(c), times.append(n)
    if ids:
        yield out()


class _Postings:
    """A window, with the weight of each posting."""

    def __init__(self, x: dict, weights: np.ndarray, n: int, total: int):
        read = lambda c, kind: np.frombuffer(x[c], kind)
        self.ids, lengths = read("ids", np.int64), read("lengths", np.int64)
        self.terms, self.ends, self.places = read("terms", np.int32), read("ends", np.int64), read("places", np.int32)
        tf, norm = read("times", np.int32).astype(np.int64), LOW - B + (B * lengths * n) // total
        self.weights = np.repeat(weights[self.terms], np.diff(self.ends)) * ((SCALE * tf) // (1000 * tf + 12 * norm[self.places]))
        self.most = np.maximum.reduceat(self.weights, self.ends[:-1]) if len(self.terms) else np.zeros(0, np.int64)
        self.marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def mark(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the occupancy bitset that a term's postings touch, and their bits; places rise within a term."""
        if at not in self.marks:
            place = self.places[self.ends[at] : self.ends[at + 1]]
            byte = place >> 3
            first = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
            self.marks[at] = byte[first], np.bitwise_or.reduceat(np.left_shift(1, place & 7).astype(np.uint8), first)
        return self.marks[at]


class _Harvest:
    """The buckets and the bitset of a window's documents, and a heap of the k best documents for each item of a block."""

    def __init__(self, items: int, k: int):
        self.heaps, self.k = [[] for _ in range(items)], k
        self.buckets, self.occupied = np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def traverse(self, window: _Postings, item: int, code: np.ndarray, times: np.ndarray) -> None:
        if len(self.buckets) < len(window.ids):
            self.buckets, self.occupied = np.zeros(len(window.ids), np.int64), np.zeros(ceil_div(len(window.ids), 8), np.uint8)
        at = np.searchsorted(window.terms, code)
        here = at < len(window.terms)
        here[here] = window.terms[at[here]] == code[here]
        at, times, heap = at[here], times[here], self.heaps[item]
        if not len(at) or (len(heap) == self.k and int((window.most[at] * times).sum()) < heap[0][0]):
            return
        for t, n in zip(at.tolist(), times.tolist(), strict=True):
            part = slice(window.ends[t], window.ends[t + 1])
            self.buckets[window.places[part]] += window.weights[part] * n
            byte, bits = window.mark(t)
            self.occupied[byte] |= bits
        byte = np.flatnonzero(self.occupied)
        place = (byte[:, None] * 8 + np.arange(8))[np.unpackbits(self.occupied[byte, None], axis=1, bitorder="little").astype(bool)]
        score = self.buckets[place]
        self.buckets[place], self.occupied[byte] = 0, 0
        # the heap needs only what its least entry doesn't beat, and of that the k best
        fits = score > 0 if len(heap) < self.k else (score > 0) & (score >= heap[0][0])
        place, score = place[fits], score[fits]
        if len(place) > self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            place, score = place[score >= least], score[score >= least]
        # documents rise with their place, so of equal scores the first are the ones that stay
        for entry in sorted(zip(score.tolist(), (-window.ids[place]).tolist(), strict=True), reverse=True)[: self.k]:
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            else:
                break


def _scored(batches: Iterator, weights: np.ndarray, n: int, total: int, k: int):
    import pyarrow as pa

    held: dict[bytes, _Harvest] = {}
    for batch in batches:
        for at in range(batch.num_rows):
            x = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
            ends, code, times = np.frombuffer(x["q_ends"], np.int64), np.frombuffer(x["q_terms"], np.int32), np.frombuffer(x["q_times"], np.int64)
            harvest = held.setdefault(x["q_ids"], _Harvest(len(ends), k))
            window = _Postings(x, weights, n, total)
            for i, (a, b) in enumerate(zip(np.r_[0, ends[:-1]], ends, strict=True)):
                harvest.traverse(window, i, code[a:b], times[a:b])
    for q_ids, harvest in held.items():
        rows = [(q, -d, s) for q, heap in zip(np.frombuffer(q_ids, np.int64).tolist(), harvest.heaps, strict=True) for s, d in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["item_id", "doc_id", "score"])


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """floor(1000 ln((2 n + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, documents: int = DOCUMENTS, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of docs(doc_id, text, ...) that score highest, over 0, for each of items(item_id, text, ...).

    Words are runs of ASCII letters and digits and of all characters over U+007F; A to Z are lower-cased. A word's weight, the share of its
    count in a document and the score are whole numbers; ties go to the smaller doc_id, and fewer than k documents are all returned. Null
    and empty texts have no words. Counts cover all documents with a word, those without an id too, but such can't be named and aren't
    returned. Rows that repeat a doc_id are documents of their own, each with a rank. Rows that repeat an item_id are one item with the
    words of all; items without an id take no part. Other columns are ignored. No documents or no items give no rows.

    Items are searched in rounds of about round_bytes of their texts (dealt by a hash of the id, an item stays whole), so the words that
    tasks look for are bounded; each round reads the documents once.
    """
    spark = lean(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rounds = ceil_div(size, round_bytes)
    found = [_round(docs, items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == i), k, documents) for i in range(rounds)]
    found = [x for x in found if x is not None]
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    every = found[0]
    for x in found[1:]:
        every = every.unionAll(x)
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _round(docs: DataFrame, items: DataFrame, k: int, documents: int) -> DataFrame | None:
    """(item_id, doc_id, score) of a bounded number of items: the k best of each cell of blocks of items and windows."""
    spark = docs.sparkSession
    asked = cut(items.mapInArrow(_asked, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times")), "asked")
    terms = sorted(bytes(r.term) for r in asked.select("term").distinct().collect())
    if not terms:
        return None
    codes = {t: i for i, t in enumerate(terms)}
    index = cut(docs.mapInArrow(lambda b: _indexed(b, codes), "doc_id long, n long, codes binary, times binary"), "index")
    n, total, hits, last = index.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n"), F.count(F.when(F.length("codes") > 0, 1)), F.sum(F.length("codes") / 4)).first()
    if not hits:
        return None
    df = np.zeros(len(terms), np.int64)
    for r in index.select("codes").mapInArrow(lambda b: _frequencies(b, len(terms)), "code int, df long").groupBy("code").agg(F.sum("df").alias("df")).collect():
        df[r.code] = r.df
    weight, tasks = weights(df, n), partitions(spark)

    known = index.where("doc_id is not null and length(codes) > 0").withColumn("tie", F.xxhash64("codes"))
    about = max(ceil_div(hits, documents), ceil_div(int(last), POSTINGS))
    dealt = known.repartitionByRange(max(1, min(tasks, about)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    windows = dealt.select("doc_id", "n", "codes", "times").mapInArrow(lambda b: _windows(b, documents, POSTINGS), ", ".join(f"{c} binary" for c in ("ids", "lengths", "terms", "ends", "places", "times")))
    many = ceil_div(asked.select("item_id").distinct().count(), ITEMS)
    groups, parts = shape(many, about, tasks)
    windows = cut(numbered(windows, "part", parts), "windows")
    coded = asked.mapInArrow(lambda b: _coded(b, codes), "item_id long, code int, times long")
    queries = coded.repartition(many, "item_id").sortWithinPartitions("item_id", "code").mapInArrow(lambda b: _queries(b, ITEMS), "q_ids binary, q_ends binary, q_terms binary, q_times binary")
    pairs = met(cut(numbered(queries, "group", groups), "queries"), windows, groups, parts)
    return pairs.mapInArrow(lambda b: _scored(b, weight, n, total, k), "item_id long, doc_id long, score long")


def _coded(batches: Iterator, codes: dict[bytes, int]):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array([codes[t] for t in batch.column("term").to_pylist()], pa.int32()), batch.column("times")], names=["item_id", "code", "times"])
