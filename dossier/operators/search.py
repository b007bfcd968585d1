"""Ranking: keyword, vector and hybrid search, source ranking, graph boosts, keyword classes, key sentences."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import blocks, text
from ..functions.tables import lean, spread, written

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Weights of queries' words that a task holds.
WEIGHTS = 1_000_000


def top(df: DataFrame, by: str, order: list, k: int) -> DataFrame:
    """The k first rows per query with their rank; Spark prunes each partition to k per query before the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, most: int = WEIGHTS) -> DataFrame:
    """query_id, doc_id, score, rank: the k best documents with a score over 0 for each of queries(query_id, query).

    Okapi weights with k1 1.5 and b 0.75; a negative inverse frequency becomes a quarter of the mean over all terms. Counts
    cover all documents. Query words count as often as they occur. Null texts are empty. doc_id and query_id are integers.

    Queries with their weights are dealt to groups (of most weights in the mean) and documents to parts; both meet in the cells of
    a grid, one for each task, which holds its queries and has its documents pass by. A document is copied to the groups, a
    query to the parts. A cell leaves k documents per query, so a frequent word meets no posting list, and of queries, words
    and weights none passes through the driver.
    """
    lean(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    # one pass counts documents, words and each word's documents; the row without a term has the sums
    counts = spread(slim.select("text")).mapInArrow(_counted, "term string, df long, n long, words long").groupBy("term")
    counts = written(counts.agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.sum("words").alias("words")), "counts")
    sums = counts.where("term is null").first()
    n, mean_length = (sums.n, sums.words / sums.n) if sums else (0, 0.0)
    raw = counts.where("term is not null").select("term", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw")).first()[0]
    idf = F.when(F.col("raw") < 0, FLOOR * F.lit(mean)).otherwise(F.col("raw"))
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # a hint, as a broadcast of the words would pass through the driver
    weighed = asked.hint("merge").join(raw, "term").select("query_id", "term", (F.col("times") * idf * (K1 + 1)).alias("weight"))
    weighed = written(weighed.groupBy("query_id").agg(F.collect_list(F.struct("term", "weight")).alias("weights")), "weights")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-(weighed.agg(F.sum(F.size("weights"))).first()[0] or 0) // most))
    parts = max(1, -(-tasks // groups))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = (F.col("group") * parts + F.col("part")).cast("int").alias("cell")
    left = weighed.withColumn("group", F.pmod(F.xxhash64("query_id"), F.lit(groups))).withColumn("part", each(parts)).select(cell, F.col("query_id").alias("id"), "weights", F.lit(None).cast("string").alias("text"))
    # a document without an id is counted, but can't be a hit
    right = slim.where("doc_id is not null").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts))).withColumn("group", each(groups))
    right = right.select(cell, F.col("doc_id").alias("id"), F.lit(None).cast(weighed.schema["weights"].dataType).alias("weights"), "text")
    # queries first: they have no text
    cells = left.unionAll(right).repartitionById(groups * parts, "cell").sortWithinPartitions("cell", F.col("text").isNotNull())
    scored = cells.mapInArrow(lambda b: _scored(b, mean_length, k), "query_id long, doc_id long, score double")
    return top(scored, "query_id", [F.desc("score"), F.col("doc_id")], k)


def _counted(batches, most: int = 500_000):
    """(term, df, n, words): how many of a task's documents hold a term, and with a null term the numbers of its documents and their words."""
    import pyarrow as pa

    def out(counts: Counter, n: int, words: int):
        terms = [None, *(t.decode() for t in counts)]
        zeros = [0] * len(counts)
        return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array(x, pa.int64()) for x in ([0, *counts.values()], [n, *zeros], [words, *zeros]))], names=["term", "df", "n", "words"])

    held, n, words = Counter(), 0, 0
    for batch in batches:
        for t in batch.column("text").cast(pa.large_binary()).to_pylist():
            parts = t.split()
            n, words = n + 1, words + len(parts)
            held.update(set(parts))
            if len(held) > most:
                yield out(held, n, words)
                held, n, words = Counter(), 0, 0
    if n:
        yield out(held, n, words)


def _scored(batches, mean_length: float, k: int):
    """(query_id, doc_id, score): of each cell's documents the k best for each of its queries, which come before them."""
    import pyarrow as pa

    last, rows, scorer = None, [], None
    for batch in batches:
        cell, ids = batch.column("cell").to_numpy(), batch.column("id")
        asked, texts = batch.column("text").is_null().to_numpy(zero_copy_only=False), batch.column("text").cast(pa.large_binary())
        ends = np.flatnonzero((np.diff(cell) != 0) | (asked[1:] != asked[:-1])) + 1
        for i, j in zip([0, *ends], [*ends, len(cell)], strict=True):
            if cell[i] != last:
                if scorer:
                    yield scorer.out()
                last, rows, scorer = cell[i], [], None
            if asked[i]:
                rows += zip(ids[i:j].to_pylist(), _lists(batch.column("weights")[i:j]), strict=True)
            elif rows or scorer:
                scorer = scorer or _Scorer(rows, mean_length, k)
                rows = []
                scorer.add(ids[i:j].to_numpy(), texts[i:j].to_pylist())
    if scorer:
        yield scorer.out()


def _lists(weights) -> list:
    """(terms, weights) of each row of an Arrow array of lists of both."""
    import pyarrow as pa

    flat, at = weights.flatten(), np.r_[0, np.cumsum(weights.value_lengths().to_numpy())]
    terms, values = flat.field("term").cast(pa.large_binary()).to_pylist(), flat.field("weight").to_numpy()
    return [(terms[i:j], values[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]


class _Scorer:
    """Scores documents for the queries of a cell and keeps k of each."""

    def __init__(self, rows: list, mean_length: float, k: int, most_pairs: int = 1_000_000, most_cells: int = 2_000_000):
        self.ids, self.mean_length, self.k, self.most_pairs, self.most_cells = [q for q, _ in rows], mean_length, k, most_pairs, most_cells
        self.terms: dict[bytes, int] = {}
        of = np.array([self.terms.setdefault(t, len(self.terms)) for _, (terms, _) in rows for t in terms], np.int64)
        order = np.argsort(of, kind="stable")
        self.at = np.repeat(np.arange(len(rows)), [len(x) for _, (x, _) in rows])[order]
        self.weight = np.concatenate([x for _, (_, x) in rows])[order]
        self.start = np.searchsorted(of[order], np.arange(len(self.terms) + 1))
        self.held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        #: The score below which a document isn't among the k best of a query.
        self.least = np.zeros(len(rows))

    def add(self, docs: np.ndarray, texts: list[bytes]):
        terms, start, pending, pairs, first = self.terms, self.start.tolist(), [], 0, 0
        for i, t in enumerate(texts):
            words = t.split()
            counts = Counter(w for w in words if w in terms)
            pending.append((len(words), [(terms[w], c) for w, c in counts.items()]))
            pairs += sum(start[x + 1] - start[x] for x, _ in pending[-1][1])
            if pairs > self.most_pairs or len(pending) * len(self.ids) > self.most_cells or i == len(texts) - 1:
                hits = np.array([(d, x, c) for d, (_, found) in enumerate(pending) for x, c in found], np.int64).reshape(-1, 3)
                new = self._scores(docs[first : i + 1], np.array([n for n, _ in pending], float), *hits.T)
                self._keep(*(np.concatenate(x) for x in zip(self.held, new, strict=True)))
                pending, pairs, first = [], 0, i + 1

    def _scores(self, docs, lengths, doc, term, tf):
        part = tf / (tf + K1 * (1 - B + B * lengths[doc] / self.mean_length))
        start, n = self.start, len(self.ids)
        count = start[term + 1] - start[term]
        take = np.repeat(start[term], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        total = np.bincount(np.repeat(doc, count) * n + self.at[take], np.repeat(part, count) * self.weight[take], len(docs) * n)
        total = np.round(total, 6).reshape(len(docs), n)
        doc, query = np.nonzero((total > 0) & (total >= self.least))
        return query, docs[doc], total[doc, query]

    def _keep(self, query, doc, score):
        """The k best of each query, ties to the smaller document."""
        order = np.lexsort((doc, -score, query))
        query, doc, score = query[order], doc[order], score[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query, "left")
        self.held = tuple(x[nth < self.k] for x in (query, doc, score))
        self.least[query[nth == self.k - 1]] = score[nth == self.k - 1]

    def out(self):
        import pyarrow as pa

        query, doc, score = self.held
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()).take(pa.array(query)), pa.array(doc), pa.array(score)], names=["query_id", "doc_id", "score"])


def cosine_top_k(vectors_: DataFrame, k: int = 5, every: int = 100, same_label: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank of the rows whose vec_id is divisible by every against all others, best by cosine; the filter on
    labels, if any, comes before the ranking. Blocks of queries meet blocks of vectors, and each leaves k rows of a query."""
    found = blocks.best(vectors_.where(F.col("vec_id") % every == 0), vectors_, blocks.cosines, k, "label" if same_label else None)
    return top(found.select("query_id", "vec_id", F.round("score", 6).alias("score")), "query_id", [F.desc("score"), F.col("vec_id")], k)


def l2_top_k(vectors_: DataFrame, k: int = 5, every: int = 100, same_label: bool = True) -> DataFrame:
    """Best by 1 / (1 + squared distance); the filter comes after the ranking, so fewer than k may be left."""
    found = blocks.best(vectors_.where(F.col("vec_id") % every == 0), vectors_, blocks.closeness, k)
    best = top(found.select("query_id", "vec_id", F.round("score", 6).alias("score")), "query_id", [F.desc("score"), F.col("vec_id")], k)
    if same_label:
        of = vectors_.select("vec_id", "label")
        best = best.join(of, "vec_id").join(of.toDF("query_id", "query_label"), "query_id").where("label = query_label")
    return best.select("query_id", "vec_id", "score", "rank")


def fused(semantic: DataFrame, keyword: DataFrame, weights: tuple[float, float] = (0.7, 0.3), k: int = 5) -> DataFrame:
    """query_id, text, score, rank. Scores of each side are divided by the query's largest; sides meet on equal text, a missing one counts 0."""

    def scaled(df, name):
        most = F.max("score").over(Window.partitionBy("query_id"))
        return df.select("query_id", "text", F.coalesce(F.try_divide(F.col("score").cast("double"), most.cast("double")), F.lit(0.0)).alias(name))

    both = scaled(semantic, "s").join(scaled(keyword, "w"), ["query_id", "text"], "full_outer")
    score = weights[0] * F.coalesce("s", F.lit(0.0)) + weights[1] * F.coalesce("w", F.lit(0.0))
    return top(both.select("query_id", "text", F.round(score, 6).alias("score")), "query_id", [F.desc("score"), F.col("text")], k)


def ranked_sources(sources: DataFrame, now: str, decay: float = 365.0) -> DataFrame:
    """sources(similarity, authority, dated, verified, ...) with score: .40 similarity, .25 authority, .20 recency, .15 verified (unverified .8)."""
    days = F.datediff(F.lit(now).cast("date"), text.parsed_date(F.col("dated")))
    recency = F.coalesce(F.exp(-days / decay), F.lit(0.5))
    score = 0.40 * F.col("similarity").cast("double") + 0.25 * F.col("authority").cast("double") + 0.20 * recency + 0.15 * F.when(F.col("verified"), 1.0).otherwise(0.8)
    return sources.withColumn("score", F.round(score, 4))


def boosted(results: DataFrame, mentions: DataFrame, boost: float = 0.05) -> DataFrame:
    """results(query_id, doc_id, text, score) raised by boost for each of the query's entities (query_id, entity) that the text contains."""
    hits = results.join(mentions, "query_id").where(F.lower("text").contains(F.lower("entity"))).groupBy("query_id", "doc_id").agg(F.countDistinct("entity").alias("n"))
    return results.join(hits, ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.round(F.col("score").cast("double") + boost * F.coalesce("n", F.lit(0)), 6).alias("score"))


def keyword_classes(docs: DataFrame, rules: DataFrame, most: int = 10_000) -> DataFrame:
    """doc_id, category, confidence. rules(category, place, keyword), most at most: the share of a category's keywords in the text, doubled, 1 at
    most; ties to the smaller place; no hit gives other at 0.1, empty text other at 0."""
    held = rules.select("category", "place", F.lower("keyword").alias("keyword")).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError(f"more than {most} rules")
    of = Counter((r.category, r.place) for r in held)
    known = F.array(*[F.struct(F.lit(r.category).alias("category"), F.lit(r.place).alias("place"), F.lit(1.0 / of[r.category, r.place]).alias("share"), F.lit(r.keyword).alias("keyword")) for r in held])
    low = F.lower(F.coalesce("text", F.lit("")))
    hits = docs.select("doc_id", F.inline(F.filter(known, lambda k: low.contains(k["keyword"])))).groupBy("doc_id", "category", "place").agg(F.sum("share").alias("share"))
    best = hits.groupBy("doc_id").agg(F.max_by(F.struct("category", "share"), F.struct(F.round("share", 9).alias("s"), -F.col("place"))).alias("b"))
    empty = F.length(F.trim(F.coalesce("text", F.lit("")))) == 0
    return docs.join(best, "doc_id", "left").select("doc_id", F.coalesce("b.category", F.lit("other")).alias("category"), F.when(empty, 0.0).otherwise(F.coalesce(F.least(F.round(2 * F.col("b.share"), 6), F.lit(1.0)), F.lit(0.1))).alias("confidence"))


def ivf_top_k(vectors_: DataFrame, k: int = 5, every: int = 100, cells: int = 100, recall: float = 0.95, sample: int = 1000, trials: int = 64) -> DataFrame:
    """query_id, vec_id, score, rank by cosine, approximately: an inverted file of cells whose centres are fitted to sample vectors by a hash
    of the id (a documented bound); every vector is indexed. Vectors of one length, the sample's most common, take part.

    How many cells a query looks into is the least number that finds recall of the nearest neighbours among the sample for trials of its
    vectors. Queries meet the blocks of their cells alone.
    """
    slim = vectors_.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    drawn = slim.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    if not drawn:
        return vectors_.sparkSession.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    dim = Counter(len(r.embedding) for r in drawn).most_common(1)[0][0]
    x = np.array([r.embedding for r in drawn if len(r.embedding) == dim])
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    centres = _centres(x, min(cells, len(x)))
    probes = _probes(x, centres, k, recall, trials)

    def celled(batches, most: int):
        import pandas as pd

        for batch in batches:
            some = batch[batch["embedding"].map(len) == dim]
            if len(some):
                near = np.argsort(-(np.stack(some["embedding"].to_numpy()) @ centres.T), axis=1, kind="stable")[:, :most]
                yield pd.DataFrame({"vec_id": np.repeat(some["vec_id"].to_numpy(), near.shape[1]), "embedding": some["embedding"].to_numpy().repeat(near.shape[1]), "cell": near.ravel()})

    schema = "vec_id long, embedding array<double>, cell int"
    index = slim.mapInPandas(lambda b: celled(b, 1), schema)
    asked = slim.where(F.col("vec_id") % every == 0).mapInPandas(lambda b: celled(b, probes), schema)
    found = blocks.best(asked, index, blocks.cosines, k, "cell")
    return top(found.groupBy("query_id", "vec_id").agg(F.round(F.max("score"), 6).alias("score")), "query_id", [F.desc("score"), F.col("vec_id")], k)


def _centres(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Unit centres by spherical k-means, from the first rows on."""
    centres = x[:cells].copy()
    for _ in range(rounds):
        of = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def _probes(x: np.ndarray, centres: np.ndarray, k: int, recall: float, trials: int) -> int:
    """The least number of cells in which that share of the k nearest rows lies, over some rows of the sample."""
    ask = x[:trials]
    score = ask @ x.T
    np.fill_diagonal(score, -np.inf)
    best = np.argsort(-score, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(ask @ centres.T), axis=1), axis=1)
    at = np.sort(np.take_along_axis(place, (x @ centres.T).argmax(axis=1)[best], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(recall * len(at))) - 1)]) + 1


def key_sentences(docs: DataFrame, keywords: list[str], k: int = 10) -> DataFrame:
    """doc_id, sentence, score, rank: sentences of 20 to 300 characters; .15 per keyword, .1 for a date, an amount, a place among
    the first three or last two of all sentences, .05 for an honorific; .15 at least, 1 at most."""
    parts = docs.select("doc_id", F.split("text", r"(?<=[.!?])\s+").alias("all")).select("doc_id", F.size("all").alias("of"), F.posexplode("all").alias("place", "sentence"))
    parts = parts.withColumn("sentence", F.regexp_replace("sentence", r"^\s+|\s+$", "")).where(F.length("sentence").between(20, 300))
    low = F.lower("sentence")
    score = sum((F.when(low.contains(w), 0.15).otherwise(0.0) for w in keywords), F.lit(0.0))
    edge = (F.col("place") < 3) | (F.col("place") >= F.col("of") - 2)
    for hit, worth in ((F.col("sentence").rlike(text.NUMERIC_DATE), 0.1), (F.col("sentence").rlike(text.AMOUNT), 0.1), (F.col("sentence").rlike(text.HONORIFIC), 0.05), (edge, 0.1)):
        score = score + F.when(hit, worth).otherwise(0.0)
    return top(parts.withColumn("score", F.round(F.least(score, F.lit(1.0)), 4)).where("score >= 0.15"), "doc_id", [F.desc("score"), F.col("place")], k).drop("place", "of")
