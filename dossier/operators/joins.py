"""Joins by meaning: duplicates, shared and conflicting values, requirements, evidence, mentions, fuzzy names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fuzzy


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, digest, first_id, copies: texts with one SHA-256 (null: empty); the group is counted before it meets its members."""
    hashed = docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    group = hashed.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))
    return hashed.join(group, "digest").select("doc_id", "digest", "first_id", "copies")


def hamming_pairs(hashes: DataFrame, most: int = 8) -> DataFrame:
    """a, b, distance of 64-bit hashes(id, hash) that differ in most bits at most.

    Of most + 1 bands of the bits (most is under 64) one must be equal, so the bands block the pairs without loss. Equal hashes meet once,
    as their smallest ids; a copy pairs with its group's smallest id.
    """
    groups = hashes.where("id is not null and hash is not null").groupBy("hash").agg(F.min("id").alias("id"))
    cuts = [i * 64 // (most + 1) for i in range(most + 2)]
    bands = F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned(F.shiftleft("hash", 64 - b), 64 - b + a).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])
    cut = groups.select("id", "hash", F.inline(bands))
    x, y = cut.toDF("a", "ha", "band", "value"), cut.toDF("b", "hb", "band", "value")
    near = x.join(y, ["band", "value"]).where("a < b").select("a", "b", F.bit_count(F.col("ha").bitwiseXOR(F.col("hb"))).alias("distance")).where(F.col("distance") <= most).distinct()
    copies = hashes.join(groups.withColumnRenamed("id", "a"), "hash").where("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("distance"))
    return near.unionByName(copies)


def fuzzy_pairs(names: DataFrame, threshold: float = 80.0) -> DataFrame:
    """a, b, score of distinct names with an indel similarity of threshold or more.

    Exact blocking: similar names share most of their characters, so in a fixed order of characters their prefixes share one
    (counted characters, each with its number). Rare ones come first, so that prefixes hold few names in common, and a key's
    names meet by length: each is dealt to all lengths that it can be similar to. The similarity itself is computed on
    candidates alone.
    """
    plain = names.select(F.col("name")).where("name is not null").distinct().withColumn("n", F.length("name"))
    chars = plain.where("n > 0").select("name", "n", F.explode(F.filter(F.split("name", ""), lambda c: c != "")).alias("c")).groupBy("name", "n", "c").agg(F.count("*").alias("times"))
    keyed = chars.select("name", "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("times").cast("int")), lambda i: F.concat("c", F.lit("#"), i.cast("string")))).alias("key"))
    ranked = keyed.join(keyed.groupBy("key").agg(F.count("*").alias("names")), "key").groupBy("name", "n").agg(F.array_sort(F.collect_list(F.struct("names", "key"))).alias("keys"))
    need = F.ceil(F.col("n") * threshold / (200 - threshold) - F.lit(1e-9))
    prefix = ranked.select("name", "n", F.explode(F.slice("keys.key", 1, (F.col("n") - need + 1).cast("int"))).alias("key"))
    # the shorter of two names goes to the lengths up to the longest that fits it
    longest = F.floor(F.col("n") * (200 - threshold) / threshold + F.lit(1e-9))
    x = prefix.select(F.col("name").alias("s"), F.col("n").alias("ns"), "key", F.explode(F.sequence(F.col("n").cast("long"), longest)).alias("length"))
    y = prefix.select(F.col("name").alias("l"), F.col("n").cast("long").alias("length"), "key")
    pairs = x.join(y, ["key", "length"]).where("ns < length or s < l").select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"))
    return pairs.distinct().withColumn("score", fuzzy.indel_ratio("a", "b")).where(F.col("score") >= threshold)


def shared_values(fields: DataFrame) -> DataFrame:
    """value, docs: values (trimmed, lower case, two characters or more) that occur in more than one document."""
    value = F.lower(F.trim(F.col("value").cast("string")))
    return fields.select(value.alias("value"), "doc_id").where("length(value) >= 2").groupBy("value").agg(F.countDistinct("doc_id").alias("docs")).where("docs > 1")


def conflicts(fields: DataFrame) -> DataFrame:
    """entity, field, distinct values: fields of an entity on which its rows disagree (trimmed, any case; nulls apart)."""
    value = F.lower(F.trim(F.col("value").cast("string")))
    return fields.where("value is not null").groupBy("entity", "field").agg(F.countDistinct(value).alias("n_values"), F.count("*").alias("n_rows")).where("n_values > 1")


def field_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """field, change: ADDED, REMOVED, MODIFIED or SAME, of two versions (field, value)."""
    a, b = before.select("field", F.col("value").alias("old"), F.lit(1).alias("in_a")), after.select("field", F.col("value").alias("new"), F.lit(1).alias("in_b"))
    change = F.when(F.col("in_a").isNull(), "ADDED").when(F.col("in_b").isNull(), "REMOVED").when(F.col("old").eqNullSafe(F.col("new")), "SAME").otherwise("MODIFIED")
    return a.join(b, "field", "full_outer").select("field", "old", "new", change.alias("change"))


def missing_requirements(present: DataFrame, required: list[str]) -> DataFrame:
    """case_id, n_missing, missing (in order, joined), completeness in per cent: required kinds that present(case_id, kind) lacks."""
    have = present.groupBy("case_id").agg(F.collect_set(F.when(F.col("kind").isin(required), F.col("kind"))).alias("have"))
    need = F.array(*map(F.lit, sorted(required)))
    left = F.array_except(need, "have")
    return have.select("case_id", F.size(left).cast("long").alias("n_missing"), F.array_join(left, ",").alias("missing"), F.round(F.lit(100.0) * (len(required) - F.size(left)) / max(1, len(required)), 1).alias("completeness"))


def evidence(values: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, value, chunk, confidence: the first chunk that contains the value in any case (1.0), else the first chunk (0.5)."""
    both = values.join(chunks, "doc_id")
    at = F.lower("text").contains(F.lower("value"))
    order = Window.partitionBy("doc_id", "value").orderBy(at.desc(), "chunk")
    return both.withColumn("hit", at).withColumn("nth", F.row_number().over(order)).where("nth = 1").select("doc_id", "value", "chunk", F.when(F.col("hit"), 1.0).otherwise(0.5).alias("confidence"))


#: A dictionary of up to so many names is an expression; a larger one is held in automata of so many names at a time.
FEW, MANY = 1000, 100_000


def mentions(docs: DataFrame, names: DataFrame, few: int = FEW, many: int = MANY) -> DataFrame:
    """doc_id, name: names of a dictionary that a text contains, in any case, each once per document. Null texts contain none. doc_id may be of any type.

    Texts are read where they lie: a small dictionary is a filtered array in the plan; of a larger one each task holds an automaton of many
    names at most, and the texts are read once for each such part.
    """
    known = names.select("name").where("name <> ''").distinct()
    low = F.lower(F.col("text"))
    first = known.limit(few + 1).collect()
    if len(first) <= few:
        if not first:
            return docs.select("doc_id", F.lit("").alias("name")).limit(0)
        held = F.array(*[F.struct(F.lit(r.name).alias("name"), F.lower(F.lit(r.name)).alias("low")) for r in first])
        return docs.select("doc_id", F.explode(F.filter(held, lambda n: low.contains(n["low"]))).alias("n")).select("doc_id", "n.name").distinct()
    parts = -(-known.count() // many)
    dealt = known.withColumn("low", F.lower("name")).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts)))
    slim, out = docs.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("text")), None
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name string"
    for i in range(parts):
        part = slim.mapInArrow(_spotter([(r.low, r.name) for r in dealt.where(F.col("part") == i).select("low", "name").collect()]), schema)
        out = part if out is None else out.unionAll(part)
    return out.distinct()


def _spotter(names: list[tuple[str, str]]):
    """The function that finds names in the texts of a partition."""

    def spotted(batches):
        import ahocorasick
        import pyarrow as pa

        words = ahocorasick.Automaton()
        for low, name in names:
            words.add_word(low, [*words.get(low, []), name])
        words.make_automaton()
        for batch in batches:
            ids, found = [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                hits = sorted({n for _, held in words.iter(t) for n in held})
                ids += [i] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(found, pa.string())], names=["doc_id", "name"])

    return spotted


def named_in(queries: DataFrame, names: DataFrame) -> DataFrame:
    """query_id, id of names(id, name) that a short text of queries(query_id, query) contains, in any case. All parts of the queries up to the
    longest name meet the names by equality, so the dictionary may have any size."""
    known = names.where("name <> ''").select("id", F.lower("name").alias("low"))
    longest = known.agg(F.max(F.length("low"))).first()[0] or 0
    low = F.lower(F.coalesce("query", F.lit("")))
    ends = F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1))), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(max(1, longest)), F.greatest(F.length(low) - i + 1, F.lit(1)))), lambda n: F.substring(low, i, n)))
    parts = queries.select("query_id", F.explode(F.array_distinct(F.flatten(ends))).alias("low"))
    return parts.join(known, "low").select("query_id", "id").distinct()


def children(parents: DataFrame, rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """Parents with their ordered child rows as an array of structs; an empty array where there is none."""
    kids = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias("rows"))
    return parents.join(kids, key, "left").withColumn("rows", F.coalesce("rows", F.array().cast(kids.schema["rows"].dataType)))
