"""Exact dedup by skew-safe combining: copies meet within a task, then within a salted digest group, then once more over the salts.

Each of the three stages groups by the digest and by the whole text, so equal digests alone join nothing. A hot text leaves one row
per task in the first stage and one per salt in the second. Texts whose digest occurs once never travel.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean

#: Groups that the copies of a digest are dealt to before the last stage.
SALTS = 16
#: A digest with a share of 1 / HOT of all rows is hot; so HOT digests (under 100 KB) are broadcast at most.
HOT = 1000
#: Digests up to this many (about 20 MB) are broadcast to pick the texts to compare; more are joined by shuffle.
BROADCAST_DIGESTS = 200_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def combined(texts: DataFrame, salts: int = SALTS) -> DataFrame:
    """digest, text, keep_id, n of texts(doc_id, digest, text): the largest id and the number of rows of each text."""
    salted = texts.withColumn("salt", F.spark_partition_id() % salts)
    # Spark groups within each task before it shuffles: the local stage; what is left of a text is one row per task
    merged = salted.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
    return merged.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def exact_duplicates(docs: DataFrame, fingerprint: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of docs(doc_id, text, ...): doc_id, keep_id, group_size, kept, text_sha256.

    Rows with equal texts are a group, and its largest doc_id stays: keep_id. Null texts count as empty, and empty texts are equal to
    each other. A null id is below all others; a group without any id keeps all its rows (keep_id null), as none can be named. Rows that
    repeat an id and a text count one each in group_size and stay or go together; rows that repeat an id with other texts are judged
    each by its own. Other columns are ignored. An empty table gives no rows. fingerprint only deals texts to groups: texts that share
    one are told apart by their content.
    """
    lean(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("digest", fingerprint(F.col("text")))
    rows = cut(slim.select("doc_id", "digest", sha256(F.col("text")).alias("sha")), "digests")
    often = cut(rows.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1"), "often")
    hot = often.where(F.col("n") * HOT >= rows.count()).select("digest")
    cold = often.where(F.col("n") * HOT < rows.count()).select("digest")
    few = often.count() <= BROADCAST_DIGESTS
    copies = slim.join(F.broadcast(hot), "digest", "left_semi")
    copies = copies.unionByName(slim.join(F.broadcast(hot), "digest", "left_anti").join(F.broadcast(cold) if few else cold, "digest", "left_semi"))
    groups = cut(combined(copies, salts).select("digest", "keep_id", F.col("n").alias("group_size")), "groups")
    shared = groups.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")
    shared = None if shared.isEmpty() else cut(shared, "shared")
    if shared is not None:
        rows, groups = rows.join(shared, "digest", "left_anti"), groups.join(shared, "digest", "left_anti")
    # a hot digest's rows meet its group where they lie; no other digest has many
    large = rows.join(F.broadcast(groups.join(F.broadcast(hot), "digest", "left_semi")), "digest")
    small = rows.join(F.broadcast(hot), "digest", "left_anti").join(groups, "digest", "left")
    one = F.col("group_size").isNull()
    small = small.select("digest", "doc_id", "sha", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"))
    out = large.unionByName(small)
    if shared is not None:
        # texts that share a digest: rows meet their group by content
        both = slim.join(shared, "digest", "left_semi")
        named = combined(both, salts).withColumnRenamed("n", "group_size")
        out = out.unionByName(both.withColumn("sha", sha256(F.col("text"))).join(named, ["digest", "text"]).drop("text"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
