"""The bounded sample of labelled documents that the classifiers are fitted to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import among, cut, held_out

#: Documents in a sample, and bytes of each that are used (a window that its id picks), so that the driver holds 48 MB at most.
DOCUMENTS, BYTES = 3000, 16_384


def labelled(docs: DataFrame, labels: DataFrame, label: str, documents: int = DOCUMENTS, bytes_: int = BYTES) -> list[tuple[bytes, int]]:
    """(text, label) of documents whose crc32 remainder isn't the held-out one, in order of a hash of the id.

    A longer text gives a window of bytes_ characters at a place that the hash picks, so that beginnings aren't preferred.
    """
    some = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1)").where(~held_out("doc_id"))
    some = some.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents)
    some = cut(some, "labels")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    start = F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.greatest(F.length(text) - bytes_, F.lit(0)) + 1) + 1
    picked = among(docs.withColumn("doc_id", F.col("doc_id").cast("long")), some.select("doc_id"), "doc_id")
    picked = picked.select("doc_id", F.substring(text, start.cast("int"), F.lit(bytes_)).alias("text")).dropDuplicates(["doc_id"]).join(F.broadcast(some), "doc_id")
    rows = picked.orderBy(F.xxhash64("doc_id"), "doc_id").select("text", "label").collect()
    return [(r.text.encode(), r.label) for r in rows]
