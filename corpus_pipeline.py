"""A training-data pipeline over the documents table; each stage works on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm import minhash, mixing, packing, secrets, toxicity
from dossier.llm.common import among, dropped, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject, as they are. Null and empty texts are scored as texts without words; rows without an id
    and repeated rows are judged each by its text; columns besides doc_id and text don't matter. An empty table gives no rows."""
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.3)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8): the one with the smallest id. Rows that repeat a doc_id with the same
    text are one document and stay together; with other texts they are documents of their own, behind all others in a group. Texts without
    words and rows without an id stay. An empty table gives no rows."""
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    # ids with several texts get another id for each, above all that there are
    several = docs.groupBy("doc_id").agg(F.min(text).alias("lo"), F.max(text).alias("hi")).where("doc_id is not null and lo <> hi").select("doc_id")
    if several.isEmpty():
        return _first_of_groups(docs)
    most = docs.agg(F.max("doc_id")).first()[0]
    shared = [c for c in docs.columns if c != "doc_id"]
    apart = among(docs, several, "doc_id").select(F.struct("doc_id", *shared).alias("row"), "text", (F.lit(most) + 1 + F.pmod(F.xxhash64("doc_id", "text"), F.lit((2**63 - 2 - max(0, most)) // 2))).alias("doc_id"))
    rest = among(docs, several, "doc_id", "left_anti").select(F.struct("doc_id", *shared).alias("row"), "text", "doc_id")
    return _first_of_groups(rest.unionByName(apart)).select("row.*").select(docs.columns)


def _first_of_groups(docs: DataFrame) -> DataFrame:
    found = minhash.near_duplicates(docs, k=5, percent=80)
    return among(docs, found.where("not kept").select("doc_id").distinct(), "doc_id", "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted again. Null and empty texts stay as they are, repeated rows too."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents as often as they are taken, twice at most. Null is a source of its own; texts without words weigh nothing and are
    not taken; repeated rows and rows without an id are sampled each by itself. An empty table gives no rows."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of permitted lengths: a row per piece. Texts without words have none; repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack_sequences)]

#: SQL can't express the classifier, the balanced sample and the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; between them the rows lie as Parquet in the shared folder, until the next stage's are written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/dossier-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            dropped(before)
        docs = before = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
