"""Shared pieces: lineage cuts in the shared folder, partition counts, connected components."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import BATCH_BYTES, lean  # noqa: F401  used by the operators

#: The driver's contract: labels may be learned only from documents with another remainder.
HELD_OUT_REMAINDER = 2


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where none is set, one of its own in local mode (tests); machines don't share theirs."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="dossier-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def dropped(*tables: DataFrame) -> None:
    """Remove tables that cut has written, once nothing reads them any more."""
    for table in tables:
        for path in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, lost executors don't matter."""
    spark = lean(df.sparkSession)
    path = f"{shared_dir(spark)}/dossier-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == HELD_OUT_REMAINDER


def components(edges: DataFrame, left: str = "src", right: str = "dst") -> DataFrame:
    """(node, component) for every node of an undirected edge list; component is the smallest node reachable.

    Minimum labels with pointer jumping; each round is written to the shared folder. Labels fall along paths
    and jump through their own labels, so the rounds grow with the logarithm of a chain's length. Null ends
    and self-loops are dropped; no edges give no rows.
    """
    both = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a is not null and b is not null and a <> b")
    both = cut(both.unionAll(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", "component", F.least("component", "near").alias("low"))
        to = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        jumped = lower.join(to, lower.low == to["at"]).select("node", F.least("low", "further").alias("component"), (F.least("low", "further") < F.col("component")).alias("moved"))
        before, jumped = labels, cut(jumped, "labels")
        labels = jumped.select("node", "component")
        done = jumped.where("moved").isEmpty()
        dropped(before, *[both] * done)
        if done:
            return labels


#: Ids up to this many (16 MB) are broadcast to filter wide rows; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def among(df: DataFrame, ids: DataFrame, key: str | list[str], how: str = "left_semi") -> DataFrame:
    """The rows of df whose key is among ids, which has the key's columns (left_anti: is not); wide rows stay in place while ids are few."""
    ids = cut(ids, "ids")
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, key, how)


def fmix64(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the public splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fmix32(h: np.ndarray) -> np.ndarray:
    """A bijective mixer of 32-bit words (the public murmur3 finaliser): a permutation of [0, 2**32)."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


#: An odd base for polynomial hashes modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo 2**64, kept between calls and not to be written to."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(1 << max(0, n - 1).bit_length(), np.uint64(base), dtype=np.uint64)
        out[0] = 1
        _POWERS[base] = np.multiply.accumulate(out)
    return _POWERS[base][:n]


def utf8(texts) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in texts.cast(pa.large_binary()).to_pylist()]


def pieces(batch, size: int = 1 << 20, column: str = "text", sizes=None):
    """Slices of an Arrow batch that hold about size bytes of text each (or of what sizes says), so that temporary arrays stay small."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    sizes = pc.binary_length(batch.column(column)) if sizes is None else sizes
    ends = np.cumsum(sizes.fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + size)))
        yield batch.slice(start, stop - start)
        start = stop


def ceil_div(a: int, b: int) -> int:
    return max(1, math.ceil(a / b))
