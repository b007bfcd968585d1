"""Tables in the folder that all machines share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch between Spark and Python. Spark's default of 64 MB lets long texts and packed blocks fill both sides.
BATCH_BYTES = 2 << 20


def lean(spark: SparkSession) -> SparkSession:
    """The session, with Arrow batches of BATCH_BYTES at most; operators whose functions get whole texts or packed blocks call it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key)).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or the one that is set; one of its own only in local mode, as machines don't share theirs."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="dossier-"))
    return context.getCheckpointDir()


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder."""
    path = f"{checkpoint_dir(df.sparkSession)}/dossier-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as shuffles have, if it lies in fewer: only small tables do, so few rows move. df is read from files or is cheap."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
