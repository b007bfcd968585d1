"""Readers and stores: text and DOCX files, snapshots, exports."""

from __future__ import annotations

import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

KINDS = {"txt": "text", "md": "text", "pdf": "pdf", "docx": "docx", "png": "image", "jpg": "image", "jpeg": "image"}


def kind_of(name) -> Column:
    """The reader of a file by its extension; null for unsupported ones."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1)))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """name, text of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("name"), F.col("value").alias("text"))


def _paragraphs(content: bytes) -> str | None:
    try:
        xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode()
    except (zipfile.BadZipFile, KeyError, UnicodeDecodeError):
        return None
    parts = ("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S))
    text = "\n\n".join(p for p in parts if p.strip())
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = text.replace(entity, sign)
    return text


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """name, text of DOCX files: paragraphs joined by blank lines; null for broken files."""

    @F.pandas_udf(StringType())
    def parsed(contents: pd.Series) -> pd.Series:
        return contents.map(_paragraphs)

    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("name"), parsed("content").alias("text"))


def assembled_lines(words: DataFrame) -> DataFrame:
    """doc_id, text, confidence of OCR words(doc_id, block, par, line, place, word, conf): words with a confidence over 0, a blank line between paragraphs."""
    some = words.where("conf > 0")
    lines = some.groupBy("doc_id", "block", "par", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda w: w["word"]), " ").alias("t"))
    pars = lines.groupBy("doc_id", "block", "par").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("t"))
    texts = pars.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "par", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
    return texts.join(some.groupBy("doc_id").agg(F.round(F.avg("conf") / 100, 4).alias("confidence")), "doc_id")


def save_snapshot(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace the snapshot at path; by are its partition columns."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def export_events(rows: DataFrame) -> DataFrame:
    """A security log's fields, with the fingerprint cut to 16 characters."""
    return rows.select(F.col("ts").alias("@timestamp"), F.col("event_type").alias("event.action"), F.col("user_id").cast("string").alias("user.id"), F.substring(F.sha2(F.coalesce("props", F.lit("")), 256), 1, 16).alias("event.hash"))
