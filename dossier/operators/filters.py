"""Filters and predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: patterns of hostile input, file types by their first bytes, extensions that are refused
HOSTILE = (
    r"\b(UNION|SELECT|INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|EXEC|EXECUTE)\b.*\b(FROM|INTO|TABLE|SET|WHERE)\b",
    r"\.\./|\.\.\\|%2e%2e",
    r"<script[^>]*>",
    r"javascript:",
    r"on(error|load|click|mouseover|focus|blur)\s*=",
    r"<iframe",
    r"<object",
    r"<embed",
)
DANGEROUS = ("exe", "bat", "cmd", "ps1", "sh", "vbs", "js", "msi", "dll", "com", "scr", "pif", "hta")
MAGIC = {"pdf": "25504446", "jpg": "FFD8FF", "png": "89504E47", "docx": "504B0304"}
MOST_BYTES = 50 * 1024 * 1024


def hostile(value) -> Column:
    return F.coalesce(value.rlike("(?i)" + "|".join(HOSTILE)), F.lit(False))


def file_type(content) -> Column:
    """The type that a file's first bytes name; null for others."""
    out = F.lit(None).cast("string")
    for name, magic in MAGIC.items():
        out = F.when(F.startswith(F.hex(F.substring(content, 1, 4)), F.lit(magic)), name).otherwise(out)
    return out


def file_errors(name, content) -> Column:
    """Errors joined by '; ', '' for a valid file: too large, empty, a dangerous extension; a type that isn't known only if nothing else is
    wrong."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    errors = F.concat_ws("; ", F.when(F.octet_length(content) > MOST_BYTES, "too large"), F.when(F.octet_length(content) == 0, "empty"), F.when(ext.isin(*DANGEROUS), "dangerous extension"))
    return F.when((errors == "") & file_type(content).isNull(), "unrecognized type").otherwise(errors)


def listed(docs: DataFrame, equals: dict | None = None, order: str = "doc_id", limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows with all the given values, newest first; paging is the caller's."""
    for column, value in (equals or {}).items():
        if value is not None:
            docs = docs.where(F.col(column) == value)
    docs = docs.orderBy(F.desc(order))
    return docs.offset(offset).limit(limit) if limit is not None else docs


def searched(docs: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows one of whose columns contains the query, in any case."""
    some = F.lit(False)
    for c in columns:
        some = some | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False))
    return docs.where(some)


def metadata_filter(rows: DataFrame, wanted: dict, column: str = "metadata") -> DataFrame:
    """date_range: inclusive text comparison that rows without a date pass; document_types: one of them; other lists: one of them; else
    equality, which a missing key fails. column is a map or a struct; a key with dots goes down into structs."""
    for key, value in wanted.items():
        if key == "date_range":
            at = F.try_element_at(column, F.lit("date"))
            rows = rows.where(at.isNull() | (at == "") | at.between(*value))
        elif "." in key:
            rows = rows.where(F.coalesce(F.col(f"{column}.{key}") == value, F.lit(False)))
        elif key == "document_types":
            rows = rows.where(F.coalesce(F.try_element_at(column, F.lit("document_type")).isin(value), F.lit(False)))
        else:
            at = F.try_element_at(column, F.lit(key))
            rows = rows.where(at.isin(value) if isinstance(value, list) else at == value)
    return rows


def unexpired(rows: DataFrame, now: str, seconds: int = 1800, created: str = "created_at") -> DataFrame:
    """Rows of a staging table that are at most seconds old."""
    return rows.where(F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp(F.col(created).cast("timestamp")) <= seconds)


def permitted(users: DataFrame, grants: DataFrame) -> DataFrame:
    """users(user_id, role, permission) with allowed: the role holds the permission."""
    held = grants.select("role", "permission").distinct().withColumn("allowed", F.lit(True))
    return users.join(held, ["role", "permission"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def absent(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Insert-if-absent: the new rows whose key doesn't exist."""
    return new.join(existing.select(key).distinct(), key, "left_anti")
