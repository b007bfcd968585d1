"""The queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Register a function (t, spark) -> DataFrame under its name; t reads a table by name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name), spark)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rows(t, spark: SparkSession, sql: str) -> DataFrame:
    """The rows of SQL that reads tables by their plain names, as DuckDB does, through t."""
    names = {m[1] for m in re.finditer(r"(?:FROM|JOIN) (customer|orders|lineitem|supplier|part|nation|region|events|documents)\b", sql)}
    if not names:
        return spark.sql(sql)
    named = re.sub(r"(FROM|JOIN) (" + "|".join(sorted(names)) + r")\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(named, **{n: t(n) for n in names})


def duck(sql: str) -> str:
    """Literal rows as DuckDB writes their types."""
    return sql.replace("STRING", "VARCHAR")
