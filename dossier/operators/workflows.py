"""Workflows as rows: which kinds of documents a case needs, checked for all cases in one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "workflow string, name string, kind string, required boolean, place int"
#: Up to so many workflows (some MB) are broadcast; more are joined by shuffle.
BROADCAST = 10_000
# fixed values
DEFAULTS = {
    "GOVERNMENT_APPLICATION": ("Government Application Verification", ("Application", "Identity Proof", "Address Proof"), ("Certificate", "Affidavit")),
    "COURT_CASE": ("Court Case Bundle", ("Court Document", "Affidavit", "Identity Proof"), ("Address Proof", "Certificate")),
    "NOTARY_VERIFICATION": ("Notary/Affidavit Verification", ("Affidavit", "Identity Proof", "Address Proof"), ("Certificate",)),
    "CONTRACT_EXECUTION": ("Contract Execution", ("Contract", "Identity Proof"), ("Address Proof", "Affidavit")),
    "FINANCIAL_TRANSACTION": ("Financial Transaction Verification", ("Invoice", "Identity Proof", "Address Proof"), ("Receipt", "Contract")),
}


def rules(spark: SparkSession, workflows: dict[str, tuple[str, tuple, tuple]] | None = None) -> DataFrame:
    """RULES of workflows: id to (name, required kinds, optional kinds)."""
    rows = [(w, name, kind, i < len(need), i) for w, (name, need, more) in (DEFAULTS if workflows is None else workflows).items() for i, kind in enumerate([*need, *more])]
    return spark.createDataFrame(rows, RULES)


def with_workflow(held: DataFrame, new: DataFrame) -> DataFrame:
    """held rules with new ones; a workflow that is in both becomes the new one."""
    return held.join(new.select("workflow").distinct(), "workflow", "left_anti").select(*new.columns).unionByName(new)


def save(held: DataFrame, path: str) -> None:
    held.write.mode("overwrite").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULES).json(path)


def listed(held: DataFrame) -> DataFrame:
    """workflow, name, required_count, optional_count."""
    n = lambda c: F.count_if(c).cast("long")
    return held.groupBy("workflow").agg(F.min("name").alias("name"), n(F.col("required")).alias("required_count"), n(~F.col("required")).alias("optional_count"))


def checked(cases: DataFrame, held: DataFrame) -> DataFrame:
    """case_id, workflow, name, status, message, completeness, total_required, present_required, missing, checklist for each case and workflow of
    cases(case_id, workflow, kind), a row for each document (kind null for a case without any).

    Kinds are compared trimmed and capitalised. A case's kinds are kept only as far as rules name them, so a case with very many documents stays
    small. An unknown workflow has the status ERROR.
    """
    kinds = lambda needed: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("place", "kind", "required")), lambda r: r["required"] == needed)), lambda r: r["kind"])
    known = held.groupBy("workflow").agg(F.min("name").alias("name"), kinds(True).alias("need"), kinds(False).alias("more"))
    known = F.broadcast(known) if held.select("workflow").distinct().count() <= BROADCAST else known
    named = held.select("kind").distinct().withColumn("ruled", F.lit(True))
    rows = cases.select("case_id", "workflow", F.initcap(F.trim("kind")).alias("kind")).distinct().join(named, "kind", "left")
    have = rows.groupBy("case_id", "workflow").agg(F.collect_set(F.when(F.col("ruled"), F.col("kind"))).alias("have"))
    both = have.join(known, "workflow", "left")
    bad, missing = F.col("need").isNull(), F.filter("need", lambda k: ~F.array_contains("have", k))
    need, left = F.size("need"), F.size(missing)
    line = lambda column, lacking: F.transform(column, lambda k: F.concat(F.lit("\n  "), F.when(F.array_contains("have", k), "✓").otherwise(lacking), F.lit(" "), k))
    text = F.concat(F.lit("DOCUMENT CHECKLIST\n" + "=" * 50 + "\n\nRequired Documents:"), F.array_join(line("need", "✗"), ""), F.lit("\n\nOptional Documents:"), F.array_join(line("more", "○"), ""))
    message = F.when(bad, F.concat(F.lit("Unknown workflow: "), "workflow")).when(left > 0, F.concat(F.lit("APPLICATION INCOMPLETE — Missing: "), F.array_join(missing, ", "))).otherwise("APPLICATION COMPLETE — All required documents present")
    zero = lambda c: F.when(bad, F.lit(0)).otherwise(c).cast("long")
    return both.select(
        "case_id", "workflow", "name", F.when(bad, "ERROR").when(left > 0, "INCOMPLETE").otherwise("COMPLETE").alias("status"), message.alias("message"),
        F.coalesce(F.when(~bad & (need > 0), F.round(100.0 * (need - left) / need, 1)), F.lit(0.0)).alias("completeness"),
        zero(need).alias("total_required"), zero(need - left).alias("present_required"), F.when(bad, "").otherwise(F.array_join(missing, ", ")).alias("missing"),
        F.when(bad, "ERROR: Workflow configuration not found").otherwise(text).alias("checklist"),
    )
