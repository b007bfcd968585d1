"""Scores and rollups: readiness, verification, severities, reviews, timelines, consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values
PENALTY = {"MINOR": 3.0, "MODERATE": 8.0, "MAJOR": 15.0}
LEVELS = ((90.0, "READY_FOR_REVIEW"), (75.0, "MOSTLY_READY"), (60.0, "NEEDS_ATTENTION"), (40.0, "SIGNIFICANT_ISSUES"))
SURE = {"direct": 0.95, "ocr": 0.70, "regex": 0.75, "ner": 0.80, "llm": 0.65, "manual": 0.99}
PARTIES = ("plaintiff", "defendant", "judge", "advocate")


def level(score, levels=LEVELS, rest: str = "NOT_READY") -> Column:
    out = F.lit(rest)
    for bound, name in reversed(levels):
        out = F.when(score >= bound, name).otherwise(out)
    return out


def readiness(cases: DataFrame) -> DataFrame:
    """cases(case_id, completeness, consistency, confidence in per cent) with readiness (.4/.3/.3) and its level."""
    score = F.round(0.4 * F.col("completeness") + 0.3 * F.col("consistency") + 0.3 * F.col("confidence"), 1)
    return cases.withColumn("readiness", score).withColumn("level", level(F.col("readiness")))


def consistency(issues: DataFrame) -> DataFrame:
    """case_id, consistency: 100 less 3, 8 or 15 for each minor, moderate or major issue (8 for others), 0 at least."""
    cost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PENALTY.items() for x in kv]), F.upper("severity")), F.lit(PENALTY["MODERATE"]))
    return issues.groupBy("case_id").agg((100.0 - F.least(F.lit(100.0), F.sum(cost))).alias("consistency"))


def verification(steps: DataFrame) -> DataFrame:
    """document_id, fraud_score, badge, confidence, passed, failed, warnings from steps(document_id, status, confidence).

    .6 of the failed share, .2 of the warned, .2 of what the mean confidence lacks, over steps that weren't skipped (none: .5).
    """
    done = F.col("status") != "SKIPPED"
    n, failed, warned = F.count_if(done), F.count_if(F.col("status") == "FAILED"), F.count_if(F.col("status") == "WARNING")
    mean = F.avg(F.when(done, F.col("confidence").cast("double")))
    sums = steps.groupBy("document_id").agg(n.alias("n"), failed.alias("failed"), warned.alias("warnings"), F.count_if(F.col("status") == "PASSED").alias("passed"), mean.alias("mean"))
    raw = 0.6 * F.col("failed") / F.col("n") + 0.2 * F.col("warnings") / F.col("n") + 0.2 * (1 - F.col("mean"))
    scored = sums.withColumn("fraud_score", F.when(F.col("n") == 0, 0.5).otherwise(F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 4)))
    badge = F.when((F.col("failed") > 0) | (F.col("fraud_score") > 0.5), "RED").when((F.col("warnings") > 0) | (F.col("fraud_score") > 0.2), "YELLOW").otherwise("GREEN")
    return scored.select("document_id", "fraud_score", badge.alias("badge"), F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("confidence"), "passed", "failed", "warnings")


def rank_weighted(rows: DataFrame, by: str, value: str, tie: str, k: int = 5) -> DataFrame:
    """by, confidence: the k largest values, weighted by 1 / rank."""
    ranked = rows.where(F.col(value).isNotNull()).withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(value), tie))).where(F.col("r") <= k)
    return ranked.groupBy(by).agg(F.round(F.sum(F.col(value) / F.col("r")) / F.sum(1 / F.col("r")), 6).alias("confidence"))


def severity_report(issues: DataFrame) -> DataFrame:
    """case_id, major, moderate, minor, status: counts by severity; the worst decides."""
    c = lambda s: F.count_if(F.upper("severity") == s)
    sums = issues.groupBy("case_id").agg(c("MAJOR").alias("major"), c("MODERATE").alias("moderate"), c("MINOR").alias("minor"))
    return sums.withColumn("status", F.when(F.col("major") > 0, "MAJOR_ISSUES").when(F.col("moderate") > 0, "REVIEW_REQUIRED").when(F.col("minor") > 0, "MINOR_VARIATIONS").otherwise("CONSISTENT"))


def field_confidence(fields: DataFrame) -> DataFrame:
    """case_id, confidence: the mean confidence in per cent of fields(case_id, value, confidence) with a value, 0 without one."""
    return fields.groupBy("case_id").agg(F.round(F.coalesce(F.avg(F.when(F.col("value").isNotNull(), F.col("confidence").cast("double") * 100)), F.lit(0.0)), 4).alias("confidence"))


def metadata_confidence(fields: DataFrame) -> DataFrame:
    """document_id, field, score of fields(document_id, field, value, method, pattern, seen, agreeing): .4 of the method's confidence, .3 of the share of
    agreeing sightings, .3 of how the value fits its pattern (wholly 1, in part .7, not .2); 0.5 stands for what isn't known."""
    method = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SURE.items() for x in kv]), F.lower("method")), F.lit(0.5))
    fit = F.expr("case when pattern is null then 0.5 when value rlike concat('^(?:', pattern, ')$') then 1.0 when value rlike pattern then 0.7 else 0.2 end")
    agree = F.coalesce(F.try_divide("agreeing", "seen"), F.lit(0.5))
    return fields.where("value <> '' and not startswith(field, '_')").select("document_id", "field", F.round(0.4 * method + 0.3 * agree + 0.3 * fit, 3).alias("score"))


def recommendation(cases: DataFrame) -> DataFrame:
    """case_id, recommendation of cases(case_id, readiness, completeness, consistency, confidence, missing, major): what the score allows, and what to do."""
    # fixed values: the sentences
    status = F.when(F.col("readiness") >= 90, "Ready for human/authorized review").when(F.col("readiness") >= 75, "Minor issues to address before review").when(F.col("readiness") >= 60, "Several issues need attention").otherwise("Significant work required before submission")
    todo = F.concat_ws(
        " ",
        F.when((F.col("completeness") < 100) & (F.coalesce("missing", F.lit("")) != ""), F.concat(F.lit("Missing required documents: "), "missing")),
        F.when((F.col("consistency") < 80) & (F.col("major") > 0), F.concat(F.lit("Found "), F.col("major").cast("string"), F.lit(" major inconsistencies requiring resolution"))),
        F.when(F.col("confidence") < 70, "Multiple fields have low confidence - manual verification recommended"),
    )
    return cases.select("case_id", F.when(todo == "", status).otherwise(F.concat(status, F.lit(". "), todo)).alias("recommendation"))


def decision(cases: DataFrame) -> DataFrame:
    """case_id, decision of cases(case_id, readiness, issues, complete): approved for review from 90 with nothing missing or inconsistent,
    conditional from 75, correction from 60, else rejected."""
    score = F.col("readiness")
    return cases.select("case_id", F.when((score >= 90) & (F.col("issues") == 0) & F.col("complete"), "APPROVED_FOR_REVIEW").when(score >= 75, "CONDITIONAL_APPROVAL").when(score >= 60, "REQUIRES_CORRECTION").otherwise("REJECTED").alias("decision"))


def parties(fields: DataFrame, least: float = 0.7) -> DataFrame:
    """case_id, party, names of fields(case_id, field, value, confidence) surer than least whose names hold a party's, in that order."""
    party = F.lit(None).cast("string")
    for p in reversed(PARTIES):
        party = F.when(F.lower("field").contains(p), p).otherwise(party)
    rows = fields.where((F.col("confidence") > least) & (F.col("value") != "")).withColumn("party", party).where("party is not null")
    return rows.groupBy("case_id", "party").agg(F.array_join(F.sort_array(F.collect_set("value")), "; ").alias("names"))


def identity_status(fields: DataFrame, names: tuple[str, ...] = ("full_name", "date_of_birth", "address", "document_number")) -> DataFrame:
    """case_id, status of the identity documents' fields(case_id, field, value): NEEDS_REVIEW as soon as a field has two values, equal or not."""
    n = fields.where(F.col("field").isin(*names)).groupBy("case_id", "field").agg(F.count("*").alias("n"))
    return fields.select("case_id").distinct().join(n.groupBy("case_id").agg(F.max("n").alias("n")), "case_id", "left").select("case_id", F.when(F.coalesce("n", F.lit(0)) > 1, "NEEDS_REVIEW").otherwise("VERIFIED").alias("status"))


def notary_checklist(cases: DataFrame) -> DataFrame:
    """case_id, item, good, ready of cases(case_id, deponent, complete, consistent, major): four items each; ready without regard to the first."""
    items = F.array(*[F.struct(F.lit(name).alias("item"), good.alias("good")) for name, good in (
        ("Deponent name verified", F.coalesce(F.col("deponent") != "", F.lit(False))), ("Supporting documents complete", F.col("complete")),
        ("Identity information consistent", F.col("consistent")), ("No major inconsistencies", F.col("major") == 0))])
    ready = F.col("complete") & F.col("consistent") & (F.col("major") == 0)
    return cases.select("case_id", ready.alias("ready"), F.inline(items)).select("case_id", "item", "good", "ready")


def locker_status(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """document_id, confidence, status, duplicate_of of docs(document_id, digest, ocr_confidence, class_confidence): the mean of both, verified from
    least; duplicate_of is the first document of an equal digest."""
    first = docs.groupBy("digest").agg(F.min("document_id").alias("first"))
    both = docs.join(first, "digest").withColumn("c", F.round((F.col("ocr_confidence") + F.col("class_confidence")) / 2, 4))
    return both.select("document_id", F.col("c").alias("confidence"), F.when(F.col("c") >= least, "verified").otherwise("pending").alias("status"), F.when(F.col("first") != F.col("document_id"), F.col("first")).alias("duplicate_of"))


def text_source(mime, text, ocr_text) -> Column:
    """A struct of text and confidence: of images the OCR's; of PDFs their own (.85) unless under 100 characters, then the OCR's (.7); of DOCX files .90;
    nothing counts 0."""
    own, ocr = F.coalesce(text, F.lit("")), F.coalesce(ocr_text, F.lit(""))
    some = lambda t, c: F.when(F.trim(t) == "", 0.0).otherwise(c)
    scanned = mime.startswith("image/") | ((mime == "application/pdf") & (F.length(F.trim(own)) < 100))
    return F.struct(F.when(scanned, ocr).otherwise(own).alias("text"), F.when(scanned, some(ocr, 0.7)).when(mime == "application/pdf", some(own, 0.85)).otherwise(some(own, 0.90)).alias("confidence"))


def review_queue(items: DataFrame) -> DataFrame:
    """Items under full confidence with a priority: under .70 HIGH, under .90 MEDIUM, else LOW; place is the order by priority, time and id."""
    priority = F.when(F.col("confidence") < 0.7, 0).when(F.col("confidence") < 0.9, 1).otherwise(2)
    queued = items.where("confidence < 1.0").withColumn("p", priority)
    return queued.withColumn("priority", F.element_at(F.array(F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")), F.col("p") + 1)).orderBy("p", "created_at", "item_id").drop("p")


def timeline_span(events: DataFrame, by: str, ts: str) -> DataFrame:
    """by, n_events, first, last, days: null days for fewer than two events."""
    sums = events.groupBy(by).agg(F.count(ts).alias("n_events"), F.min(F.col(ts).cast("date")).alias("first"), F.max(F.col(ts).cast("date")).alias("last"))
    return sums.withColumn("days", F.when(F.col("n_events") >= 2, F.datediff("last", "first")))


def agreed(fields: DataFrame, least: float = 0.7) -> DataFrame:
    """case_id, field, n_values, consistent: distinct values with more than least confidence; one is consistent."""
    return fields.where(F.col("confidence") > least).groupBy("case_id", "field").agg(F.countDistinct("value").alias("n_values")).withColumn("consistent", F.col("n_values") == 1)


def risk(cases: DataFrame) -> DataFrame:
    """cases(conflicts, duplicates, ...) with risk: .15 and .05 each, 1 at most."""
    return cases.withColumn("risk", F.round(F.least(F.lit(1.0), 0.15 * F.col("conflicts") + 0.05 * F.col("duplicates")), 4))


def duplicate_label(cosine) -> Column:
    """EXACT from .98, LIKELY from .90, else POSSIBLE; null for a null cosine."""
    return F.when(cosine >= 0.98, "EXACT").when(cosine >= 0.9, "LIKELY").when(cosine.isNotNull(), "POSSIBLE")


def consents(records: DataFrame) -> DataFrame:
    """user_id, type, granted from records(user_id, type, action, decided, record_id): the last record of a user's type decides, ties to the larger record_id. An aggregate, so no history is held."""
    last = records.groupBy("user_id", "type").agg(F.max_by("action", F.struct("decided", "record_id")).alias("last"))
    return last.select("user_id", "type", F.coalesce(F.col("last") == "grant", F.lit(False)).alias("granted"))
