"""Comparisons across documents: near copies by vectors, inconsistent and contradictory fields, graded differences, shared parties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, fuzzy
from ..functions import text as T
from ..functions.tables import written
from . import graph, joins

# fixed values
COMPARABLE = (
    "full_name", "applicant_name", "holder_name", "deponent_name", "person_name", "date_of_birth", "dob", "address", "applicant_address", "deponent_address",
    "document_number", "application_number", "certificate_number", "contact_number", "phone", "mobile", "email", "father_name", "mother_name",
)
HIGH_STAKES = ("full_name", "date_of_birth", "id_number", "address", "applicant_name", "holder_name", "deponent_name")
ABSENT = ("not found", "n/a", "none")
CONFLICT_FIELDS = ("date_of_birth", "address", "father_name", "serial_number")
NEWER_BY = ("issue_date", "valid_from", "effective_date", "date")


def grade(cosine) -> Column:
    """A struct of label and confidence of a pair's cosine: from .98, .90, .80 and below."""
    label = F.when(cosine >= 0.98, "EXACT_DUPLICATE").when(cosine >= 0.90, "LIKELY_DUPLICATE").otherwise("POSSIBLE_DUPLICATE")
    sure = F.when(cosine >= 0.98, "VERY_HIGH").when(cosine >= 0.90, "HIGH").when(cosine >= 0.80, "MEDIUM").otherwise("LOW")
    return F.struct(label.alias("label"), sure.alias("confidence"))


def similar_vectors(vectors: DataFrame, threshold: float = 0.90, by: str | None = None) -> DataFrame:
    """a, b, similarity, label, confidence: pairs a < b of vectors(vec_id, embedding, ...), within equal values of by if given, with a
    cosine of threshold or more. Null vectors take no part, zero ones have cosine 0. Blocks of vectors are compared, not rows."""
    near = blocks.alike(vectors, threshold, by).withColumn("similarity", F.round("similarity", 6))
    return near.select("a", "b", "similarity", F.inline(F.array(grade(F.col("similarity")))))


def similar_classes(vectors: DataFrame, threshold: float = 0.90, by: str | None = None) -> DataFrame:
    """vec_id, n_links, class of each of vectors: how many vectors are similar, and the smallest one that is reached over such links (itself, without
    any). No pairs are made, so groups of thousands of copies do."""
    found = written(blocks.alike_links(vectors, threshold, by), "links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    reached = graph.components(found.select(F.col("vec_id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "vec_id")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    both = ids.join(counts, "vec_id", "left").join(reached, "vec_id", "left")
    return both.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("class"))


def canonical(field, strict: bool = False) -> Column:
    """The comparable name of a field; null for others.

    As underscores become spaces before names are looked for, only one-word variants count ('email address' is an address);
    strict looks for the whole names instead.
    """
    low = F.trim(F.replace(F.lower(field), F.lit("_"), F.lit(" ")))
    out = F.when(field.isin(*COMPARABLE), field)
    if strict:
        low = F.replace(low, F.lit(" "), F.lit("_"))
        groups = {"name": "^(full|applicant|holder|deponent|person|party_a|party_b)_name$", "dob": "^(date_of_birth|birth_date|dob)$", "address": "^((applicant|deponent|party_a|party_b|seller|buyer)_)?address$", "phone": "^(contact_number|phone|mobile|telephone)$", "email": "^email(_address)?$"}
    else:
        groups = {"dob": "dob", "address": "address", "phone": "phone|mobile|telephone", "email": "email"}
    for name, pattern in reversed(groups.items()):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def _pairs(values: DataFrame) -> DataFrame:
    """case_id, field, a, b, n_a, n_b, doc_a, doc_b, similarity of the distinct values of a case's field, any case: an instance pair
    of equal values differs in nothing, so values stand for their instances, whose numbers are kept."""
    held = values.groupBy("case_id", "field", F.lower("value").alias("v")).agg(F.count("*").alias("n"), F.min("document_id").alias("doc"))
    x, y = held.toDF("case_id", "field", "a", "n_a", "doc_a"), held.toDF("case_id", "field", "b", "n_b", "doc_b")
    both = x.join(y, ["case_id", "field"]).where("a < b")
    return both.withColumn("similarity", fuzzy.indel_ratio("a", "b"))


def inconsistencies(fields: DataFrame, strict: bool = False) -> DataFrame:
    """case_id, field, a, b, n_a, n_b, doc_a, doc_b, similarity, severity: values of fields(case_id, document_id, field, value) that differ
    within a case; from 90 MINOR, from 75 MODERATE, else MAJOR. Blank values don't count."""
    some = fields.select("case_id", "document_id", canonical(F.col("field"), strict).alias("field"), F.trim("value").alias("value")).where("field is not null and value <> ''")
    severity = F.when(F.col("similarity") >= 90, "MINOR").when(F.col("similarity") >= 75, "MODERATE").otherwise("MAJOR")
    return _pairs(some).where("similarity < 100").withColumn("severity", severity)


def contradictions(fields: DataFrame) -> DataFrame:
    """case_id, field, a, b, n_a, n_b, doc_a, doc_b, similarity, high_stakes, severity: values under 95 alike; from 80 MINOR, from 60
    MODERATE (MAJOR for a high-stakes field), else MAJOR. Fields by their alias; values that say that there is none don't count."""
    some = fields.select("case_id", "document_id", T.alias(F.col("field")).alias("field"), F.trim("value").alias("value")).where("field <> '' and value <> ''").where(~F.lower("value").isin(*ABSENT))
    stakes = F.col("field").isin(*HIGH_STAKES)
    severity = F.when(F.col("similarity") >= 80, "MINOR").when((F.col("similarity") >= 60) & ~stakes, "MODERATE").otherwise("MAJOR")
    return _pairs(some).where("similarity < 95").withColumn("high_stakes", stakes).withColumn("severity", severity)


def comparison_report(cases: DataFrame, found: DataFrame) -> DataFrame:
    """case_id, total, major, moderate, minor, status for each of cases(case_id), instances counted."""
    n = F.col("n_a") * F.col("n_b")
    of = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, n)), F.lit(0))
    sums = cases.select("case_id").distinct().join(found.select("case_id", "severity", "n_a", "n_b"), "case_id", "left").groupBy("case_id").agg(of("MAJOR").alias("major"), of("MODERATE").alias("moderate"), of("MINOR").alias("minor"))
    status = F.when(F.col("major") > 0, "MAJOR_ISSUES").when(F.col("moderate") > 0, "REVIEW_REQUIRED").when(F.col("minor") > 0, "MINOR_VARIATIONS").otherwise("CONSISTENT")
    return sums.select("case_id", (F.col("major") + F.col("moderate") + F.col("minor")).alias("total"), "major", "moderate", "minor", status.alias("status"))


def graded_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """pair_id, field, value_a, value_b, similarity, status of fields(pair_id, field, value): MATCH from .95, NEAR_MATCH from .75, MISMATCH,
    or ONLY_IN_A, ONLY_IN_B. Fields in snake case; null, empty and absent values don't count; of repeated fields the largest value."""
    held = lambda df, name: df.where("value is not null and value not in ('', 'Not found', 'N/A')").groupBy("pair_id", F.replace(F.lower("field"), F.lit(" "), F.lit("_")).alias("field")).agg(F.max("value").alias(name))
    both = held(before, "value_a").join(held(after, "value_b"), ["pair_id", "field"], "full_outer")
    alike = F.when(F.col("value_a").isNull() | F.col("value_b").isNull(), 0.0).otherwise(fuzzy.indel_ratio(F.lower("value_a"), F.lower("value_b")) / 100)
    both = both.withColumn("similarity", alike)
    status = F.when(F.col("value_a").isNull(), "ONLY_IN_B").when(F.col("value_b").isNull(), "ONLY_IN_A").when(F.col("similarity") >= 0.95, "MATCH").when(F.col("similarity") >= 0.75, "NEAR_MATCH").otherwise("MISMATCH")
    return both.select("pair_id", "field", "value_a", "value_b", F.round("similarity", 3).alias("similarity"), status.alias("status"))


def verdicts(diff: DataFrame, content: DataFrame) -> DataFrame:
    """pair_id, field_similarity, mismatches, verdict of graded_diff's rows and content(pair_id, content_similarity)."""
    sums = diff.groupBy("pair_id").agg(F.avg("similarity").alias("mean"), F.count_if(F.col("status") == "MISMATCH").alias("mismatches")).join(content, "pair_id", "left")
    verdict = F.when((F.col("mean") >= 0.90) & (F.coalesce("content_similarity", F.lit(0.0)) >= 0.85), "NEAR_IDENTICAL").when(F.col("mismatches") > 3, "SIGNIFICANT_DIFFERENCES").when(F.col("mismatches") > 0, "MINOR_DIFFERENCES").otherwise("CONSISTENT")
    return sums.select("pair_id", F.round("mean", 4).alias("field_similarity"), "mismatches", verdict.alias("verdict"))


def change_summary(diff: DataFrame) -> DataFrame:
    """The summary line of joins.field_diff's rows: how many fields were added, removed and modified."""
    n = lambda c: F.count_if(F.col("change") == c)
    sums = diff.agg(n("ADDED").alias("added"), n("REMOVED").alias("removed"), n("MODIFIED").alias("modified"))
    parts = F.concat_ws(", ", *[F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(f" field(s) {c}"))) for c in ("added", "removed", "modified")])
    return sums.select("added", "removed", "modified", F.when(parts == "", "No changes detected").otherwise(parts).alias("summary"))


def version_number(value) -> Column:
    """The first number of a version text."""
    return F.regexp_extract(F.coalesce(value, F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def superseded(pairs: DataFrame, fields: DataFrame, floor: float = 0.70) -> DataFrame:
    """pair_id, newer, likely_versions, supersedes of pairs(pair_id, a, b, type_a, type_b, content_similarity) with fields(document_id, field,
    value): the later of the first date field that both have, else the larger version number; null where neither decides."""
    day = lambda c: F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)) for f in ("dd-MM-yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy")])
    wanted = [*NEWER_BY, "version", "revision"]
    held = fields.where(F.col("field").isin(wanted)).groupBy("document_id").agg(F.map_from_entries(F.collect_set(F.struct("field", "value"))).alias("f"))
    both = pairs.join(held.toDF("a", "fa"), "a", "left").join(held.toDF("b", "fb"), "b", "left")
    at = lambda side, name: F.try_element_at(side, F.lit(name))
    newer = F.lit(None).cast("string")
    version = lambda side: version_number(F.coalesce(at(side, "version"), at(side, "revision")))
    newer = F.when(version("fa").isNotNull() & version("fb").isNotNull(), F.when(version("fa") > version("fb"), F.col("a")).otherwise(F.col("b")))
    for name in reversed(NEWER_BY):
        p, q = day(at("fa", name)), day(at("fb", name))
        newer = F.when(p.isNotNull() & q.isNotNull(), F.when(p > q, F.col("a")).otherwise(F.col("b"))).otherwise(newer)
    likely = F.col("type_a").eqNullSafe(F.col("type_b")) & (F.coalesce("content_similarity", F.lit(0.0)) >= floor)
    return both.select("pair_id", newer.alias("newer"), likely.alias("likely_versions"), F.when(likely, newer).alias("supersedes"))


def linked_names(names: DataFrame, threshold: float = 80.0) -> DataFrame:
    """name_a, name_b, score of distinct lower-case names(name): equal ones pair with themselves at 100, similar ones by fuzzy_pairs."""
    low = names.select(F.lower("name").alias("name")).where("name is not null").distinct()
    near = joins.fuzzy_pairs(low, threshold)
    both = near.select(F.col("a").alias("name_a"), F.col("b").alias("name_b"), "score")
    return both.unionAll(both.select("name_b", "name_a", "score")).unionAll(low.select("name", "name", F.lit(100.0)))


def entity_links(entities: DataFrame, threshold: float = 80.0) -> DataFrame:
    """doc_a, doc_b, type, name_a, name_b, score, match of entities(document_id, type, name): names of one type in two documents, doc_a <
    doc_b, that are threshold alike. Names meet by their distinct values; only linked documents are paired."""
    held = entities.select("document_id", "type", F.lower("name").alias("name")).where("name is not null").distinct()
    out = None
    alike = linked_names(held, threshold)
    x = held.toDF("doc_a", "type", "name_a").join(alike, "name_a")
    out = x.join(held.toDF("doc_b", "type", "name_b"), ["type", "name_b"]).where("doc_a < doc_b")
    return out.select("doc_a", "doc_b", "type", "name_a", "name_b", F.round("score", 4).alias("score"), F.when(F.col("score") == 100, "exact").otherwise("fuzzy").alias("match"))


def related_documents(people: DataFrame, case_numbers: DataFrame) -> DataFrame:
    """doc_a, doc_b, relation, confidence, shared: same_case (.95) for a shared case number in upper case; else shared_party for two or more of
    doc_a's people with a match in doc_b (.6 and .1 each, .95 at most)."""
    held = case_numbers.select("document_id", F.upper("value").alias("n")).distinct()
    same = held.toDF("doc_a", "n").join(held.toDF("doc_b", "n"), "n").where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.count("*").alias("shared"))
    party = entity_links(people.withColumn("type", F.lit("person"))).groupBy("doc_a", "doc_b").agg(F.countDistinct("name_a").alias("shared")).where("shared >= 2").join(same, ["doc_a", "doc_b"], "left_anti")
    return same.select("doc_a", "doc_b", F.lit("same_case").alias("relation"), F.lit(0.95).alias("confidence"), "shared").unionAll(party.select("doc_a", "doc_b", F.lit("shared_party"), F.round(F.least(0.6 + F.col("shared") * 0.1, F.lit(0.95)), 4), "shared"))


def duplicate_identities(people: DataFrame, threshold: float = 80.0) -> DataFrame:
    """name_a, name_b, confidence, match, documents of people(document_id, name): a name in two documents or more (.95), and similar names
    whose documents aren't the same."""
    held = people.select("document_id", F.lower(F.trim("name")).alias("name")).where("name is not null").distinct()
    where = held.groupBy("name").agg(F.sort_array(F.collect_set("document_id")).alias("docs"))
    exact = where.where(F.size("docs") >= 2).select(F.col("name").alias("name_a"), F.col("name").alias("name_b"), F.lit(0.95).alias("confidence"), F.lit("exact").alias("match"), F.size("docs").alias("documents"))
    near = joins.fuzzy_pairs(held.select("name"), threshold).where("score < 100")
    both = near.join(where.toDF("a", "docs_a"), "a").join(where.toDF("b", "docs_b"), "b").where("docs_a <> docs_b")
    return exact.unionAll(both.select("a", "b", F.round(F.col("score") / 100, 4), F.lit("fuzzy"), F.size(F.array_union("docs_a", "docs_b"))))


def merge_candidates(vertices: DataFrame, threshold: float = 80.0) -> DataFrame:
    """a, b, score, recommendation of similar but unequal names among vertices(name): merge from 90, else review."""
    near = joins.fuzzy_pairs(vertices.select(F.lower("name").alias("name")), threshold).where("score < 100")
    return near.select("a", "b", F.round(F.col("score") / 100, 4).alias("score"), F.when(F.col("score") >= 90, "merge").otherwise("review").alias("recommendation"))


def metadata_conflicts(people: DataFrame, metadata: DataFrame, fields: tuple[str, ...] = CONFLICT_FIELDS) -> DataFrame:
    """doc_a, doc_b, field, value_a, value_b: documents that share a person's exact lower-case name and differ in a field of
    metadata(document_id, field, value); blank values don't count."""
    held = people.select("document_id", F.lower("name").alias("name")).distinct()
    pairs = held.toDF("doc_a", "name").join(held.toDF("doc_b", "name"), "name").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
    some = metadata.where(F.col("field").isin(*fields)).where("value <> ''")
    both = pairs.join(some.toDF("doc_a", "field", "value_a"), "doc_a").join(some.toDF("doc_b", "field", "value_b"), ["doc_b", "field"])
    return both.where("value_a <> value_b").select("doc_a", "doc_b", "field", "value_a", "value_b")
