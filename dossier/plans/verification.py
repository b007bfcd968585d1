"""Verification, readiness and reviews."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import checks, scores
from ..registry import duck, query, rows

REQUESTS = """SELECT * FROM (VALUES
('r1', 'Government of India. Passport of the Republic of India, number K1234567, issued by the passport officer on 01/02/2020. Signature of the holder is here.', 'passport', 0.9, 'K1234567', 'https://example.org/v', 'abcdef'),
('r2', 'Birth certificate: registration no: BR778, registrar of the municipal office, signed on 3-4-2021 and hereby certified', 'birth_certificate', CAST(NULL AS DOUBLE), 'ZZ', 'garbled', ''),
('r3', 'short', 'other', 0.4, '', '', ''),
('r4', 'Driving licence MH12 20190001234 of the transport office, class LMV, vehicle MH-01-AB-1234, ref: QX12345', 'driving_licence', 0.6, '', '', 'ff'),
('r5', 'Survey no: 12/3 of the land revenue department; owner: Asha Rao; khata and patta attached. Civil suit pending.', 'unknown', 0.5, '', '', ''),
('r6', 'Stamp paper serial no: MH001234, date of issue: 1/1/2024, treasury: Nashik, Rs. 500, non-judicial', '', 0.5, 'MH001234', '', '77'),
('r7', 'CBSE marksheet, roll no: 123456, degree of the state board', 'education certificate', 0.8, '', '', ''),
('r8', 'Court order, appeal dismissed, CERT-20241 of the driving school DS/12345, authority', 'court_order', 0.8, '', '', ''),
('r9', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING))) AS t(document_id, text, document_type, class_confidence, serial_number, qr_data, file_hash)"""


#: The serial pattern with word ends of any script, as Spark and Python have them.
_SERIAL = checks.SERIAL.replace("(?i)\\b", "(?i)(?:^|[^\\pL\\pN_])").replace("\\b", "(?:$|[^\\pL\\pN_])")


def _some(words, low: str = "low") -> str:
    return "(" + " OR ".join(f"contains({low}, '{w}')" for w in words) + ")"


def _tally(words) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(low, '{w}') THEN 1 ELSE 0 END" for w in words) + ")"


_DEPARTMENT = "coalesce(CASE lower(document_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in checks.DEPARTMENTS.items()) + " END, CASE " + " ".join(f"WHEN {_some(words)} THEN '{name}'" for name, words in checks.WORDS.items()) + " ELSE 'general' END)"


def _registry(name: str, rule: checks.Rule) -> str:
    hit = f"regexp_matches(t, '{rule.pattern}')" if rule.pattern else _some(rule.words)
    cases = [(hit, "PASSED", rule.passed)]
    if rule.weak:
        cases.append((_some(rule.fallback), *rule.weak))
    if rule.rest:
        cases.append(("true", *rule.rest))
    status = "CASE " + " ".join(f"WHEN {c} THEN '{s}'" for c, s, _ in cases) + " END"
    sure = "CASE " + " ".join(f"WHEN {c} THEN {x}" for c, _, x in cases) + " END"
    only = f" AND {_some(rule.only_if)}" if rule.only_if else ""
    where = f"department = '{name}'" if name != checks.OTHER else f"department IN ('{name}', 'general')"
    return f"SELECT document_id, department, 8 AS step_order, '[Registry] {rule.name}' AS step_name, {status} AS status, {sure}::DOUBLE AS confidence FROM d WHERE {where}{only}"


def _step(n: int, name: str, status: str, sure: str) -> str:
    return f"SELECT document_id, department, {n} AS step_order, '{name}' AS step_name, {status} AS status, ({sure})::DOUBLE AS confidence FROM d"


_GENERAL = [
    _step(1, "Document Upload Validation", "CASE WHEN full_ THEN 'PASSED' ELSE 'FAILED' END", "CASE WHEN full_ THEN 0.95 ELSE 0.1 END"),
    _step(2, "OCR Quality Assessment", "CASE WHEN words >= 10 AND share > 0.6 THEN 'PASSED' WHEN words >= 5 THEN 'WARNING' ELSE 'FAILED' END", "CASE WHEN words >= 10 AND share > 0.6 THEN least(share, 0.95) WHEN words >= 5 THEN share * 0.7 ELSE 0.1 END"),
    _step(3, "AI Classification Verification", "CASE WHEN kind NOT IN ('', 'other') THEN 'PASSED' ELSE 'WARNING' END", "CASE WHEN kind NOT IN ('', 'other') THEN greatest(coalesce(class_confidence, 0.5), 0.7) ELSE 0.3 END"),
    _step(4, "Serial Number Verification", f"CASE WHEN serial <> '' AND contains(t, serial) THEN 'PASSED' WHEN regexp_matches(t, '{_SERIAL}') THEN 'WARNING' ELSE 'SKIPPED' END", f"CASE WHEN serial <> '' AND contains(t, serial) THEN 0.9 WHEN regexp_matches(t, '{_SERIAL}') THEN 0.6 ELSE 0 END"),
    _step(5, "QR Code Verification", "CASE WHEN qr = '' THEN 'SKIPPED' WHEN contains(lower(qr), 'http') OR regexp_matches(qr, '[a-f0-9-]{36}') THEN 'PASSED' ELSE 'WARNING' END", "CASE WHEN qr = '' THEN 0 WHEN contains(lower(qr), 'http') OR regexp_matches(qr, '[a-f0-9-]{36}') THEN 0.85 ELSE 0.5 END"),
    _step(6, "Template Structure Verification", "CASE WHEN template >= 0.5 THEN 'PASSED' WHEN template >= 0.2 THEN 'WARNING' ELSE 'FAILED' END", "template"),
    _step(7, "Issuing Authority Verification", "CASE WHEN heads > 0 THEN 'PASSED' ELSE 'WARNING' END", "CASE WHEN heads > 0 THEN least(0.5 + heads * 0.1, 0.95) ELSE 0.2 END"),
    _step(9, "Ongoing Case Check", f"CASE WHEN {_some(checks.CASES)} THEN 'WARNING' ELSE 'PASSED' END", f"CASE WHEN {_some(checks.CASES)} THEN 0.6 ELSE 0.8 END"),
    _step(10, "Duplicate Document Check", "CASE WHEN hash <> '' THEN 'PASSED' ELSE 'SKIPPED' END", "CASE WHEN hash <> '' THEN 0.9 ELSE 0 END"),
]
_ALL = _GENERAL + [_registry(name, r) for name, rules in checks.REGISTRIES.items() for r in rules]
_STEPS = rf"""q AS ({duck(REQUESTS)} UNION ALL SELECT 'd' || doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'passport' ELSE 'other' END, 0.8, '', '', sha256(coalesce(text, '')) FROM documents),
c AS (SELECT *, coalesce(text, '') AS t, lower(coalesce(text, '')) AS low, coalesce(document_type, '') AS kind, coalesce(serial_number, '') AS serial, coalesce(qr_data, '') AS qr, coalesce(file_hash, '') AS hash FROM q),
d AS (SELECT *, {_DEPARTMENT.replace('document_type', 'kind')} AS department, length(regexp_replace(t, '^\s+|\s+$', '', 'g')) > 20 AS full_, len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) AS words, length(regexp_replace(t, '[^\p{{L}}\s]', '', 'g')) / greatest(length(t), 1) AS share,
  least({_tally(checks.MARKERS)} * 0.15 + CASE WHEN regexp_matches(t, '{checks.DAY}') THEN 0.2 ELSE 0 END + CASE WHEN {_some(checks.SIGNATURES)} THEN 0.2 ELSE 0 END, 1)::DOUBLE AS template, {_tally(checks.AUTHORITIES)} AS heads FROM c),
s AS (SELECT * FROM ({' UNION ALL '.join(_ALL)}) WHERE status IS NOT NULL)"""


def _requests(t, spark):
    docs = t("documents").select(F.concat(F.lit("d"), "doc_id"), "text", F.when(F.col("doc_id") % 3 == 0, "passport").otherwise("other"), F.lit(0.8), F.lit(""), F.lit(""), F.sha2(F.coalesce("text", F.lit("")), 256))
    return spark.sql(REQUESTS).withColumn("class_confidence", F.col("class_confidence").cast("double")).unionAll(docs)


@query(f"WITH {_STEPS} SELECT document_id, department, step_order, step_name, status, round(confidence, 6) AS confidence FROM s")
def verification_steps(t, spark):
    return checks.verification_steps(_requests(t, spark)).withColumn("confidence", F.round("confidence", 6))


_SCORE = """a AS (SELECT document_id, count(*) FILTER (status <> 'SKIPPED') AS n, count(*) FILTER (status = 'FAILED') AS f, count(*) FILTER (status = 'WARNING') AS w, count(*) FILTER (status = 'PASSED') AS p, count(*) FILTER (status = 'SKIPPED') AS k, avg(confidence) FILTER (status <> 'SKIPPED') AS m, sum(confidence) FILTER (status <> 'SKIPPED') AS total FROM s GROUP BY 1),
b AS (SELECT *, round(least(greatest(0.6 * f / n + 0.2 * w / n + 0.2 * (1 - m), 0), 1), 4) AS fraud FROM a),
e AS (SELECT *, CASE WHEN fraud < 0.2 THEN 'PASSED' WHEN fraud < 0.5 THEN 'WARNING' ELSE 'FAILED' END AS grade FROM b),
g AS (SELECT document_id, fraud AS fraud_score, round((total + (1 - fraud) + 1) / (n + 2), 4) AS confidence, p + 1 + CASE WHEN grade = 'PASSED' THEN 1 ELSE 0 END AS passed, f + CASE WHEN grade = 'FAILED' THEN 1 ELSE 0 END AS failed, w + CASE WHEN grade = 'WARNING' THEN 1 ELSE 0 END AS warnings, k AS skipped FROM e),
h AS (SELECT *, CASE WHEN failed > 0 OR fraud_score > 0.5 THEN 'RED' WHEN warnings > 0 OR fraud_score > 0.2 THEN 'YELLOW' ELSE 'GREEN' END AS badge FROM g)"""


@query(f"WITH {_STEPS}, {_SCORE} SELECT *, badge = 'YELLOW' AS needs_review FROM h")
def verification_results(t, spark):
    return checks.verification_results(_requests(t, spark))


@query(f"""WITH {_STEPS}, w AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY step_order, step_name) AS r, count(*) OVER (PARTITION BY document_id) AS n FROM s WHERE status = 'WARNING')
SELECT document_id, 'Manual review needed (' || any_value(n) || ' warnings): ' || string_agg(step_name, '; ' ORDER BY r) AS reason FROM w WHERE r <= 5 GROUP BY 1""")
def review_reasons(t, spark):
    return checks.review_reasons(checks.verification_steps(_requests(t, spark)))


@query(f"WITH {_STEPS} SELECT department, count(*) AS n FROM d GROUP BY 1")
def department_detection(t, spark):
    held = checks.looked_at(_requests(t, spark)).select("department")
    return held.groupBy("department").agg(F.count("*").alias("n"))


FIELDS = "SELECT * FROM (VALUES ('c1', 'd1', 'full_name', 'Asha Rao', 0.9), ('c1', 'd1', 'plaintiff_name', 'Asha Rao', 0.8), ('c1', 'd2', 'Defendant', 'Bo Chan', 0.95), ('c1', 'd2', 'judge_name', 'Otto Lind', 0.7), ('c2', 'd3', 'full_name', CAST(NULL AS STRING), 0.4), ('c2', 'd3', 'advocate', 'Nila Das', 0.71), ('c2', 'd4', 'advocate', 'Ada Fox', 1.0), ('c3', 'd5', 'x', CAST(NULL AS STRING), 0.1), ('c1', 'd2', 'full_name', 'Asha Rao', 0.6)) AS t(case_id, document_id, field, value, confidence)"
FIELDS += """ UNION ALL SELECT 'k' || o_custkey, 'o' || o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'plaintiff_name' WHEN 1 THEN 'full_name' WHEN 2 THEN 'Judge' WHEN 3 THEN 'advocate' ELSE 'address' END, CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END, 0.5 + (o_orderkey % 10) / 20.0 FROM orders"""


@query(f"SELECT case_id, round(coalesce(avg(CASE WHEN value IS NOT NULL THEN CAST(confidence AS DOUBLE) * 100 END), 0), 4)::DOUBLE AS confidence FROM ({duck(FIELDS)}) GROUP BY 1")
def field_confidence(t, spark):
    return scores.field_confidence(rows(t, spark, FIELDS))


@query(f"""WITH p AS (SELECT *, CASE WHEN contains(lower(field), 'plaintiff') THEN 'plaintiff' WHEN contains(lower(field), 'defendant') THEN 'defendant' WHEN contains(lower(field), 'judge') THEN 'judge' WHEN contains(lower(field), 'advocate') THEN 'advocate' END AS party FROM ({duck(FIELDS)}) WHERE confidence > 0.7 AND value <> '')
SELECT case_id, party, string_agg(DISTINCT value, '; ' ORDER BY value) AS names FROM p WHERE party IS NOT NULL GROUP BY 1, 2""")
def case_parties(t, spark):
    return scores.parties(rows(t, spark, FIELDS))


@query(f"SELECT case_id, CASE WHEN max(n) > 1 THEN 'NEEDS_REVIEW' ELSE 'VERIFIED' END AS status FROM (SELECT case_id, field, count(*) FILTER (field IN ('full_name', 'date_of_birth', 'address', 'document_number')) AS n FROM ({duck(FIELDS)}) GROUP BY 1, 2) GROUP BY 1")
def identity_status(t, spark):
    return scores.identity_status(rows(t, spark, FIELDS))


METADATA = r"SELECT * FROM (VALUES ('d1', 'pan', 'ABCDE1234F', 'ocr', '[A-Z]{5}[0-9]{4}[A-Z]', 4, 3), ('d1', 'name', 'Asha', 'manual', CAST(NULL AS STRING), 2, 2), ('d2', 'pin', 'x 400001', 'REGEX', '[0-9]{6}', 0, 0), ('d2', 'fee', 'none', 'guess', '[0-9]+', 1, 0), ('d2', '_note', 'y', 'llm', CAST(NULL AS STRING), 1, 1), ('d3', 'empty', '', 'ner', CAST(NULL AS STRING), 1, 1)) AS t(document_id, field, value, method, pattern, seen, agreeing)"
METADATA += """ UNION ALL SELECT 'k' || c_custkey, 'name', c_name, CASE c_custkey % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'manual' WHEN 2 THEN 'regex' ELSE 'guess' END, '[A-Za-z]+#[0-9]+', c_nationkey, c_nationkey % 3 FROM customer UNION ALL SELECT 'k' || c_custkey, 'segment', c_mktsegment, 'ner', '[A-Z]{3}', 0, 0 FROM customer"""
_SURE = "coalesce(CASE lower(method) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in scores.SURE.items()) + " END, 0.5)"


@query(f"""SELECT document_id, field, round(0.4 * {_SURE} + 0.3 * coalesce(agreeing / nullif(seen, 0), 0.5) + 0.3 * CASE WHEN pattern IS NULL THEN 0.5 WHEN regexp_full_match(value, pattern) THEN 1 WHEN regexp_matches(value, pattern) THEN 0.7 ELSE 0.2 END, 3)::DOUBLE AS score
FROM ({duck(METADATA)}) WHERE value <> '' AND field[1] <> '_'""")
def metadata_confidence(t, spark):
    return scores.metadata_confidence(rows(t, spark, METADATA))


CASES = "SELECT * FROM (VALUES (1, 95.0, 100.0, 100.0, 95.0, '', 0, 0, true, 'Asha', true), (2, 80.0, 66.7, 70.0, 60.0, 'Affidavit', 2, 3, false, '', false), (3, 60.0, 50.0, 90.0, 75.0, 'Proof, Form', 0, 1, false, 'Bo', true), (4, 39.9, 100.0, 40.0, 10.0, CAST(NULL AS STRING), 0, 4, true, CAST(NULL AS STRING), true), (5, 90.0, 100.0, 79.9, 70.0, '', 1, 1, true, 'Eva', true)) AS t(case_id, readiness, completeness, consistency, confidence, missing, major, issues, complete, deponent, consistent)"
CASES += """ UNION ALL SELECT 100 + c_custkey, 40.0 + c_custkey % 60, CASE WHEN c_custkey % 3 = 0 THEN 100.0 ELSE 66.7 END, 60.0 + c_custkey % 41, 50.0 + c_custkey % 50, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Form ' || c_nationkey END, c_custkey % 3, c_custkey % 4, c_custkey % 3 = 0, CASE WHEN c_custkey % 6 = 0 THEN '' ELSE c_name END, c_custkey % 5 > 0 FROM customer"""


@query(f"""WITH c AS (SELECT *, CASE WHEN readiness >= 90 THEN 'Ready for human/authorized review' WHEN readiness >= 75 THEN 'Minor issues to address before review' WHEN readiness >= 60 THEN 'Several issues need attention' ELSE 'Significant work required before submission' END AS s,
  concat_ws(' ', CASE WHEN completeness < 100 AND coalesce(missing, '') <> '' THEN 'Missing required documents: ' || missing END, CASE WHEN consistency < 80 AND major > 0 THEN 'Found ' || major || ' major inconsistencies requiring resolution' END, CASE WHEN confidence < 70 THEN 'Multiple fields have low confidence - manual verification recommended' END) AS todo FROM ({duck(CASES)}))
SELECT case_id, CASE WHEN todo = '' THEN s ELSE s || '. ' || todo END AS recommendation FROM c""")
def readiness_recommendation(t, spark):
    return scores.recommendation(rows(t, spark, CASES))


@query(f"SELECT case_id, CASE WHEN readiness >= 90 AND issues = 0 AND complete THEN 'APPROVED_FOR_REVIEW' WHEN readiness >= 75 THEN 'CONDITIONAL_APPROVAL' WHEN readiness >= 60 THEN 'REQUIRES_CORRECTION' ELSE 'REJECTED' END AS decision FROM ({duck(CASES)})")
def application_decision(t, spark):
    return scores.decision(rows(t, spark, CASES))


@query(f"""WITH c AS (SELECT *, complete AND consistent AND major = 0 AS ready FROM ({duck(CASES)}))
SELECT case_id, 'Deponent name verified' AS item, coalesce(deponent <> '', false) AS good, ready FROM c UNION ALL SELECT case_id, 'Supporting documents complete', complete, ready FROM c
UNION ALL SELECT case_id, 'Identity information consistent', consistent, ready FROM c UNION ALL SELECT case_id, 'No major inconsistencies', major = 0, ready FROM c""")
def notary_checklist(t, spark):
    return scores.notary_checklist(rows(t, spark, CASES))


@query("""WITH d AS (SELECT doc_id AS document_id, sha256(coalesce(text, '')) AS digest, 0.5 + (doc_id % 6) / 10.0 AS o, 0.4 + (doc_id % 7) / 10.0 AS c FROM documents),
f AS (SELECT *, min(document_id) OVER (PARTITION BY digest) AS first, round((o + c) / 2, 4)::DOUBLE AS confidence FROM d)
SELECT document_id, confidence, CASE WHEN confidence >= 0.75 THEN 'verified' ELSE 'pending' END AS status, CASE WHEN first <> document_id THEN first END AS duplicate_of FROM f""")
def locker_status(t, spark):
    held = t("documents").select(F.col("doc_id").alias("document_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), (0.5 + (F.col("doc_id") % 6) / 10.0).alias("ocr_confidence"), (0.4 + (F.col("doc_id") % 7) / 10.0).alias("class_confidence"))
    return scores.locker_status(held)


SCANS = "SELECT * FROM (VALUES (1, 'image/png', CAST(NULL AS STRING), 'seen'), (2, 'application/pdf', repeat('x', 120), 'scan'), (3, 'application/pdf', 'tiny', 'scan'), (4, 'application/vnd.wordprocessingml', 'body', ''), (5, 'application/pdf', '', ' ')) AS t(id, mime, own, ocr)"
SCANS += """ UNION ALL SELECT 100 + doc_id, CASE doc_id % 3 WHEN 0 THEN 'image/png' WHEN 1 THEN 'application/pdf' ELSE 'text/plain' END, CASE WHEN doc_id % 4 = 0 THEN substr(text, 1, 20) ELSE text END, lang FROM documents"""


@query(f"""WITH s AS (SELECT id, CASE WHEN mime LIKE 'image/%' OR (mime = 'application/pdf' AND length(trim(coalesce(own, ''))) < 100) THEN true ELSE false END AS scanned, mime, coalesce(own, '') AS own, coalesce(ocr, '') AS ocr FROM ({duck(SCANS)}))
SELECT id, CASE WHEN scanned THEN ocr ELSE own END AS text, CASE WHEN trim(CASE WHEN scanned THEN ocr ELSE own END) = '' THEN 0 WHEN scanned THEN 0.7 WHEN mime = 'application/pdf' THEN 0.85 ELSE 0.9 END::DOUBLE AS confidence FROM s""")
def text_source(t, spark):
    return rows(t, spark, SCANS).select("id", F.inline(F.array(scores.text_source(F.col("mime"), F.col("own"), F.col("ocr")))))


DAYS = "SELECT * FROM (VALUES (1, '2024-05-06'), (2, 'on 05/06/2024'), (3, '05-06-2024'), (4, '5/6/2024'), (5, CAST(NULL AS STRING)), (6, '01/02/2020 or 2021-03-04')) AS t(id, value)"
DAYS += """ UNION ALL SELECT 100 + o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'on ' || CAST(o_orderdate AS DATE) WHEN 1 THEN '' || (10 + o_orderkey % 19) || '/' || (10 + o_orderkey % 3) || '/2021' ELSE 'day ' || (10 + o_orderkey % 17) || '-11-2020' END FROM orders"""


@query(f"""SELECT id, CASE WHEN regexp_matches(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN regexp_extract(value, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') WHEN regexp_matches(value, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}') THEN regexp_replace(regexp_extract(value, '[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}'), '(..)/(..)/(....)', '\\3-\\2-\\1')
  WHEN regexp_matches(value, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}') THEN regexp_replace(regexp_extract(value, '[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}}'), '(..)-(..)-(....)', '\\3-\\2-\\1') END AS day FROM ({duck(DAYS)})""")
def normal_dates(t, spark):
    return rows(t, spark, DAYS).select("id", text.normal_date(F.col("value")).alias("day"))
