"""Fields, items, entities and timelines of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks
from ..operators import extracts, fields
from ..registry import duck, query

#: Literal forms; bars stand for line ends.
FORMS = """SELECT CAST(doc_id AS BIGINT) AS doc_id, document_type, replace(text, '|', chr(10)) AS text FROM (VALUES
(-1, 'Identity Proof', 'IDENTITY CARD|Full Name: Asha Rao Age 40|Date of Birth: 05/06/1980|ID Number: ABC-12345|Nationality: Indian|Phone: 98765 43210|Fathers Name: Ravi Kumar Rao|'),
(-2, 'Certificate', 'Certificate of Merit|Certificate No: CERT/2024/77|Issued by: Board of Weaving Arts.|Date of Issue: 1/2/2024|Valid Till: 01-02-2030|name: Mr Bo Chan|Ref No: RW-99120|'),
(-3, 'Application', 'Application No: APP-2024-9|Applicant Name: Eva Ilm Date 3|Application Date: 12/12/2023|Purpose: Trade permit|Department: Fisheries|Email: eva@example.org|Fee: Rs. 1,250.50|Case No: KX/2023/11|'),
(-4, 'Other', 'Memo|Date: 3.4.2024|Prepared by: Nila Das.|File Number: ME-2024/5|x - y|  : z|Pin: 400001|PAN ABCDE1234F|'),
(-5, 'Other', CAST(NULL AS STRING)), (-6, 'Unknown', 'Date: 01/01/2020')) AS t(doc_id, document_type, text)"""
SCHEMAS = """SELECT * FROM (VALUES ('Identity Proof', 'full_name', 'string', true), ('Identity Proof', 'date_of_birth', 'date', true), ('Identity Proof', 'id_number', 'string', true), ('Identity Proof', 'document_number', 'string', false), ('Identity Proof', 'nationality', 'string', false), ('Identity Proof', 'father_name', 'string', false), ('Identity Proof', 'contact_number', 'phone', false), ('Identity Proof', 'mother_name', 'string', false),
('Certificate', 'certificate_number', 'string', true), ('Certificate', 'issue_date', 'date', true), ('Certificate', 'expiry_date', 'date', false), ('Certificate', 'issuing_authority', 'string', true), ('Certificate', 'holder_name', 'string', true), ('Certificate', 'reference_number', 'string', false),
('Application', 'application_number', 'string', true), ('Application', 'applicant_name', 'string', true), ('Application', 'date_filed', 'date', true), ('Application', 'purpose', 'string', false), ('Application', 'department', 'string', false), ('Application', 'email', 'email', false),
('Other', 'date', 'date', false), ('Other', 'author', 'string', false), ('Other', 'reference_number', 'string', false), ('Other', 'email', 'email', false), ('Other', 'contact_number', 'phone', false), ('Other', 'document_title', 'string', false), ('Other', 'document_type_specific', 'string', false)) AS t(document_type, field, type, required)"""
NOTES = """SELECT CAST(doc_id AS BIGINT) AS doc_id, replace(text, '|', chr(10)) AS text FROM (VALUES
(-11, 'In the High Court of Vale: the Petitioner: Mira Sen, aged 40, resident of Oakdale. Heard by Justice Otto Lind. Case No. WP/11/2024, listed for hearing on 12/03/2024.|Fee: Rs. 2,500 is due by March 5, 2024.'),
(-12, 'Department of Rural Works, office of the Collector: Ravi Das, hereby certified on 2024-01-15. Place: Ulmstead; Pin code 400012. Rohan Pal S/o Vikas Pal was born on 3 April 1990.'),
(-13, 'Inspector: Hari Lal, Police Station Northgate. FIR No: 77/2023 filed on 05/07/2023 against Tara Bo. City: Westhill;'),
(-14, CAST(NULL AS STRING)), (-15, 'Nothing of note here.')) AS t(doc_id, text)"""
LOW_TYPES = "SELECT * FROM (VALUES ('birth_certificate'), ('court_order'), ('land_record'), ('other')) AS t(document_type)"


def _quoted(p: str) -> str:
    return p.replace("'", "''")


def _cleaned(x: str) -> str:
    return rf"trim(regexp_replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), '[,.]+$', ''))"


def _hit(patterns) -> str:
    """SQL of the first pattern's cleaned hit with two characters or more."""
    hits = [_cleaned(f"regexp_extract(t, '(?im){_quoted(p)}', 1)") for p in patterns]
    return "coalesce(" + ", ".join(f"CASE WHEN length({h}) > 1 THEN {h} END" for h in hits) + ", NULL)"


_DOCS = f"docs AS ({duck(FORMS)} UNION ALL SELECT doc_id, 'Other', text FROM documents)"
_ASKED = [f for f in fields.PATTERNS if f"'{f}'" in SCHEMAS]
_VALUE = "CASE field " + " ".join(f"WHEN '{f}' THEN {_hit(fields.PATTERNS[f])}" for f in _ASKED) + " END"
_SCHEMA_FIELDS = f"""{_DOCS}, b AS (SELECT doc_id, field, type, required, coalesce(text, '') AS t FROM docs JOIN ({SCHEMAS}) USING (document_type)),
sf AS (SELECT doc_id, field, {_VALUE} AS value, type, required FROM b)"""
_KEY = r"regexp_replace(regexp_replace(lower(trim(k)), '[\s/]+', '_', 'g'), '[^a-z0-9_]', '', 'g')"
_REST = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS field, trim(regexp_extract(t, '(?i){_quoted(p)}', 1)) AS value FROM r" for name, p in fields.UNIVERSAL.items())
_NOISE = ", ".join(f"'{w}'" for w in fields.NOISE)
_LABEL_FIELDS = rf"""r AS (SELECT doc_id, coalesce(text, '') AS t FROM docs),
lines AS (SELECT doc_id, unnest(regexp_extract_all(t, '{fields.LABEL_LINE}', 1)) AS k, unnest(regexp_extract_all(t, '{fields.LABEL_LINE}', 2)) AS v, unnest(range(1, len(regexp_extract_all(t, '{fields.LABEL_LINE}', 1)) + 1)) AS i FROM r),
pairs AS (SELECT doc_id, {_KEY} AS field, regexp_replace(trim(v), '[.,;]+$', '') AS value, i FROM lines),
own AS (SELECT doc_id, field, max_by(value, i) AS value FROM pairs WHERE length(value) >= 2 AND field <> '' GROUP BY 1, 2),
lf AS (SELECT * FROM (SELECT * FROM own UNION ALL SELECT * FROM ({_REST}) u WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.doc_id = u.doc_id AND o.field = u.field)) WHERE length(field) > 1 AND length(value) > 1 AND field NOT IN ({_NOISE}))"""
_GUESS = "CASE WHEN regexp_matches(field, 'date|dob|birth|issue|expiry|valid') THEN 'date' WHEN regexp_matches(field, 'amount|fee|price|cost|salary|income') THEN 'number' WHEN contains(field, 'email') THEN 'email' WHEN regexp_matches(field, 'phone|mobile|contact|tel') THEN 'phone' ELSE 'string' END"


def _docs(t, spark):
    return spark.sql(FORMS).unionAll(t("documents").select("doc_id", F.lit("Other"), "text"))


@query(f"WITH {_SCHEMA_FIELDS} SELECT *, CASE WHEN value IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence FROM sf")
def schema_fields(t, spark):
    return fields.schema_fields(_docs(t, spark), spark.sql(SCHEMAS))


# titles need more than SQL's patterns; a test compares them
@query(f"WITH {_DOCS}, {_LABEL_FIELDS} SELECT * FROM lf")
def label_fields(t, spark):
    return fields.label_fields(_docs(t, spark)).where("field <> 'document_title'")


@query(f"""WITH {_SCHEMA_FIELDS}, {_LABEL_FIELDS}
SELECT doc_id, field, value, CASE WHEN value IS NULL THEN 0.0 ELSE 0.9 END::DOUBLE AS confidence, type, required FROM sf WHERE field <> 'document_title'
UNION ALL SELECT doc_id, field, value, 0.85::DOUBLE, {_GUESS}, false FROM lf WHERE NOT EXISTS (SELECT 1 FROM sf WHERE sf.doc_id = lf.doc_id AND sf.field = lf.field AND sf.value IS NOT NULL)""")
def extracted_fields(t, spark):
    return fields.extracted_fields(_docs(t, spark), spark.sql(SCHEMAS)).where("field <> 'document_title'")


# titles and patterns that look ahead are beyond SQL's patterns; tests compare them with plain readings
@query()
def document_titles(t, spark):
    return fields.label_fields(_docs(t, spark)).where("field = 'document_title'")


@query()
def graph_fields_ahead(t, spark):
    return fields.graph_fields(_docs(t, spark)).where(~F.col("field").isin(list(_PLAIN_GRAPH)))


_LOCKER = ", ".join(f"array_to_string(list_transform(regexp_extract_all(trim(coalesce(text, '')), '{p}', 1)[1:{n}], lambda x: trim(x)), ';') AS {name}" for name, (p, n) in fields.LOCKER.items())


@query(f"WITH {_DOCS} SELECT doc_id, {_LOCKER} FROM docs")
def locker_metadata(t, spark):
    return _docs(t, spark).select("doc_id", F.inline(F.array(fields.locker_metadata(F.col("text")))))


_PLAIN_GRAPH = {n: x for n, x in fields.GRAPH.items() if "(?=" not in x[1]}


@query(f"WITH {_DOCS} SELECT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS field, '{k}' AS type, trim(regexp_extract(coalesce(text, ''), '(?im){p}', 1)) AS value FROM docs" for n, (k, p) in _PLAIN_GRAPH.items()) + ") WHERE length(value) > 1")
def graph_fields(t, spark):
    return fields.graph_fields(_docs(t, spark)).where(F.col("field").isin(list(_PLAIN_GRAPH)))


REPLIES = """SELECT * FROM (VALUES (1, 'So: {"name": {"value": "Bo", "confidence": 0.8}, "city": "Ulm", "fee": null} end'), (2, 'no object'), (3, '{"name": "Eva"}'), (4, CAST(NULL AS STRING)), (5, '{"name": {"value": null}}')) AS t(reply_id, reply)"""


@query(f"""WITH r AS ({duck(REPLIES)}), j AS (SELECT reply_id, field, try_cast(nullif(regexp_extract(reply, '(?s)(\\{{.*\\}})', 1), '') AS JSON) -> field AS x FROM r, (SELECT unnest(['name', 'city', 'fee']) AS field))
SELECT reply_id, field, CASE WHEN json_type(x) = 'OBJECT' THEN x ->> 'value' WHEN json_type(x) <> 'NULL' THEN x ->> '$' END AS value,
  CASE WHEN json_type(x) = 'OBJECT' THEN coalesce(CAST(x ->> 'confidence' AS DOUBLE), 0) WHEN json_type(x) IS NOT NULL AND json_type(x) <> 'NULL' THEN 0.7 ELSE 0 END::DOUBLE AS confidence FROM j""")
def model_replies(t, spark):
    rows = spark.sql(REPLIES).select("reply_id", "reply", F.explode(F.array(*map(F.lit, ("name", "city", "fee")))).alias("field"))
    return rows.select("reply_id", "field", F.inline(F.array(fields.parsed_reply(F.col("reply"), F.col("field")))))


def _notes(t, spark):
    return spark.sql(NOTES).unionAll(t("documents").select("doc_id", "text"))


# offsets and contexts need more than SQL; tests compare with plain Python
@query()
def named_entities(t, spark):
    return extracts.everything(_notes(t, spark))


@query()
def entity_profiles(t, spark):
    return extracts.entity_profiles(_notes(t, spark))


@query()
def document_timeline(t, spark):
    return extracts.document_timeline(_notes(t, spark))


@query()
def item_summaries(t, spark):
    return extracts.summaries(extracts.everything(_notes(t, spark)))


DATED = "SELECT * FROM (VALUES (1, 'Issue_Date', '01/02/2024'), (1, 'expiry_date', '2025-03-04'), (1, 'name', '2020-01-01'), (2, 'date_of_birth', '5 May 1990'), (2, 'due_date', 'soon'), (2, 'date', '31-12-2023'), (3, 'hearing_date', CAST(NULL AS STRING))) AS t(document_id, field, value)"
_KINDS = "CASE lower(field) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in extracts.FIELD_EVENTS.items()) + " END"


@query(f"""WITH d AS (SELECT *, {_KINDS} AS event_type, coalesce(try_strptime(value, '%Y-%m-%d'), try_strptime(value, '%d/%m/%Y'), try_strptime(value, '%d-%m-%Y'), try_strptime(value, '%-d %B %Y')) AS day FROM ({duck(DATED)}))
SELECT document_id, strftime(day, '%Y-%m-%d') AS date, event_type, field FROM d WHERE event_type IS NOT NULL AND day IS NOT NULL""")
def field_events(t, spark):
    return extracts.field_events(spark.sql(DATED))


@query()
def section_chunks(t, spark):
    return chunks.chunked(t("documents"), "sections")


@query()
def adaptive_chunks(t, spark):
    kinds = F.element_at(F.array(*map(F.lit, ("passport", "court_order", "land_record", "fir", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return chunks.adaptively_chunked(t("documents").select("doc_id", kinds.alias("document_type"), "text"))


@query()
def section_titles(t, spark):
    return chunks.sections(t("documents"))


CLAIMS = "SELECT * FROM (VALUES (-21, 'Spark is a compute engine. The Engine uses Arrow and is part of the Stack; see https://example.org/x or /opt/lib/a.so, version 4.1.2-rc1'), (-22, 'Deep learning and NLP. Models are large'), (-23, CAST(NULL AS STRING))) AS t(doc_id, text)"
_CLAIMED = f"c AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS t FROM ({duck(CLAIMS)}) UNION ALL SELECT doc_id, coalesce(text, '') FROM documents)"
_PHRASES = " UNION ALL ".join(f"SELECT doc_id, '{p}' AS name, '{k}' AS type, 0.7::DOUBLE AS confidence FROM c WHERE contains(' ' || array_to_string(regexp_extract_all(lower(t), '[a-z0-9]+'), ' ') || ' ', ' {p} ')" for k, ps in extracts.PHRASES.items() for p in ps)


def _claims(t, spark):
    return spark.sql(CLAIMS).selectExpr("cast(doc_id as long) as doc_id", "text").unionAll(t("documents").select("doc_id", "text"))


@query(f"WITH {_CLAIMED} SELECT DISTINCT * FROM (" + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(t, '{p}')) AS name, '{k}' AS type, 0.8::DOUBLE AS confidence FROM c" for k, p in extracts.FORMS) + f" UNION ALL {_PHRASES})")
def formal_entities(t, spark):
    return extracts.formal_entities(_claims(t, spark))


@query(f"WITH {_CLAIMED}, f AS (" + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(t, '{p}', 1)) AS src, '{k}' AS type, unnest(regexp_extract_all(t, '{p}', 2)) AS dst FROM c" for k, p in extracts.STATED) + ") SELECT doc_id, min(src) AS src, type, min(dst) AS dst, 0.7::DOUBLE AS confidence FROM f GROUP BY doc_id, lower(src), type, lower(dst)")
def stated_relations(t, spark):
    return extracts.stated_relations(_claims(t, spark))


TERMS = "SELECT * FROM (VALUES ('license'), ('The'), ('all rights'), ('es')) AS t(name)"


@query(f"""WITH d AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), b AS (SELECT doc_id, name, lower(name) AS low, t, (length(t) - length(replace(t, lower(name), ''))) / length(name) AS n, strpos(t, lower(name)) - 1 AS pos, regexp_extract_all(t, '[\\pL\\pN_]+') AS w FROM d JOIN ({TERMS}) ON contains(t, lower(name)))
SELECT doc_id, name, CAST(n AS BIGINT) AS occurrences, CAST(pos AS INTEGER) AS position, round(least(1, n / greatest(length(t) / 100, 1) * 0.5 + (1 - pos / greatest(length(t), 1)) * 0.3 + CASE WHEN length(split_part(low, ' ', 1)) > 2 THEN len(list_filter(w, lambda x: x = split_part(low, ' ', 1))) / greatest(len(w), 1) ELSE 0 END * 0.2), 6)::DOUBLE AS relevance FROM b""")
def entity_relevance(t, spark):
    return extracts.entity_relevance(t("documents"), spark.sql(TERMS))


@query()
def keyed_digests(t, spark):
    from ..functions import text

    return t("documents").select("doc_id", text.hmac(F.coalesce("text", F.lit("")), b"key").alias("digest"))
