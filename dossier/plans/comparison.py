"""Comparisons across documents and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare, joins
from ..registry import duck, query, rows

FIELDS = """SELECT * FROM (VALUES ('c1', 'd1', 'dob', '01/02/1990'), ('c1', 'd2', 'DOB', '01/02/1991'), ('c1', 'd1', 'Phone no', '12345'), ('c1', 'd3', 'mobile', '12345'), ('c1', 'd2', 'email_address', 'a@b.org'), ('c1', 'd1', 'address', 'a@c.org'),
('c1', 'd1', 'full_name', 'Asha Rao'), ('c1', 'd2', 'full_name', 'asha rao'), ('c1', 'd3', 'full_name', 'Asha Raoo'), ('c1', 'd4', 'name', 'Bo Chan'), ('c2', 'd5', 'full_name', 'Eva'), ('c2', 'd7', 'full_name', 'Otto Lindberg'), ('c2', 'd6', 'full_name', ' '), ('c2', 'd6', 'colour', 'red'), ('c2', 'd5', 'colour', 'blue'), ('c2', 'd7', 'colour', 'Not found'), ('c2', 'd7', 'email', CAST(NULL AS STRING))) AS t(case_id, document_id, field, value)"""
D_FIELDS = FIELDS + """ UNION ALL SELECT 'k' || o_custkey, 'o' || o_orderkey, 'phone', o_orderpriority FROM orders UNION ALL SELECT 'k' || o_custkey, 'o' || o_orderkey, 'document_number', o_orderstatus || o_orderpriority FROM orders"""
OLD = "SELECT * FROM (VALUES (1, 'Full Name', 'Asha Rao'), (1, 'City', 'Ulm'), (1, 'Fee', '100'), (1, 'Note', 'N/A'), (2, 'a', 'same'), (2, 'b', 'same')) AS t(pair_id, field, value)"
D_OLD = OLD + """ UNION ALL SELECT 100 + c_custkey, 'Customer Name', c_name FROM customer UNION ALL SELECT 100 + c_custkey, 'Segment', c_mktsegment FROM customer"""
NEW = "SELECT * FROM (VALUES (1, 'full_name', 'Asha Raos'), (1, 'fee', '100'), (1, 'zip', '12'), (2, 'A', 'SAME'), (2, 'b', 'same')) AS t(pair_id, field, value)"
D_NEW = NEW + """ UNION ALL SELECT 100 + c_custkey, 'customer_name', c_name || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' jr' END FROM customer UNION ALL SELECT 100 + c_custkey, 'nation', '' || c_nationkey FROM customer WHERE c_custkey % 2 = 0"""
PEOPLE = "SELECT * FROM (VALUES ('d1', 'Mira Sen'), ('d1', 'Otto Lind'), ('d2', 'mira sen'), ('d2', 'Otto Lindt'), ('d3', 'Mira Senn'), ('d4', 'Hari Lal'), ('d5', 'Hari Lal'), ('d5', CAST(NULL AS STRING))) AS t(document_id, name)"
NUMBERS = "SELECT * FROM (VALUES ('d4', 'ab/1'), ('d5', 'AB/1'), ('d1', 'X/2'), ('d5', 'AB/1')) AS t(document_id, value)"
METADATA = "SELECT * FROM (VALUES ('d1', 'address', 'Oak 1'), ('d2', 'address', 'Elm 2'), ('d1', 'father_name', 'Sen'), ('d2', 'father_name', 'Sen'), ('d4', 'serial_number', '7'), ('d5', 'serial_number', ''), ('d1', 'other', '1'), ('d2', 'other', '2')) AS t(document_id, field, value)"
VERSIONS = "SELECT * FROM (VALUES (1, 'd1', 'd2', 'a', 'a', 0.9), (2, 'd3', 'd4', 'a', 'b', 0.9), (3, 'd5', 'd6', 'a', 'a', 0.5), (4, 'd7', 'd8', 'a', 'a', 0.7)) AS t(pair_id, a, b, type_a, type_b, content_similarity)"
VERSIONS += """ UNION ALL SELECT 100 + c_custkey, 'a' || c_custkey, 'b' || c_custkey, 'x', CASE WHEN c_custkey % 4 = 0 THEN 'y' ELSE 'x' END, c_nationkey / 25.0 FROM customer"""
VERSION_FIELDS = "SELECT * FROM (VALUES ('d1', 'issue_date', '01-02-2024'), ('d2', 'issue_date', '2024-01-31'), ('d3', 'version', 'v2.1'), ('d4', 'revision', '3'), ('d5', 'date', 'unknown'), ('d6', 'date', '1/1/2024'), ('d7', 'effective_date', '13/01/2024'), ('d8', 'effective_date', '01/14/2024')) AS t(document_id, field, value)"
VERSION_FIELDS += """ UNION ALL SELECT 'a' || c_custkey, 'issue_date', '2024-01-' || (10 + c_custkey % 20) FROM customer UNION ALL SELECT 'b' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'issue_date' ELSE 'version' END, '2024-01-' || (10 + c_nationkey % 19) FROM customer"""


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.4)
SELECT *, CASE WHEN similarity >= 0.98 THEN 'EXACT_DUPLICATE' WHEN similarity >= 0.9 THEN 'LIKELY_DUPLICATE' ELSE 'POSSIBLE_DUPLICATE' END AS label, CASE WHEN similarity >= 0.98 THEN 'VERY_HIGH' WHEN similarity >= 0.9 THEN 'HIGH' WHEN similarity >= 0.8 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM p""")
def near_dup_pairs(t, spark):
    return compare.similar_vectors(t("embeddings"), 0.4)


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label = b.label WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3""")
def near_dup_pairs_by_group(t, spark):
    return compare.similar_vectors(t("embeddings"), 0.3, "label").select("a", "b", "similarity")


COSINES = "SELECT * FROM (VALUES (1, 0.7499), (2, 0.75), (3, 0.80), (4, 0.8999), (5, 0.90), (6, 0.9799), (7, 0.98)) AS t(id, cosine)"
COSINES += """ UNION ALL SELECT 100 + l_orderkey * 10 + l_linenumber, 0.7 + 3 * l_discount FROM lineitem"""


@query(f"SELECT id, CASE WHEN cosine >= 0.98 THEN 'EXACT_DUPLICATE' WHEN cosine >= 0.90 THEN 'LIKELY_DUPLICATE' ELSE 'POSSIBLE_DUPLICATE' END AS label, CASE WHEN cosine >= 0.98 THEN 'VERY_HIGH' WHEN cosine >= 0.90 THEN 'HIGH' WHEN cosine >= 0.80 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM ({COSINES})")
def duplicate_grades(t, spark):
    return rows(t, spark, COSINES).select("id", F.inline(F.array(compare.grade(F.col("cosine")))))


_LOW = "trim(replace(lower(field), '_', ' '))"
_COMPARABLE = ", ".join(f"'{x}'" for x in compare.COMPARABLE)


@query(f"SELECT DISTINCT field, CASE WHEN contains({_LOW}, 'dob') THEN 'dob' WHEN contains({_LOW}, 'address') THEN 'address' WHEN regexp_matches({_LOW}, 'phone|mobile|telephone') THEN 'phone' WHEN contains({_LOW}, 'email') THEN 'email' WHEN field IN ({_COMPARABLE}) THEN field END AS name FROM ({duck(D_FIELDS)})")
def canonical_fields(t, spark):
    return rows(t, spark, D_FIELDS).select("field", compare.canonical(F.col("field")).alias("name")).distinct()


# the indel similarity isn't one of SQL's functions; tests compare with plain Python
@query()
def field_inconsistencies(t, spark):
    return compare.inconsistencies(rows(t, spark, D_FIELDS)).withColumn("similarity", F.round("similarity", 4))


@query()
def contradictions(t, spark):
    return compare.contradictions(rows(t, spark, D_FIELDS)).withColumn("similarity", F.round("similarity", 4))


@query()
def comparison_report(t, spark):
    held = rows(t, spark, D_FIELDS)
    return compare.comparison_report(held.select("case_id"), compare.inconsistencies(held))


@query()
def customer_inconsistencies(t, spark):
    """Orders of a customer that disagree in their priority, as fields of a case."""
    held = t("orders").select(F.col("o_custkey").cast("string").alias("case_id"), F.col("o_orderkey").cast("string").alias("document_id"), F.lit("phone").alias("field"), F.col("o_orderpriority").alias("value"))
    return compare.inconsistencies(held).select("case_id", "field", "a", "b", "n_a", "n_b", "severity")


@query()
def graded_diff(t, spark):
    return compare.graded_diff(rows(t, spark, D_OLD), rows(t, spark, D_NEW))


@query()
def comparison_verdicts(t, spark):
    content = rows(t, spark, "SELECT * FROM (VALUES (1, 0.9D), (2, 0.86D)) AS t(pair_id, content_similarity) UNION ALL SELECT 100 + c_custkey, c_nationkey / 25.0 FROM customer")
    return compare.verdicts(compare.graded_diff(rows(t, spark, D_OLD), rows(t, spark, D_NEW)), content)


CHANGES = "SELECT * FROM (VALUES (1, 'name', 'Ann'), (1, 'city', 'Ulm'), (1, 'zip', '1'), (2, 'name', 'Anne'), (2, 'phone', '12'), (2, 'fax', '3')) AS t(version, field, value)"
CHANGES += """ UNION ALL SELECT 1, 'o' || o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 2, 'o' || o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE o_orderpriority END FROM orders WHERE o_orderkey % 4 <> 0"""


@query(f"""WITH v AS ({CHANGES}), d AS (SELECT a.field AS x, b.field AS y, a.value AS old, b.value AS new FROM (SELECT * FROM v WHERE version = 1) a FULL JOIN (SELECT * FROM v WHERE version = 2) b ON a.field = b.field),
n AS (SELECT count(*) FILTER (x IS NULL) AS added, count(*) FILTER (y IS NULL) AS removed, count(*) FILTER (x = y AND old <> new) AS modified FROM d)
SELECT *, coalesce(nullif(concat_ws(', ', CASE WHEN added > 0 THEN added || ' field(s) added' END, CASE WHEN removed > 0 THEN removed || ' field(s) removed' END, CASE WHEN modified > 0 THEN modified || ' field(s) modified' END), ''), 'No changes detected') AS summary FROM n""")
def change_summary(t, spark):
    held = rows(t, spark, CHANGES)
    return compare.change_summary(joins.field_diff(held.where("version = 1"), held.where("version = 2")))


_DAY = "coalesce(try_strptime({0}, '%d-%m-%Y'), try_strptime({0}, '%Y-%m-%d'), try_strptime({0}, '%d/%m/%Y'), try_strptime({0}, '%m/%d/%Y'))"
_NEWER = " ".join(f"WHEN {_DAY.format('fa.' + n)} IS NOT NULL AND {_DAY.format('fb.' + n)} IS NOT NULL THEN CASE WHEN {_DAY.format('fa.' + n)} > {_DAY.format('fb.' + n)} THEN p.a ELSE p.b END" for n in compare.NEWER_BY)


@query(f"""WITH f AS (SELECT document_id, {', '.join(f"max(value) FILTER (field = '{n}') AS {n}" for n in (*compare.NEWER_BY, 'version', 'revision'))} FROM ({VERSION_FIELDS}) GROUP BY 1),
p AS ({VERSIONS}), n AS (SELECT p.*, CASE {_NEWER} WHEN regexp_extract(coalesce(fa.version, fa.revision), '([0-9]+(\\.[0-9]+)?)') <> '' AND regexp_extract(coalesce(fb.version, fb.revision), '([0-9]+(\\.[0-9]+)?)') <> '' THEN CASE WHEN CAST(regexp_extract(coalesce(fa.version, fa.revision), '([0-9]+(\\.[0-9]+)?)') AS DOUBLE) > CAST(regexp_extract(coalesce(fb.version, fb.revision), '([0-9]+(\\.[0-9]+)?)') AS DOUBLE) THEN p.a ELSE p.b END END AS newer
  FROM p LEFT JOIN f fa ON fa.document_id = p.a LEFT JOIN f fb ON fb.document_id = p.b)
SELECT pair_id, newer, type_a = type_b AND content_similarity >= 0.7 AS likely_versions, CASE WHEN type_a = type_b AND content_similarity >= 0.7 THEN newer END AS supersedes FROM n""")
def superseded_versions(t, spark):
    return compare.superseded(rows(t, spark, VERSIONS), rows(t, spark, VERSION_FIELDS))


@query()
def entity_links(t, spark):
    return compare.entity_links(spark.sql(PEOPLE).withColumn("type", F.lit("person")))


@query()
def related_documents(t, spark):
    return compare.related_documents(spark.sql(PEOPLE), spark.sql(NUMBERS))


@query()
def duplicate_identities(t, spark):
    return compare.duplicate_identities(spark.sql(PEOPLE))


@query()
def merge_candidates(t, spark):
    return compare.merge_candidates(t("part").select(F.col("p_name").alias("name")).unionAll(spark.sql(PEOPLE).select("name")), 60.0)


@query(f"""WITH p AS (SELECT DISTINCT document_id, lower(name) AS name FROM ({duck(PEOPLE)})), d AS (SELECT DISTINCT x.document_id AS doc_a, y.document_id AS doc_b FROM p x JOIN p y ON x.name = y.name AND x.document_id < y.document_id), m AS (SELECT * FROM ({METADATA}) WHERE value <> '' AND field IN ('date_of_birth', 'address', 'father_name', 'serial_number'))
SELECT doc_a, doc_b, a.field, a.value AS value_a, b.value AS value_b FROM d JOIN m a ON a.document_id = doc_a JOIN m b ON b.document_id = doc_b AND a.field = b.field WHERE a.value <> b.value""")
def metadata_conflicts(t, spark):
    return compare.metadata_conflicts(spark.sql(PEOPLE), spark.sql(METADATA))


@query("SELECT DISTINCT lower(trim(o_clerk)) AS v FROM (SELECT o_orderpriority AS o_clerk FROM orders) INTERSECT SELECT lower(trim(o_orderpriority)) FROM orders WHERE o_orderstatus = 'F'")
def shared_priorities(t, spark):
    """Values that two document sets have in common. They are counted as values: a join, as of set operations, would gather the rows of each."""
    v = F.lower(F.trim("o_orderpriority")).alias("v")
    return t("orders").groupBy(v).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("held")).where("held").select("v")


@query("""WITH k AS (SELECT c_nationkey AS nation, c_mktsegment AS name, true AS sold FROM customer UNION ALL SELECT s_nationkey, 's' || (s_suppkey % 7), false FROM supplier UNION ALL SELECT s_nationkey, 'BUILDING', false FROM supplier WHERE s_suppkey % 3 = 0)
SELECT nation, string_agg(DISTINCT name, ',' ORDER BY name) AS names, (SELECT count(*) FROM (SELECT name FROM k x WHERE x.nation = k.nation AND sold INTERSECT SELECT name FROM k x WHERE x.nation = k.nation AND NOT sold)) AS shared FROM k GROUP BY nation""")
def key_sets(t, spark):
    """The keys that customers and suppliers of a nation have, of either and of both."""
    mine = t("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.collect_set("c_mktsegment").alias("a"))
    theirs = t("supplier").select(F.col("s_nationkey").alias("nation"), F.explode(F.array(F.concat(F.lit("s"), F.col("s_suppkey") % 7), F.when(F.col("s_suppkey") % 3 == 0, "BUILDING"))).alias("x"))
    both = mine.join(theirs.groupBy("nation").agg(F.collect_set("x").alias("b")), "nation", "full_outer")
    a, b = (F.coalesce(c, F.array().cast("array<string>")) for c in ("a", "b"))
    return both.select("nation", F.array_join(F.sort_array(F.array_union(a, b)), ",").alias("names"), F.size(F.array_intersect(a, b)).cast("long").alias("shared"))


@query("SELECT doc_id, sha256(coalesce(lang, '') || '|' || coalesce(source, '') || '|' || n_chars) AS digest FROM documents")
def row_fingerprints(t, spark):
    return t("documents").select("doc_id", T.fingerprint(F.col("lang"), F.col("source"), F.col("n_chars")).alias("digest"))
