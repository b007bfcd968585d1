"""The operators as queries over the driver's tables or over literal rows, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import chunks, text
from .operators import extracts, filters, graph, joins, scores, search, windows
from .plans import comparison, extraction, graphs, others, records, retrieval, stores, verification  # noqa: F401  register their queries
from .registry import duck as _lit, rows
from .registry import query


#: Literal rows, as both engines read them.
LISTS = "SELECT * FROM (VALUES (1, 's', 'alpha', 0.9), (1, 's', 'beta', 0.6), (1, 's', 'gamma', 0.3), (1, 'w', 'beta', 4.0), (1, 'w', 'delta', 8.0), (2, 'w', 'alpha', 1.5), (2, 's', 'omega', 0.2)) AS t(query_id, side, text, score)"
LISTS += """ UNION ALL SELECT 100 + o_custkey, 's', 'd' || (o_orderkey % 37), max(o_totalprice) / 1000000 FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, o_orderkey % 37 UNION ALL SELECT 100 + o_custkey, 'w', 'd' || (o_orderkey % 37), count(*) FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey, o_orderkey % 37"""
SOURCES = "SELECT * FROM (VALUES (1, 0.9, 0.5, '2025-12-01', true), (2, 0.4, 1.0, '01/06/2024', false), (3, 0.7, 0.2, 'unknown', true), (4, 0.7, 0.2, '2026-01-01', false)) AS t(source_id, similarity, authority, dated, verified)"
SOURCES += """ UNION ALL SELECT 100 + o_orderkey, (o_orderkey % 100) / 100.0, (o_custkey % 10) / 10.0, '' || CAST(o_orderdate AS DATE), o_orderkey % 2 = 0 FROM orders"""
RULES = "SELECT * FROM (VALUES ('invoice', 0, 'amount'), ('invoice', 0, 'due'), ('invoice', 0, 'tax'), ('licence', 1, 'driver'), ('licence', 1, 'vehicle'), ('record', 2, 'birth'), ('record', 2, 'tax')) AS t(category, place, keyword)"
NOTICES = "SELECT * FROM (VALUES (-1, 'Case No. AB/12/2024: the fee of Rs. 1,500 is due by March 5, 2024 or 2024-04-01.'), (-2, 'FIR No: 77/2023, heard on 7 May 2023; Ref No. XY-1234.')) AS t(doc_id, text)"
LETTERS = "SELECT * FROM (VALUES (1, 'The AMOUNT is due with tax'), (2, 'A driver of a vehicle'), (3, 'Only tax here'), (4, 'nothing fits'), (5, ''), (6, CAST(NULL AS STRING)), (7, 'Vehicle and birth')) AS t(doc_id, text)"
LETTERS += """ UNION ALL SELECT 100 + doc_id, text || CASE doc_id % 5 WHEN 0 THEN ' tax' WHEN 1 THEN ' driver' WHEN 2 THEN ' birth and tax' ELSE '' END FROM documents"""
STEPS = "SELECT * FROM (VALUES ('a', 'PASSED', 0.9), ('a', 'PASSED', 1.0), ('b', 'PASSED', 0.8), ('b', 'WARNING', 0.6), ('b', 'SKIPPED', 0.0), ('c', 'FAILED', 0.2), ('c', 'PASSED', 0.9), ('d', 'SKIPPED', 0.5), ('e', 'PASSED', 0.0), ('e', 'PASSED', 0.001)) AS t(document_id, status, confidence)"
STEPS += """ UNION ALL SELECT 'o' || l_orderkey, CASE l_returnflag WHEN 'A' THEN 'PASSED' WHEN 'N' THEN CASE WHEN l_linestatus = 'O' THEN 'WARNING' ELSE 'SKIPPED' END ELSE 'FAILED' END, 0.613717 + l_linenumber * 0.0313139 FROM lineitem"""
ISSUES = "SELECT * FROM (VALUES (1, 'MAJOR'), (1, 'minor'), (2, 'MODERATE'), (2, 'MODERATE'), (3, 'MINOR'), (4, 'odd'), (5, 'MAJOR'), (5, 'MAJOR'), (5, 'MAJOR'), (5, 'MAJOR'), (5, 'MAJOR'), (5, 'MAJOR'), (5, 'MAJOR')) AS t(case_id, severity)"
ISSUES += """ UNION ALL SELECT 100 + l_orderkey, CASE l_returnflag WHEN 'A' THEN 'MAJOR' WHEN 'N' THEN 'minor' ELSE 'MODERATE' END FROM lineitem WHERE l_linestatus = 'F'"""
ITEMS = "SELECT * FROM (VALUES (1, 0.6999, '2026-01-02'), (2, 0.7, '2026-01-01'), (3, 0.8999, '2026-01-03'), (4, 0.9, '2026-01-01'), (5, 1.0, '2026-01-01'), (6, 0.1, '2026-01-01')) AS t(item_id, confidence, created_at)"
ITEMS += """ UNION ALL SELECT 100 + event_id, (event_id % 101) / 100.0, '2024-01-' || (10 + event_id % 20) FROM events"""
LINKS = "SELECT * FROM (VALUES ('a', 'b', 'is_a', 0.9), ('b', 'c', 'is_a', 0.8), ('c', 'd', 'is_a', 1.0), ('a', 'c', 'part_of', 0.5), ('d', 'a', 'uses', 0.4), ('e', 'e', 'is_a', 1.0), ('b', 'd', 'is_a', 0.7)) AS t(src, dst, type, confidence)"
LINKS += """ UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'is_a', 0.5 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'is_a', 0.9 FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'part_of', 0.7 FROM supplier"""
VERSIONS = "SELECT * FROM (VALUES (1, 'name', 'Ann'), (1, 'city', 'Ulm'), (1, 'zip', CAST(NULL AS STRING)), (2, 'name', 'Anne'), (2, 'zip', CAST(NULL AS STRING)), (2, 'phone', '12')) AS t(version, field, value)"
VERSIONS += """ UNION ALL SELECT 1, 'o' || o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT 2, 'o' || o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END FROM orders WHERE o_orderkey % 4 <> 0"""
PEOPLE = "SELECT * FROM (VALUES (1, '  dr. anna   lee', '+49 (170) 123-45678', ' Main  STREET 5 ', '31/12/2024', 'DOB'), (2, 'Mr Bo Chan', '12345', 'x', '2024-02-30', 'Mobile'), (3, 'eva', '0049 170 1234567', 'A b', '2024-02-29', 'Fee paid'), (4, CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING), '5.1.2024', 'Full Name')) AS t(id, name, phone, address, dated, field)"
PEOPLE += """ UNION ALL SELECT 100 + c_custkey, 'Mr  ' || lower(c_mktsegment) || ' lee', '0049-' || (1000000000 + c_custkey * 7919), '  Oak  STREET ' || c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '2024-02-' || (10 + c_custkey % 19) ELSE '' || (10 + c_custkey % 19) || '/11/2023' END, CASE c_custkey % 3 WHEN 0 THEN 'DOB' WHEN 1 THEN 'Mobile' ELSE 'Fee paid' END FROM customer"""
QUESTIONS = "SELECT * FROM (VALUES (1, 'When is the deadline?'), (2, 'How much is the fee?'), (3, 'Who are the witnesses?'), (4, 'Where was it?'), (5, 'Give me a summary'), (6, 'Hello'), (7, 'What is the due date of the fee?'), (8, 'Is it genuine?'), (9, 'Which department?'), (10, 'Any pending case?'), (11, 'The date of birth?')) AS t(id, question)"
INPUTS = "SELECT * FROM (VALUES (1, '1 UNION  SELECT x from y'), (2, 'plain words'), (3, '<SCRIPT>alert'), (4, '%2E%2e/etc'), (5, CAST(NULL AS STRING)), (6, 'selected from'), (7, 'javascript:run'), (8, 'onFocus =x'), (9, '<embed x'), (10, 'drop the table')) AS t(id, value)"
USERS = "SELECT * FROM (VALUES (1, 'clerk', 'read'), (2, 'clerk', 'delete'), (3, 'admin', 'delete'), (4, 'guest', 'read')) AS t(user_id, role, permission)"
USERS += """ UNION ALL SELECT 100 + c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'clerk' WHEN 1 THEN 'admin' ELSE 'guest' END, CASE WHEN c_nationkey % 2 = 0 THEN 'read' ELSE 'delete' END FROM customer"""
GRANTS = "SELECT * FROM (VALUES ('clerk', 'read'), ('admin', 'read'), ('admin', 'delete'), ('admin', 'delete')) AS t(role, permission)"
HASHES = "SELECT * FROM (VALUES (1, 0), (2, 255), (3, 511), (4, 4294967295), (5, 0), (6, -1), (7, -256), (8, 281474976710656), (9, 4294967280)) AS t(id, hash)"
PASSAGES = "SELECT * FROM (VALUES (1, 0, 'The fee is 20'), (1, 1, 'Signed by ANNA Lee'), (1, 2, 'anna lee again'), (2, 0, 'Nothing'), (2, 1, 'More')) AS t(doc_id, chunk, text)"
PASSAGES += """ UNION ALL SELECT 1000000 + o_custkey, o_orderkey, 'Order ' || o_orderkey || ' is ' || o_orderpriority FROM orders"""
NAMES = "SELECT * FROM (VALUES ('License'), ('copyright'), ('secret'), ('Password')) AS t(name)"
VALUES = "SELECT * FROM (VALUES (1, 'Anna Lee'), (1, '20'), (2, 'absent')) AS t(doc_id, value)"
VALUES += """ UNION ALL SELECT 1000000 + c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'urgent' WHEN 1 THEN 'LOW' ELSE 'none of it' END FROM customer"""

CONSENTS = "SELECT * FROM (VALUES (1, 'a', 'share', 'grant', 10), (2, 'a', 'share', 'revoke', 20), (3, 'a', 'store', 'grant', 5), (4, 'b', 'share', 'revoke', 7), (5, 'b', 'share', 'grant', 7), (6, 'c', 'store', CAST(NULL AS STRING), 1)) AS t(record_id, user_id, type, action, decided)"
CONSENTS += """ UNION ALL SELECT 100 + event_id, 'u' || user_id, CASE WHEN event_id % 2 = 0 THEN 'share' ELSE 'store' END, CASE event_type WHEN 'click' THEN 'grant' WHEN 'view' THEN 'revoke' END, event_id % 1000 FROM events"""
COSINES = "SELECT * FROM (VALUES (1, 0.7499), (2, 0.75), (3, 0.8999), (4, 0.90), (5, 0.9799), (6, 0.98), (7, CAST(NULL AS DOUBLE))) AS t(id, cosine)"
COSINES += """ UNION ALL SELECT 100 + l_orderkey * 10 + l_linenumber, 0.7 + 3 * l_discount FROM lineitem"""


TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


@query(f"""
WITH words AS (SELECT doc_id, {TOKENS} AS w FROM documents),
size AS (SELECT doc_id, len(w) AS dl FROM words), total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, total GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10""")
def bm25_topk(t, spark):
    return search.bm25(t("documents"), t("benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 10)


_PAIRS = "SELECT q.vec_id AS query_id, q.label AS ql, v.vec_id, v.label, {} AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0"
_RANKED = "ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p) "


@query(f"WITH p AS ({_PAIRS.format('round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)')}), {_RANKED} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 5")
def vector_cosine_topk(t, spark):
    return search.cosine_top_k(t("embeddings"))


@query(f"WITH p AS ({_PAIRS.format('round(1 / (1 + list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda z: power(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE), 2)))), 6)')}), {_RANKED} SELECT query_id, vec_id, score, rank FROM ranked WHERE rank <= 5 AND label = ql")
def vector_l2_topk(t, spark):
    return search.l2_top_k(t("embeddings"))


@query(f"""
WITH l AS ({LISTS}), m AS (SELECT query_id, side, text, CAST(score AS DOUBLE) / max(CAST(score AS DOUBLE)) OVER (PARTITION BY query_id, side) AS x FROM l),
f AS (SELECT query_id, text, round(0.7 * coalesce(sum(x) FILTER (side = 's'), 0) + 0.3 * coalesce(sum(x) FILTER (side = 'w'), 0), 6) AS score FROM m GROUP BY ALL)
SELECT query_id, text, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, text) AS INTEGER) AS rank FROM f QUALIFY rank <= 5""")
def hybrid_fusion(t, spark):
    held = rows(t, spark, LISTS)
    return search.fused(held.where("side = 's'"), held.where("side = 'w'"))


@query(f"""
WITH s AS ({SOURCES}), d AS (SELECT *, coalesce(try_strptime(dated, '%Y-%m-%d'), try_strptime(dated, '%d/%m/%Y')) AS seen FROM s)
SELECT source_id, round(0.4 * CAST(similarity AS DOUBLE) + 0.25 * CAST(authority AS DOUBLE) + 0.2 * coalesce(exp(-date_diff('day', CAST(seen AS DATE), DATE '2026-01-01') / 365.0), 0.5) + 0.15 * CASE WHEN verified THEN 1.0 ELSE 0.8 END, 4) AS score FROM d""")
def source_ranking(t, spark):
    return search.ranked_sources(rows(t, spark, SOURCES), "2026-01-01").select("source_id", "score")


@query(f"""
WITH l AS ({_lit(LETTERS)}), r AS ({RULES}), n AS (SELECT category, count(*) AS n FROM r GROUP BY 1),
h AS (SELECT doc_id, category, place, count(*) / any_value(n) AS share FROM l JOIN r ON contains(lower(text), keyword) JOIN n USING (category) GROUP BY doc_id, category, place),
b AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, place) = 1)
SELECT l.doc_id, coalesce(category, 'other') AS category, CASE WHEN trim(coalesce(text, '')) = '' THEN 0 ELSE coalesce(least(round(2 * share, 6), 1), 0.1) END::DOUBLE AS confidence FROM l LEFT JOIN b USING (doc_id)""")
def keyword_class(t, spark):
    return search.keyword_classes(rows(t, spark, LETTERS), spark.sql(RULES))


@query()
def key_sentences(t, spark):
    return search.key_sentences(t("documents"), ["the", "und", "les", "los", "que"])


@query("WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents) SELECT doc_id, digest, min(doc_id) OVER w AS first_id, count(*) OVER w AS copies FROM h WINDOW w AS (PARTITION BY digest)")
def exact_dup_groups(t, spark):
    return joins.exact_duplicates(t("documents"))


@query(f"""
WITH h AS (SELECT CAST(id AS BIGINT) AS id, CAST(hash AS BIGINT) AS hash FROM ({HASHES})), g AS (SELECT min(id) AS id, hash FROM h GROUP BY hash)
SELECT a.id AS a, b.id AS b, CAST(bit_count(xor(a.hash, b.hash)) AS INTEGER) AS distance FROM g a JOIN g b ON a.id < b.id WHERE bit_count(xor(a.hash, b.hash)) <= 8
UNION ALL SELECT g.id, h.id, 0 FROM h JOIN g USING (hash) WHERE h.id <> g.id""")
def hamming_pairs(t, spark):
    return joins.hamming_pairs(spark.sql(HASHES).select(F.col("id").cast("long").alias("id"), F.col("hash").cast("long").alias("hash")))


@query()
def fuzzy_name_pairs(t, spark):
    return joins.fuzzy_pairs(t("part").select(F.col("p_name").alias("name")))


@query("SELECT lower(trim(CAST(l_partkey AS VARCHAR))) AS value, count(DISTINCT l_suppkey) AS docs FROM lineitem WHERE length(CAST(l_partkey AS VARCHAR)) >= 2 GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def shared_values(t, spark):
    return joins.shared_values(t("lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_partkey").alias("value")))


@query("""
WITH f AS (SELECT o_custkey AS entity, 'priority' AS field, o_orderpriority AS value FROM orders UNION ALL SELECT o_custkey, 'status', o_orderstatus FROM orders)
SELECT entity, field, count(DISTINCT lower(trim(value))) AS n_values, count(*) AS n_rows FROM f WHERE value IS NOT NULL GROUP BY ALL HAVING count(DISTINCT lower(trim(value))) > 1""")
def field_conflicts(t, spark):
    fields = t("orders").select(F.col("o_custkey").alias("entity"), F.expr("inline(array(struct('priority' as field, o_orderpriority as value), struct('status' as field, o_orderstatus as value)))"))
    return joins.conflicts(fields)


@query(f"""
WITH v AS ({_lit(VERSIONS)}), a AS (SELECT * FROM v WHERE version = 1), b AS (SELECT * FROM v WHERE version = 2)
SELECT coalesce(a.field, b.field) AS field, a.value AS old, b.value AS new,
  CASE WHEN a.field IS NULL THEN 'ADDED' WHEN b.field IS NULL THEN 'REMOVED' WHEN a.value IS NOT DISTINCT FROM b.value THEN 'SAME' ELSE 'MODIFIED' END AS change
FROM a FULL JOIN b ON a.field = b.field""")
def field_diff(t, spark):
    held = rows(t, spark, VERSIONS)
    return joins.field_diff(held.where("version = 1"), held.where("version = 2"))


KINDS = ["click", "error", "purchase", "refund", "signup"]


@query("""
WITH need AS (SELECT unnest(['click', 'error', 'purchase', 'refund', 'signup']) AS kind), u AS (SELECT DISTINCT user_id FROM events),
m AS (SELECT user_id, kind, EXISTS (SELECT 1 FROM events e WHERE e.user_id = u.user_id AND e.event_type = kind) AS here FROM u, need)
SELECT user_id AS case_id, count(*) FILTER (NOT here) AS n_missing, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (NOT here), '') AS missing, round(100.0 * count(*) FILTER (here) / 5, 1) AS completeness FROM m GROUP BY 1""")
def missing_requirements(t, spark):
    return joins.missing_requirements(t("events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("kind")), KINDS)


@query(f"""
WITH c AS ({PASSAGES}), v AS ({VALUES}), b AS (SELECT v.doc_id, value, chunk, contains(lower(text), lower(value)) AS hit FROM v JOIN c USING (doc_id))
SELECT doc_id, value, chunk, CAST(CASE WHEN hit THEN 1.0 ELSE 0.5 END AS DOUBLE) AS confidence FROM b QUALIFY row_number() OVER (PARTITION BY doc_id, value ORDER BY hit DESC, chunk) = 1""")
def evidence_lookup(t, spark):
    return joins.evidence(rows(t, spark, VALUES), rows(t, spark, PASSAGES))


@query(f"SELECT DISTINCT doc_id, name FROM documents JOIN ({NAMES}) ON contains(lower(text), lower(name))")
def mention_join(t, spark):
    return joins.mentions(t("documents"), spark.sql(NAMES))


@query("""
SELECT c_custkey, n_orders, latest FROM (SELECT o_custkey AS c_custkey, count(*) AS n_orders, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1)""")
def parent_children(t, spark):
    kids = joins.children(t("customer").select("c_custkey"), t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderdate", "o_orderkey")
    return kids.where(F.size("rows") > 0).select("c_custkey", F.size("rows").cast("long").alias("n_orders"), F.element_at("rows", -1)["o_orderkey"].alias("latest"))


@query("""
WITH e AS (SELECT * FROM events WHERE event_type IN ('error', 'signup')),
r AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM e),
f AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, run ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, run, ts ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS failures FROM r WHERE event_type = 'error')
SELECT * FROM f WHERE failures >= 2""")
def brute_force(t, spark):
    return windows.failures_in_window(t("events"), "error", "signup", seconds=86_400, least=2)


@query("""
WITH c AS (SELECT event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 86399999999 MICROSECOND PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, ts ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS recent FROM events),
s AS (SELECT event_id, recent, round(CASE WHEN recent > 4 THEN 0.4 ELSE 0 END + CASE WHEN hour(ts) < 8 OR hour(ts) > 20 THEN 0.15 ELSE 0 END, 2)::DOUBLE AS score FROM c)
SELECT *, CASE WHEN score < 0.3 THEN 'allow' WHEN score < 0.6 THEN 'monitor' ELSE 'block' END AS action FROM s""")
def access_rate(t, spark):
    return windows.access_rate(t("events"), seconds=86_400, most=4)


@query("""
WITH l AS (SELECT event_id, user_id, ts, k.kind, CASE k.kind WHEN 'device' THEN event_type WHEN 'address' THEN '10.' || (user_id % 3) || '.' || (event_id % 2) || '.' || (event_id % 5) ELSE '10.' || (event_id % 2) END AS v FROM events, (SELECT unnest(['device', 'address', 'network']) AS kind) k),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, user_id, v ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY kind, user_id ORDER BY ts, event_id) AS m FROM l) SELECT event_id, user_id, kind FROM r WHERE n = 1 AND m > 1""")
def novel_networks(t, spark):
    number = lambda c, n: (F.col(c) % n).cast("string")
    address = F.concat_ws(".", F.lit("10"), number("user_id", 3), number("event_id", 2), number("event_id", 5))
    other = F.concat_ws(".", F.lit("10"), number("event_id", 2), F.lit("7"), F.lit("9"))
    return windows.novel_networks(t("events"), {"device": F.col("event_type"), "address": address, "network": text.subnet(other, 2)})


@query("""
WITH e AS (SELECT *, max(CASE WHEN event_type = 'signup' THEN ts END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last FROM events WHERE event_type IN ('signup', 'view'))
SELECT event_id, user_id, coalesce(ts - last <= INTERVAL 2 DAY, false) AS found FROM e WHERE event_type = 'view'""")
def staged_hits(t, spark):
    return windows.staged(t("events"), "signup", "view", 2 * 86_400)


@query("""
WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_spans(t, spark):
    spans = windows.session_spans(t("events"), "12 hours")
    return spans.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_values(t, spark):
    return windows.first_values(t("events").select("user_id", "event_type", "event_id", "value", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""
WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS m FROM events)
SELECT event_id, user_id FROM r WHERE n = 1 AND m > 1""")
def novelty(t, spark):
    return windows.novelty(t("events"), "event_type")


@query("""
WITH c AS (SELECT *, sha256(event_id || '|' || user_id || '|' || event_type) AS h FROM events),
k AS (SELECT *, lag(h, 1, '') OVER w AS prev FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
d AS (SELECT *, CASE WHEN event_id % 97 = 0 THEN 'altered' ELSE event_type END AS now FROM k),
v AS (SELECT user_id, sha256(event_id || '|' || user_id || '|' || now) = h AND lag(h, 1, '') OVER (PARTITION BY user_id ORDER BY ts, event_id) = prev AS whole FROM d)
SELECT user_id, count(*) AS n_rows, count(*) FILTER (NOT whole) AS n_broken FROM v GROUP BY 1""")
def hash_chain_verify(t, spark):
    rows = windows.chained(t("events"), "user_id", ["ts", "event_id"], ["event_id", "user_id", "event_type"])
    # tampered rows: another type than the one that was hashed
    rows = rows.withColumn("event_type", F.when(F.col("event_id") % 97 == 0, "altered").otherwise(F.col("event_type")))
    return windows.chain_breaks(rows, "user_id", ["ts", "event_id"], ["event_id", "user_id", "event_type"])


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def latest_version(t, spark):
    return windows.latest(t("events").select("user_id", "event_type", "event_id", "ts"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT event_id, CASE event_type WHEN 'signup' THEN 0.0 WHEN 'view' THEN 33.3 WHEN 'click' THEN 66.7 WHEN 'purchase' THEN 100.0 ELSE 0.0 END::DOUBLE AS progress FROM events")
def stage_progress(t, spark):
    return windows.progress(t("events").select("event_id", F.col("event_type").alias("stage")), ["signup", "view", "click", "purchase"]).select("event_id", "progress")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def ring_buffer(t, spark):
    return windows.newest(t("events"), "ts", "event_id", 1000).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 10000")
def ring_buffer_10000(t, spark):
    return windows.newest(t("events"), "ts", "event_id").select("event_id", "user_id")


@query("SELECT conv_id, count(*) AS n_used, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS context FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) WHERE s <= 3000 GROUP BY 1")
def context_build(t, spark):
    return windows.context(t("conversations"), "conv_id", "turn")


_EDGES = "edges AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _edges(t):
    """Customers and suppliers in their nations, all of them."""
    ends = (("customer", "c", "c_custkey", "c_nationkey"), ("supplier", "s", "s_suppkey", "s_nationkey"))
    a, b = (t(table).select(F.concat(F.lit(kind), key).alias("src"), F.concat(F.lit("n"), nation).alias("dst")) for table, kind, key, nation in ends)
    return a.unionAll(b).distinct()


_BOTH = "both_ AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


@query(f"""
WITH RECURSIVE {_EDGES}, {_BOTH}, reach(node, other) AS (SELECT src, src FROM both_ UNION SELECT r.node, b.dst FROM reach r JOIN both_ b ON b.src = r.other)
SELECT node, min(other) AS component FROM reach GROUP BY 1""")
def connected_components(t, spark):
    return graph.components(_edges(t))


@query(f"""
WITH RECURSIVE {_EDGES}, {_BOTH}, reach(node, other) AS (SELECT src, src FROM both_ UNION SELECT r.node, b.dst FROM reach r JOIN both_ b ON b.src = r.other),
c AS (SELECT node, min(other) AS component FROM reach GROUP BY 1), n AS (SELECT component, count(*) AS n_nodes FROM c GROUP BY 1), e AS (SELECT component, count(*) AS n_edges FROM edges JOIN c ON node = src GROUP BY 1)
SELECT component, n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 6) AS density FROM n JOIN e USING (component) WHERE n_nodes >= 3""")
def clusters(t, spark):
    return graph.clusters(_edges(t))


@query(f"""
WITH {_EDGES}, {_BOTH}, c AS (SELECT 's' || s_suppkey AS id FROM supplier), h AS (
  SELECT id AS centre, id AS node, 0 AS hops FROM c UNION ALL SELECT id, dst, 1 FROM c JOIN both_ ON src = id
  UNION ALL SELECT id, y.dst, 2 FROM c JOIN both_ x ON x.src = id JOIN both_ y ON y.src = x.dst)
SELECT centre, node, CAST(min(hops) AS INTEGER) AS hops FROM h GROUP BY 1, 2""")
def subgraph_2hop(t, spark):
    return graph.neighbourhood(_edges(t), t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id")), 2)


@query(f"""
WITH l AS (SELECT DISTINCT src, dst FROM ({LINKS}) WHERE src <> dst), p AS (
  SELECT src AS s, dst AS e, [src, dst] AS nodes, 1 AS hops FROM l
  UNION ALL SELECT x.src, y.dst, [x.src, x.dst, y.dst], 2 FROM l x JOIN l y ON x.dst = y.src WHERE y.dst <> x.src
  UNION ALL SELECT x.src, z.dst, [x.src, x.dst, y.dst, z.dst], 3 FROM l x JOIN l y ON x.dst = y.src JOIN l z ON y.dst = z.src WHERE y.dst <> x.src AND z.dst NOT IN (x.src, x.dst))
SELECT s AS "start", e AS "end", array_to_string(nodes, '>') AS path, CAST(hops AS INTEGER) AS hops FROM p""")
def paths_3hop(t, spark):
    links = rows(t, spark, LINKS)
    return graph.simple_paths(links, links.select(F.col("src").alias("id")).distinct())


@query(f"""
WITH {_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT id, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d""")
def degree_centrality(t, spark):
    return graph.centrality(_edges(t))


@query(f"""
WITH l AS (SELECT src, dst, type, CAST(confidence AS DOUBLE) AS c FROM ({LINKS})), n AS (
  SELECT x.src, y.dst, 'is_a' AS type, x.c * y.c * 0.9 AS c FROM l x JOIN l y ON x.dst = y.src WHERE x.type = 'is_a' AND y.type = 'is_a' AND x.src <> y.dst
  UNION ALL SELECT dst, src, CASE type WHEN 'part_of' THEN 'has_part' ELSE 'used_by' END, c * 0.95 FROM l WHERE type IN ('part_of', 'uses'))
SELECT src, dst, type, round(max(c), 6) AS confidence FROM n WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = n.src AND l.dst = n.dst AND l.type = n.type) GROUP BY ALL""")
def transitive_inference(t, spark):
    return graph.inferred(rows(t, spark, LINKS).withColumn("confidence", F.col("confidence").cast("double")))


@query(f"""
WITH l AS (SELECT src, dst, CAST(confidence AS DOUBLE) AS c FROM ({LINKS}))
SELECT x.src, y.dst, round(least(max(x.c * y.c), 1), 6) AS score FROM l x JOIN l y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM l WHERE l.src = x.src AND l.dst = y.dst) GROUP BY ALL""")
def link_suggestions(t, spark):
    return graph.suggestions(rows(t, spark, LINKS).withColumn("confidence", F.col("confidence").cast("double")))


def _all_links(t):
    """Edges as often as they occur."""
    return t("lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))


def _all_edges(t):
    return _all_links(t).distinct()


_ALL_EDGES = "edges AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"


# recursion over the whole table is too slow in SQL, so these two have none
@query()
def connected_components_all(t, spark):
    return graph.components(_all_links(t))


@query()
def clusters_all(t, spark):
    return graph.clusters(_all_links(t))


@query(f"""
WITH {_ALL_EDGES}, {_BOTH}, c AS (SELECT DISTINCT src AS id FROM edges), h AS (
  SELECT id AS centre, id AS node, 0 AS hops FROM c UNION ALL SELECT id, dst, 1 FROM c JOIN both_ ON src = id
  UNION ALL SELECT id, y.dst, 2 FROM c JOIN both_ x ON x.src = id JOIN both_ y ON y.src = x.dst)
SELECT centre, node, CAST(min(hops) AS INTEGER) AS hops FROM h GROUP BY 1, 2""")
def subgraph_2hop_all(t, spark):
    return graph.neighbourhood(_all_links(t), _all_links(t).select(F.col("src").alias("id")), 2)


@query(f"""
WITH {_ALL_EDGES}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)
SELECT id, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d""")
def degree_centrality_all(t, spark):
    return graph.centrality(_all_edges(t))


def _orders_graph(t):
    """Orders placed by customers, customers in nations, nations in regions."""
    parts = (("orders", "o", "o_orderkey", "c", "o_custkey", "placed_by", 0.9), ("customer", "c", "c_custkey", "n", "c_nationkey", "in", 0.8), ("nation", "n", "n_nationkey", "r", "n_regionkey", "in", 1.0))
    links = [t(table).select(F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(kind).alias("type"), F.lit(c).alias("confidence")) for table, a, x, b, y, kind, c in parts]
    return links[0].unionAll(links[1]).unionAll(links[2])


_ORDERS_GRAPH = """l AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst, 'placed_by' AS type, 0.9::DOUBLE AS c FROM orders
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'in', 0.8 FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'in', 1.0 FROM nation)"""


@query(f"""
WITH {_ORDERS_GRAPH}
SELECT src AS "start", dst AS "end", src || '>' || dst AS path, 1 AS hops FROM l
UNION ALL SELECT x.src, y.dst, x.src || '>' || y.src || '>' || y.dst, 2 FROM l x JOIN l y ON x.dst = y.src
UNION ALL SELECT x.src, z.dst, x.src || '>' || y.src || '>' || z.src || '>' || z.dst, 3 FROM l x JOIN l y ON x.dst = y.src JOIN l z ON y.dst = z.src""")
def paths_3hop_orders(t, spark):
    links = _orders_graph(t)
    return graph.simple_paths(links, links.select(F.col("src").alias("id")).distinct())


@query(f"""
WITH {_ORDERS_GRAPH}
SELECT x.src, y.dst, 'in' AS type, round(x.c * y.c * 0.9, 6) AS confidence FROM l x JOIN l y ON x.dst = y.src WHERE x.type = 'in' AND y.type = 'in'
UNION ALL SELECT dst, src, 'placed', round(c * 0.95, 6) FROM l WHERE type = 'placed_by'""")
def transitive_inference_orders(t, spark):
    return graph.inferred(_orders_graph(t), "in", {"placed_by": "placed"})


@query(f"""
WITH {_ORDERS_GRAPH}
SELECT x.src, y.dst, round(max(x.c * y.c), 6) AS score FROM l x JOIN l y ON x.dst = y.src GROUP BY ALL""")
def link_suggestions_orders(t, spark):
    return graph.suggestions(_orders_graph(t))


@query("SELECT lower(event_type) AS key, CAST(user_id AS VARCHAR) AS type, count(*) AS freq, max(value) AS confidence, max_by(props, (ts, props)) AS metadata FROM events GROUP BY 1, 2")
def entity_upsert(t, spark):
    return graph.upsert(t("events").select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("type"), F.col("value").alias("confidence"), F.col("props").alias("metadata"), F.col("ts").alias("at")))


@query(f"""
WITH s AS (SELECT document_id, status, CAST(confidence AS DOUBLE) AS c FROM ({STEPS})),
a AS (SELECT document_id, count(*) FILTER (status <> 'SKIPPED') AS n, count(*) FILTER (status = 'FAILED') AS failed, count(*) FILTER (status = 'WARNING') AS warnings, count(*) FILTER (status = 'PASSED') AS passed, avg(c) FILTER (status <> 'SKIPPED') AS m FROM s GROUP BY 1),
b AS (SELECT *, CASE WHEN n = 0 THEN 0.5 ELSE round(least(greatest(0.6 * failed / n + 0.2 * warnings / n + 0.2 * (1 - m), 0), 1), 4) END::DOUBLE AS fraud_score FROM a)
SELECT document_id, fraud_score, CASE WHEN failed > 0 OR fraud_score > 0.5 THEN 'RED' WHEN warnings > 0 OR fraud_score > 0.2 THEN 'YELLOW' ELSE 'GREEN' END AS badge, round(coalesce(m, 0), 4) AS confidence, passed, failed, warnings FROM b""")
def verification_score(t, spark):
    return scores.verification(rows(t, spark, STEPS))


@query(f"""
WITH i AS ({ISSUES}) SELECT case_id, 100.0::DOUBLE - least(100, sum(CASE upper(severity) WHEN 'MINOR' THEN 3 WHEN 'MAJOR' THEN 15 ELSE 8 END))::DOUBLE AS consistency FROM i GROUP BY 1""")
def consistency_score(t, spark):
    return scores.consistency(rows(t, spark, ISSUES))


@query(f"""
WITH c AS (SELECT case_id, count(*) FILTER (upper(severity) = 'MAJOR') AS major, count(*) FILTER (upper(severity) = 'MODERATE') AS moderate, count(*) FILTER (upper(severity) = 'MINOR') AS minor FROM ({ISSUES}) GROUP BY 1)
SELECT *, CASE WHEN major > 0 THEN 'MAJOR_ISSUES' WHEN moderate > 0 THEN 'REVIEW_REQUIRED' WHEN minor > 0 THEN 'MINOR_VARIATIONS' ELSE 'CONSISTENT' END AS status FROM c""")
def severity_report(t, spark):
    return scores.severity_report(rows(t, spark, ISSUES))


@query("""
WITH c AS (SELECT source AS case_id, 100.0 * count(l.doc_id) / count(*) AS completeness, 100.0 * avg(coalesce(1 - l.toxic, 1)) AS consistency, 100.0 * avg(coalesce(l.quality, 0)) AS confidence FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1),
r AS (SELECT case_id, round(0.4 * completeness + 0.3 * consistency + 0.3 * confidence, 1) AS readiness FROM c)
SELECT case_id, readiness, CASE WHEN readiness >= 90 THEN 'READY_FOR_REVIEW' WHEN readiness >= 75 THEN 'MOSTLY_READY' WHEN readiness >= 60 THEN 'NEEDS_ATTENTION' WHEN readiness >= 40 THEN 'SIGNIFICANT_ISSUES' ELSE 'NOT_READY' END AS level FROM r""")
def readiness_score(t, spark):
    both = t("documents").select("doc_id", "source").join(t("labels").withColumn("has", F.lit(1)), "doc_id", "left")
    cases = both.groupBy(F.col("source").alias("case_id")).agg((100.0 * F.count("has") / F.count("*")).alias("completeness"), (100.0 * F.avg(F.coalesce(1 - F.col("toxic"), F.lit(1)))).alias("consistency"), (100.0 * F.avg(F.coalesce("quality", F.lit(0)))).alias("confidence"))
    return scores.readiness(cases).select("case_id", "readiness", "level")


@query(f"SELECT item_id, CASE WHEN confidence < 0.7 THEN 'HIGH' WHEN confidence < 0.9 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM ({ITEMS}) WHERE confidence < 1")
def pending_reviews(t, spark):
    return scores.review_queue(rows(t, spark, ITEMS)).select("item_id", "priority")


@query("""
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL)
SELECT user_id, round(sum(value / r) / sum(1 / r), 6) AS confidence FROM r WHERE r <= 5 GROUP BY 1""")
def rank_weighted_confidence(t, spark):
    return scores.rank_weighted(t("events"), "user_id", "value", "event_id")


@query("SELECT user_id, count(ts) AS n_events, min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last, CASE WHEN count(ts) >= 2 THEN CAST(date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) AS INTEGER) END AS days FROM events GROUP BY 1")
def timeline_span(t, spark):
    return scores.timeline_span(t("events"), "user_id", "ts")


@query("SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def type_histogram(t, spark):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'license') OR contains(lower(source), 'license')")
def doc_search_like(t, spark):
    return filters.searched(t("documents"), "LICENSE", ["text", "source"]).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id DESC LIMIT 50 OFFSET 10")
def doc_list(t, spark):
    return filters.listed(t("documents"), {"lang": "de", "source": None}, limit=50, offset=10).select("doc_id")


_HOSTILE = "(?i)" + "|".join(filters.HOSTILE)


@query(f"""
WITH i AS ({_lit(INPUTS)}) SELECT 'input' AS kind, CAST(id AS BIGINT) AS id, coalesce(regexp_matches(value, '{_HOSTILE}'), false) AS hostile FROM i
UNION ALL SELECT 'page', page_id, coalesce(regexp_matches(html, '{_HOSTILE}'), false) FROM pages""")
def malicious_input(t, spark):
    held = spark.sql(INPUTS).select(F.lit("input").alias("kind"), F.col("id").cast("long").alias("id"), "value").unionAll(t("pages").select(F.lit("page").alias("kind"), "page_id", "html"))
    return held.select("kind", "id", filters.hostile(F.col("value")).alias("hostile"))


@query(f"SELECT user_id, EXISTS (SELECT 1 FROM ({GRANTS}) g WHERE g.role = u.role AND g.permission = u.permission) AS allowed FROM ({USERS}) u")
def permission_check(t, spark):
    return filters.permitted(rows(t, spark, USERS), spark.sql(GRANTS)).select("user_id", "allowed")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def insert_if_absent(t, spark):
    return filters.absent(t("customer").select("c_custkey"), t("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT event_id FROM events WHERE TIMESTAMP '2024-01-15 00:00:00' - date_trunc('second', ts) <= INTERVAL 1800 SECOND AND ts < TIMESTAMP '2024-01-15 00:00:00'")
def staging_ttl(t, spark):
    return filters.unexpired(t("events").where("ts < timestamp_ntz'2024-01-15 00:00:00'"), "2024-01-15 00:00:00", created="ts").select("event_id")


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '([a-z])-\n([a-z])', '\1\2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' {2,}', ' ', 'g'), ' ')) AS cleaned FROM documents""")
def preprocess_text(t, spark):
    return t("documents").select("doc_id", F.sha2(text.clean(F.col("text")), 256).alias("cleaned"))


@query(rf"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{text.NUMERIC_DATE}')) AS n_dates, array_to_string(regexp_extract_all(coalesce(text, ''), '{text.EMAIL}'), ' ') AS emails, len(regexp_extract_all(coalesce(text, ''), '{text.PHONE}')) AS n_phones FROM documents")
def contact_extract(t, spark):
    d = F.col("text")
    return t("documents").select("doc_id", F.size(text.found(d, text.NUMERIC_DATE)).cast("long").alias("n_dates"), F.array_join(text.found(d, text.EMAIL), " ").alias("emails"), F.size(text.found(d, text.PHONE)).cast("long").alias("n_phones"))


@query()
def extracted_items(t, spark):
    return extracts.extracted(t("documents").select("doc_id", "text").unionAll(spark.sql(NOTICES)))


@query(f"SELECT doc_id, len({TOKENS}) AS n_words, CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE round(length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) / length(text), 6) END::DOUBLE AS letter_share FROM documents")
def text_quality(t, spark):
    return t("documents").select("doc_id", text.word_count(F.col("text")).alias("n_words"), F.round(text.letter_share(F.col("text")), 6).alias("letter_share"))


_INTENTS = "CASE " + " ".join(f"WHEN regexp_matches(lower(trim(question)), '{p}') THEN '{n}'" for n, p in text.INTENTS) + " ELSE 'general' END"


@query(f"SELECT 'question' AS kind, CAST(id AS BIGINT) AS id, {_INTENTS} AS intent FROM ({QUESTIONS}) UNION ALL SELECT role, conv_id * 1000 + turn, {_INTENTS} FROM (SELECT *, text AS question FROM conversations)")
def intent_class(t, spark):
    turns = t("conversations").select(F.col("role").alias("kind"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("question"))
    held = spark.sql(QUESTIONS).select(F.lit("question").alias("kind"), F.col("id").cast("long").alias("id"), "question").unionAll(turns)
    return held.select("kind", "id", text.intent(F.col("question")).alias("intent"))


_TITLE = r"(?i)\b(Mr|Mrs|Ms|Dr|Prof|Sir|Madam)\.?\b"
_ALIASES = "CASE f " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in text.FIELD_ALIASES.items()) + " ELSE f END"
_TYPES = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(field), '{w}')" for w in words) + f" THEN '{name}'" for name, words in text.FIELD_TYPES) + " ELSE 'string' END"


@query(rf"""
WITH p AS (SELECT *, regexp_replace(lower(trim(field)), ' +', '_', 'g') AS f, trim(regexp_replace(regexp_replace(name, '{_TITLE}', '', 'g'), ' +', ' ', 'g')) AS bare FROM ({_lit(PEOPLE)}))
SELECT id, right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) AS phone, trim(regexp_replace(lower(address), ' +', ' ', 'g')) AS address, CAST(coalesce(try_strptime(dated, '%Y-%m-%d'), try_strptime(dated, '%d/%m/%Y')) AS DATE) AS dated,
  {_ALIASES} AS field, {_TYPES} AS type, array_to_string(list_transform(string_split(bare, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS name FROM p""")
def normalisers(t, spark):
    c = F.col
    return rows(t, spark, PEOPLE).select("id", text.normal_phone(c("phone")).alias("phone"), text.normal_address(c("address")).alias("address"), text.parsed_date(c("dated")).alias("dated"), text.alias(c("field")).alias("field"), text.field_type(c("field")).alias("type"), text.normal_name(c("name")).alias("name"))


@query("SELECT doc_id, i AS chunk, substr(text, i * 1000 + 1, 1000) AS text FROM (SELECT doc_id, text, unnest(range(0, CAST(ceil(length(text) / 1000) AS BIGINT))) AS i FROM documents)")
def forced_chunks(t, spark):
    return t("documents").select("doc_id", F.posexplode(text.slices(F.col("text"), 1000)).alias("chunk", "text"))


@query()
def character_chunks(t, spark):
    return chunks.chunked(t("documents"), "characters")


@query()
def sentence_chunks(t, spark):
    return chunks.chunked(t("documents"), "sentences")


@query()
def paragraph_chunks(t, spark):
    return chunks.chunked(t("documents"), "paragraphs")


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 5000 THEN 'whole' WHEN length(text) < 10000 THEN 'paragraphs' ELSE 'characters' END AS strategy FROM documents")
def chunk_strategy(t, spark):
    return t("documents").select("doc_id", chunks.strategy(F.col("text")).alias("strategy"))


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS number FROM orders")
def sequence_numbers(t, spark):
    graph.checkpoint_dir(spark)
    return windows.numbered(t("orders").select("o_orderstatus", "o_orderkey"), "o_orderstatus", "o_orderkey").select("o_orderkey", "number")


@query(f"SELECT id, CASE WHEN cosine >= 0.98 THEN 'EXACT' WHEN cosine >= 0.90 THEN 'LIKELY' WHEN cosine IS NOT NULL THEN 'POSSIBLE' END AS label FROM ({_lit(COSINES)})")
def duplicate_labels(t, spark):
    return rows(t, spark, COSINES).select("id", scores.duplicate_label(F.col("cosine")).alias("label"))


@query(f"SELECT user_id, type, coalesce(action = 'grant', false) AS granted FROM (SELECT *, row_number() OVER (PARTITION BY user_id, type ORDER BY decided DESC, record_id DESC) AS r FROM ({_lit(CONSENTS)})) WHERE r = 1")
def consent_ledger(t, spark):
    return scores.consents(rows(t, spark, CONSENTS))
