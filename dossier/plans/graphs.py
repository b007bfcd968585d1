"""Knowledge graphs: building, lookups, clusters, rankings, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..registry import duck, query

NODES = "SELECT id, name, type, confidence, freq, CASE WHEN k = '' THEN CAST(map() AS MAP<STRING, STRING>) ELSE map(k, v) END AS metadata FROM (VALUES ('a', 'Asha Rao', 'citizen', 0.9D, 4, 'issue_date', '2024-01-02'), ('b', 'Deed of Ulm', 'document', 0.8D, 1, 'source', 'Ulm archive'), ('c', 'Roads Department', 'department', 0.95D, 9, 'created_at', '2023-05-06'), ('d', 'Otto Lind', 'officer', 0.7D, 2, '', ''), ('e', 'Case 12', 'case', 0.6D, 1, 'filing_date', '2022-02-02'), ('f', 'Asha', 'citizen', 0.5D, 7, '', ''), ('g', 'Plan', 'document', 0.5D, 1, '', '')) AS t(id, name, type, confidence, freq, k, v)"
LINKS = "SELECT src, dst, type, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('a', 'b', 'owns', 0.9), ('b', 'c', 'issued_by', 0.8), ('d', 'c', 'belongs_to', 1.0), ('c', 'e', 'handles', 0.5), ('a', 'f', 'related_to', 0.4), ('g', 'c', 'issued_by', 0.7), ('b', 'd', 'handled_by', 0.6), ('z', 'a', 'owns', 0.3)) AS t(src, dst, type, confidence)"
#: The nodes as DuckDB reads them.
D_NODES = "SELECT * FROM (VALUES ('a', 'Asha Rao', 'citizen', 0.9, 4, 'issue_date', '2024-01-02'), ('b', 'Deed of Ulm', 'document', 0.8, 1, 'source', 'Ulm archive'), ('c', 'Roads Department', 'department', 0.95, 9, 'created_at', '2023-05-06'), ('d', 'Otto Lind', 'officer', 0.7, 2, '', ''), ('e', 'Case 12', 'case', 0.6, 1, 'filing_date', '2022-02-02'), ('f', 'Asha', 'citizen', 0.5, 7, '', ''), ('g', 'Plan', 'document', 0.5, 1, '', '')) AS t(id, name, type, confidence, freq, k, v)"
# customers are citizens that live in nations, to whose officers the suppliers' departments belong; the literal rows are boundary cases
D_NODES += """ UNION ALL SELECT 'c' || c_custkey, c_name, 'citizen', 0.5 + (c_custkey % 50) / 100.0, c_nationkey, 'issue_date', '2024-01-' || (10 + c_custkey % 20) FROM customer
UNION ALL SELECT 's' || s_suppkey, s_name, 'department', 0.8, s_nationkey, '', '' FROM supplier UNION ALL SELECT 'n' || n_nationkey, n_name, 'officer', 0.6, n_regionkey, 'source', 'region ' || n_regionkey FROM nation"""
D_LINKS = LINKS + """ UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'lives_in', 0.9 FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'belongs_to', 1.0 FROM supplier
UNION ALL SELECT 'c' || c_custkey, 's' || s_suppkey, 'related_to', 0.4 FROM customer JOIN supplier ON s_suppkey = c_custkey"""


def _nodes(t, spark):
    pair = lambda k, v: F.create_map(F.lit(k), v)
    row = lambda df, id_, name, kind, sure, freq, held: df.select(F.concat(F.lit(id_[0]), id_[1:]).alias("id"), F.col(name).alias("name"), F.lit(kind).alias("type"), sure.cast("double").alias("confidence"), F.col(freq).cast("int").alias("freq"), held.alias("metadata"))
    customers = row(t("customer"), "cc_custkey", "c_name", "citizen", 0.5 + (F.col("c_custkey") % 50) / 100.0, "c_nationkey", pair("issue_date", F.concat(F.lit("2024-01-"), 10 + F.col("c_custkey") % 20)))
    suppliers = row(t("supplier"), "ss_suppkey", "s_name", "department", F.lit(0.8), "s_nationkey", F.create_map().cast("map<string,string>"))
    nations = row(t("nation"), "nn_nationkey", "n_name", "officer", F.lit(0.6), "n_regionkey", pair("source", F.concat(F.lit("region "), "n_regionkey")))
    return spark.sql(NODES).unionByName(customers).unionByName(suppliers).unionByName(nations)


def _links(t, spark):
    link = lambda df, src, dst, kind, sure: df.select(F.concat(F.lit(src[0]), src[1:]).alias("src"), F.concat(F.lit(dst[0]), dst[1:]).alias("dst"), F.lit(kind).alias("type"), F.lit(sure).cast("double").alias("confidence"))
    both = t("customer").join(t("supplier"), F.col("s_suppkey") == F.col("c_custkey"))
    out = spark.sql(LINKS).unionByName(link(t("customer"), "cc_custkey", "nc_nationkey", "lives_in", 0.9))
    return out.unionByName(link(t("supplier"), "ns_nationkey", "ss_suppkey", "belongs_to", 1.0)).unionByName(link(both, "cc_custkey", "ss_suppkey", "related_to", 0.4))


_TRADE = "edges AS (SELECT DISTINCT 'c' || o_custkey AS src, 'p' || l_partkey AS dst, l_returnflag AS type FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
_ENDS = "ends AS (SELECT unnest([src, dst]) AS id FROM edges)"


def _trade(t):
    """Customers and the parts that they ordered."""
    return t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.col("l_returnflag").alias("type")).distinct()


@query(f"WITH {_TRADE} SELECT type, count(*) AS n FROM edges GROUP BY 1")
def edge_histogram(t, spark):
    return graph.type_counts(_trade(t))


@query(f"WITH {_TRADE}, {_ENDS}, d AS (SELECT id, count(*) AS degree FROM ends GROUP BY 1) SELECT id, degree, round(degree / ((SELECT count(*) FROM d) - 1), 6) AS centrality FROM d ORDER BY degree DESC, id LIMIT 20")
def top_nodes(t, spark):
    return graph.top_by_degree(_trade(t), 20)


@query(f"WITH {_TRADE}, {_ENDS}, d AS (SELECT id, count(*) AS degree FROM ends GROUP BY 1) SELECT id, id AS name, substr(id, 1, 1) AS type, CASE substr(id, 1, 1) WHEN 'c' THEN '#111111' ELSE '#6b7280' END AS colour, CAST(5 + least(10, degree) AS INTEGER) AS size FROM d")
def coloured_nodes(t, spark):
    ids = _trade(t).select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return graph.coloured(ids.select("id", F.col("id").alias("name"), F.substring("id", 1, 1).alias("type")), _trade(t), {"c": "#111111", "Other": "#6b7280"})


@query(f"SELECT src AS source, dst AS target, type, replace(type, '_', ' ') AS label FROM ({D_LINKS})")
def labelled_edges(t, spark):
    return graph.labelled(_links(t, spark))


# triangles and recursion over all lineitems are too slow in SQL; tests compare with plain Python
@query()
def clustering_all(t, spark):
    return graph.clustering(t("lineitem").select(F.concat(F.lit("n"), F.col("l_suppkey") % 97).alias("src"), F.concat(F.lit("n"), F.col("l_partkey") % 97).alias("dst")))


_SMALL = "edges AS (SELECT DISTINCT 'n' || (l_suppkey % 40) AS src, 'n' || (l_partkey % 40) AS dst FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40)"


@query(f"""WITH {_SMALL}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), d AS (SELECT src AS id, count(*) AS degree FROM u GROUP BY 1),
w AS (SELECT x.src AS id, count(*) AS n FROM u x JOIN u y ON x.src = y.src AND x.dst < y.dst JOIN u z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1)
SELECT id, degree, coalesce(n, 0) AS triangles, round(coalesce(2.0 * coalesce(n, 0) / nullif(degree * (degree - 1), 0), 0), 6)::DOUBLE AS coefficient FROM d LEFT JOIN w USING (id)""")
def clustering_folded(t, spark):
    return graph.clustering(t("lineitem").select(F.concat(F.lit("n"), F.col("l_suppkey") % 40).alias("src"), F.concat(F.lit("n"), F.col("l_partkey") % 40).alias("dst")))




RING = "SELECT * FROM (VALUES ('p', 'citizen'), ('q1', 'document'), ('q2', 'document'), ('q3', 'document'), ('q4', 'document'), ('q5', 'document'), ('r1', 'case'), ('r2', 'case'), ('r3', 'case'), ('s1', 'department'), ('s2', 'department'), ('s3', 'department'), ('t1', 'x'), ('t2', 'x'), ('t3', 'x')) AS t(id, type)"
D_RING = RING + " UNION ALL SELECT 'c' || c_custkey, 'citizen' FROM customer UNION ALL SELECT 'o' || o_orderkey, 'document' FROM orders"
RING_LINKS = "SELECT * FROM (VALUES ('p', 'q1'), ('p', 'q2'), ('p', 'q3'), ('p', 'q4'), ('p', 'q5'), ('r1', 'r2'), ('r2', 'r3'), ('r3', 's1'), ('s1', 's2'), ('s2', 's3'), ('t1', 't2'), ('t2', 't3'), ('t3', 't1'), ('t2', 't1')) AS t(src, dst)"


D_RING_LINKS = RING_LINKS + " UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders"


@query(f"""WITH RECURSIVE l AS ({D_RING_LINKS}), b AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), r(node, other) AS (SELECT src, src FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.other),
c AS (SELECT node, min(other) AS component FROM r GROUP BY 1), k AS (SELECT component, count(*) AS n_nodes, count(*) FILTER (type = 'citizen') = 1 AND count(*) FILTER (type = 'document') >= 5 AS one, count(*) FILTER (type = 'case') >= 3 AS two, count(*) FILTER (type = 'department') >= 3 AS three FROM c JOIN ({D_RING}) ON id = node GROUP BY 1),
e AS (SELECT component, count(*) AS m FROM l JOIN c ON node = src GROUP BY 1), f AS (SELECT *, round(m / (n_nodes * (n_nodes - 1)), 6) AS density FROM k JOIN e USING (component)),
g AS (SELECT component, n_nodes, density, round(CASE WHEN one THEN 0.3 ELSE 0 END + CASE WHEN two THEN 0.2 ELSE 0 END + CASE WHEN three THEN 0.1 ELSE 0 END + CASE WHEN density > 0.5 THEN 0.2 ELSE 0 END, 3)::DOUBLE AS risk, concat_ws('; ', CASE WHEN one THEN 'Single citizen with many documents' END, CASE WHEN two THEN 'Multiple cases in cluster' END, CASE WHEN three THEN 'Cross-department connections' END, CASE WHEN density > 0.5 THEN 'Dense cluster' END) AS indicators FROM f) SELECT * FROM g WHERE risk > 0.1""")
def fraud_clusters(t, spark):
    people = t("customer").select(F.concat(F.lit("c"), "c_custkey"), F.lit("citizen")).union(t("orders").select(F.concat(F.lit("o"), "o_orderkey"), F.lit("document")))
    return graph.fraud_clusters(spark.sql(RING).union(people), spark.sql(RING_LINKS).union(t("orders").select(F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("o"), "o_orderkey"))))


@query(f"""WITH l AS ({D_LINKS}), d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM l UNION ALL SELECT dst FROM l) GROUP BY 1)
SELECT n.id, name, round(0.6 * coalesce(degree / (SELECT max(degree) FROM d), 0) + 0.3 * least(1, freq / 5) + 0.1 * CAST(confidence AS DOUBLE), 6)::DOUBLE AS importance FROM ({D_NODES}) n LEFT JOIN d USING (id) ORDER BY importance DESC, id LIMIT 5""")
def key_entities(t, spark):
    return graph.key_entities(_nodes(t, spark), _links(t, spark), 5)


@query(f"SELECT id FROM ({D_NODES}) WHERE confidence >= 0.4 AND (contains(lower(name), 'region 1') OR contains(lower(v), 'region 1')) ORDER BY confidence DESC, freq DESC, id LIMIT 10")
def entity_search(t, spark):
    return graph.search(_nodes(t, spark), "REGION 1", least=0.4).select("id")


WANTED = "SELECT * FROM (VALUES ('asha'), ('ASHA RAO '), ('rao'), ('a'), ('none')) AS t(asked)"
D_WANTED = WANTED + " UNION ALL SELECT upper(c_name) FROM customer UNION ALL SELECT substr(n_name, 2) FROM nation UNION ALL SELECT substr(s_name, 3) FROM supplier"


def _wanted(t, spark):
    return spark.sql(WANTED).union(t("customer").select(F.upper("c_name"))).union(t("nation").select(F.substring("n_name", 2, 99))).union(t("supplier").select(F.substring("s_name", 3, 99)))


@query(f"""WITH w AS (SELECT asked, lower(trim(asked)) AS low FROM ({D_WANTED})), m AS (SELECT asked, id, name, lower(name) = low AS exact FROM w JOIN ({D_NODES}) ON contains(lower(name), low))
SELECT asked, id, name FROM m QUALIFY row_number() OVER (PARTITION BY asked ORDER BY exact DESC, length(name), id) = 1""")
def entity_lookup(t, spark):
    return graph.lookup(_nodes(t, spark), _wanted(t, spark))


@query(f"""WITH e AS (SELECT src AS id, type, 'outgoing' AS direction, dst AS other FROM ({D_LINKS}) UNION ALL SELECT dst, type, 'incoming', src FROM ({D_LINKS}))
SELECT e.id, e.type, direction, count(*) AS n, string_agg(DISTINCT coalesce(name, other), '; ' ORDER BY coalesce(name, other)) AS names FROM e LEFT JOIN ({D_NODES}) n ON n.id = other GROUP BY 1, 2, 3""")
def entity_connections(t, spark):
    return graph.connections(_nodes(t, spark), _links(t, spark))


@query(f"SELECT id, name, type FROM ({D_NODES}) UNION ALL SELECT x, 'Unknown-' || x, 'Unknown' FROM (SELECT src AS x FROM ({D_LINKS}) UNION SELECT dst FROM ({D_LINKS})) WHERE x NOT IN (SELECT id FROM ({D_NODES}))")
def unknown_ends(t, spark):
    return graph.with_ends(_nodes(t, spark), _links(t, spark))


@query("SELECT user_id AS id, max_by(event_type, (ts, event_type)) AS type, max_by(props, (ts, event_type)) AS properties FROM events GROUP BY 1")
def node_store(t, spark):
    return graph.last_written(t("events").select(F.col("user_id").alias("id"), F.col("event_type").alias("type"), F.col("props").alias("properties"), F.col("ts").alias("at")))


FIELDS = "SELECT * FROM (VALUES ('d1', 'full_name', 'Asha Rao', 0.9), ('d1', 'court_name', 'High Court', 0.5), ('d1', 'issue_date', '1/1/2024', 0.4999), ('d2', 'odd', 'x', 1.0), ('d2', 'document_number', '', 0.9), ('d2', 'case_number', 'AB/1', 0.8)) AS t(document_id, field, value, confidence)"
D_FIELDS = FIELDS + """ UNION ALL SELECT 'c' || c_custkey, 'full_name', c_name, c_nationkey / 25.0 FROM customer UNION ALL SELECT 'o' || o_orderkey, 'issue_date', CAST(CAST(o_orderdate AS DATE) AS VARCHAR), 0.7 FROM orders UNION ALL SELECT 's' || s_suppkey, 'department', s_name, 0.5 FROM supplier"""
_ENTITY = "CASE field " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in graph.FIELD_VERTICES.items()) + " END"
_RELATION = "CASE field " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in graph.FIELD_VERTICES.items()) + " END"


@query(f"SELECT document_id AS src, replace({_ENTITY} || '_' || value, ' ', '_') AS dst, {_RELATION} AS type, {_ENTITY} AS entity_type, CAST(confidence AS DOUBLE) AS confidence FROM ({D_FIELDS}) WHERE confidence >= 0.5 AND value <> '' AND {_ENTITY} IS NOT NULL")
def populated_graph(t, spark):
    row = lambda df, id_, field, value, sure: df.select(F.concat(F.lit(id_[0]), id_[1:]).alias("document_id"), F.lit(field).alias("field"), value.alias("value"), sure.cast("double").alias("confidence"))
    rows = spark.sql(FIELDS).withColumn("confidence", F.col("confidence").cast("double")).unionByName(row(t("customer"), "cc_custkey", "full_name", F.col("c_name"), F.col("c_nationkey") / 25.0))
    rows = rows.unionByName(row(t("orders"), "oo_orderkey", "issue_date", F.col("o_orderdate").cast("date").cast("string"), F.lit(0.7))).unionByName(row(t("supplier"), "ss_suppkey", "department", F.col("s_name"), F.lit(0.5)))
    return graph.populated(rows)


INGESTED = "SELECT * FROM (VALUES (1, 'Deed', 'Asha Rao'), (2, 'Plan', ''), (3, 'Map', 'asha rao')) AS t(document_id, name, owner)"
D_INGESTED = INGESTED + " UNION ALL SELECT CAST(1000 + o_orderkey AS INTEGER), 'Order ' || o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey"
PROFILES = "SELECT * FROM (VALUES (1, 'officer', 'Otto Lind'), (1, 'department', 'Roads'), (2, 'department', 'roads'), (2, 'court', 'High Court'), (2, 'citizen', 'Bo Chan'), (3, 'institution', '')) AS t(document_id, type, name)"
D_PROFILES = PROFILES + " UNION ALL SELECT CAST(1000 + l_orderkey AS INTEGER), CASE l_linenumber % 3 WHEN 0 THEN 'officer' WHEN 1 THEN 'department' ELSE 'court' END, s_name FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"


def _ingested(t, spark):
    docs = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select((1000 + F.col("o_orderkey")).cast("int"), F.concat(F.lit("Order "), "o_orderkey"), "c_name")
    kind = F.when(F.col("l_linenumber") % 3 == 0, "officer").when(F.col("l_linenumber") % 3 == 1, "department").otherwise("court")
    people = t("lineitem").join(t("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).select((1000 + F.col("l_orderkey")).cast("int"), kind, "s_name")
    return graph.ingested(spark.sql(INGESTED).union(docs), spark.sql(PROFILES).union(people))


@query(f"""SELECT 'citizen:' || lower(owner) AS src, 'document:' || document_id AS dst, 'owns' AS type FROM ({D_INGESTED}) WHERE owner <> ''
UNION SELECT 'document:' || document_id, type || ':' || lower(name), CASE type WHEN 'officer' THEN 'handled_by' ELSE 'issued_by' END FROM ({D_PROFILES}) WHERE name <> '' AND type IN ('officer', 'department')""")
def ingested_edges(t, spark):
    return _ingested(t, spark)[1]


@query(f"""WITH v AS (SELECT 'document:' || document_id AS id, name, 'document' AS type FROM ({D_INGESTED}) UNION ALL SELECT 'citizen:' || lower(owner), owner, 'citizen' FROM ({D_INGESTED}) WHERE owner <> '' UNION ALL SELECT CASE type WHEN 'court' THEN 'institution' ELSE type END || ':' || lower(name), name, CASE type WHEN 'court' THEN 'institution' ELSE type END FROM ({D_PROFILES}) WHERE name <> '')
SELECT id, min(name) AS name, type FROM v GROUP BY id, type""")
def ingested_vertices(t, spark):
    return _ingested(t, spark)[0]


@query(f"SELECT v AS date, id, CASE k WHEN 'issue_date' THEN 'Issue Date' WHEN 'created_at' THEN 'Created At' ELSE 'Filing Date' END AS event_type FROM ({D_NODES}) WHERE k IN ('issue_date', 'created_at', 'filing_date')")
def metadata_timeline(t, spark):
    return graph.metadata_timeline(_nodes(t, spark))


@query(f"""WITH l AS ({D_LINKS}), n AS ({D_NODES}) SELECT id, (SELECT count(*) FROM l JOIN n s ON s.id = src WHERE dst = d.id AND s.type = 'officer' AND l.type = 'belongs_to') AS officers, (SELECT count(*) FROM l JOIN n s ON s.id = src WHERE dst = d.id AND s.type = 'document' AND l.type = 'issued_by') AS documents, (SELECT count(*) FROM l JOIN n s ON s.id = dst WHERE src = d.id AND s.type = 'case') AS cases FROM n d WHERE type = 'department'""")
def department_rollup(t, spark):
    return graph.departments(_nodes(t, spark), _links(t, spark))


@query("SELECT term AS id, term AS name, max(score) AS score, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, source AS term, round(n_chars / 20000.0, 6)::DOUBLE AS score FROM documents WHERE source IS NOT NULL) GROUP BY 1 ORDER BY score DESC, id LIMIT 15")
def merged_concepts(t, spark):
    rows = t("documents").where("source is not null").select(F.col("doc_id").alias("document_id"), F.col("source").alias("id"), F.col("source").alias("name"), F.round(F.col("n_chars") / 20000.0, 6).alias("score"))
    return graph.merged_concepts(rows)


@query("SELECT lang AS name, count(DISTINCT source) AS documents FROM documents WHERE source <> '' GROUP BY 1 HAVING count(DISTINCT source) > 1")
def shared_entities(t, spark):
    return graph.shared_entities(t("documents").select(F.col("lang").alias("name"), "source"))


RANKS = "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 3), ('d', 4), ('g', 5)) AS t(id, rank)"
D_RANKS = RANKS + " UNION ALL SELECT 'c' || c_custkey, c_custkey FROM customer UNION ALL SELECT 's' || s_suppkey, 100000000 + s_suppkey FROM supplier"


@query(f"""WITH l AS ({D_LINKS}), r AS ({D_RANKS}), w AS (SELECT src, dst, type, confidence, 1 AS hops FROM l UNION ALL SELECT x.src, y.dst, x.type, x.confidence, 2 FROM l x JOIN l y ON x.dst = y.src WHERE x.src <> y.dst)
SELECT src AS a, dst AS b, type, confidence, CAST(hops AS INTEGER) AS hops FROM w JOIN r p ON p.id = src JOIN r q ON q.id = dst WHERE p.rank < q.rank QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY hops, confidence DESC, type) = 1 ORDER BY confidence DESC, hops, a, b LIMIT 15""")
def key_relations(t, spark):
    ranks = spark.sql(RANKS).union(t("customer").select(F.concat(F.lit("c"), "c_custkey"), "c_custkey")).union(t("supplier").select(F.concat(F.lit("s"), "s_suppkey"), 100000000 + F.col("s_suppkey")))
    return graph.key_relations(ranks, _links(t, spark))


@query(f"WITH v AS ({D_NODES}), e AS ({D_LINKS}) SELECT 'vertices' AS kind, 'all' AS name, count(*) AS n FROM v UNION ALL SELECT 'vertices', type, count(*) FROM v GROUP BY type UNION ALL SELECT 'edges', 'all', count(*) FROM e UNION ALL SELECT 'edges', type, count(*) FROM e GROUP BY type")
def graph_summary(t, spark):
    return graph.summary(_nodes(t, spark), _links(t, spark))


@query(f"""WITH RECURSIVE l AS (SELECT DISTINCT src, dst FROM ({D_LINKS}) WHERE type <> 'lives_in'), b AS (SELECT src, dst FROM l UNION SELECT dst, src FROM l), r(node, other) AS (SELECT src, src FROM b UNION SELECT r.node, b.dst FROM r JOIN b ON b.src = r.other), n AS (SELECT count(DISTINCT src) AS nodes FROM b)
SELECT nodes, (SELECT count(*) FROM l) AS links, round((SELECT count(*) FROM l) / (nodes * (nodes - 1)), 6) AS density, (SELECT count(DISTINCT low) FROM (SELECT min(other) AS low FROM r GROUP BY node)) AS components FROM n""")
def graph_density(t, spark):
    return graph.density(_links(t, spark).where("type <> 'lives_in'"))
