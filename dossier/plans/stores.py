"""Stored vectors and graphs that change in place, proximity graphs, shortest paths, classes of similar vectors."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tables import checkpoint_dir
from ..operators import compare, paths, proximity, questions, workflows
from ..registry import query
from ..sources.store import GraphStore, Numbers, VectorStore

_COSINE = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))"


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/dossier-{name}-{uuid.uuid4().hex}"


# approximate: a test measures the recall against all rows
@query()
def vector_graph_topk(t, spark):
    vectors = t("embeddings")
    return proximity.proximity_top_k(proximity.proximity_index(vectors), vectors.where("vec_id % 100 = 0"), 5)


@query(f"""WITH held AS (SELECT * FROM embeddings WHERE vec_id % 5 <> 0 OR vec_id % 10 = 0), s AS (
SELECT q.vec_id AS query_id, v.vec_id, round({_COSINE}, 6) AS score FROM embeddings q JOIN held v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def vector_store_search(t, spark):
    """Vectors are added in two segments, some are deleted and some of these added again, the cells compacted, and the rest is searched."""
    vectors = t("embeddings")
    store = VectorStore.create(vectors, _folder(spark, "vectors"), 16)
    store.add(vectors.where("vec_id % 3 = 0"))
    store.add(vectors.where("vec_id % 3 <> 0"))
    store.delete(vectors.where("vec_id % 5 = 0"))
    store.compact()
    store.add(vectors.where("vec_id % 10 = 0"))
    return store.search(vectors.where("vec_id % 100 = 0"), 5)


@query("""SELECT count(*) FILTER (vec_id % 5 <> 0 OR vec_id % 10 = 0) AS held, count(*) FILTER (vec_id % 7 = 0 AND (vec_id % 5 <> 0 OR vec_id % 10 = 0)) AS got FROM embeddings""")
def vector_store_counts(t, spark):
    vectors = t("embeddings")
    store = VectorStore.create(vectors, _folder(spark, "vectors"), 16)
    store.add(vectors)
    store.delete(vectors.where("vec_id % 5 = 0"))
    store.add(vectors.where("vec_id % 10 = 0"))
    copy = store.save(_folder(spark, "copy"))
    got = copy.get(vectors.where("vec_id % 7 = 0"))
    return spark.createDataFrame([(copy.count(), got.count())], "held long, got long")


@query("SELECT lower(event_type) AS key, CAST(user_id AS VARCHAR) AS type, count(*) AS freq, max(value) AS confidence, max_by(props, (ts, props)) AS metadata FROM events GROUP BY 1, 2")
def graph_store_entities(t, spark):
    """Events are merged into a stored graph in four batches, out of order and one twice."""
    events = t("events").select(F.col("event_type").alias("name"), F.col("user_id").cast("string").alias("type"), F.col("value").alias("confidence"), F.col("props").alias("metadata"), F.col("ts").alias("at"), (F.col("event_id") % 4 + 1).alias("batch"))
    store = GraphStore(spark, _folder(spark, "graph"), 16)
    for number in (2, 1, 4, 2, 3):
        store.merge(number, events.where(F.col("batch") == number).drop("batch"))
    return store.load()[0]


@query("SELECT 'n' || c_nationkey AS src, 's' || c_mktsegment AS dst, 'buys' AS type, CAST(max(c_acctbal) AS DOUBLE) AS confidence, count(*) AS n FROM customer GROUP BY 1, 2")
def graph_store_relations(t, spark):
    rows = t("customer").select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("s"), "c_mktsegment").alias("dst"), F.lit("buys").alias("type"), F.col("c_acctbal").alias("confidence"), (F.col("c_custkey") % 3 + 1).alias("batch"))
    store = GraphStore(spark, _folder(spark, "graph"), 16)
    for number in (1, 3, 3, 2):
        store.merge(number, edges=rows.where(F.col("batch") == number).drop("batch"))
    return store.load()[1]


_TRADE = "SELECT DISTINCT 'n' || c_nationkey AS src, 'o' || o_orderpriority || extract(year FROM o_orderdate) AS dst FROM orders JOIN customer ON c_custkey = o_custkey"
_MADE = "SELECT DISTINCT 'o' || o_orderpriority || extract(year FROM o_orderdate) AS src, 's' || l_suppkey AS dst FROM orders JOIN lineitem ON l_orderkey = o_orderkey"
_HOME = "SELECT 's' || s_suppkey AS src, 'm' || s_nationkey AS dst FROM supplier"


def _orders_graph(t):
    year = F.concat(F.lit("o"), "o_orderpriority", F.year("o_orderdate"))
    trade = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.concat(F.lit("n"), "c_nationkey").alias("src"), year.alias("dst"))
    made = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(year.alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    home = t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("m"), "s_nationkey").alias("dst"))
    return trade.union(made).union(home).distinct()


_PAIRS = """SELECT 'n' || c_nationkey AS "start", 's' || s_suppkey AS "end" FROM customer JOIN supplier ON s_suppkey = c_custkey
UNION SELECT 'n' || c_nationkey, 'm' || s_nationkey FROM customer JOIN supplier ON s_suppkey = c_custkey"""


@query(f"""WITH RECURSIVE e AS ({_TRADE} UNION {_MADE} UNION {_HOME}), w(start, node, nodes, hops) AS (
SELECT DISTINCT src, src, [src], 0 FROM e WHERE src LIKE 'n%' UNION ALL SELECT start, dst, list_append(nodes, dst), hops + 1 FROM w JOIN e ON src = node WHERE hops < 3 AND NOT list_contains(nodes, dst)),
p AS (SELECT w.start, node AS "end", nodes, hops, min(hops) OVER (PARTITION BY w.start, node) AS best FROM w JOIN ({_PAIRS}) q ON q.start = w.start AND q."end" = node)
SELECT start, "end", CAST(hops AS INTEGER) AS hops, CAST(row_number() OVER (PARTITION BY start, "end" ORDER BY nodes) AS INTEGER) AS nth, array_to_string(nodes, '>') AS path FROM p WHERE hops = best QUALIFY nth <= 10""")
def shortest_paths(t, spark):
    """From nations of customers over groups of orders to suppliers and their nations; the pairs are customers and suppliers of one number."""
    both = t("customer").join(t("supplier"), F.col("s_suppkey") == F.col("c_custkey"))
    start = F.concat(F.lit("n"), "c_nationkey").alias("src")
    pairs = both.select(start, F.concat(F.lit("s"), "s_suppkey").alias("dst")).union(both.select(start, F.concat(F.lit("m"), "s_nationkey").alias("dst")))
    return paths.all_shortest_paths(_orders_graph(t), pairs, 3, 10)


@query("""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.38),
r(node, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.other)
SELECT node AS vec_id, (SELECT count(*) FROM l WHERE a = node) AS n_links, min(other) AS class FROM r GROUP BY node""")
def near_dup_classes(t, spark):
    return compare.similar_classes(t("embeddings"), 0.38)


@query("SELECT o_orderkey, CAST(month(o_orderdate) AS INTEGER) AS month, row_number() OVER (PARTITION BY month(o_orderdate) ORDER BY o_orderkey % 3, o_orderkey) AS number FROM orders")
def continued_numbers(t, spark):
    """Orders are numbered by month in three batches; the second one is assigned twice."""
    orders = t("orders").select("o_orderkey", F.month("o_orderdate").alias("month"))
    store, out = Numbers(spark, _folder(spark, "numbers")), None
    for number in (0, 1, 1, 2):
        given = store.assign(orders.where(F.col("o_orderkey") % 3 == number), "month", "o_orderkey", number)
        out = given if out is None else out.unionByName(given) if number != 1 or given.inputFiles() != last else out
        last = given.inputFiles()
    return out


_WORKFLOWS = {"F": ("Filled", ("Af", "Rf"), ("Nf",)), "O": ("Open", ("No",), ()), "T": ("Two", ("Af", "No"), ("Rf",))}


@query("""WITH c AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderpriority LIKE '1%' THEN 'T' ELSE o_orderstatus END AS workflow, list(DISTINCT l_returnflag || lower(l_linestatus)) AS have FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT 'F' AS workflow, 'Filled' AS name, ['Af', 'Rf'] AS need, ['Nf'] AS more UNION ALL SELECT 'O', 'Open', ['No'], []::VARCHAR[] UNION ALL SELECT 'T', 'Two', ['Af', 'No'], ['Rf']),
b AS (SELECT c.*, name, need, more, list_filter(need, lambda k: NOT list_contains(have, k)) AS lack FROM c LEFT JOIN r USING (workflow))
SELECT case_id, workflow, name, CASE WHEN need IS NULL THEN 'ERROR' WHEN len(lack) > 0 THEN 'INCOMPLETE' ELSE 'COMPLETE' END AS status,
CASE WHEN need IS NULL THEN 'Unknown workflow: ' || workflow WHEN len(lack) > 0 THEN 'APPLICATION INCOMPLETE — Missing: ' || array_to_string(lack, ', ') ELSE 'APPLICATION COMPLETE — All required documents present' END AS message,
CASE WHEN need IS NULL THEN 0.0 ELSE round(100.0 * (len(need) - len(lack)) / len(need), 1) END::DOUBLE AS completeness,
CASE WHEN need IS NULL THEN 0 ELSE len(need) END AS total_required, CASE WHEN need IS NULL THEN 0 ELSE len(need) - len(lack) END AS present_required, coalesce(array_to_string(lack, ', '), '') AS missing,
CASE WHEN need IS NULL THEN 'ERROR: Workflow configuration not found' ELSE 'DOCUMENT CHECKLIST' || chr(10) || repeat('=', 50) || chr(10) || chr(10) || 'Required Documents:' || array_to_string(list_transform(need, lambda k: chr(10) || '  ' || CASE WHEN list_contains(have, k) THEN '✓' ELSE '✗' END || ' ' || k), '')
|| chr(10) || chr(10) || 'Optional Documents:' || coalesce(array_to_string(list_transform(more, lambda k: chr(10) || '  ' || CASE WHEN list_contains(have, k) THEN '✓' ELSE '○' END || ' ' || k), ''), '') END AS checklist FROM b""")
def workflow_checks(t, spark):
    """Orders as cases and the states of their line items as documents; the rules go through a file. Orders in part have no workflow."""
    path = _folder(spark, "workflows")
    workflows.save(workflows.with_workflow(workflows.rules(spark), workflows.rules(spark, _WORKFLOWS)), path)
    status = F.when(F.col("o_orderpriority").startswith("1"), "T").otherwise(F.col("o_orderstatus"))
    rows = t("orders").join(t("lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    cases = rows.select(F.col("o_orderkey").alias("case_id"), status.alias("workflow"), F.concat(F.lit(" "), F.lower("l_returnflag"), "l_linestatus").alias("kind"))
    return workflows.checked(cases, workflows.load(spark, path))


def _people(t):
    """Customers and suppliers in nations in regions, as vertices and edges."""
    part = lambda table, p, id_, name, of: (t(table).select(F.concat(F.lit(p), id_).alias("id"), F.col(name).alias("name")), t(table).select(F.concat(F.lit(p), id_).alias("src"), F.concat(F.lit(of[0]), of[1]).alias("dst"), F.lit(of[2]).alias("type")))
    made = [part("customer", "c", "c_custkey", "c_name", ("n", "c_nationkey", "home_nation")), part("supplier", "s", "s_suppkey", "s_name", ("n", "s_nationkey", "nation")), part("nation", "n", "n_nationkey", "n_name", ("r", "n_regionkey", "region"))]
    vertices = t("region").select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name"))
    edges = made[0][1].union(made[1][1]).union(made[2][1])
    for v, _ in made:
        vertices = vertices.union(v)
    return vertices, edges


@query("""WITH c AS (SELECT *, c_custkey % 5 AS form FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT 'c' || c_custkey AS query_id, 'relation' AS kind, 'n' || c_nationkey AS id, n_name AS name, 'home_nation' AS relation, NULL::VARCHAR AS path FROM c WHERE form = 0
UNION ALL SELECT 'c' || c_custkey, 'entity', 'n' || c_nationkey, n_name, 'home_nation', NULL FROM c WHERE form IN (1, 2)
UNION ALL SELECT 'c' || c_custkey, 'path', 'r' || r_regionkey, r_name, NULL, 'c' || c_custkey || '>n' || c_nationkey || '>r' || r_regionkey FROM c WHERE form = 3
UNION ALL SELECT 'n' || n_nationkey, 'relation', 'r' || r_regionkey, r_name, 'region', NULL FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT 's' || s_suppkey, 'path', 'n' || s_nationkey, n_name, NULL, 's' || s_suppkey || '>n' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey""")
def graph_questions(t, spark):
    """A question about every customer, nation and supplier, in the forms that are known, and some that no form fits."""
    vertices, edges = _people(t)
    home = t("customer").join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    form = F.col("c_custkey") % 5
    text = F.when(form == 0, F.concat(F.lit("What is the nation of "), "c_name", F.lit("?"))).when(form == 1, F.concat(F.lit("Who is "), "c_name", F.lit("?"))).when(form == 2, F.concat(F.lit("Tell me about "), "c_name", F.lit(".")))
    text = text.when(form == 3, F.concat(F.lit("How are "), "c_name", F.lit(" and "), "r_name", F.lit(" connected?"))).otherwise(F.concat(F.lit("Greetings to "), "c_name"))
    asked = home.select(F.concat(F.lit("c"), "c_custkey").alias("query_id"), text.alias("question"))
    asked = asked.union(t("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("Which region has "), "n_name", F.lit("?"))))
    near = t("supplier").join(t("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    asked = asked.union(near.select(F.concat(F.lit("s"), "s_suppkey"), F.concat(F.lit("what is the relationship between "), "s_name", F.lit(" and "), "n_name", F.lit("?"))))
    return questions.answers(questions.plans(asked, vertices), vertices, edges)
