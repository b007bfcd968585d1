"""Hybrid search, graph-guided retrieval, contexts, grounding and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extracts, retrieval, search
from ..registry import duck, query

TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
#: Keyword scores as bm25_topk's SQL has them, of 2k documents, and cosines of the 2k nearest vectors; a query is the text and vector of one id.
_HYBRID = f"""words AS (SELECT doc_id, {TOKENS} AS w FROM documents), size AS (SELECT doc_id, len(w) AS dl FROM words), total AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM words) GROUP BY ALL), raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, total GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT vec_id AS query_id, text FROM embeddings JOIN documents ON doc_id = vec_id WHERE vec_id % 100 = 0),
sem AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 10),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({TOKENS}) AS term FROM q WHERE query_id IN (SELECT query_id FROM sem)) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN size USING (doc_id), total GROUP BY ALL),
kw AS (SELECT query_id, doc_id, score FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10),
one AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(coalesce(text, ''))) AS one FROM documents),
ks AS (SELECT query_id, one AS doc_id, max(score) AS score FROM kw JOIN one USING (doc_id) GROUP BY ALL), ss AS (SELECT query_id, one AS doc_id, max(score) AS score FROM sem JOIN one USING (doc_id) GROUP BY ALL),
k AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS x FROM ks), s AS (SELECT *, score / max(score) OVER (PARTITION BY query_id) AS x FROM ss),
f AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.doc_id, k.doc_id) AS doc_id, round(0.7 * coalesce(s.x, 0) + 0.3 * coalesce(k.x, 0), 6) AS score FROM s FULL JOIN k ON s.query_id = k.query_id AND s.doc_id = k.doc_id)"""


def _semantic(t):
    asked = t("documents").where("doc_id % 100 = 0").join(t("embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return asked, search.cosine_top_k(t("embeddings"), 10).select("query_id", F.col("vec_id").alias("doc_id"), "score")


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 5")
def hybrid_search(t, spark):
    asked, semantic = _semantic(t)
    return retrieval.hybrid(t("documents"), asked, semantic)


@query(f"WITH {_HYBRID} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND source IS NOT NULL) QUALIFY rank <= 5")
def hybrid_search_filtered(t, spark):
    asked, semantic = _semantic(t)
    docs = t("documents").withColumn("metadata", F.create_map(F.lit("lang"), F.col("lang"), F.lit("document_type"), F.when(F.col("source").isNotNull(), "known").otherwise("none")))
    return retrieval.hybrid(docs, asked, semantic, wanted={"lang": "en", "document_types": ["known"], "date_range": ("2020", "2030")})


@query("SELECT count(*) AS documents, 0.7::DOUBLE AS semantic_weight, 0.3::DOUBLE AS keyword_weight, true AS ready FROM documents")
def index_statistics(t, spark):
    return retrieval.index_statistics(t("documents"))


@query("""WITH ty AS (SELECT label AS type, min(vec_id) AS place FROM embeddings GROUP BY 1), e AS (SELECT 't' || type AS type, place, embedding AS t FROM ty JOIN embeddings ON vec_id = place),
s AS (SELECT vec_id AS doc_id, type, round(list_sum(list_transform(list_zip(embedding, t), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS c, place FROM embeddings, e)
SELECT doc_id, CASE WHEN c >= 0.3 THEN type ELSE 'Other' END AS type, c AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, place) = 1""")
def vector_classes(t, spark):
    first = t("embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    types = t("embeddings").join(first, ["label", "vec_id"]).select(F.concat(F.lit("t"), "label").alias("type"), F.col("vec_id").alias("place"), "embedding")
    return retrieval.classified(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), types)


NAMES = "SELECT * FROM (VALUES ('a', 'permit'), ('b', 'roads office'), ('c', 'fee'), ('d', 'ox'), ('e', 'deadline'), ('f', 'clerk')) AS t(id, name)"
LINKS = "SELECT src, dst, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES ('a', 'b', 0.9), ('c', 'a', 0.7), ('a', 'd', 0.95), ('e', 'a', 0.6), ('b', 'f', 0.8), ('f', 'e', 0.61)) AS t(src, dst, confidence)"
QUERIES = "SELECT * FROM (VALUES (1, 'Which permit and fee?'), (2, 'the Roads Office'), (3, 'nothing')) AS t(query_id, query)"


@query(f"""WITH n AS ({NAMES}), l AS ({LINKS}), q AS ({QUERIES}), b AS (SELECT src, dst, confidence FROM l WHERE confidence > 0.6 UNION ALL SELECT dst, src, confidence FROM l WHERE confidence > 0.6),
t AS (SELECT query_id, y.name AS term, max(confidence) AS w FROM q JOIN n x ON contains(lower(query), x.name) JOIN b ON src = x.id JOIN n y ON y.id = dst WHERE length(y.name) >= 3 AND NOT contains(lower(query), y.name) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS r FROM t QUALIFY r <= 5) SELECT query_id, trim(any_value(query) || ' ' || coalesce(string_agg(term, ' ' ORDER BY r), '')) AS expanded FROM q LEFT JOIN r USING (query_id) GROUP BY 1""")
def expanded_queries(t, spark):
    return retrieval.expanded(spark.sql(QUERIES), spark.sql(NAMES), spark.sql(LINKS))


ASKED = "SELECT * FROM (VALUES (1, 'a'), (1, 'c'), (2, 'b')) AS t(query_id, entity)"
HELD = "SELECT * FROM (VALUES (10, 'a'), (10, 'f'), (11, 'b'), (11, 'c'), (12, 'd'), (13, 'e')) AS t(doc_id, entity)"
_RELEVANCE = f"""l AS ({LINKS}), qe AS ({ASKED}), de AS ({HELD}), w AS (SELECT src, dst, max(w) AS w FROM (SELECT src, dst, 1.0 AS w FROM l UNION ALL SELECT x.src, y.dst, 0.5 FROM l x JOIN l y ON x.dst = y.src WHERE x.src <> y.dst) GROUP BY 1, 2),
p AS (SELECT query_id, doc_id, count(*) FILTER (q.entity = d.entity) AS same, coalesce(sum(w), 0) AS linked FROM qe q CROSS JOIN de d LEFT JOIN w ON src = q.entity AND dst = d.entity GROUP BY 1, 2),
rel AS (SELECT query_id, doc_id, round(0.6 * same / (SELECT count(*) FROM qe x WHERE x.query_id = p.query_id) + 0.4 * linked / ((SELECT count(*) FROM qe x WHERE x.query_id = p.query_id) * (SELECT count(*) FROM de y WHERE y.doc_id = p.doc_id)), 6)::DOUBLE AS relevance FROM p WHERE same > 0 OR linked > 0)"""


@query(f"WITH {_RELEVANCE} SELECT * FROM rel")
def graph_relevance(t, spark):
    return retrieval.graph_relevance(spark.sql(ASKED), spark.sql(HELD), spark.sql(LINKS))


RESULTS = "SELECT query_id, doc_id, CAST(score AS DOUBLE) AS score FROM (VALUES (1, 10, 0.5), (1, 11, 0.6), (1, 12, 0.9), (2, 11, 0.2), (2, 13, 0.8)) AS t(query_id, doc_id, score)"


@query(f"WITH {_RELEVANCE} SELECT query_id, doc_id, round(0.5 * score + 0.5 * coalesce(relevance, 0), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * score + 0.5 * coalesce(relevance, 0), 6) DESC, doc_id) AS INTEGER) AS rank FROM ({RESULTS}) LEFT JOIN rel USING (query_id, doc_id)")
def graph_reranked(t, spark):
    return retrieval.graph_reranked(spark.sql(RESULTS), retrieval.graph_relevance(spark.sql(ASKED), spark.sql(HELD), spark.sql(LINKS)))


@query("""WITH h AS (SELECT conv_id AS query_id, CAST(turn + 1 AS INTEGER) AS rank, '[Document ' || (turn + 1) || ' - Source: ' || role || ', Page: unknown]' || chr(10) || coalesce(text, '') || chr(10) AS part FROM conversations), u AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY rank) AS s FROM h)
SELECT query_id, CAST(count(*) AS INTEGER) AS used, string_agg(part, chr(10) || '---' || chr(10) ORDER BY rank) AS context FROM u WHERE s <= 3000 GROUP BY 1""")
def numbered_context(t, spark):
    rows = t("conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), "text", F.col("role").alias("source"), F.lit(None).cast("string").alias("page"))
    return retrieval.numbered_context(rows)


PROMPTS = "SELECT * FROM (VALUES (1, 'Summarize it', 'x'), (2, 'compare a versus b', 'x'), (3, 'Why is that?', 'x'), (4, 'Which town?', 'a.py'), (5, 'Which town?', 'x'), (6, 'Is there an api?', 'x'), (7, 'What is the main point; and the cause?', 'x'), (8, 'Give an overview of similar towns', 'x')) AS t(id, query, source)"
_SQL_TEMPLATE = f"CASE WHEN len(regexp_extract_all(coalesce(context, ''), '\\b\\w+\\b')) < 30 THEN 'default' WHEN regexp_matches(lower(source), '{retrieval.SOURCES}') THEN 'technical' WHEN regexp_matches(lower(query), '{retrieval.REASONING}') THEN 'chain_of_thought' WHEN regexp_matches(lower(query), '{retrieval.TECHNICAL}') OR regexp_matches(context, '{retrieval.CODE}') THEN 'technical' WHEN regexp_matches(lower(query), '{retrieval.COMPARE}') THEN 'compare' WHEN regexp_matches(lower(query), '{retrieval.SUMMARY}') THEN 'summary' ELSE 'enhanced' END"


@query(f"""WITH c AS (SELECT id, query, source, n, CASE n WHEN 0 THEN 'short' WHEN 1 THEN repeat('word ', 40) ELSE repeat('word ', 40) || 'def run(' END AS context FROM ({PROMPTS}), (SELECT unnest([0, 1, 2]) AS n)) SELECT id, n, {_SQL_TEMPLATE} AS template FROM c""")
def prompt_templates(t, spark):
    rows = spark.sql(PROMPTS).join(spark.sql("SELECT explode(array(0, 1, 2)) AS n"), F.lit(True))
    context = F.when(F.col("n") == 0, "short").otherwise(F.concat(F.repeat(F.lit("word "), F.lit(40)), F.when(F.col("n") == 2, "def run(").otherwise("")))
    return rows.select("id", "n", retrieval.template(F.col("query"), context, F.col("source")).alias("template"))


_REASONS = "(" + " OR ".join(f"contains(lower(query), '{w}')" for w in ("why", "how", "explain", "reason", "analyze", "compare", "contrast", "difference", "similar", "relationship", "connect", "cause", "effect")) + ")"


@query(f"SELECT id, CASE WHEN regexp_matches(lower(query), 'summarize|summary|overview|what is this document about') THEN 'summary' WHEN regexp_matches(lower(query), 'compare|difference|similar|contrast|versus|vs') THEN 'comparison' ELSE 'grounded' END AS template, {_REASONS} OR len(regexp_extract_all(query, '\\?')) > 1 OR contains(query, ';') OR len(list_filter(regexp_split_to_array(query, '\\s+'), lambda w: w <> '')) > 15 AS reasoning FROM ({PROMPTS})")
def grounded_prompts(t, spark):
    return spark.sql(PROMPTS).select("id", retrieval.grounded_template(F.col("query")).alias("template"), retrieval.needs_reasoning(F.col("query")).alias("reasoning"))


REPLIES = "SELECT reply_id, reply, CAST(confidence AS DOUBLE) AS confidence, evidence, documents, error FROM (VALUES (1, 'It is 5 [1], see [Source: a.txt] and (b.txt, Page 3) and [1].', 0.8, 2, 2, CAST(NULL AS STRING)), (2, 'I think it is probably so', 0.29, 1, 1, CAST(NULL AS STRING)), (3, 'As an AI I cannot', 0.9, 0, 0, CAST(NULL AS STRING)), (4, CAST(NULL AS STRING), 0.5, 1, 3, 'late')) AS t(reply_id, reply, confidence, evidence, documents, error)"
_DOUBT = "concat_ws(', ', " + ", ".join("CASE WHEN contains(lower(coalesce(reply, '')), '{0}') THEN '{0}' END".format(w.replace("'", "''")) for w in retrieval.UNSURE) + ")"


@query(f"WITH w AS (SELECT reply_id, concat_ws('; ', CASE WHEN evidence = 0 THEN 'No evidence/sources provided for the response' END, CASE WHEN confidence < 0.3 THEN 'Low confidence score: ' || printf('%.2f', confidence) END, CASE WHEN {_DOUBT} <> '' THEN 'Response contains uncertainty indicators: ' || {_DOUBT} END) AS warnings FROM ({duck(REPLIES)})) SELECT reply_id, warnings = '' AS valid, warnings FROM w")
def reply_checks(t, spark):
    return retrieval.validated(spark.sql(REPLIES))


@query(f"SELECT reply_id, CASE WHEN documents = 0 THEN '{retrieval.NONE_FOUND.replace(chr(39), chr(39) * 2)}' WHEN error IS NOT NULL THEN 'An error occurred while processing your question: ' || error ELSE reply END AS reply, CASE WHEN documents = 0 OR error IS NOT NULL THEN 0 ELSE confidence END::DOUBLE AS confidence FROM ({duck(REPLIES)})")
def fixed_replies(t, spark):
    return retrieval.fixed_replies(spark.sql(REPLIES))


CITED = "SELECT * FROM (VALUES (1, 1, 'a.txt', 3, 0.5D), (1, 2, CAST(NULL AS STRING), CAST(NULL AS INT), 0.25D), (3, 1, 'b', 1, 1D)) AS t(reply_id, place, source, page, confidence)"


@query(f"""WITH e AS ({duck(CITED).replace('0.5D', '0.5').replace('0.25D', '0.25').replace('1D)', '1.0)')}), l AS (SELECT reply_id, string_agg(place || '. ' || coalesce(source, 'Unknown') || ' (Page ' || coalesce(CAST(page AS VARCHAR), '?') || ') - Confidence: ' || printf('%.2f', confidence::DOUBLE), chr(10) ORDER BY place) AS l FROM e GROUP BY 1)
SELECT reply_id, reply || coalesce(chr(10) || chr(10) || '**Sources:**' || chr(10) || l, '') AS reply FROM ({duck(REPLIES)}) LEFT JOIN l USING (reply_id)""")
def cited_replies(t, spark):
    return retrieval.cited(spark.sql(REPLIES).select("reply_id", "reply"), spark.sql(CITED))


@query(f"SELECT reply_id, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(coalesce(reply, ''), '\\[([0-9]+)\\]', 1), regexp_extract_all(coalesce(reply, ''), '\\[Source: ([^\\]]+)\\]', 1), regexp_extract_all(coalesce(reply, ''), '\\(([^)]+), Page [0-9]+\\)', 1)))), ';') AS cited FROM ({duck(REPLIES)})")
def reply_citations(t, spark):
    return spark.sql(REPLIES).select("reply_id", F.array_join(F.sort_array(retrieval.citations(F.col("reply"))), ";").alias("cited"))


@query("SELECT item_id AS query_id, 1 AS rank, 'Unknown' AS source, 0 AS page, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS snippet, 0.5::DOUBLE AS confidence FROM benchmark")
def evidence_rows(t, spark):
    rows = t("benchmark").select(F.col("item_id").alias("query_id"), F.lit(1).alias("rank"), "text", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("page"), F.lit(0.5).alias("score"))
    return retrieval.evidence_rows(rows)


ANSWERS = "SELECT * FROM (VALUES (1, 'It is so'), (2, 'I cannot say'), (3, 'As an AI'), (9, CAST(NULL AS STRING))) AS t(query_id, reply)"
_UNGROUNDED = " OR ".join("contains(lower(coalesce(reply, '')), '{}')".format(w.replace("'", "''")) for w in retrieval.UNGROUNDED)
_UNEXPLAINED = " OR ".join("contains(lower(coalesce(reply, '')), '{}')".format(w.replace("'", "''")) for w in retrieval.NOT_EXPLAINED)


@query(f"SELECT query_id, coalesce(n, 0) AS sources, round(coalesce(m, 0), 4)::DOUBLE AS confidence, NOT ({_UNGROUNDED}) AS \"grounded\" FROM ({duck(ANSWERS)}) LEFT JOIN (SELECT query_id, count(*) AS n, avg(score) AS m FROM ({RESULTS}) GROUP BY 1) USING (query_id)")
def provenance(t, spark):
    return retrieval.provenance(spark.sql(RESULTS), spark.sql(ANSWERS))


@query(f"""SELECT query_id, coalesce(n, 0) AS chunks, round(coalesce(m, 0), 4)::DOUBLE AS score, CASE WHEN coalesce(m, 0) > 0.75 THEN 'HIGH' WHEN coalesce(m, 0) > 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS level, NOT ({_UNEXPLAINED}) AS "grounded", coalesce(e, '') AS entities FROM ({duck(ANSWERS)}) LEFT JOIN (SELECT query_id, count(*) AS n, avg(score) AS m FROM ({RESULTS}) GROUP BY 1) USING (query_id)
LEFT JOIN (SELECT query_id, string_agg(DISTINCT entity, ', ' ORDER BY entity) AS e FROM ({ASKED}) GROUP BY 1) USING (query_id)""")
def explained_answers(t, spark):
    return retrieval.explained(spark.sql(RESULTS), spark.sql(ANSWERS), spark.sql(ASKED).withColumnRenamed("entity", "name"))


VALUES = "SELECT CAST(doc_id AS BIGINT) AS doc_id, value FROM (VALUES (1, ' the '), (2, 'no such words'), (3, 'The'), (5, 'e')) AS t(doc_id, value)"


@query(f"""WITH v AS ({VALUES}), b AS (SELECT v.doc_id, value, 0 AS chunk, text, strpos(text, trim(value)) AS pos FROM v JOIN documents USING (doc_id) WHERE strpos(text, trim(value)) > 0)
SELECT v.doc_id, v.value, chunk, trim(substr(text, greatest(pos - 60, 1), pos + length(trim(v.value)) + 60 - greatest(pos - 60, 1))) AS snippet FROM v LEFT JOIN b USING (doc_id, value)""")
def located_values(t, spark):
    return retrieval.located(spark.sql(VALUES), t("documents").select("doc_id", F.lit(0).alias("chunk"), "text"))


QUESTIONS = "SELECT * FROM (VALUES (1, -11, 'What is this document about?'), (2, -11, 'Is there a pending case?'), (3, -11, 'When is the deadline?'), (4, -12, 'Which department?'), (5, -12, 'Where was it?'), (6, -13, 'Who is named?'), (7, -15, 'How much is the fine?'), (8, -14, 'Is it genuine?'), (9, -12, 'Tell of the Ulmstead things'), (10, -15, 'Quux?'), (11, -11, 'What is the fee?'), (12, -12, 'The date of birth?')) AS t(question_id, doc_id, question)"


# the items come from Python; a test states the answers
@query()
def rule_answers(t, spark):
    from .extraction import NOTES

    notes = spark.sql(NOTES)
    items = extracts.everything(notes)
    documents = notes.select("doc_id", "text", F.when(F.col("doc_id") == -12, "Rural Works").alias("department"), F.when(F.col("doc_id") == -14, "verified").alias("status"))
    return retrieval.rule_answers(spark.sql(QUESTIONS), items, documents)


# approximate: a test measures its recall
@query()
def vector_ivf_topk(t, spark):
    from ..operators import search

    return search.ivf_top_k(t("embeddings"))
