"""Risk of cases, exports, filters, relation paths, boosts and lines of recognised words over the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.tables import checkpoint_dir
from ..operators import filters, graph, records, scores, search
from ..registry import query
from ..sources import files


@query("""WITH c AS (SELECT o_custkey AS case_id, count(*) FILTER (o_orderstatus = 'P') AS conflicts, count(*) - count(DISTINCT o_orderpriority) AS duplicates FROM orders GROUP BY 1)
SELECT case_id, conflicts, duplicates, round(least(1.0, 0.15 * conflicts + 0.05 * duplicates), 4)::DOUBLE AS risk FROM c""")
def case_risk(t, spark):
    held = t("orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("conflicts"), (F.count("*") - F.countDistinct("o_orderpriority")).alias("duplicates"))
    return scores.risk(held).withColumn("risk", F.col("risk").cast("double"))


@query("SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, event_type AS action, CAST(user_id AS VARCHAR) AS of, substr(sha256(coalesce(props, '')), 1, 16) AS hash FROM events")
def event_export(t, spark):
    """The export of events goes through a snapshot that replaces another."""
    path = f"{checkpoint_dir(spark)}/dossier-snapshot-{uuid.uuid4().hex}"
    files.save_snapshot(t("events").limit(3), path)
    files.save_snapshot(t("events"), path, ["event_type"])
    out = files.export_events(spark.read.schema(t("events").schema).parquet(path))
    return out.select(F.date_format("`@timestamp`", "yyyy-MM-dd HH:mm:ss").alias("at"), F.col("`event.action`").alias("action"), F.col("`user.id`").alias("of"), F.col("`event.hash`").alias("hash"))


@query("SELECT 'r' || n_regionkey AS id, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def relation_paths(t, spark):
    """Where ways of given relations lead from all customers: into a nation, and on to what that is part of."""
    link = lambda table, src, dst, kind: t(table).select(F.concat(F.lit(src[0]), src[1:]).alias("src"), F.concat(F.lit(dst[0]), dst[1:]).alias("dst"), F.lit(kind).alias("type"))
    edges = link("customer", "cc_custkey", "nc_nationkey", "in").union(link("nation", "nn_nationkey", "rn_regionkey", "part_of")).union(link("supplier", "ss_suppkey", "ns_nationkey", "in"))
    return graph.relation_path(edges, t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")), ["in", "part_of"]).groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority = '1-URGENT' AND strftime(o_orderdate, '%Y-%m-%d') BETWEEN '1994-01-01' AND '1996-06-30'")
def built_filters(t, spark):
    """Filters on types, dates and a value, made by the builders and combined."""
    held = t("orders").withColumn("metadata", F.create_map(F.lit("document_type"), "o_orderstatus", F.lit("priority"), "o_orderpriority", F.lit("date"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    wanted = records.combined(records.by_value("priority", "none"), records.by_types(["F", "P"]), records.by_dates("1994-01-01", "1996-06-30"), records.by_value("priority", "1-URGENT"))
    return filters.metadata_filter(held, wanted).select("o_orderkey")


@query("""WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS doc_id, o_orderpriority || ' ' || o_orderstatus AS text, o_totalprice / 1000000 AS score FROM orders), m AS (SELECT c_custkey AS query_id, unnest(['urgent', 'f', 'low']) AS entity FROM customer)
SELECT r.query_id, doc_id, round(any_value(score) + 0.05 * count(entity), 6) AS score FROM r LEFT JOIN m ON m.query_id = r.query_id AND contains(lower(text), entity) GROUP BY 1, 2""")
def boosted_results(t, spark):
    held = t("orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("text"), (F.col("o_totalprice") / 1000000).alias("score"))
    return search.boosted(held, t("customer").select(F.col("c_custkey").alias("query_id"), F.explode(F.array(*map(F.lit, ("urgent", "F", "LOW")))).alias("entity")))


@query("""WITH w AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS block, l_suppkey % 2 AS par, l_partkey % 3 AS line, l_linenumber * 1000000 + l_partkey AS place, l_returnflag || l_partkey AS word, 100 * l_discount * 10 - 20 AS conf FROM lineitem), s AS (SELECT DISTINCT * FROM w WHERE conf > 0),
l AS (SELECT doc_id, block, par, line, string_agg(word, ' ' ORDER BY place, word) AS t FROM s GROUP BY ALL), p AS (SELECT doc_id, block, par, string_agg(t, chr(10) ORDER BY line) AS t FROM l GROUP BY ALL),
d AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY block, par) AS text FROM p GROUP BY ALL) SELECT doc_id, text, (SELECT round(avg(conf) / 100, 3) FROM s WHERE s.doc_id = d.doc_id) AS confidence FROM d""")
def ocr_lines(t, spark):
    words = t("lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 2).alias("block"), (F.col("l_suppkey") % 2).alias("par"), (F.col("l_partkey") % 3).alias("line"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("place"), F.concat("l_returnflag", "l_partkey").alias("word"), (100 * F.col("l_discount") * 10 - 20).alias("conf")).distinct()
    return files.assembled_lines(words).withColumn("confidence", F.round("confidence", 3))
