"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from dossier import queries as _  # noqa: F401
from dossier.registry import QUERIES

HEADLINE = "bm25_topk hybrid_search vector_cosine_topk vector_l2_topk vector_graph_topk comparison_report graph_questions workflow_checks exact_dup_groups fuzzy_name_pairs shared_values field_conflicts missing_requirements brute_force access_rate novelty hash_chain_verify latest_version context_build connected_components subgraph_2hop entity_upsert readiness_score verification_results extracted_fields named_entities mention_join preprocess_text contact_extract text_quality character_chunks sentence_chunks sequence_numbers".split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    # starts the JVM's and Python's workers, so that the first query isn't charged for them
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(1000).repartition(int(cpus)).mapInArrow(lambda batches: batches, "id long").count()
    spark.range(1000).repartition(int(cpus)).mapInPandas(lambda batches: batches, "id long").count()
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
