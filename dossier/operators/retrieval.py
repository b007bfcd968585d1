"""Retrieval end to end: hybrid search, expansion and re-ranking by a graph, contexts, grounding, evidence, answers by rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import filters, joins, search
from .search import top

# fixed values: phrases and patterns by which replies and questions are judged
NO_ANSWER = ("don't have enough information", "cannot answer", "not found in the documents", "insufficient information", "not provided in the context", "no information about")
UNSURE = ("i think", "probably", "maybe", "it's possible", "in general", "typically", "usually")
UNGROUNDED = ("i don't know", "i cannot", "not in the documents", "as an ai", "my training")
NOT_EXPLAINED = ("don't have enough information", "not found in the documents", "cannot answer", "as an ai")
CITATIONS = (r"\[([0-9]+)\]", r"\[Source: ([^\]]+)\]", r"\(([^)]+), Page [0-9]+\)")
SUMMARY = r"summarize|summary|overview|main points|what is this (document|text|content) about|describe the (document|text|content)|key (points|findings|ideas|concepts)|tldr|gist|brief description"
COMPARE = r"compare|contrast|difference|similarities|how does .+ differ from|what is the relationship between|versus|vs\.|similarities and differences"
TECHNICAL = r"code|function|api|class|method|implementation|how to implement|syntax|programming|algorithm|data structure|technical|configure|setup|install"
CODE = r"def\s+\w+\s*\(|class\s+\w+|function\s+\w+|import\s+\w+|from\s+\w+\s+import|#include|<script|<style|<html|```"
REASONING = r"\b(why|how|explain|reason|analyze|what would happen if|implications|consequences|evaluate|assess|determine the cause)\b"
SOURCES = r"\.(py|js|java|c|cpp|h)$"
GROUNDED_SUMMARY = ("summarize", "summary", "overview", "what is this document about")
GROUNDED_COMPARE = ("compare", "difference", "similar", "contrast", "versus", "vs")
ACTIVE = ("ongoing", "pending", "active", "fir", "complaint", "hearing", "next date")
NONE_FOUND = "I don't have any documents to answer this question. Please upload relevant documents first."


def _any(low: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


# search


def hybrid(docs: DataFrame, queries: DataFrame, semantic: DataFrame, k: int = 5, wanted: dict | None = None, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """query_id, doc_id, score, rank: keyword hits of 2k documents and semantic(query_id, doc_id, score) together, each side over its largest
    score of the query; then the filter on docs.metadata, then k. Documents of one text are one result, with the smallest id; queries
    without semantic results have none."""
    hashed = written(docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text")), "digests")
    # joined by shuffle: what Spark broadcasts passes through the driver, and digests take more there than in files
    of = written(hashed.hint("merge").join(hashed.groupBy("text").agg(F.min("doc_id").alias("one")), "text").select("doc_id", "one"), "ones")
    single = lambda df: df.hint("merge").join(of, "doc_id").groupBy("query_id", "one").agg(F.max("score").alias("score")).select("query_id", F.col("one").alias("text"), "score")
    # it is read twice
    semantic = written(semantic, "semantic")
    asked = queries.join(semantic.select("query_id").distinct(), "query_id", "left_semi")
    words = search.bm25(docs, asked, 2 * k)
    if wanted is None:
        return search.fused(single(semantic), single(words), weights, k).select("query_id", F.col("text").alias("doc_id"), "score", "rank")
    both = search.fused(single(semantic), single(words), weights, 1 << 30).drop("rank")
    kept = filters.metadata_filter(docs, wanted).select(F.col("doc_id").alias("text"))
    return top(both.hint("merge").join(kept, "text", "left_semi"), "query_id", [F.desc("score"), F.col("text")], k).select("query_id", F.col("text").alias("doc_id"), "score", "rank")


def expanded(queries: DataFrame, vertices: DataFrame, edges: DataFrame, most: int = 5, least: float = 0.6, order: str = "weight") -> DataFrame:
    """query_id, expanded: the query and the names of up to most neighbours of the vertices(id, name) that it mentions, over edges(src, dst,
    confidence) surer than least: by confidence, or by length; names of three characters or more that the query doesn't hold."""
    low = F.lower("query")
    named = queries.join(joins.named_in(queries, vertices), "query_id").select("query_id", "query", "id")
    both = edges.where(F.col("confidence") > least).select("src", "dst", "confidence")
    step = both.unionAll(both.select("dst", "src", "confidence"))
    near = named.join(step, named.id == step.src).join(vertices.select(F.col("id").alias("dst"), F.col("name").alias("term")), "dst")
    good = near.where((F.length("term") >= 3) & ~low.contains(F.lower("term"))).groupBy("query_id", "term").agg(F.max("confidence").alias("weight"))
    by = [F.desc("weight"), F.col("term")] if order == "weight" else [F.length("term"), F.col("term")]
    best = top(good, "query_id", by, most).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return queries.join(best, "query_id", "left").select("query_id", F.concat_ws(" ", "query", F.array_join(F.transform("t", lambda x: x["term"]), " ")).alias("expanded")).withColumn("expanded", F.trim("expanded"))


def graph_relevance(query_entities: DataFrame, doc_entities: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, doc_id, relevance of (query_id, entity) and (doc_id, entity): .6 of the share of the query's entities that the document holds, .4 of
    the pairs of different entities that a way of two edges at most joins, each by 1 over its number of edges, over all pairs."""
    q = query_entities.distinct()
    d = doc_entities.distinct()
    asked, held = q.groupBy("query_id").agg(F.count("*").alias("nq")), d.groupBy("doc_id").agg(F.count("*").alias("nd"))
    shared = q.join(d, "entity").groupBy("query_id", "doc_id").agg(F.count("*").alias("same"))
    one = edges.select("src", "dst").where("src <> dst").distinct()
    x, y = one.alias("x"), one.alias("y")
    start = q.select(F.col("entity").alias("e")).distinct()
    two = x.join(start, F.col("x.src") == F.col("e"), "left_semi").join(y, F.col("x.dst") == F.col("y.src")).where("x.src <> y.dst").select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"), F.lit(0.5).alias("w"))
    ways = one.withColumn("w", F.lit(1.0)).unionAll(two).groupBy("src", "dst").agg(F.max("w").alias("w"))
    near = q.join(ways, q.entity == ways.src).select("query_id", "dst", "w").join(d, F.col("dst") == d.entity).groupBy("query_id", "doc_id").agg(F.sum("w").alias("linked"))
    both = shared.join(near, ["query_id", "doc_id"], "full_outer").join(asked, "query_id").join(held, "doc_id")
    score = 0.6 * F.coalesce("same", F.lit(0)) / F.col("nq") + 0.4 * F.coalesce("linked", F.lit(0.0)) / (F.col("nq") * F.col("nd"))
    return both.select("query_id", "doc_id", F.round(score, 6).alias("relevance"))


def graph_reranked(results: DataFrame, relevance: DataFrame, k: int = 5, weight: float = 0.5) -> DataFrame:
    """query_id, doc_id, score, rank: results(query_id, doc_id, score) with weight given to the graph's relevance (none counts 0)."""
    both = results.drop("rank").join(relevance, ["query_id", "doc_id"], "left")
    score = F.round((1 - weight) * F.col("score") + weight * F.coalesce("relevance", F.lit(0.0)), 6)
    return top(both.select("query_id", "doc_id", score.alias("score")), "query_id", [F.desc("score"), F.col("doc_id")], k)


def index_statistics(docs: DataFrame, weights: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    return docs.agg(F.count("*").alias("documents")).select("documents", F.lit(weights[0]).alias("semantic_weight"), F.lit(weights[1]).alias("keyword_weight"), (F.col("documents") > 0).alias("ready"))


def classified(docs: DataFrame, types: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, type, confidence: the type of types(type, place, embedding) with the largest dot product, ties to the smaller place; under least
    Other. The types are a small table: they are broadcast if they are 1,000 at most."""
    from ..functions import vectors

    few = types.select("type", "place", F.col("embedding").alias("t"))
    few = F.broadcast(few) if few.limit(1001).count() <= 1000 else few
    scored = docs.select("doc_id", "embedding").join(few, F.size("embedding") == F.size("t")).withColumn("s", vectors.dot(F.col("embedding"), F.col("t")))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("type", "s"), F.struct("s", (-F.col("place")).alias("p"))).alias("b"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", F.when(F.col("b.s") >= least, F.col("b.type")).otherwise("Other").alias("type"), F.round(F.coalesce("b.s", F.lit(0.0)), 6).alias("confidence"))


# contexts and prompts


def numbered_context(hits: DataFrame, most: int = 3000) -> DataFrame:
    """query_id, used, context of hits(query_id, rank, text, source, page): numbered documents in order of rank, up to the first that would take the
    context over most characters."""
    part = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit(" - Source: "), F.coalesce("source", F.lit("Unknown")), F.lit(", Page: "), F.coalesce(F.col("page").cast("string"), F.lit("unknown")), F.lit("]\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    fit = hits.withColumn("part", part).withColumn("upto", F.sum(F.length("part")).over(order)).where(F.col("upto") <= most)
    held = fit.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "part"))).alias("p"))
    return held.select("query_id", F.size("p").alias("used"), F.array_join(F.transform("p", lambda x: x["part"]), "\n---\n").alias("context"))


def template(query, context, source, reasoning=None) -> Column:
    """The name of the prompt for a query and its context: default for fewer than 30 words of context; of enhanced, summary, compare, technical,
    chain_of_thought and (for program files) technical, the last that fits."""
    low = F.lower(query)
    words = F.regexp_count(F.coalesce(context, F.lit("")), F.lit(r"\b\w+\b"))
    deep = low.rlike(REASONING) if reasoning is None else low.rlike(REASONING) | reasoning
    return F.when(words < 30, "default").when(F.lower(F.coalesce(source, F.lit(""))).rlike(SOURCES), "technical").when(deep, "chain_of_thought").when(low.rlike(TECHNICAL) | context.rlike(CODE), "technical").when(low.rlike(COMPARE), "compare").when(low.rlike(SUMMARY), "summary").otherwise("enhanced")


def grounded_template(query) -> Column:
    low = F.lower(query)
    return F.when(_any(low, GROUNDED_SUMMARY), "summary").when(_any(low, GROUNDED_COMPARE), "comparison").otherwise("grounded")


def needs_reasoning(query, words: tuple[str, ...] = ("why", "how", "explain", "reason", "analyze", "compare", "contrast", "difference", "similar", "relationship", "connect", "cause", "effect")) -> Column:
    """A keyword, more than one question mark, a semicolon, or more than 15 words."""
    return _any(F.lower(query), words) | (F.regexp_count(query, F.lit(r"\?")) > 1) | query.contains(";") | (F.size(F.array_remove(F.split(query, r"\s+"), "")) > 15)


# answers and their evidence


def validated(replies: DataFrame) -> DataFrame:
    """reply_id, valid, warnings of replies(reply_id, reply, confidence, evidence): no evidence, confidence under .3, words of doubt."""
    low = F.lower(F.coalesce("reply", F.lit("")))
    unsure = F.concat_ws(", ", *[F.when(low.contains(w), w) for w in UNSURE])
    warnings = F.concat_ws(
        "; ",
        F.when(F.col("evidence") == 0, "No evidence/sources provided for the response"),
        F.when(F.col("confidence") < 0.3, F.concat(F.lit("Low confidence score: "), F.format_string("%.2f", F.col("confidence")))),
        F.when(unsure != "", F.concat(F.lit("Response contains uncertainty indicators: "), unsure)),
    )
    return replies.select("reply_id", (warnings == "").alias("valid"), warnings.alias("warnings"))


def grounded(reply, phrases: tuple[str, ...] = UNGROUNDED) -> Column:
    return ~_any(F.lower(F.coalesce(reply, F.lit(""))), phrases)


def fixed_replies(replies: DataFrame) -> DataFrame:
    """reply_id, reply, confidence of replies(reply_id, reply, error, documents, confidence): fixed words at confidence 0 without documents or after an
    error."""
    none, failed = F.col("documents") == 0, F.col("error").isNotNull()
    text = F.when(none, NONE_FOUND).when(failed, F.concat(F.lit("An error occurred while processing your question: "), "error")).otherwise(F.col("reply"))
    return replies.select("reply_id", text.alias("reply"), F.when(none | failed, 0.0).otherwise(F.col("confidence").cast("double")).alias("confidence"))


def cited(replies: DataFrame, evidence: DataFrame) -> DataFrame:
    """reply_id, reply with a numbered list of sources from evidence(reply_id, place, source, page, confidence); without any, as it is."""
    line = F.concat(F.col("place").cast("string"), F.lit(". "), F.coalesce("source", F.lit("Unknown")), F.lit(" (Page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(") - Confidence: "), F.format_string("%.2f", F.col("confidence")))
    lists = evidence.select("reply_id", "place", line.alias("line")).groupBy("reply_id").agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("l"))
    lines = F.concat(F.lit("\n\n**Sources:**\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return replies.join(lists, "reply_id", "left").select("reply_id", F.concat("reply", F.coalesce(lines, F.lit(""))).alias("reply"))


def citations(reply) -> Column:
    """What a reply cites, each once: [n], [Source: x], (x, Page n)."""
    text = F.coalesce(reply, F.lit(""))
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in CITATIONS]))


def evidence_rows(hits: DataFrame) -> DataFrame:
    """query_id, rank, source, page, snippet, confidence of hits(query_id, rank, text, filename, source, page, score): 200 characters of each."""
    snippet = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text"))
    return hits.select("query_id", "rank", F.coalesce("filename", "source", F.lit("Unknown")).alias("source"), F.coalesce("page", F.lit(0)).alias("page"), snippet.alias("snippet"), F.col("score").cast("double").alias("confidence"))


def provenance(hits: DataFrame, replies: DataFrame) -> DataFrame:
    """query_id, sources, confidence, grounded of hits(query_id, score) and replies(query_id, reply): the mean score, and whether the reply keeps to its
    sources."""
    sums = hits.groupBy("query_id").agg(F.count("*").alias("sources"), F.avg("score").alias("mean"))
    return replies.join(sums, "query_id", "left").select("query_id", F.coalesce("sources", F.lit(0)).alias("sources"), F.round(F.coalesce("mean", F.lit(0.0)), 4).alias("confidence"), grounded(F.col("reply")).alias("grounded"))


def explained(hits: DataFrame, replies: DataFrame, entities: DataFrame) -> DataFrame:
    """query_id, chunks, score, level, grounded, entities: how an answer came about, for replies(query_id, reply), hits(query_id, score) and
    entities(query_id, name); HIGH over .75, MEDIUM over .5."""
    sums = hits.groupBy("query_id").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    names = entities.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ", ").alias("names"))
    both = replies.join(sums, "query_id", "left").join(names, "query_id", "left")
    mean = F.coalesce("mean", F.lit(0.0))
    return both.select("query_id", F.coalesce("n", F.lit(0)).alias("chunks"), F.round(mean, 4).alias("score"), F.when(mean > 0.75, "HIGH").when(mean > 0.5, "MEDIUM").otherwise("LOW").alias("level"), grounded(F.col("reply"), NOT_EXPLAINED).alias("grounded"), F.coalesce("names", F.lit("")).alias("entities"))


def located(values: DataFrame, chunks: DataFrame, around: int = 60) -> DataFrame:
    """doc_id, value, chunk, snippet: the first chunk that holds a value as it is, with around characters on both sides; null where none does."""
    at = F.expr("locate(trim(value), text)")
    both = values.join(chunks, "doc_id").withColumn("at", at).where("at > 0")
    first = both.groupBy("doc_id", "value").agg(F.min_by(F.struct("chunk", "text", "at"), "chunk").alias("c"))
    start = F.greatest(F.col("c.at") - around, F.lit(1))
    length = F.col("c.at") + F.length(F.trim("value")) + around - start
    found = first.select("doc_id", "value", F.col("c.chunk").alias("chunk"), F.trim(F.substring(F.col("c.text"), start, length)).alias("snippet"))
    return values.join(found, ["doc_id", "value"], "left")


def rule_answers(questions: DataFrame, items: DataFrame, documents: DataFrame) -> DataFrame:
    """question_id, intent, answer, confidence for questions(question_id, doc_id, question) from a document's items(doc_id, category, value,
    confidence, evidence, position) and documents(doc_id, text, department, status): a sentence by the question's intent."""
    from ..functions import text as T

    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("category").isin(*c), F.struct("position", "value", "confidence", "evidence")))), lambda x: F.struct(x["value"].alias("value"), x["confidence"].alias("confidence"), x["evidence"].alias("evidence")))
    kinds = {"people": ("person",), "organizations": ("organization",), "dates": ("date", "deadline"), "deadlines": ("deadline",), "amounts": ("amount",), "cases": ("case_number", "fir_number", "reference_number"), "places": ("location",)}
    held = items.groupBy("doc_id").agg(*[of(c).alias(name) for name, c in kinds.items()])
    rows = questions.join(documents, "doc_id", "left").join(held, "doc_id", "left").withColumn("intent", T.intent(F.col("question")))
    none = F.array().cast("array<struct<value:string,confidence:double,evidence:string>>")
    for name in kinds:
        rows = rows.withColumn(name, F.coalesce(name, none))
    values = lambda c, n: F.array_join(F.transform(F.slice(c, 1, n), lambda x: x["value"]), ", ")
    first = lambda c, f: F.try_element_at(F.col(c), F.lit(1))[f]
    some = lambda c: F.size(c) > 0
    low, status = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("status", F.lit("")))
    words = F.concat_ws(", ", *[F.when(low.contains(w), w) for w in ACTIVE])
    dept = F.coalesce("department", F.lit(""))
    expiring = F.filter("dates", lambda d: F.lower(d["evidence"]).contains("expir") | F.lower(d["evidence"]).contains("valid"))
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    about = F.concat_ws(" ", F.lit("This document holds what follows."), F.when(some("people"), say("It mentions: ", values("people", 3), ".")), F.when(some("organizations"), say("Organizations involved: ", values("organizations", 3), ".")), F.when(some("dates"), say("Key dates: ", values("dates", 3), ".")), F.when(some("cases"), say("Case references: ", values("cases", 3), ".")))
    # fixed values: the sentences of the answers and how sure they are
    rules = {
        "about": (about, F.lit(0.80)),
        "department": (F.when(dept != "", say("This document was issued by: ", dept, ".")).when(some("organizations"), say("The issuing authority appears to be: ", first("organizations", "value"), ".")).otherwise("The issuing department could not be determined from the document."), F.when(dept != "", 0.90).when(some("organizations"), first("organizations", "confidence")).otherwise(0.2)),
        "verified": (F.when(status == "verified", "Yes, this document is verified.").when(status == "pending", "This document is pending verification.").when(status == "rejected", "This document has been rejected during verification.").when(status == "expired", "This document's verification has expired.").otherwise("The verification status is not available for this document."), F.when(status.isin("verified", "rejected"), 0.95).when(status.isin("pending", "expired"), 0.90).otherwise(0.3)),
        "deadline": (F.when(some("deadlines"), say("The deadline is: ", first("deadlines", "value"), ".")).when(F.size(expiring) > 0, say("No explicit deadline found, but an expiry/validity date is: ", F.try_element_at(expiring, F.lit(1))["value"], ".")).otherwise("No deadline or expiry date was found in this document."), F.when(some("deadlines"), first("deadlines", "confidence")).when(F.size(expiring) > 0, F.try_element_at(expiring, F.lit(1))["confidence"] * 0.8).otherwise(0.5)),
        "ongoing_case": (F.when(some("cases") & (words != ""), say("Yes, there appears to be an ongoing case: ", first("cases", "value"), ". Keywords found: ", words, ".")).when(some("cases"), say("A case reference was found (", first("cases", "value"), "), but it's unclear if it's currently active.")).otherwise("No ongoing case references were found in this document."), F.when(some("cases") & (words != ""), 0.80).when(some("cases"), 0.5).otherwise(0.6)),
        "person": (F.when(some("people"), say("The following people are mentioned: ", values("people", 5), F.when(F.size("people") > 5, "...").otherwise(""), ".")).otherwise("No person names could be extracted from this document."), F.when(some("people"), 0.80).otherwise(0.4)),
        "date": (F.when(some("dates"), say("Important dates found: ", values("dates", 5), ".")).otherwise("No dates were found in this document."), F.when(some("dates"), 0.85).otherwise(0.5)),
        "amount": (F.when(some("amounts"), say("Amounts found: ", values("amounts", 5), ".")).otherwise("No monetary amounts were found in this document."), F.when(some("amounts"), 0.85).otherwise(0.5)),
        "location": (F.when(some("places"), say("Locations found: ", values("places", 5), ".")).otherwise("No specific locations could be extracted from this document."), F.when(some("places"), 0.75).otherwise(0.4)),
    }
    every = F.concat(*kinds)
    asked = F.filter(F.split(F.lower("question"), " "), lambda w: F.length(w) > 3)
    fit = F.filter(every, lambda x: F.exists(asked, lambda w: F.lower(x["value"]).contains(w) | F.lower(x["evidence"]).contains(w)))
    answer = F.when(F.size(fit) > 0, say("Based on the document, relevant information found: ", F.array_join(F.array_distinct(F.transform(F.slice(fit, 1, 5), lambda x: x["value"])), ", "), ".")).otherwise("I could not find specific information to answer this question from the document.")
    confidence = F.when(F.size(fit) > 0, 0.6).otherwise(0.2)
    for name, (says, sure) in rules.items():
        answer, confidence = F.when(F.col("intent") == name, says).otherwise(answer), F.when(F.col("intent") == name, sure).otherwise(confidence)
    return rows.select("question_id", "intent", answer.alias("answer"), F.round(confidence, 4).alias("confidence"))
