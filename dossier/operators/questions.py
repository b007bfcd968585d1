"""Questions as plans over a knowledge graph: a table of questions is read into plan rows, and each kind of plan is answered by one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import graph

# fixed values: the forms of questions, in the order in which they are tried; groups are a relation and a name, a name, or two names
FORMS = (
    ("relation", r"(?:what|which|who) (?:is|are) (?:the|a) (.+?) (?:of|for|related to) (.+?)\?"),
    ("relation", r"(?:how|why) (?:is|are) (.+?) (?:related to|connected to|associated with) (.+?)\?"),
    ("relation", r"(?:what|which) (.+?) (?:has|have|contains) (.+?)\?"),
    ("entity", r"(?:what|which|who) (?:is|are) (.+?)\?"),
    ("entity", r"(?:tell me about|describe) (.+?)(?:\.|$)"),
    ("path", r"(?:how is|what is the relationship between) (.+?) and (.+?)\?"),
    ("path", r"(?:how are) (.+?) and (.+?) (?:related|connected)\?"),
)
# fixed values: what a question is after, the first that fits
INTENTS = (
    ("comparison", r"(compare|comparison|difference|similarities? between)"),
    ("list", r"(list|what are|what is|examples of)"),
    ("explanation", r"(explain|why|how does|how do)"),
    ("relationship", r"(relationship|connection|related|link|associate)"),
)


def intent(question) -> F.Column:
    low, out = F.lower(question), F.lit("general")
    for name, pattern in reversed(INTENTS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def plans(questions: DataFrame, vertices: DataFrame) -> DataFrame:
    """query_id, kind, intent, relation, source, target of questions(query_id, question) over vertices(id, name): the first form that fits and whose
    names are names of vertices, in any case (of equal names the smallest id). Questions without one, null ones too, are of kind general."""
    low = F.lower(F.coalesce("question", F.lit("")))
    trimmed = lambda pattern, group: F.trim(F.regexp_extract(low, pattern, group))
    forms = []
    for nth, (kind, pattern) in enumerate(FORMS):
        if kind == "relation":
            parts = (trimmed(pattern, 1), trimmed(pattern, 2), F.lit(None).cast("string"))
        elif kind == "entity":
            parts = (F.lit(None).cast("string"), trimmed(pattern, 1), F.lit(None).cast("string"))
        else:
            parts = (F.lit(None).cast("string"), trimmed(pattern, 1), trimmed(pattern, 2))
        forms.append(F.when(low.rlike(pattern), F.struct(F.lit(nth).alias("nth"), F.lit(kind).alias("kind"), *(p.alias(n) for p, n in zip(parts, ("relation", "source_name", "target_name"), strict=True)))))
    read = questions.select("query_id", F.explode(F.array_compact(F.array(*forms))).alias("f")).select("query_id", "f.*")
    ids = vertices.where("name is not null").groupBy(F.lower("name").alias("name")).agg(F.min("id").alias("id"))
    read = read.join(ids.toDF("source_name", "source"), "source_name").join(ids.toDF("target_name", "target"), "target_name", "left")
    fits = read.where("kind <> 'path' or target is not null").groupBy("query_id").agg(F.min(F.struct("nth", "kind", "relation", "source", "target")).alias("p"))
    every = questions.select("query_id", intent(F.coalesce("question", F.lit(""))).alias("intent"))
    return every.join(fits, "query_id", "left").select("query_id", F.coalesce("p.kind", F.lit("general")).alias("kind"), "intent", "p.relation", "p.source", "p.target")


def answers(plans_: DataFrame, vertices: DataFrame, edges: DataFrame, hops: int = 3) -> DataFrame:
    """query_id, kind, id, name, relation, path: the rows that answer plans over vertices(id, name) and edges(src, dst, type).

    A relation question gives the neighbours over edges whose type contains the relation, an entity question all neighbours, a path question
    every simple path of at most hops steps, its nodes joined by '>', with its end as id. All plans of a kind are one join.
    """
    names = vertices.select("id", "name")
    near = plans_.where("kind in ('relation', 'entity')").join(edges.select("src", F.col("dst").alias("id"), "type"), F.col("source") == F.col("src"))
    near = near.where(F.col("kind").eqNullSafe("entity") | F.contains(F.lower("type"), F.col("relation")))
    near = near.join(names, "id").select("query_id", "kind", "id", "name", F.col("type").alias("relation"), F.lit(None).cast("string").alias("path"))
    asked = plans_.where("kind = 'path'").select("query_id", "kind", F.col("source").alias("start"), F.col("target").alias("end"))
    ways = graph.simple_paths(edges, asked.select(F.col("start").alias("id")).distinct(), hops, asked.select("start", "end").distinct())
    found = asked.join(ways, ["start", "end"]).join(names, F.col("end") == F.col("id"))
    return near.unionByName(found.select("query_id", "kind", "id", "name", F.lit(None).cast("string").alias("relation"), "path"))
