"""Graph operators over vertices(id, ...) and edges(src, dst, type, confidence)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import grid
from ..functions.tables import checkpoint_dir, lean, written
from . import joins

# fixed values: colours of node types, and what fields of a document say about it
COLOURS = {"Person": "#818cf8", "Organization": "#f472b6", "Location": "#34d399", "Date": "#fbbf24", "Identifier": "#60a5fa", "Concept": "#60a5fa", "Attribute": "#94a3b8", "Document": "#475569", "Other": "#6b7280"}
FIELD_VERTICES = {
    "full_name": ("Person", "HAS_PERSON"), "applicant_name": ("Person", "HAS_APPLICANT"), "holder_name": ("Person", "HAS_HOLDER"), "deponent_name": ("Person", "HAS_DEPONENT"),
    "father_name": ("Person", "HAS_FATHER"), "mother_name": ("Person", "HAS_MOTHER"), "judge_name": ("Person", "HAS_JUDGE"), "advocate_name": ("Person", "HAS_ADVOCATE"),
    "party_a_name": ("Person", "HAS_PARTY_A"), "party_b_name": ("Person", "HAS_PARTY_B"), "issuing_authority": ("Organization", "ISSUED_BY"), "court_name": ("Organization", "FILED_IN"),
    "department": ("Organization", "SUBMITTED_TO"), "address": ("Address", "HAS_ADDRESS"), "applicant_address": ("Address", "HAS_ADDRESS"), "date_of_birth": ("Date", "HAS_DATE"),
    "issue_date": ("Date", "ISSUED_ON"), "date_filed": ("Date", "FILED_ON"), "statement_date": ("Date", "DATED"), "document_number": ("ID", "HAS_ID"),
    "application_number": ("ID", "HAS_APPLICATION_ID"), "case_number": ("ID", "HAS_CASE_ID"), "certificate_number": ("ID", "HAS_CERTIFICATE_ID"),
}
TIMES = ("issue_date", "date_of_birth", "effective_date", "upload_timestamp", "created_at", "filing_date")
INGESTED = {"officer": "handled_by", "department": "issued_by"}

#: Roots of forests, and centres, that are broadcast; more are joined by shuffle.
MOST_ROOTS = 200_000


def _kept(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def undirected(edges: DataFrame) -> DataFrame:
    """Each link in both directions once; loops and null ends go."""
    some = edges.select("src", "dst").where("src <> dst")
    return some.unionAll(some.select("dst", "src")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node reachable. Edges may repeat; loops and null ends go.

    Tasks first replace their edges by forests, where they lie, and a node's roots meet: it keeps the smallest, which is joined to the others.
    Only roots need rounds of smallest labels then; a node that is nobody's root takes its own one's. Ids are text or integers.
    """
    kind = edges.select("src").unionAll(edges.select("dst")).schema[0].dataType
    some = edges.where("src <> dst").select(F.col("src").cast(kind).alias("src"), F.col("dst").cast(kind).alias("dst"))
    stars = some.mapInArrow(_forest, f"src {kind.simpleString()}, dst {kind.simpleString()}")
    stars = written(stars.groupBy("src").agg(F.min("dst").alias("dst"), F.collect_set("dst").alias("all")), "stars")
    roots = _kept(stars.select(F.explode("all").alias("root")).distinct())
    # more roots are joined by shuffle
    small = F.broadcast if roots.count() <= MOST_ROOTS else lambda df: df
    joined = stars.where("size(all) > 1").select(F.explode("all").alias("src"), "dst").where("src <> dst")
    labels = _labels(joined.unionAll(stars.join(small(roots), stars.src == roots.root, "left_semi").select("src", "dst")))
    of = _kept(roots.join(labels, roots.root == labels.node, "left").select("root", F.coalesce("component", "root").alias("component")))
    leaves = stars.join(small(roots), stars.src == roots.root, "left_anti")
    return _kept(leaves.join(small(of), leaves.dst == of.root).select(F.col("src").alias("node"), "component").unionAll(of.select(F.col("root").alias("node"), "component")))


def _forest(batches, most: int = 1_000_000):
    """(src, dst): each node of a task's edges with the smallest that they join to it, which is its root; after most nodes it starts afresh."""
    import pyarrow as pa

    up: dict = {}

    def root(x):
        while (y := up[x]) != x:
            up[x] = x = up[y]
        return x

    def stars(kind):
        rows = [(x, root(x)) for x, y in up.items() if x != y]
        for i in range(0, len(rows), 100_000):
            part = rows[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], kind), pa.array([r[1] for r in part], kind)], names=["src", "dst"])

    kind = None
    for batch in batches:
        kind = batch.schema.field("src").type
        for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
            a, b = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            if a < b:
                up[b] = a
            elif b < a:
                up[a] = b
        if len(up) > most:
            yield from stars(kind)
            up.clear()
    yield from stars(kind)


def _labels(edges: DataFrame) -> DataFrame:
    """node, component by rounds: smallest labels spread and jump; every round is checkpointed."""
    both = _kept(undirected(edges))
    labels = _kept(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("component")))
    while True:
        near = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.node == near.src).select("node", "component", F.least("component", "near").alias("low"))
        to = labels.select(F.col("node").alias("at"), F.col("component").alias("further"))
        new = low.join(to, low.low == to["at"]).select("node", F.least("low", "further").alias("component"), (F.least("low", "further") < F.col("component")).alias("moved"))
        new = _kept(new)
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels


def fraud_clusters(vertices: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """component, n_nodes, density, risk, indicators of components of least nodes or more with a risk over .1: one citizen with five documents
    or more .3, three cases .2, three departments .1, a density over .5 .2. vertices(id, type)."""
    parts = components(edges)
    n = lambda t: F.count_if(F.col("type") == t).alias(t)
    kinds = parts.join(vertices, parts.node == vertices.id, "left").groupBy("component").agg(n("citizen"), n("document"), n("case"), n("department"))
    both = clusters(edges, least, parts).join(kinds, "component")
    marks = [((F.col("citizen") == 1) & (F.col("document") >= 5), 0.3, "Single citizen with many documents"), (F.col("case") >= 3, 0.2, "Multiple cases in cluster"), (F.col("department") >= 3, 0.1, "Cross-department connections"), (F.col("density") > 0.5, 0.2, "Dense cluster")]
    risk = sum((F.when(c, w).otherwise(0.0) for c, w, _ in marks), F.lit(0.0))
    found = both.select("component", "n_nodes", "density", F.round(risk, 3).alias("risk"), F.concat_ws("; ", *[F.when(c, text) for c, _, text in marks]).alias("indicators"))
    return found.where("risk > 0.1")


def clustering(edges: DataFrame) -> DataFrame:
    """id, degree, triangles, coefficient of each node of the undirected graph.

    Each link points to its end of higher degree, so a hub's links come in and not out: the pairs of out-links that are tried number at most
    the links to the power 1.5.
    """
    both = _kept(undirected(edges))
    degree = both.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    ranked = both.join(degree.toDF("src", "ds"), "src").join(degree.toDF("dst", "dd"), "dst").where("struct(ds, src) < struct(dd, dst)").select("src", "dst", "dd")
    x, y = ranked.toDF("apex", "b", "db"), ranked.toDF("apex", "c", "dc")
    wedges = x.join(y, "apex").where("struct(db, b) < struct(dc, c)").select("apex", "b", "c")
    closed = wedges.join(ranked.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    counts = closed.select(F.explode(F.array("apex", "b", "c")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
    out = degree.join(counts, "id", "left").withColumn("triangles", F.coalesce("triangles", F.lit(0)))
    return out.withColumn("coefficient", F.round(F.coalesce(F.try_divide(2.0 * F.col("triangles"), F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)), 6))


def clusters(edges: DataFrame, least: int = 3, parts: DataFrame | None = None) -> DataFrame:
    """component, n_nodes, n_edges, density (of a directed graph) of components with at least least nodes; parts, if they are known."""
    parts = components(edges) if parts is None else parts
    ends = edges.where("src <> dst").select("src", "dst").distinct().groupBy("src").agg(F.count("*").alias("n"))
    inside = ends.join(parts, ends.src == parts.node).groupBy("component").agg(F.sum("n").alias("n_edges"))
    size = parts.groupBy("component").agg(F.count("*").alias("n_nodes")).where(F.col("n_nodes") >= least)
    return size.join(inside, "component").withColumn("density", F.round(F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1)), 6))


def neighbourhood(edges: DataFrame, centres: DataFrame, depth: int = 2) -> DataFrame:
    """centre, node, hops: nodes within depth steps in either direction, with the fewest steps. Edges may repeat; ids are text.

    All ways of a centre with a single neighbour go through it, so such centres share what lies around that one; their rows are made last and
    aren't shuffled. Other centres are dealt to groups by ranges of their ids, and a node sends the list of its neighbours once to each group that has centres
    before it, not once for each centre. Lists are dealt by a hash of the neighbour where a node has more than SPLIT; sorted and as text, which takes less than
    half of an array's bytes.
    """
    some = edges.where("src <> dst").select("src", "dst")
    both = some.unionAll(some.select("dst", "src"))
    most = both.groupBy("src").count().agg(F.max("count")).first()[0] or 1
    keys = -(-most // SPLIT)
    lists = both.groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(keys)).cast("int").alias("key")).agg(F.array_sort(F.collect_set("dst")).alias("nodes"))
    lists = lists.select("src", "key", F.size("nodes").alias("n"), F.element_at("nodes", 1).alias("low"), F.to_json("nodes").alias("nodes"))
    return _around(written(lists, "lists"), centres.select("id").distinct(), depth)


def _around(lists: DataFrame, centres: DataFrame, depth: int) -> DataFrame:
    """centre, node, hops around distinct centres(id); lists(src, key, n, low, nodes) has the neighbours of each node, dealt to keys, their number and the lowest."""
    own = centres.select(F.col("id").alias("centre"), F.col("id").alias("node"), F.lit(0).alias("hops"))
    if depth < 1:
        return own
    degree = lists.groupBy("src").agg(F.sum("n").alias("n"), F.min("low").alias("via"))
    dealt = written(centres.hint("merge").join(degree, centres.id == degree.src, "left").select("id", "via", F.coalesce("n", F.lit(0)).alias("n")), "centres")
    own = dealt.select(F.col("id").alias("centre"), F.col("id").alias("node"), F.lit(0).alias("hops"))
    near = lambda some: _of(lists, some.select(F.col("id").alias("src"))).select(F.col("src").alias("centre"), "key", "nodes")
    each = lambda nodes: F.explode(F.from_json(nodes, "array<string>"))
    if depth == 1:
        return own.unionAll(near(dealt.where("n > 0")).select("centre", each("nodes").alias("node"), F.lit(1).alias("hops")))
    leaves, others, out = dealt.where("n = 1").select(F.col("id").alias("centre"), "via"), dealt.where("n > 1"), own
    if not leaves.isEmpty():
        around = written(_around(lists, leaves.select(F.col("via").alias("id")).distinct(), depth - 1), "around")
        out = out.unionAll(_shared(leaves, around.select(F.col("centre").alias("via"), "node", (F.col("hops") + 1).alias("hops"))))
    if others.isEmpty():
        return out
    tasks = int(lean(lists.sparkSession).conf.get("spark.sql.shuffle.partitions"))
    # the table keeps what group a centre is in
    first = written(near(others).repartitionByRange(tasks, "centre").withColumn("g", F.spark_partition_id()), "around")
    found = first.select("g", "key", F.lit(1).alias("hops"), F.to_json(F.array("centre")).alias("centres"), "nodes")
    level = first.select("g", "centre", each("nodes").alias("via"))
    for h in range(2, depth + 1):
        # the groups of a node lie together already, so they meet its lists where they are
        before = level.repartition(tasks, "via").groupBy("via", "g").agg(F.to_json(F.array_sort(F.collect_list("centre"))).alias("centres"))
        after = lists.select(F.col("src").alias("via"), "key", "nodes").repartition(tasks, "via")
        ways = before.hint("merge").join(after, "via").select("g", "key", F.lit(h).alias("hops"), "centres", "nodes")
        # neighbouring groups go to different tasks
        cells = found.unionAll(ways).repartitionById(tasks, F.pmod(F.col("g") + F.col("key") * 7919, F.lit(tasks)).cast("int")).sortWithinPartitions("g", "key")
        last = cells.mapInArrow(_nearest, "g int, key int, centre string, node string, hops int")
        if h < depth:
            last = written(last, "around")
            found = last.groupBy("g", "key", "hops", "centre").agg(F.to_json(F.array_sort(F.collect_list("node"))).alias("nodes")).select("g", "key", "hops", F.to_json(F.array("centre")).alias("centres"), "nodes")
            level = last.where(F.col("hops") == h).select("g", "centre", F.col("node").alias("via"))
    return out.unionAll(last.select("centre", "node", "hops"))


def _of(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """lists(src, ...) of distinct nodes(src); few nodes are broadcast."""
    return lists.join(F.broadcast(nodes), "src") if nodes.count() <= MOST_ROOTS else grid.shuffled(lists, nodes, ["src"])


def _nearest(batches, most: int = 2_000_000):
    """(g, key, centre, node, hops): the least hops of each centre to each other node. A row of batches(g, key, hops, centres, nodes) says that all its centres reach all its
    nodes (lists as JSON); the rows of a cell (g, key) follow each other. A cell is held as codes of its ids, and about most ways are looked through at a time."""
    import json

    import pyarrow as pa

    cell, held, codes = None, [], {}

    def coded(column):
        rows = json.loads("[" + ",".join(column.to_pylist()) + "]")
        flat = pa.array([x for row in rows for x in row], pa.string()).dictionary_encode()
        known = np.array([codes.setdefault(x, len(codes)) for x in flat.dictionary.to_pylist()], np.int32)
        return np.array([len(row) for row in rows]), known[flat.indices.to_numpy()]

    for batch in batches:
        g, key = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("g", "key"))
        cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(key) != 0)) + 1).tolist(), len(g)] if len(g) else [0]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if cell not in (None, (g[a], key[a])):
                yield from _least(cell, held, codes, most)
                held.clear(), codes.clear()
            cell, part = (g[a], key[a]), batch.slice(a, b - a)
            hops, centres, nodes = (part.column(part.schema.get_field_index(c)) for c in ("hops", "centres", "nodes"))
            held.append((hops.to_numpy(), *coded(centres), *coded(nodes)))
    if held:
        yield from _least(cell, held, codes, most)


def _least(cell: tuple, held: list, codes: dict, most: int):
    """The rows of _nearest for one cell; held has the rows' hops, numbers of centres, centres, numbers of nodes, and nodes."""
    import pyarrow as pa

    hops, centres, centre, sizes, node = (np.concatenate(x) for x in zip(*held, strict=True))
    names, n, d = pa.array(list(codes), pa.string()), len(codes), int(hops.max()) + 1
    order = np.argsort(centre, kind="stable")
    centre, row = centre[order].astype(np.int64), np.repeat(np.arange(len(hops)), centres)[order]
    start, size = np.cumsum(sizes) - sizes, sizes[row].astype(np.int64)
    end, at, rest = np.cumsum(size), 0, np.zeros(0, np.int64)
    while at < len(centre):
        to = max(at + 1, int(np.searchsorted(end, end[at] - size[at] + most, side="right")))
        s = size[at:to]
        flat = np.repeat(start[row[at:to]] - (np.cumsum(s) - s), s) + np.arange(s.sum())
        way = (np.repeat(centre[at:to] * n, s) + node[flat]) * d + np.repeat(hops[row[at:to]], s)
        way = np.sort(np.concatenate([rest, way]))
        pair = way // d
        first = np.r_[True, pair[1:] != pair[:-1]][: len(pair)]
        way, pair = way[first], pair[first]
        # the last centre may go on in the next piece
        goes_on = pair // n == centre[to] if to < len(centre) else np.zeros(len(pair), bool)
        rest, way, pair = way[goes_on], way[~goes_on], pair[~goes_on]
        other = pair // n != pair % n
        way, pair = way[other], pair[other]
        for i in range(0, len(pair), 100_000):
            p, w = pair[i : i + 100_000], way[i : i + 100_000]
            ends = [names.take(pa.array(x)) for x in (p // n, p % n)]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(p), x, np.int32)) for x in cell), *ends, pa.array((w % d).astype(np.int32))], names=["g", "key", "centre", "node", "hops"])
        at = to


def _shared(leaves: DataFrame, around: DataFrame) -> DataFrame:
    """centre, node, hops: every centre of leaves(centre, via) beside every other node of around(via, node, hops). Both sides are packed to lists of
    about SPLIT ids, and each pair of lists is a key of its own, so what is shuffled is small beside the outcome and nothing is broadcast."""

    def packed(df: DataFrame, by: list[str], id_: str, part: str) -> tuple[DataFrame, int]:
        most = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 1
        parts = -(-most // SPLIT)
        return written(df.groupBy(*by, F.pmod(F.xxhash64(id_), F.lit(parts)).cast("int").alias(part)).agg(F.collect_list(id_).alias(id_)), "packed"), parts

    (left, ours), (right, theirs) = packed(leaves, ["via"], "centre", "ours"), packed(around, ["via", "hops"], "node", "theirs")
    left = left.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.lit(theirs - 1))))
    right = right.withColumn("ours", F.explode(F.sequence(F.lit(0), F.lit(ours - 1))))
    met = grid.shuffled(left, right, ["via", "ours", "theirs"]).select("hops", "node", F.explode("centre").alias("centre"))
    return met.select("centre", F.explode("node").alias("node"), "hops").where("node <> centre")


def simple_paths(edges: DataFrame, starts: DataFrame, hops: int = 3, pairs: DataFrame | None = None) -> DataFrame:
    """start, end, path (nodes joined by '>'), hops: directed paths from starts without a repeated node; with pairs(start, end), those of the pairs.

    Then a path only goes on to nodes from which its end can still be reached in the steps that are left: distances to the ends are labelled
    first, so ways that lead nowhere aren't followed.
    """
    step = edges.select("src", "dst").where("src <> dst").distinct()
    if pairs is not None:
        near = pairs.select("end", F.col("end").alias("node")).distinct().withColumn("left", F.lit(0))
        level = near
        for h in range(1, hops):
            level = level.join(step.toDF("before", "node"), "node").select("end", F.col("before").alias("node"), F.lit(h).alias("left")).distinct()
            near = near.unionAll(level)
        near = _kept(near.groupBy("end", F.col("node").alias("next")).agg(F.min("left").alias("left")))
        asked = pairs.join(starts.select(F.col("id").alias("start")), "start", "left_semi").select("start", "end").distinct()
        level, out = asked.select("end", F.array("start").alias("nodes")), None
        for h in range(1, hops + 1):
            here = level.withColumn("at", F.element_at("nodes", -1)).where(F.col("at") != F.col("end")).join(step.toDF("at", "next"), "at").where(~F.array_contains("nodes", F.col("next")))
            level = _kept(here.join(near.where(F.col("left") <= hops - h), ["end", "next"]).select("end", F.concat("nodes", F.array("next")).alias("nodes")))
            rows = level.where(F.element_at("nodes", -1) == F.col("end")).select(F.element_at("nodes", 1).alias("start"), "end", F.array_join("nodes", ">").alias("path"), F.lit(h).alias("hops"))
            out = rows if out is None else out.unionAll(rows)
        return out
    level = starts.select(F.array("id").alias("nodes"))
    out = None
    for h in range(1, hops + 1):
        joined = level.join(step, F.element_at("nodes", -1) == step.src).where(~F.array_contains("nodes", F.col("dst")))
        level = joined.select(F.concat("nodes", F.array("dst")).alias("nodes"))
        rows = level.select(F.element_at("nodes", 1).alias("start"), F.element_at("nodes", -1).alias("end"), F.array_join("nodes", ">").alias("path"), F.lit(h).alias("hops"))
        out = rows if out is None else out.unionAll(rows)
    return out


def relation_path(edges: DataFrame, start: DataFrame, types: list[str]) -> DataFrame:
    """id: nodes reached over edges of the types in order; a node counts once for each way."""
    at = start.select("id")
    for t in types:
        at = at.join(edges.where(F.col("type") == t), at.id == F.col("src")).select(F.col("dst").alias("id"))
    return at


def neighbours(edges: DataFrame, direction: str = "both") -> DataFrame:
    """id, type, other: a node's neighbours out, in, or both."""
    out = edges.select(F.col("src").alias("id"), "type", F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("id"), "type", F.col("src").alias("other"))
    return out if direction == "out" else into if direction == "in" else out.unionAll(into)


def centrality(edges: DataFrame) -> DataFrame:
    """id, degree, centrality: links at either end over the number of other nodes."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    n = ends.agg(F.count("*").alias("n"))
    return ends.join(F.broadcast(n), F.lit(True)).select("id", "degree", F.round(F.coalesce(F.try_divide("degree", F.col("n") - 1), F.lit(0.0)), 6).alias("centrality"))


def upsert(mentions: DataFrame) -> DataFrame:
    """key, type, freq, confidence, metadata: one vertex per lower-case name and type; the latest metadata wins."""
    return mentions.groupBy(F.lower("name").alias("key"), "type").agg(F.count("*").alias("freq"), F.max("confidence").alias("confidence"), F.max_by("metadata", F.struct("at", "metadata")).alias("metadata"))


#: Edges at a node that meet in one key; the edges of a larger node are dealt to several keys on both sides.
SPLIT = 1000


def two_steps(first: DataFrame, second: DataFrame, split: int = SPLIT) -> DataFrame:
    """x, y: every edge of first beside every edge of second that starts where it ends, but for ways back to the start, as structs. A hub's
    edges in and out are dealt to groups of about split, and each pair of groups is a key, so no task makes all ways through a hub."""
    parts = lambda df, end, name: df.groupBy(F.col(end).alias("node")).agg(F.ceil(F.count("*") / split).cast("int").alias(name))
    sizes = parts(first, "dst", "in").join(parts(second, "src", "out"), "node")
    x = first.select(F.col("dst").alias("node"), F.struct(*first.columns).alias("x")).join(sizes, "node")
    y = second.select(F.col("src").alias("node"), F.struct(*second.columns).alias("y")).join(sizes, "node")
    x = x.select("node", "x", F.pmod(F.xxhash64("x.src"), F.col("in")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("out") - 1)).alias("j"))
    y = y.select("node", "y", F.pmod(F.xxhash64("y.dst"), F.col("out")).cast("int").alias("j"), F.explode(F.sequence(F.lit(0), F.col("in") - 1)).alias("i"))
    return x.join(y, ["node", "i", "j"]).where("x.src <> y.dst").select("x", "y")


def inferred(edges: DataFrame, transitive: str = "is_a", inverse: dict[str, str] | None = None) -> DataFrame:
    """New edges: one transitive step (confidences multiplied, times .9) and inverses (times .95), each with its best confidence; no edge that exists."""
    inverse = {"part_of": "has_part", "uses": "used_by"} if inverse is None else inverse
    typed = edges.where(F.col("type") == transitive).select("src", "dst", "confidence")
    two = two_steps(typed, typed).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"), F.lit(transitive).alias("type"), (F.col("x.confidence") * F.col("y.confidence") * 0.9).alias("confidence"))
    pairs = F.create_map(*[F.lit(v) for kv in inverse.items() for v in kv])
    back = edges.where(F.col("type").isin(list(inverse))).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.element_at(pairs, F.col("type")).alias("type"), (F.col("confidence") * 0.95).alias("confidence"))
    best = two.unionByName(back).groupBy("src", "dst", "type").agg(F.round(F.max("confidence"), 6).alias("confidence"))
    return best.join(edges.select("src", "dst", "type"), ["src", "dst", "type"], "left_anti")


def suggestions(edges: DataFrame) -> DataFrame:
    """src, dst, score: second neighbours that aren't neighbours; the product of the confidences, the best of the ways."""
    slim = edges.select("src", "dst", "confidence")
    two = two_steps(slim, slim).select(F.col("x.src").alias("src"), F.col("y.dst").alias("dst"), (F.col("x.confidence") * F.col("y.confidence")).alias("score"))
    return two.groupBy("src", "dst").agg(F.round(F.least(F.max("score"), F.lit(1.0)), 6).alias("score")).join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def type_counts(rows: DataFrame) -> DataFrame:
    """type, n: how many vertices or edges there are of each type."""
    return rows.groupBy("type").agg(F.count("*").alias("n"))


def top_by_degree(edges: DataFrame, n: int) -> DataFrame:
    """id, degree, centrality of the n nodes with the most links, ties to the smaller id."""
    return centrality(edges).orderBy(F.desc("degree"), "id").limit(n)


def key_entities(vertices: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """id, name, importance of the n best of vertices(id, name, freq, confidence): .6 of the degree over the highest, .3 of the frequency over 5
    (1 at most), .1 of the confidence."""
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    most = degrees.agg(F.max("degree").alias("most"))
    both = vertices.join(degrees, "id", "left").join(F.broadcast(most), F.lit(True))
    score = 0.6 * F.coalesce(F.col("degree") / F.col("most"), F.lit(0.0)) + 0.3 * F.least(F.lit(1.0), F.col("freq") / 5) + 0.1 * F.col("confidence")
    return both.select("id", "name", F.round(score, 6).alias("importance")).orderBy(F.desc("importance"), "id").limit(n)


def search(vertices: DataFrame, query: str, type_: str | None = None, least: float = 0.0, limit: int = 10) -> DataFrame:
    """Of vertices(id, name, type, confidence, freq, metadata map) those whose name or metadata contain the query in any case, the surest and
    most frequent first."""
    low = query.lower()
    hit = F.contains(F.lower("name"), F.lit(low)) | F.exists(F.map_values("metadata"), lambda v: F.coalesce(F.contains(F.lower(v), F.lit(low)), F.lit(False)))
    rows = vertices.where(F.coalesce(hit, F.contains(F.lower("name"), F.lit(low)))).where(F.col("confidence") >= least)
    rows = rows.where(F.col("type") == type_) if type_ else rows
    return rows.orderBy(F.desc("confidence"), F.desc("freq"), "id").limit(limit)


def lookup(vertices: DataFrame, names: DataFrame) -> DataFrame:
    """asked, id, name for names(asked): the vertex of that lower-case name, else the shortest that contains it, ties to the smaller id; names
    without one give no row. Exact names meet by equality; only what is left is looked for inside names."""
    low = names.select("asked", F.lower(F.trim("asked")).alias("low")).distinct()
    exact = low.join(vertices.select("id", "name", F.lower("name").alias("low")), "low").groupBy("asked").agg(F.min(F.struct(F.length("name").alias("n"), "id", "name")).alias("v"))
    rest = low.join(exact.select("asked"), "asked", "left_anti")
    # what isn't a name is looked for inside all names: the names are the texts and what is asked the dictionary
    inside = joins.mentions(vertices.select(F.col("id").alias("doc_id"), F.col("name").alias("text")), rest.select(F.col("low").alias("name")))
    part = inside.toDF("id", "low").join(rest, "low").join(vertices.select("id", "name"), "id").groupBy("asked").agg(F.min(F.struct(F.length("name").alias("n"), "id", "name")).alias("v"))
    return exact.unionAll(part).select("asked", "v.id", "v.name")


def connections(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, type, direction, n, names: a node's neighbours by relation and direction, names in order."""
    named = vertices.select(F.col("id").alias("other"), "name")
    out = edges.select(F.col("src").alias("id"), "type", F.lit("outgoing").alias("direction"), F.col("dst").alias("other"))
    into = edges.select(F.col("dst").alias("id"), "type", F.lit("incoming").alias("direction"), F.col("src").alias("other"))
    return out.unionAll(into).join(named, "other", "left").groupBy("id", "type", "direction").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.coalesce("name", "other"))), "; ").alias("names"))


def with_ends(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices(id, name, type) and an entity 'Unknown-<id>' for each end of an edge that isn't among them."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct().join(vertices.select("id"), "id", "left_anti")
    return vertices.select("id", "name", "type").unionByName(ends.select("id", F.concat(F.lit("Unknown-"), "id").alias("name"), F.lit("Unknown").alias("type")))


def last_written(nodes: DataFrame) -> DataFrame:
    """A store of nodes(id, type, properties, at): the last write of an id counts."""
    return nodes.groupBy("id").agg(F.max_by(F.struct("type", "properties"), F.struct("at", "type")).alias("r")).select("id", "r.*")


def coloured(vertices: DataFrame, edges: DataFrame, colours: dict[str, str] | None = None) -> DataFrame:
    """id, name, type, colour, size for a drawing: the type's colour (Other's for others), 5 and one for each link, 15 at most."""
    colours = COLOURS if colours is None else colours
    known = F.create_map(*[F.lit(x) for kv in colours.items() for x in kv])
    degrees = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    size = 5 + F.least(F.lit(10), F.coalesce("degree", F.lit(0)))
    return vertices.join(degrees, "id", "left").select("id", "name", "type", F.coalesce(F.try_element_at(known, F.col("type")), F.lit(colours["Other"])).alias("colour"), size.cast("int").alias("size"))


def labelled(edges: DataFrame) -> DataFrame:
    """source, target, type, label: edges for a drawing, types with spaces."""
    return edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", F.replace("type", F.lit("_"), F.lit(" ")).alias("label"))


def populated(fields: DataFrame, least: float = 0.5) -> DataFrame:
    """src, dst, type, entity_type, confidence: edges from a document to the entities that fields(document_id, field, value, confidence) name;
    those under least, empty ones and fields without a meaning here give none. An entity's id is its type and value."""
    kinds = F.create_map(*[x for f, (t, r) in FIELD_VERTICES.items() for x in (F.lit(f), F.struct(F.lit(t).alias("t"), F.lit(r).alias("r")))])
    rows = fields.where(F.col("confidence") >= least).where("value <> ''").withColumn("k", F.try_element_at(kinds, F.col("field"))).where("k is not null")
    entity = F.replace(F.concat(F.col("k.t"), F.lit("_"), F.col("value")), F.lit(" "), F.lit("_"))
    return rows.select(F.col("document_id").alias("src"), entity.alias("dst"), F.col("k.r").alias("type"), F.col("k.t").alias("entity_type"), F.col("confidence").cast("double").alias("confidence"))


def ingested(docs: DataFrame, profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """vertices(id, name, type) and edges(src, dst, type) of docs(document_id, name, owner) and profiles(document_id, type, name): an owner owns the
    document, officers handle it, departments issue it; citizens, courts and institutions stand alone, courts as institutions."""
    key = lambda t, n: F.concat_ws(":", t, F.lower(n))
    kind = F.when(F.col("type") == "court", "institution").otherwise(F.col("type"))
    owners = docs.where("owner <> ''")
    people = profiles.where("name <> ''").select("document_id", kind.alias("type"), "name")
    vertices = docs.select(F.concat_ws(":", F.lit("document"), F.col("document_id").cast("string")).alias("id"), "name", F.lit("document").alias("type"))
    vertices = vertices.unionByName(owners.select(key(F.lit("citizen"), F.col("owner")).alias("id"), F.col("owner").alias("name"), F.lit("citizen").alias("type"))).unionByName(people.select(key(F.col("type"), F.col("name")).alias("id"), "name", "type"))
    vertices = vertices.groupBy("id", "type").agg(F.min("name").alias("name")).select("id", "name", "type")
    document = F.concat_ws(":", F.lit("document"), F.col("document_id").cast("string"))
    relation = F.try_element_at(F.create_map(*[F.lit(x) for kv in INGESTED.items() for x in kv]), F.col("type"))
    edges = owners.select(key(F.lit("citizen"), F.col("owner")).alias("src"), document.alias("dst"), F.lit("owns").alias("type"))
    edges = edges.unionByName(people.where(relation.isNotNull()).select(document.alias("src"), key(F.col("type"), F.col("name")).alias("dst"), relation.alias("type"))).distinct()
    return vertices, edges


def metadata_timeline(vertices: DataFrame) -> DataFrame:
    """date, id, event_type: a row for each time in the metadata map of vertices(id, metadata), to be sorted as text."""
    rows = vertices.select("id", F.explode(F.array(*[F.struct(F.lit(t).alias("k"), F.try_element_at("metadata", F.lit(t)).alias("date")) for t in TIMES])).alias("x"))
    return rows.where("x.date <> ''").select("x.date", "id", F.initcap(F.replace("x.k", F.lit("_"), F.lit(" "))).alias("event_type"))


def departments(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, officers, documents, cases of the departments: officers that belong to them, documents that they issued, cases that they point to."""
    typed = vertices.select("id", "type")
    into = edges.join(typed.toDF("src", "of"), "src").select(F.col("dst").alias("id"), ((F.col("of") == "officer") & (F.col("type") == "belongs_to")).cast("int").alias("o"), ((F.col("of") == "document") & (F.col("type") == "issued_by")).cast("int").alias("d"), F.lit(0).alias("c"))
    out = edges.join(typed.toDF("dst", "of"), "dst").select(F.col("src").alias("id"), F.lit(0).alias("o"), F.lit(0).alias("d"), (F.col("of") == "case").cast("int").alias("c"))
    sums = into.unionAll(out).groupBy("id").agg(F.sum("o").alias("o"), F.sum("d").alias("d"), F.sum("c").alias("c"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return vertices.where("type = 'department'").select("id").join(sums, "id", "left").select("id", zero("o", "officers"), zero("d", "documents"), zero("c", "cases"))


def merged_concepts(concepts: DataFrame, n: int = 15) -> DataFrame:
    """id, name, score, documents of the n best concepts over concepts(document_id, id, name, score): the highest score of each."""
    best = concepts.groupBy("id").agg(F.max_by("name", F.struct("score", "name")).alias("name"), F.max("score").alias("score"), F.countDistinct("document_id").alias("documents"))
    return best.orderBy(F.desc("score"), "id").limit(n)


def shared_entities(mentions: DataFrame) -> DataFrame:
    """name, documents: names of mentions(name, source) in more than one source."""
    return mentions.where("source <> ''").groupBy("name").agg(F.countDistinct("source").alias("documents")).where("documents > 1")


def key_relations(concepts: DataFrame, edges: DataFrame, n: int = 15) -> DataFrame:
    """a, b, type, confidence, hops for pairs a < b by rank of concepts(id, rank): the shortest way of two edges at most from a to b, its first edge's
    type and confidence; the surest, then the shortest. A null confidence comes last.

    Ways of two edges are ordered by their first edge's confidence and start, and so the first edges are gone through in that order, in
    batches that grow, until n pairs are found: no later one can precede them.
    """
    ranked = concepts.select("id", "rank")
    step = written(edges.select("src", "dst", "type", F.coalesce(-F.col("confidence"), F.lit(float("inf"))).alias("c")), "links")
    last = written(step.select(F.col("src").alias("via"), F.col("dst").alias("b")).distinct().join(ranked.toDF("b", "rb"), "b"), "links")
    first = step.join(ranked.toDF("src", "ra"), "src").select(F.col("src").alias("a"), "ra", F.col("dst").alias("via"), "type", "c")
    direct = first.join(ranked.toDF("via", "rb"), "via").where("ra < rb").groupBy("a", F.col("via").alias("b")).agg(F.min(F.struct("c", "type")).alias("w"))
    direct = written(direct.select("a", "b", "w.c", "w.type", F.lit(1).alias("hops")), "pairs")
    first = written(first.join(last.select("via").distinct(), "via", "left_semi"), "links")
    groups = written(first.select("c", "a").distinct(), "groups")
    order, found, size = ["c", "hops", "a", "b"], None, max(64, n)
    while (batch := written(groups.orderBy("c", "a").limit(size), "batch")).count():
        ways = first.join(batch, ["c", "a"]).join(last, "via").where("ra < rb and a <> b").groupBy("a", "b").agg(F.min(F.struct("c", "type")).alias("w"))
        ways = ways.select("a", "b", "w.c", "w.type", F.lit(2).alias("hops")).join(direct.select("a", "b"), ["a", "b"], "left_anti")
        # an earlier batch has a pair's surer way
        ways = ways if found is None else found.unionAll(ways.join(found.select("a", "b"), ["a", "b"], "left_anti"))
        found = written(ways.orderBy(*order).limit(n), "pairs")
        if found.count() >= n:
            break
        end = batch.orderBy(F.desc("c"), F.desc("a")).first()
        groups = groups.where((F.col("c") > end.c) | ((F.col("c") == end.c) & (F.col("a") > end.a)))
        size *= 16
    best = direct if found is None else direct.unionAll(found)
    return best.orderBy(*order).limit(n).select("a", "b", "type", F.when(F.col("c") < float("inf"), -F.col("c")).alias("confidence"), "hops")


def summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, name, n: numbers of vertices and edges, in all and by type, in long form."""
    of = lambda df, kind: df.groupBy(F.col("type").alias("name")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    total = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit("all").alias("name"), "n")
    return total(vertices, "vertices").unionAll(of(vertices, "vertices")).unionAll(total(edges, "edges")).unionAll(of(edges, "edges"))


def density(edges: DataFrame) -> DataFrame:
    """nodes, links, density, components of the directed graph of distinct links."""
    ends = edges.where("src <> dst").select("src", "dst").distinct()
    n = ends.select(F.explode(F.array("src", "dst")).alias("id")).agg(F.countDistinct("id").alias("nodes"))
    m = ends.agg(F.count("*").alias("links"))
    c = components(edges).agg(F.countDistinct("component").alias("components"))
    return n.join(m, F.lit(True)).join(c, F.lit(True)).select("nodes", "links", F.round(F.coalesce(F.try_divide(F.col("links"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)), 6).alias("density"), "components")
