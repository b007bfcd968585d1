"""Stored tables that change in place: a manifest of versions over Parquet folders, a graph in key buckets, vectors in cells.

A change writes new folders first and then a new version of the manifest, which names all folders that count; a reader sees one version
or the next. What no version names any more is removed by vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import blocks
from ..functions.tables import checkpoint_dir
from ..operators import search, windows


class Manifest:
    """Versions of a list of entries (dicts): small files under path/manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._at = lambda *parts: jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        self.fs = self._at().getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; 0 before the first."""
        folder = self._at("manifest")
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max((int(n) for n in names if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"entries": [], "applied": [], "above": 0}
        return json.loads(self.spark.read.option("wholetext", True).text(f"{self.path}/manifest/{version}").first()[0])

    def commit(self, state: dict, seen: int) -> int:
        """Write the version after seen; fails if another writer was first."""
        name = f"{seen + 1}"
        draft, final = self._at("manifest", f"_draft-{uuid.uuid4().hex}"), self._at("manifest", name)
        out = self.fs.create(draft, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise ValueError(f"version {name} of {self.path} was written by another")
        return seen + 1

    def folder(self) -> str:
        return f"{self.path}/data/{uuid.uuid4().hex}"

    def vacuum(self, keep: int = 1) -> None:
        """Remove data that the keep newest versions don't name, and older versions."""
        newest = self.version()
        versions = range(max(1, newest - keep + 1), newest + 1)
        named = {e["folder"].rsplit("/", 1)[-1] for v in versions for e in self.read(v)["entries"]}
        for part, held in (("data", named), ("manifest", {str(v) for v in versions})):
            if self.fs.exists(self._at(part)):
                for s in self.fs.listStatus(self._at(part)):
                    if s.getPath().getName() not in held:
                        self.fs.delete(s.getPath(), True)


def applied(state: dict, batch: int) -> bool:
    return batch <= state["above"] or batch in state["applied"]


def with_batch(state: dict, batch: int) -> dict:
    """The record of applied batches with one more: all up to a number, and those beyond it that came early."""
    some, above = {*state["applied"], batch}, state["above"]
    while above + 1 in some:
        above += 1
        some.discard(above)
    return {"applied": sorted(some), "above": above}


class Buckets:
    """A table of rows with a key, in buckets by a hash of it; merge() rewrites only the buckets that a batch touches.

    combine brings rows of one key together: it takes the stored rows and the batch's as one DataFrame and gives a row per key, and must not
    depend on how rows came in batches. Batches have numbers from 1; one that was applied before is passed over, whatever the order.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, combine: Callable[[DataFrame], DataFrame], buckets: int = 64):
        self.spark, self.key, self.schema, self.combine, self.buckets = spark, key, schema, combine, buckets
        self.manifest = Manifest(spark, path)

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _read(self, entries: list[dict]) -> DataFrame:
        """The rows of the buckets of entries, each from the folder that counts."""
        out = self.spark.createDataFrame([], self.schema)
        for folder in sorted({e["folder"] for e in entries}):
            mine = [e["bucket"] for e in entries if e["folder"] == folder]
            rows = self.spark.read.schema(self.schema + ", bucket int").parquet(folder)
            out = out.unionByName(rows.where(F.col("bucket").isin(mine)).drop("bucket"))
        return out

    def load(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest.read(version)["entries"])

    def merge(self, batch: DataFrame, number: int) -> bool:
        """Apply a batch of rows; False if its number was applied before."""
        seen = self.manifest.version()
        state = self.manifest.read(seen)
        if applied(state, number):
            return False
        names = self.spark.createDataFrame([], self.schema).columns
        batch = batch.select(*names)
        touched = {r[0] for r in batch.select(self._bucket()).distinct().collect()}
        old = self._read([e for e in state["entries"] if e["bucket"] in touched])
        folder = self.manifest.folder()
        rows = self.combine(old.unionByName(batch)).select(*names).withColumn("bucket", self._bucket())
        rows.repartition(max(1, min(len(touched), int(self.spark.conf.get("spark.sql.shuffle.partitions")))), "bucket").write.partitionBy("bucket").parquet(folder)
        entries = [e for e in state["entries"] if e["bucket"] not in touched] + [{"bucket": b, "folder": folder} for b in sorted(touched)]
        self.manifest.commit({"entries": entries} | with_batch(state, number), seen)
        return True


class Numbers:
    """Numbers that go on from batch to batch: high-water marks per type in a table, and the numbers of each batch as they were given."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.manifest = spark, Manifest(spark, path)

    def _schema(self, rows: DataFrame) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", number long"

    def assign(self, batch: DataFrame, by: str, order: str, number: int) -> DataFrame:
        """batch with number: in each type (column by) on from the type's mark, in the order of a column. A batch whose number was assigned before
        gets its old numbers. Rows are dealt by range, so a large type spreads over many tasks."""
        seen = self.manifest.version()
        state = self.manifest.read(seen)
        schema = self._schema(batch)
        for e in state["entries"]:
            if e.get("batch") == number:
                return self.spark.read.schema(schema).parquet(e["folder"])
        kind = f"`{by}` {batch.schema[by].dataType.simpleString()}, mark long"
        marks = self.spark.createDataFrame([], kind)
        for e in state["entries"]:
            marks = self.spark.read.schema(kind).parquet(e["folder"]) if "marks" in e else marks
        checkpoint_dir(self.spark)
        rows = windows.numbered(batch, by, order).join(marks.withColumnRenamed(by, "by_"), F.col(by).eqNullSafe(F.col("by_")), "left").withColumn("number", F.col("number") + F.coalesce("mark", F.lit(0)))
        folder, new = self.manifest.folder(), self.manifest.folder()
        rows.select(*batch.columns, F.col("number").cast("long").alias("number")).write.parquet(folder)
        given = self.spark.read.schema(schema).parquet(folder)
        given.select(by, F.col("number").alias("mark")).unionByName(marks).groupBy(by).agg(F.max("mark").alias("mark")).write.parquet(new)
        entries = [e for e in state["entries"] if "marks" not in e] + [{"folder": folder, "batch": number}, {"folder": new, "marks": True}]
        self.manifest.commit(state | {"entries": entries}, seen)
        return given


class GraphStore:
    """A stored knowledge graph: entities by lower-case name and type, relations by ends and type; events of a batch are merged into both."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.entities = Buckets(spark, f"{path}/entities", ["key", "type"], "key string, type string, freq long, confidence double, metadata string, at timestamp_ntz", self._entities, buckets)
        self.relations = Buckets(spark, f"{path}/relations", ["src", "dst", "type"], "src string, dst string, type string, confidence double, n long", self._relations, buckets)

    @staticmethod
    def _entities(rows: DataFrame) -> DataFrame:
        last = F.max(F.struct("at", "metadata")).alias("last")
        return rows.groupBy("key", "type").agg(F.sum("freq").alias("freq"), F.max("confidence").alias("confidence"), last).select("key", "type", "freq", "confidence", "last.metadata", "last.at")

    @staticmethod
    def _relations(rows: DataFrame) -> DataFrame:
        return rows.groupBy("src", "dst", "type").agg(F.max("confidence").alias("confidence"), F.sum("n").alias("n"))

    def merge(self, number: int, mentions: DataFrame | None = None, edges: DataFrame | None = None) -> bool:
        """Merge mentions(name, type, confidence, metadata, at) and edges(src, dst, type, confidence) of a batch. False if the batch was applied
        before; a batch that was cut short between the two is completed. Rows without a name or an end go."""
        new = False
        if mentions is not None:
            rows = mentions.where("name is not null").select(F.lower("name").alias("key"), "type", F.lit(1).cast("long").alias("freq"), F.col("confidence").cast("double").alias("confidence"), "metadata", "at")
            new |= self.entities.merge(self._entities(rows), number)
        if edges is not None:
            rows = edges.where("src is not null and dst is not null").select("src", "dst", "type", F.col("confidence").cast("double").alias("confidence"), F.lit(1).cast("long").alias("n"))
            new |= self.relations.merge(self._relations(rows), number)
        return new

    def load(self) -> tuple[DataFrame, DataFrame]:
        """key, type, freq, confidence, metadata of the entities; src, dst, type, confidence, n of the relations."""
        return self.entities.load().drop("at"), self.relations.load()


class VectorStore:
    """Vectors in cells around stored centres: adding appends a segment, deleting a list of ids, and compact() rewrites the cells that either
    touches. vec_id is a key: a vector that is added again replaces the one before."""

    SCHEMA = "vec_id long, embedding array<double>, label int, generation long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.manifest = spark, Manifest(spark, path)

    @classmethod
    def create(cls, vectors: DataFrame, path: str, cells: int = 64) -> VectorStore:
        """An empty store whose centres are fitted to a bounded sample of vectors(vec_id, embedding)."""
        store = cls(vectors.sparkSession, path)
        centres = blocks.pivots(blocks.usable(vectors), cells)
        rows = [(i, [float(x) for x in c]) for i, c in enumerate([] if centres is None else centres)]
        store.spark.createDataFrame(rows, "cell int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{store.manifest.path}/centres")
        if not store.manifest.version():
            store.manifest.commit({"entries": [], "applied": [], "above": 0, "generation": 0}, 0)
        return store

    def _state(self) -> tuple[int, dict]:
        seen = self.manifest.version()
        if not seen:
            raise ValueError(f"there is no store in {self.manifest.path}")
        return seen, self.manifest.read(seen)

    def centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.manifest.path}/centres").orderBy("cell").collect()
        return np.array([r.centre for r in rows])

    def _celled(self, rows: DataFrame) -> DataFrame:
        """rows(vec_id, embedding, ...) with the cell of the nearest centre by cosine; vectors of another length than the centres go to cell -1."""
        centres, names = self.centres(), rows.columns

        def celled(batches):
            for batch in batches:
                fits = batch["embedding"].map(len).to_numpy() == (centres.shape[1] if centres.ndim == 2 else -1)
                cell = np.full(len(batch), -1, np.int32)
                if fits.any():
                    cell[fits] = (np.stack(batch["embedding"][fits].to_numpy()) @ centres.T).argmax(axis=1)
                yield batch[names].assign(cell=cell)

        return rows.mapInPandas(celled, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", cell int")

    def _segments(self, state: dict, cells: set | None = None) -> DataFrame:
        out = self.spark.createDataFrame([], self.SCHEMA + ", cell int")
        held = [e for e in state["entries"] if e["kind"] == "cell" and (cells is None or e["cell"] in cells)]
        for folder in sorted({e["folder"] for e in held}):
            mine = [e["cell"] for e in held if e["folder"] == folder]
            out = out.unionByName(self.spark.read.schema(self.SCHEMA + ", cell int").parquet(folder).where(F.col("cell").isin(mine)))
        return out

    def _dead(self, state: dict) -> DataFrame:
        """vec_id, until: the generation up to which an id is deleted."""
        out = self.spark.createDataFrame([], "vec_id long, until long")
        for e in state["entries"]:
            if e["kind"] == "dead":
                out = out.unionByName(self.spark.read.schema("vec_id long, until long").parquet(e["folder"]))
        return out.groupBy("vec_id").agg(F.max("until").alias("until"))

    def _live(self, state: dict, cells: set | None = None) -> DataFrame:
        rows = self._segments(state, cells)
        if not any(e["kind"] == "dead" for e in state["entries"]):
            return rows
        return rows.join(self._dead(state), "vec_id", "left").where("until is null or generation > until").drop("until")

    def load(self) -> DataFrame:
        """vec_id, embedding, label of what the store holds."""
        return self._live(self._state()[1]).select("vec_id", "embedding", "label")

    def add(self, vectors: DataFrame) -> None:
        """Append vectors(vec_id, embedding, label); null ids, vectors and components are left out; of rows that repeat an id the largest counts."""
        seen, state = self._state()
        generation = state["generation"] + 1
        good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
        good = good.where("vec_id is not null and embedding is not null").where(F.forall("embedding", lambda x: x.isNotNull()))
        good = good.groupBy("vec_id").agg(F.max(F.struct("embedding", "label")).alias("r")).select("vec_id", "r.*").withColumn("generation", F.lit(generation).cast("long"))
        folder, dead = self.manifest.folder(), self.manifest.folder()
        self._celled(good).repartition("cell", F.pmod("vec_id", F.lit(8))).write.partitionBy("cell").parquet(folder)
        # partitionBy gives the cells as folders: their names tell which cells the segment has
        cells = [r.cell for r in self.spark.read.schema(self.SCHEMA + ", cell int").parquet(folder).select("cell").distinct().collect()]
        new = self.spark.read.schema(self.SCHEMA + ", cell int").parquet(folder).select("vec_id")
        again = self._segments(state).select("vec_id").distinct().join(new, "vec_id", "left_semi").withColumn("until", F.lit(generation - 1).cast("long"))
        again.write.parquet(dead)
        entries = state["entries"] + [{"kind": "cell", "cell": c, "folder": folder} for c in sorted(cells)]
        if not self.spark.read.parquet(dead).isEmpty():
            entries.append({"kind": "dead", "folder": dead})
        self.manifest.commit(state | {"entries": entries, "generation": generation}, seen)

    def delete(self, ids: DataFrame) -> None:
        """Delete the vectors of ids(vec_id); unknown ones don't matter."""
        seen, state = self._state()
        folder = self.manifest.folder()
        rows = ids.select(F.col("vec_id").cast("long").alias("vec_id")).where("vec_id is not null").distinct().withColumn("until", F.lit(state["generation"]).cast("long"))
        rows.write.parquet(folder)
        self.manifest.commit(state | {"entries": [*state["entries"], {"kind": "dead", "folder": folder}]}, seen)

    def count(self) -> int:
        return self._live(self._state()[1]).count()

    def get(self, ids: DataFrame) -> DataFrame:
        """The stored vectors of ids(vec_id)."""
        return self.load().join(ids.select(F.col("vec_id").cast("long").alias("vec_id")).distinct(), "vec_id", "left_semi")

    def clear(self) -> None:
        seen, state = self._state()
        self.manifest.commit(state | {"entries": []}, seen)

    def compact(self) -> list[int]:
        """Rewrite the cells that lie in several segments or hold deleted vectors, without these, and forget the deletions; the others stay where
        they are. Gives the rewritten cells."""
        seen, state = self._state()
        held = [e["cell"] for e in state["entries"] if e["kind"] == "cell"]
        touched = {c for c in held if held.count(c) > 1}
        gone = self._segments(state).select("vec_id", "cell", "generation").join(self._dead(state), "vec_id").where("generation <= until")
        touched |= {r.cell for r in gone.select("cell").distinct().collect()}
        entries = [e for e in state["entries"] if e["kind"] == "cell" and e["cell"] not in touched]
        if touched:
            folder = self.manifest.folder()
            self._live(state, touched).repartition("cell", F.pmod("vec_id", F.lit(8))).write.partitionBy("cell").parquet(folder)
            left = [r.cell for r in self.spark.read.schema(self.SCHEMA + ", cell int").parquet(folder).select("cell").distinct().collect()]
            entries += [{"kind": "cell", "cell": c, "folder": folder} for c in sorted(left)]
        self.manifest.commit(state | {"entries": entries}, seen)
        return sorted(touched)

    def save(self, path: str) -> VectorStore:
        """A copy of what the store holds now, in a store of its own with the same centres."""
        copy = VectorStore(self.spark, path)
        self.spark.read.parquet(f"{self.manifest.path}/centres").write.mode("overwrite").parquet(f"{copy.manifest.path}/centres")
        seen = copy.manifest.version()
        copy.manifest.commit({"entries": [], "applied": [], "above": 0, "generation": 0}, seen)
        copy.add(self.load())
        return copy

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None) -> DataFrame:
        """query_id, vec_id, score, rank: the k best by cosine for queries(vec_id, embedding), their own ids left out. Exact, or with probes among the
        vectors of the cells whose centres are nearest to the query."""
        rows = self._live(self._state()[1])
        if probes is None:
            found = blocks.best(queries, rows, blocks.cosines, k)
        else:
            centres = self.centres()

            def probed(batches):
                import pandas as pd

                for batch in batches:
                    some = batch[batch["embedding"].map(len) == centres.shape[1]]
                    if len(some):
                        near = np.argsort(-(np.stack(some["embedding"].to_numpy()) @ centres.T), axis=1, kind="stable")[:, :probes]
                        yield pd.DataFrame({"vec_id": np.repeat(some["vec_id"].to_numpy(), near.shape[1]), "embedding": some["embedding"].to_numpy().repeat(near.shape[1]), "cell": near.ravel()})

            asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
            found = blocks.best(asked.mapInPandas(probed, "vec_id long, embedding array<double>, cell int"), rows, blocks.cosines, k, "cell")
        best = found.groupBy("query_id", "vec_id").agg(F.round(F.max("score"), 6).alias("score"))
        return search.top(best, "query_id", [F.desc("score"), F.col("vec_id")], k)
