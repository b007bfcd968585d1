"""Blocks of queries against blocks of rows, dealt to the cells of a grid of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import lean, written

#: Query blocks that meet in one cell at most, in the mean: what a task keeps per query is bounded by them.
GROUP = 16
#: Cells per shuffle partition, so that hashing evens out.
CELLS = 4
#: Kinds of blocks whose shapes are broadcast; more are joined by shuffle.
KINDS = 100_000


def numbered(blocks: DataFrame, name: str, most: int) -> DataFrame:
    """blocks with a column name: numbers below most, dealt in turn from a place that hangs on the partition. Write the outcome to a
    table before it is read twice."""
    return blocks.withColumn(name, F.pmod(_place(), F.lit(most)).cast("int"))


def _place():
    place = F.monotonically_increasing_id()
    return F.shiftright(place, 33) * 7 + place.bitwiseAND(F.lit((1 << 33) - 1))


def placed(blocks: DataFrame, name: str) -> DataFrame:
    """blocks with a column place, written to a table: blocks of one kind that follow each other have places that do."""
    return written(blocks.withColumn("place", _place()), name)


def shape(asked: int, held: int, tasks: int, group: int = GROUP) -> tuple[int, int]:
    """(groups of query blocks, parts of row blocks): a group has group query blocks, and there are enough parts to use all tasks."""
    groups = max(1, -(-asked // group))
    return groups, max(1, min(held, -(-tasks * CELLS // groups)))


def met(asked: DataFrame, held: DataFrame, groups: int, parts: int, by: list[str] | None = None) -> DataFrame:
    """Every block of asked (with a column group) beside every block of held (with part), or those with equal values of by. A block of asked is copied to the parts, and
    one of held to the groups; each cell of the grid is a key of its own, so no key grows with the tables."""
    left = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    right = held.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return shuffled(left, right, ["group", "part", *(by or [])]).drop("group", "part")


def met_alike(asked: DataFrame, held: DataFrame, by: list[str], tasks: int, group: int = GROUP) -> DataFrame:
    """Every block of asked beside every block of held with equal values of by; both are placed. Each kind of blocks has a grid of its own: a block of held is
    copied once for each group of group blocks of asked of its kind, not of all kinds, and a kind has its share of tasks * CELLS cells by the pairs in it."""
    kinds = asked.groupBy(*by).agg(F.count("*").alias("a")).join(held.groupBy(*by).agg(F.count("*").alias("h")), by)
    kinds = written(kinds.withColumn("groups", F.ceil(F.col("a") / group).cast("int")), "kinds")
    found = kinds.agg(F.count("*").alias("n"), F.sum(F.col("a") * F.col("h")).alias("pairs")).first()
    parts = F.ceil(tasks * CELLS * (F.col("a") * F.col("h") / (found.pairs or 1)) / F.col("groups"))
    kinds = kinds.select(*by, "groups", F.greatest(F.lit(1), F.least(parts, F.col("h"))).cast("int").alias("parts"))
    small = F.broadcast if found.n <= KINDS else lambda df: df
    number = lambda name: F.pmod(F.col("place"), F.col(f"{name}s")).cast("int").alias(name)
    every = lambda name: F.explode(F.sequence(F.lit(0), F.col(f"{name}s") - 1)).alias(name)
    left = asked.join(small(kinds), by).select(*asked.drop("place").columns, number("group"), every("part"))
    right = held.join(small(kinds), by).select(*held.drop("place").columns, number("part"), every("group"))
    return shuffled(left, right, [*by, "group", "part"], tasks).drop("group", "part")


def shuffled(left: DataFrame, right: DataFrame, key: list[str], tasks: int | None = None) -> DataFrame:
    """left and right joined by shuffle, whatever their files' sizes are: packed blocks are many times larger in memory than compressed, so
    a broadcast of them would fill the driver. A number of partitions that is asked for stays, so small tables use all tasks too."""
    spark = lean(left.sparkSession)
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(tasks, *key).hint("merge").join(right.repartition(tasks, *key), key)
