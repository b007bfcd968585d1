"""Ordered functions over events: trailing counts, first sightings, chains, latest versions, progress, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICRO = 1_000_000


def _micros(ts) -> F.Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


#: A time slice of a user's events is this many trailing intervals long.
SLICES = 16


def sliced(events: DataFrame, seconds: int) -> DataFrame:
    """events with us, slice and own: each event in its slice of time, and once more (own false) in the next one if it lies in the last seconds
    before it. So trailing intervals of seconds lie whole within (user_id, slice), and a user's events spread over many tasks."""
    width, step = seconds * MICRO, SLICES * seconds * MICRO
    timed = events.withColumn("us", _micros("ts"))
    at = F.floor(F.col("us") / step)
    near = (at + 1) * step - F.col("us") < width
    return timed.withColumn("in_", F.explode(F.when(near, F.array(at, at + 1)).otherwise(F.array(at)))).withColumn("own", F.col("in_") == at).withColumnRenamed("in_", "slice")


def failures_in_window(events: DataFrame, failed: str, success: str, seconds: int = 300, least: int = 5) -> DataFrame:
    """event_id, user_id, failures: failures with at least least of a user's in the last seconds (strictly less), none before the last success;
    of equal times the smaller event_id comes first. Only successes within the interval matter, so slices of time are counted apart."""
    mine = sliced(events.where(F.col("event_type").isin(failed, success)), seconds)
    so_far = Window.partitionBy("user_id", "slice").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = mine.withColumn("run", F.count_if(F.col("event_type") == success).over(so_far)).where(F.col("event_type") == failed)
    near = Window.partitionBy("user_id", "slice", "run").orderBy("us").rangeBetween(-(seconds * MICRO - 1), 0)
    later = Window.partitionBy("user_id", "slice", "run", "us").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    counted = run.withColumn("failures", F.count("*").over(near) - F.count("*").over(later)).where("own")
    return counted.where(F.col("failures") >= least).select("event_id", "user_id", "failures")


def access_rate(events: DataFrame, seconds: int = 60, most: int = 30, early: int = 8, late: int = 20) -> DataFrame:
    """event_id, recent, score, action: over most accesses in seconds .4, hours before early or after late (UTC) .15; under .3 allow, under .6 monitor, else block."""
    near = Window.partitionBy("user_id", "slice").orderBy("us").rangeBetween(-(seconds * MICRO - 1), 0)
    later = Window.partitionBy("user_id", "slice", "us").orderBy("event_id").rowsBetween(1, Window.unboundedFollowing)
    counted = sliced(events, seconds).withColumn("recent", F.count("*").over(near) - F.count("*").over(later)).where("own")
    hour = F.hour(F.col("ts"))
    score = F.when(F.col("recent") > most, 0.4).otherwise(0.0) + F.when((hour < early) | (hour > late), 0.15).otherwise(0.0)
    scored = counted.withColumn("score", F.round(score, 2))
    return scored.select("event_id", "recent", "score", F.when(F.col("score") < 0.3, "allow").when(F.col("score") < 0.6, "monitor").otherwise("block").alias("action"))


def novelty(events: DataFrame, value: str) -> DataFrame:
    """event_id, user_id: a user's events with a value not seen before, but for the user's very first. Firsts are aggregates, so no history is held."""
    order = F.struct("ts", "event_id")
    first = events.groupBy("user_id", value).agg(F.min(order).alias("at"))
    start = events.groupBy("user_id").agg(F.min(order).alias("start"))
    return first.join(start, "user_id").where("at <> start").select(F.col("at.event_id").alias("event_id"), "user_id")


def chained(rows: DataFrame, by: str, order: list[str], payload: list[str]) -> DataFrame:
    """rows with entry_hash, the SHA-256 of the payload columns joined by bars, and prev_hash, that of the row before in its chain ('' at first)."""
    own = rows.withColumn("entry_hash", F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in payload]), 256))
    return own.withColumn("prev_hash", F.lag("entry_hash", 1, "").over(Window.partitionBy(by).orderBy(*order)))


def chain_breaks(rows: DataFrame, by: str, order: list[str], payload: list[str]) -> DataFrame:
    """by, n_rows, n_broken: rows of a chain whose entry_hash isn't that of their payload or whose prev_hash isn't the row before's."""
    before = F.lag("entry_hash", 1, "").over(Window.partitionBy(by).orderBy(*order))
    whole = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in payload]), 256)
    bad = rows.withColumn("bad", ~(whole.eqNullSafe(F.col("entry_hash")) & before.eqNullSafe(F.col("prev_hash"))))
    return bad.groupBy(by).agg(F.count("*").alias("n_rows"), F.count_if("bad").alias("n_broken"))


def latest(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group as an aggregate (no sort of groups); ties by the order's later columns."""
    best = rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*order)).alias("r"))
    return best.select(*by, "r.*")


def progress(rows: DataFrame, stages: list[str]) -> DataFrame:
    """rows with progress: the stage's place among stages in per cent, 0 for unknown ones."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    return rows.withColumn("progress", F.when(place > 0, F.round(100.0 * (place - 1) / max(1, len(stages) - 1), 1)).otherwise(0.0))


def newest(rows: DataFrame, order: str, tie: str, n: int = 10_000) -> DataFrame:
    """A ring buffer's content: the n newest rows (each partition keeps n at most before they meet)."""
    return rows.orderBy(F.desc(order), F.desc(tie)).limit(n)


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    """rows with number, from 1 in each group (null is one) by order. Rows are dealt by range, so that a large group spreads over many tasks;
    each part counts its own, and the counts of the parts before are added. Needs a checkpoint folder (the parts must stay)."""
    dealt = rows.repartitionByRange(F.col(by), F.col(order)).withColumn("part_", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy(by, "part_").agg(F.count("*").alias("n_"))
    before = counts.select(F.col(by).alias("by_"), F.col("part_").alias("of_"), (F.sum("n_").over(Window.partitionBy(by).orderBy("part_")) - F.col("n_")).alias("before_"))
    nth = F.row_number().over(Window.partitionBy(by, "part_").orderBy(order))
    both = dealt.withColumn("nth_", nth).join(before, (F.col("part_") == F.col("of_")) & F.col(by).eqNullSafe(F.col("by_")))
    return both.withColumn("number", F.col("nth_") + F.col("before_")).drop("part_", "nth_", "before_", "by_", "of_")


def context(turns: DataFrame, by: str, order: str, most: int = 3000) -> DataFrame:
    """by, n_used, context: texts in order, joined, as long as their running length doesn't exceed most."""
    so_far = F.sum(F.length("text")).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    fit = turns.withColumn("sum_", so_far).where(F.col("sum_") <= most)
    held = fit.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(order, "text"))).alias("t"))
    return held.select(by, F.size("t").cast("long").alias("n_used"), F.array_join(F.transform("t", lambda x: x["text"]), "\n\n").alias("context"))


def novel_networks(logins: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """event_id, user_id, kind for each kind in columns (device, address, network and the like, as expressions): logins with a value of that kind
    that the user hasn't had before, but for the first that has any. Firsts are aggregates."""
    out = None
    for kind, value in columns.items():
        rows = logins.withColumn("value_", value).where("value_ <> ''")
        found = novelty(rows, "value_").withColumn("kind", F.lit(kind))
        out = found if out is None else out.unionAll(found)
    return out


def staged(events: DataFrame, put: str, get: str, seconds: int = 1800) -> DataFrame:
    """event_id, user_id, found of each get: whether a put of the same user before it is at most seconds old."""
    mine = events.where(F.col("event_type").isin(put, get)).withColumn("us", _micros("ts"))
    so_far = Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max(F.when(F.col("event_type") == put, F.col("us"))).over(so_far)
    rows = mine.withColumn("last", last).where(F.col("event_type") == get)
    return rows.select("event_id", "user_id", F.coalesce(F.col("us") - F.col("last") <= seconds * MICRO, F.lit(False)).alias("found"))


def session_spans(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n: a user's events without a pause of gap between them; a session ends gap after its last event."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_values(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first row of each group by order, as an aggregate: of values that several patterns find, the first pattern's counts."""
    best = rows.groupBy(*by).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in by]), F.struct(*order)).alias("r"))
    return best.select(*by, "r.*")
