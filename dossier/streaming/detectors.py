"""Operators over a stream of events(event_id, user_id, event_type, ts); each has a batch twin in operators.windows.

Events of a micro-batch are taken in order of (ts, event_id); events later than the watermark's delay are dropped. A user's state is
removed once the watermark has passed what it can matter for.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

ALERT = "event_id long, user_id long, failures long"
MICRO = 1_000_000


def _per_key(events: DataFrame, key: str, columns: list[str], step: Callable, output: str, state: str, keep: int | None, delay: str) -> DataFrame:
    """A row for each that step(key, rows, held) -> (held, tuples) gives; held is the state's tuple or None. A state goes keep
    microseconds after its last event; without keep it stays."""
    names = [c.split()[0] for c in output.split(", ")]

    def run(group, frames: Iterator[pd.DataFrame], group_state) -> Iterator[pd.DataFrame]:
        if group_state.hasTimedOut:
            group_state.remove()
            return
        rows = pd.concat(frames).sort_values(["us", "event_id"])
        held, out = step(group[0], rows, group_state.get if group_state.exists else None)
        group_state.update(held)
        if keep is not None:
            group_state.setTimeoutTimestamp(max((int(rows["us"].iloc[-1]) + keep) // 1000 + 1, group_state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    seen = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    slim = seen.select(key, "event_id", "ts", F.unix_micros("ts").alias("us"), *[c for c in columns if c not in (key, "event_id", "ts")])
    timeout = GroupStateTimeout.NoTimeout if keep is None else GroupStateTimeout.EventTimeTimeout
    return slim.groupBy(key).applyInPandasWithState(run, output, state, "append", timeout)


def failure_alerts(events: DataFrame, failed: str = "error", success: str = "signup", seconds: int = 300, least: int = 5, delay: str = "10 minutes") -> DataFrame:
    """Alerts on failures with at least least of a user's in the last seconds, none before the last success. The state is the recent
    failures' times. Twin: failures_in_window."""
    width = seconds * MICRO

    def step(user, rows, state):
        held, out = list(state[0]) if state else [], []
        for event, kind, us in zip(rows["event_id"], rows["event_type"], rows["us"], strict=True):
            if kind == success:
                held = []
                continue
            held = [t for t in held if us - t < width] + [us]
            if len(held) >= least:
                out.append((event, user, len(held)))
        return (held,), out

    return _per_key(events.where(F.col("event_type").isin(failed, success)), "user_id", ["event_type"], step, ALERT, "times array<long>", width, delay)


def access_scores(events: DataFrame, seconds: int = 60, most: int = 30, early: int = 8, late: int = 20, delay: str = "10 minutes") -> DataFrame:
    """event_id, user_id, recent, score, action of each access: more than most in the last seconds .4, an hour (UTC) before early or after late
    .15; under .3 allow, under .6 monitor, else block. Twin: access_rate."""
    width = seconds * MICRO

    def step(user, rows, state):
        held, out = list(state[0]) if state else [], []
        for event, us in zip(rows["event_id"], rows["us"], strict=True):
            held = [t for t in held if us - t < width] + [us]
            hour = us // (3600 * MICRO) % 24
            score = round((0.4 if len(held) > most else 0.0) + (0.15 if hour < early or hour > late else 0.0), 2)
            out.append((event, user, len(held), score, "allow" if score < 0.3 else "monitor" if score < 0.6 else "block"))
        return (held,), out

    return _per_key(events, "user_id", [], step, "event_id long, user_id long, recent long, score double, action string", "times array<long>", width, delay)


def first_sightings(events: DataFrame, value: str, days: int | None = None, delay: str = "10 minutes") -> DataFrame:
    """event_id, user_id of a user's events with a value not seen before, but for the very first. The state is the set of a user's values; after
    days without an event, if given, the user is forgotten. Twin: novelty."""

    def step(user, rows, state):
        known, out = set(state[0]) if state else set(), []
        for event, x in zip(rows["event_id"], rows[value], strict=True):
            if known and x not in known:
                out.append((event, user))
            known.add(x)
        return (sorted(known),), out

    return _per_key(events.where(F.col(value).isNotNull()), "user_id", [value], step, "event_id long, user_id long", "known array<string>", None if days is None else days * 86_400 * MICRO, delay)


def token_bucket(calls: DataFrame, per_minute: float = 60.0, burst: float = 10.0, delay: str = "10 minutes") -> DataFrame:
    """event_id, user_id, allowed: a bucket of burst tokens, refilled per_minute; refused calls leave the bucket as it was. A bucket that is full
    again is forgotten."""

    def step(user, rows, state):
        tokens, last = state if state else (burst, None)
        out = []
        for event, us in zip(rows["event_id"], rows["us"], strict=True):
            now = burst if last is None else min(burst, tokens + (us - last) / 6e7 * per_minute)
            if now >= 1:
                tokens, last = now - 1, us
            out.append((event, user, bool(now >= 1)))
        return (float(tokens), int(last)), out

    return _per_key(calls, "user_id", [], step, "event_id long, user_id long, allowed boolean", "tokens double, last long", int(burst / per_minute * 6e7) + MICRO, delay)


def staged_hits(events: DataFrame, put: str, get: str, seconds: int = 1800, delay: str = "10 minutes") -> DataFrame:
    """event_id, user_id, found of each get: whether a put of the same user is at most seconds old. Twin: staged."""

    def step(user, rows, state):
        last, out = state[0] if state else None, []
        for event, kind, us in zip(rows["event_id"], rows["event_type"], rows["us"], strict=True):
            if kind == put:
                last = us
            else:
                out.append((event, user, last is not None and us - last <= seconds * MICRO))
        return (-(1 << 62) if last is None else last,), out

    return _per_key(events.where(F.col("event_type").isin(put, get)), "user_id", ["event_type"], step, "event_id long, user_id long, found boolean", "last long", seconds * MICRO, delay)


def chained(events: DataFrame, payload: list[str], delay: str = "10 minutes") -> DataFrame:
    """event_id, user_id, entry_hash, prev_hash: each entry's SHA-256 of its payload joined by bars, and that of the entry before in the user's chain
    ('' at first). The state is the chain's head, and it stays. Twin: chained."""

    def step(user, rows, state):
        head, out = state[0] if state else "", []
        for event, text in zip(rows["event_id"], rows["payload"], strict=True):
            own = hashlib.sha256(text.encode()).hexdigest()
            out.append((event, user, own, head))
            head = own
        return (head,), out

    rows = events.withColumn("payload", F.concat_ws("|", *[F.col(c).cast("string") for c in payload]))
    return _per_key(rows, "user_id", ["payload"], step, "event_id long, user_id long, entry_hash string, prev_hash string", "head string", None, delay)


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """user_id, start, end, n: a user's events without a pause of gap between them; a session ends gap after its last event. Twin: session_spans."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rates(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Extension: events per type and tumbling window, with late events dropped after delay."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def track_stages(events: DataFrame, path: str, checkpoint: str):
    """Start a query that keeps the latest stage of each application below path, a snapshot a batch: path/v=<batch>.

    events(application_id, at, event_id, stage, officer, department); a snapshot's row stands for all events before it, so a batch costs the
    snapshot and its own events. A batch that is run again writes the same snapshot. Twin: records.stage_changes.
    """
    columns = "application_id string, at long, event_id long, stage string, officer string, department string, n_events long"

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        held = spark.read.schema(columns).parquet(f"{path}/v={number - 1}") if number else spark.createDataFrame([], columns)
        rows = batch.withColumn("n_events", F.lit(1).cast("long")).select(*[c.split()[0] for c in columns.split(", ")]).unionByName(held)
        order = F.struct("at", "event_id")
        kept = lambda c: F.max_by(F.nullif(c, F.lit("")), F.when(F.coalesce(c, F.lit("")) != "", order)).alias(c)
        merged = rows.groupBy("application_id").agg(F.max("at").alias("at"), F.max_by("event_id", order).alias("event_id"), F.max_by("stage", order).alias("stage"), kept("officer"), kept("department"), F.sum("n_events").alias("n_events"))
        merged.write.mode("overwrite").parquet(f"{path}/v={number}")

    return events.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
