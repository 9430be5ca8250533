"""Streaming operators; each works on batch DataFrames as well, which is how results are compared."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veinstone.functions import lexicons as L


def stage_of(name: Column) -> Column:
    """A callback's stage; parsing for one that is not known."""
    return F.when(name.isin(L.CALLBACK_STAGES), name).otherwise("parsing")


#: How late events may come before a stream's state lets go of them.
LATE = "1 hour"


def _on_time(events: DataFrame, late: str | None) -> DataFrame:
    """A stream with a watermark, so that its state doesn't grow for ever; a batch as it is."""
    return _timed(events).withWatermark("ts", late or LATE) if events.isStreaming else events


def _timed(events: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need timestamps of the session's time zone."""
    return events.withColumn(column, F.col(column).cast("timestamp"))


def current_stage(progress: DataFrame, late: str | None = None) -> DataFrame:
    """(doc_id, stage): the last of each document's progress (doc_id, ts, stage).

    A stream tells the last stage within windows of a day, (doc_id, day, stage), in update mode: older days leave the state.
    """
    if progress.isStreaming:
        found = _on_time(progress, late).groupBy("doc_id", F.window("ts", "1 day").alias("day")).agg(F.max_by(stage_of(F.col("stage")), F.col("ts")).alias("stage"))
        return found.select("doc_id", F.col("day.start").alias("day"), "stage")
    return progress.groupBy("doc_id").agg(F.max_by(stage_of(F.col("stage")), F.col("ts")).alias("stage"))


def idle_sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, start, end, events): sessions that end after ``gap`` without an event."""
    found = _on_time(events, late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("events"))
    return found.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "events")


def tumbling_counts(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    found = _on_time(events, late).groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def sliding_means(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    found = _on_time(events, late).groupBy(F.window("ts", size, slide).alias("w"), "event_type").agg(F.avg("value").alias("mean"))
    return found.select(F.col("w.start").alias("start"), "event_type", "mean")


def without_repeats(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark."""
    return _timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def answered(asks: DataFrame, replies: DataFrame, timeout: str = "300 seconds") -> DataFrame:
    """(ask_id, ts, reply): replies (ask_id, ts, reply) within the timeout, null for asks without one."""
    a, r = asks, replies.select(F.col("ask_id").alias("reply_to"), F.col("ts").alias("reply_ts"), "reply")
    if asks.isStreaming:
        a, r = _timed(a).withWatermark("ts", timeout), _timed(r, "reply_ts").withWatermark("reply_ts", timeout)
    in_time = (F.col("reply_to") == F.col("ask_id")) & (F.col("reply_ts") >= F.col("ts")) & (F.col("reply_ts") <= F.col("ts") + F.expr(f"INTERVAL {timeout}"))
    return a.join(r, in_time, "left").select("ask_id", "ts", "reply")


def patches(parts: DataFrame) -> DataFrame:
    """(task_id, text, closed): patches (task_id, seq, patch) joined in order; a separator line or a fence at the end closes a task."""
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "patch"))), lambda x: x["patch"]), "").alias("text")
    return parts.groupBy("task_id").agg(joined).withColumn("closed", F.contains("text", F.lit("\n---\n")) | F.rtrim("text").endswith("```"))


def envelope(payload: Column) -> Column:
    return F.to_json(payload)


def opened(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def publish(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Starts a query that hands each micro-batch to a sink."""
    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def idle_since(last: DataFrame, now: Column, limit: str = "600 seconds") -> DataFrame:
    """Keys (key, ts) whose last event is longer ago than the limit."""
    return last.groupBy("key").agg(F.max("ts").alias("ts")).where(now - F.expr(f"INTERVAL {limit}") > F.col("ts"))


def idle_alerts(events: DataFrame, limit: str = "600 seconds", late: str = "30 seconds") -> DataFrame:
    """(key, last, events) once a key (key, ts) has had no event for the limit: a session window that the watermark closes."""
    found = _timed(events).withWatermark("ts", late).groupBy("key", F.session_window("ts", limit).alias("s")).agg(F.max("ts").alias("last"), F.count("*").alias("events"))
    return found.select("key", "last", "events")


def kept_turns(turns: DataFrame, n: int = 10, idle_ms: int = 1_800_000) -> DataFrame:
    """(session, turns): the last n turns of each session after each batch; turns (session, turn, user, assistant), in order of turn within a batch.

    A session's state is n turns, and goes after ``idle_ms`` without one.
    """
    def keep(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        new = pd.concat(list(batches)).sort_values("turn")
        kept = [*kept, *(json.dumps([int(t), u, a], ensure_ascii=False) for t, u, a in zip(new["turn"], new["user"], new["assistant"]))][-n:]
        state.update((kept,))
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session": [key[0]], "turns": [kept]})

    return turns.groupBy("session").applyInPandasWithState(keep, f"session {dict(turns.dtypes)['session']}, turns array<string>", "turns array<string>", "update", GroupStateTimeout.ProcessingTimeTimeout)
