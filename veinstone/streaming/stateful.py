"""Operators with state and timers of their own, on transformWithState.

State is kept for each key in RocksDB, so it may outgrow memory; a key's timer ends what nobody goes on with, which no later event of another key is
needed for where the clock is that of processing. Each is compared with what a batch gives in the tests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SEPARATOR, FENCE = "\n---\n", "```"
IDLE_MS, ALERT_MS = 1_800_000, 600_000
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, clock: str, mode: str = "append", time: str = "") -> DataFrame:
    """clock: ``processing``, ``event`` (by the watermark) or ``none``."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)  # transformWithState has no other
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, mode, {"processing": "ProcessingTime", "event": "EventTime", "none": "None"}[clock], eventTimeColumnName=time)


class _Timed(StatefulProcessor):
    """Puts off one timer for each key."""

    def __init__(self, idle_ms: int, clock: str) -> None:
        self.idle_ms, self.clock = idle_ms, clock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields(handle)

    def fields(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def put_off(self, timers, last_ms: int | None = None) -> None:
        """The timer goes off ``idle_ms`` after now, or after the last event by the events' own clock."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        now = timers.getCurrentProcessingTimeInMs() if self.clock == "processing" else max(last_ms or 0, timers.getCurrentWatermarkInMs())
        self.handle.registerTimer(now + self.idle_ms)

    def close(self) -> None:
        pass


class _Queue(_Timed):
    def __init__(self, n: int, idle_ms: int, clock: str) -> None:
        super().__init__(idle_ms, clock)
        self.n = n

    def fields(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, user string, assistant string")
        self.count = handle.getValueState("count", "n long, last long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(["turn", "ts"], kind="stable")
        n, last = self.count.get() if self.count.exists() else (0, None)
        kept = list(self.turns.get()) if self.turns.exists() else []
        if self.clock == "event" and last is not None and new["ts"].min().timestamp() * 1000 > last + self.idle_ms:
            yield self._expired(key, n)  # the gap is there, whether or not the watermark has told
            n, kept = 0, []
        last = max(last or 0, int(new["ts"].max().timestamp() * 1000))
        told = []
        for turn, user, assistant in zip(new["turn"].tolist(), new["user"].tolist(), new["assistant"].tolist()):
            kept = [*kept, (turn, user, assistant)][-self.n :]
            n += 1
            told.append((key[0], n, turn, len(kept), [k[0] for k in kept]))
        self.turns.put(kept)
        self.count.update((n, last))
        self.put_off(timerValues, last)
        yield pd.DataFrame(told, columns=["session", "nth", "turn", "kept", "turns"]).assign(event="served")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        self.turns.clear()
        self.count.clear()
        yield self._expired(key, n)

    @staticmethod
    def _expired(key: tuple, n: int) -> pd.DataFrame:
        return pd.DataFrame({"session": [key[0]], "nth": [n], "turn": [None], "kept": [0], "turns": [[]], "event": ["expired"]})


def session_queue(turns: DataFrame, n: int = 10, idle_ms: int = IDLE_MS, clock: str = "processing", late: str = "0 seconds") -> DataFrame:
    """(session, nth, turn, kept, turns, event): each session's turns (session, ts, turn, user, assistant) one after the other, with the last n that are kept then.

    ``served`` rows come in the order of turns within a micro-batch, and of micro-batches; nth counts a session's turns. A session that gets none for
    ``idle_ms`` is ``expired``: its turns go, and it begins again at 1. clock: ``processing``, or ``event`` with turns up to ``late`` late.
    """
    rows = turns.select("session", F.col("ts").cast("timestamp").alias("ts"), F.col("turn").cast("long").alias("turn"), "user", "assistant")
    if clock == "event":
        rows = rows.withWatermark("ts", late)
    schema = f"session {dict(turns.dtypes)['session']}, nth long, turn long, kept int, turns array<long>, event string"
    return _with_state(rows, "session", _Queue(n, idle_ms, clock), schema, clock)


class _Watch(_Timed):
    def fields(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "last timestamp, n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, n = self.seen.get() if self.seen.exists() else (None, 0)
        for batch in rows:
            newest = batch["ts"].max()
            last = newest if last is None or newest > last else last
            n += len(batch)
        self.seen.update((last, n))
        self.put_off(timerValues)
        yield pd.DataFrame({"key": pd.Series([], dtype=object), "last": pd.Series([], dtype="datetime64[ns]"), "events": pd.Series([], dtype="int64")})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, n = self.seen.get()
        self.seen.clear()
        yield pd.DataFrame({"key": [key[0]], "last": [pd.Timestamp(last)], "events": [n]})


def watchdog(events: DataFrame, limit_ms: int = ALERT_MS) -> DataFrame:
    """(key, last, events) once a key (key, ts) has had no event for ``limit_ms`` of the machine's time, whether or not anything else happens. events: since it began or last alerted."""
    rows = events.select("key", F.col("ts").cast("timestamp").alias("ts"))
    return _with_state(rows, "key", _Watch(limit_ms, "processing"), f"key {dict(events.dtypes)['key']}, last timestamp, events long", "processing", "update")


class _Patches(_Timed):
    def fields(self, handle: StatefulProcessorHandle) -> None:
        self.text = handle.getValueState("text", "next long, text string, closed boolean")
        self.early = handle.getMapState("early", "seq long", "patch string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, text, closed = self.text.get() if self.text.exists() else (0, "", False)
        done = closed
        if not closed:
            for batch in rows:
                for seq, patch in zip(batch["seq"].tolist(), batch["patch"].tolist()):
                    if seq >= following:
                        self.early.updateValue((seq,), (patch,))
            while not closed and self.early.containsKey((following,)):
                text += self.early.getValue((following,))[0] or ""
                self.early.removeKey((following,))
                following, closed = following + 1, SEPARATOR in text or text.rstrip(" ").rstrip().endswith(FENCE)
            if closed:
                self.early.clear()
            self.text.update((following, "" if closed else text, closed))
        self.put_off(timerValues)
        told = [(key[0], text, True)] if closed and not done else []
        yield pd.DataFrame(told, columns=["task_id", "text", "closed"]).astype({"text": object, "closed": bool})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, text, closed = self.text.get() if self.text.exists() else (0, "", False)
        self.text.clear()
        self.early.clear()
        told = [] if closed else [(key[0], text, False)]
        yield pd.DataFrame(told, columns=["task_id", "text", "closed"]).astype({"text": object, "closed": bool})


def closing_patches(parts: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """(task_id, text, closed): each task's patches (task_id, seq, patch), numbered from 0, joined in order up to the one that closes it.

    A separator line, or a fence at the end of what is there so far, closes a task: its text comes out once, and later patches are dropped. Patches may
    come in any order and more than once. A task without patches for ``idle_ms`` is forgotten; if it wasn't closed what there was comes out as such.
    """
    rows = parts.select("task_id", F.col("seq").cast("long").alias("seq"), "patch")
    return _with_state(rows, "task_id", _Patches(idle_ms, "processing"), f"task_id {dict(parts.dtypes)['task_id']}, text string, closed boolean", "processing", "update")


def closed_texts(parts: DataFrame) -> DataFrame:
    """The same of a batch: (task_id, text, closed), where a task's patches behind the closing one are left out."""
    listed = F.sort_array(F.collect_set(F.struct("seq", F.coalesce("patch", F.lit("")).alias("patch"))))  # of one task
    ends = lambda text: F.contains(text, F.lit(SEPARATOR)) | F.rtrim(F.regexp_replace(text, r"\s+$", "")).endswith(FENCE)

    def add(state: Column, part: Column) -> Column:
        text = F.when(state["closed"], state["text"]).otherwise(F.concat(state["text"], part["patch"]))
        return F.struct(text.alias("text"), (state["closed"] | ends(text)).alias("closed"))

    whole = parts.groupBy("task_id").agg(F.aggregate(listed, F.struct(F.lit("").alias("text"), F.lit(False).alias("closed")), add).alias("end"))
    return whole.select("task_id", "end.text", "end.closed")


def started(spark: SparkSession, rows: DataFrame, name: str, checkpoint: str, mode: str = "append", every: str | None = None):
    """Starts a query into a table in memory; over what there is, or every so often for as long as it runs. One whose clock is that of processing runs until it is stopped, either way."""
    writer = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
