"""Structured Streaming forms of the message and emotion operators.

Stateless operators (routing, alerts, log rows, commands) are the batch functions: they take a stream as they take a table.
The stateful ones need the RocksDB state store, which :func:`drained` sets for its query; set it for a query of your own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import groupby
from math import log
from operator import add, itemgetter

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.emotion import EMOTIONS, smoothing_weights
from ..operators.messages import FirstIn
from ..storage import remove, shared_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
NO_SESSION = -1  # the bucket of results without a session


def stream_session_activity(messages: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions that end after a gap: session_id, created_at, last_active, messages; takes a table too.

    A stream gives a session when the watermark has passed its end, and then drops its state.
    """
    rows = (messages.withWatermark(ts, late) if messages.isStreaming else messages).groupBy("session_id", F.session_window(ts, gap).alias("w"))
    return rows.agg(F.min(ts).alias("created_at"), F.max(ts).alias("last_active"), F.count("*").alias("messages")).drop("w")


def with_open_sessions(closed: DataFrame, messages: DataFrame, ts: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """The sessions that a stream gave, and those that are still open at its watermark, counted from the table.

    Only sessions of ids with a message after the watermark less the gap are counted.
    """
    end = messages.agg(F.max(ts)).first()[0]
    if end is None:
        return closed
    after = F.col(ts) + F.expr(f"INTERVAL {gap}") + F.expr(f"INTERVAL {late}") >= F.lit(end)
    some = messages.where(after).select("session_id").distinct()
    still = stream_session_activity(messages.join(some, "session_id", "left_semi"), ts, gap)
    return closed.unionByName(still.join(closed.select("session_id", "created_at"), ["session_id", "created_at"], "left_anti"))


class Sessions(StatefulProcessor):
    """Per session id: the open session, if there is one.

    A message opens a session where none is open and else belongs to the open one. An ``end`` closes it at once and
    belongs to it; where none is open it does nothing. A session without a message for ``gap`` ends by itself: at the next
    message, or by a timer when the watermark passes, and its state is dropped. Times are microseconds.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "created long, last long, messages long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        session = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for at, ends in pd.concat(list(rows)).sort_values(["at", "ends"])[["at", "ends"]].itertuples(index=False):
            if session and at - session[1] > self.gap:
                out.append((*session, "idle"))
                session = None
            if session:
                session = (session[0], max(session[1], int(at)), session[2] + 1)
                if ends:
                    out.append((*session, "command"))
                    session = None
            elif not ends:
                session = (int(at), int(at), 1)
        clear_timers(self.handle)
        if session:
            self.open.update(session)
            self.handle.registerTimer((session[1] + self.gap) // 1000 + 1)
        else:
            self.open.clear()
        yield self._table(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(*tuple(self.open.get()), "idle")] if self.open.exists() else []
        self.open.clear()
        yield self._table(key, out)

    def _table(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["session_id", "created", "last", "messages", "ended_by"])

    def close(self) -> None:
        pass


def stream_sessions(messages: DataFrame, gap: float = 1800.0, late: str = "10 minutes") -> DataFrame:
    """Sessions that have ended, of a stream of (session_id, ts, ends): session_id, created_at, last_active, messages, ended_by.

    ``ends`` marks the message that ends its session (``end_session``); ``ended_by`` is command or idle. See
    :class:`Sessions`. Rows of a batch are taken in order of their times.
    """
    rows = messages.withWatermark("ts", late).select("session_id", "ts", F.unix_micros("ts").alias("at"), F.coalesce("ends", F.lit(False)).alias("ends"))
    schema = f"session_id {messages.schema['session_id'].dataType.simpleString()}, created long, last long, messages long, ended_by string"
    ended = rows.groupBy("session_id").transformWithStateInPandas(Sessions(round(gap * 1_000_000)), schema, "Append", "EventTime")
    return ended.select("session_id", F.timestamp_micros("created").alias("created_at"), F.timestamp_micros("last").alias("last_active"), "messages", "ended_by")


class Answers(StatefulProcessor):
    """Per server: the keys of its cache, oldest first."""

    def __init__(self, entries: int):
        self.entries = entries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getListState("kept", "asked string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache = FirstIn(self.entries, [r[0] for r in self.kept.get()] if self.kept.exists() else [])
        asked = pd.concat(list(rows)).sort_values(["seq", "asked"])
        hits = [cache.ask(x) for x in asked["asked"]]
        self.kept.put([(k,) for k in cache.keys])
        yield pd.DataFrame({"server": key[0], "seq": asked["seq"].to_numpy(), "asked": asked["asked"].to_numpy(), "hit": hits})

    def close(self) -> None:
        pass


def stream_cached_requests(requests: DataFrame, entries: int = 100) -> DataFrame:
    """Each request of a stream of (server, seq, asked) with ``hit``: whether the server's cache of ``entries`` keys has it.

    The cache is that of :func:`learnloom.operators.messages.cached_requests`; rows of a batch are taken in order of ``seq``.
    """
    schema = f"server {requests.schema['server'].dataType.simpleString()}, seq long, asked string, hit boolean"
    return requests.select("server", "seq", "asked").groupBy("server").transformWithStateInPandas(Answers(entries), schema, "Append", "none")


def stream_dedupe_requests(requests: DataFrame, key: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The first request of each key within the watermark."""
    return requests.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def clear_timers(handle: StatefulProcessorHandle) -> None:
    for at in list(handle.listTimers()):
        handle.deleteTimer(at[0] if isinstance(at, tuple) else at)


class FuseAndSmooth(StatefulProcessor):
    """Per session: the results of one side that wait for the other, and the last fused ones.

    The n-th result of one side pairs with the n-th of the other, errors included, as in the batch form. A session
    ends when ``wait`` passes without a result: what waits goes out alone, in order, and the state is dropped. Times are
    microseconds.

    Keys are buckets of sessions, each an entry of the bucket's map, since a key costs more than the results of a session.
    A bucket has one timer, at the end of a session or before; when it fires the bucket's sessions are gone through.
    """

    def __init__(self, history: int, wait: int):
        self.history, self.wait = history, wait
        self.weights = [smoothing_weights(n) for n in range(1, history + 1)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        result = "modality: string, probs: array<double>, confidence: double, error: string, at: bigint, event_id: bigint"
        state = f"waiting array<struct<{result}>>, past array<array<double>>, last long"
        self.sessions = handle.getMapState("sessions", "session_id long", state)
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["session_id", "at", "event_id"])
        table = table[["session_id", "modality", "probs", "confidence", "error", "at", "event_id"]]
        known = self.sessions.exists()
        out, ends = [], []
        for session, own in groupby(table.itertuples(index=False, name=None), lambda r: None if key[0] == NO_SESSION else r[0]):
            waiting, past, last = self._opened((known and self.sessions.getValue((session,))) or ([], [], None))
            for _, modality, probs, confidence, error, at, event in own:
                if last is not None and at - last > self.wait:
                    out += [(session, *self._fused(past, w)) for w in waiting]
                    waiting, past = deque(), []
                at, probs = int(at), None if probs is None else list(map(float, probs))
                side = (modality, probs, None if pd.isna(confidence) else float(confidence), error, at, int(event))
                if waiting and waiting[0][0] != modality:
                    out.append((session, *self._fused(past, waiting.popleft(), side)))
                else:
                    waiting.append(side)
                last = at
            self.sessions.updateValue((session,), (list(waiting), past, last))
            ends.append(self._end(last))
        timer = self.timer.get()
        if timer is None or min(ends) < timer[0]:
            if timer is not None:
                self.handle.deleteTimer(timer[0])
            self._set_timer(ends)
        yield self._table(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        out, over, ends = [], [], []
        for (session,), state in list(self.sessions.iterator()):
            waiting, past, last = self._opened(state)
            if self._end(last) <= now:
                over.append(session)
                out += [(session, *self._fused(past, w)) for w in waiting]
            else:
                ends.append(self._end(last))
        if ends:
            for session in over:
                self.sessions.removeKey((session,))
            self._set_timer(ends)
        else:
            self.sessions.clear()
            self.timer.clear()
        yield self._table(out)

    def _end(self, last: int) -> int:
        return (last + self.wait) // 1000 + 1

    def _set_timer(self, ends: list[int]) -> None:
        self.handle.registerTimer(min(ends))
        self.timer.update((min(ends),))

    def _opened(self, state) -> tuple[deque, list, int | None]:
        waiting, past, last = state
        return deque(map(tuple, waiting)), [list(p) for p in past], last

    def _fused(self, past: list, *sides) -> tuple:
        """(event_id, emotion, confidence, error) of one pair, or of one side alone; ``past`` takes its unsmoothed result."""
        event = max(sides, key=itemgetter(4, 5))[5]
        good = {s[0]: s for s in sides if s[3] is None and s[1] is not None}
        if not good:
            errors = {s[0]: s[3] for s in sides}
            return event, None, None, errors.get("audio") or errors.get("face") or "no result"
        if len(good) == 2:
            audio, face = good["audio"], good["face"]
            move = 0.2 * (_reliability(face) - _reliability(audio))
            wa, wf = (min(0.9, max(0.1, w)) for w in (0.4 - move, 0.6 + move))
            past.append(_normalised([(wa * a + wf * f) / (wa + wf) for a, f in zip(audio[1], face[1], strict=True)]))
        else:
            past.append(next(iter(good.values()))[1])
        del past[: -self.history]
        mean = [0.0] * len(past[0])
        for w, p in zip(self.weights[len(past) - 1], past):
            mean = [m + w * x for m, x in zip(mean, p, strict=True)]
        mean = mean if len(past) == 1 else _normalised(mean)
        place = max(range(len(mean)), key=lambda i: (mean[i] != mean[i], mean[i]))
        return event, EMOTIONS[place], mean[place], None

    def _table(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["session_id", "event_id", "emotion", "confidence", "error"])

    def close(self) -> None:
        pass


def _normalised(values: list[float]) -> list[float]:
    whole = reduce(add, values, 0.0)
    return [x / whole for x in values] if whole > 0 or whole != whole else values


def _reliability(side: tuple) -> float:
    """As :func:`learnloom.functions.emotion.reliability`."""
    if side[2] is not None:
        return side[2]
    n = len(side[1])
    return 1 + reduce(add, (p * log(min(1.0, max(1e-10, p))) for p in side[1]), 0.0) / log(n) if n > 1 else (0.5, 1.0)[n]


def stream_fuse_and_smooth(results: DataFrame, history: int = 5, wait: float = 3600.0, late: str = "10 minutes", buckets: int = 4096) -> DataFrame:
    """Fused and smoothed results of a stream of (session_id, modality, probs, confidence, error, ts, event_id).

    Rows of a batch are taken in event order. See :class:`FuseAndSmooth` for pairs and for the end of a session. A task
    holds the rows of a batch in one of ``buckets`` at a time; a query keeps the number that it began with.
    """
    schema = "session_id long, event_id long, emotion string, confidence double, error string"
    bucket = F.when(F.col("session_id").isNull(), NO_SESSION).otherwise(F.pmod(F.xxhash64("session_id"), F.lit(buckets)))
    # A null among whole numbers would make those around it floats.
    session, at = F.coalesce("session_id", F.lit(0)).alias("session_id"), F.unix_micros("ts").alias("at")
    rows = results.withWatermark("ts", late).select(bucket.alias("bucket"), "ts", session, "modality", "probs", "confidence", "error", at, "event_id")
    return rows.groupBy("bucket").transformWithStateInPandas(FuseAndSmooth(history, round(wait * 1_000_000)), schema, "Append", "EventTime")


class Ring(StatefulProcessor):
    """Per session: the last n messages, sent again as they change."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getListState("last", "seq long, message string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = [(int(r[0]), r[1]) for r in self.last.get()] if self.last.exists() else []
        new = pd.concat(list(rows))
        last = sorted(old + list(zip(new["seq"].astype(int), new["message"])))[-self.n :]
        self.last.put(last)
        yield pd.DataFrame([(key[0], s, m, len(last) - i) for i, (s, m) in enumerate(last)], columns=["session_id", "seq", "message", "place"])

    def close(self) -> None:
        pass


def stream_message_log(log: DataFrame, n: int = 100) -> DataFrame:
    """The newest ``n`` log rows of each session that changed in a batch: session_id, seq, message, place."""
    return log.groupBy("session_id").transformWithStateInPandas(Ring(n), "session_id long, seq long, message string, place long", "Append", "none")


def command_answers(tables, limit: int = 5) -> Callable[[DataFrame], dict[str, DataFrame]]:
    """What a :class:`learnloom.sources.tables.BatchSink` does with a stream of commands (id, data): a table ``answers``.

    A batch is answered by :func:`learnloom.operators.messages.process_commands` from the tables nodes, edges and mastery as
    they are when it starts, so what is committed to the graph while the stream runs counts from the next batch on.
    """
    from ..operators.messages import process_commands

    def split(batch: DataFrame) -> dict[str, DataFrame]:
        return {"answers": process_commands(batch, tables.read("nodes"), tables.read("edges"), tables.read("mastery"), limit=limit)}

    return split


@contextmanager
def settings(spark: SparkSession, values: dict[str, str | None]) -> Iterator[None]:
    """Settings for queries started within; those that are None stay as they are."""
    values = {k: v for k, v in values.items() if v is not None}
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def state_settings(spark: SparkSession, partitions: int | None = None):
    """The state store that stateful processors need, and the number of their partitions.

    Each partition has a store and a worker for each batch, so a stream of few rows is quicker with few. A query keeps the
    number that it began with.
    """
    return settings(spark, {PROVIDER: STATE_STORE, "spark.sql.shuffle.partitions": str(partitions) if partitions else None})


def drained(stream: DataFrame, spark: SparkSession, folder: str | None = None, state: str | None = None, partitions: int | None = None) -> DataFrame:
    """Everything that a stream gives for the data there now, written as Parquet to ``folder`` and read back.

    With ``folder`` and ``state`` of an earlier run the stream goes on from there; without ``state`` what the stream kept
    is removed at its end. ``partitions`` is that of :func:`state_settings`.
    """
    folder = folder or shared_path(spark, "stream")
    with state_settings(spark, partitions):
        writer = stream.writeStream.format("parquet").option("checkpointLocation", state or f"{folder}-state").outputMode("append")
        writer.trigger(availableNow=True).start(folder).awaitTermination()
    if not state:
        remove(spark, f"{folder}-state")
    return spark.read.schema(stream.schema).parquet(folder)
