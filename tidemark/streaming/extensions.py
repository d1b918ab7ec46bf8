"""Streaming forms of batch operators over event tables: windows, sessions, stateful following, late rows, upserts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tidemark.operators.series import Clock, Slew
from tidemark.session import ship_package

Names = Sequence[str]


def event_stream(spark: SparkSession, folder: str, schema, ts: str = "ts") -> DataFrame:
    """A folder of Parquet files as a stream, one file a trigger, the time column as a point in time."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return s.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_summary(stream: DataFrame, ts: str, key: str, x: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """n, mean, min and max by time window and key. Exact percentiles would keep every value as state and are left out."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, late).groupBy(w, key).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "mean", "min", "max")


def sessions(stream: DataFrame, ts: str, key: str, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events without a gap, by key."""
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


#: The state store that ``transformWithState`` asks for.
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Keyed(StatefulProcessor):
    """Rows of a key through ``step(state, [(ts, x)]) -> (state, rows)``; the state is a value, silence ends it by a timer.

    In ``ordered`` form rows wait in a list until the watermark has passed them, so they are taken in the order of their
    times whatever the order in which they came.
    """

    def __init__(self, key: str, ts: str, x: str, kind: str, state: str, names: list[str], step, end, expire_ms: int, ordered: bool):
        self.key, self.ts, self.x, self.kind, self.fields, self.names = key, ts, x, kind, state, names
        self.step, self.end, self.expire_ms, self.ordered = step, end, expire_ms, ordered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.fields)
        self.ends = handle.getValueState("ends", "at long")
        self.waiting = handle.getListState("waiting", f"t timestamp, x {self.kind}") if self.ordered else None

    def _advance(self, who: tuple, rows: list) -> Iterator[pd.DataFrame]:
        if rows:
            new, out = self.step(self.held.get() if self.held.exists() else None, rows)
            self.held.update(new)
            if out:
                yield self._frame(who, out)

    def _frame(self, who: tuple, rows: list) -> pd.DataFrame:
        return pd.DataFrame([(who[0], *r) for r in rows], columns=[self.key, *self.names])

    def _expire_after(self, newest: int) -> None:
        old = self.ends.get()[0] if self.ends.exists() else None
        at = max(newest + self.expire_ms, old or 0)
        if at != old:
            if old is not None:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)
            self.ends.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values(self.ts, kind="stable")
        newest = int(got[self.ts].iloc[-1].timestamp() * 1000)
        self._expire_after(max(newest, timerValues.getCurrentWatermarkInMs()))
        pairs = list(zip(got[self.ts], got[self.x]))
        if not self.ordered:
            yield from self._advance(key, pairs)
            return
        self.waiting.appendList([(t.to_pydatetime(), None if pd.isna(v) else v) for t, v in pairs])
        for at in {int(t.timestamp() * 1000) + 1 for t, _ in pairs}:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        if self.ordered:
            rows = sorted(self.waiting.get(), key=lambda r: r[0])
            due = [(t, v) for t, v in rows if pd.Timestamp(t).timestamp() * 1000 < mark]
            if due:
                rest = rows[len(due) :]
                self.waiting.put(rest) if rest else self.waiting.clear()
                yield from self._advance(key, due)
        if self.ends.exists() and expiredTimerInfo.getExpiryTimeInMs() == self.ends.get()[0]:
            out = self.end(self.held.get()) if self.held.exists() else []
            self.held.clear()
            self.ends.clear()
            if out:
                yield self._frame(key, out)

    def close(self) -> None:
        pass


def _stateful(stream: DataFrame, key: str, ts: str, x: str, columns: str, state: str, step, end, late: str, expire_ms: int, ordered: bool) -> DataFrame:
    """``step`` and ``end`` over each key by ``transformWithState``; a key that the watermark leaves behind by ``expire_ms`` gets
    ``end(state) -> rows`` and its state goes. Rows that come behind the watermark are dropped by Spark."""
    spark = stream.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    names = [f.split()[0] for f in columns.split(", ")]
    kinds = dict(stream.dtypes)
    rule = _Keyed(key, ts, x, kinds[x], state, names, step, end, expire_ms, ordered)
    s = stream.withWatermark(ts, late).select(key, ts, x)
    return s.groupBy(key).transformWithStateInPandas(rule, f"{key} {kinds[key]}, {columns}", "Append", "eventTime")


def _recurrence(stream: DataFrame, key: str, ts: str, x: str, rule: Slew | Clock, late: str, expire_ms: int, ordered: bool) -> DataFrame:
    """The batch operator's rule, its last value as state: rows without x keep it."""

    def step(state, rows):
        y, out = (state[0] if state else None), []
        for t, v in rows:
            v = None if v is None or v != v else float(v)
            if v is not None:
                y = v if y is None else rule.step(y, v)
            out.append((t, v, y))
        return (y,), out

    return _stateful(stream.withColumn(x, F.col(x).cast("double")), key, ts, x, f"{ts} timestamp, {x} double, y double", "y double", step, lambda _: [], late, expire_ms, ordered)


def slew_follow(stream: DataFrame, key: str, ts: str, x: str, limit: float, late: str = "1 hour", expire_ms: int = 86_400_000, ordered: bool = False) -> DataFrame:
    """A follower limited to ``limit`` a row, its last value kept as state by key: (key, ts, x, y). Rows of one trigger are
    taken in time order, or, ``ordered``, all rows in time order once the watermark has passed them: then the result is
    that of the batch operator over all rows that were not late. A key silent for ``expire_ms`` of event time starts anew."""
    return _recurrence(stream, key, ts, x, Slew(limit), late, expire_ms, ordered)


def monotonic_clock(stream: DataFrame, key: str, ts: str, x: str, slack: float = 0.5, late: str = "1 hour", expire_ms: int = 86_400_000, ordered: bool = False) -> DataFrame:
    """Whole seconds are added to a reading until it is not below the last one less ``slack``: (key, ts, x, y)."""
    return _recurrence(stream, key, ts, x, Clock(slack), late, expire_ms, ordered)


def clean_runs(stream: DataFrame, key: str, ts: str, flag: str, min_on: int, min_off: int, late: str = "1 hour", expire_ms: int = 86_400_000, ordered: bool = False) -> DataFrame:
    """The batch operator's rule row by row: gaps shorter than ``min_off`` inside close, then runs shorter than ``min_on`` go;
    runs at the ends stay: (key, ts, clean). ``flag`` is 0 or 1.

    A row is given as soon as nothing that may follow can change it, so at most min_on + min_off rows a key are held; what
    is held at the end comes out when the key expires.
    """

    def step(state, rows):
        mode, times, flags = (state[0], list(state[1]), list(state[2])) if state else ("new", [], [])
        out = []
        for t, v in rows:
            v = int(bool(v))
            if mode == "new":
                mode = "on" if v else "off"
            times.append(t)
            flags.append(v)
            last = max((i for i, f in enumerate(flags) if f), default=-1)
            gap = len(flags) - 1 - last
            if mode == "on" and v:
                out += [(x, True) for x in times]
                times, flags = [], []
            elif mode == "on" and gap >= min_off:
                out += [(x, False) for x in times]
                mode, times, flags = "off", [], []
            elif mode == "off" and last < 0:
                out += [(x, False) for x in times]
                times, flags = [], []
            elif mode == "off" and last + 1 >= min_on:
                out += [(x, True) for x in times[: last + 1]]
                mode, times, flags = "on", times[last + 1 :], flags[last + 1 :]
            elif mode == "off" and gap >= min_off:
                out += [(x, False) for x in times]
                times, flags = [], []
        return (mode, times, flags), out

    def end(state):
        """A held run that touches the end stays; one with a gap after it is inside and too short; gaps stay gaps."""
        return [(t, bool(state[2][-1])) for t in state[1]]

    return _stateful(stream.withColumn(flag, F.col(flag).cast("int")), key, ts, flag, f"{ts} timestamp, clean boolean", "mode string, times array<timestamp>, flags array<int>", step, end, late, expire_ms, ordered)


def first_seen(stream: DataFrame, keys: Names, ts: str, late: str = "1 hour") -> DataFrame:
    """One row a key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def upsert_sink(path: str, keys: Names, version: str):
    """A foreachBatch writer that keeps the newest row of every key; a batch written twice changes nothing."""
    from tidemark.sources.sinks import upsert_table

    def write(batch: DataFrame, epoch: int) -> None:
        upsert_table(batch, path, keys, version)

    return write


def append_to(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over what is there and adds its rows to a folder of Parquet files. A run that stopped goes on from its
    checkpoint: each row is there once."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def drain(stream: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there and gives its memory table; for tests and small results."""
    w = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
