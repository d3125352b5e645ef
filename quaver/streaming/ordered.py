"""Rules that judge the events of a key in the order of their times: as streams with state and timers, and over tables.

A stream holds events back until the watermark has passed them and judges them then, ordered by (time, event_id). So it gives
what the table form gives for the same events, however they are dealt to batches, as long as none is later than the
watermark's delay; later ones are dropped. Memory for a key is that of its events within the delay and of its rule, whose
state is bounded by the rule's own limits. Rows without a time or a user are left out in both forms; of events of equal time
and id, all are judged.
"""

from __future__ import annotations

import contextlib
import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import TimestampNTZType

from quaver.streaming.admission import DualAllowance

_JUDGED = "user_id long, event_id long, us long, answer int"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


class DualRule:
    """The dual allowance over events with ``search`` (boolean) and ``cost`` (seconds of CPU)."""

    FIELDS = "search boolean, cost double"
    STATE = "searches array<double>, controls array<double>, anchor double, count long, used double"

    def __init__(self, *limits, **more):
        self.own = DualAllowance(*limits, **more)

    def judge(self, now: float, search, cost) -> int:
        return self.own.admit(now, bool(search), float(cost or 0.0))

    def dump(self) -> tuple:
        own = self.own
        return list(own.held[True]), list(own.held[False]), own.anchor, own.count, own.used

    def load(self, state) -> None:
        own = self.own
        own.held = {True: deque(state[0]), False: deque(state[1])}
        own.anchor, own.count, own.used = state[2], state[3], state[4]

    def idle(self) -> float:
        """The time from which a new rule would judge as this one does."""
        own = self.own
        return max([own.anchor + own.hour, *(t[-1] + own.window for t in own.held.values() if t)])


class TombstoneRule:
    """Requests that were cancelled: a search is refused for ``ttl`` seconds after a cancel of its request and generation.

    Up to ``most`` cancels are held; a further one evicts the one held longest. A cancel of what is held renews its time, not its place.
    """

    FIELDS = "cancel boolean, request string, generation long"
    STATE = "requests array<string>, generations array<long>, until array<double>"

    def __init__(self, ttl: float = 60.0, most: int = 256):
        self.ttl, self.most = ttl, most
        self.held: dict[tuple[str, int], float] = {}

    def judge(self, now: float, cancel, request, generation) -> int:
        if not cancel:
            return int(self.held.get((request, generation), now) > now)
        self.held = {k: t for k, t in self.held.items() if t > now}
        if len(self.held) >= self.most:
            del self.held[next(iter(self.held))]
        self.held[request, generation] = now + self.ttl
        return 0

    def dump(self) -> tuple:
        return [k[0] for k in self.held], [k[1] for k in self.held], list(self.held.values())

    def load(self, state) -> None:
        self.held = dict(zip(zip(state[0], state[1]), state[2]))

    def idle(self) -> float:
        return max(self.held.values(), default=0.0)


class _InOrder(StatefulProcessor):
    """Holds a key's events until the watermark passes them, then asks its rule."""

    def __init__(self, make: Callable, names: list[str]):
        self.make, self.names = make, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        rule = self.make()
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"us long, event_id long, {rule.FIELDS}")
        self.kept = handle.getValueState("kept", rule.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            part = part[["us", "event_id", *self.names]].astype(object)
            held = list(part.where(part.notna(), None).itertuples(index=False, name=None))
            if held:
                self.waiting.appendList(held)
                first = min([h[0] for h in held] + ([] if first is None else [first]))
        if first is not None and not any(t * 1000 <= first for t in self.handle.listTimers()):
            self.handle.registerTimer(-(-first // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        border = timerValues.getCurrentWatermarkInMs() * 1000
        due, later = [], []
        for held in self.waiting.get() if self.waiting.exists() else ():
            (due if held[0] <= border else later).append(tuple(held))
        rule = self.make()
        if self.kept.exists():
            rule.load(self.kept.get())
        if due:
            due.sort(key=lambda h: (h[0], h[1] is not None, h[1]))
            answers = [rule.judge(h[0] / 1e6, *h[2:]) for h in due]
            if later:
                self.waiting.put(later)
            else:
                self.waiting.clear()
            self.kept.update(rule.dump())
            yield pd.DataFrame({"user_id": key[0], "event_id": pd.array([h[1] for h in due], "Int64"), "us": [h[0] for h in due], "answer": answers})
        elif not self.kept.exists():
            return
        if later:
            self.handle.registerTimer(-(-min(h[0] for h in later) // 1000))
        elif (end := math.ceil(rule.idle() * 1000)) * 1000 > border:
            self.handle.registerTimer(end)
        else:
            self.kept.clear()

    def close(self) -> None:
        pass


def _names(rule) -> list[str]:
    return [f.split()[0] for f in rule.FIELDS.split(", ")]


def _plain(events: DataFrame, names: list[str]) -> DataFrame:
    """Events with ``us``, the microseconds of their times; times without a zone are read as UTC, whatever the session's zone."""
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)") if isinstance(events.schema["ts"].dataType, TimestampNTZType) else F.unix_micros("ts")
    timed = events.filter("ts is not null and user_id is not null").select("user_id", "event_id", us.alias("us"), *names)
    return timed.withColumn("ts", F.timestamp_micros("us"))


def _answered(judged: DataFrame, answer: list[Column]) -> DataFrame:
    return judged.select("user_id", "event_id", F.timestamp_micros("us").alias("ts"), *answer)


def _stream(events: DataFrame, make: Callable, delay: str) -> DataFrame:
    names = _names(make())
    marked = _plain(events, names).withWatermark("ts", delay)
    return marked.groupBy("user_id").transformWithStateInPandas(_InOrder(make, names), _JUDGED, "append", "eventTime")


def _table(events: DataFrame, make: Callable) -> DataFrame:
    names = _names(make())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, key = None, object()
        for b in batches:
            rest = b[names].astype(object)
            answers = []
            for user, us, values in zip(b["user_id"], b["us"], rest.where(rest.notna(), None).itertuples(index=False, name=None)):
                if user != key:
                    key, rule = user, make()
                answers.append(rule.judge(us / 1e6, *values))
            yield b[["user_id", "event_id", "us"]].assign(answer=answers)

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _plain(events, names).drop("ts").repartition(parts, "user_id").sortWithinPartitions("user_id", "us", "event_id")
    return dealt.mapInPandas(run, _JUDGED)


def _admission(judged: DataFrame) -> DataFrame:
    return _answered(judged, [(F.col("answer") == 0).alias("admitted"), F.col("answer").alias("retry")])


def _cancellation(judged: DataFrame) -> DataFrame:
    return _answered(judged, [(F.col("answer") == 1).alias("cancelled")])


def dual_stream(events: DataFrame, searches: int, controls: int, hourly: int, delay: str = "1 minute", **more) -> DataFrame:
    """(user_id, event_id, ts, admitted, retry) of a stream (user_id, event_id, ts, search, cost). Its state needs the RocksDB provider (``keyed_state``)."""
    return _admission(_stream(events, lambda: DualRule(searches, controls, hourly, **more), delay))


def dual_table(events: DataFrame, searches: int, controls: int, hourly: int, **more) -> DataFrame:
    """The same over a table."""
    return _admission(_table(events, lambda: DualRule(searches, controls, hourly, **more)))


def cancel_stream(events: DataFrame, ttl: float = 60.0, most: int = 256, delay: str = "1 minute") -> DataFrame:
    """(user_id, event_id, ts, cancelled) of a stream (user_id, event_id, ts, cancel, request, generation)."""
    return _cancellation(_stream(events, lambda: TombstoneRule(ttl, most), delay))


def cancel_table(events: DataFrame, ttl: float = 60.0, most: int = 256) -> DataFrame:
    """The same over a table."""
    return _cancellation(_table(events, lambda: TombstoneRule(ttl, most)))


@contextlib.contextmanager
def keyed_state(spark: SparkSession):
    """The state store that list state and timers need, for the streams that are started inside."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def run_to_end(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream gives for all that its sources hold now; run again on the same folder, it goes on from its checkpoint."""
    spark = stream.sparkSession
    with keyed_state(spark):
        out = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append")
        out.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
