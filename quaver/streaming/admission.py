"""Admission of requests: sliding allowances, as keyed streaming state and as the same rule over a table."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESULT = "user_id long, event_id long, ts timestamp, admitted boolean, retry int"


class SlidingAllowance:
    """At most ``limit`` admissions in any ``window`` seconds; what is refused isn't recorded."""

    def __init__(self, limit: int, window: float = 60.0, held: list[float] | None = None):
        self.limit, self.window, self.held = limit, window, deque(held or ())

    def admit(self, now: float) -> int:
        """0 if admitted, else the seconds after which to try again."""
        while self.held and now - self.held[0] >= self.window:
            self.held.popleft()
        if len(self.held) >= self.limit:
            return max(1, int(self.window - (now - self.held[0])) + 1)
        self.held.append(now)
        return 0


class DualAllowance:
    """Searches and controls have allowances of their own; searches also an hourly one, re-anchored at the first event after an hour.

    The first hour begins at ``start``, or else at the first event. What is admitted costs seconds of CPU; once an hour has
    used ``cpu`` of them, its searches are refused too.
    """

    def __init__(self, searches: int, controls: int, hourly: int, window: float = 60.0, hour: float = 3600.0, cpu: float = math.inf, start: float | None = None):
        self.limits = {True: searches, False: controls}
        self.hourly, self.window, self.hour, self.cpu = hourly, window, hour, cpu
        self.held = {True: deque(), False: deque()}
        self.anchor = start
        self.count, self.used = 0, 0.0

    def admit(self, now: float, search: bool, cost: float = 0.0) -> int:
        if self.anchor is None or now - self.anchor >= self.hour:
            self.anchor, self.count, self.used = now, 0, 0.0
        for own in self.held.values():
            while own and now - own[0] >= self.window:
                own.popleft()
        own = self.held[search]
        if len(own) >= self.limits[search]:
            return max(1, math.ceil(self.window - (now - own[0])))
        if search and (self.count >= self.hourly or self.used >= self.cpu):
            return max(1, math.ceil(self.hour - (now - self.anchor)))
        own.append(now)
        self.count += search
        self.used += cost
        return 0


class BoundedQueue:
    """At most ``pending`` requests are under way, each for ``seconds``; a further one is refused until one ends."""

    def __init__(self, pending: int, seconds: float):
        self.pending, self.seconds, self.ends = pending, seconds, deque()

    def admit(self, now: float) -> int:
        while self.ends and self.ends[0] <= now:
            self.ends.popleft()
        if len(self.ends) >= self.pending:
            return max(1, math.ceil(self.ends[0] - now))
        self.ends.append(now + self.seconds)
        return 0


def _by_key(events: DataFrame, columns: list[str], make, judge) -> DataFrame:
    """Judge events by key in time order, batch by batch, so a hot key needs no more memory than any other."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rule, key = None, object()
        for b in batches:
            retry = []
            for row in b.itertuples(index=False):
                if row.user_id != key:
                    key, rule = row.user_id, make()
                retry.append(judge(rule, row))
            out = b[["user_id", "event_id", "ts"]].copy()
            out["admitted"] = [r == 0 for r in retry]
            out["retry"] = retry
            yield out

    parts = int(events.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = events.select(*columns).repartition(parts, "user_id").sortWithinPartitions("user_id", "ts", "event_id")
    return dealt.mapInPandas(run, RESULT)


def admit_table(events: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """Judge a table of events (user_id, event_id, ts); a key's state is at most ``limit`` times."""
    return _by_key(events, ["user_id", "event_id", "ts"], lambda: SlidingAllowance(limit, window), lambda rule, row: rule.admit(row.ts.timestamp()))


def admit_dual_table(events: DataFrame, searches: int, controls: int, hourly: int, window: float = 60.0, hour: float = 3600.0) -> DataFrame:
    """The dual rule over events with a boolean column ``search``."""
    make = lambda: DualAllowance(searches, controls, hourly, window, hour)
    return _by_key(events, ["user_id", "event_id", "ts", "search"], make, lambda rule, row: rule.admit(row.ts.timestamp(), bool(row.search)))


def queue_table(events: DataFrame, pending: int = 8, seconds: float = 1.0) -> DataFrame:
    """The bounded queue over events (user_id, event_id, ts), by key."""
    return _by_key(events, ["user_id", "event_id", "ts"], lambda: BoundedQueue(pending, seconds), lambda rule, row: rule.admit(row.ts.timestamp()))


def admit_stream(events: DataFrame, limit: int, window: float = 60.0, delay: str = "1 minute") -> DataFrame:
    """The same rule over a stream: late events beyond ``delay`` are dropped, idle keys leave the state."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rule = SlidingAllowance(limit, window, list(state.get[0]) if state.exists else [])
        parts = [f for f in frames]
        part = pd.concat(parts) if parts else pd.DataFrame(columns=["user_id", "event_id", "ts"])
        part = part.sort_values(["ts", "event_id"])
        retry = [rule.admit(t.timestamp()) for t in part["ts"]]
        out = part[["user_id", "event_id", "ts"]].copy()
        out["admitted"] = [r == 0 for r in retry]
        out["retry"] = retry
        state.update((list(rule.held),))
        latest = int(part["ts"].max().timestamp() * 1000) if len(part) else 0
        state.setTimeoutTimestamp(max(latest + int(window * 1000), state.getCurrentWatermarkMs() + 1))
        yield out

    marked = events.withWatermark("ts", delay).select("user_id", "event_id", "ts")
    return marked.groupBy("user_id").applyInPandasWithState(run, RESULT, "held array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def latest_generation(replies: DataFrame) -> DataFrame:
    """(user_id, event_id): the reply of the highest generation (ts, event_id) of each key."""
    return replies.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def byte_budget(attempts: DataFrame, budget: float) -> DataFrame:
    """(user_id, event_id): the first attempt of each key whose running sum of values is over the budget."""
    running = F.sum("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return attempts.withColumn("spent", running).filter(F.col("spent") > budget).groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def coalesced(requests: DataFrame, seconds: int) -> DataFrame:
    """(user_id, slot, requests): requests of a key in the same slot share one answer."""
    slot = F.floor(F.unix_timestamp("ts") / seconds)
    return requests.groupBy("user_id", slot.alias("slot")).agg(F.count("*").alias("requests"))


def tombstones(events: DataFrame, ttl: int = 60) -> DataFrame:
    """(user_id, event_id): events of a key less than ``ttl`` seconds after a cancel of it (event_type 'cancel')."""
    last = F.last(F.when(F.col("event_type") == "cancel", F.col("ts")), ignorenulls=True)
    before = last.over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    gone = F.col("ts") < F.col("c") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(ttl))
    return events.withColumn("c", before).filter((F.col("event_type") != "cancel") & gone).select("user_id", "event_id")


#: Requests each minute by route.
ROUTE_BUDGETS = {"tracks": 300, "rows": 600, "neighbors": 60, "credits": 300, "tiles": 2400, "links": 600}
