import math
import random
from datetime import datetime, timedelta

import pytest

from quaver.streaming import ordered

T0 = datetime(2024, 1, 1)
DUAL = "user_id long, event_id long, ts timestamp, search boolean, cost double"
CANCEL = "user_id long, event_id long, ts timestamp, cancel boolean, request string, generation long"


def dual_events(n, seed):
    r = random.Random(seed)
    return [(r.choice([1, 1, 1, 2, 3]), i, T0 + timedelta(milliseconds=r.randint(0, 9_000_000)), r.random() < 0.7, r.random()) for i in range(n)]


def cancel_events(n, seed):
    r = random.Random(seed)
    return [(r.choice([1, 1, 2]), i, T0 + timedelta(milliseconds=r.randint(0, 400_000)), r.random() < 0.5, str(r.randint(0, 9)), r.randint(0, 1)) for i in range(n)]


def brute_dual(events, searches, controls, hourly, cpu, start):
    """Each answer from the list of what was admitted before, with no state but that list and the hours' starts."""
    out = {}
    for user in {e[0] for e in events}:
        admitted, hour = [], start
        for _, event, ts, search, cost in sorted((e for e in events if e[0] == user), key=lambda e: (e[2], e[1])):
            now = ts.timestamp()
            if hour is None or now - hour >= 3600:
                hour = now
                admitted = [(*a[:3], False) for a in admitted]
            near = [a[0] for a in admitted if a[1] == search and now - a[0] < 60]
            this_hour = [a for a in admitted if a[3]]
            if len(near) >= (searches if search else controls):
                out[event] = max(1, math.ceil(60 - (now - near[0])))
            elif search and (sum(a[1] for a in this_hour) >= hourly or sum(a[2] for a in this_hour) >= cpu):
                out[event] = max(1, math.ceil(3600 - (now - hour)))
            else:
                admitted.append((now, search, cost, True))
                out[event] = 0
    return out


def brute_cancels(events, ttl, most):
    out = {}
    for user in {e[0] for e in events}:
        held = []  # [request and generation, end], the one held longest first
        for _, event, ts, cancel, request, generation in sorted((e for e in events if e[0] == user), key=lambda e: (e[2], e[1])):
            now, name = ts.timestamp(), (request, generation)
            out[event] = not cancel and any(h[0] == name and h[1] > now for h in held)
            if cancel:
                held = [h for h in held if h[1] > now]
                held = held[1:] if len(held) >= most else held
                mine = [h for h in held if h[0] == name]
                if mine:
                    mine[0][1] = now + ttl
                else:
                    held.append([name, now + ttl])
    return out


def written(spark, events, kind, folder):
    spark.createDataFrame(events, kind).coalesce(1).write.mode("append").parquet(folder)


def fed(spark, events, kind, make, tmp_path, end):
    """The stream's rows after two runs from one checkpoint, over events that arrive a little out of order."""
    r = random.Random(7)
    late = sorted(events, key=lambda e: e[2] + timedelta(seconds=r.randint(0, 50)))
    source = str(tmp_path / "in")
    for i, part in enumerate((late[: len(late) // 2], late[len(late) // 2 :], [end])):
        written(spark, part, kind, source)
        rows = ordered.run_to_end(make(spark.readStream.schema(kind).parquet(source)), str(tmp_path / "out"))
        if i == 0:
            assert 0 < rows.count() < len(part)
    return rows.collect()


@pytest.mark.parametrize("start", [None, T0.timestamp() - 1800])
def test_dual_table_equals_brute_force(spark, start):
    events = dual_events(600, 1)
    got = ordered.dual_table(spark.createDataFrame(events, DUAL), 3, 2, 40, cpu=12.0, start=start).collect()
    want = brute_dual(events, 3, 2, 40, 12.0, start)
    assert {r.event_id: r.retry for r in got} == want and len(got) == 600
    assert any(v > 60 for v in want.values()) and all(r.admitted == (r.retry == 0) for r in got)
    assert {r.event_id: r.ts for r in got} == {e[1]: e[2] for e in events}


def test_dual_stream_equals_table_over_restarts(spark, tmp_path):
    events = dual_events(300, 2)
    make = lambda s: ordered.dual_stream(s, 2, 2, 30, delay="1 minute", cpu=9.0)
    got = fed(spark, events, DUAL, make, tmp_path, (9, 999, T0 + timedelta(days=1), True, 0.0))
    assert {r.event_id: r.retry for r in got} == brute_dual(events, 2, 2, 30, 9.0, None) and len(got) == 300


def test_cancel_table_equals_brute_force(spark):
    for most in (3, 256):
        events = cancel_events(500, most)
        got = ordered.cancel_table(spark.createDataFrame(events, CANCEL), 60.0, most).collect()
        want = brute_cancels(events, 60.0, most)
        assert {r.event_id: r.cancelled for r in got} == want and len(got) == 500 and any(want.values())


def test_cancel_stream_equals_table_over_restarts(spark, tmp_path):
    events = cancel_events(200, 5)
    got = fed(spark, events, CANCEL, lambda s: ordered.cancel_stream(s, 60.0, 4), tmp_path, (9, 999, T0 + timedelta(days=1), True, "x", 0))
    assert {r.event_id: r.cancelled for r in got} == brute_cancels(events, 60.0, 4) and len(got) == 200


def test_odd_rows(spark):
    rows = [(1, 1, None, True, 0.0), (None, 2, T0, True, 0.0), (1, 3, T0, None, None), (1, 3, T0, None, None), (1, None, T0, True, 0.5)]
    got = ordered.dual_table(spark.createDataFrame(rows, DUAL), 5, 5, 5).collect()
    assert sorted((r.event_id is None, r.event_id or 0, r.retry) for r in got) == [(False, 3, 0), (False, 3, 0), (True, 0, 0)]
    assert ordered.dual_table(spark.createDataFrame([], DUAL), 5, 5, 5).count() == 0
    cancels = [(1, 1, T0, True, None, None), (1, 2, T0, False, None, None), (1, 3, T0, None, "a", None)]
    assert [r.cancelled for r in sorted(ordered.cancel_table(spark.createDataFrame(cancels, CANCEL)).collect(), key=lambda r: r.event_id)] == [False, True, False]


def test_streamed_query_equals_table_form(spark, small):
    from pyspark.sql import functions as F

    from quaver import queries_streams, schema

    events = schema.table(spark, small, "events").select("user_id", "event_id", "ts", (F.col("event_type") != "view").alias("search"), F.col("value").alias("cost"))
    want = {(r.user_id, r.event_id, r.ts, r.admitted, r.retry) for r in ordered.dual_table(events, 2, 1, 5, window=3600.0, hour=86400.0, cpu=200.0).collect()}
    got = queries_streams.QUERIES["w02_streamed_admission"](spark, small).collect()
    assert {tuple(r.asDict()[c] for c in ("user_id", "event_id", "ts", "admitted", "retry")) for r in got} == want and len(got) == len(want)
    assert {r.admitted for r in got} == {True, False}
