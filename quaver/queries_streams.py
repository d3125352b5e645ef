"""Queries that read tables as streams, with their SQL where it can say the same."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaver import schema
from quaver.scratch import scratch_table, shared_folder
from quaver.streaming import ordered

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _ended(spark, d) -> DataFrame:
    """The events as a stream that one event of another day and nobody's user closes, so that the watermark passes all others."""
    events = schema.table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value")
    last = scratch_table(events.agg(F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 2 days")).alias("ts"), F.lit("view").alias("event_type"), F.lit(0.0).alias("value")), "closing")
    read = lambda df, path: spark.readStream.schema(df.schema).parquet(path)
    # a pattern, since a stream takes the path of one file for a folder
    return read(events, f"{d}/events.parque[t]").unionByName(read(last, last.inputFiles()[0].rsplit("/", 1)[0]))


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"


@query("w02_streamed_admission")
def _(spark, d):
    events = _ended(spark, d).select("user_id", "event_id", "ts", (F.col("event_type") != "view").alias("search"), F.col("value").alias("cost"))
    admitted = ordered.dual_stream(events, 2, 1, 5, "1 hour", window=3600.0, hour=86400.0, cpu=200.0)
    return ordered.run_to_end(admitted, _folder(spark))


CANCELLED = """
SELECT user_id, event_id, event_type <> 'view' AND c IS NOT NULL AND epoch_us(ts) - epoch_us(c) < 259200000000 AS cancelled
FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS)
        OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT) % 4, event_id % 2 ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c
      FROM events)
"""


@query("w03_streamed_cancels", CANCELLED)
def _(spark, d):
    request = (F.floor("value") % 4).cast("string")
    events = _ended(spark, d).select("user_id", "event_id", "ts", (F.col("event_type") == "view").alias("cancel"), request.alias("request"), (F.col("event_id") % 2).alias("generation"))
    return ordered.run_to_end(ordered.cancel_stream(events, 259200.0, 256, "1 hour"), _folder(spark)).drop("ts")
