"""Registered queries that run as streams over what a folder holds, and return what they wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import follow
from . import projections as T
from .registry import query


def _growing(spark, sf):
    """The events as a stream of the files that make up the table."""
    schema = T.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf)


def _written(spark, stream, name):
    """What a stream appended until it had taken all there was."""
    path = follow.scratch(spark, name)
    follow.append(stream, f"{path}/rows", f"{path}/marks").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("SELECT event_id AS step_id, event_type AS kind, user_id AS thread_id FROM events")
def followed_steps(spark, sf):
    """Steps of a growing trace, each appended once (K-1 to K-3)."""
    return _written(spark, _growing(spark, sf).selectExpr("event_id as step_id", "event_type as kind", "user_id as thread_id"), "followed")


@query(
    """SELECT thread_id, step_seq, coalesce(string_agg(name, ',' ORDER BY seq), '') AS names FROM (
    SELECT s.user_id AS thread_id, s.event_id AS step_seq, v.event_type AS name, v.event_id AS seq FROM (
      SELECT user_id, event_id, lead(event_id) OVER w AS after, row_number() OVER w AS k FROM events WHERE event_type = 'click' WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) s
    LEFT JOIN events v ON v.user_id = s.user_id AND v.event_type <> 'click' AND v.event_id < s.after AND (v.event_id > s.event_id OR s.k = 1)
    WHERE s.after IS NOT NULL) GROUP BY 1, 2"""
)
def pending_step_values(spark, sf):
    """Values of each thread's open step, given out with it when the next step comes: state in a stream (K-5)."""
    signals = _growing(spark, sf).selectExpr("user_id as thread_id", "event_id as seq", "if(event_type = 'click', 'step', 'value') as kind", "event_type as name")
    out = follow.pending_steps(signals)
    return _written(spark, out, "pending").withColumn("names", F.array_join("names", ","))


@query("SELECT event_id AS call_key, event_id AS entry_step, CASE WHEN event_type = 'error' THEN (SELECT max(event_id) FROM events) ELSE event_id + 3 END AS exit_step FROM events")
def drained_calls(spark, sf):
    """Calls that never returned end at the last step (K-4)."""
    rows = T.table(spark, sf, "events")
    calls = rows.selectExpr("event_id as call_key", "event_id as entry_step", "if(event_type = 'error', null, event_id + 3) as exit_step")
    return follow.drain(calls, rows.selectExpr("event_id as step_id"))
