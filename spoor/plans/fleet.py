"""Registered queries over many traces at once, told apart by trace_id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import carry, indexes
from ..operators import positions as P
from . import projections as T
from .queries import MOVING
from .registry import query

BY = ("trace_id",)


@query("SELECT * FROM fleet_positions", T.STEPS, T.FLEET)
def fleet_positions(spark, sf):
    """The absolute position of every step of every trace (R1)."""
    return P.positions(T.fleet_steps(spark, sf), BY)


@query("SELECT s.trace_id, s.step_id, max(call_key) AS call_key FROM fleet s LEFT JOIN fleet_calls c ON c.trace_id = s.trace_id AND entry_step <= step_id AND exit_step >= step_id GROUP BY ALL", T.STEPS, T.CALLS, T.FLEET, T.FLEET_CALLS)
def fleet_call_for_step(spark, sf):
    """The innermost call of every step of every trace (R2)."""
    return C.enclosing(T.fleet_steps(spark, sf), T.fleet_calls(spark, sf), by=BY)


@query(f"SELECT trace_id, position AS gli, step_id // 65536 AS chunk_no, string_agg(CAST(step_id AS VARCHAR), ',' ORDER BY step_id) AS step_ids, count(*) AS n FROM fleet_positions WHERE {MOVING} GROUP BY 1, 2, 3", T.STEPS, T.FLEET)
def fleet_line_hits(spark, sf):
    """The step ids of each line of every trace, in chunks (F-1)."""
    return indexes.line_hits(P.positions(T.fleet_steps(spark, sf), BY), by=BY).withColumn("step_ids", F.array_join("step_ids", ","))


@query(
    f"""SELECT trace_id, position // {T.STRIDE} AS path_id, position % {T.STRIDE} AS line, step_id // 65536 AS chunk_no, count(*) AS step_count,
    min(step_id) AS first_step_id, max(step_id) AS last_step_id FROM fleet_positions WHERE {MOVING} GROUP BY 1, 2, 3, 4""",
    T.STEPS, T.FLEET,
)
def fleet_step_map(spark, sf):
    """The breakpoint index of every trace (F-4)."""
    path, line = P.resolve(F.col("position"))
    located = P.positions(T.fleet_steps(spark, sf), BY).where(MOVING).select("trace_id", "step_id", path.alias("path_id"), line.alias("line"))
    return indexes.step_map(located, by=BY).drop("step_ids")


@query("SELECT trace_id, step_id AS seq, CASE WHEN kind = 'absolute' THEN step_id END AS step_id, min(CASE WHEN kind = 'absolute' THEN step_id END) OVER (PARTITION BY trace_id ORDER BY step_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS target FROM fleet", T.STEPS, T.FLEET)
def fleet_carry_forward(spark, sf):
    """Values without a step go to the next one of their trace (R7)."""
    rows = T.fleet_steps(spark, sf).selectExpr("trace_id", "step_id as seq", "if(kind = 'absolute', step_id, null) as step_id")
    return carry.carry_forward(rows, 4096, BY)


@query("SELECT trace_id, count(*) AS steps, count(DISTINCT CASE WHEN kind IN ('absolute', 'delta') THEN position END) AS lines FROM fleet_positions GROUP BY 1", T.STEPS, T.FLEET)
def fleet_summary(spark, sf):
    """Steps and distinct lines of every trace (F-3, F-6)."""
    moved = F.when(F.expr(MOVING), F.col("position"))
    return P.positions(T.fleet_steps(spark, sf), BY).groupBy("trace_id").agg(F.count("*").alias("steps"), F.countDistinct(moved).alias("lines"))
