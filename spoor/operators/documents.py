"""Interleaved documents: the streams of a trace woven into one order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The order of what happens at one step of a document.
ENTRY, STEP, IO, EXIT, LATE = range(5)


def _part(df: DataFrame, phase: int, step: str, ordinal: str, kind: str, payload: str) -> DataFrame:
    return df.selectExpr(f"cast({step} as bigint) as step_id", f"{phase} as phase", f"cast({ordinal} as bigint) as ordinal", f"'{kind}' as kind", f"{payload} as payload")


def document(steps: DataFrame, calls: DataFrame, ios: DataFrame) -> DataFrame:
    """step_id, phase, ordinal, kind, payload: per step its call entries, itself, its I/O and its call exits (E-5).

    Column nudges are left out. Entries past the last step come at the end, by entry and key. The
    order is the first three columns; sort by them to print.
    """
    known = calls.crossJoin(F.broadcast(steps.agg(F.coalesce(F.max("step_id") + 1, F.lit(0)).alias("_n"))))  # one row
    inside, late = known.where("entry_step < _n"), known.where("entry_step >= _n")
    parts = [
        _part(inside, ENTRY, "entry_step", "call_key", "call_entry", "concat('f', function_id)"),
        _part(steps.where("kind <> 'delta_column'"), STEP, "step_id", "0", "step", "kind"),
        _part(ios, IO, "step_id", "io_index", "io", "kind"),
        _part(inside, EXIT, "exit_step", "call_key", "call_exit", "concat('f', function_id)"),
        _part(late, LATE, "entry_step", "call_key", "call_entry", "concat('f', function_id)"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def low_level(paths: DataFrame, functions: DataFrame, steps: DataFrame, calls: DataFrame, values: DataFrame, ios: DataFrame) -> DataFrame:
    """section, step_id, phase, ordinal, kind, payload: declarations, then per step calls (by depth), the step,
    its values and returns (deepest first), then all I/O, of which every kind but errors is a write (I-1)."""
    zero = "cast(0 as bigint)"

    def section(df, n, step, phase, ordinal, kind, payload):
        return df.selectExpr(f"{n} as section", f"cast({step} as bigint) as step_id", f"{phase} as phase", f"cast({ordinal} as bigint) as ordinal", f"{kind} as kind", f"{payload} as payload")

    parts = [
        section(paths, 0, zero, 0, "path_id", "'path'", "path"),
        section(functions, 1, zero, 0, "id", "'function'", "name"),
        section(calls, 2, "entry_step", 0, "depth * 1000000000 + call_key", "'call'", "concat('f', function_id)"),
        section(steps, 2, "step_id", 1, "0", "'step'", "kind"),
        section(values, 2, "step_id", 2, "ordinal", "'value'", "varname"),
        section(calls, 2, "exit_step", 3, "-(depth * 1000000000 + call_key)", "'return'", "concat('f', function_id)"),
        section(ios, 3, "step_id", 0, "io_index", "if(kind = 'error', 'error', 'write')", "data"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def json_events(declarations: DataFrame, steps: DataFrame, calls: DataFrame, values: DataFrame, ios: DataFrame) -> DataFrame:
    """step_id, phase, ordinal, json: declarations first (step -1), then per step call, step, values and I/O; no exits (E-6)."""

    def line(df, step, phase, ordinal, kind, *columns):
        body = F.to_json(F.struct(F.lit(kind).alias("event"), *columns))
        return df.select(F.expr(f"cast({step} as bigint)").alias("step_id"), F.lit(phase).alias("phase"), F.expr(f"cast({ordinal} as bigint)").alias("ordinal"), body.alias("json"))

    parts = [
        line(declarations, "-1", 0, "id", "declaration", "id", "name"),
        line(calls, "entry_step", 1, "call_key", "call", "call_key", "function_id"),
        line(steps, "step_id", 2, "0", "step", "step_id", "kind"),
        line(values, "step_id", 3, "ordinal", "value", "varname", "value"),
        line(ios, "step_id", 4, "io_index", "io", "io_index", "kind"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def native(thread_events: DataFrame, os_events: DataFrame) -> DataFrame:
    """section, geid, thread_id, stream_offset, source, event: thread events by (geid, thread, offset), then OS events as stored."""
    a = thread_events.selectExpr("0 as section", "geid", "thread_id", "stream_offset", "'thread' as source", "event")
    b = os_events.selectExpr("1 as section", "geid", "thread_id", "stored as stream_offset", "'os' as source", "event")
    return a.unionByName(b)


ORDER = ("step_id", "phase", "ordinal")


def to_text(doc: DataFrame) -> DataFrame:
    """One line of text an event, in order."""
    return doc.orderBy(*ORDER).select(F.format_string("%d %s %s", "step_id", "kind", "payload").alias("line"))
