"""Calls: the one that encloses a step, and call trees from enter and return signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .indexes import POSTINGS, postings
from .numbering import dense
from .ranges import range_join

#: Steps of a bin when steps meet calls: a step is compared with the calls that touch its bin.
BIN = 256


def enclosing(steps: DataFrame, calls: DataFrame, bin_width: int = BIN, by: tuple[str, ...] = (), keep: tuple[str, ...] = ()) -> DataFrame:
    """by, step_id, keep, call_key: the greatest call_key with entry <= step <= exit, null outside every call (E-1).

    by: columns that tell traces apart; keep: columns of the steps to carry along. Rows stay in the partitions of the bins through the
    aggregate, so each side is shuffled once.
    """
    left = steps.select(*by, "step_id", *keep).withColumn("_bin", F.floor(F.col("step_id") / bin_width))
    bins = F.sequence(F.floor(F.col("entry_step") / bin_width), F.floor(F.col("exit_step") / bin_width))
    right = calls.select(*by, "call_key", "entry_step", "exit_step", F.explode(bins).alias("_bin"))
    on = F.expr("entry_step <= step_id and exit_step >= step_id")
    for key in [*by, "_bin"]:
        on = on & (left[key] == right[key])
    met = left.join(right, on, "left")
    keys = [left[k] for k in (*by, "_bin", "step_id", *keep)]
    return met.groupBy(*keys).agg(F.max("call_key").alias("call_key")).select(*by, "step_id", *keep, "call_key")


def signals(calls: DataFrame) -> DataFrame:
    """seq, kind (enter, return), function_id: what a recorder would have sent for these calls.

    At one step exits of deeper calls come first among returns, and entries of outer calls first among entries.
    """
    enter = calls.selectExpr("entry_step * 8 + depth as seq", "'enter' as kind", "function_id")
    leave = calls.selectExpr("exit_step * 8 + 7 - depth as seq", "'return' as kind", "function_id")
    return enter.unionByName(leave)


def call_tree(sig: DataFrame, last_seq: int | None = None, width: int = 65536) -> DataFrame:
    """call_key, function_id, enter_seq, exit_seq, depth, parent_call_key from signals; -1 for no parent (R5).

    open = entries less returns so far; a frame's enter and return share the depth open - 1 and
    open. Both the running sum and the order in a depth are taken in bins of seq first, so no
    trace is one task. Calls that never return end at the last signal, and more returns than
    entries raise an error where there is any call, as the recorder's stack would underflow.
    """
    rows = sig.withColumn("d", F.expr("if(kind = 'enter', 1, -1)")).withColumn("_bin", F.floor(F.col("seq") / width))
    sums = rows.groupBy("_bin").agg(F.sum("d").alias("_sum"))
    starts = sums.selectExpr("_bin", "sum(_sum) over (order by _bin rows between unbounded preceding and current row) - _sum as _start")
    run = "sum(d) over (partition by _bin order by seq rows between unbounded preceding and current row)"
    opened = rows.withColumn("_in", F.expr(run)).join(starts, "_bin").selectExpr("seq", "kind", "function_id", "_in + _start as open")
    framed = opened.withColumn("depth", F.expr("cast(if(kind = 'enter', open - 1, open) as int)"))
    # The signal after an enter at its depth is its return: the next in the bin, else the first of a later bin.
    framed = framed.withColumn("_bin", F.floor(F.col("seq") / width))
    heads = framed.groupBy("depth", "_bin").agg(F.min("seq").alias("_head"))
    after = heads.selectExpr("depth", "_bin", "lead(_head) over (partition by depth order by _bin) as _after")
    near = framed.withColumn("_next", F.expr("lead(seq) over (partition by depth, _bin order by seq)"))
    paired = near.join(after, ["depth", "_bin"]).withColumn("exit_seq", F.coalesce("_next", "_after")).drop("_bin", "_next", "_after")
    frames = dense(paired.where("kind = 'enter'"), "seq", "call_key", width)
    # Every frame's end reads the least open, so that an underflow can't be pruned away.
    bounds = opened.agg(F.max("seq").alias("_last"), F.min("open").alias("_low"))
    frames = frames.crossJoin(F.broadcast(bounds))
    last = F.col("_last") if last_seq is None else F.lit(last_seq).cast("long")
    end = F.when(F.col("_low") < 0, F.raise_error(F.lit("return without a call"))).otherwise(F.coalesce("exit_seq", last))
    frames = frames.select("call_key", "function_id", F.col("seq").alias("enter_seq"), end.alias("exit_seq"), "depth")
    parents = frames.selectExpr("call_key as parent_call_key", "depth + 1 as depth", "enter_seq as p_enter", "exit_seq as p_exit")
    bins = F.sequence(F.floor(F.col("p_enter") / 4096), F.floor(F.col("p_exit") / 4096))
    parents = parents.withColumn("_bin", F.explode(bins))
    left = frames.withColumn("_bin", F.floor(F.col("enter_seq") / 4096))
    met = left.join(parents, (left["_bin"] == parents["_bin"]) & (left["depth"] == parents["depth"]) & F.expr("p_enter < enter_seq and p_exit >= exit_seq"), "left")
    return met.select("call_key", "function_id", "enter_seq", "exit_seq", left["depth"], F.coalesce("parent_call_key", F.lit(-1).cast("long")).alias("parent_call_key"))


def children(tree: DataFrame, span: int = POSTINGS) -> DataFrame:
    """parent_call_key, chunk_no, children (keys in order) of every call that has some."""
    return postings(tree.where("parent_call_key >= 0"), ["parent_call_key"], "call_key", "children", span)


def leaf_clamp(entry: str, step_count: str) -> str:
    """The recorded entry of a call that returned before any step: the step before, or 0."""
    return f"if({step_count} > {entry}, {entry}, greatest({step_count} - 1, 0))"


__all__ = ["BIN", "call_tree", "children", "enclosing", "leaf_clamp", "range_join", "signals"]
