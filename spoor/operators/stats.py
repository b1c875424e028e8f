"""Counts and size statistics of traces and containers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 4096


def summary(steps: DataFrame, calls: DataFrame, ios: DataFrame) -> DataFrame:
    """steps_raw, steps_logical, values (one record a step), calls, io_events: one row (F-6 to F-12)."""
    a = steps.agg(F.count("*").alias("steps_raw"), F.count_if(F.col("kind") != "delta_column").alias("steps_logical"), F.count("*").alias("values"))
    return a.crossJoin(calls.agg(F.count("*").alias("calls"))).crossJoin(ios.agg(F.count("*").alias("io_events")))


def meta_json(counts: DataFrame, program: str) -> DataFrame:
    """One line of JSON with the counts of a trace (F-13)."""
    return counts.select(F.to_json(F.struct(F.lit(program).alias("program"), *counts.columns)).alias("json"))


def events_by_kind(events: DataFrame, shown: tuple[str, ...]) -> DataFrame:
    """kind, n: kinds that aren't shown count as other; kinds without events have no row (F-11)."""
    kind = F.when(F.col("kind").isin(*shown), F.col("kind")).otherwise("other")
    return events.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def file_space(files: DataFrame) -> DataFrame:
    """name, bytes, blocks, allocated, utilization per file (F-14)."""
    blocks = F.ceil(F.col("bytes") / BLOCK).cast("long")
    return files.select("name", "bytes", blocks.alias("blocks"), (blocks * BLOCK).alias("allocated"), F.when(blocks > 0, F.col("bytes") / (blocks * BLOCK)).otherwise(0.0).alias("utilization"))


def index_percentiles(sizes: DataFrame, column: str, group: list[str] | None = None) -> DataFrame:
    """n, min, median, p95, p99, max by sorted index: the element at n div 2, at least(n - 1, n * 95 div 100), ... (F-15).

    Sizes are counted first, so ranks come from running sums over distinct sizes and no list is collected.
    """
    keys = group or []
    counted = sizes.groupBy(*keys, column).agg(F.count("*").alias("c"))
    part = f"partition by {', '.join(keys)}" if keys else ""
    run = counted.selectExpr("*", f"sum(c) over ({part} order by `{column}` rows between unbounded preceding and current row) as upto", f"sum(c) over ({part}) as n")
    at = lambda k: f"min(if(upto > {k}, `{column}`, null))"
    picks = [("median", "n div 2"), ("p95", "least(n - 1, n * 95 div 100)"), ("p99", "least(n - 1, n * 99 div 100)")]
    exprs = [F.first("n").alias("n"), F.min(column).alias("min"), *[F.expr(at(k)).alias(name) for name, k in picks], F.max(column).alias("max")]
    return run.groupBy(*keys).agg(*exprs)


def pool_usage(entries: DataFrame) -> DataFrame:
    """pool_class, pool_size, entries, used_bytes, fragmentation from entry sizes (F-16, F-17)."""
    from ..functions.scalars import pool_class

    rows = entries.select(pool_class(F.col("size")).alias("pool_class"), "size")
    out = rows.groupBy("pool_class").agg(F.count("*").alias("entries"), F.sum("size").alias("used_bytes"))
    slot = F.call_function("shiftleft", F.lit(32), F.col("pool_class"))
    return out.select("pool_class", slot.alias("pool_size"), "entries", "used_bytes", ((F.col("entries") * slot - F.col("used_bytes")) / (F.col("entries") * slot)).alias("fragmentation"))


def slots(pool: DataFrame) -> DataFrame:
    """pool_class, allocated, free slots (F-25, F-26)."""
    return pool.groupBy("pool_class").agg(F.count_if("used").alias("allocated"), F.count_if(~F.col("used")).alias("free"))


def tree_shape(entries: DataFrame, fanout: int) -> DataFrame:
    """entries, leaves, depth of a B-tree of full nodes over that many entries (F-18)."""
    n = entries.agg(F.count("*").alias("entries"))
    leaves = F.ceil(F.col("entries") / fanout).cast("long")
    depth = F.when(F.col("entries") == 0, 0).otherwise(1 + F.ceil(F.log(F.greatest(leaves, F.lit(1)).cast("double")) / F.log(F.lit(float(fanout))) - 1e-9))
    return n.select("entries", leaves.alias("leaves"), depth.cast("int").alias("depth"))


def report(space: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The space report as one row of JSON a file, and as text (F-19, F-20)."""
    return space.select(F.to_json(F.struct(*space.columns)).alias("json")), space.select(F.format_string("%s %d bytes %d blocks %.1f%%", "name", "bytes", "blocks", F.col("utilization") * 100).alias("line"))


def hit_rate(accesses: DataFrame) -> DataFrame:
    """hit_rate: hits by accesses, 0 without any (F-21)."""
    return accesses.agg(F.coalesce(F.avg(F.col("hit").cast("double")), F.lit(0.0)).alias("hit_rate"))


def totals(frames: DataFrame) -> DataFrame:
    """compressed, decompressed bytes of all frames (F-22, F-23)."""
    return frames.agg(F.coalesce(F.sum("compressed_size"), F.lit(0)).alias("compressed"), F.coalesce(F.sum("decompressed_size"), F.lit(0)).alias("decompressed"))


def quorum_read(replies: DataFrame, quorum: int) -> DataFrame:
    """block_id, replies, data of the first replica that answered; blocks with fewer good replies than the quorum fail and go (F-24)."""
    ok = replies.groupBy("block_id").agg(F.count_if("ok").alias("replies"), F.min_by("data", F.when(F.col("ok"), F.col("replica_no"))).alias("data"))
    return ok.where(F.col("replies") >= quorum)


def evicted(blocks: DataFrame, budget: int) -> DataFrame:
    """block_id of the blocks to evict, in their order, until the size is within the budget; permanent ones stay.

    A block goes while what stays after the ones before it is still over the budget.
    """
    from .numbering import bucketed

    rows = bucketed(blocks.where("not permanent"), "block_id", 4096)
    own = rows.withColumn("_in", F.expr("sum(bytes) over (partition by _bin order by block_id rows between unbounded preceding and current row) - bytes"))
    bins = rows.groupBy("_bin").agg(F.sum("bytes").alias("_sum"))
    starts = bins.selectExpr("_bin", "sum(_sum) over (order by _bin rows between unbounded preceding and current row) - _sum as _start")
    total = blocks.agg(F.sum("bytes").alias("_total"))
    return own.join(starts, "_bin").crossJoin(F.broadcast(total)).where(F.col("_total") - F.col("_start") - F.col("_in") > budget).select("block_id")


def reclaimable(pages: DataFrame, oldest: int) -> tuple[DataFrame, DataFrame]:
    """Freed pages that no reader can see any more, and those that must wait (I-5)."""
    return pages.where(F.col("freed_commit") <= oldest), pages.where(F.col("freed_commit") > oldest)
