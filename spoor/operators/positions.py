"""Source positions: rebuilding them from deltas, resolving them, and encoding them again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import range_join

#: Steps of a chunk of the step stream; values and calls have 256, I/O events 64.
CHUNK = 4096
#: Positions a file spans when files are packed into one index.
STRIDE = 100_000

_MOVES = "kind in ('absolute', 'delta', 'delta_column')"


def within_chunks(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """steps with seg (absolute steps so far in the chunk) and part (the sum since the last of them)."""
    keys = ", ".join([*by, "chunk_id"])
    over = f"over (partition by {keys} order by step_id rows between unbounded preceding and current row)"
    rows = steps.withColumn("seg", F.expr(f"sum(if(kind = 'absolute', 1, 0)) {over}"))
    # Both levels are windows of one order, so a chunk is sorted once: moves since the chunk's start, and what an absolute step set them to.
    rows = rows.withColumn("_moved", F.expr(f"sum(if({_MOVES} and kind <> 'absolute', v, 0L)) {over}"))
    rows = rows.withColumn("_from", F.expr(f"last(if(kind = 'absolute', coalesce(v, 0L) - _moved, null), true) {over}"))
    return rows.withColumn("part", F.expr("_moved + coalesce(_from, 0L)")).drop("_moved", "_from")


def positions(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, step_id, kind, position of every step, carried over chunk boundaries (G-1, G-7).

    by: columns that tell traces apart. Two levels: sums inside each chunk, then a running sum
    over one row a chunk, whose result each chunk starts from until its first absolute step.
    """
    rows = within_chunks(steps, by)
    ends = rows.groupBy(*by, "chunk_id").agg(F.max("seg").alias("n"), F.max_by("part", "step_id").alias("tail"))
    own = f"partition by {', '.join(by)} " if by else ""
    upto = "order by chunk_id rows between unbounded preceding and current row"
    ends = ends.withColumn("g", F.expr(f"sum(if(n > 0, 1, 0)) over ({own}{upto})"))
    ends = ends.withColumn("out", F.expr(f"sum(tail) over (partition by {', '.join([*by, 'g'])} {upto})"))
    carry = ends.selectExpr(*by, "chunk_id", f"coalesce(lag(out) over ({own}order by chunk_id), 0L) as carry")
    joined = rows.join(carry, [*by, "chunk_id"])
    return joined.selectExpr(*by, "step_id", "kind", "cast(part + if(seg = 0, carry, 0L) as bigint) as position")


def position_point(steps: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, step_id, kind, position as a point read gives it, starting from 0 in each chunk (G-2)."""
    return within_chunks(steps, by).selectExpr(*by, "step_id", "kind", "cast(part as bigint) as position")


def resolve(position: Column, files: int | None = None) -> tuple[Column, Column]:
    """path_id and line of a position under the fixed stride; beyond the last file it stays there (E-2)."""
    path = F.floor(position / STRIDE)
    if files is not None:
        path = F.least(path, F.lit(files - 1))
    return path.cast("long"), (position - path * STRIDE).cast("long")


def file_bases(counts: DataFrame) -> DataFrame:
    """file_id, n, base: the exclusive prefix sum of line counts; a file without lines counts 1 (G-3, G-3c)."""
    sized = counts.withColumn("n", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1)).cast("long"))
    sized = sized.withColumn("_bin", F.col("file_id").cast("long") / F.lit(4096))
    sized = sized.withColumn("_bin", F.floor("_bin"))
    own = sized.withColumn("_in", F.expr("sum(n) over (partition by _bin order by file_id rows between unbounded preceding and current row) - n"))
    bins = sized.groupBy("_bin").agg(F.sum("n").alias("_sum"))
    starts = bins.selectExpr("_bin", "sum(_sum) over (order by _bin rows between unbounded preceding and current row) - _sum as _start")
    return own.join(starts, "_bin").selectExpr("file_id", "n", "cast(_in + _start as bigint) as base")


def line_bases(paths: DataFrame) -> DataFrame:
    """path_id, line (from 1), len, base: where each line begins in the position space of bytes (G-3b)."""
    files = file_bases(paths.selectExpr("path_id as file_id", "cast(aggregate(line_lengths, 0L, (a, x) -> a + x) as bigint) as n"))
    lines = paths.selectExpr("path_id", "posexplode(line_lengths) as (i, len)")
    own = "sum(len) over (partition by path_id order by i rows between unbounded preceding and current row) - len"
    inside = lines.selectExpr("path_id", "cast(i + 1 as int) as line", "cast(len as bigint) as len", f"cast({own} as bigint) as off")
    return inside.join(files.selectExpr("file_id as path_id", "base as file_base"), "path_id").selectExpr("path_id", "line", "len", "file_base + off as base")


def decode(points: DataFrame, paths: DataFrame, point: str = "position") -> DataFrame:
    """points with path_id, line and column (from 1); positions beyond every line have no row (E-3)."""
    lines = line_bases(paths).where("len > 0").selectExpr("path_id", "line", "base", "base + len - 1 as last")
    found = range_join(points, lines, point, "base", "last", width=4096)
    return found.withColumn("column", (F.col(point) - F.col("base") + 1).cast("int")).drop("base", "last")


def locations(points: DataFrame, paths: DataFrame, point: str = "position") -> DataFrame:
    """points with path_id, line, column: by line tables where they hold the position, else by the stride with column 1 (E-7)."""
    exact = decode(points, paths, point).select("step_id", F.col("path_id").alias("_p"), F.col("line").alias("_l"), "column")
    path, line = resolve(F.col(point))
    joined = points.join(exact, "step_id", "left")
    return joined.select(*points.columns, F.coalesce("_p", path).alias("path_id"), F.coalesce(F.col("_l").cast("long"), line).alias("line"), F.coalesce("column", F.lit(1)).alias("column"))


def to_global(path_id: Column, line: Column) -> Column:
    """The position of a line under the fixed stride (G-5)."""
    return path_id * STRIDE + line


def encode_steps(targets: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """step_id, kind, v from step_id and position: a delta where it fits 7 bits and no chunk starts, else absolute (G-6w).

    The order is cut into chunks first, and as each chunk starts with an absolute step, no value crosses one.
    """
    rows = targets.withColumn("chunk_id", F.floor(F.col("step_id") / chunk))
    delta = F.expr("position - lag(position) over (partition by chunk_id order by step_id)")
    rows = rows.withColumn("d", delta)
    is_delta = (F.col("step_id") % chunk != 0) & F.col("d").between(-64, 63)
    return rows.select("step_id", "chunk_id", F.when(is_delta, "delta").otherwise("absolute").alias("kind"), F.when(is_delta, F.col("d")).otherwise(F.col("position")).alias("v"))
