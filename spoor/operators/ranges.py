"""Interval joins, ranges and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, point: str, low: str, high: str, width: int, how: str = "inner") -> DataFrame:
    """points with every span for which low <= point <= high, as an equality join on bins of `width`.

    A span stands in each bin it touches: where spans nest, a bin holds those that enter it and
    those already open at its start, so long outer spans cost bins times depth rows. A point
    lies in one bin and so meets a span once.
    """
    left = points.withColumn("_bin", F.floor(F.col(point) / width))
    right = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    on = (left["_bin"] == right["_bin"]) & (left[point] >= right[low]) & (left[point] <= right[high])
    return left.join(right, on, how).drop("_bin")


def page(df: DataFrame, key: str, start: int, count: int, cap: int | None = None) -> DataFrame:
    """Rows with start <= key < start + count by key, at most `cap`: dense keys make it a pushed-down filter (H)."""
    found = df.where(F.col(key).between(start, start + count - 1)).orderBy(key)
    return found if cap is None else found.limit(cap)


def scan(df: DataFrame, key: str, low: int, high: int, cap: int | None = None) -> DataFrame:
    """Rows with low <= key <= high by key, at most `cap`."""
    return page(df, key, low, high - low + 1, cap)


def as_of(points: DataFrame, bases: DataFrame, point: str, base: str, width: int = 65536) -> DataFrame:
    """points with the columns of the row of bases that has the greatest base <= point; points before all have no row.

    Points and bases are put in one order inside bins of their values. A point with no base before
    it in its bin takes the last one of the bins before: one row a bin passes through a single task.
    """
    own = points.select(F.col(point).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"), F.lit(None).alias("_base"))
    given = bases.select(F.col(base).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).alias("_row"), F.struct(*bases.columns).alias("_base"))
    rows = own.unionByName(given).withColumn("_bin", F.floor(F.col("_at") / width))
    heads = rows.groupBy("_bin").agg(F.max_by("_base", F.when(F.col("_kind") == 0, F.col("_at"))).alias("_last"))
    before = heads.selectExpr("_bin", "last_value(_last) ignore nulls over (order by _bin rows between unbounded preceding and 1 preceding) as _before")
    near = rows.withColumn("_near", F.expr("last_value(_base) ignore nulls over (partition by _bin order by _at, _kind rows between unbounded preceding and current row)"))
    found = near.where("_kind = 1").join(before, "_bin").select("_row", F.coalesce("_near", "_before").alias("_base")).where("_base is not null")
    return found.select("_row.*", "_base.*")


def frame_at(offset: Column, size: int) -> tuple[Column, Column]:
    """The frame that holds a byte offset and the offset in it, for frames of one size."""
    return F.floor(offset / size).cast("long"), (offset % size).cast("long")
