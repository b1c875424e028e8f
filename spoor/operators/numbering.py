"""Dense numbers and running sums over a total order, without sorting a table in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bucketed(df: DataFrame, order: str, width: int = 65536) -> DataFrame:
    """df with _bin, which rises with the integer column `order`; each bin is ordered on its own."""
    return df.withColumn("_bin", F.floor(F.col(order) / F.lit(width)))


def dense(df: DataFrame, order: str, out: str, width: int = 65536) -> DataFrame:
    """df with `out`: 0, 1, 2, ... in the order of an integer column.

    Rows are numbered in bins of the column's values, and each bin starts after the rows of those
    before it; only one row a bin passes through a single task.
    """
    rows = bucketed(df, order, width)
    sizes = rows.groupBy("_bin").agg(F.count("*").alias("_n"))
    starts = sizes.selectExpr("_bin", "sum(_n) over (order by _bin rows between unbounded preceding and current row) - _n as _start")
    numbered = rows.withColumn("_at", F.expr(f"row_number() over (partition by _bin order by `{order}`) - 1"))
    return numbered.join(starts, "_bin").withColumn(out, (F.col("_start") + F.col("_at")).cast("long")).drop("_bin", "_at", "_start")


def interned(df: DataFrame, name: str, order: str, out: str = "id") -> DataFrame:
    """name, id: names numbered by their first appearance."""
    first = df.groupBy(name).agg(F.min(order).alias("_first"))
    return dense(first, "_first", out).select(name, out)
