"""Values that arrive without a step, and the latest state of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def carry_forward(signals: DataFrame, width: int = 65536, by: tuple[str, ...] = ()) -> DataFrame:
    """signals with target: the step_id of the step at or after each one, null past the last (R7, G-8).

    by: columns that tell traces apart. The next step is found inside bins of seq, else it is the
    first step of a later bin; one row a bin crosses.
    """
    keys = [*by, "_bin"]
    own = f"partition by {', '.join(by)} " if by else ""
    rows = signals.withColumn("_bin", F.floor(F.col("seq") / width))
    near = f"first_value(step_id) ignore nulls over (partition by {', '.join(keys)} order by seq rows between current row and unbounded following)"
    heads = rows.groupBy(*keys).agg(F.min_by("step_id", F.when(F.col("step_id").isNotNull(), F.col("seq"))).alias("_first"))
    after = heads.selectExpr(*keys, f"first_value(_first) ignore nulls over ({own}order by _bin rows between 1 following and unbounded following) as _after")
    return rows.withColumn("_near", F.expr(near)).join(after, keys).withColumn("target", F.coalesce("_near", "_after")).drop("_bin", "_near", "_after")


def latest(states: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """Per key the row with the greatest order (R8)."""
    rest = [c for c in states.columns if c != key]
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_s")).select(key, "_s.*")


def retry_pending(states: DataFrame, key: str = "object_key") -> DataFrame:
    """Objects whose latest upload failed and may be tried again."""
    return latest(states, key).where("upload = 'retryable_failure'")


def finalized(requests: DataFrame) -> DataFrame:
    """The first request of each idempotency_key."""
    rest = [c for c in requests.columns if c != "idempotency_key"]
    return requests.groupBy("idempotency_key").agg(F.min_by(F.struct(*rest), "seq").alias("_s")).select("idempotency_key", "_s.*")
