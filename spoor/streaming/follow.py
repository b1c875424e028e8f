"""Following a growing trace with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that are appended to a folder of Parquet files; offsets in the checkpoint are the high-water marks (K-1, K-2)."""
    return spark.readStream.schema(schema).parquet(path)


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, millis: int = 200, once: bool = False):
    """Give each batch of new rows to `sink`; `once` takes what there is and ends."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{millis} milliseconds")).start()


def append(stream: DataFrame, path: str, checkpoint: str):
    """Write a stream so that readers see whole batches only (K-3)."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or in local mode, where that is unset, a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(top or 'file://' + tempfile.mkdtemp(prefix='spoor-')).rstrip('/')}/{name}-{uuid.uuid4().hex}"


PENDING = "thread_id long, step_seq long, names array<string>"


def pending_steps(signals: DataFrame) -> DataFrame:
    """thread_id, step_seq, names: each step with the values sent since the step before, once the next one comes (K-5).

    signals: thread_id, seq, kind (step or value), name. The state of a thread is its open step.
    """

    def flush(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, names = state.get if state.exists else (-1, [])
        names, out = list(names), []
        for row in pd.concat(list(parts)).sort_values("seq").itertuples():
            if row.kind == "step":
                if step >= 0:
                    out.append((key[0], step, names))
                    names = []
                step = row.seq
            else:
                names.append(row.name)
        state.update((step, names))
        yield pd.DataFrame(out, columns=["thread_id", "step_seq", "names"])

    grouped = signals.groupBy("thread_id")
    return grouped.applyInPandasWithState(flush, PENDING, "step long, names array<string>", "append", GroupStateTimeout.NoTimeout)


def drain(open_calls: DataFrame, steps: DataFrame) -> DataFrame:
    """Calls that never returned end at the last step of the trace (K-4)."""
    last = steps.agg(F.max("step_id").alias("_last"))
    return open_calls.crossJoin(F.broadcast(last)).withColumn("exit_step", F.coalesce("exit_step", "_last")).drop("_last")
