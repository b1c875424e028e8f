"""Storage manifests and upload states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = (
    "trace_id string, segments array<struct<index: int, shards: array<struct<index: int, block_start: bigint, block_end: bigint, "
    "replicas: array<struct<replica_no: int, uri: string>>>>>>"
)
UPLOAD_STATES = ("pending", "uploading", "uploaded", "retryable_failure", "permanent_failure")


def parse(texts: DataFrame, column: str = "value") -> DataFrame:
    """trace_id, segment, shard, block_start, block_end, replica_no, uri from JSON manifests; malformed ones raise an error."""
    rows = texts.select(F.from_json(column, MANIFEST, {"mode": "FAILFAST"}).alias("m"))
    segments = rows.select("m.trace_id", F.explode("m.segments").alias("s"))
    shards = segments.select("trace_id", F.col("s.index").alias("segment"), F.explode("s.shards").alias("h"))
    return shards.select("trace_id", "segment", F.col("h.index").alias("shard"), "h.block_start", "h.block_end", F.explode("h.replicas").alias("r")).select("*", "r.replica_no", "r.uri").drop("r")


def locate(manifest: DataFrame, wanted: DataFrame, width: int = 4096) -> DataFrame:
    """wanted (segment, block_id) with the replicas that hold each block, the first one first (E-4).

    An equality join on segments and bins of blocks: a shard stands in each bin it touches.
    """
    bins = F.sequence(F.floor(F.col("block_start") / width), F.floor(F.col("block_end") / width))
    held = manifest.select("segment", "block_start", "block_end", "replica_no", "uri", F.explode(bins).alias("_bin"))
    met = wanted.withColumn("_bin", F.floor(F.col("block_id") / width)).join(held, ["segment", "_bin"]).where("block_id between block_start and block_end")
    replicas = F.sort_array(F.collect_list(F.struct("replica_no", "uri")))
    return met.groupBy("segment", "block_id").agg(replicas.alias("replicas"))
