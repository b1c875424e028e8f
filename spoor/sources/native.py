"""Native bundles: containers with a stream for each thread and a log of OS events."""

from __future__ import annotations

import re
import struct
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .container import THREAD, decode_thread, directory, headers, names, number, read_file, rows_of, streams

# The first bytes of the log's index, and the size of its header.
MAGIC = b"EIDX"
HEADER = 18
OS_EVENT = "geid long, tick long, tid long, kind int, fd int, return_value long, metadata binary, content binary"


def kinds(files: DataFrame) -> DataFrame:
    """path, kind of each file: none (no container), broken (a header that can't be), native or streams.

    A native bundle has metadata in JSON and either a thread's stream or a recording mode.
    """
    heads = headers(files).select("path", "is_container", (F.col("is_readable") & (F.col("block_size") > 0) & F.col("max_entries").between(1, 4096)).alias("good"))
    opened = files.join(heads.where("good").select("path"), "path", "left_semi")
    inside = directory(opened).groupBy("path").agg(F.bool_or(F.col("name") == "meta.json").alias("meta"), F.bool_or(F.col("name").rlike("^t[0-9]+$")).alias("threads"))
    modes = streams(opened, "meta.json").select("path", F.get_json_object(F.col("content").cast("string"), "$.recordingMode").alias("mode"))
    all_of = heads.join(inside, "path", "left").join(modes, "path", "left")
    native = F.coalesce(F.col("meta"), F.lit(False)) & (F.coalesce(F.col("threads"), F.lit(False)) | (F.length("mode") > 0))
    kind = F.when(~F.col("is_container"), "none").when(~F.col("good"), "broken").when(native, "native").otherwise("streams")
    return all_of.select("path", kind.alias("kind"))


def thread_events(files: DataFrame) -> DataFrame:
    """path, thread_id and the events of every thread's stream."""

    def run(batches):
        for path, content in rows_of(batches):
            for name in filter(re.compile(r"t[0-9]+").fullmatch, names(content)):
                rows = decode_thread(read_file(content, name))
                while part := list(islice(rows, 10_000)):
                    columns = [[path] * len(part), [int(name[1:])] * len(part), *zip(*part, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    whole = f"path string, thread_id long, {THREAD}"
    shape = to_arrow_schema(StructType.fromDDL(whole))
    return files.select("path", "content").mapInArrow(run, whole)


def _chunk(data: bytes) -> list[tuple]:
    """The entries of one chunk: fixed fields, then metadata and content behind their lengths."""
    (count,), at, rows = struct.unpack_from("<I", data), 4, []
    for _ in range(count):
        geid, tick, tid, kind, fd, value, size = struct.unpack_from("<QQIBiqH", data, at)
        at += 35
        metadata, at = data[at : at + size], at + size
        (size,) = struct.unpack_from("<I", data, at)
        content, at = data[at + 4 : at + 4 + size], at + 4 + size
        if at > len(data):
            raise ValueError("an entry ends beyond its chunk")
        rows.append((geid, tick, tid, kind, fd, value, metadata, content))
    return rows


def os_events(files: DataFrame) -> DataFrame:
    """path, chunk, entry and the fields of every OS event; a container without a log has none.

    Chunks are cut by the index and are rows of their own before they are decoded.
    """
    index = streams(files, "event_log.idx").withColumnRenamed("content", "_idx")
    good = F.when(F.substring("_idx", 1, 4) == F.lit(MAGIC), number(F.col("_idx"), 14, 4).cast("int")).otherwise(F.raise_error(F.concat(F.lit("no event log index in "), "path")))
    index = index.select("path", "_idx", good.alias("_n")).where("_n > 0").select("path", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.substring("_idx", HEADER + 1 + 8 * i, F.lit(8)))).alias("chunk", "_o"))
    both = index.select("path", "chunk", number(F.col("_o"), 0, 8).cast("int").alias("_at")).join(streams(files, "event_log.dat"), "path")
    size = number(F.col("content"), F.col("_at"), 4).cast("int")
    parts = both.select("path", F.col("chunk").cast("long").alias("chunk"), F.substring("content", F.col("_at") + 5, size).alias("part")).repartition("path", "chunk")

    def run(batches):
        for path, chunk, part in rows_of(batches):
            if rows := _chunk(part):
                columns = [[path] * len(rows), [chunk] * len(rows), range(len(rows)), *zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    whole = f"path string, chunk long, entry long, {OS_EVENT}"
    shape = to_arrow_schema(StructType.fromDDL(whole))
    return parts.mapInArrow(run, whole)


def log_of(chunks: list[list[tuple]]) -> tuple[bytes, bytes]:
    """The data and the index of a log of OS events."""
    data, offsets = bytearray(), b""
    for rows in chunks:
        body = struct.pack("<I", len(rows))
        for *fixed, metadata, content in rows:
            body += struct.pack("<QQIBiqH", *fixed, len(metadata)) + metadata + struct.pack("<I", len(content)) + content
        offsets += struct.pack("<Q", len(data))
        data += struct.pack("<I", len(body)) + body
    return bytes(data), MAGIC + struct.pack("<HIII", 1, sum(map(len, chunks)), max(map(len, chunks), default=0), len(chunks)) + offsets
