"""Compressed streams cut into frames or chunks, each of which is a row that is decompressed on its own."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .container import decode_steps, decoded, number, rows_of, streams

# The seek table of the seekable Zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
FOOT = 9
HEAD = 8


def seekable(parts: Iterable[bytes], head: bool = False) -> bytes:
    """Each part as a frame, and a seek table: behind them, or of head format before them."""
    parts = list(parts)
    frames = [zstandard.ZstdCompressor(level=3).compress(p) for p in parts]
    sizes = b"".join(struct.pack("<II", len(f), len(p)) for f, p in zip(frames, parts, strict=True))
    foot = struct.pack("<IBI", len(parts), 0, SEEKABLE)
    table = struct.pack("<II", SKIPPABLE, len(sizes) + FOOT) + (foot + sizes if head else sizes + foot)
    return b"".join([table, *frames] if head else [*frames, table])


def seek_table(files: DataFrame, head: bool = False) -> DataFrame:
    """path, frame, compressed_size, size, compressed_at, at of every frame; a file without a seek table raises an error.

    The two offsets are sums over the frames before, so a file's frames meet in one task, its content doesn't.
    """
    content, n = F.col("content"), F.octet_length("content")
    foot: Column | int = HEAD if head else n - FOOT
    count = number(content, foot, 4).cast("int")
    good = number(content, foot + 5, 4).cast("long") == SEEKABLE
    checked = F.when(good, count).otherwise(F.raise_error(F.concat(F.lit("no seek table in "), "path")))
    rows = files.select("path", checked.alias("_n"), content.alias("content"), F.lit(HEAD + FOOT if head else 0).alias("_first"))
    start = F.lit(HEAD + FOOT) if head else n - FOOT - 8 * F.col("_n")
    rows = rows.where("_n > 0").select("path", F.substring("content", start + 1, 8 * F.col("_n")).alias("t"), F.when(F.lit(head), HEAD + FOOT + 8 * F.col("_n")).otherwise(0).alias("_at"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("frame"))
    rows = rows.select("path", "frame", "_at", number(F.col("t"), 8 * F.col("frame"), 4).cast("long").alias("compressed_size"), number(F.col("t"), 8 * F.col("frame") + 4, 4).cast("long").alias("size"))
    before = "over (partition by path order by frame rows between unbounded preceding and current row)"
    return rows.selectExpr("path", "frame", "compressed_size", "size", f"_at + sum(compressed_size) {before} - compressed_size as compressed_at", f"sum(size) {before} - size as at")


def _unpacked(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and data: the frame in the column `packed` of each row, decompressed."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                data = unpack.decompress(row.column(len(keys))[0].as_py(), max_output_size=1 << 31)
                yield pa.RecordBatch.from_arrays([*row.columns[: len(keys)], pa.array([data], pa.binary())], names=[*keys, "data"])

    return rows.select(*keys, "packed").mapInArrow(run, f"{kinds}, data binary")


def frames(files: DataFrame, head: bool = False, low: int = 0, high: int | None = None) -> DataFrame:
    """path, frame, at, data of the frames that hold decompressed bytes from low to before high; by default all.

    Only those frames' bytes leave the JVM, each as a row of its own.
    """
    table = seek_table(files, head).where((F.col("at") >= low) | (F.col("at") + F.col("size") > low))
    table = table if high is None else table.where(F.col("at") < high)
    packed = F.substring(F.col("content"), (F.col("compressed_at") + 1).cast("int"), F.col("compressed_size").cast("int"))
    return _unpacked(table.join(files.select("path", "content"), "path").select("path", "frame", "at", packed.alias("packed")), ["path", "frame", "at"])


def chunked(parts: Iterable[tuple[int, int, bytes]]) -> bytes:
    """A stream of chunks, each behind a header: its compressed size, number of events and first event's number."""
    out = bytearray()
    for count, first, data in parts:
        packed = zstandard.ZstdCompressor(level=3).compress(data)
        out += struct.pack("<IIQ", len(packed), count, first) + packed
    return bytes(out)


def chunks(files: DataFrame, name: str) -> DataFrame:
    """path, chunk, compressed_size, event_count, first, packed of a stream of chunks in each container."""

    def cut(data: bytes) -> Iterator[tuple]:
        at = chunk = 0
        while at + 16 <= len(data):
            size, count, first = struct.unpack_from("<IIQ", data, at)
            if not size:
                return
            yield chunk, size, count, first, data[at + 16 : at + 16 + size]
            at, chunk = at + 16 + size, chunk + 1

    return decoded(files, name, "chunk long, compressed_size long, event_count long, first long, packed binary", cut)


def chunked_steps(files: DataFrame, name: str = "steps.dat") -> DataFrame:
    """path, step_id, kind, v of a step stream in chunks: chunks are spread over tasks before they are decoded."""
    spread = _unpacked(chunks(files, name).select("path", "first", "packed").repartition("path", "first"), ["path", "first"])

    def run(batches):
        for path, first, data in rows_of(batches):
            ids, kinds, vs, _ = zip(*decode_steps(data), strict=True)
            columns = [pa.array([path] * len(ids)), pa.array([first + i for i in ids], pa.int64()), pa.array(kinds), pa.array(vs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["path", "step_id", "kind", "v"])

    return spread.mapInArrow(run, "path string, step_id long, kind string, v long")


def table_of(records: list[bytes], per_chunk: int) -> tuple[bytes, bytes]:
    """A table of records of one size in compressed chunks, and its index: records of a chunk, and where each chunk begins."""
    data, index = bytearray(), bytearray(struct.pack("<I", per_chunk))
    for i in range(0, len(records), per_chunk):
        index += struct.pack("<Q", len(data))
        data += zstandard.ZstdCompressor(level=3).compress(b"".join(records[i : i + per_chunk]))
    return bytes(data), bytes(index)


def table_chunks(files: DataFrame, base: str) -> DataFrame:
    """path, first (number of the chunk's first record), data of each decompressed chunk of a table, found by its index."""
    index = streams(files, f"{base}.idx").select("path", number(F.col("content"), 0, 4).cast("long").alias("_per"), F.col("content").alias("_idx"))
    count = ((F.octet_length("_idx") - 4) / 8).cast("int")
    starts = index.where(F.octet_length("_idx") > 4).select("path", "_per", F.posexplode(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring("_idx", 5 + 8 * i, F.lit(8)))).alias("_chunk", "_o"))
    starts = starts.select("path", "_per", "_chunk", number(F.col("_o"), 0, 8).cast("long").alias("_start"))
    ends = starts.withColumn("_end", F.expr("lead(_start) over (partition by path order by _chunk)"))
    both = ends.join(streams(files, f"{base}.dat").withColumnRenamed("content", "_dat"), "path")
    both = both.withColumn("_end", F.coalesce("_end", F.octet_length("_dat").cast("long")))
    packed = F.substring(F.col("_dat"), (F.col("_start") + 1).cast("int"), (F.col("_end") - F.col("_start")).cast("int"))
    return _unpacked(both.select("path", (F.col("_per") * F.col("_chunk")).alias("first"), packed.alias("packed")), ["path", "first"])


def chunked_records(files: DataFrame, base: str, size: int) -> DataFrame:
    """path, index, record of a table of records of one size in compressed chunks."""
    at = F.sequence(F.lit(0), (F.octet_length("data") / size).cast("int") - 1)
    cut = table_chunks(files, base).where(F.octet_length("data") >= size).select("path", "first", "data", F.explode(at).alias("_i"))
    return cut.select("path", (F.col("first") + F.col("_i")).alias("index"), F.substring(F.col("data"), F.col("_i") * size + 1, F.lit(size)).alias("record"))
