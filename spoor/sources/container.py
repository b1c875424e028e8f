"""Trace containers: block-mapped files of named streams, read into DataFrames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import chain, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.scalars import unbase40

# The layout of a container's start.
MAGIC = bytes.fromhex("C0DE72ACE2")
VERSIONS = (2, 3, 4)
HEADER = 16
ENTRY = 24
LEVELS = 5
COMPRESSION = {0: "none", 1: "zstd", 2: "lz4"}
ENCRYPTION = {0: "none", 1: "aes256gcm"}
NAME_CHARS = "\0" + "0123456789abcdefghijklmnopqrstuvwxyz./-"


def open_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of each container under a path."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def number(content: Column, at: int | Column, size: int) -> Column:
    """An unsigned little-endian number at a byte offset."""
    start = F.lit(at) if isinstance(at, int) else at
    digits = F.hex(F.substring(content, (start + 1).cast("int"), F.lit(size)))
    swapped = F.concat(*[F.substring(digits, 2 * (size - i) - 1, 2) for i in range(size)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def headers(files: DataFrame) -> DataFrame:
    """path, is_container, version, is_readable, compression, encryption, max_shards, block_size, max_entries of each file.

    Version 3 has the compression at byte 6 and the encryption at byte 7, and no shards; the others have
    the encryption at byte 6 and the shards at byte 7. Unknown numbers count as none.
    """
    byte = lambda i: number(F.col("content"), i, 1).cast("int")
    name = lambda table, n: F.coalesce(F.get(F.array(*[F.lit(table[k]) for k in sorted(table)]), n), F.lit("none"))
    good, third = F.substring("content", 1, 5) == F.lit(MAGIC), byte(5) == 3
    return files.select(
        "path",
        good.alias("is_container"),
        byte(5).alias("version"),
        (good & byte(5).isin(*VERSIONS)).alias("is_readable"),
        F.when(third, name(COMPRESSION, byte(6))).otherwise("none").alias("compression"),
        name(ENCRYPTION, F.when(third, byte(7)).otherwise(byte(6))).alias("encryption"),
        F.when(third, 1).otherwise(F.greatest(byte(7), F.lit(1))).alias("max_shards"),
        number(F.col("content"), 8, 4).cast("long").alias("block_size"),
        number(F.col("content"), 12, 4).cast("long").alias("max_entries"),
    )


def directory(files: DataFrame) -> DataFrame:
    """path, name, size, map_block of the named files in each container."""
    known = files.withColumn("n", number(F.col("content"), 12, 4).cast("int"))
    slots = known.select("path", "content", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    at = F.col("i") * ENTRY + HEADER
    rows = slots.select("path", number(F.col("content"), at + 16, 8).alias("code"), number(F.col("content"), at, 8).cast("long").alias("size"), number(F.col("content"), at + 8, 8).cast("long").alias("map_block"))
    return rows.where("code > 0").select("path", unbase40(F.col("code")).alias("name"), "size", "map_block")


def data_blocks(data: bytes, root: int, block_size: int) -> Iterator[int]:
    """The numbers of a file's data blocks in order.

    A map block holds pointers and, last, the block that maps the next level: there each pointer leads to a map of the level below.
    """
    width = block_size // 8

    def pointers(block: int) -> tuple[int, ...]:
        return struct.unpack_from(f"<{width}Q", data, block * block_size)

    def below(block: int, level: int) -> Iterator[int]:
        for p in pointers(block)[:-1]:
            if not p:
                return
            if level == 1:
                yield p
            else:
                yield from below(p, level - 1)

    for level in range(1, LEVELS + 1):
        if not root:
            return
        yield from below(root, level)
        root = pointers(root)[-1]


def name_code(name: str) -> int:
    """A file's name in base 40: its first 12 characters, of which those outside the alphabet count as the end mark."""
    return sum(max(NAME_CHARS.find(c), 0) * 40**i for i, c in enumerate(name[:12]))


def names(data: bytes) -> list[str]:
    """The names of a container's files."""
    count, found = struct.unpack_from("<I", data, 12)[0], []
    for i in range(count):
        code = struct.unpack_from("<Q", data, HEADER + i * ENTRY + 16)[0]
        if code:
            found.append("".join(NAME_CHARS[code // 40**k % 40] for k in range(12)).rstrip("\0"))
    return found


def read_file(data: bytes, name: str) -> bytes | None:
    """The bytes of a named file of a container; None if it has no such file."""
    block_size, count = struct.unpack_from("<II", data, 8)
    code = name_code(name)
    for i in range(count):
        size, root, own = struct.unpack_from("<QQQ", data, HEADER + i * ENTRY)
        if own == code:
            need = -(-size // block_size)
            found = list(islice(data_blocks(data, root, block_size), need))
            if len(found) < need:
                raise ValueError(f"{name}: {len(found)} of {need} blocks are mapped")
            return b"".join(data[b * block_size : (b + 1) * block_size] for b in found)[:size]
    return None


def build(files: dict[str, bytes], block_size: int = 4096, max_entries: int = 31) -> bytes:
    """A container of named files, each name of up to 12 characters of 0-9 a-z . / -"""
    width = block_size // 8
    blocks: list[bytearray] = [bytearray(block_size)]

    def new(data: bytes = b"") -> int:
        blocks.append(bytearray(data.ljust(block_size, b"\0")))
        return len(blocks) - 1

    def mapped(numbers: list[int], level: int) -> int:
        """A map of one level over its data blocks."""
        span = (width - 1) ** (level - 1)
        own = numbers if level == 1 else [mapped(numbers[i : i + span], level - 1) for i in range(0, len(numbers), span)]
        return new(struct.pack(f"<{len(own)}Q", *own))

    head = MAGIC + bytes([4, 0, 1]) + struct.pack("<II", block_size, max_entries)
    entries = b""
    for name, data in files.items():
        numbers = [new(data[i : i + block_size]) for i in range(0, len(data), block_size)]
        first, before = 0, 0
        for level in range(1, LEVELS + 1):
            part, numbers = numbers[: (width - 1) ** level], numbers[(width - 1) ** level :]
            if not part and level > 1:
                break
            root = mapped(part, level)
            if before:
                struct.pack_into("<Q", blocks[before], block_size - 8, root)
            first, before = first or root, root
        entries += struct.pack("<QQQ", len(data), first, name_code(name))
    start = head + entries
    if len(start) > block_size or len(files) > max_entries:
        raise ValueError("too many files for the first block")
    blocks[0][: len(start)] = start
    return b"".join(blocks)


def rows_of(batches) -> Iterator[tuple]:
    """The rows of Arrow batches, one at a time: contents may be large, so no batch of them becomes Python values at once."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(column[at].as_py() for column in batch.columns)


def decoded(files: DataFrame, name: str | tuple[str, ...], schema: str, decode) -> DataFrame:
    """Rows that decode(bytes) gives for one named file of each container, or decode(bytes, ...) for several, with the container's path."""
    wanted = (name,) if isinstance(name, str) else name

    def run(batches):
        for path, content in rows_of(batches):
            data = [read_file(content, n) for n in wanted]
            rows = iter(decode(*data)) if None not in data else iter(())
            while part := list(islice(rows, 10_000)):
                columns = list(zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([[path] * len(part), *columns], shape, strict=True)], schema=shape)

    shape = to_arrow_schema(StructType.fromDDL(f"path string, {schema}"))
    return files.select("path", "content").mapInArrow(run, f"path string, {schema}")


def streams(files: DataFrame, name: str) -> DataFrame:
    """path, content of one named file of each container that has it."""
    return decoded(files, name, "content binary", lambda data: iter([(data,)]))


def varints(data: bytes, at: int) -> tuple[int, int]:
    """The LEB128 number at an offset, and the offset after it."""
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


# Step kinds by their tags.
STEP_KINDS = ("absolute", "delta", "raise", "catch", "thread_switch", "thread_start", "thread_exit", "delta_column")


def decode_steps(data: bytes) -> Iterator[tuple]:
    """(step_id, kind, v, message) of a decompressed step stream: v is a position, delta, type or thread."""
    at = n = 0
    while at < len(data):
        kind = STEP_KINDS[data[at]]
        v, at = varints(data, at + 1)
        message = b""
        if kind in ("delta", "delta_column"):
            v = v >> 1 ^ -(v & 1)
        elif kind == "raise":
            size, at = varints(data, at)
            message, at = data[at : at + size], at + size
        yield n, kind, v, message
        n += 1


def encode_steps(rows) -> bytes:
    """The bytes of (kind, v, message) rows."""
    out = bytearray()

    def number(v: int) -> None:
        while v > 127:
            out.append(v & 127 | 128)
            v >>= 7
        out.append(v)

    for kind, v, message in rows:
        out.append(STEP_KINDS.index(kind))
        number((v << 1 ^ v >> 63) & (1 << 64) - 1 if kind in ("delta", "delta_column") else v)
        if kind == "raise":
            number(len(message))
            out += message
    return bytes(out)


def steps(files: DataFrame, name: str = "steps.raw") -> DataFrame:
    """path, step_id, kind, v, message of each container's plain step stream."""
    return decoded(files, name, "step_id long, kind string, v long, message binary", decode_steps)


def fixed_records(files: DataFrame, name: str, size: int) -> DataFrame:
    """path, index, record of a file of records of one size."""
    return decoded(files, name, "index long, record binary", lambda d: ((i // size, d[i : i + size]) for i in range(0, len(d) - size + 1, size)))


def variable_records(files: DataFrame, base: str) -> DataFrame:
    """path, index, record of a table of records, cut at its little-endian 64-bit offsets."""

    def cut(data: bytes, offsets: bytes) -> Iterator[tuple]:
        starts = (start for (start,) in struct.iter_unpack("<Q", offsets[: len(offsets) // 8 * 8]))
        for i, (start, end) in enumerate(pairwise(chain(starts, (len(data),)))):
            if start < end:
                yield i, data[start:end]

    return decoded(files, (f"{base}.dat", f"{base}.off"), "index long, record binary", cut)


def decode_thread(data: bytes) -> Iterator[tuple]:
    """(event_type, ct_tid, geid, tick, payload, stream_offset) of 26-byte headers and the payloads behind them."""
    at = 0
    while at + 26 <= len(data):
        kind, size, tid, geid, tick = struct.unpack_from("<HIIQQ", data, at)
        if at + 26 + size > len(data):
            raise ValueError(f"payload of {size} bytes beyond the stream's end")
        yield kind, tid, geid, tick, data[at + 26 : at + 26 + size], at
        at += 26 + size


THREAD = "event_type int, ct_tid long, geid long, tick long, payload binary, stream_offset long"


def thread_events(files: DataFrame, thread_id: int, name: str) -> DataFrame:
    """path, thread_id, event_type, ct_tid, geid, tick, payload, stream_offset of one thread's stream."""
    rows = decoded(files, name, THREAD, decode_thread)
    return rows.withColumn("thread_id", F.lit(thread_id).cast("long")).select("path", "thread_id", *rows.columns[1:])


def split_traces(spark: SparkSession, folder: str) -> DataFrame:
    """index, path, content of the containers of a split trace, in the order of their names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ct").load(folder)
    order = files.select("path").withColumn("index", F.expr("row_number() over (order by path) - 1"))  # one short row a file
    return files.join(F.broadcast(order), "path").select("index", "path", "content")
